"""The three jobs end to end: written tables read back equal to the plans."""

import os

import pytest

from affinity.operators.distribution import user_tag_distribution
from affinity.plans import jobs
from affinity.plans.catalog import EVAL_DATE, K, N, N_TAGS, TO_DATE, WINDOW_DAYS
from affinity.session import shared_dir
from affinity.sources.sinks import distribution_table_name, recommendation_table_name
from affinity.sources.testdata import testdata_inputs as load_testdata

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="generated tables not present")


def _rows(df, cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


@pytest.fixture(scope="module")
def inputs(spark):
    return load_testdata(spark, SF, N_TAGS)


def test_table_names():
    assert distribution_table_name("user") == "UserTagDistribution"
    assert distribution_table_name("city") == "cityTagDistribution"
    assert recommendation_table_name("phone") == "RecommendationBasedOnphone"
    with pytest.raises(ValueError):
        distribution_table_name("planet")


def test_rec_job_writes_enriched_list(spark, inputs, tmp_path):
    out = jobs.run_rec(inputs, "user", K, N, TO_DATE, WINDOW_DAYS, path=str(tmp_path / "rec"))
    recs = jobs.recommendations(inputs, "user", K, N, TO_DATE, WINDOW_DAYS)
    assert set(out.columns) == {"video_id", "up_id", "rank", "source", "tags"}
    cols = ["up_id", "video_id", "rank", "source"]
    assert _rows(out, cols) == _rows(recs.join(inputs.items.dense(), "video_id"), cols)
    assert all(len(r.tags) == N_TAGS for r in out.select("tags").collect())


def test_train_job_stores_distribution_and_scores(spark, inputs, tmp_path):
    res = jobs.run_train(inputs, "city", K, N, "20010101", EVAL_DATE, WINDOW_DAYS,
                         path=str(tmp_path / "train"))
    cols = ["reside_city", "tag_idx", "n", "total", "prob"]
    fresh = jobs.label_tag_distribution("city", inputs.profile, inputs.history, inputs.items,
                                        "20010101", EVAL_DATE)
    assert _rows(res.distribution, cols) == _rows(fresh, cols)
    p = res.precision.collect()[0]
    assert p.recommended > 0 and 0 <= p.hits <= p.recommended


def test_stat_job(spark, inputs):
    out = jobs.run_stat(inputs, TO_DATE, weeks=3, offset_weeks=1).collect()
    assert sorted(r.week for r in out) == [0, 1, 2]


def test_default_location_is_the_shared_folder(spark, inputs):
    from affinity.sources.sinks import save_distribution
    dist = user_tag_distribution(inputs.history, inputs.items, "20010101", TO_DATE)
    stored = save_distribution(dist, "user")
    base = shared_dir(spark).replace("file:", "")
    assert any(base in f for f in stored.inputFiles())


def test_cut_lineage_writes_to_the_shared_folder(spark):
    from affinity.session import cut_lineage
    df = spark.range(10).withColumnRenamed("id", "x")
    out = cut_lineage(df, "unit")
    base = shared_dir(spark).replace("file:", "")
    assert sorted(r.x for r in out.collect()) == list(range(10))
    assert all(base in f and "/unit-" in f for f in out.inputFiles())


def test_runs_never_share_a_default_path(spark, inputs):
    from affinity.sources.sinks import save_distribution
    dist = user_tag_distribution(inputs.history, inputs.items, "20010101", TO_DATE)
    a, b = save_distribution(dist, "user"), save_distribution(dist.limit(1), "user")
    assert a.count() == dist.count() and b.count() == 1


def test_dense_form_is_stored(spark, inputs, tmp_path):
    res = jobs.run_train(inputs, "phone", K, N, "20010101", EVAL_DATE, WINDOW_DAYS,
                         path=str(tmp_path / "dense"), form="dense")
    assert res.distribution.columns == ["phone_type", "prob"]
    assert all(len(r.prob) == N_TAGS and abs(sum(r.prob) - 1) < 1e-9 for r in res.distribution.collect())


def test_cluster_without_shared_folder_is_an_error():
    from affinity import session

    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return Conf()

    class Session:
        sparkContext = Context()
    with pytest.raises(RuntimeError):
        session.shared_dir(Session())
