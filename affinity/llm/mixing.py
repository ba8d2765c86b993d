"""Mixing sources to target weights by iterative proportional fitting.

Token counts per (source, lang, topic) cell are raked until the weighted
tokens meet all three marginals; documents are then kept with a probability
proportional to the weight of their cell, by a hash of their id.
"""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affinity.llm.common import cut

# Languages x topics at most; both are closed label sets, sources are not.
LABEL_PAIRS = 100_000
SWEEPS = 100_000  # a fit that is still short then says so
TOLERANCE = 1e-6
# Up to so many cells sweeps run on the driver, beyond that as one job each.
DRIVER_CELLS = 1 << 20
# Rounding of the proof that no weights meet the marginals.
PROOF = 1e-12
TEMPERATURE = 0.9
SEED = 42
NONE = "(none)"


def text_form(text: Column) -> Column:
    """A stand-in topic for tables without one: the form of the text."""
    text = F.coalesce(text, F.lit(""))
    n = F.length(text)
    bars = n - F.length(F.replace(text, F.lit("|"), F.lit("")))
    return (F.when(bars * 100 > n, "table").when(n < 500, "note").when(n < 4000, "article").otherwise("long"))


def tokens_of(text: Column) -> Column:
    """Space-separated tokens; an empty or null text weighs one."""
    return F.size(F.split(F.coalesce(text, F.lit("")), " ")).cast("long")


def _keys(docs: DataFrame) -> list[Column]:
    def named(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(NONE)) if c in docs.columns else F.lit(NONE)
    topic = named("topic") if "topic" in docs.columns else text_form(F.col("text"))
    return [named("source").alias("_s"), named("lang").alias("_l"), topic.alias("_t")]


def cells_of(docs: DataFrame) -> DataFrame:
    """(_s, _l, _t, tokens): one row per cell, partial sums before the shuffle."""
    return (docs.select(*_keys(docs), tokens_of(F.col("text")).alias("n"))
            .groupBy("_s", "_l", "_t").agg(F.sum("n").alias("tokens")))


def _tempered(totals: dict[str, float], power: float) -> dict[str, float]:
    raised = {k: v ** power for k, v in totals.items()}
    return {k: v / sum(raised.values()) for k, v in raised.items()}


def rake(cells: DataFrame, targets: dict[str, dict[str, float]] | None = None,
         temperature: float = TEMPERATURE) -> DataFrame:
    """(_s, _l, _t, tokens, weight): raked weights of a written cell table.

    ``targets`` may give shares for "source", "lang" and "topic"; a missing one
    is the tempered share of the data (share ** temperature, normalised).
    Shares of categories without tokens are left out and the rest normalised.
    A category that a given target does not name gets weight 0; a target that
    names no category of the data raises ValueError.

    The fit ends when all marginals are met to ``TOLERANCE``.  It ends short of
    that only if the growth of the factors proves that no weights can meet them
    and the gap has come to rest (or after ``SWEEPS``); a warning then names the
    remaining gap of each marginal.

    The proof: weights that meet the marginals have the mean log growth V = sum
    of share x log growth over all factors, so V cannot be above the largest
    log growth of a single cell.

    Up to ``DRIVER_CELLS`` cells sweep on the driver; beyond that each sweep is
    one job, source factors stay distributed, and only language x topic
    matrices reach the driver.
    """
    spark, targets = cells.sparkSession, targets or {}
    pair = cells.groupBy("_l", "_t").agg(F.sum("tokens").alias("w")).limit(LABEL_PAIRS + 1).collect()
    if len(pair) > LABEL_PAIRS:
        raise ValueError(f"more than {LABEL_PAIRS} language-topic pairs")
    langs, topics = sorted({r["_l"] for r in pair}), sorted({r["_t"] for r in pair})
    if not pair:
        return cells.withColumn("weight", F.lit(1.0))

    place_l, place_t = {k: i for i, k in enumerate(langs)}, {k: i for i, k in enumerate(topics)}

    def matrix(rows, name: str = "w", empty: float = 0.0) -> np.ndarray:
        out = np.full((len(langs), len(topics)), empty)
        for r in rows:
            if r[name] is not None:
                out[place_l[r["_l"]], place_t[r["_t"]]] = r[name]
        return out

    def shares(name: str, labels: list[str], totals: np.ndarray) -> np.ndarray:
        goal = targets.get(name) or _tempered(dict(zip(labels, totals)), temperature)
        out = np.array([float(goal.get(k, 0)) * (t > 0) for k, t in zip(labels, totals)])
        if out.sum() <= 0:
            raise ValueError(f"no {name} that the target names has tokens")
        return out / out.sum()

    w = matrix(pair)
    want_l, want_t = shares("lang", langs, w.sum(1)), shares("topic", topics, w.sum(0))
    by_source = cells.groupBy("_s").agg(F.sum("tokens").alias("total"))
    if "source" in targets:
        given = spark.createDataFrame(sorted(targets["source"].items()), "_s string, raw double")
        goal = by_source.join(given, "_s", "left").select("_s", F.coalesce("raw", F.lit(0.0)).alias("raw"))
    else:
        goal = by_source.select("_s", F.pow("total", F.lit(temperature)).alias("raw"))
    goal = cut(goal, "mix-goal")
    mass = goal.agg(F.sum("raw")).first()[0]
    if not mass or mass <= 0:
        raise ValueError("no source that the target names has tokens")
    goal = goal.select("_s", (F.col("raw") / F.lit(mass)).alias("want"))
    b, c = np.ones(len(langs)), np.ones(len(topics))

    b0, c0 = b, c

    def fitted(b: np.ndarray, c: np.ndarray, b0: np.ndarray, c0: np.ndarray) -> DataFrame:
        """Weights by the factors, and the log growth of the source's factor since b0, c0."""
        factors = [(la, to, float(b[i] * c[j]), float(b0[i] * c0[j])) for i, la in enumerate(langs) for j, to in enumerate(topics)]
        part = cells.join(F.broadcast(spark.createDataFrame(factors, "_l string, _t string, f double, f0 double")), ["_l", "_t"])
        a = part.groupBy("_s").agg(*(F.sum(F.col("tokens") * F.col(k)).alias(m) for k, m in (("f", "m"), ("f0", "m0")))).join(
            goal, "_s").select("_s", F.when(F.col("m") > 0, F.col("want") / F.col("m")).otherwise(0.0).alias("a"),
                               F.when((F.col("m") > 0) & (F.col("m0") > 0), F.log(F.col("m0") / F.col("m"))).alias("grown"))
        return part.join(a, "_s").select("_s", "_l", "_t", "tokens", (F.col("a") * F.col("f")).alias("weight"), "grown")

    def sweep_by_job(*factors: np.ndarray):
        mass = F.col("tokens") * F.col("weight")
        rows = fitted(*factors).groupBy("_l", "_t").agg(
            F.sum(mass).alias("w"), F.sum(F.when(mass > 0, mass * F.col("grown"))).alias("v"),
            F.max(F.when(mass > 0, F.col("grown"))).alias("m")).collect()
        return matrix(rows), matrix(rows, "v").sum(), matrix(rows, "m", -np.inf)

    sweep = sweep_by_job
    if cells.count() <= DRIVER_CELLS:
        held = cells.join(goal, "_s").select("_s", "_l", "_t", "tokens", "want").toPandas()
        _, first, source = np.unique(held["_s"].to_numpy(str), return_index=True, return_inverse=True)
        row, col = held["_l"].map(place_l).to_numpy(int), held["_t"].map(place_t).to_numpy(int)
        tokens, want_s = held["tokens"].to_numpy(float), held["want"].to_numpy(float)[first]
        pair_of, n_pairs = row * len(topics) + col, len(langs) * len(topics)

        def sweep(b, c, b0, c0):
            f = b[row] * c[col]
            m, m0 = np.bincount(source, tokens * f), np.bincount(source, tokens * b0[row] * c0[col])
            a = np.divide(want_s, m, out=np.zeros_like(m), where=m > 0)
            grown = np.log(np.divide(m0, m, out=np.ones_like(m), where=(m > 0) & (m0 > 0)))
            mass = tokens * a[source] * f
            most = np.full(n_pairs, -np.inf)
            np.maximum.at(most, pair_of[mass > 0], grown[source[mass > 0]])
            got = np.bincount(pair_of, mass, n_pairs).reshape(len(langs), -1)
            return got, float(mass @ grown[source]), most.reshape(len(langs), -1)

    def growth(new: np.ndarray, old: np.ndarray) -> np.ndarray:
        return np.log(np.divide(new, old, out=np.ones_like(new), where=(new > 0) & (old > 0)))

    last, short = np.inf, False
    for _ in range(SWEEPS):
        got, mean, most = sweep(b, c, b0, c0)
        gaps = {"lang": np.abs(got.sum(1) - want_l).max(), "topic": np.abs(got.sum(0) - want_t).max(),
                "source": abs(1 - got.sum())}  # each source is met as far as it has cells left
        off = max(gaps.values())
        if off <= TOLERANCE:
            break
        grown_l, grown_t = growth(b, b0), growth(c, c0)
        cell = (most + grown_l[:, None] + grown_t[None, :])[most > -np.inf].max(initial=-np.inf)
        # proved once, it holds: cells that lost all their mass, or a mean above the largest
        short = short or gaps["source"] > TOLERANCE or mean + want_l @ grown_l + want_t @ grown_t > cell + PROOF
        if short and abs(off - last) <= TOLERANCE * last:
            break
        last, b0, c0 = off, b, c
        for _ in range(200):  # rake the small matrix fully before the next pass over the sources
            rows, cols = got.sum(1), None
            r = np.divide(want_l, rows, out=np.zeros_like(rows), where=rows > 0)
            got, b = got * r[:, None], b * r
            cols = got.sum(0)
            s = np.divide(want_t, cols, out=np.zeros_like(cols), where=cols > 0)
            got, c = got * s, c * s
            if max(np.abs(r[want_l > 0] - 1).max(), np.abs(s[want_t > 0] - 1).max()) < 1e-10:
                break
        b, c = b / b.max(), c / c.max()  # the sources take up the scale
    if off > TOLERANCE:
        warnings.warn("mixing: " + ("no weights meet the marginals" if short else f"not met after {SWEEPS} sweeps")
                      + "".join(f"; {k} is off by {v:.3g}" for k, v in gaps.items()), RuntimeWarning, stacklevel=2)
    return cut(fitted(b, c, b, c).drop("grown"), "mix-weights")


def unit_hash(seed: int, id_col: str = "doc_id", text_col: str = "text") -> Column:
    """A value in [0, 1) from the document id, or its text where the id is null."""
    key = F.coalesce(F.col(id_col).cast("string"), F.col(text_col), F.lit(""))
    return F.shiftrightunsigned(F.xxhash64(key, F.lit(seed)), 11) / F.lit(float(1 << 53))


def with_probability(docs: DataFrame, targets: dict | None = None, temperature: float = TEMPERATURE) -> DataFrame:
    """``row`` (a struct of the document's columns), ``mix_weight, mix_probability``.

    The weight is per token; the probability is the weight over the largest
    one, so expected kept tokens have the target marginals and the cell that
    is short by most is kept whole.
    """
    cells = cut(cells_of(docs), "mix-cells")
    weights = rake(cells, targets, temperature)
    top = weights.agg(F.max("weight")).first()[0] or 1.0
    weights = weights.select("_s", "_l", "_t", F.col("weight").alias("mix_weight"),
                             (F.col("weight") / F.lit(top)).alias("mix_probability"))
    # no hint: Spark broadcasts the written table if its size is below the threshold, else AQE splits hot cells
    return docs.select(F.struct(*docs.columns).alias("row"), *_keys(docs)).join(weights, ["_s", "_l", "_t"]).select(
        "row", "mix_weight", "mix_probability")


def sample(docs: DataFrame, targets: dict | None = None, temperature: float = TEMPERATURE, seed: int = SEED) -> DataFrame:
    """The sampled documents: ``row`` (their columns), ``mix_weight, mix_probability``.

    Needs ``doc_id`` and ``text``; null or missing sources, languages and
    topics are a category of their own; a null or empty text counts as one
    token.  Rows with one id are kept or left together if they share a cell;
    null ids go by their text.  An empty table gives an empty result.  Documents
    travel as one struct, so extra columns cannot clash; a ``topic`` column is
    used where there is one, else the text's form stands in.
    """
    return with_probability(docs, targets, temperature).where(
        unit_hash(seed, "row.doc_id", "row.text") < F.col("mix_probability"))
