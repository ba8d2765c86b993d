"""Document quality by Bradley-Terry pairwise ranking.

A document's strength is a linear score of features of its text alone.  The
weights are learned from preference pairs (a document marked good against one
marked bad) by logistic loss on the feature differences; a quantile of the
scores of all documents then decides what is kept.  The fit reads a bounded
sample of labelled rows; the bad share counts all labels outside the held-out
fold.  Scoring is one pass over all documents without a shuffle.
"""

from __future__ import annotations

import math
import operator
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinity.llm.common import cut

# Labelled documents that the fit reads at most (a seeded hash picks them).
LABELLED_ROWS = 20_000
# Preference pairs drawn from them; each good document meets random bad ones.
PAIRS = 200_000
RIDGE = 1e-2
SEED = 42
CUT = 0.3  # the score that the chosen quantile is mapped to
RANKS = 100_000  # the sketch that brackets the quantile is off by 1 / RANKS of the rows at most

_CLASSES = np.zeros((256, 8))
for _k, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:?", b"!", b"|",
                             b"#$%&*@~^_=+<>{}[]\\/", b"\n", bytes(range(128, 256)))):
    _CLASSES[list(_chars), _k] = 1
N_FEATURES = _CLASSES.shape[1] + 10


def features(text: str | None) -> list[float]:
    """Length, character classes, word length and repetition of a whole text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    shares = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _CLASSES / max(1, len(raw))
    words = raw.lower().split()
    m = max(1, len(words))
    counts = Counter(words)
    top = sorted(counts.values(), reverse=True)[:5]
    lines = [x for x in raw.split(b"\n") if x]
    return [*shares.tolist(), math.log1p(len(raw)), math.log1p(len(words)), sum(map(len, words)) / m,
            math.log1p(max(map(len, words), default=0)), len(counts) / m, max(top, default=0) / m, sum(top) / m,
            sum(map(operator.eq, words, words[1:])) / m, len(set(lines)) / max(1, len(lines)),
            math.log1p(len(raw) / max(1, len(lines)))]


@dataclass(frozen=True)
class Model:
    """score = sigmoid(logit(CUT) + (strength - threshold) / scale)."""

    mean: np.ndarray
    deviation: np.ndarray
    weights: np.ndarray
    threshold: float
    scale: float

    def strength(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.deviation, -8, 8) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.log(CUT / (1 - CUT)) + (self.strength(x) - self.threshold) / self.scale
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def fit(x: np.ndarray, good: np.ndarray, pairs: int = PAIRS, seed: int = SEED) -> Model:
    """Fit on feature rows and their 0/1 marks.

    Newton steps on the pairwise logistic loss with a ridge term.  The
    threshold is the quantile of the sample's strengths at the share of bad
    rows.  Without both marks there is no pair: all strengths are zero and
    every document gets the cut's own score.
    """
    mean, deviation = x.mean(axis=0) if len(x) else np.zeros(N_FEATURES), x.std(axis=0) if len(x) else np.ones(N_FEATURES)
    deviation = np.where(deviation > 1e-9, deviation, 1.0)
    z = np.clip((x - mean) / deviation, -8, 8)
    up, down = z[good == 1], z[good == 0]
    w = np.zeros(N_FEATURES)
    if not len(up) or not len(down):
        return Model(mean, deviation, w, 0.0, 1.0)
    rng = np.random.default_rng(seed)
    d = up[rng.integers(0, len(up), pairs)] - down[rng.integers(0, len(down), pairs)]
    for _ in range(25):
        p = 1 / (1 + np.exp(np.clip(d @ w, -500, 500)))  # of losing
        step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / pairs + RIDGE * np.eye(len(w)),
                               d.T @ p / pairs - RIDGE * w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    s = z @ w
    threshold = float(np.quantile(s, (good == 0).mean()))
    return Model(mean, deviation, w, threshold, float(max(s.std() / 4, 1e-9)))


def held_out(doc_id="doc_id"):
    """Rows that the fit never sees: crc32 of the id as text divisible by 5."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def _feature_rows(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([features(t.as_py()) for t in b.column(1)], pa.list_(pa.float64()))],
                names=["quality", "x"])
    return rows.select("quality", "text").mapInArrow(run, "quality int, x array<double>")


def train(docs: DataFrame, labels: DataFrame, max_rows: int = LABELLED_ROWS) -> Model:
    """Fit on at most ``max_rows`` labelled documents outside the held-out fold.

    Threshold and scale are the quantile and deviation of the strengths of all
    documents, at the bad share of all labels outside that fold.  Rows of
    ``labels`` with a null id or mark are left out; a repeated label row counts
    once.
    """
    usable = (labels.select("doc_id", F.col("quality").cast("int").alias("quality"))
              .where("doc_id IS NOT NULL AND quality IN (0, 1)").where(~held_out()).distinct())
    chosen = (usable.orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id", "quality").limit(max_rows))
    # max_rows bounds the broadcast side and, once repeated ids are cut, the fit
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    got = (_feature_rows(rows).withColumn("k", F.xxhash64("quality", "x")).orderBy("k", "x").limit(max_rows)
           .select("quality", "x").collect())
    x = np.array([r["x"] for r in got], float).reshape(-1, N_FEATURES)
    model = fit(x, np.array([r["quality"] for r in got], int))
    if not model.weights.any():
        return model
    strengths = cut(_strengths(docs, model), "quality-strengths")
    share = usable.agg(F.avg(1 - F.col("quality"))).first()[0]
    spread = strengths.agg(F.stddev_pop("s")).first()[0]
    return replace(model, threshold=_quantile(strengths, share), scale=max(spread / 4, 1e-9))


def _strengths(docs: DataFrame, model: Model) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = np.array([features(t.as_py()) for t in b.column(0)], float)
                yield pa.RecordBatch.from_arrays([pa.array(model.strength(x))], names=["s"])
    return docs.select(F.col("text").cast("string")).mapInArrow(run, "s double")


def _quantile(values: DataFrame, share: float) -> float:
    """The exact quantile (interpolated) of column ``s``: a sketch brackets it, the ranks inside are counted."""
    n = values.count()
    slack = 2 / RANKS + 2 / n
    low, high = values.agg(F.percentile_approx("s", [max(0.0, share - slack), min(1.0, share + slack)], RANKS)).first()[0]
    below = values.where(F.col("s") < low).count()
    inside = values.where(F.col("s").between(low, high)).groupBy("s").count().orderBy("s").collect()
    ends = below + np.cumsum([r["count"] for r in inside])  # rank behind the last row of each value
    at = share * (n - 1)
    left, right = (inside[int(np.searchsorted(ends, k, side="right"))]["s"] for k in (math.floor(at), math.ceil(at)))
    return left + (right - left) * (at - math.floor(at))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, held_out, score, predicted``.

    Null texts count as empty and are scored like any other text.  Null, tied
    or repeated ids keep their rows (a null id is not held out); an empty table
    gives an empty result.  Only the two named columns are read, so extra
    columns cannot clash.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = np.array([features(t.as_py()) for t in b.column(1)], float)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(x))], schema=schema)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, score double").select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Model) -> DataFrame:
    """The documents whose score reaches the cut, all columns as they were."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = np.array([features(t.as_py()) for t in b.column(at)], float)
                yield b.filter(pa.array(model.score(x) >= CUT))
    return docs.mapInArrow(run, docs.schema)
