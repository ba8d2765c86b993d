"""Hard-negative mining with a cover tree over norm-augmented candidates.

Candidates get one more component, ``sqrt(M^2 - |x|^2)``, so all lie on a
sphere of radius M and the inner product with a query is a cosine.  A node has
a centre (one of its points) and a measured covering radius, hence a cap of the
sphere; the angle between query and centre, plus and minus the cap's, bounds
the inner products of everything below it.  The top level is global: every row
goes to the nearest of a few centres, its cell, and a cell is dealt in parts to
tasks, each of which keeps its lower levels as flat arrays in one written row.

Anchors first descend in their own cell for their positives; the k-th score
found there lets them skip most other cells.  With the positives known, an
anchor visits only cells whose bounds meet one of its score windows.  Inside a
tree a task's anchors descend together, each best leaves first, skipping nodes
outside its windows or below what it has found; leaves are verified in exact
integers.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinity.llm.common import cut

# Rows that the top level's centres are chosen from, and their number at most.
SAMPLE, CENTRES = 4_096, 32
# Bytes of vectors in one tree, and anchors that one task serves, on average.
TREE_BYTES, GROUP_ROWS = 8 << 20, 1_024
# Children of a node at most, and points of a leaf.
FAN, LEAF = 16, 128
# Squared lengths, and so scores, stay below this.
LIMIT = 1 << 62
# Relative rounding allowed to the bounds.
SLACK = 1e-7


def integer_rows(vectors: DataFrame, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding",
                 label_col: str = "label") -> DataFrame:
    """(id, label, v): v = floor(scale * x) as BIGINTs.

    Rows with a null id, label or vector, or a null or non-finite component,
    take no part; rows that repeat an id count once (smallest label, vector).
    """
    x = F.col("x")
    good = x.isNotNull() & F.col("id").isNotNull() & F.col("label").isNotNull() & F.forall(
        x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    first = F.min(F.struct("label", "v")).alias("s")
    return (vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"),
                           F.col(vector_col).cast("array<double>").alias("x"))
            .where(F.coalesce(good, F.lit(False)))
            .select("id", "label", F.transform("x", lambda c: F.floor(F.lit(scale) * c).cast("long")).alias("v"))
            .groupBy("id").agg(first).select("id", "s.label", "s.v"))


def matrix(cells, width: int) -> np.ndarray:
    """Integer rows, padded with zeros."""
    out = np.zeros((len(cells), width), np.int64)
    for k, c in enumerate(cells):
        out[k, :len(c)] = c
    return out


def augmented(points: np.ndarray, radius: float) -> np.ndarray:
    """Points moved onto the sphere of ``radius`` in one more dimension."""
    p = points.astype(float)
    rest = np.sqrt(np.maximum(radius * radius - (p * p).sum(1), 0))
    return np.hstack([p, rest[:, None]])


def distances(points: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(((points - centre) ** 2).sum(1), 0))


def spread(points: np.ndarray, first: int, most: int, enough: float) -> tuple[list[int], np.ndarray, np.ndarray]:
    """(centres, nearest centre, distance to it): the farthest point is next, until all are within ``enough``.

    Centres are further than ``enough`` from each other; with ``most`` centres
    the points left keep the larger distance they have.
    """
    centres, near = [first], np.zeros(len(points), np.int64)
    far = distances(points, points[first])
    while len(centres) < most:
        at = int(far.argmax())
        if far[at] <= enough:
            break
        d = distances(points, points[at])
        closer = d < far
        near[closer], far[closer] = len(centres), d[closer]
        centres.append(at)
    return centres, near, far


class CoverTree:
    """Flat arrays: node i covers ``order[start[i]:end[i]]`` within ``radius[i]`` of ``centre[i]``."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, points: np.ndarray):
        size = float(np.sqrt((points.astype(float) ** 2).sum(1).max(initial=0)))
        up = augmented(points, size)
        order = np.arange(len(ids))
        start, end, centre, radius, child, children = [0], [len(ids)], [0], [0.0], [0], [0]
        # a node's centre is also the centre of its first child; levels halve the radius
        if len(ids):
            radius[0] = float(distances(up, up[0]).max())
        todo = [0] if len(ids) else []
        while todo:
            i = todo.pop()
            part = order[start[i]:end[i]].copy()
            if len(part) <= LEAF or radius[i] == 0:
                continue
            here = up[part]
            centres, near, far = spread(here, int(np.flatnonzero(part == centre[i])[0]), FAN, radius[i] / 2)
            child[i], children[i] = len(start), len(centres)
            at = start[i]
            for k, c in enumerate(centres):
                mine = near == k
                rows = part[mine]
                todo.append(len(start))
                start.append(at)
                end.append(at + len(rows))
                centre.append(int(part[c]))
                radius.append(float(far[mine].max()))
                child.append(0)
                children.append(0)
                order[at:at + len(rows)] = rows
                at += len(rows)
        self.size, self.most = size, float(np.abs(points.astype(float)).max(initial=0))
        self.start, self.end = np.array(start), np.array(end)
        self.child, self.children = np.array(child), np.array(children)
        self.centre, self.radius = (up[centre] if len(ids) else np.zeros((1, up.shape[1]))), np.array(radius)
        self.ids, self.labels, self.points = ids[order], labels[order], points[order]
        # a node of one label is skipped by those who look for another
        self.one_label = np.array([bool(len(ids)) and s < e and (self.labels[s:e] == self.labels[s]).all()
                                   for s, e in zip(start, end)])


def bounds(query: np.ndarray, centre: np.ndarray, radius: np.ndarray, size: float) -> tuple[np.ndarray, np.ndarray]:
    """(lowest, highest) inner product of a query, or of each, with points in caps of the sphere."""
    length = np.sqrt((query * query).sum(-1))
    reach = np.maximum(length * size, 1e-300)[..., None]
    turn = 2 * np.arcsin(np.clip(radius / max(2 * size, 1e-300), 0, 1))
    angle = np.arccos(np.clip(query @ centre[:, :-1].T / reach, -1, 1))
    wide = reach * SLACK + SLACK
    return (reach * np.cos(np.minimum(angle + turn, np.pi)) - wide, reach * np.cos(np.maximum(angle - turn, 0)) + wide)


def exact_products(points: np.ndarray, queries: np.ndarray, most: float) -> np.ndarray:
    """Inner products (point, query) of integers up to ``most``, none beyond 2^62 (float BLAS where that is exact)."""
    if most * float(np.abs(queries.astype(float)).max(initial=0)) * points.shape[1] < 2 ** 53:
        return (points.astype(float) @ queries.astype(float).T).astype(np.int64)
    return points @ queries.T


def _merged(slot: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best (score, then smaller id) of every slot."""
    order = np.lexsort((ids, -score, slot))
    slot, score, ids = slot[order], score[order], ids[order]
    first = np.ones(len(slot), bool)
    first[1:] = slot[1:] != slot[:-1]
    starts = np.flatnonzero(first)
    keep = np.arange(len(slot)) - np.repeat(starts, np.diff(np.append(starts, len(slot)))) < k
    return slot[keep], score[keep], ids[keep]


def descend(tree: CoverTree, queries: np.ndarray, own: np.ndarray, labels: np.ndarray, same: bool,
            owner: np.ndarray, lows: np.ndarray, highs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window, score, id): for every window of scores its k best in the tree, ties to the smaller id.

    Window w belongs to query ``owner[w]`` and holds scores from ``lows[w]`` to
    ``highs[w]``.  Only rows of the query's label (``same``) or of another one
    count, never its own row.  All queries go down together: a node stays alive
    for a query while its bounds meet one of the query's windows, above what
    the window has found.  Each round opens every query's best leaves, twice as
    many as the round before, and drops the nodes that the new finds rule out.
    """
    none = np.zeros(0, np.int64)
    if not len(tree.ids) or not len(owner):
        return none, none, none
    low, high = bounds(queries.astype(float), tree.centre, tree.radius, tree.size)
    # nothing to find where all points have the label that is not wanted
    wrong = tree.one_label[None, :] & ((tree.labels[tree.start][None, :] == labels[:, None]) != same)
    floors = lows.copy()
    found = (none, none, none)
    order = np.argsort(owner, kind="stable")
    begins = np.searchsorted(owner[order], np.arange(len(queries) + 1))
    most = int(np.diff(begins).max())
    shut = np.zeros(low.shape, bool)  # opened leaves
    leaves = np.flatnonzero(tree.children == 0)
    step = 1
    while True:
        meets = np.zeros(low.shape, bool)
        for nth in range(most):
            has = np.flatnonzero(begins[:-1] + nth < begins[1:])
            w = order[begins[has] + nth]
            meets[has] |= (high[has] >= floors[w, None]) & (low[has] <= highs[w, None])
        alive = meets & ~wrong & ~shut
        for node in np.flatnonzero(tree.children):  # parents stand before their children
            alive[:, tree.child[node]:tree.child[node] + tree.children[node]] &= alive[:, node, None]
        bound = np.where(alive[:, leaves], high[:, leaves], -np.inf)
        if not alive[:, leaves].any():
            return found
        if step < len(leaves):
            edge = np.partition(bound, len(leaves) - step, axis=1)[:, len(leaves) - step, None]
            pick = (bound >= edge) & (bound > -np.inf)
        else:
            pick = bound > -np.inf
        parts = [found]
        for leaf, at in zip(leaves[pick.any(0)].tolist(), np.flatnonzero(pick.any(0))):
            rows = slice(tree.start[leaf], tree.end[leaf])
            who = np.flatnonzero(pick[:, at])
            ids, score = tree.ids[rows], exact_products(tree.points[rows], queries[who], tree.most)
            fits = ((tree.labels[rows][:, None] == labels[None, who]) == same) & (ids[:, None] != own[None, who])
            for nth in range(most):
                has = np.flatnonzero(begins[who] + nth < begins[who + 1])
                w = order[begins[who[has]] + nth]
                here = score[:, has]
                r, c = np.nonzero(fits[:, has] & (here >= floors[None, w]) & (here <= highs[None, w]))
                parts.append((w[c], here[r, c], ids[r]))
            shut[who, leaf] = True
        found = _merged(*(np.concatenate(x) for x in zip(*parts)), k)
        # the k-th score of a full window is the least that still counts
        full = np.flatnonzero(np.bincount(found[0], minlength=len(owner)) == k)
        last = np.searchsorted(found[0], full, side="right") - 1
        floors[full] = np.maximum(floors[full], found[1][last])
        step *= 2


def _top_level(rows: DataFrame, width: int, size: float) -> np.ndarray:
    """Augmented centres of the cells, spread over a bounded sample in hashed order."""
    some = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").collect()
    up = augmented(matrix([r["v"] for r in some], width), size)
    return up[spread(up, 0, CENTRES, 0.0)[0]]


def _celled(rows: DataFrame, centres: np.ndarray, width: int, size: float) -> DataFrame:
    """Rows with ``cell``, the nearest centre, and ``far``, the distance to it."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        half = (centres * centres).sum(1) / 2
        for frame in frames:
            up = augmented(matrix(frame["v"], width), size)
            frame["cell"] = (up @ centres.T - half).argmax(1).astype("int32") if len(up) else np.zeros(0, "int32")
            frame["far"] = distances(up, centres[frame["cell"].to_numpy()])
            yield frame
    return rows.mapInPandas(run, "id long, label long, v array<long>, cell int, far double")


_FOUND = "anchor long, slot int, id long, score long"


def _search(trees: DataFrame, asked: DataFrame, same: bool, k: int) -> DataFrame:
    """The k best of every (anchor, window) of each tree.

    ``asked``: (cell, part, grp, anchor, label, v, slots, lows, highs), one row
    per anchor and tree to visit.
    """
    def run(key: tuple, asked: pd.DataFrame, tree: pd.DataFrame) -> pd.DataFrame:
        out = {"anchor": [], "slot": [], "id": [], "score": []}
        if len(tree) and len(asked):
            built: CoverTree = pickle.loads(tree["tree"].iloc[0])
            n = np.array([len(s) for s in asked["slots"]])
            anchor = asked["anchor"].to_numpy()
            owner = np.repeat(np.arange(len(asked)), n)
            window, score, ids = descend(
                built, matrix(asked["v"], built.points.shape[1]), anchor, asked["label"].to_numpy(), same, owner,
                np.concatenate(asked["lows"].to_list()), np.concatenate(asked["highs"].to_list()), k)
            out = {"anchor": anchor[owner[window]], "slot": np.concatenate(asked["slots"].to_list())[window], "id": ids, "score": score}
        return pd.DataFrame(out)

    return asked.groupBy("cell", "part", "grp").cogroup(trees.groupBy("cell", "part", "grp")).applyInPandas(run, _FOUND)


def _k_best(found: DataFrame, k: int) -> DataFrame:
    """(anchor, slot, rank, id, score): the k best of each anchor's slot, from at most k per tree."""
    order = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "id"))), 1, k)
    return (found.groupBy("anchor", "slot").agg(order.alias("best"))
            .select("anchor", "slot", F.posexplode("best").alias("rank", "b"))
            .select("anchor", "slot", (F.col("rank") + 1).alias("rank"), F.col("b.id").alias("id"), (-F.col("b.s")).alias("score")))


def mine(rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 10,
         low_pct: int = 30, high_pct: int = 90) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``rows`` and ``anchors`` are (id, label, v) with distinct ids (see
    ``integer_rows``), anchors being some of the rows.  A row's score is its
    integer inner product with the anchor, higher first, ties by smaller id.
    An anchor's positives are its best ``positives`` other rows of its label;
    for each, the best ``negatives`` rows of another label whose score lies
    between ``low_pct`` and ``high_pct`` percent of the positive's (a negative
    positive score leaves no such range).  Fewer rows give fewer results;
    anchors without positives or positives without negatives give none.
    Shorter vectors count as padded with zeros, equal vectors all stay.  Empty
    inputs give an empty result.  Vectors of a squared length from 2^62 on raise
    ValueError, as their scores may not fit a BIGINT.
    """
    spark = rows.sparkSession
    rows = cut(rows, "cover-rows")
    norm = F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double"))
    shape = rows.agg(F.max(F.size("v")).alias("d"), F.max(norm).alias("m")).first()
    if shape["d"] is None:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, "
                                         "positive_score long, negative_score long")
    if shape["m"] >= LIMIT:
        raise ValueError("inner products of these components may not fit 64 bits")
    width, size = max(1, shape["d"]), float(np.sqrt(shape["m"])) * (1 + 1e-12)
    centres = _top_level(rows, width, size)
    celled = _celled(rows, centres, width, size)
    # parts of a cell by its bytes, so a cell of many copies is spread as well
    celled = cut(celled, "cover-cells")
    cells = celled.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("far")).collect()  # <= CENTRES rows
    parts = {c["cell"]: -(-c["n"] * 8 * width // TREE_BYTES) for c in cells}
    reach = np.array([next((c["far"] for c in cells if c["cell"] == i), -1.0) for i in range(len(centres))]) * (1 + 1e-9)
    n_parts = reduce(lambda e, c: F.when(F.col("cell") == c, parts[c]).otherwise(e), parts, F.lit(1))
    part = F.pmod(F.xxhash64("id"), n_parts).cast("int").alias("part")

    def build(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("id")
        tree = CoverTree(frame["id"].to_numpy(), frame["label"].to_numpy(), matrix(frame["v"], width))
        return pd.DataFrame({"cell": [key[0]], "part": [key[1]], "tree": [pickle.dumps(tree, protocol=5)]})

    trees = cut(celled.select("id", "label", "v", "cell", part).groupBy("cell", "part")
                .applyInPandas(build, "cell int, part int, tree binary"), "cover-trees")
    asked = cut(celled.join(anchors.select("id"), "id", "left_semi")
                .select(F.col("id").alias("anchor"), "label", "v", "cell"), "cover-anchors")
    n_groups = max(1, -(-asked.count() // GROUP_ROWS))
    every = F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1))).alias("grp")
    trees = trees.select("*", every)

    def dealt(queries: DataFrame, own: bool | None) -> DataFrame:
        """One row per anchor and tree that its windows can reach."""
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                low, high = bounds(matrix(frame["v"], width).astype(float), centres, np.maximum(reach, 0), size)
                meets = np.zeros(low.shape, bool)
                for r, (lows, highs) in enumerate(zip(frame["lows"], frame["highs"])):
                    meets[r] = ((high[r][None, :] >= np.asarray(lows, float)[:, None])
                                & (low[r][None, :] <= np.asarray(highs, float)[:, None])).any(0)
                home = frame["cell"].to_numpy()[:, None] == np.arange(len(centres))[None, :]
                visit = (reach >= 0)[None, :] & (home if own else meets & ~home if own is False else meets)
                r, c = np.nonzero(visit)
                yield frame.iloc[r].assign(cell=c.astype("int32"))
        shape = "anchor long, label long, v array<long>, cell int, slots array<int>, lows array<long>, highs array<long>"
        to = queries.select("anchor", "label", "v", "cell", "slots", "lows", "highs").mapInPandas(run, shape)
        return to.select("*", F.explode(F.sequence(F.lit(0), (n_parts - 1).cast("int"))).alias("part"),
                         F.pmod(F.xxhash64("anchor"), F.lit(n_groups)).cast("int").alias("grp"))

    least, most = -LIMIT, LIMIT

    def whole(low):
        return (F.array(F.lit(0)).alias("slots"), F.array(low.cast("long")).alias("lows"),
                F.array(F.lit(most).cast("long")).alias("highs"))

    # positives: the own cell first, then the cells that may hold better ones
    home = cut(_search(trees, dealt(asked.select("*", *whole(F.lit(least))), True), True, positives), "cover-home")
    ranked = _k_best(home, positives)
    floor = ranked.where(F.col("rank") == positives).select("anchor", F.col("score").alias("floor"))
    further = asked.join(floor, "anchor", "left").select("anchor", "label", "v", "cell", *whole(F.coalesce("floor", F.lit(least))))
    other = _search(trees, dealt(further, False), True, positives)
    pos = cut(_k_best(home.union(other), positives).select(
        "anchor", F.col("rank").alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "cover-positives")
    # negatives: ceil(low_pct * p / 100) <= score <= floor(high_pct * p / 100)
    def share(pct: int, more: int):
        return F.expr(f"(CAST(positive_score AS DECIMAL(20,0)) * {pct} + {more}) DIV 100")

    windows = (pos.where("positive_score >= 0")
               .select("anchor", F.struct("slot", share(low_pct, 99).alias("lo"), share(high_pct, 0).alias("hi")).alias("w"))
               .groupBy("anchor").agg(F.sort_array(F.collect_list("w")).alias("w"))
               .select("anchor", F.col("w.slot").alias("slots"), F.col("w.lo").alias("lows"), F.col("w.hi").alias("highs")))
    found = _search(trees, dealt(asked.join(windows, "anchor"), None), False, negatives)
    return (_k_best(found, negatives).join(pos, ["anchor", "slot"])
            .select(F.col("anchor").alias("anchor_id"), "positive_id", "rank", F.col("id").alias("negative_id"),
                    "positive_score", F.col("score").alias("negative_score")))
