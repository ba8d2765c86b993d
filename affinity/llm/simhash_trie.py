"""SimHash near-duplicates by a binary trie self-join.

Fingerprints are computed per document; equal ones are reduced to one class
before anything is compared.  A pair within ``max_bits`` of each other agrees
on at least one of ``max_bits + 1`` bit blocks, so the trie is cut into the
subtries below each block value (every fingerprint belongs to ``max_bits + 1``
of them) and the subtries are spread over the cluster.  Inside a subtrie, node
pairs are traversed together: going down one bit adds a differing bit when the
two children disagree, and a pair whose error exceeds the budget is pruned.
Tasks return a spanning forest of the links they found, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinity.llm.common import arrow_rows, connected_components, cut

SEED = 42
# A subtrie with more classes is dealt out as pairs of parts of this size.
SUBTRIE_ROWS = 200_000
# Rows of subtries per task on average; with the size above it bounds a task's arrays.
TASK_ROWS = 1_000_000
# Node pairs expanded at once; bounds the memory of the traversal.
FRONTIER = 1 << 19


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """64-bit SimHash (unsigned) of a text; no words give 0."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return 0
    digest = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    if n <= shingle:
        return digest(joined, SEED)
    size = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(size + 1) - 1
    starts = ends - size
    hashes = np.array([digest(joined[s:e], SEED) for s, e in
                       zip(starts[:n - shingle + 1].tolist(), ends[shingle - 1:].tolist())], "<u8")
    ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > hashes.size, bitorder="little")
    return int(bits.view("<u8")[0])


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def fingerprints(docs: DataFrame, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, fp, size, mark): fp is the fingerprint's bits as a signed BIGINT;
    size and mark (a 64-bit hash) tell the texts of a repeated doc_id apart."""
    def run(cols):
        return {"doc_id": cols["doc_id"], "fp": [_signed(fingerprint(t, shingle)) for t in cols["text"]],
                "size": cols["size"], "mark": cols["mark"]}
    text = F.col(text_col).cast("string")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), *_text_key(text))
    return arrow_rows(source, run, pa.schema([(c, pa.int64()) for c in ("doc_id", "fp", "size", "mark")]),
                      "doc_id long, fp long, size long, mark long")


def _text_key(text):
    return (F.coalesce(F.octet_length(text), F.lit(-1)).cast("long").alias("size"), F.xxhash64(text).alias("mark"))


def block_masks(max_bits: int) -> list[int]:
    """Signed masks of ``max_bits + 1`` bit blocks that cover all 64 bits."""
    edges = [64 * i // (max_bits + 1) for i in range(max_bits + 2)]
    return [_signed(((1 << (hi - lo)) - 1) << lo) for lo, hi in zip(edges, edges[1:])]


def subtries(classes: DataFrame, max_bits: int) -> DataFrame:
    """(block, value, i, j, side, fp): each class once per subtrie it belongs to.

    Subtries beyond ``SUBTRIE_ROWS`` classes are split into g hashed parts and
    dealt out as part pairs (i, j), so one hot block value never is one task.
    """
    rows = classes.select("fp", F.explode(F.array(*[
        F.struct(F.lit(n).alias("block"), F.col("fp").bitwiseAND(F.lit(mask)).alias("value"))
        for n, mask in enumerate(block_masks(max_bits))])).alias("b")).select("b.block", "b.value", "fp")
    # at most (max_bits + 1) * classes / SUBTRIE_ROWS rows
    hot = (rows.groupBy("block", "value").count().where(F.col("count") > SUBTRIE_ROWS)
           .select("block", "value", F.ceil(F.col("count") / SUBTRIE_ROWS).cast("int").alias("g")))
    part = F.pmod(F.xxhash64("fp"), F.coalesce("g", F.lit(1))).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.coalesce("g", F.lit(1)) - 1))
    return (rows.join(hot, ["block", "value"], "left").withColumn("p", part).withColumn("q", other)
            .select("block", "value", F.least("p", "q").alias("i"), F.greatest("p", "q").alias("j"),
                    (F.col("p") > F.col("q")).cast("int").alias("side"), "fp"))


def trie_pairs(fps: np.ndarray, roots: np.ndarray, max_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs within ``max_bits`` of each other, by traversing node pairs.

    ``fps`` (uint64) is sorted inside each root; a trie node is a range of it.
    ``roots`` has rows (a_lo, a_hi, b_lo, b_hi): the node pairs to start from,
    with a == b for a self-join.
    """
    todo = [(63, roots, np.zeros(len(roots), np.int64))]
    while todo:
        bit, nodes, error = todo.pop()
        if len(nodes) > FRONTIER:
            half = len(nodes) // 2
            todo += [(bit, nodes[:half], error[:half]), (bit, nodes[half:], error[half:])]
            continue
        alo, ahi, blo, bhi = nodes.T
        leaf = (ahi - alo == 1) & (bhi - blo == 1)
        if leaf.any():
            a, b = alo[leaf], blo[leaf]
            near = (np.bitwise_count(fps[a] ^ fps[b]) <= max_bits) & (a != b)
            if near.any():
                yield a[near], b[near]
            alo, ahi, blo, bhi, error = (x[~leaf] for x in (alo, ahi, blo, bhi, error))
        if bit < 0 or not len(alo):
            # below the last bit only equal fingerprints share a node
            for la, ha, lb, hb in zip(alo, ahi, blo, bhi):
                a, b = np.meshgrid(np.arange(la, ha), np.arange(lb, hb), indexing="ij")
                keep = a.ravel() != b.ravel()
                yield a.ravel()[keep], b.ravel()[keep]
            continue
        ones = np.concatenate(([0], np.cumsum((fps >> np.uint64(bit)) & np.uint64(1), dtype=np.int64)))
        amid, bmid = ahi - (ones[ahi] - ones[alo]), bhi - (ones[bhi] - ones[blo])
        same = (alo == blo) & (ahi == bhi)
        kids = np.concatenate([
            np.stack([alo, amid, blo, bmid], 1), np.stack([amid, ahi, bmid, bhi], 1),
            np.stack([alo, amid, bmid, bhi], 1), np.stack([amid, ahi, blo, bmid], 1)])
        cost = np.concatenate([error, error, error + 1, error + 1])
        keep = (cost <= max_bits) & (kids[:, 0] < kids[:, 1]) & (kids[:, 2] < kids[:, 3])
        keep[3 * len(alo):] &= ~same  # of a self-pair, the mirrored child pair
        keep &= ~((kids[:, 1] - kids[:, 0] == 1) & (kids[:, 0] == kids[:, 2]))
        todo.append((bit - 1, kids[keep], cost[keep]))


class Forest:
    """Union-find over 0..n-1 that joins whole arrays of pairs."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        root = self.root
        while True:
            ra, rb = root[a], root[b]
            open_ = ra != rb
            if not open_.any():
                return
            a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
            np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
            while True:
                up = root[root]
                if np.array_equal(up, root):
                    break
                root[:] = up


def _links(max_bits: int):
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        rows = pa.Table.from_batches(got)
        key = [rows[c].to_numpy() for c in ("block", "value", "i", "j", "side")]
        fps = rows["fp"].to_numpy().view(np.uint64)
        order = np.lexsort((fps, *key[::-1]))
        key, fps = [k[order] for k in key], fps[order]
        new = np.ones(len(fps), bool)  # first row of each (subtrie, part pair, side)
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in key])
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], len(fps))
        side, i, j = key[4][starts], key[2][starts], key[3][starts]
        selfs = np.stack([starts, ends, starts, ends], 1)[(i == j) & (ends - starts > 1)]
        # side 0 of a part pair stands right before its side 1
        tasks = np.logical_and.reduce([k[starts][1:] == k[starts][:-1] for k in key[:4]]) & (side[1:] != side[:-1])
        at = np.flatnonzero(tasks)
        cross = np.stack([starts[at], ends[at], starts[at + 1], ends[at + 1]], 1)
        ids, index = np.unique(fps, return_inverse=True)
        forest = Forest(len(ids))
        for a, b in trie_pairs(fps, np.concatenate([selfs, cross]), max_bits):
            forest.join(index[a], index[b])
        linked = np.flatnonzero(forest.root != np.arange(len(ids)))
        yield pa.RecordBatch.from_arrays([pa.array(ids[linked].view(np.int64)),
                                          pa.array(ids[forest.root[linked]].view(np.int64))], schema=schema)
    return run


def links(classes: DataFrame, max_bits: int) -> DataFrame:
    """(u, v): a spanning forest of all pairs of fingerprints within ``max_bits``."""
    rows = (max_bits + 1) * classes.count()
    tasks = max(int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))
    dealt = subtries(classes, max_bits).repartition(tasks, "block", "value", "i", "j")
    return dealt.mapInArrow(_links(max_bits), "u long, v long")


def near_duplicates(docs: DataFrame, shingle: int = 4, max_bits: int = 4,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, fingerprint, component_id``.

    ``fingerprint`` is 16 lowercase hex digits; ``component_id`` the smallest
    doc_id reachable over links of at most ``max_bits`` differing bits.

    Null texts count as empty and get fingerprint zero, which links like any
    other.  Equal texts share one class, so ties and repeated rows cost one
    comparison; each input row gives one output row.  A null doc_id keeps its
    row: it takes the smallest non-null doc_id of its component, or null if
    there is none.  An empty table gives an empty result.  Only the two named
    columns are read, so extra columns cannot clash.
    """
    rows = cut(fingerprints(docs, shingle, id_col, text_col), "simhash-rows")
    labelled = _labelled(rows.groupBy("fp").agg(F.min("doc_id").alias("rep")), max_bits)
    least = cut(labelled.groupBy("label").agg(F.min("rep").alias("component_id")), "simhash-least")
    by_fp = cut(labelled.join(least.hint("merge"), "label").select("fp", "component_id"), "simhash-components")
    return (rows.join(by_fp.hint("merge"), "fp")
            .select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"))


def _labelled(classes: DataFrame, max_bits: int) -> DataFrame:
    """The classes of equal fingerprints with ``label``, the same for all of a component."""
    classes = cut(classes, "simhash-classes")
    groups = connected_components(links(classes.select("fp"), max_bits))
    return cut(classes.join(groups, classes["fp"] == groups["node"], "left")
               .select(*classes.columns, F.coalesce("component", "fp").alias("label")), "simhash-labels")


def keep_one(docs: DataFrame, shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """The documents with one row of each near-duplicate group.

    Rows are judged one by one: of a group, the row with the smallest doc_id
    stays, of several such rows the one with the shortest text (then the
    smaller text hash).  A doc_id that repeats on unlike texts therefore keeps
    a row in each group where it is the smallest.  Rows equal in doc_id and
    text are reduced to the first by their JSON form, so columns of any type
    (maps too) may follow.  Rows with a null doc_id cannot be told apart by id:
    they link others, and all stay.  Null texts count as empty; an empty table
    gives an empty result; extra columns are kept, whatever their names.
    """
    rows = cut(fingerprints(docs, shingle, "doc_id", "text"), "simhash-rows")
    key = ("doc_id", "size", "mark")
    # nulls sort last here, as a group may be led by an id from any of its rows
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct(*key))).alias("rep")
    labelled = _labelled(rows.groupBy("fp").agg(first), max_bits)
    winners = cut(labelled.where("rep IS NOT NULL").groupBy("label").agg(F.min("rep").alias("rep"))
                  .select(*[F.col(f"rep.{c}").alias(f"_w_{c}") for c in key]).distinct(), "simhash-winners")
    text = docs["text"].cast("string")
    same = [docs["doc_id"].cast("long") == winners["_w_doc_id"],
            *[k == winners[f"_w_{c}"] for k, c in zip(_text_key(text), key[1:])]]
    won = docs.join(winners, reduce(lambda a, b: a & b, same), "left_semi")
    unnamed = docs.where(docs["doc_id"].isNull())
    repeated = cut(rows.groupBy(*key).count().where("count > 1 AND doc_id IS NOT NULL")
                   .select(*[F.col(c).alias(f"_w_{c}") for c in key]), "simhash-repeated")
    if repeated.isEmpty():
        return won.unionByName(unnamed)
    alike = reduce(lambda a, b: a & b, [won["doc_id"].cast("long") == repeated["_w_doc_id"],
                                        *[k == repeated[f"_w_{c}"] for k, c in zip(_text_key(won["text"].cast("string")), key[1:])]])
    row = F.struct(*[won[c] for c in docs.columns])
    one = (won.join(repeated, alike, "left_semi").select(row.alias("r"), F.to_json(row).alias("j"))
           .groupBy(F.col("r.doc_id").alias("i"), F.xxhash64("r.text").alias("m"))
           .agg(F.min_by("r", "j").alias("r")).select("r.*"))
    return won.join(repeated, alike, "left_anti").unionByName(one).unionByName(unnamed)
