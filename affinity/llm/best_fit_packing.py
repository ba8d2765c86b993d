"""Bounded-space online best-fit packing of tokenised documents.

A document becomes its token ids plus an end id.  Only documents longer than a
sequence are cut; the remainder is the first piece, so the other pieces fill
a sequence each and need no packing.  The rest go through best-fit: a task
keeps a fixed number of open bins, found through a bitset keyed by free space,
and closes the fullest when it needs room.  Items arrive in hashed order and
are taken longest first from a short look-ahead, which fills bins almost
completely.  What tasks leave open is packed again, bins as items, in rounds
with fewer tasks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinity.llm.common import cut

CAPACITY = 2048
END_ID = 0
OPEN_BINS = 1024
# Items a task holds back to place the longest of them first.
LOOKAHEAD = 2048
# Pieces per packing task on average.
TASK_ROWS = 16_384
# Packing tasks whose open bins meet in one task of the next round.
FAN_IN = 32
# Sequence numbers of one task, and of one round, are this far from those of the next.
TASK_STRIDE, ROUND_STRIDE = 1 << 32, 1 << 56


class _Encoder:
    """Token ids of texts, as the tokenizers library gives them for ``path``.

    ``ranks`` names the same vocabulary as a rank file, which a faster encoder
    reads; a text that holds a special token's string goes to the slower one.
    """

    def __init__(self, path: str, ranks: str | None, pattern: str | None):
        from tokenizers import Tokenizer
        self.slow = Tokenizer.from_file(path)
        self.special = [t.content for t in self.slow.get_added_tokens_decoder().values()]
        self.fast = None
        if ranks:
            import base64

            import tiktoken
            with open(ranks, "rb") as lines:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})

    def __call__(self, text: str) -> list[int]:
        if self.fast is None or any(t in text for t in self.special):
            return self.slow.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


_ENCODERS: dict[tuple, _Encoder] = {}


def encoder(path: str, ranks: str | None = None, pattern: str | None = None) -> _Encoder:
    key = (path, ranks, pattern)
    if key not in _ENCODERS:
        _ENCODERS[key] = _Encoder(*key)
    return _ENCODERS[key]


def public_encoder_args(name: str = "byte_bpe_50k") -> tuple[str, str, str]:
    import public_tokenizers
    return (public_tokenizers.path(f"{name}.json"), public_tokenizers.path(f"{name}.tiktoken"),
            public_tokenizers.PATTERN)


def cuts(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, end) of the pieces of n tokens: the remainder first, then full ones."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(s, s + capacity) for s in range(first, n, capacity)]


class BestFit:
    """Open bins by free space; ``mask`` has bit f set if a bin with f free is open."""

    def __init__(self, capacity: int, open_bins: int, first: int):
        self.capacity, self.open_bins, self.next = capacity, open_bins, first
        self.mask, self.count = 0, 0
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _take(self, free: int) -> int:
        stack = self.bins[free]
        out = stack.pop()
        if not stack:
            self.mask &= ~(1 << free)
        self.count -= 1
        return out

    def put(self, length: int) -> tuple[int, int]:
        """(bin, offset) of an item in the open bin that it fills best."""
        fits = self.mask >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            number = self._take(free)
        else:
            if self.count == self.open_bins:  # the fullest closes
                self._take((self.mask & -self.mask).bit_length() - 1)
            free, number = self.capacity, self.next
            self.next += 2
        left = free - length
        if left:
            self.bins[left].append(number)
            self.mask |= 1 << left
            self.count += 1
        return number, self.capacity - free

    def still_open(self) -> set[int]:
        return {b for stack in self.bins for b in stack}


def pieces(docs: DataFrame, tokenizer: tuple, capacity: int, id_col: str, text_col: str,
           with_ids: bool) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every document."""
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
              ("ids_crc32", pa.int64())] + [("ids", pa.binary())] * with_ids
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(*tokenizer)
        for batch in batches:
            out: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.array(encode(text.as_py() or "") + [END_ID], "<u4")
                for k, (s, e) in enumerate(cuts(len(ids), capacity)):
                    raw = ids[s:e].tobytes()
                    out.append((doc, k, s, e - s, zlib.crc32(raw)) + (raw,) * with_ids)
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long"
                             + (", ids binary" if with_ids else ""))


def _packer(capacity: int, open_bins: int, level: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # odd numbers: packed sequences; even ones: full pieces
        bins = BestFit(capacity, open_bins, 1 + ROUND_STRIDE * level + TASK_STRIDE * TaskContext.get().partitionId())
        for batch in batches:
            for at in range(0, batch.num_rows, LOOKAHEAD):
                block = batch.slice(at, LOOKAHEAD)
                length = block.column("length").to_numpy()
                placed = np.empty((len(length), 2), np.int64)
                for k in np.argsort(-length, kind="stable").tolist():
                    placed[k] = bins.put(int(length[k]))
                yield pa.RecordBatch.from_arrays(
                    [*block.columns, pa.array(placed[:, 0]), pa.array(placed[:, 1])], schema=schema)
        left = sorted(bins.still_open())
        if left:  # rows without a key name the bins that are still open
            empty = pa.nulls(len(left), pa.int64())
            yield pa.RecordBatch.from_arrays([empty, empty, pa.array(left, pa.int64()), empty], schema=schema)
    return run


def _best_fit(items: DataFrame, tasks: int, level: int, capacity: int, open_bins: int) -> DataFrame:
    """``items`` (key, length) with bin and offset, and a row without a key for each open bin."""
    dealt = (items.select("key", "length").withColumn("_order", F.xxhash64("key", F.lit(level)))
             .repartition(tasks, "_order").sortWithinPartitions("_order", "key").drop("_order"))
    schema = pa.schema([(c, pa.int64()) for c in ("key", "length", "bin", "offset")])
    return dealt.mapInArrow(_packer(capacity, open_bins, level, schema),
                            "key long, length long, bin long, offset long")


def pack(docs: DataFrame, tokenizer: tuple | None = None, capacity: int = CAPACITY,
         open_bins: int = OPEN_BINS, id_col: str = "doc_id", text_col: str = "text",
         with_ids: bool = True) -> DataFrame:
    """Pack documents into sequences of at most ``capacity`` tokens.

    Returns one row per piece: ``doc_id, piece, start, length, ids_crc32,
    sequence_id, offset`` and, with ``with_ids``, the piece's ids as
    little-endian unsigned 32-bit integers.  Offsets of a sequence are gapless
    from 0.  ``tokenizer`` is (tokenizers file, rank file or None, pattern).

    A null text is empty and becomes its end id alone.  Null, tied or repeated
    doc_ids are kept: every row is a document of its own.  Texts of any length
    are cut, never shortened.  An empty table gives an empty result.  Only the
    two named columns are read, so extra columns cannot clash.
    """
    # the piece number of the table row, not the document, identifies a piece
    whole = cut(pieces(docs, tokenizer or public_encoder_args(), capacity, id_col, text_col, with_ids)
                .withColumn("key", F.monotonically_increasing_id()), "pack-pieces")
    full = whole.where(F.col("length") == capacity).select(
        "*", (F.col("key") * 2).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    part = whole.where(F.col("length") < capacity).select("key", "length")
    tasks, level, items, placed = max(1, -(-part.count() // TASK_ROWS)), 0, part, None
    while True:
        got = cut(_best_fit(items, tasks, level, capacity, open_bins), "pack-round")
        rows = got.where("key IS NOT NULL")
        if placed is None:
            placed = rows
        else:  # bins were the items: their pieces move along
            moved = rows.select(F.col("key").alias("old"), F.col("bin").alias("into"), F.col("offset").alias("shift"))
            placed = cut(placed.join(moved, placed["bin"] == moved["old"], "left").select(
                "key", "length", F.coalesce("into", "bin").alias("bin"),
                (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset")), "pack-placed")
        if tasks == 1:
            break
        left = got.where("key IS NULL").select("bin")
        items = placed.join(left, "bin", "left_semi").groupBy(F.col("bin").alias("key")).agg(
            F.sum("length").alias("length"))
        tasks, level = -(-tasks // FAN_IN), level + 1
    packed = whole.where(F.col("length") < capacity).drop("length").join(placed, "key").withColumnRenamed("bin", "sequence_id")
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] + ["ids"] * with_ids
    return full.select(*columns).unionByName(packed.select(*columns))
