r"""Chat formatting over a prefix tree of conversations.

Conversations that share their first turns share nodes of a tree: a node is a
turn together with all turns before it.  Every node's formatted text is emitted
once, in depth-first order; a node carries its position in the conversation and
the intervals of the emission that hold its ancestors, so packed attention sees
what the single conversation would have seen.  The unit is the code point.

The tree is never built in one place.  The smallest conversation through a
node owns it, and what a conversation owns is one stretch at the end of its
path.  Stretches sort into depth-first order by the branch points above them,
so a range sort and a running sum lay out the whole forest, however many
conversations share a first turn.

Template: ``<|im_start|>role\ntext<|im_end|>\n`` per turn.  Control strings
inside texts and roles get a backslash after their first character; one that
already has backslashes there gets one more, so the escape can be undone.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinity.llm.common import cut

START, END = "<|im_start|>", "<|im_end|>\n"
# Control strings of common chat templates, without their first character.
CONTROLS = r"(?:\|im_start\|>|\|im_end\|>|/?s>|/?INST\]|</?SYS>>)"
_ESCAPE = re.compile(rf"([<\[]\\*)(?={CONTROLS})")
_UNESCAPE = re.compile(rf"([<\[]\\*)\\(?={CONTROLS})")
_TURN = re.compile(r"<\|im_start\|>(.*?)\n(.*?)<\|im_end\|>\n", re.S)
_ROLE = re.compile(r"\\(.)", re.S)
LOSS_ROLE = "assistant"


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\1\\", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def format_turn(role: str | None, text: str | None) -> tuple[str, int, int]:
    """(formatted turn, start and length of its text inside it)."""
    head = START + escape((role or "").replace("\\", "\\\\").replace("\n", "\\n")) + "\n"
    body = escape(text or "")
    return head + body + END, len(head), len(body)


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of formatted turns."""
    return [(_ROLE.sub(lambda m: "\n" if m[1] == "n" else m[1], unescape(r)), unescape(t))
            for r, t in _TURN.findall(formatted)]


_PATH = [("conv_id", pa.int64()), ("depth", pa.int32()), ("node", pa.string()), ("role", pa.string()),
         ("formatted", pa.string()), ("length", pa.int64()), ("position", pa.int64()), ("loss_start", pa.int64()),
         ("loss_length", pa.int64())]
_PATH_DDL = ("conv_id long, depth int, node string, role string, formatted string, length long, position long, "
             "loss_start long, loss_length long")


def _paths(conversations: DataFrame) -> DataFrame:
    """One row per turn with its node: a digest of it and all turns before it.

    Turns stream through in order with the state of one conversation, so its
    length does not matter.
    """
    schema = pa.schema(_PATH)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, depth, node, at = None, 0, b"", 0
        for batch in batches:
            out = []
            for conv_id, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if conv_id != conv:
                    conv, depth, node, at = conv_id, 0, b"", 0
                turn, start, size = format_turn(role, text)
                node = hashlib.blake2b(node + turn.encode("utf-8", "surrogatepass"), digest_size=16).digest()
                loss = role == LOSS_ROLE
                out.append((conv_id, depth, node.hex(), role, turn, len(turn), at, start if loss else None,
                            size if loss else 0))
                depth, at = depth + 1, at + len(turn)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                                F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    ordered = (rows.where("conv_id IS NOT NULL").repartition("conv_id")
               .sortWithinPartitions("conv_id", "turn", "role", "text").drop("turn"))
    return ordered.mapInArrow(run, _PATH_DDL)


def _laid_out(segments: DataFrame) -> DataFrame:
    """``segments`` (conv_id, key, size, ...) with ``start``: the running sum of sizes in key order."""
    spark = segments.sparkSession
    fields = [f for f in segments.schema if f.name != "key"]
    arrow = pa.schema([(f.name, pa.int64()) for f in fields] + [("local", pa.int64()), ("task", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, task = 0, TaskContext.get().partitionId()
        for batch in batches:
            local = []
            for n in batch.column("size").to_pylist():
                local.append(at)
                at += n
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(local, pa.int64()), pa.array([task] * len(local), pa.int64())], schema=arrow)
    ordered = segments.repartitionByRange("key").sortWithinPartitions("key").drop("key")
    placed = cut(ordered.mapInArrow(run, ", ".join(f"{n} long" for n in arrow.names)), "chat-layout")
    # one row per task
    totals = placed.groupBy("task").agg(F.sum("size").alias("n")).orderBy("task").collect()
    at, offsets = 0, []
    for row in totals:
        offsets.append((row["task"], at))
        at += row["n"]
    base = spark.createDataFrame(offsets, "task long, base long")
    return placed.join(F.broadcast(base), "task").withColumn("start", F.col("base") + F.col("local")).drop(
        "task", "base", "local", "size")


def prefix_tree(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, paths) of a table ``conv_id, turn, role, text``.

    nodes, one row per distinct prefix: ``node, tree_id, owner, depth, role,
    formatted, start, length, position, loss_start, loss_length,
    segment_start, ancestors``.  ``start`` is the offset in the emission, in
    which every tree and subtree is contiguous; ``position`` the position id of
    its first code point; the loss mask covers ``loss_length`` code points from
    ``loss_start`` of an assistant turn.  A node attends to the intervals
    ``ancestors`` (start, end) and to [segment_start, itself].
    paths, one row per turn: ``conv_id, depth, node``.

    Turns are ordered by turn, then role and text; nulls come first, repeated
    rows are turns of their own.  A null text or role is empty.  Rows without a
    conv_id belong to no conversation and are left out.  Texts and
    conversations of any length are formatted whole; an empty table gives empty
    results.  Only the four named columns are read, so extra columns cannot
    clash.
    """
    turns = cut(_paths(conversations), "chat-turns")
    # written tables on both sides of the joins below, so that AQE splits hot first turns
    owners = cut(turns.groupBy("node").agg(F.min("conv_id").alias("owner")), "chat-owners")
    owned = cut(turns.select("conv_id", "depth", "node", "length", "position").join(owners.hint("merge"), "node"), "chat-owned")
    # a path is runs of owners; a run starts where the owner's own stretch starts
    runs = (owned.groupBy("conv_id", "owner").agg(F.min("depth").alias("depth"), F.min("position").alias("position"),
                                                  F.sum("length").alias("size")))
    branch = F.sort_array(F.collect_list(F.struct("depth", "owner", "position")))
    stretches = cut(runs.groupBy("conv_id").agg(
        branch.alias("runs"), F.max(F.when(F.col("owner") == F.col("conv_id"), F.col("size"))).alias("size"))
        .where("size IS NOT NULL"), "chat-stretches")
    key = F.transform("runs", lambda r: F.struct((-r["depth"]).alias("up"), r["owner"].alias("owner")))
    layout = cut(_laid_out(stretches.select(
        "conv_id", key.alias("key"), "size", F.element_at("runs", 1)["owner"].alias("tree_id"),
        F.element_at("runs", -1)["position"].alias("first"))), "chat-segments")
    # the part of an ancestor's stretch that a conversation runs through
    last = F.size("runs")
    above = stretches.select("conv_id", F.explode(F.transform(F.slice("runs", 1, last - 1), lambda r, i: F.struct(
        r["owner"].alias("owner"), r["depth"].alias("depth"),
        (F.element_at("runs", i + 2)["position"] - r["position"]).alias("n")))).alias("r")).select(
            F.col("conv_id").alias("below"), "r.*")
    intervals = (above.join(layout.select("conv_id", "start").hint("merge"), above["owner"] == layout["conv_id"])
                 .groupBy("below").agg(F.sort_array(F.collect_list(F.struct(
                     "depth", "start", (F.col("start") + F.col("n")).alias("end")))).alias("a"))
                 .select(F.col("below").alias("conv_id"), F.transform("a", lambda x: F.struct(
                     x["start"].alias("start"), x["end"].alias("end"))).alias("ancestors")))
    segments = cut(layout.join(intervals, "conv_id", "left"), "chat-intervals")
    own = turns.join(owned.where("owner = conv_id").select("conv_id", "depth"), ["conv_id", "depth"])
    none = F.array().cast("array<struct<start:long,end:long>>")
    nodes = own.join(segments.withColumnRenamed("start", "segment_start"), "conv_id").select(
        "node", "tree_id", F.col("conv_id").alias("owner"), "depth", "role", "formatted",
        (F.col("segment_start") + F.col("position") - F.col("first")).alias("start"), "length", "position",
        "loss_start", "loss_length", "segment_start", F.coalesce("ancestors", none).alias("ancestors"))
    return nodes, turns.select("conv_id", "depth", "node")


def read_back(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """One row per conversation with digests of what its path through the emission says.

    ``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``:
    the formatted turns are parsed and unescaped again; the loss digest covers
    the text under the mask.
    """
    nodes = cut(nodes.select("node", "formatted", "loss_start", "loss_length"), "chat-nodes")
    rows = (paths.join(nodes.hint("merge"), "node").select("conv_id", "depth", "formatted", "loss_start", "loss_length")
            .repartition("conv_id").sortWithinPartitions("conv_id", "depth").drop("depth"))
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
                        ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None

        def row(s):
            return (s[0], s[1], s[2].hexdigest(), s[3], s[4].hexdigest(), s[5])
        for batch in batches:
            out = []
            for conv, formatted, start, size in zip(*(c.to_pylist() for c in batch.columns)):
                if state is None or state[0] != conv:
                    if state is not None:
                        out.append(row(state))
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in parse_turns(formatted):
                    state[1] += 1
                    state[2].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                if start is not None:
                    loss = unescape(formatted[start:start + size])
                    state[3] += len(loss)
                    state[4].update(loss.encode("utf-8", "surrogatepass"))
                state[5] += len(formatted)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(row(state), schema)], schema=schema)
    return rows.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, "
                           "loss_sha256 string, formatted_chars long")
