"""URL filter: prefix rules first, then naive Bayes over segmented hosts.

Host names are often words run together.  A unigram Viterbi splits them with
word counts taken from the text of all pages; a multinomial naive Bayes over
the words of host and path, trained on the pages that the rules decide, judges
the rest.  Only substrings that occur in a host name meet the word counts, so
no vocabulary is broadcast; hosts are scored once each, not once per page.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affinity.llm.common import cut

# (verdict, host, path prefix)
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/"))
# A DNS label has at most 63 characters; longer names are not split.
NAME_LENGTH = 63
# Log odds are summed as integers, so that no order of summing changes a verdict.
UNIT = 1e9
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Letters of every script, with the marks that belong to them; in hosts and paths digit runs as well.
LETTERS = r"\p{L}[\p{L}\p{M}]*"
_RUNS = f"({LETTERS}|\\p{{Nd}}+)"
_TAG, _WORD = re.compile(r"<[^<>]*>"), regex.compile(LETTERS)


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_column(host: Column, path: Column, rules: Sequence[tuple[str, str, str]], pick) -> Column:
    """``pick(verdict, rule)`` of the longest fitting rule, else null."""
    cases = [F.when(((host == h) | host.endswith(f".{h}")) & path.startswith(p), F.lit(pick(v, h + p)))
             for v, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))]
    return F.coalesce(*cases, F.lit(None).cast("string"))


def _readable(text: Column) -> Column:
    """Lower-case text with its percent escapes undone, where they are all whole."""
    plain = F.translate(text, "+", " ")
    return F.lower(F.coalesce(F.when(text.contains("%"), F.try_url_decode(plain)), plain))


def word_counts(pages: DataFrame) -> DataFrame:
    """(word, n): lower-case words of every script outside tags, over all pages; none longer than a name."""
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter = Counter()
            for page in batch.column(0):
                text = _TAG.sub(" ", page.as_py() or "")
                counts.update(_WORD.findall((html.unescape(text) if "&" in text else text).lower()))
            words = [w for w in counts if len(w) <= NAME_LENGTH]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()),
                                              pa.array([counts[w] for w in words], pa.int64())], schema=schema)
    return (pages.select(F.col("html").cast("string")).mapInArrow(run, "word string, n long")
            .groupBy("word").agg(F.sum("n").alias("n")))


def segment(name: str, counts: dict[str, int], total: int) -> list[str]:
    """The likeliest split of a name into words; unknown words cost ten times more per letter."""
    if len(name) > NAME_LENGTH:
        return [name]
    best: list[tuple[float, int]] = [(0.0, 0)]
    for end in range(1, len(name) + 1):
        options = []
        for start in range(end):
            n = counts.get(name[start:end], 0)
            cost = math.log(total / n) if n else math.log(total + 1) + (end - start) * math.log(10)
            options.append((best[start][0] + cost, start))
        best.append(min(options))
    words, end = [], len(name)
    while end:
        words.append(name[best[end][1]:end])
        end = best[end][1]
    return words[::-1]


def segments(names: DataFrame, counts: DataFrame) -> DataFrame:
    """(name, words) of distinct ``name``; joins only substrings that names contain."""
    counts = cut(counts, "url-words")
    total = counts.agg(F.sum("n")).first()[0] or 0
    n = F.length("name")
    starts = F.sequence(F.lit(1), F.greatest(n, F.lit(1)))
    subs = F.array_distinct(F.flatten(F.transform(starts, lambda i: F.transform(
        F.sequence(F.lit(1), n - i + 1), lambda k: F.substring("name", i, k)))))
    parts = (names.where(n <= NAME_LENGTH).select("name", F.explode(subs).alias("word")).join(counts, "word"))
    # at most NAME_LENGTH ** 2 / 2 entries a name
    known = parts.groupBy("name").agg(F.collect_list(F.struct("word", "n")).alias("known"))
    schema = pa.schema([("name", pa.string()), ("words", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            words = [segment(r["name"], {k["word"]: k["n"] for k in r["known"] or ()}, total) for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, schema.field(1).type)], schema=schema)
    return names.join(known, "name", "left").mapInArrow(run, "name string, words array<string>")


def _tokens(text: Column, prefix: str) -> Column:
    """Letter runs and, by their length, digit runs."""
    return F.transform(F.regexp_extract_all(_readable(text), F.lit(_RUNS), F.lit(1)), lambda t: F.concat(
        F.lit(prefix), F.when(t.rlike("^\\p{Nd}"), F.concat(F.lit("#"), F.length(t))).otherwise(t)))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES,
          id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: ``page_id, host, path, rule, verdict, host_words, block_log_odds``.

    ``rule`` is null where no rule fits; there ``verdict`` is the classifier's
    and ``block_log_odds`` its score (block above 0).  The classifier reads
    letters of every script, with percent escapes undone (of a text with a
    broken escape none are); names beyond 63 letters stay whole.  A null url, or one
    without ``://``, has an empty host and path; without any token the class
    prior alone decides, and without a page that a rule decides all others are
    allowed.  Ties are allowed.  Null, tied or repeated ids keep their rows;
    urls and pages of any length are read whole; an empty table gives an empty
    result.  Only the named columns and ``html`` are read, so extra columns
    cannot clash.
    """
    url = F.col(url_col).cast("string")
    rows = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    rows = cut(rows.select("*", rule_column(F.col("host"), F.col("path"), rules, lambda v, r: r).alias("rule"),
                           rule_column(F.col("host"), F.col("path"), rules, lambda v, r: v).alias("decided"),
                           F.monotonically_increasing_id().alias("key")), "url-rows")
    marks = [(F.coalesce(F.col("decided") == v, F.lit(False))).cast("long").alias(c) for v, c in (("allow", "a"), ("block", "b"))]
    hosts = cut(rows.select("host", *marks).groupBy("host").agg(F.sum("a").alias("a"), F.sum("b").alias("b")), "url-hosts")
    runs = F.regexp_extract_all(_readable(F.col("host")), F.lit(_RUNS), F.lit(1))
    named = hosts.select("host", F.posexplode(runs).alias("at", "name"))
    split = cut(segments(named.where(F.col("name").rlike(r"^\p{L}")).select("name").distinct(), word_counts(pages)), "url-segments")
    pieces = named.join(split, "name", "left").select(
        "host", "at", F.coalesce("words", F.array(F.concat(F.lit("#"), F.length("name")))).alias("words"))
    host_words = cut(pieces.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("at", "words"))).alias("w"))
                     .select("host", F.flatten(F.transform("w", lambda s: s["words"])).alias("host_words")), "url-host-words")
    host_tokens = host_words.select("host", F.explode("host_words").alias("t")).select(
        "host", F.concat(F.lit("h:"), "t").alias("token"))
    path_tokens = rows.select("key", "decided", F.explode(_tokens(F.col("path"), "p:")).alias("token"))
    counts = (host_tokens.join(hosts.where("a + b > 0"), "host").select("token", "a", "b")
              .union(path_tokens.where("decided IS NOT NULL").select("token", *marks))
              .groupBy("token").agg(F.sum("a").alias("a"), F.sum("b").alias("b")))
    counts = cut(counts, "url-tokens")
    t = counts.agg(F.count(F.lit(1)).alias("v"), F.sum("a").alias("a"), F.sum("b").alias("b")).first()
    d = hosts.agg(F.sum("a").alias("a"), F.sum("b").alias("b")).first()
    v, ta, tb, da, db = t["v"], t["a"] or 0, t["b"] or 0, d["a"] or 0, d["b"] or 0
    trained = da + db > 0
    prior = round(UNIT * math.log((db + 1) / (da + 1))) if trained else 0
    scale = math.log((ta + v + 1) / (tb + v + 1))
    unseen = round(UNIT * scale)
    odds = cut(counts.select("token", F.round(F.lit(UNIT) * (F.log((F.col("b") + 1) / (F.col("a") + 1)) + F.lit(scale)))
                             .cast("long").alias("odds")), "url-odds")

    def scored(tokens: DataFrame, key: str, name: str) -> DataFrame:
        return (tokens.join(odds, "token", "left").groupBy(key)
                .agg(F.sum(F.coalesce("odds", F.lit(unseen))).alias(name)))
    open_ = path_tokens.where("decided IS NULL").select("key", "token")
    by_host = cut(scored(host_tokens, "host", "host_odds").join(host_words, "host"), "url-host-odds")
    by_path = cut(scored(open_, "key", "path_odds"), "url-path-odds")
    total = F.lit(prior) + F.coalesce("host_odds", F.lit(0)) + F.coalesce("path_odds", F.lit(0))
    total = F.when(F.col("decided").isNull(), total if trained else F.lit(0))
    return (rows.join(by_path, "key", "left").join(by_host, "host", "left")
            .select("page_id", "host", "path", "rule",
                    F.coalesce("decided", F.when(total > 0, "block").otherwise("allow")).alias("verdict"),
                    F.coalesce("host_words", F.array().cast("array<string>")).alias("host_words"),
                    (total / UNIT).alias("block_log_odds")))
