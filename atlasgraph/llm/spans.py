"""Long exact spans shared between records.

Paragraphs cannot give this result: a span of 160 characters may lie anywhere, across or within paragraphs. So
every window of 160 characters is a "paragraph": its one min-hash is the smallest hash of its GRAM-character
shingles, and windows with equal min-hashes collide. Equal windows have equal min-hashes, so recall is exactly
one, and as neighbouring windows mostly share their minimum, only about 2 / (160 - GRAM + 2) of all positions
are kept (winnowing).

1. Distinct texts give their minima: (hash, text, position). A minimum that two texts have in common makes
   both candidates there.
2. A candidate's context is all that a window around the minimum can see: SPAN - GRAM characters before the shingle
   and as many behind it. Texts with equal contexts share every window there, so whole runs of windows are settled by
   one row. Only of a minimum that stands in different contexts do the distinct contexts give the 128-bit
   hashes of the windows of which it is the minimum; windows of two contexts are shared. No pair is formed to find that out.
3. Shared contexts and windows with the same set of texts are reduced to one before pairs are formed; every pair
   formed is a result. The groups of linked texts need no pairs at all.

Copies are one text until the end. Long texts are hashed in whole, by numpy, in linear time and memory. Contexts and
windows are compared by 128-bit hashes, which stand for the text: two different ones are taken for equal with a
probability of about n^2 / 2^129.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from ..session import stored
from .components import connected_components, star_edges

SPAN = 160
GRAM = 100
_BASE = 0x9E3779B97F4A7C15


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        up, down = np.full(size, base, np.uint64), np.full(size, pow(base, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        with np.errstate(over="ignore"):
            have = (np.multiply.accumulate(up), np.multiply.accumulate(down))
        if n <= 1 << 22:
            _POWERS[base] = have
    return have[0][:n], have[1][:n]


def rolling(points: np.ndarray, width: int, base: int) -> np.ndarray:
    """Hash of every window of the given width."""
    up, down = _powers(base, len(points) + 1)
    total = np.zeros(len(points) + 1, np.uint64)
    np.cumsum(_mix(points.astype(np.uint64) + np.uint64(base)) * up[:-1], out=total[1:])
    n = len(points) - width + 1
    return _mix((total[width:] - total[:n]) * down[:n])


def _sliding(x: np.ndarray, width: int, op) -> np.ndarray:
    """op (np.minimum or np.maximum) over every window, in linear time."""
    n = len(x)
    pad = -n % width
    fill = np.iinfo(x.dtype).max if op is np.minimum else np.iinfo(x.dtype).min
    rows = np.concatenate([x, np.full(pad, fill, x.dtype)]).reshape(-1, width)
    ahead = op.accumulate(rows, axis=1).ravel()
    back = op.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(back[: n - width + 1], ahead[width - 1 : n])


def minima(points: np.ndarray, span: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the shingles that are the smallest of some window of `span` characters (all of equal ones)."""
    if len(points) < span:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = rolling(points, gram, _BASE)
    width = span - gram + 1
    lowest = _sliding(h, width, np.minimum)
    around = np.concatenate([np.zeros(width - 1, np.uint64), lowest, np.zeros(width - 1, np.uint64)])
    at = np.flatnonzero(_sliding(around, width, np.maximum)[: len(h)] == h)
    return at, h[at]


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def _stack(parts: list[tuple], schema: T.StructType):
    cols = [np.concatenate([p[i] for p in parts]) for i in range(len(parts[0]))]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], schema.names)


def _columns(rows: list[tuple], schema: T.StructType):
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[f.dataType.simpleString()]) for c, f in zip(zip(*rows), schema)], schema.names)


def _rows(one, schema: T.StructType):
    """A mapInArrow function from one(number, text, ...) to its columns, about a million rows a batch."""

    def run(batches):
        for batch in batches:
            parts, size = [], 0
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                got = one(*row)
                if len(got[0]):
                    parts.append(got)
                    size += len(got[0])
                if size > 500_000:
                    yield _stack(parts, schema)
                    parts, size = [], 0
            if parts:
                yield _stack(parts, schema)

    return run


def distinct_texts(docs: DataFrame, key: str, column: str, span: int) -> tuple[DataFrame, DataFrame]:
    """(t, text) of each distinct text long enough, t the smallest key that has it; (t, key) of all its records."""
    long = docs.where(F.length(column) >= span).select(F.col(key).cast("long").alias("key"), F.col(column).alias("text"))
    ids = long.select("key", F.md5("text").alias("h"))
    first = ids.groupBy("h").agg(F.min("key").alias("t"))
    members = stored(ids.join(first, "h").select("t", "key").distinct(), "spans-members")
    return long.join(members.select("t").distinct(), F.col("key") == F.col("t"), "left_semi").select(F.col("key").alias("t"), "text"), members


def _contexts(texts: DataFrame, span: int, gram: int) -> DataFrame:
    """(t, at, h, left, n, c1, c2, context): every occurrence of a minimum that two texts have in common. context are the n
    characters that windows around it see, left of them before it; c1 and c2 are their hashes."""
    shape = T.StructType.fromDDL("t long, at long, h long")

    def low(t, text):
        at, h = minima(_points(text), span, gram)
        return np.full(len(at), t, np.int64), at, h.astype(np.int64)

    marks = stored(texts.mapInArrow(_rows(low, shape), shape), "spans-minima")
    common = marks.groupBy("h").agg(F.min("t").alias("lo"), F.max("t").alias("hi")).where("lo <> hi").select("h")
    # Occurrences within one text, packed: bounded by that text's length.
    where = marks.join(common, "h").groupBy("t").agg(F.collect_set(F.struct("at", "h")).alias("at"))
    around, out = span - gram, T.StructType.fromDDL("t long, at long, h long, left int, context string")

    def see(batches):
        for batch in batches:
            rows = []
            for t, text, at in zip(*(c.to_pylist() for c in batch.columns)):
                for a in at:
                    p = a["at"]
                    rows.append((t, p, a["h"], min(p, around), text[max(0, p - around) : p + span]))
                if len(rows) > 50_000:
                    yield _columns(rows, out)
                    rows = []
            if rows:
                yield _columns(rows, out)

    rows = texts.join(where, "t").select("t", "text", "at").mapInArrow(see, out)
    return stored(rows.withColumns({"n": F.length("context"), "c1": F.xxhash64("h", "left", "context"), "c2": F.xxhash64(F.lit(1), "context", "left", "h")}), "spans-contexts")


def shared_sets(texts: DataFrame, span: int = SPAN, gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """What is shared, and the contexts it is shared in: sets (k1, k2, first, last, c1, c2), where a set is a run of windows
    (by their starts within the context) with equal text in all its contexts, and the contexts' occurrences (see _contexts)."""
    seen = _contexts(texts, span, gram)
    kinds = seen.groupBy("c1", "c2").agg(F.min("t").alias("lo"), F.max("t").alias("hi"), F.first("h").alias("h"), F.first("n").alias("n"), F.first("context").alias("context"))
    kinds = stored(kinds, "spans-kinds")
    whole = kinds.where("lo <> hi").select(F.col("c1").alias("k1"), F.col("c2").alias("k2"), F.lit(0).alias("first"), (F.col("n") - span).alias("last"), "c1", "c2")
    several = kinds.groupBy("h").agg(F.count("*").alias("k")).where("k > 1").select("h")
    shape = T.StructType.fromDDL("c1 long, c2 long, lo long, hi long, s int, w1 long, w2 long")

    def windows(c1, c2, lo, hi, h, context):
        points = _points(context)
        lowest = _sliding(rolling(points, gram, _BASE), span - gram + 1, np.minimum)
        s = np.flatnonzero(lowest.astype(np.int64) == h).astype(np.int32)
        a, b = (rolling(points, span, base)[s].astype(np.int64) for base in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F))
        return *(np.full(len(s), x, np.int64) for x in (c1, c2, lo, hi)), s, a, b

    parts = stored(kinds.join(several, "h").select("c1", "c2", "lo", "hi", "h", "context").mapInArrow(_rows(windows, shape), shape), "spans-windows")
    differ = (F.min(F.struct("c1", "c2")) != F.max(F.struct("c1", "c2"))).alias("differ")
    common = parts.groupBy("w1", "w2").agg(differ, F.min("lo").alias("a"), F.max("hi").alias("b")).where("differ and a <> b").select("w1", "w2")
    single = parts.join(common, ["w1", "w2"]).select(F.col("w1").alias("k1"), F.col("w2").alias("k2"), F.col("s").alias("first"), F.col("s").alias("last"), "c1", "c2")
    return whole.unionByName(single), seen


def _one_of_each(rows: DataFrame, keys: list[str], member: list[str]) -> DataFrame:
    """The rows of one of all keys that have the same set of members."""
    mark = lambda salt: F.sum(F.xxhash64(*member, F.lit(salt)).cast("decimal(38,0)"))
    sets = rows.groupBy(*keys).agg(F.count("*").alias("n"), mark(0).alias("s1"), mark(1).alias("s2"))
    one = sets.groupBy("n", "s1", "s2").agg(F.min(F.struct(*keys)).alias("k")).select("k.*")
    return rows.join(one, keys)


def sharing_texts(texts: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """(k1, k2, t): sets of distinct texts that have a span in common, no set twice. Every pair within a set shares a span."""
    sets, seen = shared_sets(texts, span, gram)
    sets = _one_of_each(sets.select("k1", "k2", "c1", "c2").distinct(), ["k1", "k2"], ["c1", "c2"])
    rows = sets.join(seen.select("c1", "c2", "t").distinct(), ["c1", "c2"]).select("k1", "k2", "t").distinct()
    return stored(_one_of_each(stored(rows, "spans-sets"), ["k1", "k2"], ["t"]), "spans-sharing")


def class_pairs(sharing: DataFrame) -> DataFrame:
    """(x, y), x < y, of the distinct texts that share a span."""
    side = lambda c: sharing.select("k1", "k2", F.col("t").alias(c))
    return side("x").join(side("y"), ["k1", "k2"]).where("x < y").select("x", "y").distinct()


def sharing_pairs(docs: DataFrame, key: str = "doc_id", column: str = "text", span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """(doc_a, doc_b), doc_a < doc_b, of all records that have `span` consecutive equal characters in common.

    White space counts; null texts and shorter ones share nothing; a record shares nothing with itself however
    often its row repeats.
    """
    texts, members = distinct_texts(docs, key, column, span)
    pairs = class_pairs(sharing_texts(texts, span, gram))
    a, b = members.select(F.col("t").alias("x"), F.col("key").alias("p")), members.select(F.col("t").alias("y"), F.col("key").alias("q"))
    across = pairs.join(a, "x").join(b, "y").select("p", "q")
    copies = members.groupBy("t").agg(F.count("*").alias("n")).where("n > 1").select("t")
    again = members.join(copies, "t")
    within = again.select("t", F.col("key").alias("p")).join(again.select("t", F.col("key").alias("q")), "t").where("p < q").select("p", "q")
    return across.unionByName(within).select(F.least("p", "q").alias("doc_a"), F.greatest("p", "q").alias("doc_b")).distinct()


def sharing_classes(docs: DataFrame, key: str = "doc_id", column: str = "text", span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """(key, class_id, links) of every record with a text of `span` characters or more: its class (copies of one text, named
    by the smallest key) and the number of other records that share a span with it. No pair of records is formed."""
    texts, members = distinct_texts(docs, key, column, span)
    pairs = class_pairs(sharing_texts(texts, span, gram))
    size = members.groupBy("t").agg(F.count("*").alias("n"))
    both = pairs.unionByName(pairs.select(F.col("y").alias("x"), F.col("x").alias("y")))
    others = both.join(size.withColumnRenamed("t", "y"), "y").groupBy(F.col("x").alias("t")).agg(F.sum("n").alias("others"))
    links = (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("links")
    return members.join(size, "t").join(others, "t", "left").select(F.col("key").alias(key), F.col("t").alias("class_id"), links)


def clusters(docs: DataFrame, key: str = "doc_id", column: str = "text", span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """(root, key) of every record that shares a span with another: root is the smallest record linked with it, directly or
    through others. Keeping the roots alone leaves no pair. Links are stars over sets and copies, never pairs."""
    texts, members = distinct_texts(docs, key, column, span)
    sharing = sharing_texts(texts, span, gram)
    labels = sharing.select(F.col("t").alias("v"), F.concat_ws(":", "k1", "k2").alias("label"))
    copied = members.groupBy("t").agg(F.count("*").alias("n")).where("n > 1").select("t")
    labels = labels.unionByName(members.join(copied, "t").select(F.col("key").alias("v"), F.concat(F.lit("t:"), F.col("t").cast("string")).alias("label")))
    edges = stored(star_edges(labels, "v", "label"), "spans-edges")
    ends = edges.select(F.explode(F.array("a", "b")).alias("v")).distinct()
    return connected_components(ends, edges).select("root", F.col("v").alias(key))


def shared_parts(docs: DataFrame, key: str = "doc_id", column: str = "text", span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_chars, shared_chars, spans, share) of every record: how much of its text, in stretches of at least
    `span` characters, appears in another record as well. A copied text is shared as a whole; a null or empty
    text has a share of 0."""
    texts, members = distinct_texts(docs, key, column, span)
    sets, seen = shared_sets(texts, span, gram)
    begin = F.col("at") - F.col("left")
    runs = sets.select("c1", "c2", "first", "last").distinct().join(seen.select("c1", "c2", "t", "at", "left"), ["c1", "c2"]).select("t", (begin + F.col("first")).alias("lo"), (begin + F.col("last")).alias("hi"))
    # Gaps and islands: a stretch ends where the next run begins behind the end of all before it.
    before = F.max("hi").over(Window.partitionBy("t").orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1)) + span
    steps = runs.withColumn("end", before).select("t", F.when(F.col("end").isNull() | (F.col("lo") > F.col("end")), 1).otherwise(0).alias("new"), F.greatest(F.lit(0), F.col("hi") + span - F.greatest("lo", F.coalesce("end", "lo"))).alias("gain"))
    cover = steps.groupBy("t").agg(F.sum("gain").alias("c"), F.sum("new").alias("s"))
    copies = members.groupBy("t").agg((F.count("*") > 1).alias("copied"))
    known = members.join(copies, "t").join(cover, "t", "left").select(F.col("key").alias(key), "copied", "c", "s")
    n = F.coalesce(F.length(column), F.lit(0)).cast("long")
    sizes = docs.groupBy(F.col(key).cast("long").alias(key)).agg(F.max(n).alias("n_chars"))
    out = sizes.join(known, key, "left")
    shared = F.when(F.coalesce("copied", F.lit(False)), F.col("n_chars")).otherwise(F.coalesce("c", F.lit(0)).cast("long"))
    return out.select(key, "n_chars", shared.alias("shared_chars"), F.when(F.coalesce("copied", F.lit(False)), 1).otherwise(F.coalesce("s", F.lit(0))).cast("long").alias("spans"), F.round(F.when(F.col("n_chars") > 0, shared / F.col("n_chars")).otherwise(0.0), 4).alias("share"))
