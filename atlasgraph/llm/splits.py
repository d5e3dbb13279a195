"""Same or near-same records across splits.

Texts are brought to plain form (plainform), bared of case, spaces and punctuation, and reduced to one class
per distinct text. Classes get minwise hashes of their three-character shingles; bands of them are buckets. Only
buckets with a training and an evaluation class give candidates. The exact edit distance decides about them, as the
task asks, bounded so that it stops early; of the confirmed pairs the exact Jaccard similarity is reported.

Bands: edits of 10 % leave at worst 70 % of the shingles, a similarity of 0.54, and if they fall at random 0.57; the
80 bands of 5 rows find such pairs with a probability of 0.975 and 0.993, and one of 0.65 with 0.9999. Texts from
one pattern, of similarity 0.3, meet with 0.18.

Bands are taken in rounds, and each round's candidates are settled before the next begins, so neither the bands nor the
candidates of all rounds are ever on disk at once. Within the join a candidate is dropped if the bits of the two texts'
character pairs show more edits than allowed. An edit takes away two pairs at most and adds two at most, so no text
within the distance is lost by that.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import discard, stored
from .plainform import bare, plain_form

SHINGLE = 3
BANDS, ROWS = 80, 5
ROUND = 5  # bands of a round
WORDS = 4  # of 64 bits, for a text's character pairs
MAX_DISTANCE = 0.10
_RNG = np.random.default_rng(20)
_A = _RNG.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
_B = _RNG.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _points(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Code points of texts of n characters or more, one after the other, and at which positions n of one text begin."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64)
    inside = np.ones(len(points), bool)
    for i in range(1, n):
        inside[np.cumsum(sizes) - i] = False
    return points, np.flatnonzero(inside)


def batch_keys(texts: list[str], first: int = 0, count: int = BANDS) -> np.ndarray:
    """A row of keys per text, of `count` bands from the first on; equal keys are of one band."""
    out = np.zeros((len(texts), count), np.uint64)
    sizes = np.cumsum([max(SHINGLE, len(t)) for t in texts])
    cuts = np.searchsorted(sizes, np.arange(32768, sizes[-1] if len(sizes) else 0, 32768), "right")  # texts in slices that fit the cache
    for at in filter(len, np.split(np.arange(len(texts)), np.unique(cuts))):
        part = [texts[i].ljust(SHINGLE, "\0") for i in at]
        points, begin = _points(part, SHINGLE)
        h = points[begin]
        for i in range(1, SHINGLE):
            h = (h << np.uint64(21)) | points[begin + i]  # three code points fit exactly
        h = _mix(h)
        starts = np.concatenate([[0], np.cumsum([len(t) - SHINGLE + 1 for t in part])[:-1]])
        key = np.repeat(_mix(np.arange(first, first + count, dtype=np.uint64))[None], len(at), axis=0)
        for b in range(count):
            for i in range(ROWS):
                j = (first + b) * ROWS + i
                key[:, b] = _mix(key[:, b] * np.uint64(31) + np.minimum.reduceat(h * _A[j] + _B[j], starts))  # of mixed values, so multiply and add is enough
        out[at] = key
    return out.astype(np.int64)


def band_keys(text: str) -> np.ndarray:
    return batch_keys([text])[0]


def pair_bits(texts: list[str]) -> np.ndarray:
    """WORDS words per text with a bit set for each of its character pairs, by the pair's hash."""
    out = np.zeros((len(texts), WORDS), np.uint64)
    part = [t.ljust(2, "\0") for t in texts]
    if part:
        points, begin = _points(part, 2)
        h = _mix((points[begin] << np.uint64(21)) | points[begin + 1])
        of = np.repeat(np.arange(len(part)), [len(t) - 1 for t in part])
        np.bitwise_or.at(out, (of, (h >> np.uint64(6)) % np.uint64(WORDS)), np.uint64(1) << (h & np.uint64(63)))
    return out.view(np.int64)


def _bands(first: int):
    @F.pandas_udf(T.ArrayType(T.LongType()))
    def bands(texts: pd.Series) -> pd.Series:
        return pd.Series(list(batch_keys(list(texts), first, ROUND)))

    return bands


@F.pandas_udf(T.ArrayType(T.LongType()))
def _bits(texts: pd.Series) -> pd.Series:
    return pd.Series(list(pair_bits(list(texts))))


def jaccard(a: str, b: str) -> Column:
    """Exact Jaccard similarity of two columns' distinct shingles."""

    def shingles(c: str) -> Column:
        return F.expr(f"array_distinct(transform(sequence(1, greatest(1, length({c}) - {SHINGLE - 1})), i -> substring({c}, i, {SHINGLE})))")

    x, y = shingles(a), shingles(b)
    return F.round(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)), 4)


def classes(records: DataFrame, text: str = "question", split: str = "subset", train: str = "FZ_train") -> tuple[DataFrame, DataFrame]:
    """(class_id, bare, t, e, w0 to w3) of each distinct text, with 1 in t and e if a training and an evaluation record has it and
    its pair_bits in w, and (class_id, side, id, split, source) of the records."""
    r = records.where(F.col(text).isNotNull() & F.col("id").isNotNull() & F.col(split).isNotNull()).select("id", F.col(split).alias("split"), "source", F.col(text).alias("text")).distinct()
    r = plain_form(r, "text").withColumn("bare", bare(F.col("plain"))).where("bare <> ''")
    r = r.withColumn("class_id", F.xxhash64("bare")).withColumn("side", F.when(F.col("split") == train, "train").otherwise("eval"))
    every = stored(r.select("class_id", "side", "id", "split", "source", "bare"), "splits-every")
    has = lambda side: F.max((F.col("side") == side).cast("int"))
    texts = every.groupBy("class_id").agg(F.first("bare").alias("bare"), has("train").alias("t"), has("eval").alias("e")).withColumn("bits", _bits("bare"))
    texts = stored(texts.select("class_id", "bare", "t", "e", *[F.col("bits")[i].alias(f"w{i}") for i in range(WORDS)]), "splits-texts")
    slim = stored(every.drop("bare"), "splits-records")
    discard(every)
    return texts, slim


def overlapping_classes(texts: DataFrame, limit: float = MAX_DISTANCE) -> DataFrame:
    """(train_class, eval_class, distance, jaccard) of classes whose texts differ in at most `limit` of the longer one."""
    words = [f"w{i}" for i in range(WORDS)]
    most = f"floor({limit} * greatest(tn, en))"
    beyond = lambda x, y: " + ".join(f"bit_count({x}{w} & ~{y}{w})" for w in words)
    fits = F.expr(f"train_class <> eval_class and abs(tn - en) <= {most} and {beyond('t', 'e')} <= 2 * {most} and {beyond('e', 't')} <= 2 * {most}")
    left = texts.select(F.col("class_id").alias("train_class"), F.col("bare").alias("a"))
    right = texts.select(F.col("class_id").alias("eval_class"), F.col("bare").alias("b"))
    rounds = []
    for first in range(0, BANDS, ROUND):
        # Bands, a length and the bits, no texts: the texts join the candidates afterwards.
        band = texts.select("class_id", "t", "e", F.length("bare").alias("n"), *words, F.explode(_bands(first)("bare")).alias("key"))
        side = lambda s, name: band.where(f"{s} = 1").select("key", F.col("class_id").alias(name), F.col("n").alias(f"{s}n"), *[F.col(w).alias(f"{s}{w}") for w in words])  # noqa: B023, E731
        pairs = side("t", "train_class").join(side("e", "eval_class"), "key").where(fits).select("train_class", "eval_class").distinct()
        both = pairs.join(left, "train_class").join(right, "eval_class").withColumn("most", F.expr(f"cast(floor({limit} * greatest(length(a), length(b))) as int)"))
        near = both.withColumn("d", F.expr("levenshtein(a, b, most)")).where("d >= 0").select("train_class", "eval_class", F.col("d").alias("distance"), jaccard("a", "b").alias("jaccard"))
        rounds.append(stored(near, "splits-near"))
    near = functools.reduce(DataFrame.unionByName, rounds).distinct()
    same = texts.where("t = 1 and e = 1").select(F.col("class_id").alias("train_class"), F.col("class_id").alias("eval_class"), F.lit(0).alias("distance"), F.lit(1.0).alias("jaccard"))
    return near.unionByName(same)


def overlaps(records: DataFrame, **options) -> DataFrame:
    """Every overlapping pair of records: train_id, eval_id, split and source of the evaluation record, distance, jaccard.

    Null texts, and texts of which nothing is left once case, spaces and punctuation are ignored, overlap with
    nothing. Rows that repeat count once.
    """
    texts, r = classes(records)
    pairs = overlapping_classes(texts, **options)
    train = r.where("side = 'train'").select(F.col("class_id").alias("train_class"), F.col("id").alias("train_id")).distinct()
    ev = r.where("side = 'eval'").select(F.col("class_id").alias("eval_class"), F.col("id").alias("eval_id"), "split", "source").distinct()
    return pairs.join(train, "train_class").join(ev, "eval_class").where("train_id <> eval_id").select("train_id", "eval_id", "split", "source", "distance", "jaccard")


def linked_records(records: DataFrame, **options) -> DataFrame:
    """(side, id, split, source, class_id, links) of every record with a text: the class of its text, and with how many records
    of the other side it overlaps. Classes are counted, their copies never paired; an id with several texts has a row for each."""
    texts, r = classes(records)
    pairs = stored(overlapping_classes(texts, **options).select("train_class", "eval_class"), "splits-pairs")
    r = r.distinct()
    size = lambda side, c: r.where(F.col("side") == side).select("class_id", "id").distinct().groupBy(F.col("class_id").alias(c)).agg(F.count("*").alias("n"))
    of_eval = pairs.join(size("train", "train_class"), "train_class").groupBy(F.lit("eval").alias("side"), F.col("eval_class").alias("class_id")).agg(F.sum("n").alias("others"))
    of_train = pairs.join(size("eval", "eval_class"), "eval_class").groupBy(F.lit("train").alias("side"), F.col("train_class").alias("class_id")).agg(F.sum("n").alias("others"))
    # An id on both sides doesn't overlap with itself.
    both = r.groupBy("class_id", "id").agg(F.count_distinct("side").alias("sides")).where("sides = 2").select("class_id", "id", F.lit(1).alias("itself"))
    out = r.join(of_eval.unionByName(of_train), ["side", "class_id"], "left").join(both, ["class_id", "id"], "left")
    return out.select("side", "id", "split", "source", "class_id", (F.coalesce("others", F.lit(0)) - F.coalesce("itself", F.lit(0))).alias("links"))


def overlap_report(records: DataFrame, **options) -> DataFrame:
    """(split, source, pairs, records): overlapping pairs and evaluation records with any, from the classes' sizes."""
    links = linked_records(records, **options).where("side = 'eval' and links > 0")
    return links.groupBy("split", "source").agg(F.sum("links").alias("pairs"), F.count_distinct("id").alias("records"))
