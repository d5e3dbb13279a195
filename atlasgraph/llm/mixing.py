"""Mixing sources to target weights.

Each source's documents are dealt into blocks by hash. A source's quota is its share of the total, capped by
its tokens times its permitted repeats; whole passes over the source are followed by part of one pass. The
blocks of all passes are split exactly among the output shards by a tree: every node draws from the vector of
block counts by source (a multivariate hypergeometric draw) what goes to its left half. A leaf's counts are
consecutive stretches of each source's permuted blocks, so the shards are disjoint, and rows are shuffled
within their shard.

Blocks and shards follow the corpus's size (layout) or are given. Only block sums reach the driver: (listed sources)
x blocks rows, and as blocks grow with the square root of the tokens, both their number and the block that a task has to sort
stay small: 25 million million tokens make 50,000 blocks of 500 million tokens a source.
"""

from __future__ import annotations

from math import isqrt

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .tokens import NAME, TOKENIZERS, count_tokens

LEAST_BLOCKS, LEAST_SHARDS = 256, 64
TOKENS_PER_SHARD = 200_000_000


def layout(tokens: int) -> tuple[int, int]:
    """(blocks a source, output shards) for a mixture of so many tokens."""
    return max(LEAST_BLOCKS, isqrt(tokens) // 100), max(LEAST_SHARDS, -(-tokens // TOKENS_PER_SHARD))


def split_tree(counts: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """counts[s] blocks of source s split exactly among shards: an array (shards, sources) whose columns sum to counts."""
    rng = np.random.default_rng(seed)
    out = np.zeros((shards, len(counts)), np.int64)

    def split(left: int, right: int, have: np.ndarray) -> None:
        if right - left == 1:
            out[left] = have
            return
        middle = (left + right) // 2
        take = round(int(have.sum()) * (middle - left) / (right - left))
        mine = rng.multivariate_hypergeometric(have, take, method="marginals") if have.sum() else have
        split(left, middle, mine)
        split(middle, right, have - mine)

    split(0, shards, counts.astype(np.int64))
    return out


def _quotas(sizes: dict[str, int], targets: list, total: int | None) -> list[dict]:
    rows = []
    total = sum(sizes.get(t["source"], 0) for t in targets) if total is None else total
    for t in targets:
        have = sizes.get(t["source"], 0)
        wanted = round(total * t["target_share"])
        rows.append({"source": t["source"], "target_share": t["target_share"], "max_repeats": t["max_repeats"], "available": have, "wanted": wanted, "quota": min(wanted, have * t["max_repeats"])})
    return rows


def sized(documents: DataFrame, targets: DataFrame, *, folder: str = TOKENIZERS, name: str = NAME) -> DataFrame:
    """(doc_id, source, place, n_tokens) of the documents of listed sources, written once.

    Documents without a source or of an unlisted one, and texts without tokens, add nothing to a mixture.
    """
    listed = F.broadcast(targets.where("source is not null").select("source").distinct())  # the configuration, not data
    d = documents.where("text is not null and source is not null").select("doc_id", "source", "text").join(listed, "source", "left_semi")
    n = count_tokens(d, folder=folder, name=name).where("n_tokens > 0")
    return stored(n.select("doc_id", "source", F.xxhash64("doc_id", F.lit("place")).alias("place"), "n_tokens"), "mix-sized")


def _in_blocks(docs: DataFrame, blocks: int) -> DataFrame:
    return docs.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int"))


def _plan(docs: DataFrame, targets: DataFrame, total: int | None, seed: int, shards: int):
    target_rows = sorted((r.asDict() for r in targets.where("source is not null").distinct().collect()), key=lambda r: r["source"])
    sums: dict[str, dict[int, int]] = {}
    for r in docs.groupBy("source", "block").agg(F.sum("n_tokens").alias("n")).collect():
        sums.setdefault(r["source"], {})[r["block"]] = r["n"]
    quotas = _quotas({s: sum(b.values()) for s, b in sums.items()}, target_rows, total)
    draws, cut = [], []
    for i, q in enumerate(quotas):
        blocks = sorted(sums.get(q["source"], {}))
        left, turn, mine = q["quota"], 0, []
        while left > 0 and blocks:
            order = np.random.default_rng([seed, i, turn]).permutation(len(blocks))
            for b in order:
                size = sums[q["source"]][blocks[b]]
                mine.append((blocks[b], turn, min(size, left)))
                left -= size
                if left <= 0:
                    break
            turn += 1
        draws.append(mine)
    counts = split_tree(np.array([len(d) for d in draws], np.int64), shards, seed)
    at = np.zeros(len(draws), np.int64)
    rows = []
    for shard in range(shards):
        for i, mine in enumerate(draws):
            rows += [(quotas[i]["source"], b, turn, shard, int(limit)) for b, turn, limit in mine[at[i] : at[i] + counts[shard, i]]]
            at[i] += counts[shard, i]
    return quotas, rows


def mixture(documents: DataFrame, targets: DataFrame, *, total: int | None = None, seed: int = 0, folder: str = TOKENIZERS, name: str = NAME, docs: DataFrame | None = None, blocks: int | None = None, shards: int | None = None) -> tuple[DataFrame, list[dict]]:
    """The mixture, a row per use of a document: shard, place (the order within the shard), doc_id, source, copy, n_tokens; and the quotas.

    total is the mixture's intended size in tokens, by default all tokens of the listed sources. Of the block in
    which a quota ends documents are taken in their hash order as long as they fit, so a source misses its quota by
    less than one document's tokens. blocks and shards are those of layout() unless given.
    """
    spark = documents.sparkSession
    docs = sized(documents, targets, folder=folder, name=name) if docs is None else docs
    fit = layout(docs.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0] if total is None else total)
    shards = shards or fit[1]
    docs = _in_blocks(docs, blocks or fit[0])
    quotas, rows = _plan(docs, targets, total, seed, shards)
    shape = "source string, block int, turn int, shard int, room long"
    plan = F.broadcast(spark.createDataFrame(rows or [("", -1, 0, 0, 0)], shape))  # (listed sources) x blocks x repeats rows
    size = docs.groupBy("source", "block").agg(F.sum("n_tokens").alias("size"))
    # Only blocks in which a quota ends need running sums, one block a source.
    used = docs.join(plan, ["source", "block"])
    cut = F.broadcast(spark.createDataFrame(rows or [("", -1, 0, 0, 0)], shape).join(size, ["source", "block"]).where("room < size").select("source", "block", "turn"))
    whole = used.join(cut, ["source", "block", "turn"], "left_anti")
    from pyspark.sql import Window

    w = Window.partitionBy("source", "block", "turn").orderBy("place", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    part = used.join(cut, ["source", "block", "turn"], "left_semi").withColumn("sum", F.sum("n_tokens").over(w)).where("sum <= room").drop("sum")
    out = whole.unionByName(part.select(whole.columns))
    out = out.select("shard", F.xxhash64("doc_id", "turn", F.lit(seed)).alias("place"), "doc_id", "source", F.col("turn").alias("copy"), "n_tokens")
    return out.repartitionByRange("shard", "place").sortWithinPartitions("shard", "place"), quotas


def mixture_report(documents: DataFrame, targets: DataFrame, **options) -> DataFrame:
    """Per listed source: target_share, max_repeats, tokens available, wanted, got, and the share got of the mixture's tokens."""
    spark = documents.sparkSession
    mix, quotas = mixture(documents, targets, **options)
    got = mix.groupBy("source").agg(F.sum("n_tokens").alias("got"), F.max("copy").alias("last"))
    q = spark.createDataFrame([(x["source"], float(x["target_share"]), int(x["max_repeats"]), x["available"], x["wanted"], x["quota"]) for x in quotas], "source string, target_share double, max_repeats int, available long, wanted long, quota long")
    from pyspark.sql import Window

    out = q.join(got, "source", "left").withColumn("got", F.coalesce("got", F.lit(0).cast("long"))).withColumn("repeats", F.coalesce(F.col("last") + 1, F.lit(0))).drop("last")
    return out.withColumn("actual_share", F.round(F.col("got") / F.sum("got").over(Window.partitionBy()), 6))
