"""Closures of many seeds: blocks of seeds over all edges, whose pairs of seed and node are never rows.

A block takes its seeds and every edge, as numbers packed into lists, and works its seeds off in batches: a byte per seed
and node tells what was reached. Only what is asked about a seed leaves the block. There are twice as many blocks as cores
at most, so the edges are shuffled that often; a task holds them all (8 bytes an edge while they are read).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored

SEEDS, EDGES, ENDS, HOMES, NAMES = range(5)
PACK = 32_768  # numbers of a list
PLACES = 1 << 23  # pairs of seed and node of a batch
STEP = 1 << 20  # neighbours looked at at once
VALUES = 1 << 19  # values of a batch that leaves a block
LISTED = 1 << 17  # names of such a batch
TOGETHER = 1 << 24  # seeds, or edges, that a single task takes


def numbers(*columns: DataFrame) -> DataFrame:
    """(n, name) of all values of these tables' single columns: whole numbers from 0 in the order of the names."""
    every = columns[0].toDF("name")
    for c in columns[1:]:
        every = every.unionByName(c.toDF("name"))
    placed = stored(every.where("name is not null").distinct().orderBy("name").withColumn("at", F.monotonically_increasing_id()), "reach-placed")
    # The number tells the partition (above 33 bits) and the place in it.
    part = placed.groupBy(F.shiftright("at", 33).alias("part")).agg(F.count("*").alias("rows")).collect()
    first, total = [], 0
    for p in sorted(part):
        first.append((p["part"], total))
        total += p["rows"]
    firsts = F.broadcast(placed.sparkSession.createDataFrame(first, "part long, first long"))  # a row per partition
    mask = F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    return stored(placed.withColumn("part", F.shiftright("at", 33)).join(firsts, "part").select((F.col("first") + mask).alias("n"), "name"), "reach-names")


def pairs_of(df: DataFrame, a: str, b: str) -> DataFrame:
    """(x): two numbers in one."""
    return df.select((F.shiftleft(F.col(a).cast("long"), 32) + F.col(b)).alias("x"))


def _packed(df: DataFrame, kind: int) -> DataFrame:
    """(kind, data, names) of single numbers (x) in lists."""
    chunks = max(1, -(-df.count() // PACK))
    lists = df.groupBy(F.pmod(F.xxhash64("x"), F.lit(chunks)).alias("chunk")).agg(F.collect_list("x").alias("data"))
    return lists.select(F.lit(kind).alias("kind"), "data", F.lit(None).cast("array<string>").alias("names"))


def in_blocks(seeds: DataFrame, edges: DataFrame, depth: int, ask: Callable, schema: str, *, ends: DataFrame | None = None, homes: DataFrame | None = None, names: DataFrame | None = None) -> DataFrame:
    """What ask(block, batch) gives for all seeds (seed), by closures over edges (node, pred) of at most depth hops.

    All are numbers; the stored tables are read more than once. ends (node) and homes (node, module) are at the block's hand
    if given, names (n, name) too.
    """
    spark = seeds.sparkSession
    asked = seeds.select(F.col("seed").alias("x")).distinct()
    blocks = max(1, min(-(-seeds.count() // 256), 2 * spark.sparkContext.defaultParallelism))
    own = asked.groupBy(F.pmod(F.xxhash64("x"), F.lit(blocks)).alias("block")).agg(F.collect_list("x").alias("data"))
    rest = _packed(pairs_of(edges, "node", "pred"), EDGES)
    if ends is not None:
        rest = rest.unionByName(_packed(ends.select(F.col("node").alias("x")), ENDS))
    if homes is not None:
        rest = rest.unionByName(_packed(pairs_of(homes, "node", "module"), HOMES))
    if names is not None:
        lists = names.groupBy(F.shiftright("n", 13).alias("chunk")).agg(F.sort_array(F.collect_list(F.struct("n", "name"))).alias("s"))
        rest = rest.unionByName(lists.select(F.lit(NAMES).alias("kind"), F.col("s.n").alias("data"), F.col("s.name").alias("names")))
    each = rest.crossJoin(F.broadcast(spark.range(blocks).select(F.col("id").alias("block"))))  # a number per block
    rows = own.select("block", F.lit(SEEDS).alias("kind"), "data", F.lit(None).cast("array<string>").alias("names")).unionByName(each.select("block", "kind", "data", "names"))
    return rows.repartitionByRange(blocks, "block").mapInArrow(_worker(depth, ask), schema)


def in_one(seeds: DataFrame, edges: DataFrame, ask: Callable, schema: str) -> DataFrame:
    """What ask(seeds, edges) gives for all seeds (seed) and edges (node, pred) at once, in one task, as numbers in lists; for at
    most TOGETHER of each. Without seeds, no row."""
    rows = _packed(seeds.select(F.col("seed").alias("x")), SEEDS).unionByName(_packed(pairs_of(edges, "node", "pred"), EDGES))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data: dict[int, list] = {SEEDS: [np.empty(0, np.int64)], EDGES: [np.empty(0, np.int64)]}
        for b in batches:
            for kind, x in zip(b["kind"].to_pylist(), b["data"], strict=True):
                data[kind].append(np.array(x.values, dtype=np.int64))
        if len(data[SEEDS]) > 1:
            yield from ask(*(np.concatenate(data.pop(k)) for k in (SEEDS, EDGES)))

    return rows.select("kind", "data").repartition(1).mapInArrow(work, schema)


def _worker(depth: int, ask: Callable):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data: dict[int, list] = {k: [] for k in range(5)}
        words, one = [], None  # where two blocks share a partition, what isn't a seed is taken once
        for b in batches:
            for i in range(b.num_rows):
                kind, block = b["kind"][i].as_py(), b["block"][i].as_py()
                if kind != SEEDS:
                    one = block if one is None else one
                    if block != one:
                        continue
                data[kind].append(np.array(b["data"][i].values, dtype=np.int64))
                if kind == NAMES:
                    words.append((data[kind][-1][0], b["names"][i].values))
        if data[SEEDS]:
            names = pa.chunked_array([w for _, w in sorted(words, key=lambda x: x[0])]).combine_chunks() if words else None
            block = Block(depth, *(np.concatenate([np.empty(0, np.int64), *data[k]]) for k in (SEEDS, EDGES, ENDS, HOMES)), names)
            data.clear()  # the block has its own
            words.clear()
            if names is not None:
                block.even()
            for batch in block.batches():
                yield from ask(block, batch)

    return work


def _lists(pairs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs in one number each: where the list of a first number starts, and the second numbers."""
    pairs.sort()
    return np.searchsorted(pairs, np.arange(n + 1, dtype=np.int64) << 32), pairs & 0xFFFFFFFF


class Block:
    """Seeds and the lists of numbers that they are asked about. A key is a seed's place in its batch, then the node's number."""

    def __init__(self, depth: int, seeds: np.ndarray, edges: np.ndarray, ends: np.ndarray, homes: np.ndarray, names: pa.Array | None):
        self.depth, self.seeds, self.names = depth, np.sort(seeds), names
        top = max([int(seeds.max())] + [int(x.max()) for e in (edges, homes) if len(e) for x in (e >> 32, e & 0xFFFFFFFF)] + [int(ends.max()) if len(ends) else 0])
        self.shift = max(1, top.bit_length())
        n = top + 1
        self.edges, self.homes = _lists(edges, n), _lists(homes, n)
        self.is_end = np.zeros(n, bool)
        self.is_end[ends] = True
        self.size = max(1, PLACES >> self.shift)
        places = min(self.size, len(self.seeds)) << self.shift
        self.reached, self.met, self.tag = np.zeros(places, bool), np.zeros(places, bool), np.zeros(places, np.int64)

    def even(self) -> None:
        """Spreads the seeds that reach much evenly among the others, the one that reaches most first: a writer of their lists
        guesses from some rows when to look at its size again."""
        sizes = np.concatenate([batch.counts(batch.every()) for batch in self.batches()])
        self.seeds = self.seeds[np.argsort(-sizes, kind="stable")]
        self.seeds = self.seeds[np.argsort(np.arange(len(sizes)) * 0.6180339887498949 % 1, kind="stable")]

    def node(self, keys: np.ndarray) -> np.ndarray:
        return keys & ((1 << self.shift) - 1)

    def batches(self) -> Iterator[Batch]:
        for at in range(0, len(self.seeds), self.size):
            batch = Batch(self, self.seeds[at : at + self.size])
            yield batch
            for keys in batch.levels:
                self.reached[keys] = False

    def beyond(self, keys: np.ndarray, lists: tuple[np.ndarray, np.ndarray]) -> Iterator[np.ndarray]:
        """The keys of what the lists have for these keys' nodes, part by part."""
        start, values = lists
        node = self.node(keys)
        begin, count = start[node], start[node + 1] - start[node]
        sums = np.cumsum(count)
        cuts = np.searchsorted(sums, np.arange(STEP, sums[-1] if len(sums) else 0, STEP), "right")
        for a, z in zip([0, *cuts], [*cuts, len(keys)], strict=True):
            if a < z:
                c = count[a:z]
                step = np.cumsum(c)
                at = np.arange(step[-1]) + np.repeat(begin[a:z] - step + c, c)
                yield np.repeat(keys[a:z] - node[a:z], c) + values[at]

    def fresh(self, keys: np.ndarray, known: np.ndarray) -> np.ndarray:
        """The keys not known yet, each once, which are known from now on."""
        keys = keys[~known[keys]]
        at = np.arange(len(keys))
        self.tag[keys] = at
        keys = keys[self.tag[keys] == at]
        known[keys] = True
        return keys


class Batch:
    """levels: the keys that the seeds reach, by hops, each in the seeds' order."""

    def __init__(self, block: Block, seeds: np.ndarray):
        self.block, self.seeds = block, seeds
        new = (np.arange(len(seeds), dtype=np.int64) << block.shift) + seeds
        block.reached[new] = True
        self.levels = [new]
        for _ in range(block.depth):
            new = np.concatenate([np.empty(0, np.int64), *(block.fresh(k, block.reached) for k in block.beyond(new, block.edges))])
            if not len(new):
                break
            self.levels.append(new)

    def every(self, least: int = 0) -> np.ndarray:
        return np.concatenate([np.empty(0, np.int64), *self.levels[least:]])

    def counts(self, keys: np.ndarray) -> np.ndarray:
        return np.bincount(keys >> self.block.shift, minlength=len(self.seeds))

    def cut(self) -> np.ndarray:
        """Which seeds have more nodes beyond the depth. Of each seed a growing number of nodes is looked at, until one is found."""
        block, found = self.block, np.zeros(len(self.seeds), bool)
        last = self.levels[block.depth] if len(self.levels) > block.depth else np.empty(0, np.int64)
        take = 256
        while len(last):
            seed = last >> block.shift
            now = np.arange(len(last)) - np.searchsorted(seed, np.arange(len(self.seeds)))[seed] < take
            for keys in block.beyond(last[now], block.edges):
                found[keys[~block.reached[keys]] >> block.shift] = True
            last = last[~now & ~found[seed]]
            take *= 8
        return found

    def modules(self) -> np.ndarray:
        """The keys, in order, of the modules that hold what was reached."""
        block = self.block
        keys = np.concatenate([np.empty(0, np.int64), *(block.fresh(k, block.met) for k in block.beyond(self.every(), block.homes))])
        block.met[keys] = False
        keys.sort()
        return keys

    def bounds(self, keys: np.ndarray) -> np.ndarray:
        """Where each seed's keys start, and the last one's end; for keys in order."""
        return np.searchsorted(keys, np.arange(len(self.seeds) + 1, dtype=np.int64) << self.block.shift)


def ask_cut(block: Block, batch: Batch) -> Iterator[pa.RecordBatch]:
    """(seed) of those that have more beyond."""
    yield pa.RecordBatch.from_arrays([pa.array(batch.seeds[batch.cut()])], ["seed"])


def ask_size(block: Block, batch: Batch) -> Iterator[pa.RecordBatch]:
    """(seed, nodes, ends) without the seed itself."""
    keys = batch.every(1)
    yield pa.RecordBatch.from_arrays([pa.array(batch.seeds), pa.array(batch.counts(keys)), pa.array(batch.counts(keys[block.is_end[block.node(keys)]]))], ["seed", "nodes", "ends"])


def ask_modules(block: Block, batch: Batch) -> Iterator[pa.RecordBatch]:
    """(seed, n, first, last): how many modules hold what a seed reaches, the first and the last of them; none, no row."""
    keys = batch.modules()
    at = batch.bounds(keys)
    some = at[1:] > at[:-1]
    module = lambda place: pa.array(block.node(keys[place]))
    yield pa.RecordBatch.from_arrays([pa.array(batch.seeds[some]), pa.array((at[1:] - at[:-1])[some]), module(at[:-1][some]), module(at[1:][some] - 1)], ["seed", "n", "first", "last"])


LISTS = "seed string, direct array<string>, transitive array<string>, ends array<string>, modules array<string>, truncated boolean"
TEXTS = LISTS.replace("array<string>", "string")


def ask_lists(block: Block, batch: Batch, joined: str | None = None) -> Iterator[pa.RecordBatch]:
    """LISTS by name: what a seed reaches at the first hop and later, the ends among it and itself, the modules that hold it.
    TEXTS instead if joined parts the names of a list, so that a name isn't a value of its own outside the block."""
    every = batch.every()
    lists = [np.sort(batch.levels[1]) if len(batch.levels) > 1 else every[:0], np.sort(batch.every(2)), np.sort(every[block.is_end[block.node(every)]]), batch.modules()]
    bounds, cut = [batch.bounds(k) for k in lists], batch.cut()
    names = lambda numbers: block.names.take(pa.array(numbers))
    leave = lambda lists: lists if joined is None else pc.binary_join(lists, joined)
    sums = sum(bounds)
    a = 0
    while a < len(batch.seeds):
        z = max(a + 1, int(np.searchsorted(sums, sums[a] + LISTED, "right")) - 1)
        z = min(z, len(batch.seeds))
        columns = [leave(pa.ListArray.from_arrays(pa.array((b[a : z + 1] - b[a]).astype(np.int32)), names(block.node(k[b[a] : b[z]])))) for k, b in zip(lists, bounds, strict=True)]
        yield pa.RecordBatch.from_arrays([names(batch.seeds[a:z]), *columns, pa.array(cut[a:z])], ["seed", "direct", "transitive", "ends", "modules", "truncated"])
        a = z
