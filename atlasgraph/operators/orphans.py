"""Orphan references: references to records that are missing, deleted or arrive later.

Parents become, per range of their key's hash, sorted arrays (hash, second hash, start of life, running
maximum of the ends of life); batches of references probe the arrays of their range by binary search.

* Ranges have equal width on a 64-bit hash, so they hold equally many distinct keys whatever the keys look
  like. The second hash makes a false match as unlikely as 2**-128.
* References never meet by key but by (range, lane). A range that holds more references than one task should
  take gets more lanes, and only its (bounded) parent arrays are repeated, so a key with a third of all
  references is spread over many tasks.
* Only numbers are shuffled: two hashes, the time, and the reference's own identity.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ntz_micros, stored

LEAST_RANGES = 16
PARENTS_PER_RANGE = 200_000
REFS_PER_TASK = 500_000
FOREVER = 2**63 - 1
KINDS = ("ok", "missing", "late", "deleted")


def norm_ref(c: Column) -> Column:
    """One spelling of an id: backslash to slash, no blanks around it. Case counts."""
    return F.regexp_replace(F.regexp_replace(c, r"\\", "/"), r"(?U)^\s+|\s+$", "")


def _hashes(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("second"), key).alias("h2")]


def parents_table(*nodes: DataFrame, key: str = "id", start: str = "created_at", end: str = "deleted_at") -> DataFrame:
    """(h1, h2, start, until) of all lives. Null ids are dropped; a null start counts as 'since ever'."""
    out = None
    for df in nodes:
        one = df.where(F.col(key).isNotNull()).select(
            *_hashes(norm_ref(F.col(key))),
            F.coalesce(ntz_micros(start), F.lit(-(2**62))).alias("start"),
            F.coalesce(ntz_micros(end), F.lit(FOREVER)).alias("until"),
        )
        out = one if out is None else out.unionByName(one)
    return out.groupBy("h1", "h2", "start").agg(F.max("until").alias("until"))


def refs_table(df: DataFrame, table: str, record_id: str, field: str, at: str) -> DataFrame:
    """References of one column; nulls are no references."""
    return df.where(F.col(field).isNotNull()).select(
        F.lit(table).alias("table_name"),
        F.col(record_id).cast("long").alias("record_id"),
        F.lit(field).alias("field_name"),
        *_hashes(norm_ref(F.col(field))),
        ntz_micros(at).alias("at"),
    )


def _range_of(n: int) -> Column:
    """Range of h1 among n of equal width (n a power of two)."""
    bits = n.bit_length() - 1
    return (F.shiftrightunsigned("h1", 64 - bits) if bits else F.lit(0)).cast("int")


def _probe(refs: pa.Table, parents: pa.Table) -> np.ndarray:
    """Index into KINDS of each reference."""
    kind = np.full(len(refs), 1, dtype=np.int8)
    if not len(parents) or not len(refs):
        return kind
    column = lambda t, c: t.column(c).to_numpy()
    ph, p2, start, until = (column(parents, c) for c in ("h1", "h2", "start", "until"))
    order = np.lexsort((start, p2, ph))
    ph, p2, start, until = ph[order], p2[order], start[order], until[order]
    new = np.r_[True, (ph[1:] != ph[:-1]) | (p2[1:] != p2[:-1])]
    first = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    # Running maximum of until within each key: the keys' maxima are computed on ranks, lifted by group.
    rank = np.unique(until, return_inverse=True)[1].astype(np.int64)
    lifted = np.maximum.accumulate(rank + group.astype(np.int64) * (len(until) + 1)) - group * (len(until) + 1)
    ever = np.sort(until)[np.searchsorted(np.sort(rank), lifted)]
    # Keys sorted by (h1, h2): find h1, then step over the very rare equal h1 with another h2.
    kh, k2 = ph[first], p2[first]
    rh, r2 = column(refs, "h1"), column(refs, "h2")
    at_na = refs.column("at").is_null().to_numpy()
    at = refs.column("at").fill_null(0).to_numpy()
    k = np.searchsorted(kh, rh)
    while True:
        inside = k < len(kh)
        same = np.zeros(len(rh), bool)
        same[inside] = (kh[k[inside]] == rh[inside]) & (k2[k[inside]] < r2[inside])
        if not same.any():
            break
        k = k + same
    hit = k < len(kh)
    hit[hit] = (kh[k[hit]] == rh[hit]) & (k2[k[hit]] == r2[hit])
    ends = np.r_[first[1:], len(ph)]
    # Last life that began at or before the reference: binary search on (key number, start) at once.
    starts = np.unique(np.r_[start, at])
    width = len(starts) + 1
    probe = group.astype(np.int64) * width + np.searchsorted(starts, start)
    want = k[hit].astype(np.int64) * width + np.searchsorted(starts, at[hit])
    pos = np.searchsorted(probe, want, side="right") - 1
    lo = first[k[hit]]
    began = pos >= lo
    alive = np.zeros(len(pos), bool)
    alive[began] = ever[pos[began]] > at[hit][began]
    assert (pos < ends[k[hit]]).all()
    kind[hit] = np.where(alive, 0, np.where(began, 3, 2))
    kind[hit & at_na] = 0  # without a time no lifetime can be refuted: the id exists, the reference holds
    return kind


def find_orphans(refs: DataFrame, parents: DataFrame) -> DataFrame:
    """Orphans of refs (see refs_table) against parents (see parents_table).

    Returns table_name, record_id, field_name, at, kind with kind missing (no row with that id), late (all rows
    with it were created after the reference's time) or deleted. A reference without a time holds if its id
    exists at all, else it is missing. Repeated rows come out as often as they go in; empty tables give an
    empty result; extra columns are ignored.
    """
    parents = stored(parents, "orphan-parents")  # aggregated once: counted here, probed below
    n = LEAST_RANGES
    n_parents = parents.count()
    while n * PARENTS_PER_RANGE < n_parents:
        n *= 2
    refs = refs.withColumn("rng", _range_of(n))
    # A row per range. It stays a table, so ranges may grow with the parents.
    layout = stored(refs.groupBy("rng").agg(F.ceil(F.count("*") / REFS_PER_TASK).cast("int").alias("lanes")), "orphan-layout")
    right = parents.withColumn("rng", _range_of(n)).join(layout, "rng").select("rng", F.explode(F.sequence(F.lit(0), F.col("lanes") - 1)).alias("lane"), "h1", "h2", "start", "until")
    left = refs.join(layout, "rng").select("rng", F.pmod(F.xxhash64("record_id", "at"), F.col("lanes")).cast("int").alias("lane"), "table_name", "record_id", "field_name", "h1", "h2", "at")
    names = T.StructType.fromDDL("table_name string, record_id long, field_name string, at long, kind string")

    def probe(a: pa.Table, b: pa.Table) -> pa.Table:
        kind = _probe(a, b)
        bad = kind > 0
        found = a.select(["table_name", "record_id", "field_name", "at"]).filter(pa.array(bad))
        return found.append_column("kind", pa.array(np.array(KINDS, object)[kind[bad]], pa.string()))

    return left.groupBy("rng", "lane").cogroup(right.groupBy("rng", "lane")).applyInArrow(probe, names)


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphans per table, field, month of the reference and kind; a reference without a time has a null month."""
    month = F.date_format(F.timestamp_micros(F.col("at")), "yyyy-MM")
    return orphans.groupBy("table_name", "field_name", month.alias("month"), "kind").agg(F.count("*").alias("n"))
