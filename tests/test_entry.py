"""Every registered query of the core that has SQL agrees with it at the smallest scale, and every one gives rows."""

import functools
import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from atlasgraph.plans import registry

CORE, ORACLE = registry.collect("QUERIES"), registry.collect("ORACLE")
#: Queries for which the smallest scale has no rows, and the scale that has some.
FEW = {"u3_shared_modules": "/root/testdata/sf0.01"}


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    return v


@functools.cache
def tables(folder):
    c = duckdb.connect()
    for p in glob.glob(f"{folder}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(n for n in CORE if n in ORACLE))
def test_against_sql(spark, small, name):
    folder = FEW.get(name, small)
    df = CORE[name](spark, folder)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    r = tables(folder).execute(ORACLE[name])
    have = [d[0] for d in r.description]
    assert sorted(have) == cols
    at = [have.index(c) for c in cols]
    assert got, "no rows, so nothing is compared"
    assert got == sorted((tuple(norm(x[i]) for i in at) for x in r.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(n for n in CORE if n not in ORACLE))
def test_without_sql(spark, small, name):
    assert not CORE[name](spark, small).isEmpty()


@pytest.mark.parametrize("name", ["t2_impact_calls", "t3_impact_imports", "t8_caller_pattern", "j16_enriched_candidates", "j20_rev_calls_closure", "j20_impact_modules"])
def test_all_functions_are_targets(spark, small, name):
    every, few = CORE[f"{name}_all"](spark, small), CORE[name](spark, small)
    key = few.columns[0]
    assert few.select(key).subtract(every.select(key)).count() == 0 and every.count() > few.count()
    if name.startswith("t"):
        fn = CORE["s5_nodes_of_label"](spark, small).select("id")
        assert every.count() == (fn.join(CORE["j10_module_of"](spark, small), "id", "left_semi") if "imports" in name else fn).count()
