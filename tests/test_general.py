"""Repeated deliveries and orphan references, against brute force and in awkward cases."""

import datetime as dt
import os
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from atlasgraph.operators import orphans
from atlasgraph.streaming.delivery import repeated_deliveries

from .conftest import rows

DAY = dt.timedelta(days=1)
T0 = dt.datetime(2024, 1, 1)


def messages(folder, parts):
    folder.mkdir()
    for i, part in enumerate(parts):
        cols = list(zip(*part)) or [(), (), (), ()]
        pq.write_table(pa.table({"row_no": pa.array(cols[0], pa.int64()), "id": pa.array(cols[1], pa.string()), "group": pa.array(cols[2], pa.string()), "ts": pa.array(cols[3], pa.timestamp("us")), "best": pa.array([1] * len(cols[0]), pa.int64())}), folder / f"p{i}.parquet")
    return str(folder)


def brute(all_rows):
    best = {}
    for n, i, grp, ts in all_rows:
        if i is not None and grp is not None:
            best[i, grp] = min(best.get((i, grp), (dt.datetime.max, 10**9)), (ts or dt.datetime.max, n))
    kept = {n for _, n in best.values()}
    return sorted(r[0] for r in all_rows if r[1] is not None and r[2] is not None and r[0] not in kept)


def test_deliveries_with_late_arrivals(spark, tmp_path):
    rng, n, parts = random.Random(7), 0, []
    for f in range(4):
        part = []
        for _ in range(50):
            n += 1
            ts = None if rng.random() < 0.05 else T0 + DAY * (rng.randint(0, 300) + 400 * f - (900 if rng.random() < 0.2 else 0))
            part.append((n, rng.choice(["a", "b", "c", "d", None]), rng.choice(["A", "B", None]), ts))
        parts.append(part)
    path = messages(tmp_path / "m.parquet", parts)
    got = sorted(r[0] for r in repeated_deliveries(spark, path, files_per_batch=1).collect())
    assert got == brute([r for p in parts for r in p])


def test_a_standing_stream_reads_new_files_only(spark, tmp_path):
    old = [(i, f"m{i % 40}", "A", T0 + DAY * (i % 50)) for i in range(100)]
    new = [(i, f"m{30 + i % 30}", "A", T0 + DAY * (40 + i % 50)) for i in range(100, 200)]
    path, folder = messages(tmp_path / "m.parquet", [old]), str(tmp_path / "standing")
    run = lambda: sorted(r[0] for r in repeated_deliveries(spark, path, folder=folder).collect())
    assert run() == brute(old)
    states = lambda: set(os.listdir(f"{folder}/states"))
    first = states()
    for p in os.listdir(messages(tmp_path / "more", [new])):
        os.rename(tmp_path / "more" / p, f"{path}/new-{p}")
    assert run() == brute(old + new)
    touched = {r["k1"] for b in states() - first for r in spark.read.parquet(f"{folder}/states/{b}").collect()}
    assert touched == {r[1] for r in new} and run() == brute(old + new)
    late = [(900, "m1", "A", T0 - DAY * 400), (901, "m1", "A", T0 + DAY * 900)]
    for p in os.listdir(messages(tmp_path / "late", [late])):
        os.rename(tmp_path / "late" / p, f"{path}/late-{p}")
    assert run() == brute(old + new + late)


def test_deliveries_ties_hot_key_and_single_file(spark, tmp_path):
    part = [(i, "hot", "A", T0) for i in range(500, 0, -1)] + [(1000, "one", "A", T0)]
    path = messages(tmp_path / "m.parquet", [part])
    assert sorted(r[0] for r in repeated_deliveries(spark, path + "/p0.parquet").collect()) == list(range(2, 501))


def test_deliveries_empty(spark, tmp_path):
    assert repeated_deliveries(spark, messages(tmp_path / "m.parquet", [[]])).count() == 0


REFS = "edge_no long, src string, observed_at timestamp_ntz, h1 string"
NODES = "id string, created_at timestamp_ntz, deleted_at timestamp_ntz, kind string"


def orphaned(spark, nodes, refs):
    p = orphans.parents_table(spark.createDataFrame(nodes, NODES))
    return rows(orphans.find_orphans(orphans.refs_table(spark.createDataFrame(refs, REFS), "t", "edge_no", "src", "observed_at"), p), "record_id", "kind")


def test_orphans_cases(spark):
    nodes = [("a/b", T0, None, "x"), ("gone", T0, T0 + DAY, "x"), ("gone", T0 + 3 * DAY, T0 + 4 * DAY, "x"), ("young", T0 + 9 * DAY, None, "x"), (None, T0, None, "x"), ("a/b", T0, None, "x"), ("Case", T0, None, "x")]
    refs = [
        (1, " a\\b ", T0, ""), (2, "a/b", T0 - DAY, ""), (3, "gone", T0 + DAY, ""), (4, "gone", T0 + 3 * DAY, ""), (5, "gone", T0 + 2 * DAY, ""), (6, "young", T0, ""), (7, "young", T0 + 9 * DAY, ""), (8, None, T0, ""), (9, "no", T0, ""), (10, "case", T0, ""),
        (11, "young", None, ""), (12, "no", None, ""), (13, "", T0, ""), (14, "x" * 100_000, T0, ""),
    ]
    assert orphaned(spark, nodes, refs) == sorted([(2, "late"), (3, "deleted"), (5, "deleted"), (6, "late"), (9, "missing"), (10, "missing"), (12, "missing"), (13, "missing"), (14, "missing")], key=repr)


@pytest.mark.parametrize("nodes, refs, n", [([], [(1, "a", T0, "")], 1), ([("a", T0, None, "")], [], 0), ([], [], 0)])
def test_orphans_empty(spark, nodes, refs, n):
    assert len(orphaned(spark, nodes, refs)) == n


def test_orphans_random_with_hot_key_over_lanes(spark, monkeypatch):
    monkeypatch.setattr(orphans, "REFS_PER_TASK", 50)
    rng = random.Random(1)
    nodes = [(f"k{rng.randrange(30)}", T0 + DAY * rng.randrange(100), rng.choice([None, T0 + DAY * rng.randrange(100, 200)]), "") for _ in range(60)]
    refs = [(i, rng.choice(["k1", f"k{rng.randrange(40)}"]), T0 + DAY * rng.randrange(220), "") for i in range(600)]
    want = []
    for i, k, t, _ in refs:
        lives = [(c, d) for x, c, d, _ in nodes if x == k]
        if not any(c <= t and (d is None or t < d) for c, d in lives):
            want.append((i, "missing" if not lives else "late" if all(c > t for c, _ in lives) else "deleted"))
    assert orphaned(spark, nodes, refs) == sorted(want, key=repr)


def test_report_adds_up(spark, small):
    from atlasgraph.plans.general import p4_found, p4_report

    assert p4_report(spark, small).agg({"n": "sum"}).first()[0] == p4_found(spark, small).count()
