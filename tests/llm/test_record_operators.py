"""Components, split overlaps, shared spans and mixing, against brute force and in awkward cases."""

import random
import time
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest

from atlasgraph.llm import components as cc
from atlasgraph.llm import mixing, spans, splits

from ..conftest import rows


def find_roots(vertices, pairs):
    root = {v: v for v in vertices}

    def up(v):
        while root[v] != v:
            root[v] = root[root[v]]
            v = root[v]
        return v

    for a, b in pairs:
        if a in root and b in root and a is not None:
            x, y = up(a), up(b)
            root[max(x, y)] = min(x, y)
    return {v: up(v) for v in vertices}


@pytest.mark.parametrize("kind", ["random", "chain", "star", "none"])
def test_components(spark, kind):
    rng, n = random.Random(4), 200
    pairs = {"random": [(rng.randrange(n), rng.randrange(n)) for _ in range(150)], "chain": [(i, i + 1) for i in range(60)], "star": [(150, i) for i in range(100)], "none": []}[kind]
    pairs += [(3, 3), (None, 1)] + pairs[:5]
    v = spark.createDataFrame([(i,) for i in range(n)] + [(5,), (None,)], "v long")
    got = dict(rows(cc.connected_components(v, spark.createDataFrame(pairs, "a long, b long"))))
    assert got == find_roots(range(n), [p for p in pairs if None not in p])


def test_consolidate(spark):
    groups = [(1, "Alpha Beta", ["x"], None), (2, "other", ["alpha-beta"], []), (3, "z", [None, ""], ["Other"]), (4, "alone", None, None), (5, "-", [" "], None), (6, "-", None, None), (7, None, None, None), (8, "foo_bar", None, None), (9, "foo-bar", None, None), (10, "q", None, None), (1, "Alpha Beta", ["x"], None)]
    audit = [(1, 4, 10, "same"), (2, 10, 4, "different"), (3, 4, 99, "same"), (4, None, 4, "same"), (5, 8, 8, "same"), (6, 9, 8, "unsure")]
    g = spark.createDataFrame(groups, "group_no long, name string, members array<string>, aliases array<string>").selectExpr("*", "'x' as root_no", "1 as v")
    out = dict(rows(cc.consolidate(g, spark.createDataFrame(audit, "id long, left_ref long, right_ref long, verdict string")), "group_no", "root_no"))
    assert out == {1: 1, 2: 1, 3: 1, 4: 4, 10: 4, 5: 5, 6: 6, 7: 7, 8: 8, 9: 9}
    assert cc.consolidate(g.limit(0), spark.createDataFrame([], "id long, left_ref long, right_ref long, verdict string")).count() == 0


def test_hot_name_gives_as_many_edges_as_members(spark):
    m = spark.range(2000).selectExpr("id as v", "'hot' as l")
    assert cc.star_edges(m, "v", "l").count() < 2100
    assert {r["root"] for r in cc.connected_components(m, cc.star_edges(m, "v", "l")).collect()} == {0}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i] + row[1:], row
        for j, y in enumerate(b, 1):
            row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
    return row[-1]


def test_layout_of_a_mixture():
    assert mixing.layout(0) == (256, 64) and mixing.layout(10**6) == (256, 64)
    blocks, shards = mixing.layout(25 * 10**12)
    assert blocks == 50_000 and shards == 125_000 and mixing.layout(4 * 25 * 10**12)[0] == 2 * blocks


def test_split_overlaps_against_all_pairs(spark):
    rng = random.Random(11)
    words = "cursor ledger harbor funnel pallet roster beacon shard lexicon digest symbol anchor".split()
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(3, 14))) for _ in range(60)]

    def edit(t, k):
        t = list(t)
        for _ in range(k):
            i = rng.randrange(len(t))
            t[i : i + 1] = rng.choice([[], ["x"], [t[i], "y"]])
        return "".join(t)

    recs = [(f"T{i}", "FZ_train", "s", t) for i, t in enumerate(base)]
    recs += [(f"E{i}", rng.choice(["FZ_dev", "L0"]), rng.choice(["a", None]), edit(t, rng.randint(0, max(1, len(t) // 8)))) for i, t in enumerate(base)]
    recs += [("E900", "PP", "a", base[0].upper() + "!"), ("E901", "PP", "a", base[1].replace(" ", "\u3000")), ("E902", "PP", "a", None), ("E903", "PP", "a", " - "), ("T903", "FZ_train", "a", "?"), ("E0", "FZ_dev", "a", base[0]), ("E0", "FZ_dev", "a", base[0])]
    df = spark.createDataFrame(recs, "id string, subset string, source string, question string").selectExpr("*", "1 as band", "2 as class_id")
    got = {tuple(r) for r in splits.overlaps(df).select("train_id", "eval_id").distinct().collect()}
    bare = lambda t: "".join(c for c in t.lower().replace("\u3000", "") if c.isalnum())
    want = set()
    for ti, s, _, t in recs:
        for ei, es, _, e in recs:
            if s == "FZ_train" and es != "FZ_train" and t and e and bare(t) and bare(e):
                a, b = bare(t), bare(e)
                if distance(a, b) <= int(0.1 * max(len(a), len(b))):
                    want.add((ti, ei))
    assert got == want and len(want) > 25
    texts = {i: [t for j, _, _, t in recs if j == i] for i, *_ in recs}
    for r in splits.linked_records(df).collect():
        if len(texts[r["id"]]) == 1:
            assert r["links"] == sum(p[r["side"] == "eval"] == r["id"] for p in want)
    report = splits.overlap_report(df)
    assert {r["split"]: r["records"] for r in report.groupBy("split").agg({"records": "sum"}).withColumnRenamed("sum(records)", "records").collect()}["PP"] == len({e for _, e in want if e in ("E900", "E901")})
    assert report.agg({"pairs": "sum"}).first()[0] >= len(want) and splits.overlap_report(df.limit(0)).count() == 0
    assert ("T0", "E900") in got and ("T1", "E901") in got
    assert splits.overlaps(df.limit(0)).count() == 0


def test_band_recall_is_what_is_said():
    rng, found, n = random.Random(2), 0, 150
    for _ in range(n):
        t = "".join(rng.choice("abcdefghijklmnop") for _ in range(100))
        e = list(t)
        for i in rng.sample(range(100), 10):
            e[i] = "z"
        found += bool(set(enumerate(splits.band_keys(t))) & set(enumerate(splits.band_keys("".join(e)))))
    assert found >= 0.96 * n


def test_pair_bits_keep_every_text_within_the_distance():
    rng = random.Random(5)
    for _ in range(300):
        t = "".join(rng.choice("abcdefgh才么") for _ in range(rng.randint(1, 120)))
        e, k = list(t), rng.randint(1, 9)
        for _ in range(k):
            i = rng.randrange(len(e) + 1)
            e[i : i + rng.randint(0, 1)] = rng.choice([[], ["x"], ["y"]])
        a, b = ([int(w) & (2**64 - 1) for w in row] for row in splits.pair_bits([t, "".join(e)]))
        assert max(sum((x & ~y).bit_count() for x, y in zip(*p, strict=True)) for p in ((a, b), (b, a))) <= 2 * k


def test_rounds_of_bands_are_the_bands():
    texts = ["", "a", "ab", "somewhat longer text"] * 3 + ["x" * 70_000]
    whole = splits.batch_keys(texts)
    assert all((whole[:, i : i + splits.ROUND] == splits.batch_keys(texts, i, splits.ROUND)).all() for i in range(0, splits.BANDS, splits.ROUND))
    assert (whole[3] == splits.band_keys(texts[3])).all() and splits.batch_keys([]).shape == (0, splits.BANDS)


def test_overlaps_leave_no_shuffle_files_of_what_is_written(spark):
    blocks = lambda: {b.toString() for b in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()) if b.toString().startswith("shuffle_")}
    before = blocks()
    df = spark.createDataFrame([(f"T{i}", "FZ_train", "s", f"how does cursor {i} reach ledger {i * 7}") for i in range(40)] + [("E", "L0", "s", "how does cursor 3 reach ledger 21")], "id string, subset string, source string, question string")
    splits.overlaps(df)
    for _ in range(50):
        if not blocks() - before:
            break
        time.sleep(0.1)
    assert not blocks() - before


def shared_by_windows(docs, span):
    holders = defaultdict(set)
    for i, t in docs:
        for p in range(len(t or "") - span + 1):
            holders[t[p : p + span]].add(i)
    return {p for h in holders.values() for p in combinations(sorted(h), 2)}


@pytest.mark.parametrize("alphabet", ["abcdefghij ", "ab", "中文é🎈x"])
def test_shared_spans_against_all_windows(spark, alphabet):
    rng = random.Random(8)
    rand = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    docs = []
    for i in range(24):
        docs.append((i, rand(rng.randint(0, 500))))
    for i in range(24, 48):
        other = docs[rng.randrange(24)][1]
        n = rng.choice([39, 40, 41, 60, 200])
        at = rng.randrange(max(1, len(other) - n))
        docs.append((i, rand(rng.randint(0, 90)) + other[at : at + n] + rand(rng.randint(0, 90))))
    docs += [(60, "-" * 300), (61, "-" * 45), (62, "x" + "-" * 39 + "y"), (63, docs[3][1]), (64, docs[3][1]), (65, ""), (66, None), (60, "-" * 300)]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as t", "2 as h", "3 as at")
    got = {tuple(r) for r in spans.sharing_pairs(df, span=40, gram=20).collect()}
    assert got == shared_by_windows(dict(docs).items(), 40)
    part = {r["doc_id"]: r for r in spans.shared_parts(df, span=40, gram=20).collect()}
    assert part[65]["share"] == 0 and part[66]["n_chars"] == 0 and (63 not in {x for p in got for x in p} or part[63]["share"] == 1.0)
    holders = defaultdict(set)
    for i, t in docs:
        for p in range(len(t or "") - 39):
            holders[t[p : p + 40]].add(i)
    for i, t in dict(docs).items():
        cover = set()
        for p in range(len(t or "") - 39):
            if len(holders[t[p : p + 40]]) > 1:
                cover |= set(range(p, p + 40))
        assert part[i]["shared_chars"] == len(cover)


def test_shared_spans_long_text_and_empty(spark):
    big = "".join(random.Random(1).choice("abcdefgh") for _ in range(400_000))
    df = spark.createDataFrame([(1, big), (2, "q" * 50 + big[123_456 : 123_456 + 160]), (3, big[5:164])], "doc_id long, text string")
    assert rows(spans.sharing_pairs(df)) == [(1, 2)]
    assert spans.sharing_pairs(df.limit(0)).count() == 0 and spans.shared_parts(df.limit(0)).count() == 0


def test_splitting_tree_is_exact():
    counts = np.array([100, 3, 0, 57])
    out = mixing.split_tree(counts, 8, 1)
    assert (out.sum(axis=0) == counts).all() and out.sum(axis=1).max() - out.sum(axis=1).min() <= 3


def test_mixture(spark):
    docs = [(i, "words in a row " * (1 + i % 7), "big") for i in range(300)] + [(1000 + i, "few words", "small") for i in range(6)] + [(2000, None, "big"), (2001, "", "small"), (2002, "lost", None), (2003, "unlisted", "zzz")]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string").selectExpr("*", "1 as block", "2 as shard")
    t = spark.createDataFrame([("big", 0.6, 1), ("small", 0.3, 4), ("absent", 0.1, 2), ("small", 0.3, 4)], "source string, target_share double, max_repeats int")
    out, quotas = mixing.mixture(d, t)
    use = out.collect()
    size = {q["source"]: q for q in quotas}
    got = defaultdict(int)
    times = defaultdict(int)
    for r in use:
        got[r["source"]] += r["n_tokens"]
        times[r["doc_id"], r["copy"]] += 1
    assert max(times.values()) == 1 and {r["source"] for r in use} == {"big", "small"}
    assert got["small"] == size["small"]["available"] * 4 == size["small"]["quota"] < size["small"]["wanted"]
    assert size["big"]["quota"] - 30 < got["big"] <= size["big"]["quota"] and size["absent"]["available"] == 0
    rep = {r["source"]: r for r in mixing.mixture_report(d, t).collect()}
    assert abs(sum(r["actual_share"] for r in rep.values()) - 1) < 1e-5 and rep["small"]["repeats"] == 4 and rep["absent"]["got"] == 0
    few, again = mixing.mixture(d, t, blocks=5, shards=3)
    assert {r["shard"] for r in few.collect()} <= {0, 1, 2} and [q["quota"] for q in again] == [q["quota"] for q in quotas]
    assert mixing.mixture(d.limit(0), t)[0].count() == 0 and mixing.mixture(d, t.limit(0))[0].count() == 0


def test_span_clusters_and_classes(spark):
    one, two, three = (c * 3 + "".join(random.Random(i).choice("abcdefgh") for _ in range(200)) for i, c in enumerate("xyz"))
    docs = [(5, one), (1, one[:170]), (9, one[20:] + two), (12, two), (2, three), (3, three), (3, three), (4, "short"), (6, None), (7, "q" * 200)]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as root", "2 as t", "3 as label")
    assert rows(spans.clusters(df), "doc_id", "root") == sorted([(1, 1), (5, 1), (9, 1), (12, 1), (2, 2), (3, 2)], key=repr)
    got = {r["doc_id"]: (r["class_id"], r["links"]) for r in spans.sharing_classes(df).collect()}
    pairs = {tuple(r) for r in spans.sharing_pairs(df).collect()}
    assert got == {i: (2 if i == 3 else i, sum(i in p for p in pairs)) for i in (1, 2, 3, 5, 7, 9, 12)} and pairs
    assert spans.clusters(df.limit(0)).count() == 0 and spans.sharing_classes(df.limit(0)).count() == 0
