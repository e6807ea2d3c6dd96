"""Problems 2 and 6."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scorelake.llm import group_split
from scorelake.llm.group_split import leaking_entities, place_components, round_bundles, split_by_entity, split_rows
from scorelake.llm.quota_sample import allocate, draw_sample, largest_remainder, plan_sample

lists = st.integers(1, 6).flatmap(lambda n: st.tuples(st.lists(st.integers(0, 60), min_size=n, max_size=n), st.lists(st.integers(0, 10), min_size=n, max_size=n), st.lists(st.integers(0, 200), min_size=n, max_size=n)))


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 300), lists)
def test_allocation(size, spec):
    shares, floors, available = spec
    q = allocate(size, shares, floors, available)
    low = [min(f, a) for f, a in zip(floors, available)]
    assert all(lo <= x <= a for lo, x, a in zip(low, q, available))
    if sum(shares) and all(shares):
        assert sum(q) == max(sum(low), min(size, sum(available)))


def test_largest_remainder():
    assert largest_remainder(10, [1, 1, 1]) == [4, 3, 3] and largest_remainder(0, [1]) == [0] and largest_remainder(5, [0, 0]) == [0, 0]


def test_plan_and_draw(spark):
    pool = spark.createDataFrame([("s", "a" if i % 3 else "b", i) for i in range(300)] + [("s", "b", 0)] + [("s", "c", 1000), ("s", None, 5), (None, "a", 6)], "stratum string, category string, id bigint")
    targets = spark.createDataFrame([("s", "a", 50, 1, 20), ("s", " B ", 40, 1, 20), ("s", "c", 10, 3, 20), ("s", "d", 0, 0, 20), ("s", "c", 10, 3, 20), ("t", "a", 100, 1, 5), ("s", "e", None, None, None), (None, "x", 1, 1, 1)], "stratum string, category string, target_pct int, min_rows int, sample_size bigint")
    plan = plan_sample(pool, targets)
    rows = {(r["stratum"], r["category"]): (r["available"], r["wanted"], r["quota"], r["shortfall"]) for r in plan.collect()}
    assert rows["s", "c"] == (1, 3, 1, 2) and rows["t", "a"] == (0, 5, 0, 5) and rows["s", "d"] == (0, 0, 0, 0) and rows["s", "e"] == (0, 0, 0, 0)
    drawn = draw_sample(pool, plan, seed=3)
    counts = {(r["stratum"], r["category"]): r["n"] for r in drawn.groupBy("stratum", "category").agg(F.count("*").alias("n")).collect()}
    assert counts == {("s", "a"): rows["s", "a"][2], ("s", "b"): rows["s", " B "][2], ("s", "c"): 1} and sum(counts.values()) == 20
    assert drawn.select("id").distinct().count() >= 19
    again = draw_sample(pool.repartition(7), plan, seed=3)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, drawn.collect()))
    assert sorted(map(tuple, draw_sample(pool, plan, seed=4).collect())) != sorted(map(tuple, drawn.collect()))
    assert plan_sample(pool.limit(0), targets).where("quota > 0").count() == 0 and plan_sample(pool, targets.limit(0)).count() == 0


def entity_splits(spark, rows, targets):
    df = spark.createDataFrame(rows, "i bigint, e string, l string, entity string, label int")
    return split_by_entity(df, ["i"], F.col("e"), F.col("l"), targets).collect()


def test_split_keeps_entities_together(spark):
    rows = [(i, f"e{i % 97}" if i % 10 else None, ["x", "y", None][i % 3], "clash", 1) for i in range(2000)] + [(5000 + i, "hot", "x", None, None) for i in range(900)]
    got = entity_splits(spark, rows, {"train": 80, "validation": 10, "test": 10})
    assert len(got) == len(rows) and len({r["i"] for r in got}) == len(rows)
    by = {}
    for r in got:
        if r["entity"] is not None:
            by.setdefault(r["entity"], set()).add(r["new_split"])
    assert all(len(s) == 1 for s in by.values())
    share = {s: sum(r["new_split"] == s for r in got) / len(rows) for s in ("train", "validation", "test")}
    assert abs(share["train"] - 0.8) < 0.01 and abs(share["test"] - 0.1) < 0.01
    assert entity_splits(spark, [], {"train": 1}) == []
    with pytest.raises(ValueError):
        entity_splits(spark, rows[:5], {})


def test_less_detail(spark, monkeypatch):
    """Whatever the bound on bundles, entities stay whole and shares near."""
    rows = [(i, f"e{i * i % 211}" if i % 7 else None, "xyz"[i % 3], "clash", 1) for i in range(3000)]
    for bound in (30, 12, 4):
        monkeypatch.setattr(group_split, "BUNDLES", bound)
        monkeypatch.setattr(group_split, "LABELS", 2)
        got = entity_splits(spark, rows, {"train": 80, "validation": 10, "test": 10})
        assert len({r["i"] for r in got}) == len(got) == len(rows)
        assert len({(r["entity"], r["new_split"]) for r in got if r["entity"]}) == len({r["entity"] for r in got if r["entity"]})
        assert abs(sum(r["new_split"] == "train" for r in got) / len(rows) - 0.8) < 0.05


def test_every_label_and_bundle_counts(spark, monkeypatch):
    """However many labels and bundles there are, none is merged with others: placement and leaks are as with all of them at once."""
    rows = [(i, f"e{i * i % 53}" if i % 7 else None, f"{'dev' if i % 3 else 'train'}/{i % 19}") for i in range(600)]
    df = spark.createDataFrame(rows, "i bigint, e string, l string")
    found = []
    for bound in (50_000, 5):
        monkeypatch.setattr(group_split, "BUNDLES", bound)
        monkeypatch.setattr(group_split, "LABELS", bound)
        placed = place_components(df, ["i"], F.col("e"), F.col("l"), {"train": 80, "validation": 10, "test": 10})
        leaks = leaking_entities(placed, F.substring_index("label", "/", 1), ["dev", "train"])
        found.append((sorted(map(str, placed.collect())), sorted(r["entity"] for r in leaks.collect())))
    sides = {(e, l.split("/")[0]) for _, e, l in rows if e}
    assert found[0][1] == sorted(e for e, s in sides if s == "dev" and (e, "train") in sides) and found[0] == found[1]


def test_flow_meets_quotas():
    rows = split_rows({"a": 1000, "b": 37, "": 5}, {"train": 80, "validation": 10, "test": 10})
    for label, n in (("a", 1000), ("b", 37), ("", 5)):
        assert sum(v for (lab, _), v in rows.items() if lab == label) == n
    assert abs(sum(v for (_, s), v in rows.items() if s == "train") - 833) <= 1


def test_flow_of_many_labels():
    labels = {f"l{i}": 1 + i * 7919 % 1000 for i in range(10_000)}
    shares = {"train": 80, "validation": 10, "test": 10}
    rows = split_rows(labels, shares)
    for label, n in labels.items():
        assert sum(rows[label, s] for s in shares) == n and all(0 <= rows[label, s] - n * pct // 100 <= 2 for s, pct in shares.items())
    for s, pct in shares.items():
        assert 0 <= sum(rows[label, s] for label in labels) - sum(labels.values()) * pct // 100 <= 2
    bundles = [(1 + i % 40, ((f"l{i}", 1 + i % 40),), 3) for i in range(10_000)]
    out = round_bundles(bundles, split_rows({p[0][0]: 3 * s for s, p, _ in bundles}, shares), list(shares))
    assert sum(n for *_, n in out) == 30_000


profiles = st.dictionaries(st.sampled_from("abc"), st.integers(1, 20), min_size=1).map(lambda d: tuple(sorted(d.items())))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(profiles, st.integers(1, 30)), min_size=1, max_size=12, unique_by=lambda t: t[0]))
def test_rounding_places_every_component(found):
    bundles = [(sum(n for _, n in p), p, count) for p, count in found]
    labels = {}
    for _, p, count in bundles:
        for label, n in p:
            labels[label] = labels.get(label, 0) + n * count
    shares = {"train": 80, "validation": 10, "test": 10}
    out = round_bundles(bundles, split_rows(labels, shares), list(shares))
    for b, (_, _, count) in enumerate(bundles):
        assert sum(n for c, _, n in out if c == b) == count
    total, largest = sum(labels.values()), max(s for s, *_ in bundles)
    for s, pct in shares.items():
        assert abs(sum(bundles[b][0] * n for b, t, n in out if t == s) - total * pct / 100) <= largest + len(shares)


def test_leaks(spark):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate([("a", "dev"), ("a", "train"), ("b", "dev"), (None, "dev"), (None, "train"), ("c", None)])], "i bigint, e string, s string")
    placed = place_components(df, ["i"], F.col("e"), F.col("s"), {"train": 1})
    assert [r["entity"] for r in leaking_entities(placed, F.col("label"), ["dev", "train"]).collect()] == ["a"]
