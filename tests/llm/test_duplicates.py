"""Problems 1, 4 and 7 against brute force."""

import random
import re
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from scorelake.llm import blocks, near_duplicates
from scorelake.llm.canonical import Trie, canonical_copies, canonical_groups, canonical_query
from scorelake.llm.components import connected_components
from scorelake.llm.cross_split import cross_split_overlaps, overlap_report
from scorelake.llm.near_duplicates import near_duplicate_groups, near_duplicate_pairs
from tests.conftest import DATA


def normal(t):
    return re.sub("[^a-z0-9]+", " ", t.lower()).strip(" ")


def alike(a, b):
    a, b = normal(a), normal(b)
    x, y = ({t[i : i + 3] for i in range(len(t) - 2)} for t in (a, b))
    return 1.0 if a == b else len(x & y) / max(1, len(x | y))


def brute(rows):
    """rows: (group, id, text)."""
    kept = {(g, i): t for g, i, t in rows if t is not None and i is not None}
    return {(g, *sorted((i, j))) for (g, i), (h, j) in combinations(kept, 2) if g == h and alike(kept[g, i], kept[h, j]) >= 0.65}


def pairs(spark, rows, **more):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "g string, i bigint, t string, text string, a int")
    return {(r["group"], r["id_a"], r["id_b"]) for r in near_duplicate_pairs(df, "g", "i", "t", **more).collect()}


def edited(rng, text):
    out = list(text)
    for _ in range(rng.randint(0, 5)):
        k = rng.randrange(len(out) + 1)
        kind = rng.randrange(3)
        if kind == 0:
            out.insert(k, rng.choice("abcxyz "))
        elif out:
            k %= len(out)
            out[k : k + 1] = [] if kind == 1 else [rng.choice("abcxyz")]
    return "".join(out)


def test_near_duplicates_brute_force(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 9))) for _ in range(300)]
    rows = []
    for k in range(120):
        base = "How many of the " + " ".join(rng.choices(words, k=rng.randint(1, 12))) + "?"
        rows += [("g" if rng.random() < 0.7 else "h", len(rows) + j, edited(rng, base)) for j in range(rng.randint(1, 4))]
    assert pairs(spark, rows) == brute(rows)


def test_near_duplicates_short_and_odd(spark):
    rows = [("g", i, t) for i, t in enumerate([None, "", "", "!!", "ab", "AB", "abc", "abcd", "abcde", "abcdef", "abcdefg", "zzzzzzzz", "zzzzzzzzz", "a b c", "A-B-C", "q" * 5000, "Q" * 4000 + "r", "é", "ü"])]
    rows += [("g", 3, "!!"), (None, 50, "abcd"), (None, 51, "abcd"), ("h", None, "abcd")]
    assert {p for p in pairs(spark, rows) if p[0] == "g"} == {p for p in brute(rows) if p[0] == "g"}
    assert pairs(spark, []) == set()


def test_near_duplicates_of_the_tables(spark):
    from scorelake.llm.near_queries import p1_found

    rows = [("dev", r["example_id"], r["question"]) for r in spark.read.parquet(f"{DATA}/dev.parquet").collect()]
    rows += [("spider_instance", r["instance_id"], r["utterance"]) for r in spark.read.parquet(f"{DATA}/spider_instance.parquet").collect()]
    assert {(r["source_table"], r["id_a"], r["id_b"]) for r in p1_found(spark, DATA).collect()} == brute(rows)


def test_hot_key_is_split(spark, monkeypatch):
    """A third of the rows share most of their grams: hot keys give way to more specific ones, at last to sub-blocks, and nothing is lost."""
    rng = random.Random(1)
    stem = "zyxwvutsrq ponmlkjihg fedcba zyxwvutsrq"
    rows = [("g", i, f"{stem} {rng.randint(10**5, 10**6)}") for i in range(60)] + [("g", 100 + i, "".join(rng.choices("abcdefgh ", k=60))) for i in range(120)]
    monkeypatch.setattr(blocks, "HOT", 20)
    monkeypatch.setattr(blocks, "CHUNK", 7)
    assert pairs(spark, rows) == brute(rows)
    assert pairs(spark, rows, exact=True) == brute(rows)
    side = lambda x: spark.createDataFrame([(i, t, None) for _, i, t in x], "i bigint, t string, q string")
    want = {(i, j) for _, i, t in rows[:30] for _, j, u in rows[30:] if alike(t, u) >= 0.65}
    assert want == {(r["a"], r["b"]) for r in cross_split_overlaps(side(rows[:30]), "i", side(rows[30:]), "i", "t", canonical_query(F.col("q"))).collect()}


def test_hot_keys_where_joins_turn_into_broadcasts(spark, monkeypatch):
    """Records of a key stay together when adaptive execution makes a broadcast of the join that takes the hot keys out."""
    rng = random.Random(1)
    stem = "zyxwvutsrq ponmlkjihg fedcba zyxwvutsrq"
    rows = [("g", i, f"{stem} {rng.randint(10**5, 10**6)}") for i in range(60)]
    for i in range(60):
        base = "".join(rng.choices("abcdefgh ", k=60))
        rows += [("g", 100 + 3 * i + k, edited(rng, base)) for k in range(3)]
    monkeypatch.setattr(blocks, "HOT", 20)
    monkeypatch.setattr(blocks, "CHUNK", 7)
    monkeypatch.setattr(blocks, "small", lambda df, *_: df, raising=False)
    more = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10m", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for k, v in more.items():
        spark.conf.set(k, v)
    try:
        assert pairs(spark, rows) == brute(rows)
    finally:
        for k in more:
            spark.conf.unset(k)


def test_keys_in_passes(spark, monkeypatch):
    """No more keys of a text are routed at once than a pass takes; the links are the same."""
    rng = random.Random(7)
    rows = [("gh"[i % 2], i, edited(rng, "how many of the visitors " + "".join(rng.choices("abcdefgh ", k=rng.choice([0, 40]))))) for i in range(150)]
    widths, spread = [], blocks.spread
    monkeypatch.setattr(blocks, "spread", lambda plan, often, first, end: widths.append((first, end, plan.n_keys)) or spread(plan, often, first, end))
    monkeypatch.setattr(blocks, "PASS_ROUTES", 1)
    monkeypatch.setattr(blocks, "PASS_KEYS", 3)
    assert pairs(spark, rows) == brute(rows)
    assert [k for first, end, _ in widths for k in range(first, end)] == list(range(widths[0][2])) and max(end - first for first, end, _ in widths) == 3


def test_dense_blocks(spark, monkeypatch):
    """Records of blocks in which most pairs are near the threshold meet their texts in the block; the links are the same."""
    monkeypatch.setattr(blocks, "DENSE_ROWS", 2)
    monkeypatch.setattr(blocks, "DENSE_SHARE", -1)
    monkeypatch.setattr(blocks, "OWN_SHARE", 0.3)
    rng = random.Random(6)
    stem = "how many of the visitors of every listed garden were counted with the name that begins like "
    rows = [("gh"[i % 2], i, stem + "".join(rng.choices("abcdefgh", k=rng.randint(0, 60)))) for i in range(90)] + [("g", 200, None), ("g", 201, "")]
    for hot in (8192, 20):
        monkeypatch.setattr(blocks, "HOT", hot)
        monkeypatch.setattr(blocks, "CHUNK", max(7, hot // 2))
        assert pairs(spark, rows) == brute(rows)
    side = lambda x: spark.createDataFrame([(i, t, None) for _, i, t in x], "i bigint, t string, q string")
    want = {(i, j) for _, i, t in rows[:40] for _, j, u in rows[40:] if t is not None and u is not None and alike(t, u) >= 0.65}
    assert want and want == {(r["a"], r["b"]) for r in cross_split_overlaps(side(rows[:40]), "i", side(rows[40:]), "i", "t", canonical_query(F.col("q"))).collect()}


def word_edit(rng, text):
    words = text.split(" ")
    for _ in range(max(1, len(words) // 60)):
        words[rng.randrange(len(words))] = rng.choice(words) if rng.random() < 0.5 else "".join(rng.choices("abcdefghijklmnop", k=6))
    return " ".join(words)


def letter_edit(rng, text):
    for _ in range(max(1, len(text) // 800)):
        text = edited(rng, text)
    return text


@pytest.mark.parametrize("low, high", [(0.65, 0.72), (0.80, 0.88)])
def test_recall_on_documents(spark, low, high):
    """Documents of 400 to 4,000 characters, edited by words and by letters until ``low`` to ``high`` alike: 0.99 of the pairs are found."""
    rng = random.Random(8)
    texts = [r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").where("length(text) between 400 and 4000 and lang = 'en'").orderBy("doc_id").select("text").collect()]
    bases = [normal(t) for t in texts if len(normal(t)) >= 400][:60]
    left, right = list(enumerate(bases)), []
    for i, t in enumerate(bases):
        for k, edit in enumerate((word_edit, letter_edit)):
            u, goal = t, rng.uniform(low, high)
            while alike(t, v := edit(rng, u)) >= goal:
                u = v
            right.append((1000 + 2 * i + k, u))
    l, r = (spark.createDataFrame([(*x, None) for x in side], "i bigint, t string, q string") for side in (left, right))
    want = {(i, j) for i, t in left for j, u in right if alike(t, u) >= 0.65}
    got = {(x["a"], x["b"]) for x in cross_split_overlaps(l, "i", r, "i", "t", canonical_query(F.col("q"))).collect()}
    assert got <= want and len(got) >= 0.99 * len(want) and len(want) >= 60
    both = [("g", *x) for x in left + right]
    want, got = brute(both), pairs(spark, both)
    assert got <= want and len(got) >= 0.99 * len(want)


def test_keys_grow_slower_than_the_texts():
    from scorelake.llm.textsim import KeyPlan

    for n in (10**3, 10**4, 10**6, 10**9):
        a, b = KeyPlan(n, 0.65, 0.13), KeyPlan(10 * n, 0.65, 0.13)
        assert b.n_keys <= 3 * a.n_keys and (1 - 0.65**b.n_values) ** b.n_keys <= 1e-4


def test_large_class_of_copies(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates, "ALL_PAIRS", 3)
    rows = [("g", i, "one question about many keepers") for i in range(6)] + [("g", 9, "one question about many keeper")]
    assert pairs(spark, rows) == {("g", 0, i) for i in (1, 2, 3, 4, 5, 9)}


def test_groups(spark):
    rows = [("g", 1, "alpha beta gamma delta"), ("g", 2, "alpha beta gamma deltas"), ("g", 3, "alpha beta gamma deltas x"), ("g", 4, "something else entirely"), ("g", 5, "something else entirely"), ("g", 6, None)]
    df = spark.createDataFrame(rows, "g string, i bigint, t string")
    got = {r["id"]: r["group_id"] for r in near_duplicate_groups(df, "g", "i", "t").collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4}


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 102), (7, 7)]
    got = {r["id"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in (100, 101, 102)}


def test_cross_split(spark):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(200)]
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 14))) for _ in range(120)]
    left = [(i, edited(rng, rng.choice(texts)), f"SELECT a, b FROM t{rng.randint(0, 300)}") for i in range(150)] + [(900, None, None), (901, "", " "), (902, "abc", None)]
    right = [(1000 + i, edited(rng, rng.choice(texts)), f"select b,a  from T{rng.randint(0, 300)};") for i in range(200)] + [(2000, None, None), (2001, "", ""), (2002, "abcd", None)]
    schema = "i bigint, t string, q string"
    l, r = spark.createDataFrame(left, schema), spark.createDataFrame(right, schema)
    got = {(x["a"], x["b"]) for x in cross_split_overlaps(l, "i", r, "i", "t", canonical_query(F.col("q"))).collect()}
    table = lambda q: re.search(r"t(\d+)", q.lower()).group(1) if q and q.strip() else None
    want = {(i, j) for i, t, q in left for j, u, p in right if (t is not None and u is not None and alike(t, u) >= 0.65) or (table(q) is not None and table(q) == table(p))}
    assert got == want
    empty = spark.createDataFrame([], schema)
    assert cross_split_overlaps(l, "i", empty, "i", "t", canonical_query(F.col("q"))).count() == 0


def test_cross_split_same_grams(spark):
    """Different texts with the same set of 3-grams are alike, though not equal."""
    left = [(1, "Which stadiums have a roof and a garden and a roof and a tower and a roof?", None), (2, "the number 1000000", None), (3, "the number 1000000", None), (4, "ab", None)]
    right = [(11, "Which stadiums have a roof and a tower and a roof and a garden and a roof?", None), (12, "the number 10000000", None), (13, "The number 1000000!", None), (14, "ab", None)]
    assert alike(left[0][1], right[0][1]) == 1 and normal(left[0][1]) != normal(right[0][1])
    l, r = (spark.createDataFrame(x, "i bigint, t string, q string") for x in (left, right))
    got = sorted((x["a"], x["b"]) for x in cross_split_overlaps(l, "i", r, "i", "t", canonical_query(F.col("q"))).collect())
    assert got == [(1, 11), (2, 12), (2, 13), (3, 12), (3, 13), (4, 14)]


def test_long_texts_with_insertions(spark, monkeypatch):
    """Inserted or appended rare text doesn't part a long text from its original; chunks of bands are split."""
    monkeypatch.setattr(blocks, "CHUNK", 9)
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8))) for _ in range(90)]
    bases = ["which of the " + " ".join(rng.choices(words, k=rng.randint(14, 30))) for _ in range(40)]
    junk = lambda n: "".join(rng.choices("0123456789abcdef", k=n))
    changed = [f"{t} {junk(48)}" if i % 2 else f"{t[:50]} {junk(40)} {t[50:]}" for i, t in enumerate(bases)]
    left, right = list(enumerate(bases)), [(100 + i, t) for i, t in enumerate(changed)]
    want = {(i, j) for i, t in left for j, u in right if alike(t, u) >= 0.65}
    assert len(want) > 20
    assert pairs(spark, [("g", *r) for r in left + right]) == brute([("g", *r) for r in left + right])
    l, r = (spark.createDataFrame([(*x, None) for x in side], "i bigint, t string, q string") for side in (left, right))
    for exact in (False, True):
        assert {(x["a"], x["b"]) for x in cross_split_overlaps(l, "i", r, "i", "t", canonical_query(F.col("q")), exact=exact).collect()} == want


def test_cross_split_of_the_tables(spark):
    from scorelake.llm.canonical_queries import CANON_SQL
    from scorelake.llm.overlap_queries import p4_found
    import duckdb

    con = duckdb.connect()
    for t in ("dev", "train_spider"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    dev, train = (con.execute(f"select example_id, question from {t}").fetchall() for t in ("dev", "train_spider"))
    same = f"select d.example_id, t.example_id from ({CANON_SQL}) a join ({CANON_SQL}) b using (canon) join dev d on d.example_id = a.example_id join train_spider t on t.example_id = b.example_id where canon <> ''"
    want = {(i, j) for i, t in dev if t is not None for j, u in train if u is not None and len(set(normal(t).split()) & set(normal(u).split())) > 4 and alike(t, u) >= 0.65}
    got = {(r["dev_id"], r["train_id"]) for r in p4_found(spark, DATA).collect()}
    assert got == want | set(con.execute(same).fetchall())


def test_overlap_report(spark):
    left = spark.createDataFrame([(1, "dev", "crowd"), (2, "test", None)], "i bigint, s string, o string")
    found = overlap_report(spark.createDataFrame([(1, 5), (1, 6), (2, 5)], "a bigint, b bigint"), left, "i", "s", "o").collect()
    assert sorted((r["split"], r["source"], r["n_pairs"], r["n_records"]) for r in found) == [("dev", "crowd", 2, 1), ("test", None, 1, 1)]


@pytest.mark.parametrize(
    "a, b, same",
    [
        ("SELECT a, b FROM t", "select b ,a from t;", True),
        ("SELECT DISTINCT a, b FROM t", "select distinct b, a from t", True),
        ("SELECT DISTINCT a FROM t", "SELECT a FROM t", False),
        ("SELECT f(a, b), c FROM t", "SELECT c, f(a, b) FROM t", True),
        ("SELECT f(a, b), c FROM t", "SELECT f(b, a), c FROM t", False),
        ("SELECT a FROM t WHERE x = 'Y z'", 'select a from `t` where x="yz"', True),
        ("SELECT a, b FROM t WHERE x IN (SELECT c, d FROM u)", "SELECT b, a FROM t WHERE x IN (SELECT d, c FROM u)", False),
        ("SELECT a, b", "SELECT b, a", False),
    ],
)
def test_canonical_form(spark, a, b, same):
    r = spark.createDataFrame([(a, b)], "a string, b string").select(canonical_query(F.col("a")).alias("a"), canonical_query(F.col("b")).alias("b")).first()
    assert (r["a"] == r["b"]) == same


def test_canonical_groups_split_buckets(spark):
    rng = random.Random(2)
    texts = ["select x from " + "".join(rng.choices("ab", k=rng.choice([3, 30, 90, 300]))) for _ in range(400)] + ["select hot from t"] * 300 + [None, "", " ;"]
    rows = [(i, t, 0) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "i bigint, q string, keep_id int").repartition(3)
    want = {}
    for i, t, _ in rows:
        if t and t.strip(" ;"):
            want.setdefault(t.replace(" ", ""), []).append(i)
    got = sorted((r["keep_id"], r["copies"]) for r in canonical_groups(df, "i", canonical_query(F.col("q")), bucket_rows=5).collect())
    assert got == sorted((min(v), len(v)) for v in want.values())
    copies = {(r["keep_id"], r["copy_id"]) for r in canonical_copies(df, "i", canonical_query(F.col("q")), bucket_rows=5).collect()}
    assert copies == {(min(v), i) for v in want.values() for i in v if i != min(v)}
    assert canonical_copies(df.limit(0), "i", canonical_query(F.col("q"))).count() == 0


def test_trie():
    t = Trie()
    for key, i in [(b"", 5), (b"abc", 3), (b"abcdefgh", 2), (b"abcdefghi", 9), (b"abc", 1), (b"abc", 7)]:
        t.add(key, i, 1)
    assert sorted(t.items()) == [(b"", 5, 1), (b"abc", 1, 3), (b"abcdefgh", 2, 1), (b"abcdefghi", 9, 1)]
