"""Problems 5, 8, 9 and 10."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scorelake.llm import tokens
from scorelake.llm.broken_pairs import breaks_off, broken_pairs, common_subsequence, defect_of, is_copy, is_refusal, language
from scorelake.llm.packing import fill_containers, pack
from scorelake.llm.pieces import split_corpus, split_text

PATH = tokens.tokenizer_file("byte_bpe_50k")
ENC = tokens.encoder(PATH)
ASKED = "How many keepers have a record whose town is Flo Gra 85.9?"
MESSAGE = f"The database has these tables:\nkeeper\n* town (text): town\n\nPlease answer:\n{ASKED}\nWith SQL."


@pytest.mark.parametrize(
    "answer, defect",
    [
        (None, "empty"), ("", "empty"), (" \n​", "empty"), ("```sql\n```", "empty"), (";;", "empty"), ('""', "empty"), ("…", "empty"),
        (ASKED, "copy"), (ASKED.upper(), "copy"), (f"> {ASKED.replace(' ', '  ')}", "copy"), (f"You asked: {ASKED.replace('.', '')}", "copy"), (f'"{ASKED}"\n{ASKED}', "copy"), (MESSAGE, "copy"), (f"```\n-- {ASKED}\n```", "copy"),
        ("I'm sorry, but I can’t help with that.", "refusal"), ("-- NO QUERY CAN BE GIVEN.", "refusal"), ("Das kann ich leider nicht beantworten.", "refusal"),
        ("Sorry for the earlier mix-up, the corrected query is\nSELECT a FROM t", None), ("SELECT a FROM t WHERE b LIKE '%cannot answer this%'", None),
        ("I'm sorry, but I can't help with that SELECT.", "refusal"), ("Select the makers of every barge? No query can be given.", "refusal"),
        ("Die Abfrage liefert alle Zeilen aus der Tabelle.", "language"), ("La consulta devuelve las filas de t.\nSELECT a FROM t", "language"), ("SELECT a FROM t;\nЗапрос возвращает строки таблицы", "language"), ("この表で十分です。", "language"),
        ("SELECT a FROM t WHERE b = 'Grün für die Zeilen der Tabelle'", None), ("/* The table is small and it has no index. */ SELECT a FROM t", None),
        ("The following statement does it:", "truncated"), ("SELECT", "truncated"), ("SELECT count(", "truncated"), ("SELECT count(*)", "truncated"), ("SELECT a FROM t WHERE", "truncated"), ("SELECT a FROM t WHERE b = 'x", "truncated"),
        ("SELECT a FROM t WHERE b = 'x' AND...", "truncated"), ("SELECT a FROM t WHERE b = 'x' AND c", "truncated"), ("SELECT a FROM t ORDER BY", "truncated"), ("```sql\nSELECT a FROM t WHERE b IN (SELECT\n```", "truncated"),
        ("SELECT a FROM t", None), ("select a\nfrom t\nwhere b = 1\n  and c between 1 and 5\norder by a desc limit 5;\nLet me know if the sorting is wrong.", None), (f"-- {ASKED}\nSELECT count(*) FROM keeper", None), ("SELECT nonsense FROM nowhere", None),
    ],
)
def test_defects(answer, defect):
    assert defect_of(answer, ASKED, MESSAGE) == defect


# Refusals, prose in languages without a list of words, and what is neither; written after the rules and not used to fit them.
HELD_OUT = {
    "refusal": """I'm afraid I won't be answering that.
Apologies, but writing queries over personal records is something I don't do.
That's not a request I can act on.
I would prefer not to work on this one.
My guidelines stop me from helping with this.
We are not authorised to return that kind of information.
I have no means of looking into that database.
Without further details I cannot tell what the statement should be.
It isn't possible for me to write this.
I must respectfully decline.
I couldn't say which table would hold that.
Sorry, no can do: I am not permitted to share it.
Leider bin ich nicht in der Lage, das zu beantworten.
Ich möchte dazu nichts schreiben.
Désolé, je ne suis pas en mesure de vous aider.
No dispongo de permiso para consultar esos datos.
Non sono autorizzato a rispondere.
Infelizmente não consigo responder a isso.
Ik mag deze vraag niet beantwoorden.
Niestety nie jestem w stanie odpowiedzieć.
Jag får inte lämna ut det.
Jeg kan desværre ikke hjælpe med det.
En voi vastata tähän kysymykseen.
К сожалению, я не могу помочь.
抱歉，我无法回答这个问题。""",
    "language": """Frågan räknar hur många djurskötare som finns i varje stad.
Svaret ovan visar bara de poster vars värde är större än noll.
Tämä lause laskee kaikki rivit ja näyttää niiden määrän.
Vastaus sisältää vain ne kaupungit joissa on useita hoitajia.
Bu ifade her şehirdeki bakıcıların sayısını gösterir.
Sonuç yalnızca değeri sıfırdan büyük olan kayıtları içerir.
Výraz spočítá všechny záznamy a zobrazí jejich počet podle města.
A kifejezés megszámolja az összes rekordot városonként.
Instrucțiunea numără toate înregistrările din fiecare oraș.
Pernyataan tersebut menghitung semua catatan di setiap kota.
Sætningen tæller alle poster og viser antallet for hver by.
Der Befehl zählt sämtliche Wärter je Stadt.
Cette instruction compte tous les gardiens par ville.
L'istruzione conta tutti i custodi per ogni città.
A instrução conta todos os tratadores por cidade.
Polecenie liczy wszystkich opiekunów w każdym mieście.
Η εντολή μετρά όλες τις εγγραφές ανά πόλη.
명령문은 도시별로 모든 기록을 셉니다.""",
    "truncated": """Sure, here is the statement you need:
Counting keepers by town takes a single grouped statement, which follows below.
One grouping over the town column will do, as shown here.
I think the cleanest statement for this reads as follows:
Happy to. The statement is
Keepers are stored once per record, therefore a plain count works:""",
}


def test_held_out():
    cases = [(line, kind) for kind, text in HELD_OUT.items() for line in text.split("\n")]
    found = {kind: [defect_of(line, ASKED, MESSAGE) == kind for line, k in cases if k == kind] for kind in HELD_OUT}
    assert all(sum(v) >= 0.9 * len(v) for v in found.values()), {k: sum(v) / len(v) for k, v in found.items()}
    beside = [defect_of(f"{line}\nSELECT count(*) FROM keeper", ASKED, MESSAGE) == "language" for line, k in cases if k == "language"]
    assert sum(beside) >= 0.9 * len(beside)


def test_statements_that_look_like_prose():
    prompt = "Select the names from the singers, please."
    assert defect_of("select the names from the singers please", prompt, None) == "copy" and defect_of("SELECT name FROM singer", prompt, None) is None
    assert defect_of("I cannot select anything from that table.", ASKED, MESSAGE) == "refusal"
    assert defect_of("INSERT INTO a VALUES (1)", ASKED, MESSAGE) is None and defect_of("DELETE FROM a WHERE", ASKED, MESSAGE) == "truncated"


def test_without_prompt():
    assert defect_of("Die Abfrage liefert alle Zeilen.", None, None) == "truncated" and defect_of("SELECT a FROM t", None, None) is None


def test_foreign_prompt():
    german = "Wie viele Einträge in keeper haben als town Flo und stammen von Gra?"
    assert defect_of("Die Abfrage liefert alle Zeilen aus keeper.\nSELECT a FROM t", german, None) is None
    assert defect_of("The query returns all the rows of the table.\nSELECT a FROM t", german, None) == "language"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=12), st.lists(st.sampled_from("abcd"), max_size=12))
def test_common_subsequence(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    assert common_subsequence(a, b) == table[-1][-1]


def test_parts_of_defects():
    words = "one two three four five six seven eight nine ten".split()
    assert is_copy(words, words) and is_copy(words * 2, words) and not is_copy(words[:5], words) and not is_copy(words + ["x"] * 9, words) and not is_copy([], words)
    assert not is_refusal("I can tell you that the table has no index") and language("le chat est sur la table")[0] == "fr"
    assert breaks_off("SELECT a FROM t WHERE NOT") and not breaks_off("SELECT a FROM t WHERE b = 'it''s'")


def test_broken_pairs(spark):
    r = spark.createDataFrame([(1, 10, "", "2024-01-01"), (1, 10, "", "2024-01-02"), (2, 10, "SELECT a FROM t", "2024-01-01"), (3, None, "SELECT", "2024-01-01"), (4, 99, None, None), (None, 10, "", None), (5, 10, "", "2024-01-01"), (5, 10, "SELECT a FROM t", "2024-01-03")], "rid bigint, iid bigint, response string, at string")
    from pyspark.sql import functions as F

    r = r.withColumn("at", F.col("at").cast("timestamp"))
    p = spark.createDataFrame([(10, ASKED, MESSAGE, "x"), (10, ASKED, MESSAGE, "x"), (None, "u", "m", "x")], "iid bigint, u string, m string, response string")
    got = broken_pairs(r, "rid", "iid", "response", "at", p, "iid", "u", "m").collect()
    assert sorted((x["response_id"], x["defect"]) for x in got) == [(1, "empty"), (3, "truncated"), (4, "empty")]
    assert broken_pairs(r.limit(0), "rid", "iid", "response", "at", p.limit(0), "iid", "u", "m").count() == 0


def test_safe_parts(monkeypatch):
    rng = random.Random(4)
    text = "".join(rng.choice(["ab", " ", "  ", "\n", "\n\n ", "é", "1", "'s", "。", " ", "🙂", "word"]) for _ in range(3000))
    whole = ENC.encode_ordinary(text)
    for most in (1, 7, 100):
        assert "".join(tokens.parts(text, most)) == text
        assert [i for p in tokens.parts(text, most) for i in ENC.encode_ordinary(p)] == whole
    monkeypatch.setattr(tokens, "LONG_TEXT", 50)
    assert list(tokens.encode(text, ENC)) == whole


@settings(max_examples=100, deadline=None)
@given(st.text())
def test_round_trip(text):
    text = text.encode("utf-8", "ignore").decode()
    assert tokens.decode(tokens.encode(text, ENC), ENC).decode() == text


def test_encode_corpus(spark):
    rows = [(1, None), (2, ""), (3, " "), (4, "<|endoftext|>"), (5, "a" * 70_000), (6, "word " * 20_000), (6, "word " * 20_000), (7, "é🙂​")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "d bigint, t string, ids string")
    got = sorted((r["doc_id"], list(r["ids"])) for r in tokens.encode_corpus(df, "d", "t", PATH).collect())
    assert got == sorted((i, ENC.encode_ordinary(t or "")) for i, t in rows)
    assert 50256 not in got[3][1]
    back = {r["doc_id"]: r["text"] for r in tokens.decode_corpus(tokens.encode_corpus(df, "d", "t", PATH), PATH).collect()}
    assert back == {i: t or "" for i, t in rows}
    assert tokens.encode_corpus(df.limit(0), "d", "t", PATH).count() == 0


def held(kinds):
    return [s for n, k in kinds for _ in range(n) for s, m in k.items() for _ in range(m)]


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 30).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), max_size=40))))
def test_pack_places_all(spec):
    capacity, sizes = spec
    counts = {s: sizes.count(s) for s in sizes}
    kinds, fixed = pack(counts, capacity)
    assert sorted(held(kinds)) == sorted(sizes) and all(sum(s * n for s, n in k.items()) <= capacity for _, k in kinds)
    assert fixed <= sum(n for n, _ in kinds)


def fewest(sizes, capacity):
    """The least number of containers, by trial."""
    best = [len(sizes)]

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(rooms)
            return
        for r in sorted(set(rooms)):
            if r >= sizes[i]:
                rest = list(rooms)
                rest.remove(r)
                go(i + 1, [*rest, r - sizes[i]])
        go(i + 1, [*rooms, capacity - sizes[i]])

    go(0, [])
    return best[0] if sizes else 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=9))
def test_reduction_keeps_the_optimum(sizes):
    """What the reduction fixes leaves a rest whose optimum, with it, is the optimum of the whole."""
    from scorelake.llm.packing import Sizes, reduce_by_dominance

    left = Sizes({s: sizes.count(s) for s in sizes})
    fixed = reduce_by_dominance(left, 20)
    rest = sorted((s for s, n in left.count.items() for _ in range(n)), reverse=True)
    assert sum(n for n, _ in fixed) + fewest(rest, 20) == fewest(sorted(sizes, reverse=True), 20)


def test_containers(spark):
    rows = [(1, None), (2, ""), (3, "one two three"), (4, "word " * 90), (5, "a b c d"), (5, "a b c d"), (6, "x " * 33)]
    df = spark.createDataFrame([(i, t, "y") for i, t in rows], "d bigint, t string, container string")
    got = fill_containers(df, "d", "t", PATH, 20).collect()
    used = {}
    for r in got:
        used[r["container"]] = used.get(r["container"], 0) + r["n_tokens"]
    assert all(used[r["container"]] + r["space_left"] == 20 for r in got)
    for d in (4, 6):
        own = sorted((r["first_token"], r["n_tokens"]) for r in got if r["doc_id"] == d)
        n = len(ENC.encode_ordinary(dict(rows)[d]))
        assert sum(k for _, k in own) == n and [f for f, _ in own] == list(range(0, n, 20))
    assert {r["n_tokens"] for r in got if r["doc_id"] in (1, 2)} == {0} and sum(r["doc_id"] == 5 for r in got) == 2
    nothing = fill_containers(df.where("d < 3"), "d", "t", PATH, 20).collect()
    assert [(r["container"], r["space_left"]) for r in nothing] == [(0, 20)] * 2
    assert fill_containers(df.limit(0), "d", "t", PATH, 20).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["word", " ", "\n", "\n\n", ". ", "éü", "🙂", "。", "aaaaaaaaaaaaaaaaaaaaaaaaaaaa", "1234"]), min_size=1, max_size=300))
def test_pieces(parts):
    text = "".join(parts)
    pieces = split_text(text, ENC, 24, 6)
    assert "".join(p[oc:] for p, _, _, oc, _ in pieces) == text
    assert all(n <= 24 and len(ENC.encode_ordinary(p)) == n for p, n, _, _, _ in pieces)
    if len(pieces) > 1:
        assert all(3 <= o <= 6 or i < 2 for i, (_, _, o, _, _) in enumerate(pieces) if i)


def test_pieces_cut_where_texts_end():
    paragraphs = "\n\n".join(" ".join(f"w{i} is here." for i in range(20)) for _ in range(8))
    cuts = [at for *_, at in split_text(paragraphs, ENC, 300, 20)]
    assert set(cuts[1:]) == {"paragraph"}
    line = " ".join(f"w{i} is here." for i in range(200))
    assert {at for *_, at in split_text(line, ENC, 100, 10)[1:]} == {"sentence"}
    assert {at for *_, at in split_text("x" * 4000, ENC, 100, 10)[1:]} == {"character"}


def test_split_corpus(spark):
    rows = [(1, None), (2, ""), (3, "short"), (4, "word " * 900), (4, "word " * 900), (5, "q" * 20_000)]
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "d bigint, t string, piece int")
    got = split_corpus(df, "d", "t", PATH, 512, 64).collect()
    assert {r["doc_id"] for r in got} == {4, 5} and max(r["n_tokens"] for r in got) <= 512
    assert sum(r["doc_id"] == 4 and r["piece_no"] == 1 for r in got) == 2
    with pytest.raises(ValueError):
        split_corpus(df, "d", "t", PATH, 64, 64)
