"""What the graded subset, the verifier, execution match and the molecule critics decide, by hand from the rules."""

SCHEMA = {
    "stadium": ["stadium_id", "location", "name", "capacity", "highest", "lowest", "average"],
    "singer": ["singer_id", "name", "country", "song_name", "song_release_year", "age", "is_male"],
    "concert": ["concert_id", "concert_name", "theme", "stadium_id", "year"],
    "singer_in_concert": ["concert_id", "singer_id"],
}
KEYS = {
    "concert.stadium_id": "stadium.stadium_id",
    "stadium.stadium_id": "stadium.stadium_id",
    "singer_in_concert.singer_id": "singer.singer_id",
    "singer.singer_id": "singer.singer_id",
    "singer_in_concert.concert_id": "concert.concert_id",
    "concert.concert_id": "concert.concert_id",
}
#: id, query, clauses, nested, others, level, keywords: clauses as in Counts; None for what the subset doesn't hold.
GRADED = [
    (1, "SELECT count(*) FROM singer", 0, 0, 0, "easy", ""),
    (2, "SELECT name FROM singer WHERE age > 20 ORDER BY age DESC LIMIT 3", 3, 0, 0, "hard", "desc,limit,order,where"),
    (3, "SELECT country, count(*) FROM singer GROUP BY country", 1, 0, 1, "medium", "group"),
    (4, 'SELECT t1.name FROM singer AS t1 JOIN singer_in_concert AS t2 ON t1.singer_id = t2.singer_id WHERE t1.age > 20 AND t1.country = "France"', 2, 0, 1, "medium", "where"),
    (5, "SELECT name FROM singer WHERE age > (SELECT avg(age) FROM singer)", 1, 1, 0, "hard", "where"),
    (6, 'SELECT name FROM singer WHERE country = "France" UNION SELECT name FROM singer WHERE age > 40', 1, 1, 0, "hard", "union,where"),
    (7, "SELECT name, country FROM singer WHERE age > 20 UNION SELECT name, country FROM singer WHERE age < 10", 1, 1, 1, "extra", "union,where"),
    (8, "SELECT country FROM singer GROUP BY country HAVING count(*) > 1 ORDER BY count(*) DESC LIMIT 1", 3, 0, 0, "hard", "desc,group,having,limit,order"),
    (9, "SELECT country FROM singer GROUP BY country HAVING count(*) > 1 AND avg(age) > 20 ORDER BY count(*) DESC LIMIT 1", 3, 0, 1, "hard", "desc,group,having,limit,order"),
    (10, "SELECT name FROM stadium WHERE stadium_id NOT IN (SELECT stadium_id FROM concert)", 1, 1, 0, "hard", "in,not,where"),
    (11, 'SELECT name FROM singer WHERE name LIKE "%Joe%" OR age > 40', 3, 0, 1, "hard", "like,or,where"),
    (12, "SELECT name FROM singer WHERE age IS NOT NULL", None, None, None, None, None),
    (13, "SELECT name AS n FROM singer", None, None, None, None, None),
    (14, "SELECT t1.name FROM singer t1", None, None, None, None, None),
    (15, "SELECT name FROM singer UNION ALL SELECT name FROM stadium", None, None, None, None, None),
    (16, "SELECT name FROM singer WHERE name = \"Stark's\"", None, None, None, None, None),
    (17, "SELECT name FROM siner", None, None, None, None, None),
]


MASKED = [
    (1, 'SELECT DISTINCT t2.singer_id FROM singer AS t1 JOIN singer_in_concert AS t2 ON t1.singer_id = t2.singer_id WHERE t1.age > 20 AND t1.name = "A"'),
    (2, "SELECT name FROM singer WHERE age IN (SELECT age FROM singer WHERE age > 3)"),
    (3, "SELECT name FROM (SELECT name FROM singer WHERE age > 3)"),
]


#: pred, gold
COMPARED = [
    ("SELECT country, count(*) FROM singer GROUP BY country", "SELECT count(*), country FROM singer GROUP BY country"),
    ("SELECT name FROM singer WHERE age > 20 AND country = 'France'", "SELECT name FROM singer WHERE age > 30"),
    ("SELECT max(age) FROM singer ORDER BY age DESC LIMIT 1", "SELECT min(age) FROM singer ORDER BY age DESC LIMIT 5"),
]


#: id, pred, gold over nation and region
EXECUTED = [
    (1, "SELECT n_name, n_regionkey FROM nation", "SELECT n_regionkey, n_name FROM nation"),
    (2, "SELECT r_name FROM region ORDER BY r_regionkey DESC", "SELECT r_name FROM region ORDER BY r_regionkey"),
    (3, "SELECT count(*) FROM nation", "SELECT count(*) FROM nation"),
    (4, "SELECT count(r_regionkey) FROM region WHERE r_regionkey = 1", "SELECT max(r_regionkey) FROM region WHERE r_regionkey = 1"),
    (5, "SELECT nme FROM nation", "SELECT n_name FROM nation"),
    (6, "SELECT * FROM region", "SELECT r_regionkey, r_name FROM region"),
    (7, "SELECT count(*) FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_regionkey < 2)", "SELECT count(*) FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey < 2"),
    (8, "SELECT r_name FROM region LIMIT 3 OFFSET x", "SELECT r_name FROM region LIMIT 3"),
    (9, "SELECT n_nationkey FROM nation WHERE n_nationkey < 3 ORDER BY n_nationkey", "SELECT n_nationkey FROM nation WHERE n_nationkey <= 2 ORDER BY n_nationkey"),
    (10, "SELECT r_regionkey FROM region UNION SELECT n_regionkey FROM nation", "SELECT r_regionkey FROM region"),
]


_PREFIXES = [
    (1, "SELECT Name FROM", True), (2, "SELECT Name FROM singer WHERE", True), (3, "SELECT t1.Name FROM singer AS t1 WHERE", True), (4, "SELECT COUNT(*) FROM singer WHERE", True),
    (5, "SELECT singer.Name, concert.Theme FROM singer, concert WHERE", True), (6, "SELECT DISTINCT Name FROM singer WHERE", True), (7, "SELECT * FROM (SELECT Name FROM singer WHERE", True),
    (8, "SELECT Stadium_ID FROM singer WHERE", False), (9, "SELECT t1.concert_ID FROM stadium AS t1 WHERE", False), (10, "SELECT t2.Name FROM singer AS t1 WHERE", False),
]
_WHOLE = [
    (1, "SELECT Name FROM singer", True), (2, "SELECT COUNT(*) FROM singer", True), (3, "SELECT t5.Name FROM singer AS t5", True), (4, "SELECT singer.Name, concert.Theme FROM singer, concert", True),
    (5, "SELECT Name FROM singer WHERE Age > 25", True), (6, "SELECT Name FROM singer GROUP BY Country", True), (7, "SELECT Name FROM singer ORDER BY Age DESC", True),
    (8, "SELECT t1.Name, t2.concert_ID FROM singer t1 JOIN concert t2 ON t1.Name = t2.concert_name", True), (9, "SELECT * FROM (SELECT Name FROM singer) WHERE (SELECT COUNT(*) FROM concert)", True),
    (10, "SELECT NonExistentColumn FROM singer", False), (11, "SELECT Name FROM nonexistent_table", False), (12, "SELECT * FROM singer WHERE NonExistentColumn = 5", False),
    (13, "SELECT Name FROM singer GROUP BY NonExistentColumn", False), (14, "SELECT t1.Name, t2.concert_ID FROM singer t1 JOIN concert t2 ON t1.Name = t2.Name", False),
]


_SMILES = [
    (1, "", True, False), (2, "BrC1=C2C3C4C3N(CC4C#C)C2=NC(=O)", True, False), (3, "BrC1=C2C3C4C3N(CC4C#C)C2=NC(=O)S1", True, True), (4, "23r23", False, False), (5, "c1ccccc1", True, True), (6, "c1cccc1", True, False),
    (7, "C(C)(C)(C)(C)C", False, False), (8, "C1CC", True, False), (9, "CC(", True, False), (10, "[NH4+]", True, True), (11, "CC[", True, False), (12, "N#N", True, True), (13, " CCO", True, True), (14, "C)", False, False),
]


#: id, part, label_total, pred_total, matched, without_agg of COMPARED
COMPONENTS = [
            (0, "select", 2, 2, 2, 2), (0, "where", 0, 0, 0, 0), (0, "group", 1, 1, 1, None), (0, "having", 1, 1, 1, None), (0, "order", 0, 0, 0, None), (0, "and_or", 1, 1, 1, None), (0, "keywords", 1, 1, 1, None),
            (1, "select", 1, 1, 1, 1), (1, "where", 1, 2, 1, 1), (1, "group", 0, 0, 0, None), (1, "having", 0, 0, 0, None), (1, "order", 0, 0, 0, None), (1, "and_or", 1, 0, 0, None), (1, "keywords", 1, 1, 1, None),
            (2, "select", 1, 1, 0, 1), (2, "where", 0, 0, 0, 0), (2, "group", 0, 0, 0, None), (2, "having", 0, 0, 0, None), (2, "order", 1, 1, 1, None), (2, "and_or", 1, 1, 1, None), (2, "keywords", 3, 3, 3, None),
        ]

#: id, exec_match, level, gold_level of EXECUTED
MATCHES = [
            (1, True, "medium", "medium"), (2, False, "easy", "easy"), (3, True, "easy", "easy"), (4, True, "easy", "easy"), (5, False, None, None), (6, False, "easy", "medium"),
            (7, True, "hard", "medium"), (8, False, "easy", "easy"), (9, True, "medium", "medium"), (10, True, "hard", "easy"),
        ]
#: id, relaxed match
RELAXED = [(1, False), (2, False), (3, True), (4, True), (5, False), (6, True), (7, True), (8, False), (9, True), (10, True)]
