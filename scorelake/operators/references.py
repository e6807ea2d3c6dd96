"""References to records that do not exist: orphans by Bloom filter, exact check of the rest, counts per period."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.session import small, strip

#: One block of the filter: 4 words of 64 bits, of which a key sets one bit each.
WORDS = 4
#: Keys that a block takes on average (256 bits / 24 keys: some 2 % of absent keys pass).
KEYS_PER_BLOCK = 24
BLOCK_BYTES = 8 * (WORDS + 2)


_WHOLE = {"tinyint", "smallint", "int", "bigint"}


def key_of(df: DataFrame, name: str) -> Column:
    """A reference read as a whole number: null for null and blank, for words, fractions and numbers beyond 64 bits.

    is_reference() tells blank (no reference) from what names nobody. Columns of whole numbers are taken as they are.
    """
    if dict(df.dtypes)[name] in _WHOLE:
        return F.col(name).cast("bigint")
    text = strip(F.col(name).cast("string"))
    plain = text.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]{1,3})?$")
    number = text.try_cast("decimal(38,8)")
    return F.when(text.rlike("^[0-9]{1,18}$"), text.cast("bigint")).when(plain & (number == F.floor(number)), number.try_cast("bigint"))


def is_reference(df: DataFrame, name: str) -> Column:
    """True where the column holds something: null and blank are no reference."""
    c = F.col(name)
    return c.isNotNull() if dict(df.dtypes)[name] in _WHOLE else c.isNotNull() & (strip(c.cast("string")) != "")


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _mask(key: Column, word: int) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(F.xxhash64(F.lit(word), key), F.lit(64)).cast("int"))


def bloom_filter(keys: DataFrame, blocks: int) -> DataFrame:
    """A blocked Bloom filter of the column ``key`` as a table: one row per block, its bits in w0..w3.

    Built by bit_or with map-side combine, so a hot key costs no more than a rare one.
    """
    bits = [F.bit_or(_mask(F.col("key"), i)).alias(f"w{i}") for i in range(WORDS)]
    return keys.groupBy(_block(F.col("key"), blocks).alias("block")).agg(*bits)


def orphan_references(
    child: DataFrame, child_id: str, reference: str, child_time: str, parent: DataFrame, parent_key: str, parent_time: str, parent_end: str, field: str
) -> DataFrame:
    """The references of ``child`` that no living row of ``parent`` answers.

    A reference is sound if the parent has a row with that key whose ``parent_time`` is not after ``child_time`` and
    whose ``parent_end`` is null or after it. Otherwise it comes out as ``missing`` (no row has the key), ``late`` (all
    rows with the key came after the child) or ``deleted``.

    Returns ref_field, child_id, reason, period (month of child_time, null if that is null).

    Text is trimmed and read as a number, keys are whole numbers; other text and numbers name nobody (``missing``). Null and blank references are no case.
    A parent row with a null key or null time answers nothing, though its key counts as known; a child with a null time
    can't be shown sound: its case is ``missing`` or ``deleted``. Repeated child rows each give a row. Empty tables give none
    (empty parent: every reference is missing). Only the named columns are read, so others may clash.

    Definite orphans are told by a Bloom filter of the parent keys, broadcast if its size allows; only references that pass
    it are joined with the parent, by an anti join that splits hot keys (adaptive skew join).
    """
    refs = child.select(
        F.col(child_id).cast("bigint").alias("child_id"),
        key_of(child, reference).alias("key"),
        F.col(child_time).alias("at"),
        is_reference(child, reference).alias("is_ref"),
    ).where("is_ref")
    parents = parent.select(key_of(parent, parent_key).alias("key"), F.col(parent_time).alias("born"), F.col(parent_end).alias("ended")).where("key is not null")

    keys = parents.select("key").distinct()
    count = parents.select(F.approx_count_distinct("key", 0.02)).first()[0]
    blocks = max(1, -(-count // KEYS_PER_BLOCK))
    sieve = small(bloom_filter(keys, blocks), blocks, BLOCK_BYTES)

    marked = refs.withColumn("block", _block(F.col("key"), blocks)).join(sieve, "block", "left")
    maybe = F.col("w0").isNotNull() & F.col("key").isNotNull()
    for i in range(WORDS):
        maybe = maybe & (F.col(f"w{i}").bitwiseAND(_mask(F.col("key"), i)) != 0)
    marked = marked.withColumn("maybe", F.coalesce(maybe, F.lit(False))).select("child_id", "key", "at", "maybe")

    absent = marked.where("not maybe").select("child_id", "at", F.lit("missing").alias("reason"))
    asked, known = marked.where("maybe").alias("c"), parents.alias("p")
    sound = (F.col("c.key") == F.col("p.key")) & (F.col("p.born") <= F.col("c.at")) & (F.col("p.ended").isNull() | (F.col("p.ended") > F.col("c.at")))
    unsound = asked.join(known, sound, "left_anti")
    first = parents.groupBy("key").agg(F.min("born").alias("first"), F.count("*").alias("n"))
    judged = unsound.join(first, "key", "left").select(
        "child_id",
        "at",
        F.when(F.col("n").isNull(), "missing").when(F.col("first") > F.col("at"), "late").otherwise("deleted").alias("reason"),
    )
    return absent.unionByName(judged).select(
        F.lit(field).alias("ref_field"), "child_id", "reason", F.date_trunc("month", F.col("at")).alias("period")
    )


def orphan_report(cases: DataFrame, tables: dict[str, str]) -> DataFrame:
    """Counts of cases per table, field, reason and month; ``tables`` maps a field to the table it stands in."""
    of = F.create_map(*[F.lit(x) for pair in tables.items() for x in pair])
    return (
        cases.groupBy(of[F.col("ref_field")].alias("table_name"), "ref_field", "period", "reason")
        .agg(F.count("*").alias("n_orphans"))
    )
