"""Problem 2: a sample with given shares of its categories, minimum rows, and a report of what could not be met."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.operators.ranks import distributed_rank, text_key
from scorelake.session import small, strip


def plain_category(c: Column) -> Column:
    """White space trimmed, lower case; null for blank."""
    return F.nullif(F.lower(strip(c)), F.lit(""))


def largest_remainder(total: int, weights: list[Fraction]) -> list[int]:
    """``total`` shared out in proportion to ``weights``: whole parts, then one each by largest remainder (ties: first)."""
    whole = sum(weights)
    if not whole or total <= 0:
        return [0] * len(weights)
    exact = [total * w / whole for w in weights]
    given = [int(x) for x in exact]
    order = sorted(range(len(weights)), key=lambda i: (given[i] - exact[i], i))
    for i in order[: total - sum(given)]:
        given[i] += 1
    return given


def allocate(size: int, shares: list[int], floors: list[int], available: list[int]) -> list[int]:
    """Whole quotas that add up to ``size`` where the floors and the availability allow.

    Every quota is at least min(floor, available) and at most available. What caps leave over goes to the other
    categories in proportion to their shares; what floors take beyond a share comes off the others in proportion.
    Floors that add up to more than ``size`` are kept: the sample is then larger.
    """
    low = [min(f, a) for f, a in zip(floors, available)]
    quota, fixed = [0] * len(shares), {}
    while True:
        free = [i for i in range(len(shares)) if i not in fixed]
        given = largest_remainder(size - sum(fixed.values()), [Fraction(shares[i]) for i in free])
        for i, q in zip(free, given):
            quota[i] = q
        under = {i: low[i] for i in free if quota[i] < low[i]}
        over = {i: available[i] for i in free if quota[i] > available[i]}
        if not under and not over:
            break
        lack, surplus = sum(v - quota[i] for i, v in under.items()), sum(quota[i] - v for i, v in over.items())
        fixed |= under if lack >= surplus else over  # the greater violation first; both end after len(shares) rounds
        for i, v in (under if lack >= surplus else over).items():
            quota[i] = v
    return quota


def plan_sample(pool: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per target: stratum, category, target_pct, min_rows, sample_size, available, wanted, quota, shortfall.

    pool has stratum, category and id; targets the columns of sample_target. wanted is the greater of min_rows and the share
    of sample_size, rounded up; shortfall is what the pool lacks of it. Null numbers in targets count as 0, rows with a null
    stratum or category are no target, of repeated ones the greatest numbers count. An empty pool gives quotas of 0.

    The pool is counted with map-side combine; only the targets, a specification of a few rows, come to the driver.
    """
    spark = pool.sparkSession
    counts = pool.groupBy("stratum", "category").agg(F.count("*").alias("available"))
    asked = targets.select("stratum", "category", "target_pct", "min_rows", "sample_size").where("stratum is not null and category is not null")
    asked = asked.groupBy("stratum", "category").agg(*[F.max(c).alias(c) for c in ("target_pct", "min_rows", "sample_size")])
    joined = asked.join(counts.withColumnsRenamed({"stratum": "_s", "category": "_c"}), (F.col("stratum") == F.col("_s")) & (plain_category(F.col("category")) == F.col("_c")), "left")
    rows = joined.select("stratum", "category", *[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in ("target_pct", "min_rows", "sample_size", "available")]).orderBy("stratum", "category").collect()
    out = []
    for stratum in sorted({r["stratum"] for r in rows}):
        own = [r for r in rows if r["stratum"] == stratum]
        quotas = allocate(max(r["sample_size"] for r in own), [r["target_pct"] for r in own], [r["min_rows"] for r in own], [r["available"] for r in own])
        for r, q in zip(own, quotas):
            wanted = max(r["min_rows"], -(-r["target_pct"] * r["sample_size"] // 100))
            out.append((stratum, r["category"], r["target_pct"], r["min_rows"], r["sample_size"], r["available"], wanted, q, max(0, wanted - r["available"])))
    return spark.createDataFrame(out, "stratum string, category string, target_pct bigint, min_rows bigint, sample_size bigint, available bigint, wanted bigint, quota bigint, shortfall bigint")


def draw_sample(pool: DataFrame, plan: DataFrame, seed: int = 0) -> DataFrame:
    """stratum, category, id: of each category its quota of records, those of smallest random key (ranks.text_key of the id).

    A category of any size is ranked in parts (distributed_rank); parts beyond the quota aren't shuffled. Records of equal
    key are ordered by id; repeated ids are records of their own. The plan, a row per target, is broadcast if small.
    """
    per = plan.groupBy(F.col("stratum").alias("_s"), plain_category(F.col("category")).alias("_c")).agg(F.max("quota").alias("quota"), F.max("available").alias("_a")).where("quota > 0")
    size = per.agg(F.count("*"), F.coalesce(F.sum("_a"), F.lit(0))).first()
    quotas = small(per.drop("_a"), size[0], 200)
    kept = pool.select("stratum", "category", "id").join(quotas, (F.col("stratum") == F.col("_s")) & (F.col("category") == F.col("_c"))).drop("_s", "_c")
    return distributed_rank(kept, ["stratum", "category"], text_key(F.col("id"), seed), ["id"], "rank", rows=size[1], limit="quota").select("stratum", "category", "id")
