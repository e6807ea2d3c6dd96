"""The rules of some headline queries as single-threaded Python loops over the same files: what bench.py is held against.

Prints one JSON line of seconds, reading included. BENCH_SF_DIR: data folder.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time
from collections import defaultdict

import pyarrow.parquet as pq

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def rows(sf_dir: str, table: str, *columns: str) -> list[tuple]:
    t = pq.read_table(f"{sf_dir}/{table}.parquet", columns=list(columns))
    return list(zip(*(t.column(c).to_pylist() for c in columns)))


def macro_average(d: str) -> float:
    scores: dict = {}
    for i, s, at in rows(d, "evaluation_result", "response_id", "score", "evaluated_at"):
        if i not in scores or at > scores[i][0]:
            scores[i] = (at, s)
    latest: dict = {}
    for i, inst, rep, w, at in rows(d, "model_response", "response_id", "instance_id", "replicate", "weight", "loaded_at"):
        if i not in latest or at > latest[i][0]:
            latest[i] = (at, inst, rep, w)
    ensembles: dict = defaultdict(float)
    for i, (_, inst, rep, w) in latest.items():
        ensembles[inst, rep] += (scores.get(i, (None, 0.0))[1] or 0.0) * (w or 0.0)
    means: dict = defaultdict(float)
    for (inst, _), v in ensembles.items():
        means[inst] += v / 3
    return sum(means.values()) / len(means)


def regex_fullmatch_score(d: str) -> list[int]:
    from scorelake.plans.evaluation_queries import PATTERNS

    compiled = [re.compile(p) for p in PATTERNS]
    names = rows(d, "part", "p_name")
    return [sum(p.fullmatch(n) is not None for (n,) in names) for p in compiled]


def agg_max_min_count_sum_avg(d: str) -> dict:
    out: dict = {}
    for f, s, q, p, x in rows(d, "lineitem", "l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice", "l_discount"):
        g = out.setdefault((f, s), [q, p, 0, 0.0, 0.0])
        g[0], g[1], g[2], g[3], g[4] = max(g[0], q), min(g[1], p), g[2] + 1, g[3] + q, g[4] + x
    return out


def gold_levels(d: str) -> list:
    from scorelake.functions.sql.grade import count_parts, hardness_of
    from scorelake.functions.sql.reader import SqlError, read_sql

    out = []
    for gold, tables in rows(d, "spider_instance", "gold", "tables"):
        try:
            out.append(hardness_of(count_parts(read_sql(gold, {t["name"].lower(): [c["name"].lower() for c in t["columns"]] for t in tables or ()}))))
        except (SqlError, AttributeError):
            out.append(None)
    return out


def p1_found(d: str) -> int:
    """All pairs of dev, by their sets of 3-grams."""
    sets = []
    for (q,) in rows(d, "dev", "question"):
        if q is not None:
            t = re.sub("[^a-z0-9]+", " ", q.lower()).strip(" ")
            sets.append({t[i : i + 3] for i in range(len(t) - 2)})
    found = 0
    for i, a in enumerate(sets):
        for b in sets[:i]:
            if min(len(a), len(b)) >= 0.65 * max(len(a), len(b)):
                common = len(a & b)
                found += common >= 0.65 * (len(a) + len(b) - common)
    return found


LOOPS = [macro_average, regex_fullmatch_score, agg_max_min_count_sum_avg, gold_levels, p1_found]

if __name__ == "__main__":
    folder, seconds = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), {}
    for loop in LOOPS:
        began = time.perf_counter()
        loop(folder)
        seconds[loop.__name__] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "seconds of single-threaded loops", "queries": seconds, "sf": os.path.basename(folder.rstrip("/"))}))
