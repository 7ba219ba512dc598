"""Run registered queries on Spark and their SQL on DuckDB and compare.

    python tools/check_oracle.py [--sf DIR] [--only SUBSTRING ...]
"""

from __future__ import annotations

import argparse
import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

from gradeframe.session import build_session  # noqa: E402
import registry  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return "NULL" if math.isnan(value) else repr(round(value, 6) + 0.0)
    if value is None:
        return "NULL"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(plain(v) for v in value) + "]"
    if hasattr(value, "isoformat"):
        return value.isoformat()
    return str(value)


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("--only", nargs="*", default=[])
    args = parser.parse_args()
    registry.load_all()
    spark = build_session("check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{args.sf}/{name}.parquet'")
    bad = 0
    for name, fn in registry.QUERIES.items():
        if args.only and not any(o in name for o in args.only):
            continue
        start = time.time()
        try:
            df = fn(spark, args.sf)
            rows = df.collect()
            took = time.time() - start
            cols = sorted(df.columns)
            got = sorted([plain(r[c]) for c in cols] for r in rows)
            if name not in registry.ORACLE:
                print(f"rows  {name:45s} {len(rows):7d} rows {took:6.2f}s")
                continue
            start = time.time()
            cur = con.execute(registry.ORACLE[name])
            names = [d[0] for d in cur.description]
            types = {d[0]: str(d[1]) for d in cur.description}
            want_rows = cur.fetchall()
            sql_took = time.time() - start
            problem = None
            if sorted(names) != cols:
                problem = f"columns {cols} vs {sorted(names)}"
            else:
                pos = [names.index(c) for c in cols]
                want = sorted([plain(r[p]) for p in pos] for r in want_rows)
                if len(got) != len(want):
                    problem = f"{len(got)} rows vs {len(want)}"
                elif got != want:
                    diff = [(a, b) for a, b in zip(got, want) if a != b]
                    problem = f"{len(diff)} rows differ, cols {cols}: {str(diff[0])[:700]}"
            kinds = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
            odd = [f"{c}:{t}/{types.get(c)}" for c, t in df.dtypes if kinds.get(t, "") not in types.get(c, "").upper().replace("NUMBER", "")]
            flag = "ok   " if problem is None else "BAD  "
            bad += problem is not None
            print(f"{flag} {name:45s} {len(rows):7d} rows {took:6.2f}s sql {sql_took:5.2f}s {problem or ''} {('types ' + ' '.join(odd)) if odd else ''}", flush=True)
        except Exception as error:  # noqa: BLE001
            bad += 1
            print(f"ERROR {name:45s} {type(error).__name__}: {str(error)[:600]}", flush=True)
    print("problems:", bad)
    spark.stop()
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
