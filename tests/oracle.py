"""Compare registered queries with their SQL: ``python tests/oracle.py [--sf DIR] [name ...]``."""

from __future__ import annotations

import argparse
import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def database(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET threads TO 8")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _plain(v):
    if v is None:
        return None
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    if isinstance(v, int) and not isinstance(v, bool):
        return v
    return v


def normalized(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


def compare(df, con, sql: str) -> str:
    """Empty text when both sides agree, else what differs."""
    mine_cols, mine = normalized(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    their_cols, theirs = normalized([d[0] for d in cur.description], cur.fetchall())
    if mine_cols != their_cols:
        return f"columns {mine_cols} != {their_cols}"
    if len(mine) != len(theirs):
        return f"rows {len(mine)} != {len(theirs)}; {mine[:2]} {theirs[:2]}"
    bad = [(a, b) for a, b in zip(mine, theirs, strict=True) if a != b or [type(x) for x in a] != [type(x) for x in b]]
    return f"{len(bad)} of {len(mine)} rows differ, e.g. {bad[:2]}" if bad else ""


def main() -> None:
    from __spark_entry__ import oracle_sql, queries

    from rillflow.session import build_session

    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("--cores", default="8")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    spark = build_session("oracle", f"local[{args.cores}]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = database(args.sf)
    qs, sqls = queries(), oracle_sql()
    wanted = [q for q in qs if not args.names or any(q.startswith(n) for n in args.names)]
    failed = []
    for name in wanted:
        began = time.time()
        try:
            df = qs[name](spark, args.sf)
            if name in sqls:
                problem = compare(df, con, sqls[name])
            else:
                problem = "" if df.count() else "no rows"
        except Exception as exc:  # report and go on
            problem = f"{type(exc).__name__}: {str(exc)[:1500]}"
        print(f"{'ok  ' if not problem else 'FAIL'} {name} {time.time() - began:.1f}s {'' if name in sqls else '(rows only)'} {problem[:1800]}", flush=True)
        if problem:
            failed.append(name)
    print(f"{len(wanted) - len(failed)}/{len(wanted)} agree; failed: {failed}")


if __name__ == "__main__":
    main()
