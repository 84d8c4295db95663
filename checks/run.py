"""Compare every check with its SQL: python -m checks.run [sf_dir] [name ...]"""

from __future__ import annotations

import math
import os
import sys
import time
from datetime import datetime
from decimal import Decimal

import duckdb

from checks.frames import Frames
from checks.queries import ORACLE, QUERIES
from sparkprep.session import build_session

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _value(v):
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    if isinstance(v, datetime):
        return v.replace(tzinfo=None)
    return v


def canonical(names: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(_value(r[i]) for i in order) for r in rows]
    return [names[i] for i in order], sorted(out, key=repr)


def compare(spark, con, sf_dir: str, name: str) -> str | None:
    """None when equal, else what differs."""
    df = QUERIES[name](Frames(spark, sf_dir))
    ours = canonical(df.columns, [tuple(r) for r in df.collect()])
    if name not in ORACLE:
        return None if ours[1] else "no rows"
    cur = con.execute(ORACLE[name])
    theirs = canonical([d[0] for d in cur.description], cur.fetchall())
    if ours[0] != theirs[0]:
        return f"columns {ours[0]} / {theirs[0]}"
    if len(ours[1]) != len(theirs[1]):
        return f"rows {len(ours[1])} / {len(theirs[1])}"
    if ours[1] != theirs[1]:
        a, b = next((x, y) for x, y in zip(*(ours[1], theirs[1])) if x != y)
        return f"values\n    {dict(zip(ours[0], a))}\n    {dict(zip(ours[0], b))}"
    return None if ours[1] else "equal but empty"


def main() -> None:
    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and os.path.isdir(args[0]) else "/root/testdata/sf0.01"
    names = [n for n in QUERIES if not args or any(n.startswith(a) for a in args)]
    spark = build_session("local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__driver__memory="12g", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(sf_dir), 0
    for name in names:
        started = time.monotonic()
        try:
            difference = compare(spark, con, sf_dir, name)
        except Exception as error:
            difference = f"{type(error).__name__}: {str(error)[:600]}"
        bad += difference is not None
        print(f"{'ok  ' if difference is None else 'FAIL'} {name} {time.monotonic() - started:.1f}s {difference or ''}", flush=True)
    print(f"{len(names) - bad} of {len(names)} equal")


if __name__ == "__main__":
    main()
