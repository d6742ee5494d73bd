"""Compare registered queries with their oracles: ``python tests/oracle.py [data dir] [name ...]``."""

from __future__ import annotations

import math
import sys
import tempfile
import time
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
)


def connect(directory: str):
    import duckdb

    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{directory}/{table}.parquet')")
    return con


def _plain(value):
    if value is None:
        return None
    if isinstance(value, float) and math.isnan(value):
        return "nan"
    if isinstance(value, bool):
        return value
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, float):
        return round(value, 6) + 0.0
    return value


def difference(con, frame, sql: str) -> str | None:
    """What differs, or None. Types are compared as families."""
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    expected = cursor.fetchall()
    columns = sorted(frame.columns)
    if sorted(names) != columns:
        return f"columns {columns} != {sorted(names)}"
    order = [names.index(c) for c in columns]
    want = Counter(tuple(_plain(row[k]) for k in order) for row in expected)
    got = Counter(tuple(_plain(v) for v in row) for row in frame.select(*[f"`{c}`" for c in columns]).collect())
    if got == want:
        kinds = {}
        for row in list(want)[:50]:
            for c, v in zip(columns, row):
                if v is not None:
                    kinds.setdefault(c, type(v).__name__)
        for row in list(got)[:50]:
            for c, v in zip(columns, row):
                if v is not None and kinds.get(c, type(v).__name__) != type(v).__name__:
                    return f"type of {c}: {type(v).__name__} != {kinds[c]}"
        return None
    extra, missing = got - want, want - got
    return f"rows {sum(got.values())} != {sum(want.values())}; only spark {list(extra)[:3]}; only oracle {list(missing)[:3]}"


def main() -> None:
    from deskstream.session import build_session

    args = sys.argv[1:]
    directory = args[0] if args else "/root/testdata/sf0.01"
    spark = build_session(master="local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="8g", spark__checkpoint__dir=tempfile.mkdtemp(prefix="spark-oracle-"))
    spark.sparkContext.setLogLevel("ERROR")
    import __spark_entry__ as entry

    con = connect(directory)
    queries, oracles = entry.queries(), entry.oracle_sql()
    names = args[1:] or list(queries)
    bad = 0
    for name in names:
        start = time.time()
        try:
            frame = queries[name](spark, directory)
            if name in oracles:
                t1 = time.time()
                problem = difference(con, frame, oracles[name])
                state = "ok" if problem is None else f"DIFF {problem}"
            else:
                state = f"rows {frame.count()}"
                problem = None
        except Exception as error:  # noqa: BLE001
            problem = state = "ERROR " + " ".join(str(error).split())[:600]
        bad += problem is not None
        print(f"{time.time() - start:6.2f}s {name}: {state}", flush=True)
    print(f"{len(names) - bad} of {len(names)} fine")
    spark.stop()


if __name__ == "__main__":
    main()
