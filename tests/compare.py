"""Run named queries on Spark and their checking SQL on DuckDB and compare every row.

Usage: python tests/compare.py SF_DIR [NAME ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    """Values of both engines in one form; floats must be equal to the last bit."""
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    if isinstance(value, decimal.Decimal):
        return plain(float(value))
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, dt.date):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
    "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP",
}


def compare(df, con, sql: str) -> str | None:
    """None if both results are equal, else what differs."""
    names = sorted(df.columns)
    described = {r[0]: r[1] for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    if sorted(described) != names:
        return f"columns: spark {names}, sql {sorted(described)}"
    types = {f.name: TYPES.get(f.dataType.simpleString()) for f in df.schema.fields}
    wrong = {n: (types[n], described[n]) for n in names if types[n] != described[n]}
    order = ", ".join(f'"{n}"' for n in names)
    left = sorted((tuple(plain(v) for v in r) for r in df.select(*names).collect()), key=repr)
    rows = con.execute(f"SELECT {order} FROM ({sql}) q").fetchall()
    right = sorted((tuple(plain(v) for v in r) for r in rows), key=repr)
    if len(left) != len(right):
        return f"rows: spark {len(left)}, sql {len(right)}; spark {left[:2]} sql {right[:2]}"
    for a, b in zip(left, right):
        if a != b:
            return f"values {names}: spark {a}, sql {b}"
    if wrong:
        return f"types: {wrong}"
    return None


def main() -> None:
    from tests.conftest import make_session
    from trendloom.plans.catalog import ORACLES, QUERIES

    sf_dir, names = sys.argv[1], sys.argv[2:] or list(QUERIES)
    spark, con = make_session(), connect(sf_dir)
    bad = 0
    for name in names:
        start = time.time()
        try:
            df = QUERIES[name](spark, sf_dir)
            if name in ORACLES:
                problem = compare(df, con, ORACLES[name])
                note = f"{df.count()} rows" if "-v" in sys.argv else ""
            else:
                problem, note = None, f"no SQL, {df.count()} rows"
        except Exception as error:
            problem, note = f"{type(error).__name__}: {str(error)[:900]}", ""
        bad += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - start:.1f}s {note} {(problem or '')[:1500]}", flush=True)
    print(f"{len(names) - bad} of {len(names)} agree")


if __name__ == "__main__":
    main()
