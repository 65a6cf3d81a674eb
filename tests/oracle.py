"""Run registered queries against their SQL in DuckDB and compare rows.

    python tests/oracle.py <sf_dir> [name ...]
"""

from __future__ import annotations

import math
import sys
import time
import traceback
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def _value(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_value(r[i]) for i in order) for r in rows), key=repr)


TIMES: dict[str, tuple[float, float]] = {}
KINDS = {"bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN",
         "timestamp_ntz": "TIMESTAMP", "date": "DATE"}


def compare(spark, con, name: str, fn, sql: str, sf: str) -> str | None:
    """None when equal, else what differs."""
    t0 = time.time()
    df = fn(spark, sf)
    got = df.collect()
    t1 = time.time()
    rel = con.sql(sql)
    want = rel.fetchall()
    TIMES[name] = (t1 - t0, time.time() - t1)
    if sorted(df.columns) != sorted(rel.columns):
        return f"columns {sorted(df.columns)} != {sorted(rel.columns)}"
    types = {c: str(t) for c, t in zip(rel.columns, rel.types)}
    for c, t in df.dtypes:
        if KINDS.get(t) != types[c] and types[c] != '"NULL"':
            return f"type of {c}: {t} != {types[c]}"
    a, b = _rows(df.columns, got), _rows(rel.columns, want)
    if a == b:
        return None if a else "both sides empty"
    sa, sb = set(map(repr, a)), set(map(repr, b))
    return (f"{len(a)} rows against {len(b)}\n  only here: {[x[:400] for x in sorted(sa - sb)[:2]]}"
            f"\n  only sql:  {[x[:400] for x in sorted(sb - sa)[:2]]}")


def main() -> int:
    from marginalia.plans import ORACLES, QUERIES
    from marginalia.session import local_session
    sf, names = sys.argv[1], sys.argv[2:] or list(QUERIES)
    spark = local_session(cores="8")
    con = connect(sf)
    bad = 0
    for name in names:
        t = time.time()
        try:
            if name in ORACLES:
                err = compare(spark, con, name, QUERIES[name], ORACLES[name], sf)
            else:
                n = len(QUERIES[name](spark, sf).collect())
                err = None if n else "no rows"
                name += f" (rows only: {n})"
        except Exception as e:
            err = "".join(traceback.format_exception_only(e))[:1500]
        bad += err is not None
        a, b = TIMES.get(name, (time.time() - t, 0.0))
        print(f"{'ok  ' if err is None else 'FAIL'} {name} {a:.1f}s (sql {b:.1f}s)" + (f"\n  {err}" if err else ""), flush=True)
    print(f"{len(names) - bad} of {len(names)} agree")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
