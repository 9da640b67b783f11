"""Run queries against their oracle SQL: ``python tests/oracle.py [sf_dir] [name ...]``."""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return "-0.0" if value == 0 and math.copysign(1.0, value) < 0 else value  # a value hash tells the zeros apart
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    return value


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((v is None, str(type(v)) if isinstance(v, bool) else "", str(v)) for v in r))


def compare(spark, con, name: str, query, sql: str | None, sf_dir: str) -> str:
    df = query(spark, sf_dir)
    columns = sorted(df.columns)
    got = [tuple(plain(v) for v in r) for r in df.select(*[f"`{c}`" for c in columns]).collect()]
    if sql is None:
        return f"rows-only {len(got)}"
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    if sorted(names) != columns:
        return f"MISMATCH columns {columns} vs {sorted(names)}"
    order = [names.index(c) for c in columns]
    types = {c: str(cursor.description[i][1]) for c, i in zip(columns, order)}
    want = [tuple(plain(r[i]) for i in order) for r in cursor.fetchall()]
    if len(got) != len(want):
        return f"MISMATCH rows {len(got)} vs {len(want)}"
    if not got:
        return "MISMATCH empty"
    a, b = ordered(got), ordered(want)
    if a == b:
        kinds = {c: f.dataType.simpleString() for c, f in zip(columns, [df.schema[c] for c in columns])}
        expected = {"bigint": ("BIGINT",), "double": ("DOUBLE",), "string": ("VARCHAR",), "boolean": ("BOOLEAN",)}
        odd = [f"{c}:{kinds[c]}/{types[c]}" for c in columns if not any(e in types[c] for e in expected.get(kinds[c], (types[c],)))]
        return f"ok {len(got)}" + (f" types {odd}" if odd else "")
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return f"MISMATCH values {len(bad)}/{len(a)} {columns}\n    spark  {bad[0][0]}\n    oracle {bad[0][1]}"


def main(argv):
    from framelane.bindings import ORACLES, QUERIES
    from framelane.session import local_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:] or list(QUERIES)
    spark, con = local_session(8), connect(sf_dir)
    failed = []
    for name in names:
        start = time.time()
        try:
            text = compare(spark, con, name, QUERIES[name], ORACLES.get(name), sf_dir)
        except Exception as error:  # noqa: BLE001
            text = "ERROR " + " ".join(str(error).split())[:500]
        if text.startswith(("MISMATCH", "ERROR")):
            failed.append(name)
        print(f"{time.time() - start:6.2f}s {name}: {text}", flush=True)
    print(f"{len(names) - len(failed)}/{len(names)} good; failed: {failed}")


if __name__ == "__main__":
    main(sys.argv[1:])
