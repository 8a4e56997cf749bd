"""Run registered queries against their SQL in DuckDB.  CLI: compare.py SF [name-part ...]"""

from __future__ import annotations

import sys
import time
from collections import Counter
from decimal import Decimal

import duckdb

sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])

from depthlake.plans.proxies import NAMES  # noqa: E402


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in NAMES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def norm(v):
    if isinstance(v, bool) or v is None or isinstance(v, (str, bytes)):
        return v
    if isinstance(v, (float, Decimal)):
        if isinstance(v, float) and v != v:
            return "nan"
        return float(f"{float(v):.9g}")
    if isinstance(v, (list, tuple)) and not hasattr(v, "asDict"):
        return tuple(norm(x) for x in v)
    if hasattr(v, "asDict"):
        return tuple((k, norm(x)) for k, x in sorted(v.asDict().items()))
    if isinstance(v, dict):
        return tuple((k, norm(x)) for k, x in sorted(v.items()))
    return v


def rows_of(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(norm(r[i]) for i in order) for r in data)


KINDS = {"tinyint": "int", "smallint": "int", "integer": "int", "bigint": "int", "hugeint": "int", "int": "int", "long": "int",
         "double": "float", "float": "float", "varchar": "str", "string": "str", "boolean": "bool"}


def check(spark, con, name, run, sql, sf_dir):
    start = time.time()
    df = run(spark, sf_dir)
    got_cols, got = rows_of(df.columns, df.collect())
    took = time.time() - start
    if sql is None:
        return f"rows-only {sum(got.values())}", took, True
    res = con.execute(sql)
    types = {d[0]: str(d[1]).lower() for d in res.description}
    want_cols, want = rows_of([d[0] for d in res.description], res.fetchall())
    if got_cols != want_cols:
        return f"COLUMNS {got_cols} != {want_cols}", took, False
    note = ""
    for field in df.schema:
        a, b = KINDS.get(field.dataType.simpleString()), KINDS.get(types[field.name])
        if a and b and a != b or types[field.name] == "hugeint":
            note += f" type({field.name}: {field.dataType.simpleString()} vs {types[field.name]})"
    if got != want:
        only_got, only_want = got - want, want - got
        return (f"DIFF rows {sum(got.values())} vs {sum(want.values())}; cols {got_cols}\n   spark-only {list(only_got)[:3]}"
                f"\n   sql-only   {list(only_want)[:3]}"), took, False
    return f"ok {sum(got.values())}{note}", took, not note and sum(got.values()) > 0


def main(argv):
    from __spark_entry__ import oracle_sql, queries
    from depthlake.session import local_session

    sf_dir = f"/root/testdata/sf{argv[0]}"
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    q, o = queries(), oracle_sql()
    bad = []
    for name in q:
        if len(argv) > 1 and not any(part in name for part in argv[1:]):
            continue
        try:
            text, took, ok = check(spark, con, name, q[name], o.get(name), sf_dir)
        except Exception as error:  # noqa: BLE001
            text, took, ok = f"ERROR {str(error)[:900]}", 0.0, False
        if not ok:
            bad.append(name)
        print(f"{'  ' if ok else '!!'} {name:40s} {took:6.2f}s {text}", flush=True)
    print(f"{len(bad)} not ok: {bad}")


if __name__ == "__main__":
    main(sys.argv[1:])
