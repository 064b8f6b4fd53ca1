"""Compare registered queries with their SQL: python -m tests.oracle [sf dir] [names...]"""

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402
from faqloom.session import local_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
SAME = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "float": "FLOAT"}


#: What no registered query may run: products of tables, and Python on single rows.
FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython")
#: Findings: the smallest tables may hold none.
MAY_BE_EMPTY = ("op3_secrets",)
SPENT = {}


def database(root):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{root}/{t}.parquet'")
    return db


def compare(spark, db, root, name, fn, sql):
    """Empty string when equal, else what differs."""
    t = time.time()
    df = fn(spark, root)
    columns = sorted(df.columns)
    plan = df._jdf.queryExecution().toString()
    if bad := [x for x in FORBIDDEN if x in plan]:
        return f"the plan holds {bad}"
    got = df.select(columns).toArrow()
    SPENT[name] = time.time() - t
    if sql is None:
        return "" if got.num_rows or name in MAY_BE_EMPTY else "no rows"
    rel = db.sql(sql)
    types = dict(zip(rel.columns, map(str, rel.types)))
    if sorted(rel.columns) != columns:
        return f"columns {columns} against {sorted(rel.columns)}"
    odd = {c: (t, types[c]) for c, t in df.dtypes if SAME.get(t, t) != types[c]}
    db.register("_got", got)
    db.execute("CREATE OR REPLACE TEMP TABLE _want AS SELECT " + ", ".join(f'"{c}"' for c in columns) + f" FROM ({sql})")
    db.execute("CREATE OR REPLACE TEMP TABLE _have AS SELECT * FROM _got")
    n_want, n_have = (db.sql(f"SELECT count(*) FROM {t}").fetchall()[0][0] for t in ("_want", "_have"))
    missing = db.sql("SELECT * FROM _want EXCEPT ALL SELECT * FROM _have LIMIT 3").fetchall()
    extra = db.sql("SELECT * FROM _have EXCEPT ALL SELECT * FROM _want LIMIT 3").fetchall()
    db.unregister("_got")
    if missing or extra or n_want != n_have or odd or not n_have:
        return f"rows {n_have} against {n_want}; types {odd}; missing {str(missing)[:600]}; extra {str(extra)[:600]}"
    return ""


def main(argv):
    root = argv[0] if argv else "/root/testdata/sf0.01"
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    db = database(root)
    queries, oracle = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in argv[1:] or queries:
        t = time.time()
        try:
            note = compare(spark, db, root, name, queries[name], oracle.get(name))
        except Exception as e:  # noqa: BLE001
            text = str(e)
            at = max(text.find("Caused by"), 0)
            note = f"{type(e).__name__}: {text[at : at + 700]}"
        bad += bool(note)
        weak = "" if name in oracle else "(rows only)"
        print(f"{'BAD ' if note else 'ok  '} {name:24s} {SPENT.get(name, 0):6.1f}s of {time.time() - t:6.1f}s {weak}{note}", flush=True)
    print("failed:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
