"""Run registered queries next to their SQL and compare the rows. Also usable as a script."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _value(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v
    return v


def compare(spark_df, con, sql: str) -> str | None:
    """None when the two sides agree, else a short description of the difference."""
    got_cols = sorted(spark_df.columns)
    got = [tuple(_value(r[c]) for c in got_cols) for r in spark_df.collect()]
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != got_cols:
        return f"columns {got_cols} vs {sorted(names)}"
    at = [names.index(c) for c in got_cols]
    want = [tuple(_value(r[i]) for i in at) for r in cur.fetchall()]
    key = lambda r: tuple((x is None, str(type(x).__name__), x if x is not None else 0) for x in r)
    got.sort(key=key)
    want.sort(key=key)
    if got == want:
        kinds = lambda rows: [sorted({type(r[i]).__name__ for r in rows} - {"NoneType"}) for i in range(len(got_cols))]
        return None if kinds(got) == kinds(want) else f"types {kinds(got)} vs {kinds(want)}"
    missing = [r for r in want if r not in set(got)][:3]
    extra = [r for r in got if r not in set(want)][:3]
    return (f"rows {len(got)} vs {len(want)} columns {got_cols}\n   only sql: {missing}\n   only spark: {extra}")[:900]


def main() -> None:
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    sys.path.insert(0, root)
    import __spark_entry__ as entry
    from chatlake.session import local_session

    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    wanted = sys.argv[1:]
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    sqls = entry.oracle_sql()
    bad = 0
    for name, fn in entry.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        t = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in sqls:
                problem = compare(df, con, sqls[name])
                n = "-"
            else:
                n = df.count()
                problem = None
        except Exception as e:  # report and go on
            problem = f"{type(e).__name__}: {str(e)[:500]}"
            n = "-"
        bad += problem is not None
        print(f"{'ok ' if problem is None else 'BAD'} {name:32s} {time.time() - t:6.2f}s rows={n} {'' if name in sqls else '(no sql)'}")
        if problem:
            print("   ", problem)
        sys.stdout.flush()
    print("problems:", bad)


if __name__ == "__main__":
    main()
