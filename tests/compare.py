"""Runs the registered queries against their SQL twins. ``python tests/compare.py [names...] [--sf dir]``"""
import sys
import time

sys.path.insert(0, str(__import__("pathlib").Path(__file__).resolve().parents[1]))


def canon(value):
    import datetime
    import math
    from decimal import Decimal
    if value is None:
        return "~"
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, float):
        return "~" if math.isnan(value) else f"{value:.6f}"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, int):
        return f"{float(value):.6f}" if False else str(value)
    if isinstance(value, (datetime.datetime, datetime.date)):
        return str(value)
    return str(value)


def run(name, spark, con, sf_dir, queries, oracles):
    t = time.time()
    df = queries[name](spark, sf_dir)
    cols = df.columns
    rows = [tuple(r) for r in df.collect()]
    took = time.time() - t
    if name not in oracles:
        return True, f"{len(rows)} rows, no twin", took
    cur = con.execute(oracles[name])
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(cols) != sorted(names):
        return False, f"columns {sorted(cols)} vs {sorted(names)}", took
    a = sorted(tuple(canon(r[cols.index(c)]) for c in sorted(cols)) for r in rows)
    b = sorted(tuple(canon(r[names.index(c)]) for c in sorted(cols)) for r in want)
    if a != b:
        sa, sb = set(a), set(b)
        return False, f"{len(a)} vs {len(b)} rows; {sorted(cols)}; only spark {sorted(sa - sb)[:3]}; only sql {sorted(sb - sa)[:3]}", took
    return True, f"{len(a)} rows", took


def main():
    import duckdb
    import __spark_entry__ as e
    from decisionlake.sources.fixtures import TABLES
    from tests.conftest import make_session
    args = sys.argv[1:]
    sf = "/root/testdata/sf0.01"
    if "--sf" in args:
        i = args.index("--sf")
        sf = args[i + 1]
        del args[i:i + 2]
    queries, oracles = e.queries(), e.oracle_sql()
    spark = make_session()
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    bad = 0
    for name in (args or queries):
        try:
            ok, text, took = run(name, spark, con, sf, queries, oracles)
        except Exception as ex:
            ok, text, took = False, f"{type(ex).__name__}: {str(ex)[:700]}", 0
        bad += not ok
        print(f"{'ok ' if ok else 'BAD'} {name} {took:.1f}s {text}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
