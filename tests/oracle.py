"""Runs registered queries next to their SQL in DuckDB and compares names, rows and values."""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def show(v):
        if v is None:
            return "~"
        if isinstance(v, bool):
            return str(v)
        if isinstance(v, float):
            return repr(round(v, 6) + 0.0)
        if isinstance(v, (list, tuple)):
            return "[" + ",".join(show(x) for x in v) + "]"
        return str(v)

    return [columns[i] for i in order], sorted(tuple(show(r[i]) for i in order) for r in rows)


KIND = {
    "int": "INTEGER", "bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN",
    "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP",
}


def compare(spark, con, entry, sf_dir: str) -> dict:
    t = time.time()
    df = entry.run(spark, sf_dir)
    got = df.collect()
    spent = time.time() - t
    report = {"name": entry.name, "rows": len(got), "sec": round(spent, 2), "ok": None, "note": ""}
    if entry.sql is None:
        return report
    t = time.time()
    cur = con.execute(entry.sql)
    names = [d[0] for d in cur.description]
    types = dict(zip(names, (str(d[1]) for d in cur.description)))
    want = cur.fetchall()
    report["duck"] = round(time.time() - t, 2)
    a_cols, a = canonical(df.columns, [tuple(r) for r in got])
    b_cols, b = canonical(names, want)
    report["ok"] = a_cols == b_cols and a == b
    odd = [
        f"{c}:{k}/{types.get(c)}" for c, k in df.dtypes if KIND.get(k) is None or KIND[k] != types.get(c)
    ]
    report["types"] = odd
    if not report["ok"]:
        left, right = set(a), set(b)
        extra, lacking = sorted(left - right)[:2], sorted(right - left)[:2]
        report["note"] = f"cols {a_cols} {b_cols} n {len(a)} {len(b)} spark {extra} duck {lacking}"[:900]
    return report


if __name__ == "__main__":
    from codegrove.catalog import load_all
    from codegrove.session import get_session

    sf = os.environ.get("SF", "/root/testdata/sf0.01")
    wanted = sys.argv[1:]
    session = get_session(
        master="local[8]",
        extra={"spark.checkpoint.dir": os.environ.get("CHECKPOINT_DIR", os.path.join(os.getcwd(), "spark-warehouse", "staged")),
               "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "10g",
               "spark.ui.showConsoleProgress": "false", "spark.log.level": "OFF"},
    )
    entries = load_all()
    connection = duck(sf)
    failed = 0
    for name, entry in entries.items():
        if wanted and not any(w == name or (w.endswith("*") and name.startswith(w[:-1])) or w in entry.run.__module__ for w in wanted):
            continue
        try:
            r = compare(session, connection, entry, sf)
        except Exception as exc:
            r = {"name": name, "ok": False, "note": f"{type(exc).__name__}: {str(exc)[:700]}"}
        failed += r["ok"] is False
        mark = {True: "ok  ", False: "FAIL", None: "rows"}[r["ok"]]
        print(mark, name, r.get("rows"), r.get("sec"), r.get("duck"), " ".join(r.get("types") or []), r.get("note", ""), flush=True)
    print("failed:", failed)
