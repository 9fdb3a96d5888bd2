"""Compare registered queries with their SQL twins: python tests/check_catalog.py [sf_dir] [name ...]."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

from umbraline.catalog import registry  # noqa: E402


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else (0.0 if value == 0 else value)
    if hasattr(value, "isoformat"):
        return value.isoformat()
    return value


def _rows(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(_plain(row[i]) for i in order) for row in rows]
    return sorted(out, key=lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) if not isinstance(v, (list, dict)) else (False, "", str(v)) for v in r))


def compare(spark, folder: str, name: str) -> dict:
    start = time.time()
    frame = registry.QUERIES[name](spark, folder)
    got = frame.collect()
    spark_s = time.time() - start
    report = {"name": name, "rows": len(got), "spark_s": round(spark_s, 1), "columns": frame.columns}
    if name not in registry.ORACLE:
        report["status"] = "rows-only"
        return report
    start = time.time()
    con = duckdb.connect()
    con.execute("SET memory_limit = '8GB'")
    for table in registry.TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    cursor = con.execute(registry.ORACLE[name])
    names = [d[0] for d in cursor.description]
    types = {d[0]: str(d[1]) for d in cursor.description}
    want = cursor.fetchall()
    report["duck_s"] = round(time.time() - start, 1)
    if sorted(names) != sorted(frame.columns):
        report["status"] = f"COLUMNS {sorted(frame.columns)} != {sorted(names)}"
        return report
    a, b = _rows([tuple(r) for r in got], frame.columns), _rows(want, names)
    report["types"] = {n: (t, types[n]) for n, t in frame.dtypes}
    if a == b:
        report["status"] = "ok"
    else:
        bad = [(x, y) for x, y in zip(a, b) if x != y]
        report["status"] = f"DIFF rows {len(a)}/{len(b)} bad {len(bad)} first {bad[:3]} cols {sorted(names)}"
    return report


KIND = {"bigint": {"BIGINT"}, "int": {"INTEGER"}, "double": {"DOUBLE"}, "string": {"VARCHAR"}, "boolean": {"BOOLEAN"}}


def type_gaps(report: dict) -> list:
    return [(n, s, d) for n, (s, d) in report.get("types", {}).items() if d not in KIND.get(s, {d})]


if __name__ == "__main__":
    import umbraline.catalog as catalog
    from umbraline.session import build_session

    args = sys.argv[1:]
    folder = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g"})
    wanted = [n for n in catalog.QUERIES if not args or any(n == a or (a.endswith("*") and n.startswith(a[:-1])) for a in args)]
    failed = 0
    for name in wanted:
        try:
            report = compare(spark, folder, name)
        except Exception as error:  # noqa: BLE001
            report = {"name": name, "status": f"ERROR {str(error)[:1500]}"}
        good = report["status"] in ("ok", "rows-only")
        failed += not good
        print(f"{'PASS' if good else 'FAIL'} {name} rows={report.get('rows')} spark={report.get('spark_s')}s duck={report.get('duck_s')}s {'' if good else report['status']} {type_gaps(report) or ''}", flush=True)
    print(f"{len(wanted) - failed}/{len(wanted)} ok")
