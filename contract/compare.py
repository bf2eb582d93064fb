"""Run cases in Spark and DuckDB and compare: ``python -m contract.compare <dir> [names]``."""

from __future__ import annotations

import math
import sys
import time
import traceback

from contract.base import TABLES


def duck(d: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{d}/{t}.parquet')")
    return con


def canonical(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return int(value)
    if isinstance(value, (list, tuple)) or type(value).__name__ == "ndarray":
        return tuple(canonical(v) for v in value)
    if isinstance(value, (int,)):
        return value
    try:
        number = float(value)
    except (TypeError, ValueError):
        return str(value)
    if isinstance(value, str):
        return value
    if math.isnan(number):
        return None
    return int(number) if number == int(number) and abs(number) < 2**53 else float(f"{number:.12g}")


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(canonical(r[i]) for i in order) for r in rows]
    return sorted(columns), sorted(out, key=repr)


def compare(spark, con, d: str, case) -> tuple[str, int]:
    """("ok" or what differs, rows)."""
    df = case.run(spark, d)
    start = time.time()
    columns, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if case.sql is None:
        return "no SQL", len(got)
    case.seconds = time.time() - start
    res = con.execute(case.sql)
    names = [c[0] for c in res.description]
    expected_columns, expected = rows_of(names, res.fetchall())
    if columns != expected_columns:
        return f"columns {columns} != {expected_columns}", len(got)
    if len(got) != len(expected):
        return f"rows {len(got)} != {len(expected)}", len(got)
    wrong = [(a, b) for a, b in zip(got, expected) if a != b]
    if wrong:
        return f"{len(wrong)} of {len(got)} rows differ, first {wrong[0]}", len(got)
    return ("ok" if got else "no rows"), len(got)


def main(argv: list[str]) -> int:
    from contract import CASES
    from regdata import build_session

    d, names = argv[0], argv[1:] or list(CASES)
    spark = build_session(master="local[8]", conf={"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g", "spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = duck(d), 0
    for name in names:
        start = time.time()
        try:
            result, n = compare(spark, con, d, CASES[name])
        except Exception as e:  # noqa: BLE001 - report and go on
            result, n = f"{type(e).__name__}: {str(e)[:900]}", 0
            if len(names) < 4:
                traceback.print_exc()
        bad += not result.startswith("ok")
        print(f"{name:28s} {getattr(CASES[name], 'seconds', 0):6.2f}s of {time.time() - start:6.2f}s {n:8d}  {result}", flush=True)
    print(f"{len(names) - bad} of {len(names)} agree")
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
