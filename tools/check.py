"""Run every registered query and its SQL side by side and report differences.

    python tools/check.py [scale-factor directory] [query name ...]
"""

import os
import sys
import time
from pathlib import Path

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402
import pandas as pd  # noqa: E402

from queries import all_oracles, all_queries  # noqa: E402
from rulelens.session import build_session  # noqa: E402


def _kind(dtype):
    text = str(dtype).lower()
    for kind in ("int", "float", "bool", "datetime"):
        if kind in text:
            return kind
    return "text"


def _rows(pdf):
    pdf = pdf[sorted(pdf.columns)].astype(object).where(pdf.notna(), None)
    return sorted((tuple(r) for r in pdf.itertuples(index=False)), key=repr)


def compare(spark_pdf, duck_pdf):
    if sorted(spark_pdf.columns) != sorted(duck_pdf.columns):
        return f"columns {sorted(spark_pdf.columns)} != {sorted(duck_pdf.columns)}"
    if len(spark_pdf) != len(duck_pdf):
        return f"{len(spark_pdf)} rows != {len(duck_pdf)}"
    left, right = _rows(spark_pdf), _rows(duck_pdf)
    for a, b in zip(left, right):
        if [str(x) for x in a] != [str(x) for x in b]:
            return f"{a} != {b}"
    return None


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = sys.argv[2:]
    spark = build_session("check", "local[8]", 8)
    duck = duckdb.connect()
    for file in Path(sf).glob("*.parquet"):
        duck.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
    oracles, bad = all_oracles(), []
    for name, run in all_queries().items():
        if only and name not in only:
            continue
        began = time.time()
        try:
            result = run(spark, sf)
            got = result.toPandas()
        except Exception as error:
            bad.append(name)
            print(f"ERROR {name}: {str(error)[:600]}", flush=True)
            continue
        spent = time.time() - began
        if name not in oracles:
            print(f"rows  {name}: {len(got)} rows {spent:.1f}s", flush=True)
            continue
        try:
            began = time.time()
            cursor = duck.execute(oracles[name])
            types = {d[0]: str(d[1]) for d in cursor.description}
            fault = compare(got, cursor.fetchdf())
        except Exception as error:
            fault, types = f"SQL: {str(error)[:600]}", {}
        hints = {k: v for k, v in types.items() if v in ("HUGEINT",) or v.startswith("DECIMAL") or v == "INTEGER"}
        if fault:
            bad.append(name)
        print(f"{'FAIL ' if fault else 'ok   '} {name}: {len(got)} rows {spent:.1f}s sql {time.time() - began:.1f}s {fault or ''} {hints or ''}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
