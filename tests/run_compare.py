"""Command line: compare all or some registered queries on one test folder."""

import os
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

import compare  # noqa: E402

import __spark_entry__  # noqa: E402
from shelfline.session import local_session  # noqa: E402


def main(folder: str, names: list[str]) -> int:
    queries, oracles = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    spark = local_session(8)
    con = compare.connect(folder)
    bad = 0
    for name in names or queries:
        try:
            ok, n, took, note = compare.check(
                spark, folder, name, queries[name], oracles.get(name), con
            )
        except Exception as e:  # noqa: BLE001
            ok, n, took, note = False, -1, 0.0, f"{type(e).__name__}: {str(e)[:1500]}"
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:42s} {n:8d} rows {took:6.2f}s {note}", flush=True)
    print(f"{bad} of {len(names or queries)} differ")
    return bad


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1], sys.argv[2:]))
