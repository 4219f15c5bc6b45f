"""Run registered queries against their SQL: python tests/check_queries.py [prefix ...]"""

from __future__ import annotations

import os
import sys
import time
from pathlib import Path

sys.path[:0] = [str(Path(__file__).resolve().parents[1]), str(Path(__file__).resolve().parent)]

from oracle import compare, connect  # noqa: E402
from plumbline.plans import queries as Q  # noqa: E402
from plumbline.session import build_session  # noqa: E402


def main() -> None:
    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = build_session("check", "local[8]", spark__sql__shuffle__partitions="8",
                          spark__ui__enabled="false", spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("OFF")
    con = connect(sf)
    Q.load()
    bad = 0
    for name, fn in Q.QUERIES.items():
        if sys.argv[1:] and not any(name.startswith(p) for p in sys.argv[1:]):
            continue
        t = time.time()
        try:
            df = fn(spark, sf)
            if name in Q.SQL:
                why = compare(df, con, Q.SQL[name])
            else:
                n = len(df.collect())
                why = None if n else "no rows"
        except Exception as exc:  # noqa: BLE001
            why = type(exc).__name__ + ": " + str(exc)[:700]
        took = time.time() - t
        if why:
            bad += 1
        print(f"{'FAIL' if why else 'ok  '} {took:5.1f}s {name}{' (rows only)' if name not in Q.SQL else ''} {why or ''}", flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main()
