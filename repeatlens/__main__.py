"""``python -m repeatlens [--sf=DIR] [--explain] [names...]``.

Default: Spark vs DuckDB parity for the named queries (all when none).
``--explain`` prints each query's formatted physical plan instead.
"""

from __future__ import annotations

import sys
import time


def main(argv: list[str]) -> int:
    from repeatlens import catalog, oracle
    from repeatlens.parity import compare, duckdb_connection
    from repeatlens.session import local_session

    sf_dir = "/root/testdata/sf0.01"
    names = [a for a in argv if not a.startswith("--")]
    for a in argv:
        if a.startswith("--sf="):
            sf_dir = a.split("=", 1)[1]
    spark = local_session()
    if "--explain" in argv:
        qs = catalog.queries()
        for name in names or list(qs):
            print(f"===== {name}")
            qs[name](spark, sf_dir).explain("formatted")
        return 0
    con = duckdb_connection(sf_dir)
    qs, sqls = catalog.queries(), oracle.build()
    bad = 0
    for name in names or list(qs):
        t0 = time.time()
        pdf = qs[name](spark, sf_dir).toPandas()
        t1 = time.time()
        if name in sqls:
            ok, msg = compare(pdf, con.execute(sqls[name]).df())
        else:
            ok, msg = True, "rows-only"
        bad += not ok
        print(f"{'PASS' if ok else 'FAIL'} {name:32s} rows={len(pdf):6d} {t1 - t0:6.2f}s {msg}", flush=True)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
