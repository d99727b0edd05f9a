"""python tests/run_check.py [-d sf_dir] [name part ...]: compare registered queries with their SQL."""

import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from compare import compare, connect  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from vetline.session import local_session  # noqa: E402


def main(argv):
    sf_dir = "/root/testdata/sf0.001"
    if argv[:1] == ["-d"]:
        sf_dir, argv = argv[1], argv[2:]
    queries, oracles = entry.queries(), entry.oracle_sql()
    names = [n for n in queries if not argv or any(a in n for a in argv)]
    spark = local_session()
    con = connect(sf_dir)
    failed = []
    for n in names:
        t = time.time()
        try:
            if n in oracles:
                msg, rows = compare(spark, con, sf_dir, queries[n], oracles[n])
            else:
                rows, msg = queries[n](spark, sf_dir).count(), ""
        except Exception as e:  # noqa: BLE001
            msg, rows = "".join(traceback.format_exception_only(e))[:1500], -1
        print(f"{'ok ' if not msg else 'BAD'} {n} rows={rows} {time.time() - t:.2f}s{'' if n in oracles else ' (no sql)'}"
              + (f"\n    {msg}" if msg else ""), flush=True)
        if msg:
            failed.append(n)
    print(f"{len(names) - len(failed)} of {len(names)} ok; failed: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
