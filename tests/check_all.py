"""Run every registered query (or the named ones) against its SQL: python tests/check_all.py SF_DIR [names]."""

import sys
import time

sys.path.insert(0, "/root/repo")
sys.path.insert(0, "/root/repo/tests")

from oracle import connect, differences  # noqa: E402

import __spark_entry__ as E  # noqa: E402
from estatelake.session import local_session  # noqa: E402

if __name__ == "__main__":
    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark, con = local_session(8), connect(sf_dir)
    q, o = E.queries(), E.oracle_sql()
    good = 0
    for name in names or q:
        t = time.time()
        try:
            if name in o:
                diff = differences(spark, con, q[name], o[name], sf_dir)
            else:
                diff = [] if q[name](spark, sf_dir).collect() else ["no rows"]
        except Exception as e:  # noqa: BLE001
            diff = [f"{type(e).__name__}: {str(e)[:600]}"]
        good += not diff
        print(f"\n{'ok ' if not diff else 'BAD'} {name} {time.time() - t:.1f}s {'' if name in o else '(no sql)'}", *diff, sep="\n  ", flush=True)
    print(f"\n{good} of {len(names or q)} good", flush=True)
