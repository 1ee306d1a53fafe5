"""python tests/run_oracle.py [sf_dir] [name ...] - compare queries with the oracle."""

import sys
import time

sys.path.insert(0, ".")
from tests.oracle_harness import compare, duck  # noqa: E402
from tillroll.registry import ORACLE, QUERIES  # noqa: E402
from tillroll.session import local_session  # noqa: E402

sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
names = sys.argv[2:] or list(QUERIES)
spark = local_session()
con = duck(sf_dir)
bad = 0
for n in names:
    t = time.time()
    if n not in ORACLE:
        cnt = QUERIES[n](spark, sf_dir).count()
        print(f"{n:32s} rows={cnt:7d} (no oracle) {time.time()-t:.1f}s", flush=True)
        continue
    try:
        cnt, problems = compare(spark, con, n, QUERIES[n], ORACLE[n], sf_dir)
    except Exception as e:  # noqa: BLE001
        cnt, problems = -1, [f"error: {str(e)[:400]}"]
    status = "OK " if not problems else "BAD"
    bad += bool(problems)
    print(f"{status} {n:28s} rows={cnt:7d} {time.time()-t:.1f}s {'; '.join(problems)}", flush=True)
print("failures:", bad)
