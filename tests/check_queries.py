"""Compare registered queries with their SQL at one scale: check_queries.py [folder] [names...]."""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as contract  # noqa: E402
from floodspark.session import local_session  # noqa: E402
from tests.compare import compare, connect  # noqa: E402

if __name__ == "__main__":
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    queries, oracle = contract.queries(), contract.oracle_sql()
    names = sys.argv[2:] or list(queries)
    spark, con = local_session("8", memory="16g"), connect(sf_dir)
    bad = 0
    for name in names:
        start = time.time()
        try:
            df = queries[name](spark, sf_dir)
            if name in oracle:
                problems = compare(df, con, oracle[name])
                note = "ok" if not problems else "; ".join(problems)
            else:
                problems, note = [], f"rows only: {df.count()}"
        except Exception as error:  # noqa: BLE001
            problems = [repr(error)[:1500]]
            note = problems[0]
        bad += bool(problems)
        print(f"{name:26s} {time.time() - start:6.1f}s  {note}", flush=True)
    print(f"{len(names) - bad} of {len(names)} agree")
    sys.exit(bool(bad))
