"""Compare every query with its oracle: ``python check.py [sf_dir] [name ...]``."""

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent / "tests"))

from oracle import connect, differences  # noqa: E402

from ledgermatch import workload  # noqa: E402
from ledgermatch.session import local_session  # noqa: E402

if __name__ == "__main__":
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(workload.QUERIES)
    spark, con = local_session(8), connect(sf_dir)
    bad = 0
    for name in names:
        start = time.time()
        try:
            df = workload.QUERIES[name](spark, sf_dir)
            sql = workload.ORACLE.get(name)
            message = differences(df, con, sql) if sql else f"(no oracle, {df.count()} rows)"
            count = df.count() if len(names) < 100 and not message else ""
        except Exception as error:  # report and go on with the next query
            message, count = f"{type(error).__name__}: {str(error)[:700]}", ""
        bad += bool(message) and not message.startswith("(")
        print(f"{time.time() - start:6.2f}s {name}: {message or 'ok'} {count}", flush=True)
    print("failures:", bad)
