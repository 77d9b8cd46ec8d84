"""Developer tool: python tests/check.py [name prefix ...] — timings and oracle differences."""

import os
import sys
import time

sys.path[:0] = [os.path.dirname(os.path.dirname(os.path.abspath(__file__))), os.path.dirname(os.path.abspath(__file__))]

from compare import SF, connect, diff  # noqa: E402

from flowlantern.plans.registry import ORACLES, QUERIES  # noqa: E402
from flowlantern.session import build_session  # noqa: E402

spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                                            "spark.driver.memory": "8g", "spark.log.level": "ERROR", "spark.ui.showConsoleProgress": "false"})
con = connect()
bad = []
for name, fn in QUERIES.items():
    if len(sys.argv) > 1 and not any(name.startswith(a) for a in sys.argv[1:]):
        continue
    t = time.time()
    try:
        if name in ORACLES:
            n, err = diff(fn(spark, SF), ORACLES[name], con)
        else:
            n, err = fn(spark, SF).count(), None
    except Exception as e:
        n, err = -1, f"{type(e).__name__}: {str(e)[:int(os.environ.get("ERR", 600))]}"
    print(f"{'ok  ' if not err else 'FAIL'} {name:32s} rows={n:6d} {time.time() - t:6.2f}s {'S' if name in ORACLES else 'N'} {err or ''}", flush=True)
    if err:
        bad.append(name)
print(len(bad), "failed:", bad)
