"""python check.py [sf] [name ...]: run queries against their SQL checks and print time per query."""

from __future__ import annotations

import sys
import time

sys.path.insert(0, "tests")

from checks import compare  # noqa: E402
from tidemark.plans.catalog import QUERIES  # noqa: E402
from tidemark.session import local_session  # noqa: E402


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark = local_session()
    bad = 0
    for name in names:
        t = time.time()
        try:
            ok, note = compare(spark, f"/root/testdata/{sf}", QUERIES[name])
        except Exception as e:  # noqa: BLE001
            ok, note = False, f"{type(e).__name__}: {str(e)[:600]}"
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:28s} {time.time() - t:6.1f}s {note}", flush=True)
    print("failed:", bad)


if __name__ == "__main__":
    main()
