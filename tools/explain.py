"""Print the final (post-AQE) physical plan of registered queries.

    python tools/explain.py [sf_dir] query [query ...]
"""

from __future__ import annotations

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def main():
    from farebox.plans import QUERIES
    from farebox.session import get_session
    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = get_session()
    for n in names:
        df = QUERIES[n](spark, sf_dir)
        df.collect()
        print(f"==== {n}")
        print(df._jdf.queryExecution().executedPlan().toString())


if __name__ == "__main__":
    main()
