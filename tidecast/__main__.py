"""``python -m tidecast``: list registered queries, or run one over a folder of tables."""

from __future__ import annotations

import argparse


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tidecast", description=__doc__)
    p.add_argument("query", nargs="?", help="a registered query; without it, their names")
    p.add_argument("--data", help="folder with one Parquet table each")
    p.add_argument("--out", help="where to write the result; without it, some rows are shown")
    given = p.parse_args(args)
    from .plans.registry import ORACLE_SQL, QUERIES

    if given.query is None:
        print("\n".join(f"{n}{' (SQL)' if n in ORACLE_SQL else ''}" for n in sorted(QUERIES)))
        return 0
    if given.query not in QUERIES or not given.data:
        p.error("name a registered query and --data")
    from pyspark.sql import SparkSession

    result = QUERIES[given.query](SparkSession.builder.getOrCreate(), given.data)
    result.write.parquet(given.out) if given.out else result.show()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
