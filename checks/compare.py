"""Run registered queries on Spark and their SQL on DuckDB and compare the rows.

    python -m checks.compare /root/testdata/sf0.01 [query ...]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

from checks.oracle import ORACLES
from checks.queries import REGISTRY


def oracle_rows(sf_dir: str, text: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for file in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    result = con.execute(text)
    return [d[0] for d in result.description], result.fetchall()


def in_name_order(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(
        (tuple(row[i] for i in order) for row in rows),
        key=lambda r: tuple((v is None, str(v)) for v in r),
    )


def compare(spark: SparkSession, sf_dir: str, name: str) -> str:
    """'' if both sides agree, else the first difference."""
    df = REGISTRY[name](spark, sf_dir)
    mine = in_name_order(df.columns, [tuple(r) for r in df.collect()])
    if name not in ORACLES:
        return "" if mine else "no rows"
    columns, rows = oracle_rows(sf_dir, ORACLES[name])
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}"
    theirs = in_name_order(columns, rows)
    if len(mine) != len(theirs):
        extra = [r for r in mine if r not in set(theirs)][:2]
        lacking = [r for r in theirs if r not in set(mine)][:2]
        return f"{len(mine)} rows != {len(theirs)}; only here {extra}; only oracle {lacking}"
    for a, b in zip(mine, theirs, strict=True):
        if a != b:
            return f"{sorted(columns)}\n  spark  {a}\n  oracle {b}"
    return "" if mine else "no rows"


def local_session(cores: str = "8") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName("checks")
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        # call sites for every Column would be recorded otherwise
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> int:
    sf_dir, names = sys.argv[1], sys.argv[2:] or list(REGISTRY)
    spark = local_session()
    failures = 0
    for name in names:
        start = time.time()
        try:
            problem = compare(spark, sf_dir, name)
        except Exception as error:  # a broken query must not hide the others
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        failures += bool(problem)
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - start:.1f}s {problem}",
              flush=True)
    return failures


if __name__ == "__main__":
    sys.exit(main())
