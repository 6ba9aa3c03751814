"""Compare registered queries with their SQL on the test tables.

Run ``python tests/oracle.py [sf] [name ...]``.
"""

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from kvartal import catalog  # noqa: E402
from kvartal.catalog.views import TABLES  # noqa: E402


def connect(sf_dir):
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return db


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    if value is None or isinstance(value, (str, bool)):
        return value
    return int(value) if float(value).is_integer() else float(value)


def _sorted(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(
        (tuple(_plain(row[i]) for i in order) for row in rows), key=repr
    )


def difference(spark, db, sf_dir, name):
    """None when both sides agree, else a short account."""
    frame = catalog.QUERIES[name](spark, sf_dir)
    ours = _sorted(frame.columns, frame.collect())
    result = db.execute(catalog.ORACLES[name])
    theirs = _sorted([c[0] for c in result.description], result.fetchall())
    if ours == theirs:
        return None
    if ours[0] != theirs[0]:
        return f"columns {ours[0]} != {theirs[0]}"
    a, b = set(ours[1]), set(theirs[1])
    return (
        f"rows {len(ours[1])} != {len(theirs[1])}; only spark {sorted(a - b, key=repr)[:2]}; "
        f"only sql {sorted(b - a, key=repr)[:2]}"
    )


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    sf = sys.argv[1] if len(sys.argv) > 1 else "sf0.01"
    sf_dir = f"/root/testdata/{sf}"
    names = sys.argv[2:] or list(catalog.QUERIES)
    spark = (
        SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    db = connect(sf_dir)
    for name in names:
        started = time.time()
        if name not in catalog.ORACLES:
            rows = catalog.QUERIES[name](spark, sf_dir).count()
            print(f"rows  {time.time() - started:6.2f}s {name} {rows}", flush=True)
            continue
        try:
            found = difference(spark, db, sf_dir, name)
        except Exception as error:  # report and go on with the next query
            found = f"{type(error).__name__}: {str(error)[:1500]}"
        print(f"{'ok   ' if found is None else 'FAIL '} {time.time() - started:6.2f}s {name} {found or ''}", flush=True)
