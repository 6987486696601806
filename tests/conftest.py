"""One local session, and a comparison of a query with its SQL in DuckDB."""

from __future__ import annotations

import math
import os
import sys
from pathlib import Path

import duckdb
import pytest

ROOT = str(Path(__file__).resolve().parents[1])
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
os.environ.setdefault("TZ", "UTC")

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def canonical(rows) -> list[tuple]:
    def one(v):
        if v is None:
            return "null"
        if isinstance(v, float) and not isinstance(v, bool):
            return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
        return v.isoformat() if hasattr(v, "isoformat") else str(v)

    return sorted(tuple(one(v) for v in r) for r in rows)


@pytest.fixture(scope="session")
def same_as_sql(spark):
    """Checks a query over a folder of tables against SQL: columns, rows and values."""

    def check(query, sql: str, folder: str) -> int:
        con = duckdb.connect()
        con.execute("SET TimeZone = 'UTC'")
        for name in TABLES:
            if (Path(folder) / f"{name}.parquet").exists():
                con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
        found = query(spark, str(folder))
        cur = con.execute(sql)
        names = [d[0] for d in cur.description]
        assert sorted(names) == sorted(found.columns)
        got = canonical(tuple(r) for r in found.select(*[f"`{n}`" for n in names]).collect())
        want = canonical(cur.fetchall())
        assert got == want
        return len(got)

    return check
