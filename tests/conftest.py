from __future__ import annotations

import sys
from datetime import datetime
from decimal import Decimal
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from quaymetrics.session import prepare  # noqa: E402
from quaymetrics.sources.fixtures import derive  # noqa: E402
from quaymetrics.sources.schema import PREFIX, SCHEMAS  # noqa: E402
from quaymetrics.sources.tables import Tables  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield prepare(session)
    session.stop()


@pytest.fixture(scope="session")
def derived(spark):
    """The eight tables derived from the smallest test data."""
    return derive(spark, SF)


def t(text: str) -> datetime:
    """'08:50' on the test day, or a full timestamp."""
    return datetime.fromisoformat(text if "-" in text else f"2024-01-10 {text}")


def _value(kind: str, v):
    if kind == "timestamp_ntz" and isinstance(v, str):
        return t(v)
    if kind.startswith("decimal") and v is not None:
        return Decimal(str(v))
    return v


@pytest.fixture
def make(spark):
    """Tables from short rows: make(bi_job_hist=[{"job_id": "J1", ...}]). Keys default to T1 / YT / E1."""

    def build(**rows_by_table) -> Tables:
        frames = {}
        for name, schema in SCHEMAS.items():
            kinds = dict(part.strip().split(" ", 1) for part in schema.replace("decimal(20,6)", "decimal").split(","))
            rows = []
            for given in rows_by_table.get(name, []):
                row = {"tml_id": "T1", "eq_type": "YT", "eq_no": "E1", **given}
                rows.append(tuple(_value(kind, row.get(c[len(PREFIX[name]) + 1 :])) for c, kind in kinds.items()))
            frames[name] = spark.createDataFrame(rows, schema)
        return Tables(**frames)

    return build


def rows(df, *columns):
    picked = df.select(*columns) if columns else df
    return [tuple(r) for r in picked.collect()]


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()
