from __future__ import annotations

import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tidewatch.session import configured  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.log.level", "ERROR")
        # small tables: compiling a stage costs more than running it
        .config("spark.sql.codegen.wholeStage", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    yield configured(session)
    session.stop()
