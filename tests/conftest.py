import datetime as dt
import math
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def month(i: int) -> dt.date:
    return dt.date(1999 + i // 12, i % 12 + 1, 1)


@pytest.fixture(scope="session")
def tiny_rows():
    """3 members x 24 months x 4 cells; one value NULL, one NaN."""
    rows = []
    for m in range(3):
        for i in range(24):
            for c in range(4):
                rows.append((m, month(i), c, m + math.sin(i % 12 + 1) + c + 0.1 * (i // 12) * (c + 1)))
    rows[5] = (*rows[5][:3], None)
    rows[50] = (*rows[50][:3], math.nan)
    return rows


@pytest.fixture(scope="session")
def tiny_panel(spark, tiny_rows):
    from canopanel.schema import nan_to_null
    return nan_to_null(spark.createDataFrame(
        tiny_rows, "member long, time date, gridcell int, value double")).cache()


@pytest.fixture(scope="session")
def tiny_frame(tiny_rows):
    import pandas as pd
    frame = pd.DataFrame(tiny_rows, columns=["member", "time", "gridcell", "value"])
    frame["month"] = [t.month for t in frame["time"]]
    return frame
