import pytest
from pyspark.sql import functions as F


@pytest.fixture()
def extra():
    """Adds columns whose names clash with those that operators use inside."""

    def add(df):
        for c in ("n", "r", "m", "v", "u", "part", "split_", "slot", "piece", "x", "w", "stop", "last", "_r", "key", "label_"):
            if c not in df.columns:
                df = df.withColumn(c, F.lit("extra"))
        return df

    return add
