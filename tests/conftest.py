import re
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tools")]


@pytest.fixture(scope="session")
def spark():
    from factorspark.session import local_session

    return local_session(4, "tests", "4g")


@pytest.fixture(scope="session")
def frame(spark):
    """Builds a frame; ISO strings under a date column become dates."""
    from pyspark.sql import functions as F

    def make(schema, rows):
        plain = re.sub(r" date(?=,|$)", " string", schema)
        df = spark.createDataFrame(rows, plain)
        dates = [p.strip().split(" ")[0] for p in schema.split(",") if p.strip().endswith(" date")]
        for d in dates:
            df = df.withColumn(d, F.to_date(d))
        return df

    return make
