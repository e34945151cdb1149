import sys
from pathlib import Path

import pytest
from pyspark.sql.types import DoubleType

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from strandline.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(cores=4, shuffle_partitions=2, memory="4g")
    session.conf.set("spark.sql.codegen.wholeStage", "false")  # tiny tables: compiling costs more than it saves
    yield session
    session.stop()


@pytest.fixture
def table(spark):
    """Rows to a DataFrame with an explicit schema; whole numbers are fine in double columns."""
    def make(schema, rows):
        fields = spark.createDataFrame([], schema).schema.fields
        real = [isinstance(f.dataType, DoubleType) for f in fields]
        fixed = [tuple(float(v) if d and v is not None else v for v, d in zip(row, real)) for row in rows]
        return spark.createDataFrame(fixed, schema).coalesce(1)
    return make
