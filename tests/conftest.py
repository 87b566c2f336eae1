import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from profuse.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def table():
    """A small regression table with correlated columns and a sparse truth."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(120, 6))
    x[:, 5] = 0.7 * x[:, 0] + 0.3 * x[:, 5]
    y = 1.5 + x @ np.array([2.0, -1.0, 0.0, 0.5, 0.0, 0.0]) + 0.1 * rng.normal(size=120)
    return x, y


@pytest.fixture(scope="session")
def rows(spark, table):
    x, y = table
    data = [(f"s{i:04d}", [float(v) for v in x[i]], float(y[i]), i % 4 + 1) for i in range(len(x))]
    return spark.createDataFrame(data, "sample_id string, x array<double>, y double, fold int").repartition(3).cache()
