import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from strayfinder.session import local_session

    session = local_session("tests", "8")
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(autouse=True)
def fresh_cache(request):
    yield
    if "spark" in request.fixturenames:
        request.getfixturevalue("spark").catalog.clearCache()


@pytest.fixture
def make_samples(spark):
    """samples(dataset_id, row_id, features[, label]) from {name: matrix}."""

    def build(datasets: dict, labels: dict | None = None, partitions: int = 4):
        rows = []
        for name, x in datasets.items():
            for i, row in enumerate(np.asarray(x, dtype=float)):
                rows.append(
                    (name, i, [float(v) for v in row], int(labels[name][i]) if labels else None)
                )
        schema = "dataset_id string, row_id bigint, features array<double>, label int"
        df = spark.createDataFrame(rows, schema).repartition(partitions, "row_id")
        return df if labels else df.drop("label")

    return build
