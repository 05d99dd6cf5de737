import os
import sys
from datetime import timedelta
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

from moments import T0  # noqa: E402

from tidemark import model  # noqa: E402
from tidemark.session import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = session("tests", "local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def make(spark):
    """Samples from (name, seconds after T0, value, labels) and optionally a type."""

    def samples(*rows):
        data = [(r[0], r[4] if len(r) > 4 else "gauge", float(r[2]), r[3], T0 + timedelta(seconds=r[1]), "", None) for r in rows]
        return spark.createDataFrame(data, model.SAMPLES)

    return samples
