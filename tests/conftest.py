import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
os.environ.setdefault("PYSPARK_PYTHON", sys.executable)


@pytest.fixture(scope="session")
def spark():
    from almagre.session import build

    session = build("tests", cpus="4", spark__sql__shuffle__partitions="4", spark__driver__memory="3g")
    yield session
    session.stop()


@pytest.fixture
def rows():
    """A table's rows as a sorted list of tuples of the given columns."""

    def read(df, *cols):
        df = df.select(*cols) if cols else df
        return sorted((tuple(r) for r in df.collect()), key=repr)

    return read
