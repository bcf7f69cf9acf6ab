import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from barloom.sources.session import local_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "8g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    return SMALL


@pytest.fixture
def one_ticker(spark):
    """Rows of one ticker on consecutive days from equally long lists."""
    def make(ticker="A", start="2024-01-01", **columns):
        import datetime as dt

        first = dt.date.fromisoformat(start)
        names = list(columns)
        n = len(columns[names[0]])
        rows = [
            (ticker, first + dt.timedelta(days=k), *(None if columns[c][k] is None else float(columns[c][k]) for c in names))
            for k in range(n)
        ]
        return spark.createDataFrame(rows, "ticker string, date date, " + ", ".join(f"{c} double" for c in names))

    return make


def column(df, name, order="date"):
    return [r[name] for r in df.orderBy(order).select(name).collect()]
