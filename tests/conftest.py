import glob
import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ.setdefault("CHORALE_DRIVER_MEMORY", "4g")
DATA = os.environ.get("CHORALE_TESTDATA", "/root/testdata")


@pytest.fixture(scope="session")
def spark():
    from chorale.session import get_session

    session = get_session("tests", "local[4]", 4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{DATA}/sf0.001/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def rows(pdf):
    """Rows of a frame with columns in order of name, as sorted strings."""
    columns = sorted(pdf.columns)
    return columns, sorted(map(str, pdf[columns].astype(object).itertuples(index=False, name=None)))
