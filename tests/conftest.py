import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

DATA = Path("/root/testdata")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from chunklake.session import session

    s = session(4, 4, "4g")
    s.sparkContext.setLogLevel("ERROR")
    if not s.conf.get("spark.checkpoint.dir", None):
        s.conf.set("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return str(DATA / "sf0.001")


@pytest.fixture(scope="session")
def oracle(sf):
    import duckdb

    con = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


@pytest.fixture(scope="session")
def same(spark, sf, oracle):
    """Whether a query's rows are those of its SQL, in any order."""

    def check(query, text):
        df = query(spark, sf)
        names = sorted(df.columns)
        got = sorted(map(tuple, df.select(*names).collect()), key=str)
        expected = sorted(oracle.execute(f"select {', '.join(names)} from ({text})").fetchall(), key=str)
        assert got == expected
        return len(got)

    return check
