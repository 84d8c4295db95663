import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from sparkprep.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__driver__memory="8g",
        spark__ui__showConsoleProgress="false",
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def frame(spark):
    """Rows as dicts plus a DDL schema -> DataFrame with a row order."""
    def build(ddl, rows):
        names = [c.strip().split()[0] for c in ddl.split(",")]
        data = [(i, *[r.get(n) for n in names]) for i, r in enumerate(rows)]
        return spark.createDataFrame(data, f"_row_ord bigint, {ddl}")

    return build


def by(df, key):
    return {r[key]: r for r in df.collect()}
