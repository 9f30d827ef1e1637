import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from hindcast.session import session

    s = session(
        "tests", "local[4]", spark__sql__shuffle__partitions="2", spark__ui__enabled="false", spark__sql__codegen__wholeStage="false",
        spark__ui__showConsoleProgress="false", spark__driver__memory="6g",
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture
def hot(spark):
    """Treat keys of more than 40 rows as too big for a task."""

    def set_limit(n=40):
        spark.conf.set("spark.hindcast.hotRows", str(n))

    yield set_limit
    spark.conf.unset("spark.hindcast.hotRows")


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def close(a, b, tol=1e-9):
    if a is None or b is None:
        return a is None and b is None
    if isinstance(a, float) or isinstance(b, float):
        return abs(a - b) <= tol * max(1.0, abs(a), abs(b))
    return a == b


def assert_same(left, right, key, tol=1e-9):
    cols = left.columns
    assert sorted(cols) == sorted(right.columns)
    a, b = rows(left.select(*cols), *key), rows(right.select(*cols), *key)
    assert len(a) == len(b)
    for x, y in zip(a, b):
        for c, u, v in zip(cols, x, y):
            assert close(u, v, tol), (c, x, y)
