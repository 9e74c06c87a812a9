import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF0001 = "/root/testdata/sf0.001"
SF001 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from tectonic.session import local_session

    s = local_session(4, shuffle_partitions=8)
    yield s
    s.stop()


def rows(df, *cols):
    """Collected rows as plain tuples (optionally a column subset), sorted."""
    out = [tuple(r) for r in (df.select(*cols) if cols else df).collect()]
    return sorted(out, key=lambda t: tuple((x is None, x) for x in t))


def core_df(spark, data):
    """Core-schema frame from (id, time, lat, lon, depth, mag[, mag_type, place]) tuples."""
    from tectonic.schema import CORE_SCHEMA

    full = [tuple(list(d) + [None] * (8 - len(d))) for d in data]
    return spark.createDataFrame(full, CORE_SCHEMA)
