import math
import os

import duckdb
import pytest

from temporalis.plans import queries

SF = "/root/testdata/sf0.001"


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def value(x):
        if isinstance(x, float):
            return None if math.isnan(x) else round(x, 6) + 0.0
        return x

    return sorted((tuple(value(r[i]) for i in order) for r in rows), key=str)


@pytest.fixture(scope="module")
def frames(spark):
    """One for all queries: what several of them go over is worked out once."""
    return queries.Frames(spark, SF)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
@pytest.mark.parametrize("name", sorted(queries.ALL))
def test_query_equals_sql(frames, name):
    build, text = queries.ALL[name]
    df = build(frames)
    got = plain([tuple(r) for r in df.collect()], df.columns)
    assert got
    if text is None:
        return
    db = duckdb.connect()
    for file in os.listdir(SF):
        db.execute(f"create view {file.removesuffix('.parquet')} as select * from read_parquet('{SF}/{file}')")
    cur = db.execute(text)
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    want = plain(cur.fetchall(), names)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert all(x == y or (isinstance(x, float) and x == pytest.approx(y, abs=2e-6)) for x, y in zip(a, b, strict=True)), (a, b)
