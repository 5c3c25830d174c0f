"""One row per key by either way."""

from sumac.llm.once import once


def test_once(spark):
    rows = [(1, "b", None), (1, "a", 5), (2, None, 1), (2, None, 1), (3, "x", 0), (None, "y", 0)]
    df = spark.createDataFrame(rows, "id bigint, a string, b int")
    want = [(1, "a", 5), (2, None, 1), (3, "x", 0)]
    for few in (200_000, 0):
        assert sorted(map(tuple, once(df, "id", few).collect())) == want
    assert once(df.limit(0), "id").count() == 0
    assert [tuple(r) for r in once(df.filter("id = 3"), "id").collect()] == [(3, "x", 0)]
