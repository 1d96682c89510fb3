from tidemark.model import Shape
from tidemark.operators import merge, ranges, shards

S = Shape(tags=("host", "region"), fields=("field1", "field2", "field3"))
DDL = "timestamp long, host string, region string, field1 long, field2 double, field3 string"


def points(spark, times, **more):
    return spark.createDataFrame([(t, "s1", "us", t, 1.0, "x") for t in times], DDL)


def times(df):
    return [r.timestamp for r in df.collect()]


def test_scan_is_half_open_and_ascending(spark):
    df = points(spark, [3000, 1000, 2000, 5000, 4000])
    assert times(ranges.range_query(df, S, 0, 4000)) == [1000, 2000, 3000]
    assert times(ranges.range_query(df, S, 2000, 4000)) == [2000, 3000]
    assert times(ranges.range_query(df, S, 0, None)) == [1000, 2000, 3000, 4000, 5000]
    assert times(ranges.range_query(df, S, 4000, 2000)) == times(ranges.range_query(df, S, 0, 0)) == []


def test_tags(spark):
    df = spark.createDataFrame([(1000, "s1", "us", 1, 1.0, ""), (2000, "s2", "us", 1, 1.0, ""), (3000, "s1", "eu", 1, 1.0, ""), (4000, "s2", None, 1, 1.0, "")], DDL)
    ask = lambda tags: times(ranges.range_query(df, S, 0, None, tags))
    assert ask({"region": "us"}) == [1000, 2000]
    assert ask({"region": "us", "host": "s1"}) == [1000]
    assert ask({"region": ""}) == [4000]
    assert ask({"zone": ""}) == [1000, 2000, 3000, 4000]
    assert ask({"zone": "a"}) == []


def test_projection(spark):
    df = points(spark, [1, 2])
    assert ranges.range_query(df, S, 0, None, fields=["field2", "field1", "field1", "no"]).columns == ["timestamp", "host", "region", "field1", "field2"]
    only = ranges.range_query(df, S, 0, None, fields=["no"])
    assert only.columns == ["timestamp", "host", "region"] and only.count() == 2


def test_pages(spark):
    df = points(spark, range(1000, 11000, 1000))
    assert times(ranges.range_query(df, S, 0, 6000, offset=2)) == [3000, 4000, 5000]
    assert times(ranges.range_query(df, S, 0, 11000, offset=2, limit=3)) == [3000, 4000, 5000]
    assert ranges.envelope(df, S, 0, 11000, offset=2, limit=3).first() == (5, True)
    assert ranges.envelope(df, S, 0, 11000, offset=8, limit=2).first() == (10, True)
    assert ranges.envelope(df, S, 0, 11000, offset=8, limit=3).first() == (10, False)
    assert ranges.envelope(df, S, 0, 11000).first() == (10, False)


def test_merge_keeps_repeats_stored_first(spark):
    a, b = points(spark, [1000, 3000]), points(spark, [1000, 2000])
    assert [(r.timestamp, r.src) for r in merge.merge_sources(a, b).collect()] == [(1000, 0), (1000, 1), (2000, 1), (3000, 0)]


def test_shards(spark):
    df = spark.createDataFrame([(0, 3600), (3600, 7200), (7200, 10800)], "shard_start long, shard_end long")
    hit = lambda a, b: [r.shard_start for r in shards.overlapping_shards(df, a, b).collect()]
    assert hit(4000, 5000) == [3600] and hit(0, 10800) == [0, 3600, 7200] and hit(20000, 30000) == []
    assert shards.window_starts(4000, 8000, 3600) == [3600, 7200] and shards.window_starts(5, 5, 10) == []


def test_blocks(spark):
    index = shards.block_index(points(spark, range(100)), 1000, rows=30)
    assert sorted((r.block, r.first_time, r.last_time, r.n_rows) for r in index.collect()) == [(0, 0, 29, 30), (1, 30, 59, 30), (2, 60, 89, 30), (3, 90, 99, 10)]
    assert shards.find_block(index, 45).first().block == 1 and shards.find_block(index, 500).first().block == 4
