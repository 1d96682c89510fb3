"""Queries over the test tables, one or more per operator, and the SQL that must agree with them.

Where the test tables lack a situation (missing tags, repeats, tombstones, parts, bad rows), both
sides derive it from event_id by the same rule.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import functions as fn
from ..engine import Config, Engine, health
from ..model import WEEK
from ..operators import ingest, maintenance, merge, ranges, series, shards
from ..sources.scratch import fresh_path
from ..sources.measurements import EVENTS, LINEITEM, ORDERS, events, lineitem, orders

LO = 1_704_672_000_000_000_000
HI = LO + WEEK
MID = LO + WEEK // 2
DAY = 86_400_000_000_000
TAGS = ("event_type", "usr")

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

_P = """p as (select epoch_us(ts) * 1000 as timestamp, event_type, user_id::varchar as usr, value, event_id, props, event_type = 'error' as is_error from events),
    k as (select *, '{"event_type":"' || event_type || '","usr":"' || usr || '"}' as series_key, timestamp // %d * %d as shard_start from p)""" % (WEEK, WEEK)
_COLUMNS = "timestamp, event_type, usr, value, event_id, props, is_error"


def query(name: str, sql: str) -> Callable[[Query], Query]:
    """Register a query with its SQL; ``p`` and ``k`` (with series_key and shard_start) stand for the events as points."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        text = sql.strip()
        if " p" in text or " k" in text:
            text = f"with {_P}, {text[5:]}" if text.startswith("with ") else f"with {_P} {text}"
        ORACLE_SQL[name] = text
        return f

    return add


def _keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).withColumns({"series_key": fn.series_key(TAGS), "shard_start": fn.shard_start("timestamp", WEEK)})


def _parted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in parts: event_id % 3, and a third of the rows once more in part 3 with another value."""
    k = _keyed(spark, sf_dir).select("timestamp", "series_key", "shard_start", "value", "event_id").withColumn("part_seq", F.col("event_id") % 3)
    again = k.where("event_id % 3 = 0").withColumns({"value": F.col("value") + 1, "part_seq": F.lit(3).cast("long")})
    return k.unionByName(again)


_PARTED = """parted as (select timestamp, series_key, shard_start, value, event_id, event_id % 3 as part_seq from k
    union all select timestamp, series_key, shard_start, value + 1, event_id, 3 from k where event_id % 3 = 0)"""


def _tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A delete of a day around every 50th event's series."""
    k = _keyed(spark, sf_dir).where("event_id % 50 = 0")
    return k.select("series_key", F.expr(f"timestamp - {DAY // 2}").alias("mint"), F.expr(f"timestamp + {DAY // 2}").alias("maxt"), F.expr(f"timestamp + {DAY}").alias("deleted"))


_TOMBS = f"tombs as (select series_key, timestamp - {DAY // 2} as mint, timestamp + {DAY // 2} as maxt, timestamp + {DAY} as deleted from k where event_id % 50 = 0)"


def _levelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of parts that share 400 events in turn: level, part, size, min_time, max_time, n_rows."""
    e = events(spark, sf_dir).withColumn("part", F.expr("event_id div 400 * 2 + event_id % 2"))
    parts = maintenance.part_ranges(e, size=F.length("props") * 1000)
    return parts.withColumn("level", F.expr("cast(part div 2 % 3 as int)"))


_PARTS = "parts as (select event_id // 400 * 2 + event_id % 2 as part, min(timestamp) as min_time, max(timestamp) as max_time, count(*) as n_rows, sum(length(props) * 1000)::bigint as size, ((event_id // 400) % 3)::int as level from p group by event_id // 400, event_id % 2)"
_LEVEL_MAX = "case {0} when 0 then 10485760 when 1 then 104857600 when 2 then 1073741824 when 3 then 10737418240 when 4 then 107374182400 end"

# ---- range queries


@query("range_scan", f"select {_COLUMNS} from p where timestamp >= {LO} and timestamp < {HI}")
def range_scan(spark, sf_dir):
    return ranges.range_query(events(spark, sf_dir, LO, HI), EVENTS, LO, HI)


@query("range_open_end", f"select {_COLUMNS} from p where timestamp >= {LO}")
def range_open_end(spark, sf_dir):
    return ranges.range_query(events(spark, sf_dir, LO, None), EVENTS, LO, None)


@query("range_empty", f"select {_COLUMNS} from p where false")
def range_empty(spark, sf_dir):
    return ranges.range_query(events(spark, sf_dir, HI, LO), EVENTS, HI, LO)


@query("tag_eq", f"select {_COLUMNS} from p where timestamp >= {LO} and timestamp < {HI} and event_type = 'click'")
def tag_eq(spark, sf_dir):
    return ranges.range_query(events(spark, sf_dir, LO, HI), EVENTS, LO, HI, {"event_type": "click"})


@query("tag_and", f"select {_COLUMNS} from p where timestamp >= {LO} and event_type = 'click' and usr = '7'")
def tag_and(spark, sf_dir):
    return ranges.range_query(events(spark, sf_dir, LO, None), EVENTS, LO, None, {"event_type": "click", "usr": "7"})


@query("tag_missing_matches_empty", f"select timestamp, case when usr::bigint % 3 = 0 then 'a' end as zone, value from p where timestamp >= {LO} and usr::bigint % 3 <> 0")
def tag_missing_matches_empty(spark, sf_dir):
    sparse = events(spark, sf_dir).withColumn("zone", F.when(F.col("usr").cast("long") % 3 == 0, "a"))
    shape = type(EVENTS)(tags=("zone",), fields=("value",))
    return ranges.range_query(sparse, shape, LO, None, {"zone": ""})


@query("project_fields", f"select timestamp, event_type, usr, value from p where timestamp >= {LO} and timestamp < {HI}")
def project_fields(spark, sf_dir):
    return ranges.range_query(events(spark, sf_dir, LO, HI), EVENTS, LO, HI, fields=["value", "value"])


@query("project_unknown", f"select timestamp, event_type, usr from p where timestamp >= {LO} and timestamp < {HI}")
def project_unknown(spark, sf_dir):
    return ranges.range_query(events(spark, sf_dir, LO, HI), EVENTS, LO, HI, fields=["nosuch"])


@query("page_limit", f"select {_COLUMNS} from p where timestamp >= {LO} order by timestamp limit 25")
def page_limit(spark, sf_dir):
    return ranges.range_query(events(spark, sf_dir, LO, None), EVENTS, LO, None, limit=25)


@query("page_offset", f"select {_COLUMNS} from p where timestamp >= {LO} and timestamp < {HI} order by timestamp offset 100")
def page_offset(spark, sf_dir):
    return ranges.range_query(events(spark, sf_dir, LO, HI), EVENTS, LO, HI, offset=100)


@query("page_both", f"select timestamp, event_type, usr, value from p where timestamp >= {LO} and timestamp < {HI} and event_type = 'click' order by timestamp limit 10 offset 20")
def page_both(spark, sf_dir):
    return ranges.range_query(events(spark, sf_dir, LO, HI), EVENTS, LO, HI, {"event_type": "click"}, ["value"], offset=20, limit=10)


@query("page_envelope", f"with n as (select count(*) as n from p where timestamp >= {LO} and timestamp < {HI}) select least(n, 120)::bigint as total_count, n - 20 >= 100 as has_more from n")
def page_envelope(spark, sf_dir):
    return ranges.envelope(events(spark, sf_dir, LO, HI), EVENTS, LO, HI, offset=20, limit=100)


@query("orders_range", "select epoch_us(o_orderdate) * 1000 as timestamp, o_orderstatus, o_orderpriority, o_totalprice from orders where o_orderstatus = 'O' order by 1, o_orderkey limit 50 offset 10")
def orders_range(spark, sf_dir):
    return ranges.range_query(orders(spark, sf_dir, 0, None), ORDERS, 0, None, {"o_orderstatus": "O"}, offset=10, limit=50)


@query(
    "lineitem_range",
    """select epoch_us(l_shipdate) * 1000 as timestamp, l_returnflag, l_linestatus, l_quantity as quantity, l_extendedprice as price from lineitem
    where l_returnflag = 'R' and l_linestatus = 'F' order by 1, l_orderkey, l_linenumber limit 100""",
)
def lineitem_range(spark, sf_dir):
    return ranges.range_query(lineitem(spark, sf_dir, 0, None), LINEITEM, 0, None, {"l_returnflag": "R", "l_linestatus": "F"}, ["quantity", "price"], limit=100)


# ---- shards and blocks


@query("shard_assign", "select event_id, shard_start, shard_start + 604800000000000 as shard_end from k")
def shard_assign(spark, sf_dir):
    return shards.with_shard(events(spark, sf_dir), WEEK).select("event_id", "shard_start", "shard_end")


@query(
    "shard_stats",
    """select shard_start, shard_start + 604800000000000 as shard_end, count(*) as n_points, min(timestamp) as min_time, max(timestamp) as max_time,
    count(distinct series_key) as n_series from k group by shard_start""",
)
def shard_stats(spark, sf_dir):
    return shards.shard_stats(events(spark, sf_dir), WEEK, TAGS)


@query(
    "shard_overlap",
    f"with s as (select distinct shard_start, shard_start + {WEEK} as shard_end from k) select shard_start, shard_end from s where shard_start < {HI} and shard_end > {MID}",
)
def shard_overlap(spark, sf_dir):
    found = shards.with_shard(events(spark, sf_dir), WEEK).select("shard_start", "shard_end").distinct()
    return shards.overlapping_shards(found, MID, HI)


@query("shard_contains", f"select event_id, shard_start <= {MID} and {MID} < shard_start + {WEEK} as holds from k")
def shard_contains(spark, sf_dir):
    return shards.with_shard(events(spark, sf_dir), WEEK).select("event_id", fn.contains_time("shard_start", "shard_end", MID).alias("holds"))


_BLOCKS = "b as (select *, (row_number() over (partition by shard_start order by timestamp) - 1) // 512 as block from k), i as (select shard_start, block, min(timestamp) as first_time, max(timestamp) as last_time, count(*) as n_rows from b group by all)"


@query("block_index", f"with {_BLOCKS} select * from i")
def block_index(spark, sf_dir):
    return shards.block_index(events(spark, sf_dir), WEEK, rows=512)


@query("block_seek", f"with {_BLOCKS} select shard_start, coalesce(min(case when last_time >= {MID} then block end), count(*))::bigint as block from i group by shard_start")
def block_seek(spark, sf_dir):
    return shards.find_block(shards.block_index(events(spark, sf_dir), WEEK, rows=512), MID)


# ---- merge, de-duplication, deletes


@query("merge_sources", "select timestamp, event_id, value, case when event_id % 2 = 0 then 0 else 1 end as src from p")
def merge_sources(spark, sf_dir):
    e = events(spark, sf_dir).select("timestamp", "event_id", "value")
    return merge.merge_sources(e.where("event_id % 2 = 0"), e.where("event_id % 2 <> 0"))


@query("merge_ties", "select timestamp, event_id, value, 0 as src from p where event_id % 2 = 0 union all select timestamp, event_id, value, 1 from k where event_id % 3 = 0")
def merge_ties(spark, sf_dir):
    e = events(spark, sf_dir).select("timestamp", "event_id", "value")
    return merge.merge_sources(e.where("event_id % 2 = 0"), e.where("event_id % 3 = 0"))


@query("dedup_first", f"with {_PARTED} select * from parted qualify row_number() over (partition by timestamp, series_key order by part_seq) = 1")
def dedup_first(spark, sf_dir):
    return merge.dedup(_parted(spark, sf_dir), keep="first")


@query("dedup_last", f"with {_PARTED} select * from parted qualify row_number() over (partition by timestamp, series_key order by part_seq desc) = 1")
def dedup_last(spark, sf_dir):
    return merge.dedup(_parted(spark, sf_dir), keep="last")


@query("mem_dedup_ts", f"with h as (select *, timestamp // {DAY} * {DAY} as day from k) select day as timestamp, event_id, value from h qualify row_number() over (partition by day order by event_id) = 1")
def mem_dedup_ts(spark, sf_dir):
    e = events(spark, sf_dir).select(fn.shard_start("timestamp", DAY).alias("timestamp"), "event_id", "value")
    return merge.dedup_times(e, ["event_id"])


@query("tombstone_delete", f"with {_TOMBS} select event_id, timestamp, series_key from k where not exists (select 1 from tombs t where t.series_key = k.series_key and k.timestamp between t.mint and t.maxt)")
def tombstone_delete(spark, sf_dir):
    return merge.without_deleted(_keyed(spark, sf_dir), _tombstones(spark, sf_dir)).select("event_id", "timestamp", "series_key")


@query("tombstone_gc", f"with {_TOMBS} select * from tombs where {HI} - deleted < {3 * DAY}")
def tombstone_gc(spark, sf_dir):
    return merge.live_tombstones(_tombstones(spark, sf_dir), HI, 3 * DAY)


@query(
    "compact_partition",
    f"""with {_PARTED}, {_TOMBS}, d as (select * from parted qualify row_number() over (partition by timestamp, series_key order by part_seq) = 1)
    select * from d where not exists (select 1 from tombs t where t.series_key = d.series_key and d.timestamp between t.mint and t.maxt)""",
)
def compact_partition(spark, sf_dir):
    return merge.compacted(_parted(spark, sf_dir), _tombstones(spark, sf_dir))


# ---- series

_DICT = "d as (select series_key, event_type, usr, min(event_id) as f from k group by all), s as (select row_number() over (order by f, series_key) - 1 as series_id, series_key, event_type, usr from d)"


@query("series_dictionary", f"with {_DICT} select * from s")
def series_dictionary(spark, sf_dir):
    return series.dictionary(events(spark, sf_dir), TAGS, "event_id")


@query(
    "series_dictionary_incremental",
    """with a as (select series_key, event_type, usr, min(event_id) as f from k where event_id % 4 = 0 group by all),
    o as (select row_number() over (order by f, series_key) - 1 as series_id, series_key, event_type, usr from a),
    n as (select series_key, event_type, usr, min(event_id) as f from k where series_key not in (select series_key from o) group by all)
    select * from o union all select (select max(series_id) + 1 from o) + row_number() over (order by f, series_key) - 1, series_key, event_type, usr from n""",
)
def series_dictionary_incremental(spark, sf_dir):
    e = events(spark, sf_dir)
    known = series.dictionary(e.where("event_id % 4 = 0"), TAGS, "event_id")
    return series.dictionary(e, TAGS, "event_id", known)


@query("series_count", "select count(distinct series_key) as n_series from k")
def series_count(spark, sf_dir):
    return series.series_count(events(spark, sf_dir), TAGS)


@query("series_key_of_map", "select event_id, series_key from k")
def series_key_of_map(spark, sf_dir):
    tags = F.create_map(F.lit("usr"), "usr", F.lit("event_type"), "event_type")
    return events(spark, sf_dir).select("event_id", fn.series_key_of_map(tags).alias("series_key"))


@query("tag_index", f"with {_DICT} select 'event_type' as tag, event_type as value, series_id from s union all select 'usr', usr, series_id from s")
def tag_index(spark, sf_dir):
    return series.tag_pairs(series.dictionary(events(spark, sf_dir), TAGS, "event_id"), TAGS)


@query("tag_lookup", f"with {_DICT} select series_id from s where event_type = 'view'")
def tag_lookup(spark, sf_dir):
    return series.series_with_tag(series.tag_pairs(series.dictionary(events(spark, sf_dir), TAGS, "event_id"), TAGS), "event_type", "view")


@query("sid_resolve", f"with {_DICT}, r as (select event_id, event_id % 1000 as series_id from k) select r.series_id, event_id, series_key, event_type, usr from r left join s on s.series_id = r.series_id")
def sid_resolve(spark, sf_dir):
    e = events(spark, sf_dir)
    rows = e.select("event_id", (F.col("event_id") % 1000).alias("series_id"))
    return series.resolve(rows, series.dictionary(e, TAGS, "event_id"))


# ---- ingest

_BAD = """b as (select event_id, case when event_id % 11 = 0 then '' when event_id % 13 = 0 then null else 'db' end as database, case when event_id % 17 = 0 then '' else 'm' end as measurement,
    case when event_id % 19 = 0 then -timestamp when event_id % 23 = 0 then null else timestamp end as timestamp from k)"""
_REASON = """case when coalesce(database, '') = '' then 'empty database' when measurement = '' then 'empty measurement'
    when timestamp is null then 'missing timestamp' when timestamp < 0 then 'negative timestamp' end"""


def _bad(spark, sf_dir):
    e, at = events(spark, sf_dir), lambda n: F.col("event_id") % n == 0
    return e.select(
        "event_id",
        F.when(at(11), "").when(at(13), F.lit(None)).otherwise("db").alias("database"),
        F.when(at(17), "").otherwise("m").alias("measurement"),
        F.when(at(19), -F.col("timestamp")).when(at(23), F.lit(None)).otherwise(F.col("timestamp")).alias("timestamp"),
    )


@query("validate_points", f"with {_BAD} select *, {_REASON} as reject_reason from b")
def validate_points(spark, sf_dir):
    return _bad(spark, sf_dir).withColumn("reject_reason", ingest.reject_reason())


@query("validate_split", f"with {_BAD} select event_id, database, measurement, timestamp from b where {_REASON} is null")
def validate_split(spark, sf_dir):
    return ingest.validated(_bad(spark, sf_dir))[0]


@query("flush_batches", "select event_id, shard_start, (row_number() over (partition by shard_start order by event_id) - 1) // 300 as flush_batch from k")
def flush_batches(spark, sf_dir):
    return ingest.flush_batches(_keyed(spark, sf_dir), ["event_id"], rows=300).select("event_id", "shard_start", "flush_batch")


@query(
    "field_types",
    """select 'click_value' as field, case when count(case when event_type = 'click' then value end) > 0 then 'float64' else 'float64' end as type,
        count(case when event_type = 'click' then value end) as n_values, min(case when event_type = 'click' then event_id end) as first_seq from p
    union all select 'props', 'string', count(props), min(event_id) from k union all select 'never', 'float64', 0, null from k group by 1, 2""",
)
def field_types(spark, sf_dir):
    e = events(spark, sf_dir).withColumns({"click_value": F.expr("case when event_type = 'click' then value end"), "never": F.lit(None).cast("long")})
    return ingest.field_types(e, {"click_value": "float64", "props": "string", "never": "int64"}, "event_id")


_VERSIONS = "v as (select event_id // 10 as field_no, event_id as version, case when event_id % 7 = 0 then 'string' else 'int64' end as type from k)"


@query(
    "schema_conflict",
    f"with {_VERSIONS}, o as (select version, 'f' || field_no as field, lag(type) over (partition by field_no order by version) as old_type, type as new_type from v) select * from o where old_type <> new_type",
)
def schema_conflict(spark, sf_dir):
    e = events(spark, sf_dir)
    kind = F.when(F.col("event_id") % 7 == 0, "string").otherwise("int64")
    return ingest.schema_conflicts(e.select(F.concat(F.lit("f"), F.expr("event_id div 10").cast("string")).alias("field"), F.col("event_id").alias("version"), kind.alias("type")))


@query("zero_fill", "select event_id, coalesce(case when event_type = 'click' then value end, 0.0) as value, coalesce(case when event_id % 2 = 0 then props end, '') as props, coalesce(case when event_id % 3 = 0 then is_error end, false) as is_error from p")
def zero_fill(spark, sf_dir):
    e = events(spark, sf_dir).selectExpr("event_id", "case when event_type = 'click' then value end as value", "case when event_id % 2 = 0 then props end as props", "case when event_id % 3 = 0 then is_error end as is_error")
    return fn.zero_fill(e, {"value": "float64", "props": "string", "is_error": "bool"})


# ---- maintenance


@query("retention_keep", f"with s as (select distinct shard_start, shard_start + {WEEK} as shard_end from k) select * from s where shard_end >= {HI + WEEK} - {WEEK}")
def retention_keep(spark, sf_dir):
    found = shards.with_shard(events(spark, sf_dir), WEEK).select("shard_start", "shard_end").distinct()
    return maintenance.retained(found, HI + WEEK, WEEK)


@query("retention_expired", f"with s as (select distinct shard_start, shard_start + {WEEK} as shard_end from k) select * from s where shard_end < {HI + WEEK} - {WEEK}")
def retention_expired(spark, sf_dir):
    found = shards.with_shard(events(spark, sf_dir), WEEK).select("shard_start", "shard_end").distinct()
    return maintenance.expired(found, HI + WEEK, WEEK)


@query("part_ranges", "select event_id // 400 * 2 + event_id % 2 as part, min(timestamp) as min_time, max(timestamp) as max_time, count(*) as n_rows, sum(length(props) * 1000)::bigint as size from p group by 1")
def part_ranges(spark, sf_dir):
    return _levelled(spark, sf_dir).drop("level")


@query("part_overlap", f"with {_PARTS} select a.level, a.part, b.part as other from parts a join parts b on a.level = b.level and a.part < b.part and a.min_time <= b.max_time and b.min_time <= a.max_time")
def part_overlap(spark, sf_dir):
    return maintenance.overlapping_parts(_levelled(spark, sf_dir))


@query(
    "part_merge_inputs",
    f"with {_PARTS} select part from parts where level = 0 union select b.part from parts a join parts b on a.level = 0 and b.level = 1 and a.min_time <= b.max_time and b.min_time <= a.max_time",
)
def part_merge_inputs(spark, sf_dir):
    return maintenance.merge_inputs(_levelled(spark, sf_dir), 0)


@query(
    "part_select",
    f"""with {_PARTS}, r as (select *, (sum(size) over w)::bigint as running, row_number() over w as nth from parts window w as (partition by level order by size, part rows unbounded preceding))
    select level, part, size, running from r where running <= ({_LEVEL_MAX.format("level + 1")}) // 2 or nth = 1""",
)
def part_select(spark, sf_dir):
    return maintenance.select_parts(_levelled(spark, sf_dir))


@query("compact_trigger", f"with {_PARTS} select level as shard_start, count(*) as n_parts, sum(size)::bigint as size, count(*) >= 4 and sum(size) < 1073741824 as due from parts group by level")
def compact_trigger(spark, sf_dir):
    return maintenance.compaction_due(_levelled(spark, sf_dir).withColumnRenamed("level", "shard_start"), 4, 1 << 30)


@query(
    "level_trigger",
    f"""with {_PARTS} select level, count(*) as n_parts, sum(size)::bigint as size,
    case when level = 0 then count(*) >= 10 or sum(size) >= 5242880 else sum(size) >= {_LEVEL_MAX.format("level")} end as due from parts group by level""",
)
def level_trigger(spark, sf_dir):
    return maintenance.levels_due(_levelled(spark, sf_dir))


# ---- codecs, catalog, health


@query("delta_encode", "select event_id, series_key, timestamp - lag(timestamp, 1, 0) over (partition by series_key order by timestamp, event_id) as delta from k")
def delta_encode(spark, sf_dir):
    return fn.delta_encode(_keyed(spark, sf_dir), "timestamp", ["series_key"], ["timestamp", "event_id"]).select("event_id", "series_key", "delta")


@query("delta_decode", "select event_id, timestamp as value from p")
def delta_decode(spark, sf_dir):
    coded = fn.delta_encode(_keyed(spark, sf_dir), "timestamp", ["series_key"], ["timestamp", "event_id"])
    place = F.row_number().over(Window.partitionBy("series_key").orderBy("timestamp", "event_id"))
    coded = coded.withColumn("nth", place).select("event_id", "series_key", "nth", "delta")
    return fn.delta_decode(coded, "delta", ["series_key"], ["nth"]).select("event_id", "value")


_SEPTETS = "case when n < 128 then 1 when n < 16384 then 2 when n < 2097152 then 3 when n < 268435456 then 4 when n < 34359738368 then 5 when n < 4398046511104 then 6 when n < 562949953421312 then 7 when n < 72057594037927936 then 8 else 9 end"


@query("varint_len", f"with v as (select event_id, timestamp >> (event_id % 60)::int as n from p) select event_id, {_SEPTETS} as n_bytes from v")
def varint_len(spark, sf_dir):
    v = events(spark, sf_dir).select("event_id", F.expr("shiftright(timestamp, cast(event_id % 60 as int))").alias("n"))
    return v.select("event_id", fn.varint_length("n").alias("n_bytes"))


@query(
    "varint_bytes",
    f"""with v as (select event_id, timestamp >> (event_id % 60)::int as n from p), l as (select *, {_SEPTETS} as b from v)
    select event_id, array_to_string(list_transform(range(0, b), lambda i: printf('%02X', ((n >> (7 * i)::int) & 127) | case when i < b - 1 then 128 else 0 end)), '') as bytes, n as decoded from l""",
)
def varint_bytes(spark, sf_dir):
    v = events(spark, sf_dir).select("event_id", F.expr("shiftright(timestamp, cast(event_id % 60 as int))").alias("n"))
    coded = v.withColumn("code", fn.varint_encode("n"))
    return coded.select("event_id", F.hex("code").alias("bytes"), fn.varint_decode("code").alias("decoded"))


_CATALOG = [("metrics", "cpu"), ("metrics", "mem"), ("logs", "web"), ("_internal", "stats"), ("empty", None)]
_VALUES = ", ".join(f"('{d}', {f"'{m}'" if m else 'null'})" for d, m in _CATALOG)


def _engine(spark: SparkSession) -> Engine:
    """An engine on a fresh folder of the shared scratch space, with the catalog above."""
    engine = Engine(spark, Config(fresh_path(spark, "engine")))
    for database, measurement in _CATALOG:
        engine.create_database(database)
        if measurement:
            engine.create_measurement(database, measurement)
    return engine


@query("list_databases", f"select distinct database from (values {_VALUES}) as c(database, measurement) where not starts_with(database, '_')")
def list_databases(spark, sf_dir):
    return spark.createDataFrame([(d,) for d in _engine(spark).list_databases()], "database string")


@query("list_measurements", f"select measurement from (values {_VALUES}) as c(database, measurement) where database = 'metrics'")
def list_measurements(spark, sf_dir):
    return spark.createDataFrame([(m,) for m in _engine(spark).list_measurements("metrics")], "measurement string")


# ---- stored measurements: written, compacted, deleted from and read through the engine


def _stored(spark: SparkSession, sf_dir: str, *batches: DataFrame) -> Engine:
    engine = Engine(spark, Config(fresh_path(spark, "engine")))
    for batch in batches or (events(spark, sf_dir),):
        engine.write_frame("metrics", "events", batch, EVENTS)
    return engine


@query("stored_range", f"select {_COLUMNS} from p where timestamp >= {LO} and timestamp < {HI} and event_type = 'click'")
def stored_range(spark, sf_dir):
    return _stored(spark, sf_dir).query("metrics", "events", LO, HI, {"event_type": "click"})


@query("stored_page", f"select timestamp, event_type, usr, value from p where timestamp >= {LO} and timestamp < {HI} order by timestamp, event_id limit 25 offset 40")
def stored_page(spark, sf_dir):
    return _stored(spark, sf_dir).query("metrics", "events", LO, HI, fields=["value"], offset=40, limit=25)


@query("stored_twice", f"select {_COLUMNS} from p where event_id % 2 = 0 union all select {_COLUMNS} from p")
def stored_twice(spark, sf_dir):
    e = events(spark, sf_dir)
    return _stored(spark, sf_dir, e.where("event_id % 2 = 0"), e).query("metrics", "events", 0)


@query("stored_compacted", f"select {_COLUMNS.replace('value', 'case when event_id % 2 = 0 then -value else value end as value')} from p")
def stored_compacted(spark, sf_dir):
    e = events(spark, sf_dir)
    engine = _stored(spark, sf_dir, e.where("event_id % 2 = 0").withColumn("value", -F.col("value")), e)
    engine.compact("metrics", "events", keep="first")
    return engine.query("metrics", "events", 0)


@query("stored_levels", f"select {_COLUMNS} from p")
def stored_levels(spark, sf_dir):
    e = events(spark, sf_dir)
    engine = _stored(spark, sf_dir, *(e.where(f"event_id % 10 in ({i}, {(i + 1) % 10})") for i in range(10)))
    engine.compact_levels("metrics", "events")
    return engine.query("metrics", "events", 0)


@query("stored_deleted", f"select {_COLUMNS} from k where not (series_key = '{{\"event_type\":\"click\",\"usr\":\"7\"}}' and timestamp between {LO} and {HI})")
def stored_deleted(spark, sf_dir):
    engine = _stored(spark, sf_dir)
    engine.delete_range("metrics", "events", '{"event_type":"click","usr":"7"}', LO, HI)
    engine.compact("metrics", "events")
    return engine.query("metrics", "events", 0)


@query("stored_retention", f"select {_COLUMNS} from k where shard_start + {WEEK} >= {HI + WEEK} - {WEEK}")
def stored_retention(spark, sf_dir):
    engine = _stored(spark, sf_dir)
    engine.apply_retention("metrics", "events", now=HI + WEEK, retention=WEEK)
    return engine.query("metrics", "events", 0)


@query("stored_shards", f"select shard_start, shard_start + {WEEK} as shard_end, count(*) as n_points, min(timestamp) as min_time, max(timestamp) as max_time, count(distinct series_key) as n_series from k group by shard_start")
def stored_shards(spark, sf_dir):
    engine = _stored(spark, sf_dir)
    found = engine.refresh_shards("metrics", "events")
    return spark.createDataFrame([tuple(s[c] for c in ("start", "end", "n_points", "min_time", "max_time", "n_series")) for s in found], "shard_start long, shard_end long, n_points long, min_time long, max_time long, n_series long")


@query("health", "select true as healthy, '1.0.0' as version")
def health_query(spark, sf_dir):
    return health(spark)
