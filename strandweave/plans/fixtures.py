"""The tables of a directory as this library's relations, and the SQL (DuckDB) of the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.functions.times import epoch_seconds


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def anchors(spark: SparkSession, sf_dir: str, series: str = "user_id") -> DataFrame:
    """(series, t, o, w) from events: t in epoch seconds, o the value, w the number in props."""
    e = table(spark, sf_dir, "events")
    w = F.get_json_object("props", "$.k").cast("double")
    return e.select(F.col(series).alias("series"), epoch_seconds(F.col("ts")).alias("t"), F.col("value").alias("o"), F.coalesce(w, F.lit(0.0)).alias("w"), "event_id")


def anchors_sql(series: str = "user_id") -> str:
    return f"select {series} as series, epoch_us(ts) / 1e6 as t, value as o, coalesce(cast(json_extract_string(props, '$.k') as double), 0.0) as w, event_id from events"


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series, frame, vec) from embeddings: even vec_id is ref, odd is dub, frames numbered by vec_id."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.when(F.col("vec_id") % 2 == 0, "ref").otherwise("dub").alias("series"), F.floor(F.col("vec_id") / 2).alias("frame"), F.col("embedding").alias("vec"))


FRAMES_SQL = "select case when vec_id % 2 = 0 then 'ref' else 'dub' end as series, vec_id // 2 as frame, embedding as vec from embeddings"


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series, a, b, id) from orders and lineitem: order to ship date, in days, by line status and flag of return."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_custkey")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    day = lambda c: (epoch_seconds(F.col(c)) / 86400).alias(c)
    j = li.join(o, li.l_orderkey == o.o_orderkey).select("l_orderkey", "l_linenumber", "o_custkey", day("o_orderdate"), day("l_shipdate"))
    return j.filter("l_shipdate > o_orderdate").select(F.col("o_custkey").alias("series"), F.col("o_orderdate").alias("a"), F.col("l_shipdate").alias("b"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"))


SPANS_SQL = (
    "select o_custkey as series, epoch_us(o_orderdate) / 1e6 / 86400 as a, epoch_us(l_shipdate) / 1e6 / 86400 as b, l_orderkey * 10 + l_linenumber as id "
    "from lineitem join orders on l_orderkey = o_orderkey where l_shipdate > o_orderdate"
)


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series, i, x, y) from lineitem: by return flag, numbered by order and line; x the price, y the price less discount."""
    from strandweave.operators.windows import numbered

    li = table(spark, sf_dir, "lineitem")
    s = numbered(li, ["l_returnflag"], ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])
    return s.select(F.col("l_returnflag").alias("series"), "i", (F.col("l_extendedprice") / 1000).alias("x"), (F.col("l_extendedprice") * (1 - F.col("l_discount")) / 1000).alias("y"))


SAMPLES_SQL = (
    "select l_returnflag as series, row_number() over (partition by l_returnflag order by l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 as i, "
    "l_extendedprice / 1000 as x, l_extendedprice * (1 - l_discount) / 1000 as y from lineitem"
)


def cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series, n, start, end, payload) from conversations: a cue a turn, 10 s apart, 15 characters a second."""
    c = table(spark, sf_dir, "conversations")
    start = F.col("turn") * 10.0
    return c.select(F.col("conv_id").alias("series"), F.col("turn").alias("n"), start.alias("start"), (start + F.length("text") / 15).alias("end"), F.split("text", "\n", -1).alias("payload"))


CUES_SQL = "select conv_id as series, turn as n, turn * 10.0::double as start, turn * 10.0::double + length(text) / 15 as \"end\", string_split(text, chr(10)) as payload from conversations"

WMED_SQL = """
{name}_one as (select {keys}, {v} as v, sum({w}) as w, count(*) as n from {source} where {v} is not null group by {keys}, {v}),
{name}_cum as (select {keys}, v, sum(w) over (partition by {keys} order by v rows unbounded preceding) as cw, sum(w) over (partition by {keys}) as tw,
  sum(n) over (partition by {keys} order by v rows unbounded preceding) as cn, sum(n) over (partition by {keys}) as tn from {name}_one),
{name} as (select {keys}, case when max(tw) > 0 then min(v) filter (where cw >= tw / 2)
  else (min(v) filter (where cn >= floor((tn + 1) / 2)) + min(v) filter (where cn >= floor(tn / 2) + 1)) / 2 end as {out} from {name}_cum group by {keys})"""


def wmed_sql(name: str, source: str, keys: str, v: str, w: str, out: str) -> str:
    """Common table expressions that leave (keys, out) under name."""
    return WMED_SQL.format(name=name, source=source, keys=keys, v=v, w=w, out=out)

AE_SQL = anchors_sql("event_type")
