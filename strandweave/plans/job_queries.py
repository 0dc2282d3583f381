"""Queries over job logs, progress and queues, in batch and as streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandweave.functions.times import epoch_seconds
from strandweave.operators import jobs as J
from strandweave.plans.fixtures import anchors, anchors_sql, table
from strandweave.streaming.runs import as_stream, drained, in_turn

#: Commands for the kinds of events of the test table, and the same in SQL.
COMMANDS = {"signup": "enqueue", "view": "run", "click": "pause", "error": "cancel", "purchase": "retry"}
_COMMAND = "case event_type when 'signup' then 'enqueue' when 'view' then 'run' when 'click' then 'pause' when 'error' then 'cancel' when 'purchase' then 'retry' end"
AU = anchors_sql()


def _log(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    pairs = F.create_map(*(F.lit(x) for p in COMMANDS.items() for x in p))
    return e.select(F.col("user_id").alias("job"), F.col("event_id").alias("seq"), F.element_at(pairs, F.col("event_type")).alias("command"), epoch_seconds(F.col("ts")).alias("t"))


def _ordered(spark, sf_dir):
    """The log with seq counting from 0 in order of time within each job."""
    order = Window.partitionBy("job").orderBy("t", "seq")
    return _log(spark, sf_dir).select("job", (F.row_number().over(order) - 1).cast("long").alias("seq"), "command", "t")


def k1_job_states(spark, sf_dir):
    return J.states(_ordered(spark, sf_dir), ["job"])


def k2_admitted(spark, sf_dir):
    """Jobs let in two at a time by event type."""
    a = anchors(spark, sf_dir, "event_type").select("series", F.col("t").alias("came"), F.col("event_id").alias("job"), (F.col("w") * 60).alias("lasts"))
    got = J.admitted(a, ["series"], 2)
    return got.select("series", "job", F.round("began", 3).alias("began"), F.round("ended", 3).alias("ended"))


def k2_next_queued(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return J.admission_order(o.select("o_custkey", F.col("o_orderkey").alias("seq"), F.when(F.col("o_orderstatus") == "O", "queued").otherwise("done").alias("state")), ["o_custkey"]).select("o_custkey", "seq")


def k3_current_run_only(spark, sf_dir):
    log = _ordered(spark, sf_dir).withColumn("run", F.floor(F.col("seq") / 10) - F.when(F.col("seq") % 4 == 3, 1).otherwise(0))
    return J.current_run_only(log, ["job"]).select("job", "seq", "run")


def k4_overall_progress(spark, sf_dir):
    r = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("stage"), (F.col("r_regionkey") * 0.2).alias("low"), (F.col("r_regionkey") * 0.2 + 0.2).alias("high"))
    e = anchors(spark, sf_dir).select("event_id", (F.col("event_id") % 5).cast("int").alias("stage"), (F.col("w") / 90).alias("pct"))
    return J.overall_progress(e, r).select("event_id", F.round("overall", 6).alias("overall"))


def k4_monotone_progress(spark, sf_dir):
    e = anchors(spark, sf_dir).select("series", (F.col("event_id") % 2).alias("stage"), "t", F.col("event_id").alias("seq"), (F.col("w") / 100).alias("pct"))
    return J.monotone_progress(e, ["series"]).select("seq", "pct")


def k5_operations(spark, sf_dir):
    log = _ordered(spark, sf_dir).withColumn("state", F.col("command"))
    got = J.operations(log, ["job"])
    return got.select("job", "state", F.round("began", 3).alias("began"), F.round("seconds", 3).alias("seconds"))


def k6_throttled(spark, sf_dir):
    e = J.monotone_progress(anchors(spark, sf_dir).select("series", F.lit(0).alias("stage"), "t", F.col("event_id").alias("seq"), (F.col("w") / 99).alias("pct")), ["series"])
    return J.throttled(e, ["series"], 0.05, 86_400.0).select("series", F.round("t", 3).alias("t"), F.round("pct", 6).alias("pct"))


def k7_lost_runs(spark, sf_dir):
    runs = table(spark, sf_dir, "customer").select("c_custkey")
    out = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min("o_orderstatus").alias("outcome")).filter("c_custkey % 3 <> 0")
    return J.lost_runs(runs, out, ["c_custkey"])


def k9_remaining(spark, sf_dir):
    ops = anchors(spark, sf_dir).select("series", (F.col("event_id") % 5).cast("int").alias("op"), F.lit(100.0).alias("amount"), F.when(F.col("event_id") % 2 == 0, F.col("w")).otherwise(0.0).alias("done"), F.col("o").alias("spent"))
    rates = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("op"), (F.col("r_regionkey") + 0.5).alias("cost"))
    return J.remaining(ops, rates, ["series"]).select("series", F.round("seconds", 2).alias("seconds"))


def k12_trace(spark, sf_dir):
    a = anchors(spark, sf_dir).select("series", "t", F.when(F.col("w") > 50, "decide").otherwise("note").alias("kind"), F.col("event_id").cast("string").alias("name"), F.lit("audio").alias("state"), F.when(F.col("w") > 50, "yes").alias("verdict"))
    return J.trace(a, ["series"]).select("series", "seq", F.round("t", 3).alias("t"), "kind", "name", "verdict")


def k13_sub_ranges(spark, sf_dir):
    """Reports of sub-ranges brought to their parent's range, never falling back."""
    a = anchors(spark, sf_dir).select("series", "t", "event_id", (F.floor(F.col("event_id") % 4) * 0.25 + F.col("w") / 100 * 0.25).alias("pct"))
    order = Window.partitionBy("series").orderBy("t", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return a.select("event_id", F.round(F.max("pct").over(order), 6).alias("pct"))


def k1_streamed_states(spark, sf_dir):
    """The last state of each job, from the stream's changes."""
    from strandweave.streaming import jobs

    changes = drained(jobs.state_changes(as_stream(_ordered(spark, sf_dir).select("job", "seq", "command"))), "states")
    last = changes.groupBy("job").agg(F.max_by("state", "seq").alias("state"), F.count(F.lit(1)).cast("int").alias("changes"))
    every = table(spark, sf_dir, "events").select(F.col("user_id").alias("job")).distinct()
    return every.join(last, "job", "left").select("job", F.coalesce("state", F.lit("none")).alias("state"), F.coalesce("changes", F.lit(0)).alias("changes"))


def _in_time(e, late):
    """Events (series, ts, ...) in five parts by time, then those for which late says so and that are older than the end by twelve days, then one far beyond it that lets the watermark pass all."""
    day = F.floor(F.unix_seconds("ts") / 86400) - 19723
    behind = late & (day < 18)
    at = F.least(F.floor(day / 6), F.lit(4))
    end = e.limit(1).withColumn("ts", F.timestamp_seconds(F.lit(1893456000))).withColumn("series", F.lit("end").try_cast(e.schema["series"].dataType))
    return in_turn([*(e.filter(~behind & (at == k)) for k in range(5)), e.filter(behind), end])


def k_streamed_window_levels(spark, sf_dir):
    """Daily levels as their windows close; a fiftieth of the events comes after that, and goes."""
    from strandweave.streaming import series

    e = anchors(spark, sf_dir, "event_type").select("series", F.timestamp_micros((F.col("t") * 1e6).cast("long")).alias("ts"), "o", "w", "event_id")
    got = drained(series.window_levels(_in_time(e, F.col("event_id") % 50 == 0), ["series"], late="1 hour"), "levels")
    return got.filter("series <> 'end'").select("series", F.unix_seconds("start").alias("start"), "n", F.round("weight", 3).alias("weight"), F.round("mean", 4).alias("mean"))


def k_streamed_sessions(spark, sf_dir):
    """Sessions of users as they close; events come in order."""
    from strandweave.streaming import series

    e = anchors(spark, sf_dir).select("series", F.timestamp_micros((F.col("t") * 1e6).cast("long")).alias("ts"), F.col("o").alias("v"))
    got = drained(series.sessions(_in_time(e, F.lit(False)), ["series"], "12 hours", late="1 hour"), "sessions")
    return got.filter("series is not null").select("series", F.round(F.unix_micros("start") / 1e6, 3).alias("start"), F.round(F.unix_micros("end") / 1e6, 3).alias("end"), "n")


def k13_shared_throttle(spark, sf_dir):
    """Reports of four parts of each user's job through one throttle of a day and a twentieth, as a stream; a fiftieth of them comes late, another is repeated."""
    from strandweave.streaming import jobs

    a = anchors(spark, sf_dir).select("series", F.timestamp_micros((F.col("t") * 1e6).cast("long")).alias("ts"), F.col("event_id").alias("seq"), F.floor(F.col("event_id") % 4).alias("part"), F.lit(4).alias("n_parts"), (F.col("w") / 100).alias("pct"))
    again = a.filter("seq % 50 = 1")
    stream = _in_time(a.unionByName(again), F.col("seq") % 50 == 0).withWatermark("ts", "1 hour")
    got = drained(jobs.shared_throttle(stream, "series", 0.05, 86400.0), "throttle")
    return got.filter("series is not null").select("series", F.round(F.unix_micros("ts") / 1e6, 3).alias("t"), F.round("pct", 6).alias("pct"))


_ORD = f"select user_id as job, row_number() over (partition by user_id order by epoch_us(ts), event_id) - 1 as seq, {_COMMAND} as command, epoch_us(ts) / 1e6 as t, event_id from events"
_STATE = "case " + " ".join(f"when s.state = '{a}' and n.command = '{c}' then '{b}'" for (a, c), b in J.TRANSITIONS.items()) + " else s.state end"
_MOVES = "(s.state, n.command) in (" + ", ".join(f"('{a}', '{c}')" for a, c in J.TRANSITIONS) + ")"
_FOLD = f"""with recursive n as (select * from ({_ORD})), s as (select job, -1::bigint as seq, 'none' as state, 0 as changes from (select distinct job from n)
union all select s.job, n.seq, {_STATE}, s.changes + case when {_MOVES} then 1 else 0 end from s join n on n.job = s.job and n.seq = s.seq + 1)
select job, arg_max(state, seq) as state, max(changes) as changes from s group by job"""
ORACLES = {
    "k1_job_states": _FOLD,
    "k1_streamed_states": _FOLD,
    "k2_next_queued": "select o_custkey, min(o_orderkey) as seq from orders where o_orderstatus = 'O' group by o_custkey",
    "k3_current_run_only": f"with l as (select job, seq, seq // 10 - case when seq % 4 = 3 then 1 else 0 end as run from ({_ORD})), m as (select *, max(run) over (partition by job order by seq rows unbounded preceding) as now from l) select job, seq, run from m where run = now",
    "k4_overall_progress": f"select event_id, round(least(0.999, (event_id % 5) * 0.2::double + ((event_id % 5) * 0.2::double + 0.2 - (event_id % 5) * 0.2::double) * greatest(0, least(1, w / 90))), 6) as overall from ({AU})",
    "k4_monotone_progress": f"select event_id as seq, max(w / 100) over (partition by series, event_id % 2 order by t, event_id rows unbounded preceding) as pct from ({AU})",
    "k5_operations": f"""with l as (select *, lag(command) over (partition by job order by t, event_id) as was from ({_ORD})), n as (select * from l where was is null or was <> command)
select job, command as state, round(t, 3) as began, round(lead(t) over (partition by job order by t, event_id) - t, 3) as seconds from n""",
    "k7_lost_runs": "with o as (select o_custkey, min(o_orderstatus) as outcome from orders where o_custkey % 3 <> 0 group by o_custkey) select c_custkey, coalesce(outcome, 'failed') as outcome from customer left join o on o_custkey = c_custkey",
    "k9_remaining": f"""select series, round(sum((100 - case when event_id % 2 = 0 then w else 0 end) * case when event_id % 2 = 0 and w > 0 then o / w else event_id % 5 + 0.5::double end), 2) as seconds from ({AU}) group by series""",
    "k12_trace": f"""select series, row_number() over (partition by series order by t, cast(event_id as varchar)) - 1 as seq, round(t - min(t) over (partition by series), 3) as t, case when w > 50 then 'decide' else 'note' end as kind, cast(event_id as varchar) as name, case when w > 50 then 'yes' end as verdict from ({AU})""",
    "k13_sub_ranges": f"select event_id, round(max((event_id % 4) * 0.25 + w / 100 * 0.25) over (partition by series order by t, event_id rows unbounded preceding), 6) as pct from ({AU})",
    "k_streamed_window_levels": f"select series, cast(floor(t / 86400) as bigint) * 86400 as start, count(*) as n, round(sum(w), 3) as weight, round(sum(o * w) / sum(w), 4) as mean from ({anchors_sql('event_type')}) where not (event_id % 50 = 0 and cast(floor(t / 86400) as bigint) - 19723 < 18) group by series, floor(t / 86400)",
    "k13_shared_throttle": f"""with recursive e as (select series, t, max(((event_id % 4) + w / 100) / 4) over (partition by series order by t, event_id rows unbounded preceding) as pct, row_number() over (partition by series order by t, event_id) as i
from ({AU}) where not (event_id % 50 = 0 and cast(floor(t / 86400) as bigint) - 19723 < 18)),
s as (select series, i, t as lt, pct as lp, true as k from e where i = 1 union all
select series, i, case when k then t else lt end, case when k then pct else lp end, k from (select e.*, s.lt, s.lp, (e.pct >= 1 and s.lp < 1) or (e.pct - s.lp >= 0.05 and e.t - s.lt >= 86400) as k from s join e on e.series = s.series and e.i = s.i + 1))
select series, round(lt, 3) as t, round(lp, 6) as pct from s where k""",
    "k_streamed_sessions": f"""with a as (select series, t, case when t - lag(t) over (partition by series order by t) >= 43200 then 1 else 0 end as new from ({AU})), r as (select series, t, sum(new) over (partition by series order by t rows unbounded preceding) as run from a)
select series, round(min(t), 3) as start, round(max(t) + 43200, 3) as "end", count(*) as n from r group by series, run""",
}
QUERIES = {k: globals()[k] for k in (*ORACLES, "k2_admitted", "k6_throttled")}
