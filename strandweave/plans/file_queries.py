"""Queries over files, checkpoints' keys, sound blocks and records, with the SQL of each."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandweave.operators import cues as C
from strandweave.operators import sidecars
from strandweave.plans.fixtures import CUES_SQL, SAMPLES_SQL, anchors, anchors_sql, cues, table
from strandweave.plans.signal_queries import _blocks
from strandweave.plans.interval_queries import _PIECES, _pieces
from strandweave.session import scratch_path
from strandweave.sources import decode, files, store

_A = anchors_sql()


def _named(spark, sf_dir):
    """Videos e<size>.mkv and texts beside them, in folders by part."""
    p = table(spark, sf_dir, "part")
    d = F.concat(F.lit("/c/"), (F.col("p_partkey") % 10).cast("string")).alias("dir")
    e = F.concat(F.lit("e"), F.col("p_size").cast("string"))
    suffix = F.element_at(F.array(F.lit("vtt"), F.lit("ASS"), F.lit("txt")), (F.col("p_partkey") % 3 + 1).cast("int"))
    videos = p.filter("p_partkey % 2 = 0").select(d, F.concat(e, F.lit(".mkv")).alias("name")).distinct()
    texts = p.filter("p_partkey % 2 = 1").select(d, F.concat(e, F.lit(".x"), (F.col("p_partkey") % 4).cast("string"), F.lit("."), suffix).alias("name"))
    return videos, texts.unionByName(p.filter("p_partkey % 4 = 0").select(d, F.concat(e, F.lit(".en."), suffix).alias("name"))).distinct()


def a30_sidecars(spark, sf_dir):
    return files.sidecars(*_named(spark, sf_dir))


def a33_candidate_catalogues(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    root = F.concat(F.when(F.col("p_partkey") % 6 == 0, "/_").otherwise("/"), F.lit("r"), (F.col("p_partkey") % 6).cast("string"))
    f = p.select(F.concat(root, F.lit("/s"), (F.col("p_size") % 5).cast("string")).alias("dir"), F.concat(F.lit("e"), F.col("p_partkey").cast("string"), F.when(F.col("p_partkey") % 5 == 0, ".txt").otherwise(".mkv")).alias("name"))
    return files.candidate_catalogues(files.catalogue(f, p.select(F.lit("none.flac").alias("name"))))


def a9_frame_at(spark, sf_dir):
    """The last frame at or before each asked time, of each user's events as frames."""
    a = anchors(spark, sf_dir)
    asked = a.select("series").distinct().select("series", F.explode(F.expr("transform(sequence(1, 60), x -> 1704067200D + x * 43211D)")).alias("asked"))
    last = F.max(F.when(F.col("k") == 0, F.struct("t", "event_id"))).over(Window.partitionBy("series").orderBy("t", "k").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    both = a.select("series", "t", "event_id", F.lit(0).alias("k")).unionByName(asked.select("series", F.col("asked").alias("t"), F.lit(None).cast("long").alias("event_id"), F.lit(1).alias("k")))
    return both.withColumn("f", last).filter("k = 1").select("series", F.col("t").alias("asked"), F.col("f.event_id").alias("frame"))


def a21_packet_counts(spark, sf_dir):
    """Packets counted, against what is declared."""
    a = anchors(spark, sf_dir)
    return a.groupBy("series").agg(F.count(F.lit(1)).alias("packets"), (F.count(F.lit(1)) >= 0.9 * F.max("w")).alias("whole"))


def b12_mono_blocks(spark, sf_dir):
    got = decode.resampled_mono(_blocks(spark, sf_dir, 300), ["series"], 3)
    return got.select("series", "block", F.size("samples").alias("n"), F.round(F.aggregate("samples", F.lit(0.0), lambda s, x: s + x) * 1e6, 2).alias("total"))


def b20_content_keys(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", files.content_key(F.col("o_orderpriority"), F.col("o_custkey"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("crop"), F.lit("v3")).alias("key"))


def b21_summaries(spark, sf_dir):
    """Vectors as records keep them; every tenth without values."""
    e = table(spark, sf_dir, "embeddings")
    v = F.when(F.col("vec_id") % 10 == 0, F.expr("cast(array() as array<float>)")).otherwise(F.col("embedding"))
    made = F.from_json(files.summarised(v), "n int, median double")
    return e.select("vec_id", made["n"].alias("n"), F.round(made["median"], 6).alias("median"))


def f2_first_of_each_frame(spark, sf_dir):
    """Of matches with one dub frame the first, in order of frame."""
    a = anchors(spark, sf_dir).select("series", F.floor("w").cast("long").alias("dub"), "event_id")
    first = Window.partitionBy("series", "dub").orderBy("event_id")
    return a.withColumn("r", F.row_number().over(first)).filter("r = 1").drop("r")


def f5_best_anchors(spark, sf_dir):
    """Anchors by score, best first: their place."""
    a = anchors(spark, sf_dir).filter("w > 0")
    return a.select("series", "event_id", F.row_number().over(Window.partitionBy("series").orderBy(F.desc("w"), "event_id")).alias("place"))


def f7_first_existing(spark, sf_dir):
    """The first of three candidates that is there."""
    v, t = _named(spark, sf_dir)
    have = v.unionByName(t).select("dir", "name").distinct().withColumn("there", F.lit(True))
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("/c/"), (F.col("p_partkey") % 10).cast("string")).alias("dir"), F.concat(F.lit("e"), F.col("p_size").cast("string")).alias("e"))
    tried = p.select("p_partkey", "dir", F.posexplode(F.array(*(F.concat("e", F.lit(x)) for x in (".en.ASS", ".x1.vtt", ".mkv")))).alias("k", "name"))
    found = tried.join(have, ["dir", "name"]).groupBy("p_partkey").agg(F.min_by("name", "k").alias("name"))
    return p.join(found, "p_partkey", "left").select("p_partkey", F.coalesce("name", F.lit("none")).alias("name"))


def s3_write_vtt(spark, sf_dir):
    got = C.write_vtt(cues(spark, sf_dir).select("series", "n", "start", "end", "payload"), ["series"])
    return got.select("series", F.length("text").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("digest"))


def _sidecars(spark, sf_dir):
    """A file a conversation, a cue a turn; of some the header is lost, the suffix unknown, or the end cut in the middle of a letter."""
    c = cues(spark, sf_dir).withColumn("payload", F.array(F.when(F.col("n") % 4 == 2, "<b></b>").otherwise(F.concat(F.lit("é turn "), F.col("n").cast("string")))))
    c = c.withColumn("settings", F.when(F.col("n") % 2 == 0, "align:left").otherwise(""))
    docs = C.write_vtt(c.select("series", "n", "start", "end", "payload", "settings"), ["series"])
    k = F.col("series") % 7
    text = F.when(k == 1, F.regexp_replace("text", "WEBVTT", "")).otherwise(F.col("text")).cast("binary")
    content = F.when(k == 2, F.concat(text, F.unhex(F.lit("C3")))).otherwise(text)
    return docs.select("series", F.concat(F.lit("d"), F.col("series").cast("string")).alias("doc"), F.when(k == 3, "txt").when(k == 4, "VTT").otherwise("vtt").alias("suffix"), content.alias("content"))


def s13_report(spark, sf_dir):
    videos = cues(spark, sf_dir).select("series").distinct().select("series", F.lit(0.5).alias("start"), F.lit(60.0).alias("length"))
    _, report = sidecars.transferred(_sidecars(spark, sf_dir), _pieces(spark, sf_dir), videos, ["series"], 1 / 24)
    return report


def _levels_of(keys):
    """What a store computes for users: the mean of each of their event types, from the events that it is given with the key."""
    return keys.select("key", F.explode("events").alias("e")).groupBy("key", F.col("e.event_type").alias("kind")).agg(F.round(F.avg("e.o"), 6).alias("level"), F.count(F.lit(1)).alias("n"))


def a39_loaded_or_computed(spark, sf_dir):
    """Users' levels from a store that knows every other user, some of them by an older stamp, before all are asked for."""
    path = scratch_path(spark, "a39")
    a = anchors(spark, sf_dir).join(table(spark, sf_dir, "events").select("event_id", "event_type"), "event_id")
    users = a.groupBy(F.col("series").alias("key")).agg(F.count(F.lit(1)).alias("stamp"))
    own = a.select(F.col("series").alias("key"), F.struct("event_type", "o").alias("e"))
    compute = lambda keys: _levels_of(own.join(keys.select("key"), "key", "left_semi").groupBy("key").agg(F.collect_list("e").alias("events")))
    store.load_or_compute(users.filter("key % 2 = 0").withColumn("stamp", F.when(F.col("key") % 3 == 0, 0).otherwise(F.col("stamp")).cast("long")), path, compute)
    return store.load_or_compute(users, path, compute)


def s4_published_map(spark, sf_dir):
    """A time map published twice; the second version is what readers get."""
    path = scratch_path(spark, "s4")
    pieces = _pieces(spark, sf_dir)
    store.publish(pieces.filter("t0 < 10"), path)
    store.publish(pieces, path)
    return store.published(spark, path).select("series", "t0", "t1", F.round("x0", 6).alias("x0"), F.round("x1", 6).alias("x1"))


_MS = "cast(round_even({c} * 1000, 0) as bigint)"
_STAMP = "lpad(cast({ms} // 3600000 as varchar), 2, '0') || ':' || lpad(cast({ms} // 60000 % 60 as varchar), 2, '0') || ':' || lpad(cast({ms} // 1000 % 60 as varchar), 2, '0') || '.' || lpad(cast({ms} % 1000 as varchar), 3, '0')"
_FILES = """v as (select distinct '/c/' || (p_partkey % 10) as dir, 'e' || p_size || '.mkv' as name from part where p_partkey % 2 = 0),
x as (select *, ['vtt', 'ASS', 'txt'][p_partkey % 3 + 1] as suffix, '/c/' || (p_partkey % 10) as dir from part),
t as (select dir, 'e' || p_size || '.x' || (p_partkey % 4) || '.' || suffix as name from x where p_partkey % 2 = 1 union select dir, 'e' || p_size || '.en.' || suffix from x where p_partkey % 4 = 0)"""
ORACLES = {
    "a30_sidecars": f"with {_FILES} select v.dir, v.name as video, t.name from v join t on t.dir = v.dir and starts_with(t.name, regexp_replace(v.name, '\\.mkv$', '') || '.') where t.name like '%.vtt' or t.name like '%.ASS'",
    "a33_candidate_catalogues": """with f as (select '/' || case when p_partkey % 6 = 0 then '_' else '' end || 'r' || (p_partkey % 6) as root, '/s' || (p_size % 5) as sub from part where p_partkey % 5 <> 0)
select root, root[2:] as name, count(distinct sub) as series, count(*) as videos from f where root not like '/\\_%' escape '\\' group by root""",
    "a9_frame_at": f"""with a as ({_A}), q as (select series, 1704067200 + x * 43211.0::double as asked from (select distinct series from a), (select unnest(generate_series(1, 60)) as x))
select q.series, q.asked, (select arg_max(event_id, t) from a where a.series = q.series and a.t <= q.asked) as frame from q""",
    "a21_packet_counts": f"select series, count(*) as packets, count(*) >= 0.9 * max(w) as whole from ({_A}) group by series",
    "b12_mono_blocks": f"""with s as (select series, i // 300 as block, (i % 300) // 3 as k, avg(x) / 32768 as v, count(*) as c from ({SAMPLES_SQL}) group by series, i // 300, (i % 300) // 3)
select series, block, count(*)::int as n, round(sum(v) * 1e6, 2) as total from s where c = 3 group by series, block""",
    "b20_content_keys": "select o_orderkey, o_orderpriority || '|' || o_custkey || '|' || strftime(o_orderdate, '%Y%m%d') || '|crop|v3' as key from orders",
    "b21_summaries": "select vec_id, case when vec_id % 10 = 0 then 0 else len(embedding) end::int as n, case when vec_id % 10 = 0 then null else round(list_aggregate(list_transform(embedding, lambda x: x::double), 'median'), 6) end as median from embeddings",
    "f2_first_of_each_frame": f"select series, cast(floor(w) as bigint) as dub, min(event_id) as event_id from ({_A}) group by series, floor(w)",
    "f5_best_anchors": f"select series, event_id, row_number() over (partition by series order by w desc, event_id)::int as place from ({_A}) where w > 0",
    "f7_first_existing": f"""with {_FILES}, h as (select dir, name from v union select dir, name from t), p as (select p_partkey, '/c/' || (p_partkey % 10) as dir, 'e' || p_size as e from part)
select p_partkey, coalesce((select min(h.name) from h where h.dir = p.dir and h.name = e || '.en.ASS'), (select min(h.name) from h where h.dir = p.dir and h.name = e || '.x1.vtt'), (select min(h.name) from h where h.dir = p.dir and h.name = e || '.mkv'), 'none') as name from p""",
    "s3_write_vtt": f"""with b as (select series, n, {_STAMP.format(ms=_MS.format(c="start"))} || ' --> ' || {_STAMP.format(ms=_MS.format(c='"end"'))} || chr(10) || array_to_string(payload, chr(10)) || chr(10) as b from ({CUES_SQL})),
d as (select series, 'WEBVTT' || chr(10) || chr(10) || string_agg(b, chr(10) order by n) as d from b group by series) select series, length(d)::int as n_chars, md5(d) as digest from d""",
    "a39_loaded_or_computed": f"select user_id as key, event_type as kind, round(avg(value), 6) as level, count(*) as n from events group by user_id, event_type",
    "s4_published_map": f"select series, t0, t1, round(x0, 6) as x0, round(x1, 6) as x1 from {_PIECES}",
    "s13_report": f"""with c as (select *, series % 7 as k from ({CUES_SQL})), p as (select * from {_PIECES}),
q as (select series, n, greatest(0, start - 0.5) as s, least(60.0::double, "end" - 0.5) as e from c where n % 4 <> 2 and k not in (1, 2, 3)),
m as (select q.series, n, t0 + (greatest(x0, s) - x0) * (t1 - t0) / (x1 - x0) as pa, t0 + (least(x1, e) - x0) * (t1 - t0) / (x1 - x0) as pb from q join p on p.series = q.series and x0 < e and x1 > s where e > s),
r as (select *, max(pb) over (partition by series, n order by pa, pb rows between unbounded preceding and 1 preceding) as reach from m),
z as (select *, sum(case when reach is null or pa - reach > 1e-6 then 1 else 0 end) over (partition by series, n order by pa, pb rows unbounded preceding) as run from r),
f as (select series, count(*) as cues_out from (select series, n from z group by series, n, run having max(pb) - min(pa) >= 1.0::double / 24) group by series)
select c.series, 'd' || c.series as doc, max(case k when 1 then 'no WEBVTT header' when 2 then 'not text in its encoding' when 3 then 'no reader for .txt' end) as error,
  count(*) filter (where k not in (1, 2, 3)) as cues_in, coalesce(max(cues_out), 0) as cues_out, 0 as dropped_drawings, count(*) filter (where k not in (1, 2, 3) and n % 4 = 2) as dropped_empty, 0 as dropped_duplicates,
  count(*) filter (where k not in (1, 2, 3) and n % 2 = 0) as dropped_settings from c left join f on f.series = c.series group by c.series""",
}
QUERIES = {k: globals()[k] for k in ORACLES}
