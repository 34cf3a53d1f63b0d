"""Queries on `events`, `conversations` and the star schema: filters, log analytics, retention, hash chains, tables, streams, relational breadth."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heron.functions import filters, privacy
from heron.operators import logs
from heron.operators.ranges import lagged, median
from heron.operators.staging import shared_dir
from heron.plans.tables import table
from heron.sources import collections
from heron.streaming import answers, turns, voice, windows


def _events(spark, d) -> DataFrame:
    return table(spark, d, "events")


def _typed(spark, d) -> DataFrame:
    """Events with their props as VARIANT; a third has an explicit null, a third no key `x`."""
    extra = F.when(F.col("event_id") % 3 == 0, F.lit('{"x": null, "k": ')).when(F.col("event_id") % 3 == 1, F.lit('{"k": ')).otherwise(F.lit('{"x": "a", "k": '))
    return _events(spark, d).withColumn("meta", F.parse_json(F.concat(extra, F.get_json_object("props", "$.k"), F.lit("}"))))


def _filter(wanted: dict, column: str | None = None):
    def run(spark, d):
        rows = _typed(spark, d) if column else _events(spark, d)
        return filters.apply_filter(rows, wanted, column).select("event_id")

    return run


FILTERS = {
    "filter_equals": ({"event_type": "click"}, None, "event_type = 'click'"),
    "filter_in": ({"event_type": {"$in": ["click", "view"]}}, None, "event_type IN ('click', 'view')"),
    "filter_nin": ({"event_type": {"$nin": ["click", "view"]}}, None, "coalesce(event_type NOT IN ('click', 'view'), true)"),
    "filter_gt": ({"value": {"$gt": 100}}, None, "value > 100 AND NOT isnan(value)"),
    "filter_gte_lt": ({"value": {"$gte": 50, "$lt": 75.5}}, None, "value >= 50 AND value < 75.5"),
    "filter_lte": ({"k": {"$lte": 10}}, "meta", "CAST(json_extract(props, '$.k') AS DOUBLE) <= 10"),
    "filter_ne": ({"x": {"$ne": "a"}}, "meta", "event_id % 3 != 2"),
    "filter_exists": ({"x": {"$exists": True}}, "meta", "event_id % 3 != 1"),
    "filter_null": ({"x": None}, "meta", "event_id % 3 = 0"),
    "filter_and": ({"event_type": "click", "value": {"$gt": 10}, "user_id": {"$in": [1, 2, 3, 5, 8, 13]}}, None, "event_type = 'click' AND value > 10 AND user_id IN (1, 2, 3, 5, 8, 13)"),
}


def _log(rows: DataFrame) -> DataFrame:
    """Events as a request log: errors failed, the rest completed; value stands for sizes and durations."""
    return rows.withColumns({"state": F.when(F.col("event_type") == "error", "failed").otherwise("completed"), "received": F.round(F.col("value") * 100), "sent": F.round(F.col("value") * 10), "duration": F.round(F.col("value"))})


def log_stats(spark, d):
    s = logs.log_stats(_log(_events(spark, d)), F.col("state"), F.col("received"), F.col("sent"), F.col("duration"))
    return s.withColumn("speed", F.round("speed", 6))


def log_sets(spark, d):
    return logs.breakdowns(_log(_events(spark, d)), [["event_type"], ["state"], []], n=F.count("*"), received=F.sum("received"))


def log_page(spark, d):
    """Filter, order, offset and limit."""
    rows = _events(spark, d).where(F.col("event_type").rlike("^(c|v)") & (F.col("ts") >= F.lit("2024-01-02").cast("timestamp")))
    return rows.orderBy("event_id").offset(20).limit(50).select("event_id", "event_type")


def last_minute(spark, d):
    return logs.last_minute(_events(spark, d), "ts")


def rate_limit(spark, d):
    r = logs.rate_limited(_events(spark, d), "ts", 3, 3_600_000, "user_id")
    return r.select("event_id", F.col("n_recent"), "allowed")


def sessions(spark, d):
    return logs.sessions(_events(spark, d), "user_id", "ts", 1_800_000).withColumn("session", F.col("session").cast("long"))


def tumbling(spark, d):
    w = windows.rates(_events(spark, d), "ts", "1 hour", None, "10 minutes", "event_type")
    return w.select(logs.millis(F.col("start")).alias("start_ms"), "event_type", "n")


def sliding(spark, d):
    w = windows.rates(_events(spark, d), "ts", "1 hour", "30 minutes")
    return w.select(logs.millis(F.col("start")).alias("start_ms"), "n")


def session_windows(spark, d):
    s = windows.sessions(_events(spark, d), "user_id", "ts")
    return s.select("key", logs.millis(F.col("start")).alias("start_ms"), "n")


def _frames(rows: DataFrame) -> DataFrame:
    """Events of a user as frames 100 ms apart in the order of their ids, loud in runs."""
    at = (F.col("event_id") * 100).alias("at")
    return rows.select((F.col("user_id") % 7).alias("stream"), at, F.when(F.floor(F.col("event_id") / 97) % 2 == 0, F.lit(-20.0)).otherwise(F.lit(-60.0)).alias("level"))


def voice_batch(spark, d):
    return logs.voice_activity(_frames(_events(spark, d)), "stream", "at", "level")


def voice_stream(spark, d):
    """The same from the keyed state machine over a stream of the table's folder, read to its end."""
    shared = shared_dir(spark)
    source = spark.readStream.schema(_events(spark, d).schema).option("pathGlobFilter", "events.parquet").parquet(d)
    out = f"voice-{uuid.uuid4().hex}"
    q = voice.voice_activity(_frames(source), "stream", "at", "level").writeStream.format("parquet").option("checkpointLocation", f"{shared}/{out}-log").option("path", f"{shared}/{out}").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema("key long, at long, kind string, level double").parquet(f"{shared}/{out}")


#: Five seconds at most to an utterance, as the events' loud runs last ten.
_HEARD = turns.Listening(cap_ms=5000)
_TURN_EVENTS = ["start", "utterance", "response", "spoken", "utterance", "speech", "response", "spoken", "error", "stop", "interrupt"]


def _spoken(rows: DataFrame) -> DataFrame:
    level = F.when(F.floor(F.col("event_id") / 97) % 2 == 0, -20.0 - F.col("event_id") % 5).otherwise(F.lit(-60.0))
    return rows.select((F.col("user_id") % 7).alias("stream"), F.timestamp_millis(F.col("event_id") * 100 + 1000).alias("at"), level.alias("level"))


def _streamed(spark, d, apply) -> DataFrame:
    """The rows of a query with keyed states over a stream of the events, read to its end."""
    out = f"{shared_dir(spark)}/turns-{uuid.uuid4().hex}"
    found = apply(spark.readStream.schema(_events(spark, d).schema).option("pathGlobFilter", "events.parquet").parquet(d))
    with turns.state_store(spark):
        found.writeStream.format("parquet").option("checkpointLocation", f"{out}-log").option("path", out).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(found.schema).parquet(out)


def _shown(rows: DataFrame) -> DataFrame:
    return rows.withColumn("level", F.round("level", 6))


def utterance_rows(spark, d):
    return _shown(turns.utterances_of(_spoken(_events(spark, d)), "stream", "at", "level", _HEARD))


def utterance_stream(spark, d):
    return _shown(_streamed(spark, d, lambda rows: turns.utterances(_spoken(rows), "stream", "at", "level", _HEARD)))


def turn_stream(spark, d):
    """Moves of seven conversations; a plan that has no response after ten seconds has failed."""
    event = F.element_at(F.array(*[F.lit(x) for x in _TURN_EVENTS]), (F.col("event_id") * 5 % len(_TURN_EVENTS)).cast("int") + 1)
    at = F.timestamp_millis(F.col("event_id") * 1000 + 1000)
    return _streamed(spark, d, lambda rows: turns.turns(rows.select((F.col("user_id") % 7).alias("key"), at.alias("at"), "event_id", event.alias("event")), "key", "at", "event_id", "event", 10_000))


def cache_stream(spark, d):
    """Prompts of three models, a second apart, looked up and stored in one pass; an entry lives for a minute."""
    angle = F.col("event_id") * 37 % 360
    vector = F.array(F.cos(F.radians(angle)), F.sin(F.radians(angle)))
    asked = lambda rows: rows.select((F.col("user_id") % 3).alias("model"), F.timestamp_millis(F.col("event_id") * 1000 + 1000).alias("at"), "event_id", F.concat("event_type", F.lit(" "), (F.col("user_id") % 40).cast("string")).alias("prompt"), vector.alias("vector"))
    found = _streamed(spark, d, lambda rows: answers.cached(asked(rows), "model", "at", "event_id", "prompt", "vector", 0.9995, 60_000))
    return found.select("key", "prompt_id", "kind", "entry_id", F.round("score", 6).alias("score"), "entries")


def lru_eviction(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("n_chars").alias("bytes"), ((F.col("doc_id") * 7919) % 100_003).alias("used"))
    return logs.evicted_all(docs, "bytes", "used", "doc_id", 100_000).select("doc_id", "freed_before")


def lru_by_source(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", F.col("n_chars").alias("bytes"), ((F.col("doc_id") * 7919) % 100_003).alias("used"))
    active = docs.where("doc_id % 10 = 0").select("doc_id")
    return logs.evicted(docs, "source", "bytes", "used", "doc_id", 20_000, active).select("doc_id", "source", "freed_before")


def cleanup_age(spark, d):
    return logs.expired(_events(spark, d), "ts", "event_id", cutoff_ms=1_704_672_000_000, keep_least=100).select("event_id")


def cleanup_usage(spark, d):
    return logs.expired(_events(spark, d), "ts", "event_id", usage_percent=80, keep_least=100).select("event_id")


def truncate(spark, d):
    t = logs.truncated(table(spark, d, "conversations"), "conv_id", "turn", "text", 512, 100)
    return t.select("conv_id", "turn", "used")


def repeats(spark, d):
    return logs.repeated_runs(_events(spark, d), "user_id", "event_id", "event_type")


def ring(spark, d):
    return logs.newest(_events(spark, d), "user_id", [F.desc("ts"), F.desc("event_id")], 5).select("event_id", "user_id")


def _chain(rows: DataFrame) -> DataFrame:
    """A chain for each user, whose entries hold the content hash of the entry before; every 501st entry is tampered with."""
    body = F.concat_ws("|", F.col("event_id").cast("string"), "event_type", "props")
    own = F.sha2(body, 256)
    return rows.select("user_id", "event_id", "event_type", "props", body.alias("body"), own.alias("own"), F.lag(own).over(Window.partitionBy("user_id").orderBy("event_id")).alias("previous")).withColumn("body", F.when(F.col("event_id") % 501 == 500, F.concat("body", F.lit("!"))).otherwise(F.col("body")))


def audit_global(spark, d):
    """One chain over all events, each 401st entry of which was written anew, so that the one after it does not fit."""
    rows = _events(spark, d).select("event_id", F.concat_ws("|", F.col("event_id").cast("string"), "event_type").alias("body"))
    linked = lagged(rows.withColumn("own", F.sha2("body", 256)), "own", "previous", None, "event_id")
    changed = linked.withColumn("own", F.when(F.col("event_id") % 401 == 400, F.sha2(F.concat("body", F.lit("!")), 256)).otherwise(F.col("own")))
    v = logs.chain_verdict(changed, "event_id", "previous", "own", F.sha2(F.when(F.col("event_id") % 401 == 400, F.concat("body", F.lit("!"))).otherwise(F.col("body")), 256))
    return v.select("checked", F.col("broken_at").alias("broken_at"), "reason")


def audit_chain(spark, d):
    v = logs.chain_verdict(_chain(_events(spark, d)), "event_id", "previous", "own", F.sha2("body", 256), "user_id")
    return v.withColumnRenamed("key", "user_id")


def compacted(spark, d):
    """Events as a change log of users: the last one counts, errors delete."""
    c = _events(spark, d).select("user_id", "event_id", "event_type", "value")
    return logs.compacted(c, "user_id", "event_id", "event_type", "error").select("user_id", "event_id", "event_type", "value")


def budget(spark, d):
    spends = _events(spark, d).select("user_id", "event_id", (F.round(F.col("value")) / 64).alias("epsilon"))
    return privacy.budgeted(spends, "user_id", "event_id", "epsilon", 10.0).select("event_id", "spent", "allowed")


def _table(spark, d) -> DataFrame:
    return table(spark, d, "documents").select(F.col("lang").alias("collection_id"), F.col("doc_id").alias("id"), F.col("source").alias("note"), F.lit(0).alias("version"))


def upsert(spark, d):
    t = _table(spark, d)
    changes = t.where("id % 5 = 0").withColumn("version", F.lit(1)).unionByName(t.where("id % 10 = 0").withColumn("version", F.lit(2))).unionByName(t.where("id % 50 = 0").withColumns({"id": F.col("id") + 1_000_000, "version": F.lit(3)}))
    return collections.upserted(t, changes, "version")


def update(spark, d):
    t = _table(spark, d)
    return collections.updated(t, t.where("id % 4 = 0").select("collection_id", "id", F.concat("note", F.lit("!")).alias("note")))


def delete(spark, d):
    t = _table(spark, d)
    return collections.deleted(t, t.where("id % 3 = 0")).select("collection_id", "id")


def delete_where(spark, d):
    return collections.deleted_where(_table(spark, d), F.col("note") == "src0")[1]


def collection_stats(spark, d):
    e = table(spark, d, "embeddings").select(F.col("label").alias("collection_id"), F.col("embedding").alias("vector"))
    return collections.stats(e)


# ---- the star schema ------------------------------------------------------------------------------------------------


def pricing(spark, d):
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    li = table(spark, d, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    r = lambda c, n: F.round(c, 2).alias(n)
    return li.groupBy("l_returnflag", "l_linestatus").agg(r(F.sum("l_quantity"), "sum_qty"), r(F.sum("l_extendedprice"), "sum_base"), r(F.sum(price), "sum_disc"), r(F.sum(price * (1 + F.col("l_tax"))), "sum_charge"), r(F.avg("l_quantity"), "avg_qty"), F.count("*").alias("n"))


def shipping(spark, d):
    c, o, li = (table(spark, d, t) for t in ("customer", "orders", "lineitem"))
    day = F.lit("1998-03-15").cast("timestamp")
    j = c.where("c_mktsegment = 'BUILDING'").join(o.where(F.col("o_orderdate") < day), F.col("c_custkey") == F.col("o_custkey")).join(li.where(F.col("l_shipdate") > day), F.col("l_orderkey") == F.col("o_orderkey"))
    return j.groupBy("l_orderkey", "o_orderdate").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue")).orderBy(F.desc("revenue"), "l_orderkey").limit(10).select("l_orderkey", "revenue")


def nations(spark, d):
    c, o, li, s, n, r = (table(spark, d, t) for t in ("customer", "orders", "lineitem", "supplier", "nation", "region"))
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, (F.col("l_suppkey") == F.col("s_suppkey")) & (F.col("c_nationkey") == F.col("s_nationkey"))).join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("r_name", "n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


def discount(spark, d):
    li = table(spark, d, "lineitem").where("l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24")
    return li.agg(F.round(F.sum(F.col("l_extendedprice") * F.col("l_discount")), 2).alias("revenue"))


def rollup(spark, d):
    o = table(spark, d, "orders")
    return o.rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def cube(spark, d):
    return table(spark, d, "part").cube("p_type", "p_brand").agg(F.count("*").alias("n"))


def without_orders(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders").where("o_totalprice > 300000"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


def with_orders(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders").where("o_totalprice > 300000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


def set_operations(spark, d):
    c, s = table(spark, d, "customer").select(F.col("c_nationkey").alias("nation")), table(spark, d, "supplier").select(F.col("s_nationkey").alias("nation"))
    tag = lambda x, name: x.select(F.lit(name).alias("what"), "nation")
    return tag(c.intersect(s), "both").unionByName(tag(c.exceptAll(s.limit(0)).distinct().exceptAll(s.distinct()), "customers")).unionByName(tag(s.subtract(c), "suppliers"))


def asof(spark, d):
    """Each purchase with the user's last click before it: both sides in one sort by user and time, so no pairs are formed."""
    e = _events(spark, d)
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    clicked = F.last(F.when(F.col("event_type") == "click", F.col("event_id")), ignorenulls=True).over(w)
    return e.withColumn("click_id", clicked).where("event_type = 'purchase'").select("event_id", "click_id")


def ranges(spark, d):
    """Parts by price band: a join on ranges against a table of bands."""
    bands = spark.createDataFrame([(i, 900.0 + 20 * i, 920.0 + 20 * i) for i in range(60)], "band int, low double, high double")
    p = table(spark, d, "part")
    return p.join(F.broadcast(bands), (F.col("p_retailprice") >= F.col("low")) & (F.col("p_retailprice") < F.col("high"))).groupBy("band").agg(F.count("*").alias("n"))


def pivoted(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.count(F.lit(1))).select("l_returnflag", F.coalesce("F", F.lit(0)).alias("filled"), F.coalesce("O", F.lit(0)).alias("open"))


def approximate(spark, d):
    """Approximate distinct counts and medians beside the exact ones: whether each is within a tenth."""
    li = table(spark, d, "lineitem")
    near = lambda a, b: (F.abs(F.col(a) - F.col(b)) <= 0.1 * F.col(b))
    rough = li.agg(F.approx_count_distinct("l_partkey", 0.02).alias("parts"), F.percentile_approx("l_extendedprice", 0.5).alias("price"))
    exact = li.where("l_partkey IS NOT NULL").groupBy("l_partkey").count().agg(F.count("*").alias("all_parts"))
    one = rough.join(F.broadcast(exact)).join(F.broadcast(median(li, "l_extendedprice")))
    return one.select(near("parts", "all_parts").alias("distinct_ok"), near("price", "median").alias("median_ok"))


def above_average(spark, d):
    """Items whose quantity is above the average of their part: a window instead of a correlated sub-query."""
    li = table(spark, d, "lineitem").withColumn("mean", F.avg("l_quantity").over(Window.partitionBy("l_partkey")))
    return li.where("l_quantity > 1.5 * mean").groupBy("l_returnflag").agg(F.count("*").alias("n"))


QUERIES = {name: _filter(wanted, column) for name, (wanted, column, _) in FILTERS.items()} | {
    "log_stats": log_stats, "log_status_sets": log_sets, "log_page": log_page, "log_last_minute": last_minute, "rate_limit_sliding": rate_limit, "sessions": sessions, "window_tumbling": tumbling, "window_sliding": sliding, "window_session": session_windows,
    "voice_activity": voice_batch, "voice_activity_stream": voice_stream, "utterances": utterance_rows, "utterances_stream": utterance_stream, "turns_stream": turn_stream, "cache_stream": cache_stream, "lru_eviction": lru_eviction, "lru_by_source": lru_by_source, "cleanup_age": cleanup_age, "cleanup_keep_min": cleanup_usage, "conversation_truncate": truncate, "repeated_calls": repeats, "ring_buffer": ring,
    "audit_chain": audit_chain, "audit_global": audit_global, "change_log": compacted, "privacy_budget": budget, "table_upsert": upsert, "table_update": update, "table_delete": delete, "table_delete_where": delete_where, "collection_stats": collection_stats,
    "star_pricing": pricing, "star_shipping": shipping, "star_nations": nations, "star_discount": discount, "star_rollup": rollup, "star_cube": cube, "join_anti": without_orders, "join_semi": with_orders, "set_operations": set_operations,
    "join_asof": asof, "join_range": ranges, "pivot": pivoted, "approximate": approximate, "above_average": above_average,
}

_FRAMES = '''f AS (SELECT user_id % 7 AS key, event_id * 100 AS "at", CASE WHEN (event_id // 97) % 2 = 0 THEN -20.0::DOUBLE ELSE -60.0::DOUBLE END AS level FROM events)'''
_VOICE = f"""WITH {_FRAMES}, t AS (SELECT *, level >= -45 AS loud, CASE WHEN (level >= -45) = lag(level >= -45) OVER w THEN 0 ELSE 1 END AS turn FROM f WINDOW w AS (PARTITION BY key ORDER BY "at")),
    r AS (SELECT *, sum(turn) OVER (PARTITION BY key ORDER BY "at") AS run FROM t), a AS (SELECT *, "at" - min("at") OVER (PARTITION BY key, run) AS age FROM r),
    c AS (SELECT key, run, loud, min("at") AS "at" FROM a WHERE age >= CASE WHEN loud THEN 200 ELSE 900 END GROUP BY key, run, loud), n AS (SELECT *, lag(loud) OVER (PARTITION BY key ORDER BY "at") AS last FROM c)
    SELECT key, "at", CASE WHEN loud THEN 'start' ELSE 'end' END AS kind, level FROM n JOIN f USING (key, "at") WHERE (last IS NULL AND loud) OR last != loud"""
#: Speech from start to end; cut at each first frame that is five seconds in; frames counted up to each of 800 ms intervals.
_UTTERANCES = f"""{_VOICE.replace('WITH f AS', 'WITH RECURSIVE f AS').replace('event_id * 100', 'event_id * 100 + 1000').replace('THEN -20.0::DOUBLE', 'THEN -20.0::DOUBLE - event_id % 5').replace('SELECT key, "at", CASE WHEN loud', ', v AS (SELECT key, "at", CASE WHEN loud')}),
    i AS (SELECT key, s, e FROM (SELECT key, kind, "at" AS s, lead("at") OVER (PARTITION BY key ORDER BY "at") AS e FROM v) WHERE kind = 'start'),
    x(key, first, s, e) AS (SELECT key, s, s, e FROM i UNION ALL SELECT x.key, first, min(f."at"), x.e FROM x JOIN f ON f.key = x.key AND f."at" >= x.s + 5000 AND (x.e IS NULL OR f."at" < x.e) GROUP BY x.key, first, x.s, x.e),
    u AS (SELECT key, s, coalesce(lead(s) OVER w, e) AS t, lead(s) OVER w IS NOT NULL AS cut, row_number() OVER (PARTITION BY key ORDER BY s) - 1 AS utterance FROM x WINDOW w AS (PARTITION BY key, first ORDER BY s)),
    g AS (SELECT u.*, f."at" AS a, level, (f."at" - s) // 800 AS part FROM u JOIN f ON f.key = u.key AND f."at" >= s AND (t IS NULL OR f."at" < t)),
    h AS (SELECT *, count(*) OVER z AS frames, avg(level) OVER z AS mean, row_number() OVER (PARTITION BY key, utterance, part ORDER BY a) AS nth FROM g WINDOW z AS (PARTITION BY key, utterance ORDER BY a)),
    p AS (SELECT *, row_number() OVER (PARTITION BY key, utterance ORDER BY a) - 1 AS chunk FROM h WHERE part > 0 AND nth = 1)
    SELECT key, utterance, 'partial' AS kind, chunk, s AS from_ms, a AS to_ms, frames, round(mean, 6) AS level, false AS truncated FROM p
    UNION ALL SELECT key, utterance, 'final', count(*) FILTER (part > 0 AND nth = 1), any_value(s), any_value(t), count(*), round(avg(level), 6), any_value(cut) FROM h WHERE t IS NOT NULL GROUP BY key, utterance"""
#: One event after the other, in every conversation at once.
_TURNS = f"""WITH RECURSIVE e AS (SELECT user_id % 7 AS key, event_id * 1000 + 1000 AS w, ({_TURN_EVENTS})[event_id * 5 % {len(_TURN_EVENTS)} + 1] AS event, row_number() OVER (PARTITION BY user_id % 7 ORDER BY event_id) AS n FROM events),
    m(state, event, target) AS (VALUES {', '.join(str((*pair, to)) for pair, to in turns.TURNS.items())}),
    r(key, n, state, since, w, event, was, target, late) AS (SELECT DISTINCT key, 0::BIGINT, 'idle', 0::BIGINT, 0::BIGINT, '', '', NULL::VARCHAR, NULL::BIGINT FROM e UNION ALL
        SELECT y.key, y.n, coalesce(m.target, y.was), CASE WHEN m.target IS NOT NULL THEN y.w ELSE coalesce(y.late, y.since) END, y.w, y.event, y.was, m.target, y.late FROM
        (SELECT e.key, e.n, e.w, e.event, r.since, CASE WHEN r.state = 'planning' AND e.w > r.since + 10000 THEN 'error' ELSE r.state END AS was, CASE WHEN r.state = 'planning' AND e.w > r.since + 10000 THEN r.since + 10000 END AS late FROM r JOIN e ON e.key = r.key AND e.n = r.n + 1) y
        LEFT JOIN m ON m.state = y.was AND m.event = y.event),
    o AS (SELECT key, since + 10000 AS late FROM r WHERE state = 'planning' AND n = (SELECT max(n) FROM e WHERE e.key = r.key) AND since + 10000 < (SELECT max(w) - 10000 FROM e))
    SELECT key, w AS "at", event, was AS from_state, target AS to_state, event IN ('speech', 'interrupt') AS barge_in FROM r WHERE target IS NOT NULL
    UNION ALL SELECT key, late, 'timeout', 'planning', 'error', false FROM (SELECT key, late FROM r WHERE late IS NOT NULL UNION ALL FROM o)"""
#: A model's entries are a list that goes from one prompt to the next.
_CACHE = """WITH RECURSIVE q AS (SELECT user_id % 3 AS key, event_id AS id, event_id * 1000 + 1000 AS w, event_type || ' ' || (user_id % 40) AS prompt, cos(radians(event_id * 37 % 360)) AS a, sin(radians(event_id * 37 % 360)) AS b, row_number() OVER (PARTITION BY user_id % 3 ORDER BY event_id) AS n FROM events),
    r(key, n, held, id, kind, entry, score) AS (SELECT DISTINCT key, 0::BIGINT, [{'id': 0::BIGINT, 'w': -100000::BIGINT, 'prompt': '', 'a': 0.0::DOUBLE, 'b': 0.0::DOUBLE}], 0::BIGINT, '', 0::BIGINT, 0.0::DOUBLE FROM q UNION ALL
        SELECT key, n, CASE WHEN exact IS NULL AND coalesce(near.s, -1) < 0.9995 THEN list_append(live, {'id': id, 'w': w, 'prompt': prompt, 'a': a, 'b': b}) ELSE live END, id,
            CASE WHEN exact IS NOT NULL THEN 'exact' WHEN near.s >= 0.9995 THEN 'similar' ELSE 'miss' END, CASE WHEN exact IS NOT NULL THEN exact WHEN near.s >= 0.9995 THEN -near.i END, CASE WHEN exact IS NOT NULL THEN 1.0 WHEN near.s >= 0.9995 THEN near.s END FROM
        (SELECT *, list_filter(live, lambda e: e.prompt = y.prompt)[1].id AS exact, list_max(list_transform(live, lambda e: {'s': round(e.a * y.a + e.b * y.b, 9), 'i': -e.id})) AS near FROM
            (SELECT q.*, list_filter(r.held, lambda e: q.w - e.w <= 60000) AS live FROM r JOIN q ON q.key = r.key AND q.n = r.n + 1) y) z)
    SELECT key, id AS prompt_id, kind, entry AS entry_id, round(score, 6) AS score, len(held) AS entries FROM r WHERE n > 0"""
_LRU = "SELECT doc_id, source, n_chars AS bytes, (doc_id * 7919) % 100003 AS used FROM documents"
_DISC = "l_extendedprice * (1 - l_discount)"

SQL = {name: f"SELECT event_id FROM events WHERE {where}" for name, (_, _, where) in FILTERS.items()} | {
    "log_stats": "WITH l AS (SELECT event_type != 'error' AS done, round(value * 100) AS r, round(value * 10) AS s, round(value) AS d FROM events) SELECT count(*) AS requests, count(*) FILTER (done) AS completed, count(*) FILTER (NOT done) AS failed, sum(r) FILTER (done) AS received, sum(s) FILTER (done) AS sent, sum(d) FILTER (done) AS duration, round(sum(r) FILTER (done) / sum(d) FILTER (done) * 1000, 6) AS speed FROM l",
    "log_status_sets": "WITH l AS (SELECT *, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'completed' END AS state, round(value * 100) AS r FROM events) SELECT event_type, state, grouping(event_type, state)::BIGINT AS grouping, count(*) AS n, sum(r) AS received FROM l GROUP BY GROUPING SETS ((event_type), (state), ())",
    "log_page": "SELECT event_id, event_type FROM events WHERE regexp_matches(event_type, '^(c|v)') AND ts >= '2024-01-02' ORDER BY event_id LIMIT 50 OFFSET 20",
    "log_last_minute": "SELECT count(*) AS n FROM events WHERE (epoch_us(ts) // 1000) >= (SELECT max((epoch_us(ts) // 1000)) FROM events) - 60000",
    "rate_limit_sliding": "SELECT event_id, n AS n_recent, n <= 3 AS allowed FROM (SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY (epoch_us(ts) // 1000) RANGE BETWEEN 3600000 PRECEDING AND CURRENT ROW) AS n FROM events)",
    "sessions": '''WITH s AS (SELECT user_id AS key, (epoch_us(ts) // 1000) AS "at", CASE WHEN (epoch_us(ts) // 1000) - lag((epoch_us(ts) // 1000)) OVER (PARTITION BY user_id ORDER BY (epoch_us(ts) // 1000)) > 1800000 THEN 1 ELSE 0 END AS b FROM events), t AS (SELECT key, "at", CAST(sum(b) OVER (PARTITION BY key ORDER BY "at" ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM s) SELECT key, session, min("at") AS start_ms, max("at") AS end_ms, count(*) AS n FROM t GROUP BY key, session''',
    "window_tumbling": "SELECT epoch_ms(date_trunc('hour', ts)) AS start_ms, event_type, count(*) AS n FROM events GROUP BY ALL",
    "window_sliding": "SELECT s AS start_ms, count(*) AS n FROM (SELECT unnest([(epoch_us(ts) // 1000) // 1800000 * 1800000, (epoch_us(ts) // 1000) // 1800000 * 1800000 - 1800000]) AS s FROM events) GROUP BY s",
    "window_session": "WITH s AS (SELECT user_id AS key, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS b FROM events), t AS (SELECT key, ts, sum(b) OVER (PARTITION BY key ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM s) SELECT key, (epoch_us(min(ts)) // 1000) AS start_ms, count(*) AS n FROM t GROUP BY key, s",
    "voice_activity": _VOICE, "voice_activity_stream": _VOICE, "utterances": _UTTERANCES, "utterances_stream": _UTTERANCES, "turns_stream": _TURNS, "cache_stream": _CACHE,
    "lru_eviction": f"SELECT doc_id, freed_before FROM (SELECT doc_id, CAST(coalesce(sum(bytes) OVER (ORDER BY used, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS freed_before FROM ({_LRU})) WHERE freed_before < 100000",
    "lru_by_source": f"SELECT doc_id, source, freed_before FROM (SELECT doc_id, source, CAST(coalesce(sum(bytes) OVER (PARTITION BY source ORDER BY used, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS freed_before FROM ({_LRU}) WHERE doc_id % 10 != 0) WHERE freed_before < 20000",
    "cleanup_age": "SELECT event_id FROM (SELECT event_id, ts, row_number() OVER (ORDER BY ts, event_id) AS k, count(*) OVER () AS n FROM events) WHERE (epoch_us(ts) // 1000) < 1704672000000 AND k <= n - 100",
    "cleanup_keep_min": "SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS k, count(*) OVER () AS n FROM events) WHERE k <= floor(n * 20 / 100) AND k <= n - 100",
    "conversation_truncate": "SELECT conv_id, turn, used FROM (SELECT conv_id, turn, CAST(sum(ceil(length(text) / 4.0)) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS BIGINT) AS used FROM conversations) WHERE used <= 309",
    "repeated_calls": "WITH r AS (SELECT user_id AS key, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS g FROM events) SELECT key, event_type AS value, min(event_id) AS first, max(event_id) AS last, count(*) AS n FROM r GROUP BY key, event_type, g HAVING count(*) >= 2",
    "ring_buffer": "SELECT event_id, user_id FROM (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k <= 5",
    "audit_global": """SELECT count(*) AS checked, min(event_id) FILTER (before % 401 = 400) AS broken_at, CASE WHEN count(*) FILTER (before % 401 = 400) > 0 THEN 'previous hash' END AS reason FROM (SELECT event_id, lag(event_id) OVER (ORDER BY event_id) AS before FROM events)""",
    "audit_chain": "SELECT user_id, count(*) AS checked, min(event_id) FILTER (event_id % 501 = 500) AS broken_at, CASE WHEN count(*) FILTER (event_id % 501 = 500) > 0 THEN 'hash' END AS reason FROM events GROUP BY user_id",
    "change_log": "SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) WHERE k = 1 AND event_type != 'error'",
    "privacy_budget": "SELECT event_id, s AS spent, s < 10 AS allowed FROM (SELECT event_id, sum(round(value) / 64) OVER (PARTITION BY user_id ORDER BY event_id) AS s FROM events)",
    "table_upsert": "SELECT lang AS collection_id, doc_id AS id, source AS note, CASE WHEN doc_id % 10 = 0 THEN 2 WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END AS version FROM documents UNION ALL SELECT lang, doc_id + 1000000, source, 3 FROM documents WHERE doc_id % 50 = 0",
    "table_update": "SELECT lang AS collection_id, doc_id AS id, CASE WHEN doc_id % 4 = 0 THEN source || '!' ELSE source END AS note, 0 AS version FROM documents",
    "table_delete": "SELECT lang AS collection_id, doc_id AS id FROM documents WHERE doc_id % 3 != 0",
    "table_delete_where": "SELECT count(*) AS deleted FROM documents WHERE source = 'src0'",
    "collection_stats": "SELECT label AS collection_id, count(*) AS n, CAST(sum(len(embedding)) * 4 AS BIGINT) AS vector_bytes FROM embeddings GROUP BY label",
    "star_pricing": f"SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum({_DISC}), 2) AS sum_disc, round(sum({_DISC} * (1 + l_tax)), 2) AS sum_charge, round(avg(l_quantity), 2) AS avg_qty, count(*) AS n FROM lineitem WHERE l_shipdate <= '1998-09-02' GROUP BY ALL",
    "star_shipping": f"SELECT l_orderkey, revenue FROM (SELECT l_orderkey, o_orderdate, round(sum({_DISC}), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_mktsegment = 'BUILDING' AND o_orderdate < '1998-03-15' AND l_shipdate > '1998-03-15' GROUP BY ALL) ORDER BY revenue DESC, l_orderkey LIMIT 10",
    "star_nations": f"SELECT r_name, n_name, round(sum({_DISC}), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL",
    "star_discount": "SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem WHERE l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24",
    "star_rollup": "SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)",
    "star_cube": "SELECT p_type, p_brand, count(*) AS n FROM part GROUP BY CUBE (p_type, p_brand)",
    "join_anti": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)",
    "join_semi": "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)",
    "set_operations": "SELECT 'both' AS what, nation FROM (SELECT c_nationkey AS nation FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'customers', nation FROM (SELECT c_nationkey AS nation FROM customer EXCEPT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'suppliers', nation FROM (SELECT s_nationkey AS nation FROM supplier EXCEPT SELECT c_nationkey FROM customer)",
    "join_asof": "SELECT event_id, click_id FROM (SELECT event_id, event_type, last_value(CASE WHEN event_type = 'click' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS click_id FROM events) WHERE event_type = 'purchase'",
    "join_range": "SELECT CAST(floor((p_retailprice - 900) / 20) AS INTEGER) AS band, count(*) AS n FROM part WHERE p_retailprice >= 900 AND p_retailprice < 2100 GROUP BY 1",
    "pivot": "SELECT l_returnflag, count(*) FILTER (l_linestatus = 'F') AS filled, count(*) FILTER (l_linestatus = 'O') AS open FROM lineitem GROUP BY l_returnflag",
    "approximate": "SELECT true AS distinct_ok, true AS median_ok",
    "above_average": "SELECT l_returnflag, count(*) AS n FROM (SELECT *, avg(l_quantity) OVER (PARTITION BY l_partkey) AS mean FROM lineitem) WHERE l_quantity > 1.5 * mean GROUP BY l_returnflag",
}
