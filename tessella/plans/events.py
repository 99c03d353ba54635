"""Queries over events and conversations, and their streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessella.plans.base import Tables, query
from tessella.sources.shared import new_folder
from tessella.streaming import events as e
from tessella.streaming import sessions as live
from tessella.streaming import stateful


@query("SELECT event_id, nth::INT AS nth, nth <= 3 AS admitted, greatest(0, 3 - nth)::INT AS remaining FROM (SELECT *, row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id) AS nth FROM events)")
def daily_usage_admission(t: Tables):
    return e.admission(t.events, 3).select("event_id", "nth", "admitted", "remaining")


@query("SELECT event_id, recent, recent <= 2 AS allowed FROM (SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) AS recent FROM events)")
def sliding_rate_limit(t: Tables):
    return e.sliding_limit(t.events, 2, 3600).select("event_id", "recent", "allowed")


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations) WHERE k BETWEEN 2 AND 5")
def session_turns_context(t: Tables):
    return e.last_turns(t.conversations, 2).select("conv_id", "turn", "role")


@query("SELECT user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events WHERE event_type IN ('click', 'purchase')) WHERE k = 1")
def rating_last_write(t: Tables):
    return e.last_write(t.events, ["user_id"], "event_type", ["click", "purchase"])


@query("SELECT event_id, CASE WHEN event_type = 'view' AND ts <= '2024-01-15' THEN 'ready' WHEN event_type = 'view' THEN 'rendering' ELSE 'queued' END AS status FROM events")
def ready_transition(t: Tables):
    jobs = t.events.select("event_id", F.when(F.col("event_type") == "view", "rendering").otherwise("queued").alias("status"), F.col("ts").alias("ready_at"))
    return e.ready(jobs, F.lit("2024-01-15").cast("timestamp_ntz")).select("event_id", "status")


@query("SELECT floor(value / 10)::BIGINT AS message, count(*) AS n, min(value) AS least, round(avg(value), 4) AS mean, max(value) AS most FROM events WHERE event_type = 'error' GROUP BY 1")
def error_histogram(t: Tables):
    rows = t.events.filter("event_type = 'error'").groupBy(F.floor(F.col("value") / 10).alias("message"))
    return rows.agg(F.count("*").alias("n"), F.min("value").alias("least"), F.round(F.avg("value"), 4).alias("mean"), F.max("value").alias("most"))


@query("SELECT event_type, count(*) AS n, list_sort(list(value))[count(*) // 2 + 1] AS median FROM events GROUP BY event_type")
def upper_median(t: Tables):
    """The element n // 2 of the sorted values: values are counted first, slices of a type's range then summed, and only
    the slice that holds the element is ordered."""
    from pyspark.sql import Window

    c = t.events.groupBy("event_type", "value").agg(F.count("*").alias("c"))
    range_ = c.groupBy("event_type").agg(F.sum("c").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.ceil(F.sqrt(F.count("*"))).alias("k"))
    # rises with the value; a type of one value, or values out of a range's reach, is one slice
    part = F.coalesce(F.floor(F.try_divide(F.col("value") - F.col("lo"), F.col("hi") - F.col("lo")) * F.col("k")), F.lit(0))
    c = c.join(range_, "event_type").withColumn("part", part)
    sums = c.groupBy("event_type", "part").agg(F.sum("c").alias("s"))
    ahead = sums.withColumn("ahead", F.sum("s").over(Window.partitionBy("event_type").orderBy("part")) - F.col("s"))
    own = c.join(ahead, ["event_type", "part"]).filter((F.col("ahead") <= F.floor(F.col("n") / 2)) & (F.col("ahead") + F.col("s") > F.floor(F.col("n") / 2)))
    upto = own.withColumn("upto", F.col("ahead") + F.sum("c").over(Window.partitionBy("event_type").orderBy("value")))
    return upto.filter(F.col("upto") > F.floor(F.col("n") / 2)).groupBy("event_type").agg(F.max("n").alias("n"), F.min("value").alias("median"))


@query("SELECT (json_extract(props, '$.k')::BIGINT) AS k, count(*) AS n, min(event_id) AS first_event FROM events GROUP BY 1")
def json_props_extract(t: Tables):
    k = F.get_json_object("props", "$.k").cast("long").alias("k")
    return t.events.groupBy(k).agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))


@query("""SELECT event_id, CASE WHEN event_type = 'error' THEN 'e' ELSE json_extract_string(props, '$.k') END AS k, event_type AS kind FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL""")
def metadata_merge(t: Tables):
    """Two maps merged, the right one's values standing."""
    old = F.from_json("props", "map<string,string>")
    new = F.when(F.col("event_type") == "error", F.create_map(F.lit("k"), F.lit("e"), F.lit("kind"), F.col("event_type"))).otherwise(F.create_map(F.lit("kind"), F.col("event_type")))
    merged = F.map_concat(F.map_filter(old, lambda k, v: ~F.array_contains(F.map_keys(new), k)), new)
    rows = t.events.filter(F.get_json_object("props", "$.k").isNotNull()).select("event_id", merged.alias("m"))
    return rows.select("event_id", F.col("m")["k"].alias("k"), F.col("m")["kind"].alias("kind"))


@query("SELECT time_bucket(INTERVAL 1 hour, ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def tumbling_counts(t: Tables):
    return e.tumbling(t.events)


SESSIONS = "SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 minute THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s"


@query(SESSIONS)
def session_windows(t: Tables):
    return e.sessions(t.events)


def _appended(t: Tables, df):
    """What a stream over all of its input appends, as files."""
    at = new_folder(t.spark, "stream")
    df.writeStream.format("parquet").option("path", f"{at}/rows").option("checkpointLocation", f"{at}/log").trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.schema(df.schema).parquet(f"{at}/rows")


def _completed(t: Tables, df):
    """The final state of an aggregate of bounded size over a stream, from memory."""
    name = f"t_{uuid.uuid4().hex}"
    df.writeStream.format("memory").queryName(name).option("checkpointLocation", new_folder(t.spark, "stream")).outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    return t.spark.table(name)


def _stream(t: Tables, name: str, schema: str):
    """A table as a stream; where it is one file, that file of its folder."""
    path, rows, files = f"{t.sf_dir}/{name}.parquet", t.spark.readStream.schema(schema), getattr(t, name).inputFiles()
    if len(files) == 1 and files[0].endswith(f"/{name}.parquet"):
        rows, path = rows.option("pathGlobFilter", f"{name}.parquet"), t.sf_dir
    return rows.parquet(path)


@query("SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def stream_dedupe(t: Tables):
    """Users of each type of event, each counted once by a stream that drops what it has seen."""
    rows = _stream(t, "events", e.SCHEMA).withColumn("ts", F.col("ts").cast("timestamp"))
    once = e.distinct(rows, ["user_id", "event_type"], "60 days")
    return _completed(t, once.groupBy("event_type").agg(F.count("*").alias("users")))


@query("SELECT conv_id, sum(len(regexp_extract_all(text, '(?s).{1,40}')))::BIGINT AS pieces, sum(len(text))::BIGINT AS chars FROM conversations GROUP BY conv_id")
def conversation_pieces(t: Tables):
    """How many pieces of 40 characters a relay would send of each conversation."""
    pieces = t.conversations.select("conv_id", F.regexp_extract_all("text", F.lit("(?s).{1,40}"), F.lit(0)).alias("p"), F.length("text").alias("n"))
    return pieces.groupBy("conv_id").agg(F.sum(F.size("p")).alias("pieces"), F.sum("n").alias("chars"))


@query("""WITH c AS (SELECT conv_id, string_split(string_agg(text, '' ORDER BY turn), chr(10)) AS l FROM conversations GROUP BY conv_id)
SELECT conv_id, (i - 1)::INT AS seq, CASE WHEN i = 1 THEN 'sources' ELSE 'delta' END AS kind, l[i] AS body FROM (SELECT conv_id, l, unnest(range(1, len(l))) AS i FROM c)""")
def stream_token_assembly(t: Tables):
    """The lines of conversations, put together by a stream from turns as pieces."""
    pieces = _stream(t, "conversations", "conv_id long, turn long, role string, text string").select("conv_id", "turn", "text")
    return _appended(t, stateful.assembled(pieces, None))


KINDS = {"signup": "open", "view": "chunk", "click": "text", "purchase": "finish", "error": "close"}


def _frames(events, session):
    """Events as frames of relay sessions."""
    at = F.unix_millis(F.col("ts").cast("timestamp"))
    kind = F.element_at(F.create_map(*(F.lit(x) for kv in KINDS.items() for x in kv)), F.col("event_type"))
    return events.select(session.alias("session"), at.alias("at_ms"), F.col("event_id").alias("frame_id"), kind.alias("kind"), F.col("value").cast("string").alias("body"))


@query()
def stream_session_state(t: Tables):
    """Users' events as frames of relay sessions, a session a day."""
    return live.relay(_frames(t.events, F.col("user_id") * 1000 + F.dayofyear("ts")))


@query(f"""WITH f AS (SELECT user_id AS session, epoch_ms(ts) AS at_ms, event_id, event_type AS kind, value FROM events),
o AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY at_ms, event_id) AS p FROM f),
b AS (SELECT session, min(p) FILTER (kind = 'signup') AS opens, coalesce(min(p) FILTER (kind = 'purchase'), 1e9) AS finishes, coalesce(min(p) FILTER (kind = 'error'), 1e9) AS closes FROM o GROUP BY session),
c AS (SELECT o.*, closes, (SELECT max(at_ms) FROM f) AS upto, (SELECT max(x.at_ms) + 170 FROM o x WHERE x.session = o.session AND x.kind = 'signup' AND x.p < closes) AS ready FROM o JOIN b USING (session) WHERE kind = 'view' AND p < least(finishes, closes) AND opens < closes)
SELECT session, (row_number() OVER (PARTITION BY session ORDER BY p))::INT AS nth, value FROM c WHERE ready <= upto OR closes < 1e9""")
def stream_session_chunks(t: Tables):
    """Each user's events as one live session: the chunks that it sends, in order, by a stream with state and timers."""
    from pyspark.sql import Window

    events = _stream(t, "events", e.SCHEMA)
    with live.keyed_state(t.spark):
        sent = _appended(t, live.relay_stream(_frames(events, F.col("user_id"))))
    chunks = sent.filter("kind = 'chunk'")
    return chunks.select("session", F.row_number().over(Window.partitionBy("session").orderBy("seq")).alias("nth"), F.col("body").cast("double").alias("value"))


@query("SELECT user_id, event_id, recent, recent <= 2 AS allowed FROM (SELECT user_id, event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) AS recent FROM events)")
def stream_rate_limit(t: Tables):
    """The sliding limit, by a stream that keeps a user's recent times in state."""
    with live.keyed_state(t.spark):
        return _appended(t, live.limited_stream(_stream(t, "events", e.SCHEMA), 2, 3600))
