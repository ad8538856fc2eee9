"""Queries over state that events change in order, each beside its DuckDB SQL: recursive queries that take
one event of every key a step."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import folds
from ..session import working_dir
from ..sources import clicks, read
from ..streaming import reading_states, server_sent
from .library import query

CLICKS = "c AS (SELECT DISTINCT * FROM clicks WHERE client_id IS NOT NULL AND ts IS NOT NULL)"

READING = f"""WITH {CLICKS}, e AS (SELECT client_id AS user_id, ts, click_id, CASE kind WHEN 'view' THEN 'open' WHEN 'purchase' THEN 'open' WHEN 'click' THEN 'focus' WHEN 'error' THEN 'blur' WHEN 'signup' THEN 'close' END AS kind,
  CASE WHEN kind = 'view' THEN 'p' || (click_id % 50) END AS paper_id FROM c WHERE kind IS NOT NULL),
s AS (SELECT *, lead(kind) OVER o AS next_kind, lead(ts) OVER o AS next_ts, sum(CASE WHEN kind IN ('open', 'close') THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, click_id) AS tab FROM e WINDOW o AS (PARTITION BY user_id ORDER BY ts, click_id)),
p AS (SELECT *, max(paper_id) OVER (PARTITION BY user_id, tab) AS paper FROM s),
f AS (SELECT user_id, paper AS paper_id, ts AS start_time, next_ts AS end_time, (epoch_us(next_ts) - epoch_us(ts)) // 1000000 AS duration_seconds FROM p WHERE kind IN ('open', 'focus') AND tab > 0 AND paper IS NOT NULL AND next_kind IN ('open', 'blur', 'close'))
"""


def window_events(c):
    kind = F.create_map(*[F.lit(x) for pair in {"view": "open", "purchase": "open", "click": "focus", "error": "blur", "signup": "close"}.items() for x in pair])
    paper = F.when(F.col("kind") == "view", F.concat(F.lit("p"), (F.col("click_id") % 50).cast("string")))
    return c.where("kind is not null").select(F.col("client_id").alias("user_id"), "ts", F.col("click_id").alias("ord"), kind[F.col("kind")].alias("kind"), paper.alias("paper_id"))


@query("reading_sessions_by_events", READING + "SELECT * FROM f WHERE duration_seconds >= 5")
def _(s, d):
    return reading_states.sessions_by_events(window_events(clicks(s, d)))


@query("reading_tab_time", READING + "SELECT paper_id, CAST(sum(duration_seconds) AS BIGINT) AS total_seconds, count(*) AS sessions FROM f WHERE duration_seconds >= 5 GROUP BY paper_id")
def _(s, d):
    found = reading_states.sessions_by_events(window_events(clicks(s, d)))
    return found.groupBy("paper_id").agg(F.sum("duration_seconds").alias("total_seconds"), F.count("*").alias("sessions"))


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@query("reading_sessions_stream", READING + ", m AS (SELECT (epoch_ms(max(ts)) - 3600000) * 1000 AS watermark FROM e) SELECT f.* FROM f, m WHERE duration_seconds >= 5 AND epoch_us(end_time) < watermark")
def _(s, d):
    """The table as a stream, in one batch: sessions that end before the watermark, an hour before the last event."""
    table = read(s, d, "clicks")
    rows = s.readStream.schema(table.schema).parquet(f"{d}/clicks.parque[t]")  # a pattern, which may also be one file
    out, key = working_dir(s, "sessions"), "spark.sql.streaming.stateStore.providerClass"
    before = s.conf.get(key)
    s.conf.set(key, ROCKS)
    try:
        found = reading_states.streamed_sessions(window_events(rows), "1 hour")
        found.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        s.conf.set(key, before)
    found = s.read.parquet(f"{out}/rows")
    return found.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start_time", "end_time")})


UNDO = f"""WITH RECURSIVE {CLICKS}, e AS (SELECT client_id, click_id, CASE kind WHEN 'click' THEN 'undo' WHEN 'error' THEN 'redo' ELSE 'push' END AS action, row_number() OVER (PARTITION BY client_id ORDER BY ts, click_id) AS n FROM c),
w AS (SELECT DISTINCT client_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS click_id, CAST(NULL AS VARCHAR) AS shown, CAST([] AS VARCHAR[]) AS undos, CAST([] AS VARCHAR[]) AS redos FROM e
UNION ALL SELECT w.client_id, e.n, e.click_id,
  CASE WHEN action = 'push' THEN CAST(e.click_id AS VARCHAR) WHEN action = 'undo' AND len(undos) > 0 THEN undos[-1] WHEN action = 'redo' AND len(redos) > 0 THEN redos[-1] ELSE shown END,
  CASE WHEN action = 'push' THEN list_append(CASE WHEN len(undos) > 100 THEN undos[len(undos) - 99:] ELSE undos END, shown) WHEN action = 'undo' AND len(undos) > 0 THEN undos[1:len(undos) - 1] WHEN action = 'redo' AND len(redos) > 0 THEN list_append(undos, shown) ELSE undos END,
  CASE WHEN action = 'push' THEN CAST([] AS VARCHAR[]) WHEN action = 'undo' AND len(undos) > 0 THEN list_append(redos, shown) WHEN action = 'redo' AND len(redos) > 0 THEN redos[1:len(redos) - 1] ELSE redos END
  FROM w JOIN e ON e.client_id = w.client_id AND e.n = w.n + 1)
SELECT client_id, click_id, shown, CAST(len(undos) AS INTEGER) AS undos, CAST(len(redos) AS INTEGER) AS redos FROM w WHERE n > 0"""


@query("annotation_history", UNDO)
def _(s, d):
    action = F.when(F.col("kind") == "click", "undo").when(F.col("kind") == "error", "redo").otherwise("push")
    edits = clicks(s, d).select("client_id", "ts", "click_id", action.alias("action"), F.col("click_id").cast("string").alias("state"))
    return folds.edit_history(edits, ["client_id"], ["ts", "click_id"]).drop("ts")


QUEUE = f"""WITH RECURSIVE {CLICKS}, e AS (SELECT 'c' || client_id || CASE WHEN client_id % 3 = 0 THEN '.PDF' ELSE '.pdf' END AS path, click_id, CASE kind WHEN 'view' THEN 'request' WHEN 'click' THEN 'take' WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'error' WHEN 'signup' THEN 'priority' END AS event,
  row_number() OVER (PARTITION BY client_id ORDER BY click_id) AS n FROM c WHERE client_id % 10 <> 9),
w AS (SELECT path, CAST(0 AS BIGINT) AS n, count(*) AS last, CAST(NULL AS VARCHAR) AS status, CAST(NULL AS BIGINT) AS queued_at, CAST(0 AS BIGINT) AS accepted, CAST(0 AS BIGINT) AS refused, CAST(0 AS BIGINT) AS parsed FROM e GROUP BY path
UNION ALL SELECT path, n, last,
  CASE WHEN take THEN 'pending' WHEN event = 'priority' OR event = 'take' AND queued_at IS NOT NULL THEN 'parsing' WHEN event IN ('done', 'error') AND status = 'parsing' THEN event ELSE status END,
  CASE WHEN take THEN click_id WHEN event IN ('priority', 'take') THEN NULL ELSE queued_at END, accepted + CAST(take AS BIGINT), refused + CAST(event = 'request' AND NOT take AS BIGINT), parsed + CAST(event = 'done' AND status IS NOT DISTINCT FROM 'parsing' AS BIGINT)
  FROM (SELECT w.path, e.n, w.last, w.status, w.queued_at, w.accepted, w.refused, w.parsed, e.click_id, coalesce(e.event, '') AS event, coalesce(e.event, '') = 'request' AND queued_at IS NULL AND coalesce(status, '') NOT IN ('done', 'parsing') AS take FROM w JOIN e ON e.path = w.path AND e.n = w.n + 1))
SELECT path, status, queued_at, accepted, refused, parsed FROM w WHERE n = last"""


@query("parse_queue_status", QUEUE)
def _(s, d):
    ending = F.when(F.col("client_id") % 10 == 9, ".txt").when(F.col("client_id") % 3 == 0, ".PDF").otherwise(".pdf")
    event = F.create_map(*[F.lit(x) for pair in {"view": "request", "click": "take", "purchase": "done", "error": "error", "signup": "priority"}.items() for x in pair])
    events = clicks(s, d).select(F.concat(F.lit("c"), F.col("client_id").cast("string"), ending).alias("path"), "click_id", event[F.col("kind")].alias("event"))
    return folds.queue_status(events, "path", "click_id")


QUOTA = f"""WITH RECURSIVE {CLICKS}, e AS (SELECT client_id, click_id, coalesce(kind, '') AS kind, CASE WHEN click_id % 17 <> 0 THEN props END AS value, row_number() OVER (PARTITION BY client_id ORDER BY click_id) AS n FROM c),
w AS (SELECT DISTINCT client_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS click_id, '' AS kind, CAST([] AS STRUCT(k VARCHAR, l BIGINT)[]) AS held, CAST(0 AS BIGINT) AS used, true AS accepted FROM e
UNION ALL SELECT client_id, n, click_id, kind, CASE WHEN value IS NULL THEN others WHEN used + strlen(value) > 150 THEN held ELSE list_append(others, struct_pack(k := kind, l := length(value))) END, used, value IS NULL OR used + strlen(value) <= 150
  FROM (SELECT *, CAST(coalesce(list_sum(list_transform(others, lambda x: x.l)), 0) AS BIGINT) AS used FROM (SELECT e.*, w.held, list_filter(w.held, lambda x: x.k <> e.kind) AS others FROM w JOIN e ON e.client_id = w.client_id AND e.n = w.n + 1)))
SELECT client_id, kind, click_id, used, accepted FROM w WHERE n > 0"""


@query("storage_write_series", QUOTA)
def _(s, d):
    writes = clicks(s, d).select("client_id", "click_id", F.coalesce("kind", F.lit("")).alias("kind"), F.when(F.col("click_id") % 17 != 0, F.col("props")).alias("value"))
    return folds.quota_series(writes, "client_id", "kind", "value", ["click_id"], 150)


def answer_chunks(s, d):
    """The turns of each conversation as lines of one stream, cut anywhere: a turn's chunks end before its
    line does, and the line's end comes with the next turn's first chunk."""
    t = F.col("turn")
    line = F.to_json(F.struct(F.array(F.struct(F.struct(F.col("text").alias("content")).alias("delta"))).alias("choices")))
    noise = F.when(t % 3 == 0, ": ping\ndata: {\"choices\": [\nevent: x\n").when(t % 3 == 1, "data: [DONE]\r\n").otherwise("data:  \n")
    whole = F.concat(F.lit("\r\n"), noise, F.when(t % 2 == 0, "  ").otherwise(""), F.lit("data: "), line)
    size = (F.col("conv_id") % 40 + 5).cast("int")
    cuts = F.transform(F.sequence(F.lit(0), F.floor((F.length("whole") - 1) / size).cast("int")), lambda i: F.substring("whole", i * size + 1, size))
    return read(s, d, "conversations").select("conv_id", "turn", whole.alias("whole")).select("conv_id", "turn", F.posexplode(cuts).alias("piece", "chunk"))


STREAMED = "t AS (SELECT conv_id, turn, text, turn = max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations)"


@query("answer_stream_deltas", f"WITH {STREAMED} SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS no, text AS delta FROM t WHERE NOT last AND text <> ''")
def _(s, d):
    return server_sent.deltas(answer_chunks(s, d), "conv_id", ["turn", "piece"])


@query("answer_stream_broken_off", f"WITH {STREAMED}, g AS (SELECT conv_id, coalesce(string_agg(CASE WHEN NOT last THEN text END, '' ORDER BY turn), '') AS a FROM t GROUP BY conv_id) SELECT conv_id, CASE WHEN conv_id % 2 = 0 THEN a WHEN a <> '' THEN a || chr(10) || chr(10) || '[流式输出中断]' END AS answer FROM g")
def _(s, d):
    chunks = answer_chunks(s, d)
    ends = read(s, d, "conversations").where("conv_id % 2 = 1").groupBy("conv_id").agg((F.max("turn") + 1).alias("turn")).select("conv_id", "turn", F.lit(0).alias("piece"), F.lit(None).cast("string").alias("chunk"))
    return server_sent.answers(chunks.unionByName(ends), "conv_id", ["turn", "piece"])
