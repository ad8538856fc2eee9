"""Cohort retention as known at several times: a timeline of each client's start, by arrival."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import dropped, stored, table

#: Microseconds.
DAY, MINUTE = 86_400_000_000, 60_000_000
#: Arrival of what has no arrival time: after everything else.
NEVER = (1 << 63) - 1
#: A client's events are dealt over parts of this many rows, or of this share of all rows if that is more:
#: so at most as many clients as the share's divisor are dealt over several parts.
PART_ROWS, PARTS = 500, 20_000


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp without a zone, whatever the session's zone."""
    ts = ts.cast("timestamp_ntz")
    clock = (F.hour(ts) * 60 + F.minute(ts)).cast("long") * MINUTE + (F.date_part(F.lit("SECOND"), ts) * 1_000_000).cast("long")
    return F.datediff(ts.cast("date"), F.lit("1970-01-01").cast("date")).cast("long") * DAY + clock


def floored(x: Column, unit: int) -> Column:
    """x // unit of whole numbers, downwards."""
    return F.call_function("div", x - F.pmod(x, F.lit(unit)), F.lit(unit))


def timeline(starts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Versions of each client's start: client, known (from this arrival on), until (the next version's, or
    null), start; and the stored table that they are read from. ``starts`` has client, ts, arrival, in
    microseconds.

    A version begins where an event arrives that is earlier than all that arrived before: a running minimum
    by arrival. It is taken over the instants of a minute, the minutes of a day and the days, each from
    sums of the level below, so that what a window holds is bounded by the calendar and not by how many
    events a client has.
    """
    earlier = lambda *keys: Window.partitionBy(*keys)
    before = lambda w, by: w.orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    day, minute, instant = earlier("client"), earlier("client", "day"), earlier("client", "day", "minute")

    instants = starts.groupBy("client", "arrival").agg(F.min("ts").alias("ts")).select("*", floored(F.col("arrival"), DAY).alias("day"), floored(F.col("arrival"), MINUTE).alias("minute"))
    minutes = instants.groupBy("client", "day", "minute").agg(F.min("ts").alias("low"))
    days = minutes.groupBy("client", "day").agg(F.min("low").alias("low")).select("client", "day", F.min("low").over(before(day, "day")).alias("low_day"))
    carried = minutes.withColumn("low_minute", F.min("low").over(before(minute, "minute"))).join(days, ["client", "day"]).select("client", "day", "minute", F.least("low_minute", "low_day").alias("carried"))
    least = F.least("carried", F.min("ts").over(before(instant, "arrival")))
    versions = stored(instants.join(carried, ["client", "day", "minute"]).withColumn("least", least).where("least is null or ts < least").select("client", "day", "minute", F.col("arrival").alias("known"), F.col("ts").alias("start")), "start-versions")

    firsts = versions.groupBy("client", "day", "minute").agg(F.min("known").alias("first"))
    next_day = firsts.groupBy("client", "day").agg(F.min("first").alias("first")).select("client", "day", F.lead("first").over(day.orderBy("day")).alias("next_day"))
    after = firsts.withColumn("next_minute", F.lead("first").over(minute.orderBy("minute"))).join(next_day, ["client", "day"]).select("client", "day", "minute", F.coalesce("next_minute", "next_day").alias("after"))
    until = F.coalesce(F.lead("known").over(instant.orderBy("known")), "after")
    return versions.join(after, ["client", "day", "minute"]).select("client", "known", until.alias("until"), "start"), versions


def as_of(versions: DataFrame, cuts: list[int | None]) -> DataFrame:
    """The version of each client that holds at each state's cut: client, state, cut, start.

    A state knows what arrived before its cut, or everything if that is None. The states are a fixed
    short list; a version meets each and is kept where its interval holds the cut."""
    states = F.array(*[F.struct(F.lit(i).alias("state"), F.lit(c).cast("long").alias("cut")) for i, c in enumerate(cuts)])
    met = versions.select("*", F.explode(states).alias("s")).select("client", "known", "until", "start", "s.state", "s.cut")
    holds = F.when(F.col("cut").isNull(), F.col("until").isNull()).otherwise((F.col("known") < F.col("cut")) & (F.col("until").isNull() | (F.col("until") >= F.col("cut"))))
    return met.where(holds).select("client", "state", "cut", "start")


def in_parts(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The events with a ``part``, and the parts of the clients that have several: client, parts."""
    sizes = events.groupBy("client").agg(F.count("*").alias("n"))
    total = events.count()
    limit = max(PART_ROWS, total // PARTS)
    # at most total / limit rows, so PARTS at most
    frequent = stored(sizes.where(F.col("n") > limit).select("client", F.ceil(F.col("n") / limit).cast("int").alias("parts")), "frequent-clients")
    part = F.coalesce(F.pmod(F.xxhash64("ts", "arrival", "cents"), "parts").cast("int"), F.lit(0))
    return events.join(F.broadcast(frequent), "client", "left").withColumn("part", part).drop("parts"), frequent


def retention(events: DataFrame, segments: DataFrame, cuts: list[datetime | None], cohort_days: int = 1, period_days: int = 1, start: str = "signup") -> DataFrame:
    """Retention cells of clients by segment, cohort and period, as known at each cut.

    ``events`` has client_id, ts, arrival (timestamps without zone), kind, value; ``segments`` has
    client_id, segment, updated_at. State i knows the events that arrived before ``cuts[i]``, all if that
    is None. A client's start is its earliest known event of kind ``start``; cohorts and periods are
    counted in days from 1970 and from the start. Columns: state, segment, cohort, period, users,
    users_crc32, moved (users whose cohort is another one in another state), cents.

    Equal event rows count once. Rows without ts or client_id are left out; without arrival they are known
    only to a state without cut; a null or non-finite value adds no cents; a sum of cents beyond 64 bits is
    null. Of several rows of a client in ``segments`` the one last updated counts (of equals the greatest
    segment, null being least); a null or missing segment is ''. Other kinds, null too, are events but no
    starts; clients without a start give no rows, and empty tables none. Texts of any length and extra
    columns of any names only tell rows apart.
    """
    at = [None if c is None else int((c - datetime(1970, 1, 1)).total_seconds()) * 1_000_000 + c.microsecond for c in cuts]
    value = F.col("value").cast("double")
    finite = ~(F.isnan(value) | (F.abs(value) == float("inf")))
    known = (
        events.distinct()
        .where("ts is not null and client_id is not null")
        .select(
            F.col("client_id").alias("client"),
            micros(F.col("ts")).alias("ts"),
            F.coalesce(micros(F.col("arrival")), F.lit(NEVER)).alias("arrival"),
            F.coalesce(F.col("kind") == start, F.lit(False)).alias("starts"),
            F.coalesce(F.when(finite, F.floor(value * 100 + 0.5)), F.lit(0)).cast("long").alias("cents"),
        )
    )
    known = stored(known, "retention-events")
    versions, instants = timeline(known.where("starts").select("client", "ts", "arrival"))
    at_cut = as_of(versions, at)
    cohort = floored(floored(F.col("start"), DAY), cohort_days)
    clients = at_cut.withColumn("cohort", cohort).groupBy("client").agg(F.sort_array(F.collect_list(F.struct("state", "cut", "start", "cohort"))).alias("states"), (F.min("cohort") < F.max("cohort")).alias("moved"))
    named = segments.where("client_id is not null").groupBy(F.col("client_id").alias("client")).agg(F.max_by("segment", F.struct("updated_at", "segment")).alias("segment"))
    clients = stored(clients.join(named, "client", "left").withColumn("segment", F.coalesce("segment", F.lit(""))), "retention-clients")
    dropped(instants)

    dealt, frequent = in_parts(known.select("client", "ts", "arrival", "cents"))
    spread = clients.join(F.broadcast(frequent), "client", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    holds = lambda s: (F.col("ts") >= s["start"]) & (s["cut"].isNull() | (F.col("arrival") < s["cut"]))
    seen = dealt.join(spread, ["client", "part"]).select("client", "segment", "moved", "ts", "cents", F.explode(F.filter("states", holds)).alias("s"))
    period = F.call_function("div", F.col("ts") - F.col("s.start"), F.lit(DAY * period_days))
    cell = ["state", "segment", "cohort", "period"]
    users = seen.select("client", "segment", "moved", "cents", "s.state", "s.cohort", period.alias("period")).groupBy(*cell, "client", "moved").agg(F.try_sum("cents").alias("cents"))
    return users.groupBy(*cell).agg(
        F.count("*").alias("users"),
        F.sum(F.crc32(F.col("client").cast("string"))).alias("users_crc32"),
        F.sum(F.col("moved").cast("long")).alias("moved"),
        F.when(F.count("cents") == F.count("*"), F.try_sum("cents")).alias("cents"),
    )


#: The query's cuts: what had arrived before that day, and everything.
CUTS = [datetime(2024, 2, 15), None]


def op13_cohorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retention of the clients of ``clicks`` by day. Clicks whose crc32 of click_id 3 divides arrive up to
    99 days after their recorded arrival."""
    clicks = table(spark, sf_dir, "clicks")
    h = F.crc32(F.col("click_id").cast("string"))
    # a null click_id has no crc32 and arrives as recorded
    days = F.when(h % 3 == 0, h % 100).otherwise(0).cast("int")
    arrival = F.col("arrived_at").cast("timestamp_ntz") + F.make_dt_interval(days)
    clients = table(spark, sf_dir, "clients").select("client_id", "segment", "updated_at")
    return retention(clicks.withColumn("arrival", arrival), clients, CUTS)


#: crc32 of an ASCII text in SQL: a table of the remainders of all bytes, then a fold over the text's bytes.
CRC_TABLE = "(SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN (x & 1) = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS tab)"


def crc_sql(text: str) -> str:
    """SQL for the crc32 of an ASCII text, beside a column ``tab`` of CRC_TABLE."""
    codes = f"list_transform(string_split({text}, ''), lambda ch: ascii(ch)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295)"


OP13_SQL = f"""
WITH crc AS {CRC_TABLE},
hashed AS (SELECT d.*, {crc_sql("d.click_id::VARCHAR")} AS h FROM (SELECT DISTINCT * FROM clicks) d, crc),
known AS (
  SELECT client_id, ts, kind, CASE WHEN value IS NULL OR isnan(value) OR isinf(value) THEN 0 ELSE floor(100 * value + 0.5)::BIGINT END AS cents,
    arrived_at + to_days(CASE WHEN h % 3 = 0 THEN (h % 100)::INTEGER ELSE 0 END) AS arrival
  FROM hashed WHERE ts IS NOT NULL AND client_id IS NOT NULL),
states AS (SELECT 0 AS state, TIMESTAMP '2024-02-15 00:00:00' AS cut UNION ALL SELECT 1, NULL),
seen AS (SELECT * FROM known, states WHERE cut IS NULL OR arrival < cut),
starts AS (SELECT state, client_id, min(ts) AS start FROM seen WHERE kind = 'signup' GROUP BY ALL),
cohorts AS (SELECT *, epoch_us(start) // {DAY} AS cohort FROM starts),
moving AS (SELECT client_id, count(DISTINCT cohort) > 1 AS moved FROM cohorts GROUP BY client_id),
named AS (SELECT client_id, segment FROM (SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY updated_at DESC NULLS LAST, segment DESC NULLS LAST) AS k FROM clients) WHERE k = 1),
users AS (
  SELECT s.state, coalesce(n.segment, '') AS segment, c.cohort, (epoch_us(s.ts) - epoch_us(c.start)) // {DAY} AS period, s.client_id, m.moved, sum(s.cents) AS cents
  FROM seen s JOIN cohorts c ON s.state = c.state AND s.client_id = c.client_id JOIN moving m ON s.client_id = m.client_id LEFT JOIN named n ON s.client_id = n.client_id
  WHERE s.ts >= c.start GROUP BY ALL)
SELECT state, segment, cohort, period, count(*) AS users, sum({crc_sql("client_id::VARCHAR")})::BIGINT AS users_crc32,
  sum(moved::BIGINT)::BIGINT AS moved, sum(cents)::BIGINT AS cents
FROM users, crc GROUP BY state, segment, cohort, period
"""
