"""Queries over the document library, each beside its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import fuzzy, layout, metadata, reading, store
from ..sources import journal_rankings, logged_sessions, papers, read, segments

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
NOW = "2024-01-31"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


SESSIONS = f"""WITH raw AS (SELECT event_id AS id, CAST(user_id AS VARCHAR) AS paper_id, 'paper-' || CAST(user_id AS VARCHAR) AS paper_name,
  strftime(ts, '%Y-%m-%d %H:%M:%S') AS start_time, CAST(floor(value) AS BIGINT) AS duration_seconds FROM events),
s AS (SELECT *, substr(start_time, 1, 10) AS date, CAST(substr(start_time, 12, 2) AS INTEGER) AS hour FROM raw WHERE duration_seconds >= {reading.MINIMUM_SECONDS}) """


def sessions(s: SparkSession, d: str) -> DataFrame:
    return reading.log(logged_sessions(s, d))


@query("session_log_filter", SESSIONS + "SELECT id, paper_id, paper_name, start_time, duration_seconds, date, hour FROM s")
def _(s, d):
    return sessions(s, d)


@query("report_total", SESSIONS + "SELECT CAST(coalesce(sum(duration_seconds), 0) AS BIGINT) AS total_seconds FROM s")
def _(s, d):
    return reading.total(sessions(s, d))


@query("report_leaderboard", SESSIONS + "SELECT paper_id, arg_max(paper_name, start_time) AS paper_name, CAST(sum(duration_seconds) AS BIGINT) AS total_seconds FROM s GROUP BY paper_id ORDER BY 3 DESC, 1 LIMIT 20")
def _(s, d):
    return reading.leaderboard(sessions(s, d))


@query("report_daily", SESSIONS + f"SELECT date, CAST(sum(duration_seconds) AS BIGINT) AS total_seconds FROM s WHERE date >= CAST(DATE '{NOW}' - 30 AS VARCHAR) GROUP BY date")
def _(s, d):
    return reading.daily(sessions(s, d), NOW)


@query("report_hourly_spine", SESSIONS + "SELECT CAST(h.range AS INTEGER) AS hour, CAST(coalesce(sum(duration_seconds), 0) AS BIGINT) AS total_seconds FROM range(24) h LEFT JOIN s ON s.hour = h.range GROUP BY 1")
def _(s, d):
    return reading.hourly(sessions(s, d))


@query("report_combined", SESSIONS + "SELECT CAST(grouping(date) * 2 + grouping(hour) AS INTEGER) AS part, date, hour, CAST(sum(duration_seconds) AS BIGINT) AS total_seconds FROM s GROUP BY GROUPING SETS ((date), (hour), ())")
def _(s, d):
    return reading.report(sessions(s, d))


@query("report_bars", SESSIONS + "SELECT date, CAST(sum(duration_seconds) AS BIGINT) AS total_seconds, greatest(CAST(sum(duration_seconds) AS BIGINT) / max(CAST(sum(duration_seconds) AS BIGINT)) OVER () * 100, 2.0) AS percent FROM s GROUP BY date")
def _(s, d):
    return reading.bars(reading.daily(sessions(s, d), NOW, 100))


@query("display_duration", SESSIONS + "SELECT id, CASE WHEN h > 0 AND m > 0 THEN h || '小时' || m || '分钟' WHEN h > 0 THEN h || '小时' ELSE m || '分钟' END AS shown FROM (SELECT id, duration_seconds * 37 // 3600 AS h, duration_seconds * 37 % 3600 // 60 AS m FROM s)")
def _(s, d):
    return sessions(s, d).select("id", text.duration_text(F.col("duration_seconds") * 37).alias("shown"))


@query("kv_upsert_latest", "SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY user_id")
def _(s, d):
    return store.latest_wins(read(s, d, "events").select("user_id", "event_type", "event_id"), ["user_id"], "event_id")


@query("paper_upsert_full_row", "SELECT o_custkey, o_orderkey, o_orderstatus, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS r FROM orders) WHERE r = 1")
def _(s, d):
    return store.latest_wins(read(s, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice"), ["o_custkey"], "o_orderkey")


@query("annotation_upsert_created_kept", "SELECT user_id, event_type, min(event_id) AS created, arg_max(props, event_id) AS props, max(event_id) AS updated FROM events GROUP BY user_id, event_type")
def _(s, d):
    return store.upsert_keeping_created(read(s, d, "events"), ["user_id", "event_type"], "props", "event_id")


@query("paper_patch_allowlist", "SELECT d.doc_id, coalesce(u.lang, d.lang) AS lang, d.source FROM documents d LEFT JOIN (SELECT doc_id, CASE WHEN quality = 1 THEN 'xx' END AS lang FROM labels) u ON d.doc_id = u.doc_id")
def _(s, d):
    updates = read(s, d, "labels").select("doc_id", F.when(F.col("quality") == 1, "xx").alias("lang"), F.lit("no").alias("source"))
    return store.patch(read(s, d, "documents").select("doc_id", "lang", "source"), updates, "doc_id", ["lang"])


@query("delete_antijoin", "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def _(s, d):
    return store.delete(read(s, d, "documents").select("doc_id", "lang"), read(s, d, "labels").where("toxic = 1"), ["doc_id"])


@query("storage_quota", "SELECT user_id, CAST(sum(length(props)) AS BIGINT) AS used, CAST(sum(length(props)) AS BIGINT) <= 5000 AS within FROM events GROUP BY user_id")
def _(s, d):
    return store.within_quota(read(s, d, "events"), "user_id", "event_type", "props", 5000)


@query("copy_numbered_names", "SELECT p_partkey, p_name, CASE WHEN r = 0 THEN p_name ELSE p_name || '_' || r END AS unique_name FROM (SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) - 1 AS r FROM part)")
def _(s, d):
    return store.numbered_names(read(s, d, "part").select("p_partkey", "p_name"), "p_name", "p_partkey")


PAPERS = """WITH p AS (SELECT doc_id AS id, 'doc-' || CAST(doc_id AS VARCHAR) || '.pdf' AS name, trim(regexp_replace(string_split(text, chr(10))[1], ' +', ' ', 'g')) AS title,
  lang AS language, source AS journal, n_chars AS file_size, text AS abstract FROM documents) """


@query("import_dedupe", PAPERS + "SELECT id, name FROM p WHERE name NOT IN (SELECT 'doc-' || CAST(doc_id AS VARCHAR) || '.pdf' FROM labels)")
def _(s, d):
    known = read(s, d, "labels").select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("name"))
    return store.delete(papers(s, d).select("id", "name"), known, ["name"])


@query("library_search", PAPERS + "SELECT id, title FROM p WHERE contains(lower(name), 'the') OR contains(lower(title), 'the')")
def _(s, d):
    return papers(s, d).where(F.lower("name").contains("the") | F.lower("title").contains("the")).select("id", "title")


@query("library_recent", "SELECT event_id FROM events WHERE ts > TIMESTAMP '2024-01-24 00:00:00'")
def _(s, d):
    return read(s, d, "events").where("ts > timestamp_ntz'2024-01-31 00:00:00' - interval 7 days").select("event_id")


@query("plugin_paper_query", PAPERS + "SELECT id, name, title, journal, title IS NOT NULL AS metadata_extracted FROM p WHERE journal = 'src3' AND (contains(lower(name), '1') OR contains(lower(title), '1'))")
def _(s, d):
    hit = (F.col("journal") == "src3") & (F.lower("name").contains("1") | F.lower("title").contains("1"))
    return papers(s, d).where(hit).select("id", "name", "title", "journal", F.col("title").isNotNull().alias("metadata_extracted"))


@query("library_counts", PAPERS + "SELECT language, count(*) AS papers, count(*) FILTER (WHERE file_size > 2000) AS long_papers FROM p GROUP BY language")
def _(s, d):
    return papers(s, d).groupBy("language").agg(F.count("*").alias("papers"), F.count_if(F.col("file_size") > 2000).alias("long_papers"))


@query("library_newest_first", PAPERS + "SELECT id, name FROM p ORDER BY id DESC")
def _(s, d):
    return papers(s, d).select("id", "name").orderBy(F.desc("id"))


@query("category_case", PAPERS + "SELECT id, CASE WHEN journal <> '' AND id % 3 = 0 THEN '期刊文章' WHEN id % 3 = 1 THEN '预印本' ELSE '文献' END AS category FROM p")
def _(s, d):
    p = papers(s, d)
    j, u = F.when(F.col("id") % 3 == 0, F.col("journal")), F.when(F.col("id") % 3 == 1, F.lit("https://arxiv.org/abs/2401.12345"))
    return p.select("id", text.category(j, F.lit(None).cast("string"), u, F.lit(None).cast("string")).alias("category"))


TENTHS = "CAST(({n}) // 10 AS VARCHAR) || '.' || CAST(({n}) % 10 AS VARCHAR)"
SIZE_KB, SIZE_MB = TENTHS.format(n="(size * 10 + 512) // 1024"), TENTHS.format(n="(size * 10 + 524288) // 1048576")


@query("display_size", PAPERS + f", z AS (SELECT id, CASE id % 3 WHEN 0 THEN file_size WHEN 1 THEN file_size * 700 END AS size FROM p) SELECT id, CASE WHEN size IS NULL OR size = 0 THEN '-' WHEN size < 1024 THEN CAST(size AS VARCHAR) || ' B' WHEN size < 1048576 THEN {SIZE_KB} || ' KB' ELSE {SIZE_MB} || ' MB' END AS shown FROM z")
def _(s, d):
    size = F.when(F.col("id") % 3 == 0, F.col("file_size")).when(F.col("id") % 3 == 1, F.col("file_size") * 700)
    return papers(s, d).select("id", text.file_size_text(size).alias("shown"))


FILE_KB, FILE_MB = TENTHS.format(n="(file_size * 10 + 512) // 1024"), TENTHS.format(n="(file_size * 10 + 524288) // 1048576")


@query("display_size_all", PAPERS + f"SELECT id, CASE WHEN file_size IS NULL OR file_size = 0 THEN '-' WHEN file_size < 1024 THEN CAST(file_size AS VARCHAR) || ' B' WHEN file_size < 1048576 THEN {FILE_KB} || ' KB' ELSE {FILE_MB} || ' MB' END AS shown FROM p")
def _(s, d):
    return papers(s, d).select("id", text.file_size_text(F.col("file_size")).alias("shown"))


@query("author_abbrev", "SELECT doc_id, CASE WHEN len(a) > 3 THEN array_to_string(a[1:3], ', ') || ' 等' ELSE array_to_string(a, ', ') END AS authors FROM (SELECT doc_id, string_split(text, ' ') AS a FROM documents)")
def _(s, d):
    return read(s, d, "documents").select("doc_id", text.author_list_text(F.split("text", " ")).alias("authors"))


def map_sql(words: dict[str, str], column: str) -> str:
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in words.items())
    return f"array_to_string(list_transform(string_split({column}, ' '), lambda w: CASE w {cases} ELSE w END), ' ')"


NORM = "trim(regexp_replace(regexp_replace(lower({c}), '[^\\p{{L}}\\p{{N}}\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
NAMES = "n AS (SELECT p_partkey, 'J. of ' || p_name || ' (Int. Sci.)' AS name FROM part)"


def part_names(s, d):
    return read(s, d, "part").select("p_partkey", F.concat(F.lit("J. of "), "p_name", F.lit(" (Int. Sci.)")).alias("name"))


@query("journal_normalize", f"WITH {NAMES} SELECT p_partkey, {NORM.format(c='name')} AS norm FROM n")
def _(s, d):
    return part_names(s, d).select("p_partkey", text.normalize_journal(F.col("name")).alias("norm"))


@query("journal_expand", f"WITH {NAMES}, m AS (SELECT p_partkey, {NORM.format(c='name')} AS norm FROM n) SELECT p_partkey, {map_sql(text.ABBREVIATIONS, 'norm')} AS expanded FROM m")
def _(s, d):
    return part_names(s, d).select("p_partkey", text.expand_journal(text.normalize_journal(F.col("name"))).alias("expanded"))


@query("journal_contract", f"WITH n AS (SELECT p_partkey, 'Journal of Applied ' || p_name AS name FROM part), m AS (SELECT p_partkey, {NORM.format(c='name')} AS norm FROM n) SELECT p_partkey, {map_sql(text.CONTRACTIONS, 'norm')} AS contracted FROM m")
def _(s, d):
    p = read(s, d, "part").select("p_partkey", F.concat(F.lit("Journal of Applied "), "p_name").alias("name"))
    return p.select("p_partkey", text.contract_journal(text.normalize_journal(F.col("name"))).alias("contracted"))


RANK = f"""WITH r0 AS (SELECT p_partkey AS ordinal, p_name AS journal, p_size % 4 + 1 AS zone, p_size % 10 = 0 AS is_top, p_size % 7 = 0 AS is_oa, {NORM.format(c='p_name')} AS journal_norm FROM part),
r AS (SELECT * FROM r0 WHERE journal_norm <> '' QUALIFY row_number() OVER (PARTITION BY journal_norm ORDER BY ordinal) = 1) """


@query("rankings_load", RANK + "SELECT ordinal, journal, zone, is_top, is_oa, journal_norm FROM r")
def _(s, d):
    return journal_rankings(s, d)


@query("rank_exact", RANK + "SELECT p_partkey, r.ordinal FROM part JOIN r ON " + NORM.format(c="upper(p_name)") + " = r.journal_norm")
def _(s, d):
    q = read(s, d, "part").withColumn("journal_norm", text.normalize_journal(F.upper("p_name")))
    return q.join(journal_rankings(s, d).select("journal_norm", "ordinal"), "journal_norm").select("p_partkey", "ordinal")


CONTAIN = """q AS (SELECT DISTINCT name, """ + NORM.format(c="name") + """ AS norm FROM (SELECT 'Annals of ' || p_name AS name FROM part)),
c AS (SELECT q.name, r.ordinal, row_number() OVER (PARTITION BY q.name ORDER BY length(r.journal_norm) DESC, r.ordinal) AS k FROM q JOIN r ON contains(q.norm, r.journal_norm) OR contains(r.journal_norm, q.norm) WHERE q.norm <> '')"""


@query("rank_containment", RANK + ", " + CONTAIN + " SELECT name, ordinal, 'containment' AS stage FROM c WHERE k = 1")
def _(s, d):
    q = read(s, d, "part").select(F.concat(F.lit("Annals of "), "p_name").alias("name")).distinct().withColumn("norm", text.normalize_journal(F.col("name")))
    return fuzzy.containment(q, journal_rankings(s, d))


TOKENS = "list_distinct(list_filter(string_split({c}, ' '), lambda w: strlen(w) > 2 AND NOT list_contains(['the','of','and','in','on','at','for','to','a','an','is','by','with','from','its'], w)))"


@query("rank_token_overlap", RANK + f""", q AS (SELECT DISTINCT name, {TOKENS.format(c=NORM.format(c='name'))} AS t FROM (SELECT array_to_string(list_reverse(string_split(p_name, ' ')), ' ') AS name FROM part)),
x AS (SELECT q.name, r.ordinal, len(list_intersect(q.t, {TOKENS.format(c='r.journal_norm')})) / greatest(len(q.t), len({TOKENS.format(c='r.journal_norm')})) AS overlap FROM q, r WHERE len(q.t) >= 2 AND length(r.journal_norm) > 5)
SELECT name, ordinal, 'tokens' AS stage FROM x WHERE overlap >= 0.6 QUALIFY row_number() OVER (PARTITION BY name ORDER BY overlap DESC, ordinal) = 1""")
def _(s, d):
    q = read(s, d, "part").select(F.array_join(F.reverse(F.split("p_name", " ")), " ").alias("name")).distinct().withColumn("expanded", text.normalize_journal(F.col("name")))
    return fuzzy.token_overlap(q, journal_rankings(s, d))


REVERSED = "array_to_string(list_reverse(string_split(p_name, ' ')), ' ')"
CASCADE = RANK + f""", q0 AS (SELECT DISTINCT name FROM (SELECT 'J. of ' || p_name || ' (Int. Sci.)' AS name FROM part UNION ALL SELECT upper(p_name) FROM part UNION ALL SELECT {REVERSED} FROM part)),
q1 AS (SELECT name, {NORM.format(c='name')} AS norm FROM q0), q AS (SELECT name, norm, {map_sql(text.ABBREVIATIONS, 'norm')} AS expanded, {map_sql(text.CONTRACTIONS, 'norm')} AS contracted FROM q1 WHERE norm <> ''),
e AS (SELECT q.*, a.ordinal AS o1, b.ordinal AS o2, c.ordinal AS o3 FROM q LEFT JOIN r a ON a.journal_norm = q.norm LEFT JOIN r b ON b.journal_norm = q.expanded LEFT JOIN r c ON c.journal_norm = q.contracted),
n AS (SELECT e.name, r.ordinal FROM e JOIN r ON contains(e.norm, r.journal_norm) OR contains(r.journal_norm, e.norm) WHERE coalesce(o1, o2, o3) IS NULL QUALIFY row_number() OVER (PARTITION BY e.name ORDER BY length(r.journal_norm) DESC, r.ordinal) = 1),
w AS (SELECT name, {TOKENS.format(c='expanded')} AS t FROM e WHERE coalesce(o1, o2, o3) IS NULL AND name NOT IN (SELECT name FROM n)), rt AS (SELECT ordinal, {TOKENS.format(c='journal_norm')} AS u FROM r WHERE length(journal_norm) > 5),
x AS (SELECT w.name, rt.ordinal, len(list_intersect(t, u)) / greatest(len(t), len(u)) AS overlap FROM w, rt WHERE len(t) >= 2 AND len(list_intersect(t, u)) / greatest(len(t), len(u)) >= 0.6 QUALIFY row_number() OVER (PARTITION BY w.name ORDER BY overlap DESC, rt.ordinal) = 1)
SELECT e.name, coalesce(o1, o2, o3, n.ordinal, x.ordinal) AS ordinal, CASE WHEN o1 IS NOT NULL THEN 'norm' WHEN o2 IS NOT NULL THEN 'expanded' WHEN o3 IS NOT NULL THEN 'contracted' WHEN n.ordinal IS NOT NULL THEN 'containment' WHEN x.ordinal IS NOT NULL THEN 'tokens' END AS stage FROM e LEFT JOIN n ON n.name = e.name LEFT JOIN x ON x.name = e.name"""


@query("rank_cascade", CASCADE)
def _(s, d):
    names = part_names(s, d).select("name").unionByName(read(s, d, "part").select(F.upper("p_name").alias("name"))).unionByName(read(s, d, "part").select(F.array_join(F.reverse(F.split("p_name", " ")), " ").alias("name")))
    return fuzzy.resolve(names, journal_rankings(s, d))


@query("keyword_union", "SELECT p_partkey, list_concat(a, list_filter(b, lambda x: NOT list_contains(list_transform(a, lambda y: lower(y)), lower(x)))) AS words FROM (SELECT p_partkey, string_split(p_name, ' ') AS a, string_split(upper(p_type), ' ') AS b FROM part)")
def _(s, d):
    return read(s, d, "part").select("p_partkey", text.keyword_union(F.split("p_name", " "), F.split(F.upper("p_type"), " ")).alias("words"))


@query("markup_strip", "SELECT page_id, regexp_replace(regexp_replace(html, '<[^>]*>', '', 'g'), '[{}]', '', 'g') AS plain FROM pages")
def _(s, d):
    return read(s, d, "pages").select("page_id", text.strip_markup(F.col("html")).alias("plain"))


@query("filename_sanitize", "SELECT page_id, left(trim(regexp_replace(url, '[\\\\/:*?\"<>|]', '_', 'g')), 60) AS file_name FROM pages")
def _(s, d):
    return read(s, d, "pages").select("page_id", text.file_name(F.col("url")).alias("file_name"))


@query("path_base_name", "SELECT page_id, string_split(url, '/')[-1] AS base FROM pages")
def _(s, d):
    return read(s, d, "pages").select("page_id", text.base_name(F.col("url")).alias("base"))


@query("snippet_search", "SELECT doc_id, substr(text, CAST(greatest(p - 40, 1) AS BIGINT), CAST(p - greatest(p - 40, 1) + 43 AS BIGINT)) AS snippet FROM (SELECT doc_id, text, instr(lower(text), 'the') AS p FROM documents) WHERE p > 0")
def _(s, d):
    return read(s, d, "documents").select("doc_id", text.snippet(F.col("text"), "the").alias("snippet")).where("snippet is not null")


@query("semver_gate", "SELECT p_partkey, (p_size % 4, p_size % 7, p_size % 3) >= (1, 4, 2) AS satisfied FROM part")
def _(s, d):
    v = F.concat_ws(".", *[(F.col("p_size") % k).cast("string") for k in (4, 7, 3)])
    return read(s, d, "part").select("p_partkey", text.semver_satisfied(v, F.lit("1.4.2")).alias("satisfied"))


@query("title_overlap_join", """WITH w AS (SELECT doc_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: length(x) > 2)) AS t FROM documents)
SELECT a.doc_id, CASE WHEN greatest(len(a.t), len(b.t)) = 0 THEN 0.0 ELSE len(list_intersect(a.t, b.t)) / greatest(len(a.t), len(b.t)) END AS overlap FROM w a JOIN w b ON b.doc_id = a.doc_id + 1""")
def _(s, d):
    # the words once a row, before the join, which then carries them and no texts
    w = read(s, d, "documents").select("doc_id", text.long_words(F.col("text")).alias("a"))
    return w.join(w.select((F.col("doc_id") - 1).alias("doc_id"), F.col("a").alias("b")), "doc_id").select("doc_id", text.overlap_of(F.col("a"), F.col("b")).alias("overlap"))


WORDS = """WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \\n]'), lambda x: x <> '') AS t FROM documents),
e AS (SELECT doc_id, unnest(t) AS text, unnest(range(len(t))) AS i FROM w),
seg AS (SELECT doc_id AS file_id, i // 8 // 40 AS page_index, i AS seg_ord, text, CAST(i % 8 * 40 AS DOUBLE) AS xmin, CAST(i // 8 % 40 * 14 + i // 8 % 40 // 5 * 20 AS DOUBLE) AS ymin FROM e),
segments AS (SELECT *, xmin + 36 AS xmax, ymin + 10 AS ymax FROM seg),
boxes AS (SELECT DISTINCT file_id, page_index, b AS box_ord, CAST(b * 4 % 25 AS BIGINT) AS cls_id, CAST(5 - b AS BIGINT) AS read_order, b * 30.0 AS xmin, b * 90.0 AS ymin, b * 30.0 + 150 AS xmax, b * 90.0 + 120 AS ymax FROM segments, (SELECT unnest([0, 1, 2, 3, 4]) AS b)),
inside AS (SELECT s.*, b.box_ord, b.cls_id, b.read_order FROM segments s JOIN boxes b ON s.file_id = b.file_id AND s.page_index = b.page_index AND (s.xmin + s.xmax) / 2 BETWEEN b.xmin AND b.xmax AND (s.ymin + s.ymax) / 2 BETWEEN b.ymin AND b.ymax) """


def boxes(s, d):
    b = F.explode(F.array(*[F.lit(k) for k in range(5)])).alias("box_ord")
    p = segments(s, d).select("file_id", "page_index").distinct().select("file_id", "page_index", b)
    k = F.col("box_ord")
    return p.select("file_id", "page_index", "box_ord", (k * 4 % 25).cast("long").alias("cls_id"), (5 - k).cast("long").alias("read_order"), (k * 30.0).alias("xmin"), (k * 90.0).alias("ymin"), (k * 30.0 + 150).alias("xmax"), (k * 90.0 + 120).alias("ymax"))


@query("box_assign_first", WORDS + "SELECT file_id, page_index, seg_ord, box_ord, cls_id, read_order FROM inside QUALIFY row_number() OVER (PARTITION BY file_id, page_index, seg_ord ORDER BY read_order, box_ord) = 1")
def _(s, d):
    return layout.assigned(segments(s, d), boxes(s, d))


@query("box_unassigned", WORDS + "SELECT file_id, page_index, seg_ord, text FROM segments s WHERE NOT EXISTS (SELECT 1 FROM inside i WHERE i.file_id = s.file_id AND i.page_index = s.page_index AND i.seg_ord = s.seg_ord)")
def _(s, d):
    return layout.unassigned(segments(s, d), boxes(s, d)).select("file_id", "page_index", "seg_ord", "text")


@query("garbage_removed", WORDS + "SELECT file_id, page_index, seg_ord, text FROM segments s WHERE trim(text) <> '' AND NOT EXISTS (SELECT 1 FROM inside i WHERE i.cls_id IN (8, 9, 11, 12, 13, 16, 20) AND i.file_id = s.file_id AND i.page_index = s.page_index AND i.seg_ord = s.seg_ord)")
def _(s, d):
    return layout.without_garbage(segments(s, d), boxes(s, d)).select("file_id", "page_index", "seg_ord", "text")


@query("class_text", WORDS + "SELECT file_id, page_index, box_ord, string_agg(text, ' ' ORDER BY seg_ord) AS text FROM inside WHERE cls_id = 4 GROUP BY file_id, page_index, box_ord")
def _(s, d):
    return layout.class_text(segments(s, d), boxes(s, d), 4)


@query("upper_median_height", WORDS + "SELECT file_id, page_index, coalesce(list_sort(list(h) FILTER (WHERE h > 0))[count(*) FILTER (WHERE h > 0) // 2 + 1], 12.0) AS median FROM (SELECT *, ymax - ymin + length(text) % 7 - 11 AS h FROM segments) GROUP BY file_id, page_index")
def _(s, d):
    return segments(s, d).withColumn("h", F.col("ymax") - F.col("ymin") + F.length("text") % 7 - 11).groupBy("file_id", "page_index").agg(F.coalesce(layout.upper_median(F.when(F.col("h") > 0, F.col("h"))), F.lit(12.0)).alias("median"))


@query("row_band_order", WORDS + "SELECT file_id, page_index, seg_ord, CAST(row_number() OVER (PARTITION BY file_id, page_index ORDER BY round((ymin + ymax) / 2 / 8.0), xmin, seg_ord) AS INTEGER) AS rank FROM segments")
def _(s, d):
    return layout.row_band_order(segments(s, d), 8.0).select("file_id", "page_index", "seg_ord", "rank")


@query("fulltext_markers", WORDS + "SELECT file_id, string_agg('[Page ' || (page_index + 1) || ']' || chr(10) || t, chr(10) || chr(10) ORDER BY page_index) AS text FROM (SELECT file_id, page_index, string_agg(text, ' ' ORDER BY seg_ord) AS t FROM segments GROUP BY file_id, page_index) GROUP BY file_id")
def _(s, d):
    return layout.full_text(layout.page_texts(segments(s, d)))


@query("paragraph_merge")
def _(s, d):
    return layout.merge_paragraphs(segments(s, d))


@query("paragraph_merge_boxes")
def _(s, d):
    return layout.merge_with_boxes(segments(s, d), boxes(s, d))


@query("outline_parent", "WITH o AS (SELECT conv_id AS file_id, turn AS ord, length(text) % 4 AS level FROM conversations) SELECT o.file_id, o.ord, o.level, max(p.ord) AS parent FROM o LEFT JOIN o p ON p.file_id = o.file_id AND p.ord < o.ord AND p.level < o.level GROUP BY ALL")
def _(s, d):
    return metadata.outline_parents(read(s, d, "conversations").select(F.col("conv_id").alias("file_id"), F.col("turn").alias("ord"), (F.length("text") % 4).cast("long").alias("level")))


@query("qa_prompt", "SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS prompt FROM conversations GROUP BY conv_id")
def _(s, d):
    m = F.array_sort(F.collect_list(F.struct("turn", F.concat("role", F.lit(": "), "text").alias("x"))))
    return read(s, d, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(m, lambda x: x["x"]), "\n").alias("prompt"))


@query("prefetch_order", "SELECT p_partkey, CASE WHEN p_size >= 20 THEN (p_size - 20) * 2 ELSE (20 - p_size) * 3 + 1 END AS priority FROM part")
def _(s, d):
    p = F.col("p_size")
    return read(s, d, "part").select("p_partkey", F.when(p >= 20, (p - 20) * 2).otherwise((20 - p) * 3 + 1).alias("priority"))


@query("merge_remote", "SELECT d.doc_id, coalesce(nullif(trim(CASE WHEN d.doc_id % 2 = 0 THEN b.text END), ''), d.lang) AS title FROM documents d LEFT JOIN benchmark b ON b.item_id = d.doc_id")
def _(s, d):
    b = read(s, d, "benchmark").select(F.col("item_id").alias("doc_id"), F.col("text").alias("remote"))
    return read(s, d, "documents").join(b, "doc_id", "left").select("doc_id", metadata.override(F.col("lang"), F.when(F.col("doc_id") % 2 == 0, F.col("remote"))).alias("title"))


# Structured markup around the benchmark's texts: heads of several kinds, empty paragraphs, figures and tables.
TEI = [
    "<TEI><teiHeader><div><head>not here</head></div></teiHeader><text><body><div xmlns='x'><head n='1.2'>1.2.3 Looms &amp; <hi>webs</hi></head><p>", "</p><p> </p><P>Second <ref>[1]</ref>.</P></div><DIV><p>no head</p></DIV><div><p> </p></div>",
    "<div><head>12345.1.1.1.1.1.1 deep</head></div><div><head></head><p>", "</p></div>", "<figure type=\"figure\"><label>2</label><figDesc>A <b>loom</b></figDesc></figure>", "<figure><head>none</head></figure><figure><label>7</label><figDesc>seven</figDesc><graphic xml:id=\"g7\"/></figure>",
    "<figure type=\"table\"><label>3</label><figDesc>Sizes</figDesc></figure>", "<table><row/></table><table><figDesc>plain</figDesc></table>", "</body></text></TEI>",
]
TEI_SQL = "WITH t AS (SELECT item_id, concat({0}, text, {1}, {2}, repeat('thread and loom ', CAST(item_id % 3 * 100 AS BIGINT)), {3}, CASE WHEN item_id % 2 = 0 THEN {4} ELSE {5} END, CASE WHEN item_id % 3 = 0 THEN {6} ELSE {7} END, {8}) AS x FROM benchmark), b AS (SELECT item_id, regexp_extract(x, '(?is)<body[^>]*>(.*?)</body>', 1) AS x FROM t), ".format(*["'" + x.replace("'", "''") + "'" for x in TEI])
BARE = "regexp_replace(regexp_replace({x}, '<[^>]+>', '', 'g'), '^\\s+|\\s+$', '', 'g')"


def element_sql(name: str, x: str = "x") -> str:
    pattern = f"'(?is)<{name}\\b[^>]*>(.*?)</{name}>'"
    return f"CASE WHEN regexp_matches({x}, {pattern}) THEN {BARE.format(x=f'regexp_extract({x}, {pattern}, 1)')} END"


def tei(s, d):
    k, p = F.col("item_id"), [F.lit(x) for x in TEI]
    x = F.concat(p[0], F.col("text"), p[1], p[2], F.repeat(F.lit("thread and loom "), (k % 3 * 100).cast("int")), p[3], F.when(k % 2 == 0, p[4]).otherwise(p[5]), F.when(k % 3 == 0, p[6]).otherwise(p[7]), p[8])
    return read(s, d, "benchmark").select("item_id", x.alias("x"))


@query("tei_sections", TEI_SQL + f"""l AS (SELECT item_id, regexp_extract_all(x, '(?is)<div\\b[^>]*>(.*?)</div>', 1) AS found FROM b), e AS (SELECT item_id, unnest(range(len(found))) AS sec_ord, unnest(found) AS x FROM l),
c AS (SELECT item_id, sec_ord, {element_sql('head')} AS title, array_to_string(list_filter(list_transform(regexp_extract_all(x, '(?is)<p\\b[^>]*>(.*?)</p>', 1), lambda y: {BARE.format(x='y')}), lambda y: y <> ''), ' ') AS content FROM e)
SELECT item_id, CAST(sec_ord AS INTEGER) AS sec_ord, title, CAST(coalesce(least(6, length(regexp_replace(regexp_extract(title, '^([0-9][0-9.]*)', 1), '[0-9]', '', 'g')) + 1), 1) AS INTEGER) AS level, CASE WHEN strlen(content) > 2000 THEN substr(content, 1, 2000) ELSE content END AS content FROM c WHERE title IS NOT NULL OR content <> ''""")
def _(s, d):
    return metadata.sections(tei(s, d), "item_id", "x")


DESCRIBED = "coalesce(nullif(regexp_extract(x, 'xml:id\\s*=\\s*\"([^\"]+)\"', 1), ''), " + element_sql("label") + ") AS label, " + element_sql("figDesc") + " AS caption"


@query("tei_figures", TEI_SQL + f"""l AS (SELECT item_id, regexp_extract_all(x, '(?is)<figure\\b[^>]*type\\s*=\\s*"figure"[^>]*>(.*?)</figure>', 1) AS known, list_filter(regexp_extract_all(x, '(?is)<figure\\b[^>]*>(.*?)</figure>', 1), lambda y: NOT contains(y, 'type="table"') AND (contains(y, '<label') OR contains(y, '<figDesc'))) AS others FROM b),
m AS (SELECT item_id, CASE WHEN len(known) > 0 THEN known ELSE others END AS found FROM l), e AS (SELECT item_id, unnest(range(len(found))) AS fig_ord, unnest(found) AS x FROM m) SELECT item_id, CAST(fig_ord AS INTEGER) AS fig_ord, {DESCRIBED} FROM e""")
def _(s, d):
    return metadata.figures(tei(s, d), "item_id", "x")


@query("tei_tables", TEI_SQL + f"""l AS (SELECT item_id, regexp_extract_all(x, '(?is)<figure\\b[^>]*type\\s*=\\s*"table"[^>]*>(.*?)</figure>', 1) AS known, regexp_extract_all(x, '(?is)<table\\b[^>]*>(.*?)</table>', 1) AS plain FROM b),
m AS (SELECT item_id, len(known) > 0 AS named, CASE WHEN len(known) > 0 THEN known ELSE plain END AS found FROM l), e AS (SELECT item_id, named, unnest(range(len(found))) AS tab_ord, unnest(found) AS x FROM m),
o AS (SELECT item_id, named, CAST(tab_ord AS INTEGER) AS tab_ord, {DESCRIBED} FROM e) SELECT item_id, tab_ord, CASE WHEN named THEN label ELSE 'T' || (tab_ord + 1) END AS label, caption FROM o""")
def _(s, d):
    return metadata.tables(tei(s, d), "item_id", "x")


@query("title_by_font", WORDS + """, f AS (SELECT *, 8.0 + length(text) % 5 AS font_size FROM segments), m AS (SELECT *, max(font_size) OVER (PARTITION BY file_id, page_index) AS largest FROM f)
SELECT file_id, page_index, trim(string_agg(trim(text), ' ' ORDER BY seg_ord)) AS title FROM m WHERE font_size >= largest * 0.9 GROUP BY ALL HAVING title <> ''""")
def _(s, d):
    return metadata.title_by_font(segments(s, d).withColumn("font_size", F.length("text") % 5 + 8.0))


@query("reference_enrichment", """SELECT l_orderkey AS file_id, CAST(l_linenumber - 1 AS BIGINT) AS ref_index, coalesce(CASE WHEN o_custkey % 3 <> 0 THEN o_orderpriority END, l_linestatus) AS journal, l_returnflag AS doi,
  CASE WHEN o_custkey % 2 = 0 THEN o_orderstatus END AS ranking_journal, CASE WHEN o_custkey % 2 = 0 THEN CAST(o_custkey % 4 + 1 AS BIGINT) END AS zone, CASE WHEN o_custkey % 2 = 0 THEN coalesce(o_custkey % 5 = 0, false) END AS is_top
FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey AND o_custkey % 7 = l_linenumber - 1""")
def _(s, d):
    k = F.col("o_custkey")
    refs = read(s, d, "lineitem").select(F.col("l_orderkey").alias("file_id"), (F.col("l_linenumber") - 1).cast("long").alias("ref_index"), F.col("l_linestatus").alias("journal"), F.col("l_returnflag").alias("doi"))
    patches = read(s, d, "orders").select(
        F.col("o_orderkey").alias("file_id"), (k % 7).cast("long").alias("ref_index"), F.when(k % 3 != 0, F.col("o_orderpriority")).alias("journal"), F.lit(None).cast("string").alias("doi"),
        F.col("o_orderstatus").alias("ranking_journal"), F.when(k % 2 == 0, (k % 4 + 1).cast("long")).alias("ranking_zone"), (k % 5 == 0).alias("ranking_is_top"), F.lit(None).cast("boolean").alias("ranking_is_oa"),
    )
    return metadata.enriched(refs, patches).select("file_id", "ref_index", "journal", "doi", F.col("ranking.journal").alias("ranking_journal"), "ranking.zone", "ranking.is_top")
