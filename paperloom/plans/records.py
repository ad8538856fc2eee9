"""Queries over library records, annotations, files and reconciliation, each beside its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import metadata, records, store
from ..sources import read
from .library import PAPERS, SESSIONS, query, sessions

# --- settings and key-value reads -----------------------------------------------------------------

SETTINGS = "WITH settings AS (SELECT 'c' || CAST(c_custkey AS VARCHAR) AS key, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE c_mktsegment END AS value FROM customer) "


def settings(s, d):
    k = F.col("c_custkey")
    return read(s, d, "customer").select(F.concat(F.lit("c"), k.cast("string")).alias("key"), F.when(k % 5 == 0, "").otherwise(F.col("c_mktsegment")).alias("value"))


@query("settings_scan", SETTINGS + "SELECT key, value FROM settings ORDER BY key")
def _(s, d):
    return settings(s, d).orderBy("key")


@query("settings_get", SETTINGS + "SELECT value FROM settings WHERE key = 'c7'")
def _(s, d):
    return settings(s, d).where("key = 'c7'").select("value")


@query("settings_write_or_delete", SETTINGS + "SELECT key, value FROM settings WHERE value <> ''")
def _(s, d):
    given = settings(s, d).withColumn("value", records.filled_in(F.col("value")))
    return store.delete(given, given.where("value is null"), ["key"])


@query("settings_typed", "SELECT event_id, coalesce(try_cast(json_extract_string(props, '$.k') AS INTEGER), 12) AS number, coalesce(try_cast(event_type AS BOOLEAN), true) AS flag FROM events")
def _(s, d):
    return read(s, d, "events").select("event_id", F.coalesce(F.get_json_object("props", "$.k").try_cast("int"), F.lit(12)).alias("number"), F.coalesce(F.col("event_type").try_cast("boolean"), F.lit(True)).alias("flag"))


@query("settings_empty", "SELECT count(*) = 0 AS is_empty FROM customer")
def _(s, d):
    return read(s, d, "customer").agg((F.count("*") == 0).alias("is_empty"))


@query("storage_list", "SELECT DISTINCT event_type AS key FROM events WHERE user_id = 7 ORDER BY key")
def _(s, d):
    return read(s, d, "events").where("user_id = 7").select(F.col("event_type").alias("key")).distinct().orderBy("key")


QUOTA = """WITH kv AS (SELECT user_id, event_type, arg_max(props, event_id) AS props FROM events GROUP BY ALL),
n AS (SELECT user_id, event_type, repeat(arg_max(props, event_id), 4) AS v FROM events WHERE event_id % 3 = 0 GROUP BY ALL),
u AS (SELECT n.user_id, n.event_type, CAST(coalesce(sum(length(kv.props)) FILTER (WHERE kv.event_type <> n.event_type), 0) AS BIGINT) AS used, any_value(strlen(n.v)) AS size FROM n LEFT JOIN kv ON kv.user_id = n.user_id GROUP BY ALL)
SELECT user_id, event_type, used, used + size <= 50 AS accepted FROM u"""


@query("storage_set_quota", QUOTA)
def _(s, d):
    e = read(s, d, "events")
    kv = store.latest_wins(e.select("user_id", "event_type", "props", "event_id"), ["user_id", "event_type"], "event_id")
    new = store.latest_wins(e.where("event_id % 3 = 0").select("user_id", "event_type", F.repeat("props", 4).alias("props"), "event_id"), ["user_id", "event_type"], "event_id")
    return store.quota_checked(kv, new, "user_id", "event_type", "props", 50).select("user_id", "event_type", "used", "accepted")


# --- records and views ----------------------------------------------------------------------------

RECORDS = """WITH rec AS (SELECT doc_id AS id, 'doc-' || CAST(doc_id AS VARCHAR) || '.pdf' AS name, '/in/' || CAST(doc_id AS VARCHAR) AS original_path, CASE doc_id % 3 WHEN 0 THEN '/lib/' || CAST(doc_id AS VARCHAR) WHEN 1 THEN '' END AS managed_path,
  '2024-01-' || lpad(CAST(doc_id % 28 + 1 AS VARCHAR), 2, '0') AS import_date, CASE WHEN doc_id % 4 <> 0 THEN n_chars ELSE 0 END AS file_size, nullif(string_split(text, chr(10))[1], '') AS title, CASE WHEN doc_id % 6 = 0 THEN '' ELSE text END AS abstract,
  source AS journal, CASE WHEN doc_id % 2 = 0 THEN '2024' END AS date, CAST(NULL AS VARCHAR) AS doi, lang AS language,
  CASE doc_id % 4 WHEN 0 THEN '["Ada Lovelace","Alan Turing"]' WHEN 1 THEN 'not json' WHEN 2 THEN '[]' END AS authors, CASE WHEN doc_id % 5 = 0 THEN '["Loom"]' END AS keywords, doc_id % 7 <> 0 AS metadata_extracted FROM documents),
lists AS (SELECT *, CASE doc_id4 WHEN 0 THEN ['Ada Lovelace', 'Alan Turing'] WHEN 2 THEN CAST([] AS VARCHAR[]) END AS author_list, CASE WHEN id % 5 = 0 THEN ['Loom'] END AS keyword_list FROM (SELECT *, id % 4 AS doc_id4 FROM rec)) """


def library(s, d):
    k = F.col("doc_id")
    name = k.cast("string")
    return read(s, d, "documents").select(
        k.alias("id"), F.concat(F.lit("doc-"), name, F.lit(".pdf")).alias("name"), F.concat(F.lit("/in/"), name).alias("original_path"),
        F.when(k % 3 == 0, F.concat(F.lit("/lib/"), name)).when(k % 3 == 1, "").alias("managed_path"), F.concat(F.lit("2024-01-"), F.lpad((k % 28 + 1).cast("string"), 2, "0")).alias("import_date"),
        F.when(k % 4 != 0, F.col("n_chars")).otherwise(0).alias("file_size"), F.nullif(F.get(F.split("text", "\n"), 0), F.lit("")).alias("title"), F.when(k % 6 == 0, "").otherwise(F.col("text")).alias("abstract"),
        F.col("source").alias("journal"), F.when(k % 2 == 0, "2024").alias("date"), F.lit(None).cast("string").alias("doi"), F.col("lang").alias("language"),
        F.when(k % 4 == 0, '["Ada Lovelace","Alan Turing"]').when(k % 4 == 1, "not json").when(k % 4 == 2, "[]").alias("authors"), F.when(k % 5 == 0, '["Loom"]').alias("keywords"), (k % 7 != 0).alias("metadata_extracted"),
    )


VIEW = "id, name, coalesce(nullif(managed_path, ''), original_path) AS path, original_path, managed_path, import_date, file_size, " + ", ".join(f"CASE WHEN metadata_extracted THEN {c} END AS {c}" for c in records.FIELDS) + ", CASE WHEN metadata_extracted THEN author_list END AS authors, CASE WHEN metadata_extracted THEN keyword_list END AS keywords, metadata_extracted"


@query("record_to_view", RECORDS + f"SELECT {VIEW} FROM lists")
def _(s, d):
    return records.to_view(library(s, d))


BACK = "id, name, coalesce(nullif(original_path, ''), path) AS original_path, nullif(managed_path, '') AS managed_path, import_date, file_size, " + ", ".join(f"nullif({c}, '') AS {c}" for c in records.FIELDS) + ", CASE WHEN len(authors) > 0 THEN '[\"' || array_to_string(authors, '\",\"') || '\"]' END AS authors, CASE WHEN len(keywords) > 0 THEN '[\"' || array_to_string(keywords, '\",\"') || '\"]' END AS keywords, metadata_extracted"


@query("view_to_record", RECORDS + f"SELECT {BACK} FROM (SELECT {VIEW} FROM lists)")
def _(s, d):
    return records.to_record(records.to_view(library(s, d)))


@query("managed_path_get", RECORDS + "SELECT managed_path FROM rec WHERE id = 3")
def _(s, d):
    return library(s, d).where("id = 3").select("managed_path")


@query("library_search_authors", RECORDS + f"SELECT id FROM (SELECT {VIEW} FROM lists) WHERE contains(lower(name), 'turing') OR contains(lower(title), 'turing') OR contains(lower(array_to_string(authors, chr(1))), 'turing')")
def _(s, d):
    return records.searched(records.to_view(library(s, d)), "Turing").select("id")


@query("library_favourites", RECORDS + "SELECT id FROM rec WHERE false")
def _(s, d):
    return records.favourites(library(s, d)).select("id")


@query("library_fields_shown", RECORDS + "SELECT id, f AS field, v AS value FROM (SELECT id, unnest(['title', 'abstract', 'journal', 'date']) AS f, unnest([title, abstract, journal, date]) AS v FROM rec) WHERE regexp_replace(v, '\\s', '', 'g') <> ''")
def _(s, d):
    return records.shown_fields(library(s, d), ["title", "abstract", "journal", "date"])


@query("size_backfill", RECORDS + "SELECT rec.id, coalesce(nullif(file_size, 0), n) AS file_size FROM rec LEFT JOIN (SELECT doc_id, quality * 100 + 5 AS n FROM labels QUALIFY row_number() OVER (PARTITION BY doc_id) = 1) l ON l.doc_id = rec.id")
def _(s, d):
    files = read(s, d, "labels").select(F.concat(F.lit("/in/"), F.col("doc_id").cast("string")).alias("path"), (F.col("quality") * 100 + 5).cast("long").alias("size"))
    return records.sizes_filled(library(s, d).withColumn("path", F.col("original_path")).withColumn("file_size", F.col("file_size").cast("long")), files).select("id", "file_size")


@query("import_append", "SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN 'old' ELSE 'new' END AS origin FROM documents")
def _(s, d):
    docs = read(s, d, "documents").select(F.col("doc_id").alias("id"))
    return docs.where("id % 3 = 0").withColumn("origin", F.lit("old")).unionByName(docs.where("id % 3 <> 0").withColumn("origin", F.lit("new")))


FILES = "WITH f AS (SELECT p_partkey, p_name || '.' || ['pdf', 'PNG', 'txt', 'jpeg', 'tar.gz'][p_partkey % 5 + 1] AS path FROM part) "


def files(s, d):
    endings = F.array(*[F.lit(x) for x in ("pdf", "PNG", "txt", "jpeg", "tar.gz")])
    return read(s, d, "part").select("p_partkey", F.concat("p_name", F.lit("."), F.get(endings, (F.col("p_partkey") % 5).cast("int"))).alias("path"))


@query("import_allowed", FILES + "SELECT p_partkey, path FROM f WHERE lower(string_split(path, '.')[-1]) IN ('pdf', 'png', 'jpg', 'jpeg', 'bmp', 'webp')")
def _(s, d):
    return records.importable(files(s, d))


@query("document_dispatch", FILES + "SELECT p_partkey, CASE WHEN lower(path) LIKE '%.pdf' THEN 'page' ELSE 'image' END AS kind, CASE WHEN lower(path) LIKE '%.pdf' THEN least(p_partkey % 9, 3) ELSE 0 END AS page FROM f")
def _(s, d):
    x = records.kind_of_file(F.col("path"), F.col("p_partkey") % 9, F.lit(4).cast("long"))
    return files(s, d).select("p_partkey", x.alias("x")).select("p_partkey", "x.kind", F.col("x.page").cast("long").alias("page"))


@query("batch_parse_queue", FILES + "SELECT p_partkey FROM f WHERE lower(path) LIKE '%.pdf' AND path NOT IN (SELECT path FROM f WHERE p_partkey % 15 = 0)")
def _(s, d):
    f = files(s, d)
    return records.to_parse(f, f.where("p_partkey % 15 = 0")).select("p_partkey")


@query("image_sniff", """WITH f AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '89504e47' WHEN 1 THEN 'ffd8' WHEN 2 THEN '00ffd8' WHEN 3 THEN '8950' ELSE '' END || substr(lower(hex(encode(substr(text, 1, 6)))), 1, CAST(doc_id % 7 * 2 AS BIGINT)) AS h FROM documents)
SELECT doc_id, CASE WHEN length(h) >= 16 AND starts_with(h, '89504e47') THEN 'png' WHEN starts_with(h, 'ffd8') THEN 'jpeg' ELSE 'raw' END AS format FROM f""")
def _(s, d):
    k = F.col("doc_id") % 5
    head = F.when(k == 0, "89504e47").when(k == 1, "ffd8").when(k == 2, "00ffd8").when(k == 3, "8950").otherwise("")
    more = F.substring(F.lower(F.hex(F.encode(F.substring("text", 1, 6), "UTF-8"))), F.lit(1), (F.col("doc_id") % 7 * 2).cast("int"))
    return read(s, d, "documents").select("doc_id", records.image_format(F.unhex(F.concat(head, more))).alias("format"))


@query("document_info", "SELECT item_id, nullif(CASE WHEN item_id % 2 = 0 THEN text ELSE '' END, '') AS title, nullif('', '') AS author, CAST(strlen(text) AS BIGINT) AS size FROM benchmark")
def _(s, d):
    title = F.when(F.col("item_id") % 2 == 0, F.col("text")).otherwise("")
    return read(s, d, "benchmark").select("item_id", records.filled_in(title).alias("title"), records.filled_in(F.lit("")).alias("author"), F.octet_length("text").cast("long").alias("size"))


@query("page_text", "SELECT text FROM conversations WHERE conv_id = 1 AND turn = 0")
def _(s, d):
    return read(s, d, "conversations").where("conv_id = 1 and turn = 0").select("text")


@query("page_count", "SELECT conv_id, count(*) AS pages FROM conversations GROUP BY conv_id")
def _(s, d):
    return read(s, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("pages"))


# --- rankings of papers ---------------------------------------------------------------------------

LOOKED = """WITH v AS (SELECT p_partkey AS id, p_brand AS journal, CASE WHEN p_partkey % 3 = 0 THEN p_type WHEN p_partkey % 3 = 1 THEN '' END AS journal_abbrev FROM part),
found AS (SELECT DISTINCT p_brand AS journal, CASE WHEN p_brand LIKE '%1' THEN NULL ELSE 2 END AS zone FROM part WHERE p_brand LIKE '%1' OR p_brand LIKE '%3' UNION SELECT DISTINCT p_type, 3 FROM part WHERE p_type < 'M') """


def views_found(s, d):
    p = read(s, d, "part")
    k = F.col("p_partkey")
    views = p.select(k.alias("id"), F.col("p_brand").alias("journal"), F.when(k % 3 == 0, F.col("p_type")).when(k % 3 == 1, "").alias("journal_abbrev"))
    brand = F.col("p_brand")
    found = p.where(brand.endswith("1") | brand.endswith("3")).select(brand.alias("journal"), F.when(~brand.endswith("1"), 2).alias("zone"))
    return views, found.unionByName(p.where("p_type < 'M'").select(F.col("p_type").alias("journal"), F.lit(3).alias("zone"))).distinct()


@query("paper_ranking", LOOKED + "SELECT id, CASE WHEN a.journal IS NOT NULL THEN a.zone ELSE b.zone END AS zone FROM v LEFT JOIN found a ON a.journal = v.journal LEFT JOIN found b ON b.journal = v.journal_abbrev")
def _(s, d):
    return records.ranked(*views_found(s, d)).select("id", "zone")


@query("paper_ranking_each", LOOKED + "SELECT id, coalesce(a.zone, b.zone) AS zone FROM v LEFT JOIN found a ON a.journal = v.journal LEFT JOIN found b ON b.journal = v.journal_abbrev")
def _(s, d):
    return records.ranked_each(*views_found(s, d)).select("id", "zone")


@query("journals_to_look_up", LOOKED + "SELECT j AS journal FROM (SELECT journal AS j FROM v UNION SELECT journal_abbrev FROM v) WHERE j <> '' AND j NOT IN (SELECT journal FROM found)")
def _(s, d):
    return records.journals_to_look_up(*views_found(s, d))


@query("zone_label", "SELECT p_partkey, CASE p_size % 6 WHEN 1 THEN '一区' WHEN 2 THEN '二区' WHEN 3 THEN '三区' WHEN 4 THEN '四区' ELSE CAST(p_size % 6 AS VARCHAR) || '区' END AS label FROM part")
def _(s, d):
    return read(s, d, "part").select("p_partkey", text.zone_label(F.col("p_size") % 6).alias("label"))


CATEGORIES = ["", "Journal-Article", "book journal", "proceedings-article", "Conference", "book-chapter", "REPORT", "dissertation thesis", "posted-content", "Preprint", "dataset"]
LADDER = " ".join("WHEN " + " OR ".join(f"contains(lower(g), '{w}')" for w in ws) + f" THEN '{n}'" for n, ws in text.CATEGORY_WORDS)


@query("category_ladder", f"""WITH c AS (SELECT p_partkey, nullif({CATEGORIES}[p_partkey % 12 + 1], '') AS g, CASE p_size % 3 WHEN 0 THEN p_brand WHEN 1 THEN '' END AS journal, CASE WHEN p_size % 4 = 1 THEN '978' ELSE '' END AS isbn, CASE WHEN p_size % 5 < 3 THEN 'https://arxiv.org/abs/1' END AS url FROM part)
SELECT p_partkey, CASE WHEN g IS NOT NULL THEN CASE {LADDER} ELSE '文献' END WHEN journal <> '' THEN '期刊文章' WHEN isbn <> '' THEN '书籍/章节' WHEN contains(url, 'arxiv') THEN '预印本' ELSE '文献' END AS category FROM c""")
def _(s, d):
    given = F.get(F.array(*[F.lit(x) for x in CATEGORIES]), (F.col("p_partkey") % 12).cast("int"))
    size = F.col("p_size")
    journal, isbn, url = F.when(size % 3 == 0, F.col("p_brand")).when(size % 3 == 1, ""), F.when(size % 4 == 1, "978").otherwise(""), F.when(size % 5 < 3, "https://arxiv.org/abs/1")
    return read(s, d, "part").select("p_partkey", text.category(journal, isbn, url, given).alias("category"))


# --- sessions, annotations, geometry --------------------------------------------------------------


@query("session_titles", SESSIONS + ", p AS (SELECT CAST(c_custkey AS VARCHAR) AS id, CASE WHEN c_custkey % 2 = 0 THEN c_name WHEN c_custkey % 3 = 0 THEN '' END AS title, CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment END AS name FROM customer) SELECT s.id, coalesce(nullif(title, ''), nullif(name, ''), '') AS paper_name FROM s LEFT JOIN p ON p.id = s.paper_id")
def _(s, d):
    k = F.col("c_custkey")
    views = read(s, d, "customer").select(k.cast("string").alias("id"), F.when(k % 2 == 0, F.col("c_name")).when(k % 3 == 0, "").alias("title"), F.when(k % 5 != 0, F.col("c_mktsegment")).alias("name"))
    return records.titled_sessions(sessions(s, d), views).select("id", "paper_name")


@query("display_duration_short", SESSIONS + "SELECT id, CASE WHEN h > 0 AND m > 0 THEN h || 'h' || m || 'm' WHEN h > 0 THEN h || 'h' ELSE m || 'm' END AS shown FROM (SELECT id, duration_seconds * 37 // 3600 AS h, duration_seconds * 37 % 3600 // 60 AS m FROM s)")
def _(s, d):
    return sessions(s, d).select("id", text.short_duration_text(F.col("duration_seconds") * 37).alias("shown"))


@query("annotation_scan", "SELECT page_index, arg_max(props, event_id) AS json FROM (SELECT *, event_id % 50 AS page_index FROM events WHERE user_id = 7) GROUP BY page_index ORDER BY page_index")
def _(s, d):
    pages = read(s, d, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("file_path"), (F.col("event_id") % 50).alias("page_index"), F.col("props").alias("json"), "event_id")
    return records.annotations_of(store.latest_wins(pages, ["file_path", "page_index"], "event_id"), "u7")


@query("annotation_export_pages", "SELECT user_id AS file_path, event_id % 20 AS page_index, arg_max([event_type, props], event_id) AS shapes FROM events WHERE event_id % 4 <> 0 GROUP BY ALL")
def _(s, d):
    shapes = F.when(F.col("event_id") % 4 == 0, F.array().cast("array<string>")).otherwise(F.array("event_type", "props"))
    return records.shapes_by_page(read(s, d, "events").select(F.col("user_id").alias("file_path"), (F.col("event_id") % 20).alias("page_index"), F.col("event_id").alias("ord"), shapes.alias("shapes")))


SHAPES = """WITH sh AS (SELECT l_orderkey * 10 + l_linenumber AS shape_id, ['rect', 'ellipse', 'line'][l_linenumber % 3 + 1] AS kind, l_discount * 8 AS x0, l_tax * 10 AS y0, CASE WHEN l_linenumber = 4 THEN l_discount * 8 + 0.0005 ELSE l_quantity / 50 END AS x1, CASE WHEN l_linenumber = 4 THEN l_tax * 10 + 0.0005 ELSE 1 - l_quantity / 60 END AS y1, 600.0 AS page_w, 800.0 AS page_h, CAST(l_linenumber AS DOUBLE) AS size FROM lineitem) """


def shapes(s, d):
    line, four = F.col("l_linenumber"), F.col("l_linenumber") == 4
    x0, y0 = F.col("l_discount") * 8, F.col("l_tax") * 10
    return read(s, d, "lineitem").select(
        (F.col("l_orderkey") * 10 + line).alias("shape_id"), F.get(F.array(F.lit("rect"), F.lit("ellipse"), F.lit("line")), (line % 3).cast("int")).alias("kind"), x0.alias("x0"), y0.alias("y0"),
        F.when(four, x0 + 0.0005).otherwise(F.col("l_quantity") / 50).alias("x1"), F.when(four, y0 + 0.0005).otherwise(1 - F.col("l_quantity") / 60).alias("y1"), F.lit(600.0).alias("page_w"), F.lit(800.0).alias("page_h"), line.cast("double").alias("size"),
    )


@query("annotation_export_geometry", SHAPES + """SELECT * FROM (SELECT shape_id, kind,
  CASE kind WHEN 'rect' THEN least(x0, x1) * page_w WHEN 'ellipse' THEN (x0 + x1) / 2 * page_w ELSE x0 * page_w END AS a, CASE kind WHEN 'rect' THEN (1 - greatest(y0, y1)) * page_h WHEN 'ellipse' THEN (1 - (y0 + y1) / 2) * page_h ELSE (1 - y0) * page_h END AS b,
  CASE kind WHEN 'rect' THEN greatest(x0, x1) * page_w WHEN 'ellipse' THEN abs(x1 - x0) / 2 * page_w ELSE x1 * page_w END AS c, CASE kind WHEN 'rect' THEN (1 - least(y0, y1)) * page_h WHEN 'ellipse' THEN abs(y1 - y0) / 2 * page_h ELSE (1 - y1) * page_h END AS d,
  size * 0.5 AS stroke FROM sh) WHERE kind <> 'ellipse' OR (c >= 0.5 AND d >= 0.5)""")
def _(s, d):
    return records.exported(shapes(s, d))


@query("degenerate_shapes", SHAPES + "SELECT shape_id FROM sh WHERE abs(x1 - x0) < 0.001 AND abs(y1 - y0) < 0.001")
def _(s, d):
    return shapes(s, d).where(records.degenerate(F.struct("kind", "x0", "y0", "x1", "y1"))).select("shape_id")


STROKES = """WITH q AS (SELECT l_orderkey, l_linenumber, ['pen', 'rect', 'marker', 'line', 'pen', 'text', 'marker'][l_linenumber] AS kind, l_discount * 8 AS x0, l_tax * 10 AS y0, l_quantity / 50 AS x1, 1 - l_quantity / 60 AS y1 FROM lineitem),
s AS (SELECT *, unnest(range(3)) AS i FROM q), g AS (SELECT *, CASE i WHEN 0 THEN x0 WHEN 1 THEN x1 ELSE 0.5 END AS ax, CASE i WHEN 0 THEN y0 WHEN 1 THEN y1 ELSE 0.5 END AS ay, CASE i WHEN 0 THEN x1 ELSE 0.5 END AS ex, CASE i WHEN 0 THEN y1 ELSE 0.5 END AS ey FROM s),
t AS (SELECT *, coalesce(greatest(0.0, least(1.0, ((0.3 - ax) * (ex - ax) + (0.4 - ay) * (ey - ay)) / nullif((ex - ax) ** 2 + (ey - ay) ** 2, 0))), 0) AS t FROM g)
SELECT l_orderkey, max(l_linenumber) AS ord FROM t WHERE kind IN ('pen', 'marker') AND sqrt((0.3 - (ax + t * (ex - ax))) ** 2 + (0.4 - (ay + t * (ey - ay))) ** 2) < 0.02 GROUP BY l_orderkey"""


@query("eraser_hits", STROKES)
def _(s, d):
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    points = F.array(point(F.col("l_discount") * 8, F.col("l_tax") * 10), point(F.col("l_quantity") / 50, 1 - F.col("l_quantity") / 60), point(F.lit(0.5), F.lit(0.5)))
    kind = F.get(F.array(*[F.lit(x) for x in ("pen", "rect", "marker", "line", "pen", "text", "marker")]), F.col("l_linenumber") - 1)
    strokes = read(s, d, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("ord"), kind.alias("kind"), points.alias("points"))
    return records.erased(strokes, ["l_orderkey"], F.lit(0.3), F.lit(0.4))


@query("crop_regions", SHAPES + """, p AS (SELECT shape_id, x0 * 2000 - 200 AS xmin, y0 * 2000 - 200 AS ymin, x1 * 2000 AS xmax, y1 * 2000 AS ymax FROM sh),
q AS (SELECT *, CAST(floor(least(greatest(xmin, 0.0), 1000.0)) AS INTEGER) AS x, CAST(floor(least(greatest(ymin, 0.0), 800.0)) AS INTEGER) AS y FROM p)
SELECT shape_id, x, y, greatest(CAST(floor(least(greatest(xmax - xmin, 1.0), 1000.0 - x)) AS INTEGER), 1) AS w, greatest(CAST(floor(least(greatest(ymax - ymin, 1.0), 800.0 - y)) AS INTEGER), 1) AS h FROM q""")
def _(s, d):
    x = records.crop(F.col("x0") * 2000 - 200, F.col("y0") * 2000 - 200, F.col("x1") * 2000, F.col("y1") * 2000, 1000, 800)
    return shapes(s, d).select("shape_id", x.alias("x")).select("shape_id", "x.x", "x.y", "x.w", "x.h")


@query("hex_colours", "SELECT p_partkey, CASE WHEN p_partkey % 4 = 3 THEN 0 ELSE p_partkey % 256 END AS r, p_size % 256 AS g, 171 AS b FROM part")
def _(s, d):
    two = lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")
    k = F.col("p_partkey")
    c = F.concat(F.lit("#"), F.when(k % 4 == 3, "zz").otherwise(two(k % 256)), two(F.col("p_size").cast("long") % 256), F.lit("AB"))
    x = text.hex_colour(c)
    return read(s, d, "part").select("p_partkey", x.alias("x")).select("p_partkey", F.col("x.r").cast("long").alias("r"), "x.g", "x.b")


@query("cache_keys", "SELECT l_orderkey, l_linenumber, '/f' || l_orderkey || '::' || l_linenumber || '::' || CAST(round(l_discount * 1000) AS INTEGER) AS key FROM lineitem")
def _(s, d):
    return read(s, d, "lineitem").select("l_orderkey", "l_linenumber", records.cache_key(F.concat(F.lit("/f"), F.col("l_orderkey").cast("string")), F.col("l_linenumber"), F.col("l_discount")).alias("key"))


@query("argmax_last", "SELECT p_partkey, CASE WHEN c >= greatest(a, b) THEN 2 WHEN b >= a THEN 1 ELSE 0 END AS place FROM (SELECT p_partkey, p_size % 3 AS a, p_size % 4 AS c, p_size % 5 AS b FROM part)")
def _(s, d):
    return read(s, d, "part").select("p_partkey", records.last_largest(F.array(*[F.col("p_size") % k for k in (3, 5, 4)])).alias("place"))


# --- dates, texts ---------------------------------------------------------------------------------


@query("pdf_dates", "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE strftime(ts, '%Y-%m-%d') END AS date FROM events")
def _(s, d):
    raw = F.when(F.col("event_id") % 5 == 0, "D:unknown").otherwise(F.date_format("ts", "'D:'yyyyMMddHHmmss"))
    return read(s, d, "events").select("event_id", records.pdf_date(raw).alias("date"))


@query("date_parts", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN strftime(ts, '%Y') WHEN 2 THEN strftime(ts, '%Y-%m') ELSE strftime(ts, '%Y-%m-%d') END AS date FROM events")
def _(s, d):
    parts = F.slice(F.array(F.year("ts"), F.month("ts"), F.dayofmonth("ts")), F.lit(1), (F.col("event_id") % 4).cast("int"))
    return read(s, d, "events").select("event_id", records.date_parts(parts).alias("date"))


LABELS = ["Abstract: ", "ABSTRACT—", "摘要： ", "abstract . ", "", "Abstraction "]


@query("abstract_label", f"SELECT item_id, trim(regexp_replace({LABELS}[item_id % 6 + 1] || text, '^(?:Abstract|ABSTRACT|abstract|摘要)[.\\s:：\\-—]*', '')) AS abstract FROM benchmark")
def _(s, d):
    label = F.get(F.array(*[F.lit(x) for x in LABELS]), (F.col("item_id") % 6).cast("int"))
    return read(s, d, "benchmark").select("item_id", text.clean_abstract(F.concat(label, "text")).alias("abstract"))


@query("author_split", "SELECT p_partkey, list_filter(list_transform(regexp_split_to_array(p_name || ', Ann And Bo;and  C. Sandy', '(?i)[,;]|\\band\\b'), lambda x: trim(x)), lambda x: x <> '') AS authors FROM part")
def _(s, d):
    return read(s, d, "part").select("p_partkey", text.split_authors(F.concat("p_name", F.lit(", Ann And Bo;and  C. Sandy"))).alias("authors"))


@query("keyword_split", "SELECT item_id, list_filter(list_transform(regexp_split_to_array(text, '[,;]'), lambda x: trim(x)), lambda x: x <> '') AS keywords FROM benchmark")
def _(s, d):
    return read(s, d, "benchmark").select("item_id", text.split_keywords(F.col("text")).alias("keywords"))


@query("author_abbrev_total", "SELECT doc_id, CASE WHEN len(a) > 3 THEN array_to_string(a[1:3], ', ') || ' 等 (' || len(a) || '人)' ELSE array_to_string(a, ', ') END AS authors FROM (SELECT doc_id, string_split(text, ' ') AS a FROM documents)")
def _(s, d):
    return read(s, d, "documents").select("doc_id", text.author_list_text(F.split("text", " "), total=True).alias("authors"))


@query("snippet_search_case", "SELECT doc_id, substr(text, CAST(greatest(p - 40, 1) AS BIGINT), CAST(p - greatest(p - 40, 1) + 43 AS BIGINT)) AS snippet FROM (SELECT doc_id, text, instr(text, 'The') AS p FROM documents) WHERE p > 0")
def _(s, d):
    return read(s, d, "documents").select("doc_id", text.snippet(F.col("text"), "The", case=True).alias("snippet")).where("snippet is not null")


@query("palette_filter", "SELECT p_partkey FROM part WHERE contains(lower(p_name), 'wid') OR contains(lower(p_type), 'wid') OR contains(lower(p_brand), 'wid')")
def _(s, d):
    return read(s, d, "part").where(F.concat_ws("\x01", F.lower("p_name"), F.lower("p_type"), F.lower("p_brand")).contains("wid")).select("p_partkey")


@query("reference_display", """WITH r AS (SELECT l_orderkey, l_linenumber AS n, l_linestatus AS s, l_returnflag AS f FROM lineitem) SELECT l_orderkey, n AS l_linenumber, coalesce(CASE WHEN n = 1 THEN s || f END, CASE WHEN n = 2 THEN f END, CASE WHEN n < 5 THEN substr(repeat(s, 100), 1, 80) END, '未知标题') AS title, s AS journal,
  CASE WHEN n % 3 = 0 THEN ['R ' || s] WHEN n % 3 = 1 THEN [s, f] END AS authors FROM r""")
def _(s, d):
    n, status, flag = F.col("l_linenumber"), F.col("l_linestatus"), F.col("l_returnflag")
    refs = read(s, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.when(n == 1, F.concat(status, flag)).otherwise("").alias("remote_title"), F.when(n == 2, flag).alias("title"), F.when(n < 5, F.repeat(status, F.lit(100))).alias("raw_text"), F.when(n == 1, "").alias("remote_journal"), status.alias("journal"),
        F.when(n % 3 == 0, F.array(F.concat(F.lit("R "), status))).when(n % 3 == 1, F.array().cast("array<string>")).alias("remote_authors"), F.when(n % 3 < 2, F.array(status, flag)).alias("authors"),
    )
    return records.displayed(refs).select("l_orderkey", "l_linenumber", "title", "journal", "authors")


@query("references_to_refresh", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag <> 'R' OR CASE WHEN l_linenumber > 2 THEN l_linestatus END IS NULL")
def _(s, d):
    enriched, ranking = F.col("l_returnflag") == "R", F.when(F.col("l_linenumber") > 2, F.col("l_linestatus"))
    return read(s, d, "lineitem").where(~enriched | ranking.isNull()).select("l_orderkey", "l_linenumber")


@query("first_match", "SELECT conv_id, arg_min(text, turn) AS first FROM conversations WHERE role = 'assistant' GROUP BY conv_id")
def _(s, d):
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    return read(s, d, "conversations").groupBy("conv_id").agg(turns.alias("t")).select("conv_id", F.get(F.filter("t", lambda x: x["role"] == "assistant"), 0)["text"].alias("first")).where("first is not null")


@query("styles_by_category", "SELECT p_type AS category, list(p_partkey ORDER BY p_partkey) AS styles FROM part GROUP BY p_type")
def _(s, d):
    return read(s, d, "part").groupBy(F.col("p_type").alias("category")).agg(F.array_sort(F.collect_list("p_partkey")).alias("styles"))


@query("image_category_counts", "SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS clicks, count(*) FILTER (WHERE event_type = 'error') AS errors, count(*) FILTER (WHERE event_type NOT IN ('click', 'error')) AS others FROM events GROUP BY user_id")
def _(s, d):
    kind = F.col("event_type")
    return read(s, d, "events").groupBy("user_id").agg(F.count_if(kind == "click").alias("clicks"), F.count_if(kind == "error").alias("errors"), F.count_if(~kind.isin("click", "error")).alias("others"))


@query("parse_progress", "SELECT o_orderkey, o_orderstatus AS status, CAST(count(l_linenumber) AS BIGINT) AS refs, CAST(count(*) FILTER (WHERE l_returnflag = 'R') AS BIGINT) AS enriched FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL")
def _(s, d):
    refs = read(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("refs"), F.count_if(F.col("l_returnflag") == "R").alias("enriched"))
    return read(s, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status")).join(refs, "o_orderkey", "left").fillna(0, ["refs", "enriched"])


@query("score_threshold", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_discount * 10 > 0.5")
def _(s, d):
    from ..operators.layout import above_threshold

    return above_threshold(read(s, d, "lineitem").withColumn("score", F.col("l_discount") * 10), 0.5).select("l_orderkey", "l_linenumber")


@query("json_array_in_text", """WITH t AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN text || '[' || n_chars || ', ' || doc_id || ']' || lang WHEN 1 THEN '[[' || doc_id || '] ' || lang WHEN 2 THEN ']' || lang || '[' ELSE 'x [] y' END AS t FROM documents WHERE NOT contains(text, '[') AND NOT contains(text, ']'))
SELECT doc_id, TRY_CAST(nullif(regexp_extract(t, '(?s)\\[.*\\]'), '') AS BIGINT[]) AS found FROM t""")
def _(s, d):
    k, t, n = F.col("doc_id"), F.col("text"), F.col("n_chars").cast("string")
    no = k.cast("string")
    said = F.when(k % 4 == 0, F.concat(t, F.lit("["), n, F.lit(", "), no, F.lit("]"), "lang")).when(k % 4 == 1, F.concat(F.lit("[["), no, F.lit("] "), "lang")).when(k % 4 == 2, F.concat(F.lit("]"), "lang", F.lit("["))).otherwise("x [] y")
    return read(s, d, "documents").where(~t.contains("[") & ~t.contains("]")).select("doc_id", records.json_array_in(said, "array<long>").alias("found"))


# --- reconciliation -------------------------------------------------------------------------------

REMOTE = """WITH refs AS (SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN ' 10.1/X' || (doc_id % 40) END AS doi, 'Title of ' || (doc_id % 50 + 100) || ' looms and webs' AS title FROM documents),
remote AS (SELECT item_id, '10.1/x' || item_id AS doi, 'the title of looms webs ' || (item_id * 2 + 100) || CASE WHEN item_id % 5 = 0 THEN ' with many more words' ELSE '' END AS title FROM benchmark),
w AS (SELECT id, doi, list_distinct(list_filter(regexp_split_to_array(lower(title), '\\s+'), lambda x: length(x) > 2)) AS t FROM refs), u AS (SELECT item_id, doi, list_distinct(list_filter(regexp_split_to_array(lower(title), '\\s+'), lambda x: length(x) > 2)) AS t FROM remote),
o AS (SELECT id, item_id, len(list_intersect(w.t, u.t)) / greatest(len(w.t), len(u.t)) AS overlap FROM w, u), b AS (SELECT id, item_id FROM o WHERE overlap >= 0.7 QUALIFY row_number() OVER (PARTITION BY id ORDER BY overlap DESC, item_id) = 1) """


@query("reference_to_remote", REMOTE + "SELECT refs.id, coalesce(a.item_id, b.item_id) AS record FROM refs LEFT JOIN remote a ON a.doi = lower(trim(refs.doi)) LEFT JOIN b ON b.id = refs.id")
def _(s, d):
    k, i = F.col("doc_id"), F.col("item_id")
    text_of = lambda c: c.cast("string")
    refs = read(s, d, "documents").select(k.alias("id"), F.when(k % 3 == 0, F.concat(F.lit(" 10.1/X"), text_of(k % 40))).alias("doi"), F.concat(F.lit("Title of "), text_of(k % 50 + 100), F.lit(" looms and webs")).alias("title"))
    more = F.when(i % 5 == 0, " with many more words").otherwise("")
    remote = read(s, d, "benchmark").select(F.concat(F.lit("10.1/x"), text_of(i)).alias("doi"), F.concat(F.lit("the title of looms webs "), text_of(i * 2 + 100), more).alias("title"), i.alias("record"))
    return metadata.by_doi_or_title(refs, remote).select("id", "record")


@query("merge_scalars_and_lists", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 AND lang <> '' THEN lang ELSE source END AS language, CASE WHEN doc_id % 3 = 0 THEN ['x', source] ELSE [lang] END AS keywords FROM documents")
def _(s, d):
    k = F.col("doc_id")
    b = F.when(k % 3 == 0, F.array(F.lit("x"), F.col("source"))).when(k % 3 == 1, F.array().cast("array<string>"))
    return read(s, d, "documents").select("doc_id", metadata.fill(F.when(k % 2 == 0, F.col("lang")).when(k % 4 == 1, ""), F.col("source")).alias("language"), metadata.prefer_list(F.array("lang"), b).alias("keywords"))


PARSED = ["CASE WHEN p_partkey % 4 = 0 THEN 'abc' WHEN p_partkey % 4 = 1 THEN p_name WHEN p_partkey % 4 = 2 THEN p_brand || ' long title' END"]


@query("merge_parsed_title", f"SELECT p_partkey, CASE WHEN t IS NULL OR length(trim(t)) < 5 OR trim(t) = p_name THEN 'Parsed ' || p_type ELSE t END AS title FROM (SELECT *, {PARSED[0]} AS t FROM part)")
def _(s, d):
    k = F.col("p_partkey")
    own = F.when(k % 4 == 0, "abc").when(k % 4 == 1, F.col("p_name")).when(k % 4 == 2, F.concat("p_brand", F.lit(" long title")))
    return read(s, d, "part").select("p_partkey", metadata.structured_title(own, F.concat(F.lit("Parsed  "), "p_type", F.lit(" ")), F.concat("p_name", F.lit(".PDF"))).alias("title"))


FIRST_PAGE = """WITH t AS (SELECT item_id, 'Vol. ' || item_id || ', No. 3, pp. 10 - ' || (item_id + 11) || CASE WHEN item_id % 2 = 0 THEN ' 2024/3/' || (item_id % 28 + 1) ELSE ' March 2023' END || ' https://x.org/' || item_id || '), doi 10.1234/ab.' || item_id || '). ' || chr(10) || text AS t FROM benchmark) """


@query("first_page_facts", FIRST_PAGE + """SELECT item_id, regexp_replace(regexp_extract(t, '10\\.\\d{4,9}/[^\\s,;"''<>}\\]]+'), '[.)}>\\]]+$', '') AS doi, regexp_extract(t, '(?i)Vol(?:ume)?\\.?\\s*(\\d+)', 1) AS volume, regexp_extract(t, '(?i)(?:No\\.?\\s*|Issue\\s*)(\\d+)', 1) AS issue,
  regexp_extract(t, '(?i)pp?\\.?\\s*(\\d+)\\s*[-–]\\s*(\\d+)', 1) || '–' || regexp_extract(t, '(?i)pp?\\.?\\s*(\\d+)\\s*[-–]\\s*(\\d+)', 2) AS pages, regexp_replace(regexp_extract(t, 'https?://[^\\s<>"]+'), '[.)>,;]+$', '') AS url,
  CASE WHEN item_id % 2 = 0 THEN '2024-03-' || lpad(CAST(item_id % 28 + 1 AS VARCHAR), 2, '0') ELSE 'March 2023' END AS date FROM t""")
def _(s, d):
    k = F.col("item_id")
    no = k.cast("string")
    date = F.when(k % 2 == 0, F.concat(F.lit(" 2024/3/"), (k % 28 + 1).cast("string"))).otherwise(" March 2023")
    t = F.concat(F.lit("Vol. "), no, F.lit(", No. 3, pp. 10 - "), (k + 11).cast("string"), date, F.lit(" https://x.org/"), no, F.lit("), doi 10.1234/ab."), no, F.lit("). \n"), F.col("text"))
    x = metadata.first_page_facts(t)
    return read(s, d, "benchmark").select("item_id", x.alias("x")).select("item_id", *[f"x.{c}" for c in ("doi", "volume", "issue", "pages", "url", "date")])


ABSTRACTS = """WITH t AS (SELECT item_id, item_id % 4 AS m, text, CASE item_id % 4 WHEN 0 THEN 'Title' || chr(10) || 'ABSTRACT: ' || chr(10) || text || chr(10) || 'Key words a; b' WHEN 1 THEN '摘 要：' || text || chr(10) || '1 . Start' WHEN 2 THEN 'Abstract ' || text || chr(10) ELSE 'abstract of it ' || repeat(text || ' ', 30) || chr(10) || 'Introduction' END AS t FROM benchmark)
SELECT item_id, CASE WHEN length(a) BETWEEN 20 AND 800 THEN regexp_replace(trim(a), '\\s+', ' ', 'g') END AS abstract FROM (SELECT item_id, CASE WHEN m = 3 THEN NULL ELSE text END AS a FROM t)"""


@query("first_page_abstract", ABSTRACTS)
def _(s, d):
    m, t = F.col("item_id") % 4, F.col("text")
    page = F.when(m == 0, F.concat(F.lit("Title\nABSTRACT: \n"), t, F.lit("\nKey words a; b"))).when(m == 1, F.concat(F.lit("摘 要："), t, F.lit("\n1 . Start"))).when(m == 2, F.concat(F.lit("Abstract "), t, F.lit("\n"))).otherwise(F.concat(F.lit("abstract of it "), F.repeat(F.concat(t, F.lit(" ")), F.lit(30)), F.lit("\nIntroduction")))
    return read(s, d, "benchmark").select("item_id", metadata.first_page_facts(page)["abstract"].alias("abstract"))


@query("first_page_fill", PAPERS + """, o AS (SELECT id, CASE WHEN id % 4 < 2 THEN '10.1/own' WHEN id % 4 = 2 THEN '' END AS doi, CASE WHEN id % 3 = 0 THEN 'own' WHEN id % 3 = 1 THEN '' END AS volume, CASE WHEN id % 5 <> 0 THEN 'a' ELSE '' END AS abstract FROM p), l AS (SELECT *, coalesce(doi, '') = '' OR abstract = '' AS look FROM o)
SELECT id, CASE WHEN coalesce(doi, '') = '' THEN '10.1234/page' ELSE doi END AS doi, CASE WHEN coalesce(volume, '') = '' AND look THEN CAST(id % 90 AS VARCHAR) ELSE volume END AS volume, '1' AS issue FROM l""")
def _(s, d):
    from ..sources import papers

    k = F.col("id")
    page = F.concat(F.lit("Vol. "), (k % 90).cast("string"), F.lit(" No. 3 doi 10.1234/page"))
    have = {"doi": F.when(k % 4 < 2, "10.1/own").when(k % 4 == 2, ""), "abstract": F.when(k % 5 != 0, "a").otherwise(""), "date": F.lit("2024"), "volume": F.when(k % 3 == 0, "own").when(k % 3 == 1, ""), "issue": F.lit("1"), "pages": F.lit("1"), "url": F.lit("u")}
    filled = metadata.first_page_fill(have, metadata.first_page_facts(page))
    return papers(s, d).select("id", *[filled[c].alias(c) for c in ("doi", "volume", "issue")])


@query("cached_parse_completed", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN ['new'] ELSE ['old', o_orderstatus] END AS sections FROM orders")
def _(s, d):
    k = F.col("o_orderkey")
    cached = F.when(k % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("old"), F.col("o_orderstatus")))
    return read(s, d, "orders").select("o_orderkey", metadata.completed(cached, F.array(F.lit("new"))).alias("sections"))


# --- slides ---------------------------------------------------------------------------------------


def outline(s, d):
    """Each conversation as a slide outline, a turn a slide: files, and their text."""
    k = F.col("turn")
    title = F.concat(F.lit("## "), F.get(F.array(*[F.lit(x) for x in ("标题", "研究概述", "实验方法", "SEM 形貌", "EIS", "结论")]), (k % 6).cast("int")), F.lit(" "), k.cast("string"), F.when(k % 2 == 0, " [图:1]").otherwise(""))
    body = F.concat(F.lit("\nnot a bullet\n- first "), F.col("role"), F.lit("\n  * second [图:2]\n-   \n"))
    turns = F.array_sort(F.collect_list(F.struct("turn", F.concat(title, body).alias("x"))))
    return read(s, d, "conversations").groupBy(F.col("conv_id").alias("file_id")).agg(F.array_join(F.transform(turns, lambda x: x["x"]), "").alias("markdown"))


SLIDES = """WITH n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS slide_ord FROM conversations),
sl AS (SELECT conv_id AS file_id, slide_ord, turn, role, ['标题', '研究概述', '实验方法', 'SEM 形貌', 'EIS', '结论'][turn % 6 + 1] || ' ' || turn AS title, CASE WHEN turn % 2 = 0 THEN 0 ELSE 1 END AS wanted FROM n) """


@query("slides", SLIDES + """SELECT file_id, CAST(slide_ord AS INTEGER) AS slide_ord, title, CASE WHEN slide_ord = 1 THEN 'title' ELSE ['title', 'overview', 'methods', 'characterization', 'electrochemical', 'conclusion'][turn % 6 + 1] END AS slide_type,
  ['first ' || role, CASE WHEN turn % 2 = 0 THEN 'second [图:2]' ELSE 'second' END] AS bullets FROM sl""")
def _(s, d):
    from ..operators import slides

    images = s.createDataFrame([], "file_id long, page_index int, image_ord int, image string")
    had = slides.slides(outline(s, d), images.unionByName(outline(s, d).select("file_id", F.explode(F.sequence(F.lit(0), F.lit(40))).alias("image_ord")).select("file_id", F.lit(0).alias("page_index"), "image_ord", F.concat(F.lit("i"), F.col("image_ord").cast("string")).alias("image"))).unionByName(outline(s, d).select("file_id", F.lit(1).alias("page_index"), F.lit(0).alias("image_ord"), F.lit("only").alias("image"))))
    return had.select("file_id", "slide_ord", "title", "slide_type", "bullets")


@query("slide_images", SLIDES + ", r AS (SELECT *, row_number() OVER (PARTITION BY file_id, wanted ORDER BY slide_ord) AS k FROM sl) SELECT file_id, CAST(slide_ord AS INTEGER) AS slide_ord, CASE WHEN wanted = 0 THEN 'i' || (k - 1) WHEN k = 1 THEN 'only' END AS image FROM r")
def _(s, d):
    from ..operators import slides

    o = outline(s, d)
    many = o.select("file_id", F.lit(0).alias("page_index"), F.explode(F.sequence(F.lit(0), F.lit(40))).alias("image_ord")).select("file_id", "page_index", "image_ord", F.concat(F.lit("i"), F.col("image_ord").cast("string")).alias("image"))
    one = o.select("file_id", F.lit(1).alias("page_index"), F.lit(0).alias("image_ord"), F.lit("only").alias("image"))
    return slides.slides(o, many.unionByName(one)).select("file_id", "slide_ord", "image")
