"""Queries that compose records from several sources, and read and write their files, each beside its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metadata, remote, sections, sidecars
from ..session import working_dir
from ..sources import read
from .library import query

ALIKE = "list_distinct(list_filter(regexp_split_to_array(lower({c}), '\\s+'), lambda w: length(w) > 2))"

# Titles of orders' comments as requests: long ones that begin alike, vain ones, short ones.
SEARCHES = f"""WITH r AS (SELECT c_custkey AS id, c_custkey AS ord, CASE WHEN c_custkey % 11 = 0 THEN ' ab ' WHEN c_custkey % 3 = 0 THEN upper('the loom of ' || p_brand || ' and ' || p_name) ELSE repeat('the great loom ', 6) || p_brand || ' ' || p_name || CASE WHEN c_custkey % 2 = 0 THEN ' more words that no record has at all' ELSE '' END END AS title
  FROM customer JOIN part ON p_partkey = c_custkey % 37),
cat AS (SELECT p_partkey AS record, CASE WHEN p_partkey % 2 = 0 THEN 'the loom of ' || p_brand || ' and ' || p_name ELSE repeat('The great loom ', 6) || p_brand || ' ' || p_name END AS title FROM part),
k AS (SELECT *, CASE WHEN length(trim(title)) >= 5 THEN substr(lower(trim(title)), 1, 80) END AS key FROM r),
f AS (SELECT key, arg_min(title, ord) AS title FROM k WHERE key IS NOT NULL GROUP BY key),
o AS (SELECT key, record, len(list_intersect(a, b)) / greatest(len(a), len(b)) AS overlap FROM (SELECT key, {ALIKE.format(c="trim(title)")} AS a FROM f), (SELECT record, {ALIKE.format(c="title")} AS b FROM cat)),
b AS (SELECT key, record FROM o WHERE overlap >= 0.7 QUALIFY row_number() OVER (PARTITION BY key ORDER BY overlap DESC, record) = 1)
SELECT id, k.key, record FROM k LEFT JOIN b ON b.key = k.key"""


@query("remote_search_memo", SEARCHES)
def _(s, d):
    k, p = F.col("c_custkey"), read(s, d, "part")
    great = F.repeat(F.lit("the great loom "), 6)
    title = (
        F.when(k % 11 == 0, " ab ").when(k % 3 == 0, F.upper(F.concat(F.lit("the loom of "), "p_brand", F.lit(" and "), "p_name")))
        .otherwise(F.concat(great, "p_brand", F.lit(" "), "p_name", F.when(k % 2 == 0, " more words that no record has at all").otherwise("")))
    )
    requests = read(s, d, "customer").join(p, F.col("p_partkey") == k % 37).select(k.alias("id"), k.alias("ord"), title.alias("title"))
    even = F.concat(F.lit("the loom of "), "p_brand", F.lit(" and "), "p_name")
    catalogue = p.select(F.col("p_partkey").alias("record"), F.when(F.col("p_partkey") % 2 == 0, even).otherwise(F.concat(F.repeat(F.lit("The great loom "), 6), "p_brand", F.lit(" "), "p_name")).alias("title"))
    return remote.searched_once(requests, catalogue)


MERGED = """WITH o AS (SELECT c_custkey AS id, c_name AS name, CASE c_custkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'abc' WHEN 2 THEN c_name WHEN 3 THEN 'A title of ' || c_mktsegment END AS title, CASE WHEN c_custkey % 2 = 0 THEN '' WHEN c_custkey % 3 = 0 THEN 'own abstract' END AS abstract,
  CASE WHEN c_custkey % 4 = 0 THEN ['Own Name'] WHEN c_custkey % 4 = 1 THEN CAST([] AS VARCHAR[]) END AS authors, CASE WHEN c_custkey % 3 = 0 THEN '2020' WHEN c_custkey % 3 = 1 THEN '' END AS date, CASE WHEN c_custkey % 7 = 0 THEN 'own' END AS volume,
  CASE WHEN c_custkey % 6 < 2 THEN ['AI', c_mktsegment] WHEN c_custkey % 6 = 2 THEN CAST([] AS VARCHAR[]) END AS keywords,
  CASE WHEN c_custkey % 8 <> 0 THEN '  Parsed  ' || c_name || chr(10) || 'x' ELSE '' END AS ptitle, CASE WHEN c_custkey % 9 <> 0 THEN ['Ada L', 'Grace Hopper'] ELSE CAST([] AS VARCHAR[]) END AS pauthors,
  CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE concat_ws('-', '2024', CASE WHEN c_custkey % 10 < 5 THEN '03' END, CASE WHEN c_custkey % 10 < 3 THEN CAST(c_nationkey AS VARCHAR) END) END AS pdate, c_custkey % 2 = 1 AS pkeys, c_mktsegment AS seg FROM customer)
SELECT id, CASE WHEN ptitle <> '' AND (length(trim(coalesce(title, ''))) < 5 OR title = name) THEN 'Parsed ' || name || ' x' ELSE title END AS title, CASE WHEN coalesce(abstract, '') = '' THEN 'parsed ' || seg ELSE abstract END AS abstract,
  CASE WHEN len(authors) > 0 THEN authors WHEN len(pauthors) > 0 THEN pauthors ELSE authors END AS authors, CASE WHEN coalesce(date, '') <> '' THEN date WHEN pdate IS NOT NULL THEN pdate ELSE date END AS date, coalesce(volume, 'v' || id) AS volume, 'Venue' AS journal,
  CASE WHEN NOT pkeys THEN keywords WHEN keywords IS NULL OR len(keywords) = 0 THEN [lower(seg), 'ai', 'NLP', 'nlp'] ELSE list_concat(keywords, ['NLP', 'nlp']) END AS keywords FROM o"""


@query("merge_parsed_document", MERGED)
def _(s, d):
    k, none = F.col("c_custkey"), F.array().cast("array<string>")
    name = lambda full, *rest: F.struct(F.lit(full).alias("full_name"), *[F.lit(x).alias(c) for x, c in zip(rest, ("first_name", "middle_name", "last_name"))])
    own = F.struct(
        F.when(k % 5 == 0, "").when(k % 5 == 1, "abc").when(k % 5 == 2, F.col("c_name")).when(k % 5 == 3, F.concat(F.lit("A title of "), "c_mktsegment")).alias("title"), F.when(k % 2 == 0, "").when(k % 3 == 0, "own abstract").alias("abstract"),
        F.when(k % 4 == 0, F.array(F.lit("Own Name"))).when(k % 4 == 1, none).alias("authors"), F.lit(None).cast("string").alias("doi"), F.when(k % 3 == 0, "2020").when(k % 3 == 1, "").alias("date"), F.lit("").alias("journal"),
        F.when(k % 7 == 0, "own").alias("volume"), *[F.lit("x").alias(c) for c in ("issue", "pages", "publisher")], F.when(k % 6 < 2, F.array(F.lit("AI"), F.col("c_mktsegment"))).when(k % 6 == 2, none).alias("keywords"),
    )
    authors = F.array(name("", "Ada", "", "L"), name("Grace Hopper", "no", None, "use"), name(None, None, "", ""))
    date = F.struct(F.when(k % 10 != 0, "2024").otherwise("").alias("year"), F.when(k % 10 < 5, "03").otherwise("").alias("month"), F.when(k % 10 < 3, F.col("c_nationkey").cast("string")).alias("day"))
    parsed = F.struct(
        F.when(k % 8 != 0, F.concat(F.lit("  Parsed  "), "c_name", F.lit("\nx"))).otherwise("").alias("title"), F.concat(F.lit("parsed "), "c_mktsegment").alias("abstract"), F.when(k % 9 != 0, authors).otherwise(F.slice(authors, 1, 0)).alias("authors"), F.lit("").alias("doi"), date.alias("date"),
        F.struct(F.lit("Venue").alias("name"), F.concat(F.lit("v"), k.cast("string")).alias("volume"), *[F.lit("").alias(c) for c in ("issue", "pages", "publisher")]).alias("venue"), F.when(k % 2 == 1, F.array(F.lower("c_mktsegment"), F.lit("ai"), F.lit("NLP"), F.lit("nlp"))).otherwise(none).alias("keywords"),
    )
    merged = metadata.parsed_document_merge(F.col("own"), F.col("parsed"), F.concat("c_name", F.lit(".PDF")))
    rows = read(s, d, "customer").select(k.alias("id"), "c_name", own.alias("own"), parsed.alias("parsed")).select("id", merged.alias("m"))
    return rows.select("id", *[f"m.{c}" for c in ("title", "abstract", "authors", "date", "volume", "journal", "keywords")])


LAYER = """WITH t AS (SELECT item_id, text, CASE item_id % 4 WHEN 0 THEN text WHEN 1 THEN '' WHEN 2 THEN 'Other title of looms' END AS own, CASE WHEN item_id % 3 = 0 THEN '' WHEN item_id % 3 = 1 THEN text END AS lay, CASE WHEN item_id % 5 <> 0 THEN text || ' font' ELSE '' END AS font FROM benchmark),
n AS (SELECT *, nullif(lay, '') AS l, nullif(font, '') AS f, nullif(own, '') AS x FROM t), m AS (SELECT *, {forms} FROM n)
SELECT item_id, coalesce(CASE WHEN {lf} THEN l WHEN {lx} THEN l WHEN {fx} THEN f ELSE coalesce(l, f, x) END, own) AS title, CASE WHEN item_id % 2 = 0 THEN '10.1/own' ELSE '10.1/layout' END AS doi, CASE WHEN item_id % 6 < 3 THEN 'layout abstract' ELSE 'own abstract' END AS abstract FROM m"""


def layer_sql() -> str:
    from .citing import NEAR, alike_sql

    return LAYER.format(forms=", ".join(NEAR.format(c=c) + f" AS n{c}" for c in "lfx"), lf=alike_sql("nl", "nf"), lx=alike_sql("nl", "nx"), fx=alike_sql("nf", "nx"))


@query("merge_layout_layer", layer_sql())
def _(s, d):
    k, t = F.col("item_id"), F.col("text")
    known = {"title": F.when(k % 4 == 0, t).when(k % 4 == 1, "").when(k % 4 == 2, "Other title of looms"), "doi": F.when(k % 2 == 0, "10.1/own").otherwise(""), "abstract": F.lit("own abstract")}
    layout = {"doi": F.lit("10.1/layout"), "title_by_layout": F.when(k % 3 == 0, "").when(k % 3 == 1, t), "title_by_font": F.when(k % 5 != 0, F.concat(t, F.lit(" font"))).otherwise(""), "abstract": F.when(k % 6 < 3, "layout abstract").otherwise("")}
    found = metadata.layout_layer(known, layout)
    return read(s, d, "benchmark").select("item_id", *[c.alias(n) for n, c in found.items()])


SIDECARS = """SELECT s_suppkey, s_suppkey % 7 = 3 AS damaged, CASE WHEN s_suppkey % 7 <> 3 THEN s_name END AS name, CASE WHEN s_suppkey % 7 <> 3 THEN CASE WHEN s_suppkey % 2 = 0 THEN CAST(s_nationkey AS INTEGER) ELSE 4 END END AS zone,
  CASE WHEN s_suppkey % 7 <> 3 THEN false END AS is_top, CASE WHEN s_suppkey % 7 <> 3 THEN [s_name || chr(10) || '"quoted"', NULL] END AS titles, CASE WHEN s_suppkey % 7 <> 3 THEN [1, 2] END AS levels FROM supplier"""


@query("sidecar_files", SIDECARS)
def _(s, d):
    """A file for each supplier, written and read again; a seventh of them is cut off."""
    k = F.col("s_suppkey")
    sections_ = F.array(F.struct(F.concat("s_name", F.lit('\n"quoted"')).alias("title"), F.lit(1).alias("level")), F.struct(F.lit(None).cast("string").alias("title"), F.lit(2).alias("level")))
    whole = F.to_json(F.struct(F.col("s_name").alias("name"), F.when(k % 2 == 0, F.col("s_nationkey")).alias("zone"), sections_.alias("sections"), F.lit("x").alias("unknown")), {"pretty": "true"})
    folder = working_dir(s, "sidecars")
    sidecars.written(read(s, d, "supplier"), "s_suppkey", F.when(k % 7 == 3, F.left(whole, F.length(whole) - 9)).otherwise(whole), folder)
    schema = "name string, zone int, is_top boolean, sections array<struct<title string, level int>>"
    found = sidecars.read(s, folder, "s_suppkey", "bigint", schema, {"zone": F.lit(4), "is_top": F.lit(False)})
    return found.select("s_suppkey", "damaged", "name", "zone", "is_top", F.col("sections.title").alias("titles"), F.col("sections.level").alias("levels"))


# Trees of sections: a chain of deepening sections under each top one, each with a short one behind.
FLAT = """WITH t AS (SELECT o_orderkey, unnest(range(o_orderkey % 3 + 1)) AS i FROM orders WHERE o_orderkey % 50 <> 0),
c AS (SELECT o_orderkey, i, unnest(range((o_orderkey + i) % 6 + 1)) AS j, (o_orderkey + i) % 6 AS d FROM t),
n AS (SELECT o_orderkey, i, 0 AS back, j AS place, j + 1 AS depth, o_orderkey || '.' || i || '.' || j AS title, j + 1 AS level, 'text "' || j || '"' AS content FROM c
UNION ALL SELECT o_orderkey, i, 1, -j, j + 2, 'short ' || j, NULL, NULL FROM c WHERE j < d)
SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_orderkey ORDER BY i, back, place) - 1 AS INTEGER) AS sec_ord, CAST(depth AS INTEGER) AS depth, title, CAST(level AS INTEGER) AS level, content FROM n"""


@query("sections_flattened", FLAT)
def _(s, d):
    k = F.col("o_orderkey")

    def section(i, j, inner):
        no = j.cast("string")
        return F.concat(F.lit('{"title": "'), k.cast("string"), F.lit("."), i.cast("string"), F.lit("."), no, F.lit('", "level": '), (j + 1).cast("string"), F.lit(', "content": "text \\"'), no, F.lit('\\"", "subsections": ['), inner, F.lit("]}"))

    def tree(i):
        deep = ((k + i) % 6).cast("int")
        around = lambda inner, j: section(i, j, F.concat(inner, F.lit(', {"title": "short '), j.cast("string"), F.lit('"}')))
        return F.when(deep == 0, section(i, deep, F.lit(""))).otherwise(F.aggregate(F.sequence(deep - 1, F.lit(0), F.lit(-1)), section(i, deep, F.lit("")), around))

    text = F.concat(F.lit("["), F.array_join(F.transform(F.sequence(F.lit(0), (k % 3).cast("int")), tree), ", "), F.lit("]"))
    orders = read(s, d, "orders").select("o_orderkey", F.when(k % 50 == 0, F.lit("[{")).otherwise(text).alias("sections"))
    return sections.flattened(orders, "o_orderkey", "sections")
