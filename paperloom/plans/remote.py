"""Queries over remote records, names, files and texts, each beside its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import citations, text
from ..operators import layout, remote
from ..sources import read, segments, spread
from .citing import cite_sql, cited
from .library import WORDS, boxes, query


def message(k):
    """A catalogue's message about a part, in JSON."""
    no = k.cast("string")
    return F.concat(
        F.lit('{"title": ["On <i>looms</i>'), F.when(k % 4 == 0, ":").otherwise(""), F.lit('"]'), F.when(k % 3 != 0, ', "subtitle": ["the {web}"]').otherwise(', "subtitle": ["Looms"]'),
        F.when(k % 5 != 0, ', "author": [{"given": "Ada", "family": "Lovelace"}, {"name": "The Group"}, {"family": "Plato"}, {"given": ""}]').otherwise(""), F.lit(', "abstract": " <jats:p>Text {a}</jats:p> ", "container-title": ["J. Loom"], "short-container-title": ["'),
        F.when(k % 2 == 0, "J. Loom").otherwise("JL"), F.lit('"], "issued": {"date-parts": [['), F.when(k % 4 == 0, "2024").when(k % 4 == 1, "2024, 3").when(k % 4 == 2, "2024, 3, 9").otherwise("0"), F.lit("]]}, "),
        F.lit('"volume": "'), no, F.lit('", "issue": "", "DOI": "10.1/'), no, F.lit('", "ISSN": ["1", "2"], "subject": [" a ", "", "b"], "type": "journal-article", "more": {"x": 1}}'),
    )


@query("catalogue_record", """SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'On looms' || CASE WHEN p_partkey % 4 = 0 THEN ':' ELSE '' END WHEN p_partkey % 4 = 0 THEN 'On looms: the web' ELSE 'On looms: the web' END AS title,
  CASE WHEN p_partkey % 5 <> 0 THEN ['Ada Lovelace', 'The Group', 'Plato'] END AS authors, 'Text a' AS abstract, 'J. Loom' AS journal, CASE WHEN p_partkey % 2 <> 0 THEN 'JL' END AS journal_abbrev, ['2024', '2024-03', '2024-03-09', NULL][p_partkey % 4 + 1] AS date,
  CAST(p_partkey AS VARCHAR) AS volume, CAST(NULL AS VARCHAR) AS issue, '10.1/' || p_partkey AS doi, '1' AS issn, ['a', 'b'] AS keywords, 'journal-article' AS category FROM part""")
def _(s, d):
    k = F.col("p_partkey")
    fields = ("title", "authors", "abstract", "journal", "journal_abbrev", "date", "volume", "issue", "doi", "issn", "keywords", "category")
    return spread(read(s, d, "part").select(k)).select(k, remote.catalogue_record(message(k)).alias("r")).select("p_partkey", *[f"r.{c}" for c in fields])


@query("preprint_record", """SELECT item_id, CASE WHEN item_id % 4 <> 0 THEN 'On looms & webs' END AS title, CASE WHEN item_id % 4 <> 0 THEN trim(regexp_replace(text, '\\s+', ' ', 'g')) END AS abstract, CASE WHEN item_id % 4 <> 0 THEN ['Ada Lovelace', 'Plato'] END AS authors,
  CASE WHEN item_id % 4 <> 0 THEN '2024' END AS date, CASE WHEN item_id % 4 <> 0 THEN 'http://arxiv.org/abs/' || item_id END AS url, CASE WHEN item_id % 4 = 1 THEN '10.5/' || item_id END AS doi FROM benchmark""")
def _(s, d):
    k = F.col("item_id")
    link = F.when(k % 4 == 1, F.concat(F.lit('<link title="doi" href="http://dx.doi.org/10.5/'), k.cast("string"), F.lit('" rel="related"/>'))).otherwise("")
    entry = F.concat(F.lit("<entry><id>http://arxiv.org/abs/"), k.cast("string"), F.lit("</id><title> On  looms\n & webs</title><published>2024-03-01T00:00:00Z</published><summary>\n"), F.col("text"), F.lit(" </summary><author><name>Ada Lovelace</name></author><author>\n<name> Plato </name></author><link href=\"http://arxiv.org/pdf/1\"/>"), link, F.lit("</entry>"))
    feed = F.concat(F.lit("<feed><title>query</title>"), F.when(k % 4 != 0, entry).otherwise(""), F.lit("</feed>"))
    return read(s, d, "benchmark").select(k, remote.preprint_record(feed).alias("r")).select("item_id", *[f"r.{c}" for c in ("title", "abstract", "authors", "date", "url", "doi")])


W = "list_distinct(list_filter(regexp_split_to_array(lower({c}), '\\s+'), lambda w: length(w) > 2))"


@query("title_search", f"""WITH a AS (SELECT p_partkey AS id, {W.format(c="trim(p_name || ' number ' || p_brand)")} AS t FROM part), b AS (SELECT p_partkey AS record, {W.format(c="p_brand || ' ' || p_name || ' NUMBER ' || p_type")} AS u FROM part WHERE p_partkey % 3 = 0),
x AS (SELECT id, record, len(list_intersect(t, u)) / greatest(len(t), len(u)) AS overlap FROM a, b) SELECT id, record FROM x WHERE overlap >= 0.7 QUALIFY row_number() OVER (PARTITION BY id ORDER BY overlap DESC, record) = 1""")
def _(s, d):
    p = read(s, d, "part")
    titles = p.select(F.col("p_partkey").alias("id"), F.concat("p_name", F.lit(" number "), "p_brand").alias("title"))
    catalogue = p.where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("record"), F.concat("p_brand", F.lit(" "), "p_name", F.lit(" NUMBER "), "p_type").alias("title"))
    return remote.by_title(titles, catalogue)


@query("remote_choice", """WITH p AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN ' 10.1/A' || (c_custkey % 50) END AS doi, CASE WHEN c_custkey % 2 = 0 THEN 'a' || (c_custkey % 40) END AS arxiv, CASE WHEN c_custkey % 5 = 0 THEN 'short' ELSE c_name END AS title FROM customer),
d AS (SELECT '10.1/a' || i AS doi, 'by doi ' || i AS title FROM range(0, 50, 2) t(i)), a AS (SELECT 'a' || i AS arxiv, 'preprint ' || i AS title, CASE WHEN i % 3 = 0 THEN '10.1/A' || i END AS doi FROM range(0, 40, 4) t(i)),
f AS (SELECT c_custkey AS id, 'found ' || c_custkey AS title FROM customer WHERE c_custkey % 7 < 4), j AS (SELECT p.id, p.title AS own, d.title AS t1, coalesce(u.title, a.title) AS t2, CASE WHEN length(p.title) > 10 THEN f.title END AS t3
FROM p LEFT JOIN d ON d.doi = lower(trim(p.doi)) LEFT JOIN a ON a.arxiv = p.arxiv LEFT JOIN d u ON u.doi = lower(trim(a.doi)) LEFT JOIN f ON f.id = p.id)
SELECT id, coalesce(t1, t2, t3) AS remote_title, CASE WHEN t1 IS NOT NULL THEN 'doi' WHEN t2 IS NOT NULL THEN 'preprint' WHEN t3 IS NOT NULL THEN 'title' END AS remote_source FROM j""")
def _(s, d):
    c, k, i = read(s, d, "customer"), F.col("c_custkey"), F.col("id").cast("string")
    p = c.select(k.alias("id"), F.when(k % 3 == 0, F.concat(F.lit(" 10.1/A"), (k % 50).cast("string"))).alias("doi"), F.when(k % 2 == 0, F.concat(F.lit("a"), (k % 40).cast("string"))).alias("arxiv"), F.when(k % 5 == 0, "short").otherwise(F.col("c_name")).alias("title"))
    dois = s.range(0, 50, 2).select(F.concat(F.lit("10.1/a"), i).alias("doi"), F.concat(F.lit("by doi "), i).alias("title"))
    preprints = s.range(0, 40, 4).select(F.concat(F.lit("a"), i).alias("arxiv"), F.concat(F.lit("preprint "), i).alias("title"), F.when(F.col("id") % 3 == 0, F.concat(F.lit("10.1/A"), i)).alias("doi"))
    found = c.where("c_custkey % 7 < 4").select(k.alias("id"), F.concat(F.lit("found "), k.cast("string")).alias("title"))
    return remote.chosen(p, dois, preprints, found)


@query("merge_parsed_fields", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE coalesce(nullif(CASE WHEN p_partkey % 4 = 0 THEN '' ELSE p_brand END, ''), CASE WHEN p_partkey % 3 = 1 THEN '' END) END AS journal, coalesce(nullif(CASE WHEN p_partkey % 2 = 0 THEN p_type END, ''), CAST(p_size AS VARCHAR)) AS volume FROM part")
def _(s, d):
    k = F.col("p_partkey")
    own = {"journal": F.when(k % 3 == 0, F.col("p_name")).when(k % 3 == 1, ""), "volume": F.when(k % 2 == 0, F.col("p_type"))}
    got = remote.parsed_fill(own, {"journal": F.when(k % 4 == 0, "").otherwise(F.col("p_brand")), "volume": F.col("p_size").cast("string")})
    return read(s, d, "part").select("p_partkey", *[c.alias(n) for n, c in got.items()])


@query("author_names", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE concat_ws(' ', CASE WHEN c_custkey % 2 = 0 THEN 'Ada' END, CASE WHEN c_custkey % 5 = 0 THEN 'K.' END, c_mktsegment) END AS name FROM customer")
def _(s, d):
    k = F.col("c_custkey")
    author = F.struct(F.when(k % 3 == 0, F.col("c_name")).otherwise("").alias("full_name"), F.when(k % 2 == 0, "Ada").alias("first_name"), F.when(k % 5 == 0, "K.").otherwise("").alias("middle_name"), F.col("c_mktsegment").alias("last_name"))
    return read(s, d, "customer").select("c_custkey", remote.full_name(author).alias("name"))


RENAMES = """WITH RECURSIVE f AS (SELECT p_partkey, p_brand AS folder, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE 'pdf' END AS ext, CASE WHEN p_partkey % 6 = 0 THEN 'plate_01.pdf' || p_partkey ELSE 'x' || p_partkey END || CASE WHEN p_partkey % 4 = 0 THEN '' ELSE '.pdf' END AS name,
  CASE p_partkey % 9 WHEN 0 THEN ' ' WHEN 1 THEN ' plate: ' WHEN 2 THEN 'x' || (p_partkey + 25) WHEN 3 THEN 'plate__01' WHEN 4 THEN 'plate_' ELSE substr(p_type, 1, 3) || ' a/b?' END AS title FROM part),
e AS (SELECT *, trim(regexp_replace(title, '[<>:"/\\|?*]', '_', 'g')) AS bare, row_number() OVER (PARTITION BY folder ORDER BY p_partkey) AS n FROM f), d AS (SELECT *, CASE WHEN ext = '' THEN bare ELSE bare || '.' || ext END AS wanted FROM e),
w AS (SELECT folder, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS p_partkey, '' AS new_name, list(name) AS there FROM d GROUP BY folder
UNION ALL SELECT folder, n, p_partkey, new_name, list_append(list_filter(there, lambda x: x <> name), new_name) FROM (
  SELECT d.*, w.there, CASE WHEN bare = '' OR wanted = name THEN name WHEN NOT list_contains(there, wanted) THEN wanted
    ELSE list_filter(list_transform(range(1, len(there) + 2), lambda k: CASE WHEN ext = '' THEN bare || '_' || k ELSE bare || '_' || lpad(CAST(k AS VARCHAR), 2, '0') || '.' || ext END), lambda x: NOT list_contains(there, x))[1] END AS new_name
  FROM w JOIN d ON d.folder = w.folder AND d.n = w.n + 1))
SELECT p_partkey, new_name FROM w WHERE n > 0"""


@query("rename_from_title", RENAMES)
def _(s, d):
    k = F.col("p_partkey")
    no, ext = k.cast("string"), F.when(k % 4 == 0, "").otherwise("pdf")
    name = F.concat(F.when(k % 6 == 0, F.concat(F.lit("plate_01.pdf"), no)).otherwise(F.concat(F.lit("x"), no)), F.when(k % 4 == 0, "").otherwise(".pdf"))
    title = F.when(k % 9 == 0, " ").when(k % 9 == 1, " plate: ").when(k % 9 == 2, F.concat(F.lit("x"), (k + 25).cast("string"))).when(k % 9 == 3, "plate__01").when(k % 9 == 4, "plate_").otherwise(F.concat(F.substring("p_type", 1, 3), F.lit(" a/b?")))
    files = read(s, d, "part").select("p_partkey", F.col("p_brand").alias("folder"), ext.alias("ext"), k.alias("ord"), name.alias("name"), title.alias("title"))
    return remote.renamed(files).select("p_partkey", "new_name")


@query("citation_files", "WITH c AS (" + cite_sql("ieee", "html") + """) SELECT p_partkey, left(regexp_replace(repeat(p_name || '? ', 6), '[/\\\\?%*:|"<>]', '_', 'g'), 50) || '_citation.html' AS file, '<!DOCTYPE html>' || chr(10) || '<html><head><meta charset="UTF-8"><title>Citation</title></head>' || chr(10) || '<body><p>' || citation || '</p></body></html>' AS content FROM c JOIN part USING (p_partkey)""")
def _(s, d):
    c = cited(s, d, "ieee", "html").join(read(s, d, "part").select("p_partkey", "p_name"), "p_partkey")
    x = remote.citation_file(F.col("citation"), F.repeat(F.concat("p_name", F.lit("? ")), 6), "html")
    return c.select("p_partkey", x.alias("x")).select("p_partkey", "x.*")


@query("word_parts", """WITH t AS (SELECT doc_id, regexp_replace(CASE WHEN doc_id % 3 = 0 THEN regexp_replace(text, 'e', '织', 'g') ELSE '论' || text || '文' END, '[\\r\\n]+', '', 'g') AS t FROM documents)
SELECT doc_id, string_split(regexp_replace(regexp_replace(t, '([一-龥])', chr(1) || '\\1', 'g'), '^' || chr(1), ''), chr(1)) AS parts FROM t""")
def _(s, d):
    t = F.when(F.col("doc_id") % 3 == 0, F.regexp_replace("text", "e", "织")).otherwise(F.concat(F.lit("论"), "text", F.lit("文")))
    return read(s, d, "documents").select("doc_id", remote.word_parts(t).alias("parts"))


@query("sentence_split", """WITH t AS (SELECT doc_id, regexp_replace(text || ' "Do they?" Yes, e.g. ' || source || '! 3 of them.', '[\\r\\n]+', '', 'g') AS t FROM documents)
SELECT doc_id, list_filter(string_split(regexp_replace(t, '([.!?。！？]["''”’)\\]]?)\\s+(["''“‘(\\[]?[\\p{Lu}\\p{N}])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda x: x <> '') AS sentences FROM t""")
def _(s, d):
    return read(s, d, "documents").select("doc_id", remote.sentences(F.concat("text", F.lit(' "Do they?" Yes, e.g. '), "source", F.lit("! 3 of them."))).alias("sentences"))


@query("settled_saves", "SELECT event_id FROM (SELECT event_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS after FROM events) WHERE after IS NULL OR after - ts > INTERVAL 2 HOURS")
def _(s, d):
    e = read(s, d, "events").select("event_id", "user_id", "ts")
    return remote.settled(e, ["user_id"], "ts", "interval 2 hours").select("event_id")


@query("full_text_clean", WORDS + """, g AS (SELECT DISTINCT file_id, page_index, seg_ord FROM inside WHERE cls_id IN (8, 9, 11, 12, 13, 16, 20)), k AS (SELECT s.* FROM segments s LEFT JOIN g USING (file_id, page_index, seg_ord) WHERE g.seg_ord IS NULL AND trim(s.text) <> ''),
t AS (SELECT file_id, page_index, string_agg(trim(text), chr(10) ORDER BY seg_ord) AS t FROM k GROUP BY ALL) SELECT file_id, string_agg(t, chr(10) || chr(10) ORDER BY page_index) AS text FROM t GROUP BY file_id""")
def _(s, d):
    return remote.clean_full_text(layout.without_garbage(segments(s, d), boxes(s, d)))


@query("line_boxes", WORDS + "SELECT file_id, page_index, seg_ord // 8 AS line, min(xmin) AS xmin, min(ymin) AS ymin, max(xmax) AS xmax, max(ymax) AS ymax FROM segments GROUP BY ALL")
def _(s, d):
    line = F.floor(F.col("seg_ord") / 8).cast("long").alias("line")
    return segments(s, d).groupBy("file_id", "page_index", line).agg(F.min("xmin").alias("xmin"), F.min("ymin").alias("ymin"), F.max("xmax").alias("xmax"), F.max("ymax").alias("ymax"))


@query("line_gaps", WORDS + ", l AS (SELECT file_id, page_index, seg_ord // 8 AS line, min(ymin) AS ymin, max(ymax) AS ymax FROM segments GROUP BY ALL) SELECT file_id, page_index, line, ymin - lag(ymax) OVER (PARTITION BY file_id, page_index ORDER BY line) AS gap FROM l")
def _(s, d):
    from pyspark.sql import Window

    line = F.floor(F.col("seg_ord") / 8).cast("long").alias("line")
    lines = segments(s, d).groupBy("file_id", "page_index", line).agg(F.min("ymin").alias("ymin"), F.max("ymax").alias("ymax"))
    return lines.select("file_id", "page_index", "line", (F.col("ymin") - F.lag("ymax").over(Window.partitionBy("file_id", "page_index").orderBy("line"))).alias("gap"))


MATH = "(text || ' $$y^2$$ with $x_' || turn || '$ and $5')"


@query("math_parts", f"""WITH m AS (SELECT conv_id, turn, {MATH} AS t FROM conversations WHERE NOT contains(text, '$')), s AS (SELECT conv_id, turn, string_split(t, '$$') AS p FROM m),
x AS (SELECT conv_id, turn, [struct_pack(kind := 'md', content := p[1]), struct_pack(kind := 'math_d', content := p[2]), struct_pack(kind := 'md', content := string_split(p[3], '$')[1]), struct_pack(kind := 'math_i', content := string_split(p[3], '$')[2]), struct_pack(kind := 'md', content := string_split(p[3], '$')[3] || '$5')] AS parts FROM s),
e AS (SELECT conv_id, turn, unnest(range(5)) AS part_ord, unnest(parts) AS part FROM x) SELECT conv_id, turn, CAST(part_ord AS INTEGER) AS part_ord, part.kind, part.content FROM e""")
def _(s, d):
    t = F.concat("text", F.lit(" $$y^2$$ with $x_"), F.col("turn").cast("string"), F.lit("$ and $5"))
    return read(s, d, "conversations").select("conv_id", "turn", F.posexplode(text.math_parts(t)).alias("part_ord", "part")).select("conv_id", "turn", "part_ord", "part.kind", "part.content")


@query("unknown_style", "SELECT p_partkey, '[Unknown style: none]' AS citation FROM part")
def _(s, d):
    return read(s, d, "part").select("p_partkey", citations.cite(F.array(F.lit("A")), {}, "none").alias("citation"))
