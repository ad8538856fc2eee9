"""Citations and identifiers, each query beside its DuckDB SQL."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions import citations, text
from ..sources import read, spread
from .library import query

# Authors of the cited parts: one name alone, names of several words, and others than Latin ones.
PEOPLE = ["Ada Lovelace", "Alan M. Turing", "Plato", "王小明", "Grace Brewster Murray Hopper", "Kurt Gödel"] + [f"Writer{chr(65 + i)} von Loom{i}" for i in range(18)]
HOW_MANY = [1, 2, 0, 3, 4, 6, 7, 8, 11, 21, 24]


def cited(s, d, style, output="text"):
    k = F.col("p_partkey")
    fields = {
        "title": F.concat(F.lit(" On  "), F.col("p_name"), F.when(k % 9 == 0, F.lit(' <"*b*" & {c}\\>')).otherwise("")), "journal": F.when(k % 3 != 0, F.col("p_brand")), "publisher": F.when(k % 2 == 0, F.lit("Press")),
        "date": F.when(k % 4 == 0, "2024-03").when(k % 4 == 1, "March 2023").when(k % 4 == 2, "2021/5/06"), "volume": F.when(k % 6 != 0, F.col("p_size").cast("string")), "issue": F.when(k % 5 != 0, F.lit("2")),
        "pages": F.when(k % 8 != 0, F.lit("10–20–3—4—5")), "doi": F.when(k % 7 != 0, F.lit("10.1000/x1")), "url": F.when(k % 2 != 0, F.lit("https://x.org/1")), "isbn": F.when(k % 10 < 5, F.lit("978")),
    }
    count = F.get(F.array(*[F.lit(n) for n in HOW_MANY]), (k % len(HOW_MANY)).cast("int"))
    authors = F.slice(F.array(*[F.lit(n) for n in PEOPLE]), F.lit(1), count)
    parts = spread(read(s, d, "part").select("p_partkey", "p_name", "p_brand", "p_size"))
    return parts.select("p_partkey", citations.cite(authors, fields, style, output).alias("citation"))


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def template_sql(template: str) -> str:
    """The SQL of a style's template, whose fields are columns."""
    parts = []
    for optional, plain in re.findall(r"\[([^\]]*)\]|([^\[]+)", template):
        pieces = re.split(r"\{(\w+)\}", optional or plain)
        whole = " || ".join(x if i % 2 else quoted(x) for i, x in enumerate(pieces))
        parts.append(f"CASE WHEN {pieces[1]} <> '' THEN {whole} ELSE '' END" if optional else f"({whole})")
    whole = " || ".join(parts)
    return f"nullif({whole}, '')" if template.startswith("[") else whole


PARTS = "string_split(a, ' ')"
ONE = f"len({PARTS}) = 1"
GIVEN = f"{PARTS}[1:len({PARTS}) - 1]"


def initials_sql(dot: str, sep: str) -> str:
    return f"array_to_string(list_transform({GIVEN}, lambda g: upper(g[1]) || '{dot}'), '{sep}')"


FORMS = {
    "gbt": f"CASE WHEN regexp_matches(a, '[一-鿿]') THEN a WHEN {ONE} THEN upper(a) ELSE upper({PARTS}[-1]) || ' ' || {initials_sql('', ' ')} END",
    "initials": f"CASE WHEN {ONE} THEN a ELSE {PARTS}[-1] || ', ' || {initials_sql('.', ' ')} END",
    "full": f"CASE WHEN {ONE} THEN a ELSE {PARTS}[-1] || ', ' || array_to_string({GIVEN}, ' ') END",
    "first": f"CASE WHEN {ONE} THEN a ELSE {initials_sql('.', ' ')} || ' ' || {PARTS}[-1] END",
    "short": f"CASE WHEN {ONE} THEN a ELSE {PARTS}[-1] || ' ' || {initials_sql('', '')} END",
}
MARKED = r"'\*([^*]+)\*'"
ESCAPED = "replace(replace(replace(replace(c, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"
OUTPUTS = {
    "text": rf"regexp_replace(c, {MARKED}, '\1', 'g')",
    "html": rf"regexp_replace({ESCAPED}, {MARKED}, '<i>\1</i>', 'g')",
    "rtf": quoted(text.RTF_BEGIN) + rf" || regexp_replace(replace(replace(replace(c, '\', '\\'), '{{', '\{{'), '}}', '\}}'), {MARKED}, '{{\\i \1}}', 'g') || '}}'",
}


def cite_sql(style: str, output: str = "text") -> str:
    s = citations.STYLES[citations.SAME.get(style, style)]
    more = f"len(names) > {s.most} THEN array_to_string(names[1:{s.most}], {quoted(s.sep)}) || ', et al.'"
    listed = f"CASE WHEN {more} WHEN len(names) <= 1 THEN array_to_string(names, '') ELSE array_to_string(names[1:len(names) - 1], {quoted(s.sep)}) || {quoted(s.last)} || names[-1] END"
    source = f"CASE WHEN journal <> '' THEN {template_sql(s.journal)}" + (f" WHEN publisher <> '' THEN {template_sql(s.publisher)}" if s.publisher else "") + " END"
    link = f"CASE WHEN doi <> '' THEN {template_sql(s.doi)}" + (f" WHEN url <> '' THEN {template_sql(s.url)}" if s.url else "") + " END"
    parts = [f"nullif({'upper(' + listed + ')' if s.upper else listed}, '')", *[template_sql(h) for h in s.head], source, link]
    odd = "' <\"*b*\" & {c}\\>'"
    return f"""WITH f AS (SELECT p_partkey, trim('On ' || p_name || CASE WHEN p_partkey % 9 = 0 THEN {odd} ELSE '' END) AS title, CASE WHEN p_partkey % 3 <> 0 THEN p_brand ELSE '' END AS journal, CASE WHEN p_partkey % 2 = 0 THEN 'Press' ELSE '' END AS publisher,
  ['2024', '2023', '2021', ''][p_partkey % 4 + 1] AS year, CASE WHEN p_partkey % 6 <> 0 THEN CAST(p_size AS VARCHAR) ELSE '' END AS volume, CASE WHEN p_partkey % 5 <> 0 THEN '2' ELSE '' END AS issue, CASE WHEN p_partkey % 8 <> 0 THEN '10-20–3-4—5' ELSE '' END AS pages,
  CASE WHEN p_partkey % 7 <> 0 THEN '10.1000/x1' ELSE '' END AS doi, CASE WHEN p_partkey % 2 <> 0 THEN 'https://x.org/1' ELSE '' END AS url, CASE WHEN p_partkey % 3 <> 0 THEN '[J]' WHEN p_partkey % 10 < 5 THEN '[M]' ELSE '[Z]' END AS kind,
  list_transform({PEOPLE}[1:{HOW_MANY}[p_partkey % {len(HOW_MANY)} + 1]], lambda a: {FORMS[s.form]}) AS names FROM part),
w AS (SELECT p_partkey, concat_ws({quoted(s.join)}, {", ".join(parts)}) || '.' AS c FROM f) SELECT p_partkey, {OUTPUTS[output]} AS citation FROM w"""


for _style in [*citations.STYLES, *citations.SAME]:
    query("cite_" + _style.replace("-", "_"), cite_sql(_style))(lambda s, d, style=_style: cited(s, d, style))
query("cite_html", cite_sql("chicago-17th-notes", "html"))(lambda s, d: cited(s, d, "chicago-17th-notes", "html"))
query("cite_rtf", cite_sql("apa-7th", "rtf"))(lambda s, d: cited(s, d, "apa-7th", "rtf"))


NEAR = r"trim(regexp_replace(regexp_replace(lower({c}), '[^A-Za-z0-9_\s]', '', 'g'), '\s+', ' ', 'g'))"
LONG_WORDS = "list_distinct(list_filter(string_split({c}, ' '), lambda w: length(w) > 2))"


def alike_sql(a: str, b: str) -> str:
    x, y = LONG_WORDS.format(c=a), LONG_WORDS.format(c=b)
    return f"CASE WHEN coalesce({a}, '') = '' OR coalesce({b}, '') = '' THEN 0 WHEN {a} = {b} THEN 1 WHEN greatest(len({x}), len({y})) = 0 THEN 0 ELSE len(list_intersect({x}, {y})) / greatest(len({x}), len({y})) END > 0.7"


TITLES = (
    """WITH t0 AS (SELECT item_id, text AS l, CASE item_id % 4 WHEN 0 THEN upper(text) || '!' WHEN 1 THEN 'names other words here' WHEN 2 THEN text || ' with one more' END AS f, CASE item_id % 3 WHEN 0 THEN 'Some other: words here' WHEN 1 THEN text END AS x FROM benchmark),
t AS (SELECT item_id, CASE WHEN item_id % 5 <> 0 THEN l END AS l, f, x FROM t0), n AS (SELECT *, """
    + ", ".join(NEAR.format(c=c) + f" AS n{c}" for c in "lfx")
    + " FROM t) "
)


@query("title_vote", TITLES + f"SELECT item_id, CASE WHEN {alike_sql('nl', 'nf')} THEN l WHEN {alike_sql('nl', 'nx')} THEN l WHEN {alike_sql('nf', 'nx')} THEN f ELSE coalesce(l, f, x) END AS title FROM n")
def _(s, d):
    k, t = F.col("item_id"), F.col("text")
    font = F.when(k % 4 == 0, F.concat(F.upper(t), F.lit("!"))).when(k % 4 == 1, "names other words here").when(k % 4 == 2, F.concat(t, F.lit(" with one more")))
    xmp = F.when(k % 3 == 0, "Some other: words here").when(k % 3 == 1, t)
    return read(s, d, "benchmark").select("item_id", text.vote_title(F.when(k % 5 != 0, t), font, xmp).alias("title"))


DOI_TEXT = "text || CASE doc_id % 4 WHEN 0 THEN ' doi:10.1000/x' || doc_id || ').' WHEN 1 THEN ' (see https://doi.org/10.12345/A(1)-b;c], then)' WHEN 2 THEN ' 10.99/short 10.5555/\"q' ELSE '' END"


@query("doi_extract", rf"SELECT doc_id, nullif(regexp_replace(regexp_extract({DOI_TEXT}, '(10\.\d{{4,9}}/[^\s" + r'''"<>]+)', 1), '[.,;)\]]+$', ''), '') AS doi FROM documents''')
def _(s, d):
    k = F.col("doc_id")
    more = F.when(k % 4 == 0, F.concat(F.lit(" doi:10.1000/x"), k.cast("string"), F.lit(")."))).when(k % 4 == 1, " (see https://doi.org/10.12345/A(1)-b;c], then)").when(k % 4 == 2, ' 10.99/short 10.5555/"q').otherwise("")
    return read(s, d, "documents").select("doc_id", text.find_doi(F.concat("text", more)).alias("doi"))


ARXIV = [" arXiv:2401.12345", " arxiv: cs/0703142", " https://arxiv.org/pdf/2401.1234", " doi 10.48550/ArXiv.2212.00001", " nothing", " arxiv.org/abs/1501.00001 arXiv:2001.54321"]
ARXIV_FORMS = [r"(?i)arxiv:\s*(\d{4}\.\d{4,5})", r"(?i)arxiv:\s*([a-z-]+/\d{7})", r"(?i)arxiv\.org/(?:abs|pdf)/(\d{4}\.\d{4,5})", r"(?i)10\.48550/arxiv\.(\d{4}\.\d{4,5})"]
ARXIV_SQL = ", ".join(f"nullif(regexp_extract(t, '{p}', 1), '')" for p in ARXIV_FORMS)


@query("arxiv_extract", f"SELECT doc_id, coalesce({ARXIV_SQL}) AS arxiv FROM (SELECT doc_id, text || {ARXIV}[doc_id % 6 + 1] AS t FROM documents)")
def _(s, d):
    t = F.concat("text", F.get(F.array(*[F.lit(x) for x in ARXIV]), (F.col("doc_id") % 6).cast("int")))
    return read(s, d, "documents").select("doc_id", text.find_arxiv(t).alias("arxiv"))
