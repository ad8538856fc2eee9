"""Removal of boilerplate lines by their frequency within a site."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

RATIO, LEAST_PAGES = 0.08, 3
#: Frequent lines in all that are sent to every task; beyond, the join shuffles.
BROADCAST_LINES = 500_000


def lines_of(text: str) -> Column:
    return F.split(F.col(text), "\n", -1)


def frequent_lines(pages: DataFrame, host: str, text: str, ratio: float, least: int) -> DataFrame:
    """(host, line): hashes of the lines on more than ``ratio`` of the host's pages, and on ``least`` or more.

    A page counts a line once. Blank lines, and pages without a host, don't count; pages without text
    count as pages of their host.
    """
    known = pages.where(F.col(host).isNotNull()).select(F.col(host).alias("host"), F.col(text).alias("text"))
    totals = known.groupBy("host").agg(F.count("*").alias("pages"))
    seen = known.select("host", F.explode(F.array_distinct(F.transform(F.filter(lines_of("text"), lambda x: F.trim(x) != ""), lambda x: F.xxhash64(x)))).alias("line"))
    counted = seen.groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return counted.join(totals, "host").where(F.col("n") > ratio * F.col("pages")).select("host", "line")


def unused(name: str, columns: list[str]) -> str:
    """A name that no column has."""
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    return name


def without_boilerplate(pages: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, least: int = LEAST_PAGES, dropped: str | None = None) -> DataFrame:
    """The pages with boilerplate lines cut from their text, other columns unchanged.

    ``dropped`` names a new column with the number of lines cut. Pages without a host and null
    texts stay as they are; a page all of whose lines are boilerplate keeps an empty text. Lines
    are told apart by a 64-bit hash. A host has at most 1 / ``ratio`` times its lines per page
    of frequent lines, so the list for each host is bounded. Repeated rows are pages of their own;
    an empty table gives no rows; extra columns are kept, whatever their names.
    """
    # written once: it is counted, and joined
    frequent = stored(frequent_lines(pages, host, text, ratio, least), "frequent-lines")
    few = frequent.limit(BROADCAST_LINES + 1).count() <= BROADCAST_LINES
    own, cut = (unused(name, pages.columns) for name in ("__host", "__lines"))
    by_host = frequent.groupBy("host").agg(F.collect_set("line").alias("lines")).select(F.col("host").alias(own), F.col("lines").alias(cut))
    joined = pages.join(F.broadcast(by_host) if few else by_host, F.col(f"`{host}`") == F.col(own), "left")
    kept = F.filter(lines_of(text), lambda x: (F.trim(x) == "") | ~F.array_contains(cut, F.xxhash64(x)))
    known = F.col(text).isNotNull() & F.col(cut).isNotNull()
    columns = [F.when(known, F.array_join(kept, "\n")).otherwise(F.col(c)).alias(c) if c == text else F.col(f"`{c}`") for c in pages.columns]
    if dropped:
        columns.append(F.when(known, F.size(lines_of(text)) - F.size(kept)).otherwise(0).cast("long").alias(dropped))
    return joined.select(*columns)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by source: doc_id, the cleaned text, and the number of lines dropped."""
    return without_boilerplate(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), dropped="n_dropped").select("doc_id", "n_dropped", "text")


OP5_SQL = f"""
WITH pages AS (SELECT source, count(*) AS pages FROM documents WHERE source IS NOT NULL GROUP BY source),
seen AS (
  SELECT source, unnest(list_distinct(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> ''))) AS line
  FROM documents WHERE source IS NOT NULL),
counted AS (SELECT source, line, count(*) AS n FROM seen GROUP BY source, line HAVING count(*) >= {LEAST_PAGES}),
frequent AS (
  SELECT c.source, list(c.line) AS lines FROM counted c JOIN pages p ON c.source = p.source
  WHERE c.n > {RATIO} * p.pages GROUP BY c.source)
SELECT d.doc_id,
  CASE WHEN d.text IS NOT NULL AND f.lines IS NOT NULL
    THEN len(string_split(d.text, chr(10))) - len(list_filter(string_split(d.text, chr(10)), lambda x: trim(x) = '' OR NOT list_contains(f.lines, x)))
    ELSE 0 END AS n_dropped,
  CASE WHEN d.text IS NOT NULL AND f.lines IS NOT NULL
    THEN array_to_string(list_filter(string_split(d.text, chr(10)), lambda x: trim(x) = '' OR NOT list_contains(f.lines, x)), chr(10))
    ELSE d.text END AS text
FROM documents d LEFT JOIN frequent f ON d.source = f.source
"""
