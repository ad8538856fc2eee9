"""Adapters from the driver's tables to the frames of the document library."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """Rows dealt evenly over the cluster's cores. A table that is small in bytes is read by few tasks, one a
    row group at most; where each of its rows takes long, that would leave most cores idle."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism)


def logged_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a reading session, short ones too."""
    return read(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("paper_id"), F.concat(F.lit("paper-"), F.col("user_id").cast("string")).alias("paper_name"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("start_time"), F.floor("value").cast("long").alias("duration_seconds"),
    )


def journal_rankings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names as journals; of equal normal forms the first stays."""
    from ..functions.text import normalize_journal
    from ..operators.store import first_wins

    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("ordinal"), F.col("p_name").alias("journal"), (F.col("p_size") % 4 + 1).alias("zone"), (F.col("p_size") % 10 == 0).alias("is_top"), (F.col("p_size") % 7 == 0).alias("is_oa"))
    return first_wins(p.withColumn("journal_norm", normalize_journal(F.col("journal"))).where("journal_norm <> ''"), ["journal_norm"], "ordinal")


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("id"), F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("name"),
        F.trim(F.regexp_replace(F.get(F.split("text", "\n"), 0), " +", " ")).alias("title"), F.col("lang").alias("language"), F.col("source").alias("journal"), F.col("n_chars").alias("file_size"), F.col("text").alias("abstract"),
    )


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the documents placed on pages: 8 a line, 40 lines a page."""
    w = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.filter(F.split("text", "[ \n]"), lambda x: x != "")).alias("i", "text"))
    line = F.floor(F.col("i") / 8).cast("long")
    return w.select(
        F.col("doc_id").alias("file_id"), F.floor(line / 40).cast("long").alias("page_index"), F.col("i").cast("long").alias("seg_ord"), "text",
        (F.pmod("i", F.lit(8)) * 40).cast("double").alias("xmin"), (F.pmod(line, F.lit(40)) * 14 + F.floor(F.pmod(line, F.lit(40)) / 5) * 20).cast("double").alias("ymin"),
    ).withColumn("xmax", F.col("xmin") + 36).withColumn("ymax", F.col("ymin") + 10)


def clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shop's clicks, equal rows once, with a client and a time."""
    return read(spark, sf_dir, "clicks").distinct().where("client_id is not null and ts is not null")
