"""Nested sections of a parsed document as rows, in reading order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import working_dir


def flattened(documents: DataFrame, key: str, sections: str) -> DataFrame:
    """The sections of JSON texts, each before its subsections: key, sec_ord (from 0), depth, title, level,
    content.

    ``sections`` is a JSON array of {title, level, content, subsections}, nested to any depth. A level of all
    documents is taken apart at a time, and written; a section is told by its path, the places from the top
    down, whose order is that of reading. Texts that are no JSON array have no sections; what a section lacks
    is null. Repeated keys are one document."""
    spark = documents.sparkSession
    item = lambda name, kind: F.try_variant_get("section", f"$.{name}", kind).alias(name)
    columns = [key, "path", item("title", "string"), item("level", "int"), item("content", "string")]
    found = documents.select(key, F.posexplode(F.try_variant_get(F.try_parse_json(F.col(sections)), "$", "array<variant>")).alias("place", "section")).select(key, F.array("place").alias("path"), "section")
    levels = []
    while True:
        folder = working_dir(spark, "sections")
        rest = F.try_variant_get("section", "$.subsections", "array<variant>").alias("rest")
        found.select(*columns, rest).write.parquet(folder)
        level = spark.read.parquet(folder)
        levels.append(level)
        inner = level.where(F.size("rest") > 0)
        if inner.isEmpty():
            break
        found = inner.select(key, "path", F.posexplode("rest").alias("place", "section")).select(key, F.concat("path", F.array("place")).alias("path"), "section")
    whole = levels[0].drop("rest")
    for more in levels[1:]:
        whole = whole.unionByName(more.drop("rest"))
    order = (F.row_number().over(Window.partitionBy(key).orderBy("path")) - 1).alias("sec_ord")
    return whole.select(key, order, F.size("path").alias("depth"), "title", "level", "content")
