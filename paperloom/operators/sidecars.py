"""Sidecar files of parsed documents: a JSON file over many lines for each, named by its document."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import groupby

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

#: The column of a file's text that can't be read.
DAMAGED = "_damaged"


#: Characters that Spark doesn't write in a folder's name as they are.
ESCAPED = re.compile(r"""[\x01-\x1f"#%'*/:=?\\\x7f{\[\]^]""")


def folder_name(key: str, value: str | None) -> str:
    """The name of a partition's folder, as Spark writes and reads it."""
    escape = lambda name: ESCAPED.sub(lambda m: f"%{ord(m[0]):02X}", name)
    return f"{escape(key)}={escape(value) if value else '__HIVE_DEFAULT_PARTITION__'}"


def folder_value() -> Column:
    """The partition's value in the name of a file's folder, the last but one part of its path, as text."""
    decoded = lambda c: F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))
    name = decoded(F.regexp_extract("_metadata.file_path", "([^/]*)/[^/]*$", 1))  # the path is that of an URI
    return F.nullif(decoded(F.regexp_extract(name, "(?s)=(.*)$", 1)), F.lit("__HIVE_DEFAULT_PARTITION__"))


def local_path(spark: SparkSession, folder: str) -> str | None:
    """The folder's path if it is in a file system that is mounted, else None."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return store.makeQualified(path).toUri().getPath() if store.getUri().getScheme() == "file" else None


def written(documents: DataFrame, key: str, content: Column, folder: str) -> None:
    """Writes each document's content, a struct or JSON text, to its own folder ``key=...``. One row a key.

    Where the folder is mounted the tasks write the files themselves: for a mounted folder Spark's writer starts a
    process for each file and folder, to set its permissions. Both ways give the same folders and texts."""
    spark = documents.sparkSession
    given = documents.select(F.col(key).cast("string").alias(key), content.alias("value"))
    if given.schema["value"].dataType.simpleString() != "string":
        given = given.withColumn("value", F.to_json("value", {"pretty": "true"}))
    given = given.repartition(4 * spark.sparkContext.defaultParallelism, key)
    root = local_path(spark, folder)
    if root is None or os.path.exists(root):  # Spark refuses a folder that is there already
        given.write.partitionBy(key).text(folder)
        return

    def write(rows: Iterator[Row]) -> None:
        for value, own in groupby(rows, lambda row: row[0]):
            place = f"{root}/{folder_name(key, value)}"
            os.makedirs(place, exist_ok=True)
            # a task that is run again, or twice at once, puts the same file in its place
            part = f"{place}/.{os.getpid()}-{os.urandom(8).hex()}"
            with open(part, "w", encoding="utf-8", newline="") as file:
                file.writelines(f"{row[1] or ''}\n" for row in own)
            # null and empty keys share a folder
            os.replace(part, f"{place}/part-{0 if value is None else 1 if value == '' else 2:05d}.txt")

    os.makedirs(root)
    given.sortWithinPartitions(key, "value").foreachPartition(write)
    open(f"{root}/_SUCCESS", "w").close()


def read(spark: SparkSession, folder: str, key: str, key_type: str, schema: str, defaults: dict[str, Column] | None = None) -> DataFrame:
    """The sidecars of a folder: ``key``, the schema's columns, ``damaged``.

    A file that is no JSON of this schema is damaged, and its columns are null. What a file lacks is its
    default, else null; what it has beside the schema is left out, so that older and newer files are read
    alike. Keys are taken from the files' paths: Spark's own reading of partitions takes time with the square of their number."""
    rows = spark.read.schema(f"{schema}, {DAMAGED} string").option("recursiveFileLookup", "true").option("multiLine", "true").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", DAMAGED).json(folder)
    damaged = F.col(DAMAGED).isNotNull()
    columns = [c for c in rows.columns if c != DAMAGED]
    value = lambda c: F.when(~damaged, F.coalesce(c, (defaults or {})[c]) if c in (defaults or {}) else F.col(c))
    return rows.select(folder_value().cast(key_type).alias(key), *[value(c).alias(c) for c in columns], damaged.alias("damaged"))
