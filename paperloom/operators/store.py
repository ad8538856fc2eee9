"""Keyed state as tables: upserts, patches, deletes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .folds import folded


def latest_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Whole-row upsert: of each key the row with the greatest ``order``, nulls in it included."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in keys]), order).alias("__row")).select(*keys, "__row.*").select(*rows.columns)


def first_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Insert-or-ignore: of each key the row with the least ``order``."""
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in rows.columns if c not in keys]), order).alias("__row")).select(*keys, "__row.*").select(*rows.columns)


def upsert_keeping_created(rows: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """Annotation pages: the first creation, the last value and change."""
    return rows.groupBy(*keys).agg(F.min(order).alias("created"), F.max_by(value, order).alias(value), F.max(order).alias("updated"))


def delete(rows: DataFrame, tombstones: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(tombstones.select(*keys).distinct(), keys, "left_anti")


def patch(rows: DataFrame, updates: DataFrame, key: str, allowed: list[str]) -> DataFrame:
    """Sets the allowed columns where the update has a value; one update a key."""
    u = updates.select(F.col(key).alias("__key"), *[F.col(c).alias(f"__{c}") for c in allowed if c in updates.columns])
    joined = rows.join(u, F.col(key) == F.col("__key"), "left")
    return joined.select(*[F.coalesce(F.col(f"__{c}"), F.col(c)).alias(c) if f"__{c}" in u.columns else F.col(c) for c in rows.columns])


# Columns of a paper that extensions may update.
UPDATABLE = ["title", "title_translation", "authors", "abstract_text", "abstract_translation", "journal", "publisher", "date", "doi"]


def patch_json(rows: DataFrame, updates: DataFrame, key: str, update: str = "update", allowed: list[str] | None = None) -> DataFrame:
    """Sets columns of text from JSON objects (``key``, ``update``), one a key: of the ``allowed`` ones that a row
    has, what the object names. A JSON null changes nothing, a text is set as it is, an empty one too, and any other value as
    its JSON text. Updates that are no JSON object change nothing."""
    columns = [c for c in rows.columns if c in (allowed or UPDATABLE)]
    value = lambda c: F.try_variant_get("__update", f"$.{c}", "variant")
    text = lambda c: F.when(F.schema_of_variant(value(c)) == "STRING", F.try_variant_get("__update", f"$.{c}", "string")).when(F.schema_of_variant(value(c)) != "VOID", F.to_json(value(c)))
    u = updates.select(F.col(key).alias("__key"), F.try_parse_json(update).alias("__update")).select("__key", *[text(c).alias(f"__{c}") for c in columns])
    joined = rows.join(u, F.col(key) == F.col("__key"), "left")
    return joined.select(*[F.coalesce(F.col(f"__{c}"), F.col(c)).alias(c) if c in columns else F.col(c) for c in rows.columns])


class Names:
    """The names of one family that are taken."""

    def __init__(self) -> None:
        self.taken: set[str] = set()
        self.after: dict[str, int] = {}

    def given(self, name: str) -> str:
        stem, dot, end = name.rpartition(".") if "." in name else (name, "", "")
        got, k = name, self.after.get(name, 1)
        while got in self.taken:
            got, k = f"{stem}_{k}{dot}{end}", k + 1
        self.after[name] = k
        self.taken.add(got)
        return got


def numbered_names(rows: DataFrame, name: str, order: str) -> DataFrame:
    """Names in the order of arrival; one that is taken gets the least free _1, _2, ... before its extension.

    Only names of one family, alike but for such endings, can take each other's; a family is walked in
    order, and what is held of it are the names taken."""
    ext = F.regexp_extract(name, r"(\.[^.]*)$", 1)
    family = F.concat(F.regexp_replace(F.regexp_replace(F.col(name), r"\.[^.]*$", ""), r"(_\d+)+$", ""), ext)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", unique_name string"
    columns = rows.columns
    return folded(rows.withColumn("__family", family), ["__family"], [order], Names, lambda names, row: [(*(row[c] for c in columns), names.given(row[name]))], schema)


def within_quota(stored: DataFrame, owner: str, key: str, value: str, quota: int) -> DataFrame:
    """Characters each owner has stored, and whether they are within the quota."""
    return stored.groupBy(owner).agg(F.coalesce(F.sum(F.length(value)), F.lit(0)).cast("long").alias("used")).withColumn("within", F.col("used") <= quota)


def quota_checked(stored: DataFrame, new: DataFrame, owner: str, key: str, value: str, quota: int = 5 << 20) -> DataFrame:
    """New values (one a key), with the characters that the owner's other keys hold (``used``) and
    whether those and the new value's bytes are within the quota (``accepted``)."""
    sizes = stored.select(F.col(owner).alias("__owner"), F.col(key).alias("__key"), F.length(value).alias("__size"))
    total = sizes.groupBy("__owner").agg(F.sum("__size").alias("__total"))
    own = sizes.groupBy("__owner", "__key").agg(F.sum("__size").alias("__own"))
    joined = new.join(total, F.col(owner) == F.col("__owner"), "left").drop("__owner")
    joined = joined.join(own, (F.col(owner) == F.col("__owner")) & (F.col(key) == F.col("__key")), "left")
    used = (F.coalesce("__total", F.lit(0)) - F.coalesce("__own", F.lit(0))).cast("long")
    return joined.withColumn("used", used).withColumn("accepted", F.col("used") + F.octet_length(value) <= quota).select(*new.columns, "used", "accepted")
