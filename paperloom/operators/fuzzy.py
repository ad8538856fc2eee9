"""Resolution of journal names against a ranking table, cheapest stage first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import contract_journal, expand_journal, normalize_journal, significant_tokens

THRESHOLD = 0.6


GRAM = 6


def lengths(rows: DataFrame, c: str) -> list[int]:
    """The lengths of the runs by which these names are found: ``GRAM``, and those of shorter names."""
    return sorted(r[0] for r in rows.select(F.least(F.length(c), F.lit(GRAM)).alias("n")).where("n > 0").distinct().collect())


def grams(c: str, sizes: list[int]) -> Column:
    """The distinct runs of these lengths of a text."""

    def cut(k: int) -> Column:
        starts = F.when(F.length(c) >= k, F.sequence(F.lit(1), F.greatest(F.length(c) - k + 1, F.lit(1)))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.substring(F.col(c), i, F.lit(k)))

    return F.array_distinct(F.concat(F.array().cast("array<string>"), *[cut(k) for k in sizes]))


def containment(queries: DataFrame, rankings: DataFrame) -> DataFrame:
    """One name contains the other; the longest ranked name wins.

    A name that contains another contains all its runs of ``GRAM`` characters (a shorter one whole), so
    pairs meet at the contained name's run that is rarest among the ranked names, and ``contains``
    decides. So words that many names have bring no pairs together. Of the containing names only runs of
    the lengths that contained ones have are looked at: mostly ``GRAM`` alone.
    """
    whole = lambda c: F.least(F.length(c), F.lit(GRAM))
    r, q = rankings.select("ordinal", "journal_norm"), queries.select("name", "norm")
    of_ranked, of_queries = lengths(r, "journal_norm"), lengths(q, "norm")
    ranked = r.withColumn("k", F.explode(grams("journal_norm", sorted({*of_ranked, *of_queries}))))
    often = ranked.groupBy("k").agg(F.count("*").alias("often"))
    rarest = lambda rows, keys: rows.join(often, "k").groupBy(*keys).agg(F.min_by("k", F.struct("often", "k")).alias("k"))
    needle = rarest(ranked.where(F.length("k") == whole("journal_norm")), ["ordinal", "journal_norm"])
    one = q.select("name", "norm", F.explode(grams("norm", of_ranked)).alias("k")).join(needle, "k").where(F.col("norm").contains(F.col("journal_norm")))
    # a query with a run that no ranked name has is in none
    own = q.select("name", "norm", F.explode(grams("norm", of_queries)).alias("k")).where(F.length("k") == whole("norm")).join(often, "k", "left")
    sought = own.groupBy("name", "norm").agg(F.min_by("k", F.struct(F.coalesce("often", F.lit(0)), "k")).alias("k"), F.min(F.coalesce("often", F.lit(0))).alias("least")).where("least > 0")
    two = sought.join(ranked, "k").where(F.col("journal_norm").contains(F.col("norm")))
    best = F.max_by("ordinal", F.struct(F.length("journal_norm"), -F.col("ordinal"))).alias("ordinal")
    cols = ["name", "ordinal", "journal_norm"]
    return one.select(cols).unionByName(two.select(cols)).groupBy("name").agg(best).withColumn("stage", F.lit("containment"))


def token_overlap(queries: DataFrame, rankings: DataFrame) -> DataFrame:
    """Shared significant words over the larger set, 0.6 or more.

    With the words in order of rarity among the ranked names, two sets that overlap by 0.6 share one of
    the first ``n - ceil(0.6 n) + 1`` of each; an equi-join on those finds the pairs."""
    q = queries.withColumn("t", significant_tokens(F.col("expanded"))).where(F.size("t") >= 2).select("name", "t")
    r = rankings.where(F.length("journal_norm") > 5).withColumn("t", significant_tokens(F.col("journal_norm"))).select("ordinal", "t")
    often = r.select(F.explode("t").alias("w")).groupBy("w").agg(F.count("*").alias("often"))

    def first(rows: DataFrame, key: str) -> DataFrame:
        """The rows' rarest words."""
        words = rows.select(key, "t", F.explode("t").alias("w")).join(often, "w", "left")
        kept = words.groupBy(key, "t").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "w"))).alias("o"))
        n = F.size("t")
        most = (n - F.ceil(n * 3 / 5) + 1).cast("int")  # 0.6, exactly
        return kept.select(key, "t", F.explode(F.slice("o", F.lit(1), most)).alias("x")).select(key, "t", "x.w")

    pairs = first(q, "name").join(first(r, "ordinal").withColumnRenamed("t", "u"), "w").select("name", "ordinal", "t", "u").dropDuplicates(["name", "ordinal"])
    scored = pairs.withColumn("overlap", F.size(F.array_intersect("t", "u")) / F.greatest(F.size("t"), F.size("u"))).where(F.col("overlap") >= THRESHOLD)
    return scored.groupBy("name").agg(F.max_by("ordinal", F.struct("overlap", -F.col("ordinal"))).alias("ordinal")).withColumn("stage", F.lit("tokens"))


def resolve(names: DataFrame, rankings: DataFrame) -> DataFrame:
    """Distinct names (column name) through the stages, the first that finds one deciding.

    The exact stages are one pass of joins; only the rest goes on to containment, and what is left to
    the shared words."""
    q = names.select("name").distinct().withColumn("norm", normalize_journal(F.col("name"))).where("norm <> ''")
    q = q.withColumns({"expanded": expand_journal(F.col("norm")), "contracted": contract_journal(F.col("norm"))})
    for stage in ("norm", "expanded", "contracted"):
        q = q.join(rankings.select(F.col("journal_norm").alias(stage), F.col("ordinal").alias("o_" + stage)), stage, "left")
    stages = ("norm", "expanded", "contracted")
    ordinal = F.coalesce(*["o_" + s for s in stages])
    stage = F.coalesce(*[F.when(F.col("o_" + s).isNotNull(), s) for s in stages])
    q = q.select("name", "norm", "expanded", ordinal.alias("o"), stage.alias("s"))
    three = containment(q.where("o is null"), rankings).select("name", F.col("ordinal").alias("o3"))
    q = q.join(three, "name", "left")
    four = token_overlap(q.where("o is null and o3 is null"), rankings).select("name", F.col("ordinal").alias("o4"))
    q = q.join(four, "name", "left")
    found = F.coalesce("s", F.when(F.col("o3").isNotNull(), "containment"), F.when(F.col("o4").isNotNull(), "tokens"))
    return q.select("name", F.coalesce("o", "o3", "o4").alias("ordinal"), found.alias("stage"))
