"""A Merkle manifest of a dataset: a hash tree for each group of rows, and one over the groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .cohorts import CRC_TABLE, crc_sql
from .common import dropped, stored, table

FANOUT = 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def framed(column: Column) -> Column:
    """A field of a leaf's preimage: ``-`` if null, else the UTF-8 length, a colon and the value."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def ranked(rows: DataFrame, group: str, order: list[str], label: str) -> DataFrame:
    """The rows with ``idx``, their place from 0 among those of their group in this order, and ``size``,
    the group's rows.

    Rows are dealt by ranges of (group, order), so a large group stands on many tasks; each counts its own,
    and the counts before it in the group are added. The dealt rows are written, so that all reads see
    the same ranges. The counts are a row for each group and task at most.
    """
    spark = rows.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = rows.repartitionByRange(tasks, group, *order).sortWithinPartitions(group, *order).select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("place"))
    own = stored(own, label)
    counts = own.groupBy(group, "part").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    within = Window.partitionBy(group)
    offsets = counts.select(
        F.col(group).alias("g"),
        F.col("part").alias("p"),
        (F.coalesce(F.sum("n").over(within.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - F.col("first")).alias("shift"),
        F.sum("n").over(within).alias("size"),
    )
    return own.join(offsets, (F.col("part") == F.col("p")) & F.col(group).eqNullSafe(F.col("g"))).withColumn("idx", F.col("place") + F.col("shift")).drop("part", "place", "p", "g", "shift")


def level(nodes: DataFrame) -> DataFrame:
    """Nodes (group, idx, size, node) with their parent's digest, and what stands before and after each
    among its siblings. One ordered full-frame list of a run of siblings, 16 at most, gives all three.
    The single node of a group is its own parent."""
    run = Window.partitionBy("group", F.col("parent")).orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    at = (F.col("idx") % FANOUT).cast("int")
    listed = nodes.withColumn("parent", F.call_function("div", F.col("idx"), F.lit(FANOUT))).withColumn("run", F.collect_list("node").over(run))
    joined = lambda x: F.when(F.col("size") > 1, F.array_join(x, "")).otherwise("")
    return listed.select(
        *[c for c in nodes.columns],
        "parent",
        F.when(F.col("size") > 1, digest(F.array_join("run", ""))).otherwise(F.col("node")).alias("up"),
        joined(F.slice("run", F.lit(1), at)).alias("before"),
        joined(F.slice("run", at + 2, F.lit(FANOUT))).alias("after"),
    )


def parents(nodes: DataFrame) -> DataFrame:
    """The next level: of each run its first node's row stands for the parent."""
    size = F.call_function("div", F.col("size") + (FANOUT - 1), F.lit(FANOUT))
    return level(nodes).where(F.col("idx") % FANOUT == 0).select("group", F.col("parent").alias("idx"), size.alias("size"), F.col("up").alias("node"))


def tree(leaves: DataFrame, label: str) -> list[DataFrame]:
    """The levels above the leaves (group, idx, size, node), each stored, up to one node a group; the last
    is that of the roots. Only the number of levels is asked for by the driver."""
    levels, most = [], leaves.agg(F.max("size")).first()[0] or 0
    now = leaves
    while most > 1:
        now = stored(parents(now), label)
        levels.append(now)
        most = -(-most // FANOUT)
    return levels


def descended(levels: list[DataFrame], roots: DataFrame, keep: list[str]) -> DataFrame:
    """From ``roots`` (group, idx, path, ...) down the levels, highest last: each node's path is its own step,
    its siblings before and after (none of a single node), and then its parent's path. ``keep`` names the
    lowest level's columns that stay beside group, idx, path and what the roots bring."""
    brought = [c for c in roots.columns if c not in ("group", "idx", "path")]
    none = F.array().cast("array<struct<before:string,after:string>>")
    own = F.when(F.col("size") > 1, F.array(F.struct("before", "after"))).otherwise(none)
    found = roots
    for k in reversed(range(len(levels))):
        above = found.select("group", F.col("idx").alias("parent"), F.col("path").alias("rest"), *brought)
        rows = level(levels[k]).join(above, ["group", "parent"])
        found = rows.select("group", "idx", F.concat(own, "rest").alias("path"), *brought, *(keep if k == 0 else []))
    return found


def manifest(rows: DataFrame, group: str = "source", order: str = "doc_id", leaf: str = "leaf") -> DataFrame:
    """The rows with ``subroot``, their group's digest, ``root``, that of all groups, and ``path``: for each
    level up to the root the joined digests of the siblings before and after.

    ``leaf`` is the row's digest. Leaves of a group ascend by ``order`` (nulls first, equal ones by digest);
    runs of 16 become their parent's digest, a lone node is its own. The groups' digests ascend by group
    (as text, null first) and likewise give the root. Repeated rows are leaves each; an empty table gives
    no rows; extra columns of any names are kept but for the three that are added.
    """
    key = F.coalesce(F.concat(F.lit("1"), F.col(group).cast("string")), F.lit("0"))
    # written once: the ranges are sampled from it, then it is dealt
    given = stored(rows.select(key.alias("group"), F.col(leaf).alias("node"), F.col(order).alias("order"), F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row")), "merkle-leaves")
    leaves = ranked(given, "group", ["order", "node"], "merkle-ranked")
    dropped(given)
    upper = tree(leaves, "merkle-nodes")
    subroots = (upper or [leaves])[-1].select(F.lit("").alias("group"), F.col("group").alias("name"), "node")
    groups = ranked(subroots, "group", ["name"], "merkle-groups")
    above = tree(groups, "merkle-roots")
    none = F.array().cast("array<struct<before:string,after:string>>")
    tops = (above or [groups])[-1].select("group", "idx", none.alias("path"), F.col("node").alias("root"))
    named = descended([groups, *above[:-1]], tops, ["name", F.col("node").alias("subroot")])
    roots = named.select(F.col("name").alias("group"), F.lit(0).cast("long").alias("idx"), "path", "subroot", "root")
    found = descended([leaves, *upper[:-1]], roots, ["row"])
    return found.select("row.*", "subroot", "root", "path")


def siblings(path: Column) -> Column:
    """All siblings of a path, joined from the leaf's up."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), "")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(path, leaf, lambda h, s: digest(F.concat(s["before"], h, s["after"])))


FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def leaf_digest(fields: list[Column]) -> Column:
    return digest(F.concat(*[framed(f) for f in fields]))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of ``documents``, and whether each row verifies; a fifth of the rows is tampered with."""
    docs = table(spark, sf_dir, "documents")
    lowered = F.translate("text", UPPER, LOWER)
    tampered = F.crc32(F.col("doc_id").cast("string")) % 5 == 0  # null for a null doc_id, which stays
    fields = [F.col(c) for c in FIELDS]
    leaves = docs.select("doc_id", "source", leaf_digest(fields).alias("leaf"), F.when(tampered, leaf_digest([*fields[:-1], lowered])).alias("tampered"))
    proven = manifest(leaves)
    back = folded(F.coalesce("tampered", "leaf"), F.col("path"))
    found = proven.select("doc_id", "leaf", "subroot", "root", digest(siblings(F.col("path"))).alias("proof_sha256"), back.alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


#: Levels of the SQL: enough for 16^6 rows of a source, and for 16^4 sources.
SQL_LEVELS, SQL_TOPS = 6, 4


def op11_sql() -> str:
    """The same by nested tables of levels, joined by place."""
    framed_sql = lambda c: f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"
    leaf = lambda text: "sha256(" + " || ".join([*map(framed_sql, FIELDS[:-1]), framed_sql(text)]) + ")"
    changed = leaf(f"translate(text, '{UPPER}', '{LOWER}')")
    tables = [
        f"crc AS {CRC_TABLE}",
        f"hashed AS (SELECT doc_id, source AS g, {leaf('text')} AS leaf, CASE WHEN {crc_sql('doc_id::VARCHAR')} % 5 = 0 THEN {changed} END AS tampered FROM documents, crc)",
        "a0 AS (SELECT *, leaf AS node, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY g) AS size FROM hashed)",
    ]

    def climbed(name: str, levels: int) -> None:
        for k in range(levels):
            tables.append(f"{name}run{k} AS (SELECT g, idx // {FANOUT} AS parent, any_value(size) AS size, list(node ORDER BY idx) AS run FROM {name}{k} GROUP BY g, idx // {FANOUT})")
            tables.append(f"{name}{k + 1} AS (SELECT g, parent AS idx, (size + {FANOUT - 1}) // {FANOUT} AS size, CASE WHEN size > 1 THEN sha256(array_to_string(run, '')) ELSE run[1] END AS node FROM {name}run{k})")

    climbed("a", SQL_LEVELS)
    tables.append(f"b0 AS (SELECT 0 AS g, g AS name, node, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS idx, count(*) OVER () AS size FROM a{SQL_LEVELS})")
    climbed("b", SQL_TOPS)
    tables.append(f"c0 AS (SELECT a.doc_id, a.leaf, a.g, a.idx, b.idx AS top, b.node AS subroot, r.node AS root, '' AS proof, coalesce(a.tampered, a.leaf) AS f FROM a0 a JOIN b0 b ON a.g IS NOT DISTINCT FROM b.name JOIN b{SQL_TOPS} r ON true)")
    steps = [("a", k, "c.g", "c.idx") for k in range(SQL_LEVELS)] + [("b", k, "0", "c.top") for k in range(SQL_TOPS)]
    for i, (name, k, g, idx) in enumerate(steps):
        at = f"(({idx} // {FANOUT**k}) % {FANOUT})"
        before, after = f"array_to_string(run[1:{at}], '')", f"array_to_string(run[{at} + 2:], '')"
        tables.append(
            f"c{i + 1} AS (SELECT doc_id, leaf, c.g, c.idx, top, subroot, root, CASE WHEN size > 1 THEN proof || {before} || {after} ELSE proof END AS proof, "
            f"CASE WHEN size > 1 THEN sha256({before} || f || {after}) ELSE f END AS f FROM c{i} c JOIN {name}run{k} r ON {g} IS NOT DISTINCT FROM r.g AND {idx} // {FANOUT ** (k + 1)} = r.parent)"
        )
    return "WITH " + ",\n".join(tables) + f"\nSELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, f AS folded_root, f = root AS verified FROM c{len(steps)}"


OP11_SQL = op11_sql()
