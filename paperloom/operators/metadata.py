"""Reconciliation of bibliographic records from several sources."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import SPACE, clean, keyword_union, trimmed, vote_title
from .records import filled_in


def fill(base: Column, other: Column) -> Column:
    """A scalar fills only what is missing or empty."""
    return F.coalesce(filled_in(base), filled_in(other), base)


def prefer_list(base: Column, other: Column) -> Column:
    """A list that is not empty replaces the other."""
    return F.when(F.size(other) > 0, other).otherwise(base)


def override(base: Column, remote: Column) -> Column:
    """Remote values that are not blank replace local ones."""
    return F.coalesce(clean(remote), base)


def structured_title(title: Column, parsed: Column, file_name: Column) -> Column:
    """The parser's title, with single spaces, where the own one is missing, shorter than 5, or the file's name."""
    tidy = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), SPACE + "+", " "))
    own = tidy(title)
    bare = F.regexp_replace(file_name, r"(?i)\.pdf$", "")
    return F.when((parsed != "") & ((F.length(own) < 5) | (own == bare)), tidy(parsed)).otherwise(title)


# What a first page and structured markup are read by.
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"


def first_page_facts(page: Column) -> Column:
    """What a first page says: doi, abstract, date, volume, issue, pages, url; null for what it doesn't."""
    part = lambda pattern, group=1: F.nullif(F.regexp_extract(page, pattern, group), F.lit(""))
    numbers = r"(\d{4})[-/.]\s*(\d{1,2})[-/.]\s*(\d{1,2})"
    day = F.when(page.rlike(numbers), F.concat_ws("-", part(numbers, 1), F.lpad(part(numbers, 2), 2, "0"), F.lpad(part(numbers, 3), 2, "0")))
    stop = r"(?=\n(?:Keywords|关键词|Key\s*words|Introduction|1\s*[.\s]|一\s*[、.]|$))"
    abstract = part(r"(?i)(?:Abstract|摘\s*要)[：:\s]*\n?([\s\S]{20,800}?)" + stop)
    span = r"(?i)pp?\.?\s*(\d+)\s*[-–]\s*(\d+)"
    return F.struct(
        F.regexp_replace(part(r"10\.\d{4,9}/[^\s,;\"'<>}\]]+", 0), r"[.)}>\]]+$", "").alias("doi"),
        F.regexp_replace(F.trim(abstract), r"\s+", " ").alias("abstract"),
        F.coalesce(day, part(rf"(?i)(?:{MONTHS})\s+\d{{4}}", 0)).alias("date"),
        part(r"(?i)Vol(?:ume)?\.?\s*(\d+)").alias("volume"),
        part(r"(?i)(?:No\.?\s*|Issue\s*)(\d+)").alias("issue"),
        F.when(page.rlike(span), F.concat(part(span, 1), F.lit("–"), part(span, 2))).alias("pages"),
        F.regexp_replace(part(r"https?://[^\s<>\"]+", 0), r"[.)>,;]+$", "").alias("url"),
    )


def first_page_fill(known: dict[str, Column], facts: Column) -> dict[str, Column]:
    """Known fields, with gaps filled from the first page, which is read only where DOI, abstract or date is
    missing. An empty text is missing too."""
    look = filled_in(known["doi"]).isNull() | filled_in(known["abstract"]).isNull() | filled_in(known["date"]).isNull()
    return {k: F.coalesce(filled_in(c), F.when(look, filled_in(facts[k])), c) for k, c in known.items()}


def joined_date(date: Column) -> Column:
    """Year, month and day, as far as there are; null without a year."""
    parts = F.filter(F.array(*[date[c] for c in ("year", "month", "day")]), lambda x: x != "")
    return F.when(filled_in(date["year"]).isNotNull(), F.array_join(parts, "-"))


def some(c: Column) -> Column:
    """A list that has something, else null."""
    return F.when(F.size(c) > 0, c)


def parsed_document_merge(own: Column, parsed: Column, file_name: Column) -> Column:
    """A paper's metadata with what the structured parser found, as one struct.

    ``own`` has title, abstract, authors (names), doi, date, journal, volume, issue, pages, publisher,
    keywords; ``parsed`` title, abstract, authors (structs of full_name, first_name, middle_name, last_name),
    doi, date (year, month, day), venue (name, volume, issue, pages, publisher), keywords. The title is taken
    where the own one is missing, short or the file's name; keywords are added; the rest only fills gaps,
    empty texts and lists among them."""
    from .remote import full_name

    names = F.filter(F.transform(F.coalesce(parsed["authors"], F.array().cast("array<struct<full_name:string,first_name:string,middle_name:string,last_name:string>>")), full_name), lambda x: x != "")
    venue = parsed["venue"]
    gap = lambda a, b: F.coalesce(filled_in(a), filled_in(b), a)
    union = F.when(some(parsed["keywords"]).isNull(), own["keywords"]).when(some(own["keywords"]).isNull(), parsed["keywords"]).otherwise(keyword_union(own["keywords"], parsed["keywords"]))
    return F.struct(
        structured_title(own["title"], parsed["title"], file_name).alias("title"),
        gap(own["abstract"], parsed["abstract"]).alias("abstract"),
        F.coalesce(some(own["authors"]), F.when(F.size(parsed["authors"]) > 0, names), own["authors"]).alias("authors"),
        gap(own["doi"], parsed["doi"]).alias("doi"),
        F.coalesce(filled_in(own["date"]), joined_date(parsed["date"]), own["date"]).alias("date"),
        gap(own["journal"], venue["name"]).alias("journal"),
        *[gap(own[c], venue[c]).alias(c) for c in ("volume", "issue", "pages", "publisher")],
        union.alias("keywords"),
    )


def layout_layer(known: dict[str, Column], layout: dict[str, Column]) -> dict[str, Column]:
    """Title, abstract and doi after the layout's findings (doi, title_by_layout, title_by_font, abstract):
    its DOI fills a gap, titles are voted on, its abstract replaces the own one."""
    title = vote_title(filled_in(layout["title_by_layout"]), filled_in(layout["title_by_font"]), filled_in(known["title"]))
    return {"title": F.coalesce(title, known["title"]), "doi": F.coalesce(filled_in(known["doi"]), filled_in(layout["doi"]), known["doi"]), "abstract": F.coalesce(filled_in(layout["abstract"]), known["abstract"])}


def completed(cached: Column, parsed: Column) -> Column:
    """What was cached, or what is parsed anew where that is missing or empty."""
    return F.when(F.coalesce(F.size(cached), F.lit(0)) > 0, cached).otherwise(parsed)


def by_doi_or_title(refs: DataFrame, remote: DataFrame) -> DataFrame:
    """References (id, doi, title) with the remote record (record, doi, title) of their DOI, in any case; the
    rest with the one whose title shares most words, 0.7 of the larger set or more."""
    from .remote import by_title

    dois = remote.select(F.lower(F.trim("doi")).alias("__doi"), F.col("record").alias("by_doi")).where("__doi is not null").groupBy("__doi").agg(F.min("by_doi").alias("by_doi"))
    one = refs.join(dois, F.lower(F.trim(F.col("doi"))) == F.col("__doi"), "left").drop("__doi")
    titles = by_title(one.where("by_doi is null and title is not null").select("id", "title"), remote.select("record", "title")).withColumnRenamed("record", "by_title")
    return one.join(titles, "id", "left").select(*refs.columns, F.coalesce("by_doi", "by_title").alias("record"))


def outline_parents(items: DataFrame) -> DataFrame:
    """The parent of an outline item: the nearest earlier one of a smaller level.

    A file's levels are walked once, in order, as one array: each item looks back from its place
    for the last smaller level."""
    rows = F.array_sort(F.collect_list(F.struct("ord", "level")))
    stack = items.groupBy("file_id").agg(rows.alias("rows"))
    kind = {c: items.schema[c].dataType.simpleString() for c in ("file_id", "ord", "level")}

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files, orders, levels, parents = [], [], [], []
            for file, found in zip(batch.column("file_id").to_pylist(), batch.column("rows").to_pylist()):
                open_: list[tuple] = []
                for row in found:
                    while open_ and open_[-1][1] >= row["level"]:
                        open_.pop()
                    files.append(file)
                    orders.append(row["ord"])
                    levels.append(row["level"])
                    parents.append(open_[-1][0] if open_ else None)
                    open_.append((row["ord"], row["level"]))
            types = [batch.schema.field("file_id").type, *(batch.schema.field("rows").type.value_type.field(c).type for c in ("ord", "level", "ord"))]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((files, orders, levels, parents), types)], ["file_id", "ord", "level", "parent"])

    return stack.mapInArrow(walk, f"file_id {kind['file_id']}, ord {kind['ord']}, level {kind['level']}, parent {kind['ord']}")


TAG = "<[^>]+>"


def bare(c: Column) -> Column:
    """Markup's text, without white space at its ends."""
    return trimmed(F.regexp_replace(c, TAG, ""))


def first_element(c: Column, name: str) -> Column:
    """The text of the first element of a name, in any case; null if there is none."""
    pattern = rf"(?is)<{name}\b[^>]*>(.*?)</{name}>"
    return F.when(c.rlike(pattern), bare(F.regexp_extract(c, pattern, 1)))


def elements(c: Column, pattern: str) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), 1)


def body_of(c: Column) -> Column:
    pattern = r"(?is)<body[^>]*>(.*?)</body>"
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, 1)).otherwise(c)


def first_bytes(c: Column, most: int) -> Column:
    """The whole characters within the first ``most`` bytes."""
    return F.when(F.octet_length(c) <= most, c).otherwise(F.regexp_replace(F.decode(F.substring(F.encode(c, "UTF-8"), 1, most), "UTF-8"), "\ufffd+$", ""))


def sections(pages: DataFrame, key: str, markup: str) -> DataFrame:
    """Sections of structured markup (TEI): each ``div`` of the body that has a head or a paragraph with
    text. Columns ``key``, sec_ord, title (null without a head), level (by the dots of a leading number,
    6 at most, else 1) and content (paragraphs joined by spaces, 2000 bytes at most)."""
    b = pages.select(key, F.posexplode(elements(body_of(F.col(markup)), r"(?is)<div\b[^>]*>(.*?)</div>")).alias("sec_ord", "block"))
    title = first_element(F.col("block"), "head")
    paragraphs = F.filter(F.transform(elements(F.col("block"), r"(?is)<p\b[^>]*>(.*?)</p>"), bare), lambda x: x != "")
    dots = F.length(F.regexp_replace(F.regexp_extract("title", r"^([0-9][0-9.]*)", 1), "[0-9]", ""))
    out = b.select(key, "sec_ord", title.alias("title"), F.array_join(paragraphs, " ").alias("whole")).where("title is not null or whole <> ''")
    return out.select(key, "sec_ord", "title", F.coalesce(F.least(F.lit(6), dots + 1), F.lit(1)).alias("level"), first_bytes(F.col("whole"), 2000).alias("content"))


def figures(pages: DataFrame, key: str, markup: str) -> DataFrame:
    """Figures of structured markup: ``key``, fig_ord, label (its xml:id, else its label) and caption.

    Figures said to be so; where there are none, all that are not tables and have a caption or a label."""
    body = body_of(F.col(markup))
    known = elements(body, r'(?is)<figure\b[^>]*type\s*=\s*"figure"[^>]*>(.*?)</figure>')
    table = lambda x: x.contains('type="table"') | x.contains("type='table'")
    others = F.filter(elements(body, r"(?is)<figure\b[^>]*>(.*?)</figure>"), lambda x: ~table(x) & (first_element(x, "figDesc").isNotNull() | first_element(x, "label").isNotNull()))
    return described(pages.select(key, F.when(F.size(known) > 0, known).otherwise(others).alias("found")), key, "fig_ord")


def described(found: DataFrame, key: str, order: str) -> DataFrame:
    x = F.col("x")
    label = F.coalesce(F.nullif(F.regexp_extract(x, r'xml:id\s*=\s*"([^"]+)"', 1), F.lit("")), first_element(x, "label"))
    return found.select(key, F.posexplode("found").alias(order, "x")).select(key, order, label.alias("label"), first_element(x, "figDesc").alias("caption"))


def tables(pages: DataFrame, key: str, markup: str) -> DataFrame:
    """Tables of structured markup, as ``figures``; where none is said to be one, each ``table``, labelled T1, T2, ..."""
    body = body_of(F.col(markup))
    known = elements(body, r'(?is)<figure\b[^>]*type\s*=\s*"table"[^>]*>(.*?)</figure>')
    plain = pages.select(key, known.alias("known"), elements(body, r"(?is)<table\b[^>]*>(.*?)</table>").alias("plain"))
    one = described(plain.where(F.size("known") > 0).select(key, F.col("known").alias("found")), key, "tab_ord")
    two = described(plain.where(F.size("known") == 0).select(key, F.col("plain").alias("found")), key, "tab_ord")
    return one.unionByName(two.withColumn("label", F.concat(F.lit("T"), (F.col("tab_ord") + 1).cast("string"))))


def large_ones(segments: DataFrame) -> DataFrame:
    """Segments without those that are no title, as one beside them on their page is too large for that: of the
    rows of a page that lie together, those within a tenth of the largest font size stay. So few are moved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                new = [pc.fill_null(pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)), True).to_numpy(zero_copy_only=False) for c in (batch.column("file_id"), batch.column("page_index"))]
                begins = np.r_[0, np.flatnonzero(new[0] | new[1]) + 1]
                size = batch.column("font_size").to_numpy(zero_copy_only=False).astype(np.float64)
                largest = np.repeat(np.maximum.reduceat(size, begins), np.diff(np.r_[begins, len(size)]))
                yield batch.filter(pa.array(~(size < largest * 0.9)))

    rows = segments.select("file_id", "page_index", "seg_ord", "text", "font_size")
    return rows.mapInArrow(run, rows.schema)


def title_by_font(segments: DataFrame) -> DataFrame:
    """Of each page the segments within a tenth of its largest font size, joined; none if blank."""
    part = F.array_sort(F.collect_list(F.struct("seg_ord", "text", "font_size")))
    g = large_ones(segments).groupBy("file_id", "page_index").agg(F.max("font_size").alias("largest"), part.alias("parts")).where("largest > 0")
    large = F.filter("parts", lambda x: x["font_size"] >= F.col("largest") * 0.9)
    title = F.trim(F.array_join(F.transform(large, lambda x: F.trim(x["text"])), " "))
    return g.select("file_id", "page_index", title.alias("title")).where("title <> ''")


PATCHED = ["journal", "abstract", "doi", "url", "authors", "date"]


def enriched(references: DataFrame, patches: DataFrame) -> DataFrame:
    """References, named by file_id and ref_index, with what a patch of theirs has that is not null.

    A ranking is set only where the patch has its journal and its zone; its flags are false if null.
    At most one patch a reference; patches of no reference change nothing.
    """
    p = patches.select("file_id", "ref_index", *[F.col(c).alias("new_" + c) for c in PATCHED if c in patches.columns], "ranking_journal", "ranking_zone", "ranking_is_top", "ranking_is_oa")
    ranked = F.col("ranking_journal").isNotNull() & F.col("ranking_zone").isNotNull()
    flags = [F.coalesce("ranking_" + c, F.lit(False)).alias(c) for c in ("is_top", "is_oa")]
    ranking = F.when(ranked, F.struct(F.col("ranking_journal").alias("journal"), F.col("ranking_zone").alias("zone"), *flags))
    joined = references.join(p, ["file_id", "ref_index"], "left")
    patched = {c: F.coalesce("new_" + c, c) for c in references.columns if "new_" + c in p.columns}
    return joined.withColumns(patched | {"ranking": F.coalesce(ranking, "ranking") if "ranking" in references.columns else ranking}).select(*references.columns, *([] if "ranking" in references.columns else ["ranking"]))
