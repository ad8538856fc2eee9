"""Records of remote catalogues, as tables of what was fetched, and their reconciliation with own ones."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import SPACE, long_words, strip_markup, trimmed
from .folds import folded
from .records import date_parts, filled_in

#: The parts of a catalogue's message that are read.
MESSAGE = (
    "title array<string>, subtitle array<string>, author array<struct<name string, given string, family string>>, abstract string, `container-title` array<string>, `short-container-title` array<string>, "
    "publisher string, issued struct<`date-parts` array<array<int>>>, volume string, issue string, page string, DOI string, URL string, ISSN array<string>, ISBN array<string>, language string, subject array<string>, type string"
)


def catalogue_record(message: Column) -> Column:
    """A catalogue's message (JSON) as a record."""
    m = F.from_json(message, MESSAGE)
    first = lambda c: F.get(m[c], 0)
    title, sub = strip_markup(filled_in(first("title"))), strip_markup(filled_in(first("subtitle")))
    added = F.concat(title, F.when(title.endswith(":"), " ").otherwise(": "), sub)
    title = F.when(sub.isNull() | F.lower(title).contains(F.lower(sub)), title).otherwise(added)
    given = lambda a: F.coalesce(filled_in(a["name"]), F.when(filled_in(a["given"]).isNotNull(), F.concat(a["given"], F.lit(" "), F.coalesce(a["family"], F.lit("")))), a["family"])
    authors = F.filter(F.transform(m["author"], given), lambda x: x != "")
    journal, short = filled_in(first("container-title")), filled_in(first("short-container-title"))
    subjects = F.filter(F.transform(m["subject"], trimmed), lambda x: x != "")
    return F.struct(
        title.alias("title"), F.when(F.size(m["author"]) > 0, authors).alias("authors"), trimmed(strip_markup(filled_in(m["abstract"]))).alias("abstract"), journal.alias("journal"),
        F.when(journal.isNull() | (short != journal), short).alias("journal_abbrev"), m["publisher"].alias("publisher"), date_parts(F.get(m["issued"]["date-parts"], 0)).alias("date"),
        *[filled_in(m[a]).alias(b) for a, b in (("volume", "volume"), ("issue", "issue"), ("page", "pages"), ("DOI", "doi"), ("URL", "url"))],
        filled_in(first("ISSN")).alias("issn"), filled_in(first("ISBN")).alias("isbn"), m["language"].alias("language"), F.when(F.size(m["subject"]) > 0, subjects).alias("keywords"), filled_in(m["type"]).alias("category"),
    )


def preprint_record(feed: Column) -> Column:
    """The first entry of a feed (Atom) as a record; null without an entry."""
    entry = F.when(feed.rlike(r"(?s)<entry\b"), F.regexp_extract(feed, r"(?s)<entry\b[^>]*>(.*?)</entry>", 1))
    plain = lambda c: F.nullif(trimmed(F.regexp_replace(F.regexp_replace(c, "<[^>]*>", ""), SPACE + "+", " ")), F.lit(""))
    part = lambda name: plain(F.regexp_extract(entry, rf"(?s)<{name}\b[^>]*>(.*?)</{name}>", 1))
    names = F.filter(F.transform(F.regexp_extract_all(entry, F.lit(r"(?s)<author\b[^>]*>.*?<name>(.*?)</name>"), 1), trimmed), lambda x: x != "")
    year = F.substring(part("published"), 1, 4)
    links = F.filter(F.regexp_extract_all(entry, F.lit(r'<link\b[^>]*?href="([^"]*)"'), 1), lambda x: x.contains("doi.org/"))
    doi = filled_in(F.element_at(F.split(F.try_element_at(links, F.lit(-1)), "doi\\.org/"), -1))
    fields = F.struct(part("title").alias("title"), part("summary").alias("abstract"), F.when(F.size(names) > 0, names).alias("authors"), F.when(year.rlike(r"^\d{4}$"), year).alias("date"), part("id").alias("url"), doi.alias("doi"), F.lit("en").alias("language"))
    return F.when(entry.isNotNull(), fields)


def by_title(titles: DataFrame, catalogue: DataFrame, least: float = 0.7) -> DataFrame:
    """Of each title (id, title) of 5 characters or more the catalogue's record (record, title) that shares
    most words, ``least`` of the larger set or more; ties to the lesser record.

    What decides is a title's set of words, so each set is looked for once, and of the records with one set
    only the least can be the answer. With words in order of rarity in the catalogue, such pairs share one of
    the first ``n - ceil(least n) + 1`` of each, and meet at the first of them that they share."""
    named = lambda c: F.array_join(F.array_sort(long_words(c)), " ")
    a = titles.where(F.length(trimmed(F.col("title"))) >= 5).select("id", named(trimmed(F.col("title"))).alias("t")).where("t <> ''")
    b = catalogue.select("record", named(F.col("title")).alias("u")).where("u <> ''").groupBy("u").agg(F.min("record").alias("record"))
    often = b.select(F.explode(F.split("u", " ")).alias("w")).groupBy("w").agg(F.count("*").alias("often"))

    def first(rows: DataFrame, column: str, *more: str) -> DataFrame:
        """A row for each of the rarest words of a set, with its set as an array and all of those words."""
        words = rows.select(column, *more, F.explode(F.split(column, " ")).alias("w")).join(often, "w", "left").groupBy(column, *more)
        words = words.agg(F.array_sort(F.collect_list(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "w"))).alias("o"))
        n = F.size("o")
        words = words.select(column, *more, F.slice(F.transform("o", lambda x: x["w"]), F.lit(1), (n - F.ceil(F.round(n * least, 6)) + 1).cast("int")).alias("first_" + column))
        return words.select("*", F.split(column, " ").alias("words_" + column), F.explode("first_" + column).alias("w"))

    met = first(a.select("t").distinct(), "t").join(first(b, "u", "record"), "w")
    n, m = F.size("words_t"), F.size("words_u")
    met = met.where((F.least(n, m) >= F.round(F.greatest(n, m) * least, 6)) & (F.get(F.array_intersect("first_t", "first_u"), 0) == F.col("w")))
    overlap = F.size(F.array_intersect("words_t", "words_u")) / F.greatest(n, m)
    best = met.select("t", "record", overlap.alias("overlap")).where(F.col("overlap") >= least).groupBy("t").agg(F.max_by("record", F.struct("overlap", -F.col("record"))).alias("record"))
    return a.join(best, "t").select("id", "record")


SEARCH_KEY, SHORTEST = 80, 5


def searched_once(requests: DataFrame, catalogue: DataFrame, least: float = 0.7) -> DataFrame:
    """Title searches (id, ord, title) with the catalogue's record: id, key, record.

    A search is remembered under the first 80 characters of its title in lower case: the first request of a
    key is the one that is sent, and its answer, a vain one too, is that of all later ones. Titles under five
    characters are not searched, and have no key."""
    title = trimmed(F.col("title"))
    asked = requests.withColumn("key", F.when(F.length(title) >= SHORTEST, F.substring(F.lower(title), 1, SEARCH_KEY)))
    firsts = asked.where("key is not null").groupBy("key").agg(F.min_by("title", "ord").alias("title"))
    found = by_title(firsts.select(F.col("key").alias("id"), "title"), catalogue, least).withColumnRenamed("id", "key")
    return asked.join(found, "key", "left").select("id", "key", "record")


def chosen(papers: DataFrame, by_doi: DataFrame, preprints: DataFrame, searched: DataFrame) -> DataFrame:
    """Of each paper (id, doi, arxiv, title) the remote title and source: by its DOI (doi, title), else its
    preprint's (arxiv, title, doi), which the record of that one's DOI replaces, else found by title (id, title)."""
    key = F.lower(F.trim(F.col("doi")))
    dois = by_doi.select(F.lower(F.trim(F.col("doi"))).alias("k"), F.col("title").alias("by_doi")).dropDuplicates(["k"])
    one = papers.join(dois, key == F.col("k"), "left").drop("k")
    two = one.join(preprints.select("arxiv", F.col("title").alias("by_preprint"), F.lower(F.trim(F.col("doi"))).alias("p_doi")).dropDuplicates(["arxiv"]), "arxiv", "left")
    better = dois.select(F.col("k").alias("p_doi"), F.col("by_doi").alias("upgraded"))
    three = two.join(better, "p_doi", "left").join(searched.select("id", F.col("title").alias("by_title")), "id", "left")
    preprint = F.coalesce("upgraded", "by_preprint")
    found = F.when(F.length("title") > 10, F.col("by_title"))
    source = F.when(F.col("by_doi").isNotNull(), "doi").when(preprint.isNotNull(), "preprint").when(found.isNotNull(), "title")
    return three.select("id", F.coalesce("by_doi", preprint, found).alias("remote_title"), source.alias("remote_source"))


def parsed_fill(own: dict[str, Column], parsed: dict[str, Column]) -> dict[str, Column]:
    """Own scalar fields, with what the parser has where they are missing or empty."""
    return {k: F.coalesce(filled_in(c), filled_in(parsed[k]), c) for k, c in own.items()}


def full_name(author: Column) -> Column:
    """An author's full name, else the parts that there are."""
    parts = F.filter(F.array(*[author[c] for c in ("first_name", "middle_name", "last_name")]), lambda x: x != "")
    return F.coalesce(filled_in(author["full_name"]), F.array_join(parts, " "))


class Folder:
    """The names of one family in a folder, as files of it are renamed in order."""

    def __init__(self) -> None:
        self.taken: set[str] = set()
        self.least: dict[str, int] = {}  # of each wanted name the first number that may be free

    def free(self, name: str) -> None:
        self.taken.discard(name)
        numbered = re.fullmatch(r"(.*)_(\d+)(\.[^.]*)?", name, re.S)
        if numbered:
            wanted = numbered[1] + (numbered[3] or "")
            self.least[wanted] = max(1, min(self.least.get(wanted, 1), int(numbered[2])))

    def rename(self, old: str, bare: str, ext: str) -> str:
        wanted = f"{bare}.{ext}" if ext else bare
        if wanted == old:
            return old
        new = wanted
        if wanted in self.taken:
            k = self.least.get(wanted, 1)
            numbered = lambda: f"{bare}_{k:02d}.{ext}" if ext else f"{bare}_{k}"
            while numbered() in self.taken:
                k += 1
            new = numbered()
            self.least[wanted] = k + 1
        self.taken.add(new)
        return new


def renamed(files: DataFrame) -> DataFrame:
    """New names for files (folder, ext, ord, name) from their titles, one after another in the order of
    ``ord``: illegal characters become _, a blank title keeps the old name. A name that a file of the folder
    has by then gets _01, _02, ... before its extension, _1, _2, ... without one; the old name is free again.

    Only names of one family, alike but for such numbers, can meet; a family is walked in order, and what is
    held of it are its names."""
    bare = trimmed(F.translate(F.coalesce("title", F.lit("")), '<>:"/\\|?*', "_" * 9))
    ext = F.coalesce("ext", F.lit(""))
    ending = F.when(ext == "", "").otherwise(F.concat(F.lit("."), ext))
    family = lambda c: F.regexp_replace(F.regexp_replace(c, r"\.[^.]*$", ""), r"(_\d+)+$", "")
    f = files.select("folder", "ord", "name", bare.alias("bare"), ext.alias("ext"), family(F.col("name")).alias("old_family"), F.when(bare != "", family(F.concat(bare, ending))).alias("family"))
    columns = lambda phase: [F.lit(phase).alias("phase"), "ord", "name", "bare", "ext"]
    there = f.select("folder", F.col("old_family").alias("family"), *columns(0))
    # a file that leaves its family frees its name there; one that stays does so when it is renamed
    leaves = f.where("family <> old_family").select("folder", F.col("old_family").alias("family"), *columns(1))
    takes = f.where("family is not null").select("folder", "family", *columns(2))
    # phases 1 and 2 are events in the order of ord
    events = there.unionByName(leaves).unionByName(takes).withColumn("at", F.when(F.col("phase") > 0, F.col("ord")))

    def step(folder: Folder, row: dict) -> list[tuple]:
        if row["phase"] == 0:
            folder.taken.add(row["name"])
            return []
        if row["phase"] == 1:
            folder.free(row["name"])
            return []
        new = folder.rename(row["name"], row["bare"], row["ext"])
        if new != row["name"] and row["name"] in folder.taken:
            folder.free(row["name"])
        return [(row["folder"], row["ord"], new)]

    kinds = {c: files.schema[c].dataType.simpleString() for c in ("folder", "ord")}
    new = folded(events, ["folder", "family"], ["at", "phase"], Folder, step, f"folder {kinds['folder']}, ord {kinds['ord']}, new_name string")
    joined = files.join(new, ["folder", "ord"], "left").withColumn("new_name", F.coalesce("new_name", "name"))
    return joined.select(*files.columns, "new_name")


def citation_file(citation: Column, title: Column, output: str) -> Column:
    """A citation's file: its name from the paper's title, and what it holds."""
    ending = {"html": "html", "rtf": "rtf"}.get(output, "txt")
    name = F.concat(F.substring(F.regexp_replace(title, r'[/\\?%*:|"<>]', "_"), 1, 50), F.lit(f"_citation.{ending}"))
    page = F.concat(F.lit('<!DOCTYPE html>\n<html><head><meta charset="UTF-8"><title>Citation</title></head>\n<body><p>'), citation, F.lit("</p></body></html>"))
    return F.struct(name.alias("file"), (page if output == "html" else citation).alias("content"))


def word_parts(c: Column) -> Column:
    """A text without line breaks, cut before each Chinese character."""
    return F.split(F.regexp_replace(c, r"[\r\n]+", ""), "(?=[一-龥])")


def sentences(c: Column) -> Column:
    """Sentences with their punctuation, in order: a text without line breaks, cut after closing punctuation before a capital or digit."""
    return F.filter(F.split(F.regexp_replace(c, r"[\r\n]+", ""), r"(?<=[.!?。！？][\"'”’)\]]{0,1})\s+(?=[\"'“‘(\[]?[\p{Lu}\p{N}])"), lambda x: x != "")


def settled(changes: DataFrame, keys: list[str], time: str, wait: str = "interval 800 milliseconds") -> DataFrame:
    """Debounced saves: of each key the changes that no other follows within ``wait``."""
    from pyspark.sql import Window

    after = F.lead(time).over(Window.partitionBy(*keys).orderBy(time))
    return changes.withColumn("__after", after).where(F.col("__after").isNull() | (F.col("__after") - F.col(time) > F.expr(wait))).drop("__after")


def clean_full_text(segments: DataFrame) -> DataFrame:
    """A document's text from segments without garbage: a line each, pages apart by a blank line."""
    page = F.array_sort(F.collect_list(F.struct("seg_ord", trimmed(F.col("text")).alias("t"))))
    pages = segments.where(trimmed(F.col("text")) != "").groupBy("file_id", "page_index").agg(F.array_join(F.transform(page, lambda x: x["t"]), "\n").alias("t"))
    whole = F.array_sort(F.collect_list(F.struct("page_index", "t")))
    return pages.groupBy("file_id").agg(F.array_join(F.transform(whole, lambda x: x["t"]), "\n\n").alias("text"))
