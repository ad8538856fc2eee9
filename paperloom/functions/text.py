"""Scalar text functions: Column in, Column out, evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as the scripts of web views and native code see it.
SPACE = r"\p{IsWhite_Space}"

# Journal words and their abbreviations, both ways, and stop words.
ABBREVIATIONS = {
    "j": "journal", "jour": "journal", "int": "international", "intl": "international", "sci": "science", "eng": "engineering",
    "tech": "technology", "res": "research", "lett": "letters", "proc": "proceedings", "proceed": "proceedings", "trans": "transactions",
    "rev": "review", "adv": "advanced", "advan": "advanced", "appl": "applied", "comput": "computer", "inf": "information",
    "syst": "systems", "mater": "materials", "chem": "chemistry", "phys": "physics", "biol": "biology", "med": "medicine",
    "elec": "electrical", "electron": "electronics", "mech": "mechanical", "civ": "civil", "environ": "environmental", "env": "environmental",
    "nat": "natural", "bull": "bulletin", "mag": "magazine", "rept": "report", "rep": "report", "ann": "annals",
    "arch": "archives", "comm": "communications", "commun": "communications", "conf": "conference", "dev": "development", "develop": "development",
    "educ": "education", "exp": "experimental", "ind": "industrial", "industr": "industrial", "inst": "institute", "math": "mathematics",
    "micro": "microscopy", "mol": "molecular", "nano": "nanotechnology", "neurol": "neurology", "num": "numerical", "pharm": "pharmaceutical",
    "polym": "polymers", "pract": "practice", "prog": "progress", "quant": "quantum", "soc": "society", "stat": "statistics",
    "struct": "structural", "surv": "survey", "theor": "theoretical",
}
CONTRACTIONS = {
    "journal": "j", "international": "int", "science": "sci", "engineering": "eng", "technology": "tech", "research": "res",
    "letters": "lett", "proceedings": "proc", "transactions": "trans", "review": "rev", "advanced": "adv", "applied": "appl",
    "computer": "comput", "information": "inf", "systems": "syst", "materials": "mater", "chemistry": "chem", "physics": "phys",
    "biology": "biol", "medicine": "med", "electrical": "elec", "electronics": "electron", "mechanical": "mech", "civil": "civ",
    "environmental": "environ", "natural": "nat", "bulletin": "bull", "magazine": "mag", "annals": "ann", "archives": "arch",
    "communications": "commun", "conference": "conf", "development": "dev", "education": "educ", "experimental": "exp", "industrial": "ind",
    "institute": "inst", "mathematics": "math", "molecular": "mol", "pharmaceutical": "pharm", "polymers": "polym", "progress": "prog",
    "society": "soc", "statistics": "stat", "theoretical": "theor",
}
STOP_WORDS = ["the", "of", "and", "in", "on", "at", "for", "to", "a", "an", "is", "by", "with", "from", "its"]


def normalize_journal(c: Column) -> Column:
    """Lower case; anything but letters, digits and white space becomes a space; single spaces."""
    bare = F.regexp_replace(F.lower(c), r"[^\p{IsAlphabetic}\p{N}" + SPACE + "]", " ")
    return F.trim(F.regexp_replace(bare, SPACE + "+", " "))


def replace_words(c: Column, words: dict[str, str]) -> Column:
    """Replaces whole words of a normal form by a dictionary."""
    table = F.create_map(*[F.lit(x) for kv in words.items() for x in kv])
    return F.array_join(F.transform(F.split(c, " "), lambda w: F.coalesce(F.try_element_at(table, w), w)), " ")


def expand_journal(c: Column) -> Column:
    return replace_words(c, ABBREVIATIONS)


def contract_journal(c: Column) -> Column:
    return replace_words(c, CONTRACTIONS)


def significant_tokens(c: Column) -> Column:
    """Distinct words of more than 2 bytes that are no stop words."""
    return F.array_distinct(F.filter(F.split(c, " "), lambda w: ~w.isin(STOP_WORDS) & (F.octet_length(w) > 2)))


def word_overlap(a: Column, b: Column) -> Column:
    """Shared words over the larger set, of distinct words longer than 2 characters; 0 if none."""
    return overlap_of(long_words(a), long_words(b))


def long_words(c: Column) -> Column:
    """Distinct words longer than 2 characters, in lower case."""
    return F.array_distinct(F.filter(F.split(F.lower(c), SPACE + "+"), lambda w: F.length(w) > 2))


def overlap_of(x: Column, y: Column) -> Column:
    """Shared items over the larger of two sets; 0 if both are empty."""
    most = F.greatest(F.size(x), F.size(y))
    return F.when(most == 0, 0.0).otherwise(F.size(F.array_intersect(x, y)) / most)


def compare_form(c: Column) -> Column:
    """Lower case, ASCII words and white space only."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^A-Za-z0-9_\p{IsWhite_Space}]", ""), SPACE + "+", " "))


def title_similarity(a: Column, b: Column) -> Column:
    """1 for equal non-empty normal forms, 0 if one is empty, else the word overlap."""
    x, y = compare_form(a), compare_form(b)
    return F.when((x == "") | (y == "") | x.isNull() | y.isNull(), 0.0).when(x == y, 1.0).otherwise(word_overlap(x, y))


def vote_title(layout: Column, font: Column, xmp: Column) -> Column:
    """The first of two agreeing titles (similarity above 0.7), else the first there is."""
    agree = lambda a, b: title_similarity(a, b) > 0.7
    return F.when(agree(layout, font), layout).when(agree(layout, xmp), layout).when(agree(font, xmp), font).otherwise(F.coalesce(layout, font, xmp))


def clean(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def find_doi(c: Column) -> Column:
    """The first DOI, without closing full stops and brackets; null if none."""
    return F.nullif(F.regexp_replace(F.regexp_extract(c, r"(10\.\d{4,9}/[^\s\"<>]+)", 1), r"[.,;)\]]+$", ""), F.lit(""))


def find_arxiv(c: Column) -> Column:
    """An arXiv id: new form, old form, in an address, in a DOI; null if none."""
    forms = [r"(?i)arxiv:\s*(\d{4}\.\d{4,5})", r"(?i)arxiv:\s*([a-z-]+/\d{7})", r"(?i)arxiv\.org/(?:abs|pdf)/(\d{4}\.\d{4,5})", r"(?i)10\.48550/arxiv\.(\d{4}\.\d{4,5})"]
    return F.coalesce(*[F.nullif(F.regexp_extract(c, p, 1), F.lit("")) for p in forms])


def strip_markup(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, "<[^>]*>", ""), "[{}]", "")


def clean_abstract(c: Column) -> Column:
    """Without a leading label of the abstract and what separates it."""
    return trimmed(F.regexp_replace(c, r"^(?:Abstract|ABSTRACT|abstract|摘要)[.:：\-—" + SPACE + "]*", ""))


def trimmed(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def split_authors(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, r"(?i)[,;]|\band\b"), lambda x: F.trim(x)), lambda x: x != "")


def split_keywords(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, "[,;]"), lambda x: F.trim(x)), lambda x: x != "")


def keyword_union(a: Column, b: Column) -> Column:
    """All of ``a``, then those of ``b`` that ``a`` lacks, whatever their case."""
    low = F.transform(a, lambda x: F.lower(x))
    return F.concat(a, F.filter(b, lambda x: ~F.array_contains(low, F.lower(x))))


# Characters of a section's preview, and of a text in a prompt.
PREVIEW, PROMPT = 600, 30_000


def preview(c: Column, most: int = PREVIEW) -> Column:
    """The first characters of a longer text, with an ellipsis."""
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("…"))).otherwise(c)


def prompt_text(c: Column, most: int = PROMPT) -> Column:
    return F.substring(c, 1, most)


def file_name(c: Column, limit: int = 60) -> Column:
    return F.substring(F.trim(F.regexp_replace(c, r'[\\/:*?"<>|]', "_")), 1, limit)


def base_name(c: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(c, r"\\", "/"), "/"), -1)


def file_size_text(c: Column) -> Column:
    kb = c / 1024
    return F.when(c.isNull() | (c == 0), "-").when(c < 1024, F.concat(c.cast("string"), F.lit(" B"))).when(c < 1048576, F.concat(F.format_string("%.1f", kb), F.lit(" KB"))).otherwise(F.concat(F.format_string("%.1f", kb / 1024), F.lit(" MB")))


def duration_text(c: Column, hour: str = "小时", minute: str = "分钟") -> Column:
    """Hours and minutes; a part that is 0 is left out, but for 0 minutes in all."""
    h, m = F.floor(c / 3600), F.floor(F.pmod(c, F.lit(3600)) / 60)
    hours, minutes = F.concat(h.cast("string"), F.lit(hour)), F.concat(m.cast("string"), F.lit(minute))
    return F.when(c <= 0, F.lit("0" + minute)).when((h > 0) & (m > 0), F.concat(hours, minutes)).when(h > 0, hours).otherwise(minutes)


def short_duration_text(c: Column) -> Column:
    return duration_text(c, "h", "m")


def author_list_text(c: Column, most: int = 3, total: bool = False) -> Column:
    """The first ``most`` names, and a note that there are more, with their total if asked."""
    rest = F.concat(F.lit(" 等 ("), F.size(c).cast("string"), F.lit("人)")) if total else F.lit(" 等")
    return F.when(F.size(c) > most, F.concat(F.array_join(F.slice(c, 1, most), ", "), rest)).otherwise(F.array_join(c, ", "))


# The document categories, and the words that tell them, in order.
CATEGORY_WORDS = [
    ("期刊文章", ["journal"]), ("会议论文", ["proceedings", "conference"]), ("书籍/章节", ["book"]), ("报告", ["report"]), ("学位论文", ["thesis", "dissertation"]), ("预印本", ["preprint", "posted-content"]),
]
OTHER_CATEGORY = "文献"
ZONES = {1: "一区", 2: "二区", 3: "三区", 4: "四区"}


def category(journal: Column, isbn: Column, url: Column, given: Column) -> Column:
    """Document category: by the words of the given text if there is one, else by journal, ISBN or preprint address."""
    low = F.lower(given)
    by_text = F.when(F.lit(False), "")
    for name, words in CATEGORY_WORDS:
        hit = low.contains(words[0])
        for w in words[1:]:
            hit = hit | low.contains(w)
        by_text = by_text.when(hit, name)
    there = lambda c: F.coalesce(c != "", F.lit(False))
    by_field = F.when(there(journal), "期刊文章").when(there(isbn), "书籍/章节").when(F.coalesce(url.contains("arxiv"), F.lit(False)), "预印本").otherwise(OTHER_CATEGORY)
    return F.when(there(given), by_text.otherwise(OTHER_CATEGORY)).otherwise(by_field)


def zone_label(c: Column) -> Column:
    names = F.create_map(*[F.lit(x) for kv in ZONES.items() for x in kv])
    return F.coalesce(F.try_element_at(names, c.cast("int")), F.concat(c.cast("string"), F.lit("区")))


def snippet(text: Column, needle: str, reach: int = 40, case: bool = False) -> Column:
    """The first hit of ``needle`` (any case, unless ``case``) with ``reach`` characters either side; null if none."""
    at = F.locate(needle, text) if case else F.locate(needle.lower(), F.lower(text))
    begin = F.greatest(at - reach, F.lit(1))
    return F.when(at > 0, F.substring(text, begin, at - begin + len(needle) + reach))


def semver_satisfied(current: Column, required: Column) -> Column:
    parts = lambda c: [F.coalesce(F.get(F.split(c, r"\."), i).try_cast("int"), F.lit(0)) for i in range(3)]
    a, b = parts(current), parts(required)
    return (a[0] > b[0]) | ((a[0] == b[0]) & ((a[1] > b[1]) | ((a[1] == b[1]) & (a[2] >= b[2]))))


def hex_colour(c: Column) -> Column:
    digits = F.regexp_replace(c, "^#", "")
    part = lambda i: F.coalesce(F.when(F.substring(digits, i, 2).rlike("^[0-9A-Fa-f]{2}$"), F.conv(F.substring(digits, i, 2), 16, 10).cast("int")), F.lit(0))
    return F.struct(part(1).alias("r"), part(3).alias("g"), part(5).alias("b"))


def to_html(c: Column) -> Column:
    out = c
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.regexp_replace(out, r"\*([^*]+)\*", "<i>$1</i>")


# Fixed value: the beginning of an RTF citation.
RTF_BEGIN = r"{\rtf1\ansi\deff0 {\fonttbl {\f0 Times New Roman;}}\f0\fs24 "


def to_rtf(c: Column) -> Column:
    out = c
    for a, b in (("\\", "\\\\"), ("{", "\\{"), ("}", "\\}")):
        out = F.replace(out, F.lit(a), F.lit(b))
    italic = F.regexp_replace(out, r"\*([^*]+)\*", r"{\\i $1}")
    return F.concat(F.lit(RTF_BEGIN), italic, F.lit("}"))


def to_plain(c: Column) -> Column:
    return F.regexp_replace(c, r"\*([^*]+)\*", "$1")


def math_parts(text: Column) -> Column:
    """A text as parts (kind, content): ``md``, ``math_d`` between $$ and ``math_i`` between $.

    Inline formulas are looked for after the last display formula only. Empty md parts go.
    """
    part = lambda kind, content: F.struct(kind.alias("kind"), content.alias("content"))
    pieces = F.split(text, r"\$\$", -1)
    pairs = F.floor((F.size(pieces) - 1) / 2).cast("int") * 2
    shown = F.transform(F.slice(pieces, 1, pairs), lambda x, i: part(F.when(i % 2 == 1, F.lit("math_d")).otherwise(F.lit("md")), x))
    rest = F.array_join(F.slice(pieces, pairs + 1, F.size(pieces)), "$$")
    inline = r"\$(?!\$)([\s\S]*?[^\\])\$"
    gaps, found = F.split(rest, inline, -1), F.regexp_extract_all(rest, F.lit(inline), 1)
    after = F.flatten(F.transform(gaps, lambda x, i: F.array(part(F.lit("md"), x), part(F.lit("math_i"), F.get(found, i)))))
    return F.filter(F.concat(shown, after), lambda x: x["content"].isNotNull() & ((x["kind"] != "md") | (x["content"] != "")))
