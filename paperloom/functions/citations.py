"""Citations in 22 styles, assembled from a table of styles.

A template is text with ``{field}`` and optional parts ``[...]``; an optional part stands only
if its field is not empty. ``*...*`` marks italics until the output format is chosen.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPACE, to_html, to_plain, to_rtf


@dataclass(frozen=True)
class Style:
    form: str
    sep: str
    last: str
    most: int
    join: str
    #: Parts before the journal; one that is all optional and empty is left out.
    head: tuple[str, ...]
    journal: str
    publisher: str = ""
    doi: str = ""
    url: str = ""
    upper: bool = False


# The styles' punctuation.
QUOTED, PLAIN = '"{title}."', "{title}."
APA = "*{journal}*[, *{volume}*][({issue})][, {pages}]"
MEDICAL = "{journal}[. {year}][;{volume}][({issue})][:{pages}]"
STYLES = {
    "gbt-7714-2015": Style("gbt", ", ", ", ", 3, ". ", ("{title}{kind}",), "{journal}[, {year}][, {volume}][({issue})][: {pages}]", "{publisher}[, {year}][: {pages}]", "DOI: {doi}"),
    "apa-7th": Style("initials", ", ", ", & ", 20, ". ", ("[({year})]", "{title}"), APA, "{publisher}", "https://doi.org/{doi}", "{url}"),
    "apa-6th": Style("initials", ", ", ", & ", 7, ". ", ("[({year})]", "{title}"), APA, "{publisher}", "doi:{doi}", "Retrieved from {url}"),
    "mla-9th": Style("full", ", ", ", and ", 2, ". ", (QUOTED,), "*{journal}*[, vol. {volume}][, no. {issue}][, {year}][, pp. {pages}]", "{publisher}[, {year}]", "doi:{doi}", "{url}"),
    "chicago-17th-author-date": Style("full", ", ", ", and ", 10, ". ", ("[{year}]", QUOTED), "*{journal}*[ {volume}][, no. {issue}][: {pages}]", "{publisher}", "https://doi.org/{doi}"),
    "chicago-17th-notes": Style("first", ", ", ", and ", 10, ". ", (QUOTED,), "*{journal}*[ {volume}][, no. {issue}][ ({year})][: {pages}]", "{publisher}[, {year}]", "https://doi.org/{doi}"),
    "harvard": Style("initials", ", ", " and ", 3, ". ", ("[({year})]", "'{title}'"), "*{journal}*[, {volume}][({issue})][, pp. {pages}]", "{publisher}[, {year}]", "doi: {doi}"),
    "ieee": Style("first", ", ", ", and ", 6, ", ", (QUOTED,), "*{journal}*[, vol. {volume}][, no. {issue}][, pp. {pages}][, {year}]", "{publisher}[, {year}]", "doi: {doi}"),
    "vancouver": Style("short", ", ", ", ", 6, " ", (PLAIN,), MEDICAL, "{publisher}[; {year}]", "doi: {doi}"),
    "ama-11th": Style("short", ", ", ", ", 6, " ", (PLAIN,), "*{journal}*.[ {year}][;{volume}][({issue})][:{pages}]", "{publisher}[; {year}]", "doi:{doi}"),
    "nlm": Style("short", ", ", ", ", 6, " ", (PLAIN,), MEDICAL, "", "doi: {doi}"),
    "acs": Style("initials", "; ", "; ", 10, " ", (PLAIN,), "*{journal}*[ *{year}*][, *{volume}*][ ({issue})][, {pages}]", "", "DOI: {doi}"),
    "aip": Style("first", ", ", ", and ", 3, ", ", (QUOTED,), "{journal}[ *{volume}*][, {issue}][, {pages}][ ({year})]", "", "https://doi.org/{doi}"),
    "aps": Style("first", ", ", ", and ", 10, ", ", (PLAIN,), "{journal}[ *{volume}*][, {issue}][, {pages}][ ({year})]", "", "https://doi.org/{doi}"),
    "nature": Style("initials", ", ", " & ", 5, " ", (PLAIN,), "*{journal}*[ *{volume}*][, {pages}][ ({year})]", "", "https://doi.org/{doi}"),
    "science": Style("first", ", ", ", ", 5, " ", (PLAIN,), "*{journal}*[ *{volume}*][, {pages}][ ({year})]", "", "doi: {doi}"),
    "cell": Style("first", ", ", ", and ", 10, " ", ("({year}). {title}.",), "*{journal}*[ *{volume}*][, {issue}][, {pages}]", "", "https://doi.org/{doi}"),
    "pnas": Style("first", ", ", ", ", 5, " ", ("({year}) {title}.",), "*{journal}*[ {volume}][ ({issue})][:{pages}]", "", "https://doi.org/{doi}"),
    "iso-690": Style("full", ", ", ", ", 3, ". ", (PLAIN,), "{journal}[, {year}][, vol. {volume}][, no. {issue}][, p. {pages}]", "{publisher}[, {year}]", "DOI: {doi}", "Available from: {url}", True),
    "din-1505-2": Style("full", " ; ", " ; ", 3, ". ", (PLAIN,), "{journal}[, Bd. {volume}][ ({year})][, Nr. {issue}][, S. {pages}]", "{publisher}[, {year}]", "DOI: {doi}"),
}
SAME = {"mla-8th": "mla-9th", "turabian-9th": "chicago-17th-notes"}
FIELDS = ("title", "journal", "publisher", "volume", "issue", "pages", "doi", "url", "isbn", "date")


def person(name: Column, form: str) -> Column:
    """One author: gbt LAST F M, initials "Last, F. M.", full "Last, First", first "F. Last", short "Last FM"."""
    parts = F.split(F.trim(name), SPACE + "+")
    last = F.element_at(parts, -1)
    given = F.slice(parts, F.lit(1), F.size(parts) - 1)
    capital = lambda dot, sep: F.array_join(F.transform(given, lambda g: F.concat(F.upper(F.substring(g, 1, 1)), F.lit(dot))), sep)
    whole = {
        "gbt": F.concat(F.upper(last), F.lit(" "), capital("", " ")), "initials": F.concat(last, F.lit(", "), capital(".", " ")), "full": F.concat(last, F.lit(", "), F.array_join(given, " ")),
        "first": F.concat(capital(".", " "), F.lit(" "), last), "short": F.concat(last, F.lit(" "), capital("", "")),
    }[form]
    out = F.when(F.size(parts) == 1, F.upper(last) if form == "gbt" else last).otherwise(whole)
    return F.when(name.rlike("[一-鿿]"), name).otherwise(out) if form == "gbt" else out


def people(authors: Column, style: Style) -> Column:
    some = F.transform(F.coalesce(authors, F.array().cast("array<string>")), lambda a: person(a, style.form))
    n = F.size(some)
    listed = F.when(n > style.most, F.concat(F.array_join(F.slice(some, 1, style.most), style.sep), F.lit(", et al."))).when(n <= 1, F.array_join(some, "")).otherwise(
        F.concat(F.array_join(F.slice(some, F.lit(1), F.greatest(n - 1, F.lit(1))), style.sep), F.lit(style.last), F.element_at(some, -1))
    )
    return F.upper(listed) if style.upper else listed


def filled(template: str, fields: dict[str, Column]) -> Column:
    """The template's text; null where it is a single optional part whose field is empty."""
    parts = []
    for optional, text in re.findall(r"\[([^\]]*)\]|([^\[]+)", template):
        pieces = re.split(r"\{(\w+)\}", optional or text)
        column = F.concat(*[fields[x] if i % 2 else F.lit(x) for i, x in enumerate(pieces)])
        parts.append(F.when(fields[pieces[1]] != "", column).otherwise("") if optional else column)
    whole = F.concat(*parts)
    return F.nullif(whole, F.lit("")) if template.startswith("[") else whole


def parsed(fields: dict[str, Column]) -> dict[str, Column]:
    """Empty text for what is missing; year, month and day; one space in titles; plain page dashes."""
    out = {k: F.coalesce(fields.get(k, F.lit("")), F.lit("")) for k in FIELDS}
    date = out["date"]
    full = r"^(\d{4})[-/](\d{1,2})(?:[-/](\d{1,2}))?"
    out["year"] = F.when(date.rlike(full), F.regexp_extract(date, full, 1)).otherwise(F.regexp_extract(date, r"(\d{4})", 1))
    out["month"], out["day"] = F.regexp_extract(date, full, 2), F.regexp_extract(date, full, 3)
    out["title"] = F.trim(F.regexp_replace(out["title"], SPACE + "+", " "))
    for dash in "–—":  # the first of each only
        out["pages"] = F.regexp_replace(out["pages"], f"^([^{dash}]*){dash}", "$1-")
    out["kind"] = F.when(out["journal"] != "", "[J]").when(out["isbn"] != "", "[M]").otherwise("[Z]")
    return out


def cite(authors: Column, fields: dict[str, Column], style: str, output: str = "text") -> Column:
    """The citation in a style; ``output`` is text, html or rtf. An unknown style gives a note in brackets."""
    if SAME.get(style, style) not in STYLES:
        return F.lit(f"[Unknown style: {style}]")
    s, f = STYLES[SAME.get(style, style)], parsed(fields)
    source = F.when(f["journal"] != "", filled(s.journal, f))
    if s.publisher:
        source = source.when(f["publisher"] != "", filled(s.publisher, f))
    link = F.when(f["doi"] != "", filled(s.doi, f))
    if s.url:
        link = link.when(f["url"] != "", filled(s.url, f))
    parts = [F.nullif(people(authors, s), F.lit("")), *[filled(h, f) for h in s.head], source, link]
    whole = F.concat(F.concat_ws(s.join, *parts), F.lit("."))
    return {"text": to_plain, "html": to_html, "rtf": to_rtf}[output](whole)
