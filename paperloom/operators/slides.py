"""Slides from an outline in Markdown."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What tells a slide's type in its title, in order.
TYPES = [
    ("overview", ["概述", "总览", "摘要"]),
    ("methods", ["方法", "实验", "制备", "流程"]),
    ("characterization", ["表征", "SEM", "TEM", "XRD", "FTIR", "Raman", "XPS", "AFM", "EDS", "形貌"]),
    ("electrochemical", ["电化学", "CV", "EIS", "充放电", "倍率", "循环", "阻抗"]),
    ("conclusion", ["结论", "总结", "展望"]),
]
TAG = r"\[图:(\d+)\]"
TAGS = re.compile(r"\s*\[图:\d+\]")


def slide_type(title: Column, place: Column) -> Column:
    out = F.when((place == 1) | title.contains("标题"), "title")
    for name, words in TYPES:
        hit = F.lit(False)
        for w in words:
            hit = hit | title.contains(w)
        out = out.when(hit, name)
    return out.otherwise("other")


def without_tag(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s*\[图:\d+\]", ""))


def headings(outlines: DataFrame) -> DataFrame:
    """One row a slide: its place from 1, title, the pages that its title and bullets ask an image of, and the bullets."""
    # a heading and the lines up to the next
    parts = F.regexp_extract_all("markdown", F.lit(r"(?:^|\n)(##[^\S\n]+[^\n]+(?:\n(?!##[^\S\n]+[^\n])[^\n]*)*)"), 1)
    s = outlines.select("file_id", F.posexplode(parts).alias("n", "part"))
    rows = F.split("part", "\n")
    raw = F.trim(F.regexp_extract(F.get(rows, 0), r"^##\s+(.+)", 1))
    bullets = F.filter(F.transform(F.slice(rows, F.lit(2), F.size(rows)), lambda x: F.trim(F.regexp_extract(x, r"^\s*[-*]\s+(.+)", 1))), lambda x: x != "")
    s = s.select("file_id", (F.col("n") + 1).cast("int").alias("slide_ord"), raw.alias("raw"), bullets.alias("bullets"))
    page = lambda c: F.regexp_extract(c, TAG, 1).try_cast("int") - 1
    s = s.withColumn("title", without_tag(F.col("raw")))
    return s.select("file_id", "slide_ord", "title", slide_type(F.col("title"), F.col("slide_ord")).alias("slide_type"), page(F.col("raw")).alias("title_page"), F.transform("bullets", lambda b: F.struct(b.alias("text"), page(b).alias("page"))).alias("bullets"))


def slides(outlines: DataFrame, images: DataFrame) -> DataFrame:
    """Slides (file_id, slide_ord, title, slide_type, bullets, image) of outlines (file_id, markdown).

    A slide's tags ask, title first, for an unused image (file_id, page_index, image_ord, image) of a page;
    the first that is found is the slide's, later tags stay in their bullets. Which images are used
    depends on all slides before, so a file's slides are walked in order.
    """
    asked = headings(outlines)
    offered = images.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("page_index", "image_ord", "image"))).alias("images"))
    kind = outlines.schema["file_id"].dataType.simpleString()

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for file, rows, found in zip(frame.file_id, frame.slides, frame.images):
                left: dict[int, list[str]] = {}
                used: set[str] = set()
                for x in found if found is not None else []:
                    left.setdefault(x["page_index"], []).append(x["image"])

                def take(page: int | None, left=left, used=used) -> str | None:
                    for x in left.get(page, []) if page is not None else []:
                        if x not in used:
                            used.add(x)
                            return x
                    return None

                for r in rows:
                    image = take(r["title_page"])
                    bullets = []
                    for b in r["bullets"]:
                        t = b["text"]
                        if b["page"] is not None and image is None:
                            image = take(b["page"])
                            t = TAGS.sub("", t).strip()
                        if t:
                            bullets.append(t)
                    out.append((file, r["slide_ord"], r["title"], r["slide_type"], bullets, image))
            yield pd.DataFrame(out, columns=["file_id", "slide_ord", "title", "slide_type", "bullets", "image"])

    whole = asked.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("slide_ord", "title", "slide_type", "title_page", "bullets"))).alias("slides"))
    return whole.join(offered, "file_id", "left").mapInPandas(walk, f"file_id {kind}, slide_ord int, title string, slide_type string, bullets array<string>, image string")
