"""Hand-worked rows of the semantics, and the offline surfaces."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.functions import citations, text
from paperloom.functions.registry import Registry
from paperloom.operators import layout, reading, store
from paperloom.streaming.sessions import reading_sessions

AUTHORS = ["Ada Lovelace", "Alan M. Turing"]
FIELDS = {"title": "On  Computable Things", "journal": "J. Test", "date": "2024-03", "volume": "5", "issue": "2", "pages": "10–20", "doi": "10.1000/x1"}


@pytest.mark.parametrize("style,want", [
    ("gbt-7714-2015", "LOVELACE A, TURING A M. On Computable Things[J]. J. Test, 2024, 5(2): 10-20. DOI: 10.1000/x1."),
    ("apa-7th", "Lovelace, A., & Turing, A. M.. (2024). On Computable Things. J. Test, 5(2), 10-20. https://doi.org/10.1000/x1."),
    ("ieee", 'A. Lovelace, and A. M. Turing, "On Computable Things.", J. Test, vol. 5, no. 2, pp. 10-20, 2024, doi: 10.1000/x1.'),
    ("vancouver", "Lovelace A, Turing AM On Computable Things. J. Test. 2024;5(2):10-20 doi: 10.1000/x1."),
    ("din-1505-2", "Lovelace, Ada ; Turing, Alan M.. On Computable Things.. J. Test, Bd. 5 (2024), Nr. 2, S. 10-20. DOI: 10.1000/x1."),
    ("apa-6th", "Lovelace, A., & Turing, A. M.. (2024). On Computable Things. J. Test, 5(2), 10-20. doi:10.1000/x1."),
    ("mla-9th", 'Lovelace, Ada, and Turing, Alan M.. "On Computable Things.". J. Test, vol. 5, no. 2, 2024, pp. 10-20. doi:10.1000/x1.'),
    ("mla-8th", 'Lovelace, Ada, and Turing, Alan M.. "On Computable Things.". J. Test, vol. 5, no. 2, 2024, pp. 10-20. doi:10.1000/x1.'),
    ("chicago-17th-author-date", 'Lovelace, Ada, and Turing, Alan M.. 2024. "On Computable Things.". J. Test 5, no. 2: 10-20. https://doi.org/10.1000/x1.'),
    ("chicago-17th-notes", 'A. Lovelace, and A. M. Turing. "On Computable Things.". J. Test 5, no. 2 (2024): 10-20. https://doi.org/10.1000/x1.'),
    ("turabian-9th", 'A. Lovelace, and A. M. Turing. "On Computable Things.". J. Test 5, no. 2 (2024): 10-20. https://doi.org/10.1000/x1.'),
    ("harvard", "Lovelace, A. and Turing, A. M.. (2024). 'On Computable Things'. J. Test, 5(2), pp. 10-20. doi: 10.1000/x1."),
    ("ama-11th", "Lovelace A, Turing AM On Computable Things. J. Test. 2024;5(2):10-20 doi:10.1000/x1."),
    ("nlm", "Lovelace A, Turing AM On Computable Things. J. Test. 2024;5(2):10-20 doi: 10.1000/x1."),
    ("acs", "Lovelace, A.; Turing, A. M. On Computable Things. J. Test 2024, 5 (2), 10-20 DOI: 10.1000/x1."),
    ("aip", 'A. Lovelace, and A. M. Turing, "On Computable Things.", J. Test 5, 2, 10-20 (2024), https://doi.org/10.1000/x1.'),
    ("aps", "A. Lovelace, and A. M. Turing, On Computable Things., J. Test 5, 2, 10-20 (2024), https://doi.org/10.1000/x1."),
    ("nature", "Lovelace, A. & Turing, A. M. On Computable Things. J. Test 5, 10-20 (2024) https://doi.org/10.1000/x1."),
    ("science", "A. Lovelace, A. M. Turing On Computable Things. J. Test 5, 10-20 (2024) doi: 10.1000/x1."),
    ("cell", "A. Lovelace, and A. M. Turing (2024). On Computable Things. J. Test 5, 2, 10-20 https://doi.org/10.1000/x1."),
    ("pnas", "A. Lovelace, A. M. Turing (2024) On Computable Things. J. Test 5 (2):10-20 https://doi.org/10.1000/x1."),
    ("iso-690", "LOVELACE, ADA, TURING, ALAN M.. On Computable Things.. J. Test, 2024, vol. 5, no. 2, p. 10-20. DOI: 10.1000/x1."),
    ("nonsense", "[Unknown style: nonsense]"),
])
def test_citations(spark, style, want):
    fields = {k: F.lit(v) for k, v in FIELDS.items()}
    assert spark.range(1).select(citations.cite(F.array(*map(F.lit, AUTHORS)), fields, style)).first()[0] == want


@pytest.mark.parametrize("style,want", [
    ("gbt-7714-2015", "SOLO. T[M]. Press, 2021: 7."), ("apa-6th", "Solo. (2021). T. Press. Retrieved from http://u."), ("mla-9th", 'Solo. "T.". Press, 2021. http://u.'), ("chicago-17th-author-date", 'Solo. 2021. "T.". Press.'),
    ("harvard", "Solo. (2021). 'T'. Press, 2021."), ("vancouver", "Solo T. Press; 2021."), ("ama-11th", "Solo T. Press; 2021."), ("nlm", "Solo T.."), ("acs", "Solo T.."), ("aip", 'Solo, "T.".'), ("cell", "Solo (2021). T.."), ("iso-690", "SOLO. T.. Press, 2021. Available from: http://u."),
])
def test_citations_of_books(spark, style, want):
    fields = {"title": "T", "publisher": "Press", "date": "in 2021", "pages": "7", "url": "http://u", "isbn": "1"}
    assert spark.range(1).select(citations.cite(F.array(F.lit("Solo")), {k: F.lit(v) for k, v in fields.items()}, style)).first()[0] == want


def test_citations_of_many(spark):
    many = F.array(*[F.lit(f"A{i} B C{i}") for i in range(9)])
    show = lambda style, out="text": spark.range(1).select(citations.cite(many, {"title": F.lit("T"), "journal": F.lit("J"), "volume": F.lit("5")}, style, out)).first()[0]
    assert show("apa-6th") == "C0, A. B., C1, A. B., C2, A. B., C3, A. B., C4, A. B., C5, A. B., C6, A. B., et al.. T. J, 5."
    assert show("mla-9th") == 'C0, A0 B, C1, A1 B, et al.. "T.". J, vol. 5.'
    assert show("aip") == 'A. B. C0, A. B. C1, A. B. C2, et al., "T.", J 5.'
    assert show("cell", "html").endswith(', and A. B. C8 (). T. <i>J</i> <i>5</i>.')


def test_sessions(spark):
    rows = [("p1", "A", "2026-06-08T14:30:00.000Z", 600), ("p1", "A2", "2026-06-09T01:05:00.000Z", 30), ("p2", "B", "2026-06-08T23:59:58.000Z", 10), ("p2", "B", "bad", 20), ("p3", "C", "2026-06-08T10:00:00.000Z", 4)]
    log = reading.log(spark.createDataFrame(rows, "paper_id string, paper_name string, start_time string, duration_seconds long"))
    assert reading.total(log).first()[0] == 660
    assert [tuple(r) for r in reading.leaderboard(log).collect()][0][2] == 630
    assert {r[0]: r[1] for r in reading.daily(log, "2026-07-09").collect()} == {"2026-06-09": 30, "unknown": 20}
    assert {r[0]: r[1] for r in reading.hourly(log).collect() if r[1]} == {0: 20, 1: 30, 14: 600, 23: 10}


def test_sizes(spark):
    from paperloom.plans import QUERIES, SQL

    from .oracle import connect

    sizes = [None, 0, 1, 1023, 1024, 1280, 1535, 10_239, 1_048_575, 1_048_576, 1_310_720, 5_500_000, 3 << 30]
    want = ["-" if not n else f"{n} B" if n < 1024 else f"{(n * 10 + 512) // 1024 / 10:.1f} KB" if n < 1 << 20 else f"{(n * 10 + (1 << 19)) // (1 << 20) / 10:.1f} MB" for n in sizes]
    df = spark.createDataFrame(list(enumerate(sizes)), "i int, n long").select("i", text.file_size_text(F.col("n")).alias("shown"))
    assert [r.shown for r in df.orderBy("i").collect()] == want
    con = connect("/root/testdata/sf0.001")
    con.execute("CREATE OR REPLACE TEMP VIEW documents AS SELECT i AS doc_id, '' AS text, '' AS lang, '' AS source, n AS n_chars FROM (VALUES " + ", ".join(f"({i}, CAST({'NULL' if n is None else n} AS BIGINT))" for i, n in enumerate(sizes)) + ") t(i, n)")
    assert [r[1] for r in sorted(con.execute(SQL["display_size_all"]).fetchall())] == want
    sf = "/root/testdata/sf0.001"
    assert QUERIES["display_size_all"](spark, sf).count() == spark.read.parquet(f"{sf}/documents.parquet").count()


def test_identifiers(spark):
    cases = {"arXiv:2401.12345": "2401.12345", "arxiv:cs/0703142": "cs/0703142", "arxiv.org/pdf/2401.1234": "2401.1234", "10.48550/arXiv.2401.12345": "2401.12345", "2401.12345": None}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r[0]: r[1] for r in df.select("t", text.find_arxiv(F.col("t"))).collect()} == cases


def test_snippet_and_keywords(spark):
    t = "x" * 100 + "Needle" + "y" * 100
    row = spark.range(1).select(text.snippet(F.lit(t), "needle"), text.keyword_union(F.array(F.lit("AI"), F.lit("ML")), F.array(F.lit("ml"), F.lit("NLP"), F.lit("nlp")))).first()
    assert row[0] == "x" * 40 + "Needle" + "y" * 40
    assert row[1] == ["AI", "ML", "NLP", "nlp"]


def test_paragraphs():
    box = np.array([[0, 0, 50, 10], [52, 0, 100, 10], [0, 14, 100, 24], [0, 60, 100, 70]], float)
    words = ["Hello ", "world", "second line", "new para"]
    assert layout.paragraphs(words, box)[0] == ["Hello world\nsecond line\nnew para"]
    box = np.vstack([box, [0, 74, 100, 84]])
    got, bounds = layout.paragraphs([*words, "tail"], box)
    assert got == ["Hello world\nsecond line", "new para\ntail"]
    assert bounds.tolist() == [[0, 0, 100, 24], [0, 60, 100, 84]]
    assert layout.joined(["hyphen\x02 ", " ated"]) == "hyphenated"


def test_box_bounds_and_order(spark):
    seg = spark.createDataFrame([(1, 0, 0, "a", 5.0, 5.0, 15.0, 15.0), (1, 0, 1, "b", 45.0, 45.0, 55.0, 55.0)], "file_id long, page_index long, seg_ord long, text string, xmin double, ymin double, xmax double, ymax double")
    box = spark.createDataFrame([(1, 0, 0, 4, 2, 0.0, 0.0, 10.0, 10.0), (1, 0, 1, 4, 1, 10.0, 10.0, 20.0, 20.0)], "file_id long, page_index long, box_ord int, cls_id long, read_order long, xmin double, ymin double, xmax double, ymax double")
    assert [r.box_ord for r in layout.assigned(seg, box).collect()] == [1]
    assert [r.text for r in layout.unassigned(seg, box).collect()] == ["b"]


def test_upsert_is_idempotent_and_keeps_nulls(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, None, 2), (2, "b", 1)], "k int, v string, seq int")
    once = store.latest_wins(df, ["k"], "seq")
    assert sorted(map(tuple, once.collect())) == [(1, None, 2), (2, "b", 1)]
    assert sorted(map(tuple, store.latest_wins(once, ["k"], "seq").collect())) == sorted(map(tuple, once.collect()))


def test_stream_of_sessions(spark, tmp_path):
    events = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:05:00"), (1, "2024-01-01 02:00:00"), (2, "2024-01-01 03:00:00")], "user_id long, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = reading_sessions(stream).writeStream.format("memory").queryName("out").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    batch = {(r.user_id, r.events, r.duration_seconds) for r in reading_sessions(events).collect()}
    assert (1, 2, 300) in batch
    assert {(r.user_id, r.events, r.duration_seconds) for r in spark.table("out").collect()} <= batch


def test_interceptors(spark):
    r = Registry()
    r.register("p", "f", len, "read")
    r.before.append(("p", lambda df: df.where("id > 1")))
    assert r.allowed("p", "read") and not r.allowed("p", "write") and r.allowed("__own", "write")
    assert r.intercept(spark.range(4), lambda df: df).count() == 2
    assert r.intercept(spark.range(4), lambda df: df, "p").count() == 4
    r.before.append(("q", lambda df: None))
    assert r.intercept(spark.range(4), lambda df: df) is None


def test_math_parts(spark):
    from paperloom.functions.text import math_parts

    cases = {
        "a $$b$$ c $d$ e": [("md", "a "), ("math_d", "b"), ("md", " c "), ("math_i", "d"), ("md", " e")],
        "x $1 $$y$$": [("md", "x $1 "), ("math_d", "y")],
        "$$ a $b$": [("md", "$"), ("math_i", " a "), ("md", "b$")],
        "$$$$": [("math_d", "")],
        "": [],
    }
    got = {r[0]: [tuple(x) for x in r[1]] for r in spark.createDataFrame([(t,) for t in cases], "t string").select("t", math_parts(F.col("t"))).collect()}
    assert got == cases


def test_numbered_names_avoid_taken_ones(spark):
    names = ["a.pdf", "a.pdf", "a_1.pdf", "b.pdf", "a.pdf", "a_1.pdf", "c", "c"]
    rows = store.numbered_names(spark.createDataFrame(list(enumerate(names)), "i int, name string"), "name", "i").orderBy("i").collect()
    assert [r.unique_name for r in rows] == ["a.pdf", "a_1.pdf", "a_1_1.pdf", "b.pdf", "a_2.pdf", "a_1_2.pdf", "c", "c_1"]


def test_quota_counts_the_other_values(spark):
    kv = spark.createDataFrame([("p", "a", "x" * 6), ("p", "b", "yy")], "plugin string, key string, value string")
    new = spark.createDataFrame([("p", "a", "é" * 4), ("p", "c", "zz"), ("p", "d", "zzz"), ("q", "a", "1" * 10)], "plugin string, key string, value string")
    got = {(r.plugin, r.key): (r.used, r.accepted) for r in store.quota_checked(kv, new, "plugin", "key", "value", 10).collect()}
    assert got == {("p", "a"): (2, True), ("p", "c"): (8, True), ("p", "d"): (8, False), ("q", "a"): (0, True)}


def test_rtf_and_html(spark):
    row = spark.range(1).select(text.to_rtf(F.lit("a *b* {c}\\")), text.to_html(F.lit('a *b* "<&'))).first()
    assert row[0] == r"{\rtf1\ansi\deff0 {\fonttbl {\f0 Times New Roman;}}\f0\fs24 a {\i b} \{c\}\\}"
    assert row[1] == "a <i>b</i> &quot;&lt;&amp;"
