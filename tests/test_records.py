"""Hand-worked rows: layout with boxes, renames, searches that are remembered, sidecars, nested sections."""

import json
import random

from pyspark.sql import functions as F

from paperloom.operators import layout, metadata, remote, sections, sidecars, store

SEGMENT = "file_id long, page_index long, seg_ord long, text string, xmin double, ymin double, xmax double, ymax double"
BOX = "file_id long, page_index long, box_ord int, cls_id long, read_order long, xmin double, ymin double, xmax double, ymax double"


def test_boxes_then_paragraphs_of_the_rest(spark):
    rest = [("Hello ", 0, 0, 50, 10), ("world", 52, 0, 100, 10), ("second", 0, 14, 100, 24)]
    rows = [(1, 0, i, *x) for i, x in enumerate(rest)]
    rows += [(1, 0, 10, "in b", 200, 0, 220, 10), (1, 0, 11, "in both", 200, 20, 230, 30), (1, 0, 12, "in a", 200, 40, 220, 50)]
    rows += [(2, 0, i, *x) for i, x in enumerate(rest)]  # a page without boxes
    seg = spark.createDataFrame([(a, b, c, t, *map(float, xs)) for a, b, c, t, *xs in rows], SEGMENT)
    box = spark.createDataFrame([(1, 0, 0, 4, 7, 190.0, 15.0, 300.0, 60.0), (1, 0, 1, 4, 3, 190.0, 0.0, 300.0, 30.0), (1, 0, 2, 4, 1, 900.0, 0.0, 999.0, 9.0), (3, 0, 0, 4, 1, 0.0, 0.0, 9.0, 9.0)], BOX)
    got = layout.merge_with_boxes(seg, box).orderBy("file_id", "par_ord").collect()
    whole = "Hello world\nsecond"
    assert [(r.file_id, r.par_ord, r.box_ord, r.text, r.xmin, r.ymin, r.xmax, r.ymax) for r in got] == [
        (1, 0, 1, "in b\nin both", 190, 0, 300, 30), (1, 1, 0, "in a", 190, 15, 300, 60), (1, 2, None, whole, 0, 0, 100, 24), (2, 0, None, whole, 0, 0, 100, 24),
    ]
    plain = layout.merge_paragraphs(seg.where("file_id = 2")).collect()
    assert [r.text for r in plain] == [whole]


def test_every_segment_once_with_boxes(spark):
    r = random.Random(1)
    rows = [(1, 0, i, f"w{i}", x, y, x + 20.0, y + 10.0) for i in range(120) for x, y in [(r.random() * 400, r.random() * 400)]]
    box = [(1, 0, b, 4, r.randrange(4), x, y, x + 150.0, y + 150.0) for b in range(6) for x, y in [(r.random() * 300, r.random() * 300)]]
    got = layout.merge_with_boxes(spark.createDataFrame(rows, SEGMENT), spark.createDataFrame(box, BOX)).collect()
    words = "".join(x.text.replace("\n", "") for x in got)
    assert sorted(words.split("w")[1:], key=int) == [str(i) for i in range(120)]


FILES = "folder string, ord int, name string, ext string, title string"


def test_renames(spark):
    rows = [
        ("f", 1, "1.pdf", "pdf", "a"), ("f", 2, "2.pdf", "pdf", "a"), ("f", 3, "3.pdf", "pdf", "a_01"), ("f", 4, "4", "", "plain"), ("f", 5, "5", None, "plain"), ("f", 6, "b.pdf", "pdf", "c"), ("f", 7, "7.pdf", "pdf", "b"),
        ("f", 8, "8.pdf", "pdf", "later"), ("f", 9, "later.pdf", "pdf", "  "), ("f", 10, "d.pdf", "pdf", " d "), ("f", 11, "11.pdf", "pdf", None), ("f", 12, "12.PDF", "PDF", "a"), ("g", 1, "1.pdf", "pdf", "a"), ("f", 13, "13.pdf", "pdf", 'x<>:"/\\|?*'),
    ]
    got = {(r.folder, r.ord): r.new_name for r in remote.renamed(spark.createDataFrame(rows, FILES)).collect()}
    assert got == {
        ("f", 1): "a.pdf", ("f", 2): "a_01.pdf", ("f", 3): "a_01_01.pdf", ("f", 4): "plain", ("f", 5): "plain_1", ("f", 6): "c.pdf", ("f", 7): "b.pdf",  # b was free by then
        ("f", 8): "later_01.pdf", ("f", 9): "later.pdf", ("f", 10): "d.pdf", ("f", 11): "11.pdf", ("f", 12): "a.PDF", ("g", 1): "a.pdf", ("f", 13): "x_________.pdf",
    }


def test_renames_are_a_plain_walk(spark):
    r, rows = random.Random(2), []
    for i in range(300):
        ext = r.choice(["pdf", ""])
        stem = r.choice(["a", "a_01", "a_02", "b", "a_1", "a_01_02", "c.d"])
        rows.append(("f", i, f"{stem}_{i}" + (".pdf" if ext else ""), ext, r.choice(["a", "a_01", "b", "a_1", "c.d", "", f"b_{i - 7}"])))
    got = {x.ord: x.new_name for x in remote.renamed(spark.createDataFrame(rows, FILES)).collect()}
    there, want = {x[2] for x in rows}, {}
    for _, i, name, ext, title in rows:
        new = f"{title}.{ext}" if ext else title
        k = 0
        while title and new != name and new in there:
            k += 1
            new = f"{title}_{k:02d}.{ext}" if ext else f"{title}_{k}"
        want[i] = new if title else name
        there.discard(name)
        there.add(want[i])
    assert got == want and len(set(want.values())) == len(rows)


def test_first_request_of_a_search_decides(spark):
    long = "the very long title of a paper on looms and on the webs that they weave through all "
    requests = [(1, 2, long + "winters"), (2, 1, long.upper() + "summers"), (3, 3, "Short one here"), (4, 4, " abc "), (5, 5, "short ONE here "), (6, 6, None)]
    catalogue = [(10, long + "winters"), (11, "short one there"), (12, "other words")]
    got = remote.searched_once(spark.createDataFrame(requests, "id int, ord int, title string"), spark.createDataFrame(catalogue, "record int, title string"))
    assert {r.id: r.record for r in got.collect()} == {1: 10, 2: 10, 3: None, 4: None, 5: None, 6: None}  # short and here of three words: 2 / 3
    vain = spark.createDataFrame([(1, 1, long + "x " * 9 + "nothing of it all is in any catalogue so that words differ by far and many more of them"), (2, 2, long + "winters")], "id int, ord int, title string")
    assert {r.id: r.record for r in remote.searched_once(vain, spark.createDataFrame(catalogue, "record int, title string")).collect()} == {1: None, 2: None}  # a vain answer is kept too


def test_sidecars(spark, tmp_path):
    docs = spark.createDataFrame([("p1", json.dumps({"a": 1, "list": [{"t": "x\ny"}], "more": {"z": 1}}, indent=1)), ("p2", '{"a": 1,\n"list": [{'), ("p3", "{}"), ("p4", '{\n"a": "no number"\n}'), ("p5", "")], "name string, text string")
    sidecars.written(docs, "name", F.col("text"), str(tmp_path / "s"))
    got = {r.name: (r.a, r.list, r.b, r.damaged) for r in sidecars.read(spark, str(tmp_path / "s"), "name", "string", "a int, b int, list array<struct<t string>>", {"b": F.lit(7)}).collect()}
    assert got["p1"][0] == 1 and got["p1"][1][0].t == "x\ny" and got["p1"][2:] == (7, False)
    assert got["p2"] == (None, None, None, True) and got["p3"] == (None, None, 7, False) and got["p4"][3]
    assert len(got) in (4, 5)  # an empty file has no row
    back = tmp_path / "t"
    sidecars.written(spark.createDataFrame([(1, "x", [1, 2])], "k int, s string, l array<int>"), "k", F.struct("s", "l"), str(back))
    assert [tuple(r) for r in sidecars.read(spark, str(back), "k", "int", "s string, l array<int>").collect()] == [(1, "x", [1, 2], False)]


def test_sections_of_any_depth(spark):
    r, want = random.Random(3), {}

    def tree(key, depth):
        found = []
        for i in range(r.randrange(1, 3) if depth else 2):
            title = f"{key}-{len(want[key])}"
            want[key].append((depth + 1, title))
            found.append({"title": title, "level": depth, "subsections": tree(key, depth + 1) if depth < 12 and r.random() < 0.8 else []})
        return found

    rows = []
    for key in range(6):
        want[key] = []
        rows.append((key, json.dumps(tree(key, 0))))
    rows += [(90, "[]"), (91, None), (92, "{"), (93, '{"title": 1}'), (94, '[{"content": "c"}, 5]')]
    got = sections.flattened(spark.createDataFrame(rows, "k int, s string"), "k", "s").orderBy("k", "sec_ord").collect()
    assert {k: [(x.depth, x.title) for x in got if x.k == k] for k in want} == want
    assert max(x.depth for x in got) > 6
    assert [(x.title, x.content) for x in got if x.k == 94] == [(None, "c"), (None, None)] and not [x for x in got if 90 <= x.k < 94]


def test_parsed_fields_fill_gaps_only(spark):
    facts = F.struct(*[F.lit(f"page {c}").alias(c) for c in ("doi", "abstract", "date", "volume", "issue", "pages", "url")])
    known = {c: F.lit("own") for c in ("doi", "abstract", "date", "volume", "issue", "pages", "url")}
    shown = lambda **k: spark.range(1).select(*[c.alias(n) for n, c in metadata.first_page_fill(known | {a: F.lit(b) for a, b in k.items()}, facts).items()]).first()
    assert shown(volume="").volume == ""  # nothing looks at the page
    assert shown(volume="", date="")[2:4] == ("page date", "page volume")
    assert shown(doi="").volume == "own"


def test_keywords_golden(spark):
    a, b = (F.array(*map(F.lit, x)) for x in (["AI", "ML"], ["ml", "NLP", "nlp"]))
    from paperloom.functions.text import keyword_union

    assert spark.range(1).select(keyword_union(a, b)).first()[0] == ["AI", "ML", "NLP", "nlp"]


def test_patches_of_json(spark):
    rows = spark.createDataFrame([(i, "own", "a", 5, "kept") for i in range(8)], "id int, title string, authors string, volume int, note string")
    updates = [(0, '{"title": "new", "note": "x", "volume": 9}'), (1, '{"title": null, "authors": ["A", "b\\"c"]}'), (2, '{"title": ""}'), (3, '{"title": 1.50, "authors": {"z": true}}'), (4, "[1]"), (5, "{"), (6, None)]
    got = {r.id: tuple(r)[1:] for r in store.patch_json(rows, spark.createDataFrame(updates, "id int, update string"), "id").collect()}
    same = ("own", "a", 5, "kept")
    assert got == {0: ("new", "a", 5, "kept"), 1: ("own", '["A","b\\"c"]', 5, "kept"), 2: ("", "a", 5, "kept"), 3: ("1.5", '{"z":true}', 5, "kept"), 4: same, 5: same, 6: same, 7: same}


def test_boxes_of_a_model(spark):
    box = spark.createDataFrame([(1, 0, 0, 4, 9, 0.9), (1, 0, 1, 4, 2, 0.5), (1, 0, 2, 3, 2, 0.6), (1, 0, 3, 4, 2, 0.7), (2, 0, 0, 4, 1, 0.99)], "file_id long, page_index long, box_ord int, cls_id int, read_order int, score double")
    assert sorted((r.file_id, r.place, r.box_ord) for r in layout.inferred(box).collect()) == [(1, 0, 2), (1, 1, 3), (1, 2, 0), (2, 0, 0)]
    assert layout.inferred(box, 2.0).count() == 0 and layout.inferred(box, -1.0).count() == 5  # a threshold is between 0 and 1
    assert [r.box_ord for r in layout.visual(box).collect()] == [2]
