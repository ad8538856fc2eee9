"""Steps whose work must grow no faster than their input."""

import time

from pyspark.sql import functions as F

from paperloom.operators import remote


def test_title_search_with_many_copies(spark):
    """20,000 titles and 20,000 records of one set of words are one search, not 400 million pairs."""
    begin = time.perf_counter()
    titles = spark.range(20000).select("id", F.lit("Great looms of the west").alias("title"))
    catalogue = spark.range(7, 20007).select(F.col("id").alias("record"), F.lit("west looms of THE great").alias("title"))
    got = remote.by_title(titles, catalogue).groupBy("record").count().collect()
    assert [tuple(r) for r in got] == [(7, 20000)]
    assert time.perf_counter() - begin < 40


def test_title_search_same_as_all_pairs(spark):
    words = "loom web thread great small old hot cold plate ring".split()
    title = lambda k: F.concat_ws(" ", *[F.get(F.array(*[F.lit(w) for w in words]), (F.hash(k, F.lit(i)) % 5 + 5).cast("int")) for i in range(6)])
    titles = spark.range(300).select("id", title(F.col("id")).alias("title"))
    catalogue = spark.range(5000, 5300).select(F.col("id").alias("record"), title(F.col("id")).alias("title"))
    bags = [{r[0]: set(r[1].split()) for r in t.collect()} for t in (titles, catalogue)]
    want = {}
    for i, a in bags[0].items():
        found = [(len(a & b) / max(len(a), len(b)), -r) for r, b in bags[1].items()]
        if max(found)[0] >= 0.7:
            want[i] = -max(found)[1]
    assert want and {r.id: r.record for r in remote.by_title(titles, catalogue).collect()} == want


def test_remembered_searches_with_many_copies(spark):
    """200 kept searches over 100,000 records of 200 sets of words; each shares words with all records."""
    begin = time.perf_counter()
    of = lambda k: F.concat(F.lit("the great loom of weaver"), k.cast("string"))
    requests = spark.range(200).select("id", F.col("id").alias("ord"), of(F.col("id") % 200).alias("title"))
    catalogue = spark.range(100000).select(F.col("id").alias("record"), of(F.col("id") % 200).alias("title"))
    got = remote.searched_once(requests, catalogue).collect()
    assert sorted((r.id, r.record) for r in got) == [(k, k) for k in range(200)]
    assert time.perf_counter() - begin < 30


def test_long_rows_are_spread(spark, tmp_path):
    """A table in one row group, of which each row takes long, is worked on by all cores."""
    from paperloom.plans import QUERIES

    spark.range(200).selectExpr("id as p_partkey", "concat('loom ', id) as p_name", "'Brand#1' as p_brand", "cast(id % 50 as int) as p_size").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    for name in ("model_input_tensors", "catalogue_record", "cite_vancouver", "cite_ieee", "cite_nlm", "cite_mla_8th", "cite_mla_9th"):
        at = QUERIES[name](spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().collect()
        assert len(at) >= spark.sparkContext.defaultParallelism, name


def test_many_small_images(spark):
    """Images of some sizes and spaces, beside each other in a batch, have the tensors that each has alone; 40,000 take seconds."""
    import numpy as np

    from paperloom.operators import pixels

    kinds = [(3, 2, "DeviceRGB"), (2, 3, "DeviceGray"), (1, 1, "DeviceCMYK"), (2, 3, "Lab"), (9, 9, "DeviceRGB")]
    r = np.random.default_rng(3)
    rows = [(i, r.integers(0, 256, 24, np.uint8).tobytes(), *kinds[i % 5]) for i in range(200)] + [(200, None, 1, 1, "DeviceGray")]
    df = spark.createDataFrame(rows, "id int, content binary, width int, height int, space string")
    want = {i: pixels.tensor(x, 4).tobytes() for i, *image in rows if (x := pixels.to_rgb(*image)) is not None}
    got = pixels.model_inputs(df, "id", 4).collect()
    assert {x.id: bytes(x.tensor) for x in got} == want
    assert {(x.scale_h, x.scale_w) for x in got if x.id % 5 == 1} == {(np.float32(4) / np.float32(3), 2.0)}
    begin = time.perf_counter()
    many = spark.range(40000).select("id", F.lit(bytes(8)).alias("content"), F.lit(8).alias("width"), F.lit(1).alias("height"), F.lit("DeviceGray").alias("space")).coalesce(1)
    assert pixels.model_inputs(many, "id", 4).count() == 40000
    assert time.perf_counter() - begin < 10


def test_eraser_makes_points_once(spark):
    """A stroke's points are made once, not once a use."""
    from paperloom.operators import records

    points = F.transform(F.sequence(F.lit(0), F.lit(300)), lambda i: F.struct((i / 1000 + F.col("id") / 1e9).alias("x"), (i / 1000).alias("y")))
    shapes = spark.range(3000).select((F.col("id") % 10).alias("page"), F.col("id").alias("ord"), F.lit("pen").alias("kind"), points.alias("points"))
    begin = time.perf_counter()
    got = records.erased(shapes, ["page"], F.lit(0.2005), F.lit(0.2005)).collect()
    assert sorted((r.page, r.ord) for r in got) == [(k, 2990 + k) for k in range(10)]
    assert time.perf_counter() - begin < 20


def test_segments_move_once(spark):
    """Segments are sent to their page's boxes once, and not again by their own place."""
    from paperloom.operators import layout

    seg = spark.range(100).selectExpr("id % 7 as file_id", "0L as page_index", "id as seg_ord", "concat('w', id) as text", "id * 1.0D as xmin", "0.0D as ymin", "id + 1.0D as xmax", "2.0D as ymax")
    box = spark.createDataFrame([(f, 0, o, c, 9 - o, 20.0 * o, 0.0, 20.0 * o + 30, 2.0) for f in range(6) for o, c in enumerate((8, 1, 4))], "file_id long, page_index long, box_ord long, cls_id long, read_order long, xmin double, ymin double, xmax double, ymax double")
    for found in (layout.unassigned(seg, box), layout.without_garbage(seg, box), layout.assigned(seg, box)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert not [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "seg_ord" in line] and "SortMergeJoin" not in plan
    holds = lambda i: [o for o in range(3) if 20 * o <= i + 0.5 <= 20 * o + 30]
    assert sorted(r.seg_ord for r in layout.unassigned(seg, box).collect()) == [i for i in range(100) if i % 7 == 6 or not holds(i)]
    assert sorted(r.seg_ord for r in layout.without_garbage(seg, box).collect()) == [i for i in range(100) if i % 7 == 6 or 0 not in holds(i)]
    assert {r.seg_ord: (r.box_ord, r.read_order) for r in layout.assigned(seg, box).collect()} == {i: (max(holds(i)), 9 - max(holds(i))) for i in range(100) if i % 7 != 6 and holds(i)}


def test_paragraphs_of_a_long_page():
    import numpy as np

    from paperloom.operators import layout

    box = np.array([[i % 8 * 40.0, i // 8 * 14.0, i % 8 * 40.0 + 36, i // 8 * 14.0 + 10] for i in range(320)])
    begin = time.perf_counter()
    for _ in range(300):
        found = layout.paragraphs([f"w{i}" for i in range(320)], box)
    assert time.perf_counter() - begin < 0.9
    assert found[0][0].startswith("w0w1w2w3w4w5w6w7\nw8") and found[1][0][:2].tolist() == [0.0, 0.0] and found[1][-1][3] == 556.0


def test_small_fonts_do_not_move(spark):
    """Before the shuffle a page keeps its large segments only; pages in pieces and odd sizes lose nothing."""
    from paperloom.operators import metadata

    rows = [(1, 0, 0, "a", 8.0), (1, 0, 1, "B", 12.0), (1, 0, 2, "C", 11.0), (2, 0, 0, "x", -1.0), (2, 0, 1, "y", -3.0), (1, 0, 3, "d", 8.0), (3, 0, 0, "n", None), (3, 0, 1, "M", 5.0)]
    seg = spark.createDataFrame(rows, "file_id long, page_index long, seg_ord long, text string, font_size double").coalesce(1)
    kept = {r.text for r in metadata.large_ones(seg).collect()}
    assert {"B", "C", "M"} <= kept and "a" not in kept
    assert sorted(tuple(r) for r in metadata.title_by_font(seg).collect()) == [(1, 0, "B C"), (3, 0, "M")]


def test_many_sidecar_files(spark, tmp_path):
    """Files of documents in one row group are written by all cores, without a process for each."""
    from paperloom.operators import sidecars

    docs = spark.range(3000).select("id", F.concat(F.lit('{\n"a": '), F.col("id").cast("string"), F.lit("}")).alias("text")).coalesce(1)
    begin = time.perf_counter()
    sidecars.written(docs, "id", F.col("text"), str(tmp_path / "s"))
    assert time.perf_counter() - begin < 15
    got = spark.read.schema("id long, a long").option("multiLine", "true").json(str(tmp_path / "s"))
    assert got.where("id = a").count() == got.count() == 3000


def test_sidecar_folders_as_spark_writes_them(spark, tmp_path, monkeypatch):
    import pytest

    from paperloom.operators import sidecars

    odd = "".join(map(chr, range(1, 128)))
    keys = ["a b", "x=y:z", "50%+%41", "ä/ö\\", "[1]{2}^3", "", None, "'q\"", "__HIVE_DEFAULT_PARTITION__", "same", "same", odd]
    docs = spark.createDataFrame([(k, None if i == 9 else f'{{"i": {i},\n "ü": "\\r\r\n"}}') for i, k in enumerate(keys)], "`the key` string, text string")
    sidecars.written(docs, "the key", F.col("text"), str(tmp_path / "own"))
    monkeypatch.setattr(sidecars, "local_path", lambda *_: None)
    sidecars.written(docs, "the key", F.col("text"), str(tmp_path / "spark"))
    texts = lambda top: {p.name: sorted(b"".join(f.read_bytes() for f in p.glob("part-*")).split(b"\n")) for p in top.iterdir() if p.is_dir()}
    assert texts(tmp_path / "own") == texts(tmp_path / "spark") and len(texts(tmp_path / "own")) == 9  # null, empty and default keys share one
    for top in ("own", "spark"):
        given = spark.read.schema("value string, `the key` string").text(str(tmp_path / top)).select("the key").distinct().collect()
        got = sidecars.read(spark, str(tmp_path / top), "the key", "string", "i int").select("the key").distinct().collect()
        assert {r[0] for r in got} == {r[0] for r in given} and len(got) == 9
    monkeypatch.undo()
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        sidecars.written(docs, "the key", F.col("text"), str(tmp_path / "own"))
