"""Queries over pixels, models' answers and files of rankings, each beside its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import layout, model_calls, pixels, records, sidecars, store
from ..session import working_dir
from ..sources import clicks, read, spread
from .library import query


def two(c):
    return F.lpad(F.lower(F.hex(c.cast("long"))), 2, "0")


# Pixels of orders: two a row, in three colour spaces; some too short, some longer than the image.
PIXELS = """WITH b AS (SELECT o_orderkey, o_orderkey % 4 AS m, list_transform(range(8), lambda i: (o_orderkey * (i + 3) * 7 + o_custkey * (i + 1) + i * 31) % 256) AS v FROM orders),
c AS (SELECT o_orderkey, m, unnest(range(CASE WHEN m = 3 OR o_orderkey % 11 = 0 THEN 0 ELSE 2 END)) AS p, v FROM b),
f AS (SELECT o_orderkey, m, p, v, list_transform(v, lambda x: CAST(x AS FLOAT) / CAST(255 AS FLOAT)) AS f FROM c),
r AS (SELECT o_orderkey, p, CASE m WHEN 0 THEN [v[p * 3 + 1], v[p * 3 + 2], v[p * 3 + 3]] WHEN 1 THEN [v[p + 1], v[p + 1], v[p + 1]]
  ELSE list_transform([1, 2, 3], lambda k: CAST(floor(CAST(255 AS FLOAT) * (CAST(1 AS FLOAT) - f[p * 4 + k]) * (CAST(1 AS FLOAT) - f[p * 4 + 4])) AS BIGINT)) END AS rgb FROM f)
SELECT o_orderkey, string_agg(format('{:02x}{:02x}{:02x}', rgb[1], rgb[2], rgb[3]), '' ORDER BY p) AS rgb FROM r GROUP BY o_orderkey UNION ALL SELECT o_orderkey, NULL FROM b WHERE m = 3 OR o_orderkey % 11 = 0"""


def images(s, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    text = F.concat(*[two((k * (i + 3) * 7 + c * (i + 1) + i * 31) % 256) for i in range(8)])
    # too few bytes, for any of the spaces
    cut = F.when(k % 11 == 0, F.substring(text, 1, 2)).otherwise(text)
    space = F.get(F.array(*[F.lit(x) for x in ("DeviceRGB", "DeviceGray", "DeviceCMYK", "Lab")]), (k % 4).cast("int"))
    return read(s, d, "orders").select("o_orderkey", F.unhex(cut).alias("content"), F.lit(2).alias("width"), F.lit(1).alias("height"), space.alias("space"))


@query("image_colours", PIXELS)
def _(s, d):
    return pixels.coloured(images(s, d), "o_orderkey").select("o_orderkey", F.lower(F.hex("rgb")).alias("rgb"))


# A grey image of one row, scaled down to half its width by a triangle: each pixel has the weights 1, 3, 3, 1 of its neighbours.
TENSORS = """WITH v AS (SELECT p_partkey, list_transform(range(8), lambda i: (p_partkey * (i + 5) + p_size * i * i) % 256) AS v FROM part),
w AS (SELECT p_partkey, v, x, list_filter([x * 2 - 1, x * 2, x * 2 + 1, x * 2 + 2], lambda i: i BETWEEN 0 AND 7) AS near FROM v, range(4) r(x)),
g AS (SELECT p_partkey, x, list_sum(list_transform(near, lambda i: v[i + 1] * CASE WHEN i IN (x * 2, x * 2 + 1) THEN 3.0 ELSE 1.0 END)) / list_sum(list_transform(near, lambda i: CASE WHEN i IN (x * 2, x * 2 + 1) THEN 3.0 ELSE 1.0 END)) AS grey FROM w),
b AS (SELECT p_partkey, x, floor(grey + 0.5) / 255.0 AS y FROM g)
SELECT p_partkey, CAST(0.5 AS DOUBLE) AS scale_w, round(sum((y - 0.485) / 0.229) * 4, 1) AS red, round(sum((y - 0.456) / 0.224) * 4, 1) AS green, round(sum((y - 0.406) / 0.225) * 4, 1) AS blue FROM b GROUP BY p_partkey"""


@query("model_input_tensors", TENSORS)
def _(s, d):
    k, z = F.col("p_partkey"), F.col("p_size").cast("long")
    row = F.unhex(F.concat(*[two((k * (i + 5) + z * i * i) % 256) for i in range(8)]))
    grey = spread(read(s, d, "part").select("p_partkey", "p_size")).select("p_partkey", row.alias("content"), F.lit(8).alias("width"), F.lit(1).alias("height"), F.lit("DeviceGray").alias("space"))
    made = pixels.model_inputs(grey, "p_partkey", 4)
    return sums_of(made)


def sums_of(made):
    """The sums of each channel's values."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.frombuffer(b"".join(batch.column("tensor").to_pylist()), "<f4")  # all of one length
            sums = x.reshape(batch.num_rows, 3, -1).astype(np.float64).sum(axis=2)
            scale = pa.array(batch.column("scale_w").to_numpy().astype(np.float64))
            yield pa.RecordBatch.from_arrays([batch.column("p_partkey"), scale, *(pa.array(np.round(sums[:, i], 1)) for i in range(3))], ["p_partkey", "scale_w", "red", "green", "blue"])

    return made.mapInArrow(run, "p_partkey long, scale_w double, red double, green double, blue double")


ANSWERS = """SELECT doc_id, CASE WHEN w % 5 <> 0 AND w % 7 <> 3 THEN 'offline: ' || array_to_string(list_filter(string_split(regexp_replace('ask ' || source || ' ' || doc_id || ' is one of many', '\\s+', ' ', 'g'), ' '), lambda x: x <> '')[1:5], ' ') || '!' END AS answer,
  CASE WHEN w % 5 = 0 THEN 'cancelled' WHEN w % 7 = 3 THEN 'failed: no answer' ELSE 'answered' END AS outcome FROM (SELECT *, doc_id AS w FROM documents)"""


@query("model_answers", ANSWERS)
def _(s, d):
    k = F.col("doc_id")

    def client():
        def call(given):
            if int(given["user_prompt"].split()[2]) % 7 == 3:
                raise ValueError("no answer")
            return model_calls.offline(given)

        return call

    def cancelling(call):
        return None if int(call["user_prompt"].split()[1]) % 5 == 0 else call

    def asking(call):
        return call | {"user_prompt": "ask " + call["user_prompt"]}

    def failing(call):
        raise ValueError("this hook is passed over")

    hooks = model_calls.Interceptors([("a", cancelling), ("b", failing), ("me", failing), ("c", asking)], [("b", failing), ("c", lambda x: {"response": x["response"] + "!"})])
    prompts = read(s, d, "documents").select("doc_id", F.concat("source", F.lit(" "), k.cast("string"), F.lit(" is one of many")).alias("user_prompt"))
    return model_calls.answered(prompts, "doc_id", client, hooks, "me")


CLASSIFIED = """WITH c AS (SELECT conv_id, turn, conv_id % 4 AS m, turn, text FROM conversations)
SELECT conv_id, turn, CASE WHEN m < 2 THEN [turn, turn + 7] ELSE [turn, turn + 1] END AS pages, CASE WHEN m < 2 THEN [CASE WHEN turn % 3 = 0 THEN 'flowchart' WHEN turn % 3 = 1 THEN 'other' ELSE 'electrochemical' END, 'other'] ELSE ['other', 'other'] END AS categories,
  CASE WHEN m < 2 THEN [CASE WHEN m = 0 AND text <> '' THEN text ELSE '未命名图片' END, '未命名图片'] ELSE ['第' || (turn + 1) || '页的图片', '第' || (turn + 2) || '页的图片'] END AS captions FROM c"""


@query("classified_images", CLASSIFIED)
def _(s, d):
    t, m = F.col("turn"), F.col("conv_id") % 4
    kind = F.when(t % 3 == 0, "flowchart").when(t % 3 == 1, "chart").otherwise("electrochemical")
    one = F.struct(t.alias("pageIndex"), kind.alias("category"), F.when(m == 0, F.col("text")).alias("caption"))
    rest = F.concat(F.lit(', {"category": "flowchart"}, {"pageIndex": '), (t + 7).cast("string"), F.lit(', "caption": "", "category": 5}'))
    array = F.concat(F.lit("Sure:\n["), F.to_json(one), rest, F.lit("]\nDone."))
    answer = F.when(m < 2, array).when(m == 2, F.concat(F.lit("[ broken "), "text", F.lit(" ]"))).otherwise("none")
    found = model_calls.classified_images(answer, F.array(t, t + 1))
    return read(s, d, "conversations").select("conv_id", "turn", found.alias("x")).select("conv_id", "turn", F.col("x.page_index").alias("pages"), F.col("x.category").alias("categories"), F.col("x.caption").alias("captions"))


RANKINGS = """WITH p AS (SELECT p_partkey, p_brand, CASE WHEN p_partkey % 13 = 0 THEN '!?' WHEN p_partkey % 3 = 0 THEN p_name || '.' ELSE p_name END AS journal, CASE WHEN p_partkey % 4 = 0 THEN 4 ELSE CAST(p_size % 4 + 1 AS INTEGER) END AS zone, CASE WHEN p_partkey % 5 = 0 THEN true ELSE false END AS is_top FROM part),
n AS (SELECT *, trim(regexp_replace(regexp_replace(lower(replace(journal, '&', ' and ')), '[^a-z0-9]+', ' ', 'g'), '\\s+', ' ', 'g')) AS norm FROM p)
SELECT p_brand, norm AS journal_norm, journal, zone, is_top, false AS is_oa FROM n WHERE norm <> '' QUALIFY row_number() OVER (PARTITION BY p_brand, norm ORDER BY p_partkey) = 1"""


@query("rankings_from_files", RANKINGS)
def _(s, d):
    """A JSON file of rankings for each brand, written and read again."""
    k = F.col("p_partkey")
    journal = F.when(k % 13 == 0, "!?").when(k % 3 == 0, F.concat("p_name", F.lit("."))).otherwise(F.col("p_name"))
    zone = F.when(k % 4 != 0, F.col("p_size") % 4 + 1)
    entry = F.struct(k.alias("ord"), F.to_json(F.struct(journal.alias("journal"), zone.alias("zone"), F.when(k % 5 == 0, F.lit(True)).alias("is_top"))).alias("j"))
    files = read(s, d, "part").groupBy("p_brand").agg(F.concat(F.lit("[\n"), F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["j"]), ",\n"), F.lit("]")).alias("text"))
    folder = working_dir(s, "rankings")
    sidecars.written(files, "p_brand", F.col("text"), folder)
    return records.rankings_read(s, folder, "p_brand")


PATCHED = """WITH c AS (SELECT DISTINCT * FROM clicks WHERE client_id IS NOT NULL AND ts IS NOT NULL), u AS (SELECT click_id, kind, CASE WHEN click_id % 6 = 0 THEN '{broken' WHEN click_id % 6 = 1 THEN '[1]' WHEN click_id % 6 = 2 THEN '{"authors":null,"doi":"","title":false}' ELSE replace(replace(replace(props, '"k"', '"title"'), '"device"', '"journal"'), '"tags"', '"authors"') END AS u FROM c WHERE click_id % 7 <> 0),
j AS (SELECT click_id, CASE WHEN json_valid(u) THEN CAST(u AS JSON) END AS j FROM u), v AS (SELECT click_id, [CASE json_type(j, '$.' || f) WHEN 'VARCHAR' THEN json_extract_string(j, '$.' || f) WHEN 'NULL' THEN NULL ELSE CAST(json_extract(j, '$.' || f) AS VARCHAR) END FOR f IN ['title', 'authors', 'journal', 'doi']] AS v FROM j)
SELECT c.click_id, coalesce(v[1], 'own') AS title, coalesce(v[2], CASE WHEN c.click_id % 2 = 0 THEN 'A' END) AS authors, coalesce(v[3], kind) AS journal, coalesce(v[4], '10.1/x') AS doi, 7 AS volume FROM c LEFT JOIN v USING (click_id)"""


@query("paper_patch_json", PATCHED)
def _(s, d):
    c, k = clicks(s, d), F.col("click_id")
    rows = c.select("click_id", F.lit("own").alias("title"), F.when(k % 2 == 0, "A").alias("authors"), F.col("kind").alias("journal"), F.lit("10.1/x").alias("doi"), F.lit(7).alias("volume"))
    props = F.col("props")
    for a, b in (("k", "title"), ("device", "journal"), ("tags", "authors")):
        props = F.replace(props, F.lit(f'"{a}"'), F.lit(f'"{b}"'))
    update = F.when(k % 6 == 0, "{broken").when(k % 6 == 1, "[1]").when(k % 6 == 2, '{"authors":null,"doi":"","title":false}').otherwise(props)
    return store.patch_json(rows, c.where(k % 7 != 0).select("click_id", update.alias("update")), "click_id")


BOXES = """WITH b AS (SELECT l_orderkey AS file_id, l_linenumber // 4 AS page_index, l_partkey * 100000 + l_suppkey * 10 + l_linenumber AS box_ord, l_partkey % 25 AS cls_id, l_discount * 10 AS score, l_suppkey % 3 AS read_order FROM lineitem) """


def model_boxes(s, d):
    n = F.col("l_linenumber")
    page = F.floor(n / 4).cast("long")
    return read(s, d, "lineitem").select(F.col("l_orderkey").alias("file_id"), page.alias("page_index"), (F.col("l_partkey") * 100000 + F.col("l_suppkey") * 10 + n).alias("box_ord"), (F.col("l_partkey") % 25).alias("cls_id"), (F.col("l_discount") * 10).alias("score"), (F.col("l_suppkey") % 3).alias("read_order"))


@query("layout_boxes", BOXES + "SELECT *, CAST(row_number() OVER (PARTITION BY file_id, page_index ORDER BY read_order, box_ord) - 1 AS INTEGER) AS place FROM b WHERE score > 0.5")
def _(s, d):
    return layout.inferred(model_boxes(s, d))


@query("visual_boxes", BOXES + "SELECT file_id, box_ord FROM b WHERE cls_id IN (3, 5, 9, 13, 14, 15, 20, 21)")
def _(s, d):
    return layout.visual(model_boxes(s, d)).select("file_id", "box_ord")


@query("text_previews", "SELECT doc_id, CASE WHEN length(text) > 600 THEN substr(text, 1, 600) || '…' ELSE text END AS preview, length(substr(text, 1, 30000)) AS prompt_length, md5(substr(text, 1, 30000)) AS prompt_md5 FROM documents")
def _(s, d):
    prompt = text.prompt_text(F.col("text"))
    return read(s, d, "documents").select("doc_id", text.preview(F.col("text")).alias("preview"), F.length(prompt).cast("long").alias("prompt_length"), F.md5(prompt).alias("prompt_md5"))
