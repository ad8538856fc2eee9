"""State that events change: against plain walks, in batch and as streams of several micro-batches."""

import json
import random
from datetime import datetime, timedelta

import pytest

from paperloom.operators import folds
from paperloom.streaming import reading_states, server_sent

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
START = datetime(2024, 3, 1, 23, 59, 40)


def streamed(spark, run, schema, parts, folder):
    """The rows that a streaming query gives for parts that arrive one after another."""
    (folder / "in").mkdir(parents=True)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        for i, part in enumerate(parts):
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(folder / "in"))
            out = run(spark.readStream.schema(schema).parquet(str(folder / "in")))
            q = out.writeStream.format("parquet").option("path", str(folder / "out")).option("checkpointLocation", str(folder / "state")).outputMode("append").trigger(availableNow=True).start()
            q.awaitTermination()
        return spark.read.parquet(str(folder / "out")).collect()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


EVENTS = "user_id long, ts timestamp, ord long, kind string, paper_id string"


def window_log(seed, users=4, n=120):
    r, rows, now = random.Random(seed), [], START
    for i in range(n):
        now += timedelta(seconds=r.choice([0, 1, 4, 5, 30, 4000]), microseconds=r.choice([0, 1, 999_999]))
        kind = r.choice(["open", "open", "blur", "focus", "close", "scroll"])
        rows.append((r.randrange(users), now, i, kind, r.choice(["p1", "p2", None]) if kind == "open" else None))
    return rows


def walked(rows):
    """A plain walk over all events in order."""
    current, tab, out = {}, {}, []
    for user, ts, _, kind, paper in sorted(rows, key=lambda r: (r[1], r[2])):
        if kind in ("open", "blur", "close"):
            begun = current.pop(user, None)
            if begun and int((ts - begun[1]).total_seconds()) >= 5:
                out.append((user, begun[0], begun[1], ts, int((ts - begun[1]).total_seconds())))
        if kind == "open":
            tab[user] = paper
        elif kind == "close":
            tab[user] = None
        if kind in ("open", "focus") and tab.get(user):
            current[user] = (tab[user], ts)
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_sessions_by_events(spark, seed):
    rows = window_log(seed)
    got = reading_states.sessions_by_events(spark.createDataFrame(rows, EVENTS))
    assert sorted(map(tuple, got.collect())) == walked(rows) != []


def test_sessions_golden(spark):
    at = lambda s: START + timedelta(seconds=s)
    rows = [
        (1, at(0), 0, "open", "p1"), (1, at(10), 1, "open", None), (1, at(20), 2, "focus", None),  # 10 s of p1; no reader's tab is open
        (2, at(0), 3, "open", "p1"), (2, at(4), 4, "blur", None), (2, at(60), 5, "focus", None), (2, at(70), 6, "focus", None), (2, at(90), 7, "close", None), (2, at(99), 8, "focus", None),  # 4 s; 20 s since the last focus
        (3, at(0), 9, "open", "p1"), (None, at(0), 10, "open", "p1"), (3, None, 11, "blur", None),  # still open
    ]
    got = sorted(map(tuple, reading_states.sessions_by_events(spark.createDataFrame(rows, EVENTS)).collect()))
    assert got == [(1, "p1", at(0), at(10), 10), (2, "p1", at(70), at(90), 20)]
    assert reading_states.sessions_by_events(spark.createDataFrame([], EVENTS)).count() == 0


def test_sessions_of_a_stream(spark, tmp_path):
    rows = window_log(7)
    last = max(r[1] for r in rows)
    r = random.Random(1)
    parts = [rows[a : a + 40] for a in range(0, len(rows), 40)]
    for p in parts:
        r.shuffle(p)  # within the watermark's delay they may come in any order
    swapped = parts[0][:-3] + parts[1][:3], parts[0][-3:] + parts[1][3:], parts[2], [(0, last + timedelta(days=2), 999, "scroll", None), (99, last + timedelta(days=2), 1000, "blur", None)]
    got = streamed(spark, lambda e: reading_states.streamed_sessions(e, "30 hours"), EVENTS, swapped, tmp_path)
    assert sorted(map(tuple, got)) == walked(rows) != []


def test_history_is_a_plain_walk(spark):
    r, rows = random.Random(3), []
    for page in ("a", None):
        rows += [(page, i, r.choice(["push"] * 5 + ["undo"] * 2 + ["redo", "other"]), f"s{i}") for i in range(400)]
    rows += [("b", i, "push", f"s{i}") for i in range(130)] + [("b", 130 + i, "undo", None) for i in range(120)]
    got = {(x[0], x[1]): (x.shown, x.undos, x.redos) for x in folds.edit_history(spark.createDataFrame(rows, "page string, ord int, action string, state string"), ["page"], ["ord"]).collect()}
    want = {}
    for page in ("a", "b", None):
        now, before, undone = None, [], []
        for _, i, action, state in [x for x in rows if x[0] == page]:
            if action == "push":
                before = before[-100:] + [now]
                undone, now = [], state
            elif action == "undo" and before:
                undone.append(now)
                now = before.pop()
            elif action == "redo" and undone:
                before.append(now)
                now = undone.pop()
            want[page, i] = (now, len(before), len(undone))
    assert got == want
    assert got["b", 129] == ("s129", 101, 0) and got["b", 249] == ("s28", 0, 101)  # the 102nd state back is gone


def test_history_golden(spark):
    rows = [(1, "push", "x"), (2, "push", "y"), (3, "undo", None), (4, "redo", None), (5, "undo", None), (6, "push", "z"), (7, "redo", None), (8, "undo", None), (9, "undo", None), (10, "undo", None)]
    got = folds.edit_history(spark.createDataFrame([(1, *r) for r in rows], "p int, ord int, action string, state string"), ["p"], ["ord"]).orderBy("ord").collect()
    assert [r.shown for r in got] == ["x", "y", "x", "y", "x", "z", "z", "x", None, None]


def test_queue_status(spark):
    events = "a.pdf request|a.pdf request|b.PDF request|a.pdf take|a.pdf request|a.pdf done|a.pdf request|c.txt request|b.PDF take|b.PDF error|b.PDF request|d.pdf done|e.pdf request|e.pdf priority|e.pdf take|e.pdf error|f.pdf take|a.pdf priority".split("|")
    df = spark.createDataFrame([(i, *e.split()) for i, e in enumerate(events)], "i long, path string, event string")
    got = {r.path: tuple(r)[1:] for r in folds.queue_status(df, "path", "i").collect()}
    assert got == {
        "a.pdf": ("parsing", None, 1, 3, 1), "b.PDF": ("pending", 10, 2, 0, 0), "d.pdf": (None, None, 0, 0, 0), "e.pdf": ("error", None, 1, 0, 0), "f.pdf": (None, None, 0, 0, 0),
    }


def test_quota_series(spark):
    r, rows = random.Random(5), []
    for i in range(600):
        rows.append((r.randrange(3), r.choice(["a", "b", "c", None]), i, None if r.random() < 0.1 else r.choice("xé织") * r.randrange(40)))
    got = {x.i: (x.used, x.accepted) for x in folds.quota_series(spark.createDataFrame(rows, "o int, k string, i int, v string"), "o", "k", "v", ["i"], 90).collect()}
    held, want = {}, {}
    for o, k, i, v in rows:
        mine = held.setdefault(o, {})
        used = sum(len(x) for key, x in mine.items() if key != k)
        ok = v is None or used + len(v.encode()) <= 90
        if v is None:
            mine.pop(k, None)
        elif ok:
            mine[k] = v
        want[i] = (used, ok)
    assert got == want and {True, False} == {x[1] for x in want.values()}


def sent(deltas, r):
    """A stream's text for some deltas, with other lines between them."""
    noise = ["", ": ping", "event: x", "data: [DONE]", "data: {", "data: null", 'data: {"choices": []}', "data:x"]
    lines = []
    for d in deltas:
        lines += r.sample(noise, r.randrange(3)) + ["data: " + json.dumps({"choices": [{"delta": {"content": d}}]}, ensure_ascii=r.random() < 0.5)]
    return "\r\n".join(lines) + "\n"


def cut(text, r):
    out = []
    while text:
        k = r.choice([1, 2, 7, 50])
        out.append(text[:k])
        text = text[k:]
    return out


CHUNKS = "stream_id long, ord long, chunk string"


def test_any_cut_gives_the_same_deltas(spark):
    r = random.Random(2)
    want = {s: [r.choice(["a", "织机", " \n ", 'q"', "data: x"]) for _ in range(9)] for s in range(5)}
    rows = [(s, i, c) for s, d in want.items() for i, c in enumerate(cut(sent(d, r), r))]
    got = server_sent.deltas(spark.createDataFrame(rows, CHUNKS)).orderBy("stream_id", "no").collect()
    assert {s: [x.delta for x in got if x.stream_id == s] for s in want} == want
    assert [x.no for x in got if x.stream_id == 0] == list(range(9))


def test_ends_of_streams(spark):
    line = lambda x: 'data: {"choices": [{"delta": {"content": "%s"}}]}' % x
    rows = [(1, 0, line("a") + "\n"), (1, 1, line("lost")), (2, 0, line("a") + "\ndata: [DONE]\n" + line("b") + "\n"), (3, 0, " " + line("c") + "\n"), (4, 0, line("d") + "\nda"), (4, 1, None), (4, 2, "ta"), (5, 0, None), (6, 0, "x")]
    df = spark.createDataFrame(rows, CHUNKS)
    every = lambda stops: sorted((r.stream_id, r.delta) for r in server_sent.deltas(df, stops=stops).collect())
    assert every(False) == [(1, "a"), (2, "a"), (2, "b"), (3, "c"), (4, "d")]
    assert every(True) == [(1, "a"), (2, "a"), (4, "d")]
    assert {r.stream_id: r.answer for r in server_sent.answers(df).collect()} == {1: "a", 2: "ab", 3: "c", 4: "d\n\n[流式输出中断]", 5: None, 6: ""}


def test_deltas_of_a_stream(spark, tmp_path):
    r = random.Random(4)
    want = {s: [f"{s}-{i} é" for i in range(8)] for s in range(4)}
    rows = [(s, i, c) for s, d in want.items() for i, c in enumerate(cut(sent(d, r), r))]
    parts = [[x for x in rows if x[1] % 60 < 30 and x[1] < 400], [x for x in rows if x[1] % 60 >= 30 or x[1] >= 400] + rows[:3]]  # out of turn, and some again
    got = sorted(streamed(spark, server_sent.streamed_deltas, CHUNKS, parts, tmp_path), key=lambda x: (x.stream_id, x.no))
    assert {s: [x.delta for x in got if x.stream_id == s] for s in want} == want
