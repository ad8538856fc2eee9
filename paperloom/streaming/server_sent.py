"""Server-sent events of a model's answer: text arrives in chunks that are cut anywhere.

A chunk may end within a line; what is left over waits for the next one, and a last line without an end is
never read. Lines that begin with ``data: `` carry JSON, of which the first choice's delta is taken; others
and broken JSON are passed over.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.folds import folded

PREFIX, DONE = "data: ", "[DONE]"
#: Fixed value: the note behind an answer that broke off.
BROKEN_OFF = "\n\n[流式输出中断]"


@dataclass
class Decoder:
    """What a stream's decoder keeps between chunks. ``stops``: the end mark ends the stream, and a line's
    prefix stands at its very beginning; else the mark is passed over, and lines are trimmed first."""

    stops: bool = False
    rest: str = ""
    found: int = 0
    over: bool = False

    def feed(self, chunk: str) -> list[str]:
        """The deltas of the lines that this chunk ends."""
        if self.over:
            return []
        *lines, self.rest = (self.rest + chunk).split("\n")
        out = []
        for line in lines:
            line = line if self.stops else line.strip()
            if not line.startswith(PREFIX):
                continue
            data = line[len(PREFIX) :].strip()
            if data == DONE:
                if self.stops:
                    self.over = True
                    break
                continue
            delta = self.delta(data)
            if delta:
                out.append(delta)
        self.found += len(out)
        return out

    @staticmethod
    def delta(data: str) -> str | None:
        try:
            content = json.loads(data)["choices"][0]["delta"]["content"]
        except (ValueError, KeyError, IndexError, TypeError):
            return None
        return content if isinstance(content, str) else None


def deltas(chunks: DataFrame, stream: str = "stream_id", order: list[str] | None = None, chunk: str = "chunk", stops: bool = False) -> DataFrame:
    """The deltas of all streams: stream, ``no`` (from 0), ``delta``. Null chunks have nothing."""
    order = order or ["ord"]
    kind = chunks.schema[stream].dataType.simpleString()

    def step(decoder: Decoder, row: dict) -> list[tuple]:
        first = decoder.found
        return [(row[stream], first + i, d) for i, d in enumerate(decoder.feed(row["__chunk"] or ""))]

    given = chunks.select(*dict.fromkeys([stream, *order]), F.col(chunk).alias("__chunk"))
    return folded(given, [stream], order, lambda: Decoder(stops), step, f"`{stream}` {kind}, no int, delta string")


class Answer:
    """An answer so far, as its chunks come."""

    def __init__(self) -> None:
        self.decoder, self.text, self.broken = Decoder(), [], False

    def take(self, chunk: str | None) -> None:
        self.broken |= chunk is None
        if not self.broken:
            self.text += self.decoder.feed(chunk)

    def shown(self) -> str | None:
        text = "".join(self.text)
        return text if not self.broken else text + BROKEN_OFF if text else None


def answers(chunks: DataFrame, stream: str = "stream_id", order: list[str] | None = None, chunk: str = "chunk") -> DataFrame:
    """Each stream's whole answer: stream, ``answer``. A null chunk is a read that failed: what has come by
    then is the answer, with a note that it broke off, or null if nothing had come."""
    order = order or ["ord"]
    kind = chunks.schema[stream].dataType.simpleString()

    def step(answer: Answer, row: dict) -> list[tuple]:
        answer.take(row["__chunk"])
        return []

    given = chunks.select(*dict.fromkeys([stream, *order]), F.col(chunk).alias("__chunk"))
    return folded(given, [stream], order, Answer, step, f"`{stream}` {kind}, answer string", lambda key, a: [(*key, a.shown())])


class DecoderStates(StatefulProcessor):
    """``deltas`` over a stream of chunks numbered from 0: the line begun and the number of the chunk that is
    next go from micro-batch to micro-batch; chunks that come before their turn wait."""

    def __init__(self, stops: bool) -> None:
        self.stops = stops

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("decoder", "rest string, found int, over boolean, next long")
        self.early = handle.getListState("early", "ord long, chunk string")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        held = self.state.get()
        decoder, turn = (Decoder(self.stops, held[0], held[1], held[2]), held[3]) if held is not None else (Decoder(self.stops), 0)
        waiting = {r[0]: r[1] for r in self.early.get()}
        before = len(waiting)
        waiting |= {r.ord: r.chunk for r in rows if r.ord >= turn}
        out = []
        while turn in waiting:
            first = decoder.found
            out += [Row(stream_id=key[0], no=first + i, delta=d) for i, d in enumerate(decoder.feed(waiting.pop(turn) or ""))]
            turn += 1
        if waiting:
            self.early.put(list(waiting.items()))
        elif before:
            self.early.clear()
        self.state.update((decoder.rest, decoder.found, decoder.over, turn))
        return iter(out)

    def close(self) -> None:
        pass


def streamed_deltas(chunks: DataFrame, stops: bool = False) -> DataFrame:
    """The deltas of streaming chunks (stream_id, ord, chunk), as soon as their lines end: stream_id, no,
    delta. A chunk that comes again is passed over. Needs the RocksDB state store."""
    kind = chunks.schema["stream_id"].dataType.simpleString()
    given = chunks.select("stream_id", F.col("ord").cast("long").alias("ord"), "chunk")
    return given.groupBy("stream_id").transformWithState(DecoderStates(stops), f"stream_id {kind}, no int, delta string", "Append", "None")
