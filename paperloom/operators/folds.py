"""Ordered folds: state that each event of a key changes, where no window can say how.

Events are dealt by key and sorted; a task reads them as they come, from key to key, and holds the state of
one key only, never its events.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows of a batch that goes out.
OUT_ROWS = 4096


def folded(rows: DataFrame, keys: list[str], order: list[str], start: Callable[[], Any], step: Callable[[Any, dict], Iterator[tuple] | list[tuple]], schema: str, finish: Callable[[tuple, Any], list[tuple]] | None = None) -> DataFrame:
    """Walks each key's rows by ``order``. ``start`` makes a key's state, ``step`` changes it by a row and
    gives the tuples that go out, ``finish`` (key, state) gives the last ones. Null keys are a key too; rows
    that ``order`` leaves equal come in any order, so it should name a row."""
    out = to_arrow_schema(StructType.fromDDL(schema))

    def batch(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], f.type) for i, f in enumerate(out)], schema=out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, found = None, None, []
        for given in batches:
            names = given.schema.names
            for values in zip(*(c.to_pylist() for c in given.columns)):
                row = dict(zip(names, values))
                new = tuple(row[k] for k in keys)
                if new != key:
                    if key is not None and finish:
                        found += finish(key, state)
                    key, state = new, start()
                found += step(state, row)
                if len(found) >= OUT_ROWS:
                    yield batch(found)
                    found = []
        if key is not None and finish:
            found += finish(key, state)
        if found:
            yield batch(found)

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


# --- undo and redo --------------------------------------------------------------------------------

#: Earlier states that can be returned to.
UNDO_STATES = 101


class Drawing:
    """What a page shows, the states before it, and those undone."""

    def __init__(self) -> None:
        self.now: str | None = None
        self.before: list[str | None] = []
        self.undone: list[str | None] = []

    def edit(self, action: str | None, state: str | None, bound: int) -> None:
        if action == "push":
            self.before = [*self.before[-(bound - 1) :], self.now] if bound > 1 else [self.now]
            self.undone.clear()
            self.now = state
        elif action == "undo" and self.before:
            self.undone.append(self.now)
            self.now = self.before.pop()
        elif action == "redo" and self.undone:
            self.before.append(self.now)
            self.now = self.undone.pop()


def edit_history(edits: DataFrame, keys: list[str], order: list[str], action: str = "action", state: str = "state", bound: int = UNDO_STATES) -> DataFrame:
    """Each edit (push of a new state, undo, redo) with what its page shows after it: the keys, the order,
    ``shown``, and how many states can be undone and redone.

    A push keeps the ``bound`` last states before it and forgets what was undone; undo and redo without such a
    state, and other actions, change nothing. A page begins with no state (null)."""
    columns = list(dict.fromkeys([*keys, *order]))
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in edits.select(*columns).schema.fields]

    def step(page: Drawing, row: dict) -> list[tuple]:
        page.edit(row["__action"], row["__state"], bound)
        return [(*(row[c] for c in columns), page.now, len(page.before), len(page.undone))]

    given = edits.select(*columns, edits[action].cast("string").alias("__action"), edits[state].cast("string").alias("__state"))
    return folded(given, keys, order, Drawing, step, ", ".join([*kept, "shown string", "undos int", "redos int"]))


# --- the parser's queue ---------------------------------------------------------------------------


class Job:
    """The parse of a path: its status, whether it stands in the queue, and since which event."""

    def __init__(self) -> None:
        self.status: str | None = None
        self.queued_at: int | None = None
        self.accepted = self.refused = self.parsed = 0

    def move(self, event: str | None, at: Any) -> None:
        if event == "request":
            if self.queued_at is None and self.status not in ("done", "parsing"):
                self.status, self.queued_at = "pending", at
                self.accepted += 1
            else:
                self.refused += 1
        elif event == "priority":  # ahead of the queue, whatever was before
            self.status, self.queued_at = "parsing", None
        elif event == "take" and self.queued_at is not None:
            self.status, self.queued_at = "parsing", None
        elif event in ("done", "error") and self.status == "parsing":
            self.status = event
            self.parsed += event == "done"


def queue_status(events: DataFrame, path: str, order: str, event: str = "event") -> DataFrame:
    """Where each path stands after its events: path, status (pending, parsing, done, error, or null),
    queued_at (the ``order`` of the request that put it in the queue, in whose order the queue is taken), and
    how many requests were accepted and refused, and parses done.

    A request is refused while the path stands in the queue, is being parsed, or is done; an error may be
    asked for again. ``take`` is the worker's, ``priority`` parses at once and leaves the queue. Only paths
    that end in .pdf, in either case, are looked at; events that don't fit the status change nothing."""
    from pyspark.sql import functions as F

    given = events.where(F.lower(F.col(path)).endswith(".pdf")).select(F.col(path).alias("path"), F.col(order).cast("long").alias("at"), F.col(event).alias("event"))

    def step(job: Job, row: dict) -> list[tuple]:
        job.move(row["event"], row["at"])
        return []

    return folded(given, ["path"], ["at"], Job, step, "path string, status string, queued_at long, accepted long, refused long, parsed long", lambda key, job: [(*key, job.status, job.queued_at, job.accepted, job.refused, job.parsed)])


# --- writes within a quota ------------------------------------------------------------------------


class Shelf:
    """The lengths of an owner's values by key, and their sum."""

    def __init__(self) -> None:
        self.sizes: dict[str | None, int] = {}
        self.total = 0

    def put(self, key: str | None, length: int | None, size: int | None, quota: int) -> tuple[int, bool]:
        own = self.sizes.get(key, 0)
        others = self.total - own
        if length is None:  # a deletion
            self.sizes.pop(key, None)
            self.total = others
            return others, True
        if others + size > quota:
            return others, False
        self.sizes[key] = length
        self.total = others + length
        return others, True


def quota_series(writes: DataFrame, owner: str, key: str, value: str, order: list[str], quota: int = 5 << 20) -> DataFrame:
    """A series of writes, each checked against what its owner holds by then: owner, key, the order, ``used``
    (characters of the owner's other values), ``accepted``.

    A refused write leaves the old value and counts for nothing later; a null value deletes the key, which is
    always accepted. As stored, values count by characters, the new one by bytes. Only lengths travel and are
    held, not the values: a number for each key of one owner."""
    from pyspark.sql import functions as F

    columns = list(dict.fromkeys([owner, key, *order]))
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in writes.select(*columns).schema.fields]
    given = writes.select(*columns, F.length(value).cast("long").alias("__length"), F.octet_length(value).cast("long").alias("__size"))

    def step(shelf: Shelf, row: dict) -> list[tuple]:
        return [(*(row[c] for c in columns), *shelf.put(row[key], row["__length"], row["__size"], quota))]

    return folded(given, [owner], order, Shelf, step, ", ".join([*kept, "used long", "accepted boolean"]))
