"""Calls of a language model, a prompt a row, between interceptors."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as Late
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Call = dict[str, object]
# What a call has by default, and seconds that it may take.
DEFAULTS: Call = {"temperature": 0.7, "max_tokens": 4096}
SECONDS = 30.0
CATEGORIES = ["flowchart", "characterization", "electrochemical", "other"]
UNNAMED = "未命名图片"

log = logging.getLogger(__name__)


def passed_over(owner: str, when: str) -> None:
    log.debug("a hook of %s %s the call failed", owner, when, exc_info=True)


def offline(call: Call) -> str:
    """A client that needs no network: the first words of the prompt."""
    return "offline: " + " ".join(str(call["user_prompt"]).split()[:5])


@dataclass
class Interceptors:
    """Hooks around a call, by their owner. One before may change the call, or cancel it by None; one after may
    change parts of the answer. A caller's own hooks are passed over, and so is one that fails."""

    before: list[tuple[str, Callable[[Call], Call | None]]] = field(default_factory=list)
    after: list[tuple[str, Callable[[Call], Call | None]]] = field(default_factory=list)

    def ready(self, call: Call, caller: str) -> Call | None:
        for owner, hook in self.before:
            if owner != caller:
                try:
                    call = hook(call)
                except Exception:
                    passed_over(owner, "before")
                if call is None:
                    return None
        return call

    def done(self, answer: Call, caller: str) -> Call:
        for owner, hook in self.after:
            if owner != caller:
                try:
                    answer = answer | (hook(answer) or {})
                except Exception:
                    passed_over(owner, "after")
        return answer


def answered(prompts: DataFrame, key: str, client: Callable[[], Callable[[Call], str]] = lambda: offline, hooks: Interceptors | None = None, caller: str = "", system_prompt: str = "", seconds: float = SECONDS, at_once: int = 4) -> DataFrame:
    """The model's answers to prompts (key, user_prompt): key, answer, outcome.

    ``client`` is called once a task and gives what is called with each prompt. The outcome is ``answered``,
    ``cancelled`` (by a hook), ``late`` (no answer within ``seconds`` from the call's start) or ``failed: ...``; only the
    first has an answer. Null prompts are not sent (``cancelled``). ``at_once`` calls of a task run together,
    and no more prompts than that are held."""
    kind = prompts.schema[key].dataType.simpleString()
    hooks = hooks or Interceptors()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = client()

        def one(prompt: str | None) -> tuple[str | None, str]:
            given = None if prompt is None else hooks.ready({"system_prompt": system_prompt, "user_prompt": prompt} | DEFAULTS, caller)
            if given is None:
                return None, "cancelled"
            own = ThreadPoolExecutor(1)  # so that a call that hangs holds up no other
            try:
                answer = own.submit(call, given).result(seconds)
            except Late:
                return None, "late"
            except Exception as problem:
                return None, f"failed: {problem}"
            finally:
                own.shutdown(wait=False, cancel_futures=True)
            return str(hooks.done({"request": given, "response": answer}, caller)["response"]), "answered"

        with ThreadPoolExecutor(at_once) as pool:
            for batch in batches:
                for a in range(0, batch.num_rows, at_once):
                    some = batch.slice(a, at_once)
                    found = list(pool.map(one, some.column("user_prompt").to_pylist()))
                    yield pa.RecordBatch.from_arrays([some.column(key), *(pa.array([x[i] for x in found], pa.string()) for i in (0, 1))], [key, "answer", "outcome"])

    return prompts.select(key, "user_prompt").mapInArrow(run, f"`{key}` {kind}, answer string, outcome string")


def classified_images(answer: Column, pages: Column) -> Column:
    """What a model's answer says of the images on ``pages`` (an array of page indices): an array of
    page_index, category, caption.

    The answer's text from its first to its last square bracket is read as JSON (its first whole value, if
    text follows that between the brackets); items without pageIndex are left out, an unknown category is ``other``, and a missing or empty caption is a fixed one. Without such an
    array every image is ``other``, captioned by its page."""
    # null where there is no array, or no JSON
    items = F.try_variant_get(F.try_parse_json(F.nullif(F.regexp_extract(answer, r"(?s)\[.*\]", 0), F.lit(""))), "$", "array<variant>")
    item = "struct<page_index:bigint,category:string,caption:string>"
    named = lambda x: F.struct(
        F.try_variant_get(x, "$.pageIndex", "bigint").alias("page_index"),
        F.when(F.try_variant_get(x, "$.category", "string").isin(CATEGORIES), F.try_variant_get(x, "$.category", "string")).otherwise("other").alias("category"),
        F.coalesce(F.nullif(F.try_variant_get(x, "$.caption", "string"), F.lit("")), F.lit(UNNAMED)).alias("caption"),
    )
    known = F.transform(F.filter(items, lambda x: F.try_variant_get(x, "$.pageIndex", "variant").isNotNull()), named).cast(f"array<{item}>")
    plain = F.transform(pages, lambda p: F.struct(p.cast("bigint").alias("page_index"), F.lit("other").alias("category"), F.concat(F.lit("第"), (p + 1).cast("string"), F.lit("页的图片")).alias("caption"))).cast(f"array<{item}>")
    return F.coalesce(known, plain)
