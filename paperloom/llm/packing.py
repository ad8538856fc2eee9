"""Packing of tokenised documents into training sequences by first-fit decreasing."""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.taskcontext import TaskContext
from pyspark.sql import functions as F

from .common import slices, stored, table, tidy

#: Characters beyond which a text goes to the tokenizer as it is (fixed values).
PLAIN = re.compile("[^\t-\r -~À-ÖØ-öø-ÿ]")
#: The tokenizer's words, on lower-case plain text without white space (fixed value).
WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
SPECIAL = "<|"
LAST = "</w>"


def byte_alphabet() -> dict[str, int]:
    """The public byte-level alphabet: printable Latin-1 stands for itself, other bytes for 256 and up."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class WordTokens(dict):
    """Ids of a chunk between white space, as little-endian unsigned 32-bit bytes.

    A word's ids come from a byte-pair encoder over a private alphabet, in which a letter that
    ends a word is a byte of its own; its ranks are the tokenizer's ids. Texts with other than
    plain characters go to the tokenizer itself. Up to ``limit`` chunks are remembered.
    """

    def __init__(self, path: str, limit: int = 100_000) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        plain = [b for b in range(33, 127) if not 65 <= b <= 90] + [*range(0x9F, 0xC0)]
        inner = {b: i for i, b in enumerate([*plain, 0xC3])}
        final = {b: len(inner) + i for i, b in enumerate(plain)}
        self.inner = bytes(inner.get(b, 255) for b in range(256))
        self.final = bytes(final.get(b, 255) for b in range(256))
        alphabet, ranks = byte_alphabet(), {}
        for token, number in self.tokenizer.get_vocab(with_added_tokens=False).items():
            raw = [alphabet.get(c, 0) for c in token.removesuffix(LAST)]
            if raw and all(b in inner for b in raw):
                if not token.endswith(LAST):
                    ranks[bytes(inner[b] for b in raw)] = number
                elif raw[-1] in final:
                    ranks[bytes([*(inner[b] for b in raw[:-1]), final[raw[-1]]])] = number
        self.encoder = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe

    def word(self, word: str) -> list[int]:
        raw = word.encode()
        return self.encoder.encode_single_piece(raw[:-1].translate(self.inner) + raw[-1:].translate(self.final))

    def __missing__(self, chunk: str) -> bytes:
        ids = array("I")
        for w in WORDS.findall(chunk):
            ids.extend(self.word(w))
        self[chunk] = out = ids.tobytes()
        return out

    def ids(self, text: str | None) -> bytes:
        """The ids of a whole text, as the tokenizer gives them."""
        if not text:
            return b""
        if PLAIN.search(text) or SPECIAL in text:
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        if len(self) > self.limit:
            self.clear()
        return b"".join(map(self.__getitem__, text.lower().split()))


HELD: dict[str, WordTokens] = {}


def word_tokens(path: str) -> WordTokens:
    if path not in HELD:
        HELD[path] = WordTokens(path)
    return HELD[path]


class CapacityTree:
    """Tournament tree over the free room of bins: the leftmost bin with room is found in log time."""

    def __init__(self, bins: int, capacity: int) -> None:
        self.size = 1 << max(0, bins - 1).bit_length()
        self.room = [capacity] * (2 * self.size)

    def place(self, length: int) -> tuple[int, int]:
        """Puts a piece into the first bin with room for it; returns the bin and its room before."""
        room, k = self.room, 1
        while k < self.size:
            k *= 2
            if room[k] < length:
                k += 1
        before = room[k]
        room[k] = before - length
        j = k // 2
        while j:
            best = room[2 * j] if room[2 * j] >= room[2 * j + 1] else room[2 * j + 1]
            if room[j] == best:
                break
            room[j] = best
            j //= 2
        return k - self.size, before


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece; the longest come first, ties in the given order."""
    order = np.argsort(-lengths, kind="stable")
    tree = CapacityTree(max(1, len(lengths)), capacity)
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i in order.tolist():
        b, before = tree.place(int(lengths[i]))
        bins[i], offsets[i] = b, capacity - before
    return bins, offsets


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, groups: int) -> DataFrame:
    """One row per piece: at most ``capacity`` ids each, all but a document's last full."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, row, task = word_tokens(tokenizer), 0, TaskContext.get().partitionId()
        tail = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for part in slices(batch, "text"):
                keys, out = part.column("doc_id"), []
                for i, text in enumerate(part.column("text").to_pylist()):
                    ids = held.ids(text) + tail
                    n = len(ids) // 4
                    group = zlib.crc32(b"%d %d %d" % (task, row, n)) % groups  # a random group, also for repeated rows
                    row += 1
                    for start in range(0, n, capacity):
                        piece = ids[4 * start : 4 * (start + capacity)]
                        out.append((i, start, len(piece) // 4, zlib.crc32(piece), n, group))
                columns = [np.array(c, np.int64) for c in zip(*out)]
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(columns[0])), *map(pa.array, columns[1:])], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "grp"])
        held.clear()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(tidy(run), f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, grp long")


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 1, group_rows: int = 8192) -> DataFrame:
    """Packs all documents (doc_id, text) into sequences of at most ``capacity`` ids.

    A document is its ids and then ``end_id``; it is cut only where it is longer than a
    sequence. Documents are dealt at random into groups of about ``group_rows``, and each group
    is packed on its own, longest piece first, each into the first sequence with room. Null and
    empty texts are the one end id; repeated rows are packed each; an empty table gives no rows.
    Result: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.
    """
    groups = max(1, docs.count() // group_rows)

    def packed(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["doc_id", "start", "doc_tokens", "ids_crc32"], kind="stable")
        bins, offsets = first_fit_decreasing(part.length.to_numpy(), capacity)
        return part.assign(sequence_id=bins * groups + int(key[0]), offset=offsets).drop(columns="grp")

    kind = docs.schema["doc_id"].dataType.simpleString()
    # written, so that a piece keeps its group when a lost executor's work is done again
    return stored(pieces(docs, tokenizer, capacity, end_id, groups), "pieces").groupBy("grp").applyInPandas(packed, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` in sequences of at most 2048 ids; see ``pack``."""
    return pack(table(spark, sf_dir, "documents"), tokenizer_path())
