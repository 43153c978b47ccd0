"""Benchmark decontamination by Wu-Manber search over words.

The test strings are the windows of 13 consecutive words of the benchmark items; an item of fewer
words is one window. A document is read from the end of a window backwards in steps: a shift table
on blocks of two words says how far the next possible end of a window is, so most words are never
looked at. Where the shift is zero, the window's last and first blocks select the test strings
that can stand there, and comparing the words confirms them. Windows of one length share a table.

Items come to the tasks in blocks of at most ``BLOCK_BYTES`` of text; if there are more, the
documents pass through one search per block, which adds its finds to those of the one before. So a
task's memory is bounded by the block, whatever the size of the benchmark.

Defined results: a null or empty text has no words and is not contaminated; items without words
match nothing; an item without id counts under the empty id; rows of one item id are one item.
Repeated rows get equal results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 13
BLOCK_BYTES = 2_000_000
RESULTS = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
#: Every byte to itself where it is part of a word, upper-case ASCII to lower case, the rest to a space.
_WORDS = bytes(
    b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20
    for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(_WORDS).split() if text else []


class Search:
    """Shift and bucket tables of a block of items, one pair per window length."""

    def __init__(self, items: list[tuple[str, str]]):
        self.names = [name for name, _ in items]
        self.words = [words_of(text) for _, text in items]
        self.tables: dict[int, tuple[dict, dict]] = {}
        for item, words in enumerate(self.words):
            if not words:
                continue
            size = min(WINDOW, len(words))
            block = min(2, size)
            shifts, buckets = self.tables.setdefault(size, ({}, {}))
            for start in range(len(words) - size + 1):
                for end in range(block, size + 1):
                    key = tuple(words[start + end - block:start + end])
                    shifts[key] = min(shifts.get(key, size), size - end)
                ends = (tuple(words[start + size - block:start + size]), tuple(words[start:start + block]))
                buckets.setdefault(ends, []).append((item, start))

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Spans of words that are windows, and the names of their items."""
        spans: list[tuple[int, int]] = []
        names: set[str] = set()
        for size, (shifts, buckets) in self.tables.items():
            block = min(2, size)
            most, at, stop = size - block + 1, size, len(words)
            while at <= stop:
                key = (words[at - 2], words[at - 1]) if block == 2 else (words[at - 1],)
                step = shifts.get(key, most)
                if step:
                    at += step
                    continue
                begin = at - size
                window = None
                for item, start in buckets.get((key, tuple(words[begin:begin + block])), ()):
                    window = window or words[begin:at]
                    if self.words[item][start:start + size] == window:
                        names.add(self.names[item])
                        if not spans or spans[-1] != (begin, at):
                            spans.append((begin, at))
                at += 1
        return spans, names


def covered(spans: list[tuple[int, int]]) -> int:
    total = reach = 0
    for begin, end in sorted(spans):
        total += max(0, end - max(begin, reach))
        reach = max(reach, end)
    return total


_TABLES: dict[bytes, Search] = {}  # of the last block, one per worker process


def _search(items: list[tuple[str, str]]) -> Search:
    key = hashlib.sha256(repr(items).encode()).digest()
    if key not in _TABLES:
        _TABLES.clear()
        _TABLES[key] = Search(items)
    return _TABLES[key]


def _step(block, text: str, first: bool, last: bool):
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = _search(block.value)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                docs = batch.column("__doc")
                texts = docs.flatten()[docs.type.get_field_index(text)].to_pylist()
                before = [[]] * len(texts) if first else batch.column("__found").to_pylist()
                named = [[]] * len(texts) if first else batch.column("__names").to_pylist()
                rows = []
                for body, old, names in zip(texts, before, named):
                    words = words_of(body)
                    spans, more = search.find(words)
                    spans = [(s["begin"], s["end"]) for s in old] + spans
                    names = sorted(more.union(names))
                    if not last:
                        rows.append(([{"begin": b, "end": e} for b, e in spans], names))
                        continue
                    hit = covered(spans)
                    rows.append((len(words), hit, len(names), hashlib.sha256(",".join(names).encode()).hexdigest(),
                                 hit > 0 and 20 * hit >= len(words)))
                kinds = ([pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()] if last else
                         [pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())])), pa.list_(pa.string())])
                yield pa.RecordBatch.from_arrays(
                    [docs, *[pa.array(c, k) for c, k in zip(zip(*rows), kinds)]],
                    ["__doc", *(RESULTS if last else ["__found", "__names"])])
    return step


def blocks(items: DataFrame, key: str, text: str, limit: int) -> Iterator[tuple[list[tuple[str, str]], bool]]:
    """Items in blocks of about ``limit`` bytes of text, by hash, and whether it is the last; at
    least one block.

    The driver holds one block at a time: its size follows the limit, not the table.
    """
    named = items.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("name"),
                         F.coalesce(F.col(text), F.lit("")).alias("text")).distinct()
    total = named.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = max(1, ceil(total / limit))
    for k in range(count):
        part = named.where(F.pmod(F.xxhash64("name", "text"), F.lit(count)) == k)
        yield sorted(map(tuple, part.collect())), k == count - 1


def mark(docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id",
         item_text: str = "text", limit: int = BLOCK_BYTES) -> DataFrame:
    """Every row with ``n_words``, ``n_hit``, ``n_items``, ``items_sha256`` and ``contaminated``.

    Own columns of these names are replaced, and kept under ``__doc`` as given.
    """
    found = docs.select(F.struct(*docs.columns).alias("__doc"))
    kind = found.schema["__doc"].dataType.simpleString()
    results = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
    for k, (block, last) in enumerate(blocks(items, item_key, item_text, limit)):
        schema = results if last else "__found array<struct<begin:int,end:int>>, __names array<string>"
        sent = docs.sparkSession.sparkContext.broadcast(block)
        found = found.mapInArrow(_step(sent, text, k == 0, last), f"__doc {kind}, {schema}")
    return found.select(*[F.col("__doc")[c].alias(c) for c in docs.columns if c not in RESULTS], *RESULTS, "__doc")


def drop_contaminated(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """The rows that are not contaminated, with their own columns."""
    return mark(docs, items, text).where(~F.col("contaminated")).select("__doc.*")
