"""Removal of repeated byte strings by bucket refinement over anchored suffixes.

A byte is removed if a string of ``length`` bytes that covers it also starts anywhere else, in
the same document or another one. Suffixes are put into buckets by a q-gram and the buckets are
refined by hashes of the bytes at later offsets. Unlike in bucket-pointer refinement nothing is
sorted and no bucket identifier of a later offset is looked up: most offsets have no entry.

* Not every offset enters. Each window of ``length`` bytes is filed under its anchor, the q-gram
  in it with the smallest hash. Equal windows have equal anchors at equal places, so a window is
  known by its anchor and its offset ``d`` = anchor - start, and windows in a row share one entry.
* An entry stands for a range of offsets of a fixed grid. Its bucket identifier names the bytes
  that all windows of the grid cell share: at first the q-gram itself. Entries alone in their
  bucket are unique and leave. Entries that agree in all their bytes are repeated as a whole; one
  of them goes on with the rest of its bucket.
* The rest is refined: the cell is cut into smaller cells, whose identifiers are made from the
  parent's identifier and the bytes at the offsets that the smaller cell adds. New identifiers
  are the input of the next level, down to single windows, where the bucket is the answer.

Each level counts buckets with map-side combination and joins the counts back, which Spark splits
where a bucket is hot; no bucket is gathered in one task, and entries carry at most the few bytes
beside their shared core. Identifiers are 64-bit hashes chained over the levels, and "repeated"
compares a second, independent 64-bit hash inside the bucket.

Passages of ``words`` words are found the same way: a text is then the row of its words' 64-bit
hashes, and windows, anchors and offsets count words. White space between the words does not
matter there, but is removed with them.

Defined results: a null text is empty; rows equal in id and text are two documents, so their
strings are repeated and each row gets the same result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from muster.functions.ranking import aggregate_apart
from muster.llm.common import row_keys
from muster.session import cut_lineage

KEYS = ["key_a", "key_b"]
_PLACE = [("anchor", pa.int32()), ("near", pa.int32()), ("far", pa.int32())]
_BUCKET = [("bucket", pa.int64()), ("same", pa.int64()), ("n", pa.int32())]
_SCHEMA_KEYS = [("key_a", pa.int64()), ("key_b", pa.int64())]
_ROOTS = pa.schema([*_SCHEMA_KEYS, *_PLACE, *_BUCKET])
_CELLS = pa.schema([*_SCHEMA_KEYS, *_PLACE, ("cell", pa.int32()), *_BUCKET,
                    ("left", pa.binary()), ("right", pa.binary())])
_FIRST_CELLS = _CELLS.append(pa.field("in_words", pa.bool_()))
_SQL_KEYS = "key_a long, key_b long"
_SQL_PLACE = "anchor int, near int, far int"
_SQL_BUCKET = "bucket long, same long, n int"
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_FACTS = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"]
_CHUNK = 1 << 19  # bytes hashed at once: small enough for the processor's cache
_RANDOM = np.random.default_rng(5).integers(1 << 62, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15


class Kind(NamedTuple):
    """Strings of ``length`` bytes, or with ``words`` of so many words, anchored at q-grams of ``q``.

    ``steps`` are the sizes of the grid cells level by level; the last must be 1.
    """

    length: int = 400
    q: int = 64
    steps: tuple[int, ...] = (64, 8, 1)
    words: bool = False

    @property
    def reach(self) -> int:
        return self.length - self.q + 1

    @property
    def width(self) -> int:
        return 8 if self.words else 1


def passages_of(words: int) -> Kind:
    return Kind(words, 8, (8, 1), True)


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


class _Powers:
    """Powers of the odd base and of its inverse modulo 2^64, grown as needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 2 * _CHUNK)
            steps = np.full(n, _BASE, np.uint64)
            steps[0] = 1
            self.up = np.cumprod(steps)
            steps[1:] = pow(_BASE, -1, 1 << 64)
            self.down = np.cumprod(steps)
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def _word_codes(body: bytes) -> np.ndarray:
    words = body.split()
    return np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))


def anchored_runs(data: np.ndarray, ends: np.ndarray, length: int, q: int, most: int = 8 * _CHUNK):
    """Runs of windows with one anchor: ``(first start, last start, anchor)``, as arrays.

    ``data`` are bytes or 64-bit codes of words. ``ends`` are the ends of the texts laid end to end in it; windows stay inside a text. Very
    long data are read in blocks that overlap by a window: a run that a block cuts becomes two, which
    only means two entries instead of one.
    """
    parts = []
    for at in range(0, max(len(data) - length + 1, 1), most):
        to = min(len(data), at + most + length - 1)
        inner = np.unique(np.minimum(ends[ends > at], to) - at)
        parts.append([x + at for x in _runs_of_block(data[at:to], inner, length, q)])
    return tuple(np.concatenate(x) for x in zip(*parts))


def _runs_of_block(data: np.ndarray, ends: np.ndarray, length: int, q: int):
    n = len(data)
    if n < length:
        return (np.empty(0, np.int64),) * 3
    up, down = _POWERS.get(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((_RANDOM[data] if data.dtype == np.uint8 else data) * up[:n], out=sums[1:])
    grams = (sums[q:] - sums[:-q]) * down[:n - q + 1]
    grams ^= grams >> np.uint64(29)
    grams *= np.uint64(0xBF58476D1CE4E5B9)
    # the hash in the high bits, the place in the low ones: the smallest is the leftmost of equals
    least = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(n - q + 1, dtype=np.uint64)
    span, reach, last = length - q + 1, 1, n - length + 1
    while 2 * reach <= span:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    least = np.minimum(least[:last], least[span - reach:span - reach + last])
    anchors = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    starts = np.concatenate(([0], ends[:-1]))
    inside = np.zeros(n + 1, np.int64)
    fits = ends - starts >= length
    np.add.at(inside, starts[fits], 1)
    np.add.at(inside, ends[fits] - length + 1, -1)
    inside = np.cumsum(inside)[:last] > 0
    opens = inside.copy()
    opens[1:] &= (anchors[1:] != anchors[:-1]) | ~inside[:-1]
    opens[starts[fits]] = True
    first = np.flatnonzero(opens)
    closes = inside.copy()
    closes[:-1] &= opens[1:] | ~inside[1:]
    return first, np.flatnonzero(closes), anchors[first]


def _root_entries(length: int, q: int, width: int):
    """Texts to root entries. Entries of one text that agree in all bytes become one with ``n`` of 2,
    and those places are put out as repeated at once (bucket null): a text of one repeated
    letter has few entries that way."""
    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("text").cast(pa.large_binary())
            offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset:text.offset + len(text) + 1]
            body = text.buffers()[2]
            whole = np.frombuffer(body, np.uint8) if body else np.empty(0, np.uint8)
            view = memoryview(body) if body else b""
            at = 0
            while at < len(text):
                to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + _CHUNK, "right")) - 1)
                base, end = int(offsets[at]), int(offsets[to])
                if width == 1:
                    symbols, ends, raw = whole[base:end], offsets[at + 1:to + 1] - base, view[base:end]
                else:
                    codes = [_word_codes(bytes(view[a:b])) for a, b in zip(offsets[at:to], offsets[at + 1:to + 1])]
                    symbols, ends = np.concatenate(codes), np.cumsum([len(c) for c in codes])
                    raw = memoryview(symbols.tobytes())
                first, last, anchor = anchored_runs(symbols, ends, length, q)
                rows = np.searchsorted(ends, first, "right")
                found: dict[tuple[int, int, int], list[tuple[int, int, int]]] = {}
                starts = np.concatenate(([0], ends[:-1]))
                for row, lo, hi, spot in zip(rows.tolist(), first.tolist(), last.tolist(), anchor.tolist()):
                    bucket = xxh3_64_intdigest(raw[spot * width:(spot + q) * width])
                    same = xxh3_64_intdigest(raw[lo * width:(hi + length) * width], spot - lo)
                    found.setdefault((row, bucket, same), []).append((spot - int(starts[row]), spot - hi, spot - lo))
                out = [(row, *place, _signed(bucket), _signed(same), min(len(places), 2))
                       for (row, bucket, same), places in found.items() for place in places[:1]]
                out += [(row, *place, None, None, None)
                        for (row, _, _), places in found.items() if len(places) > 1 for place in places]
                if out:
                    columns = list(zip(*out))
                    at_row = pa.array(columns[0], pa.int64())
                    shared = batch.slice(at, to - at)
                    yield pa.RecordBatch.from_arrays(
                        [shared.column("key_a").take(at_row), shared.column("key_b").take(at_row),
                         *[pa.array(c, f.type) for c, f in zip(columns[1:], list(_ROOTS)[2:])]],
                        schema=_ROOTS)
                at = to
    return entries


def _cells(near: int, far: int, bucket: int, core: int, size: int, step: int, reach: int,
           left: bytes, right: bytes, width: int):
    """Children of an entry: cells of ``step`` offsets inside ``[core, core + size)``.

    ``left`` and ``right`` are the bytes beside the shared core, outwards to the entry's far and
    near ends; ``reach`` is the number of offsets in all, and an offset is ``width`` bytes.
    """
    seed = bucket & 0xFFFFFFFFFFFFFFFF
    top = min(core + size, reach)
    for low in range(near // step * step, far + 1, step):
        end = min(low + step, reach)
        lo, hi = max(near, low), min(far, end - 1)
        new_left = left[len(left) - (low - core) * width:] if low > core else b""
        new_right = right[:(top - end) * width]
        child = xxh3_64_intdigest(new_left, xxh3_64_intdigest(new_right, seed ^ low))
        rest_left = left[len(left) - (hi - core) * width:len(left) - (low - core) * width]
        rest_right = right[(top - end) * width:(top - 1 - lo) * width]
        same = xxh3_64_intdigest(rest_left, xxh3_64_intdigest(rest_right, (lo << 32) | hi))
        yield lo, hi, low, _signed(child), _signed(same), rest_left, rest_right


def _batch(rows: list[tuple], schema: pa.Schema = _CELLS) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(zip(*rows), schema)] if rows
        else [pa.array([], f.type) for f in schema], schema=schema)


def _first_cells(kinds: list[Kind]):
    """Root entries with their document's text to cells of the kind's first step."""
    by_words = {k.words: k for k in kinds}

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for key_a, key_b, text, entries in zip(
                    *[batch.column(c).to_pylist() for c in KEYS],
                    batch.column("text").cast(pa.large_binary()), batch.column("entries").to_pylist()):
                raw = text.as_py() or b""
                bodies = {w: _word_codes(raw).tobytes() if w else raw for w in {e["in_words"] for e in entries}}
                for e in entries:
                    kind, body = by_words[e["in_words"]], bodies[e["in_words"]]
                    width, reach, step = kind.width, kind.reach, kind.steps[0]
                    spot, near, far = e["anchor"], e["near"], e["far"]
                    left = body[(spot - far) * width:spot * width]
                    right = body[(spot + kind.q) * width:(spot + kind.length - near) * width]
                    for lo, hi, low, bucket, same, more, less in _cells(
                            near, far, e["bucket"], 0, reach, step, reach, left, right, width):
                        rows.append((key_a, key_b, spot, lo, hi, low, bucket, same, e["n"], more, less, kind.words))
                if len(rows) >= 20_000:
                    yield _batch(rows, _FIRST_CELLS)
                    rows = []
            yield _batch(rows, _FIRST_CELLS)
    return cells


def _finer_cells(size: int, step: int, reach: int, width: int):
    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key_a, key_b, spot, near, far, core, bucket, _, n, left, right in zip(
                    *[batch.column(c).to_pylist() for c in _CELLS.names]):
                for lo, hi, low, child, same, more, less in _cells(
                        near, far, bucket, core, size, step, reach, left, right, width):
                    rows.append((key_a, key_b, spot, lo, hi, low, child, same, n, more, less))
                if len(rows) >= 20_000:
                    yield _batch(rows)
                    rows = []
            yield _batch(rows)
    return cells


def _settle(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries that are repeated as a whole, and entries to refine.

    To refine are entries in shared buckets that are not repeated as a whole, and, for them to
    meet, one of each set of equal entries in a bucket that holds different ones. Only one or
    several counts, so ``n`` stops at 2; entries of repeated rows are equal and become one.
    """
    shared = aggregate_apart(
        entries, ["bucket"], F.sum("n").alias("members"),
        (F.min("same") != F.max("same")).alias("mixed")).where("members > 1")
    live = entries.join(shared.select("bucket", "mixed"), "bucket").withColumn(
        "name", F.xxhash64(*KEYS, "anchor", "near", "far"))
    whole = aggregate_apart(live, ["bucket", "same"], F.least(F.sum("n"), F.lit(2)).cast("int").alias("copies"),
                            F.min("name").alias("first")).where("copies > 1")
    marked = cut_lineage(live.join(whole, ["bucket", "same"], "left"))
    alone = marked.where("mixed and copies is null").select(*entries.columns)
    chosen = marked.where("mixed and name = first").withColumn("n", F.col("copies")).select(*entries.columns)
    return marked.where("copies is not null"), alone.union(chosen.distinct())


def repeated_spans(docs: DataFrame, text: str, kinds: list[Kind]) -> DataFrame:
    """``(key_a, key_b, begin, end, in_words)``: ranges to remove, which may touch and overlap; of words if
    ``in_words``, else of bytes.

    ``docs`` carries the row keys. One kind each in bytes and in words at most: the texts move once for both.
    """
    source = docs.select(*KEYS, F.col(text).alias("text"))
    place, found, waiting = [*KEYS, "anchor", "near", "far"], [], []

    def repeated(entries: DataFrame, kind: Kind) -> None:
        found.append(entries.select(
            *KEYS, (F.col("anchor") - F.col("far")).alias("begin"),
            (F.col("anchor") - F.col("near") + kind.length).alias("end"), F.lit(kind.words).alias("in_words")))

    for kind in kinds:
        least = 2 * kind.length - 1 if kind.words else kind.length
        roots = cut_lineage(source.where(F.octet_length("text") >= least).mapInArrow(
            _root_entries(kind.length, kind.q, kind.width), f"{_SQL_KEYS}, {_SQL_PLACE}, {_SQL_BUCKET}"))
        repeated(roots.where("bucket is null"), kind)
        whole, open_entries = _settle(roots.where("bucket is not null"))
        repeated(whole, kind)
        waiting.append(open_entries.select(*place, "bucket", "n", F.lit(kind.words).alias("in_words")))
    by_text = reduce(DataFrame.unionAll, waiting).groupBy(*KEYS).agg(F.collect_list(
        F.struct("anchor", "near", "far", "bucket", "n", "in_words")).alias("entries"))
    schema = f"{_SQL_KEYS}, {_SQL_PLACE}, cell int, {_SQL_BUCKET}, left binary, right binary"
    first = cut_lineage(source.join(by_text, KEYS).mapInArrow(_first_cells(kinds), f"{schema}, in_words boolean"))
    for kind in kinds:
        level = first.where(F.col("in_words") == kind.words).drop("in_words")
        for size, step in zip(kind.steps, kind.steps[1:]):
            whole, open_entries = _settle(level)
            repeated(whole, kind)
            level = cut_lineage(open_entries.mapInArrow(_finer_cells(size, step, kind.reach, kind.width), schema))
        # A cell of one window has no other bytes than the shared ones: its bucket decides.
        shared = aggregate_apart(level, ["bucket"], F.sum("n").alias("members")).where("members > 1")
        repeated(level.join(shared.select("bucket"), "bucket"), kind)
    return reduce(DataFrame.unionAll, found)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans without overlap; spans that touch become one."""
    out: list[tuple[int, int]] = []
    for begin, end in sorted(spans):
        if out and begin <= out[-1][1]:
            if end > out[-1][1]:
                out[-1] = (out[-1][0], end)
        else:
            out.append((begin, end))
    return out


def _kept(body: bytes, spans: list[tuple[int, int]]) -> bytes:
    edges = [0, *[x for span in spans for x in span], len(body)]
    return b"".join(body[a:b] for a, b in zip(edges[::2], edges[1::2]))


def _whole_characters(body: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans without the bytes of characters that they hold only in part."""
    out = []
    for begin, end in spans:
        while begin < end and body[begin] & 0xC0 == 0x80:
            begin += 1
        while end > begin and end < len(body) and body[end] & 0xC0 == 0x80:
            end -= 1
        if begin < end:
            out.append((begin, end))
    return out


def _kept_text(text: bytes | None, spans: list[tuple[int, int]]) -> str | None:
    if not spans:
        return text and text.decode()
    return _kept(text, _whole_characters(text, spans)).decode()


def _bytes_of_words(body: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges of words as ranges of bytes, from the start of the first word to the end of the last."""
    if not spans:
        return []
    at = [m.span() for m in _WORD.finditer(body)]
    return [(at[begin][0], at[end - 1][1]) for begin, end in spans]


def _removal(apart: bool):
    """With ``apart``, spans in words go only from a text of their own, put out last."""
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            facts, texts, cleaned = [], [], []
            lists = batch.column("__spans")
            flat, at = lists.flatten(), 0
            every = list(zip(*[flat.field(c).to_pylist() for c in ("begin", "end", "in_words")]))
            for text, held in zip(batch.column("__text").cast(pa.large_binary()).to_pylist(),
                                  pc.list_value_length(lists).fill_null(0).to_pylist()):
                body, spans, at = text or b"", every[at:at + held], at + held
                found = {w: [s[:2] for s in spans if s[2] == w] for w in (False, True)}
                both = merged(found[False] + _bytes_of_words(body, found[True]))
                runs = merged(found[False]) if apart else both
                kept = _kept(body, runs) if runs else body
                facts.append((len(body), len(body) - len(kept), len(runs), hashlib.sha256(kept).hexdigest()))
                texts.append(_kept_text(text, runs))
                cleaned.append(_kept_text(text, both) if apart else None)
            n_bytes, removed, runs, digest = zip(*facts) if facts else ((),) * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column("__doc"), pa.array(n_bytes, pa.int64()), pa.array(removed, pa.int64()),
                 pa.array(runs, pa.int64()), pa.array(digest, pa.string()), pa.array(texts, pa.string()),
                 pa.array(cleaned, pa.string())],
                ["__doc", *_FACTS, "text"])
    return remove


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 400,
                   words: int | None = None, passages: int | None = None) -> DataFrame:
    """Every row with ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` (of the kept bytes) and
    ``kept_text``: the kept text, in which a character that is removed only in part stays whole.

    Given ``words`` (8 at least), strings of so many words that start anywhere else go as well,
    however few bytes they have; both kinds are found in the texts as they come in. Given ``passages`` instead, they
    go from a further column ``text`` alone, the others stay as they are. Own columns of these names are replaced.
    """
    own = [*_FACTS, "text"] if passages else _FACTS
    others = [c for c in docs.columns if c not in {text, *own}]
    keyed = docs.select(*row_keys(docs, [key, text]), F.struct(*others).alias("__doc"),
                        F.col(text).alias("__text"))
    in_words = words or passages
    spans = repeated_spans(keyed, "__text", [Kind(length), *([passages_of(in_words)] if in_words else [])])
    per_row = spans.distinct().groupBy(*KEYS).agg(F.collect_list(F.struct("begin", "end", "in_words")).alias("__spans"))
    joined = keyed.join(per_row, KEYS, "left").select("__doc", "__text", "__spans")
    doc_type = keyed.schema["__doc"].dataType.simpleString()
    found = joined.mapInArrow(_removal(bool(passages)), f"__doc {doc_type}, n_bytes long, n_removed long, "
                              "n_spans long, kept_sha256 string, kept_text string, text string")
    return found.select("__doc.*", *own)
