"""Quality scores from a generalised additive model with pairwise interactions.

A text becomes a few measures (of its length, words, lines, characters and repeats). Each measure
is cut into bins, and the model is one lookup table per measure and one per chosen pair of
measures. The tables are learnt by cyclic boosting: one after the other, round after round, each
gets a small step of a shallow tree fitted to what the sum of all tables still gets wrong. A score
is the sum of a few table entries, looked up for whole batches at once.

The model is fitted on the driver from at most ``TRAIN_ROWS`` labelled rows (those of the smallest
hashes of their ids), the bound of what the driver holds. Everything else runs over all rows;
the measures are computed once and written to the shared folder.

Only the text enters a score: no id, language, source or label does. Defined results: a null text is
scored like an empty one; a row without id is not held out; without labels of both kinds every score
is their share (0.5 for none). Repeated rows get equal results, repeated labels count repeatedly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from muster.functions.ranking import aggregate_apart
from muster.session import cut_lineage

TRAIN_ROWS = 20_000
FOLDS = 5
THRESHOLD = 0.3
MEASURES = ["chars", "words", "word_length", "line_words", "symbols", "exclaims", "bars", "capitals", "digits",
            "stops", "not_ascii", "distinct_words", "distinct_triples", "distinct_lines", "marked_words", "open_lines",
            "doubled_words"]
_SYMBOLS = np.frombuffer(b"#*$%&<>@^~=+_\\", np.uint8)
_STOPS = np.frombuffer(b".,;:?", np.uint8)
_TAILS = tuple(bytes([b]) for b in b"#*$%&<>|!")
_ENDS = tuple(b".!?:;,\"')")


def measures(text: str | None) -> list[float]:
    """The measures of a text, all finite; shares are 0 where there is nothing to share."""
    body = (text or "").encode()
    words = body.split()
    n, w = max(len(body), 1), max(len(words), 1)
    lines = [line for line in body.split(b"\n") if line.strip()]
    k = max(len(lines), 1)
    count = np.bincount(np.frombuffer(body, np.uint8), minlength=256)
    triples = set(zip(words, words[1:], words[2:]))
    return [
        np.log1p(len(body)), np.log1p(len(words)), len(body) / w, np.log1p(len(words) / k),
        count[_SYMBOLS].sum() / n, count[0x21] / n, count[0x7C] / n, count[0x41:0x5B].sum() / n,
        count[0x30:0x3A].sum() / n, count[_STOPS].sum() / w, count[0x80:].sum() / n,
        len(set(words)) / w, len(triples) / max(len(words) - 2, 1), len(set(lines)) / k,
        sum(x.endswith(_TAILS) for x in words) / w, sum(line.rstrip()[-1] not in _ENDS for line in lines) / k,
        sum(map(bytes.__eq__, words, words[1:])) / w]


@dataclass
class Model:
    """Bin edges and lookup tables; ``pairs`` use every fourth edge."""

    edges: list[np.ndarray]
    start: float
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_tables: list[np.ndarray]

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        for j, table in enumerate(self.tables):
            total += table[np.searchsorted(self.edges[j], x[:, j], "right")]
        for (a, b), table in zip(self.pairs, self.pair_tables):
            total += table[_coarse(self.edges[a], x[:, a]), _coarse(self.edges[b], x[:, b])]
        return _share(total)


def _share(total: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _coarse(edges: np.ndarray, values: np.ndarray) -> np.ndarray:
    return np.searchsorted(edges[3::4], values, "right")


def _cut_value(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + 1.0)


def _tree(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """Steps per bin of a tree on one ordered measure, from sums of gradients and curvatures."""
    if len(g) < 2 or not depth:
        return np.full(len(g), g.sum() / (h.sum() + 1.0))
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gain = _cut_value(left_g, left_h) + _cut_value(g.sum() - left_g, h.sum() - left_h)
    at = int(gain.argmax()) + 1
    if gain[at - 1] <= _cut_value(g.sum(), h.sum()) + 1e-9:
        return np.full(len(g), g.sum() / (h.sum() + 1.0))
    return np.concatenate([_tree(g[:at], h[:at], depth - 1), _tree(g[at:], h[at:], depth - 1)])


def _corner_sums(g: np.ndarray) -> np.ndarray:
    return g.cumsum(0).cumsum(1)


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """Steps of the best tree with one cut on each of two measures, and its gain."""
    sums, weights = _corner_sums(g), _corner_sums(h)
    if min(g.shape) < 2:
        return np.zeros_like(g), 0.0
    low_g, low_h = sums[:-1, :-1], weights[:-1, :-1]
    parts = [(low_g, low_h), (sums[:-1, -1:] - low_g, weights[:-1, -1:] - low_h),
             (sums[-1:, :-1] - low_g, weights[-1:, :-1] - low_h)]
    parts.append((sums[-1, -1] - sum(p[0] for p in parts), weights[-1, -1] - sum(p[1] for p in parts)))
    gain = sum(_cut_value(*p) for p in parts)
    r, c = np.unravel_index(int(gain.argmax()), gain.shape)
    step = np.empty_like(g)
    for part, (rows, columns) in zip(parts, [(slice(0, r + 1), slice(0, c + 1)), (slice(0, r + 1), slice(c + 1, None)),
                                             (slice(r + 1, None), slice(0, c + 1)), (slice(r + 1, None), slice(c + 1, None))]):
        step[rows, columns] = part[0][r, c] / (part[1][r, c] + 1.0)
    return step, float(gain[r, c] - _cut_value(g.sum(), h.sum()))


def fit(x: np.ndarray, y: np.ndarray, bins: int = 32, rounds: int = 120, pairs: int = 6, pair_rounds: int = 60,
        rate: float = 0.15) -> Model:
    """Cyclic boosting of single tables, then of the pairs that promise most on what is left."""
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    model = Model([], float(np.log(share / (1 - share))), [], [], [])
    if len(y) == 0 or y.min() == y.max():
        return model
    width = x.shape[1]
    model.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(width)]
    fine = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(model.edges)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    total = np.full(len(y), model.start)
    for _ in range(rounds):
        for j in range(width):
            p = _share(total)
            size = len(model.tables[j])
            step = rate * _tree(np.bincount(fine[j], y - p, size), np.bincount(fine[j], p * (1 - p), size))
            model.tables[j] += step
            total += step[fine[j]]
    coarse = [_coarse(e, x[:, j]) for j, e in enumerate(model.edges)]
    sizes = [len(e[3::4]) + 1 for e in model.edges]

    def sums(a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        cell = coarse[a] * sizes[b] + coarse[b]
        p, shape = _share(total), (sizes[a], sizes[b])
        many = sizes[a] * sizes[b]
        return (cell, np.bincount(cell, y - p, many).reshape(shape), np.bincount(cell, p * (1 - p), many).reshape(shape))

    gains = {(a, b): _quadrants(*sums(a, b)[1:])[1] for a in range(width) for b in range(a + 1, width)}
    model.pairs = sorted(gains, key=lambda ab: (-gains[ab], ab))[:pairs]
    model.pair_tables = [np.zeros((sizes[a], sizes[b])) for a, b in model.pairs]
    for _ in range(pair_rounds):
        for k, (a, b) in enumerate(model.pairs):
            cell, g, h = sums(a, b)
            step = rate * _quadrants(g, h)[0]
            model.pair_tables[k] += step
            total += step.ravel()[cell]
    return model


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [measures(t.as_py()) for t in batch.column("__text")]
        yield pa.RecordBatch.from_arrays([batch.column("__key"), pa.array(found, pa.list_(pa.float64()))],
                                         ["__key", "measures"])


def measured(docs: DataFrame, key: str, text: str) -> DataFrame:
    bare = docs.select(F.col(key).alias("__key"), F.col(text).alias("__text"))
    kind = bare.schema["__key"].dataType.simpleString()
    return cut_lineage(bare.mapInArrow(_measured, f"__key {kind}, measures array<double>"))


def train(rows: DataFrame, labels: DataFrame, key: str, label: str, limit: int = TRAIN_ROWS) -> Model:
    """Fit on at most ``limit`` labelled rows outside the held-out fold."""
    usable = labels.select(F.col(key).alias("__key"), F.col(label).cast("int").alias("y")).where(
        F.col("y").isin(0, 1) & ~held_out(F.col("__key")))
    chosen = usable.orderBy(F.xxhash64("__key"), "__key", "y").limit(limit)
    one = aggregate_apart(rows, ["__key"], F.min("measures").alias("measures"))  # repeated ids once
    sample = chosen.join(one, "__key").orderBy(F.xxhash64("__key"), "__key", "y").collect()
    return fit(np.array([r.measures for r in sample], float).reshape(len(sample), len(MEASURES)), np.array([r.y for r in sample], float))


def _scored(model: Model):
    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("measures").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(MEASURES))
            yield pa.RecordBatch.from_arrays([batch.column("__key"), pa.array(model.scores(x), pa.float64())],
                                             ["__key", "score"])
    return scored


def score(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
          limit: int = TRAIN_ROWS) -> DataFrame:
    """``(key, held_out, score, predicted)``, one row per row of ``docs``."""
    rows = measured(docs, key, text)
    model = train(rows, labels, key, label, limit)
    kind = rows.schema["__key"].dataType.simpleString()
    found = rows.mapInArrow(_scored(model), f"__key {kind}, score double")
    return found.select(F.col("__key").alias(key), held_out(F.col("__key")).alias("held_out"), "score",
                        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
