"""Rounds of moves between communities, with the nodes dealt into blocks.

A round as a query (``communities._move``) costs Spark a second or two to plan, start and write, however small
the graph is, and convergence takes over a hundred of them. Here the edges lie in cached blocks, one a
partition, as arrays; a round is one job of two small shuffles between the blocks and needs no plan. A graph that
fits one block has its rounds in one task, as each takes less time than starting a job. The rule of a move is the
same, and so are the moves.

Nodes are numbered in the order of their keys, so numbers compare like keys. Node ``i`` lies in block
``i % parts`` at place ``i // parts``; a community has the number of a node, and the block of that node sums it up.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import partial
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from muster.functions.ranking import global_row_number
from muster.operators.graph import MOST_ARCS, Arcs
from muster.session import cut_lineage, shared_folder

# Directed edges of a graph that is one block: 273 MB in its task and half a second a round, measured with 2.2 million.
ONE_BLOCK = 2_000_000
# Rounds between checkpoints; a state needs the one before it until then.
ROUNDS_PER_CHECKPOINT = 10


class Labels(NamedTuple):
    """A community per node, one array a block, and how many rounds led to it."""
    rdd: RDD
    turn: int


class Block(NamedTuple):
    """A block's nodes and their edges. ``ghosts`` are the far ends, ordered by block and number, those of block
    ``q`` from ``first[q]`` on. ``links`` are pairs of place and other block that share an edge, ordered by block,
    those of block ``q`` from ``sends[q]`` on. ``copies`` and ``heavy``, the weights by the copies of the far end,
    hold as long as every node is alone."""
    strength: np.ndarray
    share: np.ndarray  # of the total strength
    mark: np.ndarray
    copies: np.ndarray
    row: np.ndarray
    ghost: np.ndarray
    weight: np.ndarray
    heavy: np.ndarray
    ghosts: np.ndarray
    first: np.ndarray
    links: np.ndarray
    sends: np.ndarray


class Blocks:
    """The nodes and edges of ``graph`` in blocks, from ``start(node, strength, total)``.

    A key that came twice has two equal rows there. Both count in the first round, as they do in the query, which
    leaves one of each."""

    def __init__(self, graph: Arcs, start: DataFrame):
        self._spark = graph.vertices.sparkSession
        shared_folder(self._spark)  # names the folder of checkpoints
        few = max(graph.parts, -(-graph.arcs // MOST_ARCS))
        self.parts = parts = 1 if graph.arcs <= ONE_BLOCK else few
        once = cut_lineage(start.groupBy("node").agg(
            F.first("strength").cast("double").alias("strength"), F.first("total").cast("double").alias("total"),
            F.count(F.lit(1)).alias("copies")))
        self._numbers = cut_lineage(global_row_number(once.select("node", "copies"), [F.col("node")], "number").select(
            "node", "copies", (F.col("number") - 1).alias("number")))
        nodes = once.drop("copies").join(self._numbers, "node").select(
            "number", "strength", "total", F.xxhash64("node").alias("mark"), "copies")
        left, right = (self._numbers.toDF(end, f"{number}_copies", number) for end, number in (("src", "a"), ("dst", "b")))
        # Each edge once; it is sent to both blocks.
        pairs = graph.both.where("src < dst").join(left, "src").join(right, "dst").select(
            "a", "b", F.col("weight").cast("double"), "a_copies", "b_copies")
        dealt = _dealt(nodes, _nodes(parts)).union(_dealt(pairs, _ends(parts)))
        self._blocks = dealt.partitionBy(parts, _own).mapPartitions(
            _built(parts), preservesPartitioning=True).persist(StorageLevel.MEMORY_AND_DISK)
        self._held: list[RDD] = []

    def settled(self, converge: Callable) -> DataFrame:
        """``(node, c)`` after ``converge(state, round, forget)``, from every node in a community of its own."""
        parts = self.parts
        if parts > 1:
            found = converge(self._alone(), self.round, self.forget)
            if found.turn == 0:
                return self._table(self._blocks.map(lambda row: _placed(row[0], parts, row[1][1])))
            return self._table(found.rdd.map(lambda row: _placed(row[0], parts, None, row[1][1])))

        def settle(rows: Iterator) -> Iterator:
            for p, (_, block) in rows:
                c, turn = converge((np.arange(len(block.strength)), 0), partial(_round, block))
                yield _placed(p, 1, block if turn == 0 else None, c)

        return self._table(self._blocks.mapPartitions(settle))

    def _alone(self) -> Labels:
        parts = self.parts

        def numbers(rows: Iterator) -> Iterator:
            for p, (_, block) in rows:
                yield p, ("state", np.arange(len(block.strength)) * parts + p, None)

        return Labels(self._blocks.mapPartitions(numbers, preservesPartitioning=True), 0)

    def round(self, state: Labels, draws: int) -> tuple[Labels, int, float]:
        """The state after a round of moves; how many nodes wanted to move, and the modularity before it."""
        here = self._blocks.union(state.rdd)
        told = here.mapPartitions(_told(self.parts, state.turn)).partitionBy(self.parts, _own)
        sums = told.mapPartitions(_summed(self.parts)).partitionBy(self.parts, _own)
        after = here.union(told).union(sums).mapPartitions(
            _moved(self.parts, state.turn, draws), preservesPartitioning=True).persist(StorageLevel.MEMORY_AND_DISK)
        self._held.append(after)
        if (state.turn + 1) % ROUNDS_PER_CHECKPOINT == 0:
            after.checkpoint()
        seen = after.map(lambda row: row[1][2]).collect()
        wanting, fit, strength = (math.fsum(x) for x in zip(*seen, strict=True)) if seen else (0, 0.0, 0.0)
        return Labels(after, state.turn + 1), int(wanting), fit / strength if strength else 0.0

    def forget(self, *needed: Labels) -> None:
        """Drop the states of other rounds."""
        kept = [x.rdd for x in needed]
        for rdd in self._held:
            if not any(rdd is x for x in kept):
                rdd.unpersist()
        self._held = [x for x in self._held if any(x is y for y in kept)]

    def _table(self, labels: RDD) -> DataFrame:
        """``(node, c)`` with keys again."""
        rows = labels.flatMap(lambda x: zip(x[0].tolist(), x[1].tolist(), strict=True))
        found = self._spark.createDataFrame(rows, "number long, to long", verifySchema=False)
        numbers = self._numbers.drop("copies")
        return found.join(numbers, "number").join(numbers.toDF("c", "to"), "to").select("node", "c")

    def close(self) -> None:
        self.forget()
        self._blocks.unpersist()


def _placed(p: int, parts: int, first: Block | None, c: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and labels of a block's nodes. Where no round was made, ``first`` has all rows of a key."""
    if first is None:
        return np.arange(len(c)) * parts + p, c
    numbers = np.repeat(np.arange(len(first.copies)) * parts + p, first.copies)
    return numbers, numbers


def _own(block: int) -> int:
    """Partition of a block."""
    return block


def _dealt(df: DataFrame, pack: Callable) -> RDD:
    """Arrays ``(block, …)`` for each batch of rows."""
    fields = "block int, kind string, whole array<binary>"
    return df.mapInArrow(pack, fields).rdd.map(lambda row: (row.block, (row.kind, *row.whole)))


def _nodes(parts: int) -> Callable:
    def pack(batches: Iterator) -> Iterator:
        for batch in batches:
            number, *rest = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            yield _packed("nodes", parts, number, number, *rest)
    return pack


def _ends(parts: int) -> Callable:
    def pack(batches: Iterator) -> Iterator:
        for batch in batches:
            a, b, weight, near, far = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            src, dst = np.concatenate([a, b]), np.concatenate([b, a])
            yield _packed("edges", parts, src, src, dst, np.concatenate([weight, weight]),
                          np.concatenate([weight * far, weight * near]))
    return pack


def _packed(kind: str, parts: int, number: np.ndarray, *columns: np.ndarray) -> pa.RecordBatch:
    blocks, cut, order = _by_block(number, parts)
    whole = [[x[order[cut[q]:cut[q + 1]]].tobytes() for x in columns] for q in blocks]
    return pa.RecordBatch.from_arrays(
        [pa.array(blocks, pa.int32()), pa.array([kind] * len(blocks), pa.string()), pa.array(whole, pa.list_(pa.binary()))],
        ["block", "kind", "whole"])


def _by_block(number: np.ndarray, parts: int) -> tuple[list[int], np.ndarray, np.ndarray]:
    """The blocks that have numbers, where each begins, and the order of numbers by block."""
    owner = number % parts
    order = np.argsort(owner, kind="stable")
    cut = np.searchsorted(owner[order], np.arange(parts + 1))
    return np.flatnonzero(np.diff(cut)).tolist(), cut, order


def _built(parts: int) -> Callable:
    types = {"nodes": (np.int64, np.float64, np.float64, np.int64, np.int64),
             "edges": (np.int64, np.int64, np.float64, np.float64)}

    def build(rows: Iterator) -> Iterator:
        found: dict[str, list] = {"nodes": [], "edges": []}
        p = None
        for p, (kind, *whole) in rows:
            found[kind].append([np.frombuffer(x, t) for x, t in zip(whole, types[kind], strict=True)])
        if p is None:
            return
        number, strength, total, mark, copies = (np.concatenate(x) for x in zip(*found["nodes"], strict=True))
        order = np.argsort(number)
        strength, total, mark, copies = (x[order] for x in (strength, total, mark, copies))
        none = [[np.empty(0, t)] for t in types["edges"]]
        src, dst, weight, heavy = (np.concatenate(x) for x in zip(*found["edges"], strict=True)) if found["edges"] else (
            x[0] for x in none)
        # In one order, however the edges came, so sums are the same again.
        order = np.lexsort((weight, dst, src))
        src, dst, weight, heavy = (x[order] for x in (src, dst, weight, heavy))
        ends, place = np.unique(dst, return_inverse=True)
        order = np.lexsort((ends, ends % parts))
        rank = np.empty(len(ends), np.int32)
        rank[order] = np.arange(len(ends), dtype=np.int32)
        ghosts = ends[order]
        links = np.unique(dst % parts * len(strength) + src // parts) if len(strength) else np.empty(0, np.int64)
        yield p, ("block", Block(
            strength, strength / total, mark, copies, (src // parts).astype(np.int32), rank[place], weight,
            heavy if (copies > 1).any() or (heavy != weight).any() else weight,
            ghosts, np.searchsorted(ghosts % parts, np.arange(parts + 1)),
            links, np.searchsorted(links, np.arange(parts + 1) * len(strength))))
    return build


def _told(parts: int, turn: int) -> Callable:
    """Labels go to the blocks that have an edge to their nodes, sums per community to the community's block, with
    the blocks that need the whole."""
    def tell(rows: Iterator) -> Iterator:
        p, block, c, _ = _gathered(rows)
        if block is None:
            return
        nodes = len(c)
        for q in range(parts):
            if q != p and block.sends[q] < block.sends[q + 1]:
                yield q, ("label", p, c[block.links[block.sends[q]:block.sends[q + 1]] - q * nodes])
        near, place = np.unique(c, return_inverse=True)
        copies = block.copies if turn == 0 else np.ones(nodes, np.int64)
        sums = np.bincount(place, block.strength * copies)
        count = np.bincount(place, copies).astype(np.int64)
        needed = np.unique(np.concatenate([c[block.links % nodes] * parts + block.links // nodes, near * parts + p]))
        blocks, cut, order = _by_block(near, parts)
        _, some, by = _by_block(needed // parts, parts)
        for q in blocks:
            at = order[cut[q]:cut[q + 1]]
            yield q, ("sum", p, near[at], sums[at], count[at], needed[by[some[q]:some[q + 1]]])
    return tell


def _summed(parts: int) -> Callable:
    """Strength and size of whole communities, for the blocks that need them."""
    def add(rows: Iterator) -> Iterator:
        told = sorted((x[1:] for _, x in rows if x[0] == "sum"), key=lambda x: x[0])
        if not told:
            return
        near, sums, count, needed = (np.concatenate(x) for x in [*zip(*told, strict=True)][1:])
        all_, place = np.unique(near, return_inverse=True)
        sums, count = np.bincount(place, sums), np.bincount(place, count).astype(np.int64)
        needed = np.unique(needed)
        to, c = needed % parts, needed // parts
        blocks, cut, order = _by_block(to, parts)
        for q in blocks:
            at = np.searchsorted(all_, c[order[cut[q]:cut[q + 1]]])
            yield q, ("whole", all_[at], sums[at], count[at])
    return add


def _moved(parts: int, turn: int, draws: int) -> Callable:
    def move(rows: Iterator) -> Iterator:
        p, block, c, told = _gathered(rows)
        if block is None:
            return
        known, tot, size = (np.concatenate(x) for x in zip(*told["whole"], strict=True))
        order = np.argsort(known)
        known, tot, size = known[order], tot[order], size[order]
        far = np.empty(len(block.ghosts), np.int64)
        far[block.first[p]:block.first[p + 1]] = c[block.ghosts[block.first[p]:block.first[p + 1]] // parts]
        for q, labels in told["label"]:
            far[block.first[q]:block.first[q + 1]] = labels
        weight = block.heavy if turn == 0 else block.weight
        wants, to, fit = judged(block, weight, np.searchsorted(known, c), np.searchsorted(known, far), known, tot, size)
        turns = wants & (xxhash64(turn // draws, block.mark) % draws == turn % draws)
        yield p, ("state", np.where(turns, to, c), (int(wants.sum()), float(fit.sum()), float(block.strength.sum())))
    return move


def _round(block: Block, state: tuple[np.ndarray, int], draws: int) -> tuple[tuple[np.ndarray, int], int, float]:
    """``Blocks.round`` of a graph that is one block."""
    c, turn = state
    here = [(0, ("block", block)), (0, ("state", c, None))]
    told = [*_told(1, turn)(here)]
    (_, (_, after, (wanting, fit, strength))), = _moved(1, turn, draws)([*here, *told, *_summed(1)(told)])
    return (after, turn + 1), wanting, fit / strength


def judged(block: Block, weight: np.ndarray, home: np.ndarray, far: np.ndarray, known: np.ndarray,
           tot: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which nodes would gain by moving, where to, and each node's part of the modularity.

    ``home`` and ``far`` are the communities of the nodes and of the far ends, as places in ``known``.
    """
    nodes, many = len(home), len(known)
    key = block.row * np.int64(many) + far[block.ghost]
    order = np.argsort(key)
    key = key[order]
    begins = np.flatnonzero(np.diff(key, prepend=-1))
    shared = np.add.reduceat(weight[order], begins) if len(begins) else np.empty(0)
    row, to = np.divmod(key[begins], many)
    own = to == home[row]
    inner = np.zeros(nodes)
    inner[row[own]] = shared[own]
    row, to, shared = row[~own], to[~own], shared[~own]
    gain = _rounded(shared - block.share[row] * tot[to])
    stay = _rounded(inner - block.share * (tot[home] - block.strength))
    wants, best = np.zeros(nodes, bool), home.copy()
    if len(row):
        begins = np.flatnonzero(np.diff(row, prepend=-1))
        most = np.repeat(np.maximum.reduceat(gain, begins), np.diff(begins, append=len(row)))
        top = np.flatnonzero(gain == most)
        top = top[np.diff(row[top], prepend=-1) > 0]  # ties: the smallest community
        at = row[top]
        best[at] = to[top]
        wants[at] = (gain[top] > stay[at]) & (
            (size[to[top]] > 1) | (size[home[at]] > 1) | (known[to[top]] < known[home[at]]))
    return wants, known[best], inner - block.share * tot[home]


def _gathered(rows: Iterator) -> tuple[int, Block | None, Any, dict[str, list]]:
    """A partition's block, its labels, and what it was told."""
    p, block, c, told = -1, None, None, {"label": [], "whole": []}
    for p, (kind, *rest) in rows:
        if kind == "block":
            block = rest[0]
        elif kind == "state":
            c = rest[0]
        elif kind in told:
            told[kind].append(rest)
    return p, block, c, told


def _rounded(x: np.ndarray) -> np.ndarray:
    """9 decimals, half up, as ``round`` in SQL."""
    scaled = np.abs(x) * 1e9
    return np.where(scaled < 2.0 ** 52, np.copysign(np.floor(scaled + 0.5), x) / 1e9, x)


def xxhash64(number: int, seeds: np.ndarray) -> np.ndarray:
    """``xxhash64(…, number)`` where ``seeds`` are the hashes of the columns before it."""
    one, two, three, four, five = (np.uint64(x) for x in (
        0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))

    def turned(x: np.ndarray, bits: int) -> np.ndarray:
        return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))

    mixed = turned(np.array([number], np.uint64) * two, 31) * one
    x = (seeds.astype(np.int64).view(np.uint64) + five + np.uint64(8)) ^ mixed
    x = turned(x, 27) * one + four
    x = (x ^ (x >> np.uint64(33))) * two
    x = (x ^ (x >> np.uint64(29))) * three
    return (x ^ (x >> np.uint64(32))).view(np.int64)
