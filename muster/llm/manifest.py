"""Merkle manifest of a table: leaves per row, a tree of 16-fold runs per source, one root.

A run of up to 16 nodes is hashed in order into its parent, level by level until one node is left:
the subroot of a source. Subroots, ordered by source, are hashed the same way into the root. The
trees are built bottom up, one aggregate per level, each a sixteenth of the one before; a group
never holds more than 16 nodes, and sources of any size are spread evenly because a row is placed
by its number, not by its source.

Folding checks a row against the root. Every parent keeps copies of its hash state, one from before
each child slot (``Run``); a replaced child is folded by resuming the copy at its slot with the
replacement and the siblings to the right, so nothing to the left is hashed again. Hash states
cannot leave a process. A task therefore gets the rows of one lowest run together with the runs
above it, makes the states of each run once and resumes them for all its rows.

Defined results: a null field counts as ``-``, an empty text as ``0:``; a row without id comes first
in its source and is never tampered with; rows with equal ids follow each other by leaf, equal rows
in file order; rows without source have a tree of their own, the first; an empty table has no rows
and no root. Columns other than the five named ones are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from muster.functions.ranking import aggregate_apart, global_row_number
from muster.llm.common import LOWER, UPPER
from muster.session import cut_lineage

FANOUT = 16
#: A row is tampered with where this divides the checksum of its id.
TAMPER_EVERY = 5

RESULT = ("leaf string, subroot string, root string, proof_sha256 string, folded_root string, "
          "verified boolean")
_RUN = "array<struct<slot:int,nodes:array<string>>>"


def leaf(*fields: Column) -> Column:
    """Digest of a row: every field with its length in bytes, so that no two rows read alike."""
    def framed(field: Column) -> Column:
        body = field.cast("string")
        return F.coalesce(F.concat(F.octet_length(body).cast("string"), F.lit(":"), body), F.lit("-"))
    return F.sha2(F.concat(*map(framed, fields)).cast("binary"), 256)


class Run:
    """Consecutive nodes under one parent, with the parent's hash state before each slot."""

    def __init__(self, nodes: Sequence[str], slots: Sequence[int] | None = None):
        """``slots`` names the slots whose states are kept; all of them by default."""
        self.nodes = [n.encode() for n in nodes]
        wanted = set(range(len(nodes)) if slots is None else slots)
        self.states, state = {}, hashlib.sha256()
        for slot, node in enumerate(self.nodes):
            if slot in wanted:
                self.states[slot] = state.copy()
            state.update(node)
        self.digest = state.hexdigest()

    def fold(self, slot: int, replacement: str) -> str:
        """The parent's digest with another node at ``slot``."""
        state = self.states[slot].copy()
        state.update(replacement.encode())
        for node in self.nodes[slot + 1:]:
            state.update(node)
        return state.hexdigest()

    def others(self, slot: int) -> bytes:
        return b"".join(self.nodes[:slot] + self.nodes[slot + 1:])


def _depth(nodes: int) -> int:
    levels = 0
    while nodes > 1:
        nodes, levels = -(-nodes // FANOUT), levels + 1
    return levels


def _parents(nodes: DataFrame, *carried: str) -> DataFrame:
    """One row ``(tree, place, size, nodes, digest)`` per run of ``nodes(tree, place, size, digest)``,
    trees of one node left out; ``carried`` columns of the nodes come along in ``rows``."""
    runs = (
        nodes.where("size > 1")
        .groupBy("tree", F.expr(f"place div {FANOUT}").alias("parent"),
                 F.expr(f"(size + {FANOUT - 1}) div {FANOUT}").alias("parents"))
        .agg(F.array_sort(F.collect_list(F.struct("place", "digest", *carried))).alias("rows"))
    )
    digest = F.sha2(F.array_join("rows.digest", "").cast("binary"), 256)
    kept = [F.col("rows")] if carried else []
    return runs.select("tree", F.col("parent").alias("place"), F.col("parents").alias("size"),
                       F.col("rows.digest").alias("nodes"), digest.alias("digest"), *kept)


def _levels(nodes: DataFrame, largest: int) -> list[DataFrame]:
    """The parents of every level, lowest first."""
    levels = []
    for _ in range(_depth(largest)):
        nodes = cut_lineage(_parents(nodes))
        levels.append(nodes)
    return levels


def _below(parents: DataFrame, above: DataFrame) -> DataFrame:
    """``(tree, place, …, path)`` of the children, from ``above`` the same of their parents."""
    slot = F.posexplode("nodes").alias("slot", "node")
    one = F.array(F.struct("slot", "nodes")).cast(_RUN)
    rest = [c for c in above.columns if c not in ("tree", "place", "path")]
    return (
        parents.select("tree", "place", "nodes").join(above, ["tree", "place"])
        .select("tree", "place", "nodes", "path", *rest, slot)
        .select("tree", (F.col("place") * FANOUT + F.col("slot")).alias("place"), *rest,
                F.concat(one, "path").alias("path"))
    )


def manifest(docs: DataFrame, key: str = "doc_id", group: str = "source",
             fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"),
             text: str = "text") -> DataFrame:
    """``(key, leaf, subroot, root, proof_sha256, folded_root, verified)``, one row per row of ``docs``."""
    as_stored = [F.col(f) for f in fields]
    lowered = [F.translate(f, UPPER, LOWER) if f == text else F.col(f) for f in fields]
    hit = F.crc32(F.col(key).cast("string").cast("binary")) % TAMPER_EVERY == 0
    leaves = cut_lineage(docs.select(
        F.col(key).alias("id"), F.col(group).alias("group"), leaf(*as_stored).alias("digest"),
        F.when(hit, leaf(*lowered)).alias("tampered"),
        F.monotonically_increasing_id().alias("file_order")))
    order = [F.col(c).asc_nulls_first() for c in ("group", "id", "digest", "file_order")]
    numbered = global_row_number(leaves, order, "number")
    # A row without source belongs to a group as well, and joins do not match nulls.
    named = numbered.withColumns({"none": F.col("group").isNull(), "group": F.coalesce("group", F.lit(""))})
    groups = aggregate_apart(named, ["none", "group"], F.min("number").alias("first"),
                             F.count(F.lit(1)).alias("size"))
    trees = cut_lineage(global_row_number(groups, [F.col("none").desc(), F.col("group")], "tree"))
    count, largest = trees.agg(F.count(F.lit(1)), F.max("size")).first()
    rows = cut_lineage(named.join(trees, ["none", "group"]).select(
        "tree", (F.col("number") - F.col("first")).alias("place"), "size", "digest", "id", "tampered"))

    alone = rows.where("size = 1").select(
        "tree", F.lit(0).cast("long").alias("place"), F.array("digest").alias("nodes"), "digest",
        F.array(F.struct("place", "digest", "id", "tampered")).alias("rows"))
    lowest = cut_lineage(_parents(rows, "id", "tampered").unionByName(
        alone.withColumn("size", F.lit(1).cast("long"))))
    levels = [lowest, *_levels(lowest.select("tree", "place", "size", "digest"),
                               -(-(largest or 0) // FANOUT))]
    tops = [level.where("size = 1").select("tree", "digest") for level in levels]
    subroots = tops[0]
    for top in tops[1:]:
        subroots = subroots.union(top)
    subroots = cut_lineage(subroots.select(
        F.lit(0).cast("long").alias("tree"), (F.col("tree") - 1).alias("place"),
        F.lit(count).cast("long").alias("size"), "digest"))

    crown = _levels(subroots, count)
    top = (crown[-1] if crown else subroots).select(
        "tree", "place", F.col("digest").alias("root"), F.array().cast(_RUN).alias("path"))
    for level in reversed(crown):
        top = _below(level, top)
    own = subroots.select("tree", "place", F.col("digest").alias("subroot"))
    ends = cut_lineage(top.join(own, ["tree", "place"]).select(
        (F.col("place") + 1).alias("tree"), F.lit(0).cast("long").alias("place"), "root", "subroot", "path"))

    # From the subroots down to the lowest runs; a tree joins in at the level of its subroot.
    paths = None
    for level in reversed(levels):
        here = level.where("size = 1").select("tree", "place").join(ends, ["tree", "place"])
        paths = here if paths is None else paths.unionByName(here)
        if level is not lowest:
            paths = _below(level, paths)
    folded = lowest.select("tree", "place", "rows").join(paths, ["tree", "place"]).select(
        "rows", (F.col("subroot") == F.col("rows")[0]["digest"]).alias("alone"), "subroot", "root", "path")
    kind = leaves.schema["id"].dataType.simpleString()
    return folded.mapInArrow(_fold_all, f"id {kind}, {RESULT}").withColumnRenamed("id", key)


def _fold_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            out = [row for run in batch.slice(at, 512).to_pylist() for row in _folded(run)]
            columns = list(zip(*out)) if out else [[]] * 7
            ids = batch.schema.field("rows").type.value_type.field("id").type
            kinds = [ids, *[pa.string()] * 5, pa.bool_()]
            names = ["id", *[part.split()[0] for part in RESULT.split(", ")]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds)], names)


def _folded(run: dict) -> Iterator[tuple]:
    """The results of one lowest run's rows: its own states and those of the runs above are made once."""
    above = [(step["slot"], Run(step["nodes"], [step["slot"]])) for step in run["path"]]
    upper = b"".join(r.others(slot) for slot, r in above)
    # A lone row is its tree's subroot: no parent of its own.
    own = None if run["alone"] else Run([row["digest"] for row in run["rows"]])
    for slot, row in enumerate(run["rows"]):
        value = row["tampered"] or row["digest"]
        siblings = b""
        if own:
            value, siblings = own.fold(slot, value), own.others(slot)
        for place, parent in above:
            value = parent.fold(place, value)
        yield (row["id"], row["digest"], run["subroot"], run["root"],
               hashlib.sha256(siblings + upper).hexdigest(), value, value == run["root"])
