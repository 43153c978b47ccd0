"""Near-duplicates by SimHash, linked through a grid of segment popcounts.

Fingerprints are 64 bits wide. Cut into segments, a fingerprint becomes the vector of its
segments' bit counts; two fingerprints at Hamming distance h are at Manhattan distance h or less
there. So all links at distance 2 are found among points at Manhattan distance 2, and two such
points have a grid point at distance 1 or less from both. Every fingerprint is filed at the grid
points around its own (itself and one up or down in each segment); those that share a grid point are
compared bit by bit.

Only distinct fingerprints enter. A grid point with many members is not compared pair by pair: its
members are filed once more with segments of one bit. There the grid is the fingerprint space
itself, all members of a grid point are at most 2 bits apart, and a star links them exactly.

Defined results: a null, empty or blank text has fingerprint zero and is linked like any other.
Repeated rows and rows without id share a component with all that they link to; the smallest id
leads, and a component whose rows all have no id has none.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from muster.functions.ranking import aggregate_apart
from muster.llm.common import let
from muster.operators.graph import connected_components
from muster.session import cut_lineage

SEED = 42
SHINGLE = 3
#: Grid points with more members than this are resolved by the one-bit grid, exactly as well.
PAIRS_BELOW = 32


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """Signed 64-bit SimHash over word shingles, repeats included."""
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    if len(words) < size:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*[words[k:] for k in range(size)]))
    count = max(1, len(words) - size + 1)
    hashes = np.fromiter(map(xxh64_intdigest, shingles, repeat(SEED)), np.dtype("<u8"), count)
    ones = np.zeros(64, np.int64)
    for at in range(0, count, 4096):
        part = hashes[at:at + 4096].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > count, bitorder="little").view("<i8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [fingerprint(t) for t in batch.column("__text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("__doc"), pa.array(found, pa.int64())],
                                         ["__doc", "fp"])


def fingerprints(docs: DataFrame, text: str, *columns: str | Column) -> DataFrame:
    """``columns`` of ``docs`` with ``fp``; the text itself does not come back."""
    bare = docs.select(F.struct(*columns).alias("__doc"), F.col(text).alias("__text"))
    kind = bare.schema["__doc"].dataType.simpleString()
    return bare.mapInArrow(_fingerprints, f"__doc {kind}, fp long").select("__doc.*", "fp")


def _popcounts(fp: Column) -> Column:
    """Bit counts of the sixteen 4-bit segments, one per hexadecimal digit of the result."""
    fives, threes = F.lit(0x5555555555555555), F.lit(0x3333333333333333)
    even, odd = fp.bitwiseAND(fives), F.shiftrightunsigned(fp, 1).bitwiseAND(fives)
    pairs = even.bitwiseXOR(odd).bitwiseOR(F.shiftleft(even.bitwiseAND(odd), 1))  # their sum, digit by digit
    return pairs.bitwiseAND(threes) + F.shiftrightunsigned(pairs, 2).bitwiseAND(threes)


def _grid(nodes: DataFrame) -> DataFrame:
    """Each fingerprint at its grid point and the points around it. A digit is its segment's count
    plus one, 0 to 6, so that steps never carry into the next digit."""
    steps = F.array(*[F.lit(sign << (4 * k)) for k in range(15) for sign in (1, -1)],
                    F.lit(1 << 60), F.lit(-(1 << 60)), F.lit(0))
    own = _popcounts(F.col("fp")) + F.lit(0x1111111111111111)
    return nodes.select("fp", F.explode(let(own, lambda o: F.transform(steps, lambda s: o + s))).alias("cell"))


def _bit_grid(nodes: DataFrame) -> DataFrame:
    """The same with one-bit segments: each fingerprint, and it with any one bit turned."""
    turns = F.array(*[F.lit(1 << k) for k in range(63)], F.lit(-(1 << 63)), F.lit(0))
    return nodes.select("fp", F.explode(F.transform(turns, lambda t: F.col("fp").bitwiseXOR(t))).alias("cell"))


def links(nodes: DataFrame) -> DataFrame:
    """``(src, dst)`` between distinct fingerprints ``fp``, enough to connect all that are linked."""
    filed = cut_lineage(_grid(nodes))
    sizes = cut_lineage(filed.groupBy("cell").agg(F.count(F.lit(1)).alias("members")).where("members > 1"))
    few = sizes.where(F.col("members") <= PAIRS_BELOW).select("cell")
    near = cut_lineage(filed.join(few, "cell"))
    pairs = near.alias("l").join(near.alias("r"), "cell").where(
        (F.col("l.fp") < F.col("r.fp")) & (F.bit_count(F.col("l.fp").bitwiseXOR(F.col("r.fp"))) <= 2)
    ).select(F.col("l.fp").alias("src"), F.col("r.fp").alias("dst"))
    crowded = sizes.where(F.col("members") > PAIRS_BELOW).select("cell")
    dense = filed.join(crowded, "cell").select("fp").distinct()
    turned = cut_lineage(_bit_grid(dense))
    centres = aggregate_apart(turned, ["cell"], F.min("fp").alias("dst"), F.count(F.lit(1)).alias("n"))
    stars = turned.join(centres.where("n > 1"), "cell").where("fp <> dst").select(F.col("fp").alias("src"), "dst")
    return pairs.union(stars).distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, fingerprint, component_id)`` per row; see the module's text for the odd cases."""
    marked = cut_lineage(fingerprints(docs, text, F.col(key).alias("__key")))
    return labelled(marked).select(
        F.col("__key").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def labelled(marked: DataFrame) -> DataFrame:
    """Rows ``(__key, fp)`` with ``component_id``, the smallest ``__key`` that links lead to."""
    nodes = cut_lineage(marked.groupBy("fp").agg(F.min("__key").alias("least")))
    groups = connected_components(nodes, "fp", links(nodes.select("fp")))
    named = cut_lineage(nodes.join(groups.withColumnRenamed("node", "fp"), "fp"))
    leaders = aggregate_apart(named, ["component"], F.min("least").alias("component_id"))
    by_fp = named.join(leaders, "component").select(F.struct("fp").alias("__fp"), "component_id")
    return marked.join(by_fp.select("__fp.fp", "component_id"), "fp")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component: that of the smallest id, of equal ids that of the smallest row hash."""
    row = F.xxhash64(F.struct(*docs.columns))
    marked = cut_lineage(fingerprints(docs, text, F.struct(
        F.col(key).isNull().alias("none"), F.col(key).alias("id"), row.alias("row")).alias("__key")))
    chosen = labelled(marked).where(F.col("__key") == F.col("component_id")).groupBy(
        F.col("__key.row").alias("__row"), F.col("__key.id").alias("__id")).agg(F.count(F.lit(1)).alias("__copies"))
    chosen = cut_lineage(chosen)
    kept = docs.withColumn("__hash", row).join(chosen, (F.col("__hash") == F.col("__row"))
                                               & F.col(key).eqNullSafe(F.col("__id")))
    once = kept.where("__copies = 1").select(*docs.columns)
    return once.union(kept.where("__copies > 1").select(*docs.columns).distinct())
