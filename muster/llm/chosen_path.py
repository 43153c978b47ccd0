"""Near-duplicates by a chosen-path set similarity join over minwise tokens.

A document is the set of its word shingles; sets are linked from a Jaccard similarity of ``LEAST`` on.
Of each distinct set, ``TOKENS`` minwise tokens are kept. A tree starts with all sets in one node. A
node draws positions, and each of its sets goes to the child named by its token there: similar sets
share tokens, so they go on together, while the others part. The first levels draw two positions,
deeper ones 1 / LEAST in the mean, so that pairs below the threshold die out and those above go on.
Nodes with few members are compared exhaustively; so are nodes of which all but a few members are known to
be in one component, by comparing those few with all. Trees are independent, and all of them grow at the
same time, level by level, as one table of nodes and members.

Nodes of sets that resemble one another need more than branching. All members are compared with one of them
first, and in large nodes with the most central ones (nearest to the majority of the members' token bits). Members known to be
connected need no more comparing: a node of which all members are is finished. So a large group of near
copies ends with the level at which its centre ties it together, without pairs being listed. Levels
go on until no large node is left; nothing is capped.

Candidates (by size, by four bits of each token and by the parity of counts) are confirmed on the full sets. A pair of the least
similarity meets in a tree's first level with a chance of 0.96, over a few levels of about 0.7; ``TREES``
of them make a miss rarer than one in a hundred, and rarer still for more similar pairs.

Defined results: texts that are null, empty or blank have an empty set and are linked with nothing, each
its own component; a text with fewer words than a shingle is one shingle. Rows with equal sets share a
component. Rows without id share the component of what they link to, where the smallest id leads; a
component without any id has none. ``kept`` marks the rows of the leading id, null included.
Sets are held as 64-bit hashes of their shingles, and told apart by 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from muster.functions.ranking import aggregate_apart, top_per_group
from muster.llm.common import row_keys
from muster.operators.graph import connected_components
from muster.operators.paths import both_directions
from muster.session import cut_in_buckets, cut_lineage

SHINGLE = 4
LEAST = 80  # hundredths
TOKENS = 64
TREES = 5
#: A node with fewer members outside its largest component is compared exhaustively.
SMALL = 256
#: Central members of a larger node that are compared with all of it.
CENTRES = 4
#: Columns of 64 bits, each with one bit of every token.
BITS = ["bits", "bits_b", "bits_c", "bits_d"]
#: Tokens differ in 0.1 of their bits at the least similarity: 25.6 of 256, with a deviation of 7.3. Pairs
#: beyond 62 bits are not confirmed; of pairs to be linked less than one in 100,000 is. Unrelated sets differ
#: in half of the bits, with a deviation of 8, so their number, which grows with the square of a node, does not count.
MOST_BITS = 62
#: Columns of 64 bits, by which a set's hashes are told into 512 counts; a bit is 1 where a count is odd. Each hash that
#: only one of two sets has changes one bit, so sets differ in at least as many hashes as bits: no link is lost by this.
ODD = [f"odd_{k}" for k in range(8)]
CARRIED = [*BITS, *ODD]
WIDE_LEVELS = 2

_RANDOM = np.random.default_rng(20)
_TURN = _RANDOM.integers(0, 2 ** 64, TOKENS, np.uint64) | np.uint64(1)
_ADD = _RANDOM.integers(0, 2 ** 64, TOKENS, np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    """The finishing steps of SplitMix64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_set(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))
    size = min(size, len(words))
    count = len(words) - size + 1
    joined = np.full(count, size, np.uint64)
    for k in range(size):
        joined = _mixed(joined) + hashes[k:k + count]
    return np.unique(_mixed(joined))


def tokens(found: np.ndarray) -> np.ndarray:
    """The minwise token of each position: the least of its hashes over the set."""
    least = np.full(TOKENS, 2 ** 64 - 1, np.uint64)
    for at in range(0, len(found), 4096):
        turned = found[None, at:at + 4096] * _TURN[:, None] + _ADD[:, None]
        np.minimum(least, turned.min(axis=1), out=least)
    return least


_MARKED = f"n long, set_a long, set_b long, {' long, '.join(CARRIED)} long, sketch array<int>"


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, names, bits, sketches = [], [], [], []
        for text in batch.column("__text").to_pylist():
            found = shingle_set(text)
            sizes.append(len(found))
            body = found.tobytes()
            names.append((xxh64_intdigest(body, 1), xxh64_intdigest(body, 2)))
            least = tokens(found)
            low = (least >> np.uint64(20)).astype(np.uint8)
            odd = np.bincount((found >> np.uint64(55)).view(np.int64), minlength=64 * len(ODD)) & 1
            bits.append([*(np.packbits((low >> k) & 1).view("<i8")[0] for k in range(len(BITS))),
                         *np.packbits(odd.astype(np.uint8)).view("<i8")])
            sketches.append(least.astype(np.uint32).view(np.int32) if len(found) else None)
        set_a, set_b = np.array(names, np.uint64).reshape(-1, 2).view(np.int64).T
        words = np.array(bits, np.int64).reshape(-1, len(CARRIED)).T
        yield pa.RecordBatch.from_arrays(
            [batch.column("__doc"), pa.array(sizes, pa.int64()), pa.array(set_a), pa.array(set_b),
             *map(pa.array, words), pa.array(sketches, pa.list_(pa.int32()))],
            ["__doc", *[part.split()[0] for part in _MARKED.split(", ")]])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [shingle_set(t).view(np.int64) for t in batch.column("__text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("uid"), pa.array(found, pa.list_(pa.int64()))], ["uid", "set"])


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", trees: int = TREES) -> DataFrame:
    """``(key, n_shingles, component_id, kept)``, one row per row of ``docs``."""
    bare = docs.select(F.col(key).alias("id"), F.col(text).alias("__text"))
    kind = docs.schema[key].dataType.simpleString()
    named = bare.select("__text", F.struct("id", *row_keys(bare, ["id", "__text"])).alias("__doc"))
    marked = cut_lineage(named.mapInArrow(
        _mark, f"__doc struct<id:{kind},key_a:bigint,key_b:bigint>, {_MARKED}").select("__doc.*", *_names(_MARKED)))
    # One row per distinct set; equal sets have equal tokens, so any of them serves.
    nodes = cut_lineage(
        marked.where("n > 0").groupBy("set_a", "set_b").agg(
            F.min("id").alias("least"), F.min(F.struct("key_a", "key_b")).alias("row"), F.first("n").alias("n"),
            *(F.first(b).alias(b) for b in CARRIED), F.first("sketch").alias("sketch"))
        .withColumn("uid", F.monotonically_increasing_id()))
    links = _links(nodes, bare, trees)
    labels = _components(links)
    placed = cut_lineage(nodes.join(labels, "uid", "left").select(
        "set_a", "set_b", "least", F.coalesce("component", "uid").alias("component")))
    leaders = aggregate_apart(placed, ["component"], F.min("least").alias("component_id"))
    by_set = placed.join(leaders, "component").select(F.struct("set_a", "set_b").alias("__set"), "component_id")
    by_set = by_set.select("__set.*", "component_id")
    linked = marked.where("n > 0").join(by_set, ["set_a", "set_b"])
    rows = linked.select("id", "n", "component_id").union(marked.where("n = 0").select("id", "n", "id"))
    return rows.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), "component_id",
                       F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def _names(fields: str) -> list[str]:
    return [part.split()[0] for part in fields.split(", ")]


def _components(links: DataFrame) -> DataFrame:
    """``(uid, component)`` of the linked sets."""
    ends = links.select(F.explode(F.array("src", "dst")).alias("uid")).distinct()
    return connected_components(ends, "uid", links).withColumnRenamed("node", "uid")


def _gathered(links: DataFrame) -> DataFrame:
    """``(uid, component)`` of the linked sets, good enough to go on with: sets of one label are connected, but a
    component may have several labels. Each set takes the most linked set around it, and then that one's choice, so
    all around a centre share its label."""
    both = cut_lineage(both_directions(links))
    degree = aggregate_apart(both, ["src"], F.count(F.lit(1)).alias("degree"))
    known = degree.withColumnRenamed("src", "dst")
    ranked = both.join(known, "dst").select("src", F.struct("degree", F.col("dst").alias("uid")).alias("place"))
    own = degree.select("src", F.struct("degree", F.col("src").alias("uid")))
    chosen = cut_lineage(ranked.union(own).groupBy(F.col("src").alias("uid")).agg(F.max("place")["uid"].alias("first")))
    second = chosen.select(F.struct(F.col("uid").alias("first"), F.col("first").alias("component")).alias("__next"))
    return chosen.join(second.select("__next.*"), "first").select("uid", "component")


def branch(members: DataFrame, level: int) -> DataFrame:
    """Children ``(node, uid)`` of ``members(node, uid, sketch)``. A node's draws are the same for all its
    members, whichever task they are in."""
    node, sketch = F.col("node"), F.col("sketch")
    first = F.pmod(F.xxhash64(node, F.lit(1)), F.lit(TOKENS)).cast("int")
    second = F.pmod(first + 1 + F.pmod(F.xxhash64(node, F.lit(2)), F.lit(TOKENS - 1)), F.lit(TOKENS)).cast("int")
    child = lambda place: F.xxhash64(node, place, sketch[place])
    both = F.array(child(first), child(second))
    if level > WIDE_LEVELS:
        # 1 / LEAST draws in the mean: a second one for that part of the nodes.
        lucky = F.pmod(F.xxhash64(node, F.lit(3)), F.lit(LEAST)) < 100 - LEAST
        both = F.when(lucky, both).otherwise(F.array(child(first)))
    return members.select(F.explode(both).alias("node"), "uid")


def _similar(left: str, right: str) -> Column:
    """What two sets of the least similarity fulfil by their sizes and odd counts, and nearly all by their tokens' bits."""
    small, large = F.least(f"{left}.n", f"{right}.n"), F.greatest(f"{left}.n", f"{right}.n")
    apart, odd = (sum(F.bit_count(F.col(f"{left}.{b}").bitwiseXOR(F.col(f"{right}.{b}"))) for b in columns)
                  for columns in (BITS, ODD))
    return (F.col(f"{left}.component") != F.col(f"{right}.component")) & (100 * small >= LEAST * large) & (
        apart <= MOST_BITS) & ((100 + LEAST) * odd <= (100 - LEAST) * (small + large))


def _pair(hub: str, member: str) -> list[Column]:
    ends = F.col(f"{hub}.uid"), F.col(f"{member}.uid")
    return [F.least(*ends).alias("src"), F.greatest(*ends).alias("dst"), ends[0].alias("hub")]


def _once(pairs: DataFrame) -> DataFrame:
    """One row per pair, with one of the ends that others are compared with as its hub."""
    return pairs.groupBy("src", "dst").agg(F.min("hub").alias("hub"))


def _links(nodes: DataFrame, bare: DataFrame, trees: int) -> DataFrame:
    """Confirmed links ``(src, dst)`` between sets, enough to connect all that are linked."""
    roots = F.explode(F.array(*[F.xxhash64(F.lit(t)) for t in range(trees)])).alias("node")
    filed = branch(nodes.select(roots, "uid", "sketch"), 1)
    facts = nodes.select("uid", "n", *CARRIED, F.col("uid").alias("component"))
    live = _shared(filed)
    # Most nodes hold copies of one text: comparing all with one of them ties these first.
    first = aggregate_apart(live, ["node"], F.min("uid").alias("uid")).join(facts, "uid").alias("l")
    members = live.join(facts, "uid").alias("r")
    tried = cut_lineage(_once(members.join(first, "node").where(_similar("l", "r")).select(*_pair("l", "r"))))
    sets = _full_sets(nodes.join(live.select("uid").distinct(), "uid").select("uid", "row"), bare)
    links, level = cut_lineage(_confirmed(tried, sets)), 1
    while True:
        labels = cut_lineage(_gathered(links))
        facts = nodes.select("uid", "n", *CARRIED).join(labels, "uid", "left").withColumn(
            "component", F.coalesce("component", "uid"))
        few, large = _sorted_out(live, facts)
        left, right = few.where("outside").alias("l"), few.alias("r")
        once = ~F.col("r.outside") | (F.col("l.uid") < F.col("r.uid"))
        pairs = left.join(right, "node").where(once & _similar("l", "r")).select(*_pair("l", "r"))
        more = not large.isEmpty()
        if more:
            around = large.alias("r").join(_centres(large).alias("l"), "node").where(_similar("l", "r"))
            pairs = pairs.union(around.select(*_pair("l", "r")))
        pairs = cut_lineage(_once(pairs).join(tried, ["src", "dst"], "left_anti"))
        links = links.union(cut_lineage(_confirmed(pairs, sets)))
        if not more:
            return links
        tried, level = tried.union(pairs), level + 1
        live = _shared(branch(large.select("node", "uid").join(nodes.select("uid", "sketch"), "uid"), level))


def _shared(filed: DataFrame) -> DataFrame:
    """``(node, uid)`` of the nodes with more than one member."""
    filed = cut_lineage(filed)
    sizes = filed.groupBy("node").agg(F.count(F.lit(1)).alias("members")).where("members > 1").select("node")
    return cut_lineage(filed.join(sizes, "node"))


def _sorted_out(live: DataFrame, facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members ``(node, uid, n, component, outside)``, with bits, of the nodes to be compared, and of the large ones.

    ``outside`` marks members that are not of the largest component of their node. A node is small if
    fewer than ``SMALL`` are: comparing these with all its members costs each less than ``SMALL`` steps.
    Nodes of one component are left out.
    """
    live = live.join(facts, "uid")
    parts = aggregate_apart(live, ["node", "component"], F.count(F.lit(1)).alias("held"))
    mixed = parts.groupBy("node").agg(
        F.sum("held").alias("members"), F.count(F.lit(1)).alias("parts"),
        F.max(F.struct("held", "component")).alias("main")).where("parts > 1")
    mixed = mixed.select("node", F.col("main.component").alias("main"),
                         (F.col("members") - F.col("main.held")).alias("others"))
    held = cut_lineage(live.join(mixed, "node").withColumn("outside", F.col("component") != F.col("main")).drop("main"))
    return held.where(F.col("others") < SMALL), held.where(F.col("others") >= SMALL)


def _centres(large: DataFrame) -> DataFrame:
    """The members whose bits are nearest to the majority of their node's: ``CENTRES`` of each node."""
    share = [F.avg(F.expr(f"shiftrightunsigned(bits, {k}) & 1")) for k in range(64)]
    ones = [F.when(s > 0.5, F.lit(1 << k if k < 63 else -(1 << 63))).otherwise(F.lit(0)) for k, s in enumerate(share)]
    while len(ones) > 1:
        ones = [a.bitwiseOR(b) for a, b in zip(ones[::2], ones[1::2])]
    majority = aggregate_apart(large, ["node"], ones[0].alias("majority"))
    off = F.bit_count(F.col("bits").bitwiseXOR(F.col("majority"))).alias("off")
    return top_per_group(large.join(majority, "node").select("node", "uid", "n", *CARRIED, "component", off),
                         ["node"], [F.col("off"), F.col("uid")], CENTRES).drop("off", "rank")


def _full_sets(wanted: DataFrame, bare: DataFrame) -> DataFrame:
    """``(uid, set)`` of the wanted sets, made again from one row's text each and dealt by ``uid``."""
    rows = wanted.select("uid", "row.*")
    texts = bare.select("__text", *row_keys(bare, ["id", "__text"])).join(rows, ["key_a", "key_b"])
    once = texts.select("uid", "__text").dropDuplicates(["uid"])  # rows may be repeated
    parts = int(bare.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut_in_buckets(once.mapInArrow(_sets, "uid long, set array<long>"), "uid", parts)


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs that full sets link. A set is a member of few pairs, so these go to where the members' sets
    lie; only the sets of hubs, which may have very many members, are moved, and once each."""
    member = (F.col("src") + F.col("dst") - F.col("hub")).alias("uid")
    with_member = pairs.select("src", "dst", "hub", member).join(sets, "uid").drop("uid")
    hubs = sets.join(pairs.select(F.col("hub").alias("uid")).distinct(), "uid", "left_semi")
    hubs = hubs.select(F.col("uid").alias("hub"), F.col("set").alias("hub_set"))
    both = F.size(F.array_intersect("set", "hub_set"))
    either = F.size("set") + F.size("hub_set") - both
    return with_member.join(hubs, "hub").where(100 * both >= LEAST * either).select("src", "dst")
