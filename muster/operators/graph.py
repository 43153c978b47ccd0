"""Features and views of edge tables ``(src, dst, …)``.

Iterations keep their state in the reliable checkpoint folder, so a lost executor
costs one round. Nodes with very many edges are spread over several salts.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from muster.functions.ranking import aggregate_apart, global_row_number, top_per_group
from muster.model import Catalog
from muster.operators.paths import both_directions
from muster.session import cut_in_buckets, cut_lineage

# Parameters of the features.
DAMPING = 0.85
MAX_ROUNDS = 200
TOLERANCE = 1e-10
EXPAND_LIMIT = 30
SEARCH_LIMIT = 20

# Edges of one node kept together; a busier node is spread over several salts.
EDGES_PER_SALT = 200_000
# Directed edges of a partition: a graph gets one partition per core at most until each holds MOST_ARCS.
LEAST_ARCS, MOST_ARCS = 50_000, 500_000
ROUNDS_PER_CHECKPOINT = 5
# Rounds of settling in one job; a state is used more than once in a round, so plans grow fast.
ROUNDS_PER_WRITE = 2


def undirected(edges: DataFrame, nodes: DataFrame, key: str, weight: str | None = None) -> DataFrame:
    """One row ``(src, dst, weight)`` per linked pair, ``src < dst``, weights summed.

    Self-loops and edges to unknown nodes are dropped; a missing weight counts 0.
    """
    value = F.lit(1.0) if weight is None else F.coalesce(F.col(weight).cast("double"), F.lit(0.0))
    pairs = (
        edges.where(F.col("src") != F.col("dst"))
        .groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
        .agg(F.sum(value).alias("weight"))
    )
    for end in ("src", "dst"):
        pairs = pairs.join(nodes.select(F.col(key).alias(end)), end, "left_semi")
    return pairs.select("src", "dst", "weight")


def degree(edges: DataFrame) -> DataFrame:
    """Edges per node, seen from either end."""
    return both_directions(edges.select("src", "dst")).groupBy(F.col("src").alias("node")).agg(
        F.count(F.lit(1)).alias("degree"))


def top_linked(edges: DataFrame, k: int = 1) -> DataFrame:
    """The nodes with most links, ties by key."""
    return degree(edges).orderBy(F.desc("degree"), "node").limit(k)


def _parts(spark: SparkSession, arcs: int) -> int:
    """Partitions for a graph of that many directed edges: two or more, at most those of the session's shuffles."""
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    few = min(-(-arcs // LEAST_ARCS), spark.sparkContext.defaultParallelism)
    return min(most, max(2, few, -(-arcs // MOST_ARCS)))


class Arcs:
    """Both directions of a weighted graph, partitioned once for many rounds.

    ``vertices(node, strength, arcs, salts)``, partitioned and sorted by node. Nodes with up to
    ``per_salt`` edges have them in ``quiet(src, dst, weight)``, partitioned and sorted the same
    way, so a round joins state and edges in place. Busier nodes have theirs in ``busy(src, salt, dst,
    weight)``, spread over several partitions; what is sent along these is copied once per salt.

    ``sized`` lets the number of partitions follow the edges, not the session: a round over a graph that
    was merged to a few thousand edges would else spend its time starting hundreds of empty tasks. What
    is sent must then be ``dealt``, or joins move the state to the session's number of partitions. With
    ``loops`` every node also has an edge of no weight to itself, which counts neither as an arc nor for
    its strength.
    """

    def __init__(self, pairs: DataFrame, per_salt: int = EDGES_PER_SALT, sized: bool = False, loops: bool = False):
        self.both = cut_lineage(both_directions(pairs.where(F.col("weight") > 0)))
        spark = self.both.sparkSession
        self.arcs = self.both.count()
        self.parts = parts = _parts(spark, self.arcs) if sized else int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.vertices = (
            self.both.groupBy(F.col("src").alias("node"))
            .agg(F.sum("weight").alias("strength"), F.count(F.lit(1)).alias("arcs"))
            .withColumn("salts", F.ceil(F.col("arcs") / per_salt).cast("int"))
            .repartition(parts, "node").sortWithinPartitions("node")
            .persist(StorageLevel.MEMORY_AND_DISK)
        )
        self.linked, self.split = self.vertices.agg(
            F.count(F.lit(1)), F.count(F.when(F.col("salts") > 1, 1))).first()
        # Joins of every round find the edges partitioned and sorted already.
        many = self.vertices.where("salts > 1").select(F.col("node").alias("src"), "salts")
        every = self.both.select("src", "dst", "weight")
        if loops:
            every = every.union(self.vertices.selectExpr("node", "node", "0D"))
        near = every.join(many, "src", "left_anti") if self.split else every
        self.quiet = (
            near.select("src", "dst", "weight")
            .repartition(parts, "src").sortWithinPartitions("src").persist(StorageLevel.MEMORY_AND_DISK))
        salt = F.pmod(F.xxhash64("dst"), "salts").cast("int").alias("salt")
        self.busy = (
            every.join(many, "src").select("src", salt, "dst", "weight")
            .repartition(parts, "src", "salt").sortWithinPartitions("src", "salt")
            .persist(StorageLevel.MEMORY_AND_DISK))

    def place(self, state: DataFrame) -> DataFrame:
        """The same rows as a table, dealt by node like the edges."""
        return cut_in_buckets(state, "node", self.parts)

    def dealt(self, sent: DataFrame) -> DataFrame:
        """What was sent, dealt by ``dst`` like the vertices, unless a hub would make a partition too large."""
        return sent if self.split else sent.repartition(self.parts, "dst")

    def send(self, state: DataFrame) -> DataFrame:
        """Join per-node ``state(node, …, salts)`` with the node's edges."""
        # Edges stay where they are: small ones would else be broadcast anew in every round.
        near = state.where("salts = 1").join(self.quiet.hint("merge"), F.expr("node = src"))
        if not self.split:
            return near  # no edges on the other side
        copies = state.where("salts > 1").selectExpr("*", "explode(sequence(0, salts - 1)) AS copy")
        far = copies.join(self.busy.hint("merge"), F.expr("node = src AND copy = salt"))
        return near.union(far.drop("copy", "salt"))

    def close(self) -> None:
        for cached in (self.vertices, self.quiet, self.busy):
            cached.unpersist()


def pagerank(nodes: DataFrame, key: str, pairs: DataFrame, damping: float = DAMPING,
             rounds: int = MAX_ROUNDS, tol: float = TOLERANCE,
             per_salt: int = EDGES_PER_SALT, start: DataFrame | None = None) -> DataFrame:
    """Weighted PageRank ``(node, rank)`` on an undirected graph; unlinked nodes are kept.

    Every unlinked node holds the same rank, so the mass they spread is a plain number and
    only linked nodes take part in the joins. With ``tol=0`` exactly ``rounds`` rounds of the power
    iteration are made; else ranks are settled: one more round would move them by less than ``tol``
    in total. ``start(node, rank)`` are earlier ranks to go on from.
    """
    ids = nodes.select(F.col(key).alias("node"))
    total = ids.count()
    if total == 0:
        return ids.withColumn("rank", F.lit(0.0))
    arcs = Arcs(pairs, per_salt, sized=True)
    if tol > 0:
        found = Settling(arcs, total, damping, tol, start).run(rounds)
        ranks, alone = found.ranks, found.base
    else:
        ranks, alone = _power_rounds(arcs, total, damping, rounds)
    out = cut_lineage(ids.join(ranks, "node", "left").select(
        "node", F.coalesce("rank", F.lit(alone)).alias("rank")))
    arcs.close()
    return out


def _power_rounds(arcs: Arcs, total: int, damping: float, rounds: int) -> tuple[DataFrame, float]:
    lonely, alone = total - arcs.linked, 1.0 / total
    state = arcs.vertices.withColumn("rank", F.lit(alone))
    for i in range(1, rounds + 1):
        base = (1 - damping) / total + damping * lonely * alone / total
        share = F.col("rank") * F.col("weight") / F.col("strength")
        sent = arcs.send(state).select("dst", share.alias("share"))
        got = arcs.dealt(sent).groupBy("dst").agg(F.sum("share").alias("got"))
        state = arcs.vertices.join(got, F.col("node") == F.col("dst")).select(
            "node", "strength", "salts", (F.lit(base) + damping * F.col("got")).alias("rank"))
        if i % ROUNDS_PER_CHECKPOINT == 0:
            state = cut_lineage(state)
        alone = base
    return state.select("node", "rank"), alone


class Settling:
    """Ranks of the linked nodes by a Chebyshev iteration that only sends what changed.

    The ranks solve ``rank = base + damping * received``. In an undirected graph the received part is
    a symmetric operator up to scaling, with eigenvalues between -1 and 1, so two earlier
    iterates can be combined into a step that shrinks the error by 0.56 a round where a power round
    shrinks it by 0.85. Each node keeps what it last sent and what it received so far, and a round
    sends the differences of those nodes alone whose rank has moved by more than their part of a
    hundredth of what is still off, or of a tenth of the tolerance. So the frontier shrinks, and from
    earlier ranks it starts small: after one full round only the surroundings of changed edges send.

    The state is written every other round as a table that is dealt like the edges, so no round moves it, and
    what a lost executor held is read again.
    """

    def __init__(self, arcs: Arcs, total: int, damping: float = DAMPING, tol: float = TOLERANCE,
                 start: DataFrame | None = None):
        self.arcs, self.damping, self.tol = arcs, damping, tol
        # Rank of an unlinked node, and what every linked one has besides what it receives.
        self.base = (1 - damping) / (total - damping * (total - arcs.linked))
        self.messages, self.rounds = 0, 0
        rank = F.lit(1.0 / total)
        state = arcs.vertices
        if start is not None:
            state = state.join(start.select("node", F.col("rank").alias("__start")), "node", "left")
            rank = F.coalesce("__start", F.lit(self.base))
        none = F.lit(0.0)
        state = state.select("node", "strength", "arcs", "salts", rank.alias("rank"), rank.alias("before"),
                             none.alias("got"), none.alias("sent"), F.lit(0).cast("long").alias("messages"))
        self.state = arcs.place(state)

    @property
    def ranks(self) -> DataFrame:
        return self.state.select("node", "rank")

    def run(self, rounds: int) -> Settling:
        held, weight, state = 0.0, 1.0, self.state
        for i in range(1, rounds + 1):
            if i > 1:
                weight = 1 / (1 - self.damping ** 2 * (0.5 if i == 2 else weight / 4))
            told = self._told(state, held)
            written = i % ROUNDS_PER_WRITE == 0 or i == rounds
            if written:
                seen = Observation()
                told = told.observe(
                    seen, F.expr(f"sum(abs({self._after} - rank) + {self.damping!r}D * abs(rank - sent)) AS off"),
                    F.expr("sum(messages) AS messages"))
            state = told.selectExpr("node", "strength", "arcs", "salts", f"{weight!r}D * ({self._after} - before) + before AS rank",
                                    "rank AS before", "got", "sent", "messages")
            if written:
                state = self.state = self.arcs.place(state)
                off, self.messages, self.rounds = seen.get["off"] or 0.0, seen.get["messages"] or 0, i
                if off < self.tol:
                    break
                held = max(0.01 * off, 0.1 * self.tol) / max(1, self.arcs.linked)
        return self

    @property
    def _after(self) -> str:
        """A node's rank after one more power round."""
        return f"({self.base!r}D + {self.damping!r}D * got)"

    def _told(self, state: DataFrame, held: float) -> DataFrame:
        """The state once every node has sent what changed by more than ``held``."""
        sends = f"abs(rank - sent) > {held!r}D"
        sent = self.arcs.send(state.where(sends).selectExpr("node", "salts", "strength", "rank - sent AS change"))
        sent = sent.selectExpr("dst", "change * weight / strength AS part")
        news = self.arcs.dealt(sent).groupBy("dst").agg(F.expr("sum(part) AS news"))
        return state.join(news.hint("merge"), F.expr("node = dst"), "left").selectExpr(
            "node", "strength", "arcs", "salts", "rank", "before", "got + coalesce(news, 0D) AS got",
            f"if({sends}, rank, sent) AS sent", f"messages + if({sends}, arcs, 0) AS messages")


def rank_percentile(df: DataFrame, value: str, key: str, name: str = "influence_score") -> DataFrame:
    """0–100 place of each row ordered by ``(value, key)``; the largest gets 100."""
    placed = global_row_number(df, [F.round(value, 12), F.col(key)], "__place")
    last = max(1, placed.count() - 1)
    return placed.withColumn(name, F.bround(
        F.lit(100) * (F.col("__place") - 1) / F.lit(last), 0).cast("int")).drop("__place")


def connected_components(nodes: DataFrame, key: str, edges: DataFrame) -> DataFrame:
    """``(node, component)`` with the smallest node as label; a lonely node is its own.

    Alternating large-star and small-star steps (Kiveris et al., 2014): each step is a
    minimum per node and a join, and the edge count does not grow. Ends with stars.
    """
    ids = nodes.select(F.col(key).alias("node"))
    found = (
        edges.where(F.col("src") != F.col("dst"))
        .select(F.greatest("src", "dst").alias("high"), F.least("src", "dst").alias("low"))
        .distinct()
    )
    for end in ("high", "low"):
        found = found.join(ids.select(F.col("node").alias(end)), end, "left_semi")
    found = cut_lineage(found.select("high", "low"))
    seen = None
    while (mark := _fingerprint(found)) != seen:
        seen = mark
        found = cut_lineage(_small_star(_large_star(found)))
    labels = found.select(F.col("high").alias("node"), F.col("low").alias("component"))
    return ids.join(labels, "node", "left").select(
        "node", F.coalesce("component", "node").alias("component"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Hang every larger neighbour of a node on the smallest node around it."""
    both = both_directions(edges.select(F.col("high").alias("src"), F.col("low").alias("dst")))
    least = aggregate_apart(both, ["src"], F.min(F.least("src", "dst")).alias("low"))
    return both.where(F.col("dst") > F.col("src")).join(least, "src").select(
        F.col("dst").alias("high"), "low").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Hang a node and its smaller neighbours on the smallest of them."""
    least = aggregate_apart(edges, ["high"], F.min("low").alias("root"))
    moved = edges.join(least, "high").where(F.col("low") != F.col("root")).select(
        F.col("low").alias("high"), F.col("root").alias("low"))
    return moved.union(least.select("high", F.col("root").alias("low"))).distinct()


def _fingerprint(edges: DataFrame) -> tuple:
    mark = F.xxhash64("high", "low")
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(mark),
                           F.sum(mark.cast("decimal(38,0)"))).first())


def group_size(df: DataFrame, group: str, name: str) -> DataFrame:
    """Add the number of rows sharing ``group``."""
    return df.join(aggregate_apart(df, [group], F.count(F.lit(1)).alias(name)), group)


def leave_one_out_rate(df: DataFrame, group: str, flag: str, size: str, rate: str) -> DataFrame:
    """Add the group size and the share of the *other* rows that carry ``flag``.

    3 decimals, half to even; 0 for a row alone in its group.
    """
    own = F.when(F.col(flag), 1).otherwise(0)
    sums = aggregate_apart(df, [group], F.count(F.lit(1)).alias(size), F.sum(own).alias("__flagged"))
    others = F.col(size) - 1
    share = F.when(others > 0, F.bround((F.col("__flagged") - own) / others, 3)).otherwise(0.0)
    return df.join(sums, group).withColumn(rate, share).drop("__flagged")


def with_features(df: DataFrame, key: str, features: DataFrame, feature_key: str) -> DataFrame:
    """Write features back as columns of their table, replacing earlier ones."""
    fresh = [c for c in features.columns if c != feature_key]
    kept = df.drop(*(c for c in fresh if c in df.columns))
    side = features.withColumnRenamed(feature_key, "__feature_key")
    return kept.join(side, F.col(key) == F.col("__feature_key"), "left").drop("__feature_key")


def feature_summary(lines: DataFrame, customers: DataFrame) -> DataFrame:
    """Lines, communities, and customers in households of more than one account."""
    none = F.lit(None).cast("long")
    left = lines.agg(F.count(F.lit(1)).alias("lines"),
                     F.count_distinct("community_id").alias("communities"))
    right = customers.agg(F.count(F.when(F.col("household_size") > 1, 1)).alias(
        "customers_in_households"))
    both = left.withColumn("customers_in_households", none).unionByName(
        right.withColumns({"lines": none, "communities": none}))
    return both.agg(*(F.max(c).alias(c) for c in both.columns))


def node_id(label: str, key: Column) -> Column:
    return F.concat(F.lit(f"{label}:"), key.cast("string"))


def caption(df: DataFrame, key: str, names: Sequence[str]) -> Column:
    """The first name-like column that is set, else the key."""
    return F.coalesce(*(F.col(c).cast("string") for c in names if c in df.columns),
                      F.col(key).cast("string"))


def expand(edges: DataFrame, captions: DataFrame, seeds: DataFrame, priority: Mapping[str, int],
           limit: int = EXPAND_LIMIT, hidden: Sequence[str] = ()) -> DataFrame:
    """The most telling edges around each seed.

    ``edges(type, src, dst, calls)`` and ``captions(node, caption)`` use ids like ``Label:key``.
    Per seed at most ``limit`` edges by type priority, then calls. ``truncated`` compares
    with all edges of the seed, those to hidden labels included.
    """
    both = both_directions(edges.withColumn("__forward", F.col("src"))).withColumn(
        "outgoing", F.col("__forward") == F.col("src")).drop("__forward")
    wanted = seeds.select(F.col("node").alias("src")).distinct()
    near = both.join(wanted, "src", "left_semi")
    if hidden:
        near = near.where(~F.substring_index("dst", ":", 1).isin(list(hidden)))
    place = F.lit(99)
    if priority:
        chain = F
        for name, rank in priority.items():
            chain = chain.when(F.col("type") == name, rank)
        place = chain.otherwise(99)
    order = [place, F.coalesce("calls", F.lit(0)).desc(), F.col("type"), F.col("dst")]
    # At most `limit` rows per seed, and used three times below.
    shown = cut_lineage(top_per_group(near, ["src"], order, limit))
    ends = shown.select(F.explode(F.array("src", "dst")).alias("src")).distinct()
    degrees = both.join(ends, "src", "left_semi").groupBy("src").agg(
        F.count(F.lit(1)).alias("degree"))
    sizes = shown.groupBy("src").agg(F.count(F.lit(1)).alias("__shown"))
    seed = degrees.select("src", F.col("degree").alias("seed_degree"))
    other = degrees.select(F.col("src").alias("dst"), F.col("degree").alias("neighbour_degree"))
    named = captions.select(F.col("node").alias("dst"), "caption")
    return (
        shown.join(sizes, "src").join(seed, "src").join(other, "dst").join(named, "dst", "left")
        .select(F.col("src").alias("seed"), "rank", "type", "outgoing",
                F.col("dst").alias("neighbour"), "caption", "neighbour_degree", "seed_degree",
                (F.col("seed_degree") > F.col("__shown")).alias("truncated"))
    )


def search(catalog: Catalog, text: str, limit: int = SEARCH_LIMIT) -> DataFrame | None:
    """Anchors whose key starts with the text, or with a text field containing it."""
    text = text.strip()
    if not text:
        return None
    found = None
    for anchor in catalog.anchors:
        entity = catalog.entity(anchor.name)
        key = F.col(entity.key).cast("string")
        hit = key.startswith(text)
        for a in entity.attributes:
            if a.type == "string" and a.source != entity.key:
                hit = hit | F.lower(a.source).contains(text.lower())
        rows = catalog.tables[entity.table].where(hit).orderBy(entity.key).limit(limit)
        rows = rows.select(F.lit(entity.name).alias("entity"), key.alias("key"))
        found = rows if found is None else found.unionByName(rows)
    return found.orderBy("entity", "key").limit(limit)
