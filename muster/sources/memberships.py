"""Who belongs to which saved audience, as partitioned Parquet.

Layout: ``members/anchor=…/build=…/segment_id=…/part=…`` holds ``(member_key, group)`` and is never
changed once written; the parts of an audience are consecutive ranges of its keys, and ``pages/…`` has one
row per part with its counts, so that a page of members is found and read without the others. ``state`` has one row of bookkeeping per audience that names its build and
the type of its keys. A build counts from the moment the state names it: a failed write leaves all
audiences as they were, and an audience that is empty now needs no file.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable
from functools import reduce
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from muster.session import cut_lineage

STATE_SCHEMA = ("segment_id string, anchor string, version int, holdout_pct double, as_of date, "
                "built_at timestamp, member_count long, target_count long, control_count long, "
                "build string, key_type string")
STATE_COLUMNS = [part.split()[0] for part in STATE_SCHEMA.split(", ")]


class MembershipStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")

    def _folder(self, anchor: str, build: str) -> str:
        return f"{self.path}/members/anchor={anchor}/build={build}"

    def _pages(self, anchor: str, build: str) -> str:
        return f"{self.path}/pages/anchor={anchor}/build={build}"

    def _read_parts(self, anchor: str, build: str, key_type: str) -> DataFrame:
        schema = f"member_key {key_type}, group string, segment_id string, part int"
        return self.spark.read.schema(schema).parquet(self._folder(anchor, build))

    def _read_build(self, anchor: str, build: str, key_type: str, ids: list[str]) -> DataFrame:
        found = self._read_parts(anchor, build, key_type)
        return found.where(F.col("segment_id").isin(ids)).select("segment_id", "member_key", "group")

    def write(self, anchor: str, members: DataFrame, segment_ids: Iterable[str]) -> tuple[str, str, dict[str, Row]]:
        """Write a build of ``members(segment_id, member_key, group)``; nobody sees it yet.

        Returns its name, its key type, and the group counts per audience as read back.
        """
        ids = list(segment_ids)
        for segment_id in ids:
            if not re.fullmatch(r"[A-Za-z0-9_.-]+", segment_id):
                raise ValueError(f"unsuitable segment id {segment_id!r}")
        build = uuid.uuid4().hex[:12]
        key_type = members.schema["member_key"].dataType.simpleString()
        # Written before it is sorted: finding the ranges reads the rows once more.
        found = cut_lineage(members.select("segment_id", "member_key", "group"))
        ranged = found.repartitionByRange("segment_id", "member_key").withColumn("part", F.spark_partition_id())
        ranged.sortWithinPartitions("segment_id", "member_key").write.partitionBy("segment_id", "part").parquet(
            self._folder(anchor, build))
        held = F.count(F.when(F.col("group") == "control", 1))
        pages = self._read_parts(anchor, build, key_type).where(F.col("segment_id").isin(ids)).groupBy(
            "segment_id", "part").agg(F.count(F.lit(1)).alias("members"), held.alias("control"))
        pages.coalesce(1).write.parquet(self._pages(anchor, build))
        counted = self.spark.read.parquet(self._pages(anchor, build)).groupBy("segment_id").agg(
            F.sum("members").alias("members"), F.sum("control").alias("control"))
        return build, key_type, {r.segment_id: r for r in counted.collect()}

    def page(self, anchor: str, segment_id: str, limit: int | None, skip: int = 0, group: str | None = None,
             state: dict[str, Row] | None = None) -> DataFrame:
        """``(member_key, group)`` of the members ``skip+1 … skip+limit`` by key, of one group if it is given.

        The parts they lie in follow from the counts, one row per part; only these are read, and only what
        is in them is put in order.
        """
        built = (self.state() if state is None else state)[segment_id]
        counts = self.spark.read.parquet(self._pages(anchor, built.build)).where(F.col("segment_id") == segment_id)
        number = {None: F.col("members"), "control": F.col("control")}.get(group, F.col("members") - F.col("control"))
        before, wanted = 0, []
        for row in counts.select("part", number.alias("n")).orderBy("part").toLocalIterator():
            if row.n and before + row.n > skip and (limit is None or before < skip + limit):
                wanted.append((row.part, before))
            before += row.n
        rows = self._read_parts(anchor, built.build, built.key_type).where(
            (F.col("segment_id") == segment_id) & F.col("part").isin([part for part, _ in wanted]))
        if group is not None:
            rows = rows.where(F.coalesce("group", F.lit("target")) == group)
        place = F.row_number().over(W.partitionBy("part").orderBy("member_key"))
        starts = self.spark.createDataFrame(wanted, "part int, before long")
        placed = rows.withColumn("place", place).join(starts, "part")
        inside = F.col("before") + F.col("place") > skip
        if limit is not None:
            inside &= F.col("before") + F.col("place") <= skip + limit
        return placed.where(inside).select("member_key", "group")

    def read(self, anchor: str, segment_ids: Iterable[str], state: dict[str, Row] | None = None) -> DataFrame:
        """``(segment_id, member_key, group)`` of the current builds of these audiences.

        Files are read by the key type of their build, never by what their names look like.
        """
        state = self.state() if state is None else state
        builds: dict[tuple[str, str], list[str]] = {}
        for i in segment_ids:
            if i not in state or state[i].anchor != anchor:
                raise LookupError(f"{i} has not been built for {anchor}")
            builds.setdefault((state[i].build, state[i].key_type), []).append(i)
        parts = [self._read_build(anchor, build, key_type, ids) for (build, key_type), ids in builds.items()]
        return reduce(DataFrame.unionByName, parts)

    def state(self) -> dict[str, Row]:
        """Bookkeeping of every audience built so far: one small row each."""
        try:
            rows = self.spark.read.schema(STATE_SCHEMA).parquet(f"{self.path}/state").select(
                *STATE_COLUMNS).collect()
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return {}
        return {r.segment_id: r for r in rows}

    def put_state(self, rows: list[tuple[Any, ...]]) -> dict[str, Row]:
        """Replace the bookkeeping of the audiences in ``rows``, leaving the others."""
        made = self.spark.createDataFrame(rows, STATE_SCHEMA).coalesce(1)
        made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
            "segment_id").parquet(f"{self.path}/state")
        kept = Row(*STATE_COLUMNS)
        return {row[0]: kept(*row) for row in rows}
