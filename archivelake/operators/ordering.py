"""The order of a table of contents when it is written.

Phase 1 sorts by priority, namespace, tag and description, nulls last, on columns.
Phase 2 moves entries behind what they depend on.  It is one sequential pass on the
driver, over entries that depend on others or are depended upon; of a table of contents
that is a DataFrame (``ranks``), nothing else of these and none of the others go there.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.objecttypes import priority, priority_of
from ..functions.wire import Entry


def sort_key(e: Entry) -> tuple:
    def nulls_last(s: str | None) -> tuple:
        return s is None, (s or "").encode()

    return priority(e.desc), nulls_last(e.namespace), nulls_last(e.tag), e.desc.encode()


def sort_columns() -> list[Column]:
    """Phase 1 as columns of a table of contents."""
    return [priority_of(F.col("desc")), F.col("namespace").asc_nulls_last(), F.col("tag").asc_nulls_last(), F.col("desc"), F.col("toc_pos")]


def numbered(rows: DataFrame, order: Sequence[Column], path: str) -> DataFrame:
    """``rows`` with ``nth``, from 0 in that order, written to ``path``; of the rows, only a count for each
    partition of the sort goes to the driver."""
    part, inside = F.spark_partition_id(), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    rows.orderBy(*order).select("*", part.alias("_part"), inside.alias("_inside")).write.parquet(path)
    spark = rows.sparkSession
    found = spark.read.parquet(path)
    starts, at = [], 0
    for r in sorted(found.groupBy("_part").count().collect()):
        starts.append((r["_part"], at))
        at += r["count"]
    first = F.broadcast(spark.createDataFrame(starts, "_part int, _first long"))
    return found.join(first, "_part").withColumn("nth", F.col("_first") + F.col("_inside")).drop("_part", "_first", "_inside")


def phase1(toc: DataFrame, path: str) -> DataFrame:
    """``toc``, written to ``path``, with ``sort_pos``, the place of each entry by phase 1."""
    return numbered(toc, sort_columns(), path).withColumnRenamed("nth", "sort_pos")


def ranks(toc: DataFrame, order: Sequence[Column], path: str) -> tuple[DataFrame, list[Column]]:
    """``toc`` and columns by which it has the order of both phases; ``order``: phase 1, without ties.
    Files below ``path`` hold it meanwhile."""
    needed = toc.select(F.explode("dependencies").alias("dump_id")).distinct().join(toc.select("dump_id"), "dump_id", "left_semi")
    if needed.isEmpty():
        return toc, list(order)
    toc = numbered(toc, order, f"{path}-phase1")
    linked = toc.join(needed.withColumn("needed", F.lit(True)), "dump_id", "left")
    linked = linked.where("needed or size(dependencies) > 0 or dump_id <= 0").select("nth", "dump_id", "dependencies").orderBy("nth").collect()
    places = [r.nth for r in linked]
    free, never = _freed([Entry(r.dump_id, "", dependencies=tuple(r.dependencies)) for r in linked])
    # Entries that never become free are first, in reversed order.  The others fall from the end on, so one
    # stands behind all that have a smaller place than any that fell before it.
    moved, low = [(places[i], 0, -places[i], 0) for i in never], None
    for k, i in enumerate(free):
        low = places[i] if low is None else min(low, places[i])
        moved.append((places[i], 1, low, -k))
    moved = F.broadcast(toc.sparkSession.createDataFrame(moved, "nth long, _late int, _low long, _back long"))
    toc = toc.join(moved, "nth", "left")
    return toc, [F.coalesce("_late", F.lit(1)), F.coalesce("_low", "nth"), F.coalesce("_back", F.lit(0))]


def by_dependencies(entries: Sequence[Entry]) -> list[Entry]:
    """Phase 2 of entries that phase 1 has sorted.

    The result is filled from its end: always with the last entry on which no entry
    depends that isn't placed yet.  Entries that never become free (cycles, what
    they depend on, and ids below 1) come first, in reversed order.
    """
    if len(entries) < 2 or max(e.dump_id for e in entries) <= 0:
        return list(entries)
    free, never = _freed(entries)
    return [entries[i] for i in [*free, *never][::-1]]


def _freed(entries: Sequence[Entry]) -> tuple[list[int], list[int]]:
    """The places of entries as they become free, and of those that never do."""
    # Of entries that share an id, the last takes its dependents.
    place = {e.dump_id: i for i, e in enumerate(entries) if e.dump_id > 0}
    waiting = Counter(d for e in entries for d in e.dependencies if d in place)
    free = [-i for i, e in enumerate(entries) if e.dump_id > 0 and not waiting[e.dump_id]]
    heapq.heapify(free)
    out = []
    while free:
        i = -heapq.heappop(free)
        out.append(i)
        for d in entries[i].dependencies:
            if d in place:
                waiting[d] -= 1
                if not waiting[d]:
                    heapq.heappush(free, -place[d])
    placed = set(out)
    return out, [i for i in range(len(entries)) if i not in placed]


def ordered(entries: Sequence[Entry]) -> list[Entry]:
    """Both phases."""
    return by_dependencies(sorted(entries, key=sort_key))
