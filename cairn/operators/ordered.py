"""Rows of one key in order, without a task for a key: each row's predecessor and number, the ends of chains of predecessors, and pages of an order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import dropped, written


def previous_of_key(rows: DataFrame, key: str, number: str) -> DataFrame:
    """``rows`` with ``before``: the largest smaller ``number`` of the same ``key``, or null.  Numbers are longs, and a key has each but once.

    Rows are sorted by key and number over all tasks, so a hot key goes over many of them; a task looks at neighbours only, and what the last row
    of a task says about the first one of the next comes from two rows a task, which the driver reads.
    """
    columns = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, held = TaskContext.get().partitionId(), None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                yield held
            keys, numbers = batch.column(key), batch.column(number).to_numpy()
            same = np.ones(batch.num_rows, bool)
            same[1:] = pc.equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False)
            same[0] = last is not None and last[0] == keys[0].as_py()
            before = np.concatenate(([last[1] if last else 0], numbers[:-1]))
            edge = np.zeros(batch.num_rows, np.int8)
            edge[0] = last is None
            last = keys[batch.num_rows - 1].as_py(), int(numbers[-1])
            held = pa.RecordBatch.from_arrays([*batch.columns, pa.array(before, mask=~same), pa.array(np.full(batch.num_rows, part, np.int32)), pa.array(edge)], [*columns, "before", "_part", "_edge"])
        if held is not None:  # the last row of the task
            edge = held.column("_edge").to_numpy().copy()
            edge[-1] += 2
            yield pa.RecordBatch.from_arrays([*held.columns[:-1], pa.array(edge)], held.schema.names)

    fields = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in columns)
    ordered = rows.repartitionByRange(key, number).sortWithinPartitions(key, number)
    placed = written(ordered.mapInArrow(run, f"{fields}, before bigint, _part int, _edge tinyint"), "in-order")
    known, last = {}, None
    for part, edge, its_key, its_number in _edges(placed, key, number):
        if edge & 1 and last is not None and last[0] == its_key:
            known[part] = last[1]
        if edge & 2:
            last = its_key, its_number
    if not known:
        return placed.select(*columns, "before")
    fixed = rows.sparkSession.createDataFrame(sorted(known.items()), "_at int, _known bigint")
    joined = placed.join(F.broadcast(fixed), F.col("_part") == F.col("_at"), "left")  # a row a task at most
    return joined.select(*columns, F.when(F.col("_edge").bitwiseAND(1) == 1, F.col("_known")).otherwise(F.col("before")).alias("before"))


def _edges(placed: DataFrame, key: str, number: str) -> list[tuple]:
    """The first and the last row of each task, in order."""
    rows = placed.filter("_edge > 0").select("_part", F.col("_edge").cast("int"), key, number).collect()
    return sorted(map(tuple, rows), key=lambda r: (r[0], r[1]))


def chain_ends(parents: DataFrame) -> DataFrame:
    """``node, root, turn``: where chains ``node, parent`` end, in rounds by the logarithm of the longest chain; a root has no row of its own.

    Each round doubles every pointer that has not reached its end; those that have leave the rounds.  ``turn``, where ``parents`` has it, is 0 or 1 a step and is summed to
    odd or even on the way.  Nodes of a cycle, and those that lead into one, have no end and no row.
    """
    turned = parents if "turn" in parents.columns else parents.withColumn("turn", F.lit(0))
    open_, done = written(turned.select("node", "parent", F.col("turn").cast("int").alias("turn")), "pointers"), None
    for _ in range(open_.count().bit_length() + 2):  # a longer chain has more nodes
        next_ = open_.select(F.col("node").alias("_next"), F.col("parent").alias("_far"), F.col("turn").alias("_turn"))
        moved = written(open_.join(next_, F.col("parent") == F.col("_next"), "left").select("node", "parent", "turn", "_far", "_turn"), "pointers")
        ended = moved.filter("_far is null").select("node", F.col("parent").alias("root"), "turn")
        done = ended if done is None else done.unionByName(ended)
        left = moved.filter("_far is not null")
        dropped(open_)
        if left.isEmpty():
            break
        # Each pointer stands at a root or at a row of this round; where that row has just ended, at its end.
        known = ended.select(F.col("node").alias("_met"), F.col("root").alias("_end"), F.col("turn").alias("_last"))
        jumped = left.join(known, F.col("_far") == F.col("_met"), "left")
        turn = (F.col("turn") + F.col("_turn") + F.coalesce("_last", F.lit(0))) % 2
        open_ = written(jumped.select("node", F.coalesce("_end", "_far").alias("parent"), turn.cast("int").alias("turn")), "pointers")
    return done


def numbered(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """``rows`` with ``number``: from 1 for each ``key``, in ascending ``order``; rows that tie are numbered as they come.

    As in ``previous_of_key``, one sort goes over all tasks; each numbers what it has, and what a key has in the tasks before comes from two rows a task, which the driver reads.
    """
    columns = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, held = TaskContext.get().partitionId(), None, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            if held is not None:
                yield held
            keys = batch.column(key)
            new = np.ones(n, bool)
            new[1:] = ~pc.equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False)
            new[0] = last is None or last[0] != keys[0].as_py()
            starts = np.flatnonzero(new)
            first = int(starts[0]) if len(starts) else n  # rows before it go on with the key of the batch before
            runs = np.repeat(starts, np.diff(np.append(starts, n)))
            own = np.concatenate((np.arange(first) + 1 + (last[1] if first else 0), np.arange(first, n) - runs + 1))
            edge = np.zeros(n, np.int8)
            edge[0] = last is None
            last = keys[n - 1].as_py(), int(own[-1])
            held = pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.astype(np.int64)), pa.array(np.full(n, part, np.int32)), pa.array(edge)], [*columns, "number", "_part", "_edge"])
        if held is not None:
            edge = held.column("_edge").to_numpy().copy()
            edge[-1] += 2
            yield pa.RecordBatch.from_arrays([*held.columns[:-1], pa.array(edge)], held.schema.names)

    fields = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in columns)
    ordered = rows.repartitionByRange(key, *order).sortWithinPartitions(key, *order)
    placed = written(ordered.mapInArrow(run, f"{fields}, number bigint, _part int, _edge tinyint"), "in-order")
    offsets, last, first = [], None, None
    for part, edge, its_key, number in _edges(placed, key, "number"):
        if edge & 1:
            first = (its_key, last[1]) if last is not None and last[0] == its_key else None
            if first:
                offsets.append((part, *first))
        if edge & 2:
            last = its_key, number + (first[1] if first and first[0] == its_key else 0)
    if not offsets:
        return placed.select(*columns, "number")
    kind = rows.schema[key].dataType.simpleString()
    fixed = F.broadcast(rows.sparkSession.createDataFrame(offsets, f"_at int, _key {kind}, _more bigint"))  # a row a task at most
    joined = placed.join(fixed, (F.col("_part") == F.col("_at")) & (F.col(key) == F.col("_key")), "left")
    return joined.select(*columns, (F.col("number") + F.coalesce("_more", F.lit(0))).alias("number"))


#: Rows that are sorted to take a page of them; ranges that a larger table is counted in, and rows that show where to cut them.
ENOUGH, RANGES, SHOWN = 10_000, 64, 1024


def _from(by: list[tuple[str, bool]], bound: tuple) -> Column:
    """Whether a row stands at or after ``bound`` in the order ``by`` (column, descending); nulls come first, or last where descending."""
    out = F.lit(True)
    for (column, down), value in reversed(list(zip(by, bound))):
        c, v = F.col(column), F.lit(value)
        same = c.eqNullSafe(v)
        after = (F.lit(False) if value is None else c.isNull() | (c < v)) if down else (c.isNotNull() if value is None else c.isNotNull() & (c > v))
        out = after | (same & out)
    return F.coalesce(out, F.lit(False))


def rows_between(rows: DataFrame, by: list[tuple[str, bool]], first: int, last: int) -> DataFrame:
    """Rows ``first`` to ``last`` (from 0, the last one left out) in the order ``by``, in that order.

    A table of more than ``ENOUGH`` rows is counted in ranges of the order, whose bounds are rows of it; only ranges that hold wanted rows are looked at again, and only
    the last of them are sorted.  Nothing is shuffled, and what stands before the page is counted, never moved.
    """
    orders = [F.col(c).desc() if down else F.col(c).asc() for c, down in by]
    names = [c for c, _ in by]
    count, before = rows.count(), 0
    while count > max(ENOUGH, 2 * (last - first)):
        shown = rows.select(*names).orderBy(F.xxhash64(*names), *names).limit(SHOWN).orderBy(*orders).collect()
        bounds = list(dict.fromkeys(tuple(r) for r in shown[len(shown) // RANGES :: max(1, len(shown) // RANGES)]))
        place = sum((_from(by, b).cast("int") for b in bounds), F.lit(0))
        counts = dict(rows.groupBy(place.alias("place")).count().collect())
        ends = np.cumsum([counts.get(i, 0) for i in range(len(bounds) + 1)])
        low, high = (int(np.searchsorted(ends, x - before, "right")) for x in (first, max(first, last - 1)))
        high = min(high, len(bounds))
        inside = int(ends[high]) - (int(ends[low - 1]) if low else 0)
        if low > len(bounds) or inside == count:
            break
        rows, before, count = rows.filter(place.between(low, high)), before + (int(ends[low - 1]) if low else 0), inside
    return rows.orderBy(*orders).offset(max(0, first - before)).limit(max(0, last - first))
