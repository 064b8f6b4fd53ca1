"""Dictionary joins that stay even when a few keys hold most rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, StringType, StructType

from faqloom.session import materialize

HOT_KEYS = 1000
SALTS = 256
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64 << 20
HOT_BYTES = 16 << 10


def _bytes(columns: list[str]) -> Column:
    return F.octet_length(F.to_json(F.struct(*columns)))


def fits_broadcast(entries: DataFrame) -> bool:
    """Whether a table is small in rows and bytes.  Each task sums up its own rows; one row per task moves."""
    seen = entries.agg(F.count("*"), F.sum(_bytes(entries.columns))).first()
    return seen[0] <= BROADCAST_ROWS and (seen[1] or 0) <= BROADCAST_BYTES


def small_side(entries: DataFrame) -> DataFrame:
    """Broadcast a table that was found to be small, else ask for a sort-merge join.

    Joins against exploded rows need this: the optimizer takes a table to be as large as its input, so without a hint
    it may broadcast the exploded side.
    """
    return F.broadcast(entries) if fits_broadcast(entries) else entries.hint("merge")


def lookup(
    facts: DataFrame, entries: DataFrame, key: str, values: list[str], weight: str | None = None
) -> DataFrame:
    """Left join ``facts`` with a dictionary of unique keys.

    A dictionary that was found to be small is broadcast and nothing is shuffled.  Beyond that, the ``HOT_KEYS``
    heaviest entries (by ``weight``) are broadcast, which is a fixed number of rows, and answer their rows on the spot;
    every other key then holds under 1/HOT_KEYS of the rows.  Rows already answered get salted probe keys that match
    nothing, so they spread evenly through the join that serves the rest.  Without a weight column the rows of
    ``facts`` are counted by key first.  A heavy entry of more than ``HOT_BYTES`` stays with the rest, so the broadcast
    is bounded in bytes as well.  Probe keys are text, whatever the type of the key.
    """
    slim = entries.select(key, *values)
    if fits_broadcast(slim):
        return facts.join(F.broadcast(slim), key, "left").select(*facts.columns, *values)
    if weight is None:
        weight = "_rows"
        heavy = facts.groupBy(key).agg(F.count("*").alias(weight)).orderBy(F.desc(weight), key).limit(HOT_KEYS)
        hot = entries.join(F.broadcast(heavy), key).filter(_bytes(values) <= HOT_BYTES)
        hot = hot.select(key, F.struct(*values).alias("_hot"))
    else:
        hot = _heaviest(entries, key, values, weight)
    return _probe_twice(facts, entries, key, values, hot)


def _heaviest(entries: DataFrame, key: str, values: list[str], weight: str) -> DataFrame:
    light = entries.filter(_bytes(values) <= HOT_BYTES)
    return light.orderBy(F.desc(weight), key).limit(HOT_KEYS).select(key, F.struct(*values).alias("_hot"))


def _probe_twice(facts: DataFrame, entries: DataFrame, key: str, values: list[str], hot: DataFrame) -> DataFrame:
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in facts.columns]), F.lit(SALTS)).cast("string")
    probed = facts.join(F.broadcast(hot), key, "left").withColumn(
        "_probe", F.when(F.col("_hot").isNull(), F.col(key).cast("string")).otherwise(F.concat(F.lit("\x00"), salt))
    )
    rest = entries.select(F.col(key).cast("string").alias("_probe"), F.struct(*values).alias("_rest"))
    found = F.coalesce("_hot", "_rest")
    return probed.join(rest, "_probe", "left").select(
        *facts.columns, *[found[v].alias(v) for v in values]
    )


#: Elements of the lists that are packed into one row at least; every pack asks for its own keys, so large ones ask for few.
PACK_ELEMENTS = 1 << 21


def lookup_lists(
    rows: DataFrame, column: str, entries: DataFrame, key: str, value: str, name: str, default: object = None
) -> DataFrame:
    """Rows with ``name``: the ``value`` of every element of the list ``column``, ``default`` where the dictionary lacks it.

    A dictionary that was found to be small is sent to the tasks, as a broadcast join would, and no list moves.  Beyond that
    lists are packed where they lie: some million elements become one row with their distinct keys and a block of numbers that
    point into them.  A pack asks once for each key it holds, however often, and only the blocks, which are a fraction of the
    lists, cross the network to meet the answers.  No list is sorted, a task holds one pack at a time, and a heavy key has one
    row per pack.
    """
    others = [c for c in rows.columns if c != column]
    schema = StructType([rows.schema[c] for c in others]).add(name, ArrayType(entries.schema[value].dataType))
    slim = entries.select(F.col(key).alias("_key"), F.col(value).alias("_value"))
    if fits_broadcast(slim):
        sent = rows.sparkSession.sparkContext.broadcast(slim.toArrow().combine_chunks())

        def map_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for few in _few(batch, column):  # whole texts are long: their lists are answered some at a time
                    yield from _filled(pa.Table.from_batches([few]), column, others, sent.value, name, default).to_batches()

        return rows.mapInArrow(map_lists, schema)
    packing = StructType().add("_g", StringType()).add("_keys", rows.schema[column].dataType).add("_lists", BinaryType())
    packs = materialize(rows.mapInArrow(lambda batches: _packed(batches, column), packing), "packed-lists", "zstd")
    # more partitions than packs: few of them share one, and tasks that have none end at once
    width = max(rows.sparkSession.sparkContext.defaultParallelism, 4 * packs.count())
    asked = packs.select("_g", F.posexplode("_keys").alias("_i", "_key"))
    known = asked.join(slim.hint("merge"), "_key", "left").select(F.col("_g").alias("_of"), "_i", "_value")

    def fill(lists: pa.Table, answers: pa.Table) -> pa.Table:
        return _unpacked(lists, answers, column, others, name, default)

    return packs.select("_g", "_lists").repartition(width, "_g").groupBy("_g").cogroup(known.groupBy("_of")).applyInArrow(fill, schema)


def _few(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with some two million elements of its lists at most, or one row."""
    ends = pc.cumulative_sum(pc.fill_null(pc.list_value_length(batch.column(column)), 0).cast(pa.int64())).to_numpy()
    at, done = 0, 0
    while at < len(batch):
        to = max(at + 1, int(ends.searchsorted(done + PACK_ELEMENTS, side="right")))
        yield batch.slice(at, to - at)
        at, done = to, ends[to - 1]


def _packed(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """_g, _keys, _lists: packs of rows, the elements of their lists as numbers of the distinct ones."""
    held, size, made = [], 0, 0
    part = TaskContext.get().partitionId()
    for batch in batches:
        held.append(batch)
        size += pc.sum(pc.list_value_length(batch.column(column))).as_py() or 0
        if size >= PACK_ELEMENTS:
            yield _pack(pa.Table.from_batches(held), column, f"{part}-{made}")
            held, size, made = [], 0, made + 1
    if held:
        yield _pack(pa.Table.from_batches(held), column, f"{part}-{made}")


def _pack(rows: pa.Table, column: str, pack: str) -> pa.RecordBatch:
    held = _whole(rows, column)
    coded = held.flatten().dictionary_encode()
    numbers = pa.ListArray.from_arrays(_offsets(held), coded.indices, mask=held.is_null())
    rows = rows.set_column(rows.schema.get_field_index(column), column, numbers)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(rows)
    keys = pa.ListArray.from_arrays(pa.array([0, len(coded.dictionary)], pa.int32()), coded.dictionary)
    return pa.RecordBatch.from_arrays([pa.array([pack]), keys, pa.array([sink.getvalue().to_pybytes()], pa.binary())],
                                      ["_g", "_keys", "_lists"])


def _unpacked(
    packs: pa.Table, answers: pa.Table, column: str, others: Sequence[str], name: str, default: object = None
) -> pa.Table:
    """The rows of a pack with the answers (_i, _value) in place of the numbers."""
    values = _whole(answers, "_value")
    made = []
    for pack in packs.column("_lists"):
        rows = pa.ipc.open_stream(pack.as_buffer()).read_all()
        held = _whole(rows, column)
        numbers = pc.index_in(held.flatten(), value_set=_whole(answers, "_i"))
        lists = pa.ListArray.from_arrays(_offsets(held), _or(values.take(numbers), default), mask=held.is_null())
        made.append(rows.select(others).append_column(name, lists))
    return pa.concat_tables(made)


def _whole(table: pa.Table, column: str) -> pa.Array:
    held = table.column(column).combine_chunks()
    return pa.concat_arrays(held.chunks) if isinstance(held, pa.ChunkedArray) else held


def _offsets(lists: pa.ListArray) -> pa.Array:
    """Where each list begins and ends among the elements of all, without those of null lists."""
    ends = pc.cumulative_sum(pc.fill_null(pc.list_value_length(lists), 0)).cast(pa.int32())
    return pa.concat_arrays([pa.array([0], pa.int32()), ends])


def _or(values: pa.Array, default: object) -> pa.Array:
    return values if default is None else pc.fill_null(values, pa.scalar(default, values.type))


def _filled(
    lists: pa.Table, column: str, others: Sequence[str], words: pa.Table, name: str, default: object = None
) -> pa.Table:
    """The lists of a table with each element's value in ``words`` (_key, _value)."""
    held = _whole(lists, column)
    keys = _whole(words, "_key")
    found = _whole(words, "_value").take(pc.index_in(held.flatten().cast(keys.type), value_set=keys))
    found = pa.ListArray.from_arrays(_offsets(held), _or(found, default), mask=held.is_null())
    return lists.select(others).append_column(name, found)
