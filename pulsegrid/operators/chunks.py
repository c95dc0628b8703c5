"""Previous rows and running sums of long recordings, in time chunks.

A recording of one participant may hold any share of all samples, so a window over the participant would be one task.
Here windows go over (participant, chunk of time); what passes from chunk to chunk is one row per chunk, joined back.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from ..functions.columns import DAY, micros


def chunked(df: DataFrame, ts: str, size_us: int = DAY) -> DataFrame:
    """df with the number of its time chunk."""
    return df.withColumn("__chunk", F.floor(micros(ts) / F.lit(size_us)))


def linked(df: DataFrame, keys: list[str], order: list[str], before: dict[str, Column] | None = None, after: dict[str, Column] | None = None, sums: dict[str, Column] | None = None) -> DataFrame:
    """df with values of the row before each (`before`), of the row after (`after`), and running sums with the row's own.

    The first column of the order is a timestamp; rows without a key or a time are no samples and are left out. What
    passes from chunk to chunk is one summary row a chunk for all columns together. Edges of a recording give null.
    """
    before, after, sums = before or {}, after or {}, sums or {}
    df = chunked(df, order[0]).withColumns({f"__v_{n}": F.struct(c.alias("v")) for n, c in (before | after).items()})
    first_last = F.struct(*order)
    ends = df.groupBy(*keys, "__chunk").agg(
        *[F.max_by(f"__v_{n}", first_last).alias(f"__e_{n}") for n in before],
        *[F.min_by(f"__v_{n}", first_last).alias(f"__e_{n}") for n in after],
        *[F.sum(c).alias(f"__e_{n}") for n, c in sums.items()],
    )
    over, own = Window.partitionBy(*keys).orderBy("__chunk"), Window.partitionBy(*keys, "__chunk").orderBy(*order)
    past = over.rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(
        *keys,
        "__chunk",
        *[F.lag(f"__e_{n}").over(over).alias(f"__e_{n}") for n in before],
        *[F.lead(f"__e_{n}").over(over).alias(f"__e_{n}") for n in after],
        *[F.coalesce(F.sum(f"__e_{n}").over(past), F.lit(0)).alias(f"__e_{n}") for n in sums],
    )
    up = own.rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumns(
        {f"__o_{n}": F.lag(f"__v_{n}").over(own) for n in before}
        | {f"__o_{n}": F.lead(f"__v_{n}").over(own) for n in after}
        | {f"__o_{n}": F.sum(c).over(up) for n, c in sums.items()}
    )
    out = df.join(ends, [*keys, "__chunk"])
    out = out.withColumns({n: F.coalesce(f"__o_{n}", f"__e_{n}")["v"] for n in before | after} | {n: F.col(f"__o_{n}") + F.col(f"__e_{n}") for n in sums})
    return out.drop("__chunk", *[f"__{k}_{n}" for k in "voe" for n in before | after | sums])


def previous(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """df with `value` of the row before in the order (null for a key's first row)."""
    return linked(df, keys, order, before={name: value})


def running(df: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column]) -> DataFrame:
    """df with running sums up to and with each row."""
    return linked(df, keys, order, sums=sums)


def known(df: DataFrame, keys: list[str], order: list[str], point: Column, before: str, after: str) -> DataFrame:
    """df with the nearest `point` that isn't null, at or before each row and at or after it."""
    df = chunked(df.withColumn("__point", point), order[0])
    at = F.when(F.col("__point").isNotNull(), F.struct(*order))
    ends = df.groupBy(*keys, "__chunk").agg(F.max_by("__point", at).alias("__last"), F.min_by("__point", at).alias("__first"))
    own = Window.partitionBy(*keys, "__chunk").orderBy(*order)
    x = df.withColumn("__b", F.last("__point", True).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    x = x.withColumn("__a", F.first("__point", True).over(own.rowsBetween(0, Window.unboundedFollowing)))
    x = x.join(beyond(ends, keys), [*keys, "__chunk"])
    x = x.withColumns({before: F.coalesce("__b", "__last"), after: F.coalesce("__a", "__first")})
    return x.drop("__chunk", "__point", "__a", "__b", "__last", "__first")


def beyond(ends: DataFrame, keys: list[str]) -> DataFrame:
    """One row per chunk with its __first and __last value, to the last one of all chunks before and the first after."""
    over = Window.partitionBy(*keys).orderBy("__chunk")
    last = F.last("__last", True).over(over.rowsBetween(Window.unboundedPreceding, -1))
    first = F.first("__first", True).over(over.rowsBetween(1, Window.unboundedFollowing))
    return ends.select(*keys, "__chunk", last.alias("__last"), first.alias("__first"))


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str = "idx") -> DataFrame:
    """df with each row's number in the order, from 0."""
    out = running(df, keys, order, {name: F.lit(1).cast("long")})
    return out.withColumn(name, F.col(name) - 1)


def numbered_by(df: DataFrame, keys: list[str], index: str, name: str = "idx", size: int = 1 << 20) -> DataFrame:
    """df with each row's number by a whole-number column without ties, from 0: within ranges of `size` of it, and one row
    a range for what lies before."""
    x = df.withColumn("__range", F.floor(F.col(index) / F.lit(size)))
    over = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    before = x.groupBy(*keys, "__range").count().select(*keys, "__range", F.coalesce(F.sum("count").over(over), F.lit(0)).alias("__before"))
    inside = x.withColumn(name, F.row_number().over(Window.partitionBy(*keys, "__range").orderBy(index)) - 1)
    return inside.join(before, [*keys, "__range"]).withColumn(name, (F.col(name) + F.col("__before")).cast("long")).drop("__range", "__before")


def haloed(df: DataFrame, keys: list[str], index: str, size: int, before: int, after: int, chunk: str = "chunk", mine: str = "own") -> DataFrame:
    """Numbered rows dealt to chunks of `size`, each with the `before` rows ahead of it and the `after` rows behind it:
    df with chunk, and own for the rows that the chunk itself holds.

    A function of at most so many neighbours is then exact on the own rows, and no task holds a whole recording.
    """
    i, n = F.col(index), F.lit(size)
    first, own = F.greatest(F.floor((i - after) / n), F.lit(0).cast("long")), F.floor(i / n)
    last = F.floor((i + before) / n)
    # chunks that hold no row of their own come from the last rows only; their rows aren't own, so they give nothing
    return df.withColumn(chunk, F.explode(F.sequence(F.least(first, own), last))).withColumn(mine, F.col(chunk) == own)


def framed(df: DataFrame, keys: list[str], order: list[str], before: int, after: int, make: Callable[[DataFrame, WindowSpec], DataFrame], size: int = 1 << 16) -> DataFrame:
    """What `make` adds to df by windows that reach at most `before` rows back and `after` rows ahead.

    make gets numbered rows (__idx, from 0) in chunks with their halos, and the window over a chunk in order.
    """
    x = numbered(df, keys, order, "__idx")
    x = haloed(x, keys, "__idx", max(size, 4 * (before + after)), before, after, "__part", "__own")
    return make(x, Window.partitionBy(*keys, "__part").orderBy("__idx")).where("__own").drop("__idx", "__part", "__own")


def grouped_from(df: DataFrame, keys: list[str], chunk: str, index: str, opens: str, name: str) -> DataFrame:
    """df (numbered rows in chunks, each row once) with a group that begins with a row that `opens` one and goes on up to
    the next chunk that has such a row: what lies between two opening rows is always in one group, -1 before the first.

    Groups are about as long as chunks where opening rows are frequent; one row a chunk is gone through in order.
    """
    firsts = df.groupBy(*keys, chunk).agg(F.min(F.when(F.col(opens), F.col(index))).alias("__first"))
    over = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    before = F.last(F.when(F.col("__first").isNotNull(), F.col(chunk)), True).over(over)
    firsts = firsts.select(*keys, chunk, "__first", F.coalesce(before, F.lit(-1)).alias("__before"))
    inside = F.coalesce(F.col(index) >= F.col("__first"), F.lit(False))
    return df.join(firsts, [*keys, chunk]).withColumn(name, F.when(inside, F.col(chunk)).otherwise(F.col("__before"))).drop("__first", "__before")


#: Parts into which the rows of one key are dealt for a join with a small table.
PARTS = 32


def spread(df: DataFrame, small: DataFrame, keys: list[str], by: str) -> DataFrame:
    """df left-joined with `small`, which has a row a key. Rows of a key are dealt out by their column `by`, and the small
    table's rows are repeated as often, so no task has all rows of a key and nothing is broadcast."""
    parts = small.withColumn("__deal", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    dealt = df.withColumn("__deal", F.pmod(F.xxhash64(by), F.lit(PARTS)).cast("int"))
    return dealt.join(parts, [*keys, "__deal"], "left").drop("__deal")


_ARROW = {"boolean": pa.bool_(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "string": pa.string(), "array<int>": pa.list_(pa.int32()), "array<double>": pa.list_(pa.float64())}


def _starts(rows: pa.Table, by: list[str]) -> np.ndarray:
    """The numbers of rows that differ from the row before in one of the columns; the first one counts."""
    new = np.arange(len(rows)) == 0
    for column in (rows.column(k) for k in by):
        a, b = column.slice(1), column.slice(0, len(rows) - 1)
        new[1:] |= pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(pc.is_null(a), pc.is_null(b))).to_numpy()
    return np.flatnonzero(new)


def _column(parts: list, kind: pa.DataType) -> pa.Array:
    if all(isinstance(p, np.ndarray) and p.dtype != object for p in parts):
        return pa.array(np.concatenate(parts), type=kind, from_pandas=True)
    return pa.array(list(chain.from_iterable(parts)), type=kind, from_pandas=True)


def each_group(df: DataFrame, by: list[str], order: list[str], make: Callable[[dict[str, np.ndarray]], tuple | None], keep: list[str], new: dict[str, str]) -> DataFrame:
    """by, `keep` and the columns `new` (name: type), of what `make` gives for each group of rows equal in `by`.

    make gets the group's columns as arrays in the order (nulls of numbers as NaN). It gives rows of the group, whose `by`
    and `keep` go on, and the new columns for them (NaN is null); or None for nothing. A row may be given any number of
    times. Groups lie side by side in sorted batches, so recordings of some rows each cost little more than their rows;
    a task holds a batch or a group at once.
    """
    names = [*by, *keep, *new]

    def found(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        starts = _starts(rows, by).tolist()
        columns = {c: rows.column(c).to_numpy() for c in rows.column_names}
        places, values = [], {c: [] for c in new}
        for a, b in zip(starts, [*starts[1:], len(rows)], strict=True):
            given = make({c: v[a:b] for c, v in columns.items()})
            if given is not None and len(given[0]):
                places.append(np.asarray(given[0]) + a)
                for c in new:
                    values[c].append(given[1][c])
        if places:
            old = rows.select([*by, *keep]).take(pa.array(np.concatenate(places))).combine_chunks().to_batches()[0]
            yield pa.RecordBatch.from_arrays([*old.columns, *[_column(values[c], _ARROW[kind]) for c, kind in new.items()]], names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []  # of a group that may go on
        for batch in (b for b in batches if b.num_rows):
            seen = pa.Table.from_batches([*[h.slice(h.num_rows - 1) for h in held[-1:]], batch])
            cut = int(_starts(seen, by)[-1])
            whole = cut > 0
            cut -= len(seen) - batch.num_rows
            if whole:
                yield from found(pa.Table.from_batches([*held, batch.slice(0, cut)]).combine_chunks())
                held = []
            held.append(batch.slice(max(cut, 0)))
        if held:
            yield from found(pa.Table.from_batches(held).combine_chunks())

    schema = df.select(*by, *keep, *[F.lit(None).cast(kind).alias(c) for c, kind in new.items()]).schema
    # by a hash of `by`: Spark drops a repartition by columns that a join before has, and then may read that join's rows
    # in other parts
    return df.repartition(F.xxhash64(*by)).sortWithinPartitions(*by, *order).mapInArrow(run, schema)
