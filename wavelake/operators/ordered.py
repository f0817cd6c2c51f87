"""Work that goes along an order, without a task for a whole key: numbers, running states, nearest rows.

Rows are dealt out by ranges of (keys, order). Each task does its own stretch
and leaves one row for each key that it holds; those rows tell every stretch
what the ones before it came to.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavelake.shared import stored


def _before(n: str, keys: list[str]) -> Column:
    """The sum of n over earlier tasks of the key."""
    return F.coalesce(F.sum(n).over(Window.partitionBy(*keys).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def numbered(frame: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """Rows with `name`, their number within the key by order, from 0; with no keys over all rows. The order must tell rows apart."""
    ranged = stored(frame.repartitionByRange(*keys, *order).withColumn("_task", F.spark_partition_id()), "ranged")
    tasks = ranged.groupBy(*keys, "_task").agg(F.count("*").alias("_n"))
    # Without keys there is a row for each task; with them only keys that pass a border remain.
    before = tasks.withColumn("_before", _before("_n", keys)).filter("_before > 0").drop("_n")
    at = F.row_number().over(Window.partitionBy(*keys, "_task").orderBy(*order)) - 1
    rows = ranged.withColumn(name, at.cast("bigint")).join(_null_safe(before, [*keys, "_task"]), _same([*keys, "_task"]), "left")
    return rows.withColumn(name, F.col(name) + F.coalesce("_before", F.lit(0))).select(*frame.columns, name)


def _null_safe(frame: DataFrame, keys: list[str]) -> DataFrame:
    return frame.withColumnsRenamed({k: f"_of_{k}" for k in keys})


def _same(keys: list[str]) -> Column:
    """Rows of equal keys, nulls among them."""
    out = F.lit(True)
    for k in keys:
        out = out & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    return out


def _stretches(keys: list[str], matrix: str, vector: str, size: int, schema: pa.Schema):
    def stacked(column: pa.Array, width: int) -> np.ndarray:
        return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)

    def lists(rows: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), pa.array(rows.ravel()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, key, m, v, number = TaskContext.get().partitionId(), None, None, None, 0
        for batch in batches:
            n = batch.num_rows
            vs, ms = stacked(batch[vector], size), stacked(batch[matrix], size * size).reshape(-1, size, size)
            names = list(zip(*(batch[k].to_pylist() for k in keys), strict=True)) if keys else [()] * n
            before_m, after_m, before_v, after_v = (np.empty((n, w)) for w in (size * size, size * size, size, size))
            for i, k in enumerate(names):
                if k != key or m is None:
                    key, m, v = k, np.eye(size), np.zeros(size)
                before_m[i], before_v[i] = m.ravel(), v
                m, v = ms[i] @ m, ms[i] @ v + vs[i]
                after_m[i], after_v[i] = m.ravel(), v
            more = {"_task": pa.array(np.full(n, task, dtype=np.int32)), "_number": pa.array(np.arange(number, number + n)), "_m": lists(before_m), "_v": lists(before_v), "_after_m": lists(after_m), "_after_v": lists(after_v)}
            number += n
            yield pa.RecordBatch.from_arrays([more[f.name].cast(f.type) if f.name in more else batch[f.name] for f in schema], schema=schema)

    return run


def _arriving(keys: list[str], size: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(b[c].to_pylist() for c in ("_name", "_task", "_after_m", "_after_v", *keys)), strict=True))
        for _, some in groupby(rows, lambda r: r[0]):
            state = np.zeros(size)
            for name, task, m, v, *key in some:
                row = {"_of__task": [task], "_state": [state.tolist()], **{f"_of_{k}": [x] for k, x in zip(keys, key, strict=True)}}
                yield pa.RecordBatch.from_pydict(row, schema=schema)
                state = np.asarray(m).reshape(size, size) @ state + np.asarray(v)

    return run


def _sums_before(frame: DataFrame, keys: list[str], order: list[str], vector: str, size: int, out: str) -> DataFrame:
    """Rows with `out`, the sum of vector over the rows of their key before them."""
    ranged = stored(frame.repartitionByRange(*keys, *order).withColumn("_task", F.spark_partition_id()), "ranged")
    part = lambda i: F.get(vector, F.lit(i))
    tasks = ranged.groupBy(*keys, "_task").agg(*[F.sum(part(i)).alias(f"_sum_{i}") for i in range(size)])
    earlier = F.count("*").over(Window.partitionBy(*keys).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1))
    before = tasks.select(*keys, "_task", earlier.alias("_earlier"), F.array(*[_before(f"_sum_{i}", keys) for i in range(size)]).alias("_before")).filter("_earlier > 0").drop("_earlier")
    # A task's first key alone can lie in earlier tasks, so there is a row for each task at most.
    rows = ranged.join(F.broadcast(_null_safe(before, [*keys, "_task"])), _same([*keys, "_task"]), "left")
    along = Window.partitionBy(*keys, "_task").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    begin = lambda i: F.coalesce(F.get("_before", F.lit(i)), F.lit(0.0))
    return rows.withColumn(out, F.array(*[begin(i) + F.coalesce(F.sum(part(i)).over(along), F.lit(0.0)) for i in range(size)])).select(*frame.columns, out)


def states(frame: DataFrame, keys: list[str], order: list[str], vector: str, size: int, out: str, matrix: str | None = None) -> DataFrame:
    """Rows with `out`, the state of their key before them: zeros first, and matrix * state + vector after each row.

    vector and matrix are columns with arrays of `size` and size * size doubles,
    rows of the matrix one after another; without a matrix, out is the sum of
    the vectors before. The maps of a stretch are one map, so each stretch is
    gone through once, from zeros, and its first state is put in afterwards:
    neither a key nor the rows between two states need be in one task. Sums
    need no Python.
    """
    if matrix is None:
        return _sums_before(frame, keys, order, vector, size, out)
    from pyspark.sql.pandas.types import to_arrow_schema

    many, one = "array<double>", pa.list_(pa.float64())
    added = {"_task": ("int", pa.int32()), "_number": ("bigint", pa.int64()), **{c: (many, one) for c in ("_m", "_v", "_after_m", "_after_v")}}
    schema = to_arrow_schema(frame.schema)
    for name, (_, kind) in added.items():
        schema = schema.append(pa.field(name, kind))
    kinds = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema), *(f"{c} {k}" for c, (k, _) in added.items())])
    rows = frame.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).mapInArrow(_stretches(keys, matrix, vector, size, schema), kinds)
    rows = stored(rows, "stretches")
    name = F.to_json(F.struct(*keys, F.lit(0).alias("_"))) if keys else F.lit("")
    ends = rows.groupBy(*keys, "_task").agg(F.max_by(F.struct("_after_m", "_after_v"), "_number").alias("e")).select(*keys, "_task", "e.*").withColumn("_name", name)
    # Of keys that pass a border, a row for each task.
    ends = ends.withColumn("_tasks", F.count("*").over(Window.partitionBy("_name"))).filter("_tasks > 1").drop("_tasks")
    ends = ends.repartition("_name").sortWithinPartitions("_name", "_task")
    key_fields = [f for f in frame.schema if f.name in keys]
    arriving = pa.schema([("_of__task", pa.int32()), ("_state", one), *((f"_of_{f.name}", schema.field(f.name).type) for f in key_fields)])
    kinds = ", ".join(["_of__task int", "_state array<double>", *(f"`_of_{f.name}` {f.dataType.simpleString()}" for f in key_fields)])
    first = stored(ends.mapInArrow(_arriving(keys, size, arriving), kinds), "arriving")
    begin = F.coalesce("_state", F.array(*[F.lit(0.0)] * size))
    # Written out, for a state has few numbers: Python functions above take no argument with a lambda in a filter.
    state = F.array(*[sum((F.get("_m", F.lit(i * size + j)) * F.get(begin, F.lit(j)) for j in range(size)), F.get("_v", F.lit(i))) for i in range(size)])
    return rows.join(first, _same([*keys, "_task"]), "left").withColumn(out, state).select(*frame.columns, out)


def nearest(left: DataFrame, right: DataFrame, key: str, to: str, take: list[str]) -> DataFrame:
    """Left rows with the right row whose `to` is nearest to `key`, as near_<column> for `to` and each of `take`; of two as near the earlier one.

    Both tables are dealt out together by ranges of the key; each task carries
    the last and the next right row along its stretch, and those of other
    stretches come from one row a task. Null keys, and any key if right has
    none, get nulls. `to` must tell right rows apart, else one of them is taken.
    """
    row = lambda cols: F.struct(F.col(to).alias(to), *[F.col(c).alias(c) for c in cols])
    kind = left.schema[key].dataType
    whole = F.struct(*left.columns)
    both = left.filter(F.col(key).isNotNull()).select(F.col(key).alias("_k"), whole.alias("_l"), F.lit(None).alias("_r")).unionByName(
        right.filter(F.col(to).isNotNull()).select(F.col(to).cast(kind).alias("_k"), F.lit(None).alias("_l"), row(take).alias("_r"))
    )
    # Salted, so that rows of one key can lie in several tasks; right rows of a key come first.
    both = stored(both.withColumn("_side", F.col("_r").isNull().cast("int")).repartitionByRange("_k", "_side", F.xxhash64("_l")).withColumn("_task", F.spark_partition_id()), "nearest")
    ends = both.groupBy("_task").agg(F.max_by("_r", F.when(F.col("_side") == 0, F.col("_k"))).alias("_last"), F.min_by("_r", F.when(F.col("_side") == 0, F.col("_k"))).alias("_next"))
    tasks = Window.orderBy("_task")  # one row for each task
    borders = stored(ends.select("_task", F.last("_last", True).over(tasks.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"), F.first("_next", True).over(tasks.rowsBetween(1, Window.unboundedFollowing)).alias("_after")), "borders")
    within = Window.partitionBy("_task").orderBy("_k", "_side")
    back = F.last("_r", True).over(within.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.last("_r", True).over(Window.partitionBy("_task").orderBy(F.desc("_k"), "_side").rowsBetween(Window.unboundedPreceding, 0))
    rows = both.withColumns({"_back": back, "_ahead": ahead}).filter("_side = 1").join(borders, "_task")
    back, ahead = F.coalesce("_back", "_before"), F.coalesce("_ahead", "_after")
    far = lambda r: F.abs(_measured(F.col("_k"), kind) - _measured(r[to].cast(kind), kind))
    pick = F.when(back.isNull() | (far(ahead) < far(back)), ahead).otherwise(back)
    found = rows.withColumn("_pick", pick).select("_l.*", *[F.col("_pick")[c].alias(f"near_{c}") for c in (to, *take)])
    none = left.filter(F.col(key).isNull()).select(*left.columns, *[F.lit(None).cast(right.schema[c].dataType).alias(f"near_{c}") for c in (to, *take)])
    return found.unionByName(none)


def _measured(c: Column, kind) -> Column:
    """A number or a time as a number; times in microseconds."""
    if "timestamp" in kind.simpleString() or kind.simpleString() == "date":
        return F.unix_micros(c.cast("timestamp"))
    return c


def percentiles(frame: DataFrame, keys: list[str], value: str, q: float, out: str, held: int = 4096, parts: int = 256) -> DataFrame:
    """(keys, out): the q-percentile of each key's values, between the two values about it, exact; nulls and NaN do not count.

    A value of given rank is sought by counts in `parts` equal intervals of what
    is left of a key's range; each round keeps the interval that holds the
    rank. When it has `held` values or fewer, or all are one, they are
    sorted. So no key's values are held together, however many there are.
    """
    rows = frame.select(*keys, F.col(value).cast("double").alias("_x")).filter("_x is not null and not isnan(_x)")
    spans = rows.groupBy(*keys).agg(F.count("*").alias("_c"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    place = F.lit(q) * (F.col("_c") - 1)
    spans = stored(spans.withColumn("_at", F.floor(place)).withColumn("_part", place - F.floor(place)), "spans")
    # The ranks at and after the place; _c counts what lies in [_lo, _hi], _rank is counted there.
    open_ = spans.select(*keys, F.explode(F.array(F.lit(0), F.lit(1))).alias("_which"), "_at", "_c", "_lo", "_hi")
    open_ = open_.select(*keys, "_which", F.least(F.col("_at") + F.col("_which"), F.col("_c") - 1).alias("_rank"), "_c", "_lo", "_hi")
    done, same = [], lambda f: _null_safe(f, keys)
    of = [f"_of_{k}" for k in keys]
    names = [*keys, "_which", "_rank", "_c", "_lo", "_hi"]
    while True:
        open_ = stored(open_.select(*names), "open-ranks")
        small = (F.col("_c") <= held) | (F.col("_lo") == F.col("_hi"))
        ready = open_.filter(small)
        done.append(ready)
        wide = open_.filter(~small)
        if wide.isEmpty():
            break
        inside = rows.join(same(wide), _same(keys) & F.col("_x").between(F.col("_lo"), F.col("_hi")))
        # The ends are intervals of their own, so each round parts the values, infinite ones too.
        half = lambda c: F.least(F.greatest(F.col(c), F.lit(-1e308)), F.lit(1e308)) / 2
        step = F.floor((half("_x") - half("_lo")) / (half("_hi") - half("_lo")) * parts)
        step = F.when(F.col("_x") == F.col("_lo"), -1).when(F.col("_x") == F.col("_hi"), parts + 1).otherwise(F.coalesce(step, F.lit(0)))
        counts = inside.groupBy(*of, "_which", "_rank", step.alias("_step")).agg(F.count("*").alias("_c"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
        along = Window.partitionBy(*of, "_which").orderBy("_step")
        counts = counts.withColumn("_before", F.sum("_c").over(along) - F.col("_c"))
        hit = counts.filter((F.col("_rank") >= F.col("_before")) & (F.col("_rank") < F.col("_before") + F.col("_c")))
        open_ = hit.withColumn("_rank", F.col("_rank") - F.col("_before")).withColumnsRenamed(dict(zip(of, keys, strict=True)))
    ranks = done[0]
    for more in done[1:]:
        ranks = ranks.unionByName(more)
    one = ranks.filter("_lo = _hi").select(*keys, "_which", F.col("_lo").alias("_v"))
    inside = rows.join(same(ranks.filter("_lo < _hi")), _same(keys) & F.col("_x").between(F.col("_lo"), F.col("_hi")))
    some = inside.groupBy(*of, "_which", "_rank").agg(F.sort_array(F.collect_list("_x")).alias("_xs"))
    found = one.unionByName(some.select(*[F.col(a).alias(b) for a, b in zip(of, keys, strict=True)], "_which", F.element_at("_xs", (F.col("_rank") + 1).cast("int")).alias("_v")))
    pair = found.groupBy(*keys).agg(F.max(F.when(F.col("_which") == 0, F.col("_v"))).alias("_a"), F.max(F.when(F.col("_which") == 1, F.col("_v"))).alias("_b"))
    both = pair.join(same(spans.select(*keys, "_part")), _same(keys))
    return both.select(*keys, (F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_part")).alias(out))

