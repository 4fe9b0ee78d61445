"""Numbering rows in order without ever sorting a whole group in one task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import written

_BITS = 33  # Spark numbers the rows of a partition in the low 33 bits of its ids


def numbered(df: DataFrame, order: tuple[str, ...], by: tuple[str, ...] = (), name: str = "ord") -> DataFrame:
    """Adds the place, from 1, of each row in its group by the order columns (nulls first).

    Rows are dealt by ranges of (by, order), so a group of any size is spread over
    partitions; their places within a partition come with the sorted rows, and the sizes
    of the partitions before them are added.  Only groups that a partition begins with can have rows in earlier ones, so
    what is added is a table of a few rows a partition, however many groups there are.  Of rows that are equal in all order columns
    the places are arbitrary but fixed.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [*by, *order]
    sorted_rows = df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("_row", F.monotonically_increasing_id())
    if by:
        marks = [T.StructField("_run_place", T.LongType()), T.StructField("_run_begins", T.BooleanType())]
        sorted_rows = sorted_rows.mapInArrow(_runs(by), T.StructType([*sorted_rows.schema.fields, *marks]))
    else:
        sorted_rows = sorted_rows.withColumn("_run_place", F.col("_row").bitwiseAND((1 << _BITS) - 1) + 1)
    placed = written(sorted_rows, "numbered")
    part = F.shiftrightunsigned("_row", _BITS)
    named = [F.col(c).alias(f"_by {c}") for c in by]
    same = [F.col(c).eqNullSafe(F.col(f"_by {c}")) for c in by]
    over = placed
    if by:
        first = placed.where("_run_begins").select(*named).distinct()  # a row a partition at most
        over = placed.join(F.broadcast(first), same, "left_semi")
    sizes = over.groupBy(*by, part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    starts = sizes.select(*named, F.col("_part").alias("_of"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")).where("_start > 0")
    joined = placed.join(F.broadcast(written(starts, "starts")), [part == F.col("_of"), *same], "left")
    return joined.select(*(F.col(f"`{c}`") for c in df.columns if c != name), (F.col("_run_place") + F.coalesce("_start", F.lit(0))).alias(name))


def _runs(by: tuple[str, ...]):
    """Numbers the rows of each group of a sorted partition, and marks the group that it begins with."""

    def change(column: pa.Array) -> np.ndarray:
        """Whether each row but the first differs from the one before; nulls and NaNs are equal among themselves."""
        a, b = column[:-1], column[1:]
        differ = pc.xor(a.is_null(), b.is_null())
        other = pc.fill_null(pc.not_equal(a, b), False)
        if pa.types.is_floating(column.type):
            other = pc.and_not(other, pc.fill_null(pc.and_(pc.is_nan(a), pc.is_nan(b)), False))
        return pc.or_(differ, other).to_numpy(zero_copy_only=False)

    def run(batches):
        last, held, begins = None, 0, True
        for batch in batches:
            if not batch.num_rows:
                continue
            own = batch.select(list(by))
            new = np.ones(batch.num_rows, dtype=bool)
            for i in range(len(by)):
                step = change(pa.concat_arrays([last.column(i), own.column(i)]) if last else own.column(i))
                new[0 if last else 1 :] = step if not i else new[0 if last else 1 :] | step
            at, heads = np.arange(batch.num_rows), np.flatnonzero(new)
            start = np.full(batch.num_rows, -held)
            start[heads] = heads
            place = at - np.maximum.accumulate(start) + 1
            first = np.zeros(batch.num_rows, dtype=bool)
            if begins:
                ends = heads if last else heads[1:]
                first[: ends[0] if len(ends) else batch.num_rows] = True
                begins = not len(ends)
            last, held = own.slice(batch.num_rows - 1), int(place[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place), pa.array(first)], names=[*batch.schema.names, "_run_place", "_run_begins"])

    return run


#: Values up to which one task may hold a group's distinct values.
TASK_VALUES = 1_000_000
#: Cuts that a sketch gives, the values it keeps, and passes at most; each leaves a fiftieth of what it looks at.
CUTS, SKETCH, PASSES = 256, 3200, 24


def quantiles(df: DataFrame, value: str, shares: tuple[float, ...], by: tuple[str, ...] = (), most: int = TASK_VALUES) -> DataFrame:
    """(by, q0, q1, ...): exact quantiles with linear interpolation, nulls left out; without values they are null.

    Up to ``most`` values go through Spark's aggregate, which gathers a group's values in
    one task.  For more, a mergeable sketch of the values brackets each of the two places that a
    quantile lies between, one pass counts what is below and inside the bracket, and what is inside is
    narrowed in the same way until it is a single value or few enough to be looked at.
    """
    own = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"))
    if own.count() <= most:
        return own.groupBy(*by).agg(*(F.percentile("_v", q).alias(f"q{i}") for i, q in enumerate(shares)))
    sizes = own.groupBy(*by).agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    rank = [F.lit(float(q)) * (F.col("_n") - 1) for q in shares]
    ends = [F.struct(F.lit(i).alias("_i"), (F.floor(r) + up + 1).alias("_place"), (F.lit(1.0) - r + F.floor(r) if not up else r - F.floor(r)).alias("_share")) for i, r in enumerate(rank) for up in (0, 1)]
    wanted = sizes.select(*by, F.explode(F.array(*ends)).alias("_e"), "_lo", "_hi").select(*by, "_e.*", "_lo", "_hi").where("_share > 0")
    found = _values_at(own, written(wanted.withColumn("_below", F.lit(0).cast("long")), "quantile-places"), by, max(most, 16))
    return found.groupBy(*by).agg(*(F.sum(F.when(F.col("_i") == i, F.col("_v") * F.col("_share"))).alias(f"q{i}") for i in range(len(shares))))


def _met(own: DataFrame, brackets: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """The values inside each bracket; brackets are two rows a group and quantile, so with groups Spark decides by their size."""
    inside = (F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi"))
    for c in by:
        inside = inside & F.col(c).eqNullSafe(F.col(f"_by {c}"))
    named = brackets.withColumnsRenamed({c: f"_by {c}" for c in by})
    return own.join(named if by else F.broadcast(named), inside).drop(*by).withColumnsRenamed({f"_by {c}": c for c in by})


def _values_at(own: DataFrame, brackets: DataFrame, by: tuple[str, ...], most: int) -> DataFrame:
    """(by, _i, _share, _v): the values at the brackets' places, counted from those ``_below`` the bracket."""
    what = [*by, "_i", "_place", "_share", "_below", "_lo", "_hi"]
    done = None
    for _ in range(PASSES):
        inside = _met(own, brackets, by)
        sketch = F.kll_sketch_get_quantile_double(F.kll_sketch_agg_double("_v", F.lit(SKETCH)), F.array(*(F.lit(i / CUTS) for i in range(CUTS + 1))))
        cuts = written(inside.groupBy(*what).agg(F.count("*").alias("_m"), sketch.alias("_cuts")), "quantile-cuts")
        few = cuts.where((F.col("_lo") == F.col("_hi")) | (F.col("_m") <= most))
        picked = _met(own, few.where("_lo < _hi").select(what), by).groupBy(*what).agg(F.sort_array(F.collect_list("_v")).alias("_all"))
        ready = few.where("_lo = _hi").select(*by, "_i", "_share", F.col("_lo").alias("_v")).unionByName(picked.select(*by, "_i", "_share", F.element_at("_all", (F.col("_place") - F.col("_below")).cast("int")).alias("_v")))
        done = ready if done is None else done.unionByName(ready)
        rest = cuts.where((F.col("_lo") < F.col("_hi")) & (F.col("_m") > most))
        if rest.isEmpty():
            return done
        # the sketch's own error is far below a cut; what it says is checked by counting
        at = (F.col("_place") - F.col("_below")) / F.col("_m") * CUTS
        low = F.element_at("_cuts", F.greatest(F.lit(1), F.floor(at)).cast("int"))
        high = F.element_at("_cuts", F.least(F.lit(CUTS + 1), F.ceil(at) + 3).cast("int"))
        tried = rest.select(*what, F.greatest("_lo", low).alias("_low"), F.least("_hi", high).alias("_high"))
        counted = _met(own, tried, by).groupBy(*what, "_low", "_high").agg(F.count_if(F.col("_v") < F.col("_low")).alias("_under"), F.count_if(F.col("_v") <= F.col("_high")).alias("_upto"))
        left = F.col("_place") - F.col("_below")
        low_holds, high_holds = F.col("_under") < left, F.col("_upto") >= left
        brackets = written(counted.select(*by, "_i", "_place", "_share", (F.col("_below") + F.when(low_holds, F.col("_under")).otherwise(0)).alias("_below"), F.when(low_holds, F.col("_low")).otherwise(F.col("_lo")).alias("_lo"), F.when(high_holds, F.col("_high")).otherwise(F.col("_hi")).alias("_hi")), "quantile-places")
    raise RuntimeError("the brackets of the quantiles don't narrow")
