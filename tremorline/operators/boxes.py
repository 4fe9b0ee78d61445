"""Boxes of latitude and longitude that overlap, as an equi-join on cells of several sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import written
from .neighbors import deal_crowded, parts_for_pairs

EDGES = ("minlatitude", "maxlatitude", "minlongitude", "maxlongitude")
#: Cells are 2**level degrees wide, from these levels.
LEAST_LEVEL, MOST_LEVEL = -6, 9


def bounding(events: DataFrame, key: str, by: tuple = ()) -> DataFrame:
    """(by, key, edges) of each group of events."""
    lat, lon = F.col("latitude"), F.col("longitude")
    return events.groupBy(*by, key).agg(*(f(c).alias(e) for e, (f, c) in zip(EDGES, ((F.min, lat), (F.max, lat), (F.min, lon), (F.max, lon)), strict=True)))


def overlapping(boxes: DataFrame, name: str = "name", by: tuple = ()) -> DataFrame:
    """(by, a, b): pairs of boxes whose insides meet, a before b; boxes that only touch don't.

    A box belongs to the level whose cells are at least as large as itself, so it lies in four of
    them at most; for larger boxes it is also dealt to the cells of the higher levels that occur.
    A pair is met where the box of the higher level (of equal ones the first by name) has a
    cell in common with the other, and is taken only in the cell of the lower left
    corner of what they share, so no pair is made twice.  Boxes with a null edge overlap nothing.
    """
    s, n, w, e = (F.col(c) for c in EDGES)
    own = boxes.where(s.isNotNull() & n.isNotNull() & w.isNotNull() & e.isNotNull())
    extent = F.greatest(n - s, e - w, F.lit(2.0**LEAST_LEVEL))
    own = written(own.select(*by, F.col(name).alias("name"), *EDGES, F.least(F.ceil(F.log2(extent)), F.lit(MOST_LEVEL)).cast("int").alias("home")), "boxes")
    levels = sorted(r[0] for r in own.select("home").distinct().collect())  # one of sixteen each
    if not levels:
        return own.select(*by, F.col("name").alias("a"), F.col("name").alias("b"))

    def side(prefix: str, at: Column) -> DataFrame:
        rows = own.withColumn("level", F.explode(at)).withColumn("size", F.pow(F.lit(2.0), F.col("level")))
        for axis, low, high in (("row", s, n), ("column", w, e)):
            rows = rows.withColumn(axis, F.explode(F.sequence(F.floor(low / F.col("size")), F.floor(high / F.col("size")))))
        return rows.select(*(F.col(c).alias(prefix + c) for c in rows.columns))

    children = side("c_", F.filter(F.array(*map(F.lit, levels)), lambda x: x >= F.col("home")))
    keys = (*by, "level", "row", "column")
    sides = deal_crowded(children, side("p_", F.array("home")), keys, "c_name")
    children, parents = (x.repartition(parts_for_pairs(boxes), *(prefix + k for k in (*keys, "_salt"))) for x, prefix in zip(sides, ("c_", "p_"), strict=True))
    c, p = (lambda x: F.col(f"c_{x}")), (lambda x: F.col(f"p_{x}"))
    first = (c("home") < p("home")) | ((c("home") == p("home")) & (p("name") < c("name")))
    meet = (c(EDGES[0]) < p(EDGES[1])) & (p(EDGES[0]) < c(EDGES[1])) & (c(EDGES[2]) < p(EDGES[3])) & (p(EDGES[2]) < c(EDGES[3]))
    corner = [F.floor(F.greatest(c(low), p(low)) / c("size")) == c(axis) for axis, low in (("row", EDGES[0]), ("column", EDGES[2]))]
    pairs = children.join(parents, [*(c(k) == p(k) for k in (*keys, "_salt")), first, meet, *corner])
    return pairs.select(*(c(k).alias(k) for k in by), F.least(c("name"), p("name")).alias("a"), F.greatest(c("name"), p("name")).alias("b"))
