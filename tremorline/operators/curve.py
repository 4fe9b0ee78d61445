"""The capped search for catalogs of any size: ranges of a space-filling curve, each with a halo.

Cells of the sphere are laid along a Z-order curve and cut into ranges of about equal work.  A child is
in the range of its cell; a parent is copied to the ranges that its radius can reach, which
are few, as most neighbours of a cell lie in its own range.  Each range is one
group: a tree over its parents, searched for its children.  The parents of a range that
holds too many go to several groups and so do its children, so a cell with
a third of all events is no one task's work.

Parents go by classes of radius, so one huge radius doesn't widen everyone's cells.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import model
from ..functions import geo
from ..storage import written
from . import tree

#: Children or parents of a group; cells are at least so wide (km), so there are 800,000 at most.
MOST, LEAST_KM = 100_000, 25.0
#: Bits of a band's and a cell's number that are interleaved.
BITS = 11
COLUMNS = ("ord", "_lat", "_lon", "_us", "_w", "_r")


def along(band: Column, cell: Column, bits: int = BITS) -> Column:
    """The place of a cell on the curve: the bits of both numbers in turn."""
    out = F.lit(0).cast("long")
    for i in range(bits):
        for side, x in enumerate((band, cell)):
            out = out.bitwiseOR(F.shiftleft(F.shiftright(x, i).bitwiseAND(1), 2 * i + side))
    return out


def ranges(home: DataFrame, links: DataFrame, by: tuple = (), most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """(by, band, cell, range, chunks, slabs) of the children's cells, and the same with ``own``, the parents' cell that reaches them.

    ``home`` counts children by cell, ``links`` counts parents by their own cell and each cell in reach; both have a row a cell or a few.
    """
    at = ["band", "cell"]
    met = home.join(links.groupBy(*by, *at).agg(F.sum("n").alias("near")), [*by, *at])
    order = Window.partitionBy(*by).orderBy(along(F.col("band"), F.col("cell")), "band", "cell").rowsBetween(Window.unboundedPreceding, 0)
    cut = met.withColumn("range", F.floor(F.sum(F.col("children") + F.col("near") / 9).over(order) / most)).select(*by, *at, "range", "children")
    owners = links.join(cut, [*by, *at]).select(*by, "own", "range", "parents").distinct()
    sizes = cut.groupBy(*by, "range").agg(F.ceil(F.sum("children") / most).cast("int").alias("chunks"))
    sizes = sizes.join(owners.groupBy(*by, "range").agg(F.ceil(F.sum("parents") / most).cast("int").alias("slabs")), [*by, "range"])
    return cut.drop("children").join(sizes, [*by, "range"]), owners.drop("parents").join(sizes, [*by, "range"])


def find(d: float, r_min: float, n_by: int, schema: T.StructType):
    """What a group does: the best parents of its children."""

    def run(table: pa.Table) -> pa.Table:
        from .neighbors import Side

        order = np.argsort(table.column("ord").to_numpy(), kind="stable")
        side = Side(*(table.column(c).to_numpy(zero_copy_only=False)[order] for c in COLUMNS))
        at = np.flatnonzero(table.column("child").to_numpy(zero_copy_only=False)[order])
        eta, place, years, r = tree.search(tree.EventTree(side), side, at, d, r_min)
        some = np.isfinite(eta)
        keys = [pa.array([table.column(i)[0].as_py()] * int(some.sum()), table.schema.field(i).type) for i in range(n_by)]
        return pa.Table.from_arrays([*keys, pa.array(side.order[at[some]]), pa.array(eta[some]), pa.array(side.order[place[some]]), pa.array(years[some]), pa.array(r[some])], names=schema.names)

    return run


def search(events: DataFrame, by: tuple = (), d: float = model.FRACTAL_D, r_min: float = model.R_MIN_KM, most: int = MOST) -> DataFrame:
    """(by, ord, best) within the parents' radii ``_r``."""
    from .neighbors import parts_for_pairs

    radius_class = F.ceil(F.log2(F.greatest(F.col("_r"), F.lit(1.0)))).cast("int")
    classes = sorted(r[0] for r in events.select(radius_class.alias("k")).distinct().collect())  # a dozen at most, as radii are
    largest = events.agg(F.max("_r")).first()[0]
    schema = T.StructType([*(events.schema[c] for c in by), T.StructField("ord", T.LongType()), *(T.StructField(n, t) for n, t in (("eta", T.DoubleType()), ("p_ord", T.LongType()), ("t_years", T.DoubleType()), ("r_km", T.DoubleType())))])
    columns, out = [*by, *COLUMNS], None
    for k in classes:
        grid = geo.Grid(max(LEAST_KM, min(float(2**k), largest)))
        placed = events.withColumn("own", grid.cell(F.col("latitude"), F.col("longitude")))
        reaching = placed.where(radius_class == k)
        home = placed.groupBy(*by, F.col("own.band").alias("band"), F.col("own.cell").alias("cell")).agg(F.count("*").alias("children"))
        links = reaching.select(*by, "own", F.explode(grid.around(F.col("latitude"), F.col("longitude"))).alias("to")).groupBy(*by, "own", F.col("to.band").alias("band"), F.col("to.cell").alias("cell")).agg(F.count("*").alias("n"))
        parents_of = reaching.groupBy(*by, "own").agg(F.count("*").alias("parents"))
        cells, owners = (written(x, "curve") for x in ranges(home, written(links.join(parents_of, [*by, "own"]), "curve-links"), by, most))
        children = placed.select(*columns, F.col("own.band").alias("band"), F.col("own.cell").alias("cell")).join(cells, [*by, "band", "cell"])
        children = children.withColumns({"chunk": F.pmod(F.xxhash64("ord"), F.col("chunks")), "slab": F.explode(F.sequence(F.lit(0).cast("long"), F.col("slabs") - 1)), "child": F.lit(True), "_r": F.lit(-1.0)})  # a child's row is no parent
        parents = reaching.select(*columns, "own").join(owners, [*by, "own"]).withColumns({"slab": F.pmod(F.xxhash64("ord"), F.col("slabs")), "chunk": F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)), "child": F.lit(False)})
        keys = (*by, "range", "slab", "chunk")
        rows = children.select(*keys, *COLUMNS, "child").unionByName(parents.select(*keys, *COLUMNS, "child")).repartition(parts_for_pairs(events), *keys)
        found = rows.groupBy(*keys).applyInArrow(find(d, r_min, len(by), schema), schema)
        out = found if out is None else out.unionByName(found)
    best = F.min(F.struct("eta", "p_ord", "t_years", "r_km")).alias("best")
    if out is None:
        return events.sparkSession.createDataFrame([], schema).groupBy(*by, "ord").agg(best)
    return out.groupBy(*by, "ord").agg(best)
