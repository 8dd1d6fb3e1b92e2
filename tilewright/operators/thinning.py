"""Greedy spatial thinning, as a scan in id order would do it, in bounded work per point.

Squares of side r / sqrt(2) hold at most one kept point each, so a point only ever meets the kept points of the 25 squares
around it, however crowded they are, and no list of pairs is made. Two kinds of rounds settle the points:

* *minima*: the first point of a square that comes before everything in the squares around it is kept, and what lies within
  the radius of a kept point goes. These are joins and aggregates over squares; they settle piles.
* *scans*: tiles of many squares are scanned in id order, each in one streaming task that remembers the kept point of a
  square and the points it can't decide yet because they depend on another tile. These settle long chains: the number
  of rounds follows the tiles that a chain crosses, not its length.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.session import cut_lineage, forget

#: Squares on each side of a tile, and undecided points of a square that a scan tells apart.
TILE, OPEN = 512, 16
AROUND = [(i, j) for i in range(-2, 3) for j in range(-2, 3)]


def deduplicate(points: DataFrame, radius: float, groups: Sequence[str], order: str = "node_idx", tile: int = TILE, minima: int = 2) -> DataFrame:
    """The rows of ``points`` that stay when, in the order of ``order`` within each group, a point goes if a kept one lies
    within the radius.

    Copies of a position are settled by the first of them. Points without a position have no neighbours and stay. Group
    columns must not be null and ``order`` must be unique in a group.
    """
    groups = list(groups)
    # a hair less than r / sqrt(2), so that rounding can't put two points of one square further apart than the radius
    side = float(radius) / 2**0.5 * (1 - 1e-9)
    spot = F.col("pos_x").isNotNull() & F.col("pos_y").isNotNull() & ~F.isnan("pos_x") & ~F.isnan("pos_y")
    square = lambda c: F.floor(F.col(c) / side).cast("long")
    first = points.where(spot).groupBy(*groups, "pos_x", "pos_y").agg(F.min(order).alias("id"))
    open_ = cut_lineage(
        first.select(*groups, "id", F.col("pos_x").cast("double").alias("x"), F.col("pos_y").cast("double").alias("y"))
        .withColumns({"cx": square("x"), "cy": square("y")})
    )
    known = open_.where("false")
    for _ in range(minima):
        kept, rest = _minima(open_, groups, float(radius))
        known = cut_lineage(known.unionByName(kept))
        forget(open_)
        open_ = rest
    while not open_.isEmpty():
        scanned = cut_lineage(_scan(open_, known, groups, float(radius), tile))
        settled = scanned.where("kept").drop("kept")
        before = open_
        open_, known = cut_lineage(scanned.where("not kept").drop("kept")), cut_lineage(known.unionByName(settled))
        forget(before)
        forget(scanned)
    stays = known.select(*groups, F.col("id").alias(order))
    return points.where(spot).join(stays, [*groups, order], "left_semi").unionByName(points.where(~spot))


def _minima(open_: DataFrame, groups: list[str], radius: float) -> tuple[DataFrame, DataFrame]:
    """(kept, rest): points that come before all points in reach, and what these leave undecided."""
    here = open_.groupBy(*groups, "cx", "cy").agg(F.min(F.struct("id", "x", "y")).alias("p"))
    around = here.select(*groups, F.col("p.id").alias("near"), _moved(groups)).select(*groups, "near", "at.*")
    least = around.groupBy(*groups, "cx", "cy").agg(F.min("near").alias("near"))
    wins = here.join(least, [*groups, "cx", "cy"]).where(F.col("p.id") == F.col("near"))
    kept = cut_lineage(wins.select(*groups, "p.id", "p.x", "p.y", "cx", "cy"))
    # a square meets at most 25 kept points, gathered to one row, so a crowded square stays a plain join key
    reach = kept.select(*groups, "x", "y", _moved(groups)).select(*groups, "at.*", F.struct("x", "y").alias("k"))
    reach = reach.groupBy(*groups, "cx", "cy").agg(F.collect_list("k").alias("k"))
    away = lambda k: (F.col("x") - k["x"]) * (F.col("x") - k["x"]) + (F.col("y") - k["y"]) * (F.col("y") - k["y"])
    near = F.exists(F.coalesce("k", F.array().cast("array<struct<x:double,y:double>>")), lambda k: away(k) <= radius * radius)
    return kept, cut_lineage(open_.join(reach, [*groups, "cx", "cy"], "left").where(~near).drop("k"))


def _moved(groups: list[str]) -> Column:
    """One row per square around."""
    spots = [F.struct((F.col("cx") + i).alias("cx"), (F.col("cy") + j).alias("cy")) for i, j in AROUND]
    return F.explode(F.array(*spots)).alias("at")


def _scan(open_: DataFrame, known: DataFrame, groups: list[str], radius: float, tile: int) -> DataFrame:
    """Undecided and newly kept points after every tile scanned its own, with a margin of two squares of other tiles."""
    both = open_.withColumn("sure", F.lit(False)).unionByName(known.withColumn("sure", F.lit(True)))
    home = lambda c: F.floor(F.col(c) / tile)
    sides = lambda c: F.array_distinct(F.array(home(c), F.floor((F.col(c) - 2) / tile), F.floor((F.col(c) + 2) / tile)))
    seen = both.withColumn("tx", F.explode(sides("cx"))).withColumn("ty", F.explode(sides("cy")))
    seen = seen.withColumn("own", (F.col("tx") == home("cx")) & (F.col("ty") == home("cy")))
    keys = [*groups, "tx", "ty"]
    # tiles without anything undecided need no scan
    busy = seen.where("own and not sure").select(*keys).distinct()
    seen = seen.join(busy, keys, "left_semi").repartition(*keys).sortWithinPartitions(*keys, "id")
    names = [*groups, "id", "x", "y", "cx", "cy"]
    schema = seen.select(*names).schema
    limit = radius * radius

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, kept, waiting = None, {}, {}
        for b in batches:
            column = {name: b.column(i).to_pylist() for i, name in enumerate(b.schema.names)}
            tiles = zip(*[column[k] for k in keys], strict=True)
            stay, verdict = [], []
            rows = zip(*[column[c] for c in ("x", "y", "cx", "cy", "sure", "own")], strict=True)
            for i, (tile_, (x, y, cx, cy, sure, own)) in enumerate(zip(tiles, rows, strict=True)):
                if tile_ != at:
                    at, kept, waiting = tile_, {}, {}
                if sure:
                    kept[cx, cy] = x, y
                    continue
                state = _state(x, y, cx, cy, kept, waiting, limit)
                if state == "gone":
                    continue
                if state == "kept" and own:
                    kept[cx, cy] = x, y
                else:  # it waits for another tile, or is another tile's to decide
                    some = waiting.setdefault((cx, cy), [])
                    if len(some) < OPEN:
                        some.append((x, y))
                if own:
                    stay.append(i)
                    verdict.append(state == "kept")
            picked = b.select(names).take(pa.array(stay, pa.int64()))
            yield pa.RecordBatch.from_arrays([*picked.columns, pa.array(verdict, pa.bool_())], [*names, "kept"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    return seen.mapInArrow(run, f"{fields}, kept boolean")


def _state(x: float, y: float, cx: int, cy: int, kept: dict, waiting: dict, limit: float) -> str:
    """Whether an earlier kept point is in reach (gone), else an earlier undecided one (open), else kept. A square with
    ``OPEN`` undecided points counts as in reach whatever their places."""
    for i, j in AROUND:
        k = kept.get((cx + i, cy + j))
        if k and (k[0] - x) * (k[0] - x) + (k[1] - y) * (k[1] - y) <= limit:
            return "gone"
    for i, j in AROUND:
        some = waiting.get((cx + i, cy + j))
        if some and (len(some) == OPEN or any((a - x) * (a - x) + (b - y) * (b - y) <= limit for a, b in some)):
            return "open"
    return "kept"
