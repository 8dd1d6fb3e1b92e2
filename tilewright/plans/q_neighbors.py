"""Queries: spatial joins."""

from pyspark.sql import functions as F

from tilewright.operators import neighbors as nb
from tilewright.plans.registry import query, r6
from tilewright.plans.roles import CELLS, EDGES, RADIUS, TILES, cells, knn_sql, tiles


@query("J7", f"with {CELLS}, {knn_sql(8)} select sample_name, src, dst, rank::int as rank, round(dist, 6) as dist from knn")
def knn_pairs(spark, sf):
    return nb.knn_join(cells(spark, sf), 8, ["sample_name"]).withColumns(r6("dist"))


@query("J7 Q2", f"with {CELLS}, {knn_sql(15, False)} select src, dst, rank::int as rank, round(dist, 6) as dist from knn")
def knn_pairs_across_samples(spark, sf):
    return nb.knn_join(cells(spark, sf), 15).withColumns(r6("dist"))


@query("J5 D4", f"with {CELLS}, {TILES}, {EDGES} select sample_name, src, dst, round(dist, 6) as dist from edges")
def radius_edges(spark, sf):
    return nb.within_radius(
        cells(spark, sf), tiles(spark, sf), RADIUS, ["sample_name"], right_id="tile_id"
    ).withColumns(r6("dist"))


@query(
    "J8",
    f"""with {CELLS} select a.sample_name, a.node_idx,
      round(min(sqrt((a.pos_x-b.pos_x)*(a.pos_x-b.pos_x)+(a.pos_y-b.pos_y)*(a.pos_y-b.pos_y))), 6) as dist
    from cells a join cells b on a.sample_name = b.sample_name and b.prototype_id = 0 group by all""",
)
def nearest_reference_distance(spark, sf):
    c = cells(spark, sf)
    return nb.distance_to_nearest(c, c.where("prototype_id = 0"), ["sample_name"]).withColumns(r6("dist"))


_BETWEEN = """near as (
  select sample_name, src, dst, rank, dist from (
    select a.sample_name, a.tile_id as src, b.node_idx as dst,
      sqrt((a.pos_x-b.pos_x)*(a.pos_x-b.pos_x)+(a.pos_y-b.pos_y)*(a.pos_y-b.pos_y)) as dist,
      row_number() over (partition by a.sample_name, a.tile_id
        order by (a.pos_x-b.pos_x)*(a.pos_x-b.pos_x)+(a.pos_y-b.pos_y)*(a.pos_y-b.pos_y), b.node_idx) as rank
    from tiles a join cells b on a.sample_name = b.sample_name) where rank <= {k})"""


@query(
    "J9",
    f"""with {CELLS}, {TILES}, {_BETWEEN.format(k=5)},
    votes as (select n.sample_name, src, prototype_id, count(*) as votes from near n
      join cells c on c.sample_name = n.sample_name and c.node_idx = n.dst group by all),
    best as (select *, sum(votes) over (partition by sample_name, src) as n,
      row_number() over (partition by sample_name, src order by votes desc, prototype_id) as rn from votes)
    select sample_name, src as node_idx, prototype_id as voted, round(votes / n, 6) as confidence from best where rn = 1""",
)
def majority_vote_class(spark, sf):
    t = tiles(spark, sf).withColumn("node_idx", F.col("tile_id"))
    c = cells(spark, sf)
    near = nb.majority_vote(t, c, "prototype_id", 5, ["sample_name"])
    return near.withColumns(r6("confidence"))


def _weighted(weight):
    return f"""with {CELLS}, {TILES}, {_BETWEEN.format(k=3)},
    w as (select n.sample_name, src, {weight} as w, c.score from near n
      join cells c on c.sample_name = n.sample_name and c.node_idx = n.dst)
    select sample_name, src as node_idx, round(sum(w * score) / (sum(w) + 1e-8), 6) as score from w group by all"""


@query("J10", _weighted("exp(-dist * dist / (2 * 24.0 * 24.0))"))
def gaussian_interpolation(spark, sf):
    t = tiles(spark, sf).withColumn("node_idx", F.col("tile_id"))
    return nb.interpolate(t, cells(spark, sf), "score", 3, 24.0, ["sample_name"]).withColumns(r6("score"))


@query("J10", _weighted("1.0::double / (dist + 1e-6::double)"))
def inverse_distance_interpolation(spark, sf):
    t = tiles(spark, sf).withColumn("node_idx", F.col("tile_id"))
    return nb.interpolate(t, cells(spark, sf), "score", 3, 0.0, ["sample_name"]).withColumns(r6("score"))


@query(
    "A56 E6",
    f"""with {CELLS}, {knn_sql(6)} select distinct sample_name, src, dst from
    (select sample_name, src, dst from knn union all select sample_name, dst, src from knn) where src <> dst""",
)
def knn_graph(spark, sf):
    return nb.spatial_graph(cells(spark, sf), "knn", ["sample_name"], k=6)


@query(
    "A56 E6",
    f"""with {CELLS} select a.sample_name, a.node_idx as src, b.node_idx as dst from cells a join cells b
    on a.sample_name = b.sample_name and a.node_idx <> b.node_idx
    where (a.pos_x-b.pos_x)*(a.pos_x-b.pos_x)+(a.pos_y-b.pos_y)*(a.pos_y-b.pos_y) <= 60.0*60.0""",
)
def radius_graph(spark, sf):
    return nb.spatial_graph(cells(spark, sf), "radius", ["sample_name"], radius=60.0)
