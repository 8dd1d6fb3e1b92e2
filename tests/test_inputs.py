"""File order, odd coordinates, and the folder for intermediate tables."""

import json
from types import SimpleNamespace

import pytest

from tilewright import session
from tilewright.operators import ecology, neighbors
from tilewright.sources import readers, writers


def test_genes_are_numbered_by_file_not_by_split_size(spark, tmp_path):
    (tmp_path / "a.txt").write_text("A0\n# no gene\nA1\n")
    (tmp_path / "b.txt").write_text("".join(f"B{i}\n" for i in range(50)))
    want = [(i, g) for i, g in enumerate(["A0", "A1", *(f"B{i}" for i in range(50))])]
    assert sorted(tuple(r) for r in readers.gene_list(spark, str(tmp_path)).collect()) == want
    (tmp_path / "m").mkdir()
    (tmp_path / "m/a.tsv").write_text("x\tE1.2\n")
    (tmp_path / "m/b.tsv").write_text("".join(f"y{i}\tE{i}\n" for i in range(40)))
    found = sorted(tuple(r) for r in readers.gene_map(spark, f"{tmp_path}/m").collect())
    assert found[0] == (0, "x", "E1") and [r[0] for r in found] == list(range(41)) and found[40][1] == "y39"


def test_parts_of_a_polygon_keep_their_own_ids(spark, tmp_path):
    ring = [[[[0, 0], [1, 0], [1, 1]]]]
    features = [{"geometry": {"type": "MultiPolygon", "coordinates": ring * 1500}}] * 2
    (tmp_path / "s.geojson").write_text(json.dumps({"features": features}))
    found = readers.polygons(spark, str(tmp_path / "s.geojson"))
    assert found.count() == found.select("poly_id").distinct().count() == 3000


def test_matrix_lines_may_hold_runs_of_blanks(spark, tmp_path):
    (tmp_path / "m.mtx").write_text("%%MatrixMarket matrix coordinate real general\n3  3 2\n 1   2  5\n3 1\t7\n")
    assert sorted(tuple(r) for r in readers.matrix_market(spark, str(tmp_path / "m.mtx")).collect()) == [(1, 2, 5.0), (3, 1, 7.0)]


def test_no_cell_is_cut_by_default(spark):
    counts = spark.createDataFrame([(c, 60.0 + c) for c in range(90)], "cell_idx int, x double")
    assert readers.prefilter_cells(counts, 100).count() == 50
    assert readers.prefilter_cells(counts, 100, keep_top=7).count() == 7


NAN, INF = float("nan"), float("inf")


def test_points_without_coordinates_have_no_neighbours(spark):
    pts = [(i, float(i), 0.0, 0) for i in range(30)] + [(90, NAN, 1.0, 0), (91, None, 1.0, 0), (92, 1.0, INF, 0), (93, 3.0, NAN, 1)]
    df = spark.createDataFrame(pts, "node_idx long, pos_x double, pos_y double, prototype_id int")
    pairs = neighbors.knn_join(df, 2)
    assert {r.src for r in pairs.collect()} == set(range(30)) and all(r.dst < 30 for r in pairs.collect())
    assert "CartesianProduct" not in pairs._jdf.queryExecution().toString()
    near = {(r.src, r.dst) for r in neighbors.within_radius(df, df, 1.0).collect()}
    assert near == {(a, b) for a in range(30) for b in range(30) if abs(a - b) <= 1}


def test_a_radial_profile_has_no_cap(spark):
    pts = [(0, 0.0, 0.0, 1, "x")] + [(i, 0.001 * i, 0.0, 0, "y") for i in range(1, 700)] + [(900, 0.0, 0.0, 0, "z")]
    df = spark.createDataFrame(pts, "node_idx long, pos_x double, pos_y double, prototype_id int, kind string")
    found = {r.kind: r.n for r in ecology.radial_profile(df, 1, [5.0], "kind").collect()}
    assert found == {"y": 699, "z": 1}


def test_a_cluster_needs_a_shared_folder(spark, tmp_path):
    fake = lambda master, shared: SimpleNamespace(
        conf=SimpleNamespace(get=lambda *_: shared), sparkContext=SimpleNamespace(master=master, applicationId="none")
    )
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.work_dir(fake("spark://host:7077", None))
    assert session.work_dir(fake("spark://host:7077", "file:/shared")) == "file:/shared"


def test_a_forgotten_state_leaves_no_files(spark):
    import os

    kept = session.cut_lineage(spark.range(10))
    path = kept._state_path
    assert os.path.isdir(path) and kept.count() == 10
    session.forget(kept)
    assert not os.path.exists(path)


def test_stage_keys_follow_the_content(spark):
    a = spark.createDataFrame([("s", 1), ("t", 2)], "sample string, v int")
    b = spark.createDataFrame([("s", 1), ("t", 3)], "sample string, v int")
    key = lambda df, **p: writers.content_key(df, "sample", **p)
    assert key(a) == key(a.orderBy("v", ascending=False)) and len({key(a), key(b), key(a, k=1), key(a.union(a))}) == 4
