"""The data source of matrix archives: options prune files before they are opened, and graphs come back as they were."""

import numpy as np
import pytest

from neuroloom.plans import registry
from neuroloom.sources import matrices, matrix_source

SF = "/root/testdata/sf0.001"


@pytest.fixture()
def folder(tmp_path):
    for k, (name, values) in enumerate({"a_x": [[0, 1.5], [np.nan, 0]], "a_x_confidence": [[0, 3.0], [0, 0]], "a_y": [[0, 0], [2.0, 0]], "b_x_z": [[0, 4.0], [0, 0]]}.items()):
        np.savez(tmp_path / f"{name}.npz", np.array(values))
    (tmp_path / "c_x.npz").write_bytes(b"no archive")
    (tmp_path / "notes.txt").write_text("not read")
    return str(tmp_path)


@pytest.mark.parametrize("scheme", ["", "file://"])
def test_options_open_only_what_they_name(spark, folder, scheme):
    matrix_source.register(spark)
    read = lambda **o: spark.read.format("matrices").options(**o).load(scheme + folder)
    assert [tuple(r) for r in read(session="a", stimulus="y").collect()] == [("a_y", "a", "y", "", 1, 0, 2.0)]
    some = read(session="a|b", side="")
    assert sorted(map(tuple, some.where("NOT isnan(value) AND value > 1.6").select("session", "stimulus", "value").collect())) == [("a", "y", 2.0), ("b", "x_z", 4.0)]
    assert some.where("session = 'a'").count() == 3 and some.count() == 4  # one query's filter is not the next one's
    assert read(session="nobody").collect() == []
    assert read(side="confidence").count() == 1
    with pytest.raises(Exception):
        read().select("value").collect()  # the broken file is opened


def test_partitions_are_the_files_left(folder):
    reader = matrix_source.MatrixReader(folder, {"session": {"a"}, "side": {""}})
    assert [p.path.rsplit("/", 1)[-1] for p in reader.partitions()] == ["a_x.npz", "a_y.npz"]
    assert matrix_source.told("s_a_b_offset") == {"name": "s_a_b_offset", "session": "s", "stimulus": "a_b", "side": "offset"}


def test_archives_come_back(spark, tmp_path):
    matrix_source.register(spark)
    edges = spark.createDataFrame([("s", "t u", 10, 30, 1.5, 2.0), ("s", "t u", 30, 20, -2.0, 3.0), ("r", "t u", 20, 10, 1.0, 1.0)], "session string, stimulus string, src long, dst long, weight double, confidence double")
    nodes = spark.createDataFrame([(10,), (20,), (30,), (None,)], "node long")
    assert matrix_source.write_archives(edges, nodes, str(tmp_path)) == 4
    areas = edges.select("session").dropDuplicates().crossJoin(nodes.where("node IS NOT NULL")).selectExpr("session", "node", "'v' AS area", "true AS is_active")
    for read in (spark.read.format("matrices").load(str(tmp_path)), matrices.read_matrices(spark, str(tmp_path))):
        got = matrices.graphs(read, areas).select(*edges.columns)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, edges.collect()))
    assert matrix_source.write_archives(edges.limit(0), nodes, str(tmp_path)) == 0


def test_stored_graphs_are_the_edges(spark):
    assert registry.queries()["stored_graphs"](spark, SF).count() > 100


def test_areas_round_trip_and_odd_files(spark, tmp_path):
    rows = [(7, 1, "V1", True), (7, 2, "LM", False), (7, 2, "AL", False), (7, 3, None, True), (7, None, "V1", True), (8, 1, "V1", None)]
    path = f"file://{tmp_path}/areas"
    matrices.write_areas(spark.createDataFrame(rows, "session long, node long, area string, is_active boolean"), path)
    got = sorted((tuple(r) for r in matrices.read_areas(spark, path).collect()), key=str)
    assert got == [("7", 1, "V1", True), ("7", 2, "LM", False), ("7", 3, None, True), ("8", 1, "V1", False)]
    assert {r.session for r in matrices.read_areas(spark, path, "8").collect()} == {"8"}
    odd = tmp_path / "odd.json"
    odd.write_text('{"session": 9, "areas": {"4": "V1", "x": "V1"}}\n{"areas": {"1": "V1"}}\n{"session": "10", "areas": {}}\n')
    assert [tuple(r) for r in matrices.read_areas(spark, f"file://{odd}").collect()] == [("9", 4, "V1", True)]
