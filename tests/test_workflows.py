from xml.etree import ElementTree

from lodestone.functions.drum import Drum
from lodestone.functions.features import BandEnergies
from lodestone.functions.metric import Chain
from lodestone.operators import graph, precompute
from lodestone.plans import queries as Q
from lodestone.plans import workflows
from lodestone.sources import export

BOUNDS = {"tau": (0.4, 1.7), "p": (-5.0, -2.85), "d": (-5.0, -2.75), "alpha": (0.25, 0.75)}
CHAIN = Chain(BandEnergies(8), Drum(dur=512))


def test_all_workflows(spark, tmp_path):
    points, features = workflows.precompute_store(spark, str(tmp_path), CHAIN, BOUNDS, 3, partitions=4)
    assert points.count() == features.count() == 81
    found, curves = workflows.compare_methods(points, features, CHAIN, 5, 20)
    assert all(f.where("rank = 0").first().row_id == 5 and f.count() == 20 for f in found.values())
    assert {r.iou for r in curves["Bruteforce"].collect()} == {1.0}
    # near a point the local metric tells neighbours by features better than the plain parameters do
    at = {m: c.where("K = 19").first().iou for m, c in curves.items()}
    assert 0 <= at["P-loss"] <= 1 and at["PNP"] >= at["P-loss"]
    nodes, edges = workflows.build_graph(points, str(tmp_path), CHAIN, n_hubs=9, k=4, partitions=4)
    assert nodes.count() == 81 and edges.count() >= 2 * 81 * 4
    assert graph.isolated(points, edges).count() == 0
    placed, one = workflows.lay_out(spark, str(tmp_path), 3)
    assert placed.columns == ["vertex", "x", "y", "features"] and placed.count() == 81
    assert spark.read.csv(f"{tmp_path}/layout_edges", header=True).count() == one.count()


def test_precompute_goes_on_after_a_stop(spark, tmp_path):
    """A run that is stopped midway leaves whole ranges; the next one does the rest, and each id comes once."""
    points = Q._points(spark, "/root/testdata/sf0.001")
    path, made = f"{tmp_path}/features", []

    def make(p, fail=None):
        made.append(p.agg(Q.F.min("row_id")).first()[0])
        if made[-1] == fail:
            def stop(batches):
                for i, b in enumerate(batches):
                    yield b
                raise RuntimeError("stopped")

            return precompute.features(p, CHAIN, Q.AXES, 2).mapInArrow(stop, "row_id long, s array<float>")
        return precompute.features(p, CHAIN, Q.AXES, 2)

    try:
        precompute.resumable(points, lambda p: make(p, 300), path, 100)
    except Exception as e:
        assert "stopped" in str(e)
    assert precompute.committed(spark, path) == [0, 100, 200] and made == [0, 100, 200, 300]
    before = {f: f.stat().st_mtime_ns for f in (tmp_path / "features").glob("ids=*/*.parquet")}
    got = precompute.resumable(points, make, path, 100)
    assert made[4:] == [300, 400] and all(f.stat().st_mtime_ns == t for f, t in before.items())
    assert sorted(r.row_id for r in got.collect()) == list(range(500))
    want = {r.row_id: r.s for r in precompute.features(points, CHAIN, Q.AXES, 4).collect()}
    assert all(want[r.row_id] == r.s for r in got.collect())
    assert precompute.resumable(points.limit(0), make, f"{tmp_path}/none", 100).count() == 0


def test_one_graphml_document(spark, tmp_path):
    p = Q._whole_points(spark, "/root/testdata/sf0.001")
    nodes, edges = graph.nodes(p, ("a", "b")), graph.knn_edges(p, 2, ("a", "b"), metric=None).persist()
    for _ in range(2):  # the second replaces the first
        export.write_graphml_file(nodes, edges, f"{tmp_path}/g.graphml")
    lines = export.graphml_lines(nodes, edges).orderBy("part", "a", "b").collect()
    assert sorted((tmp_path / "g.graphml").read_text().split("\n")[:-1]) == sorted("\n".join(x.line for x in lines).split("\n"))
    root = ElementTree.parse(tmp_path / "g.graphml").getroot()
    found = [x.tag.rpartition("}")[2] for x in root.iter()]
    assert found.count("node") == p.count() and found.count("edge") == edges.count()
    assert [x.name for x in tmp_path.iterdir() if "_parts" in x.name] == []
