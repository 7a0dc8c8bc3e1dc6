import math
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import distance as D
from lodestone.functions.drum import Drum, coefficients, drum_modes, kept_modes, mode_block, synth, synth_tangents, to_percept, to_physics, waveform_rows
from lodestone.functions.features import BandEnergies, JointScattering
from lodestone.functions.metric import Chain, Quadratic
from lodestone.operators import evaluate, graph, hubs, knn, layout, precompute
from lodestone.plans.queries import CHAIN, QUERIES
from lodestone.schemas import AXES
from lodestone.sources import export, grid, store

THETA = np.array([1.2, -2.0, -2.5, 0.5])


def rows(df):
    return sorted(tuple(r) for r in df.collect())


# grids


def test_grid_matches_numpy(spark):
    axes = [np.linspace(*grid.BOUNDS[a], 4) for a in AXES]
    want = [(i, *t) for i, t in enumerate((a, b, c, d) for a in axes[0] for b in axes[1] for c in axes[2] for d in axes[3])]
    assert rows(grid.grid(spark, subdiv=4)) == [tuple(map(float, w)) for w in want]


def test_grid_edges(spark):
    assert rows(grid.grid(spark, {"a": (1, 2)}, 1)) == [(0, 1.0)]
    assert rows(grid.grid(spark, {"a": (1, 2), "b": (0, 1)}, 2)) == [(0, 1.0, 0.0), (1, 1.0, 1.0), (2, 2.0, 0.0), (3, 2.0, 1.0)]
    with pytest.raises(ValueError):
        grid.grid(spark, subdiv=0)
    assert rows(grid.hub_ids(spark, 10, 1)) == [(0, 0)] and [r[1] for r in rows(grid.hub_ids(spark, 3, 6))] == [0, 0, 0, 1, 1, 2]
    assert [r[1] for r in rows(grid.hub_ids(spark, 10_000, 2000))] == np.linspace(0, 9999, 2000).astype(int).tolist()


def test_csv(spark, tmp_path):
    g = grid.grid(spark, subdiv=2)
    grid.write_csv(g, f"{tmp_path}/g")
    assert rows(grid.read_csv(spark, f"{tmp_path}/g", single=False)) == rows(g)
    assert rows(grid.read_csv(spark, f"{tmp_path}/g")) == rows(grid.grid(spark, subdiv=2, single=True))


def test_csv_without_ids(spark, tmp_path):
    """Ids are positions over all splits of all files, whatever the size of the splits and of the files."""
    g = grid.grid(spark, subdiv=8).repartition(7)
    grid.write_csv(g, f"{tmp_path}/one", ids=False)
    grid.write_csv(g, f"{tmp_path}/many", ids=False, rows=700)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size, least in (("128m", 1), ("10k", 10)):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1k")
        try:
            for name in ("one", "many"):
                back = grid.read_csv(spark, f"{tmp_path}/{name}", single=False)
                assert back.rdd.getNumPartitions() >= least
                assert rows(back) == rows(g)
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before)
            spark.conf.unset("spark.sql.files.openCostInBytes")
    (tmp_path / "own.csv").write_text("alpha,note,tau,p,d\n0.5,\"a,b\",1.0,-2.0,-3.0\n\n0.25,,1.5,-2.5,-3.5\n")
    assert rows(grid.read_csv(spark, f"{tmp_path}/own.csv")) == [(0, 1.0, -2.0, -3.0, 0.5), (1, 1.5, -2.5, -3.5, 0.25)]
    (tmp_path / "none.csv").write_text("tau,p,d,alpha\n")
    assert rows(grid.read_csv(spark, f"{tmp_path}/none.csv")) == []


# the feature store


def test_last_stored_row_wins(spark, tmp_path):
    stored = [(3, [9.0]), (1, [5.0]), (3, [1.0]), (2, [7.0]), (1, [8.0]), (3, [4.0]), (2, None)]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(stored)], "n int, row_id long, s array<float>")
    df.repartitionByRange(3, "n").sortWithinPartitions("n").drop("n").write.parquet(f"{tmp_path}/s")
    s = store.read(spark, f"{tmp_path}/s")
    assert [(r.pos, r.row_id, r.s) for r in store.lookup(s, [2, 3, 1, 3, 8]).collect()] == [(0, 2, None), (1, 3, [4.0]), (2, 1, [8.0]), (3, 3, [4.0])]
    renamed = s.select("row_id", F.col("s")[0].alias("x"))
    assert [r.x for r in store.lookup(renamed, [3, 1], "x").collect()] == [4.0, 8.0]
    memory = spark.createDataFrame(stored, "row_id long, s array<float>")
    assert store.storage_order(memory) is None and [r.s for r in store.lookup(memory, [3, 1]).collect()] == [[9.0], [8.0]]


def test_keyed_store(spark, tmp_path):
    """Joins and groups by the key leave the store where it is; another session finds the buckets again."""
    df = spark.range(5000).select((F.col("id") % 700).alias("row_id"), F.col("id").alias("x"))
    kept = store.write_keyed(df, f"{tmp_path}/k", 6)
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, df.collect()))
    assert len([f for f in (tmp_path / "k").glob("*.parquet")]) == 6
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        spark.sql(f"DROP TABLE {store._keyed_name(f'{tmp_path}/k')}")
        kept = store.read_keyed(spark, f"{tmp_path}/k")
        wanted = spark.createDataFrame([(5,), (6,), (9999,)], "row_id long")
        for out in (store.hub_rows(kept, wanted).groupBy("row_id").count(), kept.join(wanted, "row_id").select("row_id", F.lit(1).alias("count"))):
            plan = out._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
            assert plan.count("Exchange") == 1, plan  # of what is asked for
        assert {(r.row_id, r["count"]) for r in store.hub_rows(kept, wanted).groupBy("row_id").count().collect()} == {(5, 8), (6, 8)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_store(spark, tmp_path):
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(100)] + [(7, [0.5, 2.0])], "row_id long, s array<float>")
    store.write(df, f"{tmp_path}/s")
    s = store.read(spark, f"{tmp_path}/s")
    assert [(r.pos, r.row_id, r.s[0]) for r in store.lookup(s, [5, 999, 7, 5]).collect()] == [(0, 5, 5.0), (2, 7, 0.5), (3, 5, 5.0)]  # the last stored, not the greatest
    assert store.lookup(s, [1000, 1001]).count() == 0 and store.lookup_batches(s, [1000], 2).count() == 0
    assert [r.batch for r in store.lookup_batches(s, [1, 2, 3], 2).orderBy("pos").collect()] == [0, 0, 1]
    assert store.filtered(s, [7, 8, 8, -1]).count() == 3 and store.filtered(s, range(2000)).count() == 101
    assert "PushedFilters: [In(row_id" in store.filtered(s, [7, 8])._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    wide = spark.createDataFrame([(1, 0.5, 2.5)], 'row_id long, `1` float, `0` float')
    assert store.from_wide(wide).collect()[0].s == [2.5, 0.5]


# the drum


def test_first_mode_identities(spark):
    p = grid.grid(spark, {"tau": (0.4, 3.0), "p": (-5.0, -0.7), "d": (-5.0, -0.5), "alpha": (0.1, 1.0)}, 3)
    for r in drum_modes(p).where("mu1 = 1 and mu2 = 1").join(p, "row_id").collect():
        assert math.isclose(r.omega, 10**3.1, rel_tol=1e-9) and math.isclose(r.decay, 1 / r.tau, rel_tol=1e-9)


def test_conversions():
    w, tau, p, d, l, lm = 1258.9, 0.7, 0.01, 0.03, 2.0, 0.5
    d1, d3, s4, c2 = to_physics(w, tau, p, d, l, lm)
    assert np.allclose(to_percept(s4, c2 * lm, d1, d3, l, lm), (w, tau, p, d), rtol=1e-6)
    s4, c2, d1, d3 = coefficients(w, tau, p, d, 0.5)
    assert s4 > 0 and c2 > 0 and d1 > 0 and d3 < 0


def test_waveform_forms_agree(spark):
    small = Drum(dur=256)
    bounds = {"tau": (0.4, 1.7), "p": (-5.0, -2.85), "d": (-5.0, -2.75), "alpha": (0.25, 0.75)}
    g = grid.grid(spark, bounds, 2)
    long = {}
    for r in waveform_rows(g, small).collect():
        long.setdefault(r.row_id, np.zeros(256))[r.t] = r.y
    for r in g.collect():
        y = synth(np.array(r[1:]), small)
        assert abs(y[0]) < 1e-12 and math.isclose(np.abs(y).max(), 1) and np.allclose(y, long[r.row_id], atol=1e-9)


def test_mode_block(spark):
    p = grid.grid(spark, subdiv=3)
    modes = drum_modes(p)
    got = {r.row_id: (r.c1, r.c2) for r in mode_block(modes).collect()}
    bad = {}
    for r in modes.collect():
        bad.setdefault(r.row_id, np.zeros((10, 10), bool))[r.mu1 - 1, r.mu2 - 1] = r.rejected
    for i, b in bad.items():
        assert got[i] == (int(10 - b.sum(0).max()) or 10, int(10 - b.sum(1).max()) or 10)
    assert kept_modes(modes).count() == sum(a * b for a, b in got.values())


def test_zero_peak_is_nan_and_null(spark):
    none = Drum(dur=16, h=0.0)
    assert np.isnan(synth(THETA, none)).all()
    one = spark.createDataFrame([(0, *map(float, THETA))], "row_id long, tau double, p double, d double, alpha double")
    assert all(r.y is None for r in waveform_rows(one, none).collect())


def test_as_written_depends_on_tau_only(spark):
    a = synth(THETA, Drum(dur=512), as_written=True)
    b = synth(THETA + [0, 1, 1, 0.2], Drum(dur=512), as_written=True)
    assert np.array_equal(a, b)


def test_omega_axis():
    assert np.array_equal(synth(np.r_[3.1, THETA], Drum(dur=512), omega=None), synth(THETA, Drum(dur=512)))


# features and metrics


def test_tangents():
    small = Drum(dur=4096)
    _, dy = synth_tangents(THETA, small)
    for i in range(4):
        e = np.eye(4)[i] * 1e-6
        assert np.allclose((synth(THETA + e, small) - synth(THETA - e, small)) / 2e-6, dy[i], atol=1e-4 * np.abs(dy[i]).max())


@pytest.mark.parametrize("features", [BandEnergies(), JointScattering(j=8, q=4, t=512)])
def test_derivatives(features):
    small = Drum(dur=2048)
    c = Chain(features, small)
    g = c.jacobian(THETA)
    for i in range(4):
        e = np.eye(4)[i] * 1e-7
        central = (c.s(THETA + e) - c.s(THETA - e)) / 2e-7
        assert np.abs(central - g[:, i]).max() < 2e-3 * max(1, np.abs(g[:, i]).max())
    m = c.metric(THETA)
    assert np.allclose(m, m.T) and np.linalg.eigvalsh(m).min() > -1e-6 * np.linalg.eigvalsh(m).max()
    step = np.array([1, -0.5, 0.3, 0.2]) * 1e-6
    assert abs(step @ m @ step / ((c.s(THETA + step) - c.s(THETA)) ** 2).sum() - 1) < 0.02
    assert np.isfinite(c.s(THETA)).all() and (c.s(THETA) >= 0).all()


def test_quadratic_derivatives():
    q = Quadratic(3)
    for i in range(4):
        e = np.eye(4)[i] * 1e-6
        assert np.allclose((q.s(THETA + e) - q.s(THETA - e)) / 2e-6, q.jacobian(THETA)[:, i], atol=1e-6)


def test_precompute_keeps_ids(spark):
    g = grid.grid(spark, {"tau": (0.4, 1.7), "p": (-5.0, -2.85), "d": (-5.0, -2.75), "alpha": (0.25, 0.75)}, 2)
    c = Chain(BandEnergies(8), Drum(dur=512))
    got = {r.row_id: r.s for r in precompute.features(g, c, AXES, partitions=5).collect()}
    assert len(got) == 16
    for r in g.collect():
        assert np.allclose(got[r.row_id], c.s(np.array(r[1:])), rtol=1e-5)


# neighbours


def line(spark, n=5):
    return spark.createDataFrame([(i, float(abs(i - 2)), 0.0) for i in range(n)], "row_id long, x double, y double")


def test_knn_rules(spark):
    p = line(spark)
    assert [(r.row_id, r.dist) for r in knn.knn(p, 2, 4, "P-loss", ("x", "y")).orderBy("rank").collect()] == [(2, 0.0), (1, 1.0), (3, 1.0), (0, 4.0)]
    assert knn.knn(p, 2, 99, "P-loss", ("x", "y")).count() == 5
    assert rows(knn.knn(p, 2, 5, "PNP", ("x", "y"), metric=[1, 0, 0, 1])) == rows(knn.knn(p, 2, 5, "P-loss", ("x", "y")))
    with pytest.raises(ValueError):
        knn.knn(p, 2, 1, "other")
    with pytest.raises(ValueError):
        knn.knn(p, 77, 1, "P-loss", ("x", "y"))
    many = knn.knn_many(p, spark.createDataFrame([(2,), (0,)], "ref_id long"), 3, ("x", "y"))
    assert [tuple(r)[:3] for r in many.orderBy("ref_id", "rank").collect()] == [(0, 0, 0), (0, 1, 4), (0, 2, 1), (2, 0, 2), (2, 1, 1), (2, 2, 3)]
    assert knn.knn_many(p, spark.createDataFrame([], "ref_id long"), 3, ("x", "y")).count() == 0


def test_bruteforce_ties_and_partitions(spark):
    s = spark.createDataFrame([(i, [float(i % 7), 1.0]) for i in range(300)], "row_id long, s array<float>").repartition(7)
    got = [(r.row_id, r.dist) for r in knn.knn(None, 3, 50, "Bruteforce", store=s).orderBy("rank").collect()]
    assert got == sorted(((i, float((i % 7 - 3) ** 2)) for i in range(300)), key=lambda x: (x[1], x[0]))[:50]


def test_distances():
    a, b, m = np.arange(3.0), np.array([1.0, 5.0, 2.0]), np.diag([1.0, 2.0, 3.0])
    assert D.ploss(a, b) == 17 and D.pnp(a, b, m.ravel()) == 33 and D.pnp(a, b, np.eye(3).ravel()) == 17
    assert D.symmetric_pnp(a, b, m.ravel(), np.eye(3).ravel()) == 25
    assert D.block(np.stack([a, b]), b).tolist() == [17, 0]
    with pytest.raises(ValueError):
        D.distance("cosine")


# hubs and graphs


def test_allocation(spark):
    p = grid.grid(spark, subdiv=3)
    ids = grid.hub_ids(spark, 81, 9)
    table = hubs.hub_metrics(p, ids, Quadratic(5), AXES)
    got = dict(rows(hubs.allocation(p, table, AXES)))
    theta = {r[0]: np.array(r[1:]) for r in p.collect()}
    ms = [(r.hub, theta[r.row_id], np.reshape(r.m, (4, 4))) for r in table.orderBy("hub").collect()]
    for i, t in theta.items():
        q = [(h - t) @ m @ (h - t) for _, h, m in ms]
        assert q[got[i]] <= min(q) + 1e-12
    for hub, row in rows(ids):
        assert got[row] == hub


@pytest.mark.parametrize("block", [2048, 20])
def test_graph_against_brute_force(spark, block):
    p = grid.grid(spark, subdiv=3)
    table = hubs.hub_metrics(p, grid.hub_ids(spark, 81, 9), Quadratic(5), AXES)
    with_m = graph.graph_points(p, hubs.allocation(p, table, AXES), table).persist()
    e = graph.knn_edges(with_m, 4, AXES, block=block).persist()
    got = sorted((r.source, r.target, round(r.weight, 9)) for r in e.collect())
    theta = {r.row_id: (np.array([r[a] for a in AXES]), r.m) for r in with_m.collect()}
    want = []
    for i, (t, m) in theta.items():
        near = sorted((D.symmetric_pnp(c, t, mc, m), j) for j, (c, mc) in theta.items())[:5]
        for w, j in near:
            if i != j:
                want += [(i, j, round(w, 9)), (j, i, round(w, 9))]
    assert got == sorted(want)
    s = graph.stats(p, e).first()
    assert (s.num_nodes, s.num_edges) == (81, len(want)) and math.isclose(s.average_degree, len(want) / 81)
    assert graph.isolated(p, e).count() == 0 and graph.self_loops(e).count() == 0
    u = graph.undirected(e)
    assert u.count() == len({frozenset(x[:2]) for x in want}) and graph.knn_edges(with_m, 4, AXES, dedup=True).count() == len({x[:2] for x in want})


def test_self_outside_its_nearest(spark):
    """All distances zero: ties go by id, so late points aren't among their own nearest and keep k + 1 edges."""
    p = spark.createDataFrame([(i, 1.0, 0.0) for i in range(6)], "row_id long, x double, y double")
    one = graph.nearest_pairs(p, 2, ("x", "y"), None)
    assert sorted((r.source, r.target) for r in one.where("source = 5").collect()) == [(5, 0), (5, 1), (5, 2)]
    assert graph.knn_edges(p, 2, ("x", "y"), None).count() == 2 * (3 * 2 + 3 * 3)


def test_iou(spark):
    r = np.random.default_rng(0)
    for _ in range(3):
        a, b = ([(i, float(r.integers(6)), float(r.integers(3))) for i in range(12)] for _ in range(2))
        fa, fb = (spark.createDataFrame(x, "rank int, x double, y double") for x in (a, b))
        for row in evaluate.iou_curve(fa, fb, ("x", "y"), 12).collect():
            inside = [x[1:] for x in b if 1 <= x[0] <= row.K]
            n = sum(x[1:] in inside for x in a if 1 <= x[0] <= row.K)
            assert (row.intersection, row.union) == (n, 2 * row.K - n)
    own = spark.createDataFrame([(i, float(i), 0.0) for i in range(9)], "rank int, x double, y double")
    assert [x.iou for x in evaluate.iou_curve(own, own, ("x", "y"), 9).collect()] == [1.0] * 8


# layout and exports


def test_layout(spark):
    p = spark.createDataFrame([(i,) for i in range(12)], "id long")
    e = spark.createDataFrame([(a, b, 1.0) for g in (0, 6) for a in range(g, g + 6) for b in range(a) if b >= g], "source long, target long, weight double")
    one = {r.vertex: (r.x, r.y) for r in layout.force_layout(p, e, iterations=30).collect()}
    assert one == {r.vertex: (r.x, r.y) for r in layout.force_layout(p, e, iterations=30).collect()}
    far = lambda a, b: math.dist(one[a], one[b])
    near = np.mean([far(a, b) for g in (0, 6) for a in range(g, g + 6) for b in range(g, a)])
    assert near < np.mean([far(a, b) for a in range(6) for b in range(6, 12)])


def test_exports(spark, tmp_path):
    import xml.etree.ElementTree as ET

    p = grid.grid(spark, {"a": (0, 4), "b": (0, 1)}, 3)
    n, e = graph.nodes(p, ("a", "b")), graph.knn_edges(p, 2, ("a", "b"), None)
    export.write_graphml(n, e, f"{tmp_path}/g")
    text = "\n".join(r.value for f in sorted((tmp_path / "g").glob("part-*")) for r in spark.read.text(str(f)).coalesce(1).collect())
    root = ET.fromstring(text.encode())
    ns = "{http://graphml.graphdrawing.org/xmlns}"
    assert len(list(root.iter(f"{ns}node"))) == 9 and len(list(root.iter(f"{ns}edge"))) == e.count()
    assert [x.text for x in root.iter(f"{ns}data")][:2] == ["0.0,0.0", "0.0,0.5"]
    plain = export.graphml_lines(n.drop("features"), e.drop("weight"))
    assert plain.where("part = 2").first().line.endswith("/>") and plain.where("part = 1").first().line.count("\n") == 1
    export.write_csv(export.layout_edges(e), f"{tmp_path}/e")
    assert spark.read.csv(f"{tmp_path}/e", header=True).columns == ["source", "target", "weight"]
    c = Chain(BandEnergies(), Drum(dur=1000))
    near = knn.knn(grid.grid(spark, subdiv=2), 1, 16, "P-loss")
    files = export.export_sounds({"ploss": near}, c, AXES, str(tmp_path / "wav"))
    assert len(files) == 11
    with wave.open(files[0]) as f:
        assert (f.getnframes(), f.getframerate()) == (1000, 22050)


def test_entry_without_llm(spark):
    import __spark_entry__ as entry

    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and entry.entry(spark).count() > 0


def test_log1p_of_whole_vectors(spark):
    sf = "/root/testdata/sf0.001"
    got = QUERIES["log1p_features_whole"](spark, sf).groupBy("row_id").count().collect()
    assert len(got) == spark.read.parquet(f"{sf}/embeddings.parquet").count() and {x["count"] for x in got} == {64}


def test_whole_graph(spark):
    """Sizes of the reference's graph, and the edges of some points against brute force."""
    p, ids = grid.grid(spark), grid.hub_ids(spark, 10_000, 2000)
    table = hubs.hub_metrics(p, ids, CHAIN, AXES).persist()
    placed = hubs.allocation(p, table, AXES).persist()
    hub = {r.row_id: r.hub for r in placed.collect()}
    assert len(hub) == 10_000 and len(set(hub.values())) > 256
    e = graph.knn_edges(graph.graph_points(p, placed, table), 6, AXES, search="cells").persist()
    assert e.count() == 120_000 and graph.isolated(p, e).count() == 0
    m = np.array([r.m for r in table.orderBy("hub").collect()]).reshape(2000, 4, 4)
    x = np.array([list(r)[1:] for r in p.orderBy("row_id").collect()])
    mine = m[[hub[i] for i in range(10_000)]]
    for i in (0, 41, 5005, 9999):
        d = x[i] - x
        q = np.einsum("na,nab,nb->n", d, (mine + mine[i]) / 2, d)
        near = set(np.lexsort((np.arange(10_000), q))[:7].tolist()) - {i}
        assert near <= {r.target for r in e.where(F.col("source") == i).collect()}
    e.unpersist()


def test_large_ids_and_many_references(spark):
    """Ids that doubles can't tell apart, references in several blocks, and ties across blocks."""
    first = 2**53 + 1
    p = spark.createDataFrame([(first + 2 * i, float(i % 40), 0.0) for i in range(900)], "row_id long, x double, y double").repartition(5)
    for block in (2048, 100):
        one = graph.nearest_pairs(p, 2, ("x", "y"), None, block=block).collect()
        want = {first + 2 * i: sorted((float((i % 40 - j % 40) ** 2), first + 2 * j) for j in range(900))[:3] for i in range(900)}
        got = {}
        for r in one:
            got.setdefault(r.source, []).append((r.weight, r.target))
        assert {i: sorted(v) for i, v in got.items()} == want
    refs = spark.createDataFrame([(first + 2 * i,) for i in range(0, 900, 2)] + [(first,), (7,)], "ref_id long")
    many = {}
    for r in knn.knn_many(p, refs, 3, ("x", "y")).collect():
        many.setdefault(r.ref_id, []).append((r["rank"], r.dist, r.row_id))
    assert {i: [x[1:] for x in sorted(v)] for i, v in many.items()} == {i: v for i, v in want.items() if (i - first) % 4 == 0}


def test_pairs_are_not_shuffled(spark):
    p = grid.grid(spark, subdiv=5)
    plan = graph.nearest_pairs(p, 3, AXES, None, block=64)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    above = plan.split("MapInArrow")[1].split("CartesianProduct" if "CartesianProduct" in plan else "BroadcastNestedLoopJoin")[0]
    assert "Exchange" not in above


# the feature map, written out from its definition


def scattering_by_sums(y, j, q, t, f):
    """Log-scaled coefficients by sums over samples and frequencies, one coefficient at a time, without transforms, folding
    or decimation of what isn't defined on a coarser grid."""
    hop = max(1, min(t // 64, len(y) // 64))
    n = -(-len(y) // hop) * hop
    y = np.r_[y, np.zeros(n - len(y))]
    window = lambda size, centre, width: np.array([math.exp(-((k - centre) ** 2) / (2 * width**2)) * (centre == 0 or k * centre > 0) for k in np.fft.fftfreq(size)])
    wave_of = lambda shape: np.array([sum(shape[k] * complex(math.cos(2 * math.pi * k * i / len(shape)), math.sin(2 * math.pi * k * i / len(shape))) for k in range(len(shape))) / len(shape) for i in range(len(shape))])
    octaves = min(j, max(1, int(math.log2(n)) - 2))
    u = []
    for i in range(octaves * q):
        c = 0.4 * 2 ** (-i / q)
        h = wave_of(window(n, c, max(c * (2 ** (1 / q) - 1) / 1.2, 1 / n)))
        u.append([abs(sum(y[s] * h[(at - s) % n] for s in range(n))) for at in range(0, n, hop)])
    u = np.array(u)
    count, frames = u.shape
    wide = 1 << math.ceil(math.log2(count * 1.25))
    u = np.concatenate([u, np.zeros((wide - count, frames))])
    low_t = wave_of(window(frames, 0, hop / (2 * math.pi * min(t, n) / 2))).real
    low_f = wave_of(window(wide, 0, 1 / (2 * math.pi * f))).real
    at_t, at_f = range(0, frames, max(1, t // hop // 2)), range(0, count, max(1, f))
    stride = lambda size, octave: 2 ** max(0, octave - 1) if size % 2 ** max(0, octave - 1) == 0 else 1

    def mean(z, si, sk):
        return [sum(low_f[(b - k * sk) % wide] * sk * low_t[(a - i * si) % frames] * si * z[k][i] for k in range(len(z)) for i in range(len(z[0]))) for b in at_f for a in at_t]

    out = mean(u, 1, 1)
    fs = [s * 0.4 * 2.0**-i for i in range(max(1, int(math.log2(count)) - 1)) for s in (1, -1)]
    bands_f = [window(wide, c, abs(c) / 2.4 if c > 0 else -abs(c) / 2.4) for c in fs] + [window(wide, 0, 1 / wide)]
    for i in range(max(1, int(math.log2(max(2, min(t, n) / hop))))):
        c = 0.4 * 2.0**-i
        ht, si = wave_of(window(frames, c, c / 2.4)), stride(frames, i)
        along_t = np.array([[sum(u[k][s] * ht[(at - s) % frames] for s in range(frames)) for at in range(0, frames, si)] for k in range(wide)])
        for m, band in enumerate(bands_f):
            hf, sk = wave_of(band), stride(wide, m // 2) if m < len(bands_f) - 1 else 1
            z = [[abs(sum(along_t[k][a] * hf[(at - k) % wide] for k in range(wide))) for a in range(along_t.shape[1])] for at in range(0, wide, sk)]
            out += mean(z, si, sk)
    return np.log1p(1e3 * np.maximum(out, 0))


@pytest.mark.parametrize("j,q,t,f,size", [(4, 2, 64, 2, 128), (3, 3, 128, 1, 100), (5, 1, 256, 3, 192)])
def test_scattering_by_definition(j, q, t, f, size):
    y = np.random.default_rng(j).normal(size=size) * np.exp(-np.arange(size) / 40)
    got, want = JointScattering(j, q, t, f).apply(y), scattering_by_sums(y, j, q, t, f)
    assert got.shape == want.shape and np.allclose(got, want, atol=1e-9)


def test_full_scattering_coefficients():
    """At J = 14, Q = 12, T = 8,192, F = 2: first-order coefficients of a drum sound, each by direct sums over samples."""
    full, y = JointScattering(), synth(THETA, Drum())
    got = full.apply(y)
    n, hop = len(y), full.t // 64
    frames, at_t = n // hop, range(0, n // hop, full.t // hop // 2)
    count = min(full.j, int(math.log2(n)) - 2) * full.q
    wide = 1 << math.ceil(math.log2(count * 1.25))
    k, s = np.fft.fftfreq(n), np.arange(n)
    low = lambda size, width: np.exp(-(np.fft.fftfreq(size) ** 2) / (2 * width**2)) @ np.cos(2 * np.pi * np.outer(np.arange(size), np.arange(size)) / size) / size
    low_t, low_f = low(frames, hop / (np.pi * full.t)), low(wide, 1 / (2 * np.pi * full.f))
    assert n == 65_536 and len(got) == 106_176
    reach = [b for b in range(wide) if abs(low_f[b]) > 1e-13]
    for b in (24, 60):  # places along log-frequency: every f-th wavelet
        bands = {(b - x) % wide for x in reach} & set(range(count))
        want = np.zeros(len(at_t))
        for band in bands:
            c = 0.4 * 2 ** (-band / full.q)
            width = max(c * (2 ** (1 / full.q) - 1) / 1.2, 1 / n)
            used = np.flatnonzero((k > 0) & (abs(k - c) < 9 * width))  # the others weigh less than 1e-17
            h = np.zeros(n, complex)
            h[used] = np.exp(-((k[used] - c) ** 2) / (2 * width**2))
            h = np.fft.ifft(h)
            u = np.array([abs(np.dot(y, h[(at * hop - s) % n])) for at in range(frames)])
            want += low_f[(b - band) % wide] * np.array([sum(low_t[(a - i) % frames] * u[i] for i in range(frames)) for a in at_t])
        assert np.allclose(got[b // full.f * len(at_t) : (b // full.f + 1) * len(at_t)], np.log1p(1e3 * want), atol=1e-7)


def test_full_chain_metric():
    """The metric of the full chain against central differences of its features."""
    c = Chain(JointScattering())
    m, g = c.metric(THETA), []
    for i in range(4):
        e = np.eye(4)[i] * 1e-7
        g.append((c.s(THETA + e) - c.s(THETA - e)) / 2e-7)
    want = np.array(g) @ np.array(g).T
    scale = np.sqrt(np.outer(np.diag(want), np.diag(want)))
    assert np.abs(m - want).max() / scale.max() < 5e-3 and (np.abs(m - want) / scale).max() < 0.02


def test_grid_layout_forces():
    r = np.random.default_rng(5)
    pos, weight, at = r.normal(size=(6000, 2)) * 100, r.integers(1, 9, 6000).astype(float), np.arange(0, 6000, 7)
    exact, near = layout.repulsion(pos, weight, at, 20.0), layout.Cells(pos, weight).repulsion(pos, weight, at, 20.0)
    for j, i in enumerate(at[:5]):
        d = pos[i] - pos
        assert np.allclose(exact[j], (d * (20 * weight[i] * weight / np.maximum((d * d).sum(1), 1e-9))[:, None]).sum(0))
    assert np.hypot(*(exact - near).T).max() < 0.02 * np.median(np.hypot(*exact.T))
    one = layout.Cells(pos[:1], weight[:1])
    assert np.allclose(one.repulsion(pos[:1], weight[:1], np.array([0]), 20.0), 0)


def test_grid_layout_groups(spark):
    p = spark.createDataFrame([(i,) for i in range(400)], "id long")
    e = spark.createDataFrame([(a, b, 1.0) for a in range(400) for b in range(a - 6, a) if b >= 0 and (a < 200) == (b < 200)], "source long, target long, weight double")
    at = {r.vertex: (r.x, r.y) for r in layout.force_layout(p, e, iterations=40, exact=False).collect()}
    far = lambda a, b: math.dist(at[a], at[b])
    assert np.mean([far(i, i + 1) for i in range(0, 199)]) < 0.5 * np.mean([far(i, i + 200) for i in range(0, 200)])


@pytest.mark.parametrize("kind", ["spread", "clusters", "line", "copies"])
def test_tree_layout_forces(kind):
    """Far squares meet as wholes and forces are still nearly exact, wherever vertices are."""
    r = np.random.default_rng(6)
    pos = {
        "spread": r.normal(size=(4000, 2)) * 100,
        "clusters": np.r_[r.normal(size=(2000, 2)) * 0.01, r.normal(size=(2000, 2)) * 100 + 300],
        "line": np.c_[np.arange(4000.0), np.zeros(4000)],
        "copies": np.r_[r.normal(size=(3900, 2)), np.ones((100, 2))],
    }[kind]
    weight = r.integers(1, 9, 4000).astype(float)
    cells = layout.Cells(pos, weight)
    exact = layout.repulsion(pos, weight, np.arange(4000), 20.0)
    near = np.zeros((4000, 2))
    for at in np.array_split(cells.order, 5):
        near[at] = cells.repulsion(pos, weight, at, 20.0)
    size = np.hypot(*exact.T)
    assert (np.hypot(*(exact - near).T) / np.maximum(size, np.median(size))).max() < 0.003
    far, close = cells._met(np.ones(len(cells.c), bool))
    met = ((cells.end - cells.start)[close[0]] * (cells.end - cells.start)[close[1]]).sum()
    assert met + far.shape[1] < 400 * 4000  # a few hundred pushes a vertex
