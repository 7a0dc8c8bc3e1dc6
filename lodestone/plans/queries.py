"""Registered queries of the engine and the DuckDB SQL that gives the same rows.

Transcendental results are rounded or given as float32 in both, everything else is equal bit by bit.
"""

from __future__ import annotations

import math
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import distance as D
from lodestone.functions import drum as M
from lodestone.functions.features import JointScattering
from lodestone.functions.metric import Chain, Quadratic
from lodestone.operators import evaluate, graph, hubs, indexed, knn, layout, precompute
from lodestone.schemas import AXES
from lodestone.sources import export, grid, store
from lodestone.sources.scratch import Stored

REF, K, GRAPH_K = 5, 200, 6
#: A hub for so many points, as in a graph of 10,000 points with 2,000 hubs; one for so many where a full chain gives metrics.
HUB_OF, FULL_HUB_OF, CLOSE = 5, 25, 1e-4
HUB_REQUEST = [5, 3, 3, 999_999_999, 0, 17, 5, 42, 499, 3]
SMALL = M.Drum(dur=256)
CHAIN = Quadratic(3)


def _store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("row_id"), F.col("embedding").alias("s"))


def _sums(s: str = "s") -> list:
    """Sums of a stored vector's four quarters, which lie between -4 and 4."""
    return [D._total([F.col(s)[16 * j + i].cast("double") for i in range(16)]) for j in range(4)]


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stored vector as a parameter row of the drum: its quarters' sums, scaled to the axes' bounds."""
    return _store(spark, sf_dir).select("row_id", *((F.lit(low) + (g + 4.0) * F.lit((high - low) / 8)).alias(a) for g, (a, (low, high)) in zip(_sums(), grid.BOUNDS.items())))


def _whole_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stored vector as a point of two whole coordinates."""
    return _store(spark, sf_dir).select("row_id", *(F.floor(64 * g).cast("double").alias(a) for g, a in zip(_sums(), "ab")))


def _count(spark: SparkSession, sf_dir: str) -> int:
    return _store(spark, sf_dir).count()


def _hub_ids(spark: SparkSession, sf_dir: str, of: int = HUB_OF) -> DataFrame:
    n = _count(spark, sf_dir)
    return grid.hub_ids(spark, n, max(2, n // of))


def _bounds(spark: SparkSession, sf_dir: str) -> tuple[dict[str, tuple[float, float]], int, int]:
    """The ranges of the points, how many a grid has along an axis to have as many points as the table, and the table's rows."""
    r = _points(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"), *(f(a).alias(f"{f.__name__}_{a}") for a in AXES for f in (F.min, F.max))).first()
    return {a: (r[f"min_{a}"], r[f"max_{a}"]) for a in AXES}, math.ceil(math.sqrt(math.sqrt(r.n))), r.n


def _metric_columns(df: DataFrame) -> DataFrame:
    """df with m: the closed-form metric as built-in arithmetic."""
    g = [[F.lit(1.0 / (i + j + 1)) + F.col(a) / F.lit(1.0 + i + 2 * j) for i, a in enumerate(AXES)] for j in range(CHAIN.coefficients)]
    return df.withColumn("m", F.array(*(D._total([row[a] * row[b] for row in g]) for a in range(4) for b in range(4))))


def _feature_columns(df: DataFrame) -> DataFrame:
    s = [D._total([F.col(a) / F.lit(float(i + j + 1)) + F.col(a) * F.col(a) / F.lit(2.0 + 2 * i + 4 * j) for i, a in enumerate(AXES)]) for j in range(CHAIN.coefficients)]
    return df.select("row_id", F.array(*(x.cast("float") for x in s)).alias("s"))


def _ref(df: DataFrame, *more: str) -> DataFrame:
    """The reference row, as columns r_*: one row."""
    return df.where(F.col("row_id") == REF).select(*(F.col(a).alias(f"r_{a}") for a in (*AXES, *more)))


def theta_grid(spark, sf):
    """The grid over the points' ranges that has about as many points."""
    bounds, subdiv, _ = _bounds(spark, sf)
    return grid.grid(spark, bounds, subdiv)


def theta_grid_f32(spark, sf):
    bounds, subdiv, _ = _bounds(spark, sf)
    return grid.grid(spark, bounds, subdiv, single=True)


def theta_grid_first(spark, sf):
    bounds, subdiv, n = _bounds(spark, sf)
    return grid.first_rows(grid.grid(spark, bounds, subdiv), n)


def theta_grid_five_axes(spark, sf):
    bounds, subdiv, _ = _bounds(spark, sf)
    return grid.grid(spark, {"omega": (2.4, 3.8), **bounds}, subdiv)


def csv_positions(spark, sf):
    """All points written as CSV without ids, in files of some rows, and read back: ids are positions."""
    store_ = Stored(spark)
    path = store_.place("points")
    grid.write_csv(_points(spark, sf), path, ids=False, rows=20_000)
    return grid.read_csv(spark, path, single=False)


def hub_ids(spark, sf):
    return _hub_ids(spark, sf)


def s_lookup_last(spark, sf):
    """A store with many rows an id (all line items of an order, by line number): of each order asked for the last counts."""
    items = spark.read.parquet(f"{sf}/lineitem.parquet").select(F.col("l_orderkey").alias("row_id"), F.col("l_extendedprice").alias("price"), "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    kept = Stored(spark).put("items", items.repartitionByRange("l_linenumber", "l_partkey", "l_suppkey", "price", "l_quantity").sortWithinPartitions("l_linenumber", "l_partkey", "l_suppkey", "price", "l_quantity"))
    orders = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderkey").alias("row_id"), F.col("o_orderkey").alias("pos"))
    return store.lookup(kept, orders, "price").select("row_id", "price")


def s_keyed_groups(spark, sf):
    """Line items stored in buckets by order: those of urgent orders, counted by order, without a shuffle of the store."""
    items = spark.read.parquet(f"{sf}/lineitem.parquet").select(F.col("l_orderkey").alias("row_id"), F.col("l_extendedprice").alias("price"))
    urgent = spark.read.parquet(f"{sf}/orders.parquet").where(F.col("o_orderpriority").startswith("1")).select(F.col("o_orderkey").alias("row_id"))
    kept = store.write_keyed(items, Stored(spark).place("items"), 16)
    return store.hub_rows(kept, urgent).groupBy("row_id").agg(F.count(F.lit(1)).alias("n"), F.max("price").alias("price"))


def s_lookup_ordered(spark, sf):
    return store.lookup(_store(spark, sf), HUB_REQUEST).select("pos", "row_id", F.size("s").alias("n"), F.col("s")[0].cast("double").alias("s0"), F.col("s")[63].cast("double").alias("s63"))


def s_lookup_batched(spark, sf):
    return store.lookup_batches(_store(spark, sf), HUB_REQUEST, 3).select("batch", "pos", "row_id", F.col("s")[1].cast("double").alias("s1"))


def s_filtered_scan(spark, sf):
    return store.filtered(_store(spark, sf), HUB_REQUEST).select("row_id", F.col("s")[0].cast("double").alias("s0"))


def s_hub_semijoin(spark, sf):
    s = _store(spark, sf)
    return store.hub_rows(s, grid.hub_ids(spark, s.count(), 50)).select("row_id", F.col("s")[0].cast("double").alias("s0"))


def ploss_dist(spark, sf):
    p = _points(spark, sf)
    return p.crossJoin(F.broadcast(_ref(p))).select("row_id", D.ploss([F.col(a) for a in AXES], [F.col(f"r_{a}") for a in AXES]).alias("dist"))


def pnp_dist(spark, sf):
    p = _metric_columns(_points(spark, sf))
    return p.crossJoin(F.broadcast(_ref(p, "m"))).select("row_id", D.pnp([F.col(a) for a in AXES], [F.col(f"r_{a}") for a in AXES], [F.col("r_m")[i] for i in range(16)]).alias("dist"))


def sym_pnp_dist(spark, sf):
    p = _metric_columns(_points(spark, sf))
    m = [[F.col(c)[i] for i in range(16)] for c in ("m", "r_m")]
    return p.crossJoin(F.broadcast(_ref(p, "m"))).select("row_id", D.symmetric_pnp([F.col(a) for a in AXES], [F.col(f"r_{a}") for a in AXES], *m).alias("dist"))


def bruteforce_dist(spark, sf):
    s = _store(spark, sf)
    return knn.feature_distances(s, knn._reference(s, REF, ["s"])[0])


def knn_ploss(spark, sf):
    return knn.knn(_points(spark, sf), REF, K, "P-loss")


def knn_pnp(spark, sf):
    return knn.knn(_points(spark, sf), REF, K, "PNP", chain=CHAIN)


def knn_bruteforce(spark, sf):
    return knn.knn(None, REF, K, "Bruteforce", store=_store(spark, sf))


def knn_bruteforce_theta(spark, sf):
    p = _points(spark, sf)
    return knn.knn(p, REF, K, "Bruteforce", store=_feature_columns(p))


def _order_vectors(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    parts = (F.col("o_totalprice") / 1e3, F.datediff("o_orderdate", F.lit("1995-01-01")).cast("double"), F.col("o_custkey") / 10.0)
    return o.select(F.col("o_orderkey").alias("row_id"), F.array(*parts).alias("s"))


def knn_indexed(spark, sf):
    """Neighbours of one order among all, by an index of pivot distances."""
    s = _order_vectors(spark, sf)
    path = Stored(spark).place("index")
    indexed.write(s, path)
    return indexed.knn(spark, path, REF, knn._reference(s, REF, ["s"])[0], K)


def knn_many_references(spark, sf):
    return knn.knn_many(_points(spark, sf), _hub_ids(spark, sf, 25).select(F.col("row_id").alias("ref_id")), 10, AXES)


def _hub_table(points: DataFrame, ids: DataFrame) -> DataFrame:
    return ids.join(_metric_columns(points).select("row_id", "m"), "row_id").select("hub", "row_id", "m")


def hub_allocation_whole(spark, sf):
    p = _points(spark, sf)
    return hubs.allocation(p, _hub_table(p, _hub_ids(spark, sf)), AXES)


def metric_tensor_whole(spark, sf):
    return hubs.hub_metrics(_points(spark, sf), _hub_ids(spark, sf), CHAIN, AXES).select("hub", "row_id", F.posexplode("m").alias("at", "m"))


def _graph_of(p: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Points and their k-NN graph under the metrics of their hubs."""
    table = _hub_table(p, ids)
    return p, graph.knn_edges(graph.graph_points(p, hubs.allocation(p, table, AXES), table), GRAPH_K, AXES, search="cells")


def _graph(spark, sf):
    return _graph_of(_points(spark, sf), _hub_ids(spark, sf))


def knn_graph_edges_whole(spark, sf):
    return _graph(spark, sf)[1]


def knn_graph_plain(spark, sf):
    """The graph of all points under plain distances."""
    return graph.knn_edges(_points(spark, sf), GRAPH_K, AXES, metric=None, search="cells")


def knn_graph_upkeep(spark, sf):
    """The same graph in two steps: of nine tenths of the points, then brought up to date with the rest."""
    p = _points(spark, sf)
    base, batch = p.where("row_id % 10 <> 3"), p.where("row_id % 10 = 3")
    near = graph.nearest_pairs(base, GRAPH_K, AXES, metric=None, search="cells")
    return graph.edges_of(graph.updated_pairs(base, near, batch, GRAPH_K, AXES, metric=None))


def knn_graph_orders(spark, sf):
    """The graph of all orders as points (price, day, customer) under plain distances."""
    o = spark.read.parquet(f"{sf}/orders.parquet")
    p = o.select(F.col("o_orderkey").alias("row_id"), (F.col("o_totalprice") / 1e3).alias("price"), F.datediff("o_orderdate", F.lit("1995-01-01")).cast("double").alias("day"), (F.col("o_custkey") / 10.0).alias("customer"))
    return graph.knn_edges(p, GRAPH_K, ("price", "day", "customer"), metric=None, search="cells")


def knn_graph_blocks(spark, sf):
    """The same graph over vectors, each a point of 64 axes without a metric, in several blocks."""
    s = _store(spark, sf)
    axes = [f"e{i}" for i in range(64)]
    p = s.select("row_id", *(F.col("s")[i].cast("double").alias(a) for i, a in enumerate(axes)))
    return graph.knn_edges(p, GRAPH_K, axes, metric=None, block=128)


def knn_graph_undirected_whole(spark, sf):
    return graph.undirected(_graph(spark, sf)[1])


def knn_graph_stats_whole(spark, sf):
    return graph.stats(*_graph(spark, sf))


def graph_isolated_whole(spark, sf):
    """Points that no edge of at most CLOSE reaches."""
    p, e = _graph(spark, sf)
    return graph.isolated(p, e.where(F.col("weight") <= CLOSE))


def graph_selfloops(spark, sf):
    """The loops in the graph, which has none of its own, and one for each hub."""
    loops = _hub_ids(spark, sf).select(F.col("row_id").alias("source"), F.col("row_id").alias("target"), F.lit(0.0).alias("weight"))
    return graph.self_loops(_graph(spark, sf)[1].unionByName(loops))


def layout_edges_whole(spark, sf):
    return export.layout_edges(knn_graph_undirected_whole(spark, sf))


def iou_curve(spark, sf):
    p = _points(spark, sf)
    return evaluate.iou_curve(knn.knn(p, REF, K, "PNP", chain=CHAIN), knn.knn(p, REF, K, "Bruteforce", store=_feature_columns(p)), AXES, K)


def iou_curve_ploss(spark, sf):
    p = _points(spark, sf)
    return evaluate.iou_curve(knn.knn(p, REF, K, "P-loss"), knn.knn(p, REF, K, "Bruteforce", store=_feature_columns(p)), AXES, K)


def iou_self(spark, sf):
    a = knn_bruteforce_theta(spark, sf)
    return evaluate.iou_curve(a, a, AXES, K)


def method_trade_off(spark, sf):
    """Own wall seconds and overlap at K = 50 of the three methods; timings differ from run to run."""
    p, found, took = _points(spark, sf), {}, {}
    for name, q in (("Bruteforce", knn_bruteforce_theta), ("PNP", knn_pnp), ("P-loss", knn_ploss)):
        t = time.perf_counter()
        found[name] = p.sparkSession.createDataFrame(q(spark, sf).toArrow())
        took[name] = time.perf_counter() - t
    at = {n: evaluate.iou_curve(f, found["Bruteforce"], AXES, 51).where("K = 50").first()["iou"] for n, f in found.items()}
    return evaluate.trade_off(spark, [(n, took[n], at[n]) for n in found])


def drum_coefs(spark, sf):
    f = lambda c: F.col(c).cast("float").alias(c)
    return M.drum_coefficients(_points(spark, sf)).select("row_id", *(f(c) for c in ("w", "l2", "s4", "c2", "d1", "d3")))


def drum_coefs_as_written(spark, sf):
    f = lambda c: F.col(c).cast("float").alias(c)
    return M.drum_coefficients(_points(spark, sf), as_written=True).select("row_id", *(f(c) for c in ("w", "l2", "s4", "c2", "d1", "d3")))


def drum_modes_whole(spark, sf):
    return _mode_rows(_points(spark, sf))


def _mode_rows(points):
    f = lambda c: F.col(c).cast("float").alias(c)
    return M.drum_modes(points).select("row_id", "mu1", "mu2", f("n"), f("decay"), f("omega"), "rejected", F.round("amp", 9).alias("amp"))


def drum_mode_block(spark, sf):
    return M.mode_block(M.drum_modes(_points(spark, sf)))


def drum_waveform(spark, sf):
    return M.waveform_rows(_points(spark, sf), SMALL).select("row_id", "t", (F.round("y", 6) + 0.0).alias("y"))


def physics_to_percept(spark, sf):
    p = M.drum_coefficients(_points(spark, sf))
    w, tau, q, d = M.to_percept(F.col("s4"), F.col("c2"), F.col("d1"), F.col("d3"), math.pi, 1.0)
    return p.select("row_id", *(c.cast("float").alias(n) for c, n in ((w, "w"), (tau, "tau"), (q, "p"), (d, "d"))))


def percept_to_physics(spark, sf):
    p = _points(spark, sf)
    out = M.to_physics(F.pow(F.lit(10.0), F.lit(M.OMEGA)), F.col("tau"), F.pow(F.lit(10.0), F.col("p")), F.pow(F.lit(10.0), F.col("d")), 2.0, 0.5)
    return p.select("row_id", *(c.cast("float").alias(n) for c, n in zip(out, ("d1", "d3", "s4", "c2"))))


def log1p_features_whole(spark, sf):
    """Every component of every stored vector."""
    return _store(spark, sf).select("row_id", F.posexplode("s").alias("i", "v")).select("row_id", "i", F.round(F.log1p(F.abs(F.col("v").cast("double")) * 1e3), 6).alias("v"))


def feature_strings(spark, sf):
    p = _whole_points(spark, sf)
    return graph.nodes(p, ("a", "b")).select("id", export.feature_string(F.col("features")).alias("features"))


def graphml_lines(spark, sf):
    p = _whole_points(spark, sf)
    return export.graphml_lines(graph.nodes(p, ("a", "b")), graph.knn_edges(p, 2, ("a", "b"), metric=None, search="cells")).select("part", "a", "b", "line")


def knn_pnp_scattering(spark, sf):
    """The full chain at the reference row: 65,536 samples, joint scattering, exact derivatives, then all points."""
    return knn.knn(_points(spark, sf), REF, 50, "PNP", chain=Chain(JointScattering()))


def layout_nodes_whole(spark, sf):
    """All 100 rounds over the whole graph."""
    p, e = _graph(spark, sf)
    return export.layout_nodes(layout.force_layout(graph.nodes(p, AXES), e, exact=False), graph.nodes(p, AXES))


def feature_precompute_full(spark, sf):
    """All points through the full chain: 65,536 samples, joint scattering with J = 14, Q = 12, T = 8,192, F = 2."""
    return precompute.features(_points(spark, sf), Chain(JointScattering()), AXES, partitions=_tasks(spark))


def metric_hub_full_chain(spark, sf):
    """Metrics of a hub for 25 points from the full chain's exact derivatives."""
    return hubs.hub_metrics(_points(spark, sf), _hub_ids(spark, sf, FULL_HUB_OF), Chain(JointScattering()), AXES, partitions=_tasks(spark))


def wav_frames_full(spark, sf):
    """All 65,536 samples of every point's sound."""
    return export.frames(precompute.waveforms(_points(spark, sf), Chain(JointScattering()), AXES, partitions=_tasks(spark)))


def _tasks(spark) -> int:
    return 4 * spark.sparkContext.defaultParallelism


QUERIES = {
    f.__name__: f
    for f in (
        knn_bruteforce, theta_grid, theta_grid_f32, theta_grid_first, theta_grid_five_axes, csv_positions, hub_ids, s_lookup_last, s_keyed_groups, s_lookup_ordered, s_lookup_batched, s_filtered_scan, s_hub_semijoin,
        ploss_dist, pnp_dist, sym_pnp_dist, bruteforce_dist, knn_ploss, knn_pnp, knn_bruteforce_theta, knn_indexed, knn_many_references, hub_allocation_whole, metric_tensor_whole,
        knn_graph_edges_whole, knn_graph_plain, knn_graph_upkeep, knn_graph_orders, knn_graph_blocks, knn_graph_undirected_whole, knn_graph_stats_whole, graph_isolated_whole, graph_selfloops, iou_curve, iou_curve_ploss, iou_self, method_trade_off,
        drum_coefs, drum_coefs_as_written, drum_modes_whole, drum_mode_block, drum_waveform, physics_to_percept, percept_to_physics, log1p_features_whole, feature_strings, graphml_lines,
        layout_edges_whole, layout_nodes_whole, knn_pnp_scattering, feature_precompute_full, metric_hub_full_chain, wav_frames_full,
    )
}


def _n(x: float) -> str:
    """A DOUBLE literal."""
    return f"{float(x)!r}" if "e" in repr(float(x)) else f"{float(x)!r}e0"


_SUMS = ["(" + " + ".join(f"CAST(embedding[{16 * j + i + 1}] AS DOUBLE)" for i in range(16)) + ")" for j in range(4)]
_P = "(SELECT vec_id AS row_id, " + ", ".join(f"{_n(low)} + ({g} + 4e0) * {_n((high - low) / 8)} AS {a}" for g, (a, (low, high)) in zip(_SUMS, grid.BOUNDS.items())) + " FROM embeddings)"
_AB = f"(SELECT vec_id AS row_id, floor(64 * {_SUMS[0]}) AS a, floor(64 * {_SUMS[1]}) AS b FROM embeddings)"


def _grid(single: bool = False, omega: bool = False) -> str:
    names = ["omega", *AXES] if omega else list(AXES)
    low = [*(["24e-1"] if omega else []), *(f"min_{a}" for a in AXES)]
    high = [*(["38e-1"] if omega else []), *(f"max_{a}" for a in AXES)]
    axis = lambda i: f"CASE WHEN i{i} = n - 1 THEN {high[i]} ELSE i{i} * (({high[i]} - {low[i]}) / (n - 1)) + {low[i]} END"
    wrap = (lambda x: f"CAST(CAST({x} AS FLOAT) AS DOUBLE)") if single else (lambda x: x)
    ids = "i0"
    for i in range(1, len(names)):
        ids = f"({ids} * n + i{i})"
    ends = ", ".join(f"{f}({a}) AS {f}_{a}" for a in AXES for f in ("min", "max"))
    return f"""(WITH b AS MATERIALIZED (SELECT CAST(ceil(sqrt(sqrt(count(*)))) AS BIGINT) AS n, {ends} FROM {_P}), i AS MATERIALIZED (SELECT unnest(range(n)) AS i FROM b)
        SELECT {ids} AS row_id, {', '.join(f'{wrap(axis(i))} AS {a}' for i, a in enumerate(names))} FROM b, {', '.join(f'i AS x{i}(i{i})' for i in range(len(names)))})"""


def _hubs(of: int = HUB_OF) -> str:
    return f"(SELECT CAST(i AS INTEGER) AS hub, CAST((i * (n - 1)) // (h - 1) AS BIGINT) AS row_id FROM (SELECT n, h, unnest(range(h)) AS i FROM (SELECT count(*) AS n, greatest(2, count(*) // {of}) AS h FROM embeddings)))"


def _metric(t: str) -> list[str]:
    g = [[f"({_n(1 / (i + j + 1))} + {t}.{a} / {_n(1.0 + i + 2 * j)})" for i, a in enumerate(AXES)] for j in range(3)]
    return ["(" + " + ".join(f"{row[a]} * {row[b]}" for row in g) + ")" for a in range(4) for b in range(4)]


def _pnp(c: str, r: str, m: list[str]) -> str:
    return " + ".join(f"{m[i * 4 + j]} * ({r}.{a} - {c}.{a}) * ({r}.{b} - {c}.{b})" for i, a in enumerate(AXES) for j, b in enumerate(AXES))


def _ploss(c: str, r: str, axes=AXES) -> str:
    return " + ".join(f"({r}.{a} - {c}.{a}) * ({r}.{a} - {c}.{a})" for a in axes)


_FOLD = "list_reduce(list_prepend(0e0, list_transform(list_zip({c}, {r}), lambda z: (z[2] - z[1]) * (z[2] - z[1]))), lambda p, q: p + q)"
_S = "[" + ", ".join("CAST(CAST(" + " + ".join(f"({a} / {_n(i + j + 1)} + {a} * {a} / {_n(2 + 2 * i + 4 * j)})" for i, a in enumerate(AXES)) + " AS FLOAT) AS DOUBLE)" for j in range(3)) + "]"
_SEMI = "(SELECT CAST(i AS INTEGER) AS hub, CAST((i * (n - 1)) // 49 AS BIGINT) AS row_id FROM (SELECT count(*) AS n FROM embeddings), range(50) AS h(i))"


def _knn(dist: str, points: str, k: int, extra: str = "") -> str:
    return f"SELECT CAST({REF} AS BIGINT) AS ref_id, CAST(row_number() OVER (ORDER BY dist, row_id) - 1 AS INTEGER) AS rank, row_id, dist{extra} FROM (SELECT c.*, {dist} AS dist FROM {points} c, (SELECT * FROM {points} WHERE row_id = {REF}) r) QUALIFY rank < {k}"


_AX = ", tau, p, d, alpha"
_BF = f"(SELECT g.*, {_S} AS s FROM {_P} g)"
_KNN_PLOSS, _KNN_PNP, _KNN_BF = _knn(_ploss("c", "r"), _P, K, _AX), _knn(_pnp("c", "r", _metric("r")), _P, K, _AX), _knn(_FOLD.format(c="c.s", r="r.s"), _BF, K, _AX)


def _iou(a: str, b: str) -> str:
    """The definition, once for each K."""
    return f"""WITH a AS MATERIALIZED ({a}), b AS MATERIALIZED ({b}), ks AS (SELECT CAST(i AS INTEGER) AS K FROM range(1, {K}) AS r(i)),
        n AS (SELECT K, (SELECT count(*) FROM a WHERE a.rank BETWEEN 1 AND K AND EXISTS (SELECT 1 FROM b WHERE b.rank BETWEEN 1 AND K AND a.tau = b.tau AND a.p = b.p AND a.d = b.d AND a.alpha = b.alpha)) AS n FROM ks)
        SELECT K, CAST(n AS BIGINT) AS intersection, CAST(2 * K - n AS BIGINT) AS "union", n / CAST(2 * K - n AS DOUBLE) AS iou FROM n"""


def _alloc(hub_rows: str, points: str) -> str:
    return f"""hub AS MATERIALIZED (SELECT h.hub, p.* FROM {hub_rows} h JOIN {points} p USING (row_id)),
        alloc AS MATERIALIZED (SELECT c.row_id, CAST(arg_min(r.hub, (q, r.hub)) AS INTEGER) AS hub FROM (SELECT c.row_id, r.hub, {_pnp('c', 'r', _metric('r'))} AS q FROM {points} c, hub r) AS c(row_id, hub, q), LATERAL (SELECT c.hub AS hub) r GROUP BY c.row_id)"""


def _edges(points: str = _P, hub_rows: str = "") -> str:
    m = [f"((c.m{i} + r.m{i}) / 2e0)" for i in range(16)]
    return f"""WITH pt AS MATERIALIZED (SELECT * FROM {points}), {_alloc(hub_rows or _hubs(), 'pt')},
        gp AS MATERIALIZED (SELECT pt.*, {', '.join(f'{x} AS m{i}' for i, x in enumerate(_metric('hub')))} FROM pt JOIN alloc USING (row_id) JOIN hub ON hub.hub = alloc.hub),
        pair AS (SELECT r.row_id AS source, c.row_id AS target, {_pnp('c', 'r', m)} AS weight FROM gp r, gp c),
        least AS (SELECT source, unnest(min((weight, target), {GRAPH_K + 1})) AS x FROM pair GROUP BY source),
        near AS MATERIALIZED (SELECT source, x[2] AS target, x[1] AS weight FROM least),
        edge AS (SELECT source, target, weight FROM near WHERE source <> target UNION ALL SELECT target, source, weight FROM near WHERE source <> target)"""


def _plain_edges(points: str, axes, k: int = GRAPH_K) -> str:
    return f"""WITH pt AS MATERIALIZED (SELECT * FROM {points}),
        pair AS (SELECT r.row_id AS source, c.row_id AS target, {_ploss('c', 'r', axes)} AS weight FROM pt r, pt c),
        least AS (SELECT source, unnest(min((weight, target), {k + 1})) AS x FROM pair GROUP BY source),
        near AS MATERIALIZED (SELECT source, x[2] AS target, x[1] AS weight FROM least),
        edge AS (SELECT source, target, weight FROM near WHERE source <> target UNION ALL SELECT target, source, weight FROM near WHERE source <> target)"""


def _coefs(w: str, tau: str, p: str, d: str, a: str) -> str:
    b = f"({a} + 1 / {a})"
    pi = _n(math.pi)
    return f"""{w} AS w, {a} * {pi} AS l2, (({d} * {w} * {a}) * ({d} * {w} * {a}) + ({p} * {a} / {tau}) * ({p} * {a} / {tau})) AS s4,
        {a} * ((1 / {b} - {p} * {p} * {b}) / ({tau} * {tau}) + {w} * {w} * (1 / {b} - {d} * {d} * {b})) AS c2, 2 * (1 - {p} * {b}) / {tau} AS d1, -2 * {p} * {a} / {tau} AS d3"""


def _drum(points: str) -> str:
    return f"SELECT row_id, {_coefs('w', 'tau', 'p', 'd', 'alpha')} FROM (SELECT row_id, pow(10e0, {_n(M.OMEGA)}) AS w, tau, pow(10e0, p) AS p, pow(10e0, d) AS d, alpha FROM {points})"


def _modes(points: str) -> str:
    pi = _n(math.pi)
    return f"""co AS ({_drum(points)}),
        md AS (SELECT *, pow(mu1 * {pi} / {pi}, 2e0) + pow(mu2 * {pi} / l2, 2e0) AS n FROM co, range(1, 11) AS u(mu1), range(1, 11) AS v(mu2)),
        mo AS (SELECT *, (d1 - d3 * n) / 2 AS decay FROM md),
        om AS (SELECT *, sqrt(abs(s4 * n * n + c2 * n - decay * decay)) AS omega, sin(mu1 * {pi} * 4e-1) * sin(mu2 * {pi} * 4e-1) AS shape FROM mo),
        modes AS (SELECT row_id, CAST(mu1 AS INTEGER) AS mu1, CAST(mu2 AS INTEGER) AS mu2, n, decay, omega, omega / 2 / {pi} > 11025 AS rejected, 3e-2 * shape * shape / (omega * {pi} * l2 / 4) AS amp FROM om)"""


_BLOCK = """r1 AS (SELECT row_id, max(r) AS r FROM (SELECT row_id, mu2, sum(CAST(rejected AS INTEGER)) AS r FROM modes GROUP BY ALL) GROUP BY row_id),
        r2 AS (SELECT row_id, max(r) AS r FROM (SELECT row_id, mu1, sum(CAST(rejected AS INTEGER)) AS r FROM modes GROUP BY ALL) GROUP BY row_id),
        block AS (SELECT row_id, CAST(CASE WHEN r1.r = 10 THEN 10 ELSE 10 - r1.r END AS INTEGER) AS c1, CAST(CASE WHEN r2.r = 10 THEN 10 ELSE 10 - r2.r END AS INTEGER) AS c2 FROM r1 JOIN r2 USING (row_id))"""
_STEP = _n(SMALL.dur / (SMALL.dur - 1) / SMALL.sr)
_STORE = "(SELECT vec_id AS row_id, embedding AS s FROM embeddings)"
_REQUEST = ", ".join(f"({p}, {i})" for p, i in enumerate(HUB_REQUEST))
_FLOATS = lambda names: ", ".join(f"CAST({c} AS FLOAT) AS {c}" for c in names)
_TEXT = "CAST(CAST(a AS FLOAT) AS VARCHAR) || ',' || CAST(CAST(b AS FLOAT) AS VARCHAR)"
_EMB_EDGES = f"""WITH pt AS MATERIALIZED (SELECT vec_id AS row_id, embedding::DOUBLE[] AS s FROM embeddings),
        pair AS (SELECT r.row_id AS source, c.row_id AS target, {_FOLD.format(c='c.s', r='r.s')} AS weight FROM pt r, pt c),
        near AS MATERIALIZED (SELECT * FROM pair QUALIFY row_number() OVER (PARTITION BY source ORDER BY weight, target) <= {GRAPH_K + 1})
        SELECT source, target, weight FROM near WHERE source <> target UNION ALL SELECT target, source, weight FROM near WHERE source <> target"""
_PI = _n(math.pi)
_ORDERS = "(SELECT o_orderkey AS row_id, o_totalprice / 1e3 AS price, CAST(datediff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE) AS day, o_custkey / 1e1 AS customer FROM orders)"
_UNDIRECTED = "SELECT least(source, target) AS source, greatest(source, target) AS target, min(weight) AS weight FROM edge GROUP BY 1, 2"
_STATS = "SELECT n AS num_nodes, count(*) AS num_edges, count(*) / CAST(n AS DOUBLE) AS average_degree FROM edge, (SELECT count(*) AS n FROM pt) GROUP BY n"


def _tensor(points: str, hub_rows: str) -> str:
    return f"SELECT hub, row_id, CAST(generate_subscripts(m, 1) - 1 AS INTEGER) AS at, unnest(m) AS m FROM (SELECT hub, p.row_id, [{', '.join(_metric('p'))}] AS m FROM {hub_rows} h JOIN {points} p USING (row_id))"


def _mode_sql(points: str) -> str:
    return f"WITH {_modes(points)} SELECT row_id, mu1, mu2, {_FLOATS(('n', 'decay', 'omega'))}, rejected, round(amp, 9) AS amp FROM modes"


ORACLES = {
    "theta_grid": f"SELECT * FROM {_grid()}",
    "theta_grid_f32": f"SELECT * FROM {_grid(single=True)}",
    "theta_grid_first": f"SELECT * FROM {_grid()} WHERE row_id < (SELECT count(*) FROM embeddings)",
    "theta_grid_five_axes": f"SELECT * FROM {_grid(omega=True)}",
    "csv_positions": f"SELECT row_number() OVER (ORDER BY row_id) - 1 AS row_id, tau, p, d, alpha FROM {_P}",
    "hub_ids": f"SELECT * FROM {_hubs()}",
    "s_lookup_last": "SELECT l_orderkey AS row_id, arg_max(l_extendedprice, (l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity)) AS price FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders) GROUP BY l_orderkey",
    "s_keyed_groups": "SELECT l_orderkey AS row_id, count(*) AS n, max(l_extendedprice) AS price FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority LIKE '1%') GROUP BY l_orderkey",
    "s_lookup_ordered": f"SELECT CAST(pos AS BIGINT) AS pos, row_id, CAST(len(s) AS INTEGER) AS n, CAST(s[1] AS DOUBLE) AS s0, CAST(s[64] AS DOUBLE) AS s63 FROM (VALUES {_REQUEST}) AS q(pos, row_id) JOIN {_STORE} USING (row_id)",
    "s_lookup_batched": f"SELECT CAST(pos // 3 AS BIGINT) AS batch, CAST(pos AS BIGINT) AS pos, row_id, CAST(s[2] AS DOUBLE) AS s1 FROM (VALUES {_REQUEST}) AS q(pos, row_id) JOIN {_STORE} USING (row_id)",
    "s_filtered_scan": f"SELECT row_id, CAST(s[1] AS DOUBLE) AS s0 FROM {_STORE} WHERE row_id IN ({', '.join(map(str, HUB_REQUEST))})",
    "s_hub_semijoin": f"SELECT row_id, CAST(s[1] AS DOUBLE) AS s0 FROM {_STORE} WHERE row_id IN (SELECT row_id FROM {_SEMI})",
    "ploss_dist": f"SELECT c.row_id, {_ploss('c', 'r')} AS dist FROM {_P} c, (SELECT * FROM {_P} WHERE row_id = {REF}) r",
    "pnp_dist": f"SELECT c.row_id, {_pnp('c', 'r', _metric('r'))} AS dist FROM {_P} c, (SELECT * FROM {_P} WHERE row_id = {REF}) r",
    "sym_pnp_dist": f"SELECT c.row_id, {_pnp('c', 'r', [f'(({a} + {b}) / 2e0)' for a, b in zip(_metric('c'), _metric('r'))])} AS dist FROM {_P} c, (SELECT * FROM {_P} WHERE row_id = {REF}) r",
    "bruteforce_dist": f"SELECT c.row_id, {_FOLD.format(c='c.s::DOUBLE[]', r='r.s::DOUBLE[]')} AS dist FROM {_STORE} c, (SELECT * FROM {_STORE} WHERE row_id = {REF}) r",
    "knn_ploss": _KNN_PLOSS,
    "knn_pnp": _KNN_PNP,
    "knn_bruteforce": _knn(_FOLD.format(c="c.s::DOUBLE[]", r="r.s::DOUBLE[]"), _STORE, K),
    "knn_bruteforce_theta": _KNN_BF,
    "knn_indexed": _knn(_FOLD.format(c="c.s", r="r.s"), f"(SELECT row_id, [price, day, customer] AS s FROM {_ORDERS})", K),
    "knn_many_references": f"SELECT r.row_id AS ref_id, CAST(row_number() OVER (PARTITION BY r.row_id ORDER BY {_ploss('c', 'r')}, c.row_id) - 1 AS INTEGER) AS rank, c.row_id, {_ploss('c', 'r')} AS dist FROM {_P} c, (SELECT * FROM {_P} SEMI JOIN {_hubs(25)} USING (row_id)) r QUALIFY rank < 10",
    "hub_allocation_whole": f"WITH pt AS MATERIALIZED (SELECT * FROM {_P}), {_alloc(_hubs(), 'pt')} SELECT * FROM alloc",
    "metric_tensor_whole": _tensor(_P, _hubs()),
    "knn_graph_edges_whole": f"{_edges()} SELECT * FROM edge",
    "knn_graph_plain": f"{_plain_edges(_P, AXES)} SELECT * FROM edge",
    "knn_graph_upkeep": f"{_plain_edges(_P, AXES)} SELECT * FROM edge",
    "knn_graph_orders": f"{_plain_edges(_ORDERS, ('price', 'day', 'customer'))} SELECT * FROM edge",
    "knn_graph_blocks": _EMB_EDGES,
    "knn_graph_undirected_whole": f"{_edges()} {_UNDIRECTED}",
    "knn_graph_stats_whole": f"{_edges()} {_STATS}",
    "graph_isolated_whole": f"{_edges()} SELECT row_id FROM pt WHERE row_id NOT IN (SELECT source FROM edge WHERE weight <= {_n(CLOSE)})",
    "graph_selfloops": f"SELECT row_id AS source, row_id AS target, 0e0 AS weight FROM {_hubs()}",
    "iou_curve": _iou(_KNN_PNP, _KNN_BF),
    "iou_curve_ploss": _iou(_KNN_PLOSS, _KNN_BF),
    "iou_self": _iou(_KNN_BF, _KNN_BF),
    "drum_coefs": f"SELECT row_id, {_FLOATS(('w', 'l2', 's4', 'c2', 'd1', 'd3'))} FROM ({_drum(_P)})",
    "drum_coefs_as_written": f"SELECT row_id, {_FLOATS(('w', 'l2', 's4', 'c2', 'd1', 'd3'))} FROM (SELECT row_id, {_coefs('w', '3.1e0', 'w', 'w', 'tau')} FROM (SELECT row_id, pow(10e0, 3.1e0) AS w, tau FROM {_P}))",
    "drum_modes_whole": _mode_sql(_P),
    "drum_mode_block": f"WITH {_modes(_P)}, {_BLOCK} SELECT * FROM block",
    "drum_waveform": f"""WITH {_modes(_P)}, {_BLOCK},
        y AS (SELECT row_id, t, sum(amp * exp(-decay * (t * {_STEP})) * sin(omega * (t * {_STEP}))) AS y FROM modes JOIN block USING (row_id), range({SMALL.dur}) AS ts(t) WHERE mu1 <= c1 AND mu2 <= block.c2 GROUP BY row_id, t)
        SELECT row_id, CAST(t AS INTEGER) AS t, round(y / max(abs(y)) OVER (PARTITION BY row_id), 6) + 0e0 AS y FROM y""",
    "physics_to_percept": f"""WITH co AS ({_drum(_P)}),
        s AS (SELECT *, d3 / 2 - d1 / 2 AS sigma, sqrt((s4 - d3 * d3 / 4) + (c2 + d1 * d3 / 2) - d1 * d1 / 4) AS w1 FROM co)
        SELECT row_id, CAST(w1 AS FLOAT) AS w, CAST(1 / sigma AS FLOAT) AS tau, CAST(d3 / sigma / 2 AS FLOAT) AS p, CAST(sqrt(s4 - pow(d3 / sigma / 2 * sigma, 2)) / w1 AS FLOAT) AS d FROM s""",
    "percept_to_physics": f"""WITH q AS (SELECT row_id, pow(10e0, {_n(M.OMEGA)}) AS w, tau, pow(10e0, p) AS p, pow(10e0, d) AS d, pow(2 / {_PI}, 2) AS k FROM {_P})
        SELECT row_id, CAST(-1 / tau + p / tau AS FLOAT) AS d1, CAST(p * k / tau AS FLOAT) AS d3, CAST(k * k * (pow(d * w, 2) + pow(p / tau, 2)) AS FLOAT) AS s4,
               CAST(k * (w * w * (1 - d * d) + (1 - p * p) / (tau * tau)) AS FLOAT) AS c2 FROM q""",
    "log1p_features_whole": f"SELECT row_id, CAST(generate_subscripts(s, 1) - 1 AS INTEGER) AS i, round(ln(1 + 1e3 * abs(CAST(unnest(s) AS DOUBLE))), 6) AS v FROM {_STORE}",
    "feature_strings": f"SELECT row_id AS id, {_TEXT} AS features FROM {_AB}",
    "graphml_lines": f"""WITH pt AS (SELECT * FROM {_AB}),
        pair AS (SELECT r.row_id AS source, c.row_id AS target, {_ploss('c', 'r', ('a', 'b'))} AS weight FROM pt r, pt c),
        near AS MATERIALIZED (SELECT * FROM pair QUALIFY row_number() OVER (PARTITION BY source ORDER BY weight, target) <= 3),
        edge AS (SELECT source, target, weight FROM near WHERE source <> target UNION ALL SELECT target, source, weight FROM near WHERE source <> target)
        SELECT 0 AS part, 0::BIGINT AS a, CAST(i AS BIGINT) AS b, line FROM (VALUES {', '.join(f"({i}, '{x}')" for i, x in enumerate(export.GRAPHML_HEAD))}) AS h(i, line)
        UNION ALL SELECT 1, row_id, 0, '    <node id="n' || row_id || '">' || chr(10) || '      <data key="v_feat">' || {_TEXT} || '</data>' || chr(10) || '    </node>' FROM pt
        UNION ALL SELECT 2, source, target, '    <edge source="n' || source || '" target="n' || target || '">' || chr(10) || '      <data key="e_weight">' || CAST(weight AS VARCHAR) || '</data>' || chr(10) || '    </edge>' FROM edge
        UNION ALL SELECT 3, 0, CAST(i AS BIGINT), line FROM (VALUES {', '.join(f"({i}, '{x}')" for i, x in enumerate(export.GRAPHML_FOOT))}) AS f(i, line)""",
    "layout_edges_whole": f"{_edges()} {_UNDIRECTED}",
}
