"""The engine's workflows from end to end; every stage's result is a Parquet table that the next one reads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from lodestone.operators import evaluate, graph, hubs, knn, layout, precompute
from lodestone.schemas import AXES
from lodestone.sources import export, grid, store

METHODS = ("Bruteforce", "PNP", "P-loss")


def precompute_store(spark: SparkSession, folder: str, chain, bounds: dict = grid.BOUNDS, subdiv: int = 10, most: int = 10_000, partitions: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Write the grid's CSV and the features of its first `most` rows, the latter range by range, so that a stopped run can
    go on; give both, read back."""
    axes = tuple(bounds)
    points = grid.grid(spark, bounds, subdiv)
    grid.write_csv(points, f"{folder}/points.csv")
    points = grid.read_csv(spark, f"{folder}/points.csv", axes)
    cores = partitions or 4 * spark.sparkContext.defaultParallelism
    return points, precompute.resumable(grid.first_rows(points, most), lambda p: precompute.features(p, chain, axes, cores), f"{folder}/features")


def compare_methods(points: DataFrame, features: DataFrame, chain, ref_id: int, k: int, axes: Sequence[str] = AXES) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """Neighbours of each method, and each one's overlap curve with Bruteforce."""
    found = {m: knn.knn(points, ref_id, k, m, axes, chain=chain, store=features) for m in METHODS}
    return found, {m: evaluate.iou_curve(f, found["Bruteforce"], axes, k) for m, f in found.items()}


def build_graph(points: DataFrame, folder: str, chain, n_hubs: int = 2000, k: int = 6, axes: Sequence[str] = AXES, partitions: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Hub metrics, allocation, nodes and edges as tables under folder, and the graph as GraphML; gives nodes and edges."""
    spark = points.sparkSession
    cores = partitions or 4 * spark.sparkContext.defaultParallelism
    store.write(hubs.hub_metrics(points, grid.hub_ids(spark, points.count(), n_hubs), chain, axes, cores), f"{folder}/hub_metric", "hub")
    table = store.read(spark, f"{folder}/hub_metric")
    store.write(hubs.allocation(points, table, axes), f"{folder}/allocation")
    placed = graph.graph_points(points, store.read(spark, f"{folder}/allocation"), table)
    store.write(graph.nodes(points, axes), f"{folder}/nodes", "id")
    store.write(graph.knn_edges(placed, k, axes), f"{folder}/edges", "source")
    nodes, edges = store.read(spark, f"{folder}/nodes"), store.read(spark, f"{folder}/edges")
    export.write_graphml_file(nodes, edges, f"{folder}/graph.graphml")
    return nodes, edges


def lay_out(spark: SparkSession, folder: str, iterations: int = 100, exact: bool = True) -> tuple[DataFrame, DataFrame]:
    """The saved graph's layout: CSV tables of nodes with positions and of undirected edges."""
    nodes, edges = store.read(spark, f"{folder}/nodes"), graph.undirected(store.read(spark, f"{folder}/edges"))
    placed = export.layout_nodes(layout.force_layout(nodes, edges, iterations, exact=exact), nodes)
    export.write_csv(placed, f"{folder}/layout_nodes")
    export.write_csv(export.layout_edges(edges), f"{folder}/layout_edges")
    return placed, edges
