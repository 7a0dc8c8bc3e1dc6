"""The engine's chains over small grids and short sounds, and the graph's SQL against a window over all pairs."""

import pytest

from lodestone.functions import drum as M
from lodestone.functions.features import BandEnergies, JointScattering
from lodestone.functions.metric import Chain
from lodestone.operators import graph, hubs, layout, precompute
from lodestone.plans import queries as Q
from lodestone.schemas import AXES
from lodestone.sources import export, grid
from tests.oracle import assert_same

SHORT = M.Drum(dur=4096)
SCATTERING = Chain(JointScattering(j=8, q=8, t=1024), SHORT)
FEW = {"tau": (0.4, 1.7), "p": (-5.0, -2.85), "d": (-5.0, -2.75), "alpha": (0.25, 0.75)}


def layout_nodes(spark):
    p, e = Q._graph_of(grid.grid(spark, subdiv=4), grid.hub_ids(spark, 256, 16))
    return export.layout_nodes(layout.force_layout(graph.nodes(p, AXES), e, iterations=10), graph.nodes(p, AXES))


def few(spark):
    return grid.grid(spark, FEW, 2)


ROWS = {
    "layout_nodes": layout_nodes,
    "features": lambda s: precompute.features(grid.grid(s, subdiv=3), Chain(BandEnergies(), SHORT), AXES, partitions=8),
    "scattering": lambda s: precompute.features(few(s), SCATTERING, AXES, partitions=8),
    "metrics": lambda s: hubs.hub_metrics(few(s), grid.hub_ids(s, 16, 8), SCATTERING, AXES, partitions=8),
    "frames": lambda s: export.frames(precompute.waveforms(few(s), Chain(BandEnergies(), SHORT), AXES)),
}


def test_edges_by_full_sort(spark):
    """The SQL's top-k aggregate against a window over all pairs."""
    m = [f"((c.m[{i + 1}] + r.m[{i + 1}]) / 2e0)" for i in range(16)]
    sql = f"""WITH pt AS MATERIALIZED (SELECT * FROM {Q._P}), {Q._alloc(Q._hubs(), 'pt')},
        gp AS MATERIALIZED (SELECT pt.*, [{', '.join(Q._metric('hub'))}] AS m FROM pt JOIN alloc USING (row_id) JOIN hub ON hub.hub = alloc.hub),
        pair AS (SELECT r.row_id AS source, c.row_id AS target, {Q._pnp('c', 'r', m)} AS weight FROM gp r, gp c),
        near AS MATERIALIZED (SELECT * FROM pair QUALIFY row_number() OVER (PARTITION BY source ORDER BY weight, target) <= {Q.GRAPH_K + 1})
        SELECT source, target, weight FROM near WHERE source <> target UNION ALL SELECT target, source, weight FROM near WHERE source <> target"""
    assert_same(spark, Q.knn_graph_edges_whole, sql)


@pytest.mark.parametrize("name", sorted(ROWS))
def test_small_rows(spark, name):
    assert ROWS[name](spark).count() > 0
