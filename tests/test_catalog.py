import pytest
from oracle import connect, same

from lodestrata.plans import catalog


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_equals_its_sql(spark, data, con, name):
    same(spark, data, con, catalog.QUERIES[name], catalog.ORACLE[name])


#: What holds for every row of a query without SQL.
HOLDS = {
    "batch_transition_cue": "rush between 0.72 and 1 and confidence between 0.15 and 0.86",
    "bench_degradation": "n = 20 and mean_deg between 0.1 and 30",
    "bench_events": "n = 32 and mean >= 0 and p95 <= max and (metric <> 'impact_ms' or mean <= 15)",
    "bench_gates": "mean > max_value",
    "bench_orientation": "n = 32 and mean between 0 and 90 and p95 <= max and (algorithm <> 'gated' or metric <> 'mean_deg' or mean <= 6)",
    "bench_trajectory": "n = 32 and mean > 0 and (algorithm <> 'hybrid' or mean <= 17)",
    "edge_student": "n > 0 and size(coefficients) = 64 and not exists(coefficients, x -> isnan(x))",
    "filt_gyro_integrate": "filter = 'gyro' and n > 0 and turn_deg between 0 and 180",
    "filt_suite": "n > 0 and turn_deg between 0 and 180 and (tilt_deg is null or isnan(tilt_deg) or tilt_deg between 0 and 180)",
    "fit_plane_moments": "n >= 3 and normal[2] >= 0 and abs(normal[0] * normal[0] + normal[1] * normal[1] + normal[2] * normal[2] - 1) < 1e-9 and flatness between -1e-9 and 0.34",
    "latent_leave_group_out": "n > 0 and mean_abs_error >= 0 and ok_share between 0 and 1",
    "latent_prediction": "places = 32 and residual >= 0 and validity in ('ok', 'degraded', 'abstain')",
    "p4_found": "stream in ('accel', 'motion') and session_id is not null and i is not null",
    "p4_reasons": "size(reasons) > 0",
    "p7_grid": "state in ('observed', 'interpolated', 'missing') and (n > 0) = (state = 'observed') and (state <> 'missing' or x is null) and (x is null or abs(x) < double('infinity'))",
    "seg_phases": "(n < 20) = (impact is null) and (impact is null or address < top and top < impact and impact < finish and finish < n)",
    "source_exports": "file_path is not null and name <> '' and line > 0",
    "source_graph_edges": "src is not null and dst is not null and rel in ('contains', 'imports', 'calls', 'instantiates', 'extends', 'implements')",
    "source_import_resolution": "(resolved is null) = (how = 'external')",
    "source_imports": "file_path is not null and line > 0",
    "source_relations": "target <> '' and rel in ('calls', 'instantiates', 'extends', 'implements', 'decorates')",
    "source_symbols": "start_line > 0 and end_line >= start_line and node_type in ('class', 'function', 'method')",
    "stream_orientation": "n > 0 and last_qw between -1.000001 and 1.000001",
    "stream_transition_cue": "rush between 0.72 and 1 and confidence between 0.15 and 0.86",
    "traj_hybrid": "n < 20 or how in ('lever', 'assumed', 'mixture') and radius >= 0 and rank between 0 and 3 and (slip is null or slip between 0 and 1)",
    "traj_lever_arm": "n < 5 or size(arm) = 3 and rank between 0 and 3 and rms >= 0",
    "traj_segment_channels": "n > 0 and twist_range >= 0 and swing_range between 0 and 180.001 and twist_rate >= 0",
    "vec_manifold_score": "score >= 0 and residual >= 0 and confidence between 0.05 and 0.95",
}
MAY_BE_EMPTY = {"bench_gates", "batch_transition_cue", "stream_transition_cue"}


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_query_without_sql_keeps_its_rules(spark, data, name):
    df = catalog.QUERIES[name](spark, data).cache()
    assert df.count() > 0 or name in MAY_BE_EMPTY
    bad = df.where(f"not coalesce({HOLDS[name]}, false)")
    assert bad.count() == 0, bad.limit(3).collect()
    df.unpersist()


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
