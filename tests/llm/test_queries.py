import pytest
from oracle import connect, same
from pyspark.sql import functions as F

from lodestrata.llm import queries as Q


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(Q.ORACLE))
def test_query_equals_its_sql(spark, data, con, name):
    same(spark, data, con, Q.QUERIES[name], Q.ORACLE[name])


@pytest.mark.parametrize(("name", "columns"), [("p1_found", ["file_path"]), ("p3_found", ["file_path", "name"]), ("p6_found", ["session_id", "motion_i", "accel_i"]), ("p9_found", ["doc_id", "item_id"]), ("p10_found", ["doc_id", "kind", "start_pos"])])
def test_columns(spark, data, name, columns):
    d = Q.QUERIES[name](spark, data)
    assert d.columns == columns and d.count() == d.distinct().count() > 0


HOLDS = {
    "p1_files": "(valid is null) = (stage in ('none', 'depth')) and (stage <> 'lexical' or not valid)",
    "p1_rates": "n_files > 0 and n_invalid between 0 and n_files and abs(share - n_invalid / n_files) < 1e-12",
    "p3_pairs": "code <> '' and documentation <> '' and node_type in ('function', 'method') and instr(code, name) > 0",
    "p5_percentiles": "n > 0 and eps between 0 and 0.01 and value is not null and (p = 0.5 or ideal_p50 is null)",
    "p8_containers": "n_items > 0 and n_tokens between 1 and 2048",
    "p8_pack": "(container_id is null) = (n_tokens = 0) and (container_id is null or place >= 0 and place + n_tokens <= 2048)",
    "p9_leaks": "score >= 9.5 and first_word between 0 and last_word",
    "p10_redacted": "n_found >= 0 and (n_found = 0 or redacted rlike '\\\\[(EMAIL|PHONE|ID_NUMBER|ADDRESS|NAME)\\\\]')",
}


@pytest.mark.parametrize("name", sorted(HOLDS))
def test_rules(spark, data, name):
    d = Q.QUERIES[name](spark, data).cache()
    assert d.count() > 0
    bad = d.where(f"not coalesce({HOLDS[name]}, false)")
    assert bad.count() == 0, bad.limit(3).collect()
    d.unpersist()


def test_percentiles_rise(spark, data):
    q = Q.QUERIES["p5_percentiles"](spark, data).groupBy("scope", "name", "day", "subject").agg(F.array_sort(F.collect_list(F.struct("p", "value"))).alias("q"))
    assert q.where("not forall(sequence(1, size(q) - 1), k -> q[k - 1].value <= q[k].value)").count() == 0
