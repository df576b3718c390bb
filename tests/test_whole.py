"""Queries over all relations: on tables whose relations the sparse sample leaves out, and that each such query is there."""

import pytest

from strandline.plans import registry

SPARSE = """betweenness_sampled closed_ancestry connected_components cycle_list delta_candidates delta_counts delta_cycles delta_instability
delta_package_dependencies delta_renames delta_violations finding_targets hop2_cost isolated_node layer_violations owner_propagation package_cycle
package_metrics package_pairs pagerank_k reach_status regression_gate scc scc_cut_candidates scc_metrics scc_parent unprovided_injection
unreferenced_symbol unstable_dependency unstable_packages visibility_closure""".split()


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Parts 1, 2, 3 in a ring of orders of small quantities, and part 4 without any."""
    out = str(tmp_path_factory.mktemp("tables"))
    parts = [(i, f"n{i}", "Brand#1" + str(i), "T", 1, 10.0 * i) for i in (1, 2, 3, 4)] + [(5, "n5", "Brand#15", "A", 1, 1.0)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(f"{out}/part.parquet")
    items = [(o, k, n, 5.0) for o, ks in ((1, (1, 2)), (2, (2, 3)), (3, (3, 1))) for n, k in enumerate(ks, 1)]
    schema = "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double, l_suppkey long, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"
    spark.createDataFrame([(*x, 1, 1.0, 0.0, 0.0, "N", "O", None) for x in items], schema).write.parquet(f"{out}/lineitem.parquet")
    return out


def rows(spark, tables, name):
    return {tuple(r) for r in registry.QUERIES[name](spark, tables).collect()}


def test_every_query_on_the_sparse_sample_has_one_on_all_relations():
    assert {f"{n}_whole" for n in SPARSE} <= set(registry.QUERIES)


def test_small_quantities_count(spark, tables):
    assert {r[0] for r in rows(spark, tables, "isolated_node")} == {1, 2, 3, 4}
    assert {r[0] for r in rows(spark, tables, "isolated_node_whole")} == {4}
    assert rows(spark, tables, "unreferenced_symbol_whole") == {("Brand#14", 1)}
    assert rows(spark, tables, "scc_whole") == {(1, 1), (2, 1), (3, 1)}
    assert rows(spark, tables, "connected_components_whole") == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 5)}
    assert rows(spark, tables, "hop2_cost_whole") == {(1, 50.0), (2, 40.0), (3, 30.0), (4, 0.0), (5, 0.0)}


def test_visits_do_not_stop_after_three_steps(spark, tmp_path):
    parts = [(i, f"n{i}", "Brand#11", "T", 1, 1.0) for i in range(10, 17)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    schema = "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double, l_suppkey long, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"
    spark.createDataFrame([(1, i, i, 50.0, 1, 1.0, 0.0, 0.0, "N", "O", None) for i in range(10, 17)], schema).write.parquet(f"{tmp_path}/lineitem.parquet")
    assert rows(spark, tmp_path, "prefix_propagation_whole") == {(i, i - 10) for i in range(10, 17)}


def test_metrics_without_sql(spark, tables):
    ranks = dict(rows(spark, tables, "pagerank_k_whole"))
    assert ranks[1] == ranks[2] == ranks[3] > ranks[4] == ranks[5] and abs(sum(ranks.values()) - 1) < 1e-6
    between = dict(rows(spark, tables, "betweenness_sampled_whole"))
    assert between[1] == between[2] == between[3] > 0 == between[4]
