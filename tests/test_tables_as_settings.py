"""Candidate grids and band policies given as tables."""

import random
import re

import pytest

from conftest import rows
from fleetwright import schema
from fleetwright.functions.bands import POLICIES, band
from fleetwright.operators import accounting, sizing
from fleetwright.sources import fixtures
from test_plans import plan


@pytest.mark.parametrize("block", [sizing.GRID_BLOCK, 7])
def test_grid_equals_the_literal_list(spark, sf_dir, block):
    clusters = fixtures.clusters(spark, sf_dir)
    variants = [{}, {"nodes": 20.0}, {"workload": "ml", "rpn": 48.0}, {"deploy_mode": "cluster", "rpn": 128.0}]
    grid = spark.createDataFrame([(i, v.get("nodes"), v.get("rpn"), v.get("workload"), v.get("deploy_mode")) for i, v in enumerate(variants)],
                                 "variant long, nodes double, rpn double, workload string, deploy_mode string")
    columns = ("cluster_id", "variant", "nodes", "rpn", "exec_c", "exec_m", "total_exec", "mem_util")
    assert rows(sizing.what_if_grid(clusters, grid, block), *columns) == rows(sizing.what_if(clusters, variants), *columns)


def test_a_large_grid_is_a_product_of_blocks(spark, sf_dir):
    clusters = fixtures.clusters(spark, sf_dir)
    grid = spark.range(1000).selectExpr("id AS variant", "CAST(1 + id % 40 AS DOUBLE) AS nodes")
    tried = sizing.what_if_grid(clusters, grid, 100)
    text = plan(tried)
    assert "CartesianProduct" not in text and "NestedLoop" not in text
    pairs = tried.selectExpr("count(1)", "count(DISTINCT cluster_id, variant)").first()
    assert tuple(pairs) == (150_000, 150_000)


def test_repeated_candidates_are_not_broadcast(spark, sf_dir):
    """The planner takes repeated rows for a small table; blocks meet in as many tasks as there are blocks."""
    grid = spark.range(1000).selectExpr("id AS variant", "CAST(1 + id % 40 AS DOUBLE) AS nodes")
    text = plan(sizing.what_if_grid(fixtures.clusters(spark, sf_dir), grid, 100))
    assert re.search(r"SortMergeJoin \[_high#\d+, _wide#\d+\]", text)
    assert len(re.findall(r"hashpartitioning\(_high#\d+, _wide#\d+, 20\)", text)) >= 2


@pytest.mark.parametrize("variants", [
    [{}, {"rm": "k8s"}, {"rm": "local", "cpn": 9.0}, {"rm": ""}], [{"rm_r": 7.5}, {"deploy_mode": "cluster", "rm_r": 0.0}],
    [{"master_ram": 3.0, "enf_m": True, "min_em": 50.0}, {"set_exec_c": 3.0}], [{"set_exec_m": 0.0}, {}], [{}]])
def test_whatever_candidates_change(spark, sf_dir, variants):
    """What does not depend on the changed columns is computed before the product, with the same figures."""
    clusters = fixtures.clusters(spark, sf_dir).selectExpr(
        "*", "IF(cluster_id % 3 = 0, 2D, NULL) AS set_exec_c", "IF(cluster_id % 5 = 0, 11D, NULL) AS set_exec_m", "5D AS total_exec",
        "IF(cluster_id % 4 = 0, 3D, 0D) AS rm_r")
    fields = sorted({f for v in variants for f in v})
    kinds = {"rm": "string", "deploy_mode": "string", "enf_m": "boolean"}
    grid = spark.createDataFrame([(i, *[v.get(f) for f in fields]) for i, v in enumerate(variants)],
                                 ", ".join(["variant long", *[f"{f} {kinds.get(f, 'double')}" for f in fields]]))
    got, want = sizing.what_if_grid(clusters, grid, 40), sizing.what_if(clusters, variants)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want.select(*got.columns))


def test_pairs_compare_no_texts(spark, sf_dir):
    """Texts that candidates set are compared once for each cluster and kind of candidates, before the product."""
    grid = spark.range(300).selectExpr("id AS variant", "CAST(1 + id % 40 AS DOUBLE) AS nodes", "IF(id % 3 = 0, 'ml', NULL) AS workload",
                                       "IF(id % 2 = 0, 'cluster', NULL) AS deploy_mode")
    after = plan(sizing.what_if_grid(fixtures.clusters(spark, sf_dir), grid, 100).groupBy("variant").agg({"mem_util": "max"}))
    after = after[:after.index("SortMergeJoin")]
    assert "Project" in after and not re.search(r"= (cluster|client|ml|streaming)\b|workload|deploy_mode", after)


@pytest.mark.parametrize("most_kinds", [sizing.GRID_KINDS, 4])
def test_kinds_of_candidates(spark, sf_dir, most_kinds):
    """Texts with any signs, flags and nulls; the same rows when there are too many kinds to tell them apart."""
    clusters = fixtures.clusters(spark, sf_dir).limit(20)
    texts = [None, "ml", "it's \\ odd", "", "streaming"]
    variants = [(i, texts[i % 5], [None, "client", "cluster"][i % 3], [None, True, False][i % 4 % 3], [None, 7.0][i % 2], ["local", None][i % 2])
                for i in range(24)] + [(3, "ml", None, None, 2.0, None), (None, None, None, None, 3.0, "k8s")]
    grid = spark.createDataFrame(variants, "variant long, workload string, deploy_mode string, enf_c boolean, nodes double, rm string")
    columns = ("cluster_id", "workload", "deploy_mode", "rm", "rm_r", "nodes", "exec_c", "exec_m", "drv_m", "core_util", "mem_util", "master_ram")
    assert 4 < grid.select("workload", "deploy_mode", "enf_c", "rm").distinct().count() <= sizing.GRID_KINDS
    got = sizing.what_if_grid(clusters, grid, 15, most_kinds)
    want = sizing.what_if(clusters, [dict(zip(grid.columns[1:], v[1:])) for v in variants])
    assert rows(got, *columns) == rows(want, *columns)
    ids = [v[0] for v in variants for _ in range(20)]
    assert sorted(repr(r["variant"]) for r in got.select("variant").collect()) == sorted(map(repr, ids))


def test_empty_grid_and_fleet(spark, sf_dir):
    clusters = fixtures.clusters(spark, sf_dir)
    grid = spark.createDataFrame([], "variant long, nodes double")
    assert sizing.what_if_grid(clusters, grid).collect() == []
    assert sizing.what_if_grid(clusters.limit(0), spark.range(3).selectExpr("id AS variant", "5D AS nodes")).collect() == []


@pytest.mark.parametrize("policy", sorted(POLICIES))
def test_policy_rows_say_what_the_formulas_say(spark, policy):
    values = [(policy, float(v) + d) for v in (*range(0, 101, 5), 40, 50, 70, 90, 95, -7, 1e9) for d in (-1e-9, 0.0, 1e-9)]
    frame = spark.createDataFrame([*values, (policy, None), (policy, float("nan"))], "policy string, percent double")
    got = accounting.classify_by(frame, schema.policy_dim(spark)).filter("percent IS NOT NULL")
    want = frame.filter("percent IS NOT NULL").selectExpr("policy", "percent", f"{band(policy, 'percent')} AS band")
    assert got.count() == len(values) + 1 and repr(rows(got, "percent", "band")) == repr(rows(want, "percent", "band"))


@pytest.mark.parametrize("cells", [accounting.CELLS, 3])
def test_any_number_of_bands(spark, cells):
    """Uneven bounds, some of them twice, values on the bounds, an unknown policy, and values below all bands."""
    rng = random.Random(4)
    policies, values = [], []
    for p in ("a", "b", "c"):
        lows = sorted({rng.choice([rng.random() * 10 ** rng.randrange(-3, 6), float(rng.randrange(50))]) for _ in range(300)})
        lows = [None, *lows] if p != "c" else lows
        policies += [(p, low, rng.random() < 0.5, f"{p}{i}") for i, low in enumerate(lows)]
        values += [(p, v) for low in lows if low is not None for v in (low, low * (1 + 1e-15), low * (1 - 1e-15))]
    values += [("a", -5.0), ("c", -5.0), ("d", 1.0), ("a", None), ("b", 1e300)]
    frame = spark.createDataFrame([(i, *v) for i, v in enumerate(values)], "id long, policy string, percent double")
    got = accounting.classify_by(frame, spark.createDataFrame(policies, "policy string, low double, above boolean, band string"), cells=cells)

    def plain(policy, value):
        held = [b for p, low, above, b in policies if p == policy and value is not None
                and (low is None or value > low or (value == low and not above))]
        return held[-1] if held else None

    assert got.columns == ["id", "policy", "percent", "band"]
    assert {r["id"]: r["band"] for r in got.collect()} == {i: plain(*v) for i, v in enumerate(values)}
    text = plan(got)
    assert "NestedLoop" not in text and "CartesianProduct" not in text
