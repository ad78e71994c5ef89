"""Expected values worked out by hand from the published formulas (FIXTURES.md)."""

import pytest

from conftest import rows
from fleetwright.functions.numbers import fixed_text, half_up, num_text, overhead_mb, parse_number
from fleetwright.operators import jobs
from fleetwright.operators.sizing import size_fleet

FIELDS = ("exec_c exec_pn exec_m exec_oh drv_m drv_c exec_nodes total_exec total_ec para core_util"
          " mem_util drv_oh master_ram_util").split()
SCENARIOS = {"etl": ("etl", "client", False), "ml": ("ml", "cluster", True),
             "streaming": ("streaming", "cluster", False)}
TEMPLATES = {"small": (4, 8, 32), "medium": (10, 16, 64), "large": (20, 32, 128),
             "xlarge": (50, 64, 256), "emr": (10, 16, 64), "databricks": (8, 16, 56), "hdp": (12, 24, 96)}
SIZED = """
small etl 3 2 12 1229 4 2 4 8 24 48 75 92 410 28
small ml 7 1 25 3584 8 4 3 3 21 63 78 83 819 0
small streaming 2 3 8 820 8 4 3 9 18 36 69 78 819 0
medium etl 5 3 17 1741 13 2 10 30 150 300 94 92 1331 89
medium ml 8 1 53 6452 8 4 9 9 72 216 48 89 819 0
medium streaming 2 7 7 717 7 4 9 63 126 252 81 82 717 0
large etl 4 7 15 1536 16 2 20 140 560 1120 88 93 1638 110
large ml 8 3 36 4711 8 4 19 57 456 1368 72 93 819 0
large streaming 2 15 7 717 7 4 19 285 570 1140 90 88 717 0
xlarge etl 4 15 14 1434 16 2 50 750 3000 6000 94 91 1638 110
xlarge ml 8 7 31 4199 8 4 49 343 2744 8232 86 95 819 0
xlarge streaming 2 31 7 717 7 4 49 1519 3038 6076 95 93 717 0
emr etl 5 3 17 1741 13 2 10 30 150 300 94 92 1331 89
emr ml 8 1 53 6452 8 4 9 9 72 216 48 89 819 0
emr streaming 2 7 7 717 7 4 9 63 126 252 81 82 717 0
databricks etl 5 3 15 1536 9 2 8 24 120 240 94 94 922 62
databricks ml 8 1 46 5735 8 4 7 7 56 168 47 88 819 0
databricks streaming 2 7 6 615 6 4 7 49 98 196 80 79 614 0
hdp etl 4 5 16 1639 16 2 12 60 240 480 83 95 1638 110
hdp ml 8 2 40 5120 8 4 11 22 176 528 63 90 819 0
hdp streaming 2 11 7 717 7 4 11 121 242 484 85 85 717 0
"""
# nodes cpn rpn workload mode rm enforced | expected
EDGES = """
1 1 1 streaming cluster yarn 0 2 1 1 384 4 4 1 1 2 4 600 938 410 0
4 8 32 etl client yarn 1 4 1 25 2560 4 2 4 4 16 32 50 95 410 28
10 16 64 etl client local 0 5 3 18 1844 13 2 10 30 150 300 94 96 1331 89
10 16 64 etl client k8s 0 5 3 17 1741 13 2 10 30 150 300 94 94 1331 89
10 9 64 etl client yarn 0 4 2 26 2663 13 2 10 20 80 160 89 94 1331 89
"""


def _cases():
    cases = []
    for line in SIZED.split("\n"):
        if line:
            name, scenario, *expected = line.split()
            workload, mode, py = SCENARIOS[scenario]
            cases.append(((*TEMPLATES[name], workload, mode, "yarn", py, False), expected))
    for line in EDGES.split("\n"):
        if line:
            nodes, cpn, rpn, workload, mode, rm, enforced, *expected = line.split()
            spec = (int(nodes), int(cpn), int(rpn), workload, mode, rm, False, enforced == "1")
            cases.append((spec, expected))
    return cases


def test_sizing(spark):
    cases = _cases()
    specs = spark.createDataFrame(
        [(i, *map(float, s[:3]), *s[3:7], s[7], s[7]) for i, (s, _) in enumerate(cases)],
        "cluster_id bigint, nodes double, cpn double, rpn double, workload string, deploy_mode string,"
        " rm string, pyspark boolean, enf_c boolean, enf_m boolean")
    got = {r["cluster_id"]: [r[f] for f in FIELDS] for r in size_fleet(specs).collect()}
    assert len(cases) == 26
    for i, (spec, expected) in enumerate(cases):
        assert got[i] == [float(x) for x in expected], spec


@pytest.mark.parametrize(("expr", "expected"), [
    (half_up("-2.5D"), -2.0), (half_up("2.5D"), 3.0), (half_up("0.49999999999999994D"), 0.0),
    (half_up("-0.4D"), 0.0),
    (fixed_text("1.45D", 1), "1.4"), (fixed_text("0.25D", 1), "0.3"), (fixed_text("12D", 2), "12.00"),
    (fixed_text("1.005D", 2), "1.00"), (fixed_text("1234.5D", 1), "1234.5"),
    (num_text("0.6D"), "0.6"), (num_text("12D"), "12"), (num_text("1e9D"), "1000000000"),
    (overhead_mb("8D", "ceil"), 820.0), (overhead_mb("8D"), 819.0), (overhead_mb("18D"), 1843.0),
    (overhead_mb("18D", "ceil"), 1844.0), (overhead_mb("4D"), 410.0), (overhead_mb("23D"), 2355.0),
    (parse_number("' 12.5GB'"), 12.5), (parse_number("'.5x'"), 0.5), (parse_number("'1e2'"), 100.0),
    (parse_number("'-3'"), -3.0), (parse_number("'GB 4'"), 0.0), (parse_number("''"), 0.0),
    (parse_number("CAST(NULL AS STRING)"), 0.0), (parse_number("'7.'"), 7.0),
])
def test_number_rules(spark, expr, expected):
    assert spark.range(1).selectExpr(f"{expr} AS x").first()["x"] == expected


# remaining, manual shares (None = automatic), screen result, export result, unassigned
SPLITS = [
    (30, [None] * 2, [15, 15], None, 0),
    (30, [None] * 3, [10, 10, 10], None, 0),
    (30, [None] * 4, [8, 8, 7, 7], None, 0),
    (30, [None] * 7, [5, 5, 4, 4, 4, 4, 4], None, 0),
    (30, [None] * 8, [4, 4, 4, 4, 4, 4, 3, 3], None, 0),
    (5, [None] * 8, [1] * 8, None, 0),
    (200, [None] * 8, [26] * 8, None, 0),
    (100, [10, 10], [11, 11], None, 78),
    (100, [21, 21, 58], [22, 21, 57], [21, 21, 58], 0),
]


def test_splits(spark):
    pool = spark.createDataFrame([(i, float(case[0])) for i, case in enumerate(SPLITS)],
                                 "cluster_id bigint, rem_exec double")
    table = spark.createDataFrame(
        [(i, i * 100 + j, j, pct) for i, case in enumerate(SPLITS) for j, pct in enumerate(case[1])],
        "cluster_id bigint, job_id bigint, job_idx bigint, manual_pct int")
    for basis in ("screen", "export"):
        got = rows(jobs.apportion(table, pool, basis), "cluster_id", "job_idx", "assigned_exec")
        for i, (remaining, _, screen, export, unassigned) in enumerate(SPLITS):
            expected = export if basis == "export" and export else screen
            mine = [int(e) for c, _, e in sorted(got) if c == i]
            assert mine == expected, (basis, i)
            assert max(0, remaining - sum(mine)) == unassigned
