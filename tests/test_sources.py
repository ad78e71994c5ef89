"""Reading specs and links, writing texts and documents."""

import json

import pytest

from conftest import rows
from fleetwright import registry
from fleetwright.operators.lookups import apply_overrides
from fleetwright.operators.reservations import reservation_profile
from fleetwright.operators import sizing
from fleetwright.operators.sizing import size_fleet
from fleetwright.plans import conf, documents
from fleetwright.schema import INPUTS, read_input, read_input_stream
from fleetwright.session import shared_dir
from fleetwright.sources import fixtures, sinks, specs
from test_plans import plan


def test_specs_from_csv(spark, sf_dir, tmp_path):
    raw = fixtures.raw_specs(spark, sf_dir)
    ordered = raw.select(*[f.name for f in specs.RAW_SCHEMA])
    ordered.write.option("header", True).csv(str(tmp_path / "specs"))
    loaded = specs.read_specs(specs.load_specs(spark, str(tmp_path / "specs")))
    names = [f.name for f in specs.RAW_SCHEMA]
    # A csv field drops leading blanks, which the number reader ignores as well.
    assert rows(loaded, *names) == rows(specs.read_specs(raw), *names)


def test_link_round_trip(spark, sf_dir):
    clusters = fixtures.clusters(spark, sf_dir).selectExpr("*", "'http://x/y?n=1#top' AS base_url")
    links = specs.encode_share_links(clusters).selectExpr("cluster_id", "share_url AS url", "1D AS nodes",
                                                          "1D AS cpn", "1D AS rpn", "'?' AS deploy_mode", "'?' AS workload")
    fields = ("cluster_id", "nodes", "cpn", "rpn", "deploy_mode", "workload")
    assert rows(specs.decode_share_links(links), *fields) == rows(clusters, *fields)


def test_text_layouts(spark, sf_dir, tmp_path):
    texts = conf.job_texts(registry.allocs(spark, sf_dir)).filter("cluster_id < 4")
    sinks.write_conf_texts(texts, str(tmp_path / "lines"))
    assert rows(sinks.read_conf_texts(spark, str(tmp_path / "lines"))) == rows(texts, "file_name", "line", "pos")
    sinks.write_conf_texts(texts, str(tmp_path / "files"), layout="files")
    name = texts.first()["file_name"]
    lines = [r["line"] for r in texts.filter(texts["file_name"] == name).orderBy("pos").collect()]
    folder = tmp_path / "files" / f"file_name={name}"
    assert "".join(p.read_text() for p in folder.glob("*.txt")) == "\n".join(lines) + "\n"


def test_documents_sink(spark, sf_dir, tmp_path):
    docs = documents.plan_documents(
        registry.pool(spark, sf_dir), registry.allocs(spark, sf_dir), registry.profile(spark, sf_dir),
        fixtures.custom_props(spark, sf_dir), generated_at="2024-01-01T00:00:00Z")
    sinks.write_documents(docs, str(tmp_path / "docs"))
    found = [json.loads(line) for p in (tmp_path / "docs").glob("*.json") for line in p.read_text().splitlines()]
    heads = [json.loads(r["entry"]) for r in found if r["kind"] == "cluster"]
    assert len(heads) == 150 and all(h["generatedAt"] == "2024-01-01T00:00:00Z" for h in heads)
    assert set(documents.CONFIG) <= set(heads[0]["config"])
    assert heads[0]["config"]["nodes"] == heads[0]["totalCluster"]["nodes"]
    for r in found:
        if r["kind"] == "job":
            entry = json.loads(r["entry"])
            assert entry["name"] == f"Job {r['idx'] + 1}" and entry["sparkConf"]["spark.executor.memory"].endswith("g")


def test_long_keys_stay_whole(spark, sf_dir):
    texts = conf.cluster_texts(size_fleet(fixtures.clusters(spark, sf_dir)), fixtures.custom_props(spark, sf_dir))
    lines = [r["line"] for r in texts.filter("cluster_id = 1").collect()]
    assert "spark.hadoop.fleet.connector.very.long.property.name.limit64" in lines
    padded = next(x for x in lines if x.startswith("spark.executor.cores"))
    assert padded[:45].rstrip() == "spark.executor.cores" and padded[45] != " "


def test_odd_links_keep_their_parameters(spark):
    urls = ["http://x/?n=12&w=ml&q=a b", "http://x/?q={y}&n=12&w=ml", "x?w=ml&n=12", "http://x/?nn=3&n=12&w=ml#n=9", "http://x/#n=9"]
    df = spark.createDataFrame([(i, u, 1.0, 1.0, 1.0, "client", "etl") for i, u in enumerate(urls)],
                               "id long, url string, nodes double, cpn double, rpn double, deploy_mode string, workload string")
    got = [(r["nodes"], r["workload"]) for r in specs.decode_share_links(df).orderBy("id").collect()]
    assert got == [(12.0, "ml")] * 4 + [(1.0, "etl")]


def test_reservation_names(spark, sf_dir):
    sized = size_fleet(spark.createDataFrame([(1,)], "cluster_id bigint"))
    res = spark.createDataFrame([(1, 0, None, "Nightly  ETL", 2.0, 2.0, 4.0), (1, 1, 7, None, 1.0, 2.0, 4.0), (1, 3, None, " ", 1.0, 2.0, 4.0)],
                                "cluster_id long, res_idx long, res_no long, name string, exec_count double, exec_cores double, exec_mem_gb double")
    profile = reservation_profile(res, sized)
    assert [r["res_name"] for r in profile.orderBy("res_idx").collect()] == ["Nightly  ETL", "Reserved Job 7", "Reserved Job 4"]
    files = {r["file_name"] for r in conf.reservation_texts(profile).collect()}
    assert "cluster-1-nightly-etl-prealloc.conf" in files and "cluster-1-reserved-job-7-prealloc.conf" in files


def test_dynamic_inputs_reach_the_config(spark):
    clusters = spark.createDataFrame([(1, True, 7.0, 9.0, 30.0), (2, True, 0.0, None, None)],
                                     "cluster_id long, dyn_alloc boolean, dyn_min double, dyn_init double, dyn_idle double")
    keys = "key IN ('spark.dynamicAllocation.minExecutors', 'spark.dynamicAllocation.initialExecutors', 'spark.dynamicAllocation.executorIdleTimeout')"
    got = conf.conf_properties(size_fleet(clusters)).filter(keys).orderBy("cluster_id", "pos").collect()
    assert [r["value"] for r in got] == ["7", "9", "30s", "1", "4", "60s"]


def test_override_cascade(spark):
    log = spark.createDataFrame(
        [(1, 1, "execC", False, 2.0), (1, 2, "execM", False, 6.0), (1, 3, "execM", True, None),
         (1, 4, "para", False, 77.0), (1, 5, "drvC", False, None), (2, 6, "execPN", False, 0.0)],
        "cluster_id bigint, seq bigint, field string, is_reset boolean, value double").selectExpr(
        "*", "CAST(timestamp_seconds(seq) AS TIMESTAMP_NTZ) AS ts")
    clusters = spark.createDataFrame([(1,), (2,)], "cluster_id bigint")
    one, two = size_fleet(clusters, apply_overrides(log)).orderBy("cluster_id").collect()
    assert (one["exec_c"], one["exec_pn"], one["exec_m"], one["para"], one["shuf_p"], one["drv_c"]) == (
        2, 7, 7, 77, 77, 0)
    # A hand-set zero is kept, and nothing divides by it.
    assert two["exec_pn"] == 0 and two["total_exec"] == 0


@pytest.mark.parametrize(("name", "fmt"), [("clusters", "json"), ("jobs", "parquet"), ("usage_samples", "parquet"),
                                           ("custom_props", "csv")])
def test_inputs_under_explicit_schemas(spark, sf_dir, tmp_path, name, fmt):
    table = getattr(fixtures, name)(spark, sf_dir)
    table.write.format(fmt).save(str(tmp_path / name))
    loaded = read_input(spark, name, str(tmp_path / name), fmt)
    assert loaded.columns == [f.name for f in INPUTS[name]]
    assert loaded.count() == table.count()
    assert read_input_stream(spark, name, str(tmp_path / name), fmt).isStreaming
    # Text formats do not tell an empty text from a missing one.
    kept = [c for c in table.columns if c in loaded.columns and (fmt == "parquet" or c in ("cluster_id", "pos"))]
    assert rows(loaded, *kept) == rows(table, *kept)


def test_shared_dir_follows_the_session(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert shared_dir(spark) == (named or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/checkpoints")
    assert spark.sparkContext.getCheckpointDir() is not None


def test_containers_hold_every_text_once(spark, sf_dir, tmp_path):
    """Many small containers; every file is found at its place, byte by byte."""
    texts = conf.reservation_texts(registry.profile(spark, sf_dir), fixtures.custom_props(spark, sf_dir))
    texts = texts.unionByName(spark.createDataFrame([("ünï ço de", 0, "é🙂"), ("ünï ço de", 1, ""), ("ünï ço de", 2, "z")],
                                                    "file_name string, pos int, line string"), allowMissingColumns=True)
    path = str(tmp_path / "containers")
    sinks.write_containers(texts, path, container_bytes=100_000)
    want = {}
    for r in texts.select("file_name", "pos", "line").collect():
        want.setdefault(r["file_name"], []).append((r["pos"], r["line"]))
    want = {name: "".join(line + "\n" for _, line in sorted(held)) for name, held in want.items()}
    index = sinks.read_index(spark, path)
    assert index.count() == len(want) and index.select("container").distinct().count() > 5
    assert len(list((tmp_path / "containers" / "texts").glob("*/*.txt"))) <= index.select("container").distinct().count()
    got = sinks.look_up(spark, path, index.select("file_name")).collect()
    assert {r["file_name"]: r["text"] for r in got} == want and len(got) == len(want)
    assert all(r["length"] == len(r["text"].encode()) for r in got)
    assert sinks.look_up(spark, path, index.select("file_name").limit(0)).collect() == []


def test_a_container_moves_once_for_all_its_files(spark, tmp_path):
    """Thousands of files of one container: no row of theirs holds the container's bytes."""
    texts = spark.range(20_000).selectExpr("concat('file ', id, ' é') AS file_name", "explode(sequence(0, 2)) AS pos", "id").selectExpr(
        "file_name", "pos", "concat('é', pos, repeat('x', CAST(id % 50 AS INT)), id) AS line")
    path = str(tmp_path / "c")
    sinks.write_containers(texts, path)
    found = sinks.look_up(spark, path, sinks.read_index(spark, path).select("file_name").filter("file_name <> 'file 7 é'"))
    assert "FlatMapCoGroupsInArrow" in plan(found) and "substring(content" not in plan(found)
    want = {f"file {i} é": "".join(f"é{p}{'x' * (i % 50)}{i}\n" for p in range(3)) for i in range(20_000) if i != 7}
    assert sinks.read_index(spark, path).select("container").distinct().count() == 1
    assert {r["file_name"]: r["text"] for r in found.collect()} == want


def test_lines_are_stored_compressed(spark, sf_dir, tmp_path):
    texts = conf.cluster_texts(size_fleet(fixtures.clusters(spark, sf_dir)), fixtures.custom_props(spark, sf_dir))
    sinks.write_conf_texts(texts, str(tmp_path / "lines"))
    size = sum(p.stat().st_size for p in (tmp_path / "lines").glob("part-*"))
    assert 0 < size * 5 < texts.selectExpr("sum(octet_length(line) + octet_length(file_name))").first()[0]
    assert rows(sinks.read_conf_texts(spark, str(tmp_path / "lines"))) == rows(texts, "file_name", "line", "pos")


def test_a_failed_write_has_no_index(spark, tmp_path):
    texts = spark.createDataFrame([("a", 0, "x")], "file_name string, pos int, line string")
    sinks.write_containers(texts, str(tmp_path / "c"))
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        sinks.write_containers(texts.selectExpr("'b' AS file_name", "pos", "line"), str(tmp_path / "c"))
    assert [r["file_name"] for r in sinks.read_index(spark, str(tmp_path / "c")).collect()] == ["a"]


def test_equal_names_get_files_of_their_own(spark):
    named = [(1, 0, "Nightly ETL"), (1, 1, "nightly  etl"), (1, 2, "nightly-etl 2"), (1, 3, "Nightly\tetl"), (2, 0, "nightly etl"),
             (1, 1 << 40, "nightly etl")]
    profile = spark.createDataFrame(named, "cluster_id long, res_idx long, res_name string")
    got = {(r["cluster_id"], r["res_idx"]): r["file_slug"] for r in conf.distinct_names(profile).collect()}
    assert got == {(1, 0): "nightly-etl", (1, 1): "nightly-etl 2", (1, 2): "nightly-etl-2", (1, 3): "nightly-etl 3",
                   (2, 0): "nightly-etl", (1, 1 << 40): "nightly-etl 4"}


def test_very_large_numbers_make_rows_not_arrays(spark):
    """Nodes and jobs mistyped by some zeros: points and queues open in blocks, and the rest of the fleet is not lost."""
    sized = spark.createDataFrame([(1, "client", 2.0, 4.0, 3e9), (2, "client", 2.0, 4.0, 3.0)],
                                  "cluster_id long, deploy_mode string, exec_pn double, exec_c double, nodes double")
    curve = sizing.scaling_curve(sized)
    assert curve.filter("cluster_id = 2").count() == 3
    assert curve.limit(100_000).count() == 100_000
    plans = spark.createDataFrame([(1, "capacity", 5e8), (2, "capacity", 2.0)], "cluster_id long, scheduler string, num_jobs double")
    rows_ = conf.scheduler_properties(plans)
    assert [(r["part"], r["value"]) for r in rows_.filter("cluster_id = 2 AND part IS NOT NULL").orderBy("part").collect()] == [
        (0, "default"), (1, "q1"), (2, "q2")]
    assert rows_.filter("part IS NOT NULL").limit(200_000).count() == 200_000
