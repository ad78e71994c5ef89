"""Every operator as a named query over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetwright import schema
from fleetwright.operators import accounting, alerts, edits, jobs, lookups, plan, reservations, rules, sizing, weights
from fleetwright.plans import conf, documents, report, trace
from fleetwright.session import new_path, stored
from fleetwright.sources import fixtures, sinks, specs
from fleetwright.streaming import flows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

SPEC_OUT = [
    "cluster_id", "nodes", "cpn", "rpn", "os_r", "rm_r", "os_cr", "min_ec", "min_em", "mf", "sf",
    "num_jobs", "master_ram", "master_cores", "dyn_min", "dyn_init", "dyn_idle", "enf_c", "enf_m", "aqe", "dyn_alloc", "pyspark",
    "workload", "rm", "sv", "storage", "deploy_mode", "scheduler",
]
SIZED_OUT = [
    "cluster_id", "rm_r", "total_cores", "total_ram", "usable_cpn", "avail_ram", "exec_c", "exec_pn",
    "exec_m", "exec_oh", "drv_m", "drv_c", "exec_nodes", "total_exec", "total_ec", "para", "shuf_p",
    "dyn_max", "used_cores", "exec_ram_gb", "reserve_ram", "used_ram", "core_util", "mem_util",
    "unused_cores", "unused_ram", "usable_total_cores", "usable_total_ram", "drv_oh", "master_ram",
    "master_cores", "master_ram_used", "master_cores_used", "master_ram_util", "master_core_util",
    "master_ram_free", "master_cores_free",
]
ALLOC_OUT = [
    "cluster_id", "job_id", "job_idx", "job_name", "pct", "job_exec", "job_exec_c", "job_cores",
    "job_heap", "job_mem", "job_oh", "job_oh_gb", "job_jvm_gb", "job_para", "raw_exec",
]
FLOORS = jobs.JobOptions(enforce_executors=True, min_executors=3, enforce_tasks=True, min_tasks=20)
RATIO = jobs.JobOptions(cores_per_executor=3, gb_per_core=2.5, enforce_tasks=True, min_tasks=20)
VARIANTS = [
    {}, {"nodes": 20.0}, {"workload": "ml"}, {"deploy_mode": "cluster", "rpn": 128.0},
    {"rm": "local", "cpn": 9.0},
]


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def sized(spark, d):
    return sizing.size_fleet(fixtures.clusters(spark, d))


# Columns of stored job plans: what the job got, and the few figures of its pool that are shown beside it.
PLAN = [
    "cluster_id", "job_id", "job_idx", "job_name", "pct", "raw_exec", "job_exec", "job_exec_c", "job_heap", "job_cores",
    "job_mem", "job_oh", "job_jvm_gb", "job_oh_gb", "job_total_gb", "job_para", "rem_exec", "pool_cores", "pool_mem",
    "pyspark", "_ec", "_gb", "_enf_je", "_min_je",
]
# Cluster settings that a job's property file repeats.
INHERITED = ["drv_m", "drv_c", "drv_oh", "mf", "sf", "aqe"]


def pool(spark, d, res=None):
    # The narrow specs are shuffled for the join with the reservations before they are sized: a small file is one task.
    clusters = fixtures.clusters(spark, d).repartition("cluster_id")
    return reservations.remaining_pool(sizing.size_fleet(clusters), fixtures.reservations(spark, d) if res is None else res)


def stored_jobs(spark, d, *args):
    # The split reads the numbered jobs twice.
    return stored(fixtures.jobs(spark, d, *args), "jobs")


def allocs(spark, d, options=jobs.JobOptions(), carry=None):
    # The split reads the pool twice, and only the columns it needs and those carried along.
    return jobs.allocate(stored_jobs(spark, d), stored(pool(spark, d), "pool"), options=options, carry=carry)


def planned(spark, d, options=jobs.JobOptions(), res=None, listed=None):
    """Allocation and pool, each computed once and stored, for queries that read them several times."""
    whole = stored(pool(spark, d, res), "pool")
    made = jobs.allocate(listed or stored_jobs(spark, d), whole, options=options, carry=["pool_cores", "pool_mem"])
    return stored(made.select(*PLAN), "allocs"), whole


def reserved(spark, d):
    """The numbered reservations, stored for the pool and the profile.

    Numbering reads its rows twice, so these are stored as well and the lines are summed up once.
    """
    return stored(fixtures.number_reservations(stored(fixtures.reservations(spark, d), "orders")), "reservations")


def profile_of(res, clusters):
    return reservations.reservation_profile(res, clusters.select("cluster_id", "total_exec", "pyspark"))


def profile(spark, d):
    return profile_of(fixtures.numbered_reservations(spark, d), sized(spark, d))


# Sources and sinks

@query
def s1_read_specs(spark, d):
    return specs.read_specs(fixtures.raw_specs(spark, d)).select(*SPEC_OUT)


def _page_links(spark, d):
    pages = fixtures.table(spark, d, "pages").select(F.col("page_id").alias("cluster_id"), "url")
    base = F.coalesce(F.col("url"), F.lit("https://fleet.example/plan?old=1"))
    return fixtures.clusters(spark, d).join(pages, "cluster_id", "left").withColumn("base_url", base)


@query
def s2_decode_share_links(spark, d):
    pages = fixtures.table(spark, d, "pages").select("page_id", "url")
    links = fixtures.clusters(spark, d).withColumn("url", F.expr(fixtures.SHARE_LINK))
    base = {"nodes": 10.0, "cpn": 16.0, "rpn": 64.0, "deploy_mode": "client", "workload": "etl"}
    shared = links.select(F.col("cluster_id").alias("link_id"), F.lit("shared").alias("origin"), "url")
    visited = pages.select(F.col("page_id").alias("link_id"), F.lit("page").alias("origin"), "url")
    every = shared.unionByName(visited).withColumns({k: F.lit(v) for k, v in base.items()})
    return specs.decode_share_links(every)


@query
def s3_encode_share_links(spark, d):
    return specs.encode_share_links(_page_links(spark, d)).select("cluster_id", "share_url")


def _written(spark, texts):
    path = new_path(spark, "conf-texts")
    sinks.write_conf_texts(texts, path)
    return sinks.read_conf_texts(spark, path)


@query
def s4_write_conf_texts(spark, d):
    return _written(spark, conf.cluster_texts(sized(spark, d), fixtures.custom_props(spark, d)))


@query
def s4_look_up_texts(spark, d):
    """The texts of the ETL reservations, cut out of containers that hold those of all."""
    texts = conf.reservation_texts(profile(spark, d), fixtures.custom_props(spark, d))
    path = new_path(spark, "containers")
    sinks.write_containers(texts, path)
    names = sinks.read_index(spark, path).filter("file_name LIKE '%etl%'").select("file_name")
    unknown = names.sparkSession.sql("SELECT 'no such file' AS file_name")
    return sinks.look_up(spark, path, names.unionByName(unknown))


@query
def s4_write_job_texts(spark, d):
    return _written(spark, conf.job_texts(allocs(spark, d, carry=INHERITED), fixtures.custom_props(spark, d)))


@query
def s4_write_reservation_texts(spark, d):
    return _written(spark, conf.reservation_texts(profile(spark, d), fixtures.custom_props(spark, d)))


DOC_CONF = "sparkConf map<string, string>"
DOC_KINDS = {
    "job": "name string, allocationPct double, executors double, concurrentTasks double, coresPerExecutor double,"
           " heapPerExecutorGB double, totalHeapPlusOverheadGB double, memPerCoreGB double, " + DOC_CONF,
    "reservation": "name string, executors double, totalConcurrentTasks double, coresPerExecutor double,"
                   " memPerExecutorGB double, totalHeapGB double, sparkSubmit string, " + DOC_CONF,
    "property": "key string, val string", "input": "id bigint, manualPct double",
}
DOC_ROW = {
    "job": ("name", "executors", "allocationPct", "concurrentTasks", "coresPerExecutor", "heapPerExecutorGB",
            "totalHeapPlusOverheadGB", "memPerCoreGB", "NULL"),
    "reservation": ("name", "executors", "NULL", "totalConcurrentTasks", "coresPerExecutor", "memPerExecutorGB",
                    "totalHeapGB", "NULL", "sparkSubmit"),
    "property": ("key", "NULL", "NULL", "NULL", "NULL", "NULL", "NULL", "NULL", "val"),
    "input": ("CAST(id AS STRING)", "NULL", "manualPct", "NULL", "NULL", "NULL", "NULL", "NULL", "NULL"),
}
DOC_OUT = ("name", "executors", "share", "tasks", "cores", "heap", "total_gb", "per_core", "text")


def _documents(spark, d):
    res, listed = reserved(spark, d), stored_jobs(spark, d)
    allocated, whole = planned(spark, d, res=res, listed=listed)
    props = fixtures.custom_props(spark, d, dealt=True)
    return documents.plan_documents(whole, allocated, profile_of(res, whole), props, listed)


@query
def s5_plan_documents(spark, d):
    docs, parts = _documents(spark, d), []
    for kind, fields in DOC_KINDS.items():
        # Reading JSON has no generated code. The entry is named twice so that the planner keeps it a column, written by
        # generated code, and does not evaluate all its fields inside the reading.
        entry = F.when(F.col("entry").isNotNull(), F.from_json("entry", fields))
        read = docs.filter(F.col("kind") == kind).select("cluster_id", "kind", "idx", entry.alias("e")).select(
            "cluster_id", "kind", "idx", "e.*")
        own = [f"CAST({x} AS {'STRING' if out in ('name', 'text') else 'DOUBLE'}) AS {out}"
               for x, out in zip(DOC_ROW[kind], DOC_OUT, strict=True)]
        settings = [f"{'sparkConf' if 'sparkConf' in fields else 'CAST(NULL AS MAP<STRING, STRING>)'}['{key}'] AS {out}"
                    for key, out in (("spark.executor.memory", "memory"), ("spark.executor.memoryOverhead", "overhead"),
                                     ("spark.default.parallelism", "parallelism"))]
        parts.append(read.selectExpr("cluster_id", "kind", "idx", *own, *settings))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query
def s5_plan_configs(spark, d):
    whole = pool(spark, d)
    types = dict(whole.dtypes)
    fields = ", ".join(f"{c} {types[c]}" for c in documents.CONFIG)
    head = ("clusterMode string, totalCluster struct<totalCores: double, totalRAM: double>,"
            f" globalExecutorConfig struct<execMemGB: double, totalExecutors: double>, config struct<{fields}>")
    return documents.cluster_documents(whole).select("cluster_id", F.from_json("entry", head).alias("e")).selectExpr(
        "cluster_id", "e.clusterMode AS mode", "e.totalCluster.totalCores AS cores", "e.totalCluster.totalRAM AS ram",
        "e.globalExecutorConfig.execMemGB AS heap", "e.globalExecutorConfig.totalExecutors AS executors", "e.config.*")


@query
def s6_report_tables(spark, d):
    res = reserved(spark, d)
    allocated, whole = planned(spark, d, res=res)
    return report.report_tables(whole, allocated, profile_of(res, whole))


@query
def s6_report_reservations(spark, d):
    return report.report_reservations(profile(spark, d))


@query
def s6_report_jobs(spark, d):
    return report.report_jobs(allocs(spark, d, carry=[]))


# Lookups

@query
def p1_apply_templates(spark, d):
    return lookups.apply_templates(fixtures.clusters(spark, d)).select(
        "cluster_id", "template", "nodes", "cpn", "rpn")


@query
def p2_resolve_rm_reserve(spark, d):
    raw = specs.read_specs(fixtures.raw_specs(spark, d)).select("cluster_id", "rm_r")
    named = fixtures.clusters(spark, d).select("cluster_id", F.expr(fixtures.ANY_RM).alias("rm"))
    return lookups.resolve_rm_reserve(named.join(raw, "cluster_id")).select("cluster_id", "rm", "rm_r")


@query
def p3_label_dims(spark, d):
    specs_ = fixtures.clusters(spark, d).withColumns(
        {"sv": F.lit("3.5"), "workload": F.expr(fixtures.ANY_WORKLOAD)})
    return lookups.label_dims(specs_).select(
        "cluster_id", "workload_label", "mode_label", "rm_label", "scheduler_label", "version_label")


@query
def p4_merge_custom_props(spark, d):
    props = fixtures.custom_props(spark, d)
    both = [lookups.merge_custom_props(props, mode).withColumn("mode", F.lit(mode))
            for mode in ("cluster", "job")]
    return both[0].unionByName(both[1])


@query
def p5_apply_overrides(spark, d):
    return lookups.apply_overrides(fixtures.override_log(spark, d))


# Sizing

@query
def z1_size_fleet(spark, d):
    return sized(spark, d).select(*SIZED_OUT)


@query
def z1_size_fleet_overridden(spark, d):
    overrides = lookups.apply_overrides(fixtures.override_log(spark, d))
    return sizing.size_fleet(fixtures.clusters(spark, d), overrides).select(*SIZED_OUT)


@query
def z2_scaling_curve(spark, d):
    return sizing.scaling_curve(sized(spark, d))


@query
def z3_what_if(spark, d):
    return sizing.what_if(fixtures.clusters(spark, d), VARIANTS).select(
        "cluster_id", "variant", "nodes", "cpn", "rpn", "exec_c", "exec_pn", "exec_m", "exec_oh",
        "total_exec", "total_ec", "para", "core_util", "mem_util")


@query
def z3_what_if_grid(spark, d):
    """Every cluster under every candidate of a table, summed up for each candidate."""
    tried = sizing.what_if_grid(fixtures.clusters(spark, d), fixtures.candidate_grid(spark, d))
    return tried.groupBy("variant").agg(*[F.expr(e) for e in (
        "count(1) AS clusters", "sum(total_exec) AS total_exec", "sum(total_ec) AS total_ec", "sum(exec_m) AS heaps",
        "max(mem_util) AS most_mem", "min(core_util) AS least_core", "count_if(mem_util > 95) AS over_full")])


@query
def z4_driver_profile(spark, d):
    return sizing.driver_profile(sized(spark, d))


@query
def z5_dynamic_allocation_plan(spark, d):
    return sizing.dynamic_allocation_plan(sized(spark, d))


# Utilisation and accounting

@query
def u1_utilisation(spark, d):
    return accounting.utilisation(sized(spark, d))


@query
def u2_classify(spark, d):
    return accounting.classify_all(sized(spark, d))


@query
def u2_classify_by_policies(spark, d):
    """The reference's policies and one of many bands, all read from a table."""
    judged = accounting.classify_all(sized(spark, d)).drop("band")
    ladder = judged.filter("policy = 'standard'").withColumn("policy", F.lit("ladder"))
    policies = schema.policy_dim(spark).unionByName(fixtures.band_ladder(spark, d))
    return accounting.classify_by(judged.unionByName(ladder), policies)


@query
def u3_memory_ledger(spark, d):
    return accounting.memory_ledger(sized(spark, d))


@query
def u4_core_ledger(spark, d):
    return accounting.core_ledger(sized(spark, d))


@query
def u5_capacity_bars(spark, d):
    return accounting.capacity_bars(sized(spark, d))


@query
def u5_usage_summary(spark, d):
    return accounting.usage_summary(sized(spark, d))


@query
def u6_executor_memory_breakdown(spark, d):
    return accounting.executor_memory_breakdown(sized(spark, d))


@query
def u7_master_utilisation(spark, d):
    return accounting.master_utilisation(sized(spark, d))


@query
def u8_fleet_rollup(spark, d):
    return accounting.fleet_rollup(sized(spark, d))


# Rules and alerts

@query
def r1_evaluate_warnings(spark, d):
    return rules.evaluate_warnings(sized(spark, d)).drop("explanation")


@query
def r2_job_plan_status(spark, d):
    options = jobs.JobOptions(enforce_executors=True, min_executors=3)
    return plan.job_plan_status(plan.plan_totals(*planned(spark, d, options)), options)


@query
def r3_job_floor_alerts(spark, d):
    return plan.job_floor_alerts(allocs(spark, d, FLOORS, ["rem_cores"]), FLOORS)


@query
def r4_edge_alerts(spark, d):
    return alerts.edge_alerts(fixtures.usage_samples(spark, d), alerts.too_hot(40.0))


@query
def r5_change_alerts(spark, d):
    return alerts.change_alerts(fixtures.alert_keys(spark, d))


@query
def r5_change_alerts_muted(spark, d):
    # Events that serve as switches are not keys too.
    keys = fixtures.alert_keys(spark, d).join(fixtures.mute_log(spark, d).select("seq"), "seq", "left_anti")
    return alerts.change_alerts(keys, fixtures.mute_log(spark, d))


@query
def r6_muted_alerts(spark, d):
    # Events that serve as switches are not samples too.
    samples = fixtures.usage_samples(spark, d).filter("metric <> 'evictions'")
    return alerts.muted_alerts(samples, fixtures.mute_log(spark, d), alerts.too_hot(20.0))


@query
def r6_span_alerts(spark, d):
    samples = fixtures.usage_samples(spark, d).filter("metric <> 'evictions'")
    return alerts.span_alerts(samples, fixtures.mute_spans(spark, d), alerts.too_hot(20.0))


@query
def r7_tuning_hints(spark, d):
    return rules.tuning_hints(fixtures.task_metrics(spark, d))


# Aggregations

@query
def a1_reservation_totals(spark, d):
    return reservations.reservation_totals(fixtures.reservations(spark, d), sized(spark, d))


@query
def a2_reservation_profile(spark, d):
    return profile(spark, d).select(
        "cluster_id", "job_id", "res_idx", "res_name", "exec_count", "exec_cores", "exec_mem_gb",
        "res_cores", "res_mem", "res_pct", "res_para", "res_oh", "res_oh_gb")


@query
def a2_profile_of_edits(spark, d):
    """Reservations as a log of edits, folded and then profiled."""
    res = stored(edits.reservations_from(fixtures.reservation_edits(spark, d)), "reservations")
    return profile_of(res, sized(spark, d)).select(
        "cluster_id", "entry", "res_no", "res_idx", "res_name", "exec_count", "exec_cores", "exec_mem_gb", "res_cores",
        "res_mem", "res_pct", "res_oh")


@query
def a3_remaining_pool(spark, d):
    return pool(spark, d).select(
        "cluster_id", "pool_exec", "pool_cores", "pool_mem", "pool_oh", "pool_total", "res_n",
        "res_exec", "res_cores", "res_mem", "res_oh", "rem_exec", "rem_cores", "rem_mem")


@query
def a4_plan_totals(spark, d):
    return plan.plan_totals(*planned(spark, d))


@query
def a5_capacity_summary(spark, d):
    return plan.capacity_summary(plan.plan_totals(*planned(spark, d)))


# Apportionment

@query
def n1_materialise_jobs(spark, d):
    return jobs.materialise_jobs(fixtures.clusters(spark, d), fixtures.jobs(spark, d))


@query
def n2_balance_shares(spark, d):
    return jobs.balance_shares(fixtures.jobs(spark, d))


@query
def n2_shares_of_edits(spark, d):
    """Jobs as a log of edits, folded and then given their shares."""
    listed = stored(edits.jobs_from(fixtures.job_edits(spark, d)), "jobs")
    return jobs.balance_shares(listed.select("cluster_id", "job_id", "job_idx", "manual_pct"))


def _apportioned(spark, d, basis, options=jobs.JobOptions()):
    return jobs.apportion(stored_jobs(spark, d), stored(pool(spark, d), "pool"), basis, options, carry=[]).select(
        "cluster_id", "job_id", "job_idx", "pct", "base_exec", "extra", "assigned_exec")


@query
def n3_apportion_screen(spark, d):
    return _apportioned(spark, d, "screen")


@query
def n3_apportion_export(spark, d):
    return _apportioned(spark, d, "export")


@query
def n3_apportion_floor(spark, d):
    return _apportioned(spark, d, "export", FLOORS)


@query
def n3_apportion_weights(spark, d):
    whole = stored(pool(spark, d), "pool").select("cluster_id", "rem_exec")
    return weights.apportion_weights(fixtures.weighted_jobs(spark, d), whole).withColumnsRenamed(
        {"base": "base_exec", "assigned": "assigned_exec"})


@query
def n4_finalise_allocs(spark, d):
    return allocs(spark, d, carry=[]).select(*ALLOC_OUT)


@query
def n4_finalise_allocs_ratio(spark, d):
    return allocs(spark, d, RATIO, []).select(*ALLOC_OUT)


@query
def n5_suggest_floors(spark, d):
    return reservations.suggest_floors(pool(spark, d))


@query
def n5_floors_applied(spark, d):
    whole = stored(pool(spark, d), "pool")
    floors = reservations.suggest_floors(whole).selectExpr(
        "cluster_id", "min_executors AS min_je", "min_tasks AS min_jc", "true AS enf_je", "true AS enf_jc")
    return jobs.allocate(stored_jobs(spark, d), whole.join(floors, "cluster_id"), carry=[]).select(*ALLOC_OUT)


@query
def n_plan_end_to_end(spark, d):
    listed = jobs.materialise_jobs(fixtures.clusters(spark, d), fixtures.jobs(spark, d))
    listed = stored(listed.select("cluster_id", "job_id", "job_idx", "manual_pct"), "jobs")
    return jobs.allocate(listed, stored(pool(spark, d), "pool"), carry=[]).select(*ALLOC_OUT)


@query
def n6_default_reservation(spark, d):
    return reservations.default_reservation(sized(spark, d))


@query
def n7_allocation_diff(spark, d):
    return jobs.allocation_diff(
        stored_jobs(spark, d, fixtures.WIDE_MANUAL_PCT), stored(pool(spark, d), "pool"))


@query
def n8_job_share(spark, d):
    return jobs.job_share(allocs(spark, d, carry=["rem_cores", "rem_mem"]))


# Reshaping

@query
def x1_pool_segments(spark, d):
    return plan.pool_segments(*planned(spark, d))


@query
def x2_job_chart_series(spark, d):
    return plan.job_chart_series(*planned(spark, d))


@query
def x3_derivation_trace(spark, d):
    return trace.derivation_trace(sized(spark, d))


@query
def x4_job_trace(spark, d):
    res = reserved(spark, d)
    allocated, whole = planned(spark, d, res=res)
    return trace.job_trace(allocated, whole, profile_of(res, whole))


# Texts

@query
def t1_conf_properties(spark, d):
    return conf.conf_properties(sized(spark, d), fixtures.custom_props(spark, d))


@query
def t2_job_conf_properties(spark, d):
    return conf.job_conf_properties(allocs(spark, d, carry=INHERITED), fixtures.custom_props(spark, d))


@query
def t3_reservation_conf_properties(spark, d):
    return conf.reservation_conf_properties(profile(spark, d), fixtures.custom_props(spark, d))


@query
def t4_render_text(spark, d):
    return conf.cluster_texts(sized(spark, d), fixtures.custom_props(spark, d))


@query
def t4_render_job_text(spark, d):
    return conf.job_texts(allocs(spark, d, carry=INHERITED), fixtures.custom_props(spark, d))


@query
def t4_render_reservation_text(spark, d):
    return conf.reservation_texts(profile(spark, d), fixtures.custom_props(spark, d))


@query
def t5_submit_commands(spark, d):
    return conf.submit_commands(sized(spark, d))


@query
def t5_job_submit_commands(spark, d):
    return conf.job_submit_commands(allocs(spark, d, carry=[]))


@query
def t5_reservation_submit_commands(spark, d):
    return conf.reservation_submit_commands(profile(spark, d))


@query
def t6_scheduler_properties(spark, d):
    return conf.scheduler_properties(fixtures.clusters(spark, d))


# Streams and their batch forms

@query
def v1_debounce(spark, d):
    return flows.debounce_batch(fixtures.usage_samples(spark, d), "cluster_id",
                                ["metric", "value"], "sample_id", "6 hours")


@query
def v2_latest_spec(spark, d):
    return flows.latest_spec(fixtures.spec_changes(spark, d)).select(*SIZED_OUT)


@query
def v4_usage_windows(spark, d):
    return flows.usage_windows(fixtures.usage_samples(spark, d))


@query
def v1_debounce_stream(spark, d):
    stream = flows.debounce(fixtures.event_stream(spark, d, fixtures.USAGE_SAMPLES), "cluster_id",
                            ["metric", "value"], "sample_id", "6 hours")
    return flows.run_to_table(stream, new_path(spark, "bursts")).withColumns(
        {c: F.col(c).cast("timestamp_ntz") for c in ("first_ts", "last_ts")})


@query
def v2_latest_spec_stream(spark, d):
    stream = flows.latest_spec(fixtures.event_stream(spark, d, fixtures.SPEC_CHANGES)).select(*SIZED_OUT)
    return flows.run_updates(stream, ["cluster_id"], new_path(spark, "specs"))


def _in_steps(spark, d, name, build):
    """The events of five arrivals, out of order, through a stream that goes on where it stopped."""
    def streams(arrived):
        return build(lambda columns, where="true": fixtures._project(arrived().filter(where), columns))

    found = flows.run_in_steps(fixtures.arrivals(spark, d), streams, new_path(spark, name))
    return found.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query
def v3_edge_alerts_stream(spark, d):
    return _in_steps(spark, d, "edges", lambda read: flows.edge_alerts_stream(
        read(fixtures.USAGE_SAMPLES), alerts.too_hot(40.0)))


@query
def r5_change_alerts_stream(spark, d):
    return _in_steps(spark, d, "changes", lambda read: flows.change_alerts_stream(
        read(fixtures.ALERT_KEYS, "coalesce(event_type, '') <> 'error'"), read(fixtures.MUTE_LOG, "event_type = 'error'")))


@query
def r6_muted_alerts_stream(spark, d):
    return _in_steps(spark, d, "muted", lambda read: flows.muted_alerts_stream(
        read(fixtures.USAGE_SAMPLES, "event_type IN ('click', 'view', 'signup', 'purchase')"), read(fixtures.MUTE_LOG, "event_type = 'error'"),
        alerts.too_hot(20.0)))


@query
def v2_overridden_spec(spark, d):
    return flows.overridden_spec(fixtures.spec_changes(spark, d), fixtures.override_log(spark, d)).select(*SIZED_OUT)


@query
def v2_overridden_spec_stream(spark, d):
    stream = flows.overridden_spec(fixtures.event_stream(spark, d, fixtures.SPEC_CHANGES),
                                   fixtures.event_stream(spark, d, fixtures.OVERRIDE_LOG)).select(*SIZED_OUT)
    return flows.run_updates(stream, ["cluster_id"], new_path(spark, "overridden"))


@query
def v4_usage_windows_stream(spark, d):
    stream = flows.usage_windows(fixtures.event_stream(spark, d, fixtures.USAGE_SAMPLES), late="1 hour")
    return flows.run_to_table(stream, new_path(spark, "windows")).withColumns(
        {c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")})
