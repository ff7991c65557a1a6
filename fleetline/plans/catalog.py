"""Named plans over the given tables: one per operator of the inventory.

Each entry takes ``(spark, sf_dir)`` and returns a lazy DataFrame whose
columns carry the same names as the DuckDB twin in ``oracle``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetline import schemas
from fleetline.functions.exprs import canonical_json, hmac_sha256_hex, page_columns
from fleetline.operators import alerts, ingest, logs, metrics, queue, reads, snapshots, state
from fleetline.session import ensure_semantics
from fleetline.sources import fixtures as fx
from fleetline.sources.tables import register_views

Plan = Callable[[SparkSession, str], DataFrame]
PLANS: dict[str, Plan] = {}


def plan(name: str):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ensure_semantics(spark)
            return fn(spark, sf_dir)
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        PLANS[name] = run
        return run
    return deco


# ---------------------------------------------------------------- shared
def heartbeats(spark, sf_dir, collisions=False) -> DataFrame:
    return ingest.classify_heartbeat(fx.heartbeat_arrivals(spark, sf_dir, collisions))


def status_table(spark, sf_dir) -> DataFrame:
    return state.latest_state(heartbeats(spark, sf_dir))


def history_table(spark, sf_dir, collisions=False) -> DataFrame:
    return state.history(heartbeats(spark, sf_dir, collisions))


# ---------------------------------------------------------------- H / R
@plan("h1_latest_state")
def h1_latest_state(spark, sf_dir):
    """events -> heartbeat bodies -> decode/validate -> latest state per device."""
    return status_table(spark, sf_dir)


@plan("r1_page")
def r1_page(spark, sf_dir):
    """Third page (offset 100, 50 rows) of the latest-state list."""
    return reads.page(status_table(spark, sf_dir), offset=100, limit=50)


def webhooks(spark, sf_dir) -> DataFrame:
    return ingest.classify_webhook(fx.webhook_arrivals(spark, sf_dir), fx.FIXTURE_SECRET)


def queue_arrivals(spark, sf_dir) -> DataFrame:
    return queue.arrivals_from(webhooks(spark, sf_dir))


def queue_logs(spark, sf_dir):
    arr = queue_arrivals(spark, sf_dir)
    return arr, fx.writer_activity(queue.keyed_arrivals(arr))


def queue_table(spark, sf_dir) -> DataFrame:
    arr, tr = queue_logs(spark, sf_dir)
    return queue.fold(arr, tr)


AS_OF = fx.AS_OF


# ---------------------------------------------------------------- V / M
@plan("v1_hmac")
def v1_hmac(spark, sf_dir):
    """HMAC-SHA256 hex of every webhook body under the fixture secret."""
    w = fx.webhook_arrivals(spark, sf_dir)
    return w.select("seq", hmac_sha256_hex("body", fx.FIXTURE_SECRET).alias("hmac"))


@plan("v2_signed_bodies")
def v2_signed_bodies(spark, sf_dir):
    """Heartbeats as a device signs them: keys in order, no blanks, absent
    fields left out; the signature is the HMAC of that text."""
    body = canonical_json("sn", "wan_ip", "sw_version", "cpu_pct", "mem_pct")
    h = fx.heartbeat_fields(spark, sf_dir).select("seq", body.alias("body"))
    return h.select("seq", "body", hmac_sha256_hex("body", fx.FIXTURE_SECRET).alias("signature"))


@plan("v12_violations")
def v12_violations(spark, sf_dir):
    """Rows of the queue and state tables that break a column rule: none."""
    q = schemas.broken(queue_table(spark, sf_dir), schemas.QUEUE_SCHEMA, schemas.QUEUE_DOMAINS)
    s = schemas.broken(status_table(spark, sf_dir), schemas.STATUS_SCHEMA)
    h = schemas.broken(history_table(spark, sf_dir), schemas.HISTORY_SCHEMA)
    hb = heartbeats(spark, sf_dir).where("bound").select(F.lit("heartbeat").alias("table"), F.explode("violations").alias("rule"))
    found = q.select(F.lit("queue").alias("table"), F.explode("broken").alias("rule")).unionByName(
        s.select(F.lit("status").alias("table"), F.explode("broken").alias("rule"))).unionByName(
        h.select(F.lit("history").alias("table"), F.explode("broken").alias("rule"))).unionByName(hb)
    return metrics.counter(found, ["table", "rule"], "rows")


@plan("v8_webhook_outcomes")
def v8_webhook_outcomes(spark, sf_dir):
    """Signature, strict JSON, sn, event time, constraints -> code/reason."""
    return webhooks(spark, sf_dir).select("seq", "code", "reason", "sn", "event_ts")


@plan("v9_heartbeat_outcomes")
def v9_heartbeat_outcomes(spark, sf_dir):
    """Heartbeat decode/validate outcome with the decoded, stored fields."""
    return heartbeats(spark, sf_dir).select(
        "seq", "code", "reason", "sn", "last_seen", "wan_ip", "sw_version", "cpu_pct", "mem_pct")


@plan("m1_webhook_requests")
def m1_webhook_requests(spark, sf_dir):
    return metrics.counter(webhooks(spark, sf_dir).where(F.col("code") != 413), ["code"], "requests")


@plan("m2_webhook_errors")
def m2_webhook_errors(spark, sf_dir):
    w = webhooks(spark, sf_dir).where(F.col("reason").isNotNull() & (F.col("code") != 413))
    return metrics.counter(w, ["reason"], "errors")


@plan("m3_api_requests")
def m3_api_requests(spark, sf_dir):
    """API requests by code: heartbeats (after history conflicts), device
    lookups (200 found / 404 not found), lists and health probes (200)."""
    o = state.heartbeat_outcomes(heartbeats(spark, sf_dir, collisions=True))
    o = o.where(F.col("code") != 413).select("code")
    look = reads.lookup(status_table(spark, sf_dir), lookup_requests(spark, sf_dir))
    g = look.select(F.when(F.col("found"), F.lit(200)).otherwise(F.lit(404)).alias("code"))
    rest = fx.list_requests(spark, sf_dir).select(F.lit(200).alias("code")).unionByName(
        fx.health_probes(spark, sf_dir).select(F.lit(200).alias("code")))
    return metrics.counter(o.unionByName(g).unionByName(rest), ["code"], "requests")


@plan("m4_heartbeats_per_device")
def m4_heartbeats_per_device(spark, sf_dir):
    """Counted after decoding, before the table write; byte-exact sn."""
    h = heartbeats(spark, sf_dir).where(F.col("code").isin(202, 500))
    return metrics.counter(h, ["sn"], "heartbeats")


@plan("m5_m6_gauges")
def m5_m6_gauges(spark, sf_dir):
    """Last non-null cpu/mem percentage per byte-exact sn."""
    h = heartbeats(spark, sf_dir).where(F.col("code").isin(202, 500))
    return metrics.gauge_last(h, "sn", ["cpu_pct", "mem_pct"])


# ---------------------------------------------------------------- H
@plan("h2_history")
def h2_history(spark, sf_dir):
    return history_table(spark, sf_dir)


@plan("h2_history_collisions")
def h2_history_collisions(spark, sf_dir):
    """Arrival times coarsened to the hour: first arrival per key kept."""
    return history_table(spark, sf_dir, collisions=True)


@plan("h3_outcomes_collisions")
def h3_outcomes_collisions(spark, sf_dir):
    """Status written for every valid arrival, history conflicts end as 500."""
    hb = heartbeats(spark, sf_dir, collisions=True)
    return state.heartbeat_outcomes(hb).select("seq", "code", "reason")


@plan("h3_latest_state_collisions")
def h3_latest_state_collisions(spark, sf_dir):
    """Status rows also come from arrivals whose history insert failed."""
    return state.latest_state(heartbeats(spark, sf_dir, collisions=True))


@plan("h4_merge_state")
def h4_merge_state(spark, sf_dir):
    """State after the first half of January, merged with the rest."""
    hb = heartbeats(spark, sf_dir)
    cut = F.lit("2024-01-16 00:00:00").cast("timestamp_ntz")
    prev = state.latest_state(hb.where(F.col("received_at") < cut), keep_order_columns=True)
    return state.merge_state(prev, hb.where(F.col("received_at") >= cut),
                             keep_order_columns=False)


# ---------------------------------------------------------------- R
def lookup_requests(spark, sf_dir) -> DataFrame:
    """Serial numbers asked for by 'view' events: twice the user id, lower
    case, so about half of them exist."""
    e = fx.base_events(spark, sf_dir).where(F.col("event_type") == "view")
    sn = F.lower(F.concat(F.lit("CPE-"), F.lpad((F.col("user_id") * 2).cast("string"), 5, "0")))
    return e.select(sn.alias("request_sn")).distinct()


@plan("q13_paging")
def q13_paging(spark, sf_dir):
    """Offset and limit of every list request, clamped."""
    offset, limit = page_columns("offset", "limit")
    return fx.list_requests(spark, sf_dir).select("seq", offset.alias("page_offset"), limit.alias("page_limit"))


@plan("r8_ad_hoc_sql")
def r8_ad_hoc_sql(spark, sf_dir):
    """SQL over the registered views: events per nation of the users' customers."""
    register_views(spark, sf_dir, ("events", "customer", "nation"))
    return spark.sql("""
        SELECT n_name, event_type, count(*) AS events, count(DISTINCT user_id) AS users
        FROM events JOIN customer ON c_custkey = user_id JOIN nation ON n_nationkey = c_nationkey
        GROUP BY n_name, event_type""")


@plan("r2_lookup")
def r2_lookup(spark, sf_dir):
    return reads.lookup(status_table(spark, sf_dir), lookup_requests(spark, sf_dir))


@plan("r3_current_view")
def r3_current_view(spark, sf_dir):
    return reads.current_view(status_table(spark, sf_dir))


@plan("r4_latest_history_one")
def r4_latest_history_one(spark, sf_dir):
    """Admin search ' cpe-00007 ' (trimmed, collated): 20 newest rows."""
    return reads.latest_n_for(history_table(spark, sf_dir), " cpe-00007 ", 20)


@plan("r6_device_report")
def r6_device_report(spark, sf_dir):
    return reads.device_report(status_table(spark, sf_dir), history_table(spark, sf_dir), 20,
                               DASHBOARD_TEMPLATE, LOGS_TEMPLATE)


DASHBOARD_TEMPLATE = "https://dashboards.example/d/device?var-sn=%s"
LOGS_TEMPLATE = "https://logs.example/app/discover?q=sn%%3D%s"


# ---------------------------------------------------------------- Q
@plan("q1_enqueue")
def q1_enqueue(spark, sf_dir):
    """Accepted webhooks folded into the queue, no writer activity yet."""
    return queue.enqueue(queue_arrivals(spark, sf_dir))


@plan("q_fold")
def q_fold(spark, sf_dir):
    """Queue = fold(arrivals, writer transitions)."""
    return queue_table(spark, sf_dir)


@plan("q2_ready")
def q2_ready(spark, sf_dir):
    return queue.ready(queue_table(spark, sf_dir), AS_OF, 50)


@plan("q3_claim")
def q3_claim(spark, sf_dir):
    """Claims for the 500 first ready ids (twice) and for every done id:
    only queued ids are claimed, each once."""
    q = queue_table(spark, sf_dir)
    r = queue.ready(q, AS_OF, 500).select("id")
    claims = r.unionByName(r).unionByName(q.where(F.col("status") == "done").select("id"))
    return queue.claim(q, claims, AS_OF)


@plan("q4_complete")
def q4_complete(spark, sf_dir):
    """Every event left in processing is completed."""
    return queue.complete(queue_table(spark, sf_dir).where(F.col("status") == "processing"), AS_OF)


@plan("q5_fail_writer")
def q5_fail_writer(spark, sf_dir):
    """Every event left in processing fails once more (writer policy)."""
    q = queue_table(spark, sf_dir)
    f = q.where(F.col("status") == "processing").select("id", F.lit("timeout").alias("reason"))
    return queue.fail(q, f, AS_OF, policy="writer")


@plan("q7_fail_queue")
def q7_fail_queue(spark, sf_dir):
    """Same failures under the queue-package policy (base 5 s, max 5)."""
    q = queue_table(spark, sf_dir)
    f = q.where(F.col("status") == "processing").select("id", F.lit("timeout").alias("reason"))
    return queue.fail(q, f, AS_OF, policy="queue", base=5)


@plan("q8_drain")
def q8_drain(spark, sf_dir):
    return queue.drain(queue_table(spark, sf_dir), AS_OF, 50)


@plan("q9_depth")
def q9_depth(spark, sf_dir):
    return queue.depth(queue_table(spark, sf_dir), AS_OF)


@plan("q10_lag")
def q10_lag(spark, sf_dir):
    return queue.lag(queue_table(spark, sf_dir), AS_OF)


@plan("q11_backlog")
def q11_backlog(spark, sf_dir):
    arr, tr = queue_logs(spark, sf_dir)
    return queue.backlog(arr, tr, "1 day")


@plan("q12_purge")
def q12_purge(spark, sf_dir):
    return queue.purge(queue_table(spark, sf_dir), AS_OF, 14).select("id", "status", "updated_at", "action")


@plan("m8_m10_writer_counters")
def m8_m10_writer_counters(spark, sf_dir):
    _, tr = queue_logs(spark, sf_dir)
    return queue.writer_counters(tr)


# ---------------------------------------------------------------- W
# Window tests: 6 h range, 1 h step (events are minutes apart).
WIN, STEP = "6 hours", "1 hour"


@plan("w1_rate_by_code_samples")
def w1_rate_by_code_samples(spark, sf_dir):
    """sum(rate(requests_total[6h])) by (code) from scraped counter samples
    (resets at midnight)."""
    s = fx.counter_samples(spark, sf_dir)
    return metrics.rate_from_samples(s, ["metric", "code", "instance"], ["code"], window=WIN, step=STEP, end=AS_OF)


@plan("w1_rate_by_code_events")
def w1_rate_by_code_events(spark, sf_dir):
    """Same rate taken directly from the classified webhook log."""
    w = webhooks(spark, sf_dir).where(F.col("code") != 413)
    w = w.select("received_at", F.col("code").cast("string").alias("code"))
    return metrics.rate_from_events(w, "received_at", ["code"], WIN, STEP, end=AS_OF)


@plan("w2_rate_by_reason")
def w2_rate_by_reason(spark, sf_dir):
    w = webhooks(spark, sf_dir).where(F.col("reason").isNotNull() & (F.col("code") != 413))
    return metrics.rate_from_events(w, "received_at", ["reason"], WIN, STEP, end=AS_OF)


@plan("w3_api_rate_by_code")
def w3_api_rate_by_code(spark, sf_dir):
    o = state.heartbeat_outcomes(heartbeats(spark, sf_dir, collisions=True))
    o = o.where(F.col("code") != 413).select(
        F.col("seq"), F.col("received_at"), F.col("code").cast("string").alias("code"))
    return metrics.rate_from_events(o, "received_at", ["code"], WIN, STEP, end=AS_OF)


@plan("w4_writer_increase")
def w4_writer_increase(spark, sf_dir):
    """sum(increase(processed/failed/dead[6h])) from the writer log."""
    _, tr = queue_logs(spark, sf_dir)
    kind = (F.when(F.col("status") == "done", F.lit("processed"))
            .when(F.col("status") == "dead", F.lit("dead")))
    ev = tr.select("at", kind.alias("metric")).where(F.col("metric").isNotNull())
    failed = tr.where(F.col("reason").isNotNull()).select("at", F.lit("failed").alias("metric"))
    return metrics.increase_from_events(ev.unionByName(failed), "at", ["metric"], WIN, STEP, end=AS_OF)


@plan("w8_last_day_rate")
def w8_last_day_rate(spark, sf_dir):
    """Dashboard time range: evaluations in [as_of - 1 day, as_of], each with
    its full window.  What they can see is cut from the arrivals, before
    decoding, so it reaches the Parquet scan as a pushed filter."""
    arr, start, end = metrics.time_range(fx.webhook_arrivals(spark, sf_dir), "received_at", fx.AS_OF, "1 day", WIN)
    w = ingest.classify_webhook(arr, fx.FIXTURE_SECRET).where(F.col("code") != 413)
    w = w.select("received_at", F.col("code").cast("string").alias("code"))
    return metrics.rate_from_events(w, "received_at", ["code"], WIN, STEP, start=start, end=end)


@plan("w5_service_up")
def w5_service_up(spark, sf_dir):
    """sum by (service) (up{namespace="fleet", service=~"..."}), 1 h lookback."""
    s = metrics.matching(fx.labelled(fx.up_samples(spark, sf_dir)), [
        ("__name__", "=", "up"), ("namespace", "=", fx.NAMESPACE), ("service", "=~", "acs-ingest|queue-writer|status-api"), ("job", "!~", ".+")])
    return metrics.latest_in_lookback(metrics.label_columns(s, ["service"]), ["series"], ["service"], lookback="1 hour", step=STEP,
                                      name="up", end=AS_OF)


@plan("w6_error_pct")
def w6_error_pct(spark, sf_dir):
    """5xx share of API requests, percent, per 6 h window."""
    o = state.heartbeat_outcomes(heartbeats(spark, sf_dir, collisions=True)).where(F.col("code") != 413)
    return metrics.ratio_pct(o, "received_at", F.col("code").cast("string").rlike("^(?:5..)$"), WIN, STEP, end=AS_OF)


# ---------------------------------------------------------------- A
# Rules are evaluated every 5 minutes on the latest sample of the last hour.
RULE_STEP, RULE_LOOKBACK, RULE_SECONDS = "5 minutes", "1 hour", 300.0


def _evaluated(samples, series, value="value"):
    return metrics.latest_in_lookback(samples, series, series, value=value, lookback=RULE_LOOKBACK, step=RULE_STEP,
                                      name=value, end=AS_OF)


def replicas_evaluated(spark, sf_dir) -> DataFrame:
    s = metrics.matching(fx.labelled(fx.replica_samples(spark, sf_dir)), [
        ("namespace", "=", fx.NAMESPACE), ("deployment", "=~", "acs-ingest|queue-writer")])
    return _evaluated(metrics.label_columns(s, ["namespace", "deployment"]), ["namespace", "deployment"])


@plan("a1_service_down")
def a1_service_down(spark, sf_dir):
    """available replicas < 1 for 1 m, two named deployments."""
    return alerts.for_duration(replicas_evaluated(spark, sf_dir), ["namespace", "deployment"], F.col("value") < 1, 60, ts="t",
                               step_seconds=RULE_SECONDS)


@plan("a2_high_error_rate")
def a2_high_error_rate(spark, sf_dir):
    """5xx percentage > 5 for 10 m, evaluated on the hourly grid."""
    pct = PLANS["w6_error_pct"](spark, sf_dir).withColumn("rule", F.lit("HighErrorRate"))
    return alerts.for_duration(pct, ["rule"], F.col("pct") > 5, 600, ts="t", step_seconds=3600)


@plan("a3_database_down")
def a3_database_down(spark, sf_dir):
    s = fx.replica_samples(spark, sf_dir).where(
        (F.col("namespace") == fx.NAMESPACE) & (F.col("deployment") == "database"))
    g = _evaluated(s, ["namespace", "deployment"])
    return alerts.for_duration(g, ["namespace", "deployment"], F.col("value") < 1, 120, ts="t", step_seconds=RULE_SECONDS)


@plan("a4_backlog_high")
def a4_backlog_high(spark, sf_dir):
    """More than 40 open queue events for 3 hours (hourly backlog grid)."""
    arr, tr = queue_logs(spark, sf_dir)
    b = queue.backlog(arr, tr, "1 hour").withColumn("rule", F.lit("QueueBacklog"))
    return alerts.for_duration(b, ["rule"], F.col("open_events") > 40, 3 * 3600, ts="bucket_end", step_seconds=3600)


@plan("a5_connections_high")
def a5_connections_high(spark, sf_dir):
    """Connections used / limit > 80 % for 5 minutes (gauges joined on time)."""
    used, limit = fx.connection_samples(spark, sf_dir)
    j = alerts.join_gauges(_evaluated(used, ["instance"], "used"), _evaluated(limit, ["instance"], "limit"), ["instance"], ts="t")
    return alerts.for_duration(j, ["instance"], F.col("used") / F.col("limit") > 0.8, 300, ts="t", step_seconds=RULE_SECONDS)


@plan("a6_rendered_annotations")
def a6_rendered_annotations(spark, sf_dir):
    a = PLANS["a1_service_down"](spark, sf_dir)
    return a.select("namespace", "deployment", "pending_at", alerts.render(
        a, "No replica of {{ $labels.deployment }} in {{ $labels.namespace }} was ready over a whole minute", "description"))


# ---------------------------------------------------------------- L
def log_table(spark, sf_dir) -> DataFrame:
    return logs.enrich(logs.decode(fx.container_logs(spark, sf_dir)), fx.pods(spark, sf_dir))


@plan("l0_service_log_lines")
def l0_service_log_lines(spark, sf_dir):
    """Log lines the services write: one per accepted heartbeat, one per
    event the writer claimed (from the writer's transitions log)."""
    hb = logs.heartbeat_lines(state.heartbeat_outcomes(heartbeats(spark, sf_dir)))
    _, tr = queue_logs(spark, sf_dir)
    return hb.unionByName(logs.process_lines(tr, queue_table(spark, sf_dir)))


@plan("l1_l2_decoded_enriched")
def l1_l2_decoded_enriched(spark, sf_dir):
    return log_table(spark, sf_dir).select(
        "path", "ts", "message", "level", "decoded", "namespace", "pod", "container", "app", "node")


@plan("l4_search_prefix")
def l4_search_prefix(spark, sf_dir):
    """namespace = fleet AND pod.name : "acs-ingest-*" AND message : "enqueued*", size 5."""
    return logs.search(log_table(spark, sf_dir), {"namespace": fx.NAMESPACE},
                       {"pod": "acs-ingest-"}, {"message": "enqueued"}, 5).select(
        "ts", "pod", "message")


@plan("l5_search_sn")
def l5_search_sn(spark, sf_dir):
    """Phrase sn=CPE-00001 (whole token) in the last 3 days before as-of."""
    return logs.search_sn(log_table(spark, sf_dir), "CPE-00001", fx.AS_OF, 3 * 24 * 60).select(
        "ts", "pod", "message")


@plan("l6_extract")
def l6_extract(spark, sf_dir):
    return logs.extract(logs.decode(fx.container_logs(spark, sf_dir))).select(
        "path", "ts", "kind", "sn", "wan_ip", "sw_version", "cpu", "mem", "event_id", "event_time")


@plan("l8_index_sizes")
def l8_index_sizes(spark, sf_dir):
    return logs.sizes(fx.container_logs(spark, sf_dir))


@plan("l7_expired_indices")
def l7_expired_indices(spark, sf_dir):
    return logs.expired_days(logs.sizes(fx.container_logs(spark, sf_dir)), fx.AS_OF, 14)


# ---------------------------------------------------------------- K
@plan("k3_expired_snapshots")
def k3_expired_snapshots(spark, sf_dir):
    src, _ = fx.snapshot_manifests(spark, sf_dir)
    return snapshots.expired(src, fx.AS_OF, 7).select("path", "bytes", "modified_at")


@plan("k4_mirror_plan")
def k4_mirror_plan(spark, sf_dir):
    src, dst = fx.snapshot_manifests(spark, sf_dir)
    return snapshots.mirror_plan(src, dst).select("rel_path", "bytes", "action")


@plan("s6_latest_snapshot")
def s6_latest_snapshot(spark, sf_dir):
    src, _ = fx.snapshot_manifests(spark, sf_dir)
    return snapshots.latest(snapshots.manifest(src)).select("path", "snapshot_date")
