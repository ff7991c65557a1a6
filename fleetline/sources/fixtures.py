"""Inputs of the device-fleet operators, derived from the ``events`` table.

The reference receives heartbeats, webhooks, metric samples and container
logs from the network.  Here they are views computed by Spark from the given
``events`` table, one input row per event, so every query's work grows with
the table.  The formulas are fixed (FIXTURES.md section 2) and repeated in
DuckDB SQL by the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetline.functions.exprs import hmac_sha256_hex
from fleetline.sources.tables import read_table

# Fixed values for the fixtures.
FIXTURE_SECRET = "fleetline-fixture-secret"
AS_OF = "2024-01-31 00:00:00"
SERVICES = ("acs-ingest", "queue-writer", "status-api")
CODE_BY_TYPE = {"error": "500", "signup": "400", "click": "401", "view": "200", "purchase": "202"}
RFC3339_US = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"
RFC3339_S = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def as_of_col():
    return F.lit(AS_OF).cast("timestamp_ntz")


def base_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "props")
    return e.select(
        "event_id", "ts", "user_id", "event_type",
        F.get_json_object("props", "$.k").try_cast("int").alias("k"))


def device_sn() -> F.Column:
    base = F.concat(F.lit("CPE-"), F.lpad(F.col("user_id").cast("string"), 5, "0"))
    return F.when(F.col("event_id") % 7 == 0, F.lower(base)).otherwise(base)


def _padding(rows: F.Column) -> F.Column:
    """1 MiB of spaces for the given rows, else the empty text.  The length comes
    from the row: constant folding would put the whole MiB into every plan that
    reads the bodies, once for each time it reads them."""
    return F.repeat(F.lit(" "), F.when(rows, 1 << 20).otherwise(0))


def _hour(ts) -> F.Column:
    return F.date_trunc("hour", F.col(ts)).cast("timestamp_ntz")


def heartbeat_fields(spark: SparkSession, sf_dir: str, collisions: bool = False) -> DataFrame:
    """Typed heartbeat content before it is encoded as a body."""
    e = base_events(spark, sf_dir)
    k, et = F.col("k"), F.col("event_type")
    return e.select(
        F.col("event_id").alias("seq"),
        (_hour("ts") if collisions else F.col("ts")).alias("received_at"),
        device_sn().alias("sn"),
        F.when(et != "signup", F.col("ts") - F.make_dt_interval(secs=k)).alias("last_seen"),
        F.when(et != "view", F.concat(F.lit("10.0."), (F.col("user_id") % 256).cast("string"),
                                      F.lit("."), k.cast("string"))).alias("wan_ip"),
        F.concat(F.lit("v1."), (k % 3).cast("string")).alias("sw_version"),
        F.when(et != "error", k).alias("cpu_pct"),
        F.when(et != "click", F.lit(99) - k).alias("mem_pct"),
    )


def heartbeat_arrivals(spark: SparkSession, sf_dir: str, collisions: bool = False) -> DataFrame:
    """``(seq, received_at, body)``: one JSON heartbeat per event; absent
    optional fields are omitted from the body.  By ``seq % 40``: 0 no JSON, 1
    no sn, 2 a percentage of 200, 3 an sn of 65 characters, 4 trailing bytes, 5
    an invalid last_seen, 6 a percentage as text, 7 two spellings of the sn
    key; every 5,000th body is over the 1 MiB limit.  ``collisions`` coarsens the
    arrival time to the hour so history keys collide."""
    h = heartbeat_fields(spark, sf_dir, collisions)
    m = F.col("seq") % 40
    plain = F.to_json(F.struct(
        F.when(m == 3, F.repeat(F.lit("X"), 65)).when(m != 1, F.col("sn")).alias("sn"),
        F.when(m == 5, F.lit("yesterday")).otherwise(F.date_format("last_seen", RFC3339_US)).alias("last_seen"),
        "wan_ip", "sw_version", F.when(m == 2, F.lit(200)).otherwise(F.col("cpu_pct")).alias("cpu_pct"), "mem_pct"))
    h = h.select("seq", "received_at", "sn", plain.alias("plain"))
    body = (F.when(m == 0, F.lit("not json {"))
            .when(m == 4, F.concat("plain", F.lit(" trailing bytes")))
            .when(m == 6, F.concat(F.lit('{"sn":"'), "sn", F.lit('","cpu_pct":"5"}')))
            .when(m == 7, F.replace("plain", F.lit('{"sn":'), F.lit('{"sn":"other","SN":')))
            .otherwise(F.concat("plain", _padding(F.col("seq") % 5000 == 8))))
    return h.select("seq", "received_at", body.alias("body"))


def webhook_arrivals(spark: SparkSession, sf_dir: str, secret: str = FIXTURE_SECRET) -> DataFrame:
    """``(seq, received_at, body, signature, fault)`` with one outcome class per
    event type: error -> not JSON, signup -> no sn, click -> bad signature,
    view -> unsigned, purchase -> signed with ``secret``.  By ``seq % 60``: 11 an
    sn of 65 characters, 13 the database is not there, 17 the body cannot be
    read; every 5,000th body is over the 1 MiB limit."""
    e = base_events(spark, sf_dir)
    k, et = F.col("k"), F.col("event_type")
    ets = F.when(k % 10 == 0, F.lit("not-a-time")).otherwise(F.date_format(_hour("ts"), RFC3339_S))
    m = F.col("event_id") % 60
    valid = F.concat(F.lit('{"sn":"'), F.when(m == 11, F.repeat(F.lit("X"), 65)).otherwise(device_sn()), F.lit('","event_ts":"'), ets,
                     F.lit('","k":'), k.cast("string"), F.lit("}"), _padding(F.col("event_id") % 5000 == 9))
    fault = F.when(m == 13, F.lit("db_not_initialized")).when(m == 17, F.lit("read_body_error"))
    body = (F.when(et == "error", F.lit("this-is-not-json"))
            .when(et == "signup", F.concat(F.lit('{"event_ts":"'), ets, F.lit('"}')))
            .otherwise(valid))
    b = e.select(F.col("event_id").alias("seq"), F.col("ts").alias("received_at"),
                 et.alias("_t"), body.alias("body"), fault.alias("fault"))
    sig = (F.when(F.col("_t") == "click", F.lit("deadbeef"))
           .when(F.col("_t") == "purchase", hmac_sha256_hex("body", secret)))
    return b.select("seq", "received_at", "body", sig.alias("signature"), "fault")


def writer_activity(keyed: DataFrame) -> DataFrame:
    """Transitions log of a writer over the queue ids in ``keyed`` (output of
    ``queue.keyed_arrivals``): by ``id % 5``: 0 claimed then done; 1 claimed
    then failed once; 2 claimed and failed five times (dead); 3 claimed and
    left processing; 4 untouched.  The n-th action of an id happens
    ``n + 1`` minutes after the id was created.  Failures follow the writer
    policy (``queue.failure_state``)."""
    from fleetline.operators.queue import failure_state

    m = F.col("id") % 5
    count = (F.when(m == 0, 2).when(m == 1, 2).when(m == 2, 10).when(m == 3, 1).otherwise(0))
    t = keyed.select("id", "created_raw", count.alias("_c"))
    t = t.where(F.col("_c") > 0).select(
        "id", "created_raw", F.explode(F.sequence(F.lit(0), F.col("_c") - 1)).alias("n"))
    t = t.select(
        "id", F.col("n").cast("long").alias("seq"),
        (F.col("created_raw") + F.make_dt_interval(mins=F.col("n") + 1)).alias("at"),
        (F.col("n") % 2 == 0).alias("_claim"),
        ((F.floor(F.col("n") / 2)) + 1).cast("int").alias("attempts"),
        (F.col("id") % 5 == 0).alias("_ok"))
    f_status, f_next = failure_state("attempts", "at", "writer")
    status = (F.when(F.col("_claim"), F.lit("processing"))
              .when(F.col("_ok"), F.lit("done")).otherwise(f_status))
    fails = ~F.col("_claim") & ~F.col("_ok")
    return t.select(
        "id", "at", "seq", status.alias("status"), "attempts",
        F.when(fails, f_next).alias("next_at"),
        F.when(fails, F.lit("processing_error")).alias("reason"))


def worker_events(keyed: DataFrame) -> DataFrame:
    """``retries.EVENTS`` rows for the ids in ``keyed``: the first arrival, and
    what the workers report 5 s after each claim: by ``id % 5``: 0 processed; 1
    failed once, then processed; 2 failed five times; 3 nothing; 4 failed three
    times, then nothing.  A claim comes when the event is due."""
    from fleetline.functions.exprs import backoff_seconds

    m = F.col("id") % 5
    results = F.when(m == 0, 1).when(m == 1, 2).when(m == 2, 5).when(m == 4, 3).otherwise(0)
    # claims 1, 2, ... are 5 s and a delay of 10, 20, 40, 80 s apart
    waited = sum((F.when(F.col("n") > i, backoff_seconds(F.lit(i)) + 5).otherwise(0) for i in range(1, 5)), F.lit(0))
    t = keyed.select("id", "created_raw", m.alias("_m"), F.explode(F.sequence(F.lit(0), results)).alias("n"))
    failed = (F.col("_m") != 0) & ~((F.col("_m") == 1) & (F.col("n") == 2))
    return t.select(
        "id", F.when(F.col("n") == 0, F.lit("arrival")).otherwise(F.lit("result")).alias("kind"),
        F.when(F.col("n") == 0, F.col("created_raw")).otherwise(
            F.col("created_raw") + F.make_dt_interval(secs=waited + 5)).alias("at"),
        F.col("n").cast("long").alias("seq"), F.when((F.col("n") > 0) & failed, F.lit("timeout")).alias("reason"))


# ------------------------------------------------------------- samples
# Deployments watched by the replica alerts and the namespace.
REPLICA_DEPLOYMENTS = ("acs-ingest", "queue-writer", "database")
NAMESPACE = "fleet"
WEBHOOK_COUNTER = "acs_webhook_requests_total"


def _pick(values, idx):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (idx + 1).cast("int"))


def _code_of_type():
    m = F.create_map(*[x for kv in CODE_BY_TYPE.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
    return m[F.col("event_type")]


def counter_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Webhook request counter scraped at each event: series
    ``(metric, code, instance)``; the value is the running count of the
    series within the day (it restarts from 1 at midnight, like a process
    restart)."""
    from fleetline.operators.series import running_count

    e = base_events(spark, sf_dir)
    s = e.select(F.lit(WEBHOOK_COUNTER).alias("metric"), _code_of_type().alias("code"),
                 (F.col("event_id") % 2).cast("string").alias("instance"), "ts", "event_id",
                 F.to_date("ts").alias("_day"))
    rc = running_count(s, ["metric", "code", "instance", "_day"], "ts", tiebreak="event_id",
                       split_seconds=3_600, name="_n")
    return rc.select("metric", "code", "instance", "ts", F.col("_n").cast("double").alias("value"))


def replica_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Available-replica gauge: deployment by ``user_id % 3``; 0 for error and
    signup events, else 1."""
    e = base_events(spark, sf_dir)
    return e.select(
        "ts", F.lit(NAMESPACE).alias("namespace"),
        _pick(REPLICA_DEPLOYMENTS, F.col("user_id") % 3).alias("deployment"),
        F.when(F.col("event_type").isin("error", "signup"), F.lit(0.0)).otherwise(F.lit(1.0)).alias("value"))


def up_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target-up gauge per ``(service, instance)``: service by ``user_id % 3``,
    instance = pod ``<service>-<user_id % 4>``."""
    e = base_events(spark, sf_dir)
    svc = _pick(SERVICES, F.col("user_id") % 3)
    return e.select(
        "ts", F.lit(NAMESPACE).alias("namespace"), svc.alias("service"),
        F.concat(svc, F.lit("-"), (F.col("user_id") % 4).cast("string")).alias("instance"),
        F.when(F.col("event_type") == "error", F.lit(0.0)).otherwise(F.lit(1.0)).alias("value"))


def connection_samples(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two gauges sampled together per database instance: connections in
    use (2k) and the connection limit (160 + 20 * (user_id % 3))."""
    e = base_events(spark, sf_dir)
    inst = F.concat(F.lit("db-"), (F.col("user_id") % 3).cast("string")).alias("instance")
    used = e.select(inst, "ts", (F.col("k") * 2).cast("double").alias("used"))
    limit = e.select(inst, "ts", (F.lit(160) + (F.col("user_id") % 3) * 20).cast("double").alias("limit"))
    return used, limit


def labelled(samples: DataFrame, ts: str = "ts", value: str = "value") -> DataFrame:
    """Samples as a scraper stores them: ``(labels, ts, value)`` with every
    other column as a label (absent where null) and the metric's name."""
    names = [c for c in samples.columns if c not in (ts, value)]
    pairs = [F.struct(F.lit(n).alias("key"), F.col(n).alias("value")) for n in names]
    if "metric" not in names:
        pairs.append(F.struct(F.lit("__name__").alias("key"), F.lit("up").alias("value")))
    labels = F.map_from_entries(F.filter(F.array(*pairs), lambda p: p["value"].isNotNull()))
    return samples.select(labels.alias("labels"), F.col(ts), F.col(value))


# ------------------------------------------------------------- requests
def list_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(seq, offset, limit)``: the query text of one list request per signup
    event; by ``k % 4`` and ``k % 5`` also absent, negative, too large or no
    number."""
    e = base_events(spark, sf_dir).where(F.col("event_type") == "signup")
    k = F.col("k")
    offset = (F.when(k % 4 == 1, k.cast("string")).when(k % 4 == 2, F.lit("-3")).when(k % 4 == 3, F.lit("x")))
    limit = (F.when(k % 5 == 1, F.lit("0")).when(k % 5 == 2, (k * 10).cast("string")).when(k % 5 == 3, F.lit("501"))
             .when(k % 5 == 4, F.lit("+20")))
    return e.select(F.col("event_id").alias("seq"), offset.alias("offset"), limit.alias("limit"))


def health_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One health request per ten events."""
    return base_events(spark, sf_dir).where(F.col("event_id") % 10 == 0).select(F.col("event_id").alias("seq"))


# ------------------------------------------------------------- logs
LOG_SERVICES = ("status-api", "acs-ingest", "queue-writer")


def container_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(path, ts, line)``: one line per event in one of the three service
    formats (by ``event_id % 3``), JSON-wrapped for even event ids."""
    e = base_events(spark, sf_dir)
    kind = F.col("event_id") % 3
    svc = _pick(LOG_SERVICES, kind)
    pod = F.concat(svc, F.lit("-"), (F.col("user_id") % 4).cast("string"))
    path = F.concat(F.lit("/var/log/containers/"), pod, F.lit(f"_{NAMESPACE}_"), svc, F.lit("-"),
                    F.md5(F.col("user_id").cast("string")), F.lit(".log"))
    k = F.col("k").cast("string")
    hour = F.date_format(_hour("ts"), RFC3339_S)
    msg = (F.when(kind == 0, F.concat(
        F.lit("heartbeat updated: sn="), device_sn(), F.lit(" wan_ip=10.0."),
        (F.col("user_id") % 256).cast("string"), F.lit("."), k, F.lit(" sw_version=v1."),
        (F.col("k") % 3).cast("string"), F.lit(" cpu="), k, F.lit(" mem="),
        (F.lit(99) - F.col("k")).cast("string")))
        .when(kind == 1, F.concat(F.lit("enqueued event for SN="), device_sn(), F.lit(" at "), hour,
                                  F.lit(" in "), k, F.lit(".5ms")))
        .otherwise(F.concat(F.lit("processing ingest_event id="), F.col("event_id").cast("string"),
                            F.lit(" sn="), device_sn(), F.lit(" event_ts="), hour)))
    text = F.concat(F.date_format("ts", "yyyy/MM/dd HH:mm:ss"), F.lit(" "), msg)
    line = F.when(F.col("event_id") % 2 == 0,
                  F.concat(F.lit('{"message":"'), text, F.lit('","level":"info"}'))).otherwise(text)
    return e.select(path.alias("path"), "ts", line.alias("line"))


def pods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pod dimension ``(namespace, pod, app, node)``: pods 0-2 of each
    service (pod 3 is missing, so some log lines find no metadata)."""
    e = base_events(spark, sf_dir).where(F.col("user_id") % 4 < 3)
    svc = _pick(LOG_SERVICES, F.col("event_id") % 3)
    idx = F.col("user_id") % 4
    return e.select(
        F.lit(NAMESPACE).alias("namespace"),
        F.concat(svc, F.lit("-"), idx.cast("string")).alias("pod"), svc.alias("app"),
        F.concat(F.lit("node-"), (idx % 2).cast("string")).alias("node")).distinct()


# ------------------------------------------------------------- snapshots
def snapshot_manifests(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Source and mirror manifests ``(rel_path, path, bytes, modified_at)``:
    one nightly dump per day with events (size = 100 bytes per event, taken
    at 02:00).  The mirror lacks the days divisible by 3, holds a stale size
    on days divisible by 5 and keeps an extra legacy file every 7th day."""
    e = base_events(spark, sf_dir)
    days = e.groupBy(F.to_date("ts").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    ds = F.date_format("d", "yyyy-MM-dd")
    rel = F.concat(ds, F.lit("/fleet-"), ds, F.lit("-020000.parquet"))
    at = (F.col("d").cast("timestamp_ntz") + F.make_dt_interval(hours=F.lit(2)))
    src = days.select(rel.alias("rel_path"), F.concat(F.lit("backups/"), rel).alias("path"),
                      (F.col("n") * 100).alias("bytes"), at.alias("modified_at"))
    dom = F.dayofmonth("d")
    mirror = days.where(dom % 3 != 0).select(
        rel.alias("rel_path"), F.concat(F.lit("mirror/"), rel).alias("path"),
        (F.col("n") * 100 + F.when(dom % 5 == 0, 1).otherwise(0)).alias("bytes"),
        at.alias("modified_at"))
    extra = days.where(dom % 7 == 0).select(
        F.concat(F.lit("legacy/"), ds, F.lit(".sql.gz")).alias("rel_path"),
        F.concat(F.lit("mirror/legacy/"), ds, F.lit(".sql.gz")).alias("path"),
        F.col("n").alias("bytes"), at.alias("modified_at"))
    return src, mirror.unionByName(extra)
