"""Container logs (L1-L8): decode, enrich, index by day, search, extract."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetline.functions.exprs import decoded_once, parsed_once

# Container log path layout and the three service log formats.
PATH_PATTERN = r"^/var/log/containers/([^_]+)_([^_]+)_(.+)-([0-9a-f]+)\.log$"
HEARTBEAT_LINE = r"heartbeat updated: sn=(\S*) wan_ip=(\S*) sw_version=(\S*) cpu=(-?\d+) mem=(-?\d+)"
ENQUEUE_LINE = r"enqueued event for SN=(\S*) at (\S+) in (\S+)"
PROCESS_LINE = r"processing ingest_event id=(\d+) sn=(\S*) event_ts=(\S+)"


def decode(lines: DataFrame, field: str = "line") -> DataFrame:
    """L1: a line that is exactly one JSON object is decoded one level deep:
    ``fields`` holds every top-level key (nested values as JSON text) and
    its ``message`` and ``level`` keys overwrite the raw values.  Arrays,
    scalars, non-JSON lines and objects followed by other text pass
    unchanged (``decoded`` false, ``fields`` NULL)."""
    d = parsed_once(lines, field, strict_tail=True, name="_p")
    v = F.col("_p.doc")
    obj = F.col("_p.ok") & F.startswith(F.ltrim(F.col(field), F.lit(" \t\r\n")), F.lit("{"))
    d = decoded_once(d, F.struct(
        obj.alias("decoded"), F.when(obj, F.try_variant_get(v, "$[0].message", "string")).alias("message"),
        F.when(obj, F.try_variant_get(v, "$[0].level", "string")).alias("level"),
        F.when(obj, F.try_variant_get(v, "$[0]", "map<string,string>")).alias("fields")), "_d")
    return d.select(
        *[c for c in lines.columns], F.coalesce("_d.message", F.col(field)).alias("message"), "_d.level",
        F.coalesce("_d.decoded", F.lit(False)).alias("decoded"), "_d.fields")


def enrich(logs: DataFrame, pods: DataFrame, path: str = "path") -> DataFrame:
    """L2: pod metadata from the file path, then a left join to the pod
    dimension (unmatched lines keep NULL metadata).  The pod dimension is
    bounded by the cluster size; the planner broadcasts it when its
    measured size is under the broadcast threshold."""
    p = F.col(path)
    d = logs.select(
        "*",
        F.nullif(F.regexp_extract(p, PATH_PATTERN, 1), F.lit("")).alias("pod"),
        F.nullif(F.regexp_extract(p, PATH_PATTERN, 2), F.lit("")).alias("namespace"),
        F.nullif(F.regexp_extract(p, PATH_PATTERN, 3), F.lit("")).alias("container"))
    return d.join(pods.select("namespace", "pod", "app", "node"), ["namespace", "pod"], "left")


def daily_index(logs: DataFrame, ts: str = "ts") -> DataFrame:
    """L3: the day each line is indexed under."""
    return logs.withColumn("log_date", F.to_date(F.col(ts)))


# Fixed value: what counts as one token of the search phrase.
_TOKEN = "A-Za-z0-9_.-"


def write_index(logs: DataFrame, root: str, mode: str = "append", distinct_sns: int = 1_000_000,
                row_group_bytes: int = 64 << 20) -> None:
    """L3: decoded lines as a stored daily index: a folder per day, files
    sorted by pod and time, and a Parquet bloom filter on ``sn_key``, the
    (lower-case) serial number after ``sn=``, so a search for one device skips
    the row groups that do not name it.  The few lines that name several are in
    folders of their own (``several``).  Lines are dealt to files by ranges of
    day, pod and time, so a pod that writes a third of all lines is split."""
    names = F.regexp_extract_all(F.col("message"), F.lit(f"(?i)(?<![{_TOKEN}])sn=(?=([{_TOKEN}]+))"), F.lit(1))
    order = ["log_date", *[c for c in ("pod", "path") if c in logs.columns][:1], "ts"]
    d = daily_index(logs).withColumn("_names", names)
    d = d.select(*[c for c in d.columns if c != "_names"], F.lower(F.get("_names", F.lit(0))).alias("sn_key"),
                 (F.size("_names") > 1).cast("int").alias("several"))
    (d.repartitionByRange(*order).sortWithinPartitions(*order).write.mode(mode).partitionBy("log_date", "several")
     .option("parquet.bloom.filter.enabled#sn_key", "true").option("parquet.bloom.filter.expected.ndv#sn_key", str(distinct_sns))
     .option("parquet.block.size", str(row_group_bytes)).parquet(root))


def search_index(spark: SparkSession, root: str, sn: str, as_of, minutes: int = 120) -> DataFrame:
    """L5 on the stored index: the lines of ``search_sn``.  Only the days of the
    time range are read, and of them only row groups whose bloom filter may hold
    the serial number.  A phrase that is more than one token is looked for in
    all lines of these days."""
    end = as_of if isinstance(as_of, F.Column) else F.lit(as_of).cast("timestamp_ntz")
    start = end - F.make_dt_interval(mins=F.lit(minutes))
    days = spark.read.parquet(root).where(F.col("log_date").between(F.to_date(start), F.to_date(end)))
    if re.fullmatch(f"[{_TOKEN}]+", sn):
        days = days.where((F.col("several") == 0) & (F.col("sn_key") == sn.lower())).unionByName(days.where("several = 1"))
    return search_sn(days, sn, as_of, minutes)


def search(logs: DataFrame, equals: dict | None = None, prefixes: dict | None = None,
           words: dict | None = None, size: int | None = 5, ts: str = "ts") -> DataFrame:
    """L4: clauses ANDed: ``equals`` and ``prefixes`` (``x*``) on keyword
    fields compare the whole value; ``words`` (``TEXT*``) on text fields
    match any word that starts with the text, ignoring case.  Newest first,
    ``size`` hits (the result size is part of the query); lines of one time are
    ordered by path and message."""
    d = logs
    for c, v in (equals or {}).items():
        d = d.where(F.col(c) == v)
    for c, v in (prefixes or {}).items():
        d = d.where(F.col(c).startswith(v))
    for c, v in (words or {}).items():
        d = d.where(F.col(c).rlike("(?i)(^|[^A-Za-z0-9_])" + _quote(v)))
    ties = [c for c in ("path", "message", "line") if c in d.columns]
    d = d.orderBy(F.col(ts).desc(), *ties)
    return d.limit(size) if size else d


def search_sn(logs: DataFrame, sn: str, as_of, minutes: int = 120, ts: str = "ts",
              field: str = "message") -> DataFrame:
    """Lines with the phrase ``sn=<SN>`` (case-insensitive, whole token,
    so ``CPE-1`` does not hit ``CPE-10``) in (as_of - minutes, as_of]."""
    end = as_of if isinstance(as_of, F.Column) else F.lit(as_of).cast("timestamp_ntz")
    start = end - F.make_dt_interval(mins=F.lit(minutes))
    token = "(?i)(^|[^A-Za-z0-9_.-])sn=" + _quote(sn) + "($|[^A-Za-z0-9_.-])"
    return logs.where((F.col(ts) > start) & (F.col(ts) <= end) & F.col(field).rlike(token))


def _quote(s: str) -> str:
    return "".join("\\" + ch if not ch.isalnum() else ch for ch in s)


def extract(logs: DataFrame, field: str = "message") -> DataFrame:
    """Typed fields of the three service log formats (note ``sn=`` in
    two formats and ``SN=`` in the enqueue one)."""
    m = F.col(field)

    def rx(p, i):
        return F.nullif(F.regexp_extract(m, p, i), F.lit(""))

    kind = (F.when(m.rlike(HEARTBEAT_LINE), F.lit("heartbeat"))
            .when(m.rlike(ENQUEUE_LINE), F.lit("enqueue"))
            .when(m.rlike(PROCESS_LINE), F.lit("process")))
    sn = F.coalesce(rx(HEARTBEAT_LINE, 1), rx(ENQUEUE_LINE, 1), rx(PROCESS_LINE, 2))
    return logs.select(
        *[c for c in logs.columns], kind.alias("kind"), sn.alias("sn"),
        rx(HEARTBEAT_LINE, 2).alias("wan_ip"), rx(HEARTBEAT_LINE, 3).alias("sw_version"),
        rx(HEARTBEAT_LINE, 4).try_cast("int").alias("cpu"),
        rx(HEARTBEAT_LINE, 5).try_cast("int").alias("mem"),
        rx(PROCESS_LINE, 1).try_cast("long").alias("event_id"),
        F.coalesce(rx(ENQUEUE_LINE, 2), rx(PROCESS_LINE, 3)).alias("event_time"))


def sizes(logs: DataFrame, line: str = "line", ts: str = "ts") -> DataFrame:
    """Documents and bytes per daily index."""
    return (daily_index(logs, ts).groupBy("log_date")
            .agg(F.count(F.lit(1)).alias("docs"), F.sum(F.octet_length(F.col(line))).alias("bytes")))


def expired_days(index_sizes: DataFrame, as_of, days: int) -> DataFrame:
    """Daily indices older than ``days`` (to delete)."""
    end = F.to_date(F.lit(as_of).cast("timestamp_ntz")) if isinstance(as_of, str) else F.to_date(as_of)
    return index_sizes.where(F.col("log_date") < F.date_sub(end, days))


def heartbeat_lines(classified: DataFrame) -> DataFrame:
    """The line the status service logs for each accepted heartbeat (after
    both table writes): missing strings print empty, missing numbers 0.
    Pass final outcomes (``state.heartbeat_outcomes``) so arrivals that lost
    their history key, which end as 500, log nothing."""
    ok = classified.where(F.col("code") == 202)
    line = F.format_string(
        "heartbeat updated: sn=%s wan_ip=%s sw_version=%s cpu=%d mem=%d",
        F.col("sn"), F.coalesce(F.col("wan_ip"), F.lit("")), F.coalesce(F.col("sw_version"), F.lit("")),
        F.coalesce(F.col("cpu_pct"), F.lit(0)), F.coalesce(F.col("mem_pct"), F.lit(0)))
    return ok.select(F.col("received_at").alias("ts"), F.lit("status-api").alias("service"),
                     line.alias("message"))


def process_lines(transitions: DataFrame, queue: DataFrame) -> DataFrame:
    """The line the writer logs for each event it claimed: id, sn and the
    event time in RFC 3339 with nanosecond trimming."""
    from fleetline.functions.exprs import format_rfc3339_nano

    c = transitions.where(F.col("status") == "processing").select("id", "at")
    j = c.join(queue.select("id", "sn", "event_ts"), "id")
    line = F.format_string("processing ingest_event id=%d sn=%s event_ts=%s",
                           F.col("id"), F.col("sn"), format_rfc3339_nano("event_ts"))
    return j.select(F.col("at").alias("ts"), F.lit("queue-writer").alias("service"), line.alias("message"))
