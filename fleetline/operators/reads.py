"""Reads over the state tables (R1-R8): paging, lookups, per-device
history and the device report."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetline.functions.exprs import deep_link, format_go_datetime, normalize_page
from fleetline.operators.state import plain, sn_key

STATUS_COLUMNS = ("sn", "last_seen", "wan_ip", "sw_version", "cpu_pct", "mem_pct", "updated_at")


def page(status: DataFrame, offset=0, limit=50) -> DataFrame:
    """``ORDER BY sn LIMIT l OFFSET o`` with the collated order.  Bad or
    negative offset -> 0; bad, <= 0 or > 500 limit -> 50.  Spark plans this
    as a top-k (TakeOrderedAndProject), never a full sort on one task."""
    o, n = normalize_page(offset, limit)
    s = status.select(*STATUS_COLUMNS)
    return s.orderBy(sn_key("sn"), F.col("sn")).offset(o).limit(n) if o else \
        s.orderBy(sn_key("sn"), F.col("sn")).limit(n)


def page_after(status: DataFrame, after_sn: str | None, limit=50) -> DataFrame:
    """Keyset paging for deep pages at scale: the page that follows
    ``after_sn`` in collated order (a filter plus a small top-k)."""
    _, n = normalize_page(0, limit)
    s = status.select(*STATUS_COLUMNS)
    if after_sn is not None:
        s = s.where(sn_key("sn") > F.collate(F.lit(after_sn), "UNICODE_CI_AI"))
    return s.orderBy(sn_key("sn"), F.col("sn")).limit(n)


def lookup(status: DataFrame, requests: DataFrame, request_col: str = "request_sn") -> DataFrame:
    """R2 (batch form): every requested serial number with ``found`` and the
    stored row when there is one (collated equality; a miss is a 404)."""
    r = requests.select(F.col(request_col).alias("request_sn"))
    s = status.select(*STATUS_COLUMNS).withColumn("_k", sn_key("sn"))
    j = r.join(s, sn_key("request_sn") == s["_k"], "left")
    return j.select("request_sn", F.col("sn").isNotNull().alias("found"),
                    *[F.col(c) for c in STATUS_COLUMNS])


def current_view(status: DataFrame) -> DataFrame:
    """Admin projection, time as ``yyyy-MM-dd HH:mm:ss``."""
    return status.select("sn", "wan_ip", "sw_version", "cpu_pct", "mem_pct",
                         format_go_datetime("last_seen").alias("last_heartbeat_at"))


def latest_n_for(history: DataFrame, sn: str, n: int = 20) -> DataFrame:
    """The ``n`` newest history rows of one device."""
    sn = sn.strip() if isinstance(sn, str) else sn
    h = history.where(sn_key("sn") == F.collate(F.lit(sn), "UNICODE_CI_AI"))
    return h.orderBy(F.col("event_ts").desc()).limit(n)


def latest_n(history: DataFrame, n: int = 20) -> DataFrame:
    """R6 core: the ``n`` newest history rows of every device, with
    ``rank`` 1..n.  ``row_number() <= n`` lets Spark insert a partial
    WindowGroupLimit before the shuffle, so a chatty device ships at most
    ``n`` rows per input partition."""
    w = Window.partitionBy(sn_key("sn")).orderBy(F.col("event_ts").desc())
    return (history.withColumn("rank", F.row_number().over(w))
            .where(F.col("rank") <= n))


def device_report(status: DataFrame, history: DataFrame, n: int = 20,
                  dashboard_template: str | None = None,
                  logs_template: str | None = None) -> DataFrame:
    """R6+R7: admin page for every device: current status (or the error
    "SN not found" when only history exists) and its ``n`` newest history
    rows, one output row per history row (rank NULL when there is none),
    plus the deep links.  Full outer join on the collated key."""
    top = latest_n(history, n).select(
        sn_key("sn").alias("_hk"), F.col("sn").alias("_hsn"), "rank",
        format_go_datetime("event_ts").alias("heartbeat_at"),
        F.col("wan_ip").alias("h_wan_ip"),
        F.col("cpu_pct").alias("h_cpu_pct"), F.col("mem_pct").alias("h_mem_pct"))
    cur = current_view(status).withColumn("_sk", sn_key("sn"))
    j = cur.join(top, cur["_sk"] == top["_hk"], "full_outer")
    device = plain(F.coalesce(F.col("sn"), F.col("_hsn")))
    return j.select(
        device.alias("device"),
        F.col("sn").isNotNull().alias("found"),
        F.when(F.col("sn").isNull(), F.lit("SN not found")).alias("error"),
        "wan_ip", "sw_version", "cpu_pct", "mem_pct", "last_heartbeat_at",
        "rank", "heartbeat_at", "h_wan_ip", "h_cpu_pct", "h_mem_pct",
        deep_link(dashboard_template, device).alias("dashboard_url"),
        deep_link(logs_template, device).alias("logs_url"),
    )
