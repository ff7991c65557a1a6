"""Trust boundary: validate, decode and route raw arrivals.

Every arrival yields exactly one outcome row with an HTTP-like ``code``;
nothing is dropped.  The checks are column expressions evaluated in one
projection, so classification is a narrow (shuffle-free) stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetline import schemas as S
from fleetline.functions.exprs import (decoded_fields, decoded_once, is_int_or_null, is_string_or_null, rfc3339,
                                       round_ms, signature_ok)

# Ingress body limit (1 MiB) and the outcome reasons.
MAX_BODY_BYTES = 1_048_576
WEBHOOK_REASONS = ("db_not_initialized", "read_body_error", "invalid_signature",
                   "invalid_json", "missing_sn", "db_error")

HEARTBEAT_STRING_FIELDS = ("sn", "last_seen", "wan_ip", "sw_version")
HEARTBEAT_INT_FIELDS = ("cpu_pct", "mem_pct")


def classify_webhook(arrivals: DataFrame, secret: str | bytes,
                     max_body_bytes: int = MAX_BODY_BYTES) -> DataFrame:
    """Webhook outcome per arrival.

    Input: ``seq, received_at, body, signature`` and optionally ``fault``
    (transport faults ``db_not_initialized`` / ``read_body_error``).
    Output adds ``code, reason, sn, event_ts, payload``.  Check order:
    body limit (413, never reaches the service) -> fault -> signature (401)
    -> strict JSON (400 invalid_json) -> sn (400 missing_sn) -> event time
    with fallback to arrival -> column constraints (500 db_error) -> 202.
    """
    cols = arrivals.columns
    fault = F.col("fault") if "fault" in cols else F.lit(None).cast("string")
    body = F.col("body")
    d = decoded_fields(arrivals, body, ("sn", "event_ts"), True, "_f")
    f = F.col("_f")
    is_obj, sn_v, ets_v = f["is_object"], f["sn"], f["event_ts"]
    well_typed = F.when(is_obj, is_string_or_null(sn_v) & is_string_or_null(ets_v)).otherwise(f["is_null"])

    d = decoded_once(d, F.struct(
        (F.coalesce(F.octet_length(body), F.lit(0)) > max_body_bytes).alias("too_big"),
        (~F.coalesce(signature_ok(body, F.col("signature"), secret), F.lit(False))).alias("sig_bad"),
        well_typed.alias("json_ok"),
        F.when(is_obj, F.variant_get(sn_v, "$", "string")).alias("sn"),
        F.when(is_obj, F.variant_get(ets_v, "$", "string")).alias("ets")), "_d")
    event_ts = round_ms(F.coalesce(
        F.when(F.coalesce(F.col("_d.ets"), F.lit("")) != "", rfc3339(F.col("_d.ets"))),
        F.col("received_at")))
    d = decoded_once(d, F.struct(event_ts.alias("event_ts")), "_e")
    checks = S.violations([
        ("sn_too_long", S.too_long(F.col("_d.sn"))),
        ("event_ts_range", S.out_of_datetime(F.col("_e.event_ts"))),
    ])
    code, reason = _webhook_chain(fault, checks)
    stored = code.isin(202, 500)
    return d.select(
        *[F.col(c) for c in cols],
        code.alias("code"), reason.alias("reason"),
        F.when(stored, F.col("_d.sn")).alias("sn"),
        F.when(stored, F.col("_e.event_ts")).alias("event_ts"),
        F.when(code == 202, body).alias("payload"),
    )


def _webhook_chain(fault, checks):
    d, no_sn = F.col("_d"), F.coalesce(F.col("_d.sn"), F.lit("")) == ""
    code = (F.when(d["too_big"], F.lit(413))
            .when(fault == "db_not_initialized", F.lit(500))
            .when(fault.isNotNull(), F.lit(400))
            .when(d["sig_bad"], F.lit(401))
            .when(~d["json_ok"], F.lit(400))
            .when(no_sn, F.lit(400))
            .when(F.size(checks) > 0, F.lit(500))
            .otherwise(F.lit(202)))
    reason = (F.when(d["too_big"], F.lit("body_too_large"))
              .when(fault.isNotNull(), fault)
              .when(d["sig_bad"], F.lit("invalid_signature"))
              .when(~d["json_ok"], F.lit("invalid_json"))
              .when(no_sn, F.lit("missing_sn"))
              .when(F.size(checks) > 0, F.lit("db_error")))
    return code.cast("int"), reason.cast("string")


def classify_heartbeat(arrivals: DataFrame, max_body_bytes: int = MAX_BODY_BYTES) -> DataFrame:
    """Heartbeat outcome per arrival.

    Input ``seq, received_at, body``.  The decoder reads the first JSON value
    only (trailing bytes ignored); wrong field types or a missing/empty ``sn``
    give 400; a column-constraint violation gives 500 and writes neither
    table; otherwise 202 (history key collisions are resolved by
    ``state.history``, which may turn a 202 into 500).

    Output adds ``code, reason, bound, sn, last_seen, wan_ip, sw_version,
    cpu_pct, mem_pct, violations``.  ``bound`` marks rows that passed
    decoding and the sn check: they update the per-device counters and
    gauges even when the table write fails.  ``cpu_pct``/``mem_pct`` are
    LONG here (the gauge shows values the table rejects)."""
    cols = arrivals.columns
    body = F.col("body")
    d = decoded_fields(arrivals, body, HEARTBEAT_STRING_FIELDS + HEARTBEAT_INT_FIELDS, False, "_f")
    is_obj, fields = F.col("_f.is_object"), F.col("_f")
    typed = F.lit(True)
    for n in HEARTBEAT_STRING_FIELDS:
        typed = typed & is_string_or_null(fields[n])
    for n in HEARTBEAT_INT_FIELDS:
        typed = typed & is_int_or_null(fields[n])
    decoded = F.when(is_obj, typed).otherwise(F.col("_f.is_null"))

    too_big = F.coalesce(F.octet_length(body), F.lit(0)) > max_body_bytes
    d = decoded_once(d, F.struct(
        too_big.alias("too_big"), decoded.alias("dec"),
        *[F.when(is_obj, F.variant_get(fields[n], "$", "string")).alias(n) for n in HEARTBEAT_STRING_FIELDS],
        *[F.when(is_obj, F.try_variant_get(fields[n], "$", "long")).alias(n) for n in HEARTBEAT_INT_FIELDS]), "_d")
    v = F.col("_d")
    has_sn = F.coalesce(v["sn"], F.lit("")) != ""
    bound = ~v["too_big"] & v["dec"] & has_sn
    seen = v["last_seen"]
    last_seen = F.coalesce(F.when(F.coalesce(seen, F.lit("")) != "", rfc3339(seen)), F.col("received_at"))
    viol = S.violations([
        ("sn_too_long", S.too_long(v["sn"])),
        ("wan_ip_too_long", S.too_long(v["wan_ip"])),
        ("sw_version_too_long", S.too_long(v["sw_version"])),
        ("cpu_pct_range", S.out_of_tinyint(v["cpu_pct"])),
        ("mem_pct_range", S.out_of_tinyint(v["mem_pct"])),
        ("last_seen_range", S.out_of_datetime(F.col("_l.seen"))),
    ])
    d = decoded_once(d, F.struct(last_seen.alias("seen")), "_l")
    d = decoded_once(d, F.struct(bound.alias("bound"), F.when(bound, viol).alias("violations")), "_b")
    b = F.col("_b")
    code = (F.when(v["too_big"], F.lit(413))
            .when(~v["dec"] | ~has_sn, F.lit(400))
            .when(F.size(b["violations"]) > 0, F.lit(500))
            .otherwise(F.lit(202))).cast("int")
    reason = (F.when(v["too_big"], F.lit("body_too_large"))
              .when(~v["dec"], F.lit("invalid_json"))
              .when(~has_sn, F.lit("missing_sn"))
              .when(F.size(b["violations"]) > 0, F.lit("db_error"))).cast("string")
    return d.select(
        *[F.col(c) for c in cols],
        code.alias("code"), reason.alias("reason"), b["bound"].alias("bound"),
        F.when(b["bound"], v["sn"]).alias("sn"),
        F.when(b["bound"], round_ms(F.col("_l.seen"))).alias("last_seen"),
        *[F.when(b["bound"], v[n]).alias(n) for n in ("wan_ip", "sw_version", *HEARTBEAT_INT_FIELDS)],
        b["violations"].alias("violations"),
    )
