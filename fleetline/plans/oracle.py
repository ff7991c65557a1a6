"""DuckDB SQL twins of the catalog plans.

Each query derives its inputs from the raw ``events`` view with the same
fixed formulas as ``fleetline.sources.fixtures`` and then computes the
result by a different route than the Spark plan (window functions and joins
instead of min_by/max_by folds), so agreement is a real cross-check.
"""

from __future__ import annotations

import hashlib

from fleetline.sources.fixtures import AS_OF, FIXTURE_SECRET


def rms(x: str) -> str:
    """DATETIME(3): round half up to the millisecond."""
    return f"make_timestamp(((epoch_us({x}) + 500) // 1000) * 1000)"


def rs(x: str) -> str:
    """DATETIME(0): round half up to the second."""
    return f"make_timestamp(((epoch_us({x}) + 500000) // 1000000) * 1000000)"


def _hmac_sql(body: str, secret: str = FIXTURE_SECRET) -> str:
    # RFC 2104 from its definition: key XOR 0x36.. and 0x5c.. over one block
    key = (secret.encode() if len(secret.encode()) <= 64 else hashlib.sha256(secret.encode()).digest()).ljust(64, b"\0")
    ipad, opad = (bytes(a ^ b for a, b in zip(key, bytes([x]) * 64)) for x in (0x36, 0x5C))
    return (f"sha256(unhex('{opad.hex()}') || unhex(sha256(unhex('{ipad.hex()}') || encode({body}))))")


CTE = {}
CTE["ev"] = """ev AS (
  SELECT event_id, ts, user_id, event_type,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
         CASE WHEN event_id % 7 = 0 THEN lower('CPE-' || lpad(CAST(user_id AS VARCHAR), 5, '0'))
              ELSE 'CPE-' || lpad(CAST(user_id AS VARCHAR), 5, '0') END AS sn
  FROM events)"""
# heartbeat bodies, then what a decoder makes of them: the first JSON object of the text, its keys folded, the last
# of equal keys; ``name`` keeps the stored ones
def _hb(name: str, received: str) -> str:
    def entry(key: str, value: str, text: bool = True) -> str:
        return f"""'"{key}":' || {("'" + chr(34) + "' || " + value + " || '" + chr(34) + "'") if text else value}"""

    pairs = [entry("sn", "CASE WHEN m = 3 THEN repeat('X', 65) WHEN m <> 1 THEN sn END"),
             entry("last_seen", "CASE WHEN m = 5 THEN 'yesterday' WHEN event_type <> 'signup' THEN strftime(ts - to_seconds(k), '%Y-%m-%dT%H:%M:%S.%fZ') END"),
             entry("wan_ip", "CASE WHEN event_type <> 'view' THEN '10.0.' || CAST(user_id % 256 AS VARCHAR) || '.' || CAST(k AS VARCHAR) END"),
             entry("sw_version", "'v1.' || CAST(k % 3 AS VARCHAR)"),
             entry("cpu_pct", "CAST(CASE WHEN m = 2 THEN 200 WHEN event_type <> 'error' THEN k END AS VARCHAR)", False),
             entry("mem_pct", "CAST(CASE WHEN event_type <> 'click' THEN 99 - k END AS VARCHAR)", False)]
    of = lambda k, c: f"max(CASE WHEN k = '{k}' THEN {c} END)"
    texts, numbers = ("sn", "last_seen", "wan_ip", "sw_version"), ("cpu_pct", "mem_pct")
    bad = " OR ".join([*[f"coalesce({of(t, 't')}, 'NULL') NOT IN ('VARCHAR', 'NULL')" for t in texts],
                       *[f"coalesce({of(n, 't')}, 'NULL') NOT IN ('UBIGINT', 'BIGINT', 'NULL')" for n in numbers]])
    return f"""{name}_plain AS (
  SELECT event_id AS seq, {received} AS received_at, m, sn,
         '{{' || array_to_string(list_filter([{", ".join(pairs)}], lambda x: x IS NOT NULL), ',') || '}}' AS plain
  FROM (SELECT *, event_id % 40 AS m FROM ev)),
{name}_body AS (
  SELECT seq, received_at, CASE WHEN m = 0 THEN 'not json {{' WHEN m = 4 THEN plain || ' trailing bytes'
    WHEN m = 6 THEN '{{"sn":"' || sn || '","cpu_pct":"5"}}' WHEN m = 7 THEN replace(plain, '{{"sn":', '{{"sn":"other","SN":')
    WHEN seq % 5000 = 8 THEN plain || repeat(' ', 1048576) ELSE plain END AS body FROM {name}_plain),
{name}_kv AS (
  SELECT seq, lower(key) AS k, arg_max(type, id) AS t, arg_max(value ->> '$', id) AS v
  FROM (SELECT seq, regexp_extract(body, '^[ ]*([{{][^{{}}]*[}}])', 1) AS js FROM {name}_body), json_each(CASE WHEN json_valid(js) THEN js END)
  GROUP BY seq, lower(key)),
{name}_dec AS (
  SELECT seq, {", ".join(f"{of(t, 'v')} AS {t}" for t in texts)}, {", ".join(f"TRY_CAST({of(n, 'v')} AS BIGINT) AS {n}" for n in numbers)},
         {bad} AS bad FROM {name}_kv GROUP BY seq),
{name}_all AS (
  SELECT b.seq, b.received_at, d.sn, coalesce(try_strptime(d.last_seen, '%Y-%m-%dT%H:%M:%S.%fZ'), b.received_at) AS last_seen,
         d.wan_ip, d.sw_version, d.cpu_pct, d.mem_pct,
         CASE WHEN strlen(b.body) > 1048576 THEN 413 WHEN d.seq IS NULL OR d.bad OR coalesce(d.sn, '') = '' THEN 400
              WHEN {name}_viol THEN 500 ELSE 202 END AS code,
         CASE WHEN strlen(b.body) > 1048576 THEN 'body_too_large' WHEN d.seq IS NULL OR d.bad THEN 'invalid_json'
              WHEN coalesce(d.sn, '') = '' THEN 'missing_sn' WHEN {name}_viol THEN 'db_error' END AS reason
  FROM {name}_body b LEFT JOIN {name}_dec d ON d.seq = b.seq),
{name} AS (SELECT * FROM {name}_all WHERE code = 202)""".replace(f"{name}_viol", "(greatest(length(d.sn), coalesce(length(d.wan_ip), 0), coalesce(length(d.sw_version), 0)) > 64"
                                                     " OR coalesce(d.cpu_pct, 0) NOT BETWEEN -128 AND 127 OR coalesce(d.mem_pct, 0) NOT BETWEEN -128 AND 127)")


def _status(name: str, src: str) -> str:
    return f"""{name} AS (
  SELECT f.sn, {rms('l.last_seen')} AS last_seen, l.wan_ip, l.sw_version,
         CAST(l.cpu_pct AS TINYINT) AS cpu_pct, CAST(l.mem_pct AS TINYINT) AS mem_pct,
         {rs('l.received_at')} AS updated_at
  FROM (SELECT *, row_number() OVER (PARTITION BY lower(sn) ORDER BY seq DESC) AS rn FROM {src}) l
  JOIN (SELECT *, row_number() OVER (PARTITION BY lower(sn) ORDER BY seq) AS rn FROM {src}) f
    ON lower(l.sn) = lower(f.sn) AND f.rn = 1
  WHERE l.rn = 1)"""


def _hist(name: str, src: str) -> str:
    return f"""{name} AS (
  SELECT sn, event_ts, {rms('last_seen')} AS last_seen, wan_ip, sw_version,
         CAST(cpu_pct AS TINYINT) AS cpu_pct, CAST(mem_pct AS TINYINT) AS mem_pct
  FROM (SELECT *, {rms('received_at')} AS event_ts,
               row_number() OVER (PARTITION BY lower(sn), {rms('received_at')} ORDER BY seq) AS rn
        FROM {src}) WHERE rn = 1)"""


AS_OF_SQL = f"TIMESTAMP '{AS_OF}'"
HMAC = _hmac_sql("body")

CTE["hb"] = _hb("hb", "ts")
CTE["hbc"] = _hb("hbc", "date_trunc('hour', ts)")
CTE["status"] = _status("status", "hb")
CTE["statusc"] = _status("statusc", "hbc")
CTE["hist"] = _hist("hist", "hb")
CTE["histc"] = _hist("histc", "hbc")
CTE["hbo"] = f"""hbo AS (
  SELECT seq, received_at, CASE WHEN rn = 1 THEN 202 ELSE 500 END AS code,
         CASE WHEN rn = 1 THEN NULL ELSE 'history_conflict' END AS reason
  FROM (SELECT *, row_number() OVER (PARTITION BY lower(sn), {rms('received_at')} ORDER BY seq) AS rn
        FROM hbc)
  UNION ALL SELECT seq, received_at, code, reason FROM hbc_all WHERE code <> 202),
api AS (SELECT * FROM hbo WHERE code <> 413)"""
CTE["whc"] = f"""wh AS (
  SELECT event_id AS seq, ts AS received_at, event_type, CASE WHEN event_id % 60 = 11 THEN repeat('X', 65) ELSE sn END AS sn, k,
         CASE event_id % 60 WHEN 13 THEN 'db_not_initialized' WHEN 17 THEN 'read_body_error' END AS fault,
         CASE WHEN k % 10 = 0 THEN 'not-a-time'
              ELSE strftime(date_trunc('hour', ts), '%Y-%m-%dT%H:%M:%SZ') END AS ets
  FROM ev),
whb AS (
  SELECT seq, received_at, event_type, fault,
         CASE event_type WHEN 'error' THEN 'this-is-not-json'
              WHEN 'signup' THEN '{{"event_ts":"' || ets || '"}}'
              ELSE '{{"sn":"' || sn || '","event_ts":"' || ets || '","k":' || CAST(k AS VARCHAR) || '}}' || CASE WHEN seq % 5000 = 9 THEN repeat(' ', 1048576) ELSE '' END END AS body
  FROM wh),
whs AS (
  SELECT seq, received_at, body, fault,
         CASE event_type WHEN 'click' THEN 'deadbeef' WHEN 'purchase' THEN {HMAC} END AS signature
  FROM whb),
whv AS (
  SELECT *, json_valid(body) AS jv,
         CASE WHEN json_valid(body) THEN json_type(CASE WHEN json_valid(body) THEN body ELSE 'null' END) END AS jt,
         json_extract_string(CASE WHEN json_valid(body) AND json_type(CASE WHEN json_valid(body) THEN body ELSE 'null' END) = 'OBJECT'
                                  THEN body ELSE '{{}}' END, '$.sn') AS jsn,
         json_extract_string(CASE WHEN json_valid(body) AND json_type(CASE WHEN json_valid(body) THEN body ELSE 'null' END) = 'OBJECT'
                                  THEN body ELSE '{{}}' END, '$.event_ts') AS jets
  FROM whs),
whc AS (
  SELECT seq, received_at, body, signature,
         CASE WHEN strlen(body) > 1048576 THEN 413 WHEN use_fault AND fault = 'db_not_initialized' THEN 500 WHEN use_fault AND fault IS NOT NULL THEN 400
              WHEN coalesce(signature, '') <> '' AND signature <> {HMAC} THEN 401
              WHEN NOT jv OR jt NOT IN ('OBJECT', 'NULL') THEN 400
              WHEN coalesce(jsn, '') = '' THEN 400 WHEN length(jsn) > 64 THEN 500 ELSE 202 END AS code,
         CASE WHEN strlen(body) > 1048576 THEN 'body_too_large' WHEN use_fault AND fault IS NOT NULL THEN fault
              WHEN coalesce(signature, '') <> '' AND signature <> {HMAC} THEN 'invalid_signature'
              WHEN NOT jv OR jt NOT IN ('OBJECT', 'NULL') THEN 'invalid_json'
              WHEN coalesce(jsn, '') = '' THEN 'missing_sn' WHEN length(jsn) > 64 THEN 'db_error' END AS reason,
         jsn, {rms("coalesce(try_strptime(jets, '%Y-%m-%dT%H:%M:%SZ'), received_at)")} AS jevent_ts
  FROM whv, (SELECT TRUE AS use_fault))"""
# the same requests as files of arrival records, which carry no transport faults
CTE["whf"] = CTE["whc"].replace("(SELECT TRUE AS use_fault)", "(SELECT FALSE AS use_fault)")
CTE["qk"] = """qa AS (
  SELECT seq, received_at, jsn AS sn, jevent_ts AS event_ts, body AS payload FROM whc WHERE code = 202),
qk AS (
  SELECT lower(sn) AS k, event_ts, min(seq) AS id, arg_min(sn, seq) AS sn,
         arg_min(received_at, seq) AS created_raw, arg_max(received_at, seq) AS last_at,
         arg_max(payload, seq) AS payload
  FROM qa GROUP BY lower(sn), event_ts)"""
CTE["qt"] = """qt AS (
  SELECT id, CAST(n AS BIGINT) AS seq, created_raw + to_minutes(n + 1) AS "at",
         CASE WHEN n % 2 = 0 THEN 'processing' WHEN id % 5 = 0 THEN 'done'
              WHEN n // 2 + 1 >= 5 THEN 'dead' ELSE 'queued' END AS status,
         CAST(n // 2 + 1 AS INTEGER) AS attempts,
         CASE WHEN n % 2 = 1 AND id % 5 <> 0 AND n // 2 + 1 < 5
              THEN created_raw + to_minutes(n + 1) + to_seconds(LEAST(300, 5 * (1 << (n // 2 + 1)))) END AS next_at,
         CASE WHEN n % 2 = 1 AND id % 5 <> 0 THEN 'processing_error' END AS reason
  FROM (SELECT id, created_raw,
               unnest(generate_series(0, (CASE id % 5 WHEN 0 THEN 2 WHEN 1 THEN 2 WHEN 2 THEN 10
                                                      WHEN 3 THEN 1 ELSE 0 END) - 1)) AS n
        FROM qk))"""
CTE["queue"] = f"""qe AS (
  SELECT qk.id, a.received_at AS "at", 0 AS src, a.seq AS s, 'queued' AS status, 0 AS attempts,
         a.received_at AS next_at
  FROM qa a JOIN qk ON lower(a.sn) = qk.k AND a.event_ts = qk.event_ts
  UNION ALL
  SELECT id, "at", 1, seq, status, attempts, next_at FROM qt),
qlast AS (
  SELECT id, status, attempts, "at" FROM (
    SELECT *, row_number() OVER (PARTITION BY id ORDER BY "at" DESC, src DESC, s DESC) AS rn FROM qe)
  WHERE rn = 1),
qnext AS (
  SELECT id, next_at FROM (
    SELECT *, row_number() OVER (PARTITION BY id ORDER BY "at" DESC, src DESC, s DESC) AS rn
    FROM qe WHERE next_at IS NOT NULL) WHERE rn = 1),
queue AS (
  SELECT qk.id, 'acs' AS source, qk.sn, qk.event_ts, qk.payload, qlast.status,
         CAST(qlast.attempts AS INTEGER) AS attempts, {rs('qnext.next_at')} AS next_at,
         {rs('qk.created_raw')} AS created_at, {rs('qlast."at"')} AS updated_at
  FROM qk JOIN qlast USING (id) JOIN qnext USING (id))"""


def _backlog(name: str, step_us: int) -> str:
    return f"""{name}_e AS (
  SELECT min(seq) OVER (PARTITION BY lower(sn), event_ts) AS id, received_at AS "at", 0 AS src, seq,
         TRUE AS is_open FROM qa
  UNION ALL
  SELECT id, "at", 1, seq, status IN ('queued', 'processing') FROM qt),
{name}_d AS (
  SELECT "at", CAST(is_open AS INTEGER)
             - CAST(coalesce(lag(is_open) OVER (PARTITION BY id ORDER BY "at", src, seq), FALSE) AS INTEGER) AS delta
  FROM {name}_e),
{name}_b AS (
  SELECT make_timestamp((epoch_us("at") // {step_us}) * {step_us} + {step_us}) AS bucket_end,
         CAST(sum(CASE WHEN delta > 0 THEN 1 ELSE 0 END) AS BIGINT) AS opened,
         CAST(sum(CASE WHEN delta < 0 THEN 1 ELSE 0 END) AS BIGINT) AS closed
  FROM {name}_d WHERE delta <> 0 GROUP BY 1),
{name}_s AS (
  SELECT unnest(generate_series(min(bucket_end), max(bucket_end), to_microseconds({step_us}))) AS bucket_end FROM {name}_b),
{name} AS (
  SELECT s.bucket_end, coalesce(b.opened, 0) AS opened, coalesce(b.closed, 0) AS closed,
         CAST(sum(coalesce(b.opened, 0) - coalesce(b.closed, 0)) OVER (ORDER BY s.bucket_end ROWS UNBOUNDED PRECEDING) AS BIGINT) AS open_events
  FROM {name}_s s LEFT JOIN {name}_b b ON b.bucket_end = s.bucket_end)"""


CTE["backlog_day"] = _backlog("backlog_day", 86_400_000_000)
CTE["backlog_hour"] = _backlog("backlog_hour", 3_600_000_000)

CTE["samples"] = """samples AS (
  SELECT 'acs_webhook_requests_total' AS metric,
         CASE event_type WHEN 'error' THEN '500' WHEN 'signup' THEN '400' WHEN 'click' THEN '401'
              WHEN 'view' THEN '200' WHEN 'purchase' THEN '202' END AS code,
         CAST(event_id % 2 AS VARCHAR) AS instance, ts,
         CAST(count(*) OVER (PARTITION BY event_type, event_id % 2, CAST(ts AS DATE)
                             ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS value
  FROM ev)"""
CTE["replicas"] = """replicas AS (
  SELECT ts, 'fleet' AS namespace, (['acs-ingest', 'queue-writer', 'database'])[user_id % 3 + 1] AS deployment,
         CASE WHEN event_type IN ('error', 'signup') THEN 0.0 ELSE 1.0 END::DOUBLE AS value
  FROM ev)"""
CTE["ups"] = """ups AS (
  SELECT ts, 'fleet' AS namespace, (['acs-ingest', 'queue-writer', 'status-api'])[user_id % 3 + 1] AS service,
         (['acs-ingest', 'queue-writer', 'status-api'])[user_id % 3 + 1] || '-' || CAST(user_id % 4 AS VARCHAR) AS instance,
         CASE WHEN event_type = 'error' THEN 0.0 ELSE 1.0 END::DOUBLE AS value
  FROM ev)"""
CTE["conns"] = """conns AS (
  SELECT u.instance, u.ts, u.used, l."limit" FROM
    (SELECT 'db-' || CAST(user_id % 3 AS VARCHAR) AS instance, ts, CAST(k * 2 AS DOUBLE) AS used FROM ev) u
  JOIN (SELECT 'db-' || CAST(user_id % 3 AS VARCHAR) AS instance, ts,
               CAST(160 + (user_id % 3) * 20 AS DOUBLE) AS "limit" FROM ev) l
    ON u.instance = l.instance AND u.ts = l.ts)"""
CTE["logs"] = r"""cl AS (
  SELECT ev.*, event_id % 3 AS kind,
         (['status-api', 'acs-ingest', 'queue-writer'])[event_id % 3 + 1] AS svc,
         strftime(date_trunc('hour', ts), '%Y-%m-%dT%H:%M:%SZ') AS hour
  FROM ev),
cl2 AS (
  SELECT *, svc || '-' || CAST(user_id % 4 AS VARCHAR) AS pod0,
         strftime(ts, '%Y/%m/%d %H:%M:%S') || ' ' ||
         CASE kind
           WHEN 0 THEN 'heartbeat updated: sn=' || sn || ' wan_ip=10.0.' || CAST(user_id % 256 AS VARCHAR) || '.'
                       || CAST(k AS VARCHAR) || ' sw_version=v1.' || CAST(k % 3 AS VARCHAR) || ' cpu='
                       || CAST(k AS VARCHAR) || ' mem=' || CAST(99 - k AS VARCHAR)
           WHEN 1 THEN 'enqueued event for SN=' || sn || ' at ' || hour || ' in ' || CAST(k AS VARCHAR) || '.5ms'
           ELSE 'processing ingest_event id=' || CAST(event_id AS VARCHAR) || ' sn=' || sn || ' event_ts=' || hour
         END AS text
  FROM cl),
rawlogs AS (
  SELECT '/var/log/containers/' || pod0 || '_fleet_' || svc || '-' || md5(CAST(user_id AS VARCHAR)) || '.log' AS path,
         ts, CASE WHEN event_id % 2 = 0 THEN '{"message":"' || text || '","level":"info"}' ELSE text END AS line
  FROM cl2),
pods AS (
  SELECT DISTINCT 'fleet' AS namespace,
         (['status-api', 'acs-ingest', 'queue-writer'])[event_id % 3 + 1] || '-' || CAST(user_id % 4 AS VARCHAR) AS pod,
         (['status-api', 'acs-ingest', 'queue-writer'])[event_id % 3 + 1] AS app,
         'node-' || CAST((user_id % 4) % 2 AS VARCHAR) AS node
  FROM ev WHERE user_id % 4 < 3),
jlogs AS (
  SELECT *, json_valid(line) AND json_type(CASE WHEN json_valid(line) THEN line ELSE 'null' END) = 'OBJECT' AS decoded
  FROM rawlogs),
dlogs AS (
  SELECT path, ts, line,
         coalesce(json_extract_string(CASE WHEN decoded THEN line ELSE '{}' END, '$.message'), line) AS message,
         json_extract_string(CASE WHEN decoded THEN line ELSE '{}' END, '$.level') AS level,
         decoded
  FROM jlogs),
elogs AS (
  SELECT x.*, p.app, p.node FROM (
    SELECT *, nullif(regexp_extract(path, '^/var/log/containers/([^_]+)_([^_]+)_(.+)-([0-9a-f]+)\.log$', 1), '') AS pod,
              nullif(regexp_extract(path, '^/var/log/containers/([^_]+)_([^_]+)_(.+)-([0-9a-f]+)\.log$', 2), '') AS namespace,
              nullif(regexp_extract(path, '^/var/log/containers/([^_]+)_([^_]+)_(.+)-([0-9a-f]+)\.log$', 3), '') AS container
    FROM dlogs) x
  LEFT JOIN pods p ON x.namespace = p.namespace AND x.pod = p.pod)"""
CTE["manifests"] = """days AS (SELECT CAST(ts AS DATE) AS d, count(*) AS n FROM ev GROUP BY 1),
src AS (
  SELECT strftime(d, '%Y-%m-%d') || '/fleet-' || strftime(d, '%Y-%m-%d') || '-020000.parquet' AS rel_path,
         'backups/' || strftime(d, '%Y-%m-%d') || '/fleet-' || strftime(d, '%Y-%m-%d') || '-020000.parquet' AS path,
         n * 100 AS bytes, CAST(d AS TIMESTAMP) + INTERVAL 2 HOUR AS modified_at, d AS snapshot_date
  FROM days),
dst AS (
  SELECT strftime(d, '%Y-%m-%d') || '/fleet-' || strftime(d, '%Y-%m-%d') || '-020000.parquet' AS rel_path,
         n * 100 + CASE WHEN day(d) % 5 = 0 THEN 1 ELSE 0 END AS bytes
  FROM days WHERE day(d) % 3 <> 0
  UNION ALL
  SELECT 'legacy/' || strftime(d, '%Y-%m-%d') || '.sql.gz', n FROM days WHERE day(d) % 7 = 0)"""

DEPS = {"ev": [], "hb": ["ev"], "hbc": ["ev"], "status": ["hb"], "statusc": ["hbc"],
        "hist": ["hb"], "histc": ["hbc"], "hbo": ["hbc"], "whc": ["ev"], "whf": ["ev"], "qk": ["whc"],
        "qt": ["qk"], "queue": ["qt"], "backlog_day": ["qt"], "backlog_hour": ["qt"],
        "samples": ["ev"], "replicas": ["ev"], "ups": ["ev"], "conns": ["ev"], "logs": ["ev"],
        "manifests": ["ev"]}


def with_ctes(names: list[str], body: str) -> str:
    order: list[str] = []

    def visit(n):
        for d in DEPS.get(n, []):
            visit(d)
        if n not in order:
            order.append(n)

    for n in names:
        visit(n)
    return "WITH " + ",\n".join(CTE[n] for n in order) + "\n" + body


def grid(ts: str, window_s: int, step_s: int) -> tuple[str, str]:
    """(join clause, T expression): every grid point T whose window
    (T - w, T] holds ``ts``."""
    w, s = window_s * 1_000_000, step_s * 1_000_000
    join = f"CROSS JOIN range(0, {window_s // step_s}) AS g(j)"
    t = f"make_timestamp(((epoch_us({ts}) - 1) // {s}) * {s} - g.j * {s} + {w})"
    return join, t


def filled(src: str, label: str, ts: str, join: str, t: str, value: str, where: str = "TRUE") -> str:
    """Counts per label and grid point up to as_of, holes of a series as zeros."""
    return f"""
, cnt AS (SELECT {t} AS t, {label} AS l, count(*) AS n FROM {src} {join} WHERE {where} GROUP BY 1, 2),
kept AS (SELECT * FROM cnt WHERE t <= {AS_OF_SQL} {{lower}}),
pts AS (SELECT l, unnest(generate_series(min(t), max(t), INTERVAL 1 HOUR)) AS t FROM kept GROUP BY l)
SELECT p.t, p.l AS {{name}}, {value} FROM pts p LEFT JOIN kept k ON k.t = p.t AND k.l = p.l"""


def evaluated(src: str, series: list[str], values: dict[str, str], where: str = "TRUE", step: int = 300, lookback: int = 3600) -> str:
    """Latest value per series in the look-back of every evaluation up to as_of."""
    s = step * 1_000_000
    ser = ", ".join(series)
    t = f"make_timestamp(((epoch_us(ts) - 1) // {s} + 1 + g.j) * {s})"
    cols = ", ".join(f"max({{'ts': ts, 'v': {v}}}).v AS {k}" for k, v in values.items())
    return f"""(SELECT * FROM (SELECT {t} AS t, {ser}, {cols} FROM {src} CROSS JOIN range(0, {lookback // step}) AS g(j)
    WHERE {where} GROUP BY ALL) WHERE t <= {AS_OF_SQL})"""


def acore(src: str, series: list[str], ts: str, cond: str, for_s: float, step_s: int) -> str:
    """Gaps and islands, brute force with unbounded windows per series; a
    missing evaluation ends an island."""
    far = f"epoch_us({{b}}) - epoch_us({{a}}) > {step_s * 1_000_000}"
    ser = ", ".join(series)
    part = f"PARTITION BY {ser}" if series else ""
    part_isl = f"PARTITION BY {ser}, isl" if series else "PARTITION BY isl"
    grp = f"{ser}, pend" if series else "pend"
    return f"""a0 AS (SELECT {ser + ',' if series else ''} {ts} AS ts, coalesce({cond}, FALSE) AS c FROM {src}),
a1 AS (SELECT *, lag(c) OVER w AS pc, lag(ts) OVER w AS pts, lead(ts) OVER w AS nts
       FROM a0 WINDOW w AS ({part} ORDER BY ts)),
a2 AS (SELECT *, sum(CASE WHEN pts IS NULL OR pc <> c OR {far.format(a='pts', b='ts')} THEN 1 ELSE 0 END)
                   OVER ({part} ORDER BY ts ROWS UNBOUNDED PRECEDING) AS isl FROM a1),
a3 AS (SELECT *, min(ts) OVER ({part_isl}) AS pend, max(ts) OVER ({part_isl}) AS lastt FROM a2 WHERE c)
SELECT {ser + ',' if series else ''} pend AS pending_at,
       min(CASE WHEN epoch_us(ts) - epoch_us(pend) >= {int(for_s * 1_000_000)} THEN ts END) AS fired_at,
       max(ts) AS last_true_at, max(CASE WHEN ts = lastt THEN CASE WHEN {far.format(a='ts', b='nts')} THEN ts + INTERVAL {step_s} SECOND ELSE nts END END) AS resolved_at
FROM a3 GROUP BY {grp}
HAVING min(CASE WHEN epoch_us(ts) - epoch_us(pend) >= {int(for_s * 1_000_000)} THEN ts END) IS NOT NULL"""


HB_LINE = r"heartbeat updated: sn=(\S*) wan_ip=(\S*) sw_version=(\S*) cpu=(-?\d+) mem=(-?\d+)"
ENQ_LINE = r"enqueued event for SN=(\S*) at (\S+) in (\S+)"
PROC_LINE = r"processing ingest_event id=(\d+) sn=(\S*) event_ts=(\S+)"
DASH = "https://dashboards.example/d/device?var-sn="
LOGS_URL = "https://logs.example/app/discover?q=sn%3D"


def sql() -> dict[str, str]:
    q: dict[str, str] = {}
    A = AS_OF_SQL
    WIN, STEP = 6 * 3600, 3600
    # ---- H / R
    q["h1_latest_state"] = with_ctes(["status"], "SELECT * FROM status")
    q["r1_page"] = with_ctes(["status"], "SELECT * FROM status ORDER BY lower(sn), sn LIMIT 50 OFFSET 100")
    q["h2_history"] = with_ctes(["hist"], "SELECT * FROM hist")
    q["h2_history_collisions"] = with_ctes(["histc"], "SELECT * FROM histc")
    q["h3_outcomes_collisions"] = with_ctes(["hbo"], "SELECT seq, code, reason FROM hbo")
    q["h3_latest_state_collisions"] = with_ctes(["statusc"], "SELECT * FROM statusc")
    q["h4_merge_state"] = with_ctes(["status"], "SELECT * FROM status")
    q["r2_lookup"] = with_ctes(["status"], """
SELECT r.request_sn, s.sn IS NOT NULL AS found, s.sn, s.last_seen, s.wan_ip, s.sw_version, s.cpu_pct,
       s.mem_pct, s.updated_at
FROM (SELECT DISTINCT lower('CPE-' || lpad(CAST(user_id * 2 AS VARCHAR), 5, '0')) AS request_sn
      FROM ev WHERE event_type = 'view') r
LEFT JOIN status s ON lower(r.request_sn) = lower(s.sn)""")
    q["r3_current_view"] = with_ctes(["status"], """
SELECT sn, wan_ip, sw_version, cpu_pct, mem_pct, strftime(last_seen, '%Y-%m-%d %H:%M:%S') AS last_heartbeat_at
FROM status""")
    q["r4_latest_history_one"] = with_ctes(["hist"], """
SELECT * FROM hist WHERE lower(sn) = 'cpe-00007' ORDER BY event_ts DESC LIMIT 20""")
    q["r6_device_report"] = with_ctes(["status", "hist"], f"""
, top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lower(sn) ORDER BY event_ts DESC) AS rk
                         FROM hist) WHERE rk <= 20)
SELECT coalesce(s.sn, t.sn) AS device, s.sn IS NOT NULL AS found,
       CASE WHEN s.sn IS NULL THEN 'SN not found' END AS error,
       s.wan_ip, s.sw_version, s.cpu_pct, s.mem_pct,
       strftime(s.last_seen, '%Y-%m-%d %H:%M:%S') AS last_heartbeat_at,
       CAST(t.rk AS INTEGER) AS rank, strftime(t.event_ts, '%Y-%m-%d %H:%M:%S') AS heartbeat_at,
       t.wan_ip AS h_wan_ip, t.cpu_pct AS h_cpu_pct, t.mem_pct AS h_mem_pct,
       '{DASH}' || replace(url_encode(coalesce(s.sn, t.sn)), '%20', '+') AS dashboard_url,
       '{LOGS_URL}' || replace(url_encode(coalesce(s.sn, t.sn)), '%20', '+') AS logs_url
FROM status s FULL OUTER JOIN top t ON lower(s.sn) = lower(t.sn)""")
    # ---- V / M
    q["v1_hmac"] = with_ctes(["whc"], f"SELECT seq, {HMAC} AS hmac FROM whb")
    q["v8_webhook_outcomes"] = with_ctes(["whc"], """
SELECT seq, code, reason, CASE WHEN code IN (202, 500) THEN jsn END AS sn,
       CASE WHEN code IN (202, 500) THEN jevent_ts END AS event_ts FROM whc""")
    q["v9_heartbeat_outcomes"] = with_ctes(["hb"], f"""
SELECT h.seq, h.code, h.reason, b.sn, {rms('b.last_seen')} AS last_seen, b.wan_ip, b.sw_version,
       CAST(b.cpu_pct AS BIGINT) AS cpu_pct, CAST(b.mem_pct AS BIGINT) AS mem_pct
FROM hb_all h LEFT JOIN hb_all b ON b.seq = h.seq AND b.code IN (202, 500)""")
    q["m1_webhook_requests"] = with_ctes(["whc"], "SELECT code, count(*) AS requests FROM whc WHERE code <> 413 GROUP BY code")
    q["m2_webhook_errors"] = with_ctes(["whc"], """
SELECT reason, count(*) AS errors FROM whc WHERE reason IS NOT NULL AND code <> 413 GROUP BY reason""")
    q["m3_api_requests"] = with_ctes(["hbo", "status"], """
, lk AS (SELECT CASE WHEN s.sn IS NULL THEN 404 ELSE 200 END AS code
         FROM (SELECT DISTINCT lower('CPE-' || lpad(CAST(user_id * 2 AS VARCHAR), 5, '0')) AS request_sn
               FROM ev WHERE event_type = 'view') r
         LEFT JOIN status s ON lower(r.request_sn) = lower(s.sn))
SELECT code, count(*) AS requests FROM (SELECT code FROM api UNION ALL SELECT code FROM lk
  UNION ALL SELECT 200 FROM ev WHERE event_type = 'signup' UNION ALL SELECT 200 FROM ev WHERE event_id % 10 = 0) GROUP BY code""")
    q["v2_signed_bodies"] = with_ctes(["ev"], f"""
, b AS (SELECT event_id AS seq, '{{' || array_to_string(list_filter([
    '"cpu_pct":' || CAST(CASE WHEN event_type <> 'error' THEN k END AS VARCHAR), '"mem_pct":' || CAST(CASE WHEN event_type <> 'click' THEN 99 - k END AS VARCHAR),
    '"sn":"' || sn || '"', '"sw_version":"v1.' || CAST(k % 3 AS VARCHAR) || '"',
    '"wan_ip":"' || CASE WHEN event_type <> 'view' THEN '10.0.' || CAST(user_id % 256 AS VARCHAR) || '.' || CAST(k AS VARCHAR) END || '"'],
    lambda x: x IS NOT NULL), ',') || '}}' AS body FROM ev)
SELECT seq, body, {HMAC} AS signature FROM b""")
    q["v12_violations"] = with_ctes(["hb"], """
SELECT 'heartbeat' AS "table", CASE WHEN length(sn) > 64 THEN 'sn_too_long' ELSE 'cpu_pct_range' END AS rule, count(*) AS rows
FROM hb_all WHERE code = 500 GROUP BY ALL""")
    q["q13_paging"] = """
WITH r AS (SELECT event_id AS seq, k, CASE k % 4 WHEN 1 THEN CAST(k AS VARCHAR) WHEN 2 THEN '-3' WHEN 3 THEN 'x' END AS o,
    CASE k % 5 WHEN 1 THEN '0' WHEN 2 THEN CAST(k * 10 AS VARCHAR) WHEN 3 THEN '501' WHEN 4 THEN '+20' END AS l
  FROM (SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events) WHERE event_type = 'signup'),
n AS (SELECT seq, CASE WHEN regexp_full_match(o, '[+-]?[0-9]+') THEN TRY_CAST(o AS BIGINT) END AS o,
    CASE WHEN regexp_full_match(l, '[+-]?[0-9]+') THEN TRY_CAST(ltrim(l, '+') AS BIGINT) END AS l FROM r)
SELECT seq, CASE WHEN o >= 0 THEN o ELSE 0 END AS page_offset, CASE WHEN l BETWEEN 1 AND 500 THEN l ELSE 50 END AS page_limit FROM n"""
    q["r8_ad_hoc_sql"] = """
SELECT n_name, event_type, count(*) AS events, count(DISTINCT user_id) AS users
FROM events JOIN customer ON c_custkey = user_id JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name, event_type"""
    q["m4_heartbeats_per_device"] = with_ctes(["hb"], "SELECT sn, count(*) AS heartbeats FROM hb_all WHERE code IN (202, 500) GROUP BY sn")
    q["m5_m6_gauges"] = with_ctes(["hb"], """
SELECT sn, CAST(arg_max(cpu_pct, seq) FILTER (WHERE cpu_pct IS NOT NULL) AS BIGINT) AS cpu_pct,
       CAST(arg_max(mem_pct, seq) FILTER (WHERE mem_pct IS NOT NULL) AS BIGINT) AS mem_pct
FROM hb_all WHERE code IN (202, 500) GROUP BY sn""")
    # ---- Q
    q["q1_enqueue"] = with_ctes(["qk"], f"""
SELECT id, 'acs' AS source, sn, event_ts, payload, 'queued' AS status, CAST(0 AS INTEGER) AS attempts,
       {rs('last_at')} AS next_at, {rs('created_raw')} AS created_at, {rs('last_at')} AS updated_at
FROM qk""")
    q["q_fold"] = with_ctes(["queue"], "SELECT * FROM queue")
    q["q2_ready"] = with_ctes(["queue"], f"""
SELECT * FROM queue WHERE status = 'queued' AND next_at <= {A} ORDER BY id LIMIT 50""")
    q["q3_claim"] = with_ctes(["queue"], f"""
, c AS (SELECT DISTINCT id FROM (
    SELECT id FROM (SELECT id FROM queue WHERE status = 'queued' AND next_at <= {A} ORDER BY id LIMIT 500)
    UNION ALL SELECT id FROM queue WHERE status = 'done'))
SELECT q.id, {A} AS "at", CAST(0 AS BIGINT) AS seq, 'processing' AS status,
       CAST(q.attempts + 1 AS INTEGER) AS attempts, CAST(NULL AS TIMESTAMP) AS next_at,
       CAST(NULL AS VARCHAR) AS reason
FROM c JOIN queue q USING (id) WHERE q.status = 'queued'""")
    q["q4_complete"] = with_ctes(["queue"], f"""
SELECT id, {A} AS "at", CAST(1 AS BIGINT) AS seq, 'done' AS status, attempts, CAST(NULL AS TIMESTAMP) AS next_at, CAST(NULL AS VARCHAR) AS reason
FROM queue WHERE status = 'processing'""")
    q["q5_fail_writer"] = with_ctes(["queue"], f"""
SELECT id, {A} AS "at", CAST(1 AS BIGINT) AS seq,
       CASE WHEN attempts >= 5 THEN 'dead' ELSE 'queued' END AS status, CAST(attempts AS INTEGER) AS attempts,
       CASE WHEN attempts < 5 THEN {A} + to_seconds(LEAST(300, 5 * (1 << attempts))) END AS next_at,
       'timeout' AS reason
FROM queue WHERE status = 'processing'""")
    q["q7_fail_queue"] = with_ctes(["queue"], f"""
SELECT id, {A} AS "at", CAST(1 AS BIGINT) AS seq,
       CASE WHEN attempts + 1 >= 5 THEN 'dead' ELSE 'queued' END AS status,
       CAST(attempts + 1 AS INTEGER) AS attempts,
       CASE WHEN attempts + 1 < 5 THEN {A} + to_seconds(5 * (1 << attempts)) END AS next_at,
       'timeout' AS reason
FROM queue WHERE status = 'processing'""")
    q["q8_drain"] = with_ctes(["queue"], f"""
, r AS (SELECT * FROM queue WHERE status = 'queued' AND next_at <= {A} ORDER BY id LIMIT 50)
SELECT id, {A} AS "at", CAST(0 AS BIGINT) AS seq, 'processing' AS status, CAST(attempts + 1 AS INTEGER) AS attempts,
       CAST(NULL AS TIMESTAMP) AS next_at, CAST(NULL AS VARCHAR) AS reason FROM r
UNION ALL
SELECT id, {A}, CAST(1 AS BIGINT), 'done', CAST(attempts + 1 AS INTEGER), CAST(NULL AS TIMESTAMP),
       CAST(NULL AS VARCHAR) FROM r""")
    q["q9_depth"] = with_ctes(["queue"], f"""
SELECT status, count(*) AS events, count(*) FILTER (WHERE status = 'queued' AND next_at <= {A}) AS ready
FROM queue GROUP BY status""")
    q["q10_lag"] = with_ctes(["queue"], f"""
SELECT count(*) AS open_events, min(created_at) AS oldest_created_at,
       CAST(epoch({A}) - epoch(min(created_at)) AS BIGINT) AS lag_seconds
FROM queue WHERE status IN ('queued', 'processing')""")
    q["q11_backlog"] = with_ctes(["backlog_day"], "SELECT * FROM backlog_day")
    q["q12_purge"] = with_ctes(["queue"], f"""
SELECT id, status, updated_at,
       CASE WHEN status = 'done' AND updated_at < {A} - INTERVAL 14 DAY THEN 'archive' ELSE 'keep' END AS action
FROM queue""")
    q["m8_m10_writer_counters"] = with_ctes(["qt"], """
SELECT 'writer_events_processed_total' AS metric, '' AS label, count(*) AS value
FROM qt WHERE status = 'done' HAVING count(*) > 0
UNION ALL
SELECT 'writer_events_failed_total', reason, count(*) FROM qt WHERE reason IS NOT NULL GROUP BY reason
UNION ALL
SELECT 'writer_events_dead_total', '', count(*) FROM qt WHERE status = 'dead' HAVING count(*) > 0""")
    # ---- W
    j, t = grid("received_at", WIN, STEP)
    rate = f"coalesce(k.n, 0) / {float(WIN)} AS rate"
    q["w1_rate_by_code_events"] = with_ctes(["whc"], filled("whc", "CAST(code AS VARCHAR)", "received_at", j, t, rate, "code <> 413")
                                            .format(lower="", name="code"))
    q["w8_last_day_rate"] = with_ctes(["whc"], filled("whc", "CAST(code AS VARCHAR)", "received_at", j, t, rate, "code <> 413")
                                      .format(lower=f"AND t >= {A} - INTERVAL 1 DAY", name="code"))
    q["w2_rate_by_reason"] = with_ctes(["whc"], filled("whc", "reason", "received_at", j, t, rate, "reason IS NOT NULL AND code <> 413")
                                       .format(lower="", name="reason"))
    q["w3_api_rate_by_code"] = with_ctes(["hbo"], filled("api", "CAST(code AS VARCHAR)", "received_at", j, t, rate)
                                         .format(lower="", name="code"))
    q["w6_error_pct"] = with_ctes(["hbo"], f"""
SELECT {t} AS t, count(*) FILTER (WHERE regexp_full_match(CAST(code AS VARCHAR), '5..'))::DOUBLE
                 / count(*)::DOUBLE * 100.0 AS pct
FROM api {j} WHERE {t} <= {A} GROUP BY 1""")
    jt, tt = grid('"at"', WIN, STEP)
    q["w4_writer_increase"] = with_ctes(["qt"], f"""
, x AS (SELECT "at", CASE status WHEN 'done' THEN 'processed' WHEN 'dead' THEN 'dead' END AS metric
        FROM qt WHERE status IN ('done', 'dead')
        UNION ALL SELECT "at", 'failed' FROM qt WHERE reason IS NOT NULL)
""" + filled("x", "metric", '"at"', jt, tt, "CAST(coalesce(k.n, 0) AS DOUBLE) AS increase").format(lower="", name="metric"))
    js, ts_ = grid("ts", WIN, STEP)
    q["w1_rate_by_code_samples"] = with_ctes(["samples"], f"""
, d AS (SELECT *, lag(ts) OVER w AS prev_ts,
               CASE WHEN lag(value) OVER w IS NULL THEN NULL
                    WHEN value < lag(value) OVER w THEN value ELSE value - lag(value) OVER w END AS delta
        FROM samples WINDOW w AS (PARTITION BY metric, code, instance ORDER BY ts)),
ps AS (SELECT {ts_} AS t, code, instance, count(*) AS n,
              sum(CASE WHEN prev_ts > {ts_} - INTERVAL {WIN} SECOND THEN delta END) AS inc
       FROM d {js} GROUP BY 1, 2, 3)
SELECT t, code, sum(coalesce(inc, 0.0)) / {float(WIN)} AS rate FROM ps WHERE n >= 2 AND t <= {A} GROUP BY t, code""")
    ju, tu = grid("ts", 3600, 3600)
    q["w5_service_up"] = with_ctes(["ups"], f"""
, per AS (SELECT {tu} AS t, namespace, service, instance, arg_max(value, ts) AS v
          FROM ups {ju} WHERE namespace = 'fleet'
            AND regexp_full_match(service, 'acs-ingest|queue-writer|status-api') GROUP BY 1, 2, 3, 4)
SELECT t, service, sum(v) AS up FROM per WHERE t <= {A} GROUP BY t, service""")
    # ---- A
    nd = ["namespace", "deployment"]
    q["a1_service_down"] = with_ctes(["replicas"], ", " + acore(
        evaluated("replicas", nd, {"value": "value"}, "namespace = 'fleet' AND deployment IN ('acs-ingest', 'queue-writer')"),
        nd, "t", "value < 1", 60, 300))
    q["a3_database_down"] = with_ctes(["replicas"], ", " + acore(
        evaluated("replicas", nd, {"value": "value"}, "namespace = 'fleet' AND deployment = 'database'"),
        nd, "t", "value < 1", 120, 300))
    q["a5_connections_high"] = with_ctes(["conns"], ", " + acore(
        evaluated("conns", ["instance"], {"used": "used", '"limit"': '"limit"'}), ["instance"], "t", "used / \"limit\" > 0.8", 300, 300))
    q["a2_high_error_rate"] = with_ctes(["hbo"], f"""
, pct AS (SELECT 'HighErrorRate' AS rule, {t} AS t,
                 count(*) FILTER (WHERE regexp_full_match(CAST(code AS VARCHAR), '5..'))::DOUBLE
                 / count(*)::DOUBLE * 100.0 AS pct FROM api {j} WHERE {t} <= {A} GROUP BY 2),
""" + acore("pct", ["rule"], "t", "pct > 5", 600, 3600))
    q["a4_backlog_high"] = with_ctes(["backlog_hour"], """
, bl AS (SELECT 'QueueBacklog' AS rule, * FROM backlog_hour),
""" + acore("bl", ["rule"], "bucket_end", "open_events > 40", 3 * 3600, 3600))
    q["a6_rendered_annotations"] = f"""
SELECT namespace, deployment, pending_at,
       'No replica of ' || deployment || ' in ' || namespace || ' was ready over a whole minute' AS description
FROM ({q['a1_service_down']})"""
    # ---- L
    q["l0_service_log_lines"] = with_ctes(["hb", "queue"], """
SELECT received_at AS ts, 'status-api' AS service,
       'heartbeat updated: sn=' || sn || ' wan_ip=' || coalesce(wan_ip, '') || ' sw_version='
       || coalesce(sw_version, '') || ' cpu=' || CAST(coalesce(cpu_pct, 0) AS VARCHAR)
       || ' mem=' || CAST(coalesce(mem_pct, 0) AS VARCHAR) AS message
FROM hb
UNION ALL
SELECT t."at", 'queue-writer',
       'processing ingest_event id=' || CAST(t.id AS VARCHAR) || ' sn=' || q.sn || ' event_ts='
       || regexp_replace(strftime(q.event_ts, '%Y-%m-%dT%H:%M:%S.%f'), '\\.?0+$', '') || 'Z'
FROM qt t JOIN queue q USING (id) WHERE t.status = 'processing'""")
    q["l1_l2_decoded_enriched"] = with_ctes(["logs"], """
SELECT path, ts, message, level, decoded, namespace, pod, container, app, node FROM elogs""")
    q["l4_search_prefix"] = with_ctes(["logs"], """
SELECT ts, pod, message FROM elogs
WHERE namespace = 'fleet' AND starts_with(pod, 'acs-ingest-')
  AND regexp_matches(message, '(?i)(^|[^A-Za-z0-9_])enqueued')
ORDER BY ts DESC, path, message LIMIT 5""")
    q["l5_search_sn"] = with_ctes(["logs"], f"""
SELECT ts, pod, message FROM elogs
WHERE ts > {A} - INTERVAL 3 DAY AND ts <= {A}
  AND regexp_matches(message, '(?i)(^|[^A-Za-z0-9_.-])sn=CPE-00001($|[^A-Za-z0-9_.-])')""")
    q["l6_extract"] = with_ctes(["logs"], f"""
SELECT path, ts,
       CASE WHEN regexp_matches(message, '{HB_LINE}') THEN 'heartbeat'
            WHEN regexp_matches(message, '{ENQ_LINE}') THEN 'enqueue'
            WHEN regexp_matches(message, '{PROC_LINE}') THEN 'process' END AS kind,
       coalesce(nullif(regexp_extract(message, '{HB_LINE}', 1), ''),
                nullif(regexp_extract(message, '{ENQ_LINE}', 1), ''),
                nullif(regexp_extract(message, '{PROC_LINE}', 2), '')) AS sn,
       nullif(regexp_extract(message, '{HB_LINE}', 2), '') AS wan_ip,
       nullif(regexp_extract(message, '{HB_LINE}', 3), '') AS sw_version,
       TRY_CAST(nullif(regexp_extract(message, '{HB_LINE}', 4), '') AS INTEGER) AS cpu,
       TRY_CAST(nullif(regexp_extract(message, '{HB_LINE}', 5), '') AS INTEGER) AS mem,
       TRY_CAST(nullif(regexp_extract(message, '{PROC_LINE}', 1), '') AS BIGINT) AS event_id,
       coalesce(nullif(regexp_extract(message, '{ENQ_LINE}', 2), ''),
                nullif(regexp_extract(message, '{PROC_LINE}', 3), '')) AS event_time
FROM dlogs""")
    q["l8_index_sizes"] = with_ctes(["logs"], """
SELECT CAST(ts AS DATE) AS log_date, count(*) AS docs, CAST(sum(strlen(line)) AS BIGINT) AS bytes
FROM rawlogs GROUP BY 1""")
    q["l7_expired_indices"] = with_ctes(["logs"], f"""
SELECT * FROM (SELECT CAST(ts AS DATE) AS log_date, count(*) AS docs, CAST(sum(strlen(line)) AS BIGINT) AS bytes
               FROM rawlogs GROUP BY 1)
WHERE log_date < CAST({A} AS DATE) - INTERVAL 14 DAY""")
    # ---- K
    q["k3_expired_snapshots"] = with_ctes(["manifests"], f"""
SELECT path, bytes, modified_at FROM src WHERE modified_at < {A} - INTERVAL 7 DAY""")
    q["k4_mirror_plan"] = with_ctes(["manifests"], """
SELECT s.rel_path, s.bytes,
       CASE WHEN d.bytes IS NULL THEN 'copy_new' WHEN d.bytes <> s.bytes THEN 'overwrite' ELSE 'skip' END AS action
FROM src s LEFT JOIN dst d ON s.rel_path = d.rel_path""")
    q["s6_latest_snapshot"] = with_ctes(["manifests"], """
SELECT path, snapshot_date FROM src ORDER BY snapshot_date DESC, modified_at DESC, path DESC LIMIT 1""")
    # ---- stored tables and streams: the result of the batch plan
    outcomes = """
SELECT seq, code, reason, CASE WHEN code IN (202, 500) THEN jsn END AS sn, CASE WHEN code IN (202, 500) THEN jevent_ts END AS event_ts FROM whc"""
    q["s1_arrival_files"] = with_ctes(["whf"], outcomes + " WHERE code <> 413")
    q["s2_webhook_stream"] = with_ctes(["whf"], outcomes)
    q["s2_heartbeat_stream"] = q["h3_outcomes_collisions"]
    q["s5_container_log_files"] = with_ctes(["logs"], "SELECT ts, line FROM rawlogs")
    q["h4_stored_state"] = q["h1_latest_state"]
    q["q8_open_store"] = q["q8_drain"]
    q["q_stored_queue"] = with_ctes(["queue"], f"""
, r AS (SELECT id FROM queue WHERE status = 'queued' AND next_at <= {A} ORDER BY id LIMIT 50)
SELECT q.id, source, sn, event_ts, payload, CASE WHEN r.id IS NULL THEN status ELSE 'done' END AS status,
       CASE WHEN r.id IS NULL THEN attempts ELSE attempts + 1 END AS attempts, next_at, created_at,
       CASE WHEN r.id IS NULL THEN updated_at ELSE {A} END AS updated_at
FROM queue q LEFT JOIN r ON r.id = q.id""")
    q["m7_writer_runs"] = with_ctes(["qk"], f"""
SELECT CAST(3 AS BIGINT) AS writer_runs_total, CAST(least(120, count(*)) AS BIGINT) AS drained_total FROM qk WHERE last_at <= {A}""")
    q["q5_retry_stream"] = with_ctes(["qk"], """
, plan AS (SELECT id, created_raw, id % 5 AS m, CASE id % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 5 WHEN 4 THEN 3 ELSE 0 END AS results FROM qk),
claims AS (
  SELECT id, m, results, unnest(generate_series(1, CASE WHEN m IN (0, 1, 2) THEN results ELSE results + 1 END)) AS n, created_raw FROM plan),
timed AS (
  SELECT *, created_raw + to_seconds(5 * (n - 1) + 5 * ((1 << n) - 2)) AS claimed FROM claims)
SELECT id, claimed AS "at", CAST(2 * (n - 1) AS BIGINT) AS seq, 'processing' AS status, CAST(n AS INTEGER) AS attempts,
       CAST(NULL AS TIMESTAMP) AS next_at, CAST(NULL AS VARCHAR) AS reason FROM timed
UNION ALL
SELECT id, claimed + INTERVAL 5 SECOND, 2 * n - 1,
       CASE WHEN m = 0 OR (m = 1 AND n = 2) THEN 'done' WHEN n >= 5 THEN 'dead' ELSE 'queued' END, CAST(n AS INTEGER),
       CASE WHEN m = 0 OR (m = 1 AND n = 2) OR n >= 5 THEN NULL ELSE claimed + to_seconds(5 + 5 * (1 << n)) END,
       CASE WHEN m = 0 OR (m = 1 AND n = 2) THEN NULL ELSE 'timeout' END
FROM timed WHERE n <= results""")
    q["q1_resent_within_bound"] = with_ctes(["whf"], """
SELECT jsn AS sn, jevent_ts AS event_ts, CAST(1 AS BIGINT) AS kept FROM (
  SELECT jsn, jevent_ts FROM whc WHERE code = 202
  UNION ALL SELECT jsn, CASE WHEN jets IS NULL OR try_strptime(jets, '%Y-%m-%dT%H:%M:%SZ') IS NULL THEN jevent_ts + INTERVAL 20 MINUTE ELSE jevent_ts END
  FROM (SELECT c.*, v.jets FROM whc c JOIN whv v ON v.seq = c.seq) WHERE code = 202) GROUP BY ALL""")
    q["w1_stored_rollup"] = q["w1_rate_by_code_samples"]
    q["a1_carried_alerts"] = q["a1_service_down"]
    q["l5_indexed_search"] = q["l5_search_sn"]
    q["k1_k5_restored_status"] = q["h1_latest_state"]
    q["k2_export_counts"] = with_ctes(["status", "hist"], """
SELECT 'status' AS "table", count(*) AS rows FROM status UNION ALL SELECT 'history', count(*) FROM hist""")
    return q
