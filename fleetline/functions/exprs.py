"""Column expressions shared by the operators.

All of them are built-in Spark SQL expressions (no Python UDF), so they run
inside whole-stage codegen on the executors.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

__all__ = [
    "col_of", "hmac_pads", "hmac_sha256_hex", "signature_ok", "parse_json_body",
    "parsed_once", "decoded_fields", "is_string_or_null", "is_int_or_null", "rfc3339",
    "round_ms", "round_s", "backoff_seconds", "normalize_page", "normalize_batch",
    "query_escape", "deep_link", "format_go_datetime", "format_rfc3339_nano",
    "page_columns", "canonical_json", "decoded_once", "idiv",
]


def col_of(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def decoded_once(df: DataFrame, fields: Column, name: str) -> DataFrame:
    """Adds the struct ``fields`` as column ``name``, made once per row.

    The optimizer copies a projected expression into every filter and column
    that uses it, which would decode a body again for each field.  A generator
    of one row is not copied, and unlike a non-deterministic column it lets a
    filter on the other columns through to the scan.  Within ``fields`` nothing
    is shared: what several of them use must be a step of its own."""
    return df.select("*", F.explode(F.array(fields)).alias(name))


def idiv(a, b) -> Column:
    """Integral division (SQL ``a div b``)."""
    return F.call_function("div", col_of(a), b if isinstance(b, Column) else F.lit(b))


# --------------------------------------------------------------------------
# HMAC-SHA256 (RFC 2104) from sha2/unhex/concat: no UDF, stays in codegen.
# --------------------------------------------------------------------------
_BLOCK = 64


def hmac_pads(secret: str | bytes) -> tuple[bytes, bytes]:
    """Inner and outer padded keys for HMAC-SHA256.  Keys longer than the
    block are hashed first, shorter ones are zero-filled (RFC 2104)."""
    key = secret.encode("utf-8") if isinstance(secret, str) else bytes(secret)
    if len(key) > _BLOCK:
        key = hashlib.sha256(key).digest()
    key = key.ljust(_BLOCK, b"\0")
    return bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)


def hmac_sha256_hex(body, secret: str | bytes) -> Column:
    """Lowercase hex HMAC-SHA256 of ``body`` (string = its UTF-8 bytes)."""
    ipad, opad = hmac_pads(secret)
    data = col_of(body).cast("binary")
    inner = F.unhex(F.sha2(F.concat(F.lit(bytearray(ipad)), data), 256))
    return F.sha2(F.concat(F.lit(bytearray(opad)), inner), 256)


def signature_ok(body, signature, secret: str | bytes) -> Column:
    """Missing or empty signature is accepted; otherwise byte-exact compare
    with the lowercase hex digest (so uppercase hex fails)."""
    sig = col_of(signature)
    return F.when(F.coalesce(sig, F.lit("")) == "", F.lit(True)).otherwise(
        sig == hmac_sha256_hex(body, secret))


# --------------------------------------------------------------------------
# JSON decoding with the reference decoder's strictness.
# --------------------------------------------------------------------------
# The body is wrapped as  [ <body> , "<digest of the body>" ].  It is one
# well-formed JSON value iff the wrapper parses to an array of exactly two
# elements whose second is that digest: trailing bytes, a missing value or a
# second value all break that shape, and no body can contain its own digest.


def parse_json_body(body, strict_tail: bool = True) -> tuple[Column, Column]:
    """Return ``(well_formed, value)``; ``value`` is a VARIANT of the first
    JSON value (NULL when not well formed).

    strict_tail=True: the whole body must be exactly one JSON value
    (webhook decoder).  strict_tail=False: only the first value is read,
    trailing bytes are ignored (heartbeat decoder)."""
    b = col_of(body)
    if strict_tail:
        digest = F.sha2(b.cast("binary"), 256)
        wrapped = F.try_parse_json(F.concat(F.lit("["), b, F.lit(',"'), digest, F.lit('"]')))
        arr = F.try_variant_get(wrapped, "$", "array<variant>")
        ok = (F.coalesce(F.size(arr), F.lit(0)) == 2) & (
            F.coalesce(F.try_variant_get(wrapped, "$[1]", "string"), F.lit("")) == digest)
        value = F.when(ok, F.variant_get(wrapped, "$[0]", "variant"))
        return ok, value
    value = F.try_parse_json(b)
    return value.isNotNull(), value


def parsed_once(df: DataFrame, body, strict_tail: bool, name: str) -> DataFrame:
    """Adds the struct ``name``: ``doc``, the parsed VARIANT, and ``ok`` (well
    formed), with the body parsed once per row.  With ``strict_tail`` the value
    is the element ``$[0]`` of ``doc``, else ``doc`` itself."""
    b = col_of(body)
    if strict_tail:
        df = decoded_once(df, F.struct(F.sha2(b.cast("binary"), 256).alias("sum")), f"{name}0")
        digest = F.col(f"{name}0.sum")
        parsed = F.try_parse_json(F.concat(F.lit("["), b, F.lit(',"'), digest, F.lit('"]')))
    else:
        parsed = F.try_parse_json(b)
    df = decoded_once(df, F.struct(parsed.alias("doc")), f"{name}1")
    doc = F.col(f"{name}1.doc")
    ok = doc.isNotNull()
    if strict_tail:
        ok = (F.coalesce(F.try_variant_get(doc, "$[1]", "string"), F.lit("")) == digest) & F.try_variant_get(doc, "$[2]", "variant").isNull()
    return df.withColumn(name, F.struct(F.coalesce(ok, F.lit(False)).alias("ok"), doc.alias("doc"))).drop(f"{name}0", f"{name}1")


def decoded_fields(df: DataFrame, body, names: tuple[str, ...], strict_tail: bool, name: str) -> DataFrame:
    """Adds the struct ``name``: ``ok`` (well formed), ``is_object``, ``is_null``
    (JSON null) and each of ``names`` as VARIANT (SQL NULL when absent).

    Every step that later ones read more than once is a ``decoded_once`` of its
    own, as a generator has no common subexpressions: the digest, the parsed
    value, then the fields.  A key matches ignoring case, and of several
    matching keys the last one in the body counts, as in the reference decoder;
    a VARIANT does not keep the order of its keys, so the body gives it.  All
    that is looked at only where one test finds another spelling in the body."""
    b, any_of = col_of(body), "|".join(names)
    df = parsed_once(df, b, strict_tail, f"{name}p")
    ok, doc, root = F.col(f"{name}p.ok"), F.col(f"{name}p.doc"), "$[0]" if strict_tail else "$"
    # well-formed JSON is an object iff it starts like one
    is_object = F.startswith(F.ltrim(b, F.lit(" \t\r\n")), F.lit("{"))
    # no other spelling anywhere in the body, not even an escaped one: the exact key is all there can be
    df = decoded_once(df, F.struct((F.rlike(b, F.lit(f'"(?!(?:{any_of})")(?iu:{any_of})"')) | F.contains(b, F.lit("\\u"))).alias("other")), f"{name}o")
    other = F.col(f"{name}o.other")
    as_map = F.try_variant_get(doc, root, "map<string,variant>")

    def field(n: str) -> Column:
        # fixed values: the two letters beyond ASCII that fold to an ASCII letter
        matches = lambda k: F.lower(F.translate(k, "\u017f\u212a", "sk")) == F.lit(n.lower())
        last = F.element_at(F.filter(F.json_object_keys(b), matches), -1)
        keys = F.filter(F.map_keys(as_map), matches)
        folded = F.when(F.size(keys) > 1, F.try_element_at(as_map, last)).otherwise(F.try_element_at(as_map, F.get(keys, F.lit(0))))
        return F.when(other, folded).otherwise(F.try_variant_get(doc, f"{root}.{n}", "variant")).alias(n)

    fields = F.struct(ok.alias("ok"), (ok & is_object).alias("is_object"),
                      (ok & F.coalesce(F.is_variant_null(F.try_variant_get(doc, root, "variant")), F.lit(False))).alias("is_null"),
                      *[field(n) for n in names])
    return decoded_once(df, fields, name).drop(f"{name}p", f"{name}o")


def is_string_or_null(field) -> Column:
    return F.coalesce(F.schema_of_variant(col_of(field)), F.lit("VOID")).isin("STRING", "VOID")


def is_int_or_null(field) -> Column:
    """A Go ``int`` accepts only integral JSON numbers in int64 range;
    5.0 (DECIMAL), 1e2 (DOUBLE), "5" and 2^64 (DECIMAL(20,0)) fail."""
    return F.coalesce(F.schema_of_variant(col_of(field)), F.lit("VOID")).isin("BIGINT", "VOID", "INT", "SMALLINT", "TINYINT")


# --------------------------------------------------------------------------
# Time
# --------------------------------------------------------------------------
# Fixed value: the RFC 3339 shape accepted by the reference's time parser.
RFC3339_PATTERN = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}([.,]\d+)?(Z|[+-]\d{2}:\d{2})$"


def rfc3339(s) -> Column:
    """Strict RFC 3339 (with optional fraction, ',' or '.') to UTC
    TIMESTAMP_NTZ; NULL when the string does not match or names a day that
    does not exist.  Fractions beyond microseconds are truncated."""
    s = col_of(s)
    fixed = F.regexp_replace(s, ",", ".")
    parsed = fixed.try_cast("timestamp")
    return F.when(s.rlike(RFC3339_PATTERN), parsed).cast("timestamp_ntz")


def _micros(ts) -> Column:
    return F.unix_micros(col_of(ts).cast("timestamp"))


def round_ms(ts) -> Column:
    """DATETIME(3) storage: round half up to the millisecond."""
    ms = idiv(_micros(ts) + F.lit(500), 1000)
    return F.timestamp_millis(ms).cast("timestamp_ntz")


def round_s(ts) -> Column:
    """DATETIME(0) storage: round half up to the second."""
    s = idiv(_micros(ts) + F.lit(500_000), 1_000_000)
    return F.timestamp_seconds(s).cast("timestamp_ntz")


def backoff_seconds(attempts, base: int = 5, cap: int | None = 300,
                    offset: int = 0) -> Column:
    """``base * 2^(attempts - offset)`` seconds, capped at ``cap`` (None: no
    cap).  The exponent is clamped to [0, 40] so the shift never wraps; with
    the five attempts of the queue policy it stays far below."""
    n = F.least(F.greatest(col_of(attempts) - F.lit(offset), F.lit(0)), F.lit(40))
    raw = F.lit(base).cast("long") * F.call_function("shiftleft", F.lit(1).cast("long"), n.cast("int"))
    return raw if cap is None else F.least(raw, F.lit(cap).cast("long"))


def format_go_datetime(ts) -> Column:
    """Go layout ``2006-01-02 15:04:05``."""
    return F.date_format(col_of(ts), "yyyy-MM-dd HH:mm:ss")


def format_rfc3339_nano(ts) -> Column:
    """Go ``time.RFC3339Nano`` for a UTC time: fraction without trailing
    zeros, none at all when zero, suffix ``Z``."""
    s = F.date_format(col_of(ts), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    s = F.regexp_replace(s, r"\.?0+$", "")
    return F.concat(s, F.lit("Z"))


# --------------------------------------------------------------------------
# Parameters and links
# --------------------------------------------------------------------------
_INT_RE = re.compile(r"^[+-]?\d+$")


def _atoi(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return None
    if isinstance(v, int):
        return v
    s = str(v)
    return int(s) if _INT_RE.match(s) else None


def normalize_page(offset, limit, default_limit: int = 50, max_limit: int = 500) -> tuple[int, int]:
    """List paging parameters: bad or negative offset -> 0; bad, <=0 or
    > max limit -> the default (not the maximum)."""
    o = _atoi(offset)
    o = 0 if o is None or o < 0 else o
    n = _atoi(limit)
    n = default_limit if n is None or n <= 0 or n > max_limit else n
    return o, n


def page_columns(offset, limit, default_limit: int = 50, max_limit: int = 500) -> tuple[Column, Column]:
    """``normalize_page`` over columns of query text, one request per row."""
    number = lambda c: F.when(col_of(c).rlike(_INT_RE.pattern), col_of(c).try_cast("long"))
    o, n = number(offset), number(limit)
    return (F.when(o > 0, o).otherwise(F.lit(0).cast("long")),
            F.when((n > 0) & (n <= max_limit), n).otherwise(F.lit(default_limit).cast("long")))


def normalize_batch(size, default: int = 50) -> int:
    """Writer batch size / fetch limit: invalid or <= 0 -> 50."""
    n = _atoi(size)
    return default if n is None or n <= 0 else n


def query_escape(s) -> Column:
    """Go ``url.QueryEscape``: space -> '+', unreserved ``A-Za-z0-9-_.~``
    kept, everything else percent-encoded (Java's encoder differs on '~'
    and '*', fixed up here)."""
    enc = F.url_encode(col_of(s))
    return F.replace(F.replace(enc, F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def deep_link(template: str | None, sn) -> Column:
    """``fmt.Sprintf(template, QueryEscape(sn))``; empty template -> NULL."""
    if not template:
        return F.lit(None).cast("string")
    return F.format_string(template, query_escape(sn))


def canonical_json(*cols: str) -> Column:
    """Compact JSON with keys in alphabetical order (for signing)."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(cols)]))
