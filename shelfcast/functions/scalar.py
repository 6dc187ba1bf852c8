"""Scalar expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Workflow status vocabulary (store side -> application side).
STATUS_TO_APP = {"PENDING_APPROVAL": "pending", "APPROVED": "approved",
                 "REJECTED": "rejected", "EXECUTED": "executed"}
# Namespace of the deterministic record ids.
UUID_NAMESPACE = "11111111-2222-3333-4444-555555555555"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def short_id(c, keep: int = 4, limit: int = 10) -> Column:
    """``abcd…wxyz`` for ids longer than ``limit``."""
    s = _c(c).cast("string")
    return F.when(F.length(s) > limit,
                  F.concat(F.left(s, F.lit(keep)), F.lit("…"), F.right(s, F.lit(keep)))).otherwise(s)


def safe_double(c, default: float = 0.0) -> Column:
    """Parse to double; ``default`` for null, garbage and what is no finite number."""
    x = _c(c).try_cast("double")
    return F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")), x).otherwise(F.lit(default))


def whole_text(x: Column) -> Column:
    """A number as text, without a fraction if it is whole."""
    return F.when((x == F.floor(x)) & (F.abs(x) < 1e15), x.cast("bigint").cast("string")).otherwise(x.cast("string"))


def md5_mod(c, n: int = 10000) -> Column:
    """S11 helper: int(md5(c), 16) mod n without 128-bit integers:
    h = hi * 2^64 + lo, so h mod n = ((hi mod n) * (2^64 mod n) + lo mod n) mod n."""
    h = F.md5(_c(c).cast("string"))
    hi = F.conv(F.substring(h, 1, 16), 16, 10).cast("decimal(20,0)")
    lo = F.conv(F.substring(h, 17, 16), 16, 10).cast("decimal(20,0)")
    two64 = (1 << 64) % n
    return ((hi % n) * two64 + lo % n) % n


def vendor_segments(c) -> tuple[Column, Column]:
    """Deterministic placeholder segments from an id (size, region)."""
    m = md5_mod(c, 10000)
    size = F.when(m % 100 < 30, F.lit("SMB")).otherwise(F.lit("Enterprise"))
    region = F.when(F.floor(m / 100) % 100 < 40, F.lit("International")).otherwise(F.lit("Domestic"))
    return size, region


def uuid5(*parts, namespace: str = UUID_NAMESPACE) -> Column:
    """RFC 4122 version-5 id of ``'|'.join(parts)`` in ``namespace``."""
    name = F.concat_ws("|", *[_c(p).cast("string") for p in parts])
    ns = F.unhex(F.lit(namespace.replace("-", "")))
    h = F.sha1(F.concat(ns, F.encode(name, "UTF-8")))
    variant = F.lower(F.conv(((F.conv(F.substring(h, 17, 1), 16, 10).cast("int")
                               .bitwiseAND(3)).bitwiseOR(8)).cast("string"), 10, 16))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4),
                       F.concat(F.lit("5"), F.substring(h, 14, 3)),
                       F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def fingerprint(pairs: dict[str, Column], n: int = 16) -> Column:
    """First ``n`` hex of sha256 over a key-sorted JSON object of
    numbers/strings, formatted like ``{"a": 1.0, "b": "x"}``."""
    items = []
    for k in sorted(pairs):
        v = pairs[k]
        one = F.to_json(F.struct(v.alias("v")), {"ignoreNullFields": "false"})      # {"v":...}
        items.append(F.concat(F.lit(f'"{k}": '), F.substring(one, F.lit(6), F.length(one) - 6)))
    body = F.concat(F.lit("{"), F.concat_ws(", ", *items), F.lit("}"))
    return F.left(F.sha2(body, 256), F.lit(n))


def status_to_app(c) -> Column:
    """Store vocabulary -> application vocabulary, default pending."""
    m = F.create_map(*[x for kv in STATUS_TO_APP.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
    return F.coalesce(F.element_at(m, _c(c)), F.lit("pending"))


def status_to_db(c) -> Column:
    """Application vocabulary -> store vocabulary (NULL if unknown)."""
    m = F.create_map(*[x for kv in STATUS_TO_APP.items() for x in (F.lit(kv[1]), F.lit(kv[0]))])
    return F.element_at(m, _c(c))


def band(c, hi: float, mid: float, labels=("high", "med", "low"), higher_is_worse=True) -> Column:
    """Three-level colour band."""
    x = _c(c)
    if higher_is_worse:
        return F.when(x > hi, F.lit(labels[0])).when(x > mid, F.lit(labels[1])).otherwise(F.lit(labels[2]))
    return F.when(x >= hi, F.lit(labels[0])).when(x >= mid, F.lit(labels[1])).otherwise(F.lit(labels[2]))


def backfill_name(name, email) -> Column:
    """Keep a non-empty name, else the capitalised local part of the email."""
    return F.coalesce(F.nullif(_c(name), F.lit("")),
                      F.initcap(F.split_part(_c(email), F.lit("@"), F.lit(1))))


def days_band(c) -> Column:
    """Colour band of the days that stock lasts: up to 3, up to 7, longer."""
    d = _c(c)
    return F.when(d <= 3, F.lit("bad")).when(d <= 7, F.lit("warning")).when(d.isNotNull(), F.lit("good"))
