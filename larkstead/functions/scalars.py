"""Scalar functions as column expressions; those with keys derive them on the driver."""

from __future__ import annotations

import hashlib
import hmac
from functools import lru_cache

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# The digits of Crockford's base 32.
CROCKFORD = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"
# Prefixes of identifiers.
KINDS = ("usr", "ses", "loc", "dev", "doc", "ast", "pln", "occ", "job", "ntf", "trm")
# The back-off of failed attempts.
BACKOFF_FIRST_MS, BACKOFF_MOST_MS, BACKOFF_DOUBLINGS = 5_000, 600_000, 16


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def millis(timestamp: Column | str) -> Column:
    """Epoch milliseconds, rounded down; null for null."""
    return F.unix_millis(_c(timestamp).cast("timestamp"))


def time(ms: Column | str) -> Column:
    return F.timestamp_millis(_c(ms))


def fold_email(email: Column | str) -> Column:
    return F.lower(F.trim(_c(email)))


def valid_email(email: Column | str) -> Column:
    """One @, something on both sides, no white space: an approximation of the full grammar."""
    return _c(email).rlike(r"^[^@\s<>]+@[^@\s<>]+$")


def truncate_bytes(text: Column | str, n: int) -> Column:
    """The first n bytes, not characters; the end may be no valid UTF-8."""
    return F.substring(_c(text).cast("binary"), 1, n)


def long_enough(password: Column | str, n: int = 10) -> Column:
    """At least n characters, not bytes."""
    return F.char_length(_c(password)) >= n


def fingerprint(text: Column | str, salt: str) -> Column:
    """First 4 bytes, in hex, of a salted SHA-256."""
    return F.substring(F.sha2(F.concat(F.lit(salt), _c(text)), 256), 1, 8)


def token_hash(token: Column | str) -> Column:
    return F.unhex(F.sha2(_c(token), 256))


def digest(content: Column | str) -> Column:
    return F.sha2(_c(content), 256)


def valid_digest(text: Column | str) -> Column:
    return F.coalesce(_c(text).rlike("^[0-9a-f]{64}$"), F.lit(False))


def blob_path(sha256: Column | str) -> Column:
    """ab/cd/digest; null for what is no digest."""
    d = _c(sha256)
    return F.when(valid_digest(d), F.concat_ws("/", F.substring(d, 1, 2), F.substring(d, 3, 2), d))


def encode_time(ms: Column | str) -> Column:
    """The ten base-32 digits of 48 bits of milliseconds that start a time-ordered id."""
    m = _c(ms)
    return F.concat(*[F.substring(F.lit(CROCKFORD), F.pmod(F.shiftright(m, 5 * i), F.lit(32)).cast("int") + 1, F.lit(1)) for i in range(9, -1, -1)])


def id_kind(text: Column | str) -> Column:
    return F.split_part(_c(text), F.lit("_"), F.lit(1))


def valid_id(text: Column | str, kind: str | None = None) -> Column:
    """A prefix (exactly ``kind``, if given), an underscore, and 26 base-32 digits, in either case, that fit 128 bits."""
    prefix = "[^_]*" if kind is None else kind
    return F.coalesce(_c(text).rlike(f"^{prefix}_(?i:[0-7][{CROCKFORD}]{{25}})$"), F.lit(False))


def id_time(text: Column | str) -> Column:
    """Milliseconds in an id; null if it isn't valid."""
    body = F.upper(F.split_part(_c(text), F.lit("_"), F.lit(2)))
    value = F.lit(0).cast("long")
    for i in range(1, 11):
        value = value * 32 + F.position(F.substring(body, i, 1), F.lit(CROCKFORD)) - 1
    return F.when(valid_id(text), value)


def subkey(master: bytes, purpose: str, length: int = 32) -> bytes:
    """HKDF-SHA256 of a master key for one purpose; on the driver only."""
    secret = hmac.new(bytes(32), master, hashlib.sha256).digest()
    out, block, i = b"", b"", 1
    while len(out) < length:
        block = hmac.new(secret, block + purpose.encode() + bytes([i]), hashlib.sha256).digest()
        out, i = out + block, i + 1
    return out[:length]


def hmac_index(text: Column | str, key: bytes) -> Column:
    """Hex HMAC-SHA256, an index for exact matches of encrypted values."""
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(k ^ x for k in key)) for x in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, _c(text).cast("binary")), 256))), 256)


def encrypt(text: Column | str, key: bytes) -> Column:
    """nonce, ciphertext and tag of AES-GCM; never twice the same."""
    return F.aes_encrypt(_c(text), F.lit(key), F.lit("GCM"))


def decrypt(sealed: Column | str, key: bytes) -> Column:
    """The text; null if what is sealed was changed or cut."""
    return F.try_aes_decrypt(_c(sealed), F.lit(key), F.lit("GCM")).cast("string")


def cost_string(micros: Column | str) -> Column:
    """Millionths with six decimals."""
    return F.format_string("%.6f", _c(micros).cast("decimal(20,0)").cast("double") / F.lit(1e6))


def clamp(x: Column | str) -> Column:
    return F.least(F.greatest(_c(x), F.lit(0.0)), F.lit(1.0))


def backoff_ms(attempts: Column | str) -> Column:
    """5 s, doubling with each attempt, up to 10 min; without jitter."""
    doublings = F.least(F.greatest(_c(attempts), F.lit(1)) - 1, F.lit(BACKOFF_DOUBLINGS)).cast("int")
    return F.least(F.lit(BACKOFF_FIRST_MS) * F.call_function("shiftleft", F.lit(1).cast("long"), doublings), F.lit(BACKOFF_MOST_MS))


def jitter_ms(delay: Column | str, seed: Column | str) -> Column:
    """Less than a quarter of the delay, from 32 bits of a seed's SHA-256."""
    bits = F.conv(F.substring(F.sha2(_c(seed).cast("string"), 256), 1, 8), 16, 10).cast("long")
    return bits % F.greatest(F.floor(_c(delay) / 4).cast("long"), F.lit(1))


def retry_delay_ms(attempts: Column | str, seed: Column | str) -> Column:
    """The back-off less a jitter, so that jobs that failed together don't come back together."""
    delay = backoff_ms(attempts)
    return delay - jitter_ms(delay, seed)


def terminal(state: Column | str) -> Column:
    return _c(state).isin("succeeded", "failed", "cancelled")


def payload(value: Column | None) -> Column:
    return F.lit("{}") if value is None else F.coalesce(F.to_json(value), F.lit("{}"))


def first_version(text: Column | str) -> Column:
    return F.regexp_extract(_c(text), r"\d+\.\d+(\.\d+)?", 0)


def page_count(text: Column | str) -> Column:
    """N of a line 'Pages: N'; null without one."""
    return F.regexp_extract(_c(text), r"(?m)^Pages:\s+(\d+)", 1).try_cast("int")


def client_ip(forwarded: Column | str, real: Column | str) -> Column:
    """The last entry of a forwarding chain, else the proxy's header."""
    last = F.trim(F.element_at(F.split(_c(forwarded), ","), -1))
    return F.coalesce(F.nullif(last, F.lit("")), F.nullif(_c(real), F.lit("")))


def redact_home(path: Column | str, home: str) -> Column:
    import re

    return F.regexp_replace(_c(path), "^" + re.escape(home) + "(?=/|$)", "~")


def redact(secret: Column | str, mark: str = "********") -> Column:
    """A mark for a secret; an empty one stays empty."""
    return F.when(_c(secret) == "", _c(secret)).otherwise(F.lit(mark))


def same_origin(origin: Column | str, host: Column | str) -> Column:
    """Host and port of an origin equal the host, whatever the case."""
    return F.coalesce(F.lower(F.parse_url(_c(origin), F.lit("AUTHORITY"))) == F.lower(_c(host)), F.lit(False))


def ordered_set(items: Column | str) -> Column:
    """Trimmed entries without empty ones, each once, in order of first appearance."""
    return F.array_distinct(F.filter(F.transform(_c(items), lambda x: F.trim(x)), lambda x: x != ""))


def data_route(kind: Column | str, wanted: Column | str) -> Column:
    """Receipts and warranties stay local, other data goes where it is wanted."""
    return F.when(_c(kind).isin("receipt", "warranty"), F.lit("local")).otherwise(_c(wanted))


# OCR languages that aren't named by their three-letter code.
OCR_CODES = {"zh": "chi_sim", "ko": "kor", "ja": "jpn"}


@lru_cache(maxsize=1)
def _three_letter_codes() -> dict[str, str]:
    """ISO 639 codes of two letters and of three, as the JVM's locales know them."""
    locale = SparkSession.active()._jvm.java.util.Locale
    return {code: locale.forLanguageTag(code).getISO3Language() for code in locale.getISOLanguages()}


def ocr_codes(tags: Column | str) -> Column:
    """OCR languages of language tags, in order, English last; malformed and unknown tags are skipped.

    A base of two letters has its ISO 639 code of three; one of three letters must be such a code.
    """
    known = _three_letter_codes()
    table = F.create_map(*[F.lit(x) for pair in ({c: c for c in known.values()} | known | OCR_CODES).items() for x in pair])
    well_formed = F.filter(_c(tags), lambda t: t.rlike("^[A-Za-z]{2,3}([-_][A-Za-z0-9]{1,8})*$"))
    found = F.transform(well_formed, lambda t: F.try_element_at(table, F.lower(F.regexp_extract(t, "^[A-Za-z]+", 0))))
    return F.array_distinct(F.concat(F.filter(found, lambda c: c.isNotNull()), F.array(F.lit("eng"))))


def problems(**checks: tuple[Column, str]) -> Column:
    """All messages whose check fails, in order; an empty array if none does."""
    found = F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(f"{name}: {message}")) for name, (ok, message) in checks.items()])
    return F.filter(found, lambda m: m.isNotNull())
