"""Secret scan: Aho-Corasick prefilter, anchored expressions at hits, embedded checksums.

One automaton holds every keyword.  It runs over the ASCII-lower-cased text and
only where it hits is a regular expression tried, anchored at the hit.  Kinds:

* ``assign``  keyword, separator, value of 12 or more characters
* ``access``  ``AKIA`` identifiers of 18 or more characters
* ``hex``     runs of 16 or more lower-case hex digits (no keyword can announce
  one, so these are found by a single linear scan)
* ``github``, ``npm``  prefixed tokens of 36 characters whose last six are the
  base-62 CRC-32 of the first thirty; reported only if that checksum holds

Matches of one kind are leftmost and do not overlap; one that is too short
still consumes its characters.  Offsets are code points, end exclusive.

Defined results: null and empty texts have no spans; texts of any length are
scanned whole; repeated rows give repeated results; a null id is passed on; an
empty table gives an empty result; other columns of the input are passed on, but
for one named like the output, which is replaced.
"""

from __future__ import annotations

import re
import zlib
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("assign", "access", "hex", "github", "npm")
_ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
_TOKEN = re.compile(r"(?:gh[pousr]|npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
_KEYWORDS = {
    **dict.fromkeys(("password", "passwd", "secret", "token", "apikey", "api_key"), "assign"),
    "akia": "access",
    **dict.fromkeys(("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), "github"),
    "npm_": "npm",
}
_LOWER = {c: c + 32 for c in range(65, 91)}
_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


@cache
def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for word, kind in _KEYWORDS.items():
        a.add_word(word, (kind, len(word) - 1))
    a.make_automaton()
    return a


def base62_crc32(payload: str) -> str:
    """CRC-32 of ``payload`` in six base-62 digits, as the prefixed tokens carry it."""
    value, out = zlib.crc32(payload.encode()), ""
    for _ in range(6):
        value, digit = divmod(value, 62)
        out = _DIGITS[digit] + out
    return out


def find_secrets(text: str | None) -> list[tuple[str, int, int]]:
    """All spans of one whole text, by start, then kind in the order of ``KINDS``."""
    if not text:
        return []
    low = text.lower()
    if len(low) != len(text):  # a letter whose lower case is two code points
        low = text.translate(_LOWER)
    found, free = [], dict.fromkeys(KINDS, 0)
    hits = sorted((end - back, kind) for end, (kind, back) in _automaton().iter(low))
    for start, kind in hits:
        if start < free[kind]:
            continue
        if kind == "assign":
            if m := _ASSIGN.match(text, start):
                free[kind] = m.end()
                if len(m[2]) >= 12:
                    found.append((start, 0, m.end()))
        elif kind == "access":
            if m := _ACCESS.match(text, start):
                free[kind] = m.end()
                if m.end() - start >= 18:
                    found.append((start, 1, m.end()))
        elif m := _TOKEN.match(text, start):
            free[kind] = m.end()
            if base62_crc32(m[1]) == m[2]:
                found.append((start, KINDS.index(kind), m.end()))
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return [(KINDS[k], s, e) for s, k, e in sorted(found)]


SPANS = T.ArrayType(
    T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
)


def scan_secrets(docs: DataFrame, text_col: str = "text", out_col: str = "spans") -> DataFrame:
    """``docs`` with ``out_col``: array of (kind, start, end)."""

    @F.udf(SPANS, useArrow=True)
    def spans(text):
        return find_secrets(text)

    return docs.withColumn(out_col, spans(F.col(text_col).cast("string")))


def spans_text(spans: Column) -> Column:
    """``kind:start:end`` joined by commas."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )
