"""Secret scanning: fixed patterns, and high entropy in a sliding window with an allow-list.

Base kinds (``assign``, ``access``, ``hex``) are leftmost, non-overlapping pattern matches. The method adds ``entropy``
spans: candidate strings are maximal runs of base64 characters, at least ``WINDOW`` long. A window of ``WINDOW``
characters slides over each; the counts of its characters are updated by the one that enters and the one that leaves,
and with them the sum of c * log2(c) and the counts of digits, letters and hexadecimal digits, so each step costs constant
time. A window is held to the threshold of its class: digits only, no digits, hexadecimal, or any. It is suppressed if one
allow-listed form covers it whole: a UUID, or words, placeholders and short numbers joined by signs. What stands before or
after such a form is judged on its own. The entropy span runs from the first to the last hot window. Entropy spans never
replace base spans.
"""

from __future__ import annotations

import hashlib
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from duskline.llm.arrow_map import append_columns, spare_name

#: Characters in a window, and the bits a character must carry in a window of each class: digits only, no digit, hexadecimal,
#: any other. Twenty different characters carry log2(20) = 4.32 bits, ten different digits twice log2(10) = 3.32.
WINDOW, DIGIT_BITS, LETTER_BITS, HEX_BITS, BASE64_BITS = 20, 3.0, 4.0, 3.0, 3.8
#: Base patterns and their least lengths (fixed values).
ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_ASSIGN, LEAST_ACCESS = 6, 20
KINDS = ("assign", "access", "hex", "entropy")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % WINDOW)
_PART = r"(?:[a-z]{1,15}|[A-Z][a-z]{0,14}|[A-Z]{1,15}|0?123456(?:7(?:8(?:90?)?)?)?|[0-9]{1,4})"
#: Whole parts between signs: UUIDs, and lower-case, capitalised or upper-case words, short numbers and those that count up.
ALLOWED = re.compile(rf"(?<![A-Za-z0-9])(?:[0-9a-fA-F]{{8}}(?:-[0-9a-fA-F]{{4}}){{3}}-[0-9a-fA-F]{{12}}|{_PART}(?:[-_/=+]+{_PART})+)(?![A-Za-z0-9])")
_HINTS = ("password", "passwd", "secret", "token", "api")
_C_LOG_C = [0.0] + [c * math.log2(c) for c in range(1, WINDOW + 1)]
_HEX_DIGITS = frozenset("0123456789abcdefABCDEF")


def window_entropy(s: str, window: int = WINDOW) -> list[float]:
    """Shannon entropy, in bits a character, of each window of ``s``, by incremental counts."""
    table = _C_LOG_C if window == WINDOW else [0.0] + [c * math.log2(c) for c in range(1, window + 1)]
    count: dict[str, int] = {}
    total, top, out = 0.0, math.log2(window), []
    for i, c in enumerate(s):
        n = count.get(c, 0)
        count[c] = n + 1
        total += table[n + 1] - table[n] if n < window else 0.0
        if i >= window - 1:
            out.append(top - total / window)
            old = s[i - window + 1]
            n = count[old]
            count[old] = n - 1
            total += table[n - 1] - table[n]
    return out


def window_thresholds(s: str, window: int = WINDOW) -> list[float]:
    """The bits that each window of ``s`` is held to, by incremental counts of digits and hexadecimal digits."""
    digits = hexes = 0
    out = []
    for i, c in enumerate(s):
        digits += c.isdigit()
        hexes += c in _HEX_DIGITS
        if i >= window - 1:
            out.append(DIGIT_BITS if digits == window else LETTER_BITS if not digits else HEX_BITS if hexes == window else BASE64_BITS)
            old = s[i - window + 1]
            digits -= old.isdigit()
            hexes -= old in _HEX_DIGITS
    return out


def entropy_spans(text: str) -> list[tuple[int, int]]:
    """Spans of candidate strings with a hot window that no allow-listed form covers."""
    out = []
    for m in CANDIDATE.finditer(text):
        s = m.group()
        forms = [f.span() for f in ALLOWED.finditer(s) if f.end() - f.start() >= WINDOW]
        if forms == [(0, len(s))]:
            continue
        hot = [i for i, (bits, least) in enumerate(zip(window_entropy(s), window_thresholds(s), strict=True)) if bits >= least]
        hot = [i for i in hot if not any(a <= i and i + WINDOW <= b for a, b in forms)] if forms else hot
        if hot:
            out.append((m.start() + hot[0], m.start() + hot[-1] + WINDOW))
    return out


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans of the base patterns that are long enough, with their kinds."""
    out = []
    low = text.lower()
    if any(h in low for h in _HINTS):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return out


def scan(text: str) -> list[tuple[int, int, str]]:
    """All spans of a text as (start, end, kind), by start, then kind in the order of ``KINDS``, then end."""
    found = base_spans(text) + [(a, b, "entropy") for a, b in entropy_spans(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def redact(text: str, spans: list[tuple[int, int, str]], mask: str = "[SECRET]") -> str:
    """``text`` with each union of overlapping spans replaced by ``mask``."""
    out, at, end = [], 0, 0
    for a, b, _ in spans:
        if a >= end:
            out += [text[at:a], mask] if a > end or not out else [mask]
            at = end = b
        else:
            at = end = max(end, b)
    return "".join(out) + text[at:]


def _written(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def scan_secrets(docs: DataFrame, text_col: str = "text", redacted: bool = False, without: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` with ``n_assign``, ``n_access``, ``n_hex``, ``base_sha256`` and ``spans`` (``kind:start:end``, code points, end
    exclusive); with ``redacted`` also the text with its spans masked, in place.

    Null texts count as empty (and stay null if redacted); empty texts have no spans and the digest of the empty string.
    Texts are scanned whole. Equal starts are ordered by kind. Repeated rows are scanned each. An empty table gives an empty
    result. Extra columns stay; ones named like the new are replaced.
    """
    masked = spare_name(docs, "_redacted")
    fields = [*(T.StructField(c, T.LongType()) for c in ("n_assign", "n_access", "n_hex")), T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())]
    if redacted:
        fields.append(T.StructField(masked, T.StringType()))

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
        spans = [scan(t) if t else [] for t in texts]
        base = [[s for s in found if s[2] != "entropy"] for found in spans]
        columns = [pa.array([sum(s[2] == kind for s in found) for found in base], pa.int64()) for kind in KINDS[:3]]
        columns.append(pa.array([hashlib.sha256(_written(found).encode()).hexdigest() for found in base]))
        columns.append(pa.array([_written(found) for found in spans], pa.string()))
        if redacted:
            columns.append(pa.array([redact(t, found) if found else t for t, found in zip(texts, spans, strict=True)], pa.string()))
        return columns

    out = append_columns(docs, fields, compute, without)
    return out.withColumn(text_col, out[masked]).drop(masked) if redacted else out
