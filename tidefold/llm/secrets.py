"""Secret scan: patterns, and sliding-window entropy of candidate strings.

Base kinds, leftmost and without overlap within a kind (offsets in code points, end
exclusive): `assign` (a key word, `:` or `=`, then a value of 8 characters or more),
`access` (AKIA..., 16 or more) and `hex` (32 or more). These always stay.

The method adds kind `entropy`. Candidates are maximal runs of `[A-Za-z0-9+/_-]` with
optional `=` at the end, of WINDOW characters or more. A window of WINDOW characters
slides over a candidate; the counts of its characters and the sum of c*log2(c)
are updated by the character that enters and the one that leaves, so a step costs the
same whatever the window. The window's class (the smallest alphabet that holds all of
it) has its own threshold in bits a character; windows of one class of letters never
count, as those are words. Windows at or over their threshold merge into spans. A
span is dropped if it overlaps a base span or its candidate matches the allow-list.

Defined cases: null text is empty text, without spans; repeated rows each get their
row; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import Scratch, arrow_map

# The base patterns, in the order in which kinds are listed.
ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "entropy")

#: Characters of a window and of the shortest candidate.
WINDOW = 16
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{%d,}+={0,2}" % WINDOW)
#: Bits a character from which a window of a class counts: hexadecimal digits; digits and letters of one case; any. In 4,000 random
#: windows of 16 characters 95 % reach these (measured quantiles at 5 %: 2.83, 3.28 and 3.50).
THRESHOLDS = {"hex": 2.8, "lower": 3.25, "mixed": 3.5}
#: Candidates that are not secrets: UUIDs, words joined by one sign, paths of words, placeholders.
ALLOW = (
    r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}",
    r"[A-Za-z]+(?:[-_/+][A-Za-z]+)*",
    r"(?:[A-Za-z]{1,24}|[0-9]{1,8})(?:[-_/](?:[A-Za-z]{1,24}|[0-9]{1,8}))+",
    r"(?i:.*(?:example|placeholder|changeme|redacted).*)",
    r"(.)\1*",
)
_F = [0.0] + [c * math.log2(c) for c in range(1, 4096)]


def _term(c: int) -> float:
    return _F[c] if c < len(_F) else c * math.log2(c)


def _class(digits: int, lower: int, upper: int, other: int, beyond: int) -> str | None:
    """The class of a window; None for letters or digits alone. beyond: letters after f."""
    if not digits or not (lower or upper or other):
        return "mixed" if lower and upper and other else None
    if not other and not beyond and not (lower and upper):
        return "hex"
    return "lower" if not other and not (lower and upper) else "mixed"


def entropy_spans(s: str, window: int = WINDOW, thresholds: dict[str, float] = THRESHOLDS) -> list[tuple[int, int]]:
    """Merged spans of the windows of s whose entropy reaches their class's threshold."""
    counts: dict[str, int] = {}
    kinds = [0, 0, 0, 0, 0]
    total, out = 0.0, []

    def move(ch: str, by: int) -> float:
        c = counts.get(ch, 0)
        counts[ch] = c + by
        kinds[0 if "0" <= ch <= "9" else 1 if "a" <= ch <= "z" else 2 if "A" <= ch <= "Z" else 3] += by
        if ch.lower() > "f" and ch.isalpha():
            kinds[4] += by
        return _term(c + by) - _term(c)

    for i, ch in enumerate(s):
        total += move(ch, 1)
        if i >= window:
            total += move(s[i - window], -1)
        if i + 1 >= window and (kind := _class(*kinds)) and math.log2(window) - total / window >= thresholds[kind] - 1e-9:
            start = i + 1 - window
            if out and start <= out[-1][1]:
                out[-1] = (out[-1][0], i + 1)
            else:
                out.append((start, i + 1))
    return out


def scan(text: str | None, allow: re.Pattern | None = None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all spans, by start, then kind as listed."""
    text, allow = text or "", allow or _ALLOW
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 8]
    found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    base: list[list[int]] = []  # merged, so that starts and ends both ascend
    for a, b, _ in sorted(found):
        if base and a < base[-1][1]:
            base[-1][1] = max(base[-1][1], b)
        else:
            base.append([a, b])
    starts = [a for a, _ in base]
    for m in CANDIDATE.finditer(text):
        s = m[0]
        if s.isalpha() or allow.fullmatch(s):
            continue
        for a, b in entropy_spans(s):
            a, b = a + m.start(), b + m.start()
            k = bisect_left(starts, b) - 1  # the last that begins before the span's end
            if k < 0 or base[k][1] <= a:
                found.append((a, b, "entropy"))
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


_ALLOW = re.compile("|".join(f"(?:{x})" for x in ALLOW[:-1]) + r"|(?P<same>.)(?P=same)*")


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def _scan(batch: pa.RecordBatch) -> pa.RecordBatch:
    every = [scan(t) for t in batch.column("text").to_pylist()]
    base = [[x for x in spans if x[2] != "entropy"] for spans in every]
    count = lambda kind: pa.array([sum(x[2] == kind for x in b) for b in base], pa.int64())
    sha = pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for b in base])
    n = pa.array([len(a) - len(b) for a, b in zip(every, base, strict=True)], pa.int64())
    cols = [batch.column("doc_id"), count("assign"), count("access"), count("hex"), sha, pa.array([joined(s) for s in every], pa.string()), n]
    return pa.RecordBatch.from_arrays(cols, ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_entropy"])


def scan_secrets(docs: DataFrame) -> DataFrame:
    """One row per row of docs(doc_id, text): counts of each kind, a digest of the base spans, and all spans."""
    docs = docs.select(docs.doc_id.cast("long"), "text")
    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_entropy long"
    return Scratch(docs.sparkSession, "secrets").save(arrow_map(docs, _scan, schema))
