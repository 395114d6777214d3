"""Scan of texts for secrets (operator 10).

Three fixed kinds (assign, access, hex) are found by pattern. The method adds a fourth, entropy: maximal runs of key-like
characters are candidate strings; for each character class, a window slides over the candidate while the Shannon entropy
within it is kept up to date from the counts of the characters that enter and leave. A candidate is a secret if a window's
entropy reaches its class's threshold and no allow-list rule suppresses it.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from cairn.llm.shared import slices

# The contract's patterns, least lengths and order of kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "entropy")
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 8, 16, 32

#: Window of the entropy, in characters; a candidate has as many at least.
WINDOW = 20
#: Class of characters and the entropy (bits a character) that a window must reach. The first class that a candidate fits counts.
CLASSES = (("hex", frozenset("0123456789abcdefABCDEF"), 3.0), ("base32", frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), 3.4), ("base64", frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-="), 3.7))
#: Candidates that look random but aren't secrets.
ALLOWED = tuple(
    map(
        re.compile,
        (
            r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",  # UUID
            r"[0-9+/_=-]+",  # numbers, dates, rules
            r"[A-Za-z+/_=-]+",  # words and paths without any digit
            r"(?i)(sha(1|224|256|384|512)|md5)[-_].*",  # integrity sums
            r"[A-Za-z]+([_/-]+[A-Za-z]+)*[_/-]*[0-9]{1,4}",  # names with a number behind
        ),
    )
)


#: Words and runs that stand in for a secret; a candidate is allowed if at least half of it is made of them, or if one of the
#: words of _GLUED is grown together with its beginning or its end.
PLACEHOLDER = re.compile(r"(?i)(?:(?:example|sample|dummy|placeholder|changeme|change[_-]me|insert|redacted|your|my|test|fake|here|key|token|secret|password|access|api)[/_+-]*|(.)\1{3,}|0123456789|123456789?|abcdefgh?i?j?)+")


_GLUED = re.compile(r"(?i)(?:example|sample|dummy|placeholder|changeme)(?:key|token|secret)?(?![/_=-])")
_GLUED_END = re.compile(r"(?i)[^/_=-](?:example|sample|dummy|placeholder|changeme)(?:key|token|secret)?$")


def placeholder(candidate: str) -> bool:
    return bool(_GLUED.match(candidate) or _GLUED_END.search(candidate)) or 2 * sum(m.end() - m.start() for m in PLACEHOLDER.finditer(candidate)) >= len(candidate)


def window_entropy(text: str, window: int = WINDOW) -> float:
    """The largest Shannon entropy (bits a character) of any window of the text; of the whole text if it is shorter.

    With counts c in a window of n characters it is log2(n) - sum(c log2 c) / n; a step changes two of the counts.
    """
    n = min(window, len(text))
    if not n:
        return 0.0
    term = [0.0, *(c * math.log2(c) for c in range(1, n + 1))]
    counts: dict[str, int] = {}
    total = 0.0
    least = math.inf
    for i, new in enumerate(text):
        c = counts.get(new, 0)
        total += term[c + 1] - term[c] if c < n else 0.0
        counts[new] = c + 1
        if i >= n:
            old = text[i - n]
            c = counts[old]
            total += term[c - 1] - (term[c] if c <= n else term[n])
            counts[old] = c - 1
        if i >= n - 1:
            least = min(least, total)
    return max(0.0, math.log2(n) - least / n)


def suspicious(candidate: str) -> bool:
    for _, members, least in CLASSES:
        if members.issuperset(candidate):
            return window_entropy(candidate) >= least and not placeholder(candidate) and not any(a.fullmatch(candidate) for a in ALLOWED)
    return False


_PIECE = re.compile(r"[^=]+")
_KEYLIKE = np.zeros(128, bool)
_KEYLIKE[[ord(c) for c in CLASSES[-1][1]]] = True


def _runs(codes: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of key-like characters, WINDOW or longer."""
    mask = np.zeros(len(codes) + 2, np.int8)
    small = codes < 128
    mask[1:-1][small] = _KEYLIKE[codes[small]]
    steps = np.diff(mask)
    starts, ends = np.flatnonzero(steps == 1), np.flatnonzero(steps == -1)
    long = ends - starts >= WINDOW
    return list(zip(starts[long].tolist(), ends[long].tolist(), strict=True))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the fixed kinds, in code points, unsorted."""
    out = []
    lower = text.lower()
    if any(w in lower for w in ASSIGN_WORDS):
        out += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    return out


def _outside(found: list[tuple[int, int, int]], fixed: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans, in order of place, that lie within none of the fixed ones: those that begin before or with a span are known by the farthest end."""
    ends, at, farthest, out = sorted(fixed), 0, -1, []
    for x in sorted(found):
        while at < len(ends) and ends[at][0] <= x[0]:
            farthest, at = max(farthest, ends[at][1]), at + 1
        if x[1] > farthest:
            out.append(x)
    return out


def spans(text: str | None) -> list[tuple[int, int, int]]:
    """All (start, end, kind), by start, then kind as listed. An entropy span that lies within a span of a fixed kind is left out;
    one that reaches beyond it stays, and the two overlap."""
    if not text:
        return []
    out = base_spans(text)
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    found = []
    for start, end in _runs(codes):
        run = text[start:end]
        out += [(start + m.start(), start + m.end(), 2) for m in HEX.finditer(run)]
        # names and values stand on both sides of a sign of equality: each piece is a candidate of its own
        for m in _PIECE.finditer(run):
            core = m[0].strip("-_/+")
            at = start + m.start() + m[0].find(core) if core else start
            if len(core) >= WINDOW and suspicious(core):
                found.append((at, at + len(core), 3))
    return sorted([*out, *_outside(found, out)], key=lambda x: (x[0], x[2], x[1]))


def joined(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in found)


def redacted(text: str | None, found: list[tuple[int, int, int]], mark: str = "[REDACTED]") -> str | None:
    if not found:
        return text
    parts, at = [], 0
    for start, end, _ in found:
        if end <= at:
            continue
        if start >= at:
            parts += [text[at:start], mark]
        at = end
    return "".join([*parts, text[at:]])


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs: the id, the kept columns, ``n_assign``, ``n_access``, ``n_hex``, ``n_entropy``, ``base_sha256``, ``spans``
    (kind:start:end in code points, end exclusive), ``redacted`` (the text with each span replaced; null stays null).

    A null or empty text has no spans and the digest of an empty string. Repeated rows are each scanned; other columns are
    not read. There is no shuffle.
    """
    rest = [id_col, *keep]
    schema = T.StructType([*(docs.schema[c] for c in rest), *(T.StructField(n, T.LongType()) for n in ("n_assign", "n_access", "n_hex", "n_entropy")), *(T.StructField(n, T.StringType()) for n in ("base_sha256", "spans", "redacted"))])

    def run(batches):
        for batch in batches:
            texts = batch.column(len(rest))
            for part in slices((len(x.as_buffer()) if x.is_valid else 0 for x in texts), 4 << 20):
                rows = []
                for text in texts[part.start : part.stop].to_pylist():
                    found = spans(text)
                    base = [x for x in found if x[2] < 3]
                    rows.append((*(sum(x[2] == k for x in found) for k in range(4)), hashlib.sha256(joined(base).encode()).hexdigest(), joined(found), redacted(text, found)))
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([*(batch.column(i)[part.start : part.stop] for i in range(len(rest))), *(pa.array(c, pa.int64()) for c in columns[:4]), *(pa.array(c, pa.string()) for c in columns[4:])], names=schema.names)

    return docs.select(*(docs[c] for c in rest), docs[text_col].alias("__text")).mapInArrow(run, schema)
