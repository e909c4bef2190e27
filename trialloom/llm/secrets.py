"""Secrets in texts: fixed patterns, and sliding-window entropy for what has no pattern.

Candidate strings are long runs of token characters. Within one, each character class is looked at on its own: over
every maximal run of the class a window slides by one character at a time, its Shannon entropy kept up by incremental
counts. Windows above the class's limit that mix kinds of characters, as keys do and words do not, are joined into
spans. Keys in one case mix two kinds only, so their classes ask for longer windows and more entropy. Spans that meet an allow-listed string (identifiers, dates, well-known digests, placeholders) are suppressed.
"""

from __future__ import annotations

import hashlib
import math
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialloom.llm.text import map_texts

KINDS = ("assign", "access", "hex", "entropy")
NAMES = "password passwd secret token apikey api_key".split()


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_assign = re.compile("(" + "|".join(map(_either_case, NAMES)) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_access = re.compile(r"AKIA[A-Z0-9]+")
# a run of the class is one greedy match, so asking for the length at once finds the same spans
_hex = re.compile(r"[0-9a-f]{24,}")
_candidate = re.compile(r"[A-Za-z0-9+/_=-]{20,}")


@dataclass(frozen=True)
class CharClass:
    """Runs of ``pattern``, windows of ``width`` characters, entropy limit in bits, kinds of characters a window must mix."""

    name: str
    pattern: str
    width: int
    limit: float
    kinds: int


CLASSES = (
    CharClass("hex digits", r"[0-9A-Fa-f]{20,}", 20, 3.0, 2),
    CharClass("letters and digits", r"[A-Za-z0-9]{20,}", 20, 3.6, 3),
    CharClass("lower-case letters and digits", r"[a-z0-9]{24,}", 24, 3.8, 2),
    CharClass("upper-case letters and digits", r"[A-Z0-9]{24,}", 24, 3.8, 2),
    CharClass("base64", r"[A-Za-z0-9+/=]{24,}", 24, 3.9, 3),
    CharClass("url-safe base64", r"[A-Za-z0-9_-]{24,}", 24, 3.9, 3),
)
ALLOWED = (
    r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",
    r"[0-9]{4}-[0-9]{2}-[0-9]{2}[T_-][0-9-]*",
    r"d41d8cd98f00b204e9800998ecf8427e|e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855",
    r"(?:EXAMPLE|example|XXXX|xxxx)",
    r"(?:0123456789|abcdefghij|ABCDEFGHIJ)",
)
_allowed = re.compile("|".join(ALLOWED))


def _kind_of(c: str) -> int:
    return 0 if c.isdigit() else 1 if c.islower() else 2 if c.isupper() else 3


def dense_spans(run: str, rule: CharClass) -> list[tuple[int, int]]:
    """Spans of a run made of windows above the limit. Each step changes the counts of two characters only."""
    w = rule.width
    part = [0.0] + [c * math.log2(c) for c in range(1, w + 2)]  # the new character is counted before the old one leaves
    counts: dict[str, int] = {}
    mixed, kinds, total, spans = [0] * 4, 0, 0.0, []
    for at, new in enumerate(run):
        c = counts.get(new, 0)
        counts[new] = c + 1
        total += part[c + 1] - part[c]
        k = _kind_of(new)
        mixed[k] += 1
        kinds += mixed[k] == 1
        if at >= w:
            old = run[at - w]
            c = counts[old]
            counts[old] = c - 1
            total += part[c - 1] - part[c]
            k = _kind_of(old)
            mixed[k] -= 1
            kinds -= mixed[k] == 0
        if at >= w - 1 and kinds >= rule.kinds and math.log2(w) - total / w >= rule.limit:
            if spans and spans[-1][1] >= at - w + 1:
                spans[-1] = (spans[-1][0], at + 1)
            else:
                spans.append((at - w + 1, at + 1))
    return spans


_runs = [(rule, re.compile(rule.pattern)) for rule in CLASSES]


def entropy_spans(text: str) -> list[tuple[int, int]]:
    found = []
    for m in _candidate.finditer(text):
        piece = m[0]
        if piece.isalpha():
            continue
        allowed = [a.span() for a in _allowed.finditer(piece)]
        for rule, pattern in _runs:
            for run in pattern.finditer(piece):
                for a, b in dense_spans(run[0], rule):
                    a, b = a + run.start(), b + run.start()
                    if not any(a < y and x < b for x, y in allowed):
                        found.append((a + m.start(), b + m.start()))
    joined: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if joined and joined[-1][1] >= a:
            joined[-1] = (joined[-1][0], max(b, joined[-1][1]))
        else:
            joined.append((a, b))
    return joined


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the fixed patterns: leftmost, not overlapping within a kind, failing matches dropped."""
    spans = [(*m.span(), 0) for m in _assign.finditer(text) if len(m[2]) >= 6]
    spans += [(*m.span(), 1) for m in _access.finditer(text) if len(m[0]) >= 20]
    return spans + [(*m.span(), 2) for m in _hex.finditer(text)]


def find_secrets(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans and all spans of a text, by start, then kind. Entropy spans inside a base span add nothing."""
    text = text or ""
    base = base_spans(text)
    more = [(a, b, 3) for a, b in entropy_spans(text) if not any(x <= a and b <= y for x, y, _ in base)]
    order = lambda s: (s[0], s[2], s[1])
    return sorted(base, key=order), sorted(base + more, key=order)


def _written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: ``doc_id``, counts per pattern, ``base_sha256``, ``spans`` and ``n_entropy``.

    Spans are code points, end exclusive. A text without secrets, also a null or empty one, has no spans and the digest
    of the empty string. Repeated rows and null ids are scanned like any other; an empty table gives no rows. Other
    columns are not read.
    """

    def search(texts: list) -> dict:
        found = [find_secrets(t) for t in texts]
        counts = {f"n_{kind}": [sum(s[2] == k for s in spans) for _, spans in found] for k, kind in enumerate(KINDS)}
        digest = [hashlib.sha256(_written(base).encode()).hexdigest() for base, _ in found]
        return {**counts, "base_sha256": digest, "spans": [_written(spans) for _, spans in found]}

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return map_texts(rows, lambda: search, ", ".join(f"n_{kind} long" for kind in KINDS) + ", base_sha256 string, spans string")


def redact(text: str | None, mask: str = "[secret]") -> str | None:
    """The text with every span replaced by ``mask``; overlapping spans are replaced together."""
    if not text:
        return text
    out, at = [], 0
    for a, b, _ in find_secrets(text)[1]:
        if a >= at:
            out += [text[at:a], mask]
        at = max(at, b)
    return "".join(out) + text[at:]
