"""Secret scan with multipart credential linking.

Strong patterns (assignments, access identifiers, hexadecimal runs) are reported wherever they match. Weak parts, a
bare key-like token, a network endpoint or an account name, prove nothing alone: they are joined by position to the
scope of an identifier and reported only where an identifier and a secret both lie in that scope.

Scopes never cross documents, so the interval join of identifiers and parts is one of sorted lists inside a document.

Offsets are code points, ends exclusive; the span of an assignment is the whole match.

Defined cases: a null text is empty; repeated rows are scanned each; of spans that start together the kind listed first
comes first; a very long text is searched whole, in time that grows with it and the spans found; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.common import edit_batches

# The strong patterns and the least length of a match that counts.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_LEAST, ACCESS_LEAST = 12, 18

KINDS = ("assign", "access", "hex", "account", "key", "endpoint")
_RANK = {kind: i for i, kind in enumerate(KINDS)}
SCOPE = 240
_ACCOUNT = re.compile(r"""\b(?:user(?:name)?|login|account|client_id|access_key_id)["']?[ \t]*[:=][ \t]*["']?([A-Za-z0-9._@+-]{3,})""", re.I | re.A)
_KEY = re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z0-9+/_=-]*[0-9])(?=[A-Za-z0-9+/_=-]*[A-Za-z])[A-Za-z0-9+/_=-]{20,}")
_ENDPOINT = re.compile(r"\b[a-z][a-z0-9+.-]{1,15}://[^\s\"'<>]{4,}|\b\d{1,3}(?:\.\d{1,3}){3}(?::\d{2,5})?\b", re.A)

Span = tuple[int, str, int]


def base_spans(text: str) -> list[Span]:
    """Strong matches as (start, kind, end), by start and then kind as listed."""
    found = [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    found += [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]
    return sorted(found, key=_order)


def _order(span: Span) -> tuple[int, int, int]:
    return span[0], _RANK[span[1]], span[2]


def linked_spans(text: str, base: list[Span]) -> list[Span]:
    """Weak parts inside the scope of an identifier that also has a secret in its scope.

    The scope of an identifier is its span and SCOPE code points on each side. Spans of one kind are disjoint, so
    their starts and their ends are in one order, and each scope takes its parts by two bisections for each kind.
    """
    identifiers = [s for s in base if s[1] == "access"] + [(m.start(), "account", m.end()) for m in _ACCOUNT.finditer(text)]
    if not identifiers:
        return []
    covered = _merged(base)
    begins = [s for s, _ in covered]

    def bare(span: Span) -> bool:
        """Whether no base span overlaps: of disjoint ones only the last that starts before its end can."""
        at = bisect_left(begins, span[2])
        return not at or covered[at - 1][1] <= span[0]

    parts = {kind: [s for s in base if s[1] == kind] for kind in ("assign", "hex")}
    for kind, pattern in (("key", _KEY), ("endpoint", _ENDPOINT)):
        parts[kind] = [s for m in pattern.finditer(text) if bare(s := (m.start(), kind, m.end()))]
    edges = {kind: ([s for s, _, _ in spans], [e for _, _, e in spans]) for kind, spans in parts.items()}
    out = set()
    for identifier in identifiers:
        low, high = identifier[0] - SCOPE, identifier[2] + SCOPE
        near = {k: spans[bisect_right(edges[k][1], low) : bisect_left(edges[k][0], high)] for k, spans in parts.items()}
        near = {k: [p for p in spans if p[2] <= identifier[0] or identifier[2] <= p[0]] for k, spans in near.items()}
        if near["assign"] or near["hex"] or near["key"]:
            out.update(near["key"], near["endpoint"], [identifier] if identifier[1] == "account" else [])
    return sorted(out, key=_order)


def _merged(spans: list[Span]) -> list[tuple[int, int]]:
    """The same cover as disjoint intervals in order."""
    out: list[tuple[int, int]] = []
    for start, _, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


def scan(text: str | None) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans: base and linked ones in one order."""
    text = text or ""
    base = base_spans(text)
    linked = linked_spans(text, base)
    return base, sorted(base + linked, key=_order) if linked else base


def written(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, kind, end in spans)


def redact(text: str, spans: list[Span], mark: str = "[REDACTED]") -> str:
    """``text`` with every maximal run of spans replaced by ``mark``."""
    out, at = [], 0
    for start, end in _merged(spans):
        out += [text[at:start], mark]
        at = end
    return "".join([*out, text[at:]])


def redacted(documents: DataFrame) -> DataFrame:
    """The documents with every span replaced by a mark, and ``n_chars``, if there, counted again; nulls stay."""

    def edit(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t and redact(t, scan(t)[1]) for t in batch.column("text").to_pylist()]
        for name, values in (("text", texts), ("n_chars", [None if t is None else len(t) for t in texts])):
            if name in batch.schema.names:
                at = batch.schema.get_field_index(name)
                batch = batch.set_column(at, batch.schema.field(at), pa.array(values, batch.schema.field(at).type))
        return batch

    return edit_batches(documents, edit)
