"""Secret scans by multipart credential linking.

A credential usually has parts: an access identifier, a secret and an endpoint. Parts that are telling alone are the base
kinds ``assign``, ``access`` and ``hex`` and are always reported. Weak parts (short passwords, user names, temporary key ids,
addresses) are joined by position: two parts link if they lie in one scope (text between blank lines) and at most ``reach``
code points apart. A weak part is reported only if its complements link to it.

* A weak secret needs a base access key, or any identifier together with an endpoint.
* A weak identifier needs a base secret, or any secret together with an endpoint.
* An endpoint needs both an identifier and a secret.

Parts may lie inside one another, as in the query of an address: base spans come first, then identifiers, secrets and endpoints.
A secret or an endpoint that runs into another part ends before it.

The join runs inside each document on sorted positions with binary search, so it takes n log n steps for n parts and no
shuffle: a document is one row, and a long text is scanned whole. Null and empty texts have no span, an empty table gives an
empty result. Repeated rows are scanned alike. Of spans at one start, kinds are listed in the order of KINDS. Columns other than
id and text aren't read, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import texts

#: Order in which kinds at one start are listed.
KINDS = ("assign", "access", "hex", "identifier", "secret", "endpoint")
ASSIGN = re.compile(r"""(?i:(?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
ASSIGN_HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
#: Weak parts.
IDENTIFIER = re.compile(
    r"""AKIA[A-Z0-9]{8,}|(?:ASIA|AROA|AIDA)[A-Z0-9]{12,}"""
    r"""|(?i:user(?:_?name)?|login|account|client_?id|access_?key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@+-]{3,}""",
    re.A,
)
SECRET = re.compile(
    r"""(?i:pwd|pass(?:word|wd|phrase)?|secret(?:_?key)?|token|api_?key|auth|private_?key)["']?\x20*[:=]\x20*["']?(?:[A-Za-z0-9+/_.=!@#$%^*-]|&(?![A-Za-z0-9_.-]+=)){4,}"""
    r"""|(?P<bare>)(?<![A-Za-z0-9+/=_-])(?=[A-Za-z0-9+/]*[A-Z])(?=[A-Za-z0-9+/]*[a-z])(?=[A-Za-z0-9+/]*[0-9])[A-Za-z0-9+/]{20,}={0,2}(?![A-Za-z0-9+/=_-])""",
    re.A,
)
ENDPOINT = re.compile(
    r"""[A-Za-z][A-Za-z0-9+.-]{1,15}://[^\s"'<>]{3,}|(?i:host(?:name)?|endpoint|server|url)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.:/_-]{3,}""",
    re.A,
)
BLANK = re.compile(r"\n[ \t\r]*\n")
SPANS = "array<struct<kind:string,start:int,end:int,base:boolean>>"


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the base kinds, each kind leftmost and without overlap, in reporting order."""
    found = []
    low = text.lower()
    if any(h in low for h in ASSIGN_HINTS):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 12]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text)]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


class _Parts:
    """Spans by position; asks whether one links to a given span. Spans that overlap hold no blank line and count as one."""

    def __init__(self, spans: list[tuple[int, int]], cuts: list[int], reach: int):
        self.spans = _disjoint(spans)
        self.starts = [s for s, _ in self.spans]
        self.ends = [e for _, e in self.spans]
        self.cuts, self.reach = cuts, reach

    def linked(self, start: int, end: int) -> bool:
        """Whether a span of these lies within reach and scope. The span itself is none of these."""
        k = bisect_left(self.starts, start)
        # The scope lies between the nearest blank lines; only the nearest spans on either side can be the closest.
        c, d = bisect_right(self.cuts, start), bisect_left(self.cuts, end)
        above, below = self.cuts[c - 1] if c else -1, self.cuts[d] if d < len(self.cuts) else 1 << 60
        return any(above < self.starts[i] < below and self.ends[i] >= start - self.reach and self.starts[i] <= end + self.reach for i in (k - 1, k) if 0 <= i < len(self.spans))


def credential_spans(text: str, reach: int = 200) -> list[tuple[str, int, int, bool]]:
    """All spans of a text as (kind, start, end, base), by start and then kind."""
    base = base_spans(text)
    spans = [(*s, True) for s in base]
    taken = _disjoint([(s, e) for _, s, e in base])
    identifiers = _outside(IDENTIFIER, text, taken)
    keys = [(s, e) for k, s, e in base if k == "access"]
    if identifiers or keys:
        secrets = _trimmed(SECRET, text, _disjoint(taken + identifiers))
        strong = [(s, e) for k, s, e in base if k != "access"]
        if secrets or strong:
            endpoints = _trimmed(ENDPOINT, text, _disjoint(taken + identifiers + secrets))
            cuts = [m.start() for m in BLANK.finditer(text)]
            part = lambda x: _Parts(x, cuts, reach)
            key, who = part(keys), part(keys + identifiers)
            sure, what, where = part(strong), part(strong + secrets), part(endpoints)
            spans += [("secret", *x, False) for x in secrets if key.linked(*x) or who.linked(*x) and where.linked(*x)]
            spans += [("identifier", *x, False) for x in identifiers if sure.linked(*x) or what.linked(*x) and where.linked(*x)]
            spans += [("endpoint", *x, False) for x in endpoints if who.linked(*x) and what.linked(*x)]
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def _disjoint(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of spans, as sorted disjoint spans."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s < out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _outside(pattern: re.Pattern, text: str, taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Matches that overlap none of the given disjoint spans."""
    starts = [s for s, _ in taken]
    out = []
    for m in pattern.finditer(text):
        k = bisect_left(starts, m.end())
        if not k or taken[k - 1][1] <= m.start():
            out.append(m.span())
    return out


def _trimmed(pattern: re.Pattern, text: str, taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Matches, those that run into one of the given disjoint spans up to it, and addresses then up to their query. What is
    left must be a match itself. Bare tokens aren't cut."""
    starts = [s for s, _ in taken]
    out = []
    for m in pattern.finditer(text):
        start, end = m.span()
        k = bisect_right(starts, start)
        if k and taken[k - 1][1] > start:
            continue
        if k < len(taken) and starts[k] < end:
            if m.groupdict().get("bare") is not None:
                continue
            left = text[start : starts[k]]
            left = (left.split("?")[0] if "://" in left else left).rstrip("&;")
            if not (m := pattern.match(text, start, start + len(left))):
                continue
        out.append(m.span())
    return out


def scan_secrets(docs: DataFrame, reach: int = 200, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document: its id and ``spans``, an array of (kind, start, end, base) in code points, end exclusive."""
    slim = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))
        for b in batches:
            rows = [[dict(zip(("kind", "start", "end", "base"), s)) for s in credential_spans(t, reach)] for t in texts(b)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, kind)], ["doc_id", "spans"])

    return slim.mapInArrow(scan, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, spans {SPANS}")


def joined(spans: list[tuple]) -> str:
    return ",".join(f"{s[0]}:{s[1]}:{s[2]}" for s in spans)


def base_digest(spans: list[tuple]) -> str:
    return hashlib.sha256(joined(spans).encode()).hexdigest()
