"""Secret scans by assignment-aware lexing of source and configuration text (operator 7).

Base kinds are plain patterns: ``assign``, ``access`` and ``hex``. On top, the text is lexed into
name-literal pairs: assignments (``name = "x"``, ``export NAME=x``, ``name: x``, triple-quoted and
block texts too), calls (``set("name", "x")``), elements and key-value attributes of markup. Under a
``name:`` of lesser indent a pair has that name as well. A constant that is assigned to another name,
or joined with ``+``, is followed to its literals, from top to bottom and without scopes; comments
are lexed like code. A literal is scored by how sensitive the names are that it ends up in. Spans
are code points, end exclusive.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, texts, tidy

#: Order of kinds at equal starts; ``lexed`` spans are the method's own.
KINDS = ("assign", "access", "hex", "lexed")

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
_ASSIGN_WORDS = ("passw", "secret", "token", "api")

#: A name with its assignment sign, at a line's start or after a separator.
NAME = re.compile(r"""(?:^|[\s,;{(\[&])(?:export\s+|const\s+|let\s+|var\s+|final\s+|static\s+)?["']?([A-Za-z_][A-Za-z0-9_.\-]*+)["']?[ \t]*(?:=>|:=|=(?!=)|:(?![:/]))[ \t]*""", re.M)
#: One term of a value: a quoted literal, a name, or a bare word.
TERM = re.compile(r"""(?:[rbuf]?\"{3}((?:[^\\]|\\.)*?)\"{3}|[rbuf]?"((?:[^"\\\n]|\\.)*)"|[rbuf]?'((?:[^'\\\n]|\\.)*)'|([A-Za-z0-9+/_.=\-$@!%^*~]+))[ \t]*""")

#: A name and its literal as neighbouring arguments, as attributes of one tag, and as an element.
CALL = re.compile(r"""\(\s*["']([A-Za-z_][A-Za-z0-9_.\-]*+)["']\s*,\s*(?:"((?:[^"\\\n]|\\.)*)"|'((?:[^'\\\n]|\\.)*)')""")
ATTRIBUTES = re.compile(r"""<[^<>]*?\b(?:key|name|id)\s*=\s*["']([^"'<>\n]*)["'][^<>]*?\bvalue\s*=\s*(?:"([^"<>\n]*)"|'([^'<>\n]*)')""")
ELEMENT = re.compile(r"""<([A-Za-z_][A-Za-z0-9_.\-]*+)>([^<>\s]+)()</\1>""")

#: Weight of a part of a name.
SENSITIVE = {"password": 3.0, "passwd": 3.0, "passphrase": 3.0, "pwd": 3.0, "secret": 3.0, "token": 2.5, "apikey": 3.0, "credential": 2.5, "credentials": 2.5, "auth": 1.5, "private": 1.5, "access": 1.0, "api": 1.0, "key": 1.5, "signature": 1.0, "bearer": 2.0, "session": 1.0}
#: Literals that stand for a secret to be filled in.
PLACEHOLDERS = {"changeme", "example", "placeholder", "password", "secret", "undefined", "redacted", "required", "optional"}
LEAST_SCORE = 3.0
LEAST_CHARS = 8


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Leftmost non-overlapping matches of each base kind that pass its length rule."""
    out: list[tuple[int, int, str]] = []
    low = text.lower()
    if any(w in low for w in _ASSIGN_WORDS):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return out


def name_weight(name: str) -> float:
    """How sensitive a name is: the sum over its parts, split at signs and camel case."""
    parts = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name).lower().replace("-", "_").replace(".", "_").split("_")
    return sum(SENSITIVE.get(p, SENSITIVE.get(p.removesuffix("s"), 0.0)) for p in parts)


class Value:
    """What a constant is made of, with what its score needs; parts are spans or earlier values."""

    __slots__ = ("parts", "size", "kinds", "chars", "blank", "short")

    def __init__(self):
        self.parts, self.size, self.kinds, self.chars, self.blank, self.short = [], 0, 0, frozenset(), False, ""

    def add(self, other: Value) -> None:
        self.parts.append(other)
        self.size += other.size
        self.kinds |= other.kinds
        self.blank |= other.blank
        if len(self.chars) < 4:
            self.chars |= other.chars
        self.short = self.short + other.short if self.short is not None and other.short is not None and self.size <= 16 else None

    @classmethod
    def of(cls, text: str, a: int, b: int) -> Value:
        v, t = cls(), text[a:b]
        v.parts, v.size, v.blank, v.short = [(a, b)], b - a, bool(re.search(r"\s", t)), t if b - a <= 16 else None
        v.kinds = sum(1 << k for k, p in enumerate(("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]")) if re.search(p, t))
        v.chars = frozenset(t)
        return v

    def score(self) -> float:
        """Likeness to a secret: length, mix of character classes, no blanks."""
        if self.size < LEAST_CHARS or self.short is not None and self.short.lower() in PLACEHOLDERS or len(self.chars) < 4:
            return -9.0
        return 0.5 * (self.kinds.bit_count() - 1) + (0.5 if self.size >= 16 else 0.0) - (2.0 if self.blank else 0.0)


def _spans(values: list[Value]) -> set[tuple[int, int]]:
    """All literals that values rest on; each value is looked at once."""
    out, seen, todo = set(), set(), list(values)
    while todo:
        v = todo.pop()
        if id(v) in seen:
            continue
        seen.add(id(v))
        for p in v.parts:
            if isinstance(p, Value):
                todo.append(p)
            elif p[1] > p[0]:
                out.add(p)
    return out


def _block_text(text: str, at: int, indent: int) -> tuple[int, int]:
    """The lines after ``at`` that stand deeper than ``indent``."""
    a = end = text.find("\n", at) + 1
    while a and end < len(text):
        z = text.find("\n", end)
        line = text[end:z if z >= 0 else len(text)]
        if line.strip() and len(line) - len(line.lstrip(" ")) <= indent:
            break
        end = z + 1 if z >= 0 else len(text)
    block = text[a:end].rstrip()
    return (a + len(block) - len(block.lstrip()), a + len(block)) if a else (at, at)


def lexed_spans(text: str) -> list[tuple[int, int, str]]:
    """Literals that reach a sensitive name, directly or by way of other constants."""
    known: dict[str, Value] = {}
    found: list[Value] = []

    def judge(weight: float, value: Value, quoted: bool) -> None:
        if weight > 0 and weight + value.score() + 0.5 * quoted >= LEAST_SCORE:
            found.append(value)

    above: list[tuple[int, float]] = []  # indent and weight of open ``name:`` lines
    for m in NAME.finditer(text) if "=" in text or ":" in text else ():
        at, value, quoted = m.end(), Value(), False
        indent, weight = -1, name_weight(m[1])
        if text[m.end(1):at].lstrip("\"'")[:2].strip() == ":":
            start = text.rfind("\n", 0, m.start(1)) + 1
            indent = m.start(1) - start
            if not text[start:m.start(1)].strip(" \"'"):
                while above and above[-1][0] >= indent:
                    above.pop()
                weight += sum(w for _, w in above)
                if text[at:at + 1] in ("\n", ""):
                    above.append((indent, name_weight(m[1])))
                    continue
                if text[at:at + 1] in ("|", ">") and text[at:text.find("\n", at) if "\n" in text[at:at + 8] else at + 1].strip("|>+- \t0123456789") == "":
                    a, z = _block_text(text, at, indent)
                    value.add(Value.of(text, a, z))
                    value.blank = False  # line ends of a key are no blanks
                    known[m[1]] = value
                    judge(weight, value, True)
                    continue
        while t := TERM.match(text, at):
            g = next(k for k in (1, 2, 3, 4) if t[k] is not None)
            if g < 4:
                value.add(Value.of(text, *t.span(g)))
                quoted = True
            elif t[4] in known:
                value.add(known[t[4]])
            elif not value.parts:
                value.add(Value.of(text, *t.span(4)))
            at = t.end()
            if text[at:at + 1] != "+":
                break
            at += 1
            while text[at:at + 1] in (" ", "\t"):
                at += 1
        if value.parts:
            known[m[1]] = value
            judge(weight, value, quoted)
    for pattern in [CALL] * ("(" in text) + [ATTRIBUTES, ELEMENT] * ("<" in text):
        for m in pattern.finditer(text):
            judge(name_weight(m[1]), Value.of(text, *m.span(2 if m[2] is not None else 3)), pattern is not ELEMENT)
    return [(a, b, "lexed") for a, b in sorted(_spans(found))]


def spans_of(text: str) -> list[tuple[int, int, str]]:
    """All spans by start, then kind as listed in KINDS, then end."""
    return sorted(base_spans(text) + lexed_spans(text), key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def redact(text: str, spans: list[tuple[int, int, str]], mark: str = "[SECRET]") -> str:
    """The text with each run of overlapping spans replaced by ``mark``."""
    out, at = [], 0
    for a, b, _ in spans:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def scan(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Spans and redacted text of every document, and the columns named by ``keep``; one row out for each row in, no shuffle.

    Reads ``doc_id`` and ``text``; other columns are ignored. Null or empty text: no spans, empty
    redacted text. Null doc_ids and repeated rows are scanned like others; very long texts are scanned
    whole, in time linear in their length; spans with equal starts go by kind, then end; no rows give
    no rows.
    """
    keep = keep or []
    small_batches(docs.sparkSession)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), texts(b, "text")):
                s = spans_of(text)
                base = [x for x in s if x[2] != "lexed"]
                n = [sum(x[2] == k for x in base) for k in KINDS[:3]]
                rows.append((doc, *n, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(s), redact(text, s)))
            cols = list(zip(*rows)) if rows else [()] * 7
            yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 4 + [pa.string()] * 3)), *b.columns[2:]],
                                             names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "redacted", *[f"kept_{k}" for k in range(len(keep))]])

    source = docs.select("doc_id", "text", *[F.col(c).alias(f"kept_{k}") for k, c in enumerate(keep)])
    kept = "".join(f", kept_{k} {docs.schema[c].dataType.simpleString()}" for k, c in enumerate(keep))
    out = source.mapInArrow(tidy(task), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, redacted string" + kept)
    return out.withColumnsRenamed({f"kept_{k}": c for k, c in enumerate(keep)})
