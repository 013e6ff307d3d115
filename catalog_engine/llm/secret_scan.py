"""Secret scans by assignment-aware lexing (operator 4).

Texts are read as source and configuration: every assignment gives a target name and a value of
string literals, bare words and names, which may be concatenated. In ``name: type = value`` both names
are targets, since a log line may read the same. A bare value that holds operators is taken whole, and
if it is no secret read again from the first of them. Names keep a reference to their value, so a
literal that reaches a sensitive name through constants, however many, is found where it stands. A
literal is scored by its target name and by how random it looks. Three base patterns are applied as
well.

Null and empty texts have no spans. Offsets are code points, ends exclusive. Repeated rows give
repeated rows, an empty table an empty one. Work grows with the length of a text, however many of its
assignments build on each other.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from itertools import accumulate
from typing import NamedTuple

from pyspark.sql import DataFrame

from catalog_engine.llm.common import map_rows

#: Kinds of spans; the order breaks ties of spans that start together.
KINDS = ("assign", "access", "hex", "lexed")
THRESHOLD = 0.6
#: Names of types, which are no constants.
TYPES = frozenset("str string String bytes int integer number float bool boolean char any Any object".split())

ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # runs are whole: a shorter one cannot hide a longer

_OPERATOR = re.compile(r"(?<![=!<>:+*/%-])(?::=|=>|=(?![=~>])|:(?![:=/]))")
_NAME = re.compile(r"""["'`]?\]?[ \t]*$""")
_SPACE = re.compile(r"[ \t]*")
_LITERAL = re.compile(
    r"""(?:[rRbBuUfF]{0,2})(\"{3}|'{3}|["'`])""",
)
_BARE = re.compile(r"""[^\s"'`,;{}()\[\]<>+]+""")
_INNER = re.compile(r"(?<=[\w\]])[=:](?![=:/~>])(?=.)", re.DOTALL)
#: A type after a colon, up to its equals sign.
_TYPED = re.compile(
    r"""[ \t]*(?:&[ \t]*)?(?:'\w+[ \t]+)?(?:mut[ \t]+)?"""
    r"""([A-Za-z_$][\w.$]*+)(?:\[[^\n=;"'`]*\]|<[^\n=;"'`]*>)?(?:\[\])*\??"""
    r"""(?:[ \t]*[|&][ \t]*[A-Za-z_$][\w.$<>\[\]]*+)*+[ \t]*=(?![=~>])"""
)
_REFERENCE = re.compile(r"[A-Za-z_$][A-Za-z0-9_.$]*")
_JOIN = re.compile(r"[ \t]*(?:\+|\.\.|&|\|\|)[ \t]*|[ \t]+(?=[\"'])")
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")

#: Words of a target name that make it sensitive, with their weight.
SENSITIVE = {
    "password": 1.0,
    "passwd": 1.0,
    "passphrase": 1.0,
    "pwd": 0.9,
    "secret": 1.0,
    "token": 0.9,
    "apikey": 1.0,
    "credential": 0.9,
    "credentials": 0.9,
    "bearer": 0.9,
    "auth": 0.7,
    "authorization": 0.8,
}
#: Words that make a following "key" sensitive.
KEY_OWNERS = ("api", "access", "private", "secret", "encryption", "signing", "auth", "account")
#: Words that say that the name holds something about a secret.
HARMLESS = frozenset(
    "public len length count size name path file url uri type field label hint prompt max min "
    "limit expiry expires ttl regex pattern policy required id".split()
)
PLACEHOLDERS = re.compile(
    r"(?i)^(?:x+|\*+|\.+|none|null|true|false|undefined|todo|changeme|change_me|example.*|"
    r"your[_-].*|my[_-].*|placeholder.*|dummy.*|test|sample.*|redacted|\$\{.*|%\(.*|\{\{.*)$"
)


#: Those that may go on; the longest beginning of one has fewer characters than HEAD.
OPEN_PLACEHOLDERS = re.compile(
    r"(?i)^(?:example|your[_-]|my[_-]|placeholder|dummy|sample|\$\{|%\(|\{\{)"
)
HEAD = 64


class Span(NamedTuple):
    kind: str
    start: int
    end: int


class Atom(NamedTuple):
    start: int
    end: int
    value: str


def name_score(name: str) -> float:
    """How sensitive a target name is, from 0 to 1."""
    parts = [p.lower() for p in _PARTS.findall(name)]
    if any(p in HARMLESS for p in parts):
        return 0.0
    best = max((SENSITIVE.get(p, 0.0) for p in parts), default=0.0)
    if any(b == "key" and a in KEY_OWNERS for a, b in zip(parts, parts[1:])):
        best = 1.0
    return best


class Value:
    """Literals in a row, of a value and of the constants it refers to. What its score needs is kept,
    so that adding to a long constant does not read it again."""

    __slots__ = ("parts", "counts", "length", "head", "tail", "is_url", "score", "is_marked")

    def __init__(self, parts: list):
        self.parts = parts
        self.counts: Counter | None = None
        self.length, self.head, self.tail, self.is_url = 0, "", "", False
        self.score: float | None = None
        self.is_marked = False
        for part in parts:
            if isinstance(part, Value):
                self._add(part.length, part.head, part.tail, part.is_url)
                if self.counts is None:
                    self.counts = part.counts.copy()
                else:
                    self.counts.update(part.counts)
            else:
                text = part.value
                self._add(len(text), text[:HEAD], text[-2:], "://" in text)
                if self.counts is None:
                    self.counts = Counter()
                self.counts.update(text)

    def _add(self, length: int, head: str, tail: str, is_url: bool) -> None:
        self.is_url |= is_url or "://" in self.tail + head[:2]
        if len(self.head) < HEAD:
            self.head = (self.head + head)[:HEAD]
        self.length += length
        self.tail = (self.tail + tail)[-2:]

    def looks_secret(self) -> float:
        """How much the whole looks like a secret, from 0 to 1: length, entropy, mixed characters."""
        if self.score is None:
            self.score = self._score()
        return self.score

    def _score(self) -> float:
        counts, length = self.counts, self.length
        if length < 6 or self.is_url or " " in counts or self._is_placeholder():
            return 0.0
        entropy = -sum(n / length * math.log2(n / length) for n in counts.values())
        kinds = sum(
            any(test(c) for c in counts) for test in (str.islower, str.isupper, str.isdigit)
        ) + any(not c.isalnum() for c in counts)
        if kinds == 1 and length < 20:
            return 0.3 * min(1.0, entropy / 3)  # a plain word or number
        return min(1.0, entropy / 3.2) * min(1.0, 0.55 + 0.15 * kinds)

    def _is_placeholder(self) -> bool:
        if self.length <= HEAD:
            return bool(PLACEHOLDERS.match(self.head))
        # A long one is a run of one mark, or goes on behind what it begins with in one line.
        if set(self.counts) <= {"x", "X"} or len(self.counts) == 1 and self.head[0] in "*.":
            return True
        return bool(OPEN_PLACEHOLDERS.match(self.head)) and "\n" not in self.counts

    def mark(self) -> list[Atom]:
        """Its literals, but for those that an earlier mark has given."""
        out, left = [], [self]
        while left:
            value = left.pop()
            if value.is_marked:
                continue
            value.is_marked = True
            out += [p for p in value.parts if isinstance(p, Atom)]
            left += [p for p in value.parts if isinstance(p, Value)]
        return out


def literal_score(value: str) -> float:
    return Value([Atom(0, len(value), value)]).looks_secret()


def _target(text: str, at: int) -> str:
    """The name that ends before an operator, without its quotes; dotted names whole."""
    end = at
    while end and text[end - 1] in " \t":
        end -= 1
    if end and text[end - 1] == "]":
        end -= 1
    if end and text[end - 1] in "\"'`":
        end -= 1
    start = end
    while start and (text[start - 1].isalnum() or text[start - 1] in "_-.$"):
        start -= 1
    return text[start:end].strip("-.$")


def _value(text: str, at: int, known: dict[str, Value], cut: int) -> tuple[list, int, int]:
    """Literals and values of constants that make the value at a place, where it ends, and where
    its first bare word with an operator begins (-1 if there is none). Before ``cut`` such a
    word ends before the operator, and the value with it."""
    parts: list = []
    inner = -1
    while True:
        if quoted := _LITERAL.match(text, at):
            mark = quoted[1]
            start = at = quoted.end()
            while (end := text.find(mark, at)) > 0 and text[end - 1] == "\\":
                at = end + 1
            line = text.find("\n", start)
            if end < 0 or len(mark) == 1 and mark != "`" and 0 <= line < end:
                return parts, start, inner  # the quote is not closed
            parts.append(Atom(start, end, text[start:end]))
            at = end + len(mark)
        elif (
            cut
            and (operator := _INNER.search(text, at, cut))
            and (bare := _BARE.match(text, at, operator.start()))
            and bare.end() == operator.start()
        ):
            parts.append(known[bare[0]] if bare[0] in known else Atom(*bare.span(), bare[0]))
            return parts, bare.end(), at
        elif bare := _BARE.match(text, at):
            if inner < 0 and _INNER.search(text, at, bare.end()):
                inner = at
            word = bare[0].rstrip(".:")
            at = bare.end()
            if word in known:
                parts.append(known[word])
            elif word and not (_REFERENCE.fullmatch(word) and text[at : at + 1] in ("(", "[")):
                parts.append(Atom(bare.start(), bare.start() + len(word), word))
        else:
            return parts, at, inner
        if joined := _JOIN.match(text, at):
            at = joined.end()
        else:
            return parts, at, inner


def lex(text: str, threshold: float = THRESHOLD) -> list[Span]:
    """Literals that reach sensitive names."""
    known: dict[str, Value] = {}
    found: dict[tuple[int, int], None] = {}
    past = cut_until = tried_until = 0
    for operator in _OPERATOR.finditer(text):
        start, end = operator.span()
        if start < past:
            continue  # inside a value that has been read
        if operator[0] == ":" and text[start - 1 : start] in ("?", "!"):
            start -= 1
        name = _target(text, start)
        if not name or name[0].isdigit():
            continue
        names = [name]
        if operator[0] == ":" and (typed := _TYPED.match(text, end)):
            end = typed.end()
            names.append(typed[1])
        weight = max(name_score(n.rsplit(".", 1)[-1]) for n in names)
        # A bare word is read whole once, and once more for a sensitive name inside: so that the
        # work does not grow with its operators.
        inside = start < cut_until
        cut = cut_until if inside and (not weight or start < tried_until) else 0
        parts, past, inner = _value(text, _SPACE.match(text, end).end(), known, cut)
        ends = past
        if inner >= 0:
            past = inner
            if not cut:
                cut_until = max(cut_until, ends)
                if inside:
                    tried_until = ends
        if not parts:
            continue
        # One constant alone is just another name of it.
        value = parts[0] if len(parts) == 1 and isinstance(parts[0], Value) else Value(parts)
        for n in names:
            if n not in TYPES:
                known[n] = value
        if weight and weight * value.looks_secret() >= threshold:
            found |= dict.fromkeys((a.start, a.end) for a in value.mark() if a.end > a.start)
            past = max(past, ends)
    return [Span("lexed", *place) for place in found]


def base_spans(text: str) -> list[Span]:
    """The base patterns: matches are found first and failing ones dropped after."""
    spans = []
    if "=" in text or ":" in text:
        spans += [Span("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        spans += [Span("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    spans += [Span("hex", *m.span()) for m in HEX.finditer(text)]
    return spans


def ordered(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s.start, KINDS.index(s.kind), s.end))


def find(text: str | None, threshold: float = THRESHOLD) -> list[Span]:
    """All spans of a text: the base ones, and lexed literals that no base span covers."""
    if not text:
        return []
    base = base_spans(text)
    lexed = lex(text, threshold) if "=" in text or ":" in text else []
    if base and lexed:
        # How far base spans reach that begin at a place or before it.
        begins = sorted(base, key=lambda b: b.start)
        starts, reach = [b.start for b in begins], list(accumulate((b.end for b in begins), max))
        at = [bisect_right(starts, s.start) for s in lexed]
        lexed = [s for s, i in zip(lexed, at) if not i or reach[i - 1] < s.end]
    return ordered(base + lexed)


def redact(text: str, spans: list[Span], mark: str = "[SECRET]") -> str:
    """The text with every span replaced; spans that overlap get one mark."""
    out, at = [], 0
    for span in spans:
        if span.end <= at:
            continue
        if span.start >= at:
            out += (text[at : span.start], mark)
        at = span.end
    return "".join([*out, text[at:]])


def scan(
    docs: DataFrame, text: str = "text", key: str = "doc_id", threshold: float = THRESHOLD
) -> DataFrame:
    """``key`` and ``spans``, an array of (kind, start, end) by start, then kind."""
    kind = docs.schema[key].dataType.simpleString()

    def make():
        return lambda keys, texts: {key: keys, "spans": [[s._asdict() for s in find(t, threshold)] for t in texts]}

    schema = f"`{key}` {kind}, spans array<struct<kind:string,start:bigint,end:bigint>>"
    return map_rows(docs, [key, text], make, schema)


def scrub(docs: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents with every span of ``text`` replaced by a mark; other columns as they are."""
    names = [text, *(c for c in docs.columns if c != text)]

    def make():
        def run(texts, *rest):
            clean = [None if t is None else redact(t, find(t, threshold)) for t in texts]
            return dict(zip(names, [clean, *rest]))

        return run

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)
    return map_rows(docs, names, make, schema).select(*docs.columns)
