"""Secret scans by assignment-aware lexing.

Besides three plain kinds (named assignments, access keys, long hex runs) a
small lexer reads lines of source and configuration syntax into name-literal
pairs: ``name = "x"``, ``name: x``, ``"name": "x"``, ``export NAME=x``,
``name := x``, ``<name>x</name>``. Names that are assigned other names take
their literals along (constants are propagated, in either order and over any
number of steps, also through ``+``, which may stand on the next line).
Comments are read like the rest: a secret in one is as public. Each literal is scored by the names that
it reaches and by its own form; those with a score of 1 or more are added as
kind ``flow``.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "flow")

_ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")

_PAIR = re.compile(r"""(?<![\w.-])["']?([A-Za-z_][A-Za-z0-9_.-]*+)["']?[ \t]*+(?::=|=>|[:=](?![:=/]))[ \t]*+""")
_TAG = re.compile(r"<([A-Za-z_][\w.-]*+)>([^<>\n]++)</\1>")
#: Quoted terms go to their closing quote: triple quotes and backticks over any number of lines, the others within their line, past
#: escaped quotes (or, where none but an escaped one closes them, up to that one). Bare terms end at blanks, quotes and ; , { }.
_TERM = re.compile(
    r'''"""((?:[^"\\]++|\\[\s\S]|"(?!""))*+)"""''' + r"""|'''((?:[^'\\]++|\\[\s\S]|'(?!''))*+)'''"""
    r'''|"((?:[^"\\\n]++|\\.)*+)"|'((?:[^'\\\n]++|\\.)*+)'|"([^"\n]*+)"|'([^'\n]*+)'|`([^`]*+)`|([A-Za-z0-9+/_.=~!@#%^&*-]++)'''
)
_BARE = 8
_PLUS = re.compile(r"(?:\s|\\\n)*+\+(?:\s|\\\n)*+")
_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_.-]*+")
#: Parts of a name that tell what is assigned, and how strongly.
_SENSITIVE = {"password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "secret": 1.0, "token": 0.8, "apikey": 1.0, "credential": 0.9, "credentials": 0.9, "private": 0.5, "auth": 0.5, "bearer": 0.8, "access": 0.4, "key": 0.5, "signing": 0.5, "pin": 0.5}
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


def name_score(name: str) -> float:
    """How sensitive a target name is: the sum over its parts (snake, kebab, dotted or camel case), 1.5 at most."""
    parts = [p.lower() for p in _PARTS.findall(name)]
    return min(1.5, sum(_SENSITIVE.get(p, 0) for p in parts) + sum(_SENSITIVE.get(a + b, 0) for a, b in zip(parts, parts[1:], strict=False)))


def literal_score(literal: str) -> float:
    """How much a literal looks like a secret, 0 to 1: length, bits per character, and mixed kinds of characters."""
    if len(literal) < 8 or " " in literal.strip():
        return 0.0
    return _score(Counter(literal), len(literal))


def _score(counts: Counter, n: int) -> float:
    if n < 8:
        return 0.0
    bits = -sum(c / n * math.log2(c / n) for c in counts.values())
    kinds = sum(any(map(re.compile(p).match, counts)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    return min(1.0, 0.15 * bits + 0.1 * kinds) if kinds > 1 else 0.0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the plain kinds, by start and then kind as listed."""
    found = []
    if "=" in text or ":" in text:
        found += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 8]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


class Flow:
    """The assignments of a text as a graph: names, the terms that they take, and for each term the one that follows it after a +.

    A term that several assignments share (``a: b=c + d``) is kept once, so the
    graph grows with the text alone.
    """

    def __init__(self, text: str):
        self.text = text
        #: (start, limit): (start, end, form, next term) of a term; form is _BARE for those without quotes
        self.terms: dict[tuple[int, int], tuple[int, int, int, tuple[int, int] | None]] = {}
        self.heads: dict[str, list[tuple[tuple[int, int], bool]]] = {}
        self._bare = (0, 0)
        self._plus: dict[tuple[int, int], int | None] = {}
        at = 0
        while m := _PAIR.search(text, at):
            at = m.end()
            self._assign(m.group(1), (at, len(text)), True)
        at = 0
        while m := _TAG.search(text, at):
            at = m.start(2)
            self._assign(m.group(1), (at, m.end(2)), False)

    def _assign(self, name: str, key: tuple[int, int], refers: bool) -> None:
        if self._read(key):
            self.heads.setdefault(name, []).append((key, refers))

    def _term(self, at: int, limit: int) -> tuple[int, int, int, int] | None:
        """(start, end, form, place after it)."""
        if self._bare[0] <= at < self._bare[1] <= limit:
            return at, self._bare[1], _BARE, self._bare[1]  # the rest of a run that was read
        if not (m := _TERM.match(self.text, at, limit)):
            return None
        if m.lastindex == _BARE:
            self._bare = m.span()
        return *m.span(m.lastindex), m.lastindex, m.end()

    def _after(self, at: int, limit: int) -> tuple[int, int] | None:
        """The key of the term that a + joins to the one that ends at at; blanks are read once for all terms that end there."""
        if (at, limit) not in self._plus:
            self._plus[at, limit] = m.end() if (m := _PLUS.match(self.text, at, limit)) else None
        return (then, limit) if (then := self._plus[at, limit]) else None

    def _read(self, key: tuple[int, int]) -> bool:
        """Enter the chain of terms at key, up to one that is known."""
        before, first = None, key
        while key not in self.terms and (term := self._term(*key)):
            start, end, form, after = term
            then = self._after(after, key[1])
            self.terms[key] = (start, end, form, then)
            before, key = key, then
            if key is None:
                break
        if before and key is not None and key not in self.terms:  # a + that nothing follows
            self.terms[before] = (*self.terms[before][:3], None)
        return first in self.terms

    def _refers(self, start: int, end: int) -> bool:
        """Whether the term is a reference: a name that is assigned in the text."""
        return bool((m := _NAME.match(self.text, start, end)) and m.end() == end and m.group() in self.heads)

    def targets(self) -> dict[tuple[int, int], float]:
        """(start, end) of each literal that reaches a sensitive name: that name's score, the highest one's."""
        found: dict[tuple[int, int], float] = {}
        names, terms = set(), set()
        for score, name in sorted(((name_score(n), n) for n in self.heads), reverse=True):
            todo = [name] if score and name not in names else []
            names.update(todo)
            while todo:
                for key, refers in self.heads[todo.pop()]:
                    while key and (key, refers) not in terms:
                        terms.add((key, refers))
                        start, end, form, key = self.terms[key]
                        if refers and form == _BARE and self._refers(start, end):
                            if (to := self.text[start:end]) not in names:
                                names.add(to)
                                todo.append(to)
                        elif (start, end) not in found:
                            found[start, end] = score
        return found


def _literal_scores(text: str, spans: list[tuple[int, int]]) -> dict[tuple[int, int], float]:
    """literal_score of each span; those with the same end share their counts."""
    by_end: dict[int, list[int]] = {}
    for start, end in spans:
        by_end.setdefault(end, []).append(start)
    out = {}
    for end, starts in by_end.items():
        if len(starts) == 1 or " " in text[min(starts) : end]:
            out.update({(a, end): literal_score(text[a:end]) for a in starts})
            continue
        counts, at = Counter(), end
        for a in sorted(starts, reverse=True):
            counts.update(text[a:at])
            at = a
            out[a, end] = _score(counts, end - a)
    return out


def flow_spans(text: str) -> list[tuple[int, int, str]]:
    """Literals that reach sensitive names."""
    if not ("=" in text or ":" in text or "</" in text):
        return []
    targets = Flow(text).targets()
    scores = _literal_scores(text, list(targets))
    return sorted((start, end, "flow") for (start, end), target in targets.items() if scores[start, end] and target * 0.6 + scores[start, end] >= 1)


def scan(text: str | None) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(base spans, all spans) of a text; flow spans that lie in a base span aren't repeated."""
    text = text or ""
    base = base_spans(text)
    starts, ends = [b[0] for b in base], list(accumulate((b[1] for b in base), max))
    extra = [f for f in flow_spans(text) if not ((i := bisect_right(starts, f[0])) and f[1] <= ends[i - 1])]
    return base, sorted(base + extra, key=lambda s: (s[0], KINDS.index(s[2])))


SPANS = "base array<struct<kind:string,start:int,end:int>>, spans array<struct<kind:string,start:int,end:int>>"
_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def find(docs: DataFrame, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """(doc_id, base, spans) per row: spans in code points, ends exclusive. Null texts count as empty; null ids stay null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        as_rows = lambda spans: [{"kind": k, "start": a, "end": b} for a, b, k in spans]
        for batch in batches:
            found = [scan(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([as_rows(f[i]) for f in found], _SPAN) for i in (0, 1))], ["doc_id", "base", "spans"])

    return docs.select(F.col(ident).cast("long").alias("doc_id"), F.col(text).alias("__text")).mapInArrow(run, f"doc_id long, {SPANS}")
