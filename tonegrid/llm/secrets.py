"""Secret scan with a trigram inverted index.

From each rule's regular expression a Boolean query over trigrams is derived that every match
fulfils.  A block of documents is indexed by the trigrams that some query asks for, the postings
are intersected and united as the query says, and only the candidates are searched with the
expression itself.  A rule without mandatory trigrams searches every document.  The index lives
and dies with its block: nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import append_columns, set_aside

try:
    from re import _constants as C
    from re import _parser as parser
except ImportError:  # Python before 3.11
    import sre_constants as C
    import sre_parse as parser

SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))

#: A run of alternatives is not expanded beyond so many strings; what follows starts a new run.
MAX_STRINGS = 128


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0  # the group whose length is tested
    least: int = 0
    ignore_case: bool = False

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.ignore_case else 0))


# The base rules, in their order, then rules for well-known public token formats.
BASE_RULES = [
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]+", 0, 32),
]
MORE_RULES = [
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
]
RULES = BASE_RULES + MORE_RULES


def trigrams(s: str) -> frozenset[bytes]:
    b = s.encode().lower()
    return frozenset(b[i : i + 3] for i in range(len(b) - 2))


def trigram_query(pattern: str) -> list[list[frozenset[bytes]]]:
    """A conjunction of disjunctions of trigram sets that every match of ``pattern`` fulfils; empty: no demand.

    Consecutive parts of the expression that stand for a few fixed strings are multiplied out to a
    run of alternatives; each alternative demands all its trigrams, and a run in which some
    alternative has none demands nothing.
    """
    query: list[list[frozenset[bytes]]] = []

    def close(run: set[str]) -> set[str]:
        wanted = [trigrams(s) for s in run]
        if wanted and all(wanted):
            query.append(sorted(set(wanted), key=sorted))
        return {""}

    def strings(op, arg) -> set[str] | None:
        """The strings that a part stands for, if they are few."""
        if op is C.LITERAL:
            return {chr(arg)}
        if op is C.IN:
            return {chr(x) for _, x in arg} if len(arg) <= 8 and all(o is C.LITERAL for o, _ in arg) else None
        if op is C.SUBPATTERN:
            return sequence(arg[-1])
        if op is C.BRANCH:
            parts = [sequence(x) for x in arg[1]]
            return None if None in parts else set().union(*parts)
        if op is C.MAX_REPEAT and arg[0] <= 1 and arg[1] == 1:
            inner = sequence(arg[2])
            return inner if inner is None or arg[0] else inner | {""}
        return None

    def sequence(parts) -> set[str] | None:
        run = {""}
        for op, arg in parts:
            more = strings(op, arg)
            if more is None or len(run) * len(more) > MAX_STRINGS:
                return None
            run = {a + b for a in run for b in more}
        return run

    run = {""}
    for op, arg in parser.parse(pattern, re.ASCII):
        more = strings(op, arg)
        if more is None:
            if op is C.MAX_REPEAT and arg[0] >= 2 and (once := sequence(arg[2])) is not None and len(once) == 1:
                more = {next(iter(once)) * min(arg[0], 8)}
                run = close({a + b for a in run for b in more})
            else:
                run = close(run)
        elif len(run) * len(more) > MAX_STRINGS:
            close(run)
            run = more
        else:
            run = {a + b for a in run for b in more}
    close(run)
    return query


class Index:
    """Postings of a block of texts for the trigrams that a set of queries asks for."""

    def __init__(self, queries: list[list[list[frozenset[bytes]]]]) -> None:
        self.number = {g: i + 1 for i, g in enumerate(sorted({g for q in queries for d in q for s in d for g in s}))}
        self.table = np.zeros(1 << 24, np.uint16)
        for g, i in self.number.items():
            self.table[int.from_bytes(g, "big")] = i

    def postings(self, texts: list[str]) -> np.ndarray:
        """Trigram number x text: whether the text holds the trigram."""
        raw = [t.encode().lower() for t in texts]
        held = np.zeros((len(self.number) + 1, len(texts)), bool)
        b = np.frombuffer(b"\0\0".join(raw), np.uint8)
        if len(b) >= 3:
            code = b[:-2].astype(np.int32)
            code <<= 8
            code |= b[1:-1]
            code <<= 8
            code |= b[2:]
            hit = self.table[code]
            at = np.flatnonzero(hit)
            ends = np.cumsum([len(r) + 2 for r in raw])
            held[hit[at], np.searchsorted(ends, at, side="right")] = True
        return held

    def candidates(self, query: list[list[frozenset[bytes]]], held: np.ndarray) -> np.ndarray:
        out = np.ones(held.shape[1], bool)
        for alternatives in query:
            one = np.zeros(held.shape[1], bool)
            for grams in alternatives:
                one |= np.logical_and.reduce([held[self.number[g]] for g in grams])
            out &= one
        return np.flatnonzero(out)


def scanner(rules: list[Rule]) -> Callable[[list[str]], list[list[tuple[str, int, int]]]]:
    queries = [trigram_query(r.pattern) for r in rules]
    index, compiled = Index(queries), [r.compiled() for r in rules]

    def scan(texts: list[str]) -> list[list[tuple[str, int, int]]]:
        held = index.postings(texts)
        found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for k, rule in enumerate(rules):
            for d in index.candidates(queries[k], held).tolist():
                for m in compiled[k].finditer(texts[d]):
                    if len(m[rule.group]) >= rule.least:
                        found[d].append((m.start(), k, m.end()))
        return [[(rules[k].kind, a, b) for a, k, b in sorted(f)] for f in found]

    return scan


def find_secrets(docs: DataFrame, text: str = "text", rules: list[Rule] = RULES) -> DataFrame:
    """``docs`` with ``secrets``: kind, start, end (code points, end exclusive) by start, then by the order of the rules.

    Matches of a kind are leftmost and don't overlap; those whose tested group is too short are
    dropped, and what they cover is not searched again.  Null and empty texts hold none; repeated
    rows are scanned each on its own; a column named secrets is replaced.
    """
    fields = [T.StructField("secrets", SPANS)]

    def compute():
        scan = scanner(rules)
        return lambda texts, _: [[[{"kind": k, "start": a, "end": b} for k, a, b in f] for f in scan([t or "" for t in texts])]]

    return append_columns(docs, text, fields, compute)


def span_list(spans: str, kinds: list[str] | None = None):
    """Column: ``kind:start:end`` of the spans (of some kinds), comma-joined."""
    kept = F.filter(spans, lambda s: s.kind.isin(kinds)) if kinds is not None else F.col(spans)
    return F.array_join(F.transform(kept, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s["end"].cast("string"))), ",")


def redacted(text: str, spans: list[tuple[str, int, int]], mark: str) -> str:
    out, at = [], 0
    for _, a, b in spans:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact_secrets(docs: DataFrame, text: str = "text", mark: str = "[secret]", chars: str | None = "n_chars", rules: list[Rule] = RULES) -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by ``mark``; ``chars``, if there, is the new length.

    All rows and columns stay; texts without a secret, null ones too, are unchanged.
    """
    aside = set_aside(docs, ["redacted_text"])
    source = docs.withColumnsRenamed(aside)

    def compute():
        scan = scanner(rules)
        return lambda texts, _: [[redacted(t, f, mark) if f else None for t, f in zip(texts, scan([t or "" for t in texts]), strict=True)]]

    own = f"`{aside.get(text, text)}`"
    out = append_columns(source, aside.get(text, text), [T.StructField("redacted_text", T.StringType())], compute)
    changed = F.col("redacted_text").isNotNull()
    new = {aside.get(text, text): F.when(changed, F.col("redacted_text")).otherwise(F.col(own))}
    if chars in docs.columns:
        length = F.length("redacted_text").cast(docs.schema[chars].dataType)
        new[aside.get(chars, chars)] = F.when(changed, length).otherwise(F.col(f"`{aside.get(chars, chars)}`"))
    out = out.withColumns(new).drop("redacted_text")
    return out.withColumnsRenamed({b: a for a, b in aside.items()}).select([f"`{c}`" for c in docs.columns])
