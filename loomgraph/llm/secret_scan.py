"""Secret scans over a trigram index.

Each rule's regex is parsed and a Boolean query over trigrams is derived that every
match must satisfy. A block of documents gets an inverted index of the trigrams
that the queries name: one pass over its bytes (A-Z lowered) looks every trigram up
in a table and yields postings. Queries are evaluated over the postings; only
documents they leave are decoded and searched. A rule with no mandatory trigram
has the query True, so all documents are searched for it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from re import _constants as C
from re import _parser as parser

from loomgraph.llm import vectext


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    #: Group whose length counts (0: the match) and its least length.
    group: int = 0
    least: int = 1


#: The base rules, then formats that issuers publish for their keys.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("stripe", r"sk_live_[0-9A-Za-z]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("pem", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
)
#: Sets of possible strings larger than this are cut: what was read so far counts.
STRINGS, CHOICES = 128, 16

# Queries: True, a trigram, ("and", ...) or ("or", ...).


def _all(parts) -> object:
    parts = [p for p in dict.fromkeys(parts) if p is not True]
    return True if not parts else parts[0] if len(parts) == 1 else ("and", *parts)


def _any(parts) -> object:
    parts = list(dict.fromkeys(parts))
    return True if not parts or True in parts else parts[0] if len(parts) == 1 else ("or", *parts)


def _of_strings(strings: set[str]) -> object:
    return _any([_all([s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)])


def _choices(items) -> set[str] | None:
    """The lower-cased ASCII characters of a class, if they are few."""
    out: set[str] = set()
    for op, value in items:
        if op is C.LITERAL and value < 128:
            out.add(chr(value).lower())
        elif op is C.RANGE and value[1] < 128 and value[1] - value[0] < CHOICES:
            out |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
        else:
            return None
    return out if len(out) <= CHOICES else None


def _analyse(tree) -> tuple[set[str] | None, object]:
    """All strings that the tree can match, if few, and else what any must hold."""
    run, whole, found = {""}, True, []

    def cut() -> None:
        nonlocal run, whole
        found.append(_of_strings(run))
        run, whole = {""}, False

    def extend(more: set[str] | None) -> bool:
        nonlocal run
        if more is None or len(run) * len(more) > STRINGS:
            return False
        run = {a + b for a in run for b in more}
        return True

    for op, value in tree:
        if op is C.LITERAL:
            if value > 127:
                cut()
            else:
                extend({chr(value).lower()}) or cut()
        elif op is C.IN:
            extend(_choices(value)) or cut()
        elif op in (C.SUBPATTERN, C.BRANCH):
            inner = [_analyse(t) for t in (value[1] if op is C.BRANCH else [value[3]])]
            exact = set().union(*[e for e, _ in inner]) if all(e is not None for e, _ in inner) else None
            if not extend(exact):
                cut()
                found.append(_any([_of_strings(e) if e is not None else q for e, q in inner]))
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
            low, high, item = value
            exact, query = _analyse(item)
            if not (exact is not None and high == 1 and extend({"", *exact} if low == 0 else exact)):
                fixed = exact is not None and len(exact) == 1 and low == high and low * max(map(len, exact)) <= 64
                if not (fixed and extend({next(iter(exact)) * low})):
                    cut()
                    if low:
                        found.append(query if exact is None else _of_strings(exact))
        elif op is not C.AT:
            cut()
    if whole:
        return run, _of_strings(run)
    return None, _all([*found, _of_strings(run)])


def trigram_query(pattern: str) -> object:
    exact, query = _analyse(parser.parse(pattern))
    return _of_strings(exact) if exact is not None else query


def _names(query: object) -> set[str]:
    return set() if query is True else {query} if isinstance(query, str) else set().union(*map(_names, query[1:]))


class Index:
    """Postings of the trigrams named by the queries, over one block of texts."""

    def __init__(self, names: list[str]):
        self.names = {t: i + 1 for i, t in enumerate(names)}
        self.table = np.zeros(1 << 24, np.uint16)
        for t, i in self.names.items():
            a, b, c = t.encode()
            self.table[a << 16 | b << 8 | c] = i
        self.lower = np.arange(256, dtype=np.int32)
        self.lower[65:91] += 32

    def build(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Which text (column) holds which trigram (row)."""
        post = np.zeros((len(self.names) + 1, len(offsets) - 1), bool)
        if len(data) >= 3:
            low = self.lower[data]
            number = self.table[low[:-2] << 16 | low[1:-1] << 8 | low[2:]]
            at = np.flatnonzero(number)
            text = np.searchsorted(offsets, at, "right") - 1
            inside = at + 2 < offsets[text + 1]
            post[number[at[inside]], text[inside]] = True
        return post

    def match(self, query: object, post: np.ndarray) -> np.ndarray:
        if query is True:
            return np.ones(post.shape[1], bool)
        if isinstance(query, str):
            return post[self.names[query]]
        parts = [self.match(q, post) for q in query[1:]]
        return np.logical_and.reduce(parts) if query[0] == "and" else np.logical_or.reduce(parts)


def spans_of(rule: Rule, compiled: re.Pattern, text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches; those too short are dropped."""
    return [m.span() for m in compiled.finditer(text) if m.end(rule.group) - m.start(rule.group) >= rule.least]


def _scanning(rules: tuple[Rule, ...], base: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = [re.compile(r.pattern, re.ASCII) for r in rules]
        # a whole-match bound can be told to the engine where the pattern is one repeated class
        for i, r in enumerate(rules):
            if r.group == 0 and r.least > 1 and (single := re.fullmatch(r"(\[[^\]]+\])\+", r.pattern)):
                compiled[i] = re.compile(f"{single[1]}{{{r.least},}}", re.ASCII)
        queries = [trigram_query(r.pattern) for r in rules]
        index = Index(sorted(set().union(*map(_names, queries))))
        for batch in batches:
            data, offsets = vectext.packed(batch.column("text"))
            rows: list[tuple] = []
            for a, b in vectext.blocks(offsets):
                own, bounds = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                post = index.build(own, bounds)
                wanted = np.array([index.match(q, post) for q in queries])
                raw = own.tobytes()
                for k in range(b - a):
                    todo = np.flatnonzero(wanted[:, k])
                    text = raw[bounds[k] : bounds[k + 1]].decode("utf-8", "replace") if len(todo) else ""
                    found = [(s, i, e) for i in todo.tolist() for s, e in spans_of(rules[i], compiled[i], text)]
                    found.sort()
                    names = [f"{rules[i].kind}:{s}:{e}" for s, i, e in found]
                    first = ",".join(n for n, (_, i, _) in zip(names, found, strict=True) if i < base)
                    kinds = [i for _, i, _ in found]
                    rows.append((*[kinds.count(i) for i in range(base)], hashlib.sha256(first.encode()).hexdigest(), ",".join(names)))
            columns = list(zip(*rows, strict=True)) or [[]] * (base + 2)
            arrays = [pa.array(c, pa.int64()) for c in columns[:base]] + [pa.array(c, pa.string()) for c in columns[base:]]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], ["doc_id", *[f"n_{r.kind}" for r in rules[:base]], "base_sha256", "spans"])

    return run


def find_secrets(docs: DataFrame, base: tuple[Rule, ...] = BASE, more: tuple[Rule, ...] = MORE) -> DataFrame:
    """One row per input row: doc_id, n_<kind> of each base rule, base_sha256, spans.

    spans lists kind:start:end by start, then by the order of the rules, in code
    points with the end exclusive; base_sha256 is the digest of the base rules'
    part of it. A null or empty text has none (""). Repeated rows are scanned each
    on its own; extra columns are ignored; no rows in, no rows out.
    """
    rules = (*base, *more)
    schema = ", ".join(["doc_id long", *[f"n_{r.kind} long" for r in base], "base_sha256 string", "spans string"])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_scanning(rules, len(base)), schema)
