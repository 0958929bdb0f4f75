"""Secret scans through a trigram inverted index.

Each rule is a regular expression.  From its parsed form a Boolean query over
trigrams is derived: literal stretches give conjunctions, branches disjunctions.
Every block of texts gets an inverted index from trigram to rows; a rule's
postings are intersected and joined as its query says, and only the rows left
are matched with the expression itself.  A rule without mandatory trigrams, such
as a run of hex digits, is matched on every row.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from re import _constants as op
from re import _parser as parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from corpusmill.llm.common import batches_of, require

#: A literal stretch is followed through at most so many variants; beyond that its query is split.
MOST_VARIANTS = 64
#: ("all",), ("has", trigram), ("and", ...) or ("or", ...)
Query = tuple
ALL: Query = ("all",)


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    ignore_case: bool = False
    least: int = 0  # characters of the value
    value: int = 0  # group that is the secret itself

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.ignore_case else 0))


#: Fixed patterns of the contract, in its order.
BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", True, 6, 2),
    Rule("access", r"AKIA[A-Z0-9]+", False, 20),
    Rule("hex", r"[0-9a-f]+", False, 24),
)
#: Further kinds that the method finds; they only add spans.
MORE_RULES = (
    # the whole key: to its last line, or to the end of its long lines where that is missing
    Rule(
        "private_key",
        r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----(?:(?:\s|\\[nr])*(?:(?:Proc-Type|DEK-Info): [A-Za-z0-9,-]+|[A-Za-z0-9+/=]{16,}))*+"
        r"(?:(?:\s|\\[nr])*(?:[A-Za-z0-9+/=]{1,15}(?:\s|\\[nr])*)?-----END [A-Z ]{0,40}PRIVATE KEY-----)?",
    ),
    Rule("forge_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+"),
    Rule("url_login", r"(?<![a-z0-9+.-])[a-z0-9+.-]++(?<=[a-z0-9])://[^\s/:@]+:([^\s/@]{3,})@", False, 3, 1),
)
RULES = BASE_RULES + MORE_RULES


def _both(kind: str, parts: Iterable[Query]) -> Query:
    """Conjunction or disjunction without what says nothing."""
    parts = list(dict.fromkeys(parts))
    if kind == "or" and ALL in parts:
        return ALL
    parts = [p for p in parts if p != ALL]
    if kind == "or":  # a way that demands all that another demands, and more, adds nothing
        needs = [frozenset(p[1:] if p[0] == "and" else [p]) for p in parts]
        parts = [p for p, need in zip(parts, needs, strict=True) if not any(other < need for other in needs)]
    return ALL if not parts else parts[0] if len(parts) == 1 else (kind, *parts)


def _literals(strings: Iterable[str]) -> Query:
    return _both("or", (_both("and", (("has", s[i : i + 3]) for i in range(len(s) - 2))) for s in sorted(strings)))


def _walk(tokens) -> tuple[set[str] | None, Query]:
    """The exact strings of a parsed stretch if they are few, and the query it demands."""
    exact: set[str] | None = {""}
    demands: list[Query] = []
    open_run: set[str] = {""}

    def close() -> None:
        nonlocal open_run, exact
        demands.append(_literals(open_run))
        open_run, exact = {""}, None

    for kind, value in tokens:
        found: set[str] | None = None
        demand: Query = ALL
        if kind is op.LITERAL and value < 128:
            found = {chr(value).lower()}
        elif kind is op.IN and len(value) <= 8 and all(k is op.LITERAL and v < 128 for k, v in value):
            found = {chr(v).lower() for _, v in value}
        elif kind is op.SUBPATTERN:
            found, demand = _walk(value[3])
        elif kind is op.BRANCH:
            ways = [_walk(x) for x in value[1]]
            if all(x is not None for x, _ in ways):
                found = set().union(*(x for x, _ in ways))
            demand = _both("or", (q if x is None else _literals(x) for x, q in ways))
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT):
            least, most, inner = value
            strings, asked = _walk(inner)
            if strings is not None and most == 1:
                found = strings | ({""} if least == 0 else set())
            elif strings is not None and least == most and most <= 8:
                found = {""}
                for _ in range(least):
                    found = {a + b for a in found for b in strings}
            elif least:
                demand = asked if strings is None else _literals(strings)
        if found is not None and len(found) * len(open_run) <= MOST_VARIANTS:
            open_run = {a + b for a in open_run for b in found}
            if exact is not None:
                exact = set(open_run)
        else:
            close()
            demands.append(demand)
    if exact is None:
        demands.append(_literals(open_run))
    return exact, _both("and", demands if exact is None else [_literals(exact)])


def trigram_query(rule: Rule) -> Query:
    """What trigrams (ASCII letters folded) a text must have if the rule matches in it."""
    return _walk(parser.parse(rule.pattern))[1]


def trigrams_of(query: Query) -> set[str]:
    return {query[1]} if query[0] == "has" else set().union(*(trigrams_of(q) for q in query[1:])) if query[0] != "all" else set()


class TrigramIndex:
    """Postings of one block of texts, for the trigrams that the rules ask about."""

    def __init__(self, trigrams: Iterable[str]):
        self.slots = {t: i + 1 for i, t in enumerate(sorted(trigrams))}
        self._slot_of = np.zeros(1 << 24, np.uint16)
        for t, i in self.slots.items():
            a, b, c = t.encode()
            self._slot_of[a << 16 | b << 8 | c] = i

    def fill(self, texts: list[str]) -> "TrigramIndex":
        data = [t.encode("utf-8", "surrogatepass").lower() for t in texts]
        self.rows = len(data)
        self.postings = np.zeros((len(self.slots) + 1, self.rows), bool)
        ends = np.cumsum([len(d) + 2 for d in data])  # two zero bytes part the texts
        raw = np.frombuffer(b"\0\0".join(data) + b"\0\0", np.uint8)
        if len(raw) > 2:
            wide = raw.astype(np.uint32)
            slots = self._slot_of[wide[:-2] << 16 | wide[1:-1] << 8 | wide[2:]]
            at = np.flatnonzero(slots)
            self.postings[slots[at], np.searchsorted(ends, at, side="right")] = True
        return self

    def rows_for(self, query: Query) -> np.ndarray:
        if query[0] == "all":
            return np.ones(self.rows, bool)
        if query[0] == "has":
            return self.postings[self.slots[query[1]]]
        join = np.logical_and if query[0] == "and" else np.logical_or
        return join.reduce([self.rows_for(q) for q in query[1:]])


class Scanner:
    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        self.compiled = [r.compiled() for r in rules]
        self.queries = [trigram_query(r) for r in rules]
        self.index = TrigramIndex(set().union(*map(trigrams_of, self.queries)))

    def scan(self, texts: list[str]) -> list[list[tuple[int, int, int, int]]]:
        """Per text the spans (start, rule number, end, start of the value), in order."""
        found: list[list[tuple[int, int, int, int]]] = [[] for _ in texts]
        self.index.fill(texts)
        for n, (rule, pattern, query) in enumerate(zip(self.rules, self.compiled, self.queries, strict=True)):
            # leftmost runs of one class can be asked for at their least length at once
            if rule.kind == "hex":
                pattern = re.compile(f"[0-9a-f]{{{rule.least},}}")
            for row in np.flatnonzero(self.index.rows_for(query)).tolist():
                for m in pattern.finditer(texts[row]):
                    if m.end(rule.value) - m.start(rule.value) >= rule.least:
                        found[row].append((m.start(), n, m.end(), m.start(rule.value)))
        for spans in found:
            spans.sort()
        return found


def scan_documents(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per row of ``docs``: id, spans (array of start, end, kind), n_<base kind>,
    base_sha256 and spans joined as text.

    Positions count code points of the whole text, end exclusive.  A null text
    counts as empty and has no spans; repeated rows give repeated results; an empty
    table gives an empty one; other columns are left out.  Spans of different kinds
    may overlap.  Nothing is shuffled.
    """
    require(docs, id_col, text_col)
    base = [r.kind for r in BASE_RULES]
    schema = T.StructType(
        [T.StructField(id_col, docs.schema[id_col].dataType)]
        + [T.StructField(f"n_{k}", T.LongType()) for k in base]
        + [T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for batch in batches_of(batches):
            found = scanner.scan([t or "" for t in batch.column(1).to_pylist()])
            named = [[(rules[n].kind, f"{rules[n].kind}:{start}:{end}") for start, n, end, _ in spans] for spans in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)]
                + [pa.array([sum(k == kind for k, _ in x) for x in named], pa.int64()) for kind in base]
                + [
                    pa.array([hashlib.sha256(",".join(t for k, t in x if k in base).encode()).hexdigest() for x in named], pa.string()),
                    pa.array([",".join(t for _, t in x) for x in named], pa.string()),
                ],
                names=schema.names,
            )

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def redact_documents(docs: DataFrame, text_col: str = "text", chars_col: str = "n_chars", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with every secret value replaced by ``<kind>``; the rest of a text stays as it is.

    Overlapping values are replaced once, under the kind that starts first.  The
    column of character counts, where there is one, is counted anew for changed
    texts.  Null texts stay null; all columns and rows are kept.
    """
    require(docs, text_col)
    names = docs.columns
    text_at, chars_at = names.index(text_col), names.index(chars_col) if chars_col in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for batch in batches_of(batches):
            texts = batch.column(text_at).to_pylist()
            changed = list(texts)
            for row, spans in enumerate(scanner.scan([t or "" for t in texts])):
                if spans:
                    out, done = [], 0
                    for start, n, end, value in sorted(spans, key=lambda s: (s[3], s[1])):
                        if value >= done:
                            out += [texts[row][done:value], f"<{rules[n].kind}>"]
                        done = max(done, end if not rules[n].value else _value_end(scanner, n, texts[row], start))
                    changed[row] = "".join(out) + texts[row][done:]
            columns = [batch.column(i) for i in range(len(names))]
            columns[text_at] = pa.array(changed, columns[text_at].type)
            if chars_at is not None:
                counts = columns[chars_at].to_pylist()
                counts = [c if t is o or t == o else len(t) for c, t, o in zip(counts, changed, texts, strict=True)]
                columns[chars_at] = pa.array(counts, columns[chars_at].type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)


def _value_end(scanner: Scanner, n: int, text: str, start: int) -> int:
    return scanner.compiled[n].match(text, start).end(scanner.rules[n].value)

