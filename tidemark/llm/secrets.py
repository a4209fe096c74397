"""Secret scan through a trigram index: rules become Boolean trigram queries, postings are intersected, hits verified.

Each rule's pattern is parsed once into a condition on trigrams that every match must contain (AND over what is
concatenated, OR over alternatives).  Every block of documents gets an inverted index of just those trigrams, folded to
lower case; a rule is verified with its pattern only on the documents that its condition leaves.  A rule without a
mandatory trigram scans all documents.  The index lives and dies with its block: nothing is exchanged, and a document
is found by its own bytes alone, so loss of an executor repeats one block.

Cases: a null or empty text has no spans; rows are independent, so repeats, ties and extra columns change nothing.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from dataclasses import dataclass
from re import _constants as sre, _parser as sre_parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import per_process, pieces, raw_bytes, text_or_empty


@dataclass(frozen=True)
class Rule:
    """``group`` of the match must have ``least`` characters; ``fold`` matches ASCII letters in either case."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    fold: bool = False

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.fold else 0))


# The three base rules of the contract.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)
#: Further rules: formats that issuers of keys publish.
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]*(?:-----END [A-Z ]*PRIVATE KEY-----)?"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("url_login", r"[a-z][a-z0-9+.-]{1,20}://[^\s:@/]+:[^\s:@/]{3,}@"),
)
RULES = BASE + MORE

# A condition on trigrams: None (nothing mandatory), a trigram, ("and", ...) or ("or", ...).


def _join(kind: str, parts: list):
    parts = [p for p in dict.fromkeys(parts) if p is not None]
    return None if not parts else parts[0] if len(parts) == 1 else (kind, *parts)


def _of_text(run: str):
    """All trigrams of a literal run, lower-cased and as UTF-8 bytes."""
    raw = run.lower().encode()
    return _join("and", [raw[i : i + 3] for i in range(len(raw) - 2)])


def _strings(node, most: int = 64) -> list[str] | None:
    """All strings that a parsed pattern can match, if they are few."""
    out = [""]
    for op, arg in node:
        if op is sre.LITERAL:
            step = [chr(arg)]
        elif op is sre.IN and len(arg) <= 8 and all(o is sre.LITERAL for o, _ in arg):
            step = [chr(a) for _, a in arg]
        elif op is sre.SUBPATTERN:
            step = _strings(arg[-1], most)
        elif op is sre.BRANCH:
            branches = [_strings(b, most) for b in arg[1]]
            step = None if any(b is None for b in branches) else [s for b in branches for s in b]
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[1] is not sre.MAXREPEAT and arg[1] <= 2:
            inner = _strings(arg[2], most)
            step = None if inner is None else [s * k for s in inner for k in range(arg[0], arg[1] + 1)]
        else:
            step = None
        if step is None or len(out) * len(step) > most:
            return None
        out = [a + b for a in out for b in step]
    return out


def _query(node):
    """The condition of a parsed pattern: runs whose strings are few give trigrams, other parts what is inside them."""
    parts, run = [], [""]

    def close():
        if all(len(s.encode()) >= 3 for s in run):
            parts.append(_join("or", [_of_text(s) for s in run]))
        run[:] = [""]

    for item in node:
        strings = _strings([item])
        if strings is not None and len(run) * len(strings) <= 64:
            run[:] = [a + b for a in run for b in strings]
            continue
        close()
        op, arg = item
        if op is sre.SUBPATTERN:
            parts.append(_query(arg[-1]))
        elif op is sre.BRANCH:
            inner = [_query(b) for b in arg[1]]
            parts.append(None if any(q is None for q in inner) else _join("or", inner))
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] >= 1:
            parts.append(_query(arg[2]))
    close()
    return _join("and", parts)


def trigram_query(rule: Rule):
    """What every match of the rule must contain; None if the rule has no mandatory trigram."""
    return _query(sre_parser.parse(rule.pattern, re.ASCII))


def trigrams(query) -> set[bytes]:
    if query is None:
        return set()
    if isinstance(query, bytes):
        return {query}
    return set().union(*(trigrams(q) for q in query[1:]))


def _code(trigram: bytes) -> int:
    return trigram[0] << 16 | trigram[1] << 8 | trigram[2]


class Scanner:
    """Rules, their conditions, and a table that numbers the wanted trigrams."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        self.patterns = [r.compiled() for r in rules]
        self.queries = [trigram_query(r) for r in rules]
        wanted = sorted({_code(t) for q in self.queries for t in trigrams(q)})
        self.number = {c: i for i, c in enumerate(wanted)}
        # First byte pair -> is any wanted trigram behind it; keeps the index pass cheap.
        self.table = np.zeros(1 << 24, np.int16)
        for c, i in self.number.items():
            self.table[c] = i + 1
        lower = np.arange(256, dtype=np.uint8)
        lower[65:91] += 32
        self.lower = lower

    def index(self, body: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
        """Postings of a block: for each wanted trigram the documents that hold it."""
        low = self.lower[body].astype(np.int32)
        if len(low) < 3:
            return [np.zeros(0, np.int64)] * len(self.number)
        hit = self.table[low[:-2] << 16 | low[1:-1] << 8 | low[2:]]
        where = np.flatnonzero(hit)
        doc = np.searchsorted(at, where, "right") - 1
        inside = where + 3 <= at[doc + 1]
        where, doc = where[inside], doc[inside]
        which = hit[where] - 1
        pair = np.unique(which.astype(np.int64) * len(at) + doc)
        cut = np.searchsorted(pair, np.arange(len(self.number) + 1) * len(at))
        return [pair[a:b] - i * len(at) for i, (a, b) in enumerate(zip(cut[:-1], cut[1:]))]

    def documents(self, query, postings: list[np.ndarray], n: int) -> np.ndarray:
        if query is None:
            return np.arange(n)
        if isinstance(query, bytes):
            return postings[self.number[_code(query)]]
        parts = [self.documents(q, postings, n) for q in query[1:]]
        out = parts[0]
        for p in parts[1:]:
            out = np.intersect1d(out, p) if query[0] == "and" else np.union1d(out, p)
        return out

    def scan(self, texts: list[str], body: np.ndarray, at: np.ndarray) -> list[list[tuple[int, int, int]]]:
        """Per document its spans (start, rule number, end) in order."""
        spans: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        postings = self.index(body, at)
        for k, (rule, pattern, query) in enumerate(zip(self.rules, self.patterns, self.queries)):
            long_run = _only_run(rule)
            for d in self.documents(query, postings, len(texts)):
                text = texts[d]
                if long_run is not None:
                    spans[d] += [(m.start(), k, m.end()) for m in long_run.finditer(text)]
                    continue
                for m in pattern.finditer(text):
                    if m.end(rule.group) - m.start(rule.group) >= rule.least:
                        spans[d].append((m.start(), k, m.end()))
        for s in spans:
            s.sort()
        return spans


def _only_run(rule: Rule) -> re.Pattern | None:
    """A rule that is one repeated class matches maximal runs only: short ones can be skipped inside the pattern."""
    parsed = list(sre_parser.parse(rule.pattern, re.ASCII))
    if len(parsed) == 1 and parsed[0][0] is sre.MAX_REPEAT and parsed[0][1][0] == 1 and rule.least > 1 and rule.group == 0 and rule.pattern.endswith("]+"):
        return re.compile(rule.pattern[:-1] + "{%d,}" % rule.least, re.ASCII | (re.IGNORECASE if rule.fold else 0))
    return None


def _scanner(rules: tuple[Rule, ...]) -> Scanner:
    return per_process("secret-scanner:" + repr(rules), lambda: Scanner(rules))


def _map(docs: DataFrame, keep: list[str], rules: tuple[Rule, ...], schema: str, names: list[str], fill: Callable) -> DataFrame:
    def run(batches):
        scanner = _scanner(rules)
        for batch in batches:
            for part in pieces(batch, "_text"):
                column = part.column("_text")
                texts = column.to_pylist()
                spans = scanner.scan(texts, *raw_bytes(column))
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), *fill(rules, texts, spans)], [*keep, *names])

    return docs.mapInArrow(run, schema)


def _joined(spans, rules) -> str:
    return ",".join(f"{rules[k].kind}:{a}:{b}" for a, k, b in spans)


def find(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, spans (``kind:start:end`` in code points, by start then rule order), counts and digest of the base rules."""

    def fill(rules, texts, spans):
        base = [[s for s in d if s[1] < len(BASE)] for d in spans]
        counts = [pa.array([sum(s[1] == k for s in d) for d in base], pa.int64()) for k in range(len(BASE))]
        digest = pa.array([hashlib.sha256(_joined(d, rules).encode()).hexdigest() for d in base])
        return [*counts, digest, pa.array([_joined(d, rules) for d in spans])]

    names = [*(f"n_{r.kind}" for r in BASE), "base_sha256", "spans"]
    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    return _map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("_text")), ["doc_id"], rules, schema, names, fill)


def mask(text: str, spans: list[tuple[int, int, int]], rules: tuple[Rule, ...]) -> str:
    """The text with every span, overlapping ones together, replaced by ``[secret]``."""
    out, at = [], 0
    for start, _, end in spans:
        if start >= at:
            out += [text[at:start], "[secret]"]
        at = max(at, end)
    return "".join(out) + text[at:] if out else text


def redact(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """All columns as they are, but secrets in ``text`` masked; a null text stays null."""
    names = [c for c in docs.columns if c != text]
    inner = docs.select(*(F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(names)), F.col(f"`{text}`").isNull().alias("_null"), text_or_empty(text).alias("_text"))

    def fill(rules, texts, spans):
        return [pa.array([mask(t, s, rules) for t, s in zip(texts, spans)], pa.string())]

    keep = [f"k{i}" for i in range(len(names))] + ["_null"]
    schema = inner.drop("_text").schema.add("_masked", "string")
    done = _map(inner, keep, rules, schema, ["_masked"], fill)
    back = {c: F.col(f"k{i}").alias(c) for i, c in enumerate(names)}
    return done.select(*(back[c] if c != text else F.when(~F.col("_null"), F.col("_masked")).alias(text) for c in docs.columns))
