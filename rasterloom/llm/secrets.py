"""Secret scanning through a trigram inverted index.

From each rule's regex a Boolean trigram query is derived: trigrams that every match must hold, in any letter case.
Each block of documents gets an inverted index (trigram -> bitmap of the block's documents), limited to the trigrams
that the rules' queries name. A rule's query intersects and unites these postings; the regex then verifies the
candidates. A rule without mandatory trigrams scans every document of the block. Blocks are independent, so there is
no shuffle, and memory is bounded by a block's bytes.

Defined cases: a null or empty text has no span. Spans are code points of the original text, end exclusive, and all
rules see the whole text. Repeated rows each get a row.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from dataclasses import dataclass
from re import _constants as C  # type: ignore[attr-defined]
from re import _parser as P  # type: ignore[attr-defined]

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rasterloom.llm.textops import column_bytes, map_batches

BLOCK = 4 << 20
MOST_STRINGS, MOST_CLASS = 64, 4


@dataclass(frozen=True)
class Rule:
    """accept: what a match must also satisfy; one that doesn't still uses up its text. parts: the spans within a match, if they aren't the whole of it."""

    kind: str
    pattern: str
    accept: Callable[[re.Match], bool] | None = None
    parts: Callable[[re.Match], list[tuple[int, int]]] | None = None


def _long_value(m: re.Match) -> bool:
    return len(m.group(2)) >= 6


def _long_access(m: re.Match) -> bool:
    return m.end() - m.start() >= 20


def _tokens(m: re.Match) -> list[tuple[int, int]]:
    """Of a run of parts joined by dots, from left to right, the signed tokens: a header from its first eyJ on, a payload that begins so, and a signature, each with 8 characters besides."""
    out, at, spans = [], m.start(), []
    for part in m.group().split("."):
        spans.append((at, at + len(part)))
        at += len(part) + 1
    text, k = m.string, 0
    while k + 2 < len(spans):
        (a, b), (c, d), (e, f) = spans[k : k + 3]
        first = text.find("eyJ", a, b)
        if first >= 0 and b - first >= 11 and text.startswith("eyJ", c) and d - c >= 11 and f - e >= 8:
            out.append((first, f))
            k += 3
        else:
            k += 1
    return out


BASE_RULES = (
    Rule("assign", r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", _long_value),
    Rule("access", r"AKIA[A-Z0-9]+", _long_access),
    Rule("hex", r"[0-9a-f]{24,}"),
)
#: What follows a key's header: all up to the END line; without one, PEM headers and runs of base64, the last may be a short line.
KEY_BODY = (
    r"(?:(?:[^-]|-(?!----))*+-----END [A-Z ]{0,30}PRIVATE KEY-----"
    r"|(?:(?:\s|\\[nr])*(?:[A-Za-z-]{3,20}:\x20[^\n\\]{1,200}(?=\n|\\n)|[A-Za-z0-9+/=]{16,}))*+(?:(?:\r?\n|\\n)\s*[A-Za-z0-9+/=]+(?=\s*(?:\n|\\n|[\"']|\Z)))?)"
)
#: Public formats of issued credentials.
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----" + KEY_BODY),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[baprs]-[A-Za-z0-9-]{10,}"),
    Rule("maps", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]*+(?:\.[A-Za-z0-9_-]++)*+", None, _tokens),  # a whole run at once, so that none is read twice
    Rule("payment", r"[sr]k_live_[A-Za-z0-9]{16,}"),
    Rule("url_login", r"[a-z][a-z0-9+.-]{1,15}://[^\s/:@]++:[^\s/:@]{3,}+@"),
)

#: A query is True (no condition), a trigram, or ("and" | "or", (query, ...)).
Query = bool | str | tuple


def _all(parts: list[Query]) -> Query:
    flat = {q for p in parts if p is not True for q in (p[1] if isinstance(p, tuple) and p[0] == "and" else [p])}
    return True if not flat else flat.pop() if len(flat) == 1 else ("and", tuple(sorted(flat, key=str)))


def _any(parts: list[Query]) -> Query:
    if any(p is True for p in parts) or not parts:
        return True
    flat = set(parts)
    return flat.pop() if len(flat) == 1 else ("or", tuple(sorted(flat, key=str)))


def _trigrams(text: str) -> Query:
    """Of the text's UTF-8 bytes as ASCII-lower-cased; only ASCII strings give any."""
    low = text.lower()
    return _all([low[i : i + 3] for i in range(len(low) - 2)]) if text.isascii() else True


def _strings(node: tuple, ignore: bool) -> set[str] | None:
    """The strings that a parsed node can match if they are few, ASCII letters folded, or None."""
    op, arg = node
    if op is C.LITERAL:
        return {chr(arg).lower() if arg < 128 else chr(arg)} if arg < 128 or not ignore else None
    if op is C.IN and arg[0][0] is not C.NEGATE:
        found: set[str] = set()
        for kind, value in arg:
            if kind is C.LITERAL and value < 128:
                found.add(chr(value).lower())
            elif kind is C.RANGE and value[1] < 128 and value[1] - value[0] < 2 * MOST_STRINGS:
                found |= {chr(x).lower() for x in range(value[0], value[1] + 1)}
            else:
                return None
        return found if len(found) <= MOST_CLASS + 2 else None
    if op is C.SUBPATTERN:
        return _sequence_strings(arg[3], ignore)
    if op is C.BRANCH:
        every = [_sequence_strings(x, ignore) for x in arg[1]]
        if any(e is None for e in every):
            return None
        joined = set().union(*every)
        return joined if len(joined) <= MOST_STRINGS else None
    if op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[1] <= 2:
        one = _sequence_strings(arg[2], ignore)
        if one is None:
            return None
        return {"".join(x) for n in range(arg[0], arg[1] + 1) for x in _power(one, n)}
    return {""} if op is C.AT else None


def _power(one: set[str], n: int) -> list[tuple[str, ...]]:
    out: list[tuple[str, ...]] = [()]
    for _ in range(n):
        out = [(*x, y) for x in out for y in one]
    return out


def _sequence_strings(nodes, ignore: bool) -> set[str] | None:
    out = {""}
    for node in nodes:
        more = _strings(node, ignore)
        if more is None or len(out) * len(more) > MOST_STRINGS:
            return None
        out = {a + b for a in out for b in more}
    return out


def _of_sequence(nodes, ignore: bool) -> Query:
    parts: list[Query] = []
    run = {""}

    def flush() -> None:
        nonlocal run
        parts.append(_any([_trigrams(x) for x in run]))
        run = {""}

    for node in nodes:
        few = _strings(node, ignore)
        if few is not None and len(run) * len(few) <= MOST_STRINGS:
            run = {a + b for a in run for b in few}
            continue
        flush()
        if few is not None:
            run = few
            continue
        op, arg = node
        if op is C.SUBPATTERN:
            parts.append(_of_sequence(arg[3], ignore))
        elif op is C.BRANCH:
            parts.append(_any([_of_sequence(x, ignore) for x in arg[1]]))
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[0] >= 1:
            body = _sequence_strings(arg[2], ignore)
            if body is not None and len(body) == 1:
                parts.append(_trigrams(body.pop() * arg[0]))
            else:
                parts.append(_of_sequence(arg[2], ignore))
    flush()
    return _all(parts)


def trigram_query(pattern: str) -> Query:
    """What trigrams a text must hold to match, as lower-cased ASCII; True if nothing follows from the pattern."""
    parsed = P.parse(pattern, re.ASCII)
    return _of_sequence(parsed, False)


def named(query: Query) -> set[str]:
    if isinstance(query, str):
        return {query}
    return set().union(*map(named, query[1])) if isinstance(query, tuple) else set()


class Index:
    """Postings of one block: for each trigram that rules name, which documents hold it."""

    def __init__(self, trigrams: list[str]) -> None:
        self.at = {t: k for k, t in enumerate(trigrams)}
        self.slot = np.zeros(1 << 24, np.uint8 if len(trigrams) < 255 else np.uint16)
        for t, k in self.at.items():
            a, b, c = t.encode("ascii")
            self.slot[a << 16 | b << 8 | c] = k + 1
        self.fold = np.arange(256, dtype=np.int32)
        self.fold[65:91] += 32

    def build(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Boolean matrix, trigrams by documents."""
        postings = np.zeros((len(self.at), len(offsets) - 1), bool)
        for at in range(0, max(0, len(data) - 2), BLOCK):  # a long text is indexed piece by piece
            low = self.fold[data[at : at + BLOCK + 2]]
            slots = self.slot[(low[:-2] << 16) | (low[1:-1] << 8) | low[2:]]
            hit = np.flatnonzero(slots)
            row = np.searchsorted(offsets, hit + at, "right") - 1
            own = offsets[row + 1] >= hit + at + 3  # not across two documents
            postings[slots[hit[own]].astype(np.int64) - 1, row[own]] = True
        return postings

    def candidates(self, query: Query, postings: np.ndarray) -> np.ndarray:
        if query is True:
            return np.ones(postings.shape[1], bool)
        if isinstance(query, str):
            return postings[self.at[query]]
        parts = [self.candidates(q, postings) for q in query[1]]
        return (np.logical_and if query[0] == "and" else np.logical_or).reduce(parts)


class Scanner:
    def __init__(self, rules: tuple[Rule, ...]) -> None:
        self.rules = rules
        self.queries = [trigram_query(r.pattern) for r in rules]
        self.index: Index | None = None
        self.compiled: list[re.Pattern] = []

    def __getstate__(self) -> dict:
        return self.__dict__ | {"index": None, "compiled": []}  # workers make their own

    def scan(self, column: pa.Array) -> list[list[tuple[int, int, int]]]:
        """Of each row: (start, rule's number, end), sorted."""
        if self.index is None:
            self.index = Index(sorted(set().union(*map(named, self.queries))))
            self.compiled = [re.compile(r.pattern, re.ASCII) for r in self.rules]
        column = column.fill_null("")
        data, offsets = column_bytes(column)
        found: list[list[tuple[int, int, int]]] = [[] for _ in range(len(column))]
        first = 0
        while first < len(column):
            last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + BLOCK, "right")) - 1)
            self._block(column, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first], first, found)
            first = last
        return [sorted(f) for f in found]

    def _block(self, column: pa.Array, data: np.ndarray, offsets: np.ndarray, first: int, found: list) -> None:
        postings = self.index.build(data, offsets)
        texts: dict[int, str] = {}
        for k, (rule, query, pattern) in enumerate(zip(self.rules, self.queries, self.compiled, strict=True)):
            for row in np.flatnonzero(self.index.candidates(query, postings)).tolist():
                if row not in texts:
                    texts[row] = column[first + row].as_py()
                for m in pattern.finditer(texts[row]):
                    if rule.accept is None or rule.accept(m):
                        for start, end in rule.parts(m) if rule.parts else (m.span(),):
                            found[first + row].append((start, k, end))


def _join(spans: list[tuple[int, int, int]], rules: tuple[Rule, ...]) -> str:
    return ",".join(f"{rules[k].kind}:{s}:{e}" for s, k, e in spans)


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs with `spans`: kind, start and end of every match, by start, then by the rules' order."""
    scanner = Scanner(rules)

    def fn(batch: pa.RecordBatch) -> dict:
        found = scanner.scan(batch.column(batch.schema.get_field_index(text)))
        return {"spans": [[{"kind": rules[k].kind, "start": s, "end": e} for s, k, e in f] for f in found]}

    return map_batches(docs, fn, "spans array<struct<kind:string,start:bigint,end:bigint>>", keep)


def redact(docs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES, *, text: str = "text", size: str | None = None) -> DataFrame:
    """docs with each span (overlapping ones as one) replaced by <SECRET:kind of the first>; size: a column of the text's length to renew."""
    scanner = Scanner(rules)
    types = {f.name: f.dataType.simpleString() for f in docs.schema.fields}

    def fn(batch: pa.RecordBatch) -> dict:
        column = batch.column(batch.schema.get_field_index(text))
        texts = column.to_pylist()
        for row, spans in enumerate(scanner.scan(column)):
            if spans:
                parts, at, kind, end = [], 0, rules[spans[0][1]].kind, 0
                begin = spans[0][0]
                for s, k, e in [*spans, (len(texts[row]) + 1, 0, 0)]:
                    if s >= end and end:
                        parts += [texts[row][at:begin], f"<SECRET:{kind}>"]
                        at, begin, kind, end = end, s, rules[k].kind, e
                    else:
                        end = max(end, e)
                texts[row] = "".join([*parts, texts[row][at:]])
        out = {text: texts}
        return out | ({size: [None if t is None else len(t) for t in texts]} if size else {})

    order = docs.columns
    return map_batches(docs, fn, f"`{text}` string" + (f", `{size}` {types[size]}" if size else "")).select(*order)


def op3_secrets(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rules = BASE_RULES + MORE_RULES
    scanner = Scanner(rules)

    def fn(batch: pa.RecordBatch) -> dict:
        found = scanner.scan(batch.column(1))
        base = [[s for s in f if s[1] < len(BASE_RULES)] for f in found]
        out = {f"n_{r.kind}": [sum(s[1] == k for s in f) for f in base] for k, r in enumerate(BASE_RULES)}
        return out | {"base_sha256": [hashlib.sha256(_join(f, rules).encode()).hexdigest() for f in base], "spans": [_join(f, rules) for f in found]}

    return map_batches(docs, fn, "n_assign long, n_access long, n_hex long, base_sha256 string, spans string", ["doc_id"])
