"""Transcripts into canonical chat turns: a hidden Markov model recovers each line's role by Viterbi decoding.

A transcript is the rows of one conversation in the order of (turn, text). A row's text is cut into lines; the row's
speaker, or a mark at a line's start ("User:", "### Assistant:", "<|system|>"), is the line's marker; length, question
mark, list or code form, and for a row's first line the size of the row are its features. All probabilities (of the first
role, of the next row's and the next line's role, of markers and of features for each role) are learnt from the whole
table: counted first from rows with a known marker, then again from decoded paths (hard expectation-maximisation), so
that how far a marker is to be trusted follows from the data, and a marker against the sequence can be overruled. A
second decoding without the speakers' names gives the blind role, which tells how well the model does without them.

Rows are dealt by range of (conversation, turn), so one huge conversation spreads over many partitions. Decoding stays
exact: a partition's first and last conversation are summed up as a max-plus matrix over the roles; the driver chains
these summaries (at most two a partition) and tells each partition its entry and exit roles; then each decodes alone.

Defined cases: a null or empty text is one empty line. Null conversation ids form one conversation, null turns come
first, equal turns go by text, equal rows in any order. An empty table gives an empty result; extra columns are ignored.
Rendering opens a turn where the role changes or the conversation begins, and closes the last.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from rasterloom.session import materialise

ROLES = ("system", "user", "assistant")
#: Names under which speakers appear.
NAMES = {"system": 0, "instruction": 0, "user": 1, "human": 1, "q": 1, "question": 1, "customer": 1, "assistant": 2, "ai": 2, "bot": 2, "model": 2, "a": 2, "answer": 2, "agent": 2}
MARK = re.compile(r"^\s{0,3}(?:#{1,4}\s*|\*{1,2}|<\|(?:im_start\|>)?|\[)?(%s)(?:\*{1,2})?\s*(?:\|>|\]|[:>])\*{0,2}\s*" % "|".join(NAMES), re.I | re.A)
NONE, HIDDEN = len(ROLES), len(ROLES) + 1
LOW = -1e300


def marker_of(name: str | None) -> int:
    return NAMES.get((name or "").strip().lower(), NONE)


def features(line: str, first: bool, whole: int) -> int:
    """One of KINDS kinds: of a line within a row its size, form and question mark; of a row's first line the row's size (a power of two), form and question mark."""
    form = (1 if line[:1] and line[:1] in "-*•>|`#" or line.startswith("    ") else 0) * 2 + line.rstrip().endswith("?")
    if first:
        return 12 + min(whole.bit_length(), 17) * 4 + form
    return (0 if len(line) < 60 else 1 if len(line) < 300 else 2) * 4 + form


KINDS = 12 + 18 * 4


def lines_of(text: str | None, speaker: str | None) -> list[tuple[int, int, bool, str]]:
    """(marker, kind of features, begins a row, text without its mark) of each line."""
    out = []
    for k, line in enumerate((text or "").split("\n")):
        m = MARK.match(line)
        marker = marker_of(m.group(1)) if m else marker_of(speaker) if not k else NONE
        body = line[m.end() :] if m else line
        out.append((marker, features(body, not k, len(text or "")), not k, body))
    return out


#: What is counted: (first role), (role, next row's role), (role, next line's role), (role, marker), (role, kind).
START, TURN, STAY, TELL, KIND = range(5)


class Model:
    """Log probabilities: start[role], turn[from][to] into a new row, stay[from][to] within one, mark[role][marker], kind[role][kind].

    counts: (what, a, b) -> how often; pseudo-counts stand in for what was not seen.
    """

    def __init__(self, counts: dict[tuple[int, int, int], int]) -> None:
        n = range(len(ROLES))
        log = lambda row: [math.log(x / sum(row)) for x in row]
        usual = {(0, 1): 8.0, (1, 2): 8.0, (2, 1): 8.0}
        seen = lambda *k: counts.get(k, 0)
        self.start = log([seen(START, r, 0) + (1.0, 4.0, 0.5)[r] for r in n])
        self.turn = [log([seen(TURN, a, b) + usual.get((a, b), 0.5) for b in n]) for a in n]
        self.stay = [log([seen(STAY, a, b) + (49.0 if a == b else 0.5) for b in n]) for a in n]
        self.mark = [log([*(seen(TELL, r, m) + (16.0 if m == r else 0.2) for m in n), seen(TELL, r, NONE) + 10.0]) for r in n]
        self.kind = [log([seen(KIND, r, k) + 1.0 for k in range(KINDS)]) for r in n]

    def emit(self, r: int, line: tuple) -> float:
        return (self.mark[r][line[0]] if line[0] != HIDDEN else 0.0) + self.kind[r][line[1]]

    def step(self, v: list[float], line: tuple) -> tuple[list[float], list[int]]:
        move = self.turn if line[2] else self.stay
        new, back = [], []
        for r in range(len(ROLES)):
            best = max(range(len(ROLES)), key=lambda q: (v[q] + move[q][r], -q))
            back.append(best)
            new.append(v[best] + move[best][r] + self.emit(r, line))
        return new, back

    def begin(self, line: tuple) -> list[float]:
        return [self.start[r] + self.emit(r, line) for r in range(len(ROLES))]

    def matrix(self, lines: list[tuple]) -> list[list[float]]:
        """Best score of each (role before, role at the end)."""
        rows = []
        for q in range(len(ROLES)):
            v = [0.0 if r == q else LOW for r in range(len(ROLES))]
            for line in lines:
                v, _ = self.step(v, line)
            rows.append(v)
        return rows

    def decode(self, lines: list[tuple], before: int | None = None, last: int | None = None) -> list[int]:
        if before is None:
            v, rest = self.begin(lines[0]), lines[1:]
        else:
            v, rest = [0.0 if r == before else LOW for r in range(len(ROLES))], lines
        backs = []
        for line in rest:
            v, back = self.step(v, line)
            backs.append(back)
        r = max(range(len(ROLES)), key=lambda q: (v[q], -q)) if last is None else last
        path = [r]
        for back in reversed(backs):
            r = back[r]
            path.append(r)
        path.reverse()
        return path if before is None else path[1:]

    def score(self, lines: list[tuple], path: list[int]) -> float:
        total = self.start[path[0]] + self.emit(path[0], lines[0])
        for a, b, line in zip(path[:-1], path[1:], lines[1:], strict=True):
            total += (self.turn if line[2] else self.stay)[a][b] + self.emit(b, line)
        return total


def blinded(lines: list[tuple], text: str | None) -> list[tuple]:
    """The lines of a row as if its speaker were not named; marks in the text stay."""
    if lines and not MARK.match((text or "").split("\n", 1)[0]):
        return [(HIDDEN, *lines[0][1:]), *lines[1:]]
    return lines


def _tally(pairs: Iterator[tuple[tuple[int, int, int], int]]) -> pa.RecordBatch:
    seen: dict[tuple[int, int, int], int] = {}
    for k, n in pairs:
        seen[k] = seen.get(k, 0) + n
    return pa.RecordBatch.from_arrays([*(pa.array([k[i] for k in seen], pa.int32()) for i in range(3)), pa.array(list(seen.values()), pa.int64())], ["w", "a", "b", "n"])


def _collected(counted: DataFrame) -> dict[tuple[int, int, int], int]:
    return {(r["w"], r["a"], r["b"]): r["n"] for r in counted.groupBy("w", "a", "b").agg(F.sum("n").alias("n")).collect()}  # a few hundred at most


def first_counts(rows: DataFrame) -> dict[tuple[int, int, int], int]:
    """Counts from the rows with a marker; rows: c, t, x, s. The followers of a row are found by joining on (conversation, turn + 1)."""
    spoken = rows.select("c", "t", "x", F.lower(F.trim("s")).alias("s"))
    role = F.create_map(*[F.lit(v) for kv in NAMES.items() for v in kv])
    heads = spoken.select("c", "t", role[F.col("s")].alias("r")).groupBy("c", "t").agg(F.min("r").alias("r")).where("r is not null")
    after = heads.select("c", (F.col("t") - 1).alias("t"), F.col("r").alias("q"))
    counts = {(TURN, x["r"], x["q"]): x["n"] for x in heads.join(after, ["c", "t"]).groupBy("r", "q").agg(F.count("*").alias("n")).collect()}
    first = rows.groupBy("c").agg(F.min("t").alias("t"))
    counts |= {(START, x["r"], 0): x["n"] for x in heads.join(first, ["c", "t"]).groupBy("r").agg(F.count("*").alias("n")).collect()}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each(batch: pa.RecordBatch) -> Iterator[tuple[tuple[int, int, int], int]]:
            for text, speaker in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                now = NONE
                for marker, kind, _, _ in lines_of(text, speaker):
                    now = marker if marker != NONE else now
                    if now != NONE:
                        yield (KIND, now, kind), 1

        for batch in batches:
            yield _tally(each(batch))

    return counts | _collected(rows.select("x", "s").mapInArrow(count, "w int, a int, b int, n long"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bool, bool, list]]:
    """Of each conversation in a sorted partition: (partition, is the first, is the last, rows)."""
    own: list = []
    first = True
    part = -1
    for batch in batches:
        for p, c, t, x, s in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
            part = p
            if own and own[0][0] != c:
                yield part, first, False, own
                own, first = [], False
            own.append((c, t, x, s))
    if own:
        yield part, first, True, own


def dealt_rows(turns: DataFrame, conversation: str, turn: str, text: str, speaker: str | None) -> DataFrame:
    """(p, c, t, x, s): the rows by range of conversation, turn and text, sorted within their partition p."""
    rows = turns.select(F.col(conversation).alias("c"), F.col(turn).alias("t"), F.col(text).alias("x"), (F.col(speaker).cast("string") if speaker else F.lit(None).cast("string")).alias("s"))
    order = [F.col("c").asc_nulls_first(), F.col("t").asc_nulls_first(), F.col("x").asc_nulls_first(), F.col("u")]
    dealt = rows.withColumn("u", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    return materialise(dealt.select(F.spark_partition_id().alias("p"), "c", "t", "x", "s"))


def _plan(dealt: DataFrame, model: Model, blind: bool) -> dict:
    """How conversations cut by partitions go on: see _chain."""

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p, first, last, own in _runs(batches):
            if first or last:
                lines = [x for r in own for x in _seen(r, blind)]
                head = model.begin(lines[0])
                for line in lines[1:]:
                    head, _ = model.step(head, line)
                c = own[0][0]
                yield pa.RecordBatch.from_arrays([pa.array([p]), pa.array([first]), pa.array([last]), pa.array([None if c is None else str(c)], pa.string()), pa.array([head]), pa.array([model.matrix(lines)])], ["p", "f", "l", "c", "h", "m"])

    ends = dealt.mapInArrow(summary, "p long, f boolean, l boolean, c string, h array<double>, m array<array<double>>").collect()
    return _chain(sorted(ends, key=lambda e: (e["p"], not e["f"])))


def _seen(row: tuple, blind: bool) -> list[tuple]:
    lines = lines_of(row[2], row[3])
    return blinded(lines, row[2]) if blind else lines


def _ends(plan: dict, p: int, first: bool, last: bool) -> tuple[int | None, int | None, bool]:
    return plan.get((p, first, last), (None, None, False)) if first or last else (None, None, False)


def fit_model(dealt: DataFrame, rounds: int = 2) -> Model:
    """Learnt from the rows of dealt_rows: counts of marked rows, then `rounds` times of the decoded paths of all rows."""
    model = Model(first_counts(dealt))
    for _ in range(rounds):
        plan = _plan(dealt, model, False)

        def count(batches: Iterator[pa.RecordBatch], model: Model = model, plan: dict = plan) -> Iterator[pa.RecordBatch]:
            def each() -> Iterator[tuple[tuple[int, int, int], int]]:
                for p, first, last, own in _runs(batches):
                    before, at_end, _ = _ends(plan, p, first, last)
                    lines = [x for r in own for x in lines_of(r[2], r[3])]
                    path = model.decode(lines, before, at_end)
                    if before is None:
                        yield (START, path[0], 0), 1
                    for k, (r, line) in enumerate(zip(path, lines, strict=True)):
                        earlier = path[k - 1] if k else before
                        if earlier is not None:
                            yield (TURN if line[2] else STAY, earlier, r), 1
                        yield (TELL, r, line[0]), 1
                        yield (KIND, r, line[1]), 1

            yield _tally(each())

        model = Model(_collected(dealt.mapInArrow(count, "w int, a int, b int, n long")))
    return model


def parse_transcripts(turns: DataFrame, *, conversation: str = "conv_id", turn: str = "turn", text: str = "text", speaker: str | None = "role", model: Model | None = None) -> DataFrame:
    """A row for each row of turns: conversation, turn, role (of its first line), blind_role (that without the speakers), n_lines, n_turns (turns that open here), rendered.

    The rendered parts of a conversation, joined in order, are its canonical transcript. model: by default fitted on turns.
    """
    kind_c, kind_t = turns.schema[conversation].dataType, turns.schema[turn].dataType
    dealt = dealt_rows(turns, conversation, turn, text, speaker)
    model = fit_model(dealt) if model is None else model
    plan, blind_plan = _plan(dealt, model, False), _plan(dealt, model, True)

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for p, first, last, own in _runs(batches):
            before, at_end, goes_on = _ends(plan, p, first, last)
            cut = [lines_of(r[2], r[3]) for r in own]
            path = model.decode([x for ls in cut for x in ls], before, at_end)
            blind = model.decode([x for ls, r in zip(cut, own, strict=True) for x in blinded(ls, r[2])], *_ends(blind_plan, p, first, last)[:2])
            k, now = 0, before
            for i, (r, ls) in enumerate(zip(own, cut, strict=True)):
                parts, opened, role, other = [], 0, path[k], blind[k]
                for line in ls:
                    if path[k] != now:
                        parts.append(("<|end|>\n" if now is not None else "") + f"<|{ROLES[path[k]]}|>\n")
                        opened, now = opened + 1, path[k]
                    parts.append(line[3] + "\n")
                    k += 1
                if i == len(own) - 1 and not goes_on:
                    parts.append("<|end|>\n")
                out.append((r[0], r[1], ROLES[role], ROLES[other], len(ls), opened, "".join(parts)))
            if len(out) >= 5000:
                yield _batch(out)
                out = []
        if out:
            yield _batch(out)

    schema = T.StructType([T.StructField(conversation, kind_c), T.StructField(turn, kind_t), *(T.StructField(n, k) for n, k in (("role", T.StringType()), ("blind_role", T.StringType()), ("n_lines", T.LongType()), ("n_turns", T.LongType()), ("rendered", T.StringType())))])
    arrow = to_arrow_schema(schema)

    def _batch(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(col, f.type) for col, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

    return dealt.mapInArrow(render, schema)


def _chain(ends: list) -> dict[tuple[int, bool, bool], tuple[int | None, int | None, bool]]:
    """(partition, first, last) -> (role before, role at the end, whether the conversation goes on) of fragments of conversations cut by partitions."""
    plan: dict = {}
    k = 0
    while k < len(ends):
        group = [ends[k]]
        while group[-1]["l"] and k + len(group) < len(ends) and ends[k + len(group)]["f"] and ends[k + len(group)]["c"] == group[0]["c"]:
            group.append(ends[k + len(group)])
        if len(group) > 1:
            scores = [list(group[0]["h"])]
            for e in group[1:]:
                scores.append([max(scores[-1][q] + e["m"][q][r] for q in range(len(ROLES))) for r in range(len(ROLES))])
            role = max(range(len(ROLES)), key=lambda r: (scores[-1][r], -r))
            for i in range(len(group) - 1, -1, -1):
                before = max(range(len(ROLES)), key=lambda q: (scores[i - 1][q] + group[i]["m"][q][role], -q)) if i else None
                plan[group[i]["p"], group[i]["f"], group[i]["l"]] = (before, role, i < len(group) - 1)
                role = before
        k += len(group)
    return plan


def op10_chat(spark, sf_dir: str) -> DataFrame:
    return parse_transcripts(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
