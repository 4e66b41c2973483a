"""Exact Jaccard self-join of documents on word shingles, by T-occurrence search.

Two documents link when their shingle sets overlap in at least `percent` per cent of their union. The plan:

1. Each set is ordered by hash. A pair that links shares at least t = ceil(ceil(.75 n) / 10) of the shingles in both
   prefixes of length n - ceil(.75 n) + ceil(n / 10). Postings of the prefixes, packed into arrays by bucket of the
   hash, show which shingles occur in two documents; a document with fewer than t such shingles has no link.
2. Equal sets (128-bit fingerprint) become one representative, their smallest id. The survivors' texts are kept.
3. Over the survivors' whole sets, postings give each shingle's document frequency. A document of which under 75 % of
   the shingles occur twice has no link. The others give their prefix in ascending frequency; documents that share a
   prefix shingle form families (connected components): links never cross families. Here a shingle is its bucket and 32
   bits: shingles that these don't tell apart count as one, which only lets more documents through.
4. Families are joined by DivideSkip: of a query's inverted lists the short ones are merged, those documents that are
   often enough among them are probed in the long ones by binary search, and documents that reach the overlap link.
   A family over BLOCK documents is dealt into blocks, each with the same few pivots of the family. Documents that are
   still in different classes meet again: those outside a family's largest class meet all its blocks, or classes meet
   wherever they share a prefix shingle and are of like size, whichever takes fewer rows. So no link is lost, no document
   is compared within its class, and a long chain of documents costs what its shingles' own lists cost. Blocks grow with
   the family there, so that a document is copied to a few of them only; where that isn't enough, the meetings go in
   rounds, so that the copies on disk grow with the documents, not with the square of a family.
5. Components of the links are found by contraction.

Words of up to eight bytes are told apart exactly, longer ones by 64 bits under a key drawn for each run, sets by 128
bits. Nothing is capped. Defined cases: a text without words has an empty set and links with nothing; with fewer words than
a shingle the whole sequence is its one shingle. Rows that share an id are one document, with the text of the largest
set; rows with a null id are returned with a null component.
"""

from __future__ import annotations

import bisect
import heapq
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.textops import bucket_count, column_bytes, mix64, row_bounds, words
from rasterloom.operators.components import connected_components
from rasterloom.session import discard, materialise, settings, sieve, stored

SHINGLE, PERCENT = 5, 75
BLOCK, PIVOTS = 64, 16
#: When classes meet, a document goes to so many blocks at most, unless one would get more than HELD shingles.
COPIES, HELD = 16, 1 << 19
#: A round of meetings has so many rows, or COPIES times those of the documents that are still open.
ROUND = 1 << 16
#: A batch hands over its postings when it has so many.
POSTINGS = 1_000_000
_NOBODY = np.iinfo(np.int64).min


def shingle_sets(column: pa.Array, size: int = SHINGLE, key: int = 0) -> tuple[list[np.ndarray], np.ndarray]:
    """Of each row: the ascending 64-bit hashes of its distinct shingles, and (rows x 2 longs) 128 bits of the set.

    The second half of the 128 bits stems from a second hash of every shingle.
    """
    data, offsets = column_bytes(column)
    code, row, _, _ = words(data, offsets, key=key)
    bounds = row_bounds(row, len(column)).tolist()
    weights = mix64(np.arange(1, 2 * size + 1, dtype=np.uint64)).reshape(2, size) | np.uint64(1)
    both = []
    for w in weights:
        total = code[: max(0, len(code) - size + 1)] * w[0]
        for k in range(1, size):
            total += code[k : k + len(total)] * w[k]
        both.append(mix64(total))
    out, mark = [], np.zeros((len(column), 2), np.uint64)
    for r in range(len(column)):
        a, b = bounds[r], bounds[r + 1]
        if b - a >= size:
            s, first = np.unique(both[0][a : b - size + 1], return_index=True)
            other = both[1][a : b - size + 1][first]
        elif b > a:
            s, other = (mix64((code[a:b] * w[: b - a]).sum(keepdims=True) + np.uint64(b - a)) for w in weights)
        else:
            s = other = np.zeros(0, np.uint64)
        out.append(s)
        mark[r] = mix64(s + np.uint64(0x0123456789ABCDEF)).sum(dtype=np.uint64) ^ np.uint64(len(s)), mix64(other).sum(dtype=np.uint64)
    return out, mix64(mark).view(np.int64)


def _lists(made: tuple[list[np.ndarray], np.ndarray]) -> tuple[list[np.ndarray], list[list[int]]]:
    return made[0], made[1].tolist()


def least_overlap(n: int, percent: int = PERCENT) -> int:
    """How many of n shingles any partner must share."""
    return -(-n * percent // 100)


def _alike(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order that sorts tokens, of each in that order how many there are)."""
    order = np.argsort(tokens, kind="stable")
    t = tokens[order]
    edge = np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1]))) if len(t) else np.zeros(0, np.int64)
    size = np.diff(np.append(edge, len(t)))
    return order, np.repeat(size, size)


def _packed(x: np.ndarray) -> bytes:
    """Longs as their differences, lowest bytes of all first: near neighbours leave runs of zeros, which shuffles compress."""
    return np.diff(x, prepend=x.dtype.type(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(data, np.uint8).reshape(8, -1).T.copy().view(np.int64).ravel())


def _prefix_table(docs: DataFrame, percent: int, size: int, buckets: int, key: int) -> DataFrame:
    """(doc, n, f1, f2, credit): of each document its set's size and fingerprint and how many shingles of its prefix other documents' prefixes hold."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens: list[np.ndarray] = []
        about: list[tuple] = []
        held = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                for doc, s, mark in zip(part.column(0).to_pylist(), *_lists(shingle_sets(part.column(1), size, key)), strict=True):
                    n = len(s)
                    m = min(n, n - least_overlap(n, percent) + max(1, -(-n // 10)))
                    tokens.append(s[:m].copy())  # not a view, which keeps the whole set
                    about.append((doc, n, *mark))
                    held += m
                if held >= POSTINGS:
                    yield from send(tokens, about)
                    tokens, about, held = [], [], 0
        if about:
            yield from send(tokens, about)

    def send(tokens: list[np.ndarray], about: list[tuple]) -> Iterator[pa.RecordBatch]:
        own = np.repeat(np.arange(len(about), dtype=np.int32), [len(x) for x in tokens])
        t = np.concatenate(tokens)
        tokens.clear()
        ids = np.array([x[0] for x in about], np.int64)
        order = np.argsort(t, kind="stable")
        t, own = t[order], own[order]
        del order
        first = np.concatenate(([True], t[1:] != t[:-1])) if len(t) else np.zeros(0, bool)
        shared = ~(first & np.append(first[1:], True)[: len(t)])  # by several documents
        credit = np.bincount(own[shared], minlength=len(ids))
        t, own = t[first], np.where(shared[first], _NOBODY, ids[own[first]])  # one row for a shingle; its documents here have their credit
        bucket = (t % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
        del bucket
        short = (t >> np.uint64(16)).astype(np.uint32)[order]  # enough to tell apart the few shingles of a bucket; a clash only lets a document through
        own = own[order]
        del t, order
        home = np.array([hash(x) % buckets for x in ids.tolist()], np.int64)
        by_home = np.argsort(home, kind="stable")
        home_cut = np.searchsorted(home[by_home], np.arange(buckets + 1))
        info = np.array([(*x, c) for x, c in zip(about, credit.tolist(), strict=True)], np.int64)
        rows = [b for b in range(buckets) if cut[b] < cut[b + 1] or home_cut[b] < home_cut[b + 1]]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(rows, pa.int32()),
                pa.array([short[cut[b] : cut[b + 1]].tobytes() for b in rows], pa.binary()),
                pa.array([own[cut[b] : cut[b + 1]].tobytes() for b in rows], pa.binary()),
                pa.array([info[by_home[home_cut[b] : home_cut[b + 1]]].tobytes() for b in rows], pa.binary()),
            ],
            ["b", "t", "o", "i"],
        )

    def meet(table: pa.Table) -> pa.Table:
        t = np.concatenate([np.frombuffer(x.as_py(), np.uint32) for x in table.column("t")])
        own = np.concatenate([np.frombuffer(x.as_py(), np.int64) for x in table.column("o")])
        info = np.concatenate([np.frombuffer(x.as_py(), np.int64).reshape(-1, 5) for x in table.column("i")])
        order, count = _alike(t)
        got, credit = np.unique(own[order][(count > 1) & (own[order] != _NOBODY)], return_counts=True)
        return by_home(np.concatenate([info, np.column_stack([got, np.zeros((len(got), 3), np.int64), credit])]))

    def by_home(rows: np.ndarray) -> pa.Table:
        home = rows[:, 0] % buckets
        order = np.argsort(home, kind="stable")
        cut = np.searchsorted(home[order], np.arange(buckets + 1))
        full = [h for h in range(buckets) if cut[h] < cut[h + 1]]
        return pa.table({"h": pa.array(full, pa.int64()), "i": pa.array([rows[order[cut[h] : cut[h + 1]]].tobytes() for h in full], pa.binary())})

    def add(table: pa.Table) -> pa.Table:
        rows = np.concatenate([np.frombuffer(x.as_py(), np.int64).reshape(-1, 5) for x in table.column("i")])
        docs, at = np.unique(rows[:, 0], return_inverse=True)
        credit = np.bincount(at, rows[:, 4], len(docs)).astype(np.int64)
        order = np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1], at))  # the largest set of an id is its last row
        last = rows[order[np.searchsorted(at[order], np.arange(len(docs)), "right") - 1]]
        return pa.table({"doc": pa.array(docs), **{c: pa.array(last[:, k + 1]) for k, c in enumerate(("n", "f1", "f2"))}, "credit": pa.array(credit)})

    packed = docs.mapInArrow(emit, "b int, t binary, o binary, i binary").groupBy("b").applyInArrow(meet, "h long, i binary")
    return packed.groupBy("h").applyInArrow(add, "doc long, n long, f1 long, f2 long, credit long")


def _sets_of(texts: pa.RecordBatch, size: int, key: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Rows of a batch (t, f1, f2, ...) and their sets, a thousand texts at a time; texts whose set has another fingerprint are left out."""
    for at in range(0, texts.num_rows, 1000):
        part = texts.slice(at, 1000)
        made, mark = shingle_sets(part.column("t"), size, key)
        same = (mark[:, 0] == part.column("f1").to_numpy()) & (mark[:, 1] == part.column("f2").to_numpy())
        if same.any():
            yield part.filter(pa.array(same)), [s for s, x in zip(made, same.tolist(), strict=True) if x]


def _families(texts: DataFrame, percent: int, size: int, buckets: int, key: int) -> tuple[DataFrame, DataFrame, str]:
    """(doc, family) of the documents that may link, (doc, t), their prefixes, and the folder of these; texts: doc, t, n, f1, f2 of different sets."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, own_sets in _sets_of(batch, size, key):
                ids = part.column("doc").to_numpy()
                ascending = np.argsort(ids, kind="stable").tolist()
                t = np.concatenate([own_sets[x] for x in ascending])
                own = np.repeat(ids[ascending], [len(own_sets[x]) for x in ascending])
                bucket = (t % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
                short = (t >> np.uint64(16)).astype(np.uint32)
                rows = [b for b in range(buckets) if cut[b] < cut[b + 1]]
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), *(pa.array([pack(x[order[cut[b] : cut[b + 1]]]) for b in rows], pa.binary()) for x, pack in ((short, np.ndarray.tobytes), (own, _packed)))], ["b", "t", "o"])

    def meet(table: pa.Table) -> pa.Table:
        t = np.concatenate([np.frombuffer(x.as_py(), np.uint32) for x in table.column("t")])
        own = np.concatenate([_unpacked(x.as_py()) for x in table.column("o")])
        order, count = _alike(t)
        order, count = order[count > 1], count[count > 1]
        t, own = t[order], own[order]
        home = own % buckets
        by = np.lexsort((own, home))
        cut = np.searchsorted(home[by], np.arange(buckets + 1))
        rows = [h for h in range(buckets) if cut[h] < cut[h + 1]]
        parts = lambda x, pack: pa.array([pack(x[by[cut[h] : cut[h + 1]]]) for h in rows], pa.binary())
        here = pa.array(np.full(len(rows), table.column("b")[0].as_py(), np.int64))
        return pa.table({"h": pa.array(rows, pa.int64()), "b": here, "t": parts(t, np.ndarray.tobytes), "o": parts(own, _packed), "c": parts(count.astype(np.int64), _packed)})

    def prefix(sizes: pa.Table, shared: pa.Table) -> pa.Table:
        join = lambda c: np.concatenate([np.zeros(0, np.int64), *(_unpacked(x.as_py()) for x in shared.column(c))])
        whole = lambda x, b: np.frombuffer(x, np.uint32).astype(np.int64) << 20 | b  # noqa: E731  buckets are 1 << 20 at most
        t = np.concatenate([np.zeros(0, np.int64), *(whole(x.as_py(), b.as_py()) for x, b in zip(shared.column("t"), shared.column("b"), strict=True))])
        own, count = join("o"), join("c")
        order = np.lexsort((t, count, own))
        t, own = t[order], own[order]
        ids, n = sizes.column("doc").to_numpy(), sizes.column("n").to_numpy()
        start, stop = np.searchsorted(own, ids), np.searchsorted(own, ids, "right")
        docs, tokens = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for doc, size, a, b in zip(ids.tolist(), n.tolist(), start.tolist(), stop.tolist(), strict=True):
            least = least_overlap(size, percent)
            if b - a >= least:
                take = size - least + 1 - (size - (b - a))  # shingles of this document alone come first and match nothing
                tokens.append(t[a : a + take])
                docs.append(np.full(take, doc, np.int64))
        return pa.table({"doc": pa.array(np.concatenate(docs)), "t": pa.array(np.concatenate(tokens))})

    home = F.pmod("doc", F.lit(buckets))  # as numpy's remainder
    shared = texts.select("doc", "t", "f1", "f2").mapInArrow(emit, "b int, t binary, o binary").groupBy("b").applyInArrow(meet, "h long, b long, t binary, o binary, c binary")
    sizes = texts.select(home.cast("long").alias("h"), "doc", "n")
    sized = sizes.groupBy("h").cogroup(shared.groupBy("h")).applyInArrow(prefix, "doc long, t long")
    rows, folder = stored(sized)
    heads = rows.groupBy("t").agg(F.min("doc").alias("src"), F.count("*").alias("n")).where("n > 1").select("t", "src")
    families = connected_components(rows.join(heads, "t").select("src", F.col("doc").alias("dst"))).select(F.col("node").alias("doc"), F.col("component").alias("family"))
    return families, rows, folder


class Forest:
    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def merge_short(lists: list[tuple[list[int], list[int], int]], need: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids in low..high - 1 whose lists weigh `need` or more together, and that weight.

    lists: (starts, stops, weight), the maximal runs of consecutive ids of an inverted list. A heap holds each list's next
    boundary. Where the lists at hand weigh too little, those that begin next and still weigh less than `need` together
    with them skip ahead to the boundary after (MergeSkip).
    """
    at = [bisect.bisect_right(stops, low) for _, stops, _ in lists]
    heap = [(max(x[0][i], low), k) for k, (x, i) in enumerate(zip(lists, at, strict=True)) if i < len(x[0]) and x[0][i] < high]
    heapq.heapify(heap)
    left = sum(lists[k][2] for _, k in heap)
    inside = [False] * len(lists)
    weight, found = 0, []
    while heap and left >= need:
        here = heap[0][0]
        if here >= high:
            break
        while heap and heap[0][0] == here:
            k = heap[0][1]
            starts, stops, own = lists[k]
            if inside[k]:
                inside[k] = False
                weight -= own
                at[k] += 1
                if at[k] < len(starts):
                    heapq.heapreplace(heap, (starts[at[k]], k))
                else:
                    heapq.heappop(heap)
                    left -= own
            else:
                inside[k] = True
                weight += own
                heapq.heapreplace(heap, (stops[at[k]], k))
        if weight >= need:
            found.append((here, min(heap[0][0], high), weight))
            continue
        waiting, most = [], weight
        while heap and not inside[heap[0][1]] and most + lists[heap[0][1]][2] < need:
            most += lists[heap[0][1]][2]
            waiting.append(heapq.heappop(heap)[1])
        if not heap:
            break
        goal = heap[0][0]
        for k in waiting:
            starts, stops, own = lists[k]
            at[k] = i = bisect.bisect_right(stops, goal, at[k])
            if i < len(starts):
                heapq.heappush(heap, (max(starts[i], goal), k))
            else:
                left -= own
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([np.arange(a, b) for a, b, _ in found]), np.repeat([w for *_, w in found], [b - a for a, b, _ in found])


def join_block(sets: list[np.ndarray], percent: int = PERCENT, mark: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links among the sets, as pairs of positions.

    mark: if given, a class for each set; sets of one class are known to be connected and not compared.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    order = np.argsort(sizes, kind="stable")
    tokens, owner = np.concatenate([sets[i] for i in order]), np.repeat(np.arange(len(order)), sizes[order])
    _, code = np.unique(tokens, return_inverse=True)
    count = np.bincount(code)
    by = np.lexsort((owner, code))
    start = np.concatenate(([0], np.cumsum(count)))
    posted = owner[by]  # of each shingle, its documents by ascending size
    held = code[by]
    first = np.flatnonzero(np.concatenate(([True], (posted[1:] != posted[:-1] + 1) | (held[1:] != held[:-1]))) if len(posted) else [])
    last = np.append(first[1:], len(posted)) - 1
    begin, end = posted[first], posted[last] + 1  # runs of consecutive documents
    cut = np.searchsorted(first, start)
    # shingles of the same documents share one inverted list, which weighs as much as they are many
    named: dict[bytes, int] = {}
    runs: list[tuple[list[int], list[int]]] = []
    posts: list[np.ndarray] = []
    which = np.full(len(count), -1, np.int64)
    for c in np.flatnonzero(count > 1).tolist():
        x = posted[start[c] : start[c + 1]]
        which[c] = named.setdefault(x.tobytes(), len(runs))
        if which[c] == len(runs):
            runs.append((begin[cut[c] : cut[c + 1]].tolist(), end[cut[c] : cut[c + 1]].tolist()))
            posts.append(x)
    length = np.array([len(x) for x in posts], np.int64)
    ends = np.concatenate(([0], np.cumsum(sizes[order])))
    n_of = sizes[order]
    forest, links = Forest(len(order)), []
    if mark is not None:
        head: dict[int, int] = {}
        for q, m in enumerate(np.asarray(mark)[order].tolist()):
            forest.join(head.setdefault(m, q), q)
    for q in range(1, len(order)):
        n = int(n_of[q])
        low = int(np.searchsorted(n_of, least_overlap(n, percent)))
        if not n or low >= q:
            continue
        need = -(-percent * (n + int(n_of[low])) // (100 + percent))  # overlap that the smallest partner must reach
        own = which[code[ends[q] : ends[q + 1]]]
        own = own[own >= 0]
        if len(own) < need:
            continue
        own, weight = np.unique(own, return_counts=True)
        by_length = np.argsort(length[own], kind="stable")
        own, weight = own[by_length], weight[by_length]
        most = min(need - 1, int(need / (0.01 * np.log(length[own[-1]] + 1) + 1)))
        far = np.cumsum(weight[::-1])  # of the longest lists together
        probed = int(np.searchsorted(far, most, "right"))
        split = len(own) - probed
        rest = int(far[probed - 1]) if probed else 0
        ids, got = merge_short([(*runs[k], w) for k, w in zip(own[:split].tolist(), weight[:split].tolist(), strict=True)], need - rest, low, q)
        rank = np.argsort(-got, kind="stable")
        ids, got = ids[rank], got[rank]
        long = [(posts[k], w) for k, w in zip(own[split:][::-1].tolist(), weight[split:][::-1].tolist(), strict=True)]
        batch = 1
        while len(ids):
            root = forest.find(q)
            keep = np.array([forest.find(x) != root for x in ids.tolist()], bool)
            ids, got = ids[keep], got[keep]
            part, shared = ids[:batch], got[:batch].copy()
            for x, w in long:
                k = np.searchsorted(x, part)
                shared += w * (x[np.minimum(k, len(x) - 1)] == part)
            for other in part[100 * shared >= percent * (n + n_of[part] - shared)].tolist():
                if forest.join(q, other):
                    links.append((int(order[q]), int(order[other])))
            ids, got = ids[batch:], got[batch:]
            batch = min(4 * batch, BLOCK)
    return links


def _join_groups(rows: DataFrame, percent: int) -> DataFrame:
    """(src, dst) links; rows: g (group), k (which of them meet within it), doc, mark (a class known to be connected, or null), s, and columns that don't matter."""

    def local(table: pa.Table) -> pa.Table:
        docs, sets = table.column("doc").to_numpy(), [np.frombuffer(x.as_py(), np.uint64) for x in table.column("s")]
        family, marks = table.column("k").to_numpy(), table.column("mark").to_pylist()
        src, dst = [], []
        by = np.argsort(family, kind="stable")
        edges = np.append(np.flatnonzero(np.concatenate(([True], np.diff(family[by]) != 0))), len(by))
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            at = by[a:b]
            if b - a > 1:
                mark = None if marks[at[0]] is None else np.array([marks[x] for x in at], np.int64)
                for x, y in join_block([sets[i] for i in at], percent, mark):
                    src.append(int(docs[at[x]]))
                    dst.append(int(docs[at[y]]))
        return pa.table({"src": pa.array(src, pa.int64()), "dst": pa.array(dst, pa.int64())})

    return rows.groupBy("g").applyInArrow(local, "src long, dst long")


def _blocks(m: str, n: Column) -> Column:
    """Into how many blocks m documents of about n shingles go: COPIES at most, but of BLOCK documents at least, and beyond these of HELD shingles at most."""
    most = F.greatest(F.lit(BLOCK), F.floor(HELD / n))
    return F.ceil(F.col(m) / F.least(most, F.greatest(F.lit(BLOCK), F.ceil(F.col(m) / COPIES))))


def _shared_prefixes(heads: DataFrame, classes: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Groups in which documents of different classes meet; every link between classes has both ends in one of them.

    heads: t, doc (prefix shingles); classes: doc, family, class, n. A group is a shingle that classes share, and a step of
    sizes within 1 / percent; of shingles with the same documents one stands for all. Returned: (doc, family, class, t,
    step), and of each group (t, step, family, blocks, cost), cost being the rows it takes if dealt into pairs of blocks.
    """
    held = heads.join(classes, "doc")
    alike = [F.bit_xor(F.xxhash64("doc", F.lit(salt))).alias(f"x{salt}") for salt in (21, 22)]
    mixed = held.groupBy("t").agg(F.min("class").alias("a"), F.max("class").alias("b"), F.count("*").alias("c"), *alike).where("a <> b")
    kept = mixed.groupBy("c", "x21", "x22").agg(F.min("t").alias("t")).select("t")
    step = F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / percent)) + 1e-9)
    # sizes of a link are at most one step apart: a step's group holds those of the next step too
    rows = materialise(held.join(kept, "t").select("t", "doc", "family", "class", F.explode(F.array(step, step - 1)).alias("step")))
    size = rows.groupBy("t", "step").agg(F.count("*").alias("m"), F.min("class").alias("a"), F.max("class").alias("b"), F.min("family").alias("family")).where("a <> b")
    blocks = _blocks("m", F.pow(F.lit(100 / percent), F.col("step") + 2))
    return rows, materialise(size.select("t", "step", "family", blocks.alias("blocks"), (F.col("m") * blocks).alias("cost")))


def _links(texts: DataFrame, families: DataFrame, heads: DataFrame, percent: int, size: int, buckets: int, key: int) -> tuple[DataFrame, list[str]]:
    """(src, dst): links whose components are those of all links, and the folders that they are read from."""
    sized, sizes = stored(families.join(families.groupBy("family").agg(F.count("*").alias("m")), "family").select("doc", "family", "m"))
    sized = sized.where("m > 1")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, made in _sets_of(batch, size, key):
                yield pa.RecordBatch.from_arrays([part.column("doc"), part.column("n"), pa.array([s.tobytes() for s in made], pa.binary()), part.column("family"), part.column("m")], ["doc", "n", "s", "family", "m"])

    # a document's share of draws: pivots are few of a family, blocks about BLOCK documents
    draw = F.pmod(F.xxhash64("doc", F.lit(5)), F.lit(1 << 30)) / float(1 << 30)
    blocks = F.ceil(F.col("m") / BLOCK)
    with settings(texts.sparkSession, sieve(sized.count())):
        sets, held_sets = stored(texts.join(sized, "doc").select("doc", "t", "n", "f1", "f2", "family", "m").mapInArrow(build, "doc long, n long, s binary, family long, m long"))
    rows = sets.select("doc", "n", "s", "family", "m", blocks.alias("blocks"), F.pmod(F.xxhash64("doc", F.lit(9)), blocks).alias("block"))
    none = F.lit(None).cast("long").alias("mark")
    small = rows.where("blocks = 1").select(F.concat(F.lit("s"), F.pmod(F.xxhash64("family"), F.lit(buckets))).alias("g"), F.col("family").alias("k"), "doc", none, "s")
    name = lambda c: F.concat_ws("/", "family", c)
    large = rows.where("blocks > 1")
    dealt = large.select(name("block").alias("g"), F.col("family").alias("k"), "doc", none, "s")
    pivots = large.where(draw * F.col("m") < PIVOTS).withColumn("to", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("to <> block")
    pivots = pivots.select(name("to").alias("g"), F.col("family").alias("k"), "doc", none, "s")
    found = materialise(_join_groups(small.unionByName(dealt).unionByName(pivots), percent))
    if large.isEmpty():
        return found, [sizes, held_sets]
    # what pivots and blocks left apart: in a family, either those outside its largest class meet all its blocks, or classes
    # meet wherever they share a prefix shingle, whichever takes fewer rows; both find every link between classes
    known = connected_components(found)
    classes = materialise(large.select("doc", "family", "n").join(known.withColumnRenamed("node", "doc"), "doc", "left").withColumn("class", F.coalesce("component", "doc")).drop("component"))
    largest = classes.groupBy("family", "class").agg(F.count("*").alias("c"), F.sum("n").alias("n")).groupBy("family").agg(F.max_by("class", F.struct("c", F.negative("class"))).alias("main"), F.max("c").alias("c"), F.sum("c").alias("all"), F.sum("n").alias("n"))
    apart = largest.where("c < all").withColumn("blocks", _blocks("all", F.col("n") / F.col("all"))).drop("n")
    apart = materialise(apart.withColumn("parts", F.ceil((F.col("all") - F.col("c")) / F.ceil(F.col("all") / F.col("blocks")))))
    open_ = materialise(classes.join(apart, "family"))  # a join of its own, so that a hot family's partition can be split
    held, groups = _shared_prefixes(heads, open_.select("doc", "family", "class", "n"), percent)
    by_shingle = groups.groupBy("family").agg(F.sum("cost").alias("cost"))
    cost, wide = F.coalesce("cost", F.lit(0)), F.col("all") * F.col("parts") + (F.col("all") - F.col("c")) * F.col("blocks")
    choice = materialise(apart.join(by_shingle, "family", "left").select("family", (cost < wide).alias("by_shingle"), F.least(cost, wide).alias("rows")))  # without a shared shingle there is nothing to do
    chosen = groups.join(choice.where("by_shingle"), "family").select("t", "step", "blocks")
    dealt = held.join(chosen, ["t", "step"]).withColumn("own", F.pmod(F.xxhash64("doc", F.lit(17)), F.col("blocks"))).withColumn("to", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    meet = dealt.select(F.concat_ws("/", "t", "step", F.least("own", "to"), F.greatest("own", "to")).alias("g"), "doc", "class")
    wide = open_.join(choice.where("not by_shingle").select("family"), "family").withColumn("block", F.pmod(F.xxhash64("doc", F.lit(9)), F.col("blocks")))
    wide = wide.withColumn("part", F.when(F.col("class") != F.col("main"), F.pmod(F.xxhash64("doc", F.lit(13)), F.col("parts"))))  # of strays alone
    asks = wide.where("part is not null").withColumn("to", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rest = wide.withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).where("part is null or at <> part")  # there it asks already
    met = asks.select(F.concat_ws("/", "family", "to", "part").alias("g"), "doc", "class").unionByName(rest.select(F.concat_ws("/", "family", "block", "at").alias("g"), "doc", "class"))
    every, meetings = meet.unionByName(met), choice.agg(F.sum("rows").alias("n")).first()["n"] or 0
    rounds = max(1, -(-meetings // max(ROUND, COPIES * open_.count())))
    for turn in range(rounds):
        now = materialise(every.where(F.pmod(F.xxhash64("g"), F.lit(rounds)) == turn))
        tasks = max(2 * buckets, -(-meetings // rounds // (8 * BLOCK)))
        met_sets = now.join(large.select("doc", "s"), "doc").select("g", F.lit(0).cast("long").alias("k"), "doc", F.col("class").alias("mark"), "s")
        found = found.unionByName(materialise(_join_groups(met_sets.repartition(tasks, "g"), percent)))
    return found, [sizes, held_sets]


def similar_documents(docs: DataFrame, *, text: str = "text", key: str = "doc_id", percent: int = PERCENT, size: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each document; key must be a 64-bit or smaller integer."""
    word_key = random.SystemRandom().getrandbits(64)
    rows = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("t"))
    buckets = bucket_count(rows)
    named = rows.where("doc is not null")
    table = materialise(_prefix_table(named, percent, size, buckets, word_key))
    classes = materialise(table.where("n > 0").groupBy("f1", "f2").agg(F.min("doc").alias("rep"), F.max("n").alias("n"), F.max("credit").alias("credit")))
    need = F.ceil(F.ceil(F.col("n") * percent / 100) / 10)
    # as files, filtered where they are read, so that Spark can sift the texts by a Bloom filter before it shuffles them
    spared, spared_rows = stored(classes.select(F.col("rep").alias("doc"), "n", "f1", "f2", (F.col("credit") - need).alias("spare")))
    able = spared.where("spare >= 0").select("doc", "n", "f1", "f2")

    # a row repeated with its id comes twice here, which adds no link but one of the document with itself
    with settings(docs.sparkSession, sieve(able.count())):
        texts, all_texts = stored(named.join(able, "doc").select("doc", "t", "n", "f1", "f2"))
    families, heads, all_heads = _families(texts, percent, size, buckets, word_key)
    links, folders = _links(texts, families, heads, percent, size, buckets, word_key)
    linked = connected_components(links)  # the links are read here, the texts not again
    for folder in (spared_rows, all_texts, all_heads, *folders):
        discard(docs.sparkSession, folder)
    reps = classes.join(linked.withColumnRenamed("node", "rep"), "rep", "left").select("f1", "f2", F.coalesce("component", "rep").alias("component_id"))
    out = table.where("n > 0").join(reps, ["f1", "f2"]).select(F.col("doc").alias(key), F.col("n").alias("n_shingles"), "component_id")
    alone = table.where("n = 0").select(F.col("doc").alias(key), F.col("n").alias("n_shingles"), F.col("doc").alias("component_id"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [len(s) for s in shingle_sets(batch.column(1), size)[0]]
            none = pa.nulls(len(n), pa.int64())
            yield pa.RecordBatch.from_arrays([none, pa.array(n, pa.int64()), none], [key, "n_shingles", "component_id"])

    nameless = rows.where("doc is null").mapInArrow(count, f"`{key}` long, n_shingles long, component_id long")
    return out.unionByName(alone).unionByName(nameless)


def op5_jaccard(spark, sf_dir: str) -> DataFrame:
    return similar_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
