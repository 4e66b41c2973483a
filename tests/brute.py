"""Plain loops that say what the operators must give, written from the definitions and without the package."""

import itertools
import math

import numpy as np


def zscore(v):
    std = v.std(0)
    return (v - v.mean(0)) / np.where(std < 1e-8, 1, std)


def scores(v, k, standardise=False):
    c = v - v.mean(0)
    values, axes = np.linalg.eigh(c.T @ c / len(v))
    order = np.argsort(-values)[: min(k, v.shape[1], len(v) - 1)]
    p = c @ axes[:, order]
    return p / np.where(p.std(0) < 1e-8, 1, p.std(0)) if standardise else p


def graph(p, yx, k, radius, least, mutual=True):
    """Directed edges of the symmetrised graph."""
    top = {}
    for i, (y, x) in enumerate(yx):
        near = [(float(((p[i] - p[j]) ** 2).sum()), j) for j, (b, a) in enumerate(yx) if j != i and abs(b - y) <= radius and abs(a - x) <= radius]
        top[i] = [j for _, j in sorted(near)[: min(k, (radius + 1) ** 2 - 1)]]
    if not mutual:
        return {(i, j) for i in top for j in top[i]} | {(j, i) for i in top for j in top[i]}
    edges = {(i, j) for i in top for j in top[i] if i in top[j]}
    degree = {i: sum((i, j) in edges for j in top[i]) for i in top}
    for i in top:
        missing = [j for j in top[i] if i not in top[j]]
        for j in missing[: max(0, least - degree[i])]:
            edges |= {(i, j), (j, i)}
    return edges


def weights(v, yx, edges, spatial=True):
    edges = sorted(edges)
    d = np.array([np.linalg.norm(v[i] - v[j]) for i, j in edges])
    s = np.array([math.dist(yx[i], yx[j]) for i, j in edges])
    a, b = max(np.median(d), 1e-6), max(np.median(s), 1e-6)
    w = np.exp(-(d**2) / (2 * a * a)) * (np.exp(-(s**2) / (2 * b * b)) if spatial else 1)
    out = np.zeros((len(v), len(v)))
    for (i, j), x in zip(edges, w, strict=True):
        out[i, j] = x
    return out


def diffuse(v, w, rounds, alpha=0.5):
    total = w.sum(1, keepdims=True)
    y = v.copy()
    for _ in range(rounds):
        mean = np.where(total > 1e-12, w @ y / np.where(total > 1e-12, total, 1), y)
        y = (1 - alpha) * y + alpha * mean
    return y


def components(n, pairs):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def fine_modes(space, neighbours, radius):
    d = np.sqrt(((space[:, None] - space[None]) ** 2).sum(-1))
    pairs = [(i, j) for i in range(len(space)) for j in sorted((j for j in range(len(space)) if j != i), key=lambda j: (d[i, j], j))[:neighbours] if d[i, j] <= radius]
    found = components(len(space), pairs)
    number = {c: k for k, c in enumerate(sorted(set(found)))}
    return [number[c] for c in found]


def local_scale(space, rank):
    d = np.sqrt(((space[:, None] - space[None]) ** 2).sum(-1))
    q = [sorted(d[i, j] for j in range(len(space)) if j != i)[rank - 1] for i in range(len(space))]
    return float(np.median([x for x in q if x > 0]))


def majority(labels, yx, radius):
    if radius <= 0:
        return list(labels)
    at = dict(zip(yx, labels, strict=True))
    h, w = max(y for y, _ in yx), max(x for _, x in yx)
    out = []
    for (y, x), own in zip(yx, labels, strict=True):
        seen = [at[(min(max(y + a, 0), h), min(max(x + b, 0), w))] for a in range(-radius, radius + 1) for b in range(-radius, radius + 1) if (min(max(y + a, 0), h), min(max(x + b, 0), w)) in at]
        out.append(max(set(seen), key=lambda c: (seen.count(c), c == own, -c)))
    return out


def prototypes(space, labels):
    """{mode: [mean, dispersion, count]} with the floor."""
    out = {}
    for m in sorted(set(labels)):
        x = space[[k for k, c in enumerate(labels) if c == m]]
        out[m] = [x.mean(0), math.sqrt(x.var(0).sum()), len(x)]
    good = [s for _, s, n in out.values() if s > 1e-6 and n >= 5]
    floor = float(np.percentile(good, 25)) if good else 1e-3
    for m in out:
        out[m][1] = max(out[m][1], floor)
    return out


def consolidate(modes, tau, k=30, beta=0.0):
    """{mode: group named by its smallest mode}."""
    modes = {m: list(x) for m, x in modes.items()}
    group = {m: m for m in modes}
    while tau > 0 and len(modes) > 1:
        mid = max(float(np.median([x[2] for x in modes.values()])), 1.0)
        s = {m: x[1] if beta == 0 else x[1] / max(x[2] / mid, 1e-8) ** beta for m, x in modes.items()}
        best = {}
        for a in modes:
            raw = sorted((float(np.linalg.norm(modes[a][0] - modes[b][0])), b) for b in modes if b != a)[:k]
            best[a] = min((r / max(math.sqrt((s[a] ** 2 + s[b] ** 2) / 2), 1e-8), r, b) for r, b in raw)
        pairs = [(a, best[a][2]) for a in modes if a < best[a][2] and best[best[a][2]][2] == a and best[a][0] <= tau]
        if not pairs:
            break
        for a, b in pairs:
            (u, x, n), (v, y, m) = modes[a], modes.pop(b)
            mean = (n * u + m * v) / (n + m)
            modes[a] = [mean, math.sqrt((n * (x * x + ((u - mean) ** 2).sum()) + m * (y * y + ((v - mean) ** 2).sum())) / (n + m)), n + m]
            group = {k: a if g == b else g for k, g in group.items()}
    return group


def ari(a, b):
    two = lambda n: n * (n - 1) / 2
    count = lambda x: [list(x).count(c) for c in set(x)]
    x, y, z = (sum(map(two, count(c))) for c in (list(zip(a, b, strict=True)), a, b))
    e, m = y * z / two(len(a)), (y + z) / 2
    return 1.0 if m == e else (x - e) / (m - e)


def statistics(labels):
    n = len(labels)
    share = [list(labels).count(c) / n for c in set(labels)]
    return len(share), max(share), 0.0 if len(share) < 2 else -sum(p * math.log(p) for p in share) / math.log(len(share))


def discover(v, yx, *, components_=None, k, radius, least, rounds, space_components, neighbours, fine_radius, filter_radius, tau, beta):
    """(fine, final) labels of the whole chain."""
    z = zscore(v)
    e = graph(scores(z, components_) if components_ else z, yx, k, radius, least)
    space = scores(diffuse(z, weights(z, yx, e), rounds), space_components, True)
    fine = majority(fine_modes(space, neighbours, fine_radius), yx, filter_radius)
    group = consolidate(prototypes(space, fine), tau, 30, beta)
    return fine, [group[m] for m in fine]


def local_endpoint(curve, fine):
    """The index chosen among (labels by tau): eligible, in a run of two, fewest clusters, then stability, then tau; or None."""
    near = [None] + [ari(a, b) for a, b in itertools.pairwise(curve)] + [None]
    ok, told = [], []
    for t, labels in enumerate(curve):
        n, largest, entropy = statistics(labels)
        stability = max(x for x in (near[t], near[t + 1]) if x is not None)
        told.append((n, stability))
        ok.append(largest <= 0.40 and entropy >= 0.35 and 1 - n / fine >= 0.20 and stability >= 0.95)
    inside = [t for t in range(len(ok)) if ok[t] and ((t and ok[t - 1]) or (t + 1 < len(ok) and ok[t + 1]))]
    return min(inside, key=lambda t: (told[t][0], -told[t][1], t), default=None), told


def same_partition(a, b):
    return len(set(zip(a, b, strict=True))) == len(set(a)) == len(set(b))


def condense(edges: list[tuple[int, int, float]], ids: list[int], min_size: int = 5) -> dict[int, int]:
    """Clusters of a spanning tree by excess of mass: id -> label, noise -1. Edge by edge."""
    order = sorted(edges, key=lambda e: (e[2], e[0], e[1]))
    up = {i: i for i in ids}
    node: dict[int, int] = {i: k for k, i in enumerate(ids)}  # root -> dendrogram node
    kids: dict[int, tuple[int, int, float]] = {}
    size = {k: 1 for k in range(len(ids))}

    def find(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    nxt = len(ids)
    for a, b, d in order:
        a, b = find(a), find(b)
        if a == b:
            continue
        kids[nxt] = (node[a], node[b], d)
        size[nxt] = size[node[a]] + size[node[b]]
        up[b] = a
        node[a] = nxt
        nxt += 1

    def leaves(top: int) -> list[int]:
        stack, out = [top], []
        while stack:
            x = stack.pop()
            if x in kids:
                stack += kids[x][:2]
            else:
                out.append(x)
        return out

    clusters: list[dict] = []
    roots = sorted({find(i) for i in ids})
    stack = [(node[r], None, 0.0) for r in roots if size[node[r]] >= min_size]
    while stack:
        top, parent, born = stack.pop()
        me = len(clusters)
        clusters.append({"top": top, "parent": parent, "mass": 0.0, "kids": []})
        if parent is not None:
            clusters[parent]["kids"].append(me)
        x = top
        while x in kids:
            a, b, d = kids[x]
            lam = 1 / max(d, 1e-12)
            big = [c for c in (a, b) if size[c] >= min_size]
            if len(big) == 2:
                clusters[me]["mass"] += size[x] * (lam - born)
                stack += [(c, me, lam) for c in big]
                break
            clusters[me]["mass"] += (size[x] - sum(size[c] for c in big)) * (lam - born)
            if not big:
                break
            x = big[0]
    chosen = [True] * len(clusters)
    for me in range(len(clusters) - 1, -1, -1):
        c = clusters[me]
        below = sum(clusters[x]["mass"] for x in c["kids"])
        if c["kids"] and (below > c["mass"] or c["parent"] is None):
            chosen[me], c["mass"] = False, max(below, c["mass"])
        elif c["kids"]:
            stack2 = list(c["kids"])
            while stack2:
                x = stack2.pop()
                chosen[x] = False
                stack2 += clusters[x]["kids"]
    out, k = dict.fromkeys(ids, -1), 0
    for me, c in enumerate(clusters):
        if chosen[me] and (c["parent"] is not None):
            for leaf in leaves(c["top"]):
                out[ids[leaf]] = k
            k += 1
    return out
