"""Rules that depend on order against plain loops over whole tables, contig by contig."""

from collections import defaultdict

import pytest

from readlake.plans import registry
from readlake.sources.views import view

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def by_contig(spark):
    def of(name, *cols):
        rows = defaultdict(list)
        for r in view(spark, SF, name).select("contig", *cols).collect():
            rows[r.contig].append(tuple(r)[1:])
        return {c: sorted(v) for c, v in rows.items()}

    return of


def test_drop_overlaps(spark, by_contig):
    want = []
    for c, rows in by_contig("bed_a", "start_pos", "end_pos", "qual").items():
        alive = [True] * len(rows)
        for i, (s, _, q) in enumerate(rows):
            for j in range(i):
                if alive[i] and alive[j] and rows[j][1] > s:
                    alive[j if rows[j][2] < q else i] = False
        want += [(c, *r) for r, a in zip(rows, alive, strict=True) if a]
    assert sorted(tuple(r) for r in registry.QUERIES["win_08_drop_overlaps"](spark, SF).collect()) == sorted(want)


def test_cluster_signals(spark, by_contig):
    signals = {}
    for c, rows in by_contig("reads", "ref_start", "tlen", "flag", "mapq", "qname").items():
        signals[c] = sorted((p, t if f & 16 else -t, q if m > 55 else -1) for p, t, f, m, q in rows)
    want = []
    for c, queue in signals.items():
        clusters = []
        while queue:
            members, deferred = [queue.pop(0)], []
            while queue:
                x = queue.pop(0)
                if x[0] - members[-1][0] > 200:
                    queue.insert(0, x)
                    break
                a, b = abs(x[1]), abs(members[-1][1])
                (members if (x[1] > 0) == (members[-1][1] > 0) and min(a, b) / max(a, b) > 0.7 else deferred).append(x)
            queue = deferred + queue
            clusters.append(members)
        taken = set()
        for m in sorted(clusters, key=lambda m: (-len(m), m[0][0], m[len(m) // 2][0], sorted(x[1] for x in m)[len(m) // 2])):
            own = {x[2] for x in m} - {-1}
            want.append((c, m[len(m) // 2][0], sorted(x[1] for x in m)[len(m) // 2], len(m), len(own & taken)))
            taken |= own
    got = sorted((r.contig, r.pos, r["size"], r.support) for r in registry.QUERIES["set_04_cluster_signals"](spark, SF).collect())
    assert got == sorted((c, p, s, n - lost) for c, p, s, n, lost in want)


def test_pack_rows(spark, by_contig):
    want = []
    for c, rows in by_contig("reads", "ref_start", "ref_end").items():
        ends = []
        for s, e in rows:
            free = [i for i, x in enumerate(ends) if x <= s]
            if free:
                ends[free[0]] = e
                want.append((c, s, e, free[0]))
            elif len(ends) < 100:
                ends.append(e)
                want.append((c, s, e, len(ends) - 1))
            else:
                want.append((c, s, e, -1))
    assert sorted(tuple(r) for r in registry.QUERIES["prj_30_packed_rows"](spark, SF).collect()) == sorted(want)


def test_segments(spark):
    rows = defaultdict(list)
    for r in view(spark, SF, "score_windows").collect():
        rows[r.chr].append((r.position, r.score))

    def cut(values, window=200):
        n, order = len(values), sorted(values)
        first, times = {}, defaultdict(int)
        for i, v in enumerate(order):
            first.setdefault(v, i)
            times[v] += 1
        rank = [first[v] + (times[v] + 1) / 2 for v in values]
        unit = (n + 1 - sum((t - 1) * t * (t + 1) for t in times.values()) / n / (n - 1)) / 12
        best = (0.0, 0, 0)
        for size in range(1, min(window, n - 1) + 1):
            total = sum(rank[:size])
            for i in range(n - size + 1):
                z = abs(total - size * (n + 1) / 2) / (size * (n - size) * unit) ** 0.5
                if z > best[0] + 1e-12:
                    best = (z, i, i + size)
                if i + size < n:
                    total += rank[i + size] - rank[i]
        return best

    want = []
    for c, v in rows.items():
        v.sort()
        todo = [v]
        while todo:
            part = todo.pop()
            z, i, j = cut([x[1] for x in part]) if len(part) >= 4 else (0.0, 0, 0)
            if z > 3.891:
                todo += [x for x in (part[:i], part[i:j], part[j:]) if x]
            else:
                want.append((c, part[0][0], part[-1][0], len(part)))
    got = sorted((r.contig, r["first"], r["last"], r.n) for r in registry.QUERIES["win_10_segments"](spark, SF).collect())
    assert got == sorted(want)
