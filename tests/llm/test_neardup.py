import random
import re

import numpy as np

from paperloom.llm.neardup import NearDupOptions, _differ, _meet, _most_differ, _Sketcher, row_groups, row_pairs

O3 = NearDupOptions(shingle=3, similarity=0.6, min_words=20, groups=12)


def texts(seed=1, base=40, copies=6):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    out = []
    for _ in range(base):
        ws = [r.choice(vocabulary) for _ in range(r.randint(15, 120))]
        out.append(" ".join(ws))
        for _ in range(r.randint(0, copies)):
            e = ws[:]
            for _ in range(r.randint(0, max(1, len(ws) // 9))):
                k = r.randrange(len(e))
                e[k : k + 1] = r.choice(([], [r.choice(vocabulary)], [e[k], r.choice(vocabulary)]))
            out.append(" ".join(e))
    return out


def brute(rows, o):
    sh = {}
    for k, t, a in rows:
        ws = re.findall(r"\w+", f"{t or ''} {a or ''}".lower())
        if len(ws) >= max(o.min_words, o.shingle):
            sh[k] = {tuple(ws[i : i + o.shingle]) for i in range(len(ws) - o.shingle + 1)}
    ks = sorted(sh)
    return {(a, b) for i, a in enumerate(ks) for b in ks[i + 1 :] if len(sh[a] & sh[b]) / len(sh[a] | sh[b]) >= o.similarity}


def frame(spark, rows):
    return spark.createDataFrame([(k, t, a, 1, "x") for k, t, a in rows], "k bigint, title string, abstract string, class int, t0 string")


def test_pairs_equal_brute_force(spark):
    ts = texts()
    rows = [(i, t[:9], t) for i, t in enumerate(ts)] + [(10_000 + i, ts[0][:9], ts[0]) for i in range(5)] + [(20_000, None, ts[3]), (20_001, ts[3], None), (20_002, None, None), (20_003, "", ""), (20_004, "short", "text")]
    rows += [(30_000, "", "long " + "alpha beta gamma delta " * 20_000), (30_001, "", "Long " + "alpha beta gamma delta " * 20_001)]
    got = {(r.a, r.b) for r in row_pairs(frame(spark, rows), "k", ["title", "abstract"], O3).collect()}
    true = brute(rows, O3)
    assert got <= true and len(true - got) <= 0.01 * len(true) and len(true) > 100
    assert (30_000, 30_001) in got


def test_groups(spark):
    ts = texts(2, 10, 3)
    rows = [(i, "", t) for i, t in enumerate(ts)] + [(1000 + i, "", ts[0]) for i in range(40)]
    o = NearDupOptions()
    got = {r.k: r for r in row_groups(frame(spark, rows), "k", ["title", "abstract"], o).collect()}
    pairs = brute(rows, o)
    assert set(got) == {k for k, _, _ in rows}
    assert got[1000].group == got[0].group == 0 and got[0].copies == ts.count(ts[0]) + 40
    assert all(got[a].group == got[b].group for a, b in pairs)
    alone = [k for k in got if not any(k in p for p in pairs)]
    assert all(got[k].group == k and got[k].links == 0 and got[k].copies == 1 for k in alone)


def test_empty(spark):
    assert row_pairs(frame(spark, []), "k", ["title"], O3).count() == 0
    assert row_groups(frame(spark, []), "k", ["title"]).count() == 0


def test_signatures_follow_similarity():
    s = _Sketcher(O3)
    base = [f"w{i}" for i in range(100)]
    _, sig = s([base, base, base[:50] + [f"x{i}" for i in range(50)], [f"y{i}" for i in range(100)]])
    d = [int(_differ(sig[0], sig[k])) for k in range(4)]
    assert d[0] == d[1] == 0 < d[2] < d[3] and d[3] > _most_differ(0.6, 3.5) > 19


def test_a_crowd_in_one_variant_loses_nothing():
    n = 200
    keys, sig = np.arange(n), np.zeros((n, 2), np.uint64)
    blob = [__import__("paperloom.llm.neardup", fromlist=["x"])._blob(keys, sig, np.zeros(n, np.uint32), np.arange(n))]
    assert len(_meet(blob, 0, 1_000)[0]) == n * (n - 1) // 2
    pairs, crowds = _meet(blob, 0, 100)
    assert not len(pairs) and [(v, c.tolist()) for v, c, _ in crowds] == [(0, list(range(n)))]


def test_crowds_are_paired_outside_the_task(spark):
    """Texts of one template, all alike: every pair comes out, whether or not a task pairs the crowd itself."""
    r = random.Random(5)
    base = [f"word{i}" for i in range(60)]
    rows = [(i, " ".join(base[:50] + [f"own{i}x{j}" for j in range(r.randint(0, 3))]), None) for i in range(60)] + [(100, " ".join(base[10:]), None)]
    whole = {tuple(x) for x in row_pairs(frame(spark, rows), "k", ["title", "abstract"], NearDupOptions(shingle=3, similarity=0.6, groups=12)).collect()}
    for o in (NearDupOptions(shingle=3, similarity=0.6, groups=12, crowd=7), NearDupOptions(shingle=3, similarity=0.6, groups=12, crowd=7, spread=None)):
        assert {tuple(x) for x in row_pairs(frame(spark, rows), "k", ["title", "abstract"], o).collect()} == whole
    assert len(whole) >= 60 * 59 // 2


def test_short_and_empty_rows_have_a_group(spark):
    rows = [(1, "On nets", None), (2, "On", "Nets!"), (3, "On graphs", ""), (4, None, None), (5, "", " "), (6, "", texts(3, 1, 0)[0])]
    got = {r.k: (r.group, r.copies, r.links) for r in row_groups(frame(spark, rows), "k", ["title", "abstract"]).collect()}
    assert got == {1: (1, 2, 0), 2: (1, 2, 0), 3: (3, 1, 0), 4: (4, 2, 0), 5: (4, 2, 0), 6: (6, 1, 0)}
