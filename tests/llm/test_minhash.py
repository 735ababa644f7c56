"""op3 against all pairs, with the hub rounds forced to go on."""

import random

import numpy as np
import pytest

from graphloom.llm import components, minhash, tables


def brute(rows, k, percent):
    sets = []
    for _, t in rows:
        w = tuple((t or "").encode().lower().split())
        sets.append({w[i : i + k] for i in range(len(w) - k + 1)} if len(w) >= k else {w} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    out = []
    for i, (d, _) in enumerate(rows):
        c = least.get(find(i)) if sets[i] else d
        out.append((d, len(sets[i]), c, d == c))
    return sorted(out, key=str)


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefé") for _ in range(r.randint(2, 6)))
    rows, n = [], 0
    for _ in range(12):  # families: each member differs from its base in a few places
        base = [word() for _ in range(r.randint(30, 120))]
        for _ in range(r.randint(1, 12)):
            own = list(base)
            for _ in range(r.randint(0, 6)):
                own[r.randrange(len(own))] = word()
            rows.append((n, r.choice([" ", "\n", " \t"]).join(own)))
            n += 1
    # a chain whose ends are not similar
    chain = [word() for _ in range(100)]
    for _ in range(15):
        at = r.randrange(96)
        chain = chain[:at] + [word(), word()] + chain[at + 2 :]
        rows.append((n, " ".join(chain)))
        n += 1
    r.shuffle(rows)
    rows += [(1000, None), (1001, ""), (1002, " \n"), (1003, "one"), (1004, "One"), (1005, "one two three"), (1006, "four words are here"), (1007, "four words are here ")]
    rows += [(None, rows[0][1]), (None, "alone without an id at all"), rows[1], rows[1], (rows[2][0], "other words under a taken id " + word())]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_pairs(spark, seed):
    rows = corpus(seed)
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, sid string, kept int").repartition(3)
    for k in (4, 5):
        out = minhash.near_duplicates(docs, words=k)
        assert sorted((tuple(x) for x in out.collect()), key=str) == brute(rows, k, 80)


def test_hub_rounds_reach_every_pair(spark, monkeypatch):
    """With hubs that link to nothing, all pairs must come from the later rounds."""
    rows = [(i, " ".join(f"w{j}" if j != 7 * i % 90 else f"x{i}" for j in range(100))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.component_id for r in minhash.near_duplicates(docs).collect()} == {0}


def test_components(spark):
    r = random.Random(6)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + k) for k in range(1, 40)] + [(r.randint(200, 240), r.randint(200, 240)) for _ in range(25)] + [(7, 7)]
    got = {x.node: x.root for x in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    root = {x: x for e in edges for x in e}
    for _ in range(200):
        for u, v in edges:
            root[u] = root[v] = min(root[u], root[v])
    assert got == {k: v for k, v in root.items() if k != v}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_own_stars_connect_what_edges_connect():
    r = np.random.default_rng(3)
    for n, m in ((2, 1), (50, 30), (400, 390), (3000, 3500)):
        u, v = r.integers(-n, n, (2, m))
        u, v = np.concatenate([u, np.arange(5 * n, 6 * n)]), np.concatenate([v, np.arange(5 * n, 6 * n) + 1])  # a long path, too
        root = {x: x for x in (*u.tolist(), *v.tolist())}
        moved = True
        while moved:
            moved = False
            for a, b in zip(u.tolist(), v.tolist(), strict=True):
                low = min(root[a], root[b])
                moved |= root[a] != low or root[b] != low
                root[a] = root[b] = low
        assert dict(zip(*(x.tolist() for x in components.stars(u, v)), strict=True)) == {k: low for k, low in root.items() if k != low}
    assert not len(components.stars(u[:0], v[:0])[0])


def test_few_edges_take_no_rounds(spark, monkeypatch):
    """What one task can hold is done at once, however long its paths; more edges alternate stars as before."""
    stored, keep = [], tables.keep
    monkeypatch.setattr(tables, "keep", lambda frame, name: stored.append(name) or keep(frame, name))
    r = random.Random(8)
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + k) for k in range(1, 60)] * 2
    r.shuffle(edges)
    frame = spark.createDataFrame(edges, "u long, v long").repartition(7)
    wanted = {i: 0 for i in range(1, 301)} | {1000 + k: 1000 for k in range(1, 60)}
    for bound, most in ((1 << 18, 2), (20, 99)):
        monkeypatch.setattr(components, "EDGES", bound)
        stored.clear()
        got = [(x.node, x.root) for x in components.components(frame).collect()]
        assert dict(got) == wanted and len(got) == len(wanted) and len(stored) <= most and ("least" in stored) == (bound == 20)


def test_empty_and_stage(spark):
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    assert minhash.near_duplicates(spark.createDataFrame([], kind)).count() == 0
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(3, text, "a", "b", 1), (2, text + " more", "a", "b", 2), (5, "", None, None, None), (6, None, "a", "b", 0)], kind)
    out = minhash.stage(spark, docs, "")
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == [2, 5, 6]


def test_blocks_and_parts(spark, monkeypatch):
    """Blocks and parts of few members give the same links."""
    for name, value in (("BLOCK", 600), ("LEAST", 10), ("PART", 200), ("MEMBERS", 2)):
        monkeypatch.setattr(minhash, name, value)
    rows = [(i, " ".join(f"w{j}" if j != 7 * i % 90 else f"x{i}" for j in range(100))) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.component_id for r in minhash.near_duplicates(docs).collect()} == {0}


def test_sets_that_share_half_a_hash(spark):
    kind = "rk long, doc_id long, n_shingles long, sid long, second long, a array<long>, b array<long>"
    rows = [(1, 1, 3, 7, 5, [1], [2]), (2, 2, 3, 7, 6, [3], [4]), (3, 3, 3, 7, 5, [1], [2]), (4, 4, 3, 8, 5, [1], [2]), (5, 5, 0, None, None, [], [])]
    sigs, reps = minhash._representatives(spark.createDataFrame(rows, kind))
    sid = {r.doc_id: r.sid for r in sigs.collect()}
    assert sid[1] == sid[3] != sid[2] and sid[4] == 8 and sid[5] is None and len(set(sid.values())) == 4
    assert sorted((r.sid, r.low, r.n) for r in reps.collect()) == sorted([(sid[1], 1, 3), (sid[2], 2, 3), (8, 4, 3)])
