"""op2 against brute force."""

import hashlib
import random
import re

import pytest

from graphloom.llm import positional_index as p

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items, length=13):
    windows = set()
    for item, text in items:
        w = words(text)
        if item is None or not w:
            continue
        m = min(length, len(w))
        windows |= {(tuple(w[s : s + m]), item) for s in range(len(w) - m + 1)}
    out = []
    for i, text in docs:
        w, hit, own = words(text), set(), set()
        for window, item in windows:
            m = len(window)
            for s in range(len(w) - m + 1):
                if tuple(w[s : s + m]) == window:
                    hit |= set(range(s, s + m))
                    own.add(item)
        names = ",".join(sorted(map(str, own)))
        out.append((i, len(w), len(hit), len(own), hashlib.sha256(names.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def tables_(spark, docs, items):
    return (
        spark.createDataFrame([(i, t, 1, "z") for i, t in docs], "doc_id long, text string, rk int, hits string"),
        spark.createDataFrame([(i, t, 2) for i, t in items], "item_id long, text string, doc_id int"),
    )


@pytest.mark.parametrize("block", [p.BLOCK, 60])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(p, "BLOCK", block)
    r = random.Random(3)
    vocabulary = ["the", "of", "an", "Été", "x1", "ẞb", "zu", "K"]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [(k, text(r.randint(1, 30))) for k in range(12)] + [(20, None), (21, ""), (22, "..."), (None, "the of"), (3, text(14)), (11, "the of"), (2, "rare words here")]
    docs = [(i, text(r.randint(0, 60)) + ". " + r.choice(items[:12])[1].upper().replace(" ", ", ") + " " + text(r.randint(0, 200))) for i in range(40)]
    docs += [(50, None), (51, ""), (52, "--"), (53, "the"), (None, items[0][1]), docs[3], docs[3], (3, "words rare here")]
    d, b = tables_(spark, docs, items)
    assert sorted((tuple(x) for x in p.decontaminate(d, b).collect()), key=str) == brute(docs, items)


def test_empty(spark):
    d, b = tables_(spark, [], [])
    assert p.decontaminate(d, b).count() == 0
    d, b = tables_(spark, [(1, "a b c")], [])
    assert [tuple(x)[:4] for x in p.decontaminate(d, b).collect()] == [(1, 3, 0, 0)]


def test_proximity(spark):
    d, _ = tables_(spark, [(1, "alpha one two beta"), (2, "alpha " + "x " * 20 + "beta"), (3, "beta"), (4, "alpha")], [])
    index = p.build_index(d)
    assert {(r.doc_id, tuple(r.places)) for r in p.proximity(index, ["alpha", "beta"], 5).collect()} in ({(1, (0,))}, {(1, (3,))})


@pytest.mark.parametrize("block", [p.BLOCK, 3])
def test_stage(spark, monkeypatch, block):
    import tempfile

    monkeypatch.setattr(p, "BLOCK", block)

    folder = tempfile.mkdtemp()
    d, b = tables_(spark, [(1, "a b c d"), (2, "e f g"), (None, "q"), (4, None), (5, "m n")], [(1, "a b c d"), (2, "z z"), (3, "m n")])
    b.write.parquet(f"{folder}/benchmark.parquet")
    out = p.stage(spark, d, folder)
    assert out.columns == d.columns
    assert sorted(str(r.doc_id) for r in out.collect()) == ["2", "4", "None"]
