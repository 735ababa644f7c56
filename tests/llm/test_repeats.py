"""op5 and op9 against brute force, with hot groups forced through every splitting step."""

import hashlib
import random
from collections import defaultdict
from dataclasses import replace

import pytest

from graphloom.llm import repeats, run_length_index, suffix_automaton

SCHEMA = "doc_id long, text string, lang string, rk string, spans string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "x", "y") for i, t in rows], SCHEMA)


def brute_bytes(rows, length):
    raw = [(i, (t or "").encode()) for i, t in rows]
    seen = defaultdict(int)
    for _, b in raw:
        for s in range(len(b) - length + 1):
            seen[b[s : s + length]] += 1
    out = []
    for i, b in raw:
        gone = [False] * len(b)
        for s in range(len(b) - length + 1):
            if seen[b[s : s + length]] > 1:
                gone[s : s + length] = [True] * length
        rest = bytes(x for x, g in zip(b, gone) if not g)
        runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), runs, hashlib.sha256(rest).hexdigest()))
    return sorted(out, key=str)


def brute_words(rows, length):
    docs = [(i, (t or "").encode().split()) for i, t in rows]
    order = lambda i: float("inf") if i is None else i
    least = {}
    for i, w in docs:
        for s in range(len(w) - length + 1):
            key = tuple(w[s : s + length])
            least[key] = min(least.get(key, float("inf")), order(i))
    out = []
    for i, w in docs:
        gone = [False] * len(w)
        for s in range(len(w) - length + 1):
            if least[tuple(w[s : s + length])] < order(i):
                gone[s : s + length] = [True] * length
        rest = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(rest).hexdigest()))
    return sorted(out, key=str)


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abé") for _ in range(r.randint(1, 4)))
    passage = [" ".join(word() for _ in range(r.randint(20, 60))) for _ in range(4)]
    line = "the very common line\n" * 12
    rows = []
    for i in range(60):
        body = [" ".join(word() for _ in range(r.randint(0, 30)))]
        for _ in range(r.randint(0, 3)):
            p = r.choice(passage)
            a = r.randint(0, len(p) // 2)
            body += [p[a : a + r.randint(20, len(p))], " ".join(word() for _ in range(r.randint(1, 9)))]
        if i % 7 == 0:
            body.append(line[: r.randint(10, len(line))])
        rows.append((i, r.choice([" ", "  ", "\n"]).join(body)))
    rows += [(100 + k, rows[3][1]) for k in range(5)] + [(200, None), (201, ""), (202, "a"), (203, " \t\n"), (204, "a" * 300), (205, "ab " * 200)]
    rows += [(None, rows[5][1]), (None, rows[6][1]), rows[9], rows[9], (8, "another text under an id that is taken " * 2)]
    return rows


def got(df):
    return sorted((tuple(x) for x in df.collect()), key=str)


@pytest.mark.parametrize("most", [2000, 3])
def test_bytes(spark, monkeypatch, most):
    rows = corpus(1)
    monkeypatch.setattr(run_length_index, "BYTES", replace(repeats.BYTES, most=most, shard=4000))
    for length in (40, 120):
        out = run_length_index.remove_repeats(frame(spark, rows), length, kept=False)
        assert got(out) == brute_bytes(rows, length)


@pytest.mark.parametrize("most", [2000, 2])
def test_words(spark, monkeypatch, most):
    rows = corpus(2)
    monkeypatch.setattr(suffix_automaton, "WORDS", replace(repeats.WORDS, most=most, shard=500))
    out = suffix_automaton.remove_copied_spans(frame(spark, rows), 13, kept=False)
    assert got(out) == brute_words(rows, 13)


def test_kept_text(spark):
    rows = [(1, "x" * 50 + "tail"), (2, "x" * 50 + "end é"), (3, "alone")]
    out = {r.doc_id: bytes(r.kept) for r in run_length_index.remove_repeats(frame(spark, rows), 40).collect()}
    assert out[3] == b"alone" and out[1] == b"tail" and out[2] == "end é".encode()
    w = " ".join(f"w{i}" for i in range(15))
    out = {r.doc_id: r.kept for r in suffix_automaton.remove_copied_spans(frame(spark, [(1, w), (2, "a " + w + " b")])).collect()}
    assert out == {1: w, 2: "a b"}


def test_empty_table(spark):
    for f in (run_length_index.remove_repeats, suffix_automaton.remove_copied_spans):
        assert f(frame(spark, [])).count() == 0


def test_index_against_all_pairs():
    r = random.Random(5)
    strings = [bytes(r.choice(b"ab") for _ in range(r.randint(0, 30))) for _ in range(12)] + [b"", b"abab" * 6]
    index = run_length_index.RunLengthIndex(strings)
    places = [(k, s) for k, x in enumerate(strings) for s in range(len(x))]
    stats = index.statistics()
    for k, s in places:
        best = 0
        for q, t in places:
            if (q, t) != (k, s):
                n = 0
                while s + n < len(strings[k]) and t + n < len(strings[q]) and strings[k][s + n] == strings[q][t + n]:
                    n += 1
                best = max(best, n)
        assert stats[index.begin[k] + s] == best
    assert index.runs <= len(stats)
    assert index.text() == b" ".join(strings) + b" " * bool(strings)
    for size in (1, 2, 3, 5):
        for pattern in {x[k : k + size] for x in strings for k in range(len(x))} | {b"~", b"zz"}:
            assert index.count(pattern) == sum(x[k : k + len(pattern)] == pattern for x in strings for k in range(len(x)))


def test_runs_are_few_in_repetitive_text():
    """A base and copies with one byte changed: the index grows with the changes, not with the copies."""
    r = random.Random(1)
    base = bytes(r.choice(b"acgt") for _ in range(2000))
    copies = [base[:k] + b"x" + base[k + 1 :] for k in (r.randrange(2000) for _ in range(40))]
    one, all_ = run_length_index.RunLengthIndex([base]), run_length_index.RunLengthIndex([base, *copies])
    assert all_.runs < 2 * one.runs and all_.count(base[100:130]) >= 30


def test_stage_keeps_clean_documents(spark):
    rows = [(1, "x" * 500), (2, "x" * 500), (3, "clean é"), (4, ""), (5, None), (6, "y" * 100 + "z" * 450), (7, "z" * 450)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = {r.doc_id: r for r in run_length_index.stage(spark, docs, "").collect()}
    assert set(out) == {3, 4, 5, 6}
    assert out[6].text == "y" * 100 and out[6].n_chars == 100 and out[3].text == "clean é" and out[5].text is None
