"""op8: exact round trip of ids, gapless offsets, and the plan against exhaustive search."""

import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from graphloom.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def texts():
    r = random.Random(1)
    odd = ["don't STOP\x0bnow\x0c it's", "É́a ﬁ ΑΣ ΣΑΣ", "a<|endoftext|>b <|startoftext|>", " x y\x1cz\x85w", "12 345 ½ Ⅷ", "日本語 テキスト 🙂👍🏽", "İstanbul Straße", "'s 't", "", " ", None, "́ a"]
    return odd + [" ".join(r.choice(["alpha", "beta,", "Gamma!", "d3lta"]) for _ in range(r.choice([1, 5, 40, 700]))) for _ in range(50)]


def test_round_trip(spark, tokenizer):
    rows = list(enumerate(texts())) + [(None, "some text"), (7, "the id again"), (3, "twice"), (3, "twice")]
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, length int").repartition(3)
    for capacity in (64, 4096):
        out = packing.pack(docs, PATH, capacity).collect()
        want = {}
        for i, t in rows:
            ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
            for s in range(0, len(ids), capacity):
                part = np.array(ids[s : s + capacity], dtype="<u4")
                key = (i, s, len(part), zlib.crc32(part.tobytes()), len(ids))
                want[key] = want.get(key, 0) + 1
        got = {}
        for r in out:
            key = (r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens)
            got[key] = got.get(key, 0) + 1
        assert got == want
        by = {}
        for r in out:
            by.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert sorted(by) == list(range(len(by)))
        padding = 0
        for pieces in by.values():
            at = 0
            for offset, length in sorted(pieces):
                assert offset == at
                at += length
            assert at <= capacity
            padding += 0 if at & (at - 1) == 0 else capacity - at
        assert padding <= 2 * capacity


def test_fill_is_closest():
    r = random.Random(2)
    for _ in range(300):
        capacity = r.randint(5, 40)
        counts = {}
        for _ in range(r.randint(1, 7)):
            k = r.randint(1, capacity)
            counts[k] = counts.get(k, 0) + r.randint(1, 2)
        seed = max(counts)
        items = [k for k, n in counts.items() for _ in range(n - (k == seed))]
        sums = {sum(c) + seed for n in range(len(items) + 1) for c in itertools.combinations(items, n)}
        best = max(s for s in sums if s <= capacity)
        powers = [s for s in sums if s <= capacity and s & (s - 1) == 0]
        used = packing.fill(counts, seed, capacity)
        total = sum(k * n for k, n in used.items())
        assert all(n <= counts[k] for k, n in used.items())
        assert total == best if best == capacity or not powers else total == max(powers)


def test_plan_places_each_piece_once():
    r = random.Random(3)
    counts = {r.randint(1, 512): r.randint(1, 400) for _ in range(120)}
    table = packing.plan(counts, 512)
    seen = {}
    for length in counts:
        own = table[table[:, 0] == length]
        edges = own[:, 1].tolist() + [counts[length]]
        assert edges[0] == 0
        for row, (a, b) in zip(own, itertools.pairwise(edges)):
            assert (b - a) % row[2] == 0
            for t in range(b - a):
                seen.setdefault(row[3] + t // row[2], []).append((row[4] + t % row[2] * length, length))
    assert sorted(seen) == list(range(len(seen)))
    for pieces in seen.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 512
    total = sum(k * n for k, n in counts.items())
    assert len(seen) <= max(sum(n for k, n in counts.items() if k > 256), 1.01 * total / 512 + 4)


def test_empty(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
