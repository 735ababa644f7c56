"""The stages, one by one on their own input, against brute-force versions of the same rules."""

import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from graphloom.llm import toxicity

from .test_minhash import brute as near_groups
from .test_positional_index import brute as contaminated
from .test_repeats import brute_bytes

KIND = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    r = random.Random(9)
    vocabulary = ["".join(r.choice("abcdeghilmnoprst") for _ in range(r.randint(2, 8))) for _ in range(800)]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [(k, text(20)) for k in range(5)]
    passage = text(80)
    docs, labels = [], []
    for i in range(240):
        words = text(r.randint(30, 200)).split()
        toxic = int(i % 6 == 0)
        for _ in range(4 * toxic):
            words[r.randrange(len(words))] = r.choice(["idiot", "moron", "scum"])
        body = " ".join(words)
        if i % 20 == 3:
            body += " " + passage
        if i % 40 == 5:
            body = body[:200] + " " + items[i % 5][1]
        docs.append((i, body))
        labels.append((i, toxic))
    docs += [(500, docs[1][1]), (501, docs[2][1] + " more"), (502, docs[1][1]), (503, None), (504, ""), (505, "short"), (506, "é " * 700)]
    return docs, labels, items


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    where = str(tmp_path_factory.mktemp("sf"))
    docs, labels, items = corpus()
    spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in docs], KIND).repartition(3).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([(i, t, 1) for i, t in labels], "doc_id long, toxic int, quality int").write.parquet(f"{where}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    return where


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    items = [tuple(x) for x in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    before = {r.doc_id: r for r in docs.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        rows = [(i, r.text) for i, r in before.items()]
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        if name == "packing":
            tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
            want = {i: len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in rows}
            got = {}
            for r in out.collect():
                got[r.doc_id] = got.get(r.doc_id, 0) + r.length
            assert got == want
            continue
        assert out.columns == columns
        after = {r.doc_id: r for r in out.collect()}
        if name == "toxicity":
            predicted = {r.doc_id: r.predicted for r in toxicity.score(docs, spark.read.parquet(f"{folder}/labels.parquet")).collect()}
            assert set(after) == {i for i, p in predicted.items() if not p}
            assert 10 < len(before) - len(after) < 60
        elif name == "minhash_near_dedup":
            assert set(after) == {i for i, _, c, _ in near_groups(rows, 5, 80) if i == c} and not {500, 501, 502} & set(after)
        elif name == "suffix_array_dedup":
            want = {i: (n, removed, digest) for i, n, removed, _, digest in brute_bytes(rows, 400)}
            assert any(0 < removed < n for n, removed, _ in want.values())
            for i, (n, removed, digest) in want.items():
                if n and n == removed:
                    assert i not in after
                elif hashlib.sha256((after[i].text or "").encode()).hexdigest() != digest:
                    raw = before[i].text.encode()
                    assert removed and any(b >= 128 for b in raw)  # a cut within a character
                if i in after:
                    assert after[i].n_chars == len(after[i].text or "")
        else:
            assert set(after) == {x[0] for x in contaminated(rows, items) if not x[-1]} and len(after) < len(before)
        for i, r in after.items():
            assert (r.lang, r.source) == (before[i].lang, before[i].source)
        docs, before = out, after


def test_run_is_its_stages(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert out.count() > 0
