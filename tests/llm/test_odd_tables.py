"""Every operator and stage on nulls, odd texts, repeated rows, clashing columns, and empty tables."""

import public_tokenizers
import pytest

import corpus_pipeline
from graphloom.llm import licences, masked_lm, minhash, packing, positional_index, run_length_index, suffix_automaton, toxicity

CLASHING = ["rk", "spans", "kept", "score", "hits", "items", "sid", "a", "b", "n", "words", "length", "rank", "low", "anchor", "seg", "fold", "toxic", "item_id", "n_words"]
KIND = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING)
TEXTS = [None, "", " ", "\n\t", "a", "é", "\x00", "one two three four five six", "x" * 60_000, "w " * 9_000, "Licensed under the MIT License.", "日本語 " * 300, "é \U0001f600"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(None, TEXTS[7]), (None, None), (3, TEXTS[8]), (8, TEXTS[8]), (8, TEXTS[8]), (-5, "minus"), (2**62, "large")]
    return spark.createDataFrame([(i, t, None, None, None, *["c"] * len(CLASHING)) for i, t in rows], KIND).repartition(3)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    where = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame([(0, 1, None), (None, 1, 1), (7, None, 0), (8, 0, 1), (8, 1, 0)], "doc_id long, toxic int, quality int").write.parquet(f"{where}/labels.parquet")
    spark.createDataFrame([(1, None), (None, "one two"), (2, ""), (3, "zzz yyy")], "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    return where


OPERATORS = {
    "toxicity": lambda d, s, f: toxicity.score(d, s.read.parquet(f"{f}/labels.parquet")),
    "decontamination": lambda d, s, f: positional_index.decontaminate(d, s.read.parquet(f"{f}/benchmark.parquet")),
    "minhash": lambda d, s, f: minhash.near_duplicates(d),
    "lm": lambda d, s, f: masked_lm.pseudo_likelihood(d),
    "automaton": lambda d, s, f: suffix_automaton.remove_copied_spans(d),
    "licences": lambda d, s, f: licences.scan(d),
    "index": lambda d, s, f: run_length_index.remove_repeats(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_per_row(spark, odd, folder, name):
    out = OPERATORS[name](odd, spark, folder)
    assert sorted(str(r.doc_id) for r in out.select("doc_id").collect()) == sorted(str(r.doc_id) for r in odd.collect())
    assert OPERATORS[name](odd.limit(0), spark, folder).count() == 0


def test_packing_covers_every_row(spark, odd):
    out = packing.pack(odd, public_tokenizers.path("word_bpe_49k.json")).collect()
    assert sum(r.start == 0 for r in out) == odd.count()


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages(spark, odd, folder, name, stage):
    out = stage(spark, odd, folder)
    if name != "packing":
        assert out.schema.simpleString() == odd.schema.simpleString()
        ids = {r.doc_id for r in out.collect()}
        assert {0, 1, 4, -5, 2**62} <= ids  # clean documents stay
    else:
        assert out.count() >= odd.count()
    empty = stage(spark, odd.limit(0), folder)
    assert empty.count() == 0
