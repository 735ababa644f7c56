"""op6 against brute force for the base columns, and on planted notices for the method's own."""

import random
import re

from graphloom.llm import licences

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute(rows):
    out = []
    for i, t in rows:
        w, places, labels = words(t), [], set()
        for phrase, label in licences.BASE.items():
            p = phrase.split()
            for s in range(len(w) - len(p) + 1):
                if w[s : s + len(p)] == p:
                    places.append(s)
                    labels.add(label)
        out.append((i, len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    r = random.Random(1)
    pieces = ["GNU General Public License", "gnu general", "public license", "Apache License,", "the apache", "CC BY-NC", "cc\nby", "mit", "License", "MIT-License", "été", "of the", "İ", "word"]
    rows = [(i, " ".join(r.choice(pieces) for _ in range(r.randint(0, 60)))) for i in range(80)]
    rows += [(100, None), (101, ""), (102, "-,."), (103, "cc"), (None, "MIT license"), rows[0], rows[0], (1, "another apache license"), (104, "cc by " * 30_000)]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n_words int, rk string").repartition(3)
    out = licences.scan(docs)
    assert sorted((tuple(x) for x in out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").collect()), key=str) == brute(rows)
    for r in out.collect():
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
        assert 0 <= r.score <= 1 and (r.n_base == 0 or r.score == 1)


def test_own_labels(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
    rows = [
        (1, f"x y z {mit} (the Software)"),
        (2, mit.replace("obtaining", "who is obtaining").replace("hereby ", "")),
        (3, "permission is granted to copy this software free of charge"),
        (4, "Licensed under the Apache License, Version 2.0."),
    ]
    out = {r.doc_id: r for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[1].labels == "mit-text" and out[1].score == 1.0 and out[1].n_base == 0 and out[1].first_word is None
    assert out[2].labels == "mit-text" and 0.8 <= out[2].score < 1
    assert out[3].labels == "" and out[3].score == 0
    assert out[4].labels == "apache,apache-2.0-notice" and out[4].base_labels == "apache"


def test_plan_is_native_and_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    out = licences.scan(docs)
    assert out.count() == 0
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
