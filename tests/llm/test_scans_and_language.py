import random
import re
import zlib

from pyspark.sql import functions as F

from deltascope.llm import language, licenses
from deltascope.llm.queries import op8_license_scan, op9_language_id

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def brute(text):
    words = WORDS.findall((text or "").encode().lower().decode())
    places = [(i, label) for i in range(len(words)) for p, label in PHRASES.items() if words[i:i + len(p.split())] == p.split()]
    starts = [p[0] for p in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({p[1] for p in places}))


LICENSED = [
    (1, None), (2, ""), (3, "Released under the MIT License."), (4, "CC-BY-NC, cc by nc CC BY NC"), (5, "Licensed under the Apache License, Version 2.0; under the mit license"),
    (6, "apache license version 20"), (7, "All rights reserved."), (8, "déjà vu under the mit licensé"), (9, "under the mit license " * 500),
    (10, "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    (11, "the general public license of gnu"), (3, "Released under the MIT License."), (12, "nothing " * 20000 + "cc by nc"),
]


def test_base_phrases_agree_with_brute_force(spark, make, tmp_path):
    make(LICENSED, extra=True).write.parquet(str(tmp_path / "documents.parquet"))
    rows = op8_license_scan(spark, str(tmp_path)).collect()
    assert len(rows) == len(LICENSED)
    texts = dict(LICENSED)
    for r in rows:
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute(texts[r["doc_id"]]), r
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    labels = {r["doc_id"]: r["labels"] for r in rows}
    assert labels[7] == "reserved" and labels[10] == "gpl" and labels[11] == "" and labels[1] == ""


def test_templates_are_found_with_small_changes(make):
    text = "Permission is hereby granted, free of charge, to any person who is obtaining a copy of this software and its documentation files"
    found = licenses.scan_licenses(make([(1, "intro " * 9 + text)])).first()["found"]
    assert [f["label"] for f in found] == ["mit"] and 0.6 <= found[0]["score"] < 1 and found[0]["first"] == 9
    assert licenses.scan_licenses(make([])).count() == 0


def rarest_anchors_are_rare():
    index = licenses.Index(100, {b"the": 100, b"under": 90, b"license": 50, b"mit": 2})
    assert b"mit" in index.filed and b"the" not in index.filed


def test_phrases_are_filed_under_rare_words():
    rarest_anchors_are_rare()


SYLLABLES = {"en": "the and tion ing er ou th wh", "de": "der und ung sch ich ein ß ü", "fr": "le eau é è oi ment que ai"}


def written(lang, rng, n=60):
    return " ".join("".join(rng.choice(SYLLABLES[lang].split()) for _ in range(rng.randint(1, 3))) for _ in range(n))


def test_language_of_held_out_documents(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, written(lang := rng.choice(list(SYLLABLES)), rng), lang) for i in range(240)]
    rows += [(900, None, "en"), (901, "", "de"), (902, "123 !! \n", None), (903, written("de", rng), None), (904, written("fr", rng, 30000), "fr"), (5, rows[5][1], rows[5][2]), (None, "the ing", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash")).withColumn("_p", F.lit(1))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = op9_language_id(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    truth, right = {r[0]: r[2] for r in rows}, []
    for r in got:
        assert 0 <= r["score"] <= 1
        if r["doc_id"] is None:
            continue
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        if r["doc_id"] in (900, 901, 902):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        elif r["held_out"]:
            right.append(r["lang_pred"] == (truth[r["doc_id"]] or "de"))
    assert len(right) > 50 and sum(right) / len(right) >= 0.95


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "text", None), (2, None, "en")], "doc_id long, text string, lang string")
    model = language.train(docs)
    assert {(r["lang_pred"], r["score"]) for r in language.identify(docs, model).collect()} == {("und", 0.0)}
    assert language.identify(docs.limit(0), model).count() == 0


def test_sample_is_bounded_whatever_ids_repeat(spark, monkeypatch):
    fitted = []
    monkeypatch.setattr(language, "fit", lambda found, labels, languages, idf: fitted.append(len(labels)))
    own = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 3 != 1)
    rows = [(own, f"the house of number {k} and more", "en") for k in range(900)] + [(own, f"das haus nummer {k} und mehr", "de") for k in range(30)]
    rows += [(i, "una casa y más", "es") for i in range(60)] + [(own, "una casa y más", "es")] * 200
    language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), per_language=50)
    assert fitted and fitted[0] <= 150
