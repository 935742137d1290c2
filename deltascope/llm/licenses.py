"""License scans with a positional index of rare words.

Templates and phrases are short texts with a label. One pass over all documents counts in
how many each licence word occurs. Every phrase is then filed under its rarest word, with
the word's position; of a document only its licence words that some phrase is filed under
are looked up. Each hit fixes where a phrase or a whole template would lie (position in the
document minus position in the template), and the words standing there decide: a template
counts where its key phrases stand in place, scored by the weight of its words found there.

Documents are handled one by one in Arrow batches; nothing is shuffled but the counts of
the licence words, whose number is fixed by the templates.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from deltascope.llm.common import pruned

SLACK = 4  # words by which a template may be shifted against its key phrase
LEAST_SCORE = 0.6  # share of a template's weight that must stand in place

# fixed values: the base phrases and their labels
BASE_PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    keys: tuple[str, ...]  # must stand in place, word by word


#: Openings of common licences and the notices that name them.
TEMPLATES = (
    Template("mit", "released under the mit license", ("mit license",)),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted free of charge",)),
    Template("apache-2", "licensed under the apache license version 2 0", ("apache license version 2",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    Template("gpl", "this work is licensed under the gnu general public license version", ("gnu general public license",)),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", ("gnu general public license", "you can redistribute it")),
    Template("lgpl", "under the terms of the gnu lesser general public license", ("gnu lesser general public license",)),
    Template("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    Template("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    Template("cc-by", "licensed under a creative commons attribution 4 0 international license", ("creative commons attribution",)),
    Template("reserved", "all rights reserved", ("all rights reserved",)),
)

# letters and digits stay, A-Z in lower case; everything else of ASCII parts words
_KEPT = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_KEPT).split()


def licence_words(templates: tuple[Template, ...] = TEMPLATES) -> list[bytes]:
    return sorted({w for t in templates for w in words_of(t.text)} | {w for p, _ in BASE_PHRASES for w in words_of(p)})


def document_frequencies(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> tuple[int, dict[bytes, int]]:
    """Number of documents, and how many hold each licence word."""
    wanted = frozenset(licence_words(templates))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, n = Counter(), 0
        for batch in batches:
            n += len(batch)
            for text in batch["text"]:
                counts.update(wanted.intersection(words_of(text)))
        rows = [("", n)] + [(w.decode(), c) for w, c in counts.items()]
        yield pd.DataFrame(rows, columns=["word", "n"])

    rows = docs.select("text").mapInPandas(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    found = {r["word"].encode(): r["n"] for r in rows}
    return found.pop(b"", 0), found


class Index:
    """Phrases filed under their rarest word; templates placed by their first key phrase."""

    def __init__(self, documents: int, frequencies: dict[bytes, int], templates: tuple[Template, ...] = TEMPLATES):
        self.weight = {w: math.log((1 + documents) / (1 + frequencies.get(w, 0))) + 1 for w in licence_words(templates)}
        self.filed: dict[bytes, list[tuple]] = {}  # word -> (position in phrase, phrase, base label, template, phrase's place in it)
        for phrase, label in BASE_PHRASES:
            self._file(words_of(phrase), label, None, 0)
        for t in templates:
            whole, key = words_of(t.text), words_of(t.keys[0])
            place = next(i for i in range(len(whole)) if whole[i:i + len(key)] == key)
            rest = [words_of(k) for k in t.keys]
            self._file(key, None, (t.label, whole, rest, sum(self.weight[w] for w in whole)), place)

    def _file(self, phrase: list[bytes], label: str | None, template: tuple | None, place: int) -> None:
        at = max(range(len(phrase)), key=lambda i: (self.weight[phrase[i]], -i))
        self.filed.setdefault(phrase[at], []).append((at, phrase, label, template, place))

    def scan(self, words: list[bytes]) -> tuple[list[tuple[str, int]], list[tuple[str, int, int, float]]]:
        """(label, first word) of base phrases; (label, first word, word after, score) of templates."""
        base, found, filed = [], [], self.filed
        for i in [i for i, w in enumerate(words) if w in filed]:
            for at, phrase, label, template, place in filed[words[i]]:
                start = i - at
                if start < 0 or words[start:start + len(phrase)] != phrase:
                    continue
                if template is None:
                    base.append((label, start))
                else:
                    found.extend(self._placed(words, start - place, *template))
        return base, found

    def _placed(self, words: list[bytes], start: int, label: str, whole: list[bytes], keys: list[list[bytes]], total: float) -> Iterator[tuple]:
        first, after = max(0, start - SLACK), min(len(words), start + len(whole) + SLACK)
        window = words[first:after]
        for key in keys:
            if not any(window[i:i + len(key)] == key for i in range(len(window) - len(key) + 1)):
                return
        # a word counts where it stands in place, give or take a few words
        score = 0.0
        for p, w in enumerate(whole):
            near = words[max(0, start + p - SLACK):max(0, start + p + SLACK + 1)]
            score += self.weight[w] * (w in near)
        score = min(1.0, score / total)
        if score >= LEAST_SCORE:
            yield label, max(0, start), min(len(words), start + len(whole)), score


def scan_licenses(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """Find licence phrases and templates in every whole text: one row per row of `docs`.

    Returns doc_id, n_words, `base` (label and first word of every place of a base phrase)
    and `found` (label, first word, word after, score above 0 and up to 1 of every template
    in place), both by position. Words are letters and digits; A-Z are lower-cased.

    Null text counts as empty: no words, nothing found. Rows are scanned one by one, so
    repeated rows get equal results. Overlapping places all count. An empty table gives no
    rows; other columns are not read.
    """
    whole = pruned(docs, id_column, text_column)
    index = whole.sparkSession.sparkContext.broadcast(Index(*document_frequencies(whole, templates), templates))
    kind = whole.schema["doc_id"].dataType.simpleString()
    schema = (
        f"doc_id {kind}, n_words long, base array<struct<label:string,first:long>>, "
        "found array<struct<label:string,first:long,after:long,score:double>>"
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes, bases, templates_found = [], [], []
            for text in batch["text"]:
                words = words_of(text)
                base, found = index.value.scan(words)
                sizes.append(len(words))
                bases.append([{"label": b[0], "first": b[1]} for b in sorted(base, key=lambda b: b[::-1])])
                templates_found.append([dict(zip(("label", "first", "after", "score"), f)) for f in sorted(found, key=lambda f: (f[1], f))])
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_words": sizes, "base": bases, "found": templates_found})

    return whole.mapInPandas(run, schema)
