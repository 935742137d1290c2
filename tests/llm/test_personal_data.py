import random
import re
import time

import pytest
from pyspark.sql import functions as F

from deltascope.llm import personal_data
from deltascope.llm.personal_data import AFTER, BEFORE, BOOST, KINDS, LEAST_SCORE


def luhn(d):
    doubled = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(d))]
    return sum(x - 9 if x > 9 else x for x in doubled) % 10 == 0


CHECKS = {
    "ip": lambda s: all(int(p) <= 255 for p in s.split(".")),
    "card": lambda s: 14 <= len(re.sub("[^0-9]", "", s)) <= 19 and luhn(re.sub("[^0-9]", "", s)),
    "phone": lambda s: 10 <= len(re.sub("[^0-9]", "", s)) <= 15,
    "iban": lambda s: int("".join(str(int(c, 36)) for c in s.replace(" ", "")[4:] + s.replace(" ", "")[:4])) % 97 == 1,
    "bank": lambda s: s != "000000000" and sum(int(c) * (3, 7, 1)[k % 3] for k, c in enumerate(s)) % 10 == 0,
}


def brute(text):
    found, text = [], text or ""
    for order, kind in enumerate(KINDS):
        hits = list(re.finditer(kind.pattern, text))
        ends = [0] + [h.end() for h in hits]
        starts = [h.start() for h in hits] + [len(text)]
        for k, hit in enumerate(hits):
            before, after = text[ends[k]:hit.start()], text[hit.end():starts[k + 1]]
            near = bool(re.search(kind.context(), before[-BEFORE:]) or re.search(kind.context(), after[:AFTER]))
            score = min(100, kind.score + BOOST * near)
            fits = CHECKS.get(kind.name, lambda s: True)(hit.group())
            if kind.alone:
                fits &= not re.search("[A-Za-z0-9]", before[-1:] + after[:1])
            if fits and (kind.base or score >= LEAST_SCORE):
                found.append((hit.start(), order, hit.end(), kind.name, score))
    return [(n, s, e, c) for s, _, e, n, c in sorted(found)]


PIECES = [
    "a.b@c.de", "x@y@z.com", "co.co_d@e.fr-", "u@v", "@", "a@b..c", "1.2.3.4", "256.1.1.1", "0010.000255.3.4.5.6.7.8", "1.2.3", "4111 1111 1111 1111", "4111-1111-1111-1112",
    "12345678901234567890123", "+49 (30) 1234-5678", "+1", "+12345678901234567", "+1 2 3 ", "DE89 3704 0044 0532 0130 00", "GB29NWBK60161331926819", "DE89370400440532013001",
    "XDE89370400440532013000", "SSN ", "Social Security", "123-45-6789", "0123-45-6789", "routing", "021000021", "021000022", "000000000", "phone:", "(555) 123-4567", "555.123.4567",
    "card", "mail", "é", "😀", "\n", " ", ".", "-", "w", "7", "wort", "contact",
]


@pytest.fixture(scope="module")
def spans(spark):
    def run(texts):
        docs = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], "doc_id long, text string, spans string, _doc string")
        found = personal_data.find_personal_data(docs).select("_doc.doc_id", "spans").collect()
        return {r.doc_id: [tuple(s) for s in r.spans] for r in found}

    return run


def test_agrees_with_brute_force(spans):
    rng = random.Random(12)
    texts = [None, "", "nothing here", *PIECES] + ["".join(rng.choice(PIECES) + rng.choice(["", " ", " "]) for _ in range(rng.randint(2, 25))) for _ in range(400)]
    texts += texts[-5:]
    found = spans(texts)
    for i, text in enumerate(texts):
        assert found[i] == brute(text), text
    assert {s[0] for rows in found.values() for s in rows} == {k.name for k in KINDS}


def test_very_long_texts_take_linear_time(spans):
    texts = [
        "a" * 400_000, "1" * 400_000, "1 " * 200_000, "a.b-" * 100_000 + "@", "+" * 1_000 + "1-" * 100_000, "a@" * 150_000, "x@a" + ".b" * 150_000,
        "1." * 200_000, "mail a@b.cd, " * 20_000, "DE89" + "A0 " * 100_000,
    ]
    started = time.time()
    found = spans(texts)
    assert time.time() - started < 60
    for i in (0, 1, 2, 3, 5, 6, 9):
        assert len(found[i]) == (1 if i == 6 else 0), i
    assert len(found[8]) == 20_000 and found[8][-1] == ("email", len(texts[8]) - 8, len(texts[8]) - 2, 100)


def test_filters_on_the_result_and_empty_tables(spark, make):
    docs = make([(i, "write to a@b.cd or 1.2.3.4 " * 500) for i in range(3)], extra=True)
    started = time.time()
    assert personal_data.find_personal_data(docs).where(F.size("spans") > 5).where("_doc.doc_id >= 0").count() == 3
    assert time.time() - started < 30
    assert personal_data.find_personal_data(docs.limit(0)).collect() == []
