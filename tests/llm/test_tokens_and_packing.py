import dataclasses
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from deltascope.llm import packing, piece_model as pm, pieces, queries, token_counts

public_tokenizers = pytest.importorskip("public_tokenizers")
BPE_PATH = public_tokenizers.path("byte_bpe_50k.json")
PIECES_PATH = public_tokenizers.path("piece_bpe_32k.model")

TEXTS = [
    "", " ", "a  b", "\n a", "a\n\nb", "it's 'll  x", "a <|endoftext|> b", "don't\ncan't 12 3", "é日本語 ½ ②x²", "a\x1c b", "x" * 5000, " " * 5000 + "b",
    "▁a ▁▁b", "<s>hi</s> <unk> <0x0A>", " " * 17 + "a", "def f(x):\n    return x", "ſs ﬁ", "🎉🎉 ok", "\u0000x", "word " * 3000,
]


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BPE_PATH)
    t.encode_special_tokens = True
    return t


def test_fast_encoder_gives_the_ids_of_tokenizers(reference):
    encode = packing.Encoder(BPE_PATH)
    for text in TEXTS:
        assert np.frombuffer(encode(text), "<u4").tolist() == reference.encode(text, add_special_tokens=False).ids, text[:40]


def test_layout_agrees_with_plain_encoding(spark, make, reference):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(100, None), (101, "the words " * 2048), (102, "same"), (102, "same"), (None, "no id")]
    capacity = 64
    got = packing.pack(make(rows, extra=True), BPE_PATH, capacity).collect()
    expected = Counter()
    for i, t in rows:
        ids = reference.encode(t or "", add_special_tokens=False).ids + [0]
        start, length = 0, len(ids) % capacity or capacity
        piece = 0
        while start < len(ids):
            own = np.array(ids[start:start + length], dtype="<u4").tobytes()
            expected[str(i), piece, start, length, zlib.crc32(own)] += 1
            start, length, piece = start + length, capacity, piece + 1
    assert Counter((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == expected
    filled = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == filled.get(r["sequence_id"], 0)
        filled[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(filled.values()) <= capacity and sorted(filled) == list(range(len(filled)))
    assert packing.pack(make([]), BPE_PATH).count() == 0


def test_written_sequences_hold_the_ids(spark, make, reference, tmp_path):
    docs = make([(1, "one two three"), (2, "x " * 90), (3, None)])
    layout = packing.pack(docs, BPE_PATH, 32)
    packing.write_sequences(docs, layout, BPE_PATH, str(tmp_path / "out"), 32)
    ids = {r["sequence_id"]: r["ids"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    for r in layout.where("doc_id = 1").collect():
        assert ids[r["sequence_id"]][r["offset"]:r["offset"] + r["length"]] == reference.encode("one two three").ids + [0]
    assert sum(map(len, ids.values())) == layout.agg({"length": "sum"}).first()[0]


def fewest(items, capacity):
    """Exact, over all subsets."""
    best = [(len(items) + 1, 0)] * (1 << len(items))
    best[0] = (0, capacity)
    for done, (bins, used) in enumerate(best):
        for i, x in enumerate(items):
            if not done >> i & 1:
                best[done | 1 << i] = min(best[done | 1 << i], (bins, used + x) if used + x <= capacity else (bins + 1, x))
            bins, used = best[done]
    return best[-1][0]


def test_bin_completion_is_optimal_on_small_cases():
    rng = random.Random(2)
    for _ in range(150):
        capacity = rng.choice([10, 20, 37, 100])
        items = [rng.randint(1, capacity) for _ in range(rng.randint(1, 10))]
        plan = packing.complete_bins(dict(Counter(items)), capacity)
        placed = Counter()
        for filling, n in plan:
            assert sum(filling) <= capacity
            for x in filling:
                placed[x] += n
        assert placed == Counter(items)
        assert sum(n for _, n in plan) == fewest(items, capacity)


def test_bin_completion_beats_best_fit_where_it_can():
    counts = {6: 3, 5: 3, 4: 3, 3: 3, 2: 3}  # twenty to a bin, sixty in all
    assert sum(n for _, n in packing.complete_bins(counts, 20)) == 3
    assert packing.complete_bins({}, 20) == []
    assert sum(n for _, n in packing.complete_bins({1: 10**9, 7: 10**8}, 20)) == packing.sequences_needed({1: 10**9, 7: 10**8}, 20)


def test_pieces_agree_with_sentencepiece(make):
    import sentencepiece

    original = sentencepiece.SentencePieceProcessor(model_file=PIECES_PATH)
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(100, None), (3, TEXTS[3]), (None, "x y"), (101, "some words é  of a long text\n" * 9000), (102, "x " * 60000)]
    own = {r["doc_id"]: r["decoded"] for r in pieces.encode(make(rows), PIECES_PATH, decoded=True).collect()}
    out = pieces.decode(pieces.encode(make(rows, extra=True), PIECES_PATH, verify_every=1), PIECES_PATH).collect()
    texts = dict(rows)
    assert len(out) == len(rows)
    for r in out:
        text = texts[r["doc_id"]] or ""
        assert r["parity"] is True and r["ids"] == original.encode(text)
        assert r["decoded"] == own[r["doc_id"]] == text.replace("▁", " ")  # the marker stands for a space
    assert pieces.encode(make([]), PIECES_PATH).count() == 0


def test_the_query_verifies_every_document(spark, make, tmp_path):
    make([(i, f"document {i} é of a few words") for i in range(40)] + [(40, None), (41, "")]).write.parquet(str(tmp_path / "documents.parquet"))
    assert [r["parity"] for r in queries.QUERIES["op3_sentencepiece"](spark, str(tmp_path)).collect()] == [True] * 42


def test_unigram_model_is_rebuilt_too():
    model = pm.PieceModel((("<unk>", 0.0, pm.UNKNOWN), ("▁", -2.0, 1), ("a", -1.0, 1), ("▁ab", -1.5, 1), ("b", -1.2, 1)), pm.UNIGRAM, False, b"", True, True)
    assert pieces.build(model).encode("  ab  a ").tokens == ["▁ab", "▁", "a"]


def test_counts_agree_with_the_unigram_tokenizer(make):
    model = dataclasses.replace(pm.load(PIECES_PATH), kind=pm.UNIGRAM)
    tokenizer = pieces.build(model)
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(100, None), (4, TEXTS[4])]
    out = token_counts.count_tokens(make(rows, extra=True), PIECES_PATH).collect()
    assert sorted((r["doc_id"], r["n_tokens"]) for r in out) == sorted((i, len(tokenizer.encode(t or "").ids)) for i, t in rows)
    assert token_counts.count_tokens(make([]), PIECES_PATH).count() == 0


def test_ties_are_those_of_the_tokenizer():
    from tokenizers import Tokenizer, models

    rng = random.Random(3)
    for _ in range(300):
        vocabulary = {"<unk>": 0.0} | {c: float(-rng.randint(1, 4)) for c in rng.sample("ab▁c", rng.randint(1, 4))}
        for _ in range(rng.randint(1, 8)):
            vocabulary.setdefault("".join(rng.choice("ab▁c") for _ in range(rng.randint(2, 4))), -rng.randint(1, 6) / rng.choice([1, 2]))
        model = pm.PieceModel(tuple((p, s, pm.UNKNOWN if p == "<unk>" else 1) for p, s in vocabulary.items()), pm.UNIGRAM, False, b"", False, False)
        tokenizer = Tokenizer(models.Unigram([p[:2] for p in model.pieces], unk_id=0, byte_fallback=False))
        counter = token_counts.PieceCounter(model)
        for _ in range(4):
            text = "".join(rng.choice("ab▁cd") for _ in range(rng.randint(1, 14)))
            assert counter.count(text)[1] == len(tokenizer.encode(text).ids), (vocabulary, text)


def test_codec_decodes_arrays_and_many_portions_of_new_words():
    import sentencepiece

    original = sentencepiece.SentencePieceProcessor(model_file=PIECES_PATH)
    codec = pieces.Codec(pm.load(PIECES_PATH))
    words = " ".join(f"w{i}é{i % 7}" for i in range(3 * pieces.WORDS_AT_ONCE // 4))  # new words over several portions
    for text in [words, "a \U0001F600 b", "", *TEXTS[:8]]:
        ids = codec.encode([text])[0]
        assert ids.tolist() == original.encode(text)
        assert codec.decode(ids) == codec.decode(ids.tolist()) == codec.tokenizer.decode(ids.tolist(), skip_special_tokens=False).replace("▁", " ")
    lone = [codec.tokenizer.token_to_id("<0xC3>")]  # no valid text: the tokenizer's own decoder answers
    assert codec.decode(np.array(lone, np.int32)) == codec.tokenizer.decode(lone, skip_special_tokens=False)
