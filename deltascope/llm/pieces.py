"""SentencePiece encoding and decoding on the tokenizers library.

The model's protobuf is read and its parts are rebuilt: the normaliser (character map, extra
white space, dummy prefix, marker for white space), the scores of a unigram model or the
merges that a BPE model's scores stand for, byte fallback for what the vocabulary lacks, and
the decoder. Batches are encoded on several threads. Where no piece of a BPE model goes on
past a marker, merges never cross from one word to the next: then the words of a batch that
were not met before are encoded, once each, and texts are put together from them. Parity is
verified: every whole text is encoded by the sentencepiece library too, and the verdict is
returned with the row.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from deltascope.llm import piece_model as pm
from deltascope.llm.common import pruned

THREADS = 2  # per task
BATCH_CHARS = 200_000  # characters encoded at once: bounds memory, not results
LONG_TEXT = 50_000  # longer texts are encoded from one white space to another
ROWS = 256  # rows handled at once: bounds memory, not results
VERIFY_EVERY = 1  # one row in so many is encoded by both libraries
WORDS_HELD = 200_000  # encoded words that a worker remembers
LONGEST_WORD = 64  # longer ones are not remembered
WORDS_AT_ONCE = 20_000  # characters of new words encoded as one text


def _merges(model: pm.PieceModel) -> list[tuple[str, str]]:
    """Pairs of pieces whose union is a piece, best score first."""
    ids = {p: i for i, (p, _, kind) in enumerate(model.pieces) if kind in (pm.NORMAL, pm.USER_DEFINED, pm.UNUSED)}
    found = []
    for whole, i in ids.items():
        for cut in range(1, len(whole)):
            left, right = ids.get(whole[:cut]), ids.get(whole[cut:])
            if left is not None and right is not None:
                found.append((-model.pieces[i][1], i, left, right, whole[:cut], whole[cut:]))
    return [f[4:] for f in sorted(found)]


def build(model: pm.PieceModel):
    """A tokenizers.Tokenizer that encodes and decodes like the model."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers

    unknown = model.pieces[model.unknown][0]
    if model.kind == pm.BPE:
        own = models.BPE(
            vocab={p: i for i, (p, _, _) in enumerate(model.pieces)}, merges=_merges(model),
            unk_token=unknown, fuse_unk=True, byte_fallback=model.byte_fallback,
        )
    else:
        own = models.Unigram([(p, s) for p, s, _ in model.pieces], unk_id=model.unknown, byte_fallback=model.byte_fallback)
    tokenizer = Tokenizer(own)
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.remove_extra_whitespaces:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if model.add_dummy_prefix:
        steps.append(normalizers.Prepend(pm.MARKER))
    steps.append(normalizers.Replace(" ", pm.MARKER))
    tokenizer.normalizer = normalizers.Sequence(steps)
    back = [decoders.Replace(pm.MARKER, " "), decoders.ByteFallback(), decoders.Fuse()]
    tokenizer.decoder = decoders.Sequence(back + ([decoders.Strip(" ", 1, 0)] if model.add_dummy_prefix else []))
    return tokenizer


class Codec:
    """A rebuilt tokenizer, applied to many texts of any length at once."""

    def __init__(self, model: pm.PieceModel):
        self.tokenizer = build(model)
        # a text can be cut before a marker if no piece goes on past one, and the marker that
        # opens every text stands in for the white space that was cut at
        self.can_cut = model.add_dummy_prefix and not model.remove_extra_whitespaces and not model.charsmap and not any(
            pm.MARKER in p.lstrip(pm.MARKER) for p, _, kind in model.pieces if kind == pm.NORMAL
        )
        marker = self.tokenizer.token_to_id(pm.MARKER)
        self.by_words = self.can_cut and model.kind == pm.BPE and marker is not None
        self.begins = np.array([p.startswith(pm.MARKER) for p, _, _ in model.pieces])
        self.between = re.compile(f"(?<=[^ {pm.MARKER}]) ")
        # ids of words as 32-bit integers; nothing after a white space is the marker alone
        self.words: dict[str, bytes] = {"": np.array([marker or 0], np.int32).tobytes()}
        self.opening = " " if model.add_dummy_prefix else ""
        self.bytes = [
            bytes([int(p[3:5], 16)]) if kind == pm.BYTE else p.replace(pm.MARKER, " ").encode() for p, _, kind in model.pieces
        ]
        # the bytes of all pieces end to end, and where each piece's begin and how long they are
        self.lengths = np.array([len(b) for b in self.bytes], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.table = np.frombuffer(b"".join(self.bytes), np.uint8)

    def _cut(self, text: str) -> list[str]:
        parts = []
        while self.can_cut and len(text) > LONG_TEXT:
            at = text.find(" ", LONG_TEXT)
            if at < 0 or text[at - 1] in f" {pm.MARKER}":
                break
            parts.append(text[:at])
            text = text[at + 1:]
        return [*parts, text] if text or not parts else [*parts, ""]

    def _units(self, text: str) -> list[str]:
        """A text cut at the first white space of every run; what was cut at is the marker that opens the next."""
        if not text:
            return []
        if "  " in text or pm.MARKER in text or text[0] == " ":
            return self.between.split(text)
        return text.split(" ")

    def _from_words(self, texts: list[str]) -> list[np.ndarray]:
        units = [self._units(t) for t in texts]
        met = set().union(*units)
        if len(self.words) > WORDS_HELD:
            self.words = {"": self.words[""]}
        known, new, odd = self.words, [], []
        for word in met:
            if word not in known:
                (odd if " " in word or pm.MARKER in word else new).append(word)
        # plain words are encoded as texts of many, in which each begins with the next marker
        # plain words do not merge with their neighbours, so where portions are cut does not matter
        ends = np.cumsum(np.fromiter(map(len, new), np.int64, len(new)))
        cuts = np.unique(np.searchsorted(ends, np.arange(WORDS_AT_ONCE, ends[-1], WORDS_AT_ONCE) if len(new) else [], "right")).tolist()
        portions = [new[a:b] for a, b in zip([0, *cuts], [*cuts, len(new)]) if a < b]
        for portion, found in zip(portions, self.tokenizer.encode_batch_fast([" ".join(p) for p in portions], add_special_tokens=False)):
            ids = np.array(found.ids, np.int32)
            starts, held = (4 * np.flatnonzero(self.begins[ids])).tolist(), ids.tobytes()
            if len(starts) != len(portion):
                raise ValueError("a plain word did not begin with the marker")
            known.update(zip(portion, map(held.__getitem__, map(slice, starts, [*starts[1:], len(held)]))))
        for word, found in zip(odd, self.tokenizer.encode_batch_fast(odd, add_special_tokens=False)):
            known[word] = np.array(found.ids, np.int32).tobytes()
        out = [np.frombuffer(b"".join(map(known.__getitem__, own)), np.int32) for own in units]
        for word in (*new, *odd):
            if len(word) > LONGEST_WORD:
                del known[word]
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if self.by_words:
            return self._from_words(texts)
        parts = [self._cut(t) for t in texts]
        found: list[np.ndarray] = []
        for portion in _portions([p for own in parts for p in own]):
            found.extend(np.array(e.ids, dtype=np.int32) for e in self.tokenizer.encode_batch_fast(portion, add_special_tokens=False))
        out, at = [], 0
        for own in parts:
            out.append(found[at] if len(own) == 1 else np.concatenate(found[at:at + len(own)]))
            at += len(own)
        return out

    def decode(self, ids) -> str:
        """The text of ids; as the tokenizer's own decoder has it where bytes are no valid text."""
        ids = np.asarray(ids, np.int64)
        lengths = self.lengths[ids]
        # each byte's place in the table: its piece's start there, plus its place in the piece
        shift = np.repeat(self.starts[ids] - (np.cumsum(lengths) - lengths), lengths)
        try:
            return self.table[np.arange(len(shift)) + shift].tobytes().decode().removeprefix(self.opening)
        except UnicodeDecodeError:
            return self.tokenizer.decode(ids.tolist(), skip_special_tokens=False)


@lru_cache(maxsize=2)
def _codec(path: str, threads: int) -> Codec:
    os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
    os.environ["RAYON_NUM_THREADS"] = str(threads)
    return Codec(pm.load(path))


@lru_cache(maxsize=2)
def _original(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def _portions(texts: list[str], most: int = BATCH_CHARS) -> Iterator[list[str]]:
    """Neighbouring texts, about `most` characters at a time; a longer text by itself."""
    portion, size = [], 0
    for text in texts:
        if portion and size + len(text) > most:
            yield portion
            portion, size = [], 0
        portion.append(text)
        size += len(text)
    if portion:
        yield portion


def _portions_of_rows(texts: list[str], rows: list[int]) -> Iterator[list[int]]:
    """Row numbers whose texts come to about `BATCH_CHARS` characters together."""
    portion, size = [], 0
    for i in rows:
        portion.append(i)
        size += len(texts[i])
        if size >= BATCH_CHARS:
            yield portion
            portion, size = [], 0
    if portion:
        yield portion


def encode(
    docs: DataFrame, model_path: str, id_column: str = "doc_id", text_column: str = "text",
    threads: int = THREADS, verify_every: int = VERIFY_EVERY, decoded: bool = False,
) -> DataFrame:
    """Token ids of every whole text: doc_id, ids and parity, one row per row of `docs`.

    `parity` says whether the sentencepiece library gives the same ids; null for rows that
    are not among those verified. With `decoded`, the text that the ids stand for is
    returned too. Null and empty texts have no ids. Rows are encoded one by one, so repeated
    rows get equal ids. An empty table gives no rows; other columns are not read. A text
    without white space is one word to the model and takes memory in proportion.
    """
    whole = pruned(docs, id_column, text_column)
    kind = whole.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = _codec(model_path, threads)
        for batch in batches:
            for start in range(0, len(batch), ROWS):
                part = batch.iloc[start:start + ROWS]
                texts = part["text"].fillna("").tolist()
                ids = codec.encode(texts)
                chosen = [bool(verify_every) and (verify_every == 1 or zlib.crc32(t.encode("utf-8", "surrogatepass")) % verify_every == 0) for t in texts]
                parity: list[bool | None] = [None] * len(texts)
                for portion in _portions_of_rows(texts, [i for i, c in enumerate(chosen) if c]):
                    for i, expected in zip(portion, _original(model_path).encode([texts[i] for i in portion], num_threads=1)):
                        parity[i] = len(expected) == len(ids[i]) and bool((np.array(expected, np.int32) == ids[i]).all())
                out = pd.DataFrame({"doc_id": part["doc_id"].tolist(), "ids": ids, "parity": pd.array(parity, dtype="boolean")})
                out["doc_id"] = out["doc_id"].astype(part["doc_id"].dtype)
                if decoded:
                    out["decoded"] = [codec.decode(own) for own in ids]
                yield out

    return whole.mapInPandas(run, f"doc_id {kind}, ids array<int>, parity boolean" + ", decoded string" * decoded)


def decode(encoded: DataFrame, model_path: str, ids_column: str = "ids", threads: int = THREADS) -> DataFrame:
    """`encoded` with the column `decoded`, the text its ids stand for; null ids give null."""
    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = _codec(model_path, threads)
        for batch in batches:
            yield pd.Series([None if ids is None else codec.decode(ids.tolist()) for ids in batch], dtype=object)

    return encoded.withColumn("decoded", text(F.col(f"`{ids_column}`")))
