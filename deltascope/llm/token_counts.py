"""Token counts of a unigram tokenizer without making tokens.

An Aho-Corasick automaton of the vocabulary lists every piece that ends at a character; the
Viterbi recursion keeps, for each character, the best score of a segmentation up to it and
that segmentation's number of pieces, nothing else. Ties are those of the tokenizers
library: of equally good last pieces the longest wins, since it was reached first, and a
character without a piece of its own may be unknown, at ten less than the worst score.
Unknown characters become one piece per byte where the model has byte fallback, else
neighbouring ones are one piece.

Where no piece goes on past the white space marker, unknown characters become bytes, and
scores are whole numbers, whose sums are exact, the best segmentation of a text is that of its words, and frequent words are
remembered. Otherwise the recursion runs over the text as a whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from deltascope.llm import piece_model as pm
from deltascope.llm.common import pruned

REMEMBERED = 400_000  # words per Python worker: bounds memory, not results
LONGEST_REMEMBERED = 64  # characters
UNKNOWN_PENALTY = 10.0  # fixed value of unigram tokenizers

_SEGMENT = re.compile(f"{pm.MARKER}*[^{pm.MARKER}]+|{pm.MARKER}+")


class PieceCounter(dict):
    """Best score and number of pieces, by segment of normalised text."""

    def __init__(self, model: pm.PieceModel):
        import ahocorasick

        super().__init__()
        if model.charsmap:
            raise ValueError("models with a character map need their own normaliser")
        self.model = model
        self.automaton = ahocorasick.Automaton()
        for piece, score, _ in model.pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(score for _, score, _ in model.pieces) - UNKNOWN_PENALTY
        self.per_byte = model.bytes_complete
        long_pieces = [p for p, _, _ in model.pieces if len(p) > 1]
        self.by_word = self.per_byte and all(float(s).is_integer() for _, s, _ in model.pieces) and not any(pm.MARKER in p.lstrip(pm.MARKER) for p in long_pieces)
        self.by_line = self.by_word and not any("\n" in p for p in long_pieces)

    def __missing__(self, segment: str) -> tuple[float, int]:
        value = self.segment(segment)
        if len(segment) <= LONGEST_REMEMBERED:
            if len(self) >= REMEMBERED:
                self.clear()
            self[segment] = value
        return value

    def segment(self, text: str) -> tuple[float, int]:
        """The recursion over one text."""
        n, per_byte, unknown = len(text), self.per_byte, self.unknown
        best: list[float] = [0.0] * (n + 1)
        pieces = [0] * (n + 1)
        open_unknown = [False] * (n + 1)  # the segmentation ends in an unknown character
        matches = self.automaton.iter(text)
        match = next(matches, None)
        for end in range(1, n + 1):
            score = None
            single = False
            while match is not None and match[0] == end - 1:  # longest first
                length, own = match[1]
                candidate = best[end - length] + own
                if score is None or candidate > score:
                    score, at = candidate, end - length
                single = single or length == 1
                match = next(matches, None)
            if not single and (score is None or best[end - 1] + unknown > score):
                best[end] = best[end - 1] + unknown
                size = len(text[end - 1].encode("utf-8", "surrogatepass")) if per_byte else not open_unknown[end - 1]
                pieces[end] = pieces[end - 1] + size
                open_unknown[end] = True
            else:
                best[end], pieces[end] = score, pieces[at] + 1
        return best[n], pieces[n]

    def normalised(self, text: str) -> str:
        if self.model.remove_extra_whitespaces:
            text = re.sub(" {2,}", " ", text.strip())
        if self.model.add_dummy_prefix and text:
            text = pm.MARKER + text
        return text.replace(" ", pm.MARKER)

    def count(self, text: str) -> tuple[float, int]:
        """Best score and number of pieces of a whole text."""
        text = self.normalised(text)
        if not self.by_word:
            return self.segment(text)
        parts = text.split("\n") if self.by_line else [text]
        score, pieces = 0.0, 0
        if len(parts) > 1:
            one = self["\n"]
            score, pieces = one[0] * (len(parts) - 1), one[1] * (len(parts) - 1)
        for part in parts:
            for own in map(self.__getitem__, _SEGMENT.findall(part)):
                score += own[0]
                pieces += own[1]
        return score, pieces


@lru_cache(maxsize=2)
def _counter(path: str) -> PieceCounter:
    return PieceCounter(pm.load(path))


def count_tokens(docs: DataFrame, model_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Number of unigram pieces of every whole text: doc_id, n_tokens and the best score.

    The file's pieces and scores are taken as a unigram vocabulary, whatever kind of model
    they were learned for. Null and empty texts have 0 tokens and score 0. Rows are counted
    one by one, so repeated rows get equal counts. An empty table gives no rows; other
    columns are not read.
    """
    whole = pruned(docs, id_column, text_column)
    kind = whole.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = _counter(model_path)
        for batch in batches:
            counted = [counter.count(t or "") for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_tokens": [c[1] for c in counted], "score": [c[0] for c in counted]})

    return whole.mapInPandas(run, f"doc_id {kind}, n_tokens long, score double")
