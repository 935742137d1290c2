"""Language identification: sparse multinomial logistic regression on character n-grams.

Features are hashed n-grams of one to three characters of the letters in lower case, as
TF-IDF vectors of length one. Document frequencies are counted over all labelled training
texts. The model is fitted on a bounded sample of them (`PER_LANGUAGE` rows a language, the
smallest by a hash of their id) by follow-the-regularised-leader with L1 and L2 penalties,
and its confidence is calibrated by a temperature on a part of the sample kept aside.
Prediction is one pass over the documents; the weights have a fixed number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from deltascope.llm.common import materialize

BUCKETS = 1 << 15  # hashed n-grams
PER_LANGUAGE = 400  # most rows a language that the model is fitted on
EPOCHS = 4
ALPHA, BETA, L1, L2 = 1.0, 1.0, 0.02, 0.01  # step size, its start, penalties
UNKNOWN = "und"

_TABLE = 0x3100  # beyond it every character counts as a letter of its own
_letters = np.array([c if chr(c).isalpha() else 32 for c in range(_TABLE)], dtype=np.uint32)


def counts_of(text: str | None) -> np.ndarray | None:
    """How often each hashed n-gram occurs; None if there is no letter."""
    if not text or not any(map(str.isalpha, text)):
        return None
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    codes = np.where(codes < _TABLE, _letters[np.minimum(codes, _TABLE - 1)], codes).astype(np.uint32)
    codes = np.concatenate([[32], codes, [32]]).astype(np.uint32)
    codes = codes[1:][(codes[1:] != 32) | (codes[:-1] != 32)]
    codes = np.concatenate([np.array([32], dtype=np.uint32), codes])
    total = np.zeros(BUCKETS, dtype=np.int64)
    mixed = np.zeros(len(codes), dtype=np.uint32)
    for n in range(1, 4):
        if len(codes) < n:
            break
        mixed = (mixed[:len(codes) - n + 1] + codes[n - 1:]) * np.uint32(0x9E3779B1)
        mixed ^= mixed >> np.uint32(15)
        total += np.bincount((mixed * np.uint32(0x85EBCA6B)) >> np.uint32(17), minlength=BUCKETS)
    return total


def _vector(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    where = np.flatnonzero(counts)
    value = (1 + np.log(counts[where])) * idf[where]
    return where, value / max(np.sqrt(value @ value), 1e-12)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max())
    return e / e.sum()


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # one row a bucket, one column a language
    temperature: float = 1.0

    def predict(self, text: str | None) -> tuple[str, float]:
        counts = counts_of(text) if self.languages else None
        if counts is None:
            return UNKNOWN, 0.0
        where, value = _vector(counts, self.idf)
        chances = _softmax(value @ self.weights[where] / self.temperature)
        best = int(chances.argmax())  # ties: the first language by name
        return self.languages[best], float(chances[best])


def fit(vectors: list[tuple[np.ndarray, np.ndarray]], labels: list[int], languages: list[str], idf: np.ndarray) -> Model:
    """Follow the regularised leader, one example after the other; then calibrate."""
    shape = (BUCKETS, len(languages))
    z, n = np.zeros(shape), np.zeros(shape)
    aside = [i for i in range(len(labels)) if i % 5 == 4]
    shown = [i for i in range(len(labels)) if i % 5 != 4] or aside

    def weights(where):
        pull = z[where]
        return np.where(np.abs(pull) <= L1, 0.0, -(pull - np.sign(pull) * L1) / ((BETA + np.sqrt(n[where])) / ALPHA + L2))

    order = np.random.default_rng(7)
    for _ in range(EPOCHS):
        for i in order.permutation(shown):
            where, value = vectors[i]
            own = weights(where)
            error = _softmax(value @ own)
            error[labels[i]] -= 1
            slope = value[:, None] * error[None, :]
            rate = (np.sqrt(n[where] + slope**2) - np.sqrt(n[where])) / ALPHA
            z[where] += slope - rate * own
            n[where] += slope**2
    model = Model(languages, idf, weights(slice(None)).astype(np.float32))
    if aside:
        logits = [vectors[i][1] @ model.weights[vectors[i][0]] for i in aside]

        def loss(t):
            return -sum(np.log(max(_softmax(x / t)[labels[i]], 1e-12)) for x, i in zip(logits, aside))

        model.temperature = float(min(np.geomspace(0.05, 5, 60), key=loss))
    return model


def held_out(id_column: Column) -> Column:
    """Every third document, by the checksum of its id, is never learned from."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "lang", per_language: int = PER_LANGUAGE) -> Model:
    """Learn from the labelled documents that are not held out; rows without id, text or label are passed over.

    At most `per_language` rows a label are fitted on, by a hash of their ids; of rows that
    share an id, and of ties, by a hash of their texts. Empty texts and texts without a
    letter count for nothing, very long ones are read whole, an empty table gives a model
    that knows no language. Other columns are not read.
    """
    labelled = docs.select(F.col(f"`{id_column}`").alias("_id"), F.col(f"`{text_column}`").alias("text"), F.col(f"`{label_column}`").cast("string").alias("label"))
    labelled = labelled.where("_id IS NOT NULL AND text IS NOT NULL AND label IS NOT NULL").where(~held_out(F.col("_id")))

    def frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found, documents = np.zeros(BUCKETS, dtype=np.int64), 0
        for batch in batches:
            for text in batch["text"]:
                counts = counts_of(text)
                if counts is not None:
                    found += counts > 0
                    documents += 1
        where = np.flatnonzero(found)
        yield pd.DataFrame({"bucket": [-1, *where], "n": [documents, *found[where]]})

    rows = labelled.select("text").mapInPandas(frequencies, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    counted = {r["bucket"]: r["n"] for r in rows}
    documents = counted.pop(-1, 0)
    frequency = np.zeros(BUCKETS)
    frequency[list(counted)] = list(counted.values())
    idf = np.log((1 + documents) / (1 + frequency)) + 1

    # thinned by a hash first, within the scan, so that ranking within a language meets a
    # bounded number of rows; the model has a column a language, so their counts are few
    sizes = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count("*").alias("n")).collect()}
    shares = F.create_map(*[F.lit(x) for label, n in sizes.items() for x in (label, 4.0 * per_language / n)]) if sizes else None
    hashed = labelled.select("_id", "label", F.pmod(F.xxhash64(F.col("_id").cast("string")), F.lit(1 << 40)).alias("_order"))
    share = F.lit(0.0) if shares is None else shares[F.col("label")]
    thinned = hashed.where(F.col("_order") < F.lit(float(1 << 40)) * share)
    ranked = thinned.withColumn("_rank", F.row_number().over(Window.partitionBy("label").orderBy("_order", "_id")))
    chosen = materialize(ranked.where(F.col("_rank") <= per_language).select(F.col("_id").alias("_chosen"), "_order").distinct(), "language-sample")

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for order, label, text in zip(batch["_order"], batch["label"], batch["text"]):
                counts = counts_of(text)
                if counts is not None:
                    where = np.flatnonzero(counts)
                    out.append((order, label, where.astype("<i4").tobytes(), counts[where].astype("<i4").tobytes()))
            yield pd.DataFrame(out, columns=["order", "label", "buckets", "counts"])

    # an id that repeats brings all its rows back: the bound is on rows, ties by a hash of the text
    met = labelled.join(chosen, labelled["_id"] == chosen["_chosen"]).select("_order", "label", "text", F.xxhash64("text").alias("_tie"))
    of_label = Window.partitionBy("label").orderBy("_order", "_tie")
    sample = met.withColumn("_rank", F.row_number().over(of_label)).where(F.col("_rank") <= per_language).select("_order", "label", "text")
    rows = sample.mapInPandas(vectors, "order long, label string, buckets binary, counts binary").collect()
    rows.sort(key=lambda r: (r["order"], r["label"], bytes(r["buckets"])))
    languages = sorted({r["label"] for r in rows})
    found = []
    for r in rows:
        where, counts = np.frombuffer(r["buckets"], "<i4"), np.frombuffer(r["counts"], "<i4")
        value = (1 + np.log(counts)) * idf[where]
        found.append((where, value / max(np.sqrt(value @ value), 1e-12)))
    return fit(found, [languages.index(r["label"]) for r in rows], languages, idf)


def identify(docs: DataFrame, model: Model, text_column: str = "text") -> DataFrame:
    """`docs` with lang_pred and score: the likeliest learned language and its calibrated chance.

    Null texts and texts without a letter are `und` with score 0, as is everything if
    nothing could be learned. Texts are read whole, each row by itself; equal chances go to
    the first language by name. Columns of the same names are replaced; an empty table
    gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predicted(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([shared.value.predict(t) for t in texts], columns=["lang_pred", "score"])

    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("lang_pred", "score")]
    return docs.select(*kept, predicted(F.col(f"`{text_column}`")).alias("_p")).select(*kept, "_p.lang_pred", "_p.score")
