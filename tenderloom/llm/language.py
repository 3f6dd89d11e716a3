"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are the one- to three-character n-grams of the lower-case text, hashed to `DIMENSIONS` buckets and weighted by
(1 + ln tf) * idf with unit length. Document frequencies cover all training rows; each task adds up its own rows before
anything is shuffled. The regression is trained by follow-the-regularised-leader (per-coordinate steps, elastic-net
penalties) on at most `FIT_ROWS` rows of each language, those with the smallest hash of their id; a fifth of those of each
language is kept back to fit the softmax temperature. The model has at most `DIMENSIONS` times the number of languages weights, so it can
travel with the tasks, and a text is scored where it is read: whole, without a shuffle.

A null text and a text without a letter are `und` with score 0, and so is every text if there is nothing to learn from.
Training rows need text, a language and an id. With one language all other texts get it with score 1. Ties go to the
language first in the alphabet. Repeated rows count as often as they occur; extra columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenderloom.llm.common import bounded_batches, bucket_of
from tenderloom.session import frozen

DIMENSIONS = 1 << 15
FIT_ROWS = 1200
RANK_PARTS = 64
EPOCHS = 3
UNKNOWN = "und"


def _ngram_buckets(c: np.ndarray, starts: int) -> np.ndarray:
    """Buckets of the n-grams that begin at the first `starts` of the code points."""
    one = (c + np.uint32(1)) * np.uint32(2654435761)
    parts, gram = [one[:starts]], one
    for n in (1, 2):
        gram = (gram[:-1] ^ np.uint32(n)) * np.uint32(2246822519) + one[n:] if len(c) > n else gram[:0]
        parts.append(gram[:starts])
    mixed = np.concatenate(parts)
    mixed ^= mixed >> np.uint32(15)
    mixed *= np.uint32(2246822519)
    return (mixed >> np.uint32(17)).astype(np.int64)


def sparse_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, counts) of all n-grams. A very long text is worked on in pieces that see two code points further."""
    codes, size = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32), 1_000_000
    total = np.zeros(DIMENSIONS, np.int64)
    for at in range(0, len(codes), size):
        total += np.bincount(_ngram_buckets(codes[at:at + size + 2], size), minlength=DIMENSIONS)
    found = np.flatnonzero(total)
    return found, total[found]


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float

    def vector(self, found: np.ndarray, counts: np.ndarray) -> np.ndarray:
        x = (1 + np.log(counts)) * self.idf[found]
        norm = np.sqrt(x @ x)
        return x / norm if norm else x

    def scores(self, text: str) -> np.ndarray:
        found, counts = sparse_counts(text)
        return softmax(self.vector(found, counts) @ self.weights[found] / self.temperature)

    def predict(self, text: Column) -> Column:
        """struct<lang: string, score: double> of a text column."""
        model = self

        @F.pandas_udf("lang string, score double")
        def scored(texts: pd.Series) -> pd.DataFrame:
            langs, scores = [], []
            for text in texts:
                if text is None or not model.languages or not any(c.isalpha() for c in text):
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                p = model.scores(text)
                best = int(np.argmax(p))
                langs.append(model.languages[best])
                scores.append(float(p[best]))
            return pd.DataFrame({"lang": langs, "score": scores})

        return scored(text)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def follow_the_leader(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, alpha: float = 0.3, beta: float = 1.0,
                      l1: float = 0.05, l2: float = 0.01, epochs: int = EPOCHS) -> np.ndarray:
    """FTRL-proximal for multinomial logistic regression; rows are (buckets, values, class)."""
    z, n = np.zeros((DIMENSIONS, classes)), np.zeros((DIMENSIONS, classes))

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))

    for _ in range(epochs):
        for found, x, y in rows:
            zi, ni = z[found], n[found]
            w = weights(zi, ni)
            p = softmax(x @ w)
            p[y] -= 1.0
            g = x[:, None] * p
            grown = ni + g * g
            z[found] = zi + g - (np.sqrt(grown) - np.sqrt(ni)) / alpha * w
            n[found] = grown
    return weights(z, n)


def fitted_temperature(logits: np.ndarray, classes: np.ndarray) -> float:
    """The temperature of the smallest mean log loss, by golden-section search over its logarithm."""
    def loss(t: float) -> float:
        scaled = logits / np.exp(t)
        top = scaled.max(axis=1)
        return float(np.mean(top + np.log(np.exp(scaled - top[:, None]).sum(axis=1)) - scaled[np.arange(len(classes)), classes]))

    low, high, ratio = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def fit(docs: DataFrame, held_out: Column | None = None, fit_rows: int = FIT_ROWS, id_column: str = "doc_id",
        text_column: str = "text", lang_column: str = "lang") -> Model:
    """A model from the rows that have text, language and id and are not held out."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"), F.col(lang_column).alias("lang"))
    training = F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("id").isNotNull()
    if held_out is not None:
        training &= ~held_out
    rows = rows.where(training)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(DIMENSIONS, np.int64), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                total[sparse_counts(text)[0]] += 1
                seen += 1
        found = np.flatnonzero(total)
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([-1, *found.tolist()], pa.int64()), pa.array([seen, *total[found].tolist()], pa.int64())], names=["bucket", "n"])

    frequency = dict(rows.select("text").mapInArrow(frequencies, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect())  # DIMENSIONS rows at most
    everything = frequency.pop(-1, 0)
    idf = np.full(DIMENSIONS, np.log1p(everything) + 1)
    for bucket, n in frequency.items():
        idf[bucket] = np.log((1 + everything) / (1 + n)) + 1

    # ranked within parts of a language first, so that no task gets all ids of one; the first of all are among the first of a part
    key = F.xxhash64(F.col("id").cast("string"))
    ids = rows.select("id", "lang").distinct().withColumns({"key": key, "part": F.pmod(key, F.lit(RANK_PARTS))})
    for keys in (["lang", "part"], ["lang"]):
        ids = ids.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("key", "id"))).where(F.col("place") <= fit_rows)
    chosen = frozen(ids.select("id", "lang", "place"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [sparse_counts(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([f.astype("<u4").tobytes() for f, _ in counts]), pa.array([c.astype("<u4").tobytes() for _, c in counts])],
                names=["lang", "place", "buckets", "counts"])

    # bounded by the parameter: at most fit_rows ids per language
    sample = rows.join(F.broadcast(chosen), ["id", "lang"]).select("lang", "place", "text")
    sample = sample.mapInArrow(features, "lang string, place int, buckets binary, counts binary").collect()
    sample.sort(key=lambda r: (r["place"], r["lang"], r["buckets"], r["counts"]))
    languages = sorted({r["lang"] for r in sample})
    number = {lang: k for k, lang in enumerate(languages)}
    model = Model(languages, idf, np.zeros((DIMENSIONS, max(len(languages), 1))), 1.0)
    vectors = []
    for r in sample:
        found = np.frombuffer(r["buckets"], "<u4").astype(np.int64)
        vectors.append((found, model.vector(found, np.frombuffer(r["counts"], "<u4")), number[r["lang"]]))
    # every fifth place within each language, as places begin anew with every language
    back = [len(sample) >= 50 and r["place"] % 5 == 0 for r in sample]
    kept_back = [v for v, kept in zip(vectors, back) if kept]
    model.weights = follow_the_leader([v for v, kept in zip(vectors, back) if not kept], max(len(languages), 1))
    if kept_back:
        logits = np.array([x @ model.weights[found] for found, x, _ in kept_back])
        model.temperature = fitted_temperature(logits, np.array([y for _, _, y in kept_back]))
    return model


def identified(docs: DataFrame, buckets: int = 3, held_bucket: int = 1, id_column: str = "doc_id", text_column: str = "text",
               lang_column: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score; learns from the rows that are not held out."""
    model = fit(docs, F.coalesce(bucket_of("id", buckets) == held_bucket, F.lit(True)), id_column=id_column, text_column=text_column, lang_column=lang_column)
    rows = docs.select(F.col(id_column).alias("doc_id"), model.predict(F.col(text_column).cast("string")).alias("p"))
    held = F.coalesce(bucket_of("doc_id", buckets) == held_bucket, F.lit(False))
    return rows.select("doc_id", held.alias("held_out"), F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))


def accepted(docs: DataFrame, min_score: float = 0.4, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """The documents whose language is known with at least `min_score`, with all their columns."""
    model = fit(docs, id_column=id_column, text_column=text_column, lang_column=lang_column)
    rows = docs.select(F.struct(*docs.columns).alias("row"), model.predict(F.col(text_column).cast("string")).alias("p"))
    return rows.where((F.col("p.lang") != UNKNOWN) & (F.col("p.score") >= min_score)).select("row.*")
