"""Language identification with a string kernel.

k(x, y) is the cosine of two texts' blended spectra: which byte n-grams of lengths 1 to 3 occur at all,
hashed into ``BUCKETS`` buckets. Landmark texts give Nyström features, and one ridge regression per
language is fitted to them, one versus the rest. A batch of texts is scored by three matrix products.

Every language is learned. The classifier is fitted on at most about ``per_language`` labelled texts of each and
about ``sample_rows`` in all (but ``LEAST_ROWS`` a language), chosen by a hash of their ids; the regressions'
normal equations are summed by Spark, so what reaches the driver is the landmarks, a fixed number of Gram
matrices and one vector a language. Scoring reads every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import staged

BUCKETS = 1 << 13
#: Texts of a language, texts in all, and texts of a language however many there are.
PER_LANGUAGE, SAMPLE_ROWS, LEAST_ROWS = 400, 25_600, 8
#: Landmarks in all, dealt to the languages in turn.
LANDMARKS = 320
RIDGE = 1e-2
UNKNOWN = "und"
#: Tasks that sum the normal equations: so many Gram matrices reach the driver.
SUMMING_TASKS = 16
_LETTER = regex.compile(r"\p{L}")
_SHIFT = np.uint32(32 - 13)


def spectrum(text: bytes, out: np.ndarray) -> None:
    """Set to one the buckets of all n-grams of a text (ASCII letters lower-cased)."""
    a = np.frombuffer(text.lower(), dtype=np.uint8).astype(np.uint32)
    grams = a
    for n in (1, 2, 3):
        if n > 1:
            grams = grams[:-1] * np.uint32(256) + a[n - 1 :]
        if len(grams):
            out[((grams + np.uint32(n << 24)) * np.uint32(2654435761)) >> _SHIFT] = 1


def kernel(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosines of the rows of two presence matrices."""
    size = np.sqrt(np.maximum(x.sum(axis=1), 1))[:, None] * np.sqrt(np.maximum(y.sum(axis=1), 1))[None, :]
    return (x @ y.T) / size


def unpacked(bits: list[bytes]) -> np.ndarray:
    """Presence matrix of packed spectra."""
    rows = [np.unpackbits(np.frombuffer(b, dtype=np.uint8)) for b in bits]
    return np.array(rows, dtype=np.float32).reshape(len(rows), BUCKETS)


class Nystroem:
    """Features of a text: its kernel with the landmarks, whitened, at unit length, and a constant."""

    def __init__(self, marks: np.ndarray):
        self.marks = marks.astype(np.float32)
        values, vectors = np.linalg.eigh(kernel(self.marks, self.marks).astype(np.float64)) if len(marks) else (np.zeros(0), np.zeros((0, 0)))
        kept = values > 1e-6
        self.whiten = (vectors[:, kept] / np.sqrt(values[kept])).astype(np.float32)

    def __getstate__(self) -> tuple:
        return np.packbits(self.marks.astype(np.uint8), axis=1), self.whiten

    def __setstate__(self, state: tuple) -> None:
        self.marks = np.unpackbits(state[0], axis=1).astype(np.float32).reshape(len(state[0]), BUCKETS)
        self.whiten = state[1]

    @property
    def size(self) -> int:
        return self.whiten.shape[1] + 1

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = kernel(x.astype(np.float32), self.marks) @ self.whiten
        z = z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)
        return np.concatenate([z, np.ones((len(z), 1), dtype=z.dtype)], axis=1)


class Model:
    """The features and one regression per language.

    ``means`` are the languages' mean features. With each language weighing the same, the right side
    of a language's normal equations is twice its mean less the sum of all means.
    """

    def __init__(self, features: Nystroem, langs: list[str], gram: np.ndarray, means: np.ndarray, ridge: float = RIDGE):
        self.features, self.langs = features, langs
        right = 2 * means - means.sum(axis=0, keepdims=True)
        self.weights = np.linalg.solve(gram + ridge * np.eye(features.size), right.T).astype(np.float32)

    def __call__(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of each row's language, and its margin as a score from 0 to 1."""
        scores = self.features(x) @ self.weights
        best = scores.argmax(axis=1)
        return best, np.clip((scores[np.arange(len(best)), best] + 1) / 2, 0, 1)


def _training(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, bits, ones): the spectra of each text and of two short pieces of it."""
    for batch in batches:
        langs, bits, ones = [], [], []
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if not text or not _LETTER.search(text):
                continue
            words = text.split()
            pieces = [text, " ".join(words[len(words) // 3 :][:12]), " ".join(words[len(words) // 2 :][:4])]
            for piece in pieces:
                row = np.zeros(BUCKETS, dtype=np.uint8)
                spectrum(piece.encode("utf-8"), row)
                langs.append(lang)
                bits.append(np.packbits(row).tobytes())
                ones.append(int(row.sum()))
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(bits, pa.binary()), pa.array(ones, pa.int32())], ["lang", "bits", "ones"])


def _summed(features: Nystroem):
    """Sums over rows (lang, bits, weight), sorted by lang: each language's weighted features, and under a NULL
    language the weighted Gram matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram = np.zeros((features.size, features.size))
        lang, mean, any_row = None, np.zeros(features.size), False
        done: list[tuple[str | None, bytes]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            any_row = True
            langs = batch.column(0).to_pylist()
            z = features(unpacked(batch.column(1).to_pylist())).astype(np.float64)
            weighted = z * batch.column(2).to_numpy(zero_copy_only=False)[:, None]
            gram += z.T @ weighted
            for k, row in zip(langs, weighted, strict=True):
                if k != lang:
                    if lang is not None:
                        done.append((lang, mean.tobytes()))
                    lang, mean = k, np.zeros(features.size)
                mean = mean + row
        if any_row:
            done += [(lang, mean.tobytes()), (None, gram.tobytes())]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], pa.string()), pa.array([v for _, v in done], pa.binary())], ["lang", "sums"])

    return run


def learn(
    docs: DataFrame, lang: str = "lang", per_language: int = PER_LANGUAGE, sample_rows: int = SAMPLE_ROWS, landmarks: int = LANDMARKS
) -> Model:
    """Fit on ``docs`` (doc_id, text, ``lang``): every language, a bounded sample of each by hash of the id.

    Rows without an id, text, letter or language are not learned from. Landmarks are the richest spectra
    of the languages in turn, ``landmarks`` in all.
    """
    rows = docs.select(F.col(lang).cast("string").alias("lang"), "doc_id", "text").where("lang is not null and doc_id is not null and text is not null")
    counts = staged(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "languages")
    many = counts.count()
    each = max(LEAST_ROWS, min(per_language, sample_rows // max(many, 1)))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    upto = F.least(F.lit(1.0), each / F.col("n")) * (1 << 30)
    chosen = rows.join(counts, "lang").where(place < upto).select("lang", "text")
    sample = staged(chosen.mapInArrow(_training, "lang string, bits binary, ones int"), "sample")
    turn = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("ones"), "bits"))
    marks = sample.withColumn("turn", turn).orderBy("turn", "lang").limit(landmarks).select("bits").collect()
    features = Nystroem(unpacked([bytes(r["bits"]) for r in marks]))
    sizes = sample.groupBy("lang").agg((1 / F.count(F.lit(1))).alias("weight"))
    weighed = sample.join(sizes, "lang").select("lang", "bits", "weight")
    dealt = weighed.repartition(SUMMING_TASKS, "lang").sortWithinPartitions("lang", "bits")
    langs, means, gram = [], [], np.zeros((features.size, features.size))
    for r in sorted(dealt.mapInArrow(_summed(features), "lang string, sums binary").collect(), key=lambda r: (r["lang"] is None, r["lang"] or "", bytes(r["sums"]))):
        sums = np.frombuffer(bytes(r["sums"]))
        if r["lang"] is None:
            gram += sums.reshape(gram.shape)
        else:
            langs.append(r["lang"])
            means.append(sums)
    return Model(features, langs, gram, np.array(means).reshape(len(langs), features.size))


def predict(docs: DataFrame, model: Model, *kept: Column, batch: int = 256) -> DataFrame:
    """lang_pred and score of every row of ``docs`` (text), with the columns ``kept``.

    A NULL text or one without a letter is ``und`` with score 0, as is every text if nothing was
    learned. The model goes with the tasks: the landmarks, and a vector for each language.
    """
    rows = docs.select(*kept, F.col("text").alias("__text"))
    names = rows.columns[:-1]
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = np.zeros((batch, BUCKETS), dtype=np.float32)
        for rows in batches:
            texts = rows.column(len(names)).to_pylist()
            langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
            told = [i for i, t in enumerate(texts) if t and model.langs and _LETTER.search(t)]
            for at in range(0, len(told), batch):
                part = told[at : at + batch]
                x[: len(part)] = 0
                for k, i in enumerate(part):
                    spectrum(texts[i].encode("utf-8"), x[k])
                best, score = model(x[: len(part)])
                for i, b, s in zip(part, best.tolist(), score.tolist(), strict=True):
                    langs[i], scores[i] = model.langs[b], s
            yield pa.RecordBatch.from_arrays(
                [*(rows.column(i) for i in range(len(names))), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                [*names, "lang_pred", "score"],
            )

    return rows.mapInArrow(run, ", ".join([*fields, "lang_pred string", "score double"]))
