"""Quality rules with divergence from language references.

Two histograms of a text, of its character classes and of its language's most common words, are compared
with the language's own, by Jensen-Shannon distance (base 2). The references are counted over all texts of
the table. A histogram of too few characters or words says nothing and passes; a histogram of n words over
k bins lies about sqrt(k / (8 n ln 2)) from its own source by chance, which the word rules allow for. All
common words in one bin are compared too, which shorter texts suffice for.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import pieces, staged

SYMBOLS = b"#*$%&|<>"
COMMON_WORDS = 100
MIN_WORDS, REPEATED = 50, 0.5
#: Guards: below so many code points, or words, a histogram isn't compared.
MIN_CHARS, MIN_COMPARED = 200, 100
#: From so many words, the shares of common words as a whole are compared.
MIN_POOLED = 40
MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE, MAX_SHARE_DISTANCE = 0.29, 0.25, 0.16
#: Languages whose references a pass over the texts holds; more languages take more passes.
PASS_LANGUAGES = 1000
#: Distinct words a task holds before it passes its counts on, looked at after each of ``pieces``.
HELD_WORDS = 200_000

#: Class of each byte that starts a code point; other bytes continue one. One class each for lower case,
#: upper case, digits, blanks, line ends, sentence marks, quotes and brackets, symbols, controls, and for
#: the blocks that lead bytes tell apart (Latin letters, Greek to Arabic, other two-byte, CJK and other three-byte,
#: four-byte).
CLASSES = 14
_CONTINUES = CLASSES


def _class_table() -> bytes:
    table = []
    for x in range(256):
        c = chr(x)
        if x < 128:
            table.append(
                0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3 if c in " \t" else 4 if c in "\n\r"
                else 5 if c in ".,;:!?-'" else 6 if c in "\"()[]{}`" else 8 if x < 32 or x == 127 else 7
            )
        else:
            table.append(
                _CONTINUES if x < 0xC0 else 9 if x < 0xCA else 10 if 0xCD <= x < 0xDC else 11 if x < 0xE0 else 12 if x < 0xF0 else 13
            )
    return bytes(table)


CLASS_OF = _class_table()
_NOT_WORD_CHARS = bytes([*range(0x80, 0xC0), 0x20, *range(0x09, 0x0E)])


def class_counts(text: bytes) -> np.ndarray:
    """Code points of each class."""
    return np.bincount(np.frombuffer(text.translate(CLASS_OF), dtype=np.uint8), minlength=CLASSES + 1)[:CLASSES]


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found twice or more in the text."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    often = Counter(windows)
    covered, upto = 0, 0
    for i, w in enumerate(windows):
        if often[w] > 1:
            covered += i + 3 - max(i, upto)
            upto = i + 3
    return covered


def repeated_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def basics(text: bytes, words: list[bytes]) -> tuple[int, int, int, int, int, bool]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    n = len(words)
    repeats = repeated_words(words)
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    chars = len(text.translate(None, _NOT_WORD_CHARS))
    return n, chars, symbols, repeated_lines(text), repeats, n < MIN_WORDS or repeats > REPEATED * n


def js_distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance, 0 to 1, of two histograms (made to sum to one)."""
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        a = np.where(p > 0, p * np.log2(p / m), 0).sum()
        b = np.where(q > 0, q * np.log2(q / m), 0).sum()
    return float(np.sqrt(max(0.0, (a + b) / 2)))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, class, word, n): partial counts of classes and lower-cased words."""
    words: dict[str, Counter] = defaultdict(Counter)
    classes: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(CLASSES, dtype=np.int64))

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, counter in words.items():
            if counter:
                yield _rows([lang] * len(counter), [None] * len(counter), list(counter), list(counter.values()))
        words.clear()
        for lang, counts in classes.items():
            yield _rows([lang] * CLASSES, list(range(CLASSES)), [None] * CLASSES, counts.tolist())
        classes.clear()

    for batch in pieces(batches):
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if lang is None or not text:
                continue
            raw = text.encode("utf-8")
            classes[lang] += class_counts(raw)
            words[lang].update(raw.lower().split())
        if sum(map(len, words.values())) > HELD_WORDS:
            yield from flush()
    yield from flush()


def _rows(*columns: list) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int32(), pa.binary(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["lang", "class", "word", "n"])


def references(docs: DataFrame, common: int = COMMON_WORDS) -> DataFrame:
    """lang, class, word, n: each language's class counts, its ``common`` most frequent words with a letter
    (ties by the word) and, under a NULL word and class, its number of words. Counted over all rows that have
    a language and a text."""
    counts = staged(
        docs.select(F.col("lang").cast("string"), "text").mapInArrow(_count, "lang string, class int, word binary, n long")
        .groupBy("lang", "class", "word").agg(F.sum("n").alias("n")),
        "counts",
    )
    words = counts.where("word is not null")
    spoken = words.where(F.col("word").cast("string").rlike(r"\p{L}"))  # a bar or a dash is no common word
    # a first cut inside hash buckets leaves at most 64 * common words a language to rank together
    bucket = F.pmod(F.xxhash64("word"), F.lit(64))
    order = [F.col("n").desc(), F.col("word")]
    cut = spoken.withColumn("r", F.row_number().over(Window.partitionBy("lang", bucket).orderBy(*order))).where(F.col("r") <= common)
    top = cut.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("r") <= common).drop("r")
    total = words.groupBy("lang").agg(F.sum("n").alias("n")).select(
        "lang", F.lit(None).cast("int").alias("class"), F.lit(None).cast("binary").alias("word"), "n"
    )
    return counts.where("class is not null").unionByName(top).unionByName(total)


Tables = dict[str, tuple[np.ndarray, dict[bytes, int], np.ndarray]]


def _tables(rows: list) -> Tables:
    """lang -> class histogram, index of its common words, histogram of these and all others."""
    by: dict[str, list] = defaultdict(list)
    for r in rows:
        by[r["lang"]].append(r)
    out = {}
    for lang in sorted(by):
        classes = np.zeros(CLASSES)
        words = sorted(((bytes(r["word"]), r["n"]) for r in by[lang] if r["word"] is not None), key=lambda x: (-x[1], x[0]))
        total = sum(r["n"] for r in by[lang] if r["word"] is None and r["class"] is None)
        for r in by[lang]:
            if r["class"] is not None:
                classes[r["class"]] = r["n"]
        if classes.sum() and words:
            counts = np.array([n for _, n in words] + [max(total - sum(n for _, n in words), 0)], dtype=float)
            out[lang] = (classes, {w: i for i, (w, _) in enumerate(words)}, counts)
    return out


Verdict = tuple[float | None, float | None, bool]
#: Nothing to compare with: kept.
UNJUDGED: Verdict = (None, None, True)


def _nearness(x: Verdict) -> tuple[bool, float]:
    return not x[2], (x[0] or 0) + (x[1] or 0)


class Judge:
    """Scores texts against language references."""

    def __init__(self, tables: dict, max_char: float, max_word: float, max_share: float):
        self.tables, self.max_char, self.max_word, self.max_share = tables, max_char, max_word, max_share

    def distances(self, raw: bytes, words: list[bytes], lang: str) -> Verdict:
        """Distance of classes and of words (None: guarded), and whether both are within bounds."""
        classes, index, common = self.tables[lang]
        own = class_counts(raw)
        by_char = js_distance(own, classes) if own.sum() >= MIN_CHARS else None
        by_word, near = None, True
        if len(words) >= MIN_POOLED:
            k, n = len(index), len(words)
            get = index.get
            hist = np.bincount([get(w, k) for w in words], minlength=k + 1)
            by_word = js_distance(_pooled(hist), _pooled(common))
            near = by_word**2 <= self.max_share**2 + _chance(1, n)
            if n >= MIN_COMPARED:
                by_word = js_distance(hist, common)
                near = near and by_word**2 <= self.max_word**2 + _chance(k, n)
        fine = near and (by_char is None or by_char <= self.max_char)
        return by_char, by_word, bool(fine)

    def __call__(self, raw: bytes, words: list[bytes], lang: str | None) -> Verdict:
        """The text against its language's reference or, without a language, the nearest of all."""
        lowered = [w.lower() for w in words] if not raw.islower() else words
        if lang is not None:
            return self.distances(raw, lowered, lang)
        return min((self.distances(raw, lowered, x) for x in self.tables), key=_nearness, default=UNJUDGED)


def _chance(bins: int, n: int) -> float:
    """The squared distance that n draws lie from their own source by chance."""
    return bins / (8 * n * float(np.log(2)))


def _pooled(hist: np.ndarray) -> np.ndarray:
    """All common words as one bin, and the rest."""
    return np.array([hist[:-1].sum(), hist[-1]], dtype=float)


MEASURES = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long,"
    " base_failed boolean, char_distance double, word_distance double, kept boolean"
)
MEASURE_NAMES = [x.split()[0] for x in MEASURES.split(",")]
_KINDS = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.float64(), pa.bool_()]


def _blocks(docs: DataFrame, common: int) -> list[Tables]:
    """The references of all languages, ``PASS_LANGUAGES`` to a block."""
    told = staged(references(docs, common), "references")
    names = [r["lang"] for r in told.where("class is not null").select("lang").distinct().orderBy("lang").collect()]
    out = []
    for at in range(0, len(names), PASS_LANGUAGES):
        part = names[at : at + PASS_LANGUAGES]
        of_block = told if len(names) <= PASS_LANGUAGES else told.where(F.col("lang").between(part[0], part[-1]))
        out.append(_tables(of_block.collect()))
    return [tables for tables in out if tables]


def _measured(docs: DataFrame, kept: list[str], names: list[str], blocks: list[Tables], bounds: tuple[float, float, float]) -> DataFrame:
    """The columns ``kept`` of ``docs`` and the measures under ``names``: one pass for each block of languages.

    Inside, columns have numbers for names, so that carried ones may be called anything.

    A labelled text is judged in its language's block. One without a reference takes the nearest of all, so
    it goes through every block with the nearest so far; the first pass measures, and blocks that follow only
    look again at texts that are still open.
    """
    extra = len(kept)
    at = {c: i for i, c in enumerate(kept)}
    known = [set(b) for b in blocks]
    of_block = lambda lang: next((i for i, k in enumerate(known) if lang in k), None)

    def passed(rows: DataFrame, turn: int, tables: Tables) -> DataFrame:
        judge = Judge(tables, *bounds)
        text_at, lang_at = (at["text"], at["lang"]) if "text" in at and "lang" in at else (extra, extra + 1)
        first = len(rows.columns) - (0 if turn == 0 else len(names))
        columns_out = [*rows.columns[:first], *MEASURE_NAMES]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in pieces(batches):
                before = list(zip(*(batch.column(first + i).to_pylist() for i in range(len(names))), strict=True)) if turn else None
                out = []
                for i, (text, lang) in enumerate(zip(batch.column(text_at).to_pylist(), batch.column(lang_at).to_pylist(), strict=True)):
                    raw = (text or "").encode("utf-8")
                    words = raw.split()
                    own = None if lang is None else of_block(str(lang))
                    said = before[i] if before else (*basics(raw, words), *UNJUDGED)
                    if not said[5] and (own is None or own == turn):
                        verdict = judge(raw, words, None if own is None else str(lang)) if tables else UNJUDGED
                        if turn and own is None:
                            verdict = min((said[6], said[7], said[8]), verdict, key=_nearness)
                        said = (*said[:6], *verdict)
                    out.append(said)
                columns = list(zip(*out, strict=True)) or [[]] * len(names)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i) for i in range(first)), *(pa.array(c, t) for c, t in zip(columns, _KINDS, strict=True))],
                    columns_out,
                )

        fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:first]]
        return rows.mapInArrow(run, ", ".join([*fields, MEASURES]))

    # carried columns cross to Python once, also the text and the language
    read = [F.col(f"`{c}`") for c in kept]
    if "text" not in at or "lang" not in at:
        read += [F.col("text"), F.col("lang")]
    rows = docs.select(*read).toDF(*[f"c{i}" for i in range(len(read))])
    for turn, tables in enumerate(blocks or [{}]):
        rows = passed(rows, turn, tables)
    own = [F.col(f"c{i}").alias(c) for i, c in enumerate(kept)]
    measures = [F.col(m).alias(n) for m, n in zip(MEASURE_NAMES[:8], names, strict=False)]
    return rows.select(*own, *measures, (F.col("kept") & ~F.col("base_failed")).alias(names[8]))


def judged(
    docs: DataFrame, *, common: int = COMMON_WORDS,
    max_char: float = MAX_CHAR_DISTANCE, max_word: float = MAX_WORD_DISTANCE, max_share: float = MAX_SHARE_DISTANCE,
) -> DataFrame:
    """doc_id and the measures of every row of ``docs`` (doc_id, text, lang).

    A NULL text is empty and so fails the length rule. A row without a language, or of one that has no
    reference, is kept if any language's reference is near enough (and if there is none at all). There are
    common + 15 reference rows a language, which go with the tasks in blocks of ``PASS_LANGUAGES``. Repeated
    rows are judged each, an empty table gives no rows, other columns are ignored.
    """
    return _measured(docs, ["doc_id"], MEASURE_NAMES, _blocks(docs, common), (max_char, max_word, max_share))


def accepted(
    docs: DataFrame, *, common: int = COMMON_WORDS,
    max_char: float = MAX_CHAR_DISTANCE, max_word: float = MAX_WORD_DISTANCE, max_share: float = MAX_SHARE_DISTANCE,
) -> DataFrame:
    """The rows of ``docs`` that ``judged`` keeps, with all their columns, whatever these are named."""
    prefix = "_"
    while any(f"{prefix}{n}" in docs.columns for n in MEASURE_NAMES):
        prefix += "_"
    names = [f"{prefix}{n}" for n in MEASURE_NAMES]
    rows = _measured(docs, docs.columns, names, _blocks(docs, common), (max_char, max_word, max_share))
    return rows.where(F.col(f"`{names[8]}`")).select(*[F.col(f"`{c}`") for c in docs.columns])
