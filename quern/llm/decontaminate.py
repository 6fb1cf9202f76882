"""Benchmark decontamination with a distributed positional inverted index, in DataFrame operations only.

The training texts are split into words once, into a staged table that counts, postings and lengths are taken
from. The windows of the test items are phrases. Their terms are counted over all training texts; the index
stores, for each phrase's two rarest terms, a posting per occurrence (term, document, position). The lists
of a phrase's two terms are shifted by the terms' offsets in the item and intersected, starting from
the rarest; what is left is compared word for word with the words stored beside the rarest term's
posting. The same lists give the proximity matches. Terms that are no phrase's rarest never enter the index, so an
index serves the item set its terms were chosen for; the table of words serves every set.

Documents are told apart by doc_id and a hash of their text, so copies do not meet in one list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import ascii_lower, fits, null_safe_key, sized, staged

WINDOW = 13
#: How far from its place in the phrase the second rarest term may stand in a proximity match.
SLOP = 8
#: Tables of test terms and phrases below so many bytes are broadcast; larger ones are joined by shuffles.
BROADCAST_BYTES = 64 << 20
#: Splits lower-cased texts into words.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text, A-Z in lower case; NULL has none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS, -1), "")


def tokenised(docs: DataFrame) -> DataFrame:
    """doc_id, key, n_words, w (the words) of every row of ``docs``, staged: the texts are split once."""
    key = null_safe_key(F.col("doc_id"), F.col("text"))
    split = docs.select("doc_id", key.alias("key"), words(F.col("text")).alias("w"))
    return staged(split.select("doc_id", "key", F.size("w").cast("long").alias("n_words"), "w"), "words")


def phrases(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item, at, phrase, size): the windows of each item, which are whole items if these are short.

    item is the id as a string ("" for NULL), at the window's offset in the item. Items with one id pool
    their windows; repeated rows count once; an item without words has none.
    """
    own = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words(F.col("text")).alias("w"))
    own = own.where(F.size("w") > 0).distinct()
    last = F.greatest(F.size("w") - window, F.lit(0))
    return own.select(
        F.xxhash64("item", "w").alias("text_of"), "item", F.explode(F.sequence(F.lit(0), last)).alias("at"), "w"
    ).select("text_of", "item", "at", F.slice("w", F.col("at") + 1, F.lit(window)).alias("phrase"))


def term_counts(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """Occurrences in all tokenised ``texts`` of each of ``terms`` (term)."""
    found = texts.select(F.explode("w").alias("term")).join(sized(terms, BROADCAST_BYTES), "term").groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    return terms.join(found, "term", "left").select("term", F.coalesce("n", F.lit(0)).alias("n"))


def rare_terms(items: DataFrame, texts: DataFrame, window: int = WINDOW) -> DataFrame:
    """Each phrase with its two rarest terms: (item, phrase, first, q1, second, q2).

    q1 and q2 are the terms' offsets in the phrase. A phrase of one word only has no second term.
    """
    own = staged(phrases(items, window), "phrases")
    distinct = own.select(F.explode("phrase").alias("term")).distinct()
    counts = staged(term_counts(texts, staged(distinct, "terms")), "counts")
    placed = own.select("text_of", "item", "at", "phrase", F.posexplode("phrase").alias("q", "term"))
    by_count = placed.join(sized(counts, BROADCAST_BYTES), "term").groupBy("text_of", "item", "at").agg(
        F.first("phrase").alias("phrase"), F.slice(F.sort_array(F.collect_list(F.struct("n", "term", "q"))), 1, WINDOW).alias("order")
    )
    first = F.col("order")[0]
    second = F.get(F.filter("order", lambda x: x["term"] != first["term"]), F.lit(0))
    return by_count.where(first["n"] > 0).select(
        "item", "phrase", first["term"].alias("first"), first["q"].alias("q1"), second["term"].alias("second"), second["q"].alias("q2")
    )


def positional_index(texts: DataFrame, terms: DataFrame, reach: int) -> DataFrame:
    """Postings of ``terms`` (term, wide): term, key, pos and, where ``wide``, the words around it.

    ``around`` holds the words from pos - reach to pos + reach, ``left`` how many of them precede it. Terms that are too
    many to broadcast meet bare postings (term, key, pos) by a shuffle; the words around those that are left
    are cut from the texts afterwards, so no posting travels with its text.
    """
    left = F.least(F.col("pos"), F.lit(reach))
    around = F.slice("w", F.col("pos") - left + 1, left + reach + 1)
    if fits(terms, BROADCAST_BYTES):
        placed = texts.select("key", "w", F.posexplode("w").alias("pos", "term")).join(F.broadcast(terms), "term")
        return placed.select("term", "key", "pos", left.alias("left"), F.when(F.col("wide"), around).alias("around"))
    bare = staged(texts.select("key", F.posexplode("w").alias("pos", "term")).join(terms, "term"), "bare")
    whole = texts.select("key", "w").dropDuplicates(["key"])
    wide = bare.where("wide").join(whole, "key").select("term", "key", "pos", left.alias("left"), around.alias("around"))
    none = F.lit(None).cast("array<string>")
    return wide.unionByName(bare.where("NOT wide").select("term", "key", "pos", left.alias("left"), none.alias("around")))


def index_of(texts: DataFrame, rare: DataFrame, window: int = WINDOW) -> DataFrame:
    """The staged postings of the phrases' two rarest terms (``rare_terms``)."""
    terms = (
        rare.select(F.col("first").alias("term"), F.lit(True).alias("wide"))
        .unionByName(rare.where("second is not null").select(F.col("second").alias("term"), F.lit(False).alias("wide")))
        .groupBy("term")
        .agg(F.max("wide").alias("wide"))
    )
    return staged(positional_index(texts, staged(terms, "indexed"), window - 1), "postings")


def shifted_lists(index: DataFrame, rare: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The lists of the phrases' first and second terms, shifted to where the phrase would start:
    (item, phrase_id, phrase, key, start, q1, left, around, second) and (phrase_id, key, start)."""
    spelled = rare.withColumn("phrase_id", F.xxhash64("phrase"))
    ones = staged(spelled.select("item", "phrase_id", "phrase", "first", "q1", "second"), "firsts")
    twos = staged(spelled.where("second is not null").select("phrase_id", "second", "q2").distinct(), "seconds")
    lists1 = index.where("around is not null").join(sized(ones, BROADCAST_BYTES), F.col("term") == F.col("first"))
    lists2 = index.join(sized(twos, BROADCAST_BYTES), F.col("term") == F.col("second"))
    return (
        lists1.select("item", "phrase_id", "phrase", "key", (F.col("pos") - F.col("q1")).alias("start"), "q1", "left", "around", "second"),
        lists2.select("phrase_id", "key", (F.col("pos") - F.col("q2")).alias("start")),
    )


def exact_matches(one: DataFrame, two: DataFrame) -> DataFrame:
    """(item, key, start, size): where in which document each phrase of ``shifted_lists`` stands."""
    on = ["phrase_id", "key", "start"]
    met = one.where("second is not null").join(two, on, "left_semi")
    alone = one.where("second is null").select(met.columns)
    at = F.col("left") - F.col("q1") + 1
    here = F.slice("around", F.greatest(at, F.lit(1)), F.size("phrase"))
    return met.unionByName(alone).where(at >= 1).where(here == F.col("phrase")).select("item", "key", "start", F.size("phrase").alias("size"))


def proximity_matches(one: DataFrame, two: DataFrame, slop: int = SLOP) -> DataFrame:
    """(item, key): documents in which two of a phrase's terms, its rarest, stand within ``slop`` words of where
    the phrase has them, in either direction. Contains every exact match of two or more terms."""
    step = slop + 1
    one = one.where("second is not null").select("item", "phrase_id", "key", "start")
    near = one.withColumn("cell", F.explode(F.array(*[F.floor(F.col("start") / step) + F.lit(d) for d in (-1, 0, 1)])))
    other = two.select("phrase_id", "key", F.floor(F.col("start") / step).alias("cell"), F.col("start").alias("other"))
    both = ["phrase_id", "key", "cell"]
    met = near.alias("a").join(
        other.alias("b"), [F.col(f"a.{c}") == F.col(f"b.{c}") for c in both] + [F.abs(F.col("start") - F.col("other")) <= slop], "left_semi"
    )
    return met.select("item", "key").distinct()


def _hits(one: DataFrame, two: DataFrame, slop: int) -> DataFrame:
    """Per document with a match: n_hit, the matched items and n_near, the items matched in proximity."""
    # overlapping windows of one document come out of few items: merge its intervals in order
    spans = F.sort_array(F.collect_set(F.struct(F.col("start"), (F.col("start") + F.col("size")).alias("end"))))
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("upto"), F.lit(0).alias("n")),
        lambda a, x: F.struct(
            F.greatest(a["upto"], x["end"]).alias("upto"),
            (a["n"] + F.greatest(x["end"] - F.greatest(a["upto"], x["start"]), F.lit(0))).alias("n"),
        ),
        lambda a: a["n"].cast("long"),
    )
    exact = exact_matches(one, two).groupBy("key").agg(spans.alias("spans"), F.sort_array(F.collect_set("item")).alias("items"))
    near = proximity_matches(one, two, slop).groupBy("key").agg(F.count(F.lit(1)).alias("n_near"))
    return exact.select("key", covered.alias("n_hit"), "items").join(near, "key", "full")


def contamination(docs: DataFrame, items: DataFrame, *, window: int = WINDOW, share: int = 20, slop: int = SLOP) -> DataFrame:
    """Per document: doc_id, key, n_words, n_hit, n_items, items, contaminated, n_near.

    ``docs`` has doc_id and text, ``items`` item_id and text. A word is hit if it lies in an occurrence of
    a ``window`` of an item; a document is contaminated if at least 1 / ``share`` of its words are hit. n_near
    counts the items with a proximity match, which doesn't contaminate. A NULL text has no words, a NULL item_id
    is listed as "", repeated documents are reported each, repeated items count once, other columns are ignored.
    Without items nothing is hit; an empty table of documents gives no rows.
    """
    texts = tokenised(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    rare = staged(rare_terms(items, texts, window), "rare")
    one, two = shifted_lists(index_of(texts, rare, window), rare)
    hits = staged(_hits(one, two, slop), "hits")
    out = texts.select("doc_id", "key", "n_words").join(hits, "key", "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    ids = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        "doc_id", "key", "n_words", n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), ids.alias("items"),
        ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"), F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
    )


def clean(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns."""
    bad = contamination(docs, items, **options).where("contaminated").select(F.col("key").alias("__bad")).distinct()
    keyed = docs.withColumn("__key", null_safe_key(F.col("doc_id").cast("long"), F.col("text")))
    return keyed.join(staged(bad, "bad"), F.col("__key") == F.col("__bad"), "left_anti").drop("__key")
