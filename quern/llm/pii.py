"""Personal data by weak supervision, in DataFrame expressions only.

Candidate spans come from strict and from wider patterns. Five labelers (form, gazetteer, the characters
to the left and right, a cue word before) vote for, against or abstain. Expectation-maximisation over
the counts of vote patterns estimates the labelers' reliabilities, and a logistic span classifier is
fitted to its posteriors. The table of vote patterns has at most 3^5 rows a kind and form, whatever
the input, so both fits are folds over one array; the counts in it cover all candidates.

Spans of the strict patterns that pass their checks always stay. The classifier adds wider candidates
that overlap none of them. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import null_safe_key, staged

KINDS = ["email", "ip", "card", "phone"]

_LOCAL = "A-Za-z0-9._%+-"
#: The strict patterns. A match can start only where the run it begins with starts (or where the last
#: match ended), and repeats are possessive, so long runs are scanned once; the matches are the same.
STRICT = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Wider forms, whose spans the classifier decides on.
WIDE = {
    "email": rf"(?<![{_LOCAL}])[{_LOCAL}]{{1,64}}+ ?(?:\(at\)|\[at\]) ?[A-Za-z0-9-]{{1,63}}+(?: ?(?:\(dot\)|\[dot\]|\.) ?[A-Za-z0-9-]{{1,63}}+){{1,8}}+",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "phone": r"(?<![0-9+().-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
}
GUARDS = {"email": r"@|[\(\[]at[\)\]]", "ip": "[0-9A-Fa-f][.:][0-9A-Fa-f]", "card": "[0-9][0-9 -]", "phone": "[0-9][ ().0-9-]"}

#: Gazetteers: top-level domains, country calling codes, card issuers' first digits, special networks.
DOMAINS = "com|org|net|edu|gov|int|info|io|eu|de|fr|es|it|uk|us|at|ch|be|nl|pt|mx|ar|ca|br"
CALLING = "1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"
ISSUERS = "4|5[1-5]|2[2-7]|3[47]|6011|65|62|35"
CUES = {
    "email": r"mail|correo|courriel|contact|kontakt",
    "ip": r"\bip\b|host|server|address|adresse",
    "card": r"card|carte|karte|tarjeta|visa|credit",
    "phone": r"tel|phone|call|mobil|fon\b|tél",
}
LABELERS = 5
EM_STEPS, FIT_STEPS = 25, 60


def _pieces(text: Column, pattern: str, kind: int, wide: bool) -> Column:
    """Matches in order, each with the length of the text since the last one, and its surroundings."""
    between, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    zipped = F.arrays_zip(between.alias("before"), found.alias("match"), F.slice(between, 2, F.greatest(F.size(between) - 1, F.lit(0))).alias("after"))
    return F.transform(
        F.filter(zipped, lambda x: x["match"].isNotNull()),
        lambda x, i: F.struct(
            F.lit(kind).alias("kind"),
            F.lit(wide).alias("wide"),
            i.alias("i"),
            F.char_length(x["before"]).alias("gap"),
            x["match"].alias("match"),
            F.right(x["before"], F.lit(24)).alias("left"),
            F.left(x["after"], F.lit(1)).alias("right"),
        ),
    )


def candidates(docs: DataFrame) -> DataFrame:
    """A row per candidate span; a document without any has one row with a NULL kind.

    row_id tells rows apart (also repeated ones); it holds only within this staged table.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    none = F.array().cast(
        "array<struct<kind:int,wide:boolean,i:int,gap:int,match:string,left:string,right:string>>"
    )
    parts = []
    for k, kind in enumerate(KINDS):
        forms = [_pieces(text, STRICT[kind], k, False)]
        if kind in WIDE:
            forms.append(_pieces(text, WIDE[kind], k, True))
        parts.append(F.when(text.rlike(GUARDS[kind]), F.concat(*forms)).otherwise(none))
    rows = docs.select(
        F.monotonically_increasing_id().alias("row_id"),
        F.col("doc_id").cast("long").alias("doc_id"),
        null_safe_key(F.col("doc_id"), F.col("text")).alias("key"),
        F.concat(*parts).alias("found"),
    )
    return rows.select("row_id", "doc_id", "key", F.explode_outer("found").alias("x")).select(
        "row_id", "doc_id", "key", "x.*"
    )


def _luhn(digits: Column) -> Column:
    """Whether a digit string passes the Luhn check."""
    back = F.split(F.reverse(digits), "")
    value = lambda x, i: F.when(i % 2 == 0, x.try_cast("int")).otherwise(2 * x.try_cast("int") - F.when(x.try_cast("int") > 4, 9).otherwise(0))
    total = F.aggregate(F.transform(F.filter(back, lambda x: x != ""), value), F.lit(0), lambda a, x: a + x)
    return total % 10 == 0


def _vote(yes: Column, no: Column) -> Column:
    """2 for, 0 against, 1 abstains."""
    return F.when(yes, 2).when(no, 0).otherwise(1)


def labelled(cands: DataFrame) -> DataFrame:
    """Add start, end, base (a strict span that passes its checks), failed and the labelers' votes."""
    before = Window.partitionBy("row_id", "kind", "wide").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    m, kind = F.col("match"), F.col("kind")
    digits = F.regexp_replace(m, "[^0-9]", "")
    n = F.char_length(digits)
    bare = lambda x: F.ltrim(x, F.lit("0"))
    octets = F.transform(F.split(m, r"\."), lambda x: (F.char_length(bare(x)) <= 3) & (F.coalesce(bare(x).try_cast("int"), F.lit(0)) <= 255))
    passes = (
        F.when(kind == 0, F.lit(True))
        .when(kind == 1, F.forall(octets, lambda x: x))
        .when(kind == 2, F.when(n.between(16, 19), _luhn(digits)).otherwise(False))
        .otherwise(n.between(8, 15))
    )
    gazetteer = (
        F.when(kind == 0, _vote(m.rlike(rf"(?i)[.\)\] ](?:{DOMAINS})$"), ~m.rlike(r"[A-Za-z]{2,}$")))
        .when(kind == 1, _vote(~m.rlike(r"^(?:0|127|22[4-9]|2[3-5][0-9])\."), m.rlike(r"^(?:0|127|255)\.")))
        .when(kind == 2, _vote(digits.rlike(f"^(?:{ISSUERS})"), F.lit(False)))
        .otherwise(_vote(m.rlike(rf"^(?:\+(?:{CALLING})|\()"), F.lit(False)))
    )
    cue = F.lit(1)
    for k, name in enumerate(KINDS):
        cue = F.when(kind == k, F.when(F.col("left").rlike(f"(?iu){CUES[name]}"), 2).otherwise(1)).otherwise(cue)
    inside = r"[A-Za-z0-9_@]"
    out = (
        cands.withColumn("upto", F.sum(F.col("gap") + F.char_length("match")).over(before))
        .withColumn("start", (F.col("upto") - F.char_length("match")).cast("long"))
        .withColumn("end", F.col("upto").cast("long"))
        .withColumn("passes", F.coalesce(F.col("wide") | passes, F.lit(False)))
        .withColumn("base", F.coalesce(~F.col("wide") & F.col("passes"), F.lit(False)))
    )
    return out.select(
        "row_id", "doc_id", "key", "kind", "wide", "start", "end", "base", "passes",
        F.array(
            F.when(F.col("base"), 2).when(~F.col("passes"), 0).otherwise(1),
            gazetteer,
            _vote(~F.col("left").rlike(f"{inside}$"), F.col("left").rlike(f"{inside}$")),
            _vote(~F.coalesce(F.col("right"), F.lit("")).rlike(f"^{inside}"), F.col("right").rlike(f"^{inside}")),
            cue,
        ).alias("votes"),
    )


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _total(xs: Column, value) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + value(x))


def _sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def _em(patterns: Column) -> Column:
    """Log-odds weights of votes: [prior, labeler 0 voting 0, 1, 2, labeler 1 voting 0, ...]."""
    smooth = 0.5
    start = F.array(F.lit(0.0), *[F.lit(float(v - 1) * (2.0 if j == 0 else 1.0)) for j in range(LABELERS) for v in range(3)])

    def posterior(w: Column, x: Column) -> Column:
        odds = w[0]
        for j in range(LABELERS):
            odds = odds + F.element_at(w, F.lit(2 + 3 * j) + x["votes"][j])
        return _sigmoid(odds)

    def step(w: Column) -> Column:
        soft = F.transform(patterns, lambda x: F.struct((x["n"] * posterior(w, x)).alias("a"), x["n"].alias("n"), x["votes"].alias("votes")))

        def maximise(q: Column) -> Column:
            yes, every = _total(q, lambda x: x["a"]), _total(q, lambda x: x["n"])

            def weights(t: Column) -> Column:
                cells = [F.log((t["yes"] + smooth) / (t["every"] - t["yes"] + smooth))]
                for j in range(LABELERS):
                    for v in range(3):
                        here = lambda x, j=j, v=v: F.when(x["votes"][j] == v, x["a"]).otherwise(0.0)
                        there = lambda x, j=j, v=v: F.when(x["votes"][j] == v, x["n"] - x["a"]).otherwise(0.0)
                        cells.append(
                            F.log((_total(q, here) + smooth) / (t["yes"] + 3 * smooth))
                            - F.log((_total(q, there) + smooth) / (t["every"] - t["yes"] + 3 * smooth))
                        )
                return F.array(*cells)

            return _let(F.struct(yes.alias("yes"), every.alias("every")), weights)

        return _let(soft, maximise)

    return F.aggregate(F.sequence(F.lit(1), F.lit(EM_STEPS)), start, lambda w, _: step(w))


def _fit(rows: Column) -> Column:
    """Logistic regression of the posteriors on one-hot votes and form, by gradient steps."""
    size = 2 + 3 * LABELERS
    start = F.array(*[F.lit(0.0)] * size)

    def step(w: Column) -> Column:
        total = _total(rows, lambda x: x["n"]) + 1e-9
        errors = F.transform(rows, lambda x: F.struct((x["n"] * (x["p"] - _score(w, x["votes"], x["wide"]))).alias("e"), x["votes"].alias("votes"), x["wide"].alias("wide")))

        def descend(q: Column) -> Column:
            slope = [_total(q, lambda x: x["e"]), _total(q, lambda x: F.when(x["wide"], x["e"]).otherwise(0.0))]
            slope += [
                _total(q, lambda x, j=j, v=v: F.when(x["votes"][j] == v, x["e"]).otherwise(0.0))
                for j in range(LABELERS)
                for v in range(3)
            ]
            return F.array(*[0.999 * w[i] + 2.0 * s / total for i, s in enumerate(slope)])

        return _let(errors, descend)

    return F.aggregate(F.sequence(F.lit(1), F.lit(FIT_STEPS)), start, lambda w, _: step(w))


def _score(w: Column, votes: Column, wide: Column) -> Column:
    odds = w[0] + F.when(wide, w[1]).otherwise(0.0)
    for j in range(LABELERS):
        odds = odds + F.element_at(w, F.lit(3 + 3 * j) + votes[j])
    return _sigmoid(odds)


def train(spans: DataFrame) -> DataFrame:
    """kind, reliabilities (of the labelers) and weights (of the span classifier): a row a kind."""
    patterns = (
        spans.where("kind is not null")
        .groupBy("kind", "wide", "votes")
        .agg(F.count(F.lit(1)).cast("double").alias("n"))
        .groupBy("kind")
        .agg(F.sort_array(F.collect_list(F.struct("wide", "votes", "n"))).alias("patterns"))
    )
    em = patterns.withColumn("reliabilities", _em(F.col("patterns")))

    def soft(x: Column) -> Column:
        odds = F.col("reliabilities")[0]
        for j in range(LABELERS):
            odds = odds + F.element_at("reliabilities", F.lit(2 + 3 * j) + x["votes"][j])
        return F.struct(x["wide"].alias("wide"), x["votes"].alias("votes"), x["n"].alias("n"), _sigmoid(odds).alias("p"))

    return em.withColumn("patterns", F.transform("patterns", soft)).select(
        "kind", "reliabilities", _fit(F.col("patterns")).alias("weights")
    )


def detect(docs: DataFrame) -> DataFrame:
    """Spans of personal data: a row per document with n_* (strict spans a kind) and the span lists.

    base and spans are arrays of struct(kind, start, end) in order, kind as an index into ``KINDS``;
    spans has base and the classifier's additions. A NULL text is empty, a NULL doc_id stays NULL,
    repeated rows are reported each, other columns are ignored, an empty table gives no rows. ``key``
    identifies equal rows (doc_id and text).
    """
    spans = staged(labelled(candidates(docs)), "spans")
    model = staged(train(spans), "model")  # at most a row a kind
    scored = spans.join(F.broadcast(model.select("kind", "weights")), "kind", "left").withColumn(
        "likely", F.coalesce(F.col("wide") & F.col("passes") & (_score(F.col("weights"), F.col("votes"), F.col("wide")) >= 0.5), F.lit(False))
    )
    span = F.struct("kind", F.col("start"), F.col("end"))
    of_row = scored.groupBy("row_id", "doc_id", "key").agg(
        F.sort_array(F.collect_list(F.when(F.col("base"), span))).alias("base"),
        F.sort_array(F.collect_list(F.when(F.col("likely"), span))).alias("wide"),
    )
    apart = lambda y: F.forall("base", lambda x: (x["end"] <= y["start"]) | (x["start"] >= y["end"]))
    of_kind = lambda k: F.filter("base", lambda x: x["kind"] == k)
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    added = F.when(F.size("wide") > 0, F.filter("wide", apart)).otherwise(F.col("wide"))
    return of_row.select(
        "row_id", "doc_id", "key", *counts, "base", F.sort_array(F.concat("base", added)).alias("spans")
    )


def spelled(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda x: F.concat_ws(":", names[x["kind"]], x["start"].cast("string"), x["end"].cast("string"))), ","
    )


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every detected span replaced by its kind in brackets, and n_chars counted anew.

    Overlapping spans are replaced as one, under the first one's kind. Documents without a candidate
    character never leave their task.
    """
    guard = F.coalesce(F.col("text").rlike("|".join(GUARDS.values())), F.lit(False))
    maybe = docs.where(guard).withColumn("__key", null_safe_key(F.col("doc_id"), F.col("text")))
    found = (
        detect(docs.where(guard).select("doc_id", "text"))
        .where(F.size("spans") > 0)
        .groupBy(F.col("key").alias("__found"))
        .agg(F.first("spans").alias("__spans"))  # equal rows have equal spans
    )
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    by_start = F.sort_array(F.transform("__spans", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))
    begin = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))

    def take(a: Column, x: Column) -> Column:
        length = (x["start"] - a["at"]).cast("int")
        parts = F.array(F.substring(F.col("text"), (a["at"] + 1).cast("int"), length), names[x["kind"]])
        return F.when(x["start"] < a["at"], F.struct(F.greatest(a["at"], x["end"]).alias("at"), a["out"].alias("out"))).otherwise(
            F.struct(x["end"].alias("at"), F.concat(a["out"], parts).alias("out"))
        )

    rest = lambda a: F.concat(F.array_join(a["out"], ""), F.substring(F.col("text"), (a["at"] + 1).cast("int"), F.char_length("text")))
    text = F.when(F.col("__spans").isNull(), F.col("text")).otherwise(F.aggregate(by_start, begin, take, rest))
    clean = maybe.join(found, F.col("__key") == F.col("__found"), "left").withColumn("text", text).select(*docs.columns)
    out = docs.where(~guard).unionByName(clean)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out
