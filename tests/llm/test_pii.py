import hashlib
import re

from quern.llm import pii

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def passes(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 8 <= len(digits) <= 15


def brute(text):
    out = []
    for kind, pattern in BASE.items():
        if kind == "email" and "@" not in (text or ""):
            continue  # the plain pattern takes quadratic time
        for m in re.finditer(pattern, text or ""):
            if len(m[0]) < 10_000 and passes(kind, m[0]) or kind == "email":
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


TEXTS = [
    "mail a.b@c.de, x@y and z@w.org@q.com; a@b.cd_e@f.gh.",
    "1.2.3.4.5.6.7.8 and 256.1.1.1 then 1.1.1.256 007.8.9.0255 é 10.0.0.1",
    "4111 1111 1111 1111 and 4111-1111-1111-1112 4111111111111111! 4111  1111",
    "+1 (743) 555-3824, +49 30 1234567890123456 +1 2 +12345678.",
    "😀😀 q@r.st 😀 +1 (310) 555-4510",
    "call (310) 555-4510 or 310-555-4511",
    "",
]


def rows_of(df):
    return df.select(
        "doc_id", *[f"n_{k}" for k in pii.KINDS], pii.spelled(pii.F.col("base")).alias("base"), pii.spelled(pii.F.col("spans")).alias("spans")
    ).collect()


def test_base_spans_equal_brute_force(spark, docs):
    extra = spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    both = docs.select("doc_id", "text").unionByName(extra)
    texts = {r.doc_id: r.text for r in both.collect()}
    got = rows_of(pii.detect(both))
    assert len(got) == len(texts)
    found = 0
    for r in got:
        want = brute(texts[r.doc_id])
        assert r.base == ",".join(want), r.doc_id
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(w.startswith(k) for w in want) for k in pii.KINDS]
        assert set(want) <= set(r.spans.split(",")) or not want
        found += len(want)
    assert found > 20


def test_classifier_adds_wide_forms_only_beside_base(spark):
    texts = [f"tel (310) 555-{4000 + i} ok" for i in range(40)] + [f"call +1 (310) 555-{4000 + i}" for i in range(40)]
    texts += [f"id 9{i:03d}-555-0000-11" for i in range(30)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in rows_of(pii.detect(df))}
    assert all(got[i].spans == "phone:4:18" for i in range(40))
    assert all(got[40 + i].spans == "phone:5:22" and got[40 + i].base == got[40 + i].spans for i in range(40))


def test_query_digest(spark, sf):
    from quern.llm.queries import op3_weak_supervision_pii

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in op3_weak_supervision_pii(spark, sf).collect():
        assert r.base_sha256 == hashlib.sha256(",".join(brute(texts[r.doc_id])).encode()).hexdigest()


def test_odd_rows(odd_docs, no_docs):
    got = rows_of(pii.detect(odd_docs))
    want = sorted((str(r.doc_id), ",".join(brute(r.text))) for r in odd_docs.collect())
    assert sorted((str(r.doc_id), r.base) for r in got) == want
    assert pii.detect(no_docs).count() == 0


def test_redaction(spark, odd_docs):
    rows = [(1, "a x@y.zz b +1 (743) 555-3824"), (2, None), (2, "q"), (3, "1.2.3.4"), (3, "1.2.3.4")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "length(text) AS n_chars", "'k' AS key")
    got = sorted((r.doc_id, r.text or "", r.n_chars) for r in pii.redact(df).collect())
    assert got == [(1, "a [EMAIL] b [PHONE]", 19), (2, "", None), (2, "q", 1), (3, "[IP]", 4), (3, "[IP]", 4)]
    assert pii.redact(odd_docs).columns == odd_docs.columns
    assert pii.redact(odd_docs).count() == odd_docs.count()
