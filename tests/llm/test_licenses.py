import random

from quern.llm import licenses


def brute_increasing(xs):
    best = [1] * len(xs)
    for i in range(len(xs)):
        best[i] = 1 + max([best[j] for j in range(i) if xs[j] < xs[i]], default=0)
    return max(best, default=0)


def test_longest_increasing_subsequence():
    rng = random.Random(1)
    for _ in range(200):
        xs = rng.sample(range(50), rng.randint(0, 20))
        got = [xs[i] for i in licenses.increasing(xs)]
        assert got == sorted(got) and len(got) == brute_increasing(xs)


def test_patience_matches_are_an_alignment():
    rng = random.Random(2)
    for _ in range(200):
        a = [rng.choice("abcdefgh") for _ in range(rng.randint(0, 15))]
        b = [rng.choice("abcdefgh") for _ in range(rng.randint(0, 15))]
        pairs = licenses.patience(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:], strict=False))
    assert licenses.patience(list("abc"), list("abc")) == [(0, 0), (1, 1), (2, 2)]


def unique_in_both(a, b):
    return {w for w in a if a.count(w) == 1 and b.count(w) == 1}


def test_alignment_is_complete_and_longest():
    """No gap of an alignment holds a word that is unique in both of its sides, and where words of both whole
    lists are unique (and the ends don't match), a longest increasing run of them is matched."""
    rng = random.Random(5)
    for _ in range(300):
        a = ["<"] + [rng.choice("abcdefghijkl") for _ in range(rng.randint(0, 14))] + ["("]
        b = [">"] + [rng.choice("abcdefghijkl") for _ in range(rng.randint(0, 14))] + [")"]
        pairs = licenses.patience(a, b)
        edges = [(-1, -1), *pairs, (len(a), len(b))]
        for (i, j), (k, m) in zip(edges, edges[1:], strict=False):
            assert not unique_in_both(a[i + 1 : k], b[j + 1 : m])
        anchors = unique_in_both(a, b)
        order = [b.index(w) for w in a if w in anchors]
        assert sum(a[i] in anchors for i, _ in pairs) == brute_increasing(order)


def plain_matches(a, b):
    """Words of a longest common subsequence: what no alignment can exceed."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], (last + 1 if x == y else max(row[j], row[j - 1]))
    return row[-1]


PROBES = {
    "CC BY 3.0": "cc-by-3.0",
    "Licensed under CC BY-ND 4.0": "cc-by-nd-4.0",
    "Licensed under CC BY-NC-SA 4.0": "cc-by-nc-sa-4.0",
    "Licensed under the Apache License, Version 1.1": "apache-1.1",
    "This work is licensed under the GNU GPL, version 2": "gpl-2.0",
    "Licensed under the GNU Lesser GPL, version 3": "lgpl-3.0",
    "Released under the BSD License": "bsd",
    "Released under the XYZ License": None,
    "Licensed under CC BY-XX 9.0": None,
    "Licensed under the Apache License": None,
    "This work is licensed under the GNU General Public License, version 3.": "gpl-3.0",
    "Released under the GNU General Public License v2": "gpl-2.0",
    "GNU Affero General Public License, version 3": "agpl-3.0",
    "Licensed under the Apache License, Version 2.0.": "apache-2.0",
    "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License": "cc-by-sa-4.0",
    "licensed under a Creative Commons Attribution 4.0 International License": "cc-by-4.0",
    "The public license of the town was under review in version one": None,
}


def test_versions_and_kin_are_told_apart():
    scanner = licenses.Scanner(licenses.TEMPLATES)
    got = {text: (x := scanner(f"Some words. {text} More words follow.")) and x[0] for text in PROBES}
    assert got == PROBES


def test_every_template_is_found_whole_or_changed():
    rng = random.Random(3)
    scanner = licenses.Scanner(licenses.TEMPLATES)
    filler = "stone river window garden morning paper candle letter".split()
    for t in licenses.TEMPLATES:
        own = t.text.split()
        for changes in (0, len(own) // 12):
            words = list(own)
            free = [i for i, w in enumerate(words) if not set(licenses.words_of(w)) & {*t.needs}]
            for i in rng.sample(free, min(changes, len(free))):
                words[i] = rng.choice(filler)
            text = " ".join(rng.choices(filler, k=30) + words + rng.choices(filler, k=30))
            found = scanner(text)
            assert found is not None and found[0] == t.license, (t, text, found)
            region = licenses.words_of(text)[found[3] : found[4]]
            assert found[2] <= max(plain_matches(licenses.words_of(x.text), region) for x in licenses.TEMPLATES if x.license == t.license)
        for need in t.needs:  # without what tells it apart it is another licence or none
            text = " ".join(w for w in licenses.words_of(t.text) if w != need)
            assert (x := scanner(text)) is None or x[0] != t.license or need not in text.split()


def test_notices_with_inserted_words():
    scanner = licenses.Scanner(licenses.TEMPLATES)
    text = "Licensed under the Apache License (hereinafter called the License for short), Version 2.0"
    assert scanner(text) == ("apache-2.0", 1.0, 7, 0, 13)
    rng = random.Random(4)
    for t in licenses.TEMPLATES[::4]:
        own = licenses.words_of(t.text)
        for _ in range(2):
            words = [f"x{rng.random()}".replace(".", "") for _ in range(rng.randint(0, 300))]
            for w in own:
                words += [w, *(f"y{k}" for k in range(rng.choice([0, 0, 0, len(own)])))]
            words += ["z"] * rng.randint(0, 300)
            if len(licenses.patience(own, words)) == len(own):
                alone = licenses.Scanner([t])
                assert alone(" ".join(words))[:3] == (t.license, 1.0, len(own))


def test_all_notices_of_a_text(spark):
    by = {}
    for t in licenses.TEMPLATES:
        if len(t.text) > len(by.get(t.license, "")):
            by[t.license] = t.text
    header = by["apache-2.0"].replace("writing", "ink").replace("CONDITIONS", "TERMS")
    parts = [("cc-by-4.0", "Licensed under CC BY 4.0"), ("apache-2.0", header)]
    parts += [(k, by[k]) for k in ("mit", "bsd-3-clause", "mit", "cc-by-nc-4.0", "gpl-3.0")]
    between = " some other words of the work "
    docs = spark.createDataFrame(
        [(1, between.join(x for _, x in parts)), (2, "none"), (3, parts[0][1])], "doc_id long, text string"
    )
    got = {r.doc_id: r for r in licenses.scan(docs).collect()}
    assert [x.license for x in got[1].notices] == [k for k, _ in parts]
    assert all(x.end_word <= y.start_word for x, y in zip(got[1].notices, got[1].notices[1:], strict=False))
    assert got[1].license == "bsd-3-clause" and got[2].notices == [] and got[2].license is None
    assert [tuple(x) for x in got[3].notices] == [tuple(got[3])[1:6]] == [("cc-by-4.0", 1.0, 5, 0, 5)]


def test_documents(spark, sf, odd_docs, no_docs):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in licenses.scan(docs).collect()}
    notices = {"Apache License, Version 2.0": "apache-2.0", "Released under the MIT License": "mit", "CC BY-NC 4.0": "cc-by-nc-4.0"}
    checked = 0
    for r in docs.collect():
        for phrase, name in notices.items():
            if phrase in r.text:
                assert got[r.doc_id].license == name
                checked += 1
    assert checked > 5 and len(got) == docs.count()
    odd = licenses.scan(odd_docs)
    assert odd.count() == odd_docs.count() and odd.where("license is not null").count() == 0
    assert licenses.scan(no_docs).count() == 0
