"""The automaton's taggers against plain scans of every word."""

import random
import re

from quern.operators import dictionary as D


def scan(words, text, whole):
    """Every place of every word, by looking at every place."""
    out = []
    for n, w in enumerate(words.words):
        for i in range(len(text) - len(w) + 1):
            if text[i : i + len(w)] != w:
                continue
            beside = text[max(i - 1, 0) : i] + text[i + len(w) : i + len(w) + 1]
            if not (whole and re.search("[a-z]", w) and re.search("[a-z]", beside)):
                out.append((i, i + len(w), n))
    return sorted(out)


def choose(words, text):
    """Words one after another, long ones first, each with its own search of the text."""
    order = sorted(range(len(words.words)), key=lambda n: (-len(words.words[n]), n))
    found = []
    for n in order:
        if any(words.tags[n] in words.tags[m] for *_, m in found):
            continue
        for i, j, _ in [h for h in scan(words, text, True) if h[2] == n]:
            if not any(a <= i and j <= b for a, b, _ in found):
                found.append((i, j, n))
                break
    return sorted(found)


def test_hits_and_choices_equal_scans():
    rng = random.Random(6)
    for _ in range(400):
        vocabulary = {"".join(rng.choice("ab 가나") for _ in range(rng.randrange(1, 5))) for _ in range(rng.randrange(0, 9))}
        entries = [(w, rng.choice([w, "ab", "b", "tag"])) for w in sorted(vocabulary)]
        text = "".join(rng.choice("ab 가나x") for _ in range(rng.randrange(60)))
        for whole in (True, False):
            words = D.Words(entries, whole)
            assert sorted(map(tuple, words.hits(text))) == scan(words, text, whole)
        words = D.Words(entries)
        assert [tuple(h) for h in words.chosen(words.hits(text))] == choose(words, text)
        loose = D.Words(entries, whole=False)
        hits = scan(loose, text, False)
        inside = [h for h in hits if any(a <= h[0] and h[1] <= b and (a, b) != h[:2] for a, b, _ in hits)]
        assert {tuple(h)[:2] for h in loose.outermost(loose.hits(text))} == {h[:2] for h in hits if h not in inside}


def test_forms_can_be_switched_off_and_lists_are_read():
    terms, aliases = ["berry", "blueberry", "floral"], {"orange blossom": "floral", "mint": "none"}
    notes = D.Notes({"블루베리": "blueberry", "꽃": "floral", "밤": "chestnut"}, ["밤양갱"])
    tag = D.WholeWords(terms, aliases, notes=notes)
    assert tag("Berries and orange blossom") == ["berry", "floral"]
    assert D.WholeWords(terms, aliases, forms=False)("Berries and orange blossom, berry") == ["berry"]
    assert tag("berry, 블루 베리, 꽃, 밤양갱", True) == ["berry", "blueberry", "floral"] and tag("berry, 꽃") == ["berry"]
    assert tag("blueberry, 블루베리", True) == ["blueberry"]
    assert D.WholeWords(terms, aliases, most=1, notes=notes)("berry, 꽃", True) == ["berry"]
    assert D.WholeWords([])("berry") == [] and tag(None, True) == [] and D.Notes([])("x") == []
    assert D.Notes(["밤", "밤나무"])("밤, 밤나무 / 밤밤") == ["밤", "밤나무"]


def test_automata_are_built_once(spark):
    big = [f"w{i:05d}" for i in range(20_000)]
    tag = D.WholeWords(big, forms=False, most=3)
    text = " ".join(f"w{i:05d}" for i in range(19_990, 20_010))
    assert tag(text) == ["w19990", "w19991", "w19992"]
    built = D._built[tag.words.words]
    assert D.WholeWords(big, forms=False)("w00000") == ["w00000"] and D._built[tag.words.words] is built
    df = spark.createDataFrame([(1, text), (2, None), (3, "w00007, w00007x")], "k long, t string")
    assert sorted((r.k, r.tags) for r in D.tag_text(df, "k", "t", tag).collect()) == [(1, ["w19990", "w19991", "w19992"]), (2, []), (3, ["w00007"])]
