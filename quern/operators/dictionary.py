"""Dictionary taggers over text columns: one pass of an automaton over each text, then a choice among its hits.

The words of a dictionary are put in an Aho-Corasick automaton once a Python worker. It gives all places of all words in
time that grows with the text and the hits, whatever the size of the dictionary. The taggers differ in what they
choose of the hits.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.text import is_note_list

#: The regular English plural of a word, by its ending: the first rule that fits; None where there is none.
PLURALS = [(r"^(.+[^aeiou])y$", r"\1ies"), (r"s$", None), (r"(x|ch|sh)$", r"\1es"), (r"$", "s")]

#: The automata of this worker, by their words.
_built: dict[tuple[str, ...], ahocorasick.Automaton] = {}


def plurals(word: str) -> list[str]:
    """The regular plural of a word (of its last word, if it has several)."""
    made = next((re.sub(ending, plural, word, count=1) if plural else None) for ending, plural in PLURALS if re.search(ending, word))
    return [made] if made else []


class Hit(NamedTuple):
    start: int
    end: int
    number: int  # of the word in its dictionary


class Words:
    """A dictionary of words, each with a tag (None: a word that only takes its place)."""

    def __init__(self, entries: Iterable[tuple[str, str | None]], whole: bool = True):
        """The first entry of a word counts. ``whole``: words that have Latin letters stand without one beside them."""
        first: dict[str, str | None] = {}
        for word, tag in entries:
            if word:
                first.setdefault(word, tag)
        self.words, self.tags, self.whole = tuple(first), tuple(first.values()), whole

    def hits(self, text: str) -> list[Hit]:
        """Every place of every word in the text, as it is written."""
        if not self.words:
            return []
        if self.words not in _built:
            built = ahocorasick.Automaton()
            for number, word in enumerate(self.words):
                built.add_word(word, (number, len(word), re.search("[a-z]", word) is not None))
            built.make_automaton()
            _built[self.words] = built
        out = []
        for last, (number, size, latin) in _built[self.words].iter(text):
            start, end = last + 1 - size, last + 1
            if self.whole and latin and ("a" <= text[start - 1 : start] <= "z" or "a" <= text[end : end + 1] <= "z"):
                continue
            out.append(Hit(start, end, number))
        return out

    def chosen(self, hits: list[Hit], taken: Iterable[tuple[int, int]] = (), parts: bool = True) -> list[Hit]:
        """Long words before short ones (then by their number), each at its first place that is in no chosen or taken
        span. With ``parts`` a word is passed over if its tag is a part of a chosen tag."""
        spans, out, done = list(taken), [], set()
        for hit in sorted(hits, key=lambda h: (h.start - h.end, h.number, h.start)):
            tag = self.tags[hit.number]
            if hit.number in done or any(a <= hit.start and hit.end <= b for a, b in spans):
                continue
            if parts and any(tag in self.tags[h.number] for h in out):
                continue
            done.add(hit.number)
            spans.append((hit.start, hit.end))
            out.append(hit)
        return sorted(out)

    def outermost(self, hits: list[Hit]) -> list[Hit]:
        """The hits that lie in no other one, by their place."""
        out: list[Hit] = []
        for hit in sorted(hits, key=lambda h: (h.start, -h.end)):
            if not out or hit.end > out[-1].end:
                out.append(hit)
        return out


class WholeWords:
    """Tags of whole words in a text, longer words first: at most ``most``, in the text's order.

    A term may stand in its plural and under aliases (``forms``: both switched off, only the terms themselves). A term inside
    the span of another doesn't count, nor one whose tag is a part of a found tag ("stone" after "limestone"). ``notes``
    reads what the text is a list of, if it is one: its tags follow those of the words, by the same rule.
    """

    def __init__(self, terms: list[str], aliases: dict[str, str] | None = None, most: int = 6, forms: bool = True, notes: Notes | None = None):
        lower = {t.lower(): t for t in terms}
        entries = list(lower.items())
        if forms:
            entries += [(p, t) for k, t in lower.items() for p in plurals(k)]
            entries += [(k.lower(), lower[v.lower()]) for k, v in (aliases or {}).items() if v.lower() in lower]
        self.words, self.most, self.notes = Words(entries), most, notes

    def __call__(self, text: str | None, listed: bool = False) -> list[str]:
        low = (text or "").lower()
        tags = [self.words.tags[h.number] for h in self.words.chosen(self.words.hits(low))]
        if self.notes and listed:
            for tag in self.notes(text):
                if not any(tag in t for t in tags):
                    tags.append(tag)
        return tags[: self.most]


class AsWritten:
    """Tags of terms in prose as they are written: of hits that lie in one another the longest. In the order of first places."""

    def __init__(self, vocabulary: dict[str, str]):
        self.words = Words(vocabulary.items(), whole=False)

    def __call__(self, text: str | None, listed: bool = False) -> list[str]:
        return list(dict.fromkeys(self.words.tags[h.number] for h in self.words.outermost(self.words.hits(text or ""))))


class Notes:
    """Tags of terms anywhere in the notes of a list, in the list's order.

    A note's blanks are ignored. Longer terms come first; one inside an earlier hit or a blocked word doesn't count. A term of
    one letter must be the whole note.
    """

    def __init__(self, terms: list[str] | dict[str, str], blocked: list[str] | None = None, separators: str = r"[,;/·\n]"):
        tags = terms if isinstance(terms, dict) else {t: t for t in terms}
        self.short = {t: tag for t, tag in tags.items() if len(t) == 1}
        self.blocked = Words([(w, None) for w in blocked or []], whole=False)
        self.words = Words(sorted((x for x in tags.items() if len(x[0]) > 1), key=lambda x: x[0]), whole=False)
        self.separators = separators

    def __call__(self, text: str | None, listed: bool = False) -> list[str]:
        tags: dict[str, None] = {}
        for part in re.split(self.separators, (text or "").lower()):
            note = "".join(part.split())
            if note in self.short:
                tags.setdefault(self.short[note])
            taken = [h[:2] for h in self.blocked.hits(note)]
            for hit in self.words.chosen(self.words.hits(note), taken, parts=False):
                tags.setdefault(self.words.tags[hit.number])
        return list(tags)


def tag_text(df: DataFrame, key: str, text: str, tagger) -> DataFrame:
    """(key, tags): a tagger over a text column, which is told whether a text is a list of notes. NULL and empty texts have
    no tags."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"k": batch["k"], "tags": [tagger(t, l) for t, l in zip(batch["t"], batch["l"], strict=True)]})

    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("k"), F.col(text).alias("t"), F.coalesce(is_note_list(F.col(text)), F.lit(False)).alias("l"))
    return rows.mapInPandas(run, f"k {kind}, tags array<string>").withColumnRenamed("k", key)
