"""Token ids of whole texts with a public word-BPE file, memoised by word.

The tokenizer drops white space and splits words before it merges, so a text's ids are its
white-space separated chunks' ids in turn. Each worker process keeps chunk -> packed ids; a chunk met
for the first time is taken apart once. Results equal ``Tokenizer.encode`` on the whole text
(tests/llm/test_packing.py compares them).
"""

from __future__ import annotations

import functools

import numpy as np
import regex

#: Entries of a memo: bounds a worker's memory, never the result. The frequent words come first, so a
#: full memo keeps what it has.
MEMO_ENTRIES = 300_000


#: What the tokenizer splits lower-cased text into.
PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Chunks of other characters (combining marks, odd white space, special tokens) go to the tokenizer whole.
PLAIN = regex.compile(r"[\x21-\x3B\x3D-\x7E\xA1-\u02FF]+")


def _byte_letters() -> dict[int, str]:
    """The printable letter by which byte-level BPE files write each byte."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [x for x in range(256) if x not in printable]
    return {x: chr(x) for x in printable} | {x: chr(256 + i) for i, x in enumerate(rest)}


class ChunkIds(dict):
    """chunk (bytes without ASCII white space) -> its ids, packed as little-endian uint32.

    The pieces of a chunk are in the same memo: a plain piece is taken apart to itself, so as a chunk it has the same ids.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()

    def __missing__(self, chunk: bytes) -> bytes:
        text = chunk.decode("utf-8", "replace")
        if PLAIN.fullmatch(text):
            ids = b"".join([self.piece(p) for p in PIECE.findall(text.lower())])
        else:
            ids = _packed(self.tokenizer.encode(text, add_special_tokens=False).ids)
        self._keep(chunk, ids)
        return ids

    def _keep(self, chunk: bytes, ids: bytes) -> None:
        if len(chunk) <= 64 and len(self) < MEMO_ENTRIES:
            self[chunk] = ids

    def piece(self, piece: str) -> bytes:
        spelled = piece.encode("utf-8")
        plain = PLAIN.fullmatch(piece)  # lower-casing can lead out of the plain characters
        ids = self.get(spelled) if plain else None
        if ids is None:
            ids = _packed([t.id for t in self.model.tokenize("".join([self.letters[x] for x in spelled]))])
            if plain:
                self._keep(spelled, ids)
        return ids


def _packed(ids: list[int]) -> bytes:
    return np.array(ids, dtype="<u4").tobytes()


@functools.cache
def chunk_ids(path: str) -> ChunkIds:
    """One memo a worker process and tokenizer file."""
    return ChunkIds(path)


def forget() -> None:
    """Free this worker's memos, for a step that needs no more ids; a later step that does fills them again."""
    chunk_ids.cache_clear()


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode(memo: ChunkIds, text: str | None) -> bytes:
    """The ids of a whole text, packed; NULL is the empty text."""
    if not text:
        return b""
    return b"".join([memo[w] for w in text.encode("utf-8").split()])
