"""Public tokenizer vocabularies, opened by path in the worker.

The path is always a parameter; a bare file name is looked up with `public_tokenizers.path`.

Byte-level files of either library hold the same thing, bytes with ranks, so both are run by the quicker
one; texts that hold a special token's string go to the file's own library. Nothing is remembered between
texts but the words of a `WordTable`, whose number is bounded.
"""

from __future__ import annotations

import base64
import json
import os
import re
from functools import cache, cached_property

import numpy as np
import xxhash

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Words that a worker's table remembers before it starts anew; some 300 bytes each.
MEMORY = 150_000
#: A space only ever opens a token or stands in a run of white space, so a text may be cut here.
_CUT = re.compile(r"(?<=\S)(?= )")
#: Longer texts are encoded part by part.
LONG_TEXT = 2_000_000


def long_parts(text: str):
    """A long text in parts, cut at token boundaries; a part without one stays whole."""
    at = 0
    while at < len(text):
        cut = _CUT.search(text, min(at + LONG_TEXT // 2, len(text)))
        end = cut.start() if cut and cut.start() > at else len(text)
        yield text[at:end]
        at = end


def resolve(path: str) -> str:
    if os.path.sep in path:
        return path
    import public_tokenizers

    return public_tokenizers.path(path)


def _named_bytes() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary's names: itself if it prints, else one from 256 up."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in prints]
    return {chr(b): b for b in prints} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteLevel:
    """Ids of a byte-level BPE file (.json or .tiktoken), equal to its own library's for whole texts."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        self._place = resolve(path)
        self._special: list[str] = []
        if self._place.endswith(".json"):
            with open(self._place, encoding="utf-8") as f:
                held = json.load(f)
            of = _named_bytes()
            names, merges = held["model"]["vocab"], held["model"]["merges"]
            self._special = [x["content"] for x in held["added_tokens"]]
            ranks = {bytes(map(of.__getitem__, name)): i for name, i in names.items() if name not in self._special}
            if [names["".join(m if isinstance(m, list) else m.split(" "))] for m in merges] != list(range(256, 256 + len(merges))):
                raise ValueError(f"{self._place}: ids don't follow the order of merges")
        else:
            with open(self._place, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self._ranks = ranks
        self._ordinary = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self._spaced = np.zeros(max(ranks.values()) + 1, np.bool_)
        self._spaced[[i for name, i in ranks.items() if name.startswith(b" ")]] = True

    @cached_property
    def plain(self):
        """text -> ids, by the file's own library."""
        if not self._place.endswith(".json"):
            return self._ordinary
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(self._place)
        return lambda text: own.encode(text, add_special_tokens=False).ids

    def together(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, end of each word's ids) of words that start with a space and hold no other."""
        ids = np.array(self._ordinary("".join(words)), np.uint32)
        starts = np.flatnonzero(self._spaced[ids])
        if len(starts) != len(words):  # some other space-led token: one by one
            each = [self._ordinary(w) for w in words]
            return np.array([i for x in each for i in x], np.uint32), np.cumsum([len(x) for x in each])
        return ids, np.append(starts[1:], len(ids))

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian uint32."""
        if any(x in text for x in self._special):
            return np.array(self.plain(text), "<u4").tobytes()
        if len(text) <= LONG_TEXT:
            return np.array(self._ordinary(text), "<u4").tobytes()
        return b"".join(np.array(self._ordinary(part), "<u4").tobytes() for part in long_parts(text))

    def tokens(self) -> list[bytes]:
        """The bytes of each id; ids of special tokens have none."""
        out = [b""] * (max(self._ranks.values()) + 1)
        for name, i in self._ranks.items():
            out[i] = name
        return out

    def encode_plain(self, text: str) -> bytes:
        """As `encode`, but special tokens' strings are ordinary text."""
        parts = [text] if len(text) <= LONG_TEXT else long_parts(text)
        return b"".join(np.array(self._ordinary(part), "<u4").tobytes() for part in parts)

    def encode_all(self, texts: list[str]) -> list[bytes]:
        return [self.encode(t) for t in texts]


@cache
def byte_level(path: str) -> ByteLevel:
    return ByteLevel(path)


@cache
def pieces(path: str):
    """(encode, byte-fallback flags by id) of a sentencepiece file."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=resolve(path))
    return p.encode, np.array([p.is_byte(i) for i in range(p.vocab_size())])


class WordTable(dict):
    """word (bytes) -> row number; per row its hash, its token counts and its byte-vocabulary ids.

    `rows` numbers words, and `learn` then measures those that are new, together.
    """

    def __init__(self, byte_vocabulary: str, piece_vocabulary: str):
        super().__init__()
        self._bytes, (self._pieces, self._fallback) = byte_level(byte_vocabulary), pieces(piece_vocabulary)
        self._new: list[bytes] = []
        self.hash = np.zeros(0, np.uint64)
        self.n_pieces = self.n_fallback = self.n_ids = self.first = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        self._new.append(word)
        return n

    def rows(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))

    def learn(self) -> None:
        if not self._new:
            return
        words, self._new = self._new, []
        texts = [w.decode("utf-8", "replace") for w in words]
        own = self._pieces(texts, num_threads=1)
        n_pieces = np.fromiter(map(len, own), np.int64, len(own))
        flat = np.fromiter((i for x in own for i in x), np.int64, int(n_pieces.sum()))
        edge = np.append(0, np.cumsum(self._fallback[flat]))
        ends = np.cumsum(n_pieces)
        n_fallback = edge[ends] - edge[ends - n_pieces]
        ids, stops = [], []
        for lo in range(0, len(texts), 5000):
            got, end = self._bytes.together([" " + t for t in texts[lo : lo + 5000]])
            ids.append(got)
            stops.append(np.diff(end, prepend=0))
        n_ids = np.concatenate(stops)
        first = len(self.ids) + np.cumsum(n_ids) - n_ids
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
        self.ids = np.concatenate([self.ids, *ids])
        for name, value in (("hash", hashes), ("n_pieces", n_pieces), ("n_fallback", n_fallback), ("n_ids", n_ids), ("first", first)):
            setattr(self, name, np.concatenate([getattr(self, name), value]))

    def forget(self) -> None:
        """Start anew if too much is remembered; earlier row numbers no longer hold."""
        if len(self) > MEMORY:
            self.clear()
            self._new = []
            self.hash = np.zeros(0, np.uint64)
            self.n_pieces = self.n_fallback = self.n_ids = self.first = np.zeros(0, np.int64)
            self.ids = np.zeros(0, np.uint32)

    def ids_of(self, rows: np.ndarray) -> np.ndarray:
        """The byte-vocabulary ids of these words, in order."""
        n = self.n_ids[rows]
        ends = np.cumsum(n)
        return self.ids[np.repeat(self.first[rows] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]


@cache
def word_table(byte_vocabulary: str, piece_vocabulary: str) -> WordTable:
    return WordTable(byte_vocabulary, piece_vocabulary)
