"""Encoding of whole texts by a public tokenizer, each distinct chunk between spaces only once."""

from __future__ import annotations

import os
import re
from array import array
from itertools import accumulate, chain

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

from tokenizers import Tokenizer  # noqa: E402

#: Distinct chunks of a generation. A worker remembers two: when the young one is full it becomes
#: the old one, and what is still used moves over.
REMEMBERED = 500_000

_ODD_SPACE = re.compile(r" (?=\s|\Z)")
_BEFORE_WORD = re.compile(r"(?= \S)")


def load(path: str) -> Tokenizer:
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


class _Generation(dict):
    """Chunk to number; ids[at[number]:at[number + 1]] are its token ids."""

    def __init__(self) -> None:
        self.fresh: list = []
        self.ids, self.at = array("I"), array("q", [0])

    def __missing__(self, key):
        number = self[key] = len(self)
        self.fresh.append(key)
        return number

    def add(self, codes: list) -> None:
        self.ids.extend(chain.from_iterable(codes))
        self.at.extend(accumulate(map(len, codes), initial=self.at.pop()))


class ChunkEncoder:
    """Token ids of texts, equal to the library's on the whole text.

    A text may be cut before a space that a non-space follows: no pre-token of the supported
    tokenizers reaches over that place. A byte-level vocabulary keeps the space with the word
    behind it (``keep_space``); a word vocabulary drops white space, and any space will do.
    """

    def __init__(self, path: str, keep_space: bool) -> None:
        self.tokenizer, self.keep_space = load(path), keep_space
        self.young, self.old = _Generation(), _Generation()
        self.tokens: list[str] = []

    def _learn(self) -> None:
        young, old = self.young, self.old
        keys, young.fresh = young.fresh, []
        for first in range(0, len(keys), 8192):
            part = keys[first : first + 8192]
            codes: list = [None] * len(part)
            unknown = []
            for k, key in enumerate(part):
                number = old.get(key)
                if number is None:
                    unknown.append(k)
                else:
                    codes[k] = old.ids[old.at[number] : old.at[number + 1]]
            texts = [part[k] for k in unknown]
            if self.keep_space:
                texts = [t[0] if isinstance(t, tuple) else f" {t}" for t in texts]
            for k, code in zip(unknown, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
                codes[k] = code.ids
            young.add(codes)

    def _numbers(self, text: str):
        look = self.young.__getitem__
        if not self.keep_space:
            return map(look, text.split(" "))
        if _ODD_SPACE.search(text) is None:
            parts = text.split(" ")
            parts[0] = (parts[0],)
            return map(look, parts)
        parts = _BEFORE_WORD.split(text)
        return map(look, [p[1:] if k else (p,) for k, p in enumerate(parts)])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets per text)."""
        if len(self.young) > REMEMBERED:
            self.young, self.old = _Generation(), self.young
        numbers, chunks = array("q"), [0]
        for text in texts:
            if text:
                numbers.extend(self._numbers(text))
            chunks.append(len(numbers))
        self._learn()
        if not len(numbers):
            return np.zeros(0, np.uint32), np.zeros(len(chunks), np.int64)
        number = np.frombuffer(numbers, dtype=np.int64)
        at = np.frombuffer(self.young.at, dtype=np.int64)
        first = at[number]
        count = at[number + 1] - first
        before = np.concatenate([[0], np.cumsum(count)])
        picked = np.repeat(first - before[:-1], count) + np.arange(before[-1])
        ids = np.frombuffer(self.young.ids, dtype=np.uint32)[picked] if len(picked) else np.zeros(0, np.uint32)
        del at
        return ids, before[np.array(chunks)]

    def decode(self, codes: list[np.ndarray]) -> list[str]:
        """Texts of ids as the library's decode gives them with special tokens kept.

        Without a decoder the library puts the tokens together with spaces, which a list of
        the vocabulary does as well.
        """
        if self.tokenizer.decoder is not None:
            return self.tokenizer.decode_batch([c.tolist() for c in codes], skip_special_tokens=False)
        if not self.tokens:
            size = max(self.tokenizer.get_vocab(with_added_tokens=True).values(), default=-1) + 1
            self.tokens = [self.tokenizer.id_to_token(k) or "" for k in range(size)]
        return [" ".join(map(self.tokens.__getitem__, c.tolist())) for c in codes]


_encoders: dict[tuple, ChunkEncoder] = {}


def encoder(path: str, keep_space: bool) -> ChunkEncoder:
    """The worker's encoder for this vocabulary; it is kept from task to task."""
    key = (path, keep_space)
    if key not in _encoders:
        _encoders[key] = ChunkEncoder(path, keep_space)
    return _encoders[key]
