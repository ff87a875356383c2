"""Token ids of whole texts by a file of the tokenizers library, many words at a time.

A pre-tokenizer that works between white space gives a text the ids of its
chunks, where a chunk is white space with the word after it. Chunks repeat, so
each task looks them up and encodes only those it has not met lately.
"""

from __future__ import annotations

import os
import re
import sys
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np

if array("I").itemsize != 4 or sys.byteorder != "little":
    raise ImportError("token ids are kept as native little-endian 32-bit numbers")

_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_CHUNK = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")
#: What keeps a text from being cut at each single space and line end.
_ODD = tuple("\t\x0b\x0c\r\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")
_PAIRS = ("  ", " \n", "\n ", "\n\n")
#: Characters that libraries may or may not count as white space: such texts are encoded in one go.
_DOUBTFUL = ("\x1c", "\x1d", "\x1e", "\x1f")
#: Chunks kept by a worker (some 200 bytes each), and characters of a text cut at a time.
KEPT, PART = 1_000_000, 1 << 20
#: New chunks that are joined to one text for the library, which takes half the time of one by one.
JOINED = 100


def _whole(key: str) -> str:
    """The chunk of a key: itself after a carriage return or with its line end, else with a space before it."""
    return key[1:] if key[:1] == "\r" else key if key[:1] == "\n" else " " + key


@lru_cache(4)
def encoder(path: str, literal: bool = False) -> ChunkEncoder:
    """The encoder of this process for a tokenizer file, with the chunks met so far."""
    return ChunkEncoder(path, literal)


class ChunkEncoder:
    """Encodes texts as little-endian 32-bit ids; the same ids as the library's on the whole text.

    With ``literal`` the name of a special token in a text is text, the library's
    ``encode_special_tokens``; without, it is that token, as the library does by
    itself, and a text with an added token's name is encoded in one go.
    """

    def __init__(self, path: str, literal: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = literal
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.whole = (*_DOUBTFUL, *(t.content for t in added if not (literal and t.special)))
        self.known: dict[str, bytes] = {}
        self.aged: dict[str, bytes] = {}

    def _encode(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in found]

    def _learn(self, keys: set[str]) -> None:
        """Put chunks into ``known``. Those not met lately are encoded together."""
        missing = keys.difference(self.known)
        again = missing & self.aged.keys()
        self.known.update((k, self.aged[k]) for k in again)
        first, rest = [], []
        for key in missing - again:
            (first if key[:1] == "\r" else rest).append(key)
        if first:
            self.known.update(zip(first, self._encode(list(map(_whole, first)))))
        for at in range(0, len(rest), JOINED):
            self._learn_joined(rest[at : at + JOINED])

    def _learn_joined(self, keys: list[str]) -> None:
        """Encode chunks that begin with one white space end to end, and cut the ids where a chunk begins."""
        chunks = list(map(_whole, keys))
        found = self.tokenizer.encode("".join(chunks), add_special_tokens=False)
        begins = np.fromiter((b for b, _ in found.offsets), np.int64, len(found.ids))
        data, start = array("I", found.ids).tobytes(), 0
        for key, end in zip(keys, (4 * np.searchsorted(begins, list(accumulate(map(len, chunks))))).tolist()):
            self.known[key] = data[start:end]
            start = end

    def _ids(self, keys: list[str]) -> bytes:
        """Ids of chunks."""
        try:
            return b"".join(map(self.known.__getitem__, keys))
        except KeyError:
            self._learn(set(keys))
        ids = b"".join(map(self.known.__getitem__, keys))
        if len(self.known) > KEPT // 2:
            self.known, self.aged = {}, self.known
        return ids

    def _plain(self, text: str) -> bool:
        """Whether single spaces and line ends are all that separates words, and no added token is named."""
        return not (
            text[0] in " \n" or text[-1] in " \n" or any(c in text for c in _ODD + _PAIRS) or any(c in text for c in self.whole)
        )

    @staticmethod
    def _keys(text: str, first: bool = True) -> list[str]:
        """Keys of the chunks of a plain text, or of the rest of one from after a space."""
        keys = text.replace("\n", " \n").split(" ")
        if first:
            keys[0] = "\r" + keys[0]
        return keys

    def parts(self, text: str) -> Iterable[bytes]:
        """The ids of a text, some at a time for a long one."""
        if any(c in text for c in self.whole):
            yield self._encode([text])[0]
        elif self._plain(text):
            at = 0
            while True:
                end = text.find(" ", at + PART)
                end = len(text) if end < 0 else end
                yield self._ids(self._keys(text[at:end], at == 0))
                if end == len(text):
                    break
                at = end + 1
        else:
            keys = []
            for n, found in enumerate(_CHUNK.finditer(text), 1):
                keys.append("\r" + found.group())
                if n % PART == 0:
                    yield self._ids(keys)
                    keys = []
            yield self._ids(keys)

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text; none for null."""
        return b"".join(self.parts(text)) if text else b""

    def encode_all(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """Ids of whole texts in order, as ``encode``; new chunks of many texts are encoded together."""
        held, size = [], 0
        for text in texts:
            held.append(text)
            size += len(text or "")
            if size > PART:
                yield from self._some(held)
                held, size = [], 0
        yield from self._some(held)

    def _some(self, texts: list[str | None]) -> Iterator[bytes]:
        known, found, waiting, new = self.known, [], [], set()
        for text in texts:
            if text and len(text) <= PART and self._plain(text):
                keys = self._keys(text)
                try:
                    found.append(b"".join(map(known.__getitem__, keys)))
                except KeyError:
                    new.update(keys)
                    waiting.append((len(found), keys))
                    found.append(b"")
            else:
                found.append(self.encode(text))
                known = self.known
        self._learn(new)
        for at, keys in waiting:
            found[at] = self._ids(keys)
        return iter(found)
