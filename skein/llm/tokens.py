"""Token ids of whole texts from the tokenizers library, in which each chunk between spaces is encoded once.

Both pre-tokenizers used here end a piece before a space that a visible character follows, and before and after a line end
between visible characters, so a text falls apart there and equal chunks get equal ids. Texts with runs of white space, for
which that can't be said, and those that may hold one of the vocabulary's added tokens, such as <|endoftext|>, go to the
library whole. As add_special_tokens=False alone asks for, such a token in a text gives its own id.
"""

from __future__ import annotations

import os
import re
from array import array
from functools import lru_cache

#: Chunks in each of a worker's two generations; when the younger is full, it takes the place of the elder.
CACHE = 450_000

#: Letters below this code point are letters for every version of Unicode, and normal forms of themselves.
_PLAIN = "\u0250"

_HARD = re.compile(r"\s\s|\x00")
_CONTROLS = re.compile("[\x1c-\x1f]")


def _byte_letters() -> dict[int, str]:
    """How byte-level vocabularies spell bytes: printable ones as themselves, all others from U+0100 on in their order."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = (b for b in range(256) if b not in printable)
    return {b: chr(b) for b in printable} | {b: chr(0x100 + k) for k, b in enumerate(hidden)}


class ChunkEncoder:
    """`byte_level`: spaces belong to the pieces after them; otherwise white space is dropped."""

    def __init__(self, path: str, cache: int = CACHE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        # What all added tokens begin with, before the first letter, whose case a normaliser may change.
        self.mark = re.match("[^A-Za-z]*", os.path.commonprefix(added))[0] if added else None
        self.byte_level = self.tokenizer.normalizer is None
        self.tokenize, self.letters = self.tokenizer.model.tokenize, _byte_letters()
        self.packed = [k.to_bytes(4, "little") for k in range(self.tokenizer.get_vocab_size())]
        self.marks = {x: self._packed([x])[0] for x in ".,"}
        self.limit, self.cache, self.elder = cache, {}, {}

    def chunks(self, text: str) -> list[str] | None:
        """The chunks of a text; None if only the library can split it."""
        if self.mark is not None and self.mark in text:
            return None
        if self.byte_level:
            if _HARD.search(text):
                return None
            return text.replace(" ", "\x00 ").replace("\n", "\x00\n\x00").split("\x00")
        return None if _CONTROLS.search(text) else text.split()

    def _packed(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", x.ids).tobytes() for x in found]

    def _learn(self, chunks: set[str]) -> list[str]:
        """Remembers the chunks that are one word of plain letters and a full stop or comma at most, and returns the others.

        Such a word goes to the library's model directly, spelt as its pre-tokenizer would spell it.
        """
        tokenize, letters, marks, cache, packed, byte_level = self.tokenize, self.letters, self.marks, self.cache, self.packed, self.byte_level
        space, hard = letters[32], []
        for chunk in chunks:
            mark = marks.get(chunk[-1:])
            word = chunk if mark is None else chunk[:-1]
            if not byte_level:
                word = word.lower()
            body = word[1:] if byte_level and word[:1] == " " else word
            if not body.isalpha():
                hard.append(chunk)
                continue
            if word.isascii():
                spelt = word.replace(" ", space)
            elif max(body) < _PLAIN:
                spelt = word.encode().decode("latin-1").translate(letters)
            else:
                hard.append(chunk)
                continue
            ids = b"".join([packed[x.id] for x in tokenize(spelt)])
            cache[chunk] = ids if mark is None else ids + mark
        return hard

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        split = [self.chunks(x) for x in texts]
        wanted: set[str] = set()
        for x in split:
            wanted.update(x or ())
        if len(self.cache) > self.limit:
            self.elder, self.cache = self.cache, {}
        missing = wanted - self.cache.keys()
        self.cache.update((x, self.elder[x]) for x in missing & self.elder.keys())
        hard = self._learn(missing - self.elder.keys())
        self.cache.update(zip(hard, self._packed(hard), strict=True))
        whole = iter(self._packed([t for t, x in zip(texts, split, strict=True) if x is None]))
        get = self.cache.__getitem__
        return [next(whole) if x is None else b"".join(map(get, x)) for x in split]


@lru_cache(maxsize=2)
def encoder(path: str, cache: int = CACHE) -> ChunkEncoder:
    """One encoder for each worker process and vocabulary; a chunk takes about 200 bytes of its memory."""
    return ChunkEncoder(path, cache)
