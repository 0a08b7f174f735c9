"""Byte-level BPE as a lazily determinised finite-state transducer, and a streaming decoder.

Merges are compiled into states as texts need them. A state stands for the bytes read since the last token that is
certain, with every position in them at which the token under way may begin. A token goes out as soon as all those
possibilities agree on it, which needs a lookahead of a few token lengths at most. A state depends on its bytes alone:
if a token ends at some place in the encoding of a word, both sides of that place are encoded independently.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

#: States and remembered chunks of one worker; beyond either, it starts that table afresh.
STATES, CACHE = 250_000, 400_000
#: Ids that one step of the streaming decoder takes.
CHUNK = 1 << 16

_SPACE_RUN = re.compile(r" (?:\s|\Z)")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class MergeTransducer:
    def __init__(self, ranks: dict[bytes, int], states: int = STATES):
        self.ranks, self.limit = ranks, states
        self.token = {rank: token for token, rank in ranks.items()}
        self.prefixes = {token[:i] for token in ranks for i in range(1, len(token))}
        self.fits: dict[tuple[int, int], bool] = {}
        self._restart()

    def _restart(self) -> None:
        self.number = {b"": 0}
        self.live: list[list[tuple[bytes, tuple[int, ...]]]] = [[(b"", ())]]
        self.tail: list[bytes] = [b""]
        self.arcs: dict[int, tuple[int, bytes]] = {}

    def merge(self, word: bytes) -> list[int]:
        """The ids of a word by its merges one by one; only compiling uses it."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(a + b, 1 << 40), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == 1 << 40:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[x] for x in parts]

    def _may_follow(self, before: tuple[int, ...], rank: int) -> bool:
        """Whether `rank` after the last of `before` is what merging both tokens' bytes gives."""
        pair = (before[-1] if before else -1, rank)
        if pair not in self.fits:
            first = self.token[pair[0]] if before else b""
            self.fits[pair] = self.merge(first + self.token[rank]) == [*before[-1:], rank]
        return self.fits[pair]

    def _compile(self, state: int, byte: int) -> tuple[int, bytes]:
        """Determinises one arc: the next state and the ids that have become certain."""
        grown = [(begun + bytes((byte,)), before) for begun, before in self.live[state]]
        ended = next((*before, rank) for begun, before in grown if (rank := self.ranks.get(begun)) is not None and self._may_follow(before, rank))
        live = [x for x in grown if x[0] in self.prefixes] + [(b"", ended)]
        sure = 0
        shortest = min((before for _, before in live), key=len)
        while sure < len(shortest) and all(before[sure] == shortest[sure] for _, before in live):
            sure += 1
        out = ended[:sure]
        live = [(begun, before[sure:]) for begun, before in live]
        pending = b"".join(self.token[x] for x in live[-1][1])
        if pending not in self.number:
            self.number[pending] = len(self.live)
            self.live.append(live)
            self.tail.append(pack(f"<{len(live[-1][1])}I", *live[-1][1]))
        arc = self.arcs[state << 8 | byte] = self.number[pending], pack(f"<{sure}I", *out)
        return arc

    def encode(self, word: bytes) -> bytes:
        """The ids of one word, packed as little-endian unsigned 32-bit integers."""
        whole = self.ranks.get(word)
        if whole is not None:
            return pack("<I", whole)
        if len(self.live) > self.limit:
            self._restart()
        state, out, arcs = 0, [], self.arcs
        for byte in word:
            state, sure = arcs.get(state << 8 | byte) or self._compile(state, byte)
            if sure:
                out.append(sure)
        out.append(self.tail[state])
        return b"".join(out)


class Encoder:
    """Encodes whole texts: each match of `pattern` on its own, without special tokens."""

    def __init__(self, path: str, pattern: str, cache: int = CACHE):
        import regex

        self.transducer = MergeTransducer(read_ranks(path))
        self.words = regex.compile(pattern).findall
        self.limit, self.cache = cache, {}

    def _encode(self, text: str) -> bytes:
        return b"".join([self.transducer.encode(x.encode()) for x in self.words(text)])

    def encode(self, text: str) -> bytes:
        """Chunks that begin with a space before a visible character end words on both sides, so each is encoded once."""
        if _SPACE_RUN.search(text):
            return self._encode(text)
        first, *rest = text.split(" ")
        cache, out = self.cache, [self._encode(first)]
        if len(cache) > self.limit:
            cache.clear()
        for x in rest:
            ids = cache.get(x)
            if ids is None:
                ids = cache[x] = self._encode(" " + x)
            out.append(ids)
        return b"".join(out)


#: Fixed values of UTF-8: for each lead byte range, how many bytes a character has.
_LEADS = ((0xC2, 0xDF, 2), (0xE0, 0xEF, 3), (0xF0, 0xF4, 4))


def _lengths() -> list[int]:
    table = [1] * 256
    for low, high, n in _LEADS:
        table[low : high + 1] = [n] * (high + 1 - low)
    return table


class Utf8Stream:
    """An incremental UTF-8 machine: its state is the begun character, of which 0 to 3 bytes have come."""

    LENGTH = _lengths()

    def __init__(self) -> None:
        self.state = b""

    def feed(self, data: bytes, last: bool = False) -> str:
        """The characters that `data` completes; what is no UTF-8 becomes U+FFFD."""
        data = self.state + data
        end = len(data)
        if not last:
            for back in range(1, min(3, end) + 1):
                byte = data[-back]
                if byte & 0xC0 != 0x80:
                    if self.LENGTH[byte] > back:
                        end -= back
                    break
        self.state = data[end:]
        return data[:end].decode("utf-8", "replace")


def decode_bytes(ids: Iterable[np.ndarray], tokens: list[bytes]) -> Iterator[bytes]:
    """The bytes of each run of ids."""
    for x in ids:
        yield b"".join(map(tokens.__getitem__, x.tolist()))


def decode_stream(ids: Iterable[np.ndarray], tokens: list[bytes]) -> Iterator[str]:
    """Text as it becomes complete; a character may begin in one run of ids and end in a later one."""
    stream = Utf8Stream()
    for x in decode_bytes(ids, tokens):
        yield stream.feed(x)
    yield stream.feed(b"", last=True)


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


@lru_cache(maxsize=2)
def token_bytes(path: str) -> list[bytes]:
    ranks = read_ranks(path)
    table = [b""] * (1 + max(ranks.values()))
    for token, rank in ranks.items():
        table[rank] = token
    return table


def _columns(docs: DataFrame, *more: str) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *more)


def encode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id and ids (little-endian unsigned 32-bit integers) of every whole text.

    A null text counts as empty and has no ids; repeated rows are encoded each; further columns are ignored.
    """

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = encoder(ranks_path, pattern).encode
        for batch in slices(batches):
            ids = pa.array([one(x or "") for x in batch.column(1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["doc_id", "ids"])

    return _columns(docs, F.col("text").cast("string").alias("text")).mapInArrow(work, "doc_id long, ids binary")


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id and text of every row of (doc_id, ids), decoded in runs of ids."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = token_bytes(ranks_path)
        for batch in slices(batches, "ids"):
            texts = []
            for x in batch.column(1).to_pylist():
                ids = np.frombuffer(x or b"", dtype="<u4")
                texts.append("".join(decode_stream((ids[i : i + CHUNK] for i in range(0, len(ids), CHUNK)), tokens)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return _columns(encoded, "ids").mapInArrow(work, "doc_id long, text string")


def round_trip(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: digests of what encode() and decode() give for each text, in one pass."""
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, tokens = encoder(ranks_path, pattern).encode, token_bytes(ranks_path)
        for batch in slices(batches):
            counts, first, second = [], [], []
            for x in batch.column(1).to_pylist():
                packed = one(x or "")
                ids, digest = np.frombuffer(packed, dtype="<u4"), hashlib.sha256()
                for text in decode_stream((ids[i : i + CHUNK] for i in range(0, len(ids), CHUNK)), tokens):
                    digest.update(text.encode())
                counts.append(len(ids))
                first.append(hashlib.sha256(packed).hexdigest())
                second.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())], names=names)

    return _columns(docs, F.col("text").cast("string").alias("text")).mapInArrow(work, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
