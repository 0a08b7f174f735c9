"""Packing of token sequences: shortest-pack-first over the histogram of piece lengths."""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SALTS, salt, scratch, session, slices
from .tokens import CACHE, encoder

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PIECES_IDS = f"{PIECES}, ids binary"
_PA = {"doc_id": pa.int64(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(), "doc_tokens": pa.int64()}


def cut(docs: DataFrame, tokenizer: str, length: int, end_id: int, with_ids: bool = False, cache: int = CACHE) -> DataFrame:
    """One row for each piece of at most `length` ids of each document, its end id included.

    A null text counts as empty and gives one piece that holds the end id alone. Columns besides doc_id and text are
    ignored, whatever their names. `with_ids` adds the ids themselves.
    """
    end = np.array([end_id], dtype="<u4").tobytes()
    fields = [pa.field(k, v) for k, v in _PA.items()] + ([pa.field("ids", pa.binary())] if with_ids else [])

    def pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, cache).encode
        for batch in slices(batches):
            rows: list[tuple] = []
            packed = encode([x or "" for x in batch.column(1).to_pylist()])
            for doc, ids in zip(batch.column(0).to_pylist(), packed, strict=True):
                ids += end
                n = len(ids) // 4
                for start in range(0, n, length):
                    piece = ids[4 * start : 4 * (start + length)]
                    rows.append((doc, start, len(piece) // 4, zlib.crc32(piece), n, *[piece] * with_ids))
            columns = list(zip(*rows, strict=True)) or [[] for _ in fields]
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, fields, strict=True)], schema=pa.schema(fields))

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(pieces, PIECES_IDS if with_ids else PIECES)


@dataclass
class Plan:
    """Where the pieces of each length go: piece `rank` of a length is in the interval whose key is the last at or below it."""

    stride: int
    keys: np.ndarray
    first_sequence: np.ndarray
    offset: np.ndarray
    used: np.ndarray
    sequences: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sequence, offset, ids used in that sequence) for each piece."""
        want = length * self.stride + rank
        at = np.searchsorted(self.keys, want, side="right") - 1
        return self.first_sequence[at] + (want - self.keys[at]), self.offset[at], self.used[at]


def shortest_pack_first(histogram: dict[int, int], length: int) -> list[tuple[list[int], int]]:
    """Packing patterns and how many sequences follow each.

    Lengths come longest first. A piece goes to the shortest open pack that has room; packs of one pattern are handled
    together, so the work grows with the number of distinct lengths and not with that of pieces.
    """
    open_packs: list[tuple[int, int, list[int], int]] = []
    made = 0
    for size in sorted(histogram, reverse=True):
        left = histogram[size]
        while left:
            if open_packs and -open_packs[0][0] >= size:
                gap, _, pattern, count = heapq.heappop(open_packs)
                take = min(left, count)
                grown = [(gap + size, [*pattern, size], take), (gap, pattern, count - take)]
            else:
                # The pack just opened is then the shortest with room, until equal pieces fill it.
                fit = length // size
                packs, rest = divmod(left, fit)
                take = left
                grown = [(fit * size - length, [size] * fit, packs), (rest * size - length, [size] * rest, int(rest > 0))]
            left -= take
            for gap, pattern, count in grown:
                if count:
                    made += 1
                    heapq.heappush(open_packs, (gap, made, pattern, count))
    return [(pattern, count) for _, _, pattern, count in sorted(open_packs, key=lambda x: x[1])]


def plan(histogram: dict[int, int], length: int) -> Plan:
    stride = 1 + max(histogram.values(), default=0)
    taken = dict.fromkeys(histogram, 0)
    rows, sequence = [], 0
    for pattern, count in shortest_pack_first(histogram, length):
        offset, used = 0, sum(pattern)
        for size in pattern:
            rows.append((size * stride + taken[size], sequence, offset, used))
            taken[size] += count
            offset += size
        sequence += count
    keys, first, offset, used = np.array(sorted(rows), dtype=np.int64).reshape(-1, 4).T
    return Plan(stride, keys, first, offset, used, sequence)


def assign(pieces: DataFrame, length: int, salts: int = SALTS) -> DataFrame:
    """Adds sequence_id, offset and sequence_tokens to pieces of 1 to `length` ids.

    To the driver go the counts by (length, salt): at most `length` times `salts` rows, whatever the input. Patterns
    are joined back by the rank of a piece among those of its length. That rank is taken within (length, salt), so a
    length which a third of all pieces share is dealt over many tasks.
    """
    spark = session(pieces)
    columns = pieces.columns
    salted = pieces.withColumn("_salt", salt("doc_id", "start", "ids_crc32", salts=salts))
    counts = salted.groupBy("length", "_salt").count().collect()
    table: dict[int, list[int]] = {}
    for size, k, n in counts:
        table.setdefault(size, [0] * salts)[k] = n
    packing = plan({size: sum(x) for size, x in table.items()}, length)
    before = np.zeros((length + 1, salts), dtype=np.int64)
    for size, x in table.items():
        before[size, 1:] = np.cumsum(x)[:-1]
    shared = spark.sparkContext.broadcast((packing, before))
    ranked = salted.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "start", "ids_crc32")))
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema], "sequence_id long, offset long, sequence_tokens long"])

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packing, before = shared.value
        for batch in batches:
            size, k, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "_salt", "_rank"))
            placed = packing.place(size, before[size, k] + rank - 1)
            kept = [batch.column(batch.schema.get_field_index(c)) for c in columns]
            yield pa.RecordBatch.from_arrays([*kept, *map(pa.array, placed)], names=[*columns, "sequence_id", "offset", "sequence_tokens"])

    return ranked.mapInArrow(place, schema)


def pack(docs: DataFrame, tokenizer: str, length: int = 2048, end_id: int = 1, with_ids: bool = False, cache: int = CACHE) -> DataFrame:
    """Packs documents (doc_id, text) into sequences of at most `length` tokens.

    Returns a row for each piece: doc_id, start, length, ids_crc32, doc_tokens, [ids,] sequence_id, offset,
    sequence_tokens. Rows that repeat are documents of their own. An empty table gives an empty result. Texts are
    tokenised once, into a scratch table that holds the pieces. `cache`: chunks that a worker remembers, for speed alone.
    """
    return assign(scratch(cut(docs, tokenizer, length, end_id, with_ids, cache), "pieces"), length)
