"""Token-id files: whole documents in ascending doc_id order, in blocks of the range coder with checksums.

A file is one binary value, a row of a Parquet table, so that any store which Spark can write to holds it, tasks that are
repeated after a loss commit it once, and no local path is needed. Its layout, all numbers little-endian:

    magic "SKTF", version u8, documents u32, blocks u32, ids u64, crc32 of all ids u32, bytes of the tables u32
    tables, deflated: doc_id i64 and ids u64 of each document; ids, bytes of words, bytes of plain bits and crc32 of ids,
    words and plain bits, u32 each, of each block
    of each block: words, plain bits

Ids are unsigned 32-bit integers. Each block of up to 2048 ids is coded afresh and can be read alone.

Workers only tokenise; Spark's JVM writes and reads the files (TokenFiles.java). write_file() and read_file() do the same in NumPy,
for programs without Spark. A file holds up to 2**29 ids, as a value of Spark's has 2 GB.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import jvm
from .common import scratch, slices
from .range_coder import BLOCK, decode_blocks, encode_blocks
from .tokens import encoder

MAGIC, VERSION = b"SKTF", 2
_HEAD = struct.Struct("<4sBIIQII")
#: Bytes of text that go into one file, about.
FILE_BYTES = 12 << 20
#: Stands for a null doc_id in a file.
_NULL = -(1 << 63)


class Damaged(ValueError):
    """A file that does not hold what its checksums say."""


def _listed(doc_ids: list[int | None], ids: list[bytes]) -> bytes:
    """doc_id and number of ids of each document, as the tables have them."""
    return np.array([[_NULL if d is None else d, len(x) // 4] for d, x in zip(doc_ids, ids, strict=True)], "<i8").tobytes()


def write_file(doc_ids: list[int | None], ids: list[bytes], block: int = BLOCK) -> bytes:
    """One file of whole documents; `ids` are little-endian unsigned 32-bit integers."""
    joined, listed = b"".join(ids), _listed(doc_ids, ids)
    flat = np.frombuffer(joined, "<u4").astype(np.int64)
    parts = [flat[i : i + block] for i in range(0, len(flat), block)]
    coded = encode_blocks(parts)
    sums = [[len(p), len(w), len(b), zlib.crc32(w + b, zlib.crc32(joined[4 * k * block : 4 * (k * block + len(p))]))] for k, (p, (w, b)) in enumerate(zip(parts, coded, strict=True))]
    tables = zlib.compress(listed + np.array(sums, "<u4").tobytes())
    head = _HEAD.pack(MAGIC, VERSION, len(ids), len(parts), len(flat), zlib.crc32(joined), len(tables))
    return b"".join([head, tables, *[x for pair in coded for x in pair]])


def read_file(data: bytes) -> tuple[list[int | None], list[bytes]]:
    """(doc_ids, ids of each document); every block's checksum and that of the whole file are tested."""
    try:
        magic, version, n_docs, n_blocks, n_ids, crc, n_tables = _HEAD.unpack_from(data)
        if (magic, version) != (MAGIC, VERSION):
            raise Damaged("no token file of this version")
        tables = zlib.decompress(data[_HEAD.size : _HEAD.size + n_tables])
        if len(tables) != 16 * (n_docs + n_blocks):
            raise Damaged("the tables have another size")
    except (struct.error, zlib.error) as e:
        raise Damaged(str(e)) from e
    documents = np.frombuffer(tables, "<i8", 2 * n_docs).reshape(-1, 2)
    blocks = np.frombuffer(tables, "<u4", 4 * n_blocks, 16 * n_docs).reshape(-1, 4).tolist()
    at, coded = _HEAD.size + n_tables, []
    for _, words, plain, _ in blocks:
        coded.append((data[at : at + words], data[at + words : at + words + plain]))
        at += words + plain
    if at != len(data):
        raise Damaged(f"{len(data)} bytes instead of {at}")
    decoded = [x.astype("<u4").tobytes() for x in decode_blocks(coded, [x[0] for x in blocks])]
    for k, (x, (*_, own)) in enumerate(zip(decoded, blocks, strict=True)):
        if zlib.crc32(b"".join(coded[k]), zlib.crc32(x)) != own:
            raise Damaged(f"block {k} has another checksum")
    joined = b"".join(decoded)
    if len(joined) != 4 * n_ids or zlib.crc32(joined) != crc:
        raise Damaged("the file has another checksum")
    ends = np.cumsum(documents[:, 1]) * 4
    starts = ends - documents[:, 1] * 4
    return [None if d == _NULL else d for d in documents[:, 0].tolist()], [joined[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


def encode(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """part, seq, n_docs, n_tokens, data: files of all whole texts, in ascending (part, seq) order of doc_id; a null text counts as empty, null ids come first.

    A document has its end id at least. Rows that repeat are documents of their own. Ranges of doc_id are dealt to tasks,
    of which each writes its files one after the other, so a worker holds one file's ids at a time.
    """

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, end, seq = encoder(tokenizer), np.array([end_id], "<u4").tobytes(), 0
        doc_ids: list[int | None] = []
        ids: list[bytes] = []
        held, part = 0, 0

        def file() -> pa.RecordBatch:
            values = [part, seq, len(ids), sum(map(len, ids)) // 4, _listed(doc_ids, ids), b"".join(ids)]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names=["part", "seq", "n_docs", "n_tokens", "listed", "ids"])

        for batch in slices(batches):
            texts = [x or "" for x in batch.column(1).to_pylist()]
            doc_ids += batch.column(0).to_pylist()
            ids += [x + end for x in one.encode(texts)]
            part = batch.column(2)[0].as_py()
            held += sum(map(len, texts))
            if held >= FILE_BYTES:
                yield file()
                doc_ids, ids, held, seq = [], [], 0, seq + 1
        if ids:
            yield file()

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = narrow.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    found = ordered.withColumn("part", F.spark_partition_id()).mapInArrow(work, "part int, seq int, n_docs long, n_tokens long, listed binary, ids binary")
    jvm.functions(docs.sparkSession, VERSION)
    return found.select("part", "seq", "n_docs", "n_tokens", F.call_function(jvm.WRITE, "listed", "ids").alias("data"))


def decode(files: DataFrame) -> DataFrame:
    """(part, seq, doc_id, at, n_tokens, ids_crc32) of each document in each file; `at` counts the ids before it in its file."""
    jvm.functions(files.sparkSession, VERSION)
    return files.select("part", "seq", F.inline(F.call_function(jvm.READ, "data")))


def starts(files: DataFrame) -> DataFrame:
    """(part, seq, start): the ids in all files before each. Running sums go over the parts, then over the files of a part."""
    sizes = files.select("part", "seq", "n_tokens")
    totals = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_part"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("part", "seq", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)).alias("_file"))
    return sizes.join(totals, "part").select("part", "seq", (F.col("_part") + F.col("_file")).cast("long").alias("start"))


def document_table(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, as the files have them."""
    return decode(files).join(starts(files), ["part", "seq"]).select("doc_id", (F.col("start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def write_and_read(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Writes files to the shared folder and describes the documents that they hold."""
    return document_table(scratch(encode(docs, tokenizer, end_id), "token-files"))
