import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from skein.llm import packing, tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
ALPHABET = ["a", "b", " ", "  ", "\n", "é", "日本", "the", "ing", "=", ".", ",", ". ", "1", "'s", "😀", "\x1c", "\x00", "Word", "İ", "Σ", "ß", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|", "|>"]


def test_chunks_give_the_library_s_ids():
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        path = public_tokenizers.path(name)
        library = Tokenizer.from_file(path)
        ours, draw = tokens.ChunkEncoder(path, cache=50), random.Random(3)
        for _ in range(150):
            texts = ["".join(draw.choice(ALPHABET) for _ in range(draw.randint(0, 25))) for _ in range(8)]
            assert ours.encode(texts) == [np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts], texts


def test_patterns_hold_every_piece_once():
    draw = random.Random(9)
    for _ in range(30):
        histogram = {draw.randint(1, 64): draw.randint(1, 200) for _ in range(draw.randint(1, 40))}
        found = packing.shortest_pack_first(histogram, 64)
        placed = defaultdict(int)
        for pattern, count in found:
            assert sum(pattern) <= 64 and count > 0
            for size in pattern:
                placed[size] += count
        assert placed == histogram
    assert packing.shortest_pack_first({}, 64) == []


def check(rows, docs, library, length):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for doc, text in docs:
        ids = library.encode(text or "", add_special_tokens=False).ids + [1]
        at = 0
        for r in sorted(by_doc[doc], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at and r.sequence_tokens == sum(x.length for x in pieces)
            at += r.length
        assert at <= length
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    return sum(r.length for r in rows) / (length * max(1, len(by_sequence)))


def test_query_on_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    library = Tokenizer.from_file(PATH)
    fill = check(packing.pack(docs, PATH).collect(), [(r.doc_id, r.text) for r in docs.collect()], library, 2048)
    assert fill > 0.97


def test_edge_rows(spark):
    rows = [(1, None), (2, ""), (3, "word " * 5000), (4, "a b"), (5, "a b"), (6, "a <|endoftext|> b<|endoftext|>"), (None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "doc_id AS length", "text AS start", "doc_id AS _salt")
    library = Tokenizer.from_file(PATH)
    check(packing.pack(docs, PATH, length=64).collect(), rows, library, 64)
    assert packing.pack(docs.limit(0), PATH).count() == 0
    assert packing.pack(docs.union(docs), PATH).count() == 2 * packing.pack(docs, PATH).count()
    with_ids = packing.pack(docs, PATH, length=64, with_ids=True).collect()
    assert all(zlib.crc32(bytes(r.ids)) == r.ids_crc32 for r in with_ids)
