import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from skein.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
ALPHABET = ["a", "b", " ", "  ", "\n", "é", "日本", "ñ", "e", "the", "ing", "=", "----", "1", "22", "'s", "😀", "\x1c", "x" * 50, "Ab", "ű", "한국", "ה", "don't", "\t"]


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


@pytest.fixture(scope="module")
def ours():
    return bpe.Encoder(PATH, public_tokenizers.PATTERN)


def test_same_ids_as_the_library(library, ours):
    draw = random.Random(5)
    for _ in range(3000):
        text = "".join(draw.choice(ALPHABET) for _ in range(draw.randint(0, 30)))
        assert np.frombuffer(ours.encode(text), "<u4").tolist() == library.encode_ordinary(text), text


def test_long_runs_stay_bounded_and_right(library, ours):
    for text in ("a" * 5000, "=" * 3000, "ab" * 2000, "\n" * 300, "é" * 1000):
        assert np.frombuffer(ours.encode(text), "<u4").tolist() == library.encode_ordinary(text)


def test_states_start_afresh(library):
    small = bpe.Encoder(PATH, public_tokenizers.PATTERN, cache=5)
    small.transducer.limit = 20
    for text in ("thinking about elephants", "ünïcödé wörds", "thinking about elephants"):
        assert np.frombuffer(small.encode(text), "<u4").tolist() == library.encode_ordinary(text)


def test_decoder_takes_any_chunks(ours):
    text = "naïve 日本 😀 \n end"
    ids, tokens = np.frombuffer(ours.encode(text), "<u4"), bpe.token_bytes(PATH)
    for step in (1, 2, 3, 100):
        assert "".join(bpe.decode_stream((ids[i : i + step] for i in range(0, len(ids), step)), tokens)) == text
    stream = bpe.Utf8Stream()
    assert "".join([stream.feed(bytes([x])) for x in text.encode()] + [stream.feed(b"", last=True)]) == text
    broken = bpe.Utf8Stream()
    assert broken.feed(b"a\xe6\x97") == "a" and broken.feed(b"", last=True) == "�"


def test_query_rows(spark, library):
    rows = [(1, "Hello  world"), (2, None), (3, ""), (None, "x"), (1, "Hello  world"), (4, "é " * 20000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "doc_id AS ids", "text AS n_tokens")
    found = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip(docs, PATH, public_tokenizers.PATTERN).collect()}
    want = set()
    for doc, text in rows:
        ids = library.encode_ordinary(text or "")
        want.add((doc, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert found == want
    assert bpe.round_trip(docs.limit(0), PATH, public_tokenizers.PATTERN).count() == 0
    assert {r.text for r in bpe.decode(bpe.encode(docs, PATH, public_tokenizers.PATTERN), PATH).collect()} == {t or "" for _, t in rows}
