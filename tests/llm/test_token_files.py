import random
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from skein.llm import jvm
from skein.llm import range_coder as r
from skein.llm import token_files as t
from skein.llm.tokens import encoder

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_slots_keep_every_id():
    ids = np.concatenate([np.arange(1 << 17), (1 << 32) - 1 - np.arange(1000), 1 << np.arange(32)])
    slot, lower = r.slot_of(ids)
    assert slot.max() == r.SLOTS - 1
    back = np.where(slot < 2, slot, (2 | slot & 1) << lower | ids & ((1 << lower) - 1))
    assert (back == ids).all()


def test_blocks_round_trip():
    draw = np.random.default_rng(4)
    blocks = [np.zeros(0, np.int64), np.array([r.MOST_ID]), np.zeros(3000, np.int64), np.tile(draw.integers(0, 49408, 40), 50), draw.integers(0, 1 << 32, 2000), np.arange(500)]
    blocks += [np.minimum(draw.geometric(0.002, int(n)), 65535) for n in draw.integers(1, 900, 20)]
    # Predictions that become sure and then fail.
    blocks += [np.concatenate([np.tile(draw.integers(0, 1 << 32, 30), 40), draw.integers(0, 1 << 32, 800)])]
    coded = r.encode_blocks(blocks)
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(blocks, r.decode_blocks(coded, [len(b) for b in blocks]), strict=True))
    assert len(coded[2][0]) + len(coded[2][1]) < 150 and len(coded[3][0]) + len(coded[3][1]) < 600
    # Blocks don't depend on each other.
    assert r.encode_blocks([blocks[4], blocks[4][:7]])[0] == coded[4]
    assert r.encode_blocks([]) == [] and r.decode_blocks([], []) == []


def test_sure_predictions_that_fail_round_trip():
    """Order 2 is nearly certain, order 1 nearly sure of being wrong, and then order 1 is right after all."""
    draw, blocks = np.random.default_rng(11), []
    for k in range(120):
        cycle = draw.integers(0, 5, int(draw.integers(3, 12)))
        ids = np.tile(cycle, 2048 // len(cycle))
        at = draw.integers(600, len(ids), int(draw.integers(0, 40)))
        ids[at] = draw.integers(0, 5, len(at))
        blocks.append(ids * (1 + 1000 * (k % 3)))
    coded = r.encode_blocks(blocks)
    assert all((a == b).all() for a, b in zip(blocks, r.decode_blocks(coded, [len(b) for b in blocks]), strict=True))


def test_every_prediction_has_some_of_the_space():
    for right2, right1, weight in ((65535, 0, 1 << 20), (0, 65535, 1 << 20), (65535, 65535, 1 << 20), (0, 0, 1 << 20)):
        lanes = r.Lanes(1, 64)
        lanes.table1[0], lanes.table2[0] = 1 << 3 | r.SURE, 2 << 3 | r.SURE
        lanes.right2[:], lanes.right1[:] = right2, right1
        lanes.first, lanes.second = ([np.full(1, weight) for _ in w] for w in (r.FIRST_WEIGHTS, r.SECOND_WEIGHTS))
        lanes.predict(1)
        assert lanes.space1[0] >= r.SOME and lanes.space2[0] >= r.SOME and lanes.share[0] >= 1 << r.LEAST


def test_counts_against_sums():
    draw = np.random.default_rng(2)
    for most in (1, 16, 17, 300, 5000):
        own, table = r.Counts(3, most), np.zeros((3, most), np.int64)
        for _ in range(200):
            symbol, step = draw.integers(0, most, 3), draw.integers(1, 3, 3)
            own.add(3, symbol, step)
            table[np.arange(3), symbol] += step
        symbol = draw.integers(0, most, 3)
        assert list(own.below(3, symbol)) == [table[k, : symbol[k]].sum() for k in range(3)]
        target = draw.integers(0, table.sum(axis=1))
        found, below = own.find(3, target)
        assert list(found) == [int(np.searchsorted(table[k].cumsum(), target[k], side="right")) for k in range(3)]
        assert list(below) == [table[k, : found[k]].sum() for k in range(3)]


def test_every_block_of_text_is_smaller_than_deflated(spark, sf):
    texts = [x.text or "" for x in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    ids = np.frombuffer(b"".join(encoder(PATH).encode(texts)), "<u4").astype(np.int64)
    blocks = [ids[k : k + r.BLOCK] for k in range(0, len(ids) - r.BLOCK, r.BLOCK)]
    ours = [len(a) + len(b) for a, b in r.encode_blocks(blocks)]
    deflated = [len(zlib.compress(x.astype("<u2").tobytes(), 9)) for x in blocks]
    assert len(blocks) > 20 and all(a < b for a, b in zip(ours, deflated, strict=True)) and sum(ours) < 0.85 * sum(deflated)


def test_file_checksums():
    ids = [np.array(x, "<u4").tobytes() for x in ([1, 2, 3], [], [7] * 20000)]
    data = t.write_file([5, None, -3], ids)
    assert t.read_file(data) == ([5, None, -3], ids)
    assert t.read_file(t.write_file([], [])) == ([], [])
    for k in (0, 6, len(data) // 2, len(data) - 1):
        broken = bytearray(data)
        broken[k] ^= 0x55
        with pytest.raises(t.Damaged):
            t.read_file(bytes(broken))
    for cut in (data[:10], data[:-1], b""):
        with pytest.raises(t.Damaged):
            t.read_file(cut)
    wide = [np.array([70000, r.MOST_ID, 0], "<u4").tobytes()]
    assert t.read_file(t.write_file([1], wide)) == ([1], wide)


def check(spark, rows, found):
    library = Tokenizer.from_file(PATH)
    ids = {d: library.encode(x or "", add_special_tokens=False).ids + [1] for d, x in rows}
    at = 0
    for doc in sorted(ids, key=lambda d: (d is not None, d)):
        (row,) = [x for x in found if x.doc_id == doc]
        assert (row.start, row.n_tokens, row.ids_crc32) == (at, len(ids[doc]), zlib.crc32(np.array(ids[doc], "<u4").tobytes()))
        at += len(ids[doc])
    assert len(found) == len(rows)


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    check(spark, [(x.doc_id, x.text) for x in docs.collect()], t.write_and_read(docs, PATH).collect())


def test_edges(spark, monkeypatch):
    monkeypatch.setattr(t, "FILE_BYTES", 200)
    rows = [(9, "b " * 30000), (2, None), (None, "null id"), (3, ""), (5, "an <|endoftext|> inside"), (-4, "İstanbul 's Straße ǅ")] + [(k, f"text {random.Random(k).random()} of {k}") for k in range(20, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "doc_id AS part", "text AS data")
    check(spark, rows, t.write_and_read(docs, PATH).collect())
    twice = t.write_and_read(docs.union(docs), PATH).collect()
    assert len(twice) == 2 * len(rows) and len({x.start for x in twice}) == 2 * len(rows)
    assert t.write_and_read(docs.limit(0), PATH).count() == 0


def some_files():
    draw = np.random.default_rng(4)
    long = [np.concatenate([np.tile(draw.integers(0, 1 << 32, 30), 40), draw.integers(0, 1 << 32, 800)]), np.tile(draw.integers(0, 5, 7), 900)]
    texts = [np.minimum(draw.geometric(0.002, int(n)), 65535) for n in draw.integers(1, 900, 60)]
    for x in ([], [[]], [[r.MOST_ID]], [[1, 2, 3], [], [7] * 20000], [[70000, r.MOST_ID, 0], [1 << 31, 1, 2, 3]], [draw.integers(0, 1 << 32, 9000)], long, texts):
        ids = [np.array(v, "<u4").tobytes() for v in x]
        yield [None if k == 1 else 5 - k for k in range(len(ids))], ids


def written(spark, files):
    jvm.functions(spark, t.VERSION)
    rows = spark.createDataFrame([(k, t._listed(d, x), b"".join(x)) for k, (d, x) in enumerate(files)], "k int, listed binary, ids binary")
    return [bytes(x.data) for x in rows.select("k", F.call_function(jvm.WRITE, "listed", "ids").alias("data")).orderBy("k").collect()]


def test_spark_writes_and_reads_the_files_of_numpy(spark):
    files = list(some_files())
    numpy = [t.write_file(*x) for x in files]
    # Other versions of zlib may deflate the tables otherwise; all after them is the same byte for byte.
    body = [data[t._HEAD.size + t._HEAD.unpack_from(data)[-1] :] for data in numpy]
    for own, rest, x in zip(written(spark, files), body, files, strict=True):
        assert own.endswith(rest) and t.read_file(own) == x
    table = spark.createDataFrame([(0, k, data) for k, data in enumerate(numpy)], "part int, seq int, data binary")
    found = t.decode(table).collect()
    for k, (docs, ids) in enumerate(files):
        sizes = [len(x) // 4 for x in ids]
        rows = sorted(((x.at, x.n_tokens, x.doc_id, x.ids_crc32) for x in found if x.seq == k), key=lambda x: x[:2])
        wanted = [(sum(sizes[:j]), sizes[j], docs[j], zlib.crc32(ids[j])) for j in range(len(ids))]
        assert rows == sorted(wanted, key=lambda x: x[:2])


def test_spark_finds_damage(spark):
    jvm.functions(spark, t.VERSION)
    read = spark.sparkContext._jvm.java.lang.Thread.currentThread().getContextClassLoader().loadClass("skein.TokenFiles$Read").newInstance().call
    draw = random.Random(3)
    for docs, ids in list(some_files())[2:]:
        data = t.write_file(docs, ids)
        assert len(read(data)) == len(docs)
        for k in [0, 4, 5, 8, 9, 12, 13, 20, 21, 25, 28, *(draw.randrange(len(data)) for _ in range(25))]:
            broken = bytearray(data)
            broken[k] ^= draw.randrange(1, 256)
            with pytest.raises(Exception, match="Damaged|DataFormat"):
                read(bytes(broken))
        for cut in (data[:10], data[:-1], b""):
            with pytest.raises(Exception, match="Damaged|DataFormat"):
                read(cut)


def test_coding_is_no_work_of_python(spark):
    """Under a third of the time that NumPy takes for a whole file, and no worker to read files."""
    draw = np.random.default_rng(8)
    files = [([k], [np.minimum(draw.geometric(0.002, 400 * r.BLOCK), 49407).astype("<u4").tobytes()]) for k in range(2)]
    written(spark, files)
    began = time.perf_counter()
    (data,) = written(spark, files[:1])
    spark.createDataFrame([(data,)], "data binary").select(F.inline(F.call_function(jvm.READ, "data"))).collect()
    ours, began = time.perf_counter() - began, time.perf_counter()
    t.read_file(t.write_file(*files[0]))
    assert 3 * ours < time.perf_counter() - began
    plan = t.decode(spark.createDataFrame([], "part int, seq int, data binary"))._jdf.queryExecution().executedPlan().toString()
    assert "InArrow" not in plan and "Python" not in plan
