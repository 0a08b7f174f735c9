import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from skein.llm import toxicity, weak_labels
from skein.llm.common import documents
from tests.llm.test_line_dedup import brute as plain_lines
from tests.llm.test_ngram_join import brute as components
from tests.llm.test_packing import check


def test_stages(spark, sf):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality_classifier", "line_dedup", "ngram_jaccard_join", "packing"]
    docs = documents(spark, sf)
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and out.schema["n_chars"].dataType == docs.schema["n_chars"].dataType, name
        after = out.count()
        assert 0 < after <= before, name
        docs, before = out, after
    assert docs.where("n_chars <> char_length(text)").count() == 0
    ids = {r.doc_id for r in docs.collect()}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert {r.doc_id for r in packed} == ids and all(r.length <= 2048 for r in packed)


def test_empty_documents_table(spark, sf, tmp_path):
    for name in ("documents", "labels"):
        table = spark.read.parquet(f"{sf}/{name}.parquet")
        (table.limit(0) if name == "documents" else table).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_queries_are_registered(spark, sf):
    import __spark_entry__

    found = __spark_entry__.queries()
    for n in range(1, 11):
        assert len([q for q in found if q.startswith(f"op{n}_")]) == 1
    assert "pipeline" in found and set(__spark_entry__.oracle_sql()) <= set(found)


def test_each_stage_against_brute_force_with_odd_rows(spark, sf):
    """Null texts, ids and sites, repeated rows, a long text and columns named like those of the operators."""
    given = documents(spark, sf).limit(120).collect()
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in given]
    line = "this passage stands on every site as it is"
    rows += [(10_000 + k, f"{line}\nown line number {k} of a page " + " ".join(f"w{k}x{i}" for i in range(20)), "en", f"s{k}", 99) for k in range(7)]
    rows += [(20_000, None, None, None, None), (20_001, "", "en", "", 0), (20_002, "long words " * 20_000, "en", "s1", 220_000), rows[0], rows[0]]
    extra = ["n_removed", "n_lines", "score", "kept", "component_id", "sig", "length", "start"]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", *[f"{k} AS {c}" for k, c in enumerate(extra)])
    key = lambda r: (r.doc_id, r.text)

    clean = corpus_pipeline.toxicity_stage(spark, docs, sf)
    toxic = {r.doc_id for r in toxicity.classify(docs, spark.read.parquet(f"{sf}/labels.parquet")).where("predicted = 1").collect()}
    assert clean.columns == docs.columns and sorted(map(str, map(key, clean.collect()))) == sorted(str(x[:2]) for x in rows if x[0] not in toxic)

    good = corpus_pipeline.quality_stage(spark, docs, sf)
    bad = {r.doc_id for r in weak_labels.classify(docs).where("not kept").collect()}
    assert good.columns == docs.columns and sorted(map(str, map(key, good.collect()))) == sorted(str(x[:2]) for x in rows if x[0] not in bad)

    unique = list(dict.fromkeys(rows))
    want = plain_lines([(d, t, s) for d, t, _, s, _ in unique])
    lines = corpus_pipeline.line_dedup_stage(spark, docs, sf)
    found = lines.collect()
    left = {d for d, (text, _, removed) in want.items() if not removed or (text or "").strip(" \t\n\x0b\x0c\r")}
    assert lines.columns == docs.columns and {r.doc_id for r in found} == left and len(found) == sum(x[0] in left for x in rows)
    assert all(r.text == want[r.doc_id][0] and [r[c] for c in extra] == list(range(len(extra))) for r in found)
    assert all(r.n_chars == len(r.text) for r in found if want[r.doc_id][2]) and sum(v[2] for v in want.values()) >= 6

    one = corpus_pipeline.near_duplicate_stage(spark, docs, sf)
    kept = sorted(r.doc_id for r in one.collect())
    assert one.columns == docs.columns and kept == sorted({c for _, c in components([(d, t) for d, t, *_ in unique], 5, 80).values()})

    packed = corpus_pipeline.packing_stage(spark, docs.where("doc_id > 0").dropDuplicates(["doc_id"]), sf).collect()
    assert check(packed, [(d, t) for d, t, *_ in unique if d > 0], Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 2048) > 0.9
