from collections import defaultdict

from skein.llm import line_dedup as d


def brute(rows, sites=5, words=3):
    seen, first = defaultdict(set), {}
    for doc, text, site in sorted(rows, key=lambda r: r[0]):
        for pos, line in enumerate((text or "").split("\n")):
            if len(line.split()) >= words:
                seen[line].add(site)
                first.setdefault(line, (doc, pos))
    out = {}
    for doc, text, _ in rows:
        lines = (text or "").split("\n")
        kept = [x for pos, x in enumerate(lines) if len(seen.get(x, ())) < sites or first[x] == (doc, pos)]
        out[doc] = (None if text is None else "\n".join(kept), 0 if text is None else len(lines), len(lines) - len(kept))
    return out


def rows_of(spark, rows, **kw):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "doc_id AS doc", "text AS line", "doc_id AS h1")
    found = d.clean(docs, **kw)
    assert found.columns == ["doc_id", "text", "source", "doc", "line", "h1", "n_lines", "n_removed"]
    return found.collect()


def test_against_brute_force(spark):
    rows = [(k, f"own line number {k}\ncommon to many sites here\nshort one\nunder the limit line {k % 3}\n\nlast {'x ' * (k % 4)}", f"s{k % (4 if k % 2 else 9)}") for k in range(120)]
    rows += [(200, None, "s1"), (201, "", "s2"), (202, "common to many sites here\ncommon to many sites here", None), (203, "long " * 20000, "s3")]
    found = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in rows_of(spark, rows)}
    assert found == brute(rows)
    assert sum(v[2] for v in found.values()) > 100


def test_near_threshold_is_exact(spark):
    for sites in (4, 5, 6):
        rows = [(k, "exactly so many sites\nown " + str(k) + " line", f"s{k % sites}") for k in range(60)]
        found = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in rows_of(spark, rows)}
        assert found == brute(rows)


def test_null_and_empty_sites_are_two(spark):
    rows = [(k, "one line on four sites or five", site) for k, site in enumerate(["a", "b", "c", "", None])]
    assert sum(r.n_removed for r in rows_of(spark, rows)) == 4
    assert sum(r.n_removed for r in rows_of(spark, rows[:-1] + [(9, "one line on four sites or five", "")])) == 0


def test_clashing_columns_stay(spark):
    rows = [(k, "a line on every site\nown line of " + str(k), f"s{k}") for k in range(6)]
    more = ["n_lines", "N_Removed", "_gone", "_doc", "_hash", "_split", "pos", "dh"]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", *[f"99 + {k} AS {c}" for k, c in enumerate(more)])
    found = d.clean(docs)
    assert found.columns == [*docs.columns, "n_lines_", "n_removed_"]
    for r in found.collect():
        assert [r[c] for c in more] == [99 + k for k in range(len(more))]
        assert (r.n_lines_, r.n_removed_) == (2, int(r.doc_id > 0))


def test_long_documents_and_all_lines_removed(spark):
    lines = [f"boiler plate line {k}" for k in range(3000)]
    rows = [(k, "\n".join(lines), f"s{k}") for k in range(5)] + [(9, "\n".join([*lines, "a last line of its own"] * 20), "s9")]
    found = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in rows_of(spark, rows)}
    assert found == brute(rows) and found[4][0] == ""


def test_sketches_of_many_sites(spark):
    rows = [(k, "a line on very many sites", f"site{k}") for k in range(3000)]
    found = rows_of(spark, rows, sites=2900)
    assert sum(r.n_removed for r in found) == 2999


def test_repeated_rows_null_ids_and_empty_table(spark):
    rows = [(k, "boiler plate line everywhere", f"s{k}") for k in range(6)] + [(0, "boiler plate line everywhere", "s0"), (None, "boiler plate line everywhere", "s9"), (None, None, None)]
    found = rows_of(spark, rows)
    assert len(found) == len(rows)
    # A null id comes first, so its row keeps the line.
    assert sorted(r.n_removed for r in found) == [0, 0, 1, 1, 1, 1, 1, 1, 1]
    assert rows_of(spark, [(1, None, None)])[0].text is None
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert d.clean(docs).count() == 0
