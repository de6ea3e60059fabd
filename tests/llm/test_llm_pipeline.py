from collections import Counter

import duckdb
from llm_help import SMALL, lower, shingles

import corpus_pipeline
from urlguard.llm import quality
from urlguard.session import new_folder
from test_llm_line_dedup import brute as line_brute
from test_llm_minhash import roots
from test_llm_packing import check


def written(spark, frame):
    path = new_folder(spark, "test")
    frame.write.parquet(path)
    return spark.read.parquet(path)


def test_each_stage_on_its_own_input(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, outputs = docs.columns, {}
    odd = spark.createDataFrame([(100_001, None, "en", "s", None), (100_002, "12 34", "en", "s", 5), (100_003, "", None, None, 0)], docs.schema)
    docs = written(spark, docs.unionByName(odd))
    for name, stage in corpus_pipeline.STAGES:
        done = written(spark, stage(spark, docs, SMALL))
        outputs[name] = (docs.collect(), done.collect())
        if name != "best_fit_packing":
            assert done.columns == columns
        docs = done

    before, after = outputs["language_id"]
    assert {r.doc_id for r in before} - {r.doc_id for r in after} == {r.doc_id for r in before if not any(c.isalpha() for c in r.text or "")}

    before, after = outputs["quality_rules"]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [(r.doc_id, r.text) for r in before])
    kept = {r[0] for r in con.execute(f"SELECT doc_id FROM ({quality.check_sql()}) WHERE kept").fetchall()}
    assert {r.doc_id for r in after} == kept and 0 < len(kept) < len(before)

    before, after = outputs["line_dedup"]
    expected = {k: text for k, _, _, text in line_brute([(r.doc_id, r.text) for r in before], 10)}
    assert {r.doc_id: r.text for r in after} == expected and all(r.n_chars == len(r.text) for r in after)
    assert max(Counter(lower(line).strip() for r in after for line in set(r.text.split("\n")) if line.strip()).values()) < 10

    before, after = outputs["minhash_near_dedup"]
    sets = {r.doc_id: shingles(r.text) for r in before}
    edges = [
        (a, b) for a, x in sets.items() for b, y in sets.items()
        if a < b and x and 100 * len(x & y) >= 75 * len(x | y)
    ]
    assert {r.doc_id for r in after} == set(roots(set(sets), edges).values()) and len(after) < len(before)

    before, after = outputs["best_fit_packing"]
    check(after, [(r.doc_id, r.text) for r in before], 4096)


def test_run(spark):
    assert corpus_pipeline.run(spark, SMALL).count() > 0
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None


def test_near_copies_without_doc_id(spark):
    """A linked null doc_id takes no other row along, and one of each nameless group stays."""
    text, own = (" ".join(f"{mark}{k}" for k in range(40)) for mark in "wv")
    rows = [
        (None, text, "en", "a", 1), (5, text + " more", "en", "b", 2), (None, "alone here", "en", "c", 3),
        (None, own, "en", "d", 4), (None, own, "en", "e", 5), (None, own + " more", "en", "f", 6), (6, "other words", "en", "g", 7),
        (None, None, "en", "h", 8), (None, None, "en", "i", 9), (None, " ", "en", "j", 10), (6, "other words", "en", "k", 11),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    done = corpus_pipeline.near_copies(spark, docs, SMALL)
    assert done.columns == docs.columns
    kept = sorted(r.source for r in done.collect())
    assert [s for s in kept if s not in "def"] == list("bcghijk")
    assert sum(s in "def" for s in kept) == 1


def test_shared_lines_leave_other_columns(spark):
    rows = [(k, f"shared\nown {k}", "en", "s", 9, f"mine {k}", k, -k) for k in range(12)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept string, n_lines long, n_dropped long"
    docs = spark.createDataFrame(rows, schema).repartition(3)
    done = corpus_pipeline.shared_lines(spark, docs, SMALL)
    assert done.columns == docs.columns
    want = [(k, f"own {k}", "en", "s", len(f"own {k}"), f"mine {k}", k, -k) for k in range(12)]
    assert sorted(map(tuple, done.collect())) == want
