import cases
import corpus_pipeline
import pytest
import test_decontaminate
import test_simhash

SF = "/root/testdata/sf0.001"


def _stage(name):
    return dict(corpus_pipeline.STAGES)[name]


@pytest.fixture(scope="module")
def sf_dir(tmp_path_factory, spark):
    """Awkward documents and a benchmark, as tables in a folder."""
    folder = str(tmp_path_factory.mktemp("tables"))
    rows = cases.awkward_rows() + [(90, f"x {cases.prose(30, 40)}", "en", "a"), (91, "my token = 'abcdef0123' here and more words", "en", "b")]
    cases.frame(spark, rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, cases.prose(30, 40)), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_every_stage_on_awkward_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.collect()
    kept = _stage("language_id")(spark, docs, sf_dir)
    assert kept.columns == docs.columns
    assert cases.in_order(kept.collect()) == cases.in_order(r for r in rows if any(c.isalpha() for c in r.text or ""))
    deduped = _stage("near_dedup")(spark, docs, sf_dir)
    assert deduped.columns == docs.columns
    clean = _stage("decontaminate")(spark, docs, sf_dir)
    hit = {r[0] for r in test_decontaminate._plain([(r.doc_id, r.text) for r in rows], [(1, cases.prose(30, 40))]) if r[2]}
    assert hit == {90} and cases.in_order(clean.collect()) == cases.in_order(r for r in rows if r.doc_id != 90)
    masked = _stage("secrets")(spark, docs, sf_dir)
    assert masked.columns == docs.columns
    assert [(r.text, r.n_chars) for r in masked.collect() if r.doc_id == 91] == [("my [SECRET]' here and more words", 32)]
    assert cases.in_order(r for r in masked.collect() if r.doc_id != 91) == cases.in_order(r for r in rows if r.doc_id != 91)
    assert _stage("mix")(spark, docs, sf_dir).columns == [*docs.columns, "copy"]


def test_letterless_documents_go_without_labelled_text(spark, sf_dir):
    rows = [(1, None, None, "a"), (2, "", None, "a"), (3, "12 34 -- 56", None, "a"), (4, "plain words", None, "a"), (5, "é", None, "a")]
    kept = _stage("language_id")(spark, cases.frame(spark, rows), sf_dir).collect()
    assert sorted(r.doc_id for r in kept) == [4, 5]


def test_whole_pipeline_matches_plain_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = {r.doc_id: r for r in docs.collect() if any(c.isalpha() for c in r.text or "")}
    prints = {d: test_simhash._plain(r.text) for d, r in rows.items()}
    groups = cases.components(rows, lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)
    rows = {d: rows[d] for d in rows if groups[d] == d}
    hit = {d for d, _, n, *_ in test_decontaminate._plain([(d, r.text) for d, r in rows.items()], items) if n}
    rows = {d: r for d, r in rows.items() if d not in hit}
    out = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in out} <= rows.keys()
    assert len({(r.doc_id, r["copy"]) for r in out}) == len(out) and max(r["copy"] for r in out) <= 3
    same = sum(r.text == rows[r.doc_id].text for r in out)
    assert same >= 0.9 * len(out) and all(r.text == rows[r.doc_id].text or "[SECRET]" in r.text for r in out)
    assert "token =" not in " ".join(r.text for r in out)
    words = sum(len(r.text.encode().split()) for r in out)
    assert abs(words / sum(len(r.text.encode().split()) for r in rows.values()) - 1) < 0.2


def test_empty_documents(spark, tmp_path):
    cases.frame(spark, []).limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "a b")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_registered(spark):
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
