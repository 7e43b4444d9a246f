import zlib

import cases
import numpy as np
import pytest

from corpusprep.llm import language_id as lid

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy_over_the_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    out = lid.identify_languages(docs).collect()
    assert sorted(r.doc_id for r in out) == sorted(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out)
    assert all(0 <= r.score <= 1 for r in out) and {r.lang_pred for r in out} <= set(truth.values()) | {"und"}
    right = [r.lang_pred == truth[r.doc_id] for r in out if r.held_out]
    assert len(right) > 250 and sum(right) >= 0.98 * len(right)


def test_held_out_labels_are_not_learned(spark):
    rows = [(i, cases.prose(i, 60) if i % 2 else "żółw ślimak " * 20, "xx" if zlib.crc32(str(i).encode()) % 3 == 1 else "ab"[i % 2], "s") for i in range(60)]
    out = lid.identify_languages(cases.frame(spark, rows)).collect()
    assert all(r.lang_pred == "ab"[r.doc_id % 2] for r in out)


def test_awkward_rows(spark):
    rows = cases.awkward_rows() + [(200, "123 456 !?", "en", "a"), (201, "\U0001f600", "en", "a"), (202, "漢字かな", "ja", "a")]
    out = lid.identify_languages(cases.frame(spark, rows)).collect()
    assert len(out) == len(rows)
    assert all((r.lang_pred, r.score) == ("und", 0.0) for r in out if r.doc_id in (3, 4, 5, 200, 201))
    assert not [r for r in out if r.doc_id is None and r.held_out]
    assert lid.identify_languages(cases.frame(spark, []).limit(0)).collect() == []


def test_nothing_to_learn_from(spark):
    out = lid.identify_languages(cases.frame(spark, [(1, "some text", None, "a"), (2, "more", None, "a")])).collect()
    assert [(r.lang_pred, r.score) for r in out] == [("und", 0.0)] * 2


def test_vectors_bind_and_bundle_trigrams():
    a, b, blank = (lid._letter_vector(ord(c), 64, 1).astype(int) for c in "ab ")
    want = np.roll(blank, 2) * np.roll(a, 1) * b + np.roll(a, 2) * np.roll(b, 1) * blank
    assert (lid.document_vectors(["1Ab!"], 64, 1)[0] == want).all()
    assert not lid.document_vectors([None, "", "12 !"], 64, 1).any()


def test_long_texts_are_whole():
    text = cases.prose(5, 4000)
    whole = lid.document_vectors([text], 128)[0]
    before = lid._PACK_CHARS
    lid._PACK_CHARS = 1000
    try:
        parts = lid.document_vectors([text], 128)[0]
    finally:
        lid._PACK_CHARS = before
    cosine = whole @ parts / np.linalg.norm(whole) / np.linalg.norm(parts)
    assert cosine == pytest.approx(1, abs=1e-3)


def _model(table):
    return {r["lang"]: r["totals"] for r in table.collect()}


def test_prototypes_do_not_depend_on_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    one, two = (_model(lid.learn_prototypes(d)) for d in (docs.coalesce(1), docs.repartition(6)))
    assert one == two and set(one) == {"en", "fr", "de", "es"}


def test_training_is_bounded(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sample = lid._training(docs, "doc_id", "text", "lang", 30, lid.SEED)
    assert 60 < sample.count() < 240
    assert set(_model(lid.learn_prototypes(docs, train_docs=30))) == {"en", "fr", "de", "es"}


def test_any_number_of_languages(spark, monkeypatch):
    """More labels than a block holds: scored in blocks, as if they were one."""
    rows = [(i, cases.prose(i, 12, 9), f"l{i % 61}", "s") for i in range(183)] + [(900, None, "l1", "s"), (901, "12", "l2", "s")]
    docs = cases.frame(spark, rows)
    seen = lambda: sorted((str(r.doc_id), r.held_out, r.lang_pred, round(r.score, 9)) for r in lid.identify_languages(docs).collect())
    whole = seen()
    monkeypatch.setattr(lid, "BLOCK_LANGUAGES", 16)
    assert seen() == whole
    assert len(list(lid.prototype_blocks(lid.learn_prototypes(docs)))) >= 4


def test_many_labels_do_not_stop_the_query(spark):
    rows = [(i, f"word{i} text", f"label {i}", "s") for i in range(9000)]
    assert len(lid.identify_languages(cases.frame(spark, rows), dimensions=32).collect()) == 9000


def test_documents_of_no_language_go_and_clean_ones_stay(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    noise = [(10**6 + i, " ".join("qzxjkvwpfgh"[(i * j * 7 + j) % 11] * 2 + "xqzj"[j % 4] for j in range(1, 200)), None, "s", 9) for i in range(5)]
    table = docs.unionByName(spark.createDataFrame(noise, docs.schema))
    kept = {r.doc_id for r in lid.keep_identified(table).select("doc_id").collect()}
    lettered = {r.doc_id for r in docs.collect() if any(c.isalpha() for c in r.text or "")}
    assert kept <= lettered and len(kept) >= 0.995 * len(lettered)


def test_the_floor_and_the_prototypes_of_the_stage_come_from_all_documents(spark, monkeypatch):
    """A bound on the documents that other callers learn from changes nothing; the floor is that of all scores."""
    rows = [(i, cases.prose(i, 40), "ab"[i % 2] if i % 5 else None, "s") for i in range(120)]
    docs = cases.frame(spark, rows)
    monkeypatch.setattr(lid, "TRAIN_DOCS", 2)
    seen = []
    learn, floor = lid.learn_prototypes, lid.score_floor
    monkeypatch.setattr(lid, "learn_prototypes", lambda *a, **k: seen.append(learn(*a, **k)) or seen[-1])
    monkeypatch.setattr(lid, "score_floor", lambda judged, *a: seen.append((judged.count(), floor(judged, *a))) or seen[-1][1])
    lid.keep_identified(docs)
    model, (judged, least) = seen
    assert _model(model) == _model(learn(docs, train_docs=10**6)) and judged == 120
    scores = [r.language.score for r in lid.with_language(docs.where("lang is not null"), model).collect()]
    steps = np.round(np.array(scores) * lid.FLOOR_STEPS) / lid.FLOOR_STEPS
    assert least == pytest.approx(lid.FLOOR_SHARE * np.quantile(steps, lid.FLOOR_QUANTILE))
