"""Every operator on untidy rows: nulls, empty and very long texts, repeated rows, clashing columns, empty tables."""

import pytest

from ledgerframe.llm import decontamination, exact_dedup, language_id, line_dedup, lm_scoring, mixing, ngram_join, pii, sharding, toxicity

LONG = "lorem ipsum dolor " * 12_000
CLASH = "doc_id long, text string, lang string, source string, n_chars long, score string, kept string, size string, spans string, shard_id string, class_id string, recipe string, n_lines string, hash string"
BENCH = "item_id long, text string"


def untidy():
    texts = [None, "", " ", "\n\n", "a", "A b", "ÄÖ ñandú ça – „x“ 日本語", "x" * 70_000, LONG, "same text here", "same text here", "+1 (743) 555-3824\t4111 1111 1111 1111", "💥 \U0001f600 tail"]
    rows = [(i, t, "en" if i % 3 else None, None if i % 4 == 0 else f"s{i % 3}", 0, *["c"] * 9) for i, t in enumerate(texts)]
    return [*rows, (None, "null id", "de", "s1", 0, *["c"] * 9), (None, None, None, None, None, *[None] * 9), rows[5], rows[5]]


LABELS = "doc_id long, quality int, toxic int"


def operators():
    def toxic(d):
        labels = d.sparkSession.createDataFrame([(4, 0, 1), (5, 1, 0), (4, 0, 0), (None, 1, 1), (9, None, None), (11, 1, 0)], LABELS)
        return toxicity.score(d, toxicity.fit(d, labels))

    def lm(d):
        c = lm_scoring.Counts(d, lm_scoring.remainder("doc_id", 7) != 2)
        return lm_scoring.score(c, lm_scoring.train(c, rounds=1))

    bench = lambda d: d.sparkSession.createDataFrame([(1, "same TEXT"), (2, None), (3, ""), (None, "ipsum dolor lorem")], BENCH)
    return {
        "sharding": (lambda d: sharding.shard(d, 100), ["shard_id", "local_depth", "overflow_page"]),
        "exact_dedup": (exact_dedup.mark_duplicates, ["keep_id", "group_size", "kept", "text_sha256"]),
        "decontamination": (lambda d: decontamination.find_contamination(d, bench(d)), ["n_words", "n_hit", "item_ids", "spans"]),
        "language_id": (lambda d: language_id.identify(d, language_id.fit(d)), ["lang_pred", "score"]),
        "ngram_join": (ngram_join.find_near_duplicates, ["class_id", "n_links"]),
        "mixing": (mixing.mix, ["size", "source_size", "target", "taken"]),
        "line_dedup": (lambda d: line_dedup.LineIndex.build(d, min_docs=2).drop_lines(d), ["n_lines", "n_dropped"]),
        "lm_scoring": (lm, ["n_tokens", "n_known", "base_score", "score"]),
        "pii": (lambda d: pii.find_pii(d, pii.fit(d)), ["base_spans", "all_spans"]),
        "toxicity": (toxic, ["score", "predicted"]),
    }


@pytest.mark.parametrize("name", list(operators()))
def test_untidy_rows(spark, name):
    run, columns = operators()[name]
    rows = untidy()
    out = run(spark.createDataFrame(rows, CLASH)).collect()
    assert len(out) == len(rows)
    assert set(columns) <= set(out[0].asDict())
    assert sorted(str(r.doc_id) for r in out) == sorted(str(r[0]) for r in rows)
    kept = [c.split()[0] for c in CLASH.split(", ") if c.split()[0] in out[0].asDict()]
    assert len(kept) >= 11 and "hash" in kept and all(r["hash"] in ("c", None) for r in out)


@pytest.mark.parametrize("name", list(operators()))
def test_empty_table(spark, name):
    run, columns = operators()[name]
    out = run(spark.createDataFrame([], CLASH))
    assert out.collect() == [] and set(columns) <= set(out.columns)


def test_defined_results(spark):
    d = spark.createDataFrame(untidy(), CLASH)
    same = {r.doc_id: r for r in exact_dedup.mark_duplicates(d).collect() if r.doc_id is not None}
    assert same[9].keep_id == 10 and not same[9].kept and same[10].kept and same[0].group_size == 3
    near = {r.doc_id: r for r in ngram_join.find_near_duplicates(d).collect() if r.doc_id is not None}
    assert near[9].class_id == near[10].class_id == 9 and near[9].n_links == 1
    assert near[0].n_links == near[1].n_links == 0 and near[0].class_id == 0 and near[5].n_copies == 3
    hits = {r.doc_id: r for r in decontamination.find_contamination(d, d.sparkSession.createDataFrame([(1, "same TEXT"), (3, "")], BENCH)).collect()}
    assert hits[9].n_hit == 2 and hits[9].item_ids == ["1"] and hits[0].n_words == 0 and hits[4].n_hit == 0
    said = {r.doc_id: r for r in language_id.identify(d, language_id.fit(d)).collect()}
    assert said[0].lang_pred == said[3].lang_pred == "und" and said[0].score == 0
    assert len(exact_dedup.deduplicate(d).collect()) == len({r[1] or "" for r in untidy()})
    # 9 and 10 are one and 5 repeats; what has no words stays
    assert len(ngram_join.keep_one(d).collect()) == len(untidy()) - 3


def test_filters_return_the_columns_they_got(spark):
    d = spark.createDataFrame(untidy(), CLASH)
    labels = spark.createDataFrame([(4, 0, 1), (5, 1, 0)], LABELS)
    bench = spark.createDataFrame([(1, "same TEXT")], BENCH)
    outs = [exact_dedup.deduplicate(d), ngram_join.keep_one(d), mixing.repeat(d), decontamination.remove_contamination(d, bench), decontamination.remove_contamination(d, bench, whole_documents=False), pii.redact(d, pii.train_field(["a b"])), toxicity.drop_toxic(d, toxicity.fit(d, labels))]
    for out in outs:
        assert out.columns == d.columns and out.count() > 5
        assert all(r.score in ("c", None) and r.size in ("c", None) for r in out.collect())
