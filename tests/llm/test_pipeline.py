"""The pipeline against the operators' own decisions, put together by hand."""

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_and_run(spark, sf):
    from test_operators import brute_components, words

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r for r in now.collect()}
        now = stage(spark, now, sf).cache()
        after = {r["doc_id"]: r for r in now.collect()}
        assert now.columns == docs.columns and all(before[i] == r for i, r in after.items()), name
        if name == "exact_dedup":
            best = {}
            for i, r in before.items():
                key = (r["text"] or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
                best[key] = max(i, best.get(key, i))
            assert set(after) == set(best.values())
        if name == "near_dedup":
            labels = brute_components([(i, r["text"]) for i, r in before.items()], 5)
            assert set(after) == {c for _, c in labels.values()}
    assert all(words(r["text"]) for r in after.values())
    packed = corpus_pipeline.run(spark, sf)
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} == set(after)


def test_awkward_tables(spark, tmp_path):
    """Nulls in all columns, a very long text, repeated rows, extra columns; and no documents at all."""
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, tree string, score double"
    plain = "the quick brown fox jumps over the lazy dog near the river bank while nobody looks"
    rows = [(i, f"{plain} {i} {i * 7}", "en", "s", 1, "x", 0.1) for i in range(40)] + [(None, None, None, None, None, None, None), (100, "", "en", "s", 0, "x", 0.1), (101, (plain + " ") * 20_000, "en", None, None, None, None)]
    rows += [(102, plain + " once more", "en", "s", 1, "x", 0.2)] * 2 + [(103, "12 34", None, "s", 1, "x", 0.1)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(40)] + [(None, None, None)], "doc_id bigint, quality int, toxic int")
    for name, table in (("full", rows), ("none", [])):
        folder = tmp_path / name
        spark.createDataFrame(table, schema).write.parquet(str(folder / "documents.parquet"))
        labels.write.parquet(str(folder / "labels.parquet"))
        out = corpus_pipeline.run(spark, str(folder)).collect()
        ids = {r["doc_id"] for r in out}
        assert ids == ({*range(40), 101, 102} if table else set()) or (table and 101 in ids and 102 in ids and not {None, 100, 103} & ids)
