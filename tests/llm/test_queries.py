"""Registered queries against their SQL, and the pipeline stage by stage, on the smallest tables."""

from collections import Counter

import pytest

from tests.conftest import DATA, rows
from tests.llm.test_operators import brute_components, brute_secrets, words
from tripmill.llm import registry

ORACLES = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, duck, name):
    got = registry.queries()[name](spark, DATA).toPandas()
    expected = duck.execute(ORACLES[name]).df()
    columns = sorted(expected.columns)
    assert sorted(got.columns) == columns
    assert rows(got, columns) == rows(expected, columns)


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, seen = docs.columns, {r.doc_id for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        stage(spark, docs, DATA).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        now = {r.doc_id for r in docs.select("doc_id").collect()}
        assert now <= seen and now
        if name != "packing":
            assert docs.columns == columns
        if name == "quality_classifier":
            scores = {r.doc_id: r.score for r in registry.queries()["op3_quality_classifier"](spark, DATA).collect()}
            assert now == {i for i, score in scores.items() if score >= 0.3}
        if name == "near_dedup":
            ids = sorted(before)
            assert docs.count() == len(now) and now == {i for i, _, _, kept in brute_components([before[i].text for i in ids], ids, 5) if kept}
        if name == "secret_scan":
            assert now == seen
            for r in docs.collect():
                assert not brute_secrets(r.text) and (r.text == before[r.doc_id].text or "[secret]" in r.text) and ("[secret]" in r.text or r == before[r.doc_id])
        if name == "mixing":
            size = lambda text: len(words(text))
            copies, longest = Counter(r.doc_id for r in docs.collect()), max(size(r.text) for r in before.values())
            mixed = sum(size(before[i].text) * n for i, n in copies.items())
            assert max(copies.values()) <= 3 and abs(mixed - sum(size(r.text) for r in before.values())) <= longest
        if name == "packing":
            whole = Counter(r.doc_id for r in docs.where("start = 0").select("doc_id").collect())
            assert whole == copies and docs.groupBy("sequence_id").sum("length").where("`sum(length)` > 2048").count() == 0
        seen = now
    whole = corpus_pipeline.run(spark, DATA)
    assert sorted(map(tuple, whole.select("doc_id", "piece", "start", "length", "ids_crc32").collect())) == sorted(map(tuple, docs.select("doc_id", "piece", "start", "length", "ids_crc32").collect()))


@pytest.mark.parametrize("rows", [0, 60])
def test_pipeline_takes_odd_rows(spark, tmp_path, rows):
    """Null, empty, repeated and long texts, missing and repeated ids, clashing columns, and no rows at all."""
    import random

    import corpus_pipeline

    rng = random.Random(2)
    word = lambda: rng.choice(["river", "stone", "light", "the", "of", "and", "walk", "calm"]) + str(rng.randrange(50))
    data = [(i, " ".join(word() for _ in range(rng.randint(30, 80))), "en", f"s{i % 3}", 1, 0.5, "k") for i in range(rows)]
    data += [(3, None, None, None, None, None, None), (None, "", "en", "s1", 0, 0.1, "k"), (None, None, "en", None, 0, 0.1, "k"), data[5], data[5], (1000, data[7][1], "en", "s2", 9, 0.2, "k"), (1001, "long " * 90_000, "de", "s1", 9, 0.2, "k")] if rows else []
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, kept string"
    spark.createDataFrame(data, schema).write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, int(i % 4 > 0), 0) for i in range(0, rows, 2)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        assert name == "packing" or out.columns == docs.columns
        out.write.parquet(str(tmp_path / f"{i}"))
        docs = spark.read.parquet(str(tmp_path / f"{i}"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count() and (docs.count() > 0) == (rows > 0)
