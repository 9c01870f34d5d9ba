"""The pipeline's stages on a small corpus with known cases."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from meshvoyage.llm import storage


def test_stages_take_effect(spark, tmp_path):
    r = random.Random(8)
    words = {lang: ["".join(r.choices(letters, k=4)) for _ in range(120)] for lang, letters in (("en", "abcdefgh"), ("fr", "éèçlmnop"))}
    rows = [(i, " ".join(r.choices(words["fr" if i % 2 else "en"], k=80)), "fr" if i % 2 else "en", "s", 0) for i in range(40)]
    passage = " ".join(r.choices(words["en"], k=30))
    near = rows[0][1].split()
    near[3] = "changed"
    rows += [(50, rows[2][1], "en", "s", 0), (51, " ".join(near), "en", "s", 0), (52, passage + " " + rows[4][1], "en", "s", 0), (53, "123 456", None, "s", 0), (54, None, None, "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, left = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        left.append({x.doc_id for x in docs.select("doc_id").collect()})
    everything = set(range(40)) | {50, 51, 52}
    assert left == [everything, everything - {2}, everything - {2, 51}, everything - {2, 51, 52}]
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {x.doc_id for x in packed.select("doc_id").distinct().collect()} == left[-1]
    assert packed.agg(F.max("offset")).first()[0] < 2048


def test_odd_rows_and_an_empty_table(spark, tmp_path):
    """Null and repeated ids are rows like others; an empty table gives no pieces."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    r = random.Random(3)
    text = lambda n: " ".join("".join(r.choices("abcdefgh", k=4)) for _ in range(n))
    rows = [(i, text(40), "en", "s", 0) for i in range(12)]
    twin, bad = text(30), text(30)
    rows += [(None, text(40), None, None, None), (20, twin, "en", "s", 0), (20, bad, "en", "s", 0), (21, "", "en", "s", 0), (22, text(9000), "en", "s", 0)]
    spark.createDataFrame([(1, bad), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    pieces = corpus_pipeline.run(spark, str(tmp_path))
    got = pieces.groupBy("doc_id").agg(F.sum("length").alias("n"), F.first("doc_tokens").alias("all")).collect()
    assert {x.doc_id for x in got} == {*range(12), None, 20, 22} and all(x.n == x["all"] for x in got)
    empty = tmp_path / "empty"
    spark.createDataFrame([], schema).write.parquet(f"{empty}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{empty}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(empty)).count() == 0


def test_what_no_stage_reads_any_more_goes(spark, tmp_path, monkeypatch):
    """The join of near copies leaves no sets, and each stage's result goes after the next one's."""
    shared = tmp_path / "shared"
    monkeypatch.setattr(storage, "shared_dir", lambda spark: f"file://{shared}")
    text = " ".join(f"the word w{k} of" for k in range(60))
    rows = [(i, text + " end" * (i % 3), "en", "s", 1) for i in range(9)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([("a", "nothing of this is there")], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert {x.doc_id for x in corpus_pipeline.run(spark, str(tmp_path)).collect()} == {6}
    left = {p.name.split("-")[0] for p in (shared / "llm").iterdir()}
    assert "decontaminate" in left and not left & {"language_id", "exact_dedup", "near_dedup", "sets", "firsts", "own", "stars", "candidates", "pairs"}
