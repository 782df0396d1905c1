"""The pipeline's stages, each on what the one before kept."""

import random

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F

from typedlake.llm import decontaminate, quality

from .conftest import edited, plain_cosines, words


def test_stages(spark, tmp_path):
    rng = random.Random(4)
    items = [words(rng, 30) for _ in range(5)]
    good = [words(rng, rng.randint(30, 90)) for _ in range(200)]
    junk = [" ".join(w + "$$$" for w in words(rng, 60).split()) for _ in range(50)]
    copies = [edited(good[k] + " " + words(rng, 60), rng, 1) for k in range(3)]
    leaky = [good[k] + " " + items[k] for k in range(5, 10 - 1) if k < 5] + [words(rng, 80) + " " + i for i in items]
    texts = good + junk + copies + leaky + [None, ""]
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i, t, "en", f"s{i % 4}", len(t or "")) for i, t in enumerate(texts)], columns).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i < 200), 0) for i in range(0, 250, 2)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        columns = docs.columns
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == columns
        kept[name] = {r["doc_id"] for r in docs.select("doc_id").collect()}
    junk_ids, leaky_ids = set(range(200, 250)), {i for i, t in enumerate(texts) if t and any(x in t for x in items)}
    assert len(kept["quality_classifier"] & junk_ids) <= 2 and len(kept["quality_classifier"] & set(range(200))) >= 190
    assert kept["decontamination"] == kept["near_duplicates"] - leaky_ids
    assert kept["mixing"] <= kept["decontamination"]
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == docs.count() and {"shard", "slot", "text"} <= set(out.columns)
    assert corpus_pipeline.ORACLE_SQL is None and [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "near_duplicates", "decontamination", "mixing", "sharding"]


def test_decontamination_fits_on_all_documents(spark, tmp_path, monkeypatch):
    rng = random.Random(14)
    known = words(rng, 400).split()
    texts = [" ".join(rng.choices(known, k=rng.randint(1, 30))) for _ in range(2 * decontaminate.FITTED)]
    items = [" ".join(rng.choices(known, k=n)) for n in (20, 30, 40)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([*enumerate(items)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spaces, seen = decontaminate.spaces, []
    monkeypatch.setattr(decontaminate, "spaces", lambda *options: seen.extend(spaces(*options)) or iter(seen))
    corpus_pipeline.decontamination(spark, docs, str(tmp_path))
    assert len(seen) == 1 and np.abs(seen[0].windows @ seen[0].windows.T - plain_cosines(texts, seen[0].items, decontaminate.FITTED)).max() < 1e-3


def test_quality_classifier_learns_from_all_labels(spark, tmp_path, monkeypatch):
    """60,000 labelled documents, all different: each is in the models."""
    n = 60_000
    text = F.concat_ws(" ", *[F.concat(F.lit("good" if k else ""), F.hex(F.xxhash64("doc_id", F.lit(k)))) for k in range(5)])
    docs = spark.range(n).withColumnRenamed("id", "doc_id").withColumn("text", F.when(F.col("doc_id") % 10 == 0, F.regexp_replace(text, "good", "junk")).otherwise(text))
    spark.range(n).select(F.col("id").alias("doc_id"), (F.col("id") % 10 > 0).cast("int").alias("quality"), F.lit(0).alias("toxic")).write.parquet(str(tmp_path / "labels.parquet"))
    fit, seen = quality.fit, []
    monkeypatch.setattr(quality, "fit", lambda docs, classes, *options: seen.append(classes) or fit(docs, classes, *options))
    kept = corpus_pipeline.quality_classifier(spark, docs, str(tmp_path))
    assert {r["class"]: r["count"] for r in seen[0].groupBy("class").count().collect()} == {quality.TARGET: 54_000, quality.POOR: 6_000}
    assert kept.where("doc_id % 10 > 0").count() > 53_000 and kept.where("doc_id % 10 = 0").count() < 600
