"""The corpus pipeline: each stage against a plain version of what it must do."""

import random

import corpus_pipeline
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sporeline.llm import decontamination, quality_rules, simhash_dedup
from sporeline.llm._shared import materialize


def test_stages_one_by_one(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        kept.append(materialize(stage(spark, kept[-1], sf_dir), name))
    assert all(k.columns == columns for k in kept[:-1])
    rows = [{r.doc_id: r.text for r in k.select("doc_id", "text").collect()} for k in kept[:-1]]
    judged = {r.doc_id: r.kept for r in quality_rules.op10_quality_rules(spark, sf_dir).collect()}
    assert set(rows[1]) == {d for d, k in judged.items() if k}
    fps = {d: simhash_dedup.fingerprint(t) for d, t in rows[1].items()}
    for d in rows[1]:  # who goes has a near-duplicate, and no two that stay are near-duplicates
        near = [x for x in rows[1] if x != d and (fps[x] ^ fps[d]).bit_count() <= 4]
        assert d in rows[2] or near
        assert d not in rows[2] or not set(near) & set(rows[2])
    assert set(rows[3]) <= set(rows[2])
    matcher = decontamination.Matcher([(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()])
    assert rows[4] == {d: t for d, t in rows[3].items() if not matcher.match(t)}
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    coded = kept[-1].collect()
    assert {r.doc_id for r in coded} == set(rows[4])
    for r in coded:
        assert r.decoded == rows[4][r.doc_id] and r.ids == library.encode(r.decoded, add_special_tokens=False).ids and r.n_tokens == len(r.ids)


def test_run_gives_the_last_stage(spark, sf_dir):
    got = corpus_pipeline.run(spark, sf_dir)
    assert got.columns == ["doc_id", "n_tokens", "ids", "decoded"] and got.count() > 50


def sentences(seed, n):
    """Prose that passes the quality rules: n words, a line for each twelve."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randint(3, 8))) for _ in range(n)]
    words[::6] = ["the"] * len(words[::6])
    words[3::6] = ["and"] * len(words[3::6])
    return "\n".join(" ".join(words[i : i + 12]) + "." for i in range(0, n, 12))


def test_stages_on_nulls_ties_long_texts_and_clashing_columns(spark, tmp_path):
    shared = sentences(99, 96)
    texts = [(1, sentences(1, 120)), (2, sentences(2, 120) + "\n" + shared), (3, sentences(3, 120) + "\n" + shared), (4, None), (5, ""), (6, sentences(6, 40_000)), (7, sentences(7, 120)), (7, sentences(7, 120)), (8, sentences(7, 120)), (None, sentences(9, 120)), (10, "###")]
    docs = spark.createDataFrame([(d, t, "s", i, {"k": i}) for i, (d, t) in enumerate(texts)], "doc_id long, text string, source string, salt int, key map<string,int>").withColumn("gone", F.array("key"))
    items = spark.createDataFrame([(1, sentences(1, 60)), (2, None), (None, "")], "item_id long, text string")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES:
        kept.append(materialize(stage(spark, kept[-1], str(tmp_path)), name))
    assert all(k.columns == docs.columns for k in kept[:-1])
    ids = [sorted((r.doc_id for r in k.select("doc_id").collect()), key=lambda d: (d is None, d)) for k in kept]
    assert ids[1] == [1, 2, 3, 6, 7, 7, 8, None] and ids[2] == [1, 2, 3, 6, 7, 7, None]
    cut = {r.doc_id: r.text for r in kept[3].collect()}
    before = dict(texts)
    loser = docs.where("doc_id IN (2, 3)").orderBy(F.xxhash64("text").desc()).first().doc_id
    assert {d for d in cut if cut[d] != before[d]} == {loser}  # the text of the lowest key keeps the passage, the other loses it and nothing else
    assert cut[loser].split() == sentences(loser, 120).split()
    assert ids[4] == [2, 3, 6, 7, 7, None] and ids[5] == ids[4]
    for d, t in {r.doc_id: r.decoded for r in kept[-1].collect()}.items():
        assert t == cut[d]


def test_empty_tables_go_through_all_stages(spark, tmp_path):
    docs = spark.createDataFrame([(1, sentences(1, 120))], "doc_id long, text string")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for x, n in ((docs.where("false"), 0), (docs, 1)):
        for name, stage in corpus_pipeline.STAGES:
            x = materialize(stage(spark, x, str(tmp_path)), name)
        assert x.count() == n
