"""Language identification and toxicity: plain versions, held-out accuracy, edge cases."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sporeline.llm import language_id, toxicity

SCHEMA = "doc_id long, text string, lang string"


def grams(word, order):
    padded = language_id.START * (order - 1) + word + language_id.END
    return [padded[i : i + order] for i in range(len(word) + 1)]


def plain_probability(words, order, discount, uniform, gram):
    """Interpolated Kneser-Ney by recursion over dictionaries."""
    tables = [{}]
    for w in words:
        for g in grams(w, order):
            tables[0][g] = tables[0].get(g, 0) + 1
    for _ in range(order - 1):
        lower = {}
        for g, n in tables[-1].items():
            lower[g[1:]] = lower.get(g[1:], 0) + (n if g[1] == language_id.START else 1)
        tables.append(lower)
    tables = tables[::-1]

    def p(g):
        if not g:
            return uniform
        held = tables[len(g) - 1]
        total = sum(n for x, n in held.items() if x[:-1] == g[:-1])
        if not total:
            return p(g[1:])
        kinds = sum(x[:-1] == g[:-1] for x in held)
        return max(0, held.get(g, 0) - discount) / total + discount * kinds / total * p(g[1:])

    return p(gram)


def test_word_costs_as_by_recursion():
    rng = random.Random(1)
    words = {x: ["".join(rng.choice("abc") for _ in range(rng.randint(1, 6))) for _ in range(40)] for x in ("p", "q")}
    top = {}
    for x, ws in words.items():
        for w in ws:
            for g in grams(w, 3):
                top[x, g] = top.get((x, g), 0) + 1
    m = language_id.Models.fit(["p", "q"], [(x, g, n) for (x, g), n in top.items()], order=3)
    for w in ("ab", "abcabc", "zz", "a"):
        costs = m.word_costs([w])[0]
        for i, x in enumerate(("p", "q")):
            want = -sum(math.log(plain_probability(words[x], 3, language_id.DISCOUNT, m.uniform, g)) for g in grams(w, 3))
            assert costs[i] == pytest.approx(want, rel=1e-9)


def test_languages_of_held_out_documents(spark, sf_dir):
    got = language_id.op2_language_id(spark, sf_dir)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text")
    rows = got.join(docs, "doc_id").where("held_out AND lang IS NOT NULL AND length(text) > 100").collect()
    assert len(rows) > 20
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_edge_cases(spark):
    rows = [(i, f"the cat and dog number {i}" if i % 2 else f"der Hund und Katze Nummer {i}", "en" if i % 2 else "de") for i in range(1, 60)]
    models = language_id.train(spark.createDataFrame(rows, SCHEMA))
    odd = [(None, None, None), (1, "", "x"), (2, "12 34 ?!", "de"), (3, "the dog", None), (3, "the dog", None), (4, "der Hund " * 20_000, "de"), (5, "漢字", "zh"), (6, "½² ①", "de")]
    got = language_id.predict(spark.createDataFrame([(*r, 0.5) for r in odd], SCHEMA + ", score double"), models).collect()
    assert [r.lang_pred for r in got[:6]] == ["und", "und", "und", "en", "en", "de"]
    assert got[0].score == got[2].score == 0 and 0 <= got[6].score <= 1
    assert got[7].lang_pred == "und" and got[7].score == 0
    assert language_id.predict(spark.createDataFrame([], SCHEMA), models).count() == 0
    nothing = language_id.train(spark.createDataFrame(rows, SCHEMA).where("false"))
    assert {r.lang_pred for r in language_id.predict(spark.createDataFrame(odd, SCHEMA), nothing).collect()} == {"und"}


def test_ordinal_fit_orders_thresholds_and_recovers_weights():
    rng = np.random.default_rng(3)
    n, w = 4000, np.array([2.0, -1.5, 0.0])
    x = rng.normal(size=(n, 3))
    latent = x @ w + rng.logistic(size=n)
    grades = (latent > 0.5).astype(int) + (latent > 2.5)
    rows, columns = np.repeat(np.arange(n), 3), np.tile(np.arange(3), n)
    weights, cuts = toxicity.fit_ordinal(rows, columns, x.ravel(), grades, 3, ridge=0.0)
    assert np.allclose(weights, w, atol=0.2) and np.allclose(cuts, [0.5, 2.5], atol=0.2) and cuts[0] < cuts[1]


def plain_likelihood(rows, columns, values, grades, weights, cuts, ridge):
    """Log-likelihood of the grades by loops over documents and grades, less the ridge."""
    total = 0.0
    for i, g in enumerate(grades):
        x = sum(v * weights[c] for r, c, v in zip(rows, columns, values) if r == i)
        above = [1.0, *(1 / (1 + math.exp(c - x)) for c in cuts), 0.0]
        total += math.log(max(above[g] - above[g + 1], 1e-9))
    return total / len(grades) - ridge * sum(w * w for w in weights) / 2


def test_ordinal_fit_is_a_maximum_of_the_plain_likelihood():
    rng = np.random.default_rng(5)
    n = 120
    x = rng.normal(size=(n, 2))
    grades = np.digitize(x @ [1.0, -1.0] + rng.logistic(size=n), [-0.5, 0.8, 2.0])
    rows, columns, values = np.repeat(np.arange(n), 2), np.tile(np.arange(2), n), x.ravel()
    weights, cuts = toxicity.fit_ordinal(rows, columns, values, grades, 2, ridge=0.01, steps=3000, rate=0.02)
    best = plain_likelihood(rows, columns, values, grades, weights, cuts, 0.01)
    for at in range(5):
        for step in (-0.1, 0.1):
            w, c = weights.copy(), cuts.copy()
            (w if at < 2 else c)[at % 2 if at < 2 else at - 2] += step
            assert plain_likelihood(rows, columns, values, grades, w, c, 0.01) < best


def auc(scores, positive):
    yes, no = (np.array([x for x, y in zip(scores, positive, strict=True) if y == z]) for z in (True, False))
    return ((yes[:, None] > no).sum() + (yes[:, None] == no).sum() / 2) / (len(yes) * len(no))


def test_toxic_documents_are_told_apart(spark, sf_dir):
    """The query, on labelled documents that its model wasn't fitted on."""
    sf_dir = sf_dir.replace("sf0.001", "sf0.1")  # the smallest table has a few toxic documents only
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where("toxic IS NOT NULL AND pmod(xxhash64(doc_id), 5) = 4")
    rows = toxicity.op6_toxicity(spark, sf_dir).join(labels.select("doc_id", F.col("toxic").alias("label")), "doc_id").collect()
    toxic, clean = [r for r in rows if r.label == 1], [r for r in rows if r.label == 0]
    assert toxic and len(clean) > 10
    assert auc([r.severity for r in rows], [r.label == 1 for r in rows]) > 0.95
    assert sum(r.toxic for r in toxic) >= 0.8 * len(toxic) and sum(r.toxic for r in clean) <= 0.05 * len(clean)


def test_grades_have_a_threshold_each(spark):
    rng = random.Random(6)
    kinds = [["calm", "nice", "kind"], ["rude", "mean", "snide"], ["vile", "foul", "cruel"]]
    rows = []
    for i in range(600):
        g = rng.randrange(3)
        rows.append((i, " ".join([rng.choice(kinds[g]) for _ in range(4)] + [rng.choice(["stone", "river", "cloud", "table"]) for _ in range(8)]), g))
    data = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(data.select("doc_id", "text"), data.select("doc_id", "toxic"))
    assert len(model.thresholds) == 2 and model.thresholds[0] < model.thresholds[1]
    got = toxicity.score(data, model).join(data.select("doc_id", F.col("toxic").alias("grade")), "doc_id").collect()
    means = [np.mean([r.severity for r in got if r.grade == g]) for g in range(3)]
    assert means[0] < 0.4 < 0.6 < means[1] < 1.4 < 1.6 < means[2]
    assert toxicity.train(data.select("doc_id", "text"), data.select("doc_id", "toxic").where("false")).thresholds == []


def test_toxicity_edge_cases(spark):
    rows = [(i, "bad vile words here" if i % 3 == 0 else f"nice calm text {i}") for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(90)] + [(None, 1), (5, None), (999, 1), (3, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    odd = spark.createDataFrame([(None, None, 1.0), (1, "", 1.0), (2, "123", 1.0), (3, "bad vile words", 1.0), (3, "bad vile words", 1.0), (4, "nice calm text " * 5000, 1.0)], "doc_id long, text string, severity double")
    got = toxicity.score(odd, model).collect()
    assert got[3].toxic and got[4].toxic and not got[5].toxic and got[0].severity == got[1].severity == got[2].severity
    assert toxicity.score(odd.where("false"), model).count() == 0
    assert {r.severity for r in toxicity.score(odd, toxicity.train(docs, labels.where("toxic = 0"))).collect()} == {0.0}


def test_a_language_with_many_texts_is_cut_before_the_shuffle(spark):
    docs = spark.range(5000).selectExpr("id AS doc_id", "'the cat' AS text", "if(id < 0, 'de', 'en') AS lang")
    models = language_id.train(docs, fitted=100, calibrating=50)
    assert models.languages == ["en"]
    ranked = docs.withColumn("r", F.row_number().over(language_id.Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))).where(F.col("r") <= max(language_id.FITTED, language_id.CALIBRATING))
    assert "WindowGroupLimit" in ranked._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("small", [0, 1000])
def test_sparse_tables_hold_what_each_language_has(monkeypatch, small):
    monkeypatch.setattr(language_id, "SMALL", small)
    held = [{"ab": (1.0, 2.0), "cd": (3.0, 4.0)}, {}, {"cd": (5.0, 6.0)}]
    kept = language_id.Sparse.of(held, 2, 2)
    keys = [language_id._hashes(language_id._codes(g), 2)[1] for g in ("cd", "zz", "ab")]
    a, b = kept.find(np.array(keys, np.uint64), 3, (0.0, 1.0))
    assert a.tolist() == [[3, 0, 5], [0, 0, 0], [1, 0, 0]] and b.tolist() == [[4, 1, 6], [1, 1, 1], [2, 1, 1]]


def test_models_built_by_spark_are_those_of_dictionaries(spark):
    rng = random.Random(4)
    rows = [(i, " ".join("".join(rng.choice("abcdé漢") for _ in range(rng.randint(1, 7))) for _ in range(20)), x) for i, x in enumerate(["p", "q", "r"] * 5)]
    top = language_id.top_counts(spark.createDataFrame(rows, SCHEMA), 4)
    got = language_id.models_of(top, 4)
    want = language_id.Models.fit(["p", "q", "r"], [(x.lang, x.gram, x.n) for x in top.collect()], 4)
    assert got.languages == want.languages and got.uniform == want.uniform
    for a, b in zip(got.grams + got.contexts, want.grams + want.contexts, strict=True):
        assert all((getattr(a, c) == getattr(b, c)).all() for c in ("hashes", "starts", "languages", "values"))


def test_every_label_is_learned_however_rare(spark):
    rows = [(3 * k + i, f"{chr(0x4E00 + k)}{chr(0x4E00 + k)} {chr(0x4E00 + k)}", f"x{k:03}") for k in range(600) for i in range(3)]
    models = language_id.train(spark.createDataFrame([*rows, (9999, "only", "one")], SCHEMA))
    assert len(models.languages) == 601
    got = language_id.predict(spark.createDataFrame([(1, chr(0x4E00 + 550) * 2, None), (2, "only", None)], SCHEMA), models).collect()
    assert [r.lang_pred for r in got] == ["x550", "one"]


def test_equal_languages_go_by_name_and_unlike_texts_are_rejected(spark):
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(40)]
    rows = [(i, " ".join(rng.choices(vocabulary, k=30)), "aa") for i in range(400)]
    docs = spark.createDataFrame(rows, SCHEMA)
    models = language_id.train(docs)
    odd = spark.createDataFrame([(i, "xyzzyx qwvvkk zzzz " * 5, None) for i in range(5)], SCHEMA)
    own = language_id.predict(docs, models).collect()
    assert sum(r.accepted for r in own) >= 0.95 * len(own)
    assert set(models.limits) == {"aa"} and not any(r.accepted for r in language_id.predict(odd, models).collect())
    twice = docs.selectExpr("doc_id", "text", "lang").unionByName(docs.selectExpr("doc_id", "text", "'AB' AS lang"))
    assert {r.lang_pred for r in language_id.predict(docs, language_id.train(twice)).collect()} == {"AB"}


def plain_costs(texts, order=language_id.ORDER, discount=language_id.DISCOUNT):
    """A function of a word and the uniform chance: its nats under the Kneser-Ney model of these texts, by dictionaries."""
    tables = [{}]
    for t in texts:
        for w in language_id.words_of(t):
            for g in grams(w, order):
                tables[0][g] = tables[0].get(g, 0) + 1
    for _ in range(order - 1):
        lower = {}
        for g, n in tables[-1].items():
            lower[g[1:]] = lower.get(g[1:], 0) + (n if g[1] == language_id.START else 1)
        tables.append(lower)
    after = {}
    for held in tables:
        for g, n in held.items():
            x = after.setdefault(g[:-1], [0, 0])
            after[g[:-1]] = [x[0] + n, x[1] + 1]
    tables = {len(next(iter(h))): h for h in tables}

    def p(g, uniform):
        if not g:
            return uniform
        if g[:-1] not in after:
            return p(g[1:], uniform)
        total, kinds = after[g[:-1]]
        return max(0, tables[len(g)].get(g, 0) - discount) / total + discount * kinds / total * p(g[1:], uniform)

    return tables[1], lambda w, uniform: -sum(math.log(p(g, uniform)) for g in grams(w, order))


def test_query_as_by_dictionaries(spark, sf_dir):
    """Of sf0.001 every labelled document is within the sample, so the query's languages, scores and limits follow from all of them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", F.expr("crc32(string(doc_id)) % 3 = 1").alias("out"), F.expr("pmod(xxhash64(doc_id), 5) = 4").alias("kept")).collect()
    learned = [r for r in docs if not r.out and r.lang is not None and r.text is not None]
    names = sorted({r.lang for r in learned})
    models = {x: plain_costs([r.text for r in learned if r.lang == x and not r.kept]) for x in names}
    uniform = 1 / len({g for held, _ in models.values() for g in held})
    costs = {}

    def entropy(words, x):
        for w in words:
            if (w, x) not in costs:
                costs[w, x] = models[x][1](w, uniform)
        return sum(costs[w, x] for w in words) / sum(len(w) + 1 for w in words)

    want = {}
    for r in docs:
        words = language_id.words_of(r.text)
        want[r.doc_id] = {x: entropy(words, x) for x in names} if words else None
    got = {r.doc_id: r for r in language_id.op2_language_id(spark, sf_dir).collect()}
    assert set(got) == set(want)
    for d, h in want.items():
        if h is None:
            assert got[d].lang_pred == "und" and got[d].score == 0
            continue
        best = min(names, key=lambda x: h[x])
        n = sum(len(w) + 1 for w in language_id.words_of(next(r.text for r in docs if r.doc_id == d)))
        assert got[d].lang_pred == best and got[d].cross_entropy == pytest.approx(h[best], rel=1e-9)
        assert got[d].score == pytest.approx(1 / sum(math.exp(-min(n, language_id.EVIDENCE) * (h[x] - h[best])) for x in names), rel=1e-6)
