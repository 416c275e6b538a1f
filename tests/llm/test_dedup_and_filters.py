"""SimHash, decontamination, quality rules, and URL filters, against plain versions and SQL."""

import random
import re

import numpy as np
import pytest
import xxhash
from compare import assert_same

from pyspark.sql import functions as F

from sporeline.llm import decontamination, quality_rules, simhash_dedup, url_filters
from sporeline.llm._components import components
from sporeline.llm._edits import distance

SCHEMA = "doc_id long, text string"


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    k = min(4, len(words))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + k]).encode(), 42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, fps):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                root[find(i)] = find(j)
    groups = {}
    for i, d in enumerate(ids):
        groups.setdefault(find(i), []).append(d)
    named = {k: min((d for d in v if d is not None), default=None) for k, v in groups.items()}
    return [named[find(i)] for i in range(len(ids))]


def test_fingerprints_and_components_as_all_pairs(spark):
    rng = random.Random(1)
    rows = [(None, None), (1, ""), (2, " \t\n"), (3, "Ä one"), (4, "ÄÖ a b c d"), (5, "x" * 50_000), (6, "\x1c\x85 a　b")]
    for i in range(60):
        words = [rng.choice("abcdefgh") * rng.randint(1, 4) for _ in range(rng.randint(1, 300))]
        rows.append((10 + i, " ".join(words)))
        for k in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = rng.choice("XYZ")
            rows.append((100 + 10 * i + k, " ".join(words)))
    rows += rows[20:40]
    docs = spark.createDataFrame([(*r, "q") for r in rows], SCHEMA + ", component_id string")
    got = simhash_dedup.near_duplicates(docs).collect()
    fps = [plain_fingerprint(t) for _, t in rows]
    want = sorted((str(d), f"{f:016x}", str(c)) for (d, _), f, c in zip(rows, fps, plain_components([d for d, _ in rows], fps), strict=True))
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == want
    assert simhash_dedup.near_duplicates(docs.where("false")).count() == 0
    kept = simhash_dedup.one_of_each(docs)
    assert kept.columns == docs.columns
    firsts = {c for _, _, c in want if c != "None"}
    assert {str(r.doc_id) for r in kept.collect() if r.doc_id is not None} == firsts


def test_triples_meet_every_pair_that_shares_four_bytes():
    from itertools import combinations

    assert all(any(set(t) <= set(four) for t in simhash_dedup.TRIPLES) for four in combinations(range(8), 4))


def test_a_list_of_near_copies_links_as_all_pairs():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 64, 40, dtype=np.uint64)
    fps = np.unique(np.concatenate([base, *(base ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)) for _ in range(6))]))
    links = [(int(x), int(y)) for a, b in simhash_dedup.list_links(np.zeros(len(fps), np.int32), fps, 4) for x, y in zip(a, b, strict=True)]
    assert all((x ^ y).bit_count() <= 4 for x, y in links)
    ids = fps.tolist()
    at = {f: i for i, f in enumerate(ids)}
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, y in links:
        root[find(at[x])] = find(at[y])
    want = plain_components(list(range(len(ids))), ids)
    assert len({find(i) for i in range(len(ids))}) == len(set(want)) and len({(find(i), w) for i, w in enumerate(want)}) == len(set(want))


def test_many_postings_in_a_partition_and_split_lists_link_as_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(5)
    near = rng.integers(0, 1 << 63, 6_000, np.int64)
    family = rng.integers(0, 1 << 40, 4_000, np.int64) << 24 | 0x123456  # one triple of bytes is common
    flips = np.array([(1 << rng.choice(63, rng.integers(1, 5), replace=False).astype(np.int64)).sum() for _ in range(2_000)])
    fps = np.unique(np.r_[near, near[:2_000] ^ flips, family, family[:1_000] ^ (1 << 30 | 1 << 50 | 1 << 55), rng.integers(0, 1 << 63, 3_000, np.int64)])
    u = fps.view(np.uint64)
    want = {(int(x), int(y)) for i, x in enumerate(u) for y in u[i + 1 :][np.bitwise_count(u[i + 1 :] ^ x) <= 4]}
    frame = spark.createDataFrame([(int(x),) for x in fps], "fp long")
    held = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        assert len(fps) * len(simhash_dedup.TRIPLES) > 1 << 18
        for smaller in ({}, {"LONG": 1_000, "ROWS": 1 << 12}):
            for name, value in smaller.items():
                monkeypatch.setattr(simhash_dedup, name, value)
            got = {tuple(sorted((r.a % (1 << 64), r.b % (1 << 64)))) for r in simhash_dedup.links(frame).collect()}
            assert got <= want
            assert plain_roots(u.tolist(), got) == plain_roots(u.tolist(), want)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held)


def plain_roots(nodes, edges):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            root[n] = n = root[root[n]]
        return n

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def test_components_of_a_long_path(spark):
    edges = spark.range(300).selectExpr("id AS a", "id + 1 AS b").unionByName(spark.range(5).selectExpr("1000 + id AS a", "1000 + id AS b"))
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == dict.fromkeys(range(301), 0)


def plain_matches(text, item):
    words, pattern = decontamination.words_of(text), decontamination.words_of(item)
    edits = len(pattern) // decontamination.WORDS_AN_EDIT
    ends = [distance(pattern, words[a:b]) for a in range(len(words)) for b in range(a + 1, min(len(words), a + len(pattern) + edits) + 1)]
    return bool(pattern) and min(ends, default=10**9) <= edits


def test_items_are_found_as_by_trying_all_windows(spark):
    rng = random.Random(2)
    word = lambda: rng.choice("abcdefghijklmnop") + rng.choice("xyz")
    items = [(i, " ".join(word() for _ in range(rng.randint(8, 30)))) for i in range(12)] + [(20, ""), (21, None), (None, "aa bb cc dd ee ff gg hh ii"), (22, "?!")]
    docs = [(0, None), (1, ""), (2, "...")]
    for i in range(60):
        words = [word() for _ in range(rng.randint(0, 40))]
        if i % 2:
            own = items[rng.randrange(12)][1].split()
            for _ in range(rng.randint(0, 4)):
                own[rng.randrange(len(own))] = "Q" * rng.randint(1, 2)
            at = rng.randint(0, len(words))
            words[at:at] = own
        docs.append((10 + i, ", ".join(words)))
    table = spark.createDataFrame([(*d, "x") for d in docs], SCHEMA + ", item_id string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {(d, i) for d, t in docs for i, x in items if t and x and plain_matches(t, x)}
    assert len(want) > 15
    got = decontamination.contaminated(table, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want
    few = decontamination.contaminated(table, bench, limit=200).collect()  # several blocks
    assert sorted(map(tuple, few), key=str) == sorted(map(tuple, got), key=str)
    left = decontamination.without_items(table, bench, limit=200)
    assert left.columns == table.columns and {r.doc_id for r in left.collect()} == {d for d, _ in docs} - {d for d, _ in want}
    assert decontamination.contaminated(table, bench.where("false")).count() == decontamination.contaminated(table.where("false"), bench).count() == 0


def plain_measures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = {}
    for i in range(len(words) - 4):
        windows.setdefault(tuple(words[i : i + 5]), []).append(i)
    repeated = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(5)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(repeated))


def test_quality_counts(spark):
    rng = random.Random(3)
    rows = [(None, None), (1, ""), (2, " \n\t "), (3, "a b c d e a b c d e a b"), (4, "x\n\n x\nx\ny"), (5, "é🙂 #$ <b>"), (6, "a b c d e f g h i j " * 400), (6, "\x0b\x0ca\x85b"), (7, "a" * 40_000)]
    rows += [(10 + i, " ".join(rng.choice(["a", "b", "the", "#", "\n", "c\n"]) for _ in range(rng.randint(0, 60)))) for i in range(80)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA + ", n_words int")
    got = quality_rules.apply_rules(docs.select("doc_id", "text")).collect()
    for (_, t), r in zip(rows, got, strict=True):
        want = plain_measures(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, t
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r.kept and r.base_failed)
    kept = quality_rules.kept_rows(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.text) for r in kept.collect()) == sorted(str(t) for (_, t), r in zip(rows, got, strict=True) if r.kept)
    assert quality_rules.apply_rules(docs.select("doc_id", "text").where("false")).count() == 0


def test_quality_runs_no_python(spark, sf_dir):
    for df in (quality_rules.op10_quality_rules(spark, sf_dir), quality_rules.kept_rows(spark.read.parquet(f"{sf_dir}/documents.parquet"))):
        assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString())


@pytest.mark.parametrize("module", [quality_rules, url_filters])
def test_same_rows_as_sql(spark, duck, sf_dir, module):
    for name, sql in module.ORACLES.items():
        assert assert_same(module.QUERIES[name](spark, sf_dir), duck, sql) > 0


def test_captures_meet_the_entries_of_their_day(spark):
    changes = [("a.com", "2024-01-10", "block"), ("a.com", "2024-02-01", "remove"), ("b.a.com", "2024-01-20", "allow"), ("a.com", "2024-03-01", "block"), ("a.com", "2024-03-01", "allow"), (None, "2024-01-01", "block"), ("c.org", None, "block"), ("d.net", "2024-01-01", "x")]
    captures = [(1, "http://a.com/x", "2024-01-09"), (2, "http://a.com/x", "2024-01-10"), (3, "https://www.A.com:80/", "2024-01-31"), (4, "http://a.com", "2024-02-01"), (5, "http://z.b.a.com/", "2024-01-21"), (6, "http://z.b.a.com/", "2024-01-15"), (7, None, "2024-01-15"), (8, "nonsense", "2024-01-15"), (9, "http://a.com", None), (9, "http://user@a.com/p?q", "2024-03-05"), (10, "http://ba.com/", "2024-01-15")]
    listed = spark.createDataFrame(changes, "pattern string, changed_on string, action string").selectExpr("pattern", "cast(changed_on AS date) AS changed_on", "action")
    seen = spark.createDataFrame(captures, "page_id long, url string, fetched_on string").selectExpr("page_id", "url", "cast(fetched_on AS date) AS fetched_on", "'q' AS pattern")
    got = sorted((r.page_id, str(r.fetched_on), r.action, r.blocked) for r in url_filters.judge(seen, listed).collect())
    assert [(p, a, b) for p, _, a, b in got] == [(1, None, False), (2, "block", True), (3, "block", True), (4, None, False), (5, "allow", False), (6, "block", True), (7, None, False), (8, None, False), (9, "block", True), (9, None, False), (10, None, False)] or got
    assert {p: b for p, _, _, b in got if p != 9} == {1: False, 2: True, 3: True, 4: False, 5: False, 6: True, 7: False, 8: False, 10: False}
    assert url_filters.judge(seen, listed.where("false")).where("blocked").count() == 0
    assert url_filters.judge(seen.where("false"), listed).count() == 0


def test_a_listed_domain_covers_hosts_of_many_labels(spark):
    urls = [(1, "http://a.b.c.d.e.f.g.h.i.j.example.com/x"), (2, "http://a.b.c.d.e.f.g.h.i.j.example.org/x")]
    captures = spark.createDataFrame(urls, "page_id long, url string").selectExpr("*", "DATE '2024-02-01' AS fetched_on")
    changes = spark.createDataFrame([("example.com", "block")], "pattern string, action string").selectExpr("*", "DATE '2024-01-01' AS changed_on")
    got = {r.page_id: (r.pattern, r.blocked) for r in url_filters.judge(captures, changes).collect()}
    assert got == {1: ("example.com", True), 2: (None, False)}


def test_kept_columns_with_names_of_result_columns(spark):
    docs = spark.createDataFrame([(1, "the cat and the dog " * 3, 7, "h")], "doc_id long, text string, n_words long, host string")
    got = quality_rules.apply_rules(docs, keep=("doc_id", "n_words", "host")).first()
    assert (got.doc_id, got.kept_n_words, got.host, got.n_words) == (1, 7, "h", 15)
    captures = spark.createDataFrame([(1, "http://spam.org/x", 7, "h")], "page_id long, url string, blocked int, host string").withColumn("fetched_on", F.to_date(F.lit("2024-02-01")))
    changes = spark.createDataFrame([("spam.org", "2024-01-01", "block")], "pattern string, changed_on string, action string").withColumn("changed_on", F.to_date("changed_on"))
    got = url_filters.judge(captures, changes, keep=("page_id", "blocked", "host")).first()
    assert (got.page_id, got.kept_blocked, got.kept_host, got.host, got.blocked) == (1, 7, "h", "spam.org", True)
    names = "doc_id long, text string, gone long, first boolean, fp long, component_id long, key string"
    held = spark.createDataFrame([(1, "a b c d e f", 1, True, 2, 3, "k"), (2, "a b c d e f", 1, True, 2, 3, "k")], names)
    kept = simhash_dedup.one_of_each(held)
    assert kept.columns == held.columns and [r.doc_id for r in kept.collect()] == [1]


def test_clean_texts_in_other_languages_are_kept(spark):
    russian = "Солнце медленно поднималось над рекой когда старый рыбак вышел из дома и посмотрел на далёкий берег. " * 1
    texts = [" ".join(f"{w}{i}" for i in range(6) for w in russian.split()), "Słońce powoli wschodziło nad rzeką " + " ".join(f"kiedy{i} stary rybak{i} wyszedł{i} z domu{i} i nie{i} spojrzał{i} na brzeg{i}" for i in range(8))]
    rows = quality_rules.apply_rules(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert all(r.kept and r.n_words >= 60 for r in rows)


def test_a_popular_domain_and_a_popular_host(spark):
    captures = spark.range(20000).selectExpr("id AS page_id", "CASE WHEN id % 3 = 0 THEN 'http://one.big.com/' WHEN id % 3 = 1 THEN concat('http://h', id, '.big.com/') ELSE concat('http://', id, '.org/') END AS url", "DATE '2024-02-01' AS fetched_on")
    changes = spark.createDataFrame([("big.com", "block"), ("one.big.com", "allow")], "pattern string, action string").withColumn("changed_on", F.to_date(F.lit("2024-01-01")))
    got = {(r.kind, r.blocked): r.n for r in url_filters.judge(captures, changes).groupBy(F.expr("page_id % 3").alias("kind"), "blocked").agg(F.count("*").alias("n")).collect()}
    assert got == {(0, False): 6667, (1, True): 6667, (2, False): 6666}
