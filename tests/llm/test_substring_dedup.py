"""Substring dedup against plain comparisons of all pairs, and its edge cases."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from sporeline.llm import substring_dedup as S
from sporeline.llm._edits import distance, distances

SCHEMA = "doc_id long, text string"


def prose(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6))) for _ in range(n)]


def fuzzy(rng: random.Random, words: list[str], every: int) -> list[str]:
    """words with one of every so many replaced, dropped or doubled."""
    out = []
    for i, w in enumerate(words):
        how = rng.choice("rdi") if i % every == every // 2 else ""
        out += {"": [w], "r": ["zz" + w], "d": [], "i": [w, "yy"]}[how]
    return out


def plain_distances(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (p != t)))
        row = new
    return row[1:]


def test_bit_vectors_give_edit_distances():
    rng = random.Random(3)
    for _ in range(300):
        a, b = [rng.choice("abc") for _ in range(rng.randint(0, 70))], [rng.choice("abc") for _ in range(rng.randint(1, 70))]
        assert distances(a, b) == plain_distances(a, b)
        row = list(range(len(b) + 1))
        for i, p in enumerate(a, 1):
            new = [i]
            for j, t in enumerate(b, 1):
                new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (p != t)))
            row = new
        assert distance(a, b) == row[-1]


def plain_chain_scores(anchors):
    """The best score by comparing all pairs of anchors."""
    n, score = len(anchors), {}
    for i in sorted(range(n), key=lambda i: (anchors[i][0], anchors[i][2])):
        p0, p1, r0, r1 = anchors[i]
        gains = [score[j] - S.GAP * (p0 - anchors[j][1] + r0 - anchors[j][3] - 2 * S.SEED) for j in score if anchors[j][1] < p0 and anchors[j][3] < r0]
        score[i] = p1 - p0 + S.SEED + max([0.0, *gains])
    return max(score.values())


def test_fenwick_chains_score_as_all_pairs():
    rng = random.Random(4)
    for _ in range(200):
        anchors = []
        for _ in range(rng.randint(1, 30)):
            p, r, n = rng.randint(0, 80), rng.randint(0, 80), rng.randint(0, 10)
            anchors.append([p, p + n, r, r + n])
        best = S.chain_anchors(np.array(anchors))[0]
        score = 0.0
        for k, i in enumerate(best):
            p0, p1, r0, r1 = anchors[i]
            gain = score - S.GAP * (p0 - anchors[best[k - 1]][1] + r0 - anchors[best[k - 1]][3] - 2 * S.SEED) if k else 0.0
            assert not k or gain > 0
            score = p1 - p0 + S.SEED + gain
        assert score == pytest.approx(plain_chain_scores(anchors))


def test_every_long_equal_run_shares_a_seed():
    rng = random.Random(5)
    words = S.WordHashes()
    for _ in range(100):
        same = prose(rng, S.SEED + S.WINDOW - 1)
        a, b = (words.of(" ".join(prose(rng, rng.randint(0, 30)) + same + prose(rng, rng.randint(0, 30)))) for _ in range(2))
        h, owner, _ = S.seeds_of([a, b])
        assert set(h[owner == 0]) & set(h[owner == 1])


def test_planted_passages_are_found_and_clean_texts_left_alone(spark):
    rng = random.Random(6)
    passages = [prose(rng, n) for n in (52, 60, 75, 120, 300)]
    docs, planted = [], {}
    for i in range(120):
        body = prose(rng, rng.randint(60, 400))
        k = rng.randrange(len(passages)) if i % 2 else None
        if k is not None:
            at = rng.randint(0, len(body))
            body[at:at] = fuzzy(rng, passages[k], 15) if i % 4 == 1 else passages[k]
            planted.setdefault(k, []).append(i)
        docs.append((i, " ".join(body)))
    rows = S.repeated(spark.createDataFrame(docs, SCHEMA).repartition(5)).collect()
    for ids in planted.values():  # all but the text that has the original
        assert len(set(ids) - {r.doc_id for r in rows}) <= 1
        assert set(ids) <= {r.doc_id for r in rows} | {o for r in rows for o in r.others}
    touched = {r.doc_id for r in rows} | {o for r in rows for o in r.others}
    assert touched <= {i for ids in planted.values() for i in ids}
    for r in rows:
        a, b = docs[r.doc_id][1].split()[r.chain_start : r.chain_end], docs[r.other_id][1].split()[r.other_start : r.other_end]
        assert r.edits >= distance(a, b) and r.edits <= (1 - S.SIMILAR) * max(len(a), len(b))
        assert r.end_word - r.start_word >= S.MIN_WORDS


def test_a_passage_in_every_text_makes_one_row_for_each(spark):
    rng = random.Random(7)
    passage = prose(rng, 80)
    docs = [(i, " ".join(prose(rng, 40) + passage + prose(rng, 40))) for i in range(400)]
    rows = S.repeated(spark.createDataFrame(docs, SCHEMA).repartition(7)).collect()
    assert len({r.doc_id for r in rows}) == len(rows) == 399


def test_edge_cases(spark):
    long = " ".join(prose(random.Random(8), 60_000))
    text = " ".join(prose(random.Random(9), 100))
    rows = [(1, None, "a"), (2, "", "a"), (3, "one two", "a"), (None, text, "b"), (4, text, "c"), (4, text, "c"), (5, text, "d"), (6, long, "e"), (7, long + " tail", "e"), (None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA + ", key string")
    got = S.repeated(docs).collect()
    copies = sorted((-1 if r.doc_id is None else r.doc_id, r.other_id) for r in got if r.start_word is None)
    assert copies == [(-1, 4), (5, 4)]
    assert {frozenset((r.doc_id, r.other_id)) for r in got if r.start_word is not None} == {frozenset((6, 7))}
    assert S.repeated(docs.where("false")).count() == 0
    kept = S.without_repeats(docs)
    assert kept.columns == docs.columns
    assert kept.where("text is null or text = ''").count() == 3


def test_passages_are_cut_out_of_all_texts_but_one(spark):
    rng = random.Random(10)
    passage = prose(rng, 70)
    docs = [(i, f"Begin {i} " + " ".join(prose(rng, 30) + passage + prose(rng, 30)) + f" end {i}.") for i in range(6)] + [(9, " ".join(passage[:65]))]
    kept = {r.doc_id: r.text for r in S.without_repeats(spark.createDataFrame(docs, SCHEMA)).collect()}
    whole = [i for i, t in kept.items() if " ".join(passage[10:60]) in t]
    assert len(whole) == 1
    assert all(kept[i].startswith(f"Begin {i} ") and kept[i].endswith(f"end {i}.") for i in range(6))


def test_remove_words():
    assert S.remove_words("One, two three. Four five!", [(1, 3)]) == "One,\n. Four five!" or S.remove_words("One, two three. Four five!", [(1, 3)]).startswith("One,")
    assert S.remove_words("a b c", [(0, 3)]) == ""
    assert S.remove_words("a b c", [(0, 1), (2, 9)]) == "b"


def test_a_passage_that_stands_twice_in_a_text_is_cut_out_twice(spark):
    rng = random.Random(11)
    passage = prose(rng, 60)
    twice = " ".join(w for _ in range(3) for w in prose(rng, 50) + passage)
    body = prose(rng, 50) + passage + prose(rng, 50)
    keys = spark.createDataFrame([(-1, twice)] + [(i, " ".join(body) + f" end{i}") for i in range(40)], SCHEMA).selectExpr("doc_id", "text", "xxhash64(text) AS k").orderBy("k").collect()
    assert keys[0].doc_id >= 0  # the original is in the text of the lowest key
    docs = spark.createDataFrame([(0, keys[0].text), (1, twice)], SCHEMA)
    assert len({(r.start_word, r.end_word) for r in S.repeated(docs).collect() if r.doc_id == 1}) == 3
    assert sum(" ".join(passage[20:40]) in r.text for r in S.without_repeats(docs).collect()) == 1


def test_passages_made_of_frequent_lines_have_a_partner(spark):
    rng = random.Random(12)
    docs, planted = [], []
    for k in range(12):
        lines = [prose(rng, n) for n in ((17, 18, 19) if k % 2 else (15, 15, 15, 15))]
        docs += [prose(rng, 30) + line + prose(rng, 30) for line in lines for _ in range(8)]
        planted.append((len(docs), len(docs) + 1))
        docs += [prose(rng, 40) + sum(lines, []) + prose(rng, 40) for _ in range(2)]
    frame = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], SCHEMA)
    for n in (1, 6):
        rows = S.repeated(frame.repartition(n)).collect()
        pairs = {frozenset((r.doc_id, o)) for r in rows for o in r.others}
        assert all(frozenset(p) in pairs for p in planted)
        assert {r.doc_id for r in rows} <= {i for p in planted for i in p}


def whole(row, n: int) -> bool:
    return row.start_word is not None and row.end_word - row.start_word >= n


def test_frequent_seeds_lose_no_passage(spark):
    """Two texts share 80 words, and each run of 5 of these words stands in f other texts, too."""
    rng = random.Random(13)
    for f in (0, 10, 40, 200):
        passage = prose(rng, 80)
        docs = [prose(rng, 50) + passage + prose(rng, 50) for _ in range(2)]
        for _ in range(f):
            docs += [prose(rng, 6) + passage[i : i + 5] + prose(rng, 6) for i in range(76)]
        rows = S.repeated(spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], SCHEMA).repartition(6)).collect()
        assert len(rows) == 1 and {rows[0].doc_id, *rows[0].others} == {0, 1}
        assert whole(rows[0], 80) and rows[0].edits == 0


def test_exact_repeats_against_all_pairs(spark):
    """Texts made of a few common lines: each run of MIN_WORDS words that another text has is covered, but in one text."""
    rng = random.Random(14)
    lines = [prose(rng, rng.randint(8, 30)) for _ in range(12)]
    docs = [sum((rng.choice(lines) if rng.random() < 0.7 else prose(rng, 10) for _ in range(rng.randint(4, 12))), []) for _ in range(60)]
    runs: dict[tuple, set[int]] = {}
    for i, d in enumerate(docs):
        for at in range(len(d) - S.MIN_WORDS + 1):
            runs.setdefault(tuple(d[at : at + S.MIN_WORDS]), set()).add(i)
    for n in (1, 7):
        rows = S.repeated(spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], SCHEMA).repartition(n)).collect()
        covered = {i: np.zeros(len(d), bool) for i, d in enumerate(docs)}
        for r in rows:
            if r.start_word is not None:
                covered[r.doc_id][r.start_word : r.end_word] = True
        slack = S.WINDOW - 1
        for run, ids in runs.items():
            bare = [i for i in ids if not all(covered[i][at + slack : at + S.MIN_WORDS - slack].all() for at in range(len(docs[i]) - S.MIN_WORDS + 1) if tuple(docs[i][at : at + S.MIN_WORDS]) == run)]
            assert len(bare) <= 1 or {docs[i] == docs[bare[0]] for i in bare} == {True}


@pytest.mark.parametrize(("size", "every", "least"), [(45, 10, 0.9), (70, 7, 0.9), (70, 10, 0.95), (70, 15, 0.97), (120, 7, 0.95)])
def test_recall_of_fuzzy_passages(spark, size, every, least):
    rng = random.Random(15)
    docs = []
    for _ in range(60):
        passage = prose(rng, size)
        docs += [prose(rng, 40) + passage + prose(rng, 40), prose(rng, 40) + ["zz" + w if i % every == every // 2 else w for i, w in enumerate(passage)] + prose(rng, 40)]
    rows = S.repeated(spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], SCHEMA).repartition(5)).collect()
    pairs = {frozenset((r.doc_id, o)) for r in rows for o in r.others}
    assert all(max(p) == min(p) + 1 and min(p) % 2 == 0 for p in pairs)
    assert len(pairs) >= least * 60


def test_fuzzy_passages_of_frequent_parts(spark):
    rng = random.Random(16)
    docs, planted = [], []
    for _ in range(15):
        parts = [prose(rng, 12) for _ in range(5)]
        docs += [prose(rng, 30) + p + prose(rng, 30) for p in parts for _ in range(6)]
        planted.append(frozenset((len(docs), len(docs) + 1)))
        docs += [prose(rng, 40) + sum(([*p, f"x{k}{j}"] for j, p in enumerate(parts)), []) + prose(rng, 40) for k in range(2)]
    for n in (1, 6):
        rows = S.repeated(spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], SCHEMA).repartition(n)).collect()
        pairs = {frozenset((r.doc_id, o)) for r in rows for o in r.others}
        assert pairs <= set(planted) and len(pairs) >= 14


def test_clashing_names(spark):
    text = " ".join(prose(random.Random(17), 90))
    names = "doc_id long, text string, text_key long, _spans string, spans int, key string, salt int, copy int, start_word int, other_id long"
    docs = spark.createDataFrame([(1, text + " a", 1, "s", 2, "k", 3, 4, 5, 6), (2, text + " b", 1, "s", 2, "k", 3, 4, 5, 6), (3, None, None, None, None, None, None, None, None, None)], names)
    assert len(S.repeated(docs).collect()) == 1
    kept = S.without_repeats(docs)
    assert kept.columns == docs.columns and sum(text[:200] in (r.text or "") for r in kept.collect()) == 1


def test_a_large_group_of_copies(spark):
    rng = random.Random(18)
    text, other = " ".join(prose(rng, 100)), " ".join(prose(rng, 100))
    docs = [(i, text) for i in range(3000)] + [(i, other) for i in range(3000, 3010)] + [(i, " ".join(prose(rng, 30))) for i in range(3010, 4000)]
    rows = S.repeated(spark.createDataFrame(docs, SCHEMA).repartition(9)).collect()
    assert {(r.doc_id, r.other_id) for r in rows} == {(i, 0) for i in range(1, 3000)} | {(i, 3000) for i in range(3001, 3010)}


def texts_batch(texts: list[str]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["key", "text"])


def test_seeds_of_a_text_dont_depend_on_the_texts_before_it():
    rng, words = random.Random(19), S.WordHashes()
    texts = [words.of(" ".join(prose(rng, rng.randint(0, 30)))) for _ in range(200)]
    h, owner, place = S.seeds_of(texts)
    for i, t in enumerate(texts):
        alone = S.seeds_of([t])
        assert alone[0].tolist() == h[owner == i].tolist() and alone[2].tolist() == place[owner == i].tolist()


def test_seeds_of_a_block_are_made_slice_by_slice():
    """A worker holds the seeds of a block of texts, not the texts, and arrays over the words of a slice only."""
    rng = random.Random(20)
    line = prose(rng, 5000)
    batch = texts_batch([" ".join(rng.choices(line, k=400)) for _ in range(4000)])
    assert S.BLOCK_CHARS < batch.nbytes < 3 * S.BLOCK_CHARS
    tracemalloc.start()
    rows = sum(r.num_rows for r in S.seed_rows(iter([batch]), 0))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows > 500_000
    assert most < 100 << 20


def test_blocks_hold_a_text_once_and_are_numbered(monkeypatch):
    monkeypatch.setattr(S, "BLOCK_CHARS", 2000)
    monkeypatch.setattr(S, "ROWS", 50)
    rng = random.Random(21)
    texts = [" ".join(prose(rng, 100)) for _ in range(12)]
    batches = [texts_batch(texts).slice(i, 4) for i in (0, 0, 4, 8)]
    parts = list(S.seed_rows(iter([*batches, *batches[:1]]), 5 << 32))
    assert max(p.num_rows for p in parts) <= 50
    rows = [tuple(r.values()) for p in parts for r in p.to_pylist()]
    one = [S.seeds_of([S.WordHashes().of(t)]) for t in texts]
    blocks = [tag >> 2 for _, _, tag, _ in rows]
    assert sorted(set(blocks)) == [(5 << 32) + k for k in range(len(set(blocks)))] and len(set(blocks)) > 2
    for k in range(12):
        for block in set(blocks):
            got = sorted((h, at >> S.FAR) for (h, key, _, at), b in zip(rows, blocks, strict=True) if key == k and b == block)
            assert got in ([], sorted(zip(one[k][0].view(np.int64).tolist(), one[k][2].tolist(), strict=True)))


def test_contexts_are_the_same_however_many_lists_are_read_at_once(monkeypatch):
    rng = random.Random(22)
    lists = []
    for _ in range(60):
        places = sorted(rng.sample(range(200), rng.randint(1, 90)))
        lists.append([{"place": p, "hash": rng.getrandbits(62), "low": rng.randint(0, 3), "low_place": p + rng.randint(0, 1)} for p in places])
    kind = pa.list_(pa.struct([("place", pa.int64()), ("hash", pa.int64()), ("low", pa.int64()), ("low_place", pa.int64())]))
    batch = pa.record_batch([pa.array(range(60), pa.int64()), pa.array(lists, kind)], names=["key", "seeds"])

    def got(batches):
        return sorted((r["hash"], r["key"], r["at"]) for p in S.context_rows(iter(batches), 0) for r in p.to_pylist())

    whole = got([batch])
    monkeypatch.setattr(S, "ROWS", 100)
    sizes: list[int] = []
    plain = S.contexts_of
    monkeypatch.setattr(S, "contexts_of", lambda owner, *x: sizes.append(len(owner)) or plain(owner, *x))
    assert got([batch.slice(0, 25), batch.slice(25, 0), batch.slice(25)]) == whole and len(whole) > 500
    assert max(sizes) <= 100 and len(sizes) > 20
