"""Alignment of two tokenizers against a plain version with the libraries themselves."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from sporeline.llm import token_alignment as A
from sporeline.llm._bytebpe import byte_letters

PATH_A, PATH_B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, block string, keys int"


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(PATH_A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PATH_B)


def plain(texts, libraries):
    a_lib, b_lib = libraries
    to_byte = {c: b for b, c in enumerate(byte_letters())}
    links_of, out, held = [], [], Counter()
    for text in texts:
        groups, links = [], []
        if text:
            want = b" " + text.encode()
            a, b = a_lib.encode(" " + text, add_special_tokens=False).ids, b_lib.encode(text)
            a_bytes = [bytes(to_byte[c] for c in a_lib.id_to_token(i)) for i in a]
            b_bytes = [bytes([int(b_lib.id_to_piece(i)[3:5], 16)]) if b_lib.is_byte(i) else b_lib.id_to_piece(i).replace("▁", " ").encode() for i in b]
            if b"".join(a_bytes) == want == b"".join(b_bytes):
                def spans(parts):
                    at, res = 0, []
                    for p in parts:
                        res.append((at, at + len(p)))
                        at += len(p)
                    return res

                sa, sb = spans(a_bytes), spans(b_bytes)
                both = sorted({e for _, e in sa} & {e for _, e in sb})
                low = 0
                for e in both:
                    ga = [(i, s) for i, s in zip(a, sa, strict=True) if low <= s[0] and s[1] <= e]
                    gb = [(i, s) for i, s in zip(b, sb, strict=True) if low <= s[0] and s[1] <= e]
                    groups.append((ga, gb))
                    links += [(i, j) for i, s in ga for j, u in gb if s[0] < u[1] and u[0] < s[1]]
                    low = e
        held.update(set(links))
        links_of.append(links)
        name = ";".join(",".join(str(i) for i, _ in ga) + "|" + ",".join(str(j) for j, _ in gb) for ga, gb in groups)
        out.append([sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), len(links), hashlib.sha256(name.encode()).hexdigest() if groups else ""])
    top = {}
    for (a, _), n in held.items():
        top[a] = max(top.get(a, 0), n)
    return [(*row[:4], sum(held[x] == top[x[0]] for x in links), sum(held[x] for x in links), row[4]) for row, links in zip(out, links_of, strict=True)], held, top


def odd_texts():
    rng = random.Random(5)
    alphabet = ["a", "the", "Zürich", "naïve", " ", "  ", "\n", "\t", " ", "日本", "語", "<s>", "</s>", "<|endoftext|>", "<0x41>", "'s", "123", "🙂", "é", "é", "▁", "ﬁ", "...", "\x00", "​", "--", "'LL", "_x", "\r\n", "　", "ا", "﻿"]
    made = ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 30))) for _ in range(250)]
    return [None, "", " ", "  ", "\n", " a", "a ", "a  b", "▁", "a ▁b", "x" * 3000, "word " * 3000, *made]


def test_same_as_libraries(spark, libraries):
    texts = odd_texts()
    docs = [(rng_id, t, "q", 1) for rng_id, t in enumerate(texts)]
    docs += [(None, "a repeated row", "q", 1), (3, "a repeated row", "q", 1)] * 2
    want, held, top = plain([t for _, t, *_ in docs], libraries)
    assert sum(1 for w in want if w[0]) > 150 and sum(1 for (_, t, *_), w in zip(docs, want, strict=True) if t and not w[0]) > 5
    df = spark.createDataFrame(docs, SCHEMA).repartition(3)
    order = lambda rows: sorted(rows, key=repr)
    got = [(r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in A.align(df, PATH_A, PATH_B).collect()]
    assert order(got) == order([(d[0], *w) for d, w in zip(docs, want, strict=True)])
    table = {(r.a, r.b): (r.n_docs, r.best) for r in A.links(df, PATH_A, PATH_B).collect()}
    assert table == {p: (n, n == top[p[0]]) for p, n in held.items()}


def test_query_same_as_libraries(spark, sf_dir, libraries):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    want, _, _ = plain([r.text for r in docs], libraries)
    got = A.op12_token_alignment(spark, sf_dir).collect()
    assert sorted((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in got) == sorted((r.doc_id, *w) for r, w in zip(docs, want, strict=True))


def test_small_blocks_and_a_small_cache(spark, sf_dir, monkeypatch, libraries):
    """Closures are pickled by reference to the module, so workers see the module's own limits; here the plan runs in this process."""
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").limit(40).collect()]
    of, small = A.Aligner(PATH_A, PATH_B), A._Block()
    for t in texts:
        small.ids.append(1)
        small.chunks.append(of.chunks(t))
    of._learn()
    first = small.row(0, of).to_pydict()
    of.clear()
    again = A._Block()
    for t in texts:
        again.ids.append(1)
        again.chunks.append(of.chunks(t))
        of._learn()
    second = again.row(0, of).to_pydict()
    assert first["groups_sha256"] == second["groups_sha256"] and first["n_links"] == second["n_links"]
    assert dict(zip(zip(first["a"][0], first["b"][0], strict=True), first["df"][0], strict=True)) == dict(zip(zip(second["a"][0], second["b"][0], strict=True), second["df"][0], strict=True))


def test_without_cuts_the_same(spark, libraries):
    of = A.Aligner(PATH_A, PATH_B)
    assert of.pieces.cuts
    of.pieces.cuts = False
    whole = A._Block()
    texts = odd_texts()[:80]
    for t in texts:
        whole.ids.append(1)
        whole.chunks.append(of.chunks(t))
    of._learn()
    row = whole.row(0, of).to_pydict()
    want, _, _ = plain(texts, libraries)
    assert list(zip(row["n_a"][0], row["n_b"][0], row["n_groups"][0], row["n_links"][0], row["groups_sha256"][0], strict=True)) == [(*w[:4], w[6]) for w in want]


def test_empty_table(spark):
    assert A.align(spark.createDataFrame([], SCHEMA), PATH_A, PATH_B).collect() == []


def test_overlaps_of_unequal_tokens():
    size = {1: 3, 2: 2, 3: 1, 11: 1, 12: 4, 13: 1}.get
    assert A.overlaps([1, 2, 3], [11, 12, 13], size, size) == [(1, 11), (1, 12), (2, 12), (3, 13)]
