"""Codec, counts and token store against the tokenizers library."""

import gc
import hashlib
import random
import weakref
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sporeline.llm import _bytebpe, bpe_codec, token_counts, token_store

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string"
ODD = ["", " ", "  a  b ", "a\n\n b\t c", "<|endoftext|>", "x<|endoftext|> <|endoftext|>y", "é ü ñ 漢字 🙂", "　  a", "it's we'LL 12345 $%&", "aaaaaaaaaaaaaaaaaaaaaaaa", "\r\n\r\n", "a" * 3000, "word " * 3000]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def texts(n=400):
    rng = random.Random(2)
    pool = ["a", " ", "  ", "\n", "é", "<|endoftext|>", "'s", "1", "$ ", "\t", "the ", "ing", "　", "🙂", " th"]
    return ODD + ["".join(rng.choice(pool) for _ in range(rng.randrange(40))) for _ in range(n)]


def test_codec_as_the_library(library):
    codec = bpe_codec.Codec(PATH)
    for t in texts():
        want = library.encode(t, add_special_tokens=False).ids
        assert codec.encode(t) == want
        assert codec.decode(want) == library.decode(want, skip_special_tokens=False)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_codec_round_trips_any_text(text):
    text = text.encode("utf-8", "ignore").decode()
    codec = bpe_codec.Codec(PATH)
    assert codec.decode(codec.encode(text)) == text


def test_codes_across_spans(library, monkeypatch):
    monkeypatch.setattr(_bytebpe, "SPAN", 50)
    codec = bpe_codec.Codec(PATH)
    text = " ".join(texts(60)).replace("<|endoftext|>", "")
    assert codec.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_cuts_are_pairs_that_no_token_holds():
    vocab = _bytebpe.vocabulary(PATH)
    held = {(t[i], t[i + 1]) for t in vocab.bytes_of for i in range(len(t) - 1) if t != b"<|endoftext|>"}
    assert {(int(a), int(b)) for a, b in zip(*divmod(np.flatnonzero(vocab.inside), 256), strict=True)} == held


def test_queries_of_codec_and_counts(spark, library):
    rows = [(i, t) for i, t in enumerate(texts(100))] + [(None, None), (3, None), (3, "again"), (3, "again")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", n_tokens string")
    got = bpe_codec.code_digests(docs, PATH).collect()
    assert [r.doc_id for r in got] == [r[0] for r in rows]
    counted = token_counts.count_tokens(docs, PATH).collect()
    encoded = bpe_codec.encode_documents(docs, PATH).collect()
    for (_, t), r, c, e in zip(rows, got, counted, encoded, strict=True):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
        assert (c.n_bytes, c.n_tokens, c.over_limit) == (len((t or "").encode()), len(ids), len(ids) > 1024)
        assert e.ids == ids and e.decoded == (t or "")
    empty = docs.where("false")
    assert bpe_codec.code_digests(empty, PATH).count() == token_counts.count_tokens(empty, PATH).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(0, 60), st.integers(0, 1 << 20), st.integers(0, (1 << 64) - 1)), max_size=80), max_size=6))
def test_simple_8b_round_trips(documents):
    arrays = [np.array(d, np.uint64) for d in documents]
    words = token_store.encode_blocks(arrays)
    if not documents:
        assert words == []
        return
    offsets = np.r_[0, np.cumsum([len(w) for w in words])][:-1].astype(np.int64)
    ids, starts = token_store.decode_block(np.concatenate(words), offsets, np.array([len(d) for d in documents], np.int64))
    assert ids.tolist() == [x for d in documents for x in d]
    assert starts.tolist() == np.r_[0, np.cumsum([len(d) for d in documents])][:-1].tolist()


def test_words_hold_as_many_ids_as_fit():
    ones = token_store.encode_blocks([np.ones(60, np.uint64)])[0]
    assert len(ones) == 1 and int(ones[0]) >> 60 == 0
    assert len(token_store.encode_blocks([np.full(4, (1 << 15) - 1, np.uint64)])[0]) == 1


def test_store_has_all_ids_in_order(spark, library):
    from sporeline.llm._shared import new_path

    rows = [(i * 7 % 131, t) for i, t in enumerate(texts(120))] + [(None, "null id"), (500, None), (500, None), (501, "tie"), (501, "tie two")]
    docs = spark.createDataFrame([(*r, 0) for r in rows], SCHEMA + ", start int").repartition(6)
    path = new_path(spark, "store")
    token_store.write_store(docs, path, PATH)
    got = sorted(token_store.store_digests(spark, path).collect(), key=lambda r: r.start)
    ids_of = {}
    for d, t in rows:
        ids_of.setdefault(d, []).append([*library.encode(t or "", add_special_tokens=False).ids, 0])
    order = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert order == sorted(order) and len(got) == len(rows)
    assert [r.start for r in got] == np.r_[0, np.cumsum([r.n_tokens for r in got])][:-1].tolist()
    for r in got:
        assert (r.n_tokens, r.ids_crc32) in {(len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for x in ids_of[r.doc_id]}
    assert sorted((r.doc_id or -1, r.ids) for r in token_store.read_ids(spark, path).collect()) == sorted((d or -1, x) for d, xs in ids_of.items() for x in xs)
    path = new_path(spark, "store")
    token_store.write_store(docs.where("false"), path, PATH)
    assert token_store.store_digests(spark, path).count() == 0


@pytest.mark.parametrize(("span", "cached", "size"), [(1 << 19, 72_000_000, 500), (40, 2000, 7), (40, 72_000_000, 1)])
def test_store_encodes_arrow_columns_as_the_library(library, monkeypatch, span, cached, size):
    monkeypatch.setattr(_bytebpe, "SPAN", span)
    monkeypatch.setattr(token_store, "CACHED", cached)
    whole = [*texts(), None, "a b\x1c c \x1c d", "<|endoftext|>", "a \u00a0b c", "  \n", "no  cut here ", " b a b", "\u6f22\u5b57" * 500]
    encoder = token_store.LibraryEncoder(PATH)
    for k in range(0, len(whole), size):
        for text, ids in zip(whole[k : k + size], encoder.encode(pa.array(whole[k : k + size], pa.string())), strict=True):
            assert ids.tolist() == library.encode(text or "", add_special_tokens=False).ids


def test_store_looks_up_a_chunk_once_however_often_it_stands(library):
    encoder, asked = token_store.LibraryEncoder(PATH), []
    numbers = encoder.cache.numbers_after
    encoder.cache.numbers_after = lambda chunks: asked.extend(chunks) or numbers(chunks)
    got = encoder.encode(pa.array(["one two three two one " * 500 + "end", "two one"] * 20))
    assert sorted(asked) == ["end", "one", "three", "two"]
    assert got[0].tolist() == library.encode("one two three two one " * 500 + "end", add_special_tokens=False).ids


def test_store_cuts_texts_with_spaces_before_white_space_all_together(library):
    encoder, calls = token_store.LibraryEncoder(PATH), []
    numbers = encoder.cache.numbers_after
    encoder.cache.numbers_after = lambda chunks: calls.append(chunks) or numbers(chunks)
    whole = ["one.  Two. \n three ", "  four  one. ", " ", "five one.  Two"]
    got = encoder.encode(pa.array(whole))
    assert [x.tolist() for x in got] == [library.encode(t, add_special_tokens=False).ids for t in whole]
    assert len(calls) == 1 and sorted(set(calls[0])) == ["Two", "Two. \n", "four ", "one. ", "three "]


def test_store_names_only_new_chunks_in_python(library):
    encoder, asked = token_store.LibraryEncoder(PATH), []
    numbers = encoder.cache.numbers_after
    encoder.cache.numbers_after = lambda chunks: asked.extend(chunks) or numbers(chunks)
    encoder.encode(pa.array(["one two three"]))
    asked.clear()
    assert encoder.encode(pa.array(["one two four two"]))[0].tolist() == library.encode("one two four two", add_special_tokens=False).ids
    assert asked == ["four"]


def test_store_keeps_chunks_in_use_when_its_cache_is_full(library, monkeypatch):
    monkeypatch.setattr(token_store, "CACHED", 40_000)
    encoder, asked, held = token_store.LibraryEncoder(PATH), [], []
    library_of = encoder.cache.library
    encoder.cache.library = lambda texts: asked.extend(texts) or library_of(texts)
    for k in range(40):
        text = "start of every text " + " ".join(f"rare{k}x{j}" for j in range(100)) + "  \u00a0end\n"
        assert encoder.encode(pa.array([text, None]))[0].tolist() == library.encode(text, add_special_tokens=False).ids
        held.append(encoder.cache.held)
    assert any(b < a for a, b in zip(held, held[1:], strict=False)) and max(held) < 60_000
    assert sum(" every " in x for x in asked) == 1


def test_store_cuts_a_slice_of_a_column_at_spaces_before_what_is_not_white(library):
    whole = ["left out", "a \u3042\u3044 \u3000b \u2003 \u2019c \u00a0d \u00e9", " \u00a0", "x ", "", " \u1680y", "\u00e9 ", "\u0085 z \x85", "left out"]
    column = pa.array(whole)[1:-1]
    got = token_store.LibraryEncoder(PATH).encode(column)
    assert [x.tolist() for x in got] == [library.encode(t, add_special_tokens=False).ids for t in whole[1:-1]]
    encoder = token_store.LibraryEncoder(PATH)
    for text in ("<|endoftext|>x a", "<|endoftext|> a", "", " "):  # of the second one, only an empty chunk is new
        for kind in (pa.string(), pa.large_string()):
            assert encoder.encode(pa.array([text], kind))[0].tolist() == library.encode(text, add_special_tokens=False).ids
    data = np.frombuffer("b \u3042 \u3000 \u00e9 ".encode(), np.uint8)
    assert token_store.cut_places(data, np.array([0, len(data)])).tolist() == [0, 1, 9]


def test_blocks_of_ids_on_either_side_of_the_table_of_widths():
    for top in ((1 << 17) - 1, 1 << 17, (1 << 60) - 1, 1 << 60):
        ids = np.array([0, 1, 2, 50_256, top, 3], np.uint64)
        assert token_store._narrowest(ids).tolist() == [next((s for s, w in enumerate(token_store.WIDTHS.tolist()) if int(x) < 1 << w), 14) for x in ids]


def test_other_vocabularies_go_to_the_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    got = token_store.LibraryEncoder(path).encode(["Two words", None])
    assert got[0].tolist() == Tokenizer.from_file(path).encode("Two words", add_special_tokens=False).ids


@pytest.mark.parametrize("kind", [bpe_codec.Codec, token_counts.Counter])
def test_a_cache_goes_with_its_task(kind):
    """Without waiting for Python to look for cycles, as a reused worker would hold one task's cache in the next."""
    gc.disable()
    try:
        coder = kind(PATH)
        for x in coder.coded(["some words"]) if kind is bpe_codec.Codec else coder.counts(["some words"]):
            assert x
        held = weakref.ref(coder.cache)
        del coder, x
        assert held() is None
    finally:
        gc.enable()
