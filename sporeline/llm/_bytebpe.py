"""Byte-level BPE vocabularies, and where texts may be cut before encoding."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import regex

# How byte-level BPE splits text before its merges.
PRE_TOKENS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")

#: A space before a character that isn't white space starts a pre-token, whatever stands before it.
CUT = re.compile(r" (?=\S)")
ODD = re.compile(r" (?:\s|\Z)")
#: Characters of a text that are cut into chunks at once.
SPAN = 1 << 19
#: Characters, counting some for each entry, that a worker's cache of chunks holds.
CACHED = 24_000_000


def byte_letters() -> list[str]:
    """The character that stands for each byte in the vocabulary: printable ones stand for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, spare = [chr(b) for b in range(256)], 256
    for b in range(256):
        if b not in plain:
            letters[b], spare = chr(spare), spare + 1
    return letters


class Vocabulary:
    """bytes_of[id], ids of single bytes, ranked merges of ids, and special strings."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        model, pre = whole["model"], whole.get("pre_tokenizer") or {}
        plain = model["type"] == "BPE" and not whole.get("normalizer") and pre.get("type") == "ByteLevel" and pre.get("use_regex", True)
        if not plain or pre.get("add_prefix_space") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix") or model.get("ignore_merges"):
            raise ValueError(f"{path} isn't a plain byte-level BPE vocabulary")
        letters = byte_letters()
        to_byte = {c: b for b, c in enumerate(letters)}
        ids: dict[str, int] = model["vocab"]
        added = {t["content"]: t["id"] for t in whole.get("added_tokens", [])}
        if any(t.get(k) for t in whole.get("added_tokens", []) for k in ("lstrip", "rstrip", "single_word")):
            raise ValueError("added tokens that take white space with them aren't supported")
        self.bytes_of: list[bytes] = [b""] * (1 + max([*ids.values(), *added.values()]))
        for token, i in ids.items():
            self.bytes_of[i] = bytes(to_byte[c] for c in token)
        for token, i in added.items():
            self.bytes_of[i] = token.encode()
        self.special = added
        self.special_pattern = re.compile("(" + "|".join(re.escape(x) for x in sorted(added, key=len, reverse=True)) + ")") if added else None
        self.byte_ids = np.array([ids[c] for c in letters], np.int64)
        self.size = len(self.bytes_of)
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges.setdefault((ids[a], ids[b]), (rank, ids[a + b]))
        self.inside = np.zeros(1 << 16, bool)
        for token in ids:
            held = np.frombuffer(bytes(to_byte[c] for c in token), np.uint8).astype(np.int64)
            self.inside[held[:-1] << 8 | held[1:]] = True
        ranked = sorted((a << 32 | b, rank, new) for (a, b), (rank, new) in self.merges.items())
        self.pair_keys, self.pair_ranks, self.pair_ids = (np.array(x, np.int64) for x in zip(*ranked, strict=True)) if ranked else (np.zeros(0, np.int64),) * 3
        byte_pair = self.byte_ids[:, None] << 32 | self.byte_ids[None, :]
        self.byte_pair_at = self.find(byte_pair.ravel())

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The places of pairs among the ranked ones, -1 for those that never merge."""
        if not len(self.pair_keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, at, -1)


def merge_ranked(vocab: Vocabulary, sequences: list[bytes]) -> list[np.ndarray]:
    """The ids of byte sequences, all merged together.

    The sequences lie end to end in one array. In each round every sequence that can still merge applies its
    lowest-ranked pair at all places, from the left where places overlap; sequences that can't leave the round.
    """
    none = np.int64(1) << 40
    done: list[np.ndarray] = [np.zeros(0, np.int64)] * len(sequences)
    live = np.array([i for i, s in enumerate(sequences) if s], np.int64)
    if not len(live):
        return done
    held = np.frombuffer(b"".join(sequences), np.uint8).astype(np.int64)
    sizes = np.array([len(sequences[i]) for i in live], np.int64)
    ids = vocab.byte_ids[held]
    found = np.full(len(held), -1)
    found[:-1] = vocab.byte_pair_at[held[:-1] << 8 | held[1:]]
    while True:
        ends = np.cumsum(sizes)
        starts = ends - sizes
        found[ends - 1] = -1
        ranks = np.where(found >= 0, vocab.pair_ranks[np.maximum(found, 0)], none)
        lowest = np.minimum.reduceat(ranks, starts)
        over = lowest == none
        if over.any():
            for k in np.flatnonzero(over).tolist():
                done[live[k]] = ids[starts[k] : ends[k]]
            if over.all():
                return done
            stay = np.repeat(~over, sizes)
            ids, found, ranks = ids[stay], found[stay], ranks[stay]
            live, sizes, lowest = live[~over], sizes[~over], lowest[~over]
        at = np.flatnonzero(ranks == np.repeat(lowest, sizes))
        fresh = np.r_[True, np.diff(at) > 1]  # of neighbouring places, as in "aaa", every other one merges
        run = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
        at = at[(np.arange(len(at)) - run) % 2 == 0]
        ids[at] = vocab.pair_ids[found[at]]
        gone = np.zeros(len(ids), bool)
        gone[at + 1] = True
        owner = np.repeat(np.arange(len(live)), sizes)
        sizes = sizes - np.bincount(owner[at], minlength=len(live))
        moved = at - np.arange(len(at))  # where the merged ids stand once the others are gone
        ids, found = ids[~gone], found[~gone]
        beside = np.zeros(len(ids) + 1, bool)
        beside[moved] = beside[moved - 1] = True
        touched = np.flatnonzero(beside[: max(0, len(ids) - 1)])
        found[touched] = vocab.find(ids[touched] << 32 | ids[touched + 1])


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def spans(text: str) -> Iterator[str]:
    """text in parts of about SPAN characters, each but the first from a CUT on."""
    begin = 0
    while len(text) - begin > 2 * SPAN:
        found = CUT.search(text, begin + SPAN)
        if not found:
            break
        yield text[begin : found.start()]
        begin = found.start()
    yield text[begin:] if begin else text


def chunks(part: str) -> list[str]:
    """part cut at every CUT; all but the first come without their leading space."""
    return CUT.split(part) if ODD.search(part) else part.split(" ")


def parts(text: str | None, vocab: Vocabulary) -> Iterator[tuple[int | None, list[str]]]:
    """For each special string its id; for each span between them its chunks, marked by None."""
    if not text:
        return
    between = vocab.special_pattern.split(text) if vocab.special_pattern and vocab.special_pattern.search(text) else [text]
    for k, piece in enumerate(between):
        if k % 2:
            yield vocab.special[piece], []
        elif piece:
            for span in spans(piece):
                yield None, chunks(span)


class _Numbers(dict):
    """The number of each chunk; a chunk that is new gets the next one, and waits in new (as a whole chunk)."""

    def __init__(self, new: list[str], made: list, lead: str):
        self.new, self.made, self.lead = new, made, lead

    def __missing__(self, chunk: str) -> int:
        n = self[chunk] = len(self.made) + len(self.new)
        self.new.append(self.lead + chunk)
        return n


class ChunkCache:
    """Values of chunks, made in batches by values_of(list of whole chunks) for those not met before.

    A chunk is looked up once for each time it stands in a text. Chunks that start a span stand apart, for they lack the
    leading space that others have. values_of isn't kept: a cache that holds a method of its owner would outlive its task
    in a reused worker, until Python looks for cycles.
    """

    def __init__(self):
        self._clear()

    def _clear(self) -> None:
        self.new, self.made, self.held = [], [], 0
        self.first, self.rest = _Numbers(self.new, self.made, ""), _Numbers(self.new, self.made, " ")

    def numbers(self, lists: list[list[str]], values_of) -> list[list[int]]:
        """The numbers of each list's chunks, all of whose values are made."""
        if self.held > CACHED:
            self._clear()
        first, rest = self.first, self.rest
        out = []
        for x in lists:
            numbers = list(map(rest.__getitem__, islice(x, 1, None)))
            numbers.insert(0, first[x[0]])
            out.append(numbers)
        if self.new:
            self.held += sum(map(len, self.new)) + 40 * len(self.new)
            self.made.extend(values_of(self.new))
            self.new.clear()
        return out

    def values(self, numbers: list[int]) -> Iterator:
        return map(self.made.__getitem__, numbers)


def chunk_numbers(texts: list[str | None], vocab: Vocabulary, cache: ChunkCache, values_of) -> list[list[tuple[int | None, list[int]]]]:
    """For each text its parts: the id of a special string, or None and the numbers of a span's chunks."""
    cut = [list(parts(t, vocab)) for t in texts]
    numbers = iter(cache.numbers([c for x in cut for special, c in x if special is None], values_of))
    return [[(special, [] if special is not None else next(numbers)) for special, _ in x] for x in cut]
