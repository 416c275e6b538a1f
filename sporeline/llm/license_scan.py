"""License scans by ordered signature rules.

A text becomes words in lower case parted by single spaces. One pass of an automaton over it names the keywords it holds, and only
rules whose keyword is there are tried: most texts hold none. Of overlapping detections, one that lies inside another one of the
same or a higher priority goes (of two that are alike, the earlier rule's stays); those that stay give the labels. Detections are
met in order of their places, so no text's detections are ever held together.

Base phrases are found whatever the rules say, and their labels stay. The score is the highest confidence of what was found, 0 without.
Null and empty texts have no words and no labels; texts of any length are scanned whole, one at a time. Rows are scanned one by
one, whatever their doc_id and other columns; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from sporeline.llm._license_rules import Signature, signatures
from sporeline.llm._shared import slices, table

# Phrases and the labels they give.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Confidence in what a base phrase alone says, and in a rule by its priority.
BASE_CONFIDENCE = {"cc-by": 0.5, "gpl": 0.7, "reserved": 0.4}
CONFIDENCE = {9: 1.0, 8: 0.95, 7: 0.9, 6: 0.85, 5: 0.75, 3: 0.5, 2: 0.2}

#: A-Z become a-z, all other ASCII characters but letters and digits a space.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def normalised(text: bytes | None) -> tuple[bytes, int]:
    """The words of a text (in UTF-8) with a space before and after each, and how many there are."""
    words = (text or b"").translate(_LETTERS).split()
    return b" " + b" ".join(words) + b" ", len(words)


class Scanner:
    def __init__(self, rules: list[Signature] | None = None):
        import ahocorasick

        self.rules = signatures() if rules is None else rules
        self.patterns = [re.compile(b" (?:" + r.pattern.encode() + b")(?= )") for r in self.rules]
        held: dict[str, list[int]] = {}
        for i, r in enumerate(self.rules):
            held.setdefault(r.keyword.encode().decode("latin-1"), []).append(i)
        self.keywords = ahocorasick.Automaton()
        for k, (word, of) in enumerate(held.items()):
            self.keywords.add_word(word, (k, of))
        self.keywords.make_automaton()

    def base(self, text: bytes) -> tuple[int, int | None, int | None, set[str]]:
        """How many places of base phrases there are, the first and last word that starts one, and the labels."""
        n, first, last, labels = 0, -1, -1, set()
        for phrase, label in BASE.items():
            wanted = f" {phrase} ".encode()
            at = text.find(wanted)
            if at < 0:
                continue
            labels.add(label)
            first = at if first < 0 else min(first, at)
            while at >= 0:
                n, final = n + 1, at
                at = text.find(wanted, at + len(wanted) - 1)
            last = max(last, final)
        return (n, text.count(b" ", 0, first), text.count(b" ", 0, last), labels) if n else (0, None, None, labels)

    def _matches(self, i: int, text: bytes) -> Iterator[tuple[int, int, int, int]]:
        return ((m.start(), -m.end(), -self.rules[i].priority, i) for m in self.patterns[i].finditer(text))

    def detections(self, text: bytes) -> Iterator[tuple[int, int, int]]:
        """Begin, end and rule of what stays, in order of begin; begin is that of the space before the first word."""
        found = {k: of for _, (k, of) in self.keywords.iter(text.decode("latin-1"))} if len(text) > 1 else {}
        if not found:
            return
        tried = sorted(i for of in found.values() for i in of)
        each = [self._matches(i, text) for i in tried]
        reached: dict[int, int] = {}  # how far those met so far reach, by priority
        for begin, end, priority, i in heapq.merge(*each):
            if all(e < -end for p, e in reached.items() if p >= -priority):
                yield begin, -end, i
            reached[-priority] = max(reached.get(-priority, 0), -end)

    def scan(self, raw: bytes | None) -> tuple:
        text, n_words = normalised(raw)
        n_base, first, last, base = self.base(text)
        labels, best, n = set(base), max((BASE_CONFIDENCE[x] for x in base), default=0.0), 0
        for _, _, i in self.detections(text):
            n += 1
            labels.add(self.rules[i].label)
            best = max(best, CONFIDENCE[self.rules[i].priority])
        return n_words, n_base, first, last, ",".join(sorted(base)), ",".join(sorted(labels)), best, n


_RESULT = (("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("n_detections", pa.int64()))
SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, n_detections long"


def _texts(b: pa.RecordBatch) -> list[bytes | None]:
    return b.column("text").cast(pa.binary()).to_pylist()


def scan_documents(docs: DataFrame, rules: list[Signature] | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """A row for each document: its words, the places of base phrases, all labels, and a score."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for b in slices(batches, "text"):
            columns = zip(*map(scanner.scan, _texts(b)), strict=True)
            yield pa.record_batch([b.column("doc_id"), *(pa.array(x, kind) for x, (_, kind) in zip(columns, _RESULT, strict=True))], names=["doc_id", *(name for name, _ in _RESULT)])

    return docs.select(docs[key].cast("long").alias("doc_id"), docs[text].alias("text")).mapInArrow(work, SCHEMA)


#: Detections handed on at once.
_ROWS = 10_000


def find_licenses(docs: DataFrame, rules: list[Signature] | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, label, priority, first_word, end_word, words for each detection that stays: where a text speaks of a licence, and what it says."""
    names = ["doc_id", "label", "priority", "first_word", "end_word", "words"]
    kinds = (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner, out = Scanner(rules), []
        for b in slices(batches, "text"):
            for i, raw in zip(b.column("doc_id").to_pylist(), _texts(b), strict=True):
                text, _ = normalised(raw)
                at = word = 0
                for begin, end, rule in scanner.detections(text):
                    word, at = word + text.count(b" ", at, begin), begin
                    words = text[begin + 1 : end]
                    out.append((i, scanner.rules[rule].label, scanner.rules[rule].priority, word, word + words.count(b" ") + 1, words.decode()))
                    if len(out) >= _ROWS:
                        yield pa.record_batch([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
                        out = []
        if out:
            yield pa.record_batch([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return docs.select(docs[key].cast("long").alias("doc_id"), docs[text].alias("text")).mapInArrow(work, "doc_id long, label string, priority int, first_word long, end_word long, words string")


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op11_license_scan": op11_license_scan}
ORACLES: dict[str, str] = {}
