"""License scans against a plain version without keywords, automata or sweeps."""

import random
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from sporeline.llm import license_scan as L
from sporeline.llm._license_rules import SPDX, Signature, signatures

SCHEMA = "doc_id long, text string, labels string, score int"
RULES = signatures()


def plain_scan(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places = [(i, label) for phrase, label in L.BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    joined = " ".join(words)
    found = [(m.start() + len(m[1]), m.end(), -r.priority, k) for k, r in enumerate(RULES) for m in re.finditer(f"(^| )(?:{r.pattern})(?= |$)", joined)]
    stays = [d for d in found if not any(e != d and e[2] <= d[2] and e[0] <= d[0] and d[1] <= e[1] and ((e[0], e[1], e[2]) != d[:3] or e[3] < d[3]) for e in found)]
    base = {label for _, label in places}
    labels = base | {RULES[k].label for *_, k in stays}
    score = max([L.BASE_CONFIDENCE[x] for x in base] + [L.CONFIDENCE[-p] for _, _, p, _ in stays], default=0.0)
    at = sorted(i for i, _ in places)
    return len(words), len(places), at[0] if at else None, at[-1] if at else None, ",".join(sorted(base)), ",".join(sorted(labels)), score, len(stays)


def texts():
    rng = random.Random(2)
    parts = ["cc by", "CC-BY-SA 4.0", "General Public License", "all rights reserved", "GNU", "version 2", "the MIT License", "licensed under", "Apache-2.0", "SPDX-License-Identifier: GPL-2.0-or-later", "or later", "free", "Ünï", "cc", "by", "all", "rights"]
    parts += ["https://www.apache.org/licenses/LICENSE-2.0.txt", "creativecommons.org/licenses/by-nc-nd/4.0/", "Tous droits réservés", "gpl v3", "lgpl", "public domain", "x" * 50, "İ K ſ", "\x85 ", "0-9"]
    return [None, "", " .,;", "all rights reserved all rights reserved", "xall rights reserved", "cc by cc by", "cc\x00by", "CC by", *(rng.choice((" ", "\n", ", ", "-")).join(rng.choices(parts, k=rng.randint(1, 40))) for _ in range(200))]


def rows(df):
    names = [n for n, _ in L._RESULT]
    return sorted(((r.doc_id, *(r[n] for n in names)) for r in df.collect()), key=repr)


def test_same_as_plain_version(spark):
    docs = [(i, t, "q", 1) for i, t in enumerate(texts())] + [(None, "CC BY", "q", 1), (3, "gnu gpl", "q", 1)] * 2
    got = rows(L.scan_documents(spark.createDataFrame(docs, SCHEMA).repartition(3)))
    assert got == sorted(((d, *plain_scan(t)) for d, t, *_ in docs), key=repr)
    assert len({x[6] for x in got}) > 50


def test_query_same_as_plain_version(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    want = sorted(((r.doc_id, *plain_scan(r.text)) for r in docs), key=repr)
    assert rows(L.op11_license_scan(spark, sf_dir)) == want and any(x[5] for x in want)


@pytest.mark.parametrize("rule", RULES, ids=lambda r: f"{r.label}: {r.pattern[:40]}")
@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck), database=None)
@given(data=st.data())
def test_every_match_holds_its_keyword(rule, data):
    words = data.draw(st.from_regex(re.compile(rule.pattern, re.ASCII), fullmatch=True))
    assert rule.keyword in words and words == words.strip() and "  " not in re.sub("[a-z0-9]{1,120}", "x", words) or "[a-z0-9 ]" in rule.pattern
    text, _ = L.normalised(words.encode())
    assert "[a-z0-9 ]" in rule.pattern or L.Scanner([rule]).scan(words.encode())[5].split(",").count(rule.label) == 1


def test_known_notices():
    def found(text):
        return L.Scanner().scan(text.encode())[5].split(",")

    assert found("Licensed under the Apache License, Version 2.0.") == ["apache-2.0"]
    assert found("Licensed under CC BY-NC 4.0.") == ["cc-by", "cc-by-nc", "other"]
    assert found("Released under the MIT License.") == ["mit"]
    assert found("This work is licensed under the GNU General Public License, version 3.") == ["gpl", "gpl-3.0", "other"]
    assert found("// SPDX-License-Identifier: BSD-3-Clause") == ["bsd-3-clause"]
    assert found("You may not use this file except in compliance with the License. https://www.mozilla.org/MPL/2.0/") == ["apache-2.0", "mpl-2.0"]
    assert found("We licensed the film and reserved seats.") == [""]


def test_rules_are_many_and_well_formed():
    assert len(RULES) - len(SPDX) > 200 and {r.priority for r in RULES} <= set(L.CONFIDENCE)
    assert len({(r.label, r.pattern) for r in RULES}) == len(RULES)


def test_inner_detections_of_a_higher_priority_stay():
    rules = [Signature("wide", 2, "a", "a b c d"), Signature("inner", 5, "b", "b c"), Signature("same", 2, "c d", "c d"), Signature("twin", 2, "a", "a b c d")]
    text, _ = L.normalised(b"A b.c-D")
    assert [(rules[i].label) for _, _, i in L.Scanner(rules).detections(text)] == ["wide", "inner"]


def test_places_of_detections(spark):
    docs = spark.createDataFrame([(1, "So, the MIT License! And then: GNU GPL", "q", 1), (2, None, "q", 1), (3, "nothing", "q", 1)], SCHEMA)
    got = {(r.doc_id, r.label, r.first_word, r.end_word, r.words) for r in L.find_licenses(docs).collect()}
    assert got == {(1, "mit", 1, 4, "the mit license"), (1, "gpl", 6, 8, "gnu gpl")}


def test_a_very_long_text_and_an_empty_table(spark):
    long = "all rights reserved by nobody, mit license " * 100_000
    got = L.Scanner().scan(long.encode())
    assert got[:4] == (700_000, 100_000, 0, 699_993) and got[5] == "mit,reserved"
    assert L.scan_documents(spark.createDataFrame([], SCHEMA)).collect() == []
