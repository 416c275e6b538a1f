"""The filter audit against its SQL and a plain version of its definition."""

import itertools
import random
import re

import numpy as np
import pytest
from compare import assert_same

from sporeline.llm import filter_audit as A

SCHEMA = "doc_id long, text string, source string, part string, mask string, h long"
LABELS = "doc_id long, quality int, toxic int, key string"


def plain_masks(docs):
    out = []
    for d, text, *_ in docs:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        mask = (len(words) < 50) | (100 * len(set(words)) < 65 * len(words)) << 1 | (100 * len(re.findall("[A-Z]", t)) > 5 * len(t)) << 2 | bool(re.search(r"[#$%&*|]", t)) << 3
        copy = d is not None and any(e is not None and e < d and (x or "") == t for e, x, *_ in docs)
        out.append(mask | copy << 4)
    return out


def plain_audit(docs, labels):
    good, toxic = ({d for d, q, x, *_ in labels if d is not None and (q, x)[i] == 1} for i in (0, 1))
    masks, rows = plain_masks(docs), {}
    for part in {s or "" for _, _, s, *_ in docs}:
        held = [(d, m) for (d, _, s, *_), m in zip(docs, masks, strict=True) if (s or "") == part]
        share = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations(range(5)):
            left = held
            for i, f in enumerate(order):
                gone = [x for x in left if x[1] >> f & 1]
                left = [x for x in left if not x[1] >> f & 1]
                before = [x for x in held if x[1] >> f & 1 and x not in gone]
                only = sum(m == 1 << f for _, m in held)
                name = "".join("ABCDE"[f] for f in order)
                rows[part, name, i + 1] = [len(left), len(gone), len([x for x in held if x[1] >> f & 1]) - len(gone), only, sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone)]
                share["ABCDE"[f]] += len(gone)
                assert len(before) >= 0
        for (p, name, i), r in rows.items():
            if p == part:
                r.append(share[name[i - 1]])
    return rows


def found(spark, docs, labels):
    df = A.audit(A.document_cells(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, LABELS)), "ABCDE")
    rows = df.collect()
    assert len({(r.part, r.filter_order, r.step) for r in rows}) == len(rows)
    return {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in rows}


def test_same_as_sql(spark, duck, sf_dir):
    assert assert_same(A.op13_filter_audit(spark, sf_dir), duck, A.ORACLE_SQL) >= 600


def test_same_as_plain_version(spark):
    rng = random.Random(3)
    texts = [None, "", "  \t", "A", "a # b", "word " * 60, " ".join(f"w{i}" for i in range(70)), " ".join(f"W{i}" for i in range(70)), "Ünï " * 30 + "cöde |", "x" * 200_000, " ".join(f"v{i % 50}" for i in range(70_000))]
    texts += [" ".join(rng.choice(("one", "TWO", f"n{rng.random()}", "&")) for _ in range(rng.randint(0, 120))) for _ in range(30)]
    docs = [(rng.choice((None, i, i, i // 3)), rng.choice(texts), rng.choice((None, "", "hot", "hot", "hot", "b")), "x", "y", 1) for i in range(150)]
    docs += docs[:20]
    labels = [(rng.choice((None, *range(150))), rng.choice((None, 0, 1)), rng.choice((None, 0, 1)), "k") for _ in range(200)]
    assert found(spark, docs, labels) == plain_audit(docs, labels)


def test_empty_tables(spark):
    assert found(spark, [], []) == {}
    got = found(spark, [(1, "a", None, "p", "m", 1)], [])
    assert len(got) == 600 and got["", "ABCDE", 1] == [0, 1, 0, 1, 0, 0, 120]


@pytest.mark.parametrize("k", [1, 2, 3, 4, 5, 6])
def test_walk_visits_every_order_by_single_swaps(k):
    seen, last = set(), None
    for order, at in A.swaps(k):
        if last is not None:
            assert [i for i in range(k) if order[i] != last[i]] == [at, at + 1]
        seen.add(tuple(order))
        last = order
    assert seen == set(itertools.permutations(range(k)))


def test_walk_keeps_steps_as_counted_anew():
    cells = np.random.default_rng(1).integers(0, 9, (3, 2, 16))
    for order, at in A.walk(cells, 4):
        for i, f in enumerate(order):
            before = sum(1 << g for g in order[:i])
            gone = [m for m in range(16) if m >> f & 1 and not m & before]
            assert (at["removed"][:, i] == cells[0][:, gone].sum(1)).all() and (at["toxic_lost"][:, i] == cells[2][:, gone].sum(1)).all()
            assert (at["kept"][:, i] == cells[0][:, [m for m in range(16) if not m & (before | 1 << f)]].sum(1)).all()


def test_number_of_filters_is_bounded(spark):
    with pytest.raises(ValueError):
        A.audit(spark.createDataFrame([], "part string, mask int, n long, good long, toxic long"), "ABCDEFGHI")
