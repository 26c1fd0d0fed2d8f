import random
import re
from itertools import permutations

import numpy as np
import pytest

from textmill.llm import filter_audit

NAMES = "doc_id long, text string, lang string, part string, mask int"


def failing(rows):
    """The failed filters of each row, by definition."""
    out = []
    for i, text, *_ in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        failed = ""
        failed += "A" if len(words) < 100 else ""
        failed += "B" if 100 * len(set(words)) < 80 * len(words) else ""
        failed += "C" if 100 * len(re.findall("[A-Z]", text)) > 10 * len(text) else ""
        failed += "D" if re.search(r"[#$%&*|]", text) else ""
        failed += "E" if i is not None and any(j is not None and j < i and (t or "") == text for j, t, *_ in rows) else ""
        out.append(failed)
    return out


def brute_force(rows, labels):
    """Every order applied filter by filter to the list of documents."""
    good = {i for i, quality, _ in labels if quality == 1 and i is not None}
    toxic = {i for i, _, toxic in labels if toxic == 1 and i is not None}
    docs = [(r[2] or "", r[0], f) for r, f in zip(rows, failing(rows), strict=True)]
    out = {}
    for part in {p for p, *_ in docs}:
        own = [(i, f) for p, i, f in docs if p == part]
        for order in permutations("ABCDE"):
            left = own
            for step, letter in enumerate(order, 1):
                gone = [(i, f) for i, f in left if letter in f]
                left = [(i, f) for i, f in left if letter not in f]
                out[part, "".join(order), step] = [
                    len(left), len(gone), sum(letter in f for _, f in own) - len(gone), sum(f == letter for _, f in own),
                    sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone),
                ]
    shapley = {}
    for (part, order, step), counts in out.items():
        key = part, order[step - 1]
        shapley[key] = shapley.get(key, 0) + counts[1]
    return {k: [*v, shapley[k[0], k[1][k[2] - 1]]] for k, v in out.items()}


def audited(spark, rows, labels):
    docs = spark.createDataFrame([(*r, "own", 7) for r in rows], NAMES).repartition(3)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    cells = filter_audit.failure_cells(docs, known, filter_audit.five_filters(), "E")
    found = filter_audit.audit(cells, "ABCDE").collect()
    result = {(r.part, r.filter_order, r.step): [r[c] for c in filter_audit.COUNTS] for r in found}
    assert len(result) == len(found)
    return result


def test_audit_against_brute_force(spark):
    rng = random.Random(2)
    words = ["one", "Two", "THREE", "#", "a\u00a0b", "été", "x|y", "😀", "four\x0b", "\x85"]
    rows = []
    for i in range(220):
        n = rng.choice((0, 3, 99, 100, 101, 140))
        vocabulary = words if rng.random() < 0.5 else [f"w{k}" for k in range(400)]
        text = rng.choice((" ", "\n", "  \t")).join(rng.choice(vocabulary) for _ in range(n))
        rows.append((i, text, rng.choice(("en", "de", None, ""))))
    rows += [(500 + k, rows[k % 9][1], rng.choice(("en", "fr"))) for k in range(60)]
    rows += [rows[3], rows[3], (rows[3][0], rows[3][1], "fr"), (None, rows[4][1], "en"), (None, None, None), (-5, None, "en"), (7, rows[1][1], "de")]
    labels = [(i, rng.choice((0, 1, None)), rng.choice((0, 1))) for i in range(-5, 600, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1)]
    assert audited(spark, rows, labels) == brute_force(rows, labels)


def test_large_groups_very_long_texts_and_no_rows(spark):
    long = "Word " * 200_000
    rows = [(i, "the same", "en") for i in range(3000)] + [(9000, long, "en"), (9001, long, "de")]
    assert audited(spark, rows, []) == {
        k: v for k, v in _quick(rows).items()
    }
    assert audited(spark, [], []) == {}
    assert audited(spark, [(1, "", "en")], [(1, 1, 1)])["en", "ABCDE", 1] == [0, 1, 0, 1, 1, 1, 120]


def _quick(rows):
    """``brute_force`` for texts whose copies are all known to be in ascending order of ids."""
    first, out = {}, []
    for i, text, lang in rows:
        first.setdefault(text, i)
        out.append((i, text, lang))
    sample = [r for r in out if first[r[1]] == r[0]]
    copies = [r for r in out if first[r[1]] != r[0]]
    # one copy of each text stands for all: counts are linear in the documents
    kinds = {}
    for r in copies:
        kinds.setdefault(r[1:], []).append(r)
    result = {}
    for group, times in [(sample, 1)]:
        for k, v in brute_force(group, []).items():
            result[k] = [times * x for x in v]
    for (text, lang), own in kinds.items():
        pair = brute_force([(0, text, "none"), (1, text, lang)], [])
        for k, v in pair.items():
            if k[0] == lang:
                result[k] = [a + len(own) * b for a, b in zip(result.get(k, [0] * 7), v, strict=True)]
    return result


@pytest.mark.parametrize("k", [1, 3, 5, 6])
def test_gray_code_walk_against_sums(k):
    rng = np.random.default_rng(k)
    cells = rng.integers(0, 50, (1 << k, 3))
    states = filter_audit.survivors(cells)
    for state in range(1 << k):
        assert (states[state] == cells[[m for m in range(1 << k) if not m & state]].sum(axis=0)).all()
