"""Consistent weighted sampling against exact generalised Jaccard similarity and a plain walk over the documents."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from cloudtally.llm import weighted_sampling as cws


def weights(text, k):
    words = text.encode().split()
    if not words:
        return Counter()
    return Counter(tuple(words[i : i + k]) for i in range(max(len(words) - k + 1, 1)))


def exact(a, b, k=cws.WORDS):
    x, y = weights(a, k), weights(b, k)
    top = sum(max(x[t], y[t]) for t in x | y)
    return sum(min(x[t], y[t]) for t in x & y) / top if top else 1.0


@pytest.mark.parametrize("k", [1, 2, 3])
def test_agreement_is_generalised_jaccard(k):
    rng = random.Random(k)
    vocabulary = [f"w{i}" for i in range(40)]
    for n in (5, 60, 600):
        a = [rng.choice(vocabulary[:25] if rng.random() < 0.7 else vocabulary) for _ in range(n)]
        b = [w if rng.random() < 0.8 else rng.choice(vocabulary) for w in a]
        a, b = " ".join(a), " ".join(b + b[: n // 3])
        x, y = cws.signatures([a.encode(), b.encode()], k, 4000)
        assert abs((x == y).mean() - exact(a, b, k)) < 0.035


def test_gamma_tables():
    r, ln_c = cws.tables()
    assert abs(r.mean() - 2) < 1e-3 and abs(r.var() - 2) < 1e-2 and np.all(np.diff(r) > 0)
    assert np.all(np.diff(ln_c) >= 0) and ln_c[0] < -10


def test_equal_texts_and_texts_without_words():
    rows = cws.signatures([b"a b c", b"", b" a  b\nc", b" \n", b"a", "ä ö".encode()], 2, 64)
    assert (rows[0] == rows[2]).all() and not rows[1].any() and not rows[3].any() and rows[4].any() and rows[5].any()


def plain(rows):
    """doc_id, n_chars, edited text and next text of every (doc_id, text)."""
    least = cws.LEAST
    keys = sorted({least if i is None else i for i, _ in rows})
    head = {k: min((t or "" for i, t in rows if (least if i is None else i) == k), key=str.encode) for k in keys}
    for i, text in rows:
        text, k = text or "", keys.index(least if i is None else i)
        after = head[keys[k - 1]]
        n = len(text)
        yield i, n, text[: n - n // 3] + after[: n // 3], text, after


@pytest.mark.parametrize("case", ["given", "hot", "one", "same id"])
def test_rows_of_the_plain_form(spark, tiny, case):
    rng = random.Random(3)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text").collect()]
    if case == "hot":  # half of the rows have one id or none; texts null, empty, long, repeated
        rows = [(rng.choice([7, None, i]), t) for i, t in rows] + [(500, None), (501, ""), (7, "é漢🙂 " * 30_000), (502, "x"), (-3, "x")]
    elif case == "one":
        rows = [(4, "to be or not")]
    elif case == "same id":
        rows = [(4, t) for _, t in rows[:50]]
    docs = spark.createDataFrame([(i, t, 1, "p") for i, t in rows], "doc_id long, text string, key int, part string").repartition(5)
    got = sorted((tuple(r) for r in cws.edited(docs).collect()), key=repr)
    want = []
    for i, n, changed, text, after in plain(rows):
        a, b, c = cws.signatures([x.encode() for x in (text, changed, after)])
        want.append((i, n, hashlib.sha256(changed.encode()).hexdigest(), *cws._shown(np.array([a, b])), float((a == b).mean()), float((a == c).mean())))
    assert got == sorted(want, key=repr)


def test_fingerprints_and_likeness(spark):
    docs = spark.createDataFrame([(1, "a b c d e"), (2, "a b c d f"), (3, None)], "doc_id long, text string")
    f = {r.doc_id: r.fingerprint for r in cws.fingerprints(docs).collect()}
    pairs = spark.createDataFrame([(f[1], f[1]), (f[1], f[2]), (f[1], f[3])], "a string, b string")
    same, near, far = [r[0] for r in pairs.select(cws.likeness(pairs.a, pairs.b)).collect()]
    assert same == 1 and 0.2 < near < 0.9 and far == 0
    assert cws.edited(docs.limit(0)).count() == 0
