import random

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from cloudtally.llm import simhash
from cloudtally.llm.components import components


def plain_fingerprint(text, k=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", low) if w]
    runs = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] if len(words) >= k else [" ".join(words)] * bool(words)
    hashed = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashed) > len(hashed))


def plain_components(ids, prints, radius):
    parent = dict.fromkeys(range(len(ids)))
    parent = {i: i for i in parent}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                parent[root(i)] = root(j)
    low = {}
    for i in range(len(ids)):
        low[root(i)] = min(low.get(root(i), ids[i]), ids[i])
    return {ids[i]: low[root(i)] for i in range(len(ids))}


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 130), st.integers(0, 9), st.integers(1, 3), st.integers(0, 5))
def test_bit_sliced_pairs_are_those_of_a_plain_count(n, radius, words, seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 63, (1, words)).astype(np.uint64)
    flips = np.packbits(rng.random((n, 64 * words)) < 0.04, axis=1).view(np.uint64)
    prints = base ^ flips
    true = np.bitwise_count(prints[:, None] ^ prints[None]).sum(axis=2) <= radius
    i, j = simhash.tile_within(simhash.planes(prints), prints[: simhash.TILE], radius, n)
    found = np.zeros_like(true)
    found[i, j] = True
    assert (found[: simhash.TILE] == true[: simhash.TILE]).all()
    a, b = np.triu_indices(n, 1)
    assert (np.sort(simhash.pairs_within(prints[a], prints[b], radius)) == np.flatnonzero(true[a, b])).all()


TEXTS = ["", None, "one", "one two", "one two three", "ONE two  Three", "a b c d e f", "a b c d e f", "é É ü"]


def test_classes_are_those_of_brute_force(spark):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(50)]
    texts = list(TEXTS)
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.randint(20, 300))]
        for _ in range(6):
            copy = list(base)
            if rng.random() < 0.7:
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string, component int").repartition(3)
    prints = [plain_fingerprint(t) for t in texts]
    for group_rows in (8192, 2):
        got = {r.doc_id: (r.fp, r.component_id) for r in simhash.classes(docs, group_rows=group_rows).collect()}
        want = plain_components(list(range(len(texts))), prints, 2)
        assert {k: v[1] for k, v in got.items()} == want
        assert all(got[i][0] % (1 << 64) == prints[i] for i in got)
    assert len(set(want.values())) < len(texts)


def test_divided_groups_find_every_link(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 4).astype(np.int64)
    prints = {int(b) for b in base}
    for b in base:
        for _ in range(150):
            x = int(b)
            for bit in rng.choice(63, rng.integers(1, 4), replace=False):
                x ^= 1 << int(bit)
            prints.add(x)
    prints = sorted(prints)
    df = spark.createDataFrame([(p,) for p in prints], "fp long")
    want = plain_components(prints, [p & ((1 << 64) - 1) for p in prints], 2)
    for group_rows in (5, 8192):
        got = {r.node: r.component for r in components(simhash.exact_links(df, 2, group_rows)).collect()}
        assert {p: got.get(p, p) for p in prints} == want


def test_near_classes_join_similar_sets_and_nothing_else(spark):
    rng = random.Random(8)
    words = [f"w{k}" for k in range(4000)]
    texts, group = [], []
    for g in range(25):
        base = [rng.choice(words) for _ in range(rng.randint(150, 400))]
        for c in range(4):
            copy = list(base)
            if c:
                copy[rng.randrange(len(copy))] = "edited"
            texts.append(" ".join(copy))
            group.append(4 * g)
    texts += [None, "", None]
    group += [100, 100, 100]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(None, "x"), (5, texts[5])], "doc_id long, text string").repartition(4)
    for group_rows in (8192, 2):
        got = simhash.near_classes(docs, group_rows=group_rows).collect()
        assert len(got) == len(texts) + 1
        assert {r.doc_id: r.component_id for r in got} == dict(enumerate(group))


def test_near_classes_are_those_of_exact_jaccard_at_every_size(spark):
    rng, texts, group = random.Random(12), [], []
    for size in range(1, 101):
        for part in (0.7, 0.75, 0.79, 0.8, 0.81, 0.85, 0.9):
            shared = max(1, round(part * size))
            own = [f"s{len(texts)}x{k}" for k in range(size)]
            cut = rng.randint(shared, size)
            a, b = own[:cut], own[:shared] + own[cut:]
            similar = len(set(a) & set(b)) / len(set(a) | set(b)) >= 0.8
            group += [len(texts), len(texts) if similar else len(texts) + 1]
            texts += [" ".join(a), " ".join(b)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in simhash.near_classes(docs, k=1).collect()}
    assert got == dict(enumerate(group))


def test_near_classes_of_cut_groups_are_those_of_brute_force(spark):
    rng, texts, sets = random.Random(13), [], []
    for g in range(6):
        base = [f"g{g}w{k}" for k in range(40)]
        for c in range(12):
            own = set(base) - set(rng.sample(base, rng.randint(0, 6))) | {f"g{g}c{c}x{k}" for k in range(rng.randint(0, 4))}
            sets.append(own)
            texts.append(" ".join(sorted(own)))
    parent = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8:
                low, high = sorted((parent[i], parent[j]))
                parent = [low if p == high else p for p in parent]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    for group_rows in (8192, 5, 2):
        got = {r.doc_id: r.component_id for r in simhash.near_classes(docs, k=1, group_rows=group_rows).collect()}
        assert got == dict(enumerate(parent))
    assert 6 < len(set(parent)) < len(parent)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.classes(docs).count() == 0
    assert simhash.near_classes(docs).count() == 0


@pytest.mark.parametrize("links", [[], [(1, 1)], [(k, k + 1) for k in range(200)], [(0, k) for k in range(50)] + [(99, 98), (98, 97), (None, 3)]])
def test_components(spark, links):
    df = spark.createDataFrame(links, "a long, b long")
    nodes = {n for e in links if e[0] != e[1] and None not in e for n in e}
    low = {n: n for n in nodes}
    for _ in nodes:
        for a, b in links:
            if a in low and b in low:
                low[a] = low[b] = min(low[a], low[b])
    assert {r.node: r.component for r in components(df).collect()} == low


def test_columns_may_have_any_name(spark):
    docs = spark.createDataFrame([(2, "a b c d e f g", 1, "x"), (1, "a b c d e f g", 2, "y"), (None, "a", 3, "z")], "doc_id long, text string, _id long, _low string")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted(map(tuple, kept.collect()), key=repr) == [(1, "a b c d e f g", 2, "y"), (None, "a", 3, "z")]
