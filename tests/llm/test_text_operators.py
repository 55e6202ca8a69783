"""Byte-pair encoding, quality rules, line and passage removal against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cloudtally.llm import bpe, line_index, quality, recompress

PATH = public_tokenizers.path("byte_bpe_50k.json")
CODEC, THEIRS = bpe.Codec(PATH), Tokenizer.from_file(PATH)
SPLIT = re.compile("[^\x20\x09-\x0d]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("ab  \n\t'stld<|endoftext|>0é漢"), st.characters(exclude_categories=["Cs"])), max_size=80))
def test_ids_are_those_of_the_library(text):
    want = THEIRS.encode(text, add_special_tokens=False).ids
    ids = CODEC.encode(text)
    assert ids.tolist() == want
    assert CODEC.decode(ids) == THEIRS.decode(want, skip_special_tokens=False) == text


def test_long_pieces_and_small_memory():
    small = bpe.Codec(PATH, remembered=3)
    for text in ("a" * 5000, "ab" * 3000, " " * 500 + "x", "\n" * 70 + " y", "The " * 2000, "<|endoftext|>" * 4):
        assert small.encode(text).tolist() == THEIRS.encode(text, add_special_tokens=False).ids


def test_encode_decode_tables(spark):
    texts = ["Hello  world", "", None, "x\n\ny <|endoftext|>", "é漢字" * 40]
    docs = spark.createDataFrame([(k, t, [k]) for k, t in enumerate(texts)], "doc_id long, text string, ids array<int>")
    tokens = bpe.encode(docs, PATH)
    back = {r.doc_id: r.text for r in bpe.decode(tokens, PATH).collect()}
    assert back == {k: t or "" for k, t in enumerate(texts)}
    for r in bpe.digests(docs, PATH, with_ids=True).collect():
        ids = THEIRS.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.ids == ids and r.n_tokens == len(ids) and r.decoded_sha256 == sha(texts[r.doc_id] or "")
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    assert bpe.digests(docs.limit(0), PATH).count() == 0


def plain_base(text):
    words = SPLIT.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if SPLIT.search(line):
            dup += line in seen
            seen.add(line)
    runs = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    inside = {p for i in range(len(words) - 2) if runs[tuple(words[i : i + 3])] > 1 for p in range(i, i + 3)}
    n = len(words)
    failed = n < 50 or 100 * len(inside) > 50 * n
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside), failed


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab é#|\n\t\x1c", max_size=300))
def test_base_figures(text):
    assert quality.measure(text.encode())[:6] == plain_base(text)


def plain_worst(text):
    """The largest share of its limit, n-gram by n-gram and line by line."""
    lines = [x for x in text.split("\n") if SPLIT.search(x)]
    if len(lines) > 2:
        size = lambda x: len(SPLIT.findall(x))
        lines = lines[size(lines[0]) <= quality.FRAME_WORDS :][: len(lines) - (size(lines[0]) <= quality.FRAME_WORDS) - (size(lines[-1]) <= quality.FRAME_WORDS)]
    words = [w for x in lines for w in SPLIT.findall(x)]
    total, worst = sum(map(len, words)), 0.0
    for n in range(2, 11):
        where = {}
        for i in range(len(words) - n + 1):
            where.setdefault(tuple(words[i : i + n]), []).append(i)
        most = max(map(len, where.values()), default=0)
        if n in quality.COMMONEST and most > 1:
            worst = max(worst, max(most * sum(map(len, g)) for g, at in where.items() if len(at) == most) / total / quality.COMMONEST[n])
        if n in quality.COVERED:
            inside = {p for at in where.values() for i in at[1:] for p in range(i, i + n)}
            worst = max(worst, sum(len(words[p]) for p in inside) / total / quality.COVERED[n])
    again = [x for k, x in enumerate(lines) if x in lines[:k]]
    chars = sum(len("".join(SPLIT.findall(x))) for x in again)
    return max(worst, len(again) / len(lines) / quality.LINES, chars / total / quality.LINE_CHARS)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab é", min_size=1, max_size=40), min_size=1, max_size=12))
def test_worst_share_of_any_text(lines):
    text = "\n".join(lines)
    if SPLIT.search(text):
        assert quality.measure(text.encode())[7] == pytest.approx(plain_worst(text))


@pytest.mark.parametrize("size", [60, 78, 96, 130])
@pytest.mark.parametrize("again", [5, 9, 10, 14, 18, 19, 30])
def test_short_texts_that_only_the_limits_reject(size, again):
    words = [f"w{k:04d}" for k in range(size)]
    text = " ".join(words + words[:again])
    got = quality.measure(text.encode())
    worst = plain_worst(text)
    assert got[7] == pytest.approx(worst) and got[6] == (worst <= 1 and not got[5]) and got[5] == (again == 30 and size < 80)
    # ten-grams cover all words that come again
    if again >= 10 and not got[5]:
        assert got[6] == (again / (size + again) <= quality.COVERED[10])


def test_headings_and_footers_may_come_again():
    body = "\n".join(" ".join(f"x{k}{j}" for j in range(11)) for k in range(6))
    assert quality.measure(f"A short heading of this page\n{body}\nA short heading of this page".encode())[6]
    long = " ".join(f"y{j}" for j in range(20))
    assert not quality.measure(f"{long}\n{body}\n{long}".encode())[6]
    lines = "\n".join(f"line {k % 4} has some words that are said again and again" for k in range(40))
    assert not quality.measure(lines.encode())[6]


def test_quality_table(spark):
    docs = spark.createDataFrame([(1, None, True), (2, "", False), (None, "a " * 60, True), (2, " ".join(map(str, range(80))), None)], "doc_id long, text string, kept boolean")
    got = sorted(((r.doc_id or 0, r.n_words, r.base_failed, r.kept) for r in quality.rules(docs.repartition(2)).collect()))
    assert got == [(0, 60, True, False), (1, 0, True, False), (2, 0, True, False), (2, 80, False, True)]
    assert quality.rules(docs.limit(0)).count() == 0


@pytest.mark.parametrize("n", [0, 1, 3, 700, 20_000])
def test_perfect_hash_is_perfect(n):
    pairs = np.random.default_rng(n).integers(0, 1 << 63, (n, 2)).astype(np.uint64)
    if n > 2:
        pairs[1, 0] = pairs[0, 0]
    found = line_index.PerfectHash.build(pairs).slots(pairs)
    assert sorted(found.tolist()) == list(range(n))


def test_pairs_that_never_separate_are_listed():
    pairs = np.array([[5, 7], [5, 7 ^ 0], [9, 9]], dtype=np.uint64)[[0, 2]]
    perfect = line_index.PerfectHash([], [], pairs)
    assert perfect.slots(pairs).tolist() == [0, 1] and perfect.slots(pairs + np.uint64(1)).tolist() == [-1, -1]


def plain_lines(rows):
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\r\x0b\x0c"))
    holders = {}
    for d, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            holders.setdefault(k, []).append(d)
    low = lambda d: -(10**30) if d is None else d
    lost = lambda d, k: len(k) >= 20 and len(holders[k]) >= 3 and low(d) != max(map(low, holders[k]))
    return Counter((d, None if t is None else "\n".join(x for x in t.split("\n") if not lost(d, key(x)))) for d, t in rows)


@pytest.mark.parametrize("broadcast_bytes", [1 << 20, -1])
def test_lines_against_brute_force(spark, broadcast_bytes):
    rng = random.Random(2)
    pool = [f"line number {k} of the shared pool é" for k in range(30)] + ["Short", "", "  PADDED line of the common Pool \t", "x" * 19, "é" * 20]
    rows = [(d, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 12)))) for d in range(60)]
    rows += [(None, "\n".join(pool)), (None, pool[3]), (70, None), (71, ""), (5, pool[4]), (5, pool[4]), (72, "own line that nobody else has at all\n" * 2)]
    docs = spark.createDataFrame([(d, t, 1, "y") for d, t in rows], "doc_id long, text string, n long, h1 string").repartition(3)
    got = line_index.dedup(docs, broadcast_bytes=broadcast_bytes, counts=("before", "gone"))
    assert got.columns == ["doc_id", "text", "n", "h1", "before", "gone"]
    assert Counter((r.doc_id, r.text) for r in got.collect()) == plain_lines(rows)
    for r in got.collect():
        assert r.before - r.gone == (len((r.text or "").split("\n")) if r.gone < r.before else 0)
    assert line_index.dedup(docs.limit(0)).count() == 0


def plain_removal(texts, window):
    words = [SPLIT.findall(t or "") for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = {p for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for p in range(i, i + window)}
        out.append((len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def passages(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(rng.choice([3, 40, 3000]))]
    shared = [[rng.choice(vocabulary) for _ in range(rng.randint(5, 90))] for _ in range(6)]
    texts = []
    for _ in range(40):
        parts = [rng.choice(shared) if rng.random() < 0.4 else [rng.choice(vocabulary) for _ in range(rng.randint(0, 60))] for _ in range(rng.randint(0, 5))]
        texts.append(" ".join(w for p in parts for w in p))
    return [*texts, None, "", "a " * 100, "b c " * 60, texts[3], texts[3], "x y  z\t" * 13]


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("broadcast_bytes", [1 << 20, -1])
def test_passages_against_brute_force(spark, seed, broadcast_bytes):
    texts = passages(seed)
    ids = [k if k % 11 else None for k in range(len(texts))]
    rows = [(i, t, 0, "name") for i, t in zip(ids, texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, at int, name string").repartition(4)
    got = recompress.remove_repeats(docs, 35, broadcast_bytes=broadcast_bytes).collect()
    want = Counter((i, *w) for i, w in zip(ids, plain_removal(texts, 35)))
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.text) for r in got) == want
    assert any(w[1] for w in plain_removal(texts, 35))


@pytest.mark.parametrize("rounds", [1, 3, 6, 8])
def test_no_repeated_window_is_ruled_out(rounds):
    """A symbol that lies in a window with its context is found at every occurrence of the window."""
    for seed in range(6):
        words = [SPLIT.findall(t or "") for t in passages(seed)]
        names = recompress.word_names([w.encode() for ws in words for w in ws])
        doc = np.repeat(np.arange(len(words)), [len(w) for w in words])
        s = recompress.recompress(names, doc, rounds)
        inside = {}
        flat = [w for ws in words for w in ws]
        for lo, hi, name, start in zip(s.lo, s.hi, s.name, s.start):
            for i in range(max(hi - 35, 0), lo + 1):
                inside.setdefault(i, set()).add((int(start) - i, int(name)))
        groups = {}
        for i in range(len(flat) - 34):
            if doc[i] == doc[i + 34]:
                groups.setdefault(tuple(flat[i : i + 35]), []).append(frozenset(inside.get(i, ())))
        assert all(len(set(g)) == 1 for g in groups.values())


def test_empty_passages(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert recompress.remove_repeats(docs).count() == 0
