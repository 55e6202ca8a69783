"""Tokenizer alignment against a plain form of it."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from cloudtally.llm import align

A, B = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
BOTH = align.tokenizers(A, B)
TEXTS = [
    "Hello  world", "", None, "x\n\ny <|endoftext|> </s> <0x41>", "é漢字 naïve" * 9, "the cat and the hat", "the cat and the hat", "aaaaaaa aaaa aaa",
    "already▁spelled", " leading", "trailing \n", "🙂🙂 zero​width \x00", "unbelievably antidisestablishmentarianism", "the " * 50, "\t", " ", "a  b   c    d",
]


def plain(texts):
    """Tokens, groups and links of every text, byte by byte."""
    a_tok, b_tok = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a_tok.encode_special_tokens = True
    told = []
    for text in texts:
        text = text or ""
        a, b = (a_tok.encode(" " + text, add_special_tokens=False).ids, b_tok.encode(text)) if text else ([], [])
        x, y = b"".join(BOTH.a_bytes[i] for i in a), b"".join(BOTH.b_bytes[i] for i in b)
        if not text or x != (" " + text).encode() or y != x:
            told.append(([], [], [], ""))
            continue
        own_a = [k for k, i in enumerate(a) for _ in BOTH.a_bytes[i]]
        own_b = [k for k, i in enumerate(b) for _ in BOTH.b_bytes[i]]
        links = [(a[i], b[j]) for i, j in sorted(set(zip(own_a, own_b, strict=True)))]
        groups, i, j = [], 0, 0
        for at in range(1, len(x) + 1):
            if at == len(x) or (own_a[at] != own_a[at - 1] and own_b[at] != own_b[at - 1]):
                p, q = own_a[at - 1] + 1, own_b[at - 1] + 1
                groups.append(",".join(map(str, a[i:p])) + "|" + ",".join(map(str, b[j:q])))
                i, j = p, q
        told.append((a, b, links, ";".join(groups)))
    counts = Counter(pair for _, _, links, _ in told for pair in set(links))
    best = {}
    for (i, _), n in counts.items():
        best[i] = max(best.get(i, 0), n)
    for a, b, links, groups in told:
        digest = hashlib.sha256(groups.encode()).hexdigest() if links else ""
        n_best = sum(counts[p] == best[p[0]] for p in links)
        yield len(a), len(b), len(groups.split(";")) if links else 0, len(links), n_best, sum(counts[p] for p in links), digest


@pytest.mark.parametrize("broadcast_bytes", [align.BROADCAST_BYTES, 0])
def test_rows_of_the_plain_form(spark, tiny, broadcast_bytes):
    given = [r.text for r in spark.read.parquet(f"{tiny}/documents.parquet").orderBy("doc_id").limit(120).collect()]
    texts = TEXTS + given
    docs = spark.createDataFrame([(k, t, "x", k) for k, t in enumerate(texts)], "doc_id long, text string, a string, row long").repartition(3)
    got = {r.doc_id: tuple(r)[1:] for r in align.align(docs, A, B, broadcast_bytes).collect()}
    assert [got[k] for k in range(len(texts))] == list(plain(texts))


def test_repeated_and_null_ids_and_empty_tables(spark):
    docs = spark.createDataFrame([(None, "the cat"), (None, "the cat"), (5, None), (5, "the hat")], "doc_id long, text string")
    rows = align.align(docs, A, B).collect()
    assert sorted(r.n_a for r in rows) == [0, 3, 3, 3] or sorted(r.n_links for r in rows)[0] == 0
    assert {r.count_sum for r in rows if r.doc_id is None} and len(rows) == 4
    assert align.align(docs.limit(0), A, B).count() == 0


def test_units_do_not_change_tokens(monkeypatch):
    monkeypatch.setattr(align, "REMEMBERED", 40)
    both = align.Tokenizers(A, B)
    base = "The quick  brown fox's\n tail, 12 times; déjà vu " * 20 + "🙂" * 300
    for text in (base, base + " " + "a" * 5000 + " b", *(f"{k} words and {k * 7} more of {k}" for k in range(60)), base):
        a, b = ([np.frombuffer(x, both.kind).tolist() for x in own] for own in both.encode([text, "", "x ▁ y", text]))
        assert a[0] == a[3] == both.a.encode(" " + text, add_special_tokens=False).ids
        assert b[0] == b[3] == both.b.encode(text)
        assert a[1] == b[1] == a[2] == b[2] == []
        assert max(map(len, both.known_a)) <= align.REMEMBERED_CHARS


def test_same_bytes_by_the_identity_map():
    at = [i for i, k in enumerate(BOTH.same) if k >= 0]
    assert len(at) > 5000 and all(BOTH.a_bytes[i] == BOTH.b_bytes[BOTH.same[i]] for i in at)
