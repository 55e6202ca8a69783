"""Alignment of two tokenizers: which tokens of one stand where which tokens of the other stand.

Every text is encoded by a byte-level vocabulary (A) and by a sentence-piece model (B). Where tokens of both
end at one byte, a group ends; inside a group every A token is linked to the B tokens whose bytes it shares.
A pair of ids counts the documents that hold it linked, and a document is told how often its links
are the commonest ones of their A id.

Most groups are one A token and the one B token of the same bytes. An array made once gives every
A id its B id of the same bytes; such pairs are counted in vectors as long as A's vocabulary, and
only the other pairs are shuffled, already counted per task. The ends of a whole slice of documents are
compared at once: as both token rows spell the same bytes, the slice is one long text, and every stretch
between two neighbouring ends is one link.

Counts of the shuffled pairs go to all tasks while they take ``broadcast_bytes`` at most; beyond that, each
document's pairs meet them in a join that salts hot pairs. Both ways give the same rows.

Null and empty texts have no tokens, nor have texts that one of the tokenizers does not spell byte by
byte; these rows are zeros with an empty digest. Every row is a document, repeated ids and texts too. Texts
are encoded in units cut at single spaces, where neither tokenizer joins words; a worker process remembers units it has
met. Only ``doc_id`` and ``text`` are read, so other columns cannot clash.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import cached_property, lru_cache
from itertools import chain, islice
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cloudtally.functions.skew import spread_join
from cloudtally.llm import arrow, bpe
from cloudtally.runtime import durable

BROADCAST_BYTES = 64 << 20
SLICE = 1 << 19
LINKED_TOKENS = 1 << 17
RANKED_CHARS = 1_000  # longer units go to the library whose time does not grow with the square of a piece
REMEMBERED, REMEMBERED_CHARS = 120_000, 64  # units kept in a worker process (some 250 bytes each), and their longest
SPACE = "▁"  # fixed value: how sentence-piece models write a space
_UNITS = re.compile(r"(?<=\S) (?=\S)").split


def _vocabulary(path: str) -> tuple[tiktoken.Encoding | None, list[bytes]]:
    """The bytes of all tokens of a file, and its vocabulary as ranks, which a faster library encodes alike; no ranks if
    the merges are not in the order of their ids."""
    told = json.loads(Path(path).read_text(encoding="utf-8"))
    names, model = bpe.byte_names(), told["model"]
    spell = lambda token: bytes(names[c] for c in token)
    special = {t["content"]: t["id"] for t in told["added_tokens"]}
    ids = {spell(token): i for token, i in model["vocab"].items() if token not in special}
    found = [b""] * (1 + max([*ids.values(), *special.values()]))
    for token, i in [*ids.items(), *((t.encode(), i) for t, i in special.items())]:
        found[i] = token
    merged = [ids[spell("".join(m.split(" ") if isinstance(m, str) else m))] for m in model["merges"]]
    if merged != sorted(set(merged)) or len(ids) != len(merged) + 256:
        return None, found
    return tiktoken.Encoding("ranked", pat_str=bpe.PIECES, mergeable_ranks=ids, special_tokens={}), found


class Spelled:
    """The bytes of all tokens of one tokenizer in one array."""

    def __init__(self, tokens: list[bytes]) -> None:
        self.size = np.array([len(x) for x in tokens], dtype=np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.all = np.frombuffer(b"".join(tokens), dtype=np.uint8)

    def agree(self, ids: np.ndarray, n: np.ndarray, text: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Whether each unit (``n`` ids, ``sizes`` bytes of ``text``) is spelled by its ids."""
        unit, size = np.repeat(np.arange(len(n)), n), self.size[ids]
        same = np.bincount(unit, weights=size, minlength=len(n)).astype(np.int64) == sizes
        of_ids, of_text = same[unit], np.repeat(same, sizes)
        ids, size = ids[of_ids], size[of_ids]
        at = np.repeat(self.start[ids] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        other = self.all[at] != text[of_text]
        if other.any():
            same[np.repeat(np.arange(len(n)), sizes)[of_text][other]] = False
        return same


class Tokenizers:
    """Both tokenizers, the bytes of their tokens, and the B id of the same bytes for every A id."""

    def __init__(self, a_path: str, b_path: str) -> None:
        self.a_path = a_path
        self.ranked, a_bytes = _vocabulary(a_path)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a_bytes, self.b_bytes, whole = a_bytes, [], {}
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            if self.b.is_byte(i):
                self.b_bytes.append(bytes([int(piece[3:5], 16)]))
            else:
                self.b_bytes.append(piece.replace(SPACE, " ").encode())
                if not (self.b.is_control(i) or self.b.is_unknown(i)):
                    whole[self.b_bytes[-1]] = i
        for i, data in enumerate(self.b_bytes):  # a byte stands for itself where no piece does
            if self.b.is_byte(i):
                whole.setdefault(data, i)
        self.a_spelled, self.b_spelled = Spelled(self.a_bytes), Spelled(self.b_bytes)
        self.a_size, self.b_size = self.a_spelled.size, self.b_spelled.size
        self.kind = np.dtype("<u2" if max(len(self.a_bytes), len(self.b_bytes)) <= 1 << 16 else "<u4")
        # a piece that goes on behind a space would join words, and then texts must stay whole
        self.cut = (lambda text: [text]) if any(b" " in x.lstrip(b" ") for x in self.b_bytes) else _UNITS
        self.known_a: dict[str, bytes | None] = {}
        self.known_b: dict[str, bytes | None] = {}
        self.same = np.array([whole.get(x, -1) for x in self.a_bytes], dtype=np.int64)
        self.a_name, self.b_name = (np.array([str(i) for i in range(len(own))], dtype=object) for own in (self.a_bytes, self.b_bytes))
        self.shown = np.array([f"{i}|{k}" for i, k in enumerate(self.same.tolist())], dtype=object)

    @cached_property
    def a(self) -> Tokenizer:
        """The library for A itself, loaded where ranks do not do."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks already share out the cores
        made = Tokenizer.from_file(self.a_path)
        made.encode_special_tokens = True
        made.no_truncation()
        made.no_padding()
        return made

    def learn(self, units: set[str]) -> None:
        """Ids of new units as bytes; None where a tokenizer does not spell the unit behind a space."""
        new = list(units.difference(self.known_a))
        if len(self.known_a) + len(new) > REMEMBERED:  # the older half goes, but nothing of this slice
            for known in (self.known_a, self.known_b):
                rest = dict(islice(known.items(), len(known) // 2, None))
                known.clear()
                known.update(rest)
            new = list(units.difference(self.known_a))
        if not new:
            return
        rank = self.ranked.encode_ordinary if self.ranked else None
        coded = [
            rank(" " + u) if rank and len(u) <= RANKED_CHARS else self.a.encode(" " + u, add_special_tokens=False).ids for u in new
        ]
        data = [b" " + u.encode() for u in new]
        sizes, text = np.fromiter(map(len, data), np.int64, len(new)), np.frombuffer(b"".join(data), dtype=np.uint8)
        right, kept = np.ones(len(new), dtype=bool), []
        for ids, spelled in ((coded, self.a_spelled), (self.b.encode(new, num_threads=1), self.b_spelled)):
            flat, n = np.fromiter(chain.from_iterable(ids), self.kind), np.fromiter(map(len, ids), np.int64, len(new))
            right &= spelled.agree(flat, n, text, sizes)
            kept.append((flat.tobytes(), (self.kind.itemsize * np.cumsum(n)).tolist()))
        (a, a_ends), (b, b_ends) = kept
        a_start = b_start = 0
        for unit, fine, a_end, b_end in zip(new, right.tolist(), a_ends, b_ends, strict=True):
            self.known_a[unit], self.known_b[unit] = (a[a_start:a_end], b[b_start:b_end]) if fine else (None, None)
            a_start, b_start = a_end, b_end

    def encode(self, texts: list[str]) -> tuple[list[bytes], list[bytes]]:
        """A and B ids of every text as numbers of ``kind``; none where either does not spell the text behind a space."""
        units = [self.cut(t) if t else [] for t in texts]
        own = set(chain.from_iterable(units))
        self.learn(own)
        out = []
        for known in (self.known_a, self.known_b):
            ids = []
            for of_text in units:
                try:
                    ids.append(b"".join(map(known.__getitem__, of_text)))
                except TypeError:  # a unit that is not spelled right
                    ids.append(b"")
            out.append(ids)
        for unit in own:
            if len(unit) > REMEMBERED_CHARS:
                del self.known_a[unit], self.known_b[unit]
        return out[0], out[1]


@lru_cache(maxsize=4)
def tokenizers(a_path: str, b_path: str) -> Tokenizers:
    """One copy in each worker process, for all its tasks."""
    return Tokenizers(a_path, b_path)


def _flat(column: pa.Array, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a slice of documents, and how many each has."""
    n = pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64) // kind.itemsize
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).astype(np.int64), n


class Links:
    """Groups and links of a slice of documents, which is treated as one long text."""

    def __init__(self, batch: pa.RecordBatch, both: Tokenizers) -> None:
        self.both, self.n_docs = both, batch.num_rows
        (self.a, self.n_a), (self.b, self.n_b) = (_flat(batch.column(c), both.kind) for c in ("a", "b"))
        # bit 1: an A token ends in front of this byte, bit 2: a B token does
        mark = np.zeros(both.a_size[self.a].sum() + 1, dtype=np.uint8)
        mark[np.cumsum(both.a_size[self.a])] = 1
        mark[np.cumsum(both.b_size[self.b])] |= 2
        mark = mark[mark > 0]  # every stretch up to an end is one link
        a_ends, b_ends = mark & 1, mark >> 1
        a_done, b_done = np.cumsum(a_ends, dtype=np.int64), np.cumsum(b_ends, dtype=np.int64)
        at = a_done - a_ends
        docs = np.repeat(np.arange(self.n_docs), self.n_a)
        self.link_a, self.link_b, self.link_doc = self.a[at], self.b[b_done - b_ends], docs[at]
        both_end = mark == 3
        self.group_doc = self.link_doc[both_end]
        self.a_last, self.b_last = a_done[both_end], b_done[both_end]  # behind the last tokens of each group
        self.plain = both.same[self.link_a] == self.link_b

    def distinct(self, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Document, A id, B id and number of the chosen links, each pair once in a document."""
        width_a, width_b = len(self.both.a_bytes), len(self.both.b_bytes)
        key = (self.link_doc[of] * width_a + self.link_a[of]) * width_b + self.link_b[of]
        key, n = np.unique(key, return_counts=True)
        rest, b = np.divmod(key, width_b)
        doc, a = np.divmod(rest, width_a)
        return doc, a, b, n

    def same_pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document, A id and number of the links to the B id of the same bytes."""
        width = len(self.both.a_bytes)
        key, n = np.unique(self.link_doc[self.plain] * width + self.link_a[self.plain], return_counts=True)
        doc, a = np.divmod(key, width)
        return doc, a, n

    def per_doc(self, doc: np.ndarray, value: np.ndarray) -> np.ndarray:
        total = np.zeros(self.n_docs, dtype=np.int64)
        np.add.at(total, doc, value)
        return total

    def digests(self) -> tuple[np.ndarray, list[str]]:
        """Groups of every document, and the SHA-256 of them written out."""
        both, a_first, b_first = self.both, np.r_[0, self.a_last[:-1]], np.r_[0, self.b_last[:-1]]
        shown = np.empty(len(self.group_doc), dtype=object)
        if len(shown):
            one = (self.a_last - a_first == 1) & (self.b_last - b_first == 1) & (both.same[self.a[a_first]] == self.b[b_first])
            shown[one] = both.shown[self.a[a_first[one]]]
            a, b, other = both.a_name[self.a].tolist(), both.b_name[self.b].tolist(), np.flatnonzero(~one)
            bounds = zip(other.tolist(), *(x[other].tolist() for x in (a_first, self.a_last, b_first, self.b_last)), strict=True)
            for g, i, j, k, m in bounds:
                shown[g] = ",".join(a[i:j]) + "|" + ",".join(b[k:m])
        n = np.bincount(self.group_doc, minlength=self.n_docs)
        texts, start = shown.tolist(), 0
        out = []
        for size in n.tolist():
            out.append(hashlib.sha256(";".join(texts[start : start + size]).encode()).hexdigest() if size else "")
            start += size
        return n, out


def tokens(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id, a number of its own for every row, and the ids by A and by B; stored, as several passes read it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = tokenizers(a_path, b_path)
        for batch in batches:
            for part in arrow.slices(batch, "text", SLICE):
                a, b = (pa.array(x, pa.binary()) for x in both.encode([t or "" for t in part.column("text").to_pylist()]))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), a, b], ["doc_id", "a", "b"])

    coded = arrow.texts(docs).mapInArrow(run, "doc_id long, a binary, b binary")
    return durable(coded.withColumn("row", F.monotonically_increasing_id()))


def _links(batches: Iterator[pa.RecordBatch], both: Tokenizers) -> Iterator[tuple[pa.RecordBatch, Links]]:
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column("a")).to_numpy(zero_copy_only=False).astype(np.int64)) // both.kind.itemsize
        start = 0
        while start < batch.num_rows:  # about so many tokens at once, one document at least
            least = (ends[start - 1] if start else 0) + LINKED_TOKENS
            stop = max(int(np.searchsorted(ends, least, side="right")), start + 1)
            part = batch.slice(start, stop - start)
            yield part, Links(part, both)
            start = stop


def pair_counts(coded: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """a, b, whether both have the same bytes, and the number of documents with such a link, for all pairs.

    Pairs of the same bytes leave a task as one vector over A's vocabulary, the others as distinct pairs of its slices.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = tokenizers(a_path, b_path)
        vector = np.zeros(len(both.a_bytes), dtype=np.int64)
        names = ["a", "b", "plain", "n"]
        flags = lambda x, flag: pa.array(np.full(len(x), flag))
        for _, links in _links(batches, both):
            vector += np.bincount(links.same_pairs()[1], minlength=len(vector))
            _, a, b, _ = links.distinct(~links.plain)
            key, n = np.unique(a << 32 | b, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key >> 32), pa.array(key & 0xFFFFFFFF), flags(key, False), pa.array(n)], names)
        at = np.flatnonzero(vector)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(both.same[at]), flags(at, True), pa.array(vector[at])], names)

    found = coded.select("a", "b").mapInArrow(run, "a long, b long, plain boolean, n long")
    return found.groupBy("a", "b", "plain").agg(F.sum("n").alias("n"))


def align(docs: DataFrame, a_path: str, b_path: str, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Per row doc_id, tokens, groups and links, the links whose pair is the commonest of its A id, the sum of
    the pairs' counts over links, and the SHA-256 of the groups."""
    spark = docs.sparkSession
    both = tokenizers(a_path, b_path)
    coded = tokens(docs, a_path, b_path)
    counts = durable(pair_counts(coded, a_path, b_path))
    # a row for each A id at most: bounded by the vocabulary
    tops = counts.groupBy("a").agg(F.max("n").alias("top"), F.max(F.when(F.col("plain"), F.col("n"))).alias("same")).toArrow()
    top, same = np.zeros((2, len(both.a_bytes)), dtype=np.int64)
    ids = tops["a"].to_numpy()
    top[ids], same[ids] = tops["top"].to_numpy(), tops["same"].fill_null(0).to_numpy()
    others = counts.filter(~F.col("plain")).drop("plain")
    small = 16 * others.count() <= broadcast_bytes
    table = None
    if small:
        listed = others.select(F.shiftleft("a", 32).bitwiseOR(F.col("b")).alias("key"), "n").toArrow().sort_by("key")
        table = (listed["key"].to_numpy(), listed["n"].to_numpy())
    told = spark.sparkContext.broadcast((top, same, table))
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, (top, same, table) = tokenizers(a_path, b_path), told.value
        for part, links in _links(batches, both):
            doc, a, n = links.same_pairs()
            best, total = links.per_doc(doc, n * (same[a] == top[a])), links.per_doc(doc, n * same[a])
            if table is not None:
                doc, a, b, n = links.distinct(~links.plain)
                key, at = np.unique(a << 32 | b, return_inverse=True)
                count = table[1][np.searchsorted(table[0], key)][at]
                best += links.per_doc(doc, n * (count == top[a]))
                total += links.per_doc(doc, n * count)
            n_groups, digest = links.digests()
            n_links = np.bincount(links.link_doc, minlength=links.n_docs)
            columns = [part.column("doc_id"), *map(pa.array, (links.n_a, links.n_b, n_groups, n_links, best, total)), pa.array(digest, pa.string())]
            yield pa.RecordBatch.from_arrays([*columns, part.column("row")], [*names, "row"])

    schema = ", ".join(f"{c} {'string' if c == 'groups_sha256' else 'long'}" for c in [*names, "row"])
    rows = coded.mapInArrow(finish, schema)
    if small:
        return rows.select(*names)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, links in _links(batches, tokenizers(a_path, b_path)):
            doc, a, b, n = links.distinct(~links.plain)
            yield pa.RecordBatch.from_arrays([part.column("row").take(pa.array(doc)), *map(pa.array, (a, b, n))], ["row", "a", "b", "times"])

    known = others.join(F.broadcast(spark.createDataFrame(tops.select(["a", "top"]))), "a")
    met = spread_join(coded.mapInArrow(pairs, "row long, a long, b long, times long"), known, ["a", "b"])
    sums = met.groupBy("row").agg(
        F.sum(F.when(F.col("n") == F.col("top"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum")
    )
    more = lambda c, d: (F.col(c) + F.coalesce(d, F.lit(0))).alias(c)
    return rows.join(sums, "row", "left").select(*[more(c, {"n_best": "more_best", "count_sum": "more_sum"}[c]) if c in ("n_best", "count_sum") else c for c in names])
