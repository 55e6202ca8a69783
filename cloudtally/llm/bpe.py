"""Byte-pair encoding and decoding by dynamic programming over prefixes.

For every prefix of a piece of text one token is stored: the last one of that prefix's encoding. The
candidates are the vocabulary entries that end there, found by an automaton; the right one is the
only one that may follow the last token of the prefix in front of it. Whether two tokens may stand
side by side depends on the merges inside both alone, so the answer is kept per pair. Following the
stored tokens back from the end gives exactly the ids that merging by rank would give, without merging.

Null texts count as empty; empty texts have no tokens. Every row gives one row, repeated ids too.
"""

from __future__ import annotations

import gc
import hashlib
import json
import struct
from collections.abc import Callable
from itertools import islice
from pathlib import Path

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from cloudtally.llm import arrow

#: How byte-level vocabularies split text, and the name of the bytes that do not print.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]

#: Encodings of so many different pieces, and of so many words, are remembered in a worker process (some 150 bytes each).
REMEMBERED = 200_000
NEVER = 1 << 62


def byte_names() -> dict[str, int]:
    """Characters of a vocabulary file and the bytes they stand for."""
    names = {chr(b): b for b in PRINTABLE}
    for k, b in enumerate(b for b in range(256) if b not in set(PRINTABLE)):
        names[chr(256 + k)] = b
    return names


class Vocabulary:
    """A byte-level vocabulary: bytes of every token, the merge that makes it, and its special tokens."""

    def __init__(self, path: str) -> None:
        told = json.loads(Path(path).read_text(encoding="utf-8"))
        names = byte_names()
        spell = lambda token: bytes(names[c] for c in token)
        self.ids = {spell(token): i for token, i in told["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in told["added_tokens"]}
        self.bytes = [b""] * (1 + max([*self.ids.values(), *self.special.values()]))
        for token, i in self.ids.items():
            self.bytes[i] = token
        for text, i in self.special.items():
            self.bytes[i] = text.encode()
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.born: dict[int, int] = {}
        for r, merge in enumerate(told["model"]["merges"]):
            left, right = (spell(x) for x in (merge.split(" ") if isinstance(merge, str) else merge))
            a, b, whole = self.ids[left], self.ids[right], self.ids[left + right]
            self.rank[a, b] = r
            self.parts.setdefault(whole, (a, b))
            self.born.setdefault(whole, r)
        self.automaton = ahocorasick.Automaton()
        self.whole = {token: i for token, i in self.ids.items() if len(token) == 1 or i in self.parts}
        for token, i in self.whole.items():
            self.automaton.add_word(token.decode("latin-1"), (i, len(token)))
        self.automaton.make_automaton()
        self._edges: dict[tuple[int, int], list[tuple[int, int]]] = {}

    def edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The token and the parts along one side of it (0 left, 1 right), each with the merge that ends it."""
        key = (token, side)
        if key not in self._edges:
            found, ends = [(token, NEVER)], token
            while ends in self.parts:
                merged = self.born[ends]
                ends = self.parts[ends][side]
                found.append((ends, merged))
            self._edges[key] = found
        return self._edges[key]

    def fit(self, a: int, b: int) -> bool:
        """May ``b`` follow ``a``: no merge joins a part at the end of ``a`` and one at the start of ``b``
        while both exist. Of equal merges the one further left comes first."""
        for u, u_ends in self.edge(a, 1):
            for v, v_ends in self.edge(b, 0):
                m = self.rank.get((u, v))
                if m is not None and m < u_ends and m <= v_ends:
                    return False
        return True


#: White space in the sense of the pattern, beside the space and the line end.
OTHER_SPACE = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f"
WIDE_SPACE = "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def _even(text: str) -> bool:
    """Whether all white space is single spaces and line ends between words."""
    if not text or text[0] in " \n" or text[-1] in " \n":
        return False
    if "  " in text or "\n\n" in text or " \n" in text or "\n " in text:
        return False
    return not any(c in text for c in (OTHER_SPACE if text.isascii() else OTHER_SPACE + WIDE_SPACE))


def _forget_half(known: dict) -> None:
    """Drop the older half of the entries."""
    newer = list(islice(known.items(), (len(known) + 1) // 2, None))
    known.clear()
    known.update(newer)


class Codec:
    """Encodes and decodes whole texts with one vocabulary."""

    def __init__(self, path: str, remembered: int = REMEMBERED) -> None:
        gc.set_threshold(200_000, 50, 50)  # hundreds of thousands of kept entries, and no cycles among them
        self.words = Vocabulary(path)
        self.split = regex.compile(PIECES).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.words.special)) + ")").split if self.words.special else None
        self.remembered = remembered
        self.size = np.array([len(x) for x in self.words.bytes], dtype=np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.letters = np.frombuffer(b"".join(self.words.bytes), dtype=np.uint8)
        self._fits: dict[int, bool] = {}  # plain numbers as keys, which the garbage collector need not visit
        owner = self
        pack = lambda ids: struct.pack(f"<{len(ids)}I", *ids)

        class Known(dict):
            """Encodings as bytes, by what is made of a key where it is missing."""

            def __init__(self, make: Callable[[str], bytes]) -> None:
                super().__init__()
                self.make = make

            def __missing__(self, key: str) -> bytes:
                if len(self) >= owner.remembered:
                    _forget_half(self)
                made = self.make(key)
                if len(key) <= 64:
                    self[key] = made
                return made

        self.pieces = Known(lambda piece: pack(self.piece(piece.encode())))
        self.first = Known(self._pieces)
        # a word of letters is one piece with the space in front of it
        self.later = Known(lambda word: pack(self.piece(b" " + word.encode())) if word.isascii() and word.isalpha() else self._pieces(" " + word))
        self.newline = self._pieces("\n")

    def _pieces(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.split(text)))

    def _plain(self, text: str) -> bytes:
        """A text without special tokens. Pieces never cross from a word into the next, and a single
        space goes with the word behind it, so evenly spaced text is encoded word by word."""
        if not _even(text):
            return self._pieces(text)
        first, later, lines = self.first, self.later.__getitem__, []
        for line in text.split("\n"):
            words = line.split(" ")
            lines.append(first[words[0]] + b"".join(map(later, words[1:])))
        return self.newline.join(lines)

    def fit(self, key: int) -> bool:
        if len(self._fits) >= 4 * self.remembered:
            _forget_half(self._fits)
        known = self._fits[key] = self.words.fit(key >> 32, key & 0xFFFFFFFF)
        return known

    def piece(self, data: bytes) -> list[int]:
        """Ids of one piece. A piece that is a token has it as the last token of its whole length, whatever comes before."""
        if data in self.words.whole:
            return [self.words.whole[data]]
        n, known, start = len(data), self._fits.get, -2
        last, length = [-1] * n + [start], [0] * n  # the entry behind the last one is that of the empty prefix
        for end, (token, size) in self.words.automaton.iter(data.decode("latin-1")):
            if last[end] == -1:
                before = last[end - size]
                if before >= 0:
                    key = before << 32 | token
                    fits = known(key)
                    if fits is None:
                        fits = self.fit(key)
                elif before == start:
                    fits = True
                else:
                    continue
                if fits:
                    last[end], length[end] = token, size
        ids, at = [], n - 1
        while at >= 0:
            ids.append(last[at])
            at -= length[at]
        return ids[::-1]

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text as unsigned 32-bit integers; special tokens written in the text are recognised."""
        if self.cut is None or not any(s in text for s in self.words.special):
            return np.frombuffer(self._plain(text), dtype="<u4")
        special = {t: np.array([i], dtype="<u4").tobytes() for t, i in self.words.special.items()}
        return np.frombuffer(b"".join(special.get(x) or self._plain(x) for x in self.cut(text)), dtype="<u4")

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that are no UTF-8 become replacement characters."""
        return self.spell(ids).decode("utf-8", "replace")

    def spell(self, ids: np.ndarray) -> bytes:
        """The bytes of ids, put together from one array of the bytes of all tokens."""
        size = self.size[ids]
        ends = np.cumsum(size)
        if not len(ends):
            return b""
        return self.letters[np.repeat(self.start[ids] - (ends - size), size) + np.arange(ends[-1])].tobytes()

    def spelled_sha256(self, ids: np.ndarray) -> str:
        """The SHA-256 of the decoded text in UTF-8."""
        data = self.spell(ids)
        try:
            data.decode()
        except UnicodeDecodeError:
            data = data.decode("utf-8", "replace").encode()
        return hashlib.sha256(data).hexdigest()


def codec(path: str) -> Codec:
    """One codec in each worker process: later tasks find its vocabulary and the words it has met."""
    return arrow.own((Codec, path), lambda: Codec(path))


def _strings(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids (array of int) of every text."""

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        own = codec(path)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = [own.encode(t).astype(np.int32) for t in _strings(batch.column("text"))]
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

        return work

    return arrow.per_slice(arrow.texts(docs), "doc_id long, ids array<int>", make, "text")


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """doc_id and text of every row of ids; null ids give the empty text."""

    def run(batches):
        own = codec(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                made = [own.decode(np.asarray(x or [], dtype=np.uint32)) for x in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(made, pa.string())], ["doc_id", "text"])

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """Per text the number of tokens and the SHA-256 of its ids and of the text decoded from them.

    Encodes and decodes in one pass; the ids themselves leave the task only where they are asked for.
    """

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        own = codec(path)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            n, of_ids, of_text, kept = [], [], [], []
            for text in _strings(batch.column("text")):
                ids = own.encode(text)
                n.append(len(ids))
                of_ids.append(hashlib.sha256(ids.tobytes()).hexdigest())
                of_text.append(own.spelled_sha256(ids))
                if with_ids:
                    kept.append(ids.astype(np.int32))
            columns = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns.append(pa.array(kept, pa.list_(pa.int32())))
                names.append("ids")
            return pa.RecordBatch.from_arrays(columns, names)

        return work

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return arrow.per_slice(arrow.texts(docs), schema, make, "text")
