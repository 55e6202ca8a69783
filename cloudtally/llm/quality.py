"""Quality rules on repetition: how much of a text lies inside n-grams and lines that it repeats.

Words are numbered by first appearance, so equal words have equal numbers and nothing can collide.
Rolling hashes of the numbers give every n-gram of one length a 64-bit value in a few array steps;
equal values mark repeated n-grams. Characters are measured inside their second and later
occurrences, each word's once however many n-grams cover it, and over all occurrences of the commonest
n-gram. Each length has its own limit on the share of characters. A text may repeat its heading as its footer, or have
either again elsewhere: the first and the last line with a word are left out of what is measured if they
are short (at most ``FRAME_WORDS`` words) and something stands between them.

Null texts have no words. A text of fewer than 50 words fails the base rule and is not kept. Every
row is judged on its own, so repeated rows give repeated results, and no text is too long.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cloudtally.llm import arrow

#: Published limits on the share of characters in repeated n-grams, by words per n-gram,
#: on the share in the commonest n-gram, and on repeated lines (by number and by characters).
COVERED = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
COMMONEST = {2: 0.20, 3: 0.18, 4: 0.16}
LINES, LINE_CHARS = 0.30, 0.20
SYMBOLS = b"#*$%&|<>"
SPACE = b" \t\n\r\x0b\x0c"
LEAST_WORDS = 50
FRAME_WORDS = 12  # words of a line that may be a heading or a footer
_DROP_REST = bytes(b for b in range(256) if b not in SYMBOLS)
_CONTINUED = bytes(range(0x80, 0xC0))
ODD = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xBF58476D1CE4E5B9)


def _spread(x: np.ndarray) -> np.ndarray:
    """Scatter small numbers over 64 bits; one-to-one."""
    with np.errstate(over="ignore"):
        x = (x + np.uint64(1)) * ODD
        x = (x ^ (x >> np.uint64(30))) * MIX
        return x ^ (x >> np.uint64(31))


def ngrams(codes: np.ndarray, n: int, shorter: np.ndarray, k: int) -> np.ndarray:
    """Rolling hash of every ``n`` consecutive codes, from those of ``k = n - 1``."""
    with np.errstate(over="ignore"):
        return shorter[: len(codes) - n + 1] * ODD + codes[k:]


def repeated(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in order of their values, and whether each has the value of the one before.

    Equal values keep their order, so those marked are second or later occurrences."""
    order = np.argsort(values, kind="stable")
    ordered = values[order]
    return order, np.concatenate([[False], ordered[1:] == ordered[:-1]])


def covered(at: np.ndarray, n: int, size: int) -> np.ndarray:
    """The words inside windows of ``n`` that begin at ``at``."""
    edge = np.zeros(size + 1, dtype=np.int32)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + n, -1)
    return np.cumsum(edge[:-1]) > 0


def points(data: bytes) -> int:
    """Code points of UTF-8 bytes."""
    return len(data) if data.isascii() else len(data.translate(None, _CONTINUED))


def windows_by_size(codes: np.ndarray, largest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Words per n-gram, the hashes of all n-grams that may repeat, and where these begin; ends where none can repeat."""
    spread = _spread(codes)
    windows, spots = spread, np.arange(len(codes))
    for size in range(2, min(largest, len(codes)) + 1):
        windows = ngrams(spread, size, windows, size - 1)
        # an n-gram can only repeat where both n-grams of one word less that are in it do
        spots = np.arange(len(windows)) if size == 2 else spots[np.isin(spots + 1, spots)]
        if not len(spots):
            return
        values = windows[spots]
        yield size, values, spots
        order, again = repeated(values)
        twice = again.copy()
        twice[:-1] |= again[1:]
        spots = np.sort(spots[order[twice]])


def repeat_words(codes: np.ndarray) -> int:
    """Words inside 3-grams that are found twice or more."""
    for size, values, spots in windows_by_size(codes, 3):
        if size == 3:
            order, again = repeated(values)
            again[:-1] |= again[1:]
            return int(covered(spots[order[again]], 3, len(codes)).sum())
    return 0


def worst_share(codes: np.ndarray, chars: np.ndarray) -> float:
    """The largest share of characters in repeated n-grams, as a multiple of its limit."""
    total, worst = int(chars.sum()), 0.0
    sums = np.concatenate([[0], np.cumsum(chars)])
    for size, values, spots in windows_by_size(codes, max(COVERED)):
        order, again = repeated(values)
        if not again.any():
            break
        if size in COMMONEST:
            edges = np.flatnonzero(np.append(~again, True))
            times, at = np.diff(edges), spots[order[edges[:-1]]]
            held = times * (sums[at + size] - sums[at])
            # of equally common ones the longest
            worst = max(worst, int(held[times == times.max()].max()) / total / COMMONEST[size])
        if size in COVERED:
            worst = max(worst, int(chars[covered(spots[order[again]], size, len(codes))].sum()) / total / COVERED[size])
    return worst


def repeated_lines(lines: list[bytes]) -> tuple[int, int]:
    """Lines equal to an earlier one, and their characters without white space."""
    seen: set[bytes] = set()
    n = chars = 0
    for line in lines:
        if line in seen:
            n += 1
            chars += points(b"".join(line.split()))
        else:
            seen.add(line)
    return n, chars


def measure(data: bytes) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept and the worst share."""
    words = data.split()
    n = len(words)
    n_symbols = len(data.translate(None, _DROP_REST))
    lines = [line for line in data.split(b"\n") if line.strip(SPACE)]
    again, _ = repeated_lines(lines)
    if not n:
        return 0, 0, n_symbols, again, 0, True, False, 0.0
    number: dict[bytes, int] = {}
    codes = np.array([number.setdefault(w, len(number)) for w in words], dtype=np.uint64)
    lengths = np.fromiter(map(len if data.isascii() else points, number), dtype=np.int64, count=len(number))
    chars = lengths[codes.astype(np.intp)]
    n_repeat = repeat_words(codes)

    start, stop = 0, n
    if len(lines) > 2:
        first, last = len(lines[0].split()), len(lines[-1].split())
        if first <= FRAME_WORDS:
            start, lines = first, lines[1:]
        if last <= FRAME_WORDS:
            stop, lines = n - last, lines[:-1]
    body = chars[start:stop]
    worst = worst_share(codes[start:stop], body)
    n_lines, line_chars = repeated_lines(lines)
    worst = max(worst, n_lines / len(lines) / LINES, line_chars / int(body.sum()) / LINE_CHARS)
    failed = n < LEAST_WORDS or 100 * n_repeat > 50 * n
    return n, int(chars.sum()), n_symbols, again, n_repeat, failed, not failed and worst <= 1.0, float(worst)


FIELDS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "worst_share"]
TYPES = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()]


def rules(docs: DataFrame) -> DataFrame:
    """One row per document: the base figures, the base verdict, and ``kept``.

    ``worst_share`` is the largest measured share as a multiple of its limit; a document with
    more than 1 is not kept.
    """

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = list(zip(*map(measure, arrow.raw(batch.column("text"))), strict=True)) or [[]] * len(FIELDS)
            return pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(r, t) for r, t in zip(rows, TYPES, strict=True))], ["doc_id", *FIELDS]
            )

        return work

    schema = (
        "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
        "base_failed boolean, kept boolean, worst_share double"
    )
    return arrow.per_slice(arrow.texts(docs), schema, make, "text")
