"""Toxicity classifier that is trained not to care which group a text mentions.

Features are the words of a text and the beginnings of its words, each once however often it occurs, so
neither length nor repetition shifts a score. A logistic model weighs those that mark the toxic class.
For every training text with an identity term copies are made in which its terms are swapped for
each other one of their groups; besides the usual loss, training penalises the squared difference between the
scores of a text and of its copies. Groups hold the terms of one language, so that copies stay in it. A term that is frequent in toxic texts then gets no weight of its own
and a neutral mention is no ground for a high score.

The model is fitted on at most ``max_rows`` labelled doc_ids, those with the smallest hashes (of rows that share a
doc_id one text is taken), never on held-out ones (crc32 of the doc_id as text divisible by 5). Everything else covers all
rows. Only the text enters a score: null and empty texts get the score of a text without features.
Contradicting labels of one doc_id count as toxic, null labels are ignored; rows that repeat are
scored alike. Without any labelled row every score is 0.5 at most and nothing is toxic.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloudtally.llm import arrow

MAX_ROWS = 20_000
MAX_FEATURES = 3_000
LEAST_DOCS = 4
PREFIXES = (4, 5, 6)
PART_BYTES = 1 << 20  # of texts that are Python strings at the same time while fitting
FOLDS = 5
PENALTY, RIDGE, STEPS = 5.0, 0.02, 1_500

#: Terms of groups that may be swapped for one another.
IDENTITY = {
    "religion": ["muslim", "christian", "jewish", "hindu", "buddhist", "atheist"],
    "people": ["women", "men", "girls", "boys"],
    "orientation": ["gay", "straight", "lesbian", "bisexual"],
    "origin": ["african", "american", "asian", "european", "arab", "mexican"],
    "age": ["old", "young", "elderly"],
    "ability": ["deaf", "blind", "disabled"],
    "religion_de": ["muslim", "muslime", "christ", "christen", "jude", "juden", "hindus", "buddhisten", "atheisten"],
    "people_de": ["frauen", "männer", "mädchen", "jungen"],
    "orientation_de": ["schwul", "schwule", "lesbisch", "lesben", "bisexuell", "heterosexuell"],
    "origin_de": ["afrikaner", "amerikaner", "asiaten", "europäer", "araber", "türken"],
    "age_de": ["alte", "junge", "ältere"],
    "ability_de": ["gehörlose", "blinde", "behinderte"],
    "religion_fr": ["musulman", "musulmans", "chrétien", "chrétiens", "juif", "juifs", "hindous", "bouddhistes", "athées"],
    "people_fr": ["femmes", "hommes", "filles", "garçons"],
    "orientation_fr": ["homosexuel", "homosexuels", "lesbienne", "lesbiennes", "bisexuel", "hétérosexuel"],
    "origin_fr": ["africains", "américains", "asiatiques", "européens", "arabes", "mexicains"],
    "age_fr": ["vieux", "jeunes", "âgés"],
    "ability_fr": ["sourds", "aveugles", "handicapés"],
    "religion_es": ["musulmán", "musulmanes", "cristiano", "cristianos", "judío", "judíos", "hindúes", "budistas", "ateos"],
    "people_es": ["mujeres", "hombres", "niñas", "niños"],
    "orientation_es": ["homosexual", "homosexuales", "lesbiana", "lesbianas", "bisexual", "heterosexual"],
    "origin_es": ["africanos", "americanos", "asiáticos", "europeos", "árabes", "mexicanos"],
    "age_es": ["viejos", "jóvenes", "ancianos"],
    "ability_es": ["sordos", "ciegos", "discapacitados"],
}
_WORD = re.compile(r"\w+").findall


def features(text: str) -> set[str]:
    """Lower-cased words and, marked by a star, their beginnings."""
    words = set(_WORD(text.lower()))
    return words | {w[:n] + "*" for n in PREFIXES for w in words if len(w) > n}


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0


def sample(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """doc_id, text and toxic of the rows of at most ``max_rows`` labelled doc_ids outside the held-out fold."""
    told = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).dropna()
    ids = told.filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)  # so few narrow rows can go to all tasks
    return arrow.texts(docs).join(F.broadcast(ids), "doc_id").select("doc_id", "text", "toxic")


class Model:
    """Weights by feature, and the intercept."""

    def __init__(self, weights: dict[str, float], intercept: float) -> None:
        self.weights, self.intercept = weights, intercept

    def score(self, text: str) -> float:
        words = set(_WORD(text.lower()))
        get, total = self.weights.get, self.intercept
        for w in words:
            total += get(w, 0.0)
        for begin in {w[:n] + "*" for n in PREFIXES for w in words if len(w) > n}:
            total += get(begin, 0.0)
        return float(1 / (1 + np.exp(-total)))


def choose(rows: DataFrame, identity: dict[str, list[str]], max_features: int = MAX_FEATURES) -> list[str]:
    """Features whose share of the toxic rows stands out most, and the identity terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow.free()
        for batch in batches:
            for part in arrow.slices(batch, "text", PART_BYTES):
                found, toxic = [], []
                for text, y in zip(part.column("text").to_pylist(), part.column("toxic").to_pylist(), strict=True):
                    own = features(text or "")
                    found.extend(own)
                    toxic.extend([y] * len(own))
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(toxic, pa.int32())], ["feature", "toxic"])

    n = rows.agg(F.sum("toxic"), F.sum(1 - F.col("toxic"))).first()
    bad, good = n[0] or 0, n[1] or 0
    if not bad or not good:
        return []
    counts = rows.select("text", "toxic").mapInArrow(run, "feature string, toxic int").groupBy("feature")
    counts = counts.agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good"))
    p, q = (F.col("bad") + 0.5) / (bad + 1), (F.col("good") + 0.5) / (good + 1)
    z = F.log(p / q) / F.sqrt(1 / (F.col("bad") + 0.5) + 1 / (F.col("good") + 0.5))
    best = counts.filter(F.col("bad") >= LEAST_DOCS).select("feature", z.alias("z")).filter("z > 3").orderBy(F.desc("z"), "feature")
    kept = [r.feature for r in best.limit(max_features).collect()]
    return list(dict.fromkeys([*kept, *(t for group in identity.values() for t in group)]))


def swapped(text: str, identity: dict[str, list[str]]) -> list[str]:
    """Copies of the text with its identity terms replaced by the others of their groups, one step further each time.

    A term that several groups hold is of the first one. There are as many copies as the largest group that is
    mentioned has other terms, and none without a mention.
    """
    place: dict[str, tuple[list[str], int]] = {}
    for group in identity.values():
        for k, term in enumerate(group):
            place.setdefault(term, (group, k))
    low = text.lower()
    named = [place[w] for w in set(_WORD(low)) if w in place]
    step = lambda s: lambda m: place[m[0]][0][(place[m[0]][1] + s) % len(place[m[0]][0])] if m[0] in place else m[0]
    return [re.sub(r"\w+", step(s), low) for s in range(1, max((len(g) for g, _ in named), default=1))]


def fit_rows(texts: list[str], toxic: list[int], chosen: list[str], identity: dict[str, list[str]], penalty: float = PENALTY) -> Model:
    """Fit the weights by gradient descent with a step size of its own for every weight."""
    number = {f: k for k, f in enumerate(chosen)}
    find = lambda text: [number[f] for f in features(text) if f in number]
    copies = [(i, c) for i, t in enumerate(texts) for c in swapped(t, identity)]
    lists = [find(t) for t in texts] + [find(c) for _, c in copies]
    row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    col = np.array([k for x in lists for k in x], dtype=np.int64)
    n, m, y = len(texts), len(lists), np.array(toxic, dtype=float)
    first = np.array([i for i, _ in copies], dtype=np.int64)
    other = np.arange(n, m)
    w, slow, fast = (np.zeros(len(chosen) + 1) for _ in range(3))  # the intercept comes last
    w[-1] = -2.0
    for step in range(STEPS):
        z = np.bincount(row, weights=w[col], minlength=m) + w[-1]
        s = 1 / (1 + np.exp(-z))
        pull = np.zeros(m)
        pull[:n] = (s[:n] - y) / n
        if len(copies):
            gap = 2 * penalty * (s[first] - s[other]) / len(copies)
            slope = s * (1 - s)
            np.add.at(pull, first, gap * slope[first])
            pull[other] -= gap * slope[other]
        down = np.bincount(col, weights=pull[row], minlength=len(w)) + RIDGE * w / max(n, 1)
        down[-1] = pull.sum()
        slow, fast = 0.9 * slow + 0.1 * down, 0.999 * fast + 0.001 * down**2
        size = 0.1 / (1 + step / 300)
        w = w - size * slow / (1 - 0.9 ** (step + 1)) / (np.sqrt(fast / (1 - 0.999 ** (step + 1))) + 1e-9)
    return Model({f: float(w[k]) for f, k in number.items() if w[k]}, float(w[-1]))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, identity: dict[str, list[str]] = IDENTITY, penalty: float = PENALTY) -> Model:
    """A model of the sampled rows. What comes to the driver are their chosen features, in bounded number."""
    rows = sample(docs, labels, max_rows)
    chosen = choose(rows, identity)
    if not chosen:
        return Model({}, -1e-9)
    got = reduced(rows, chosen).orderBy("doc_id").toPandas()
    return fit_rows(got["text"].tolist(), got["toxic"].tolist(), chosen, identity, penalty)


def reduced(rows: DataFrame, chosen: list[str]) -> DataFrame:
    """doc_id, toxic and the words that matter, one row for each doc_id whatever its number of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow.free()
        yield from matter(batches, set(chosen))

    return rows.mapInArrow(run, "doc_id long, text string, toxic int").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))


def matter(batches: Iterator[pa.RecordBatch], known: set[str]) -> Iterator[pa.RecordBatch]:
    """The batches in parts of ``PART_BYTES`` of text, each text cut to the words that matter, no longer than ``known``."""
    for batch in batches:
        for part in arrow.slices(batch, "text", PART_BYTES):
            kept = []
            for text in part.column("text").to_pylist():
                words = sorted(set(_WORD((text or "").lower())))
                kept.append(" ".join(w for w in words if w in known or any(w[:n] + "*" in known for n in PREFIXES if len(w) > n)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(kept, pa.string()), part.column("toxic")], ["doc_id", "text", "toxic"])


def score(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """doc_id and score of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            one = sent.value.score
            made = [one(t or "") for t in batch.column("text").to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(made, pa.float64())], ["doc_id", "score"])

        return work

    return arrow.per_slice(arrow.texts(docs), "doc_id long, score double", make, "text")


def accepted(docs: DataFrame, model: Model, limit: float = 0.5) -> DataFrame:
    """The rows whose score is below ``limit``, as they are."""
    sent, columns = docs.sparkSession.sparkContext.broadcast(model), docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow.free()
        for batch in batches:
            for part in arrow.slices(batch, "text", 2 << 20):
                yield part.filter(pa.array([sent.value.score(t or "") < limit for t in part.column("text").to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, columns)
