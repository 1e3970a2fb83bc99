"""Toxicity by the nearest labelled examples: exact TF-IDF cosine on a block-max inverted index, weighted votes, calibrated scores.

Terms are words (runs of letters and digits, lower-cased) and their first
``STEMS`` characters, so that inflected and compound forms share terms. Of the
terms of the labelled examples those count whose presence tells the labels apart:
a G-test of ``GAIN`` or more and odds ``ODDS`` times as high, either way. A
term's weight is (1 + ln tf) * (1 + ln((1 + N) / (1 + df))), df and N being
counted over all documents; vectors have length 1.

The index keeps, per term, its examples in blocks of ``BLOCK`` and the largest
weight in each. A text's terms give every block an upper bound; blocks are read
from the highest bound down and scored exactly, until no bound reaches the
``NEAREST``-th best cosine. Ties go to the smaller place in the index.

A vote is the sum of the neighbours' cosines, those of clean examples counted
negative, by ``NEAREST``. A logistic curve, fitted on the examples' own votes (each
without itself), turns votes into probabilities. The neighbours are the evidence.

Training: at most ``MAX_ROWS`` labelled rows, those of the smallest hash of their id, with
whole texts; only their counts over the chosen terms reach the driver.

Defined cases: null text is empty text; a text without any known term has no
neighbour, so a vote of 0; labels that are null, or whose id is null or has no
document, teach nothing; of several labels of one id the smallest counts; without
labels every score is 0.5; null ids are scored and not held out; repeated rows
are scored each and count once as examples; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, text_of
from .licenses import LETTERS
from .quality import held_out

MAX_ROWS = 4096
STEMS = (3, 4, 5, 6)
GAIN, ODDS = 10.83, 4.0
BLOCK, NEAREST, THRESHOLD = 64, 15, 0.5
#: Words whose terms a task remembers.
REMEMBERED = 1 << 17


def words_of(text: str) -> Counter:
    return Counter(text.lower().encode("utf-8", "replace").translate(LETTERS).split())


def terms_of(word: bytes) -> list[str]:
    """A word and its stems, the word marked by an end."""
    text = word.decode()
    return [text + "$", *[text[:n] for n in STEMS if len(text) >= n]]


class Vocabulary:
    """Terms by number; the terms of words that came before are remembered."""

    def __init__(self, terms: list[str]) -> None:
        self.of = {t: i for i, t in enumerate(terms)}
        self.known: dict[bytes, tuple[int, ...]] = {}

    def counts(self, text: str) -> dict[int, int]:
        out: dict[int, int] = {}
        known = self.known
        for word, n in words_of(text).items():
            found = known.get(word)
            if found is None:
                if len(known) >= REMEMBERED:
                    known.clear()
                found = known[word] = tuple(self.of[t] for t in terms_of(word) if t in self.of)
            for t in found:
                out[t] = out.get(t, 0) + n
        return out


@dataclass
class Index:
    """Unit vectors of examples: postings by term and block, each block's largest weight, and what a vote needs."""

    terms: list[str]
    idf: np.ndarray
    ids: list  # of the examples, in order of the index
    labels: np.ndarray
    postings: list[tuple[np.ndarray, np.ndarray]]  # places, weights
    peaks: list[tuple[np.ndarray, np.ndarray, np.ndarray]]  # blocks, largest weights, where a block's postings start
    slope: float = 0.0
    offset: float = 0.0

    def vector(self, counts: Mapping[int, int]) -> tuple[np.ndarray, np.ndarray]:
        at = np.array(sorted(counts), np.int64)
        w = (1 + np.log([counts[t] for t in at])) * self.idf[at] if len(at) else np.zeros(0)
        return at, w / np.sqrt((w * w).sum()) if len(at) else w

    def nearest(self, counts: Mapping[int, int], k: int = NEAREST, but: int = -1) -> list[tuple[float, int]]:
        """The k examples of the highest positive cosine, best first; ``but`` is left out."""
        terms, weights = self.vector(counts)
        bounds = np.zeros(-(-len(self.ids) // BLOCK) or 1)
        for t, w in zip(terms, weights):
            blocks, most, _ = self.peaks[t]
            bounds[blocks] += w * most
        order = np.lexsort((np.arange(len(bounds)), -bounds))
        best: list[tuple[float, int]] = []  # (cosine, -place), the worst first
        for b in order.tolist():
            # a bound is a sum rounded in another order than the cosines
            if bounds[b] <= 0 or len(best) == k and bounds[b] * (1 + 1e-9) < best[0][0]:
                break
            cosines = np.zeros(BLOCK)
            for t, w in zip(terms, weights):
                blocks, _, starts = self.peaks[t]
                j = np.searchsorted(blocks, b)
                if j < len(blocks) and blocks[j] == b:
                    places, values = self.postings[t]
                    some = slice(starts[j], starts[j + 1])
                    cosines[places[some] - b * BLOCK] += w * values[some]
            for i in np.flatnonzero(cosines > 0).tolist():
                place = b * BLOCK + i
                if place != but:
                    item = (float(cosines[i]), -place)
                    if len(best) < k:
                        heapq.heappush(best, item)
                    elif item > best[0]:
                        heapq.heapreplace(best, item)
        return [(c, -p) for c, p in sorted(best, reverse=True)]

    def vote(self, near: list[tuple[float, int]]) -> float:
        return sum(c if self.labels[p] else -c for c, p in near) / NEAREST

    def score(self, vote: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * vote + self.offset, -30, 30))))


def indexed(terms: list[str], idf: np.ndarray, examples: list[tuple[object, int, dict[int, int]]]) -> Index:
    """The index of (id, label, counts by term), examples of like leading terms side by side, calibrated on themselves."""
    index = Index(terms, idf, [], np.zeros(0, bool), [], [])
    vectors = [(index.vector(c), i) for i, (_, _, c) in enumerate(examples)]
    vectors.sort(key=lambda v: ([int(t) for t in v[0][0][np.argsort(-v[0][1], kind="stable")][:2]], v[1]))
    index.ids = [examples[i][0] for _, i in vectors]
    index.labels = np.array([examples[i][1] == 1 for _, i in vectors], bool)
    place = np.repeat(np.arange(len(vectors)), [len(v[0]) for v, _ in vectors])
    term = np.concatenate([v[0] for v, _ in vectors]) if vectors else np.zeros(0, np.int64)
    weight = np.concatenate([v[1] for v, _ in vectors]) if vectors else np.zeros(0)
    order = np.lexsort((place, term))
    cuts = np.searchsorted(term[order], np.arange(len(terms) + 1))
    for t in range(len(terms)):
        some = order[cuts[t] : cuts[t + 1]]
        blocks, starts = np.unique(place[some] // BLOCK, return_index=True)
        index.postings.append((place[some], weight[some]))
        index.peaks.append((blocks, np.maximum.reduceat(weight[some], starts) if len(some) else weight[some], np.append(starts, len(some))))
    votes = np.array([index.vote(index.nearest(examples[i][2], but=p)) for p, (_, i) in enumerate(vectors)])
    index.slope, index.offset = calibrated(votes, index.labels)
    return index


def calibrated(votes: np.ndarray, labels: np.ndarray, rounds: int = 100) -> tuple[float, float]:
    """Slope and offset of the logistic curve through the votes, by Newton's method, targets drawn in by one row a side."""
    ones = int(labels.sum())
    zeros = len(labels) - ones
    if not len(labels):
        return 0.0, 0.0
    target = np.where(labels, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    x, z = np.stack([votes, np.ones(len(votes))], 1), np.zeros(2)
    ridge = np.diag([1e-3, 1e-6])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ z, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge, x.T @ (target - p) - ridge @ z)
        z = z + step * min(1.0, 10 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-9:
            break
    return float(z[0]), float(z[1])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = MAX_ROWS) -> Index:
    """Learn from the labelled rows that are not held out, ``max_rows`` of them at most."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id IS NOT NULL AND y IS NOT NULL").where(~held_out(F.col("id")))
    taught = known.groupBy("id").agg((F.min("y") == 1).cast("int").alias("y")).orderBy(F.xxhash64("id"), "id").limit(max_rows)
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    # max_rows labels are broadcast at most
    examples = materialize(rows.join(F.broadcast(taught), "id").select("id", "text", "y").distinct())
    kind = examples.schema["id"].dataType.simpleString()

    def list_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for y, text in zip(batch.column(2).to_pylist(), batch.column(1)):
                found = sorted({t for w in words_of(text.as_py()) for t in terms_of(w)})
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.repeat(pa.scalar(y, pa.int32()), len(found))], ["term", "y"])

    sides = {r.y: r.n for r in examples.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    ones, zeros = sides.get(1, 0), sides.get(0, 0)
    per = examples.mapInArrow(list_terms, "term string, y int").groupBy("term").agg(F.sum("y").cast("double").alias("a"), F.sum(1 - F.col("y")).cast("double").alias("b"))
    terms = sorted(r.term for r in per.where(telling(F.col("a"), F.col("b"), ones, zeros)).select("term").collect()) if ones and zeros else []

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, df, n = Vocabulary(terms), Counter(), 0
        for batch in batches:
            n += batch.num_rows
            for text in batch.column(1):
                df.update(vocabulary.counts(text.as_py()).keys())
        yield pa.RecordBatch.from_arrays([pa.array([-1, *df], pa.int32()), pa.array([n, *df.values()], pa.int64())], ["term", "n"])

    seen = {r.term: r.n for r in rows.mapInArrow(count, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    df = np.array([seen.get(t, 0) for t in range(len(terms))], np.float64)
    idf = 1 + np.log((1 + seen.get(-1, 0)) / (1 + df))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(terms)
        for batch in batches:
            found = [vocabulary.counts(text.as_py()) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([list(c) for c in found], pa.list_(pa.int32())), pa.array([list(c.values()) for c in found], pa.list_(pa.int64()))], ["id", "y", "terms", "n"])

    taken = examples.mapInArrow(vectors, f"id {kind}, y int, terms array<int>, n array<long>").orderBy(F.xxhash64("id"), "id", "terms", "n").collect()
    return indexed(terms, idf, [(r.id, r.y, dict(zip(r.terms, r.n))) for r in taken])


def telling(a: F.Column, b: F.Column, ones: int, zeros: int) -> F.Column:
    """Whether a term in ``a`` of the toxic and ``b`` of the clean examples tells them apart."""
    share = (a + b) / (ones + zeros)
    part = lambda n, of: F.when(n > 0, n * F.ln(n / of)).otherwise(0.0)
    gain = 2 * (part(a, ones * share) + part(b, zeros * share) + part(ones - a, ones * (1 - share)) + part(zeros - b, zeros * (1 - share)))
    odds = ((a + 0.5) * (zeros - b + 0.5)) / ((b + 0.5) * (ones - a + 0.5))
    return (gain >= GAIN) & ((odds >= ODDS) | (odds <= 1 / ODDS))


def score(docs: DataFrame, index: Index, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id, held_out, score, predicted, evidence) of every row; evidence: the nearest examples, best first, as (id, similarity, toxic)."""
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(index)
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = shared.value
        vocabulary = Vocabulary(mine.terms)
        for batch in batches:
            near = [mine.nearest(vocabulary.counts(text.as_py())) for text in batch.column(1)]
            scores = pa.array([mine.score(mine.vote(x)) for x in near], pa.float64())
            found = [p for x in near for _, p in x]
            item = pa.StructArray.from_arrays([pa.array([mine.ids[p] for p in found], batch.column(0).type), pa.array([c for x in near for c, _ in x], pa.float64()), pa.array([bool(mine.labels[p]) for p in found], pa.bool_())], ["id", "similarity", "toxic"])
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, near)]), pa.int32()), item)
            yield pa.RecordBatch.from_arrays([batch.column(0), scores, lists], ["id", "score", "evidence"])

    scored = rows.mapInArrow(run, f"id {kind}, score double, evidence array<struct<id:{kind},similarity:double,toxic:boolean>>")
    return scored.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "evidence")
