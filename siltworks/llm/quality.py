"""Document quality by a byte-level convolutional network in numpy.

A bank of ``FILTERS`` filters, each ``WIDTH`` bytes wide, slides over every byte
of a text. Chunks of 2 * ``HALF`` bytes overlap by half and cover the whole
text; each filter is max-pooled in every chunk, and the mean and the largest
of the pooled values over all chunks go through one logistic unit. As bytes are
one-hot, a filter is a table of WIDTH x 256 weights and needs only look-ups.

Training: at most ``MAX_ROWS`` labelled rows (those of the smallest hash of
their id), each with its whole text, pooled over the same chunks as in scoring.
The texts stream into a temporary file of the driver, which alone reads it; in
memory it holds one partition of them while they come and one step's text by
text later. Only the text is an input of a score.

Defined cases: null text is empty text; an empty text scores by the bias
alone; labels that are null, or whose id is null or has no document, teach
nothing; of several labels of one id the smallest counts; without any label
every score is 0.5; null ids are scored and not held out; repeated rows are
scored each; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import tempfile
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of

FILTERS, WIDTH, HALF = 24, 7, 128
MAX_ROWS = 4096
FOLDS, THRESHOLD = 5, 0.3
STEPS, DOCS_A_STEP, RATE, DECAY, SEED = 700, 16, 0.01, 1e-4, 7


def padded(text: bytes) -> np.ndarray:
    """The bytes of a text, zeros up to the end of its last half chunk and a filter's width after it."""
    x = np.zeros(-(-len(text) // HALF) * HALF + WIDTH, np.uint8)
    x[: len(text)] = np.frombuffer(text, np.uint8)
    return x


def halves_of(table: np.ndarray, x: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """The filters at every byte, a few half chunks at a time: (halves, HALF, FILTERS)."""
    halves = -(-n // HALF)
    step = 32
    for at in range(0, halves, step):
        to = min(halves, at + step)
        m = (to - at) * HALF
        acc = table[0][x[at * HALF : at * HALF + m]]
        for k in range(1, WIDTH):
            acc += table[k][x[at * HALF + k : at * HALF + k + m]]
        if to == halves and n < halves * HALF:
            acc[n - at * HALF :] = -np.inf  # positions after the end of the text
        yield acc.reshape(to - at, HALF, -1)


class Network:
    def __init__(self, table: np.ndarray, bias: np.ndarray, head: np.ndarray, offset: float) -> None:
        self.table, self.bias, self.head, self.offset = table, bias, head, float(offset)

    def pooled(self, text: bytes) -> np.ndarray:
        """The filters' largest value in every chunk: (chunks, FILTERS)."""
        best = np.concatenate([acc.max(axis=1) for acc in halves_of(self.table, padded(text), len(text))])
        if len(best) > 1:
            best = np.maximum(best[:-1], best[1:])
        return np.maximum(best + self.bias, 0)

    def score(self, text: bytes) -> float:
        if not text:
            z = self.offset
        else:
            p = self.pooled(text).astype(np.float64)
            z = float(np.concatenate([p.mean(axis=0), p.max(axis=0)]) @ self.head) + self.offset
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def peaks(table: np.ndarray, x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of every chunk and filter the largest value and the position in the text that has it: (chunks, FILTERS) each."""
    values, places = [], []
    for acc in halves_of(table, x, n):
        at = acc.argmax(axis=1)
        values.append(np.take_along_axis(acc, at[:, None, :], axis=1)[:, 0])
        places.append(at)
    best, at = np.concatenate(values), np.concatenate(places)
    at += np.arange(len(at))[:, None] * HALF
    if len(best) > 1:
        later = best[1:] > best[:-1]
        best, at = np.where(later, best[1:], best[:-1]), np.where(later, at[1:], at[:-1])
    return best, at


def train(texts: Sequence[bytes], labels: Sequence[int], seed: int = SEED, steps: int | None = None) -> Network:
    """Adam on the logistic loss over whole texts; gradients reach a filter through its pooled maxima only."""
    steps = steps or STEPS
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 0.15, (WIDTH, 256, FILTERS)).astype(np.float32)
    bias, head, offset = np.zeros(FILTERS, np.float32), rng.normal(0, 0.1, 2 * FILTERS).astype(np.float32), np.zeros(1, np.float32)
    labels = np.array(labels, np.float32)
    if not len(labels):
        return Network(table, bias, np.zeros_like(head), 0.0)
    sides = [np.flatnonzero(labels == y) for y in (0, 1)]
    params = [table, bias, head, offset]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    cell = np.arange(FILTERS)
    for step in range(1, steps + 1):
        # half of each step's rows from either label, weighted back to the true shares
        picks = np.concatenate([rng.choice(s, DOCS_A_STEP // 2) for s in sides if len(s)])
        share = np.array([len(sides[int(y)]) / len(labels) for y in labels[picks]], np.float32)
        weight = share / share.sum()
        grads = [DECAY * table, np.zeros_like(bias), DECAY * head, np.zeros_like(offset)]
        for i, w in zip(picks, weight):
            text = texts[i]
            if not text:  # scored by the bias alone
                grads[3] += w * (1 / (1 + np.exp(-np.clip(offset, -30, 30))) - labels[i])
                continue
            x = padded(text)
            best, at = peaks(table, x, len(text))
            pool = np.maximum(best + bias, 0)
            most = pool.max(axis=0)
            both = np.concatenate([pool.mean(axis=0), most])
            dz = w * (1 / (1 + np.exp(-np.clip(both @ head + offset, -30, 30))) - labels[i])
            dpool = (dz * head[:FILTERS] / len(pool) + np.where(pool == most, dz * head[FILTERS:], 0)) * (pool > 0)
            for k in range(WIDTH):
                cells = x[at + k].astype(np.int64) * FILTERS + cell
                grads[0][k] += np.bincount(cells.ravel(), dpool.ravel(), 256 * FILTERS).reshape(256, FILTERS).astype(np.float32)
            grads[1] += dpool.sum(axis=0)
            grads[2] += dz * both
            grads[3] += dz
        rate = RATE * (1 - 0.9 * step / steps)
        for i, g in enumerate(grads):
            m[i] += 0.1 * (g - m[i])
            v[i] += 0.01 * (g * g - v[i])
            params[i] -= (rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return Network(table, bias, head, offset[0])


class Stored(Sequence):
    """Texts in a file, read one at a time."""

    def __init__(self, file, places: list[tuple[int, int]]) -> None:
        self.file, self.places = file, places

    def __len__(self) -> int:
        return len(self.places)

    def __getitem__(self, i: int) -> bytes:
        at, size = self.places[i]
        self.file.seek(at)
        return self.file.read(size)


def held_out(id_col: Column, folds: int = FOLDS) -> Column:
    """Whether an id's fold is kept from training."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % folds == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = MAX_ROWS) -> Network:
    """Learn from the labelled rows that are not held out, ``max_rows`` of them at most."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id IS NOT NULL AND y IS NOT NULL").where(~held_out(F.col("id")))
    taught = known.groupBy("id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(max_rows)

    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    # max_rows labels are broadcast at most
    joined = rows.join(F.broadcast(taught), "id").select("id", "text", "y").distinct()
    with tempfile.TemporaryFile() as file:
        known_by: dict[tuple, tuple[int, int]] = {}
        for r in joined.toLocalIterator():
            text = r.text.encode("utf-8", "replace")
            known_by[r.id, r.y, hashlib.sha256(text).digest()] = (file.tell(), len(text))
            file.write(text)
        order = sorted(known_by)
        return train(Stored(file, [known_by[key] for key in order]), [int(y == 1) for _, y, _ in order])


def score(docs: DataFrame, network: Network, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id, held_out, score, predicted) of every row."""
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast((network.table, network.bias, network.head, network.offset))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = Network(*shared.value)
        for batch in batches:
            found = np.array([mine.score(x.as_py().encode("utf-8", "replace")) for x in batch.column(1)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], ["id", "score"])

    scored = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, score double")
    return scored.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, network: Network, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows that the network does not reject, with their columns."""
    shared = docs.sparkSession.sparkContext.broadcast((network.table, network.bias, network.head, network.offset))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = Network(*shared.value)
        for batch in batches:
            keep = [mine.score((x.as_py() or "").encode("utf-8", "replace")) >= threshold for x in batch.column(at)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def fold_of(doc_id: int, folds: int = FOLDS) -> int:
    return zlib.crc32(str(doc_id).encode()) % folds
