import random
import zlib

import numpy as np

from siltworks.llm import quality


def brute_pooled(net, text):
    """Every chunk by direct convolution."""
    x = np.frombuffer(text + bytes(quality.WIDTH), np.uint8)
    at = np.array([sum(net.table[k][x[i + k]] for k in range(quality.WIDTH)) for i in range(len(text))])
    halves = -(-len(text) // quality.HALF)
    best = np.array([at[h * quality.HALF : (h + 1) * quality.HALF].max(axis=0) for h in range(halves)])
    both = best if halves == 1 else np.array([np.maximum(best[i], best[i + 1]) for i in range(halves - 1)])
    return np.maximum(both + net.bias, 0)


def made(rng, n):
    rows = []
    for i in range(n):
        words = [rng.choice(["the", "and", "thing", "over", "lane", "stone", "river"]) for _ in range(rng.randint(3, 120))]
        bad = rng.random() < 0.3
        rows.append((i, " ".join(w + "$$" if bad else w for w in words), int(not bad)))
    return rows


def test_pooling_covers_the_whole_text():
    rng = np.random.default_rng(3)
    net = quality.Network(rng.normal(size=(quality.WIDTH, 256, quality.FILTERS)).astype(np.float32), np.zeros(quality.FILTERS, np.float32), rng.normal(size=2 * quality.FILTERS), 0.1)
    for n in (1, 5, 127, 128, 129, 256, 400, 5000):
        text = bytes(rng.integers(1, 256, n, dtype=np.uint8))
        assert np.allclose(net.pooled(text), brute_pooled(net, text), atol=1e-4)


def test_learns_and_generalises(spark):
    rng = random.Random(4)
    rows = made(rng, 300)
    docs = spark.createDataFrame([(i, t, "score") for i, t, _ in rows], "doc_id long, text string, score string").repartition(3)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int")
    net = quality.fit(docs, labels)
    got = {r.doc_id: r for r in quality.score(docs, net).collect()}
    for i, t, _ in rows:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert got[i].score == net.score(t.encode()) and got[i].predicted == (got[i].score >= 0.3)
    held = [(got[i].predicted, y) for i, _, y in rows if got[i].held_out]
    assert sum(a == b for a, b in held) / len(held) > 0.95
    kept = quality.keep_good(docs, net)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i in got if got[i].predicted}


def test_labels_of_held_out_rows_teach_nothing(spark):
    rows = made(random.Random(5), 80)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    one = [(i, y) for i, _, y in rows]
    other = [(i, 1 - y if quality.fold_of(i) == 0 else y) for i, y in one]
    nets = [quality.fit(docs, spark.createDataFrame(x, "doc_id long, quality int")) for x in (one, other)]
    assert np.array_equal(nets[0].table, nets[1].table)


def test_edge_cases(spark):
    docs = spark.createDataFrame([(1, None), (1, ""), (None, "x"), (3, "y" * 100_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(None, 1), (1, None), (99, 1)], "doc_id long, quality int")
    net = quality.fit(docs, labels)
    got = quality.score(docs, net).collect()
    assert len(got) == 4 and all(r.score == 0.5 and r.predicted == 1 for r in got)
    assert [r.held_out for r in got if r.doc_id is None] == [False]
    assert quality.score(docs.limit(0), net).collect() == []


def test_a_cue_anywhere_in_a_long_text_teaches(spark, monkeypatch):
    monkeypatch.setattr(quality, "STEPS", 120)
    rng = random.Random(6)
    rows = []
    for i in range(60):
        text = "".join(rng.choice("abcdefgh ") for _ in range(13_000))
        at = 128 * (100 * 5 // 23 + 3) + rng.randrange(20)  # bytes that 24 evenly spaced chunks leave out
        rows.append((i, text[:at] + "#" * 9 + text[at + 9 :] if i % 2 else text, int(i % 2 == 0)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    net = quality.fit(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int"))
    held = [(net.score(t.encode()) >= 0.5) == y for i, t, y in rows if quality.fold_of(i) == 0]
    assert len(held) > 5 and sum(held) / len(held) > 0.9


def test_training_pools_as_scoring_does():
    rng = np.random.default_rng(8)
    net = quality.Network(rng.normal(size=(quality.WIDTH, 256, quality.FILTERS)).astype(np.float32), np.zeros(quality.FILTERS, np.float32), rng.normal(size=2 * quality.FILTERS), 0.1)
    for n in (1, 128, 129, 300, 60_000):
        text = bytes(rng.integers(1, 256, n, dtype=np.uint8))
        x = quality.padded(text)
        best, at = quality.peaks(net.table, x, n)
        assert np.array_equal(np.maximum(best + net.bias, 0), net.pooled(text)) and at.max() < n
        direct = sum(net.table[k][x[at + k], np.arange(quality.FILTERS)] for k in range(quality.WIDTH))
        assert np.allclose(direct, best, atol=1e-4)
