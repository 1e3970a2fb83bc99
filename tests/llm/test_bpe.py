import hashlib
import json
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from siltworks.llm import bpe
from siltworks.llm.chunks import ChunkCache, pieces

TEXTS = [
    "", "a", " \t\n", "Hello, world! it's 123 <|endoftext|>foo<|startoftext|> bar", "aaaa" * 50, "ΣΑΣ Σ", "é x\x1cy", "İstanbul",
    "don't we'LL 'S", "x" * 3000, "日本語テキスト。", "a b c\x85d", "ǅ ß ẞ ẛ̣", "12½Ⅷ²३", "!!!???...", "naïve café", "՘a Ƛ", "<|endoftext|", "👩‍👩‍👧 ok", "\x00\x01",
]


@pytest.fixture(scope="module")
def both():
    path = bpe.default_path()
    return bpe.Bpe(open(path, encoding="utf-8").read(), cache=500), Tokenizer.from_file(path)


def test_equals_the_library(both):
    ours, theirs = both
    rng = random.Random(1)
    alphabet = "abcdefgh tion ing\n'.,1é日ÀΣ́ "
    texts = TEXTS + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 300))) for _ in range(400)]
    for text in texts:
        want = theirs.encode(text, add_special_tokens=False).ids
        assert ours.encode_text(text) == want, text
        assert ours.decode(want) == theirs.decode(want, skip_special_tokens=False)


def test_single_and_lane_trees_agree(both):
    ours, _ = both
    rng = random.Random(2)
    words = [bytes(rng.choice(b"abcdeinorst\xc3\xa9") for _ in range(rng.randint(1, 63))) for _ in range(500)]
    for word, code in zip(words, ours.words(words)):
        assert np.frombuffer(code, "<u4").tolist() == ours._long(word)


def test_digests(spark, both):
    _, theirs = both
    rows = [(i, t, "x") for i, t in enumerate([*TEXTS, None, TEXTS[3], "word " * 50000])] + [(None, "null id", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(docs).collect()}
    want = set()
    for i, t, _ in rows:
        ids = theirs.encode(t or "", add_special_tokens=False).ids
        want.add((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(theirs.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == want
    assert bpe.digests(docs.limit(0)).collect() == []


def test_round_trip_frames(spark, both):
    _, theirs = both
    docs = spark.createDataFrame([(1, "Some words, more words."), (2, None)], "doc_id long, text string")
    back = {r.doc_id: r.text for r in bpe.decode(bpe.encode(docs)).collect()}
    assert back == {1: theirs.decode(theirs.encode("Some words, more words.", add_special_tokens=False).ids, skip_special_tokens=False), 2: ""}


def test_ids_beyond_16_bits():
    """A vocabulary of over 110,000: the file's own, moved up by 70,000."""
    config = json.loads(open(bpe.default_path()).read())
    vocab = config["model"]["vocab"]
    config["model"]["vocab"] = {f"unused {i}": i for i in range(70_000)} | {k: v + 70_000 for k, v in vocab.items()}
    for token in config["added_tokens"]:
        token["id"] += 70_000
    config["post_processor"] = config["truncation"] = config["padding"] = None
    text = json.dumps(config)
    theirs, mine = Tokenizer.from_str(text), bpe.Bpe(text)
    for words in ("the river of things, and 12 others", "Überfluß naïve co-operate", "x" * 300, "antidisestablishmentarianism " * 9):
        want = theirs.encode(words, add_special_tokens=False).ids
        assert mine.encode_text(words) == want and min(want) > 65_536


def test_memory_of_a_large_batch(both):
    """16 MB of text in one batch: a worker's arrays stay those of a few MB, with the ids of texts encoded alone."""
    ours, _ = both
    rows = [f"the river {i % 7} of things, and others " * 500 for i in range(900)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(rows))), pa.array(rows)], ["id", "text"])
    want = [ours.encode_text(t) for t in rows[:7]]
    tracemalloc.start()
    try:
        for part in pieces(batch):
            for i, found in zip(part.column(0).to_pylist(), ours.texts(part.column(1))):
                assert found.tolist() == want[i % 7]
        assert tracemalloc.get_traced_memory()[1] < 64e6
    finally:
        tracemalloc.stop()


def test_cache_is_bounded_in_bytes():
    """Chunks of scripts without spaces are long: few of them fill a worker's memory."""

    class Lengths(ChunkCache):
        def others_ids(self, chunks):
            return np.array([len(c) for c in chunks], "<u4"), np.ones(len(chunks), np.int64)

        words_ids = others_ids

    cache = Lengths()
    for i in range(40):
        texts = [f"{i}x{k}" + "文" * (300 + k) for k in range(1000)]
        ids, counts = cache.encode(pa.array(texts))
        assert ids.tolist() == list(map(len, texts)) and set(counts.tolist()) == {1}
        assert sum(len(c.encode()) for c in cache.cache) <= 1 << 24
