import json
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from siltworks.llm import bpe, id_coder, queries, token_files

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("n", [0, 1, 2, 511, 512, 513, 6300])
@pytest.mark.parametrize("kind", ["random", "constant", "repeats", "skewed", "edges", "wide"])
def test_coder_round_trip(kind, n):
    rng = np.random.default_rng(5)
    ids = {
        "random": rng.integers(0, 65535, n), "constant": np.full(n, 65534), "repeats": np.resize(rng.integers(0, 49408, 30), n),
        "skewed": np.minimum(rng.geometric(0.01, n), 65534), "edges": rng.choice([0, 1, 2, 255, 256, 32767, 32768, 65534], n),
        "wide": rng.choice([0, 100_255, 1 << 18, (1 << 20) - 1], n),
    }[kind]
    data = id_coder.compress(ids)
    assert (id_coder.expand(data, n) == ids).all()
    if kind in ("constant", "repeats", "skewed") and n > 5000:
        assert len(data) < n * 2 * 0.75


def test_id_beyond_the_format():
    with pytest.raises(ValueError, match="below"):
        id_coder.compress(np.array([1, 1 << 20]))


def test_less_than_order_0_entropy():
    """Fewer bits an id than the entropy of the ids' own counts, and than a general packer."""
    theirs = Tokenizer.from_file(bpe.default_path())
    texts = pq.read_table(f"{SF.replace('0.001', '0.01')}/documents.parquet", columns=["text"]).column(0).to_pylist()
    ids = np.concatenate([np.array([*e.ids, 1]) for e in theirs.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)])
    share = np.bincount(ids)[np.unique(ids)] / len(ids)
    bits = 8 * len(id_coder.compress(ids)) / len(ids)
    assert bits < -(share * np.log2(share)).sum() and bits < 8 * len(zlib.compress(ids.astype("<u2").tobytes())) / len(ids)


def test_file_round_trip_and_damage(monkeypatch):
    rng = np.random.default_rng(6)
    counts = np.array([1, 5000, 1, 700])
    ids = rng.integers(0, 49408, counts.sum())
    for block in (1 << 21, 1000):
        monkeypatch.setattr(id_coder, "BLOCK", block)
        data = token_files.write_file(np.array([3, 4, 9, token_files.NULL_ID]), counts, ids)
        keys, n, back = token_files.read_file(data)
        assert keys.tolist() == [3, 4, 9, token_files.NULL_ID] and n.tolist() == counts.tolist() and (back == ids).all()
        for at in (60, len(data) - 900):
            with pytest.raises(ValueError, match="damaged"):
                token_files.read_file(data[:at] + bytes([data[at] ^ 255]) + data[at + 1 :])


TEXTS = [
    "Plain words, and more. And (bracketed), \"quoted.\" 'single', it's we'll they'RE o'clock, end.", "a,b.c ,d , . ,. ., ),. x), 3, 4. 5,6 ª, µ. ², ½. _a_, __. -- -, ...", "É à Ünï ß, ÿ. Ærø× ÷ Ñandú. naïve, façade!!! word&&& word$$$ %%%",
    "İstanbul ΣΑΣ, ﬁ, été. Å, ǅ. Ω, 你好, мир. 🙂, 🙂.", "a b\u0085c d\x1ce\x1f, f\x0b, g\t. h\r\n", "<|endoftext|>, x. <|startoftext|>Word, <|END|>.", "trailing, ", "trailing.", ",", ". ", "", " ", "x" * 3000 + ", y.", "WORD, Word. word,",
]


def encoded(library, texts):
    ids, counts = library.encode(pa.array(texts, pa.string()))
    ends = np.cumsum(counts)
    return [ids[e - n : e].tobytes() for e, n in zip(ends, counts)]


def test_library_encodes_as_whole_texts_do():
    config = open(bpe.default_path(), encoding="utf-8").read()
    theirs = Tokenizer.from_str(config)
    want = [np.array(theirs.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in TEXTS]
    ours = token_files.Library(config, limit=20)
    assert ours.by_chunk and encoded(ours, TEXTS) == want and encoded(ours, TEXTS[::-1]) == want[::-1]
    usual = [t for t in TEXTS if t.isascii()]
    assert encoded(ours, usual) == [w for w, t in zip(want, TEXTS) if t.isascii()] and encoded(ours, []) == []
    data = json.loads(config)
    data["pre_tokenizer"]["pretokenizers"][0]["pattern"] = {"Regex": "[a-z ]+|[^a-z]"}
    other = token_files.Library(json.dumps(data))
    theirs = Tokenizer.from_str(json.dumps(data))
    assert not other.by_chunk and encoded(other, TEXTS) == [np.array(theirs.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in TEXTS]


def expected(rows):
    theirs = Tokenizer.from_file(bpe.default_path())
    want, start = [], 0
    for key, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = theirs.encode(text or "", add_special_tokens=False).ids + [1]
        want.append((key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return want


def test_documents(spark, monkeypatch, tmp_path):
    rows = [(i * 3 % 97, f"Text {i} has some words, {'again ' * (i % 7)}", "x") for i in range(97)] + [(200, None, "y"), (201, "", "y"), (202, "long words here " * 4000, "y"), (-5, '" "<|endoftext|>', "y"), (None, "null id", "z"), (7, "second seven", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(5)
    want = expected([r[:2] for r in rows])
    monkeypatch.setattr(id_coder, "BLOCK", 300)
    got = sorted(token_files.round_trip(docs).collect(), key=lambda r: r.start)
    assert [tuple(r) for r in got] == want
    assert token_files.round_trip(docs.limit(0)).collect() == []
    token_files.write(docs, str(tmp_path / "files"))
    back = {(r.id, r.start, len(r.ids) // 4, zlib.crc32(r.ids)) for r in token_files.read(spark, str(tmp_path / "files")).collect()}
    assert back == set(want)


def test_query_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted(map(tuple, queries.op7_token_files(spark, SF).collect()), key=lambda r: r[1]) == expected(rows)
