"""Token-id files: adaptive context mixing and range coding in independent blocks.

The coder of a block, with its model of orders 0 to 2, is in ``id_coder``; every
block starts from an empty model and holds at most ``id_coder.BLOCK`` ids.

File: magic, counts, an index of (document id, tokens) and, for every block,
its byte length and the CRC-32 of its ids, then the blocks. A file ends with
the document before the one that would overfill its block; a document of more
ids than a block has a file of several blocks. Files are rows of a Parquet
table, in the order of (part, file), each with the number of its part's ids
before it, so they can lie in any store that Spark writes.

The tokenizer is the tokenizers library. Where the tokenizer file has the text
rules that ``RULES`` states, ``chunks`` encodes each chunk between white space
once. Any other tokenizer file gets whole texts, one by one.

Ids must be under 2 ** 20. Defined cases: null text is empty text and has the
end id alone; null document ids come first and are read back as null; rows that
repeat an id are written in the order of their texts; an empty table gives no
file; a damaged block is an error; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import id_coder
from .bpe import default_path
from .chunks import ChunkCache, pieces
from .common import delete_path, materialize, shared_folder, text_of

MAGIC, END = b"SILT2\0\0\0", 1
NULL_ID = -(2**63)
#: The text rules under which chunks can be encoded apart.
RULES = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "split": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+",
}
def write_file(keys: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> bytes:
    """keys, counts: id and number of tokens of each document; ids: all tokens in order."""
    n = -(-len(ids) // id_coder.BLOCK)
    blocks = np.array_split(ids, n) if n else []
    parts = [id_coder.compress(b) for b in blocks]
    table = np.array([[len(b), len(p), zlib.crc32(b.astype("<u4").tobytes())] for b, p in zip(blocks, parts)], "<i8")
    index = zlib.compress(keys.astype("<i8").tobytes() + counts.astype("<i8").tobytes() + table.tobytes())
    head = np.array([len(keys), n, len(index), zlib.crc32(index)], "<i8").tobytes()
    return MAGIC + head + index + b"".join(parts)


def read_file(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, counts, ids) of a file; a block or index that fails its checksum is an error."""
    if data[:8] != MAGIC:
        raise ValueError("not a token file")
    docs, n, length, check = np.frombuffer(data, "<i8", 4, 8).tolist()
    at = 40 + length
    if zlib.crc32(data[40:at]) != check:
        raise ValueError("the index is damaged")
    index = np.frombuffer(zlib.decompress(data[40:at]), "<i8")
    ids = []
    for i, (many, size, check) in enumerate(index[2 * docs :].reshape(n, 3).tolist()):
        try:
            found = id_coder.expand(data[at : at + size], many)
        except (IndexError, ValueError) as error:  # a damaged model size or word count
            raise ValueError(f"block {i} is damaged") from error
        if zlib.crc32(found.astype("<u4").tobytes()) != check:
            raise ValueError(f"block {i} is damaged")
        ids.append(found)
        at += size
    return index[:docs], index[docs : 2 * docs], np.concatenate(ids) if ids else np.empty(0, np.int64)


class Library(ChunkCache):
    """The tokenizers library behind a cache of chunks."""

    def __init__(self, config: str, limit: int = 1_000_000) -> None:
        # a worker has one core; threads would only cost
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        super().__init__(limit)
        self.tokenizer = Tokenizer.from_str(config)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        data = json.loads(config)
        first, second = ((data.get("pre_tokenizer") or {}).get("pretokenizers") or [{}, {}])[:2]
        split = first.get("type") == "Split" and first.get("invert") and first.get("behavior") == "Removed" and first.get("pattern") == {"Regex": RULES["split"]}
        level = second.get("type") == "ByteLevel" and not second.get("add_prefix_space") and not second.get("use_regex")
        suffix = data["model"].get("end_of_word_suffix")
        # added tokens are looked for in the raw text: none may hold white space or lie in what is changed here
        self.added = [t["content"] for t in data.get("added_tokens") or []]
        apart = all(t.startswith("<|") and not re.search(r"\s", t) for t in self.added) and not any(t.get("lstrip") or t.get("rstrip") for t in data.get("added_tokens") or [])
        self.by_chunk = bool(split and level and suffix and apart and data["model"]["type"] == "BPE" and data["normalizer"] == RULES["normalizer"] and not data.get("post_processor"))
        if self.by_chunk:
            self.ends = np.zeros(max(data["model"]["vocab"].values()) + 1, bool)
            self.ends[[i for piece, i in data["model"]["vocab"].items() if piece.endswith(suffix)]] = True
            # for rows of plain lower-case words: the same model without rules that would change nothing
            self.words = Tokenizer.from_str(config)
            self.words.normalizer = None
            self.words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            self.words.no_padding()
            self.words.no_truncation()

    def _ids(self, texts: list[str]) -> Iterator[np.ndarray]:
        for at in range(0, len(texts), 256):
            for found in self.tokenizer.encode_batch_fast(texts[at : at + 256], add_special_tokens=False):
                yield np.array(found.ids, "<u4")

    def words_ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        # words in a row, some dozens a text: each ends with the one piece of it that ends a word
        rows = [" ".join(words[at : at + 64]) for at in range(0, len(words), 64)]
        found = [np.array(x.ids, "<u4") for at in range(0, len(rows), 16) for x in self.words.encode_batch_fast(rows[at : at + 16], add_special_tokens=False)]
        ids = np.concatenate([np.empty(0, "<u4"), *found])
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(words):
            raise ValueError("the tokenizer's words do not end with its suffix")
        return ids, np.diff(ends, prepend=0)

    def others_ids(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = list(self._ids(chunks))
        return np.concatenate([np.empty(0, "<u4"), *found]), np.fromiter(map(len, found), np.int64, len(found))

    def encode(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, ids of each text) of a column without nulls."""
        return super().encode(texts) if self.by_chunk else self.others_ids(texts.to_pylist())


_encoders: dict[int, Library] = {}


def library(config: str) -> Library:
    key = zlib.crc32(config.encode())
    if key not in _encoders:
        _encoders[key] = Library(config)
    return _encoders[key]


def write(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end: int = END) -> None:
    """Encode every text, append ``end``, and write the files at ``path`` in ascending id order."""
    with open(tokenizer or default_path(), encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    ordered = rows.repartitionByRange("id").sortWithinPartitions("id", "text").withColumn("part", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = library(shared.value)
        keys, counts, ids = np.empty(0, np.int64), np.empty(0, np.int64), []
        ahead, files, part = 0, 0, None

        def flush(n: int) -> pa.RecordBatch:
            """A file of the first n documents at hand."""
            nonlocal keys, counts, ids, ahead, files
            whole, size = np.concatenate(ids), int(counts[:n].sum())
            data = write_file(keys[:n], counts[:n], whole[:size].astype(np.int64))
            values = zip((part, files, size, ahead, data), (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()))
            keys, counts, ids, ahead, files = keys[n:], counts[n:], [whole[size:]], ahead + size, files + 1
            return pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in values], ["part", "file", "tokens", "ahead", "data"])

        for batch in batches:
            for some in pieces(batch):
                part = some.column(2)[0].as_py()
                found, n = encoder.encode(some.column(1))
                # the end id after each document
                ids.append(np.insert(found, np.cumsum(n), end))
                counts = np.r_[counts, n + 1]
                keys = np.r_[keys, some.column(0).fill_null(NULL_ID).to_numpy()]
                while int(counts.sum()) > id_coder.BLOCK and len(counts) > 1:
                    yield flush(max(1, int(np.searchsorted(np.cumsum(counts), id_coder.BLOCK, side="right"))))
        if len(keys):
            yield flush(len(keys))

    made = ordered.mapInArrow(run, "part int, file int, tokens long, ahead long, data binary")
    # the data are compressed already
    made.write.mode("errorifexists").option("compression", "none").parquet(path)


def _each_file(spark, path: str, describe, schema: str) -> DataFrame:
    """``describe(keys, starts, counts, ids, ends)`` of every file: arrays of its documents."""
    files = spark.read.parquet(path)
    # one row per part: as many as the session has shuffle partitions, whatever the size of the data
    parts = sorted((r.part, r.n) for r in files.groupBy("part").agg(F.sum("tokens").alias("n")).collect())
    begins, total = {}, 0
    for part, n in parts:
        begins[part], total = total, total + n
    shared = spark.sparkContext.broadcast(begins)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                part, ahead, data = (batch.column(j)[i].as_py() for j in range(3))
                keys, counts, ids = read_file(data)
                ends = np.cumsum(counts)
                code = memoryview(ids.astype("<u4").tobytes())
                for at in range(0, len(keys), 512):
                    k, c, e = keys[at : at + 512], counts[at : at + 512], ends[at : at + 512]
                    own = [code[(b - n) * 4 : b * 4] for b, n in zip(e.tolist(), c.tolist())]
                    columns = {"id": pa.array(k, pa.int64(), mask=k == NULL_ID), "start": pa.array(shared.value[part] + ahead + e - c, pa.int64())}
                    yield pa.RecordBatch.from_pydict(columns | describe(own))

    return files.select("part", "ahead", "data").mapInArrow(run, "id long, start long, " + schema)


def read(spark, path: str) -> DataFrame:
    """(id, start, ids binary): each document's ids as little-endian unsigned 32-bit integers."""
    return _each_file(spark, path, lambda own: {"ids": pa.array([bytes(x) for x in own], pa.binary())}, "ids binary")


def describe(spark, path: str) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of each document, as read() gives it; its ids do not leave the worker."""

    def digests(own: list[memoryview]) -> dict[str, pa.Array]:
        return {"n_tokens": pa.array([len(x) // 4 for x in own], pa.int64()), "ids_crc32": pa.array([zlib.crc32(x) for x in own], pa.int64())}

    return _each_file(spark, path, digests, "n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end: int = END) -> DataFrame:
    """Write the files, read them back and describe every document; the files are then removed."""
    spark = docs.sparkSession
    path = shared_folder(spark, "tokens")
    try:
        write(docs, path, id_col, text_col, tokenizer, end)
        return materialize(describe(spark, path).withColumnRenamed("id", id_col))
    finally:
        delete_path(spark, path)
