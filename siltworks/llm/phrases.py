"""Phrase collocations: deduplicated pieces, n-grams counted in DuckDB per hash bucket, parts by shuffled requests.

1. Texts are lower-cased (A-Z), cut into pieces at ``.,;:!?`` and line ends and
   into words at spaces and tabs. Equal pieces of a language become one row with
   its multiplicity.
2. For n = 1 ... ``LONGEST``, pieces become n-grams, weighted by multiplicity and
   added up inside blocks of ``BLOCK`` words, then dealt by hash of (language,
   n-gram). DuckDB adds up each bucket out of core, in ``MEMORY`` and a folder
   that goes with the task, and gives what occurs ``LEAST`` times. The empty
   n-gram stands for all word occurrences. As an n-gram is no more frequent than
   what it begins and ends with, those are looked up first in a table of bits
   that the frequent ones set: of fixed size, never wrong about a frequent one,
   only less sparing when many share it.
3. Every candidate asks for the counts of both sides of each of its cuts; the
   requests travel to the counts (those of parts that many ask for get theirs by
   broadcast), the answers back to the candidate. A part of a candidate is at
   least as frequent, so its count is among those kept.

Arithmetic is exact: counts are 64-bit, products 38-digit decimals.

Defined cases: null texts are empty; a null language is ``und`` and one with it;
texts without words give nothing; repeated rows count each; an empty table gives
an empty result; ids, nulls in them and other columns are not read.
"""

from __future__ import annotations

import tempfile
from collections import Counter
from collections.abc import Iterable, Iterator

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import delete_path, hot_keys, materialize, shared_folder, skew_join, text_of

LONGEST, LEAST, INSIDE, TOP = 3, 10, 50, 2000
#: Words whose n-grams are added up together before the shuffle; memory for one bucket in DuckDB.
BLOCK, MEMORY = 1 << 20, "256MB"
#: Log2 of the bits that mark frequent n-grams, 4 MB in all.
MARKS = 25
SALTS = 32
#: What cuts pieces becomes a line end, other white space a space, A-Z lower case.
BYTES = bytes(c + 32 if 65 <= c <= 90 else 10 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c for c in range(256))


def pieces_of(text: str) -> Iterator[bytes]:
    """The pieces of a text that have words, words parted by one space."""
    for piece in text.encode("utf-8", "replace").translate(BYTES).split(b"\n"):
        words = piece.split(b" ") if b"  " not in piece else piece.split()
        if words := b" ".join(words).strip(b" "):
            yield words


def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) to (lang, piece, m), equal pieces of a batch together."""
    for batch in batches:
        found: dict[str, Counter] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            found.setdefault(lang, Counter()).update(pieces_of(text.as_py()))
        for lang, some in found.items():
            pieces = pa.array(list(some), pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([pa.repeat(lang, len(some)), pieces, pa.array(list(some.values()), pa.int64())], ["lang", "piece", "m"])


def mixed(numbers: list[np.ndarray]) -> np.ndarray:
    """One 64-bit hash of several, in their order."""
    out = np.zeros(len(numbers[0]), np.uint64)
    for x in numbers:
        out = (out ^ x) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def hashed(texts: Iterable[str]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(t) for t in texts], np.uint64)


def grams_of(block: pa.Table, n: int, marks: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """The distinct n-grams of a block of pieces with their weights; beside single words, all occurrences as the empty n-gram.

    marks: bits of the frequent n-grams one word shorter; an n-gram that begins or ends with an unmarked one is left out.
    """
    lists = pc.split_pattern(block["piece"].combine_chunks(), " ")
    size = pc.list_value_length(lists).to_numpy().astype(np.int64)
    coded, langs = lists.flatten().dictionary_encode(), block["lang"].combine_chunks().dictionary_encode()
    word, words = coded.indices.to_numpy().astype(np.int64), coded.dictionary
    left = np.repeat(np.cumsum(size), size) - np.arange(len(word))  # words from here to the piece's end
    lang = np.repeat(langs.indices.to_numpy().astype(np.int64), size)
    weight = np.repeat(block["m"].to_numpy(), size)

    def batch(lang: np.ndarray, grams: pa.Array, f: np.ndarray) -> pa.RecordBatch:
        # doubles hold a block's sums exactly
        return pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(lang)), grams, pa.array(f.astype(np.int64))], ["lang", "gram", "f"])

    if n == 1:
        per = np.bincount(lang, weight, len(langs.dictionary))
        yield batch(np.arange(len(per)), pa.repeat("", len(per)), per)
    at = np.flatnonzero(left >= n)
    if marks is not None and len(at):
        own, tongue = hashed(words.to_pylist())[word], hashed(langs.dictionary.to_pylist())[lang]
        fits = np.flatnonzero(left >= n - 1)
        marked = np.zeros(len(word), bool)
        marked[fits] = has(marks, mixed([tongue[fits], *[own[fits + k] for k in range(n - 1)]]))
        at = at[marked[at] & marked[at + 1]]
    if not len(at):
        return
    key, keys = lang[at], len(langs.dictionary)
    for k in range(n):
        if keys * len(words) >= 2**63:
            found, key = np.unique(key, return_inverse=True)
            keys = len(found)
        key, keys = key * len(words) + word[at + k], keys * len(words)
    _, first, place = np.unique(key, return_index=True, return_inverse=True)
    parts = [words.take(pa.array(word[at[first] + k])) for k in range(n)]
    yield batch(lang[at[first]], pc.binary_join_element_wise(*parts, " ") if n > 1 else parts[0], np.bincount(place, weight[at]))


def has(marks: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    spot = hashes >> np.uint64(64 - MARKS)
    return (marks[spot >> np.uint64(3)] >> (spot & np.uint64(7)).astype(np.uint8)) & 1 == 1


def marks_of(level: DataFrame) -> np.ndarray:
    """A table of 2 ** MARKS bits, those of the hashes of frequent n-grams set. Bits travel by slices; the table has one size, however many there are."""
    low = MARKS - 16

    def spots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tongues, grams = batch.column(0).to_pylist(), [g.split(" ") for g in batch.column(1).to_pylist()]
            for size in {len(g) for g in grams}:
                some = [i for i, g in enumerate(grams) if len(g) == size]
                spot = mixed([hashed(tongues[i] for i in some), *[hashed(grams[i][k] for i in some) for k in range(size)]]) >> np.uint64(64 - MARKS)
                yield pa.RecordBatch.from_arrays([pa.array((spot >> np.uint64(low)).astype(np.int32)), pa.array((spot & np.uint64(2**low - 1)).astype(np.int32))], ["slice", "spot"])

    found = level.where("gram != ''").select("lang", "gram").mapInArrow(spots, "slice int, spot int").groupBy("slice").agg(F.collect_set("spot").alias("spots"))
    bits = np.zeros(2**MARKS, bool)
    for r in found.toLocalIterator():
        bits[(r.slice << low) + np.array(r.spots)] = True
    return np.packbits(bits, bitorder="little")


def counted(pieces: DataFrame, n: int, least: int, marks: np.ndarray | None = None) -> DataFrame:
    """(lang, gram, f) of every n-gram with at least ``least`` occurrences, and of the empty one beside single words."""
    shared = None if marks is None else pieces.sparkSession.sparkContext.broadcast(marks)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, words, known = [], 0, None if shared is None else shared.value
        for batch in batches:
            for part in (batch.slice(i, 1 << 14) for i in range(0, batch.num_rows, 1 << 14)):
                held.append(part)
                words += pc.sum(pc.count_substring(part.column("piece"), " ")).as_py() + part.num_rows
                if words >= BLOCK:
                    yield from grams_of(pa.Table.from_batches(held), n, known)
                    held, words = [], 0
        if held:
            yield from grams_of(pa.Table.from_batches(held), n, known)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("lang", pa.string()), ("gram", pa.string()), ("f", pa.int64())])
        with tempfile.TemporaryDirectory() as folder:
            settings = {"memory_limit": MEMORY, "temp_directory": folder, "threads": 1, "preserve_insertion_order": False}
            with duckdb.connect(config=settings) as db:
                db.register("bucket", pa.RecordBatchReader.from_batches(schema, (b.cast(schema) for b in batches)))
                sums = db.sql("SELECT lang, gram, CAST(sum(f) AS BIGINT) AS f FROM bucket GROUP BY lang, gram HAVING gram = '' OR sum(f) >= ?", params=[least])
                for found in sums.to_arrow_reader(10_000):
                    yield found.cast(schema)

    schema = "lang string, gram string, f long"
    return pieces.mapInArrow(spread, schema).repartition("lang", "gram").mapInArrow(add, schema)


def frequent(pieces: DataFrame, longest: int, least: int) -> DataFrame:
    """(lang, gram, f) of every n-gram up to ``longest`` words with at least ``least`` occurrences, and of the empty one."""
    out = marks = None
    for n in range(1, longest + 1):
        level = materialize(counted(pieces, n, least, marks))
        out = level if out is None else out.unionByName(level)
        marks = marks_of(level) if n < longest else None
    return out


def words_in(gram: str) -> F.Column:
    return F.split(F.col(gram), " ", -1)


def candidates(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", longest: int = LONGEST, least: int = LEAST, inside: int = INSIDE) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of every phrase that stays, all languages."""
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), text_of(text_col).alias("text"))
    folder = shared_folder(docs.sparkSession, "pieces")
    rows.mapInArrow(cut, "lang string, piece string, m long").groupBy("lang", "piece").agg(F.sum("m").alias("m")).write.parquet(folder)
    counts = frequent(docs.sparkSession.read.parquet(folder), longest, least)
    delete_path(docs.sparkSession, folder)
    known = counts.where("gram != ''").withColumn("size", F.size(words_in("gram")))
    phrases = known.where("size > 1").select("lang", F.col("gram").alias("phrase"), F.col("f").alias("a"), "size", words_in("gram").alias("words"))

    # requests: both sides of every cut ask for their counts
    part = lambda first, n: F.array_join(F.slice("words", first, n), " ")
    cuts = phrases.select("lang", "phrase", "a", "size", "words", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    sides = F.array(F.struct(F.lit("l").alias("side"), part(F.lit(1), F.col("k")).alias("part")), F.struct(F.lit("r").alias("side"), part(F.col("k") + 1, F.col("size") - F.col("k")).alias("part")))
    asked = cuts.select("lang", "phrase", "a", "k", F.explode(sides).alias("x")).select("lang", "phrase", "a", "k", "x.side", F.concat("x.part", F.lit("\t"), "lang").alias("key"))
    asks = materialize(asked.groupBy("key").agg(F.count(F.lit(1)).alias("rows")))
    hot = hot_keys(asks, "key", "rows", asks.agg(F.sum("rows")).first()[0] or 0)
    answers = skew_join(asked, known.select(F.concat("gram", F.lit("\t"), "lang").alias("key"), "f"), "key", hot)
    found = [F.max(F.when((F.col("k") == k) & (F.col("side") == side), F.col("f"))).alias(f"{side}{k}") for k in range(1, longest) for side in "lr"]
    back = answers.groupBy("lang", "phrase", "a").agg(*found)
    exact = lambda c: f"CAST({c} AS DECIMAL(19, 0))"
    score = lambda k: F.expr(f"(CAST(1000000 AS DECIMAL(7, 0)) * ({exact('a')} * {exact('a')})) div ({exact(f'l{k}')} * {exact(f'r{k}')})")
    options = [F.when(F.col(f"l{k}").isNotNull(), F.struct(score(k).alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"))) for k in range(1, longest)]
    scored = back.withColumn("cut", F.array_min(F.array_compact(F.array(*options)))).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")

    # the most frequent longer candidate around each phrase
    spans = F.explode(F.filter(F.flatten(F.transform(F.sequence(F.lit(1), F.col("size") - 1), lambda i: F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda n: F.when(i + n - 1 <= F.col("size"), F.array_join(F.slice("words", i, n), " "))))), lambda x: x.isNotNull()))
    around = phrases.where("size > 2").select("lang", spans.alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = scored.join(around, ["lang", "phrase"], "left").where(f"longer IS NULL OR 100 * longer < {inside} * a").drop("longer")
    totals = counts.where("gram = ''").select("lang", F.col("f").alias("n"))
    return kept.join(totals, "lang")


def best(docs: DataFrame, top: int = TOP, **options) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top`` by score, then a, then phrase.

    The first of each of ``SALTS`` parts of a language are ranked, then those of the language.
    """
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    some = candidates(docs, **options).withColumn("salt", F.pmod(F.hash("phrase"), F.lit(SALTS)))
    first = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
