"""Byte-pair encoding with a segment tree over adjacent pair ranks.

The leaves of the tree hold ``rank * slots + position`` of the pair that starts
at each slot of a word, inner nodes the minimum below, so the root yields the
leftmost pair of the lowest rank. A merge changes three leaves and the paths
above them; merging stops when the root holds no pair. Short words are
encoded many at a time, one numpy lane per word; long ones one by one with the
same tree in plain lists, so a word of a million letters costs n log n.

Text rules of the tokenizer file (fixed by it): canonical composition, white
space to spaces, lower case letter by letter, split into contractions, runs of
letters, single digits and runs of anything else; white space is dropped. No
rule looks across white space, so every white-space-free chunk is encoded once
and kept in a bounded cache per Python worker (``chunks``). Special tokens are recognised
in the raw text.

Defined cases: null text is empty text and has no tokens; null ids and repeated
rows are kept as they are; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import CACHE, ChunkCache, pieces
from .common import text_of

#: Words of more bytes than this are encoded one by one.
LANE = 63
#: Bits of an id in a pair's key; no id, and the rank of no merge.
WIDTH = 31
NONE, BIG = (1 << WIDTH) - 1, 1 << 24
#: Letters and digits younger than Unicode 16, which the tokenizer knows.
YOUNGER = (
    "558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 "
    "10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 16EA0-16EB8 "
    "16EBB-16ED3 16FF2-16FF6 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 "
    "1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED "
    "1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F "
)
_young = "".join("-".join(f"\\U{int(x, 16):08X}" for x in r.split("-")) for r in YOUNGER.split())
#: The tokenizer's own split pattern, a fixed value of its file.
PRETOKEN = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}--[{_young}]]+|[\p{{N}}--[{_young}]]|[^\s[\p{{L}}\p{{N}}--[{_young}]]]+", regex.V1)
#: Lower case of letters that Unicode 16 and 17 added.
LOWER = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
LOWER |= {0x10D50 + i: 0x10D70 + i for i in range(22)} | {0x16EA0 + i: 0x16EBB + i for i in range(25)}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself where printable, else the next from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {b: chr(b) for b in own}
    for b in range(256):
        letters.setdefault(b, chr(0x100 + len(letters) - len(own)))
    return [letters[b] for b in range(256)]


class Bpe(ChunkCache):
    """Encoder and decoder of one tokenizer file (a model of bytes with word ends)."""

    def __init__(self, config: str, cache: int = CACHE) -> None:
        data = json.loads(config)
        model = data["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.find_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        ids = vocab | self.special
        self.pieces = [b""] * (max(ids.values()) + 1)
        for piece, at in ids.items():
            self.pieces[at] = piece.encode()
        letters = byte_letters()
        self.first = np.array([vocab[c] for c in letters], np.int64)
        self.last = np.array([vocab[c + end] for c in letters], np.int64)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([vocab[a] << WIDTH | vocab[b] for a, b in merges], np.int64)
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]
        self.made = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.rank_of = dict(zip(keys.tolist(), range(len(keys))))
        super().__init__(cache)

    # -- one word ---------------------------------------------------------

    def _long(self, word: bytes) -> list[int]:
        """One word, with the tree in plain lists."""
        n = len(word)
        slots = 1 << n.bit_length()
        none = slots - 1
        ids = self.first[np.frombuffer(word, np.uint8)].tolist()
        ids[-1] = int(self.last[word[-1]])
        ids += [NONE] * (slots - n)
        after, before = [*range(1, n), none], [none, *range(n - 1)]
        after += [none] * (slots - n)
        before += [none] * (slots - n)
        rank = lambda i: self.rank_of.get(ids[i] << WIDTH | ids[after[i]], BIG) * slots + i
        tree = [BIG * slots] * slots + [rank(i) if i < n - 1 else BIG * slots for i in range(slots)]
        for k in range(slots - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])
        while tree[1] < BIG * slots:
            at, pos = divmod(tree[1], slots)
            gone = after[pos]
            ids[pos], ids[gone] = int(self.made[at]), NONE
            after[pos] = after[gone]
            before[after[gone]] = pos
            changed = [(gone, BIG * slots), (pos, rank(pos))]
            if before[pos] != none:
                changed.append((before[pos], rank(before[pos])))
            for leaf, value in changed:
                k = slots + leaf
                tree[k] = value
                while k > 1:
                    k >>= 1
                    least = min(tree[2 * k], tree[2 * k + 1])
                    if tree[k] == least:
                        break
                    tree[k] = least
        return [x for x in ids[:n] if x != NONE]

    # -- many short words ---------------------------------------------------

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << WIDTH | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.order[at], BIG)

    def _lanes(self, words: list[bytes], slots: int) -> tuple[np.ndarray, np.ndarray]:
        """(all ids in order, number of ids of each word); every word has fewer bytes than ``slots``."""
        w, none, bits = len(words), slots - 1, slots.bit_length() - 1
        n = np.fromiter(map(len, words), np.int64, w)
        raw = np.frombuffer(b"".join([x.ljust(slots, b"\0") for x in words]), np.uint8).reshape(w, slots)
        ids = self.first[raw]
        rows, place = np.arange(w), np.arange(slots)
        ids[rows, n - 1] = self.last[raw[rows, n - 1]]
        ids[place[None, :] >= n[:, None]] = NONE
        after = np.minimum(np.where(place[None, :] + 1 < n[:, None], place[None, :] + 1, none), none)
        before = np.where((place[None, :] > 0) & (place[None, :] < n[:, None]), place[None, :] - 1, none)
        tree = np.empty((w, 2 * slots), np.int64)
        tree[:, slots : 2 * slots - 1] = self._ranks(ids[:, :-1], ids[:, 1:]) << bits | place[:-1]
        tree[:, 2 * slots - 1] = BIG << bits
        half = slots >> 1
        while half:
            tree[:, half : 2 * half] = np.minimum(tree[:, 2 * half : 4 * half : 2], tree[:, 2 * half + 1 : 4 * half : 2])
            half >>= 1
        fi, fa, fb, ft = ids.reshape(-1), after.reshape(-1), before.reshape(-1), tree.reshape(-1)
        live = rows[tree[:, 1] < BIG << bits]
        while len(live):
            base, root = live * slots, live * (2 * slots)
            top = ft[root + 1]
            pos, made = top & none, self.made[top >> bits]
            gone = fa[base + pos]
            then = fa[base + gone]
            fi[base + pos], fi[base + gone] = made, NONE
            fa[base + pos] = then
            prior = fb[base + pos]
            fb[base + then] = pos
            fb[base + none] = none
            leaves = np.stack([gone, pos, prior])
            left, right = fi[base + prior], fi[base + then]
            ft[root + slots + gone] = BIG << bits
            ft[root + slots + prior] = self._ranks(left, made) << bits | prior
            ft[root + slots + pos] = self._ranks(made, right) << bits | pos
            node = (slots + leaves) >> 1
            for _ in range(bits):
                at = root + node
                kids = root + 2 * node
                ft[at] = np.minimum(ft[kids], ft[kids + 1])
                node >>= 1
            live = live[ft[root + 1] < BIG << bits]
        kept = ids != NONE
        return ids[kept], kept.sum(axis=1)

    def words(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(words)
        by: dict[int, list[int]] = {}
        for i, x in enumerate(words):
            if x:
                by.setdefault(len(x).bit_length() if len(x) <= LANE else 0, []).append(i)
        for bits, some in by.items():
            if not bits:
                for i in some:
                    out[i] = np.array(self._long(words[i]), "<u4").tobytes()
                continue
            for at in range(0, len(some), 1 << 14):
                part = some[at : at + (1 << 14)]
                ids, counts = self._lanes([words[i] for i in part], 1 << max(1, bits))
                flat, ends = ids.astype("<u4").tobytes(), (np.cumsum(counts) * 4).tolist()
                begin = 0
                for i, end in zip(part, ends):
                    out[i] = flat[begin:end]
                    begin = end
        return out

    # -- texts --------------------------------------------------------------

    def _parts(self, chunk: str) -> list[str | int]:
        """The words of one chunk without white space; special tokens as their ids."""
        if chunk.isascii() and chunk.isalpha():
            return [chunk.lower()]
        found: list[str | int] = []
        for i, piece in enumerate(self.find_special.split(chunk) if self.find_special else [chunk]):
            if i % 2:
                found.append(self.special[piece])
            elif piece:
                low = "".join(map(str.lower, unicodedata.normalize("NFC", piece))).translate(LOWER)
                found += PRETOKEN.findall(low)
        return found

    def words_ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return self._in_a_row(self.words([w.encode() for w in words]))

    def others_ids(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        parts = [self._parts(c) for c in chunks]
        distinct = list({p for some in parts for p in some if isinstance(p, str)})
        ids = dict(zip(distinct, self.words([p.encode("utf-8", "replace") for p in distinct])))
        for at in self.special.values():
            ids[at] = at.to_bytes(4, "little")
        return self._in_a_row([b"".join([ids[p] for p in some]) for some in parts])

    @staticmethod
    def _in_a_row(codes: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(b"".join(codes), "<u4"), np.fromiter(map(len, codes), np.int64, len(codes)) >> 2

    def texts(self, texts: pa.StringArray) -> Iterator[np.ndarray]:
        """The ids of each text of a column without nulls."""
        ids, counts = self.encode(texts)
        ends = np.cumsum(counts)
        for end, n in zip(ends.tolist(), counts.tolist()):
            yield ids[end - n : end]

    def encode_text(self, text: str) -> list[int]:
        return next(self.texts(pa.array([text], pa.string()))).tolist()

    def decode(self, ids: Iterable[int]) -> str:
        """The pieces joined by spaces: the file names no decoder."""
        return self.joined(ids).decode()

    def joined(self, ids: Iterable[int]) -> bytes:
        return b" ".join(map(self.pieces.__getitem__, ids))


_loaded: dict[str, Bpe] = {}


def loaded(config: str) -> Bpe:
    """This worker's encoder for a tokenizer file's content."""
    key = hashlib.sha256(config.encode()).hexdigest()
    if key not in _loaded:
        _loaded[key] = Bpe(config)
    return _loaded[key]


def _shared(df: DataFrame, path: str | None):
    """The tokenizer file is read on the driver and broadcast: its size is fixed (under 2 MB)."""
    with open(path or default_path(), encoding="utf-8") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def _rows(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    return rows, rows.schema["id"].dataType.simpleString()


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id, ids array<int>) of every row."""
    rows, kind = _rows(docs, id_col, text_col)
    shared = _shared(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(shared.value)
        for batch in batches:
            for part in pieces(batch):
                ids = [found.astype(np.int32) for found in bpe.texts(part.column(1))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], [id_col, "ids"])

    return rows.mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """(id, text) from (id, ids array<int>); null ids decode to the empty text."""
    rows = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    shared = _shared(encoded, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(shared.value)
        for batch in batches:
            texts = [bpe.decode(x.as_py() or []) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [id_col, "text"])

    return rows.mapInArrow(run, f"`{id_col}` {rows.schema['id'].dataType.simpleString()}, text string")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): encoding and decoding in one pass, digested in the worker."""
    rows, kind = _rows(docs, id_col, text_col)
    shared = _shared(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(shared.value)
        for batch in batches:
            for part in pieces(batch):
                n, ids, decoded = [], [], []
                for found in bpe.texts(part.column(1)):
                    n.append(len(found))
                    ids.append(hashlib.sha256(found.data).hexdigest())
                    decoded.append(hashlib.sha256(bpe.joined(found.tolist())).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(ids), pa.array(decoded)], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    return rows.mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
