"""Token ids of texts by way of their chunks between white space, each encoded once and kept.

For tokenizers that compose and lower-case a text, drop its white space, and
have no rule that looks across it. Texts are cut, lower-cased and
dictionary-encoded as Arrow columns; the ids of known chunks lie in one array,
from which those of a column of texts are gathered.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space as Unicode has it; str.split() also splits at the four separators below.
SPACES = re.compile("[" + "".join(map(chr, [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])) + "]+")
SEPARATORS = "\x1c\x1d\x1e\x1f"
#: Words of lower-case letters that no version of Unicode disputes.
WORD = "[a-z\u00E0-\u00F6\u00F8-\u00FF]+"
#: A word and the signs after it; no apostrophe, which may open a contraction.
WORD_AND_SIGNS = re.compile("([a-z\u00E0-\u00F6\u00F8-\u00FF]+)([!-&(-/:-@\\[-`{-~]+)")
#: A comma or full stop at a chunk's end that does not follow a letter or digit, so that it belongs to a run of signs.
IN_RUN = "[^0-9a-z\u00E0-\u00F6\u00F8-\u00FF][,.](?: |$)"
#: What a text must not hold to be cut by ASCII white space and lower-cased as a whole.
UNUSUAL = "[\x1c-\x1f\u0085\u00A0\u0100-\U0010FFFF]|<\\|"
#: Bytes of text that are cut and encoded together; a worker's arrays for them take some twelve times as much.
PIECE = 1 << 21
#: Chunks that a worker's cache may hold, and bytes of text in them, before it starts anew.
CACHE, ROOM = 1 << 18, 1 << 24


def chunks_of(text: str) -> list[str]:
    """The chunks of a text between white space."""
    if any(c in text for c in SEPARATORS):
        return [c for c in SPACES.split(text) if c]
    return text.split()


def pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch cut so that the texts in column 1 of a piece have PIECE bytes together, or are one text."""
    sizes = np.cumsum(pc.binary_length(batch.column(1)).to_numpy().astype(np.int64))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + PIECE, side="right")))
        yield batch.slice(at, to - at)
        at = to


def byte_sum(texts: pa.StringArray) -> int:
    return pc.sum(pc.binary_length(texts)).as_py() or 0


class ChunkCache:
    """Known chunks and their ids; before they pass ``limit`` chunks or ``room`` bytes of text, all are forgotten."""

    def __init__(self, limit: int = CACHE, room: int = ROOM) -> None:
        self.limit, self.room = limit, room
        self._clear()

    def words_ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, ids of each) of words of plain lower-case letters."""
        raise NotImplementedError

    def others_ids(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, ids of each) of any other chunks."""
        raise NotImplementedError

    def _clear(self) -> None:
        #: The place of each known chunk in ``begins`` and ``sizes``: where its ids lie in ``known``.
        self.cache: dict[str, int] = {}
        self.held = 0
        self.begins = self.sizes = np.empty(0, np.int64)
        self.known = np.empty(0, "<u4")

    def _add(self, chunks: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        """Remember chunks whose ids follow each other in ``ids``."""
        self.cache.update(zip(chunks, range(len(self.sizes), len(self.sizes) + len(chunks))))
        self.begins = np.concatenate([self.begins, len(self.known) + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.known = np.concatenate([self.known, ids])

    def _take(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids at these places in a row, and where each place's ids end."""
        each = self.sizes[places]
        ends = np.cumsum(each)
        return self.known[np.repeat(self.begins[places] - (ends - each), each) + np.arange(ends[-1] if len(ends) else 0)], ends

    def _learn(self, new: pa.StringArray) -> None:
        """Encode chunks that the cache lacks."""
        plain = pc.match_substring_regex(new, f"^{WORD}$")
        listed, rest, signed = new.filter(plain).to_pylist(), [], []
        for chunk in new.filter(pc.invert(plain)).to_pylist():
            found = WORD_AND_SIGNS.fullmatch(chunk)
            if found:
                signed.append((chunk, *found.groups()))
            else:
                rest.append(chunk)
        listed += {head for _, head, _ in signed}.difference(self.cache, listed)
        rest += {tail for _, _, tail in signed}.difference(self.cache, rest)
        self._add(listed, *self.words_ids(listed))
        self._add(rest, *self.others_ids(rest))
        if signed:
            ids, ends = self._take(np.array([self.cache[part] for _, *both in signed for part in both]))
            self._add([chunk for chunk, *_ in signed], ids, np.diff(ends[1::2], prepend=0))

    def _joined(self, chunks: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, ids of each text) of texts given as lists of chunks."""
        coded = chunks.flatten().dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        places = np.fromiter(map(self.cache.get, distinct, repeat(-1)), np.int64, len(distinct))
        lacking = np.flatnonzero(places < 0)
        if len(lacking):
            new = coded.dictionary.take(pa.array(lacking))
            if len(self.cache) + len(new) > self.limit or self.held + byte_sum(new) > self.room:
                self._clear()
                lacking, new = np.arange(len(distinct)), coded.dictionary
            self.held += byte_sum(new)
            self._learn(new)
            places[lacking] = [self.cache[distinct[i]] for i in lacking.tolist()]
        ids, ends = self._take(places[coded.indices.to_numpy()])
        offsets = chunks.offsets.to_numpy() - chunks.offsets[0].as_py()
        return ids, np.diff(np.r_[0, ends][offsets])

    def encode(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, ids of each text) of a column without nulls.

        Within Latin-1 the lower case of a text is that of its letters, and its
        composition changes nothing; there, a comma or stop after a word is cut
        off, so that words with and without it are encoded once.
        """
        unusual = pc.match_substring_regex(texts, UNUSUAL)
        usual = pc.utf8_lower(texts.filter(pc.invert(unusual)))
        cut = pc.replace_substring(pc.replace_substring(usual, ", ", " , "), ". ", " . ")
        usual = pc.if_else(pc.match_substring_regex(usual, IN_RUN), usual, cut)
        ids, counts = self._joined(pc.ascii_split_whitespace(pc.ascii_trim_whitespace(usual)))
        if len(usual) == len(texts):
            return ids, counts
        others, more = self._joined(pa.array([chunks_of(t) for t in texts.filter(unusual).to_pylist()], pa.list_(pa.string())))
        parts = [np.split(x, np.cumsum(n)[:-1]) if len(n) else [] for x, n in ((ids, counts), (others, more))]
        turns = [iter(parts[0]), iter(parts[1])]
        ordered = [next(turns[flag]) for flag in unusual.to_pylist()]
        return np.concatenate(ordered), np.array(list(map(len, ordered)), np.int64)
