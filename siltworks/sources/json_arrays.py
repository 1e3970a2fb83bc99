"""Large JSON documents as rows: the objects in the arrays of a document's root, read by byte ranges.

A range can't tell by itself whether it begins inside a text, or how deep. So
each is scanned once under both assumptions, which gives a few numbers; those
are put in order, a row a range, and say how every range begins. A second scan
tells which array is open where a range ends, a third gives the objects that
begin in the range, reading on until the last one is closed. So a document of
any size is many tasks' work, and none holds more than a range and an object.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

from .archives import opened

#: Bytes of a range.
TARGET = 16 << 20
#: Ranges are dealt to at most so many tasks.
MAX_TASKS = 4096
RANGES = "chunk long, path string, begin long, stop long"


def structure(data: bytes, inside: bool) -> tuple[np.ndarray, np.ndarray, bool]:
    """(places, steps, inside): brackets outside texts, +1 or -1 for each, and whether ``data`` ends inside a text."""
    a = np.frombuffer(data, np.uint8)
    quotes = np.flatnonzero(a == ord('"'))
    plain = np.flatnonzero(a != ord("\\"))
    if len(plain) < len(a) and len(quotes):
        # a quote after an odd number of backslashes belongs to its text
        at = np.searchsorted(plain, quotes) - 1
        last = np.where(at >= 0, plain[at], -1)
        quotes = quotes[(quotes - last) % 2 == 1]
    # [ and { differ by one bit, as ] and } do
    folded = a | 32
    places = np.flatnonzero((folded == ord("{")) | (folded == ord("}")))
    places = places[(np.searchsorted(quotes, places) + inside) % 2 == 0]
    return places, np.where(folded[places] == ord("{"), 1, -1), bool((len(quotes) + inside) % 2)


def chunks(spark: SparkSession, paths: Sequence[str], target: int) -> list[tuple[int, str, int, int]]:
    """Byte ranges of the files, in order."""
    out = []
    for path in paths:
        fs, name = opened(path)
        info = fs.get_file_info(name)
        if info.type != pafs.FileType.File:
            raise ValueError(f"no file at {path}")
        out += [(len(out) + i, path, at, min(at + target, info.size)) for i, at in enumerate(range(0, info.size, target))]
    return out


def read_range(f, begin: int, stop: int) -> tuple[int, bytes]:
    """(begin, bytes) of a range, both ends moved on until no backslash lies before them."""

    def moved(at: int) -> int:
        while 0 < at < f.size():
            f.seek(at - 1)
            if f.read(1) != b"\\":
                break
            at += 1
        return at

    begin, stop = moved(begin), moved(stop)
    f.seek(begin)
    return begin, f.read(max(0, stop - begin))


def each_range(rows: DataFrame, work: Callable[..., Iterator[tuple]], schema: str) -> DataFrame:
    """``work(file, row, begin, data)`` on every range; it gives rows of ``schema``."""
    names = [part.split()[0] for part in schema.split(", ")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for row in part.itertuples():
                fs, name = opened(row.path)
                with fs.open_input_file(name) as f:
                    found = list(work(f, row, *read_range(f, row.begin, row.stop)))
                yield pd.DataFrame(found, columns=names)

    return rows.mapInPandas(run, schema)


def key_before(f, at: int) -> str | None:
    """The key whose value begins at a place."""
    reach = 4096
    f.seek(max(0, at - reach))
    m = re.search(rb'("(?:[^"\\]|\\.)*")\s*:\s*\Z', f.read(min(reach, at)))
    return json.loads(m[1]) if m else None


def levels(data: bytes, inside: bool, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, steps, depths): brackets and how deep it is after each."""
    places, steps, _ = structure(data, inside)
    return places, steps, depth + np.cumsum(steps)


def opens_second(data: bytes, places: np.ndarray, steps: np.ndarray, depths: np.ndarray) -> list[tuple[int, bool]]:
    """(place, whether it is an array) of what opens in the root object."""
    return [(int(p), data[p : p + 1] == b"[") for p in places[(steps == 1) & (depths == 2)]]


def summary(f, row, begin: int, data: bytes) -> Iterator[tuple]:
    _, out, odd = structure(data, False)
    _, within, _ = structure(data, True)
    lowest = lambda steps: int(np.cumsum(steps).min(initial=0))
    yield row.chunk, bool(odd), int(out.sum()), int(within.sum()), lowest(out), lowest(within)


def last_open(f, row, begin: int, data: bytes) -> Iterator[tuple]:
    places, steps, depths = levels(data, row.inside, row.depth)
    if any(data[p : p + 1] == b"[" for p in places[(steps == 1) & (depths == 1)]):
        raise ValueError(f"the root of {row.path} is no object")
    found = opens_second(data, places, steps, depths)
    if found:
        place, array = found[-1]
        yield row.chunk, key_before(f, begin + place) if array else None


def closed(f, at: int, piece: int = 1 << 20) -> bytes:
    """The object that begins at a place, however long it is."""
    f.seek(at)
    data = b""
    while True:
        more = f.read(max(piece, len(data)))
        if not more:
            raise ValueError(f"an object at {at} isn't closed")
        data += more
        places, _, depths = levels(data, False, 0)
        ends = places[depths == 0]
        if len(ends):
            return data[: ends[0] + 1]


def objects(f, row, begin: int, data: bytes) -> Iterator[tuple]:
    places, steps, depths = levels(data, row.inside, row.depth)
    opened_here = opens_second(data, places, steps, depths)
    keys = [row.section if isinstance(row.section, str) else None] + [key_before(f, begin + p) if array else None for p, array in opened_here]
    starts = places[(steps == 1) & (depths == 3)]
    ends = places[(steps == -1) & (depths == 2)]
    of = np.searchsorted([p for p, _ in opened_here], starts)
    till = np.searchsorted(ends, starts)
    for start, section, end in zip(starts, of, till):
        if keys[section] is None or data[start : start + 1] != b"{":
            continue
        text = data[start : ends[end] + 1] if end < len(ends) else closed(f, begin + int(start))
        yield row.path, keys[section], begin + int(start), text.decode("utf-8")


def elements(spark: SparkSession, paths: Sequence[str], target: int = TARGET) -> DataFrame:
    """(path, section, place, text): the objects in the arrays of the root object of each document.

    section: the array's key; place: the object's first byte. Other values of
    the root, and elements that aren't objects, have no row. A root that is no
    object, and one that isn't closed, are errors. On the driver a range has one row of five numbers.
    """
    found = chunks(spark, paths, target)
    if not found:
        return spark.createDataFrame([], "path string, section string, place long, text string")
    tasks = min(len(found), MAX_TASKS)
    ranges = spark.createDataFrame(found, RANGES).repartitionByRange(tasks, "chunk")
    told = {r[0]: r[1:] for r in each_range(ranges, summary, "chunk long, odd boolean, plain long, within long, plain_low long, within_low long").collect()}
    state, at = [], None
    for chunk, path, begin, stop in found:
        if path != at:
            inside, depth, at = False, 0, path
        state.append((chunk, path, begin, stop, inside, depth))
        odd, plain, within, plain_low, within_low = told[chunk]
        low = depth + (within_low if inside else plain_low)
        inside, depth = inside ^ odd, depth + (within if inside else plain)
        last = chunk + 1 == len(found) or found[chunk + 1][1] != path
        if low < 0 or last and (inside or depth):
            raise ValueError(f"{path} isn't a whole JSON document")
    known = spark.createDataFrame(state, RANGES + ", inside boolean, depth long").repartitionByRange(tasks, "chunk")
    opens = {r[0]: r[1] for r in each_range(known, last_open, "chunk long, section string").collect()}
    whole, section, at = [], None, None
    for row in state:
        section, at = (section if row[1] == at else None), row[1]
        whole.append((*row, section))
        section = opens.get(row[0], section)
    whole = spark.createDataFrame(whole, RANGES + ", inside boolean, depth long, section string").repartitionByRange(tasks, "chunk")
    return each_range(whole, objects, "path string, section string, place long, text string")


def digests(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(path, sha256) of whole files, read in pieces; a file is one task's."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path in part["path"]:
                fs, name = opened(path)
                digest = hashlib.sha256()
                with fs.open_input_stream(name) as f:
                    while piece := f.read(1 << 20):
                        digest.update(piece)
                yield pd.DataFrame({"path": [path], "sha256": [digest.hexdigest()]})

    rows = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, min(len(paths), MAX_TASKS)), "path")
    return rows.mapInPandas(run, "path string, sha256 string")
