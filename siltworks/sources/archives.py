"""ZIP archives as a data source: members read by ranges of the central directory, packages written with a manifest.

``register(spark)`` adds both formats. ``zip_members`` reads: each task opens an
archive, seeks to its range of members and inflates only those, so an archive
of any size is spread over tasks. ``zip_package`` writes: each task streams its
rows into an archive of its own, and the commit on the driver puts one manifest
in place that names the archives of successful tasks. What a failed or repeated
task left is named by no manifest, and so is never read.

Paths: local or mounted folders, or any store that pyarrow opens by its URI.
"""

from __future__ import annotations

import hashlib
import io
import json
import re
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import Row, StructType

MEMBERS = "archive string, split string, kind string, name string, content binary"
PATTERN = r"([^/]+)/(images|labels)/([^/]+)$"
#: Inflated bytes that one task is meant to read; members larger than MOST are refused.
TARGET, MOST = 64 << 20, 50_000_000
MANIFEST = "manifest.json"


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path and the path in it."""
    return pafs.FileSystem.from_uri(path) if re.match("[a-z0-9]+:/", path) else (pafs.LocalFileSystem(), path)


class Seekable(io.RawIOBase):
    """A file of pyarrow whose seeks to before its start fail with OSError, as those of Python's files do.

    zipfile relies on that: it looks for a record of 64-bit sizes before the end
    record, and an archive without members begins with its end record.
    """

    def __init__(self, f: pa.NativeFile) -> None:
        self.f = f

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def seek(self, offset: int, whence: int = 0) -> int:
        at = offset + (0, self.f.tell(), self.f.size())[whence]
        if at < 0:
            raise OSError("seek to before the start")
        return self.f.seek(min(at, self.f.size()))

    def tell(self) -> int:
        return self.f.tell()

    def readinto(self, out) -> int:
        data = self.f.read(len(out))
        out[: len(data)] = data
        return len(data)


@contextmanager
def unzipped(fs: pafs.FileSystem, archive: str) -> Iterator[zipfile.ZipFile]:
    with fs.open_input_file(archive) as f, zipfile.ZipFile(io.BufferedReader(Seekable(f), 1 << 16)) as z:
        yield z


def listed(path: str) -> list[str]:
    """The archives at a path: those of its manifest if it is a package, else its *.zip files, or itself."""
    fs, folder = opened(path)
    if fs.get_file_info(folder).type == pafs.FileType.File:
        return [folder]
    found = fs.get_file_info(pafs.FileSelector(folder, recursive=True))
    if any(f.path == f"{folder}/{MANIFEST}" for f in found):
        with fs.open_input_stream(f"{folder}/{MANIFEST}") as f:
            return [f"{folder}/{x['file']}" for x in json.loads(f.read())["archives"]]
    return sorted(f.path for f in found if f.type == pafs.FileType.File and f.path.lower().endswith(".zip"))


@dataclass
class Range(InputPartition):
    """Members ``first`` to before ``end`` of an archive, counted in its central directory."""

    archive: str
    first: int
    end: int


class MemberReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.pattern = options["path"], options.get("pattern", PATTERN)
        self.target, self.most = int(options.get("target", TARGET)), int(options.get("most", MOST))

    def partitions(self) -> list[Range]:
        """Ranges of about ``target`` inflated bytes; a part of the directory that holds nothing wanted is in some range too."""
        fs, out = opened(self.path)[0], []
        for archive in listed(self.path):
            with unzipped(fs, archive) as z:
                first = size = i = 0
                for i, info in enumerate(z.infolist(), 1):
                    size += info.file_size
                    if size >= self.target:
                        out.append(Range(archive, first, i))
                        first, size = i, 0
                if first < i:
                    out.append(Range(archive, first, i))
        return out

    def read(self, partition: Range) -> Iterator[tuple]:
        if partition is None:
            return
        with unzipped(opened(self.path)[0], partition.archive) as z:
            for info in z.infolist()[partition.first : partition.end]:
                m = re.search(self.pattern, info.filename)
                if not m or info.is_dir() or ".." in info.filename.split("/"):
                    continue
                if info.file_size > self.most:
                    raise ValueError(f"{info.filename} is too large")
                yield partition.archive, "val" if m[1] == "valid" else m[1], m[2], m[3], z.read(info)


class ZipMembers(DataSource):
    """Options: path, pattern (three groups: split, kind, name), target, most."""

    @classmethod
    def name(cls) -> str:
        return "zip_members"

    def schema(self) -> str:
        return MEMBERS

    def reader(self, schema: StructType) -> MemberReader:
        return MemberReader(dict(self.options))


@dataclass
class Written(WriterCommitMessage):
    """What a task wrote: its archive (or none), its list of members with that list's digest, and how many it skipped."""

    archive: str | None
    members: int
    bytes: int
    sha256: str
    skipped: dict[str, int]


class PackageWriter(DataSourceWriter):
    """Rows of name, content and anything else. A row with a null content, or whose bytes don't have their ``sha256``, is skipped with a reason."""

    def __init__(self, schema: StructType, options: dict) -> None:
        if not {"name", "content"} <= set(schema.names):
            raise ValueError("a package needs the columns name and content")
        self.names, self.path = list(schema.names), options["path"]
        fs, folder = opened(self.path)
        if fs.get_file_info(f"{folder}/{MANIFEST}").type != pafs.FileType.NotFound:
            raise ValueError(f"{self.path} holds a package already")

    def problem(self, row: Row) -> str | None:
        if not row["name"] or ".." in row["name"].split("/") or row["name"].startswith("/"):
            return "unsafe_name"
        if row["content"] is None:
            return "missing"
        if "sha256" in self.names and hashlib.sha256(row["content"]).hexdigest() != row["sha256"]:
            return "changed"
        return None

    def write(self, iterator: Iterator[Row]) -> Written:
        fs, folder = opened(self.path)
        fs.create_dir(folder, recursive=True)
        name, members, size, skipped, digest = f"part-{uuid.uuid4().hex}", 0, 0, {}, hashlib.sha256()
        with fs.open_output_stream(f"{folder}/{name}.zip") as out, fs.open_output_stream(f"{folder}/{name}.jsonl") as log:
            with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
                for row in iterator:
                    record = {c: row[c] for c in self.names if c != "content"}
                    reason = self.problem(row)
                    if reason:
                        skipped[reason] = skipped.get(reason, 0) + 1
                        record["skipped"] = reason
                    else:
                        z.writestr(zipfile.ZipInfo(row["name"]), bytes(row["content"]), zipfile.ZIP_DEFLATED)
                        record |= {"archive": f"{name}.zip", "bytes": len(row["content"]), "sha256": hashlib.sha256(row["content"]).hexdigest()}
                        members, size = members + 1, size + len(row["content"])
                    line = (json.dumps(record, sort_keys=True, default=str) + "\n").encode()
                    digest.update(line)
                    log.write(line)
        return Written(name, members, size, digest.hexdigest(), skipped)

    def commit(self, messages: list[Written | None]) -> None:
        """Put the manifest in place: archives, their lists and digests, sums, and the package's identity."""
        fs, folder = opened(self.path)
        done = sorted((m for m in messages if m is not None), key=lambda m: m.archive)
        skipped: dict[str, int] = {}
        for m in done:
            for reason, n in m.skipped.items():
                skipped[reason] = skipped.get(reason, 0) + n
        whole = {
            "status": "complete", "members": sum(m.members for m in done), "bytes": sum(m.bytes for m in done), "skipped": skipped,
            "archives": [{"file": f"{m.archive}.zip", "list": f"{m.archive}.jsonl", "list_sha256": m.sha256, "members": m.members} for m in done],
            "identity": hashlib.sha256("\n".join(sorted(m.sha256 for m in done)).encode()).hexdigest(),
        }
        fs.create_dir(folder, recursive=True)
        with fs.open_output_stream(f"{folder}/{MANIFEST}.{self.key()}") as out:
            out.write(json.dumps(whole, sort_keys=True).encode())
        fs.move(f"{folder}/{MANIFEST}.{self.key()}", f"{folder}/{MANIFEST}")

    def key(self) -> str:
        return hashlib.sha256(self.path.encode()).hexdigest()[:8]

    def abort(self, messages: list[Written | None]) -> None:
        """Remove what tasks reported; what others left is in no manifest. A failure record stays in its place."""
        fs, folder = opened(self.path)
        for m in messages:
            for suffix in (".zip", ".jsonl"):
                if m is not None and fs.get_file_info(f"{folder}/{m.archive}{suffix}").type == pafs.FileType.File:
                    fs.delete_file(f"{folder}/{m.archive}{suffix}")
        fs.create_dir(folder, recursive=True)
        with fs.open_output_stream(f"{folder}/failure.json") as out:
            out.write(json.dumps({"status": "failed", "finished_tasks": sum(m is not None for m in messages)}).encode())


class ZipPackage(DataSource):
    """Option: path, a folder without a package."""

    @classmethod
    def name(cls) -> str:
        return "zip_package"

    def writer(self, schema: StructType, overwrite: bool) -> PackageWriter:
        if overwrite:
            raise ValueError("a package is never overwritten")
        return PackageWriter(schema, dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ZipMembers)
    spark.dataSource.register(ZipPackage)


def members(spark: SparkSession, path: str, **options) -> DataFrame:
    """(archive, split, kind, name, content) of the members that match, read by ranges."""
    register(spark)
    return spark.read.format("zip_members").options(path=path, **options).load()


def paired(found: DataFrame) -> DataFrame:
    """(split, stem, image, label): images beside the label texts of one stem; either is null where it is missing."""
    from pyspark.sql import functions as F

    stem = F.regexp_replace("name", r"\.[^.]*$", "")
    of = lambda kind, name, value: found.where(F.col("kind") == kind).select("split", stem.alias("stem"), value.alias(name))
    return of("images", "image", F.col("content")).join(of("labels", "label", F.decode("content", "utf-8")), ["split", "stem"], "full_outer")


def write_package(rows: DataFrame, path: str) -> None:
    """Write rows (name, content and more) as a package; an existing one is an error."""
    register(rows.sparkSession)
    rows.write.format("zip_package").mode("append").option("path", path).save()


def package_list(spark: SparkSession, path: str, fields: str) -> tuple[DataFrame, dict]:
    """(records, manifest): the lists of a package's members and skipped rows, and its manifest. fields: their schema."""
    fs, folder = opened(path)
    if fs.get_file_info(f"{folder}/{MANIFEST}").type == pafs.FileType.NotFound:
        raise ValueError(f"no package at {path}")
    with fs.open_input_stream(f"{folder}/{MANIFEST}") as f:
        manifest = json.loads(f.read())
    lists = [f"{path}/{x['list']}" for x in manifest["archives"]]
    return (spark.read.schema(fields).json(lists) if lists else spark.createDataFrame([], fields)), manifest
