"""Remote snapshots: a plan of what is to fetch, a check of free space, the fetch, and a record of it.

A source lists a revision's files and fetches them; what it talks to is its own matter.  ``FolderSource``
serves any store that Arrow opens and copies in tasks, so the driver holds names and sizes only.
"""

from __future__ import annotations

import hashlib
import os
import shutil
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass
from datetime import UTC, datetime
from fnmatch import fnmatch
from typing import Protocol
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import SparkSession

from finweave.errors import DownloadError, NoSpace
from finweave.sources import store
from finweave.sources.tables import canonical_json


@dataclass(frozen=True)
class RemoteFile:
    path: str
    size: int
    revision: str
    will_download: bool


@dataclass(frozen=True)
class Request:
    repo_id: str
    target: str
    manifest: str
    revision: str = "main"
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    reserve: int = 0

    def wants(self, path: str) -> bool:
        return (not self.include or any(fnmatch(path, p) for p in self.include)) and not any(fnmatch(path, p) for p in self.exclude)


@dataclass(frozen=True)
class Plan:
    repo_id: str
    requested_revision: str
    resolved_revision: str
    target: str
    file_count: int
    total_bytes: int
    files_to_download: int
    bytes_to_download: int


class Source(Protocol):
    def files(self, request: Request, revision: str) -> list[RemoteFile]: ...

    def fetch(self, request: Request, revision: str) -> None: ...


def plan(request: Request, source: Source) -> Plan:
    """Resolves the revision and adds up what is left to fetch; a listing of no or several revisions is an error."""
    try:
        found = source.files(request, request.revision)
    except OSError as error:
        raise DownloadError(f"the snapshot cannot be listed: {error}") from error
    revisions = {f.revision for f in found}
    if len(revisions) != 1:
        raise DownloadError(f"the listing has {len(revisions)} revisions")
    pending = [f for f in found if f.will_download]
    return Plan(request.repo_id, request.revision, revisions.pop(), request.target, len(found), sum(f.size for f in found), len(pending), sum(f.size for f in pending))


def free_bytes(path: str) -> int:
    os.makedirs(path, exist_ok=True)
    return shutil.disk_usage(path).free


def download(spark: SparkSession, request: Request, source: Source, dry_run: bool = False, free: Callable[[str], int] = free_bytes) -> Plan:
    """Plans, checks that the bytes fit beside the reserve, fetches the resolved revision, and records it."""
    made = plan(request, source)
    if dry_run:
        return made
    try:
        space = free(request.target)
        if space < made.bytes_to_download + request.reserve:
            raise NoSpace(made.bytes_to_download + request.reserve, space)
        source.fetch(request, made.resolved_revision)
    except OSError as error:
        raise DownloadError(f"the snapshot cannot be fetched: {error}") from error
    record = asdict(made) | {"status": "complete", "completed_at": datetime.now(UTC).isoformat()}
    store.write_bytes(spark, request.manifest, canonical_json(record).encode() + b"\n")
    return made


def _copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for source, target in zip(batch.column("source").to_pylist(), batch.column("target").to_pylist()):
            (a, inside), (b, out) = (pyarrow.fs.FileSystem.from_uri(quote(u, safe="/:@%+")) for u in (source, target))
            b.create_dir(out.rpartition("/")[0], recursive=True)
            # Beside its place and then moved, so a lost task leaves no half file.
            pyarrow.fs.copy_files(inside, f"{out}.part", source_filesystem=a, destination_filesystem=b)
            b.move(f"{out}.part", out)
        yield batch.select(["target"])


class FolderSource:
    """A folder as a snapshot; its revision is a digest of its names and sizes."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def files(self, request: Request, revision: str) -> list[RemoteFile]:
        fs, root = pyarrow.fs.FileSystem.from_uri(self.root)
        found = sorted((f.path[len(root) :].lstrip("/"), f.size) for f in fs.get_file_info(pyarrow.fs.FileSelector(root, recursive=True)) if f.is_file)
        resolved = hashlib.sha256("\n".join(f"{p} {n}" for p, n in found).encode()).hexdigest()
        if revision not in ("main", resolved):
            raise DownloadError(f"no revision {revision}")
        mine, target = pyarrow.fs.FileSystem.from_uri(request.target)
        wanted = [(p, n) for p, n in found if request.wants(p)]
        there = {f.path: f.size for f in mine.get_file_info([f"{target.rstrip('/')}/{p}" for p, _ in wanted]) if f.is_file} if wanted else {}
        return [RemoteFile(p, n, resolved, there.get(f"{target.rstrip('/')}/{p}") != n) for p, n in wanted]

    def fetch(self, request: Request, revision: str) -> None:
        rows = [(f"{self.root}/{f.path}", f"{request.target.rstrip('/')}/{f.path}") for f in self.files(request, revision) if f.will_download]
        if rows:
            listed = self.spark.createDataFrame(rows, "source string, target string").repartition(min(len(rows), 64))
            listed.mapInArrow(_copy, "target string").count()
