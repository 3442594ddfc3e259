"""Artifacts: canonical JSON, self-hashed manifests, resumable feature tables, any Hadoop file system."""

from __future__ import annotations

import dataclasses
import datetime
import hashlib
import json
import math
import re
import uuid
from collections.abc import Iterable, Mapping
from pathlib import PurePath

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.checks import frame_difference, require_none

HASH = "manifest_sha256"
VERSION = 1
#: Bytes of a file that the driver holds at once.
PIECE = 1 << 20


class IntegrityError(RuntimeError):
    """A stored artifact isn't what its manifest says."""


def plain(value: object) -> object:
    """value as JSON knows it: records as mappings, sets sorted, non-finite numbers null."""
    if dataclasses.is_dataclass(value) and not isinstance(value, type):
        return plain(dataclasses.asdict(value))
    if isinstance(value, Mapping):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, (set, frozenset)):
        return [plain(v) for v in sorted(value, key=repr)]
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    if isinstance(value, np.ndarray):
        return plain(value.tolist())
    if isinstance(value, np.generic):
        return plain(value.item())
    if isinstance(value, PurePath):
        return str(value)
    if isinstance(value, (datetime.date, datetime.datetime)):
        return value.isoformat()
    if isinstance(value, float) and not math.isfinite(value):
        return None
    if value is None or isinstance(value, (bool, int, float, str)):
        return value
    if type(value).__name__ in ("NAType", "NaTType"):
        return None
    raise TypeError(f"{type(value).__name__} has no JSON form")


def canonical(value: object) -> bytes:
    return json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False).encode()


def json_digest(value: object) -> str:
    return hashlib.sha256(canonical(value)).hexdigest()


def canonical_newlines(data: bytes) -> str:
    """SHA-256 of bytes with CRLF as LF; a lone CR stays."""
    return hashlib.sha256(data.replace(b"\r\n", b"\n")).hexdigest()


def file_digest(spark: SparkSession, path: str) -> str:
    """SHA-256 of a file of any size, streamed by the JVM."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(spark._jsc.hadoopConfiguration()).open(where)
    try:
        return spark._jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex(stream)
    finally:
        stream.close()


def canonical_digest(spark: SparkSession, path: str) -> str:
    """SHA-256 of a file, or of a folder's files in order, with CRLF as LF; read in pieces of PIECE bytes."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    parts = [where] if files.getFileStatus(where).isFile() else sorted((x.getPath() for x in files.listStatus(where) if x.isFile()), key=lambda p: p.getName())
    whole, streams = hashlib.sha256(), spark._jvm.org.apache.commons.io
    for part in parts:
        stream = files.open(part)
        try:
            rest = b""
            while piece := bytes(streams.IOUtils.toByteArray(streams.input.BoundedInputStream(stream, PIECE))):
                piece = rest + piece
                rest = b"\r" if piece.endswith(b"\r") else b""  # its LF may begin the next piece
                whole.update(piece[: len(piece) - len(rest)].replace(b"\r\n", b"\n"))
            whole.update(rest)
        finally:
            stream.close()
    return whole.hexdigest()


def file_digests(spark: SparkSession, root: str, paths: list[str]) -> dict[str, str]:
    """SHA-256 of files, by their path below ``root``; a file elsewhere is an error."""
    whole = f"{root.rstrip('/')}/"
    found = {}
    for path in paths:
        if not path.startswith(whole):
            raise ValueError(f"{path} is not below {root}")
        found[path.removeprefix(whole)] = file_digest(spark, path)
    return dict(sorted(found.items()))


def sealed(manifest: Mapping) -> dict:
    """A manifest with the hash of all its other fields."""
    body = {k: v for k, v in plain(manifest).items() if k != HASH}
    return body | {HASH: json_digest(body)}


def check_seal(manifest: Mapping) -> dict:
    body = {k: v for k, v in manifest.items() if k != HASH}
    if manifest.get(HASH) != json_digest(body):
        raise IntegrityError("a manifest's hash doesn't match its content")
    return dict(manifest)


def is_subset(expected: object, actual: object) -> bool:
    """Whether every expected key is there with the expected value, at all depths."""
    if isinstance(expected, Mapping):
        return isinstance(actual, Mapping) and all(k in actual and is_subset(v, actual[k]) for k, v in expected.items())
    return expected == actual


def safe_name(name: str) -> str:
    base = re.sub(r"[^A-Za-z0-9_.-]", "_", name).strip("._")
    return base if base == name else f"{base}-{hashlib.sha256(name.encode()).hexdigest()[:10]}"


class Store:
    """Small files on the file system of a path, whatever Hadoop calls it."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.verified: set[tuple[str, str]] = set()
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def at(self, name: str) -> str:
        return f"{self.root}/{name}"

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(self.at(name)))

    def names(self, folder: str = "") -> list[str]:
        where = self._path(self.at(folder) if folder else self.root)
        return sorted(x.getPath().getName() for x in self._fs.listStatus(where)) if self._fs.exists(where) else []

    def read(self, name: str) -> bytes:
        stream = self._fs.open(self._path(self.at(name)))
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def write(self, name: str, data: bytes) -> None:
        """Write beside the name, then rename: a reader sees the old file or the whole new one."""
        fresh = self._path(f"{self.at(name)}.{uuid.uuid4().hex}.tmp")
        stream = self._fs.create(fresh, True)
        try:
            stream.write(data)
            stream.hsync()
        finally:
            stream.close()
        jvm = self.spark._jvm
        options = jvm.org.apache.hadoop.fs.Options
        over = self.spark.sparkContext._gateway.new_array(options.Rename, 1)
        over[0] = options.Rename.OVERWRITE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        context.rename(self._fs.makeQualified(fresh), self._fs.makeQualified(self._path(self.at(name))), over)

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(self.at(name)), True)

    def write_json(self, name: str, value: object) -> None:
        self.write(name, (json.dumps(plain(value), sort_keys=True, indent=2, ensure_ascii=False) + "\n").encode())

    def read_json(self, name: str) -> dict:
        found = json.loads(self.read(name))
        return check_seal(found) if HASH in found else found

    def write_manifest(self, name: str, value: Mapping) -> dict:
        held = sealed(value)
        self.write_json(name, held)
        return held

    def read_manifest(self, name: str) -> dict:
        return check_seal(json.loads(self.read(name)))


def content(df: DataFrame, *by: Column) -> DataFrame:
    """(by..., rows, digest): the size of a table and a digest of its rows in any order."""
    row = F.xxhash64(*[F.col(c) for c in sorted(df.columns)])
    both = F.concat_ws(":", F.count("*").cast("string"), F.coalesce(F.bit_xor(row), F.lit(0)).cast("string"), F.coalesce(F.sum(row.cast("decimal(38,0)")), F.lit(0)).cast("string"))
    return df.groupBy(*by).agg(F.count("*").alias("rows"), F.sha2(both, 256).alias("digest"))


class FeatureTable:
    """A feature table that grows by batches; a batch counts once its manifest is there.

    One Parquet folder a batch, not one file a response. The manifest, written last, lists the responses,
    rows, columns and a content digest, and what the features depend on.
    """

    def __init__(self, store: Store, folder: str, depends: Mapping):
        self.store, self.folder, self.depends = store, folder, plain(depends)

    def _manifests(self) -> dict[str, dict]:
        found = {}
        for name in self.store.names(self.folder):
            if name.endswith(".manifest.json"):
                try:
                    manifest = self.store.read_manifest(f"{self.folder}/{name}")
                except (IntegrityError, ValueError):
                    continue
                if is_subset({"depends": self.depends}, manifest):
                    found[name.removesuffix(".manifest.json")] = manifest
        return found

    def append(self, df: DataFrame, split: str) -> dict | None:
        """Write a batch and publish it; nothing is published for an empty one."""
        batch = f"{split}-{uuid.uuid4().hex}"
        path = self.store.at(f"{self.folder}/{batch}")
        df.write.option("compression", "zstd").parquet(path)
        kept = df.sparkSession.read.parquet(path)
        rows, digest = kept.transform(content).first()
        if not rows:
            self.store.delete(f"{self.folder}/{batch}")
            return None
        artifact = {"rows": rows, "digest": digest, "columns": kept.columns}
        return self.store.write_manifest(f"{self.folder}/{batch}.manifest.json", {"version": VERSION, "split": split, "depends": self.depends, "artifact": artifact})

    def read(self, *splits: str, verify: bool = True) -> DataFrame | None:
        """All complete batches of the splits in one scan; null if there are none.

        The rows of each batch are held against its manifest, once for a store: changed Parquet under
        an intact manifest is an error. All batches are checked in one scan.
        """
        chosen = {b: m for b, m in self._manifests().items() if m["split"] in splits}
        if not chosen:
            return None
        columns = {tuple(m["artifact"]["columns"]) for m in chosen.values()}
        if len(columns) > 1:
            raise IntegrityError("batches differ in their columns")
        if verify:
            self._verify({b: m for b, m in chosen.items() if (b, m[HASH]) not in self.store.verified})
        return self._scan(chosen)

    def _scan(self, batches: Iterable[str]) -> DataFrame:
        return self.store.spark.read.parquet(*[self.store.at(f"{self.folder}/{b}") for b in sorted(batches)])

    def _verify(self, batches: dict[str, dict]) -> None:
        if not batches:
            return
        rows = self._scan(batches)
        if rows.columns != next(iter(batches.values()))["artifact"]["columns"]:
            raise IntegrityError("a batch's columns aren't those of its manifest")
        of = F.element_at(F.split("_metadata.file_path", "/"), -2).alias("batch")
        found = {r["batch"]: (r["rows"], r["digest"]) for r in content(rows, of).collect()}
        for batch, manifest in batches.items():
            if found.get(batch) != (manifest["artifact"]["rows"], manifest["artifact"]["digest"]):
                raise IntegrityError(f"{batch} isn't what its manifest says")
            self.store.verified.add((batch, manifest[HASH]))

    def pending(self, examples: DataFrame, split: str) -> DataFrame:
        """Examples without complete features of this version."""
        done = self.read(split)
        return examples if done is None else examples.join(done.select("response_id").distinct(), "response_id", "left_anti")

    def require(self, examples: DataFrame, split: str) -> DataFrame:
        """The features of all examples, or an error that counts those missing and names five."""
        gone = self.pending(examples.select("response_id"), split)
        if count := gone.count():
            first = [r[0] for r in gone.orderBy("response_id").limit(5).collect()]
            raise IntegrityError(f"{count} responses have no features in {split}: {', '.join(first)}")
        return self.read(split)

    def fingerprint(self, *splits: str) -> str:
        """A digest over the artifacts of all complete batches."""
        return json_digest(sorted((m["artifact"]["digest"], m["artifact"]["rows"]) for m in self._manifests().values() if m["split"] in splits))


def migrate(store: Store, folder: str, depends: Mapping, apply: bool = False, proof: FeatureTable | None = None) -> list[str]:
    """Adopt intact batches whose manifests name other dependencies; a dry run unless ``apply``.

    Every batch is read and checked first. ``proof`` holds features of some of the same responses,
    extracted under the new dependencies: the rows of both must be equal. Old manifests stay beside the
    new ones as .bak.
    """
    adopted = []
    for name in store.names(folder):
        if not name.endswith(".manifest.json"):
            continue
        manifest = store.read_manifest(f"{folder}/{name}")
        if is_subset({"depends": plain(depends)}, manifest):
            continue
        rows = store.spark.read.parquet(store.at(f"{folder}/{name.removesuffix('.manifest.json')}"))
        if content(rows).first()["digest"] != manifest["artifact"]["digest"]:
            raise IntegrityError(f"{name} doesn't match its rows")
        if proof is not None and (fresh := proof.read(manifest["split"])) is not None:
            same = rows.join(fresh.select("response_id").distinct(), "response_id", "left_semi")
            fresh = fresh.join(rows.select("response_id").distinct(), "response_id", "left_semi")
            require_none(frame_difference(same, fresh.select(*rows.columns)).select("side", "response_id"), f"{name}: rows differ")
        adopted.append(name)
    for name in adopted if apply else []:
        old = store.read(f"{folder}/{name}")
        store.write(f"{folder}/{name}.bak", old)
        store.write_manifest(f"{folder}/{name}", json.loads(old) | {"depends": plain(depends)})
    return adopted


def markdown(rows: list[Mapping], columns: list[str]) -> str:
    """A Markdown table; pipes are escaped, line feeds become spaces, missing values are empty."""
    cell = lambda v: "" if v is None or isinstance(v, float) and math.isnan(v) else str(v).replace("|", "\\|").replace("\n", " ")
    lines = [columns, ["---"] * len(columns), *[[cell(r[c]) for c in columns] for r in rows]]
    return "".join(f"| {' | '.join(line)} |\n" for line in lines)


def write_results(store: Store, folder: str, metrics: DataFrame, metadata: Mapping, title: str) -> None:
    """A small metric table as JSON with metadata, CSV and Markdown, and as Parquet."""
    import csv
    import io

    rows = [r.asDict() for r in metrics.collect()]
    store.write_json(f"{folder}/metrics.json", {"metadata": plain(metadata), "metrics": rows})
    text = io.StringIO()
    writer = csv.DictWriter(text, metrics.columns)
    writer.writeheader()
    writer.writerows(rows)
    store.write(f"{folder}/metrics.csv", text.getvalue().encode())
    store.write(f"{folder}/report.md", f"# {title}\n\n{markdown(rows, metrics.columns)}".encode())
    metrics.write.mode("overwrite").parquet(store.at(f"{folder}/metrics.parquet"))
