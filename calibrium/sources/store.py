"""Content-addressed artefacts in a folder of any Hadoop file system: written once, verified when read."""

from __future__ import annotations

import hashlib
import uuid
from typing import Any

from pyspark.sql import SparkSession

from ..functions.identity import canonical_json
from .strict_json import parse


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share, under spark.checkpoint.dir.

    Only a local master, where one machine is all there is, does without that
    setting; elsewhere that is a ValueError.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        base = "file:///tmp/calibrium"
    return f"{base.rstrip('/')}/calibrium-{name}-{uuid.uuid4().hex}"


class StoreError(Exception):
    """An artefact is absent, damaged or another one than asked for."""


def fingerprint(value: Any) -> str:
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()


class Files:
    """Small texts by URI, through the session's Hadoop configuration, so in whatever store the cluster shares."""

    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _at(self, uri: str):
        path = self.jvm.org.apache.hadoop.fs.Path(uri)
        return path.getFileSystem(self.conf), path

    def state(self, uri: str) -> str:
        """ABSENT, PRESENT or DAMAGED (there, but no file, or below something that is no folder)."""
        fs, path = self._at(uri)
        parent = path.getParent()
        while parent is not None and not fs.exists(parent):
            parent = parent.getParent()
        if parent is not None and not fs.getFileStatus(parent).isDirectory():
            return "DAMAGED"
        if not fs.exists(path):
            return "ABSENT"
        return "PRESENT" if fs.getFileStatus(path).isFile() else "DAMAGED"

    def read(self, uri: str) -> str:
        fs, path = self._at(uri)
        stream = fs.open(path)
        try:
            return bytes(stream.readAllBytes()).decode("utf-8")
        finally:
            stream.close()

    def publish(self, uri: str, text: str) -> None:
        """Write beside the target, flush, and rename over it: readers see the old text or the new."""
        fs, path = self._at(uri)
        fs.mkdirs(path.getParent())
        fresh = self.jvm.org.apache.hadoop.fs.Path(path.getParent(), f".new-{uuid.uuid4().hex}")
        try:
            out = fs.create(fresh, False)
            out.write(bytearray(text.encode("utf-8")))
            out.hsync()
            out.close()
            context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), self.conf)
            options = self.jvm.java.lang.reflect.Array.newInstance(self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 1)
            options[0] = self.jvm.org.apache.hadoop.fs.Options.Rename.valueOf("OVERWRITE")
            context.rename(fs.makeQualified(fresh), fs.makeQualified(path), options)
        except BaseException:
            fs.delete(fresh, False)
            raise

    def names(self, uri: str) -> list[str]:
        """Names in a folder, in order; none where there is no folder."""
        fs, path = self._at(uri)
        return sorted(x.getPath().getName() for x in fs.listStatus(path)) if fs.exists(path) else []


class ArtefactStore:
    """Profiles, catalogues and other small artefacts, by fingerprint and version."""

    def __init__(self, spark: SparkSession, folder: str):
        self.files, self.folder = Files(spark), folder.rstrip("/")

    def path(self, fp: str, version: int = 1) -> str:
        return f"{self.folder}/v{version}/{fp[:2]}/{fp}.json"

    def put(self, artefact: dict[str, Any], version: int = 1) -> str:
        """Idempotent: what is there already is verified, not overwritten."""
        fp = fingerprint(artefact)
        if self.files.state(self.path(fp, version)) == "ABSENT":
            self.files.publish(self.path(fp, version), canonical_json(artefact))
        else:
            self.get(fp, version)
        return fp

    def get(self, fp: str, version: int = 1) -> dict[str, Any]:
        state = self.files.state(self.path(fp, version))
        if state != "PRESENT":
            raise StoreError(f"{fp}: {state.lower()}")
        try:
            artefact = parse(self.files.read(self.path(fp, version)))
        except ValueError as e:
            raise StoreError(f"{fp}: {e}") from e
        if fingerprint(artefact) != fp:
            raise StoreError(f"{fp}: its content has another fingerprint")
        return artefact

    def told(self, fp: str, version: int = 1) -> str:
        """`read`, or why there is nothing to read."""
        try:
            self.get(fp, version)
        except StoreError as e:
            return str(e).partition(": ")[2]
        return "read"
