"""Durable metadata: one versioned JSON manifest that names every current file.

Data files are never changed; a commit writes the next manifest under a temporary name and renames it into place. Until
that rename nothing has happened, after it everything has, so a failure at any point leaves the last committed state.

Of two writers one commits and the other is told so: local file systems, HDFS and ABFS refuse a rename onto a file that is
there. Object stores copy instead; there the manifest is created in place, only if absent, and appears whole when it is
closed. That is safe on stores that write conditionally (for s3a: fs.s3a.create.conditional.enabled); on others use one writer.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

from driftwell.plans.errors import StateError
from driftwell.session import file_system

_PREFIX, _SUFFIX = "manifest-", ".json"
#: Schemes of file systems whose rename refuses a target that is there.
_RENAMING = ("file", "hdfs", "viewfs", "abfs", "abfss")


class Store:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.fs, self.at = file_system(spark, self.root)
        self.fs.mkdirs(self.at)
        self.version = 0

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def exists(self, path: str) -> bool:
        return bool(self.fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(path)))

    def children(self, path: str) -> list[str]:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return [s.getPath().getName() for s in self.fs.listStatus(at)] if self.fs.exists(at) else []

    def remove(self, path: str) -> None:
        self.fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(path), True)

    def fresh(self, name: str) -> str:
        """A path nobody has used."""
        return f"{self.root}/data/{name}-{uuid.uuid4().hex}"

    def load(self) -> dict:
        """The newest manifest, or an empty one."""
        found = sorted(n for n in self.children(self.root) if n.startswith(_PREFIX) and n.endswith(_SUFFIX))
        if not found:
            self.version = 0
            return {"tables": {}, "views": {}}
        self.version = int(found[-1][len(_PREFIX) : -len(_SUFFIX)])
        stream = self.fs.open(self._path(found[-1]))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def commit(self, manifest: dict) -> None:
        """Make *manifest* the current state, unless another writer has committed since it was loaded."""
        target = self._path(f"{_PREFIX}{self.version + 1:012d}{_SUFFIX}")
        if self.fs.exists(target):
            raise StateError("another writer has committed; reopen the engine")
        renames = self.fs.getUri().getScheme() in _RENAMING
        draft = self._path(f"draft-{uuid.uuid4().hex}") if renames else target
        try:
            out = self.fs.create(draft, False)
            out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
            out.close()
        except Py4JJavaError as e:
            if renames:
                raise
            raise StateError("another writer has committed; reopen the engine") from e
        if renames and not self.fs.rename(draft, target):
            self.fs.delete(draft, False)
            raise StateError("another writer has committed, or the manifest could not be renamed; reopen the engine")
        self.version += 1
        old = self._path(f"{_PREFIX}{self.version - 5:012d}{_SUFFIX}")
        self.fs.delete(old, False)
