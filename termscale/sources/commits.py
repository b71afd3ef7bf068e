"""Folders whose content changes by commits: data is written aside first and becomes visible at once, or not at all.

A folder has data folders that never change, and manifests `_manifest/<version>` that list those that count. A commit makes
the next manifest, which fails if another writer has made it, and then starts again from that one. A job that was
committed is listed by its name, so a retry adds nothing. The file system must refuse to create a file that exists.
"""

import json
import uuid

from pyspark.sql import SparkSession

MANIFESTS = "_manifest"
#: How often a commit starts again after another writer.
ATTEMPTS = 20


class Folder:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._files = self._hadoop.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name):
        return self._hadoop.Path(f"{self.path}/{name}")

    def versions(self) -> list[int]:
        if not self._files.exists(self._at(MANIFESTS)):
            return []
        names = [status.getPath().getName() for status in self._files.listStatus(self._at(MANIFESTS))]
        return sorted(int(name) for name in names if name.isdigit())

    def entries(self, version: int = None) -> list[dict]:
        """What the last manifest, or the given one, lists: dicts with at least `job` and `folder`."""
        version = max(self.versions(), default=0) if version is None else version
        if not version:
            return []
        stream = self._files.open(self._at(f"{MANIFESTS}/{version:012d}"))
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def has(self, job: str) -> bool:
        return any(job in (entry["job"], *entry.get("jobs", ())) for entry in self.entries())

    def fresh(self, label: str) -> str:
        """The name of a new data folder."""
        return f"{label}-{uuid.uuid4().hex}"

    def commit(self, change) -> list[dict]:
        """Make `change(entries)` the content; it is called again on what another writer has committed in between.

        A change that gives None leaves the folder as it is.
        """
        for _ in range(ATTEMPTS):
            version = max(self.versions(), default=0)
            entries = self.entries(version)
            changed = change(entries)
            if changed is None:
                return entries
            if self._create(f"{MANIFESTS}/{version + 1:012d}", json.dumps(changed)):
                return changed
        raise RuntimeError(f"{self.path}: other writers were always faster")

    def _create(self, name, text) -> bool:
        """Whether the file was made; False if it is there. The text is written under another name first."""
        aside = self._at(f"{MANIFESTS}/.{uuid.uuid4().hex}")
        stream = self._files.create(aside, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        made = not self._files.exists(self._at(name)) and self._files.rename(aside, self._at(name))
        if not made:
            self._files.delete(aside, False)
        return made

    def drop_unlisted(self, keep_versions: int = 1) -> int:
        """Delete data folders that none of the last manifests lists, and older manifests; how many folders went.

        Only to be called while no job writes here: data that is not committed yet is not listed either.
        """
        versions = self.versions()
        kept = versions[-keep_versions:]
        listed = {entry["folder"] for version in kept for entry in self.entries(version)}
        gone = 0
        for status in self._files.listStatus(self._hadoop.Path(self.path)):
            name = status.getPath().getName()
            if status.isDirectory() and name != MANIFESTS and name not in listed:
                gone += self._files.delete(status.getPath(), True)
        for version in set(versions) - set(kept):
            self._files.delete(self._at(f"{MANIFESTS}/{version:012d}"), False)
        return gone
