"""The persisted index: immutable segments and a manifest for each version.

A document's content is a *revision*.  `postings` (token, rev, bucket) are only ever appended, in
folders by token bucket and sorted by token, so a lookup reads one bucket's files and skips row
groups by their bounds.  `names` (path_key, rev, seq, live) are appended too; the latest row of a
path says which revision it shows, if any.  So changing, deleting or renaming a document writes a
few name rows and the new revision's postings, never old ones; `compact` rewrites what is live.

A version is one manifest file listing its segments, created last and never overwritten: readers see
a whole version or the one before, of two writers the second is told (`Conflict`), and a job that
died leaves only files that no manifest names, which `vacuum` deletes.
"""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POSTINGS = "token string, rev string, bucket int"
NAMES = "path_key string, path string, folder_key string, name string, rev string, seq long, live boolean"


class Conflict(RuntimeError):
    """Another writer was first; read the new version and try again."""


class Store:
    def __init__(self, spark: SparkSession, root: str, buckets: int = 16):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.root}/manifests"))

    # -- versions

    def version(self) -> int:
        found = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.root}/manifests"))]
        return max((int(f[:12]) for f in found if f.endswith(".json")), default=0)

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if not version:
            return {"postings": [], "names": [], "seq": 0}
        stream = self._fs.open(self._path(f"{self.root}/manifests/{version:012d}.json"))
        try:
            raw = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        try:
            return json.loads(raw)
        except ValueError:  # still being written
            return self.manifest(version - 1)

    def publish(self, manifest: dict, after: int | None = None) -> int:
        """Makes a new version visible at once; raises if another writer has published since `after`.

        The version's file is created without overwriting, which file systems and object stores do
        as one act; a reader that meets it half written reads the version before.
        """
        version = (self.version() if after is None else after) + 1
        path = self._path(f"{self.root}/manifests/{version:012d}.json")
        if self._fs.getScheme() == "file":  # a local file system checks and creates in two acts: a hard link is one
            return self._publish_local(manifest, version, path)
        try:
            out = self._fs.create(path, False)
        except Exception as e:
            raise Conflict(f"another writer published version {version}") from e
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        return version

    def _publish_local(self, manifest: dict, version: int, path) -> int:
        local = path.toUri().getPath()
        temporary = f"{os.path.dirname(local)}/{uuid.uuid4().hex}.tmp"
        with open(temporary, "w") as f:
            json.dump(manifest, f)
        try:
            os.link(temporary, local)
        except FileExistsError as e:
            raise Conflict(f"another writer published version {version}") from e
        finally:
            os.remove(temporary)
        return version

    def vacuum(self, keep: int = 1) -> list[str]:
        """Deletes manifests but for the last `keep`, and segments that none of those names; returns what went."""
        last = self.version()
        found = sorted(int(s.getPath().getName()[:12]) for s in self._fs.listStatus(self._path(f"{self.root}/manifests")) if s.getPath().getName().endswith(".json"))
        kept = [v for v in found if v > last - keep]
        need = {f"{kind}/{s}" for v in kept for kind in ("postings", "names") for s in self.manifest(v)[kind]}
        gone = [f"manifests/{v:012d}.json" for v in found if v not in kept]
        for kind in ("postings", "names"):
            folder = self._path(f"{self.root}/{kind}")
            if self._fs.exists(folder):
                gone += [f"{kind}/{s.getPath().getName()}" for s in self._fs.listStatus(folder) if f"{kind}/{s.getPath().getName()}" not in need]
        for g in gone:
            self._fs.delete(self._path(f"{self.root}/{g}"), True)
        return gone

    # -- reading

    def _read(self, kind: str, schema: str, manifest: dict) -> DataFrame:
        if not manifest[kind]:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.root}/{kind}").parquet(*(f"{self.root}/{kind}/{s}" for s in manifest[kind]))

    def postings(self, manifest: dict | None = None) -> DataFrame:
        return self._read("postings", POSTINGS, manifest or self.manifest())

    def names(self, manifest: dict | None = None) -> DataFrame:
        return self._read("names", NAMES, manifest or self.manifest())

    @staticmethod
    def current(names: DataFrame) -> DataFrame:
        """The live rows: of each path the latest, if it shows a revision."""
        last = names.groupBy("path_key").agg(F.max_by(F.struct(*names.columns), "seq").alias("r")).select("r.*")
        return last.filter("live")

    def bucket(self, token):
        return F.pmod(F.xxhash64(token), F.lit(self.buckets)).cast("int")

    def search(self, token: str | None, version: int | None = None) -> DataFrame:
        """Q1: (path_key) of live documents with exactly this token."""
        m = self.manifest(version)
        if token is None:
            return self.spark.createDataFrame([], "path_key string")
        # the bucket is computed here: a constant partition filter prunes folders, which an expression would not
        b = self.spark.range(1).select(self.bucket(F.lit(token)).alias("b")).first()["b"]
        hits = self.postings(m).filter((F.col("bucket") == b) & (F.col("token") == token)).select("rev").distinct()
        names = self.names(m)
        paths = names.join(hits, "rev", "left_semi").select("path_key").distinct()
        now = self.current(names.join(paths, "path_key", "left_semi"))
        return now.join(hits, "rev", "left_semi").select("path_key").distinct()

    def documents(self, version: int | None = None) -> DataFrame:
        return self.current(self.names(self.manifest(version)))

    def live_postings(self, version: int | None = None) -> DataFrame:
        """(token, path_key) of live documents."""
        m = self.manifest(version)
        return self.postings(m).join(self.current(self.names(m)).select("rev", "path_key"), "rev").select("token", "path_key").distinct()

    # -- writing

    def append(self, postings: DataFrame | None, names: DataFrame, seq: int) -> int:
        """Adds postings (token, rev) and names (NAMES), and publishes them together."""
        before = self.version()
        m = self.manifest(before)
        segment = f"s={uuid.uuid4().hex}"
        if postings is not None:
            self._write_postings(postings, segment)
            m["postings"].append(segment)
        names.select(*[c.split()[0] for c in NAMES.split(", ")]).write.parquet(f"{self.root}/names/{segment}")
        m["names"].append(segment)
        m["seq"] = seq
        return self.publish(m, before)

    def _write_postings(self, postings: DataFrame, segment: str) -> None:
        rows = postings.select("token", "rev", self.bucket(F.col("token")).alias("bucket"))
        # a hot token's rows spread over tasks: they are parted by token range and revision, not by bucket alone
        rows = rows.repartitionByRange("bucket", "token", "rev").sortWithinPartitions("bucket", "token", "rev")
        rows.write.partitionBy("bucket").parquet(f"{self.root}/postings/{segment}")

    def compact(self) -> int:
        """Rewrites the live part as one segment each; `vacuum` then deletes what it replaces."""
        before = self.version()
        m = self.manifest(before)
        names = self.current(self.names(m))
        segment = f"s={uuid.uuid4().hex}"
        live = self.postings(m).join(names.select("rev").distinct(), "rev", "left_semi").select("token", "rev").distinct()
        self._write_postings(live, segment)
        names.write.parquet(f"{self.root}/names/{segment}")
        return self.publish({"postings": [segment], "names": [segment], "seq": m["seq"]}, before)
