"""The live index of folders: subscribe, search now, search after pending changes.

A stream of folder changes feeds the store by `foreachBatch`; a batch is one new version, so a
search never sees half a change.  Within a batch the last change of a path counts (B3); batches
are in order (B1).
"""

from __future__ import annotations

import json
import os
import re
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordtide.cluster import shared_dir, ship
from wordtide.functions.text import Tokenizer, mask_regex, matches, path_key_of, space_tokens
from wordtide.operators.subscriptions import Registry
from wordtide.plans.store import NAMES, Store
from wordtide.sources import files, live
from wordtide.streaming.tasks import TaskQueue


def _default_root(spark: SparkSession) -> str:
    """A folder in the cluster's shared one."""
    shared = shared_dir(spark)
    if not shared.startswith(("file:", "/")):
        raise ValueError("name a root that driver and executors see as a path: folders are watched through it")
    return f"{shared.removeprefix('file://')}/wordtide-index-{uuid.uuid4().hex[:12]}"


class Engine:
    def __init__(self, spark: SparkSession, root: str | None = None, tokenizer: Tokenizer = space_tokens, interval: str = "0 seconds", buckets: int = 4, compact_after: int = 40):
        self.spark, self.tokenizer, self.interval, self.compact_after = spark, tokenizer, interval, compact_after
        self.root = root or _default_root(spark)
        self.store = Store(spark, f"{self.root}/store", buckets)
        self.registry = Registry()
        self.tasks = TaskQueue()
        self._write = threading.RLock()
        os.makedirs(self.root, exist_ok=True)
        self._folders = os.path.join(self.root, "folders.json")
        self._save_folders()
        self._query = None

    # -- the stream

    def start(self) -> "Engine":
        """Begins to follow the folders. Without it, `refresh` takes changes over on demand."""
        if self._query is None:
            ship(self.spark)
            self.spark.dataSource.register(live.FolderChanges)
            stream = self.spark.readStream.format("folder_changes").option("folders", self._folders).option("state", f"{self.root}/listings").load()
            self._query = stream.writeStream.foreachBatch(lambda df, n: self.apply(df, n)).option("checkpointLocation", f"{self.root}/checkpoint").trigger(processingTime=self.interval).start()
        return self

    def refresh(self) -> None:
        """All changes up to now are indexed when it returns."""
        if self._query is not None:
            self._query.processAllAvailable()
            return
        with self._write:
            state = live.State(f"{self.root}/listings")
            n = max((int(f[:12]) for f in os.listdir(state.folder) if f.endswith(".json")), default=0)
            rows, _ = live.FolderReader(self._folders, f"{self.root}/listings").read({"listing": n})
            rows = list(rows)
            if rows:
                self.apply(self.spark.createDataFrame(rows, live.SCHEMA), n)

    def _save_folders(self) -> None:
        temporary = f"{self._folders}.{uuid.uuid4().hex}"
        with open(temporary, "w") as f:
            json.dump(self.registry.folders(), f)
        os.replace(temporary, self._folders)

    def apply(self, changes: DataFrame, batch: int) -> None:
        """E1-E4 of one batch (live.SCHEMA), one listing after another."""
        with self._write:
            rows = changes.orderBy("seq").collect()  # driver metadata: file names of the listings
            for n in dict.fromkeys(r.seq // live.PER_LISTING for r in rows):
                self._apply([r for r in rows if r.seq // live.PER_LISTING == n])

    def _apply(self, rows: list) -> None:
        """New revisions of created and changed files, no name for deleted ones, another name for renamed ones."""
        renamed, known = self._renamed([(r.old_path, r.path) for r in rows if r.op == live.RENAMED])
        rows = [r for r in rows if (r.op != live.RENAMED or r.path_key not in known) and (r.op == live.DELETED or self.registry.covers(os.path.dirname(r.path), r.name))]
        seq = max((n[5] for n in renamed), default=self.store.manifest()["seq"])
        alive = [r for r in rows if r.op != live.DELETED and os.access(r.path, os.R_OK)]
        dead = [r for r in rows if r.op == live.DELETED]
        names, rev_of = [], []
        for r in alive:
            seq += 1
            rev = uuid.uuid4().hex
            rev_of.append((r.path, rev))
            names.append((r.path_key, r.path, r.folder_key, r.name, rev, seq, True))
        for r in dead:
            seq += 1
            names.append((r.path_key, r.path, r.folder_key, r.name, None, seq, False))
            self.registry.file_gone(os.path.dirname(r.path), r.name)
        postings = None
        if rev_of:
            revs = self.spark.createDataFrame(rev_of, "path string, rev string")
            postings = files.tokens(self.spark, [p for p, _ in rev_of], self.tokenizer).join(F.broadcast(revs), "path").select("token", "rev")
        if renamed or names:
            self.store.append(postings, self.spark.createDataFrame(renamed + names, NAMES), seq)
        if dead or renamed:
            self._save_folders()
        if len(self.store.manifest()["postings"]) > self.compact_after:
            self.store.compact()

    # -- subscriptions

    def subscribe(self, folder: str, mask: str | None = None, wait: bool = True) -> bool:
        """Whether anything is new. A folder that is missing is ignored; a known mask is not indexed again.

        All files of a new mask are indexed, those too that the listing knows of an earlier mask.
        """
        if not os.path.isdir(folder):
            return False
        with self._write:
            if not self.registry.add(folder, mask):
                return False
            self._save_folders()

        def index() -> None:
            self.refresh()
            with self._write:
                test = re.compile(mask_regex(mask), re.S)
                have = {r.path_key for r in self.store.documents().filter(F.col("folder_key") == path_key_of(folder)).select("path_key").toLocalIterator()}
                missing = [(i, live.CREATED, p, path_key_of(p), path_key_of(folder), name, None) for i, (p, name, *_) in enumerate(files.list_folder(folder)) if test.match(name.lower()) and path_key_of(p) not in have]
                if missing:
                    self.apply(self.spark.createDataFrame(missing, live.SCHEMA), -1)

        done = self.tasks.queue(path_key_of(folder), index)
        if wait:
            done.result()
        return True

    def unsubscribe(self, folder: str, mask: str | None = None) -> bool:
        """A mask, or the folder. Its files leave the index, those that another mask covers included."""
        with self._write:
            gone = self.registry.remove(folder, mask)
            if not gone:
                return False
            self._save_folders()
        self.refresh()  # without the lock: the stream's own thread needs it
        with self._write:
            m = self.store.manifest()
            names = self.store.current(self.store.names(m)).filter(F.col("folder_key") == path_key_of(folder)).filter(matches(F.col("name"), gone))
            seq = m["seq"] + 1
            self.store.append(None, names.select("path_key", "path", "folder_key", "name", F.lit(None).cast("string").alias("rev"), F.lit(seq).cast("long").alias("seq"), F.lit(False).alias("live")), seq)
            return True

    @property
    def subscriptions(self) -> list[str]:
        """Q4."""
        return self.registry.listing()

    # -- renames

    def rename(self, old: str, new: str) -> None:
        """E4 by the caller, ahead of the next listing."""
        with self._write:
            names, _ = self._renamed([(old, new)])
            if names:
                self.store.append(None, self.spark.createDataFrame(names, NAMES), names[-1][5])
            self._save_folders()

    def _renamed(self, pairs: list[tuple[str, str]]) -> tuple[list[tuple], set[str]]:
        """E4, X5 of pairs (old, new): rows of NAMES, and the new path keys that need no reading.

        Two names exchange their revisions, contents are not read; a single-file mask follows.  A new
        name that no mask covers is not indexed; an old name that nothing took over is gone.
        """
        if not pairs:
            return [], set()
        m = self.store.manifest()
        keys = sorted({path_key_of(p) for pair in pairs for p in pair})  # driver metadata: names of one listing
        now = {r.path_key: r.rev for r in self.store.current(self.store.names(m).filter(F.col("path_key").isin(keys))).toLocalIterator()}
        rows, known, seq = [], set(), m["seq"]
        for old, new in pairs:
            self.registry.file_renamed(os.path.dirname(old), os.path.basename(old), os.path.basename(new))
            a, b = now.get(path_key_of(old)), now.get(path_key_of(new))
            if a is None:
                if b is not None:
                    known.add(path_key_of(new))  # the caller told of it before the listing did
                continue
            known.add(path_key_of(new))
            for path, rev in ((old, b), (new, a)):
                shown = rev if self.registry.covers(os.path.dirname(path), os.path.basename(path)) else None
                seq += 1
                now[path_key_of(path)] = shown
                rows.append((path_key_of(path), os.path.abspath(path), path_key_of(os.path.dirname(path)), os.path.basename(path), shown, seq, shown is not None))
        return rows, known

    # -- search

    def search(self, word: str | None, wait: bool = False) -> list[str]:
        """Q1: path keys of files with exactly this word, as indexed now; Q2 (wait): after pending changes."""
        if word is None:
            return []
        if wait:
            with self.tasks.pause():
                self.refresh()
                return self._found(word)
        return self._found(word)

    def _found(self, word: str) -> list[str]:
        return [r.path_key for r in self.store.search(word).toLocalIterator()]

    def search_frame(self, word: str | None) -> DataFrame:
        """Q1 as a DataFrame, for results that do not fit the driver."""
        return self.store.search(word)

    @property
    def is_indexing(self) -> bool:
        """Q3."""
        busy = self._query is not None and (self._query.status["isTriggerActive"] and self._query.status["isDataAvailable"])
        return bool(busy) or not self.tasks.is_empty

    def dispose(self) -> None:
        """U5."""
        if self._query is not None:
            self._query.stop()
            self._query = None
        self.tasks.dispose()
