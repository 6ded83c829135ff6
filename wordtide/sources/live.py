"""Folders as a stream of changes, by comparing listings.

Spark's own file stream never reads a changed file again and never reports a deletion, so this
Python data source lists the subscribed folders and emits the difference from the last listing.
A file of the same number, length and time under another name of its folder is a rename; a mask
that names the file follows it.  A file that cannot be read keeps what the last listing said of it,
so it is offered as soon as it can be.  An offset names a listing that is written to the state folder
before its changes are emitted; a batch that is run again gives the same rows.
"""

from __future__ import annotations

import json
import os
import threading
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from wordtide.functions.text import path_key_of
from wordtide.sources.files import list_folder

SCHEMA = "seq long, op string, path string, path_key string, folder_key string, name string, old_path string"
CREATED, CHANGED, DELETED, RENAMED = "created", "changed", "deleted", "renamed"
PER_LISTING = 1_000_000_000  # sequence numbers of one listing's changes
Listing = dict[str, tuple]  # path key: (path, length, mtime, file number)


def take(folders: dict[str, list[str]]) -> tuple[Listing, Listing]:
    """The files that folders and masks cover, now; and all files of the folders."""
    import re

    from wordtide.functions.text import mask_regex

    covered: Listing = {}
    every: Listing = {}
    for folder, masks in folders.items():
        tests = [re.compile(mask_regex(m), re.S) for m in masks]
        for path, name, length, mtime, number in list_folder(folder):
            every[path_key_of(path)] = (path, length, mtime, number)
            if any(t.match(name.lower()) for t in tests):
                covered[path_key_of(path)] = (path, length, mtime, number)
    return covered, every


def changes(old: Listing, new: Listing) -> list[tuple[str, str, str]]:
    """(op, path key, path): deletions first. Names alone: a rename is a deletion and a creation."""
    gone = [(DELETED, k, old[k][0]) for k in sorted(old.keys() - new.keys())]
    fresh = [(CREATED, k, new[k][0]) for k in sorted(new.keys() - old.keys())]
    return gone + fresh + [(CHANGED, k, new[k][0]) for k in sorted(old.keys() & new.keys()) if tuple(old[k][1:]) != tuple(new[k][1:])]


def follow(old: Listing, covered: Listing, every: Listing, folders: dict[str, list[str]]) -> tuple[Listing, list[tuple[str, str, str, str | None]]]:
    """The new listing and its changes (op, path key, path, old path), renames first.

    A rename is followed to a name that is covered, or that the mask of the file's own name follows.
    """
    new = dict(covered)
    for k, entry in covered.items():
        if not os.access(entry[0], os.R_OK):
            new.pop(k) if k not in old else new.update({k: old[k]})
    masks = {path_key_of(f): m for f, m in folders.items()}
    free = {(os.path.dirname(k), *e[1:]): k for k, e in every.items() if k not in old}
    moved: dict[str, str] = {}
    for k in sorted(old.keys() - new.keys()):
        to = free.get((os.path.dirname(k), *old[k][1:]))
        if to is not None and to not in moved.values() and (to in new or os.path.basename(k).lower() in masks.get(os.path.dirname(k), ())):
            moved[k] = to
            new[to] = every[to]
    found = [(RENAMED, to, new[to][0], old[k][0]) for k, to in moved.items()]
    found += [(op, k, path, None) for op, k, path in changes(old, new) if not (op == DELETED and k in moved or op == CREATED and k in moved.values())]
    return new, found


class State:
    """Listings by number in a folder, each written once and renamed into place."""

    def __init__(self, folder: str):
        self.folder = folder
        os.makedirs(folder, exist_ok=True)

    def _path(self, n: int) -> str:
        return os.path.join(self.folder, f"{n:012d}.json")

    def load(self, n: int) -> dict:
        if n <= 0:
            return {"listing": {}, "changes": []}
        with open(self._path(n)) as f:
            return json.load(f)

    def save(self, n: int, listing: Listing, found: list) -> None:
        temporary = f"{self._path(n)}.{os.getpid()}.{threading.get_ident()}"
        with open(temporary, "w") as f:
            json.dump({"listing": listing, "changes": found}, f)
        os.replace(temporary, self._path(n))

    def drop_before(self, n: int) -> None:
        for name in os.listdir(self.folder):
            if name.endswith(".json") and int(name[:12]) < n:
                os.remove(os.path.join(self.folder, name))


class FolderChanges(DataSource):
    """Options: folders (a JSON file with masks by folder) and state (a folder)."""

    @classmethod
    def name(cls) -> str:
        return "folder_changes"

    def schema(self) -> str:
        return SCHEMA

    def simpleStreamReader(self, schema) -> "FolderReader":
        return FolderReader(self.options["folders"], self.options["state"])


class FolderReader(SimpleDataSourceStreamReader):
    def __init__(self, folders: str, state: str):
        self.folders, self.state = folders, State(state)

    def initialOffset(self) -> dict:
        return {"listing": 0}

    def _rows(self, n: int) -> Iterator[tuple]:
        for i, (op, key, path, before) in enumerate(self.state.load(n)["changes"]):
            yield (n * PER_LISTING + i, op, path, key, path_key_of(os.path.dirname(path)), os.path.basename(path), before)

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        n = start["listing"]
        old = {k: tuple(v) for k, v in self.state.load(n)["listing"].items()}
        try:
            with open(self.folders) as f:
                folders = json.load(f)
        except FileNotFoundError:
            folders = {}
        new, found = follow(old, *take(folders), folders)
        if not found:
            return iter(()), start
        self.state.save(n + 1, new, found)
        return iter(list(self._rows(n + 1))), {"listing": n + 1}  # Spark copies the iterator: no generator

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        for n in range(start["listing"] + 1, end["listing"] + 1):
            yield from self._rows(n)

    def commit(self, end: dict) -> None:
        self.state.drop_before(end["listing"])
