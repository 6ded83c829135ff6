"""Subscriptions (U1-U5, Q4): which files of which folders are indexed.

A subscription is a row (folder_key, filters); the registry lives on the driver under a lock (B7),
what it selects is a predicate over files.
"""

from __future__ import annotations

import threading

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordtide.functions.text import mask_regex, matches, path_key_of


def _mask(mask: str | None) -> str:
    return (mask or "").strip().lower() or "*"


class Registry:
    """Masks by folder. Folders are known by their path keys; masks are lower case."""

    def __init__(self) -> None:
        self._lock = threading.RLock()
        self._masks: dict[str, list[str]] = {}
        self._paths: dict[str, str] = {}

    def add(self, folder: str, mask: str | None = None) -> bool:
        """Whether the mask is new for the folder."""
        with self._lock:
            key = path_key_of(folder)
            masks = self._masks.setdefault(key, [])
            self._paths.setdefault(key, folder)
            if _mask(mask) in masks:
                return False
            masks.append(_mask(mask))
            return True

    def remove(self, folder: str, mask: str | None = None) -> list[str]:
        """The masks whose files are to go; none if folder or mask are unknown."""
        with self._lock:
            key = path_key_of(folder)
            masks = self._masks.get(key)
            if masks is None:
                return []
            if mask is None or not mask.strip():
                self._forget(key)
                return ["*"]
            if _mask(mask) not in masks:
                return []
            masks.remove(_mask(mask))
            if not masks:
                self._forget(key)
            return [_mask(mask)]

    def file_gone(self, folder: str, name: str) -> None:
        """U4: a mask that names a deleted file goes with it; without masks the folder goes."""
        with self._lock:
            key = path_key_of(folder)
            masks = self._masks.get(key, [])
            if name.lower() in masks:
                masks.remove(name.lower())
                if not masks:
                    self._forget(key)

    def file_renamed(self, folder: str, old: str, new: str) -> None:
        """U4: a mask that names a renamed file follows it."""
        with self._lock:
            masks = self._masks.get(path_key_of(folder), [])
            if old.lower() in masks:
                masks[masks.index(old.lower())] = new.lower()

    def _forget(self, key: str) -> None:
        self._masks.pop(key, None)
        self._paths.pop(key, None)

    def folders(self) -> dict[str, list[str]]:
        """Masks by folder path."""
        with self._lock:
            return {self._paths[k]: list(m) for k, m in self._masks.items()}

    def covers(self, folder: str, name: str) -> bool:
        import re

        with self._lock:
            return any(re.match(mask_regex(m), name.lower(), re.S) for m in self._masks.get(path_key_of(folder), []))

    def listing(self) -> list[str]:
        """Q4: a folder and its masks, as one string."""
        with self._lock:
            return [f"{k}/{'|'.join(m)}" for k, m in self._masks.items()]


def listing(subscriptions: DataFrame) -> DataFrame:
    """Q4 of a relation (folder_key, filters): (folder_key, subscription)."""
    return subscriptions.select("folder_key", F.concat_ws("/", "folder_key", F.array_join(F.array_sort("filters"), "|")).alias("subscription"))


def select(files: DataFrame, folder: Column, masks: list[str | None], name: str = "name", folder_column: str = "folder_key") -> DataFrame:
    """The files of a folder that any mask covers, each once."""
    return files.filter((F.col(folder_column) == folder) & matches(F.col(name), masks))


def deselect(files: DataFrame, folder: Column, masks: list[str | None], name: str = "name", folder_column: str = "folder_key") -> DataFrame:
    """Without them. A file that another mask still covers goes too, as it always has."""
    return files.filter(~((F.col(folder_column) == folder) & matches(F.col(name), masks)))
