"""Column functions of the text index: tokens of a text, path keys, file-name masks."""

from __future__ import annotations

import os
import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A tokenizer turns a string column into an array of strings; null gives an empty array.
Tokenizer = Callable[[Column], Column]

_EMPTY = "array<string>"


def space_tokens(line: Column) -> Column:
    """Parts between U+0020, empty ones dropped. Case, tabs and punctuation stay. Null: none."""
    return F.coalesce(F.array_remove(F.split(line, " ", -1), ""), F.array().cast(_EMPTY))


def text_tokens(text: Column) -> Column:
    """The distinct tokens of a whole text, line by line (\\n, \\r and \\r\\n end lines). Null: none."""
    return F.coalesce(F.array_remove(F.array_distinct(F.split(text, r"[ \r\n]+", -1)), ""), F.array().cast(_EMPTY))


def by_line(tokenizer: Tokenizer) -> Tokenizer:
    """The distinct tokens that a line tokenizer finds in any line of a text."""

    def tokens(text: Column) -> Column:
        lines = F.split(F.coalesce(text, F.lit("")), r"\r\n|\r|\n", -1)
        return F.array_distinct(F.flatten(F.transform(lines, tokenizer)))

    return tokens


def path_key(path: Column) -> Column:
    """P1 of absolute paths: trailing separators off, upper case."""
    return F.upper(F.regexp_replace(path, r"[/\\]+$", ""))


def path_key_of(path: str) -> str:
    """P1 on the driver, of any path."""
    return os.path.abspath(path).rstrip("/\\").upper()


def parent_key(key: Column) -> Column:
    """The folder of a path key."""
    return F.regexp_extract(key, r"^(.*)[/\\]", 1)


def mask_regex(mask: str | None) -> str:
    """A mask with * and ? as an anchored regular expression for lower-case names. Blank: all."""
    mask = (mask or "").strip().lower() or "*"
    return "^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in mask) + "$"


def matches(name: Column, masks: list[str | None]) -> Column:
    """Whether a file name matches any of the masks, whatever its case."""
    if not masks:
        return F.lit(False)
    return F.lower(name).rlike("|".join(f"(?s:{mask_regex(m)})" for m in masks))
