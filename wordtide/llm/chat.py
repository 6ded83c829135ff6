"""Chat formatting: a finite-state machine over roles writes text segments with loss flags.

A declarative `Template` says how a turn of each role opens and closes, which role may follow
which, and whose text bears loss.  Turns of a conversation pass through the machine in order; each
gives three segments: opening, text, closing.  Control strings inside a text are escaped with a
backslash, and backslashes are doubled, so `parse` recovers roles and texts from the segments alone.

Rows are hashed by conversation, sorted within partitions and streamed: the machine keeps one
state, so a conversation of any length is never held in memory.

Defined results: null texts are empty; a null role is the role ''; turns are ordered by (turn,
role, text), nulls first, repeats included; a conversation that the machine refuses is formatted
all the same and marked with the first turn that is wrong; a null conv_id is a conversation;
very long texts pass one at a time; columns other than conv_id, turn, role and text are not read; no
rows give no conversations.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordtide.llm.common import Scratch, table

START = "start"


@dataclass(frozen=True)
class Template:
    """`names` maps roles to what is shown; other roles are shown in brackets."""

    names: dict[str, str] = field(default_factory=lambda: {"system": "System", "user": "User", "assistant": "Assistant"})
    follows: dict[str, tuple[str, ...]] = field(default_factory=lambda: {START: ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    final: tuple[str, ...] = ("assistant",)
    loss: tuple[str, ...] = ("assistant",)
    open_mark: str = "###"
    name_end: str = ": "
    close_mark: str = "</turn>"
    after: str = "\n"

    def escape(self, text: str) -> str:
        return text.replace("\\", "\\\\").replace(self.open_mark, "\\" + self.open_mark).replace(self.close_mark, "\\" + self.close_mark)

    def unescape(self, text: str) -> str:
        return re.sub(rf"\\(\\|{re.escape(self.open_mark)}|{re.escape(self.close_mark)})", r"\1", text)

    def opening(self, role: str) -> str:
        shown = self.names.get(role)
        if shown is None:
            shown = "[" + self.escape(role).replace("]", "\\]").replace("\n", "\\n") + "]"
        return f"{self.open_mark} {shown}{self.name_end}"

    def closing(self) -> str:
        return self.close_mark + self.after

    def role_of(self, opening: str) -> str:
        shown = opening[len(self.open_mark) + 1 : -len(self.name_end)]
        for role, name in self.names.items():
            if name == shown:
                return role
        return re.sub(rf"\\(\\|\]|n|{re.escape(self.open_mark)}|{re.escape(self.close_mark)})", lambda m: "\n" if m[1] == "n" else m[1], shown[1:-1])


SEGMENTS = "conv_id long, position long, text string, loss boolean, error_turn long"


def _format(template: Template):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, position, error, begun = None, START, 0, None, False
        for b in batches:
            out: list[tuple] = []
            for c, turn, role, text in zip(*(b.column(k).to_pylist() for k in ("conv_id", "turn", "role", "text"))):
                if not begun or c != conv:
                    conv, state, position, error, begun = c, START, 0, None, True
                role, text = role or "", text or ""
                if error is None and role not in template.follows.get(state, ()):
                    error = turn if turn is not None else -1
                state = role
                for part, loss in ((template.opening(role), False), (template.escape(text), role in template.loss), (template.closing(), False)):
                    out.append((c, position, part, loss, error))
                    position += 1
            cols = list(zip(*out)) or [()] * 5
            types = (pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(cols, types)], names=["conv_id", "position", "text", "loss", "error_turn"])

    return run


def formatted(conversations: DataFrame, template: Template = Template()) -> DataFrame:
    """Segments (conv_id, position, text, loss, error_turn); error_turn: the first wrong turn so far."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(_format(template), SEGMENTS)


RESULT = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean"


def _parse(template: Template):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: dict | None = None

        def result() -> pa.RecordBatch:
            x = now
            values = [x["conv"], x["turns"], x["all"].hexdigest(), x["loss_chars"], x["loss"].hexdigest(), x["chars"], x["error"] is None and x["role"] in template.final]
            types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_())
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], names=[f.split()[0] for f in RESULT.split(", ")])

        done: list[pa.RecordBatch] = []
        for b in batches:
            for conv, text, loss, error in zip(*(b.column(k).to_pylist() for k in ("conv_id", "text", "loss", "error_turn"))):
                if now is None or conv != now["conv"]:
                    if now is not None:
                        done.append(result())
                    now = {"conv": conv, "turns": 0, "all": hashlib.sha256(), "loss": hashlib.sha256(), "loss_chars": 0, "chars": 0, "role": None, "open": False, "error": None}
                now["chars"] += len(text)
                now["error"] = error
                if not now["open"]:
                    now["role"], now["open"] = template.role_of(text), True
                    now["all"].update((now["role"] + "\n").encode("utf-8", "surrogatepass"))
                elif text == template.closing():
                    now["open"] = False
                    now["turns"] += 1
                    now["all"].update(b"\n")
                else:
                    plain = template.unescape(text)
                    now["all"].update(plain.encode())
                    if loss:
                        now["loss"].update(plain.encode())
                        now["loss_chars"] += len(plain)
            if len(done) > 500:
                yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
                done = []
        if now is not None:
            done.append(result())
        if done:
            yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]

    return run


def parsed(segments: DataFrame, template: Template = Template()) -> DataFrame:
    """RESULT of each conversation, from its segments alone."""
    return segments.repartition("conv_id").sortWithinPartitions("conv_id", "position").select("conv_id", "text", "loss", "error_turn").mapInArrow(_parse(template), RESULT)


PROBE = "\\### Assistant: </turn> ok"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    return parsed(Scratch(spark, "chat").keep(formatted(rows.unionByName(probe)), "segments"))


ORACLE = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  CAST(sum(14 + length(role) + length(text) + length(text) - length(replace(text, '\', ''))
    + (length(text) - length(replace(text, '###', ''))) // 3 + (length(text) - length(replace(text, '</turn>', ''))) // 7) AS BIGINT) AS formatted_chars,
  regexp_full_match(string_agg(CASE role WHEN 'system' THEN 's' WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a' ELSE 'x' END, '' ORDER BY turn, role, text), 's?(ua)+') AS valid
FROM c GROUP BY conv_id
"""
