"""Maintenance of the index of documents and their tokens (X1-X8), as functions of relations.

One relation `postings` (token, doc_id) answers both ways, so forward and inverted sides cannot
disagree (X6, X7).  `docs` (doc_id, path_key) names documents; a rename touches it alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordtide.functions.text import Tokenizer, text_tokens


def postings(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", tokenizer: Tokenizer = text_tokens) -> DataFrame:
    """X1 of whole documents: (token, doc_id), each once.

    The tokenizer gives each document's distinct tokens, so no shuffle is needed unless a doc_id
    has several rows; use `merged` then.
    """
    return docs.select(F.explode(tokenizer(F.col(text))).alias("token"), F.col(doc_id).alias("doc_id"))


def merged(rows: DataFrame) -> DataFrame:
    """Distinct postings of rows whose doc_id may repeat."""
    return rows.dropDuplicates(["token", "doc_id"])


def add(old: DataFrame, new: DataFrame) -> DataFrame:
    """Union; a created document that is known keeps its tokens too."""
    return old.unionByName(new.select("token", "doc_id")).dropDuplicates(["token", "doc_id"])


def remove_documents(old: DataFrame, gone: DataFrame) -> DataFrame:
    """Without the documents of gone (doc_id)."""
    return old.join(gone.select("doc_id"), "doc_id", "left_anti").select("token", "doc_id")


def remove_tokens(old: DataFrame, gone: DataFrame) -> DataFrame:
    """Without the pairs of gone (token, doc_id)."""
    return old.join(gone.select("token", "doc_id"), ["token", "doc_id"], "left_anti").select("token", "doc_id")


def diff(old: DataFrame, new: DataFrame, changed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(removed, added) of the documents of changed (doc_id); those without a row in new have become empty."""
    ids = changed.select("doc_id").distinct()
    mine = old.join(ids, "doc_id", "left_semi").select("token", "doc_id")
    after = new.join(ids, "doc_id", "left_semi").select("token", "doc_id")
    on = ["token", "doc_id"]
    return mine.join(after, on, "left_anti"), after.join(mine, on, "left_anti")


def diff_texts(before: DataFrame, after: DataFrame, text: str = "text", tokenizer: Tokenizer = text_tokens) -> tuple[DataFrame, DataFrame]:
    """X4 of whole documents (doc_id, text), one row each: (removed, added) of those of after, from one join on doc_id.

    A document that is not in before is new; one whose text is null or empty loses all its tokens.
    """
    was = before.select("doc_id", tokenizer(F.col(text)).alias("was"))
    both = after.select("doc_id", tokenizer(F.col(text)).alias("now")).join(was, "doc_id", "left").withColumn("was", F.coalesce("was", F.array().cast("array<string>")))
    tell = lambda a, b: both.select(F.explode(F.array_except(a, b)).alias("token"), "doc_id")
    return tell("was", "now"), tell("now", "was")


def update(old: DataFrame, new: DataFrame, changed: DataFrame) -> DataFrame:
    """The documents of changed (doc_id) have the tokens of new alone, none if it has no row of them.

    The same result as removing and adding the difference, without computing it.
    """
    ids = changed.select("doc_id").distinct()
    return remove_documents(old, ids).unionByName(new.join(ids, "doc_id", "left_semi").select("token", "doc_id"))


def switch(docs: DataFrame, swaps: DataFrame) -> DataFrame:
    """Documents of swaps (who, with: path keys) exchange names; a name that is free is taken over.

    Postings stay as they are. Names in swaps occur once. Two unknown names change nothing.
    """
    pairs = swaps.select(F.col("who").alias("path_key"), F.col("with").alias("_new")).unionByName(swaps.select(F.col("with").alias("path_key"), F.col("who").alias("_new")))
    return docs.join(pairs, "path_key", "left").withColumn("path_key", F.coalesce("_new", "path_key")).select(*docs.columns)


def forward(rows: DataFrame, doc_id: Column | int) -> DataFrame:
    """The tokens of one document."""
    return rows.filter(F.col("doc_id") == doc_id).select("token")


def inverted(rows: DataFrame, token: str | None) -> DataFrame:
    """The documents of one token; none for null."""
    return rows.filter(F.col("token") == F.lit(token)).select("doc_id").distinct()


def search(rows: DataFrame, docs: DataFrame, token: str | None) -> DataFrame:
    """Q1: (path_key) of the documents that hold exactly this token."""
    return inverted(rows, token).join(docs.select("doc_id", "path_key"), "doc_id").select("path_key").distinct()


def search_text(docs: DataFrame, token: str, text: str = "text", tokenizer: Tokenizer = text_tokens) -> DataFrame:
    """Q1 without an index: a substring test that the scan can apply comes before tokenising."""
    return docs.filter(F.contains(F.col(text), F.lit(token))).filter(F.array_contains(tokenizer(F.col(text)), token))


def search_many(rows: DataFrame, tokens: DataFrame) -> DataFrame:
    """(token, doc_id) of many tokens (token) at once."""
    return rows.join(tokens.select("token").dropna().distinct(), "token", "left_semi")
