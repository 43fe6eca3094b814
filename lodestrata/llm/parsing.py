"""Source files that do not parse: chunk maps, reduced to files, then local grammars."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.code import EXTENSIONS
from lodestrata.llm import grammars, lexing
from lodestrata.llm.lexing import Part
from lodestrata.session import spread

_PARTS = "array<struct<entry:string,state:string,closed:string,left:string,bad:boolean,again:boolean>>"


def language_column(path: Column) -> Column:
    """The language of a file by its extension, which alone counts; null for others."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.coalesce(*(F.when(ext == k, F.lit(v)) for k, v in EXTENSIONS.items()))


def has_markup(path: str) -> bool:
    return path.lower().endswith(("jsx", "tsx"))


def examine(text: str, language: str, path: str) -> tuple[dict[str, Part], bool | None]:
    """(map, grammar) of a whole file: its chunks' maps composed, and whether its statements are valid, asked only where its brackets pair."""
    markup = has_markup(path)
    lexed = text
    if markup:  # text between tags is no code; what is not well-formed there is left for the grammar
        lexed = grammars.jsx_as_arrays(text)
        if lexed is None:
            return {"code": Part("code", bad=True)}, False
    whole = reduce(lexing.compose, (lexing.chunk_map(c, language, k == 0) for k, c in enumerate(lexing.chunks(lexed))))
    if whole["code"].again:  # a chunk ends inside a template's code: its text is read as one
        whole = {"code": lexing.scan(lexed, language)}
    return whole, grammars.valid(lexed, language) if lexing.balanced([whole], language) else None


def file_maps(files: DataFrame) -> DataFrame:
    """(file_path, parsed_at, digest, language, no, parts, grammar) where the texts lie: maps of lexer states without any text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, at, digest, text, language in zip(b["file_path"], b["parsed_at"], b["digest"], b["content"], b["language"]):
                m, grammar = examine(text, language, path) if text is not None and language else ({}, None)
                rows.append((path, at, digest, language, 0, [{"entry": e, **p.__dict__} for e, p in m.items()], grammar))
            yield pd.DataFrame(rows, columns=["file_path", "parsed_at", "digest", "language", "no", "parts", "grammar"])

    return spread(versions(files)).mapInPandas(run, f"file_path string, parsed_at timestamp_ntz, digest string, language string, no int, parts {_PARTS}, grammar boolean")


def versions(files: DataFrame) -> DataFrame:
    """(file_path, parsed_at, content, language, digest) of the rows that have a path."""
    return files.where("file_path is not null").select("file_path", F.col("parsed_at").cast("timestamp_ntz").alias("parsed_at"), "content", language_column(F.col("file_path")).alias("language"), F.md5(F.coalesce("content", F.lit(""))).alias("digest"))


def checked_files(files: DataFrame) -> DataFrame:
    """(file_path, parsed_at, digest, language, valid, stage) of each distinct row of files(file_path, parsed_at, content).

    Files are cut into chunks of lines, each summarised as a map of lexer states with its brackets. Maps are composed where
    the text lies, and the statements of a file whose brackets pair go through the grammar of its language there; texts
    are never shuffled. What partitions have of a file is composed in turn. valid is null for unknown extensions, null
    contents and Python nested too deep for the interpreter; an empty or comment-only file is valid. stage names what
    decided: 'lexical', 'grammar', 'depth' or 'none'. Rows without file_path are left out.
    """

    @F.pandas_udf("boolean")
    def paired(language: pd.Series, pieces: pd.Series) -> pd.Series:
        out = []
        for lang, ps in zip(language, pieces):
            maps = [{x["entry"]: Part(x["state"], x["closed"], x["left"], x["bad"], x["again"]) for x in p["parts"]} for p in sorted(ps, key=lambda p: p["no"])]
            out.append(None if lang is None or not all(maps) else lexing.balanced(maps, lang))
        return pd.Series(out, dtype=object)

    d = file_maps(files).groupBy("file_path", "parsed_at", "digest", "language").agg(F.collect_set(F.struct("no", "parts")).alias("pieces"), F.min("grammar").alias("grammar"))
    d = d.select("file_path", "parsed_at", "digest", "language", paired("language", "pieces").alias("paired"), "grammar")
    valid = F.when(~F.col("paired"), False).when(F.col("paired"), F.col("grammar"))
    stage = F.when(F.col("paired").isNull(), "none").when(~F.col("paired"), "lexical").when(F.col("grammar").isNull(), "depth").otherwise("grammar")
    return d.select("file_path", "parsed_at", "digest", "language", valid.alias("valid"), stage.alias("stage"))


def last_version() -> Column:
    """What orders the versions of a file: the last indexing, by content where two are of one time."""
    return F.struct(F.coalesce("parsed_at", F.lit("0001-01-01").cast("timestamp_ntz")), "digest")


def invalid_rates(files: DataFrame, checked: DataFrame) -> DataFrame:
    """(repo, language, n_files, n_invalid, share) over distinct files with a known language; a null repo is a group."""
    repo = files.where("file_path is not null").groupBy("file_path").agg(F.max_by("repo", "parsed_at").alias("repo"))
    last = checked.where("valid is not null").groupBy("file_path").agg(F.max_by(F.struct("language", "valid"), last_version()).alias("c"))
    d = last.join(repo, "file_path", "left").groupBy("repo", F.col("c.language").alias("language"))
    return d.agg(F.count("*").alias("n_files"), F.count_if(~F.col("c.valid")).alias("n_invalid")).withColumn("share", F.col("n_invalid") / F.col("n_files"))
