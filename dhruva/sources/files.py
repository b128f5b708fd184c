"""Readers and writers: parquet, nested JSON, CSV, a Markdown report, digests of files."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class SourceError(ValueError):
    """A source that is missing or does not have the columns it should have."""


def read_parquet(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A table read only; with ``schema`` its columns must be there with their types, other columns are left out."""
    try:
        df = spark.read.parquet(path)
    except Exception as error:
        raise SourceError(f"cannot read {path}") from error
    if schema is None:
        return df
    have = {f.name: f.dataType for f in df.schema}
    wrong = [f.name for f in schema if have.get(f.name) != f.dataType]
    if wrong:
        raise SourceError(f"{path}: columns missing or of another type: {', '.join(wrong)}")
    return df.select(*schema.names)


def read_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Nested documents, one per file or per line; fields that are not there are null."""
    return spark.read.json(path, schema=schema, multiLine=True)


def explode_list(df: DataFrame, column: str, **names: str) -> DataFrame:
    """One row for each struct of a list column; ``names`` renames the fields."""
    rows = df.select(F.explode(column).alias("__x")).select("__x.*")
    return rows.withColumnsRenamed(names)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with a header; quoted fields may hold line ends. A line that does not fit the schema fails the read."""
    return spark.read.csv(path, header=True, schema=schema, multiLine=True, escape='"', mode="FAILFAST", enforceSchema=False)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").csv(path, header=True, escape='"', quoteAll=True)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path, ignoreNullFields=False)


def markdown(df: DataFrame, most: int = 1_000) -> str:
    """A small result as a Markdown table; more than ``most`` rows are refused."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report has at most {most} rows")
    cell = lambda v: "" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v).replace("|", "\\|").replace("\n", " ")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(map(cell, r)) + " |" for r in rows]) + "\n"


def write_markdown(df: DataFrame, path: str, title: str) -> None:
    """Written next to its place and moved there, so that a reader never sees half a report."""
    to = Path(path)
    part = to.with_suffix(".part")
    part.write_text(f"# {title}\n\n{markdown(df)}", encoding="utf-8")
    part.replace(to)


#: Bytes of a file that are held at a time while it is digested.
CHUNK = 1 << 20


def digests(spark: SparkSession, path: str) -> DataFrame:
    """Name, length and SHA-256 of each file below a path; files are streamed, never held whole."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = []
            for name in pdf["path"]:
                fs, inner = FileSystem.from_uri(re.sub("^file:/+", "file:///", name))
                digest = hashlib.sha256()
                with fs.open_input_stream(inner) as stream:
                    while chunk := stream.read(CHUNK):
                        digest.update(chunk)
                found.append(digest.hexdigest())
            yield pd.DataFrame({"file": pdf["path"].str.rsplit("/", n=1).str[-1], "length": pdf["length"], "sha256": found})

    return files.mapInPandas(run, "file string, length long, sha256 string")


def install(source: str, target: str, sha256: str) -> None:
    """Copy a local file next to its place, check its digest and only then move it there; a wrong one leaves nothing behind."""
    to = Path(target)
    part, digest = to.with_name(to.name + ".part"), hashlib.sha256()
    try:
        with open(source, "rb") as src, open(part, "wb") as dst:
            while chunk := src.read(CHUNK):
                digest.update(chunk)
                dst.write(chunk)
        if digest.hexdigest() != sha256:
            raise SourceError(f"{source}: digest is not the expected one")
        part.replace(to)
    finally:
        part.unlink(missing_ok=True)


def verified(spark: SparkSession, path: str, expected: dict[str, str]) -> bool:
    """Do the files below ``path`` have exactly the expected digests?"""
    found = {r["file"]: r["sha256"] for r in digests(spark, path).limit(len(expected) + 1).collect()}
    return found == expected
