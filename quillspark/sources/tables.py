"""Sources and sinks: wide tables, lexicons, feature tables, metadata and memoised results."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from ..functions.text import safe
from ..schema import FEATURE_TABLES, LEXICON

#: Datasets whose files a task keeps open in a write, and bytes of their row groups.
OPEN_FILES, ROW_GROUP = 16, 16 << 20


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder of ``spark.checkpoint.dir``, which driver and executors share. Where
    that is unset, one in a temporary folder if they are one process (local mode), else an error."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="quillspark-")
        spark.conf.set("spark.checkpoint.dir", shared)
    return f"{shared.rstrip('/')}/quillspark/{name}-{uuid.uuid4().hex}"


def all_strings(columns: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def read_wide(spark: SparkSession, path: str, columns: Sequence[str] | None = None, kind: str = "parquet") -> DataFrame:
    """A wide table (parquet, csv, json or orc), all columns strings; with ``columns``, just these
    and missing values empty. A path that isn't there, or lacks a column, gives an empty table
    when ``columns`` says what it should have, else raises."""
    try:
        reader = spark.read.option("header", True).option("multiLine", True) if kind == "csv" else spark.read
        df = reader.format(kind).load(path)
    except AnalysisException:
        if columns is None:
            raise
        return spark.createDataFrame([], all_strings(columns))
    if columns is None:
        return df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in df.columns])
    if set(columns) - set(df.columns):
        return spark.createDataFrame([], all_strings(columns))
    return df.select(*[safe(F.col(f"`{c}`")).alias(c) for c in columns])


def read_excel(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """A spreadsheet as strings; needs the optional package openpyxl on the driver. A spreadsheet
    is one small file, so it is read there."""
    try:
        import openpyxl  # noqa: F401
    except ImportError as error:
        raise RuntimeError("reading spreadsheets needs openpyxl; save the sheet as CSV or Parquet instead") from error
    import pandas as pd

    pdf = pd.read_excel(path, dtype=str, usecols=list(columns) if columns else None)
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), all_strings(list(pdf.columns)))
    return df.select(*[safe(F.col(f"`{c}`")).alias(c) for c in df.columns]) if columns else df


def lexicon_rows(data: object) -> list[tuple[str, int, str | None, list[str]]]:
    """(text, pos, label, emotions) of a lexicon in one of three layouts: text to [label,
    emotions], text to {sentiment, emotions}, or a list of {text, sentiment, emotions}. Labels are
    trimmed and lower-cased, empty ones null. Anything else raises ValueError."""
    if isinstance(data, dict):
        items = [(k, *(v if isinstance(v, list) and len(v) == 2 else (v.get("sentiment"), v.get("emotions")) if isinstance(v, dict) else (v, "bad"))) for k, v in data.items()]
    elif isinstance(data, list) and all(isinstance(x, dict) and "text" in x for x in data):
        items = [(x["text"], x.get("sentiment"), x.get("emotions")) for x in data]
    else:
        raise ValueError("not a lexicon: neither an object nor a list of objects with a text")
    out = []
    for pos, (text, label, emotions) in enumerate(items):
        if emotions == "bad":
            raise ValueError(f"entry {text!r} is neither [label, emotions] nor an object")
        label = str(label).strip().lower() or None if label is not None else None
        out.append((str(text), pos, label, [str(e) for e in emotions or []]))
    return out


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """A lexicon file as (text, pos, label, emotions). The file is one JSON document of some
    hundred entries, read whole by Spark so that it may be in any store."""
    text = "".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
    return spark.createDataFrame(lexicon_rows(json.loads(text)), LEXICON)


def read_set_literal(spark: SparkSession, path: str, min_chars: int = 10) -> DataFrame:
    """The distinct texts of a file that holds a set literal such as ``{'a', "b"}``, of at least
    ``min_chars`` characters as written, with white space collapsed."""
    import ast

    text = "".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
    found = ast.literal_eval(text.strip()) if text.strip() else set()
    rows = sorted({" ".join(t.split()) for t in found if isinstance(t, str) and len(t) >= min_chars})
    return spark.createDataFrame([(t,) for t in rows], "text string")


def write_features(tables: Mapping[str, DataFrame], path: str, mode: str = "overwrite") -> None:
    """Feature tables as Parquet, each partitioned by dataset where it has that column.

    A task keeps a file open for each of up to ``OPEN_FILES`` datasets, so rows needn't be sorted by
    dataset first, which would hold them all; with more datasets, what comes for the others is
    sorted. Row groups are small, as those of all open files are in memory.
    """
    for name, df in tables.items():
        with _unsorted_writes(df.sparkSession):
            writer = df.write.mode(mode).option("parquet.block.size", ROW_GROUP)
            (writer.partitionBy("dataset") if "dataset" in df.columns else writer).parquet(f"{path}/{name}")


@contextmanager
def _unsorted_writes(spark: SparkSession) -> Iterator[None]:
    """Writes inside keep files of several partitions open. Planned writes would sort all the same."""
    wanted = {"spark.sql.maxConcurrentOutputFileWriters": str(OPEN_FILES), "spark.sql.optimizer.plannedWrite.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def read_features(spark: SparkSession, path: str, datasets: Sequence[str] | None = None, names: Sequence[str] = FEATURE_TABLES) -> dict[str, DataFrame]:
    """The feature tables; a missing one raises FileNotFoundError that names all that miss.
    Embeddings are read if they are there. ``datasets`` prunes partitions."""
    found, missing = {}, []
    for name in [*names, "embeddings"]:
        try:
            df = spark.read.parquet(f"{path}/{name}")
        except AnalysisException:
            if name != "embeddings":
                missing.append(name)
            continue
        found[name] = df.where(F.col("dataset").isin(*datasets)) if datasets and "dataset" in df.columns else df
    if missing:
        raise FileNotFoundError(f"{path} lacks {', '.join(missing)}")
    return found


def materialize(spark: SparkSession, path: str, build: Callable[[], DataFrame], recompute: bool = False) -> DataFrame:
    """The table at ``path``, built and written first if it isn't complete there: a table is complete
    once its ``_SUCCESS`` file is there, which Spark writes last."""
    if not recompute:
        try:
            spark.read.text(f"{path}/_SUCCESS")
            return spark.read.parquet(path)
        except AnalysisException:
            pass
    build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def append_new(df: DataFrame, path: str, key: str) -> DataFrame:
    """Appends the rows whose key the table doesn't have yet, so a run that broke off goes on
    where it was; returns the whole table."""
    spark = df.sparkSession
    try:
        done = spark.read.parquet(path).select(F.col(f"`{key}`").alias("_done"))
        df = df.join(done, F.col(f"`{key}`").eqNullSafe(F.col("_done")), "left_anti")
    except AnalysisException:
        pass
    df.write.mode("append").parquet(path)
    return spark.read.parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """With a header; spaces at the ends of values stay, which Spark would trim."""
    spaces = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    df.write.mode("overwrite").options(header=True, **spaces).csv(path)


def write_json(spark: SparkSession, path: str, value: object) -> None:
    """One JSON document, indented, characters as they are, written by Spark."""
    text = json.dumps(value, ensure_ascii=False, indent=2)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)
