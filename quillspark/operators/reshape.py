"""Wide questionnaires to long tables, recodes, bins, pivots and respondent filters."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.numeric import number
from ..schema import BASELINE, EXPERIENCE_BINS, GRADE_BINS, ROLE_BINS


@dataclass(frozen=True)
class ColumnMap:
    """Which columns of a wide table are which: by name the id and the two open answers, by
    position the seventeen that follow; what comes before the open answers is the profile."""

    respondent_id: str
    profile: tuple[str, ...]
    q1: str
    q2: str
    rest: dict[str, str]

    @property
    def words(self) -> dict[str, str]:
        return {q: c for q, c in self.rest.items() if 3 <= int(q[1:]) <= 16}

    @property
    def likert(self) -> dict[str, str]:
        return {q: c for q, c in self.rest.items() if int(q[1:]) >= 17}


def infer_column_map(df: DataFrame, id_col: str = "ID", q1: str = "Positiva", q2: str = "Negativa") -> ColumnMap:
    """Raises ValueError where a named column is missing or fewer than 17 follow."""
    names = df.columns
    for c in (id_col, q1, q2):
        if c not in names:
            raise ValueError(f"no column {c!r}")
    at = names.index(q1)
    after = [c for c in names[at + 1 :] if c not in (q2, id_col)]
    if len(after) < 17:
        raise ValueError(f"{len(after)} columns after {q1!r}; 17 are needed")
    return ColumnMap(id_col, tuple(c for c in names[:at] if c != id_col), q1, q2, {f"q{i}": c for i, c in enumerate(after[:17], 3)})


def first_column(df: DataFrame, candidates: Sequence[str]) -> str | None:
    """The first candidate that is a column."""
    return next((c for c in candidates if c in df.columns), None)


def profiles(df: DataFrame, cmap: ColumnMap) -> DataFrame:
    return df.select(F.col(f"`{cmap.respondent_id}`").cast("string").alias("respondent_id"), *[F.col(f"`{c}`") for c in cmap.profile])


def to_long(df: DataFrame, id_col: str, questions: dict[str, str], keep: Sequence[str] = ()) -> DataFrame:
    """respondent_id, question, raw: one row an answer, missing answers included."""
    wide = df.select(F.col(f"`{id_col}`").cast("string").alias("respondent_id"), *keep, *[F.col(f"`{c}`").cast("string").alias(q) for q, c in questions.items()])
    return wide.unpivot(["respondent_id", *keep], list(questions), "question", "raw")


def to_wide(df: DataFrame, rows: Sequence[str], columns: Sequence[str], row: str = "question", column: str = "dataset", value: str = "value") -> DataFrame:
    """Means by row and column, for exactly these rows and columns, null where there is none."""
    wide = df.groupBy(row).pivot(column, list(columns)).agg(F.avg(value))
    frame = df.sparkSession.createDataFrame([(r,) for r in rows], f"{row} string")
    return frame.join(wide, row, "left").select(row, *[F.col(f"`{c}`") for c in columns])


def titled(df: DataFrame, titles: dict[str, str]) -> DataFrame:
    """Renamed to the titles, in their order; a missing column or null is the empty string."""
    have = set(df.columns)
    return df.select(*[(tx.safe(F.col(f"`{q}`")) if q in have else F.lit("")).alias(t) for q, t in titles.items()])


def with_subgroups(df: DataFrame, experience: str = "Anni esp", role: str = "Ruolo", grade: str = "Grado") -> DataFrame:
    """Adds esperienza_2, ruolo_2 and grado_2; a missing column gives nulls."""
    for name, column, table in (("esperienza_2", experience, EXPERIENCE_BINS), ("ruolo_2", role, ROLE_BINS), ("grado_2", grade, GRADE_BINS)):
        df = df.withColumn(name, tx.bin_of(F.col(f"`{column}`"), table) if column in df.columns else F.lit(None).cast("string"))
    return df


def with_bins(df: DataFrame, years: str = "years", role: str = "role", grade: str = "grade") -> DataFrame:
    """Adds exp_bin from a number of years, and ruolo_bin and grado_bin, lower-cased."""
    out = df.withColumn("exp_bin", tx.years_bin(number(F.col(years).cast("string"))))
    for name, column in (("ruolo_bin", role), ("grado_bin", grade)):
        if column in df.columns:
            out = out.withColumn(name, F.lower(F.trim(F.col(column))))
    return out


def ids_in_bin(profile_table: DataFrame, column: str, value: str, dataset: str = "dataset", baseline: str = BASELINE) -> DataFrame:
    """The baseline's respondents in a bin. Systems imitate respondents of the same ids, so this
    set filters all datasets."""
    return profile_table.where((F.col(dataset) == baseline) & (F.col(column) == value)).select("respondent_id").distinct()


def only(df: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of the given respondents."""
    return df.join(ids, "respondent_id", "left_semi")
