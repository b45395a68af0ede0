"""What is shown of the results: LaTeX tables and frames to plot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.numeric import stars
from ..operators import agg, reshape

_ESCAPES = {"\\": r"\textbackslash{}", "&": r"\&", "%": r"\%", "$": r"\$", "#": r"\#", "_": r"\_", "{": r"\{", "}": r"\}", "~": r"\textasciitilde{}", "^": r"\textasciicircum{}"}


def latex_escape(text: str) -> str:
    """Each special character once, so that what an escape brings along isn't escaped again."""
    return "".join(_ESCAPES.get(c, c) for c in text)


def _tabular(spec: str, head: Sequence[str], rows: Sequence[Sequence[str]]) -> str:
    line = lambda cells: " & ".join(cells) + r" \\"
    return "\n".join([rf"\begin{{tabular}}{{{spec}}}", r"\toprule", line(head), r"\midrule", *map(line, rows), r"\bottomrule", r"\end{tabular}"]) + "\n"


def unique_table(shares: DataFrame, questions: Sequence[str], systems: Sequence[str]) -> str:
    """Shares of unique answers by question and system, one decimal, blank where there is none."""
    wide = {r["question"]: r for r in reshape.to_wide(shares, questions, systems, value="unique_pct").collect()}
    rows = [[latex_escape(q), *("" if wide[q][d] is None else f"{wide[q][d]:.1f}" for d in systems)] for q in questions]
    return _tabular("l" + "r" * len(systems), ["Question", *map(latex_escape, systems)], rows)


def keyness_table(top: DataFrame) -> str:
    """The strongest tokens of either side by number of question."""
    rows = top.select("question", tx.joined_list(F.col("human")).alias("human"), tx.joined_list(F.col("system")).alias("system"), tx.question_no(F.col("question")).alias("no")).orderBy("no", "question").collect()
    return _tabular("lll", ["Question", "Human", "Systems"], [[latex_escape(r[c]) for c in ("question", "human", "system")] for r in rows])


def heat_matrix(df: DataFrame, questions: Sequence[str], systems: Sequence[str], value: str = "value", p: str = "p_adj") -> DataFrame:
    """question, a column of values and one of stars for each system: a heat map's cells."""
    values = reshape.to_wide(df, questions, systems, value=value)
    starred = df.groupBy("question").pivot("dataset", list(systems)).agg(F.first(stars(F.col(p))))
    starred = starred.select("question", *[F.col(f"`{d}`").alias(f"{d}_stars") for d in systems])
    return values.join(starred, "question", "left").orderBy(tx.question_no(F.col("question")), "question")


def noise_plot(values: DataFrame, noise: DataFrame, signed: bool = False) -> DataFrame:
    """Bars with the noise band of their question: median, quartiles and the 95th percentile (of
    the absolute values, either way, where values have a sign)."""
    band = agg.noise_band(noise).select("question", F.col("median").alias("noise_median"), F.col("q25").alias("noise_q25"), F.col("q75").alias("noise_q75"), F.col("abs_q95" if signed else "q95").alias("noise_high"))
    out = values.join(band, "question", "left")
    return out.withColumn("noise_low", -F.col("noise_high") if signed else F.lit(0.0))


def stacked_likert(props: DataFrame, systems: Sequence[str]) -> DataFrame:
    """Proportions with where their bar segment starts, in the order of systems."""
    from pyspark.sql import Window

    w = Window.partitionBy("question", "dataset").orderBy("option").rowsBetween(Window.unboundedPreceding, -1)
    place = F.array_position(F.array(*[F.lit(d) for d in systems]), F.col("dataset"))
    return props.withColumn("start", F.coalesce(F.sum("prop").over(w), F.lit(0.0))).orderBy("question", place, "option")
