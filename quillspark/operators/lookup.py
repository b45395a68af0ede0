"""Sentiment lookup with fallbacks: the raw text, then normalised, then lower-cased."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx


def lookup_table(lexicon: DataFrame) -> DataFrame:
    """k, label: every entry (text, pos, label) under its raw, normalised and lower-cased form.

    Of entries that share a form the last one wins, whichever form of it that is.
    """
    raw, norm = tx.safe(F.col("text")), tx.norm_ws(F.col("text"))
    forms = F.array_distinct(F.array(raw, norm, F.lower(norm)))
    keys = lexicon.select(F.explode(F.filter(forms, lambda k: k != "")).alias("k"), "pos", "label")
    return keys.groupBy("k").agg(F.max_by("label", "pos").alias("label"))


def looked_up(df: DataFrame, lexicon: DataFrame, column: str = "raw", norm: str | None = None, lower: str | None = None) -> DataFrame:
    """Adds sentiment_label, sentiment_score and sentiment_source (raw, norm, lower or missing).

    An entry without a label is found but has null label and score. ``norm`` and ``lower`` are the
    columns of the normalised and the lower-cased text where there are such: the same text worked out
    in two columns makes Spark 4.1 generate code that doesn't compile. The table is joined three
    times; Spark broadcasts it where its size allows and shuffles else.
    """
    table = lookup_table(lexicon).withColumn("hit", F.lit(True))
    out = df.withColumn("_1", tx.safe(F.col(column)))
    if norm is None:
        out, norm = out.withColumn("_2", tx.norm_ws(F.col(column))), "_2"
    if lower is None:
        out, lower = out.withColumn("_3", F.lower(norm)), "_3"
    for i, form in enumerate(("_1", norm, lower), 1):
        side = table.select(F.col("k").alias(f"k{i}"), F.col("label").alias(f"label{i}"), F.col("hit").alias(f"hit{i}"))
        out = out.join(side, F.col(form) == F.col(f"k{i}"), "left")
    blank = F.col(norm) == ""
    pick = lambda of: F.when(blank, of(0)).when(F.col("hit1"), of(1)).when(F.col("hit2"), of(2)).when(F.col("hit3"), of(3)).otherwise(of(0))
    label = pick(lambda i: F.col(f"label{i}") if i else F.lit(None).cast("string"))
    source = pick(lambda i: F.lit(("missing", "raw", "norm", "lower")[i]))
    out = out.withColumn("sentiment_label", label).withColumn("sentiment_source", source).withColumn("sentiment_score", tx.sentiment_score(F.col("sentiment_label")))
    return out.drop("_1", "_2", "_3", *[f"{x}{i}" for x in ("k", "label", "hit") for i in (1, 2, 3)])


def spell_counts(df: DataFrame, vocabulary: DataFrame, id_cols: list[str], column: str = "raw", word: str = "word") -> DataFrame:
    """id columns, spell_n_errors, spell_has_errors: tokens of the text that aren't in the
    vocabulary, compared in lower case. Rows must differ in the id columns."""
    t = df.select(*id_cols, F.explode_outer(F.filter(tx.tokens(F.col(column)), tx.spellable)).alias("t"))
    words = vocabulary.select(F.lower(word).alias("w")).distinct().withColumn("known", F.lit(True))
    bad = (F.col("t").isNotNull() & F.col("known").isNull()).cast("long")
    out = t.join(words, F.lower("t") == F.col("w"), "left").groupBy(*id_cols).agg(F.sum(bad).alias("spell_n_errors"))
    return out.withColumn("spell_has_errors", (F.col("spell_n_errors") > 0).cast("int"))


def keyness_lemmas(df: DataFrame, lemmas: DataFrame, id_cols: list[str], column: str = "normalized_raw", stopwords: Sequence[str] = ()) -> DataFrame:
    """id columns and tokens: the lemmas of a text's words in their order, for keyness.

    ``lemmas`` has word and lemma; of several lemmas of a word, compared in lower case, the least
    counts, and a word without one stands for itself. Stopwords go by the word; lemmas of fewer
    than 3 characters, of fewer than 6 with a space, or without a letter go too. Rows must differ
    in the id columns; a text without tokens, or null, has none. Frequent words are split by
    adaptive execution where the dictionary isn't broadcast, being on the left side of the join.
    """
    table = lemmas.select(F.lower("word").alias("_w"), F.nullif(F.trim(F.lower("lemma")), F.lit("")).alias("_l")).groupBy("_w").agg(F.min("_l").alias("_l"))
    words = df.select(*id_cols, F.posexplode_outer(F.transform(tx.tokens(F.col(column)), lambda t: F.lower(t))).alias("_at", "_w"))
    found = words.join(table, "_w", "left").withColumn("_t", F.coalesce("_l", "_w"))
    t = F.col("_t")
    keep = ~F.col("_w").isin(*stopwords) & (F.char_length(t) >= 3) & ~((F.char_length(t) < 6) & t.contains(" ")) & tx.has_letter(t)
    # structs of kept words only: collect_list leaves nulls out
    return found.groupBy(*id_cols).agg(F.transform(F.array_sort(F.collect_list(F.when(keep, F.struct("_at", "_t")))), lambda x: x["_t"]).alias("tokens"))


def distinct_answers(df: DataFrame, columns: list[str]) -> DataFrame:
    """The distinct trimmed texts of several columns that are worth enriching: what a model is
    asked about, once each."""
    long = df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in columns]).unpivot([], columns, "column", "text")
    return long.select(tx.norm_ws(F.col("text")).alias("text")).where(tx.candidate(F.col("text"))).distinct()
