"""The analyses of a study. Each takes long tables with a ``dataset`` column and compares every
system with the baseline, all questions and systems in one plan."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.numeric import finite, number, stars
from ..operators import agg, keyness, lookup, reshape, resample, stats, vectors
from ..schema import BASELINE, KEPT_WORDS, MIN_IDS, SPLITS


def _adjusted(df: DataFrame, family: Sequence[str] = ("question",)) -> DataFrame:
    return stats.bh_adjust(df, family, ties=("dataset",), few=True).withColumn("stars", stars(F.col("p_adj")))


def embedding_fidelity(emb: DataFrame, n: int = 800, seed: int = 42) -> DataFrame:
    """question, dataset, value, p, p_adj: energy distance of open answers, permutation p."""
    return _adjusted(vectors.permutation_test(emb, n=n, seed=seed))


def embedding_noise(emb: DataFrame, n: int = 400, seed: int = 42) -> DataFrame:
    """question, rep, value: the baseline's split-half energy distances."""
    return vectors.split_half_energy(emb.where(F.col("dataset") == BASELINE), n=n, seed=seed)


word_energy = embedding_fidelity


def sentiment_shift(df: DataFrame, value: str = "sentiment_score", exact: bool = True) -> DataFrame:
    """question, dataset, shift, p, p_adj: mean sentiment less the baseline's, Mann-Whitney."""
    tests = stats.mann_whitney(df, value=value, exact=exact, means=True)
    return _adjusted(tests.withColumn("shift", F.col("mean") - F.col("base_mean")))


def open_wordcounts(df: DataFrame, numeric: Sequence[str] = ("n_words", "word_count"), texts: Sequence[str] = ("normalized_raw", "raw")) -> DataFrame:
    """question, dataset, word_count: from the first numeric column there is, else counted."""
    column, text = reshape.first_column(df, numeric), reshape.first_column(df, texts)
    count = number(F.col(column).cast("string")) if column else tx.word_count(F.col(text)).cast("double") if text else F.lit(None).cast("double")
    return df.select("question", "dataset", finite(count).alias("word_count")).where(F.col("word_count").isNotNull())


def unique_answers(df: DataFrame, candidates: Sequence[str] = ("entropy_key", "key", "normalized_raw", "raw")) -> DataFrame:
    column = reshape.first_column(df, candidates)
    return agg.distinct_share(df.withColumn("key", tx.answer_key(F.col(column))))


def entropy_delta(df: DataFrame, n: int = 500, seed: int = 42, exact: bool = False) -> DataFrame:
    """question, dataset, human, model, value (signed), abs_value, p, p_adj: difference of
    normalised entropies; p compares the respondents' bootstraps."""
    point = agg.normalized_entropy(df).select("question", "dataset", "entropy")
    base = point.where(F.col("dataset") == BASELINE).select("question", F.col("entropy").alias("human"))
    delta = point.where(F.col("dataset") != BASELINE).join(base, "question", "left").withColumn("value", F.col("entropy") - F.col("human"))
    # sums in another order differ in the last digits, which would break ties differently
    boot = resample.bootstrap_entropy(df, n=n, seed=seed).withColumn("value", F.round("entropy", 9))
    tests = stats.mann_whitney(boot, exact=exact).select("question", "dataset", "p")
    out = delta.withColumnRenamed("entropy", "model").join(tests, ["question", "dataset"], "left")
    return _adjusted(out.withColumn("abs_value", F.abs("value")))


def merged_keyness(df: DataFrame) -> DataFrame:
    """question, human, system: the strongest tokens of people and of all systems together."""
    return keyness.top_terms(keyness.log_odds(keyness.token_counts(df)))


def likert_tables(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Proportions, and chi-square tests with adjusted p."""
    props = agg.proportions(df)
    return props, _adjusted(stats.chi_square(props))


def skepticism(df: DataFrame, exact: bool = True, least: int = 5) -> DataFrame:
    """dataset, mean_diff_vs_human, p, p_adj of the index; empty if the baseline has fewer than
    ``least`` values. One family."""
    enough = df.where((F.col("dataset") == BASELINE) & finite(F.col("value")).isNotNull()).agg((F.count(F.lit(1)) >= least).alias("ok"))
    rows = df.withColumn("all", F.lit("S"))
    tests = stats.mann_whitney(rows, keys=("all",), exact=exact, means=True).withColumn("shift", F.col("mean") - F.col("base_mean"))
    out = stats.bh_adjust(tests, ("all",), ties=("dataset",), few=True)
    return out.crossJoin(F.broadcast(enough)).where("ok").select("dataset", F.col("shift").alias("mean_diff_vs_human"), "p", "p_adj")


def index_table(df: DataFrame, id_cols: Sequence[str] = ("dataset", "respondent_id")) -> DataFrame:
    """One row a respondent with q17_score to q19_score and skepticism_index_S, the mean of the
    scores there are. Of several answers to one item the highest counts."""
    item = lambda q: F.max(F.when(F.col("question") == q, F.col("score"))).alias(f"{q}_score")
    out = df.groupBy(*id_cols).agg(*[item(q) for q in ("q17", "q18", "q19")])
    return out.withColumn("skepticism_index_S", agg.row_mean([F.col(f"q{i}_score") for i in (17, 18, 19)]))


def index_noise(index: DataFrame, n: int = SPLITS, seed: int = 42) -> DataFrame:
    """question (S), rep, value: the baseline's split-half differences of the index."""
    rows = index.where(F.col("dataset") == BASELINE).select(F.lit("S").alias("question"), "respondent_id", F.col("skepticism_index_S").alias("value"))
    return resample.split_half_mean(rows, n=n, seed=seed)


def build_long(df: DataFrame, cmap: reshape.ColumnMap, questions: dict[str, str], dataset: str, lexicon: DataFrame, vocabulary: DataFrame | None = None, is_open: bool = True) -> DataFrame:
    """A long table of open answers or word associations with all text features."""
    long = reshape.to_long(df, cmap.respondent_id, questions).where(tx.valid_answer(F.col("raw")))
    norm = F.col("normalized_raw")
    long = long.withColumn("dataset", F.lit(dataset)).withColumn("normalized_raw", tx.norm_ws(F.col("raw"))).withColumn("entropy_key", F.lower(norm))
    if is_open:
        long = long.withColumn("n_words", tx.n_tokens(norm)).withColumn("gulpease", tx.gulpease(norm))
    else:
        long = long.withColumn("n_tokens", tx.n_tokens(norm)).withColumn("one_word", tx.one_word(norm))
    if vocabulary is not None:
        long = long.join(lookup.spell_counts(long, vocabulary, ["respondent_id", "question"], "normalized_raw"), ["respondent_id", "question"], "left")
    else:
        long = long.withColumn("spell_n_errors", F.lit(None).cast("long")).withColumn("spell_has_errors", F.lit(None).cast("int"))
    return lookup.looked_up(long, lexicon, norm="normalized_raw", lower="entropy_key")


def build_likert(df: DataFrame, cmap: reshape.ColumnMap, dataset: str) -> DataFrame:
    out = df.select(F.lit(dataset).alias("dataset"), F.col(f"`{cmap.respondent_id}`").cast("string").alias("respondent_id"), *[tx.likert_score(F.col(f"`{c}`")).alias(f"{q}_score") for q, c in cmap.likert.items()])
    return out.withColumn("skepticism_index_S", agg.row_mean([F.col(f"{q}_score") for q in cmap.likert]))


def default_stopwords(spark: SparkSession) -> list[str]:
    """Italian stopwords as Spark ships them, less the words that the study keeps."""
    from pyspark.ml.feature import StopWordsRemover

    return sorted({w.lower() for w in StopWordsRemover.loadDefaultStopWords("italian")} - set(KEPT_WORDS))


def build_keyness_tokens(long: DataFrame, stopwords: Sequence[str] | None = None) -> DataFrame:
    """tokens and n_tokens_keyness of each answer; without ``stopwords``, the default list."""
    if stopwords is None:
        stopwords = default_stopwords(long.sparkSession)
    out = long.select("dataset", "respondent_id", "question", tx.keyness_tokens(F.col("normalized_raw"), stopwords).alias("tokens"))
    return out.withColumn("n_tokens_keyness", F.size("tokens"))


SUBGROUPS = (("esperienza_2", "Breve Esperienza"), ("esperienza_2", "Lunga Esperienza"), ("ruolo_2", "Sostegno"), ("ruolo_2", "Curricolare"), ("grado_2", "Primaria+Infanzia"), ("grado_2", "Secondaria (I+II)"))


def subgroup_suite(profile_table: DataFrame, df: DataFrame, analysis: Callable[[DataFrame], DataFrame], groups: Sequence[tuple[str, str]] = SUBGROUPS, least: int = MIN_IDS) -> DataFrame:
    """The analysis for each subgroup of the baseline's respondents, with the columns ``subgroup``
    and ``bin``. Subgroups of fewer than ``least`` respondents are left out. Runs an action: one
    count for all subgroups."""
    base = profile_table.where(F.col("dataset") == BASELINE)
    sizes = base.agg(*[F.countDistinct(F.when(F.col(c) == v, F.col("respondent_id"))).alias(f"g{i}") for i, (c, v) in enumerate(groups)]).first()
    out = None
    for i, (column, value) in enumerate(groups):
        if sizes[i] >= least:
            part = analysis(reshape.only(df, reshape.ids_in_bin(profile_table, column, value))).withColumn("subgroup", F.lit(column)).withColumn("bin", F.lit(value))
            out = part if out is None else out.unionByName(part)
    return out if out is not None else analysis(df.limit(0)).withColumn("subgroup", F.lit("")).withColumn("bin", F.lit(""))


def in_subgroups(profile_table: DataFrame, df: DataFrame, groups: Sequence[tuple[str, str]] = SUBGROUPS, least: int = MIN_IDS) -> DataFrame:
    """The rows of ``df`` once for each subgroup that their respondent is in, with ``question``
    prefixed by subgroup and bin, so that one plan of an analysis takes all subgroups. Subgroups of
    fewer than ``least`` of the baseline's respondents are left out."""
    member = F.filter(F.array(*[F.when(F.col(c) == v, F.lit(f"{c}|{v}")) for c, v in groups]), lambda g: g.isNotNull())
    ids = profile_table.where(F.col("dataset") == BASELINE).select("respondent_id", F.explode(member).alias("sub")).distinct()
    # no more rows than there are groups
    large = ids.groupBy("sub").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("sub")
    return df.join(ids.join(F.broadcast(large), "sub"), "respondent_id").withColumn("question", F.concat_ws("|", "sub", "question")).drop("sub")


def subgroup_analyses(profile_table: DataFrame, tables: Mapping[str, DataFrame], groups: Sequence[tuple[str, str]] = SUBGROUPS, least: int = MIN_IDS, exact: bool = True) -> dict[str, DataFrame]:
    """Every analysis for every subgroup: name to its rows with ``subgroup``, ``bin`` and
    ``question``. ``tables``: open, words, likert, embeddings, word_embeddings and keyness, each
    with respondent_id; analyses of tables that miss are left out. An analysis of all subgroups
    is one plan; families of tests are questions of a subgroup. Runs no action."""
    t = {k: in_subgroups(profile_table, df, groups, least) for k, df in tables.items()}
    out = {}
    for name, table, analysis in (
        ("embedding_fidelity", "embeddings", embedding_fidelity),
        ("word_energy", "word_embeddings", word_energy),
        ("open_sentiment", "open", lambda df: sentiment_shift(df, exact=exact)),
        ("wordcount_box", "open", lambda df: agg.box_summary(open_wordcounts(df), value="word_count")),
        ("wordassoc_sentiment", "words", lambda df: sentiment_shift(df, exact=exact)),
        ("unique_answers", "words", unique_answers),
        ("entropy_delta", "words", entropy_delta),
        ("keyness", "keyness", lambda df: keyness.log_odds(keyness.token_counts(df))),
        ("likert_props", "likert", lambda df: likert_tables(df)[0]),
        ("likert_chi2", "likert", lambda df: likert_tables(df)[1]),
    ):
        if table in t:
            out[name] = analysis(t[table])
    if "likert" in t:
        part = F.substring_index("question", "|", 2).alias("sub")
        items = t["likert"].select("dataset", "respondent_id", part, F.substring_index("question", "|", -1).alias("question"), "score")
        index = index_table(items, ("sub", "dataset", "respondent_id")).select(F.concat("sub", F.lit("|S")).alias("question"), "dataset", F.col("skepticism_index_S").alias("value"))
        out["skepticism"] = sentiment_shift(index, "value", exact)
    at = F.split("question", r"\|", 3)
    return {k: df.withColumn("subgroup", at[0]).withColumn("bin", at[1]).withColumn("question", at[2]) for k, df in out.items()}
