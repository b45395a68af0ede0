"""Queries over the driver's tables, one or more for each operator, and SQL for each of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.numeric import erfc_sql, rounded, stars
from ..operators import agg, enrich, keyness, lookup, reshape, resample, stats, vectors
from ..schema import BASELINE, BOOTSTRAPS, EXPERIENCE_BINS, GRADE_BINS, LIKERT_TEXTS, MIN_IDS, PERMUTATIONS, ROLE_BINS, SPLITS, SYSTEMS
from . import analyses, export
from . import surrogates as s

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def r6(name: str, column: Column | None = None) -> Column:
    return rounded(F.col(name) if column is None else column).alias(name)


SPACES = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]+"


def _norm(c: str) -> str:
    return f"trim(regexp_replace(coalesce({c}, ''), '{SPACES}', ' ', 'g'))"


TOKEN = r"[\p{L}\p{N}_]+(?:[''’][\p{L}\p{N}_]+)*"
LETTERS = "[A-Za-zÀ-ÖØ-öø-ÿ]"

# ---- text features


@query(f"SELECT doc_id, length(n) AS n_len, md5(n) AS norm_md5, md5(lower(n)) AS key_md5, regexp_matches(n, '{LETTERS}') AS has_letter FROM (SELECT doc_id, {_norm('text')} AS n FROM documents)")
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = tx.norm_ws(F.col("text"))
    return s.table(spark, sf_dir, "documents").select("doc_id", F.length(n).cast("long").alias("n_len"), F.md5(n).alias("norm_md5"), F.md5(tx.entropy_key(F.col("text"))).alias("key_md5"), tx.has_letter(n).alias("has_letter"))


@query(
    f"WITH {s.OPEN_SQL}, v AS (SELECT dataset, question, length({_norm('raw')}) >= 3 AND regexp_matches({_norm('raw')}, '{LETTERS}') AS ok FROM open_s) "
    "SELECT dataset, question, count(*) AS n_total, CAST(sum(CAST(ok AS INTEGER)) AS BIGINT) AS n_kept, round(avg(CAST(ok AS INTEGER)), 6) + 0.0 AS keep_rate FROM v GROUP BY ALL"
)
def coverage_by_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg.coverage(s.open_answers(spark, sf_dir), tx.valid_answer(F.col("raw"))).withColumn("keep_rate", r6("keep_rate"))


@query(
    "SELECT CAST(c_custkey AS VARCHAR) AS respondent_id, u.q AS question, u.v AS raw FROM customer, "
    "unnest([{'q': 'q1', 'v': c_name}, {'q': 'q2', 'v': c_mktsegment}, {'q': 'q3', 'v': CAST(c_nationkey AS VARCHAR)}]) AS t(u)"
)
def unpivot_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshape.to_long(s.table(spark, sf_dir, "customer"), "c_custkey", {"q1": "c_name", "q2": "c_mktsegment", "q3": "c_nationkey"})


@query(
    rf"SELECT conv_id, turn, CAST(len(regexp_extract_all(coalesce(text, ''), '[\p{{L}}\p{{N}}_]+')) AS BIGINT) AS words, CAST(len(regexp_extract_all(coalesce(text, ''), '{TOKEN}')) AS BIGINT) AS tokens, "
    rf"CAST(len(regexp_extract_all(coalesce(text, ''), '{TOKEN}')) = 1 AS INTEGER) AS one_word FROM conversations"
)
def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("text")
    return s.table(spark, sf_dir, "conversations").select("conv_id", "turn", tx.word_count(c).cast("long").alias("words"), tx.n_tokens(c).cast("long").alias("tokens"), tx.one_word(c).alias("one_word"))


@query(
    rf"WITH c AS (SELECT doc_id, CAST(len(regexp_extract_all(text, '{TOKEN}')) AS DOUBLE) AS w, CAST(len(regexp_extract_all(text, '\p{{L}}')) AS DOUBLE) AS l, CAST(greatest(len(regexp_extract_all(text, '[.!?]+')), 1) AS DOUBLE) AS s FROM documents) "
    "SELECT doc_id, CASE WHEN w > 0 THEN round(89e0 + (300e0 * s - 10e0 * l) / w, 6) + 0e0 END AS gulpease FROM c"
)
def readability_gulpease(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.table(spark, sf_dir, "documents").select("doc_id", r6("gulpease", tx.gulpease(F.col("text"))))


@query(
    rf"WITH voc AS (SELECT DISTINCT lower(w) AS w FROM (SELECT unnest(regexp_extract_all(text, '{TOKEN}')) AS w FROM benchmark)), "
    rf"t AS (SELECT conv_id, turn, unnest(regexp_extract_all(text, '{TOKEN}')) AS t FROM conversations), "
    f"u AS (SELECT conv_id, turn, count(*) FILTER (lower(t) NOT IN (SELECT w FROM voc)) AS n FROM t WHERE length(t) >= 3 AND regexp_matches(t, '{LETTERS}') AND NOT (t = upper(t) AND length(t) <= 5) GROUP BY ALL) "
    "SELECT c.conv_id, c.turn, coalesce(n, 0) AS spell_n_errors, CAST(coalesce(n, 0) > 0 AS INTEGER) AS spell_has_errors FROM conversations c LEFT JOIN u USING (conv_id, turn)"
)
def oov_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = s.table(spark, sf_dir, "benchmark").select(F.explode(tx.tokens(F.col("text"))).alias("word"))
    return lookup.spell_counts(s.table(spark, sf_dir, "conversations"), vocabulary, ["conv_id", "turn"], "text")


@query(
    rf"SELECT conv_id, turn, CAST(len(k) AS BIGINT) AS n, array_to_string(k, ' ') AS tokens FROM (SELECT conv_id, turn, list_filter(list_transform(regexp_extract_all(coalesce(text, ''), '{TOKEN}'), lambda t: lower(t)), lambda t: length(t) >= 3 AND regexp_matches(t, '{LETTERS}') AND t NOT IN ('the', 'and', 'that')) AS k FROM conversations)"
)
def keyness_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = tx.keyness_tokens(F.col("text"), ("the", "and", "that"))
    return s.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(k).cast("long").alias("n"), F.array_join(k, " ").alias("tokens"))


@query(
    "SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug, coalesce(try_cast(nullif(regexp_extract(p_brand, '(\\d+)', 1), '') AS INTEGER), 1000000000) AS brand_no, "
    "array_to_string(list_filter(list_transform(string_split(replace(p_name, ' ', '; '), ';'), lambda x: trim(x)), lambda x: x <> ''), ', ') AS joined FROM part"
)
def slug_and_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.table(spark, sf_dir, "part").select("p_partkey", tx.slug(F.col("p_name")).alias("slug"), tx.question_no(F.col("p_brand")).alias("brand_no"), tx.joined_list(F.replace(F.col("p_name"), F.lit(" "), F.lit("; "))).alias("joined"))


# ---- lookups, recodes and filters

_LOOKUP = (
    f"WITH {s.LEXICON_SQL}, forms AS (SELECT pos, label, unnest(list_distinct([text, {_norm('text')}, lower({_norm('text')})])) AS k FROM lexicon_s), "
    "look AS (SELECT k, arg_max(label, pos) AS label FROM forms WHERE k <> '' GROUP BY k), "
    "a AS (SELECT p_partkey AS answer_id, CASE p_partkey % 7 WHEN 0 THEN upper(p_name) WHEN 1 THEN '  ' || p_name || chr(9) WHEN 2 THEN "
    "array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), ' ') WHEN 3 THEN p_name || ' x' WHEN 4 THEN ' ' ELSE p_name END AS raw FROM part), "
    f"n AS (SELECT *, {_norm('raw')} AS norm FROM a), "
    "j AS (SELECT n.*, x.label AS l1, x.k AS k1, y.label AS l2, y.k AS k2, z.label AS l3, z.k AS k3 FROM n LEFT JOIN look x ON x.k = n.raw LEFT JOIN look y ON y.k = n.norm LEFT JOIN look z ON z.k = lower(n.norm)), "
    "r AS (SELECT answer_id, CASE WHEN norm = '' THEN 'missing' WHEN k1 IS NOT NULL THEN 'raw' WHEN k2 IS NOT NULL THEN 'norm' WHEN k3 IS NOT NULL THEN 'lower' ELSE 'missing' END AS sentiment_source, l1, l2, l3 FROM j) "
    "SELECT answer_id, sentiment_source, sentiment_label, CASE sentiment_label WHEN 'positivo' THEN 1 WHEN 'neutro' THEN 0 WHEN 'negativo' THEN -1 END AS sentiment_score "
    "FROM (SELECT *, CASE sentiment_source WHEN 'raw' THEN l1 WHEN 'norm' THEN l2 WHEN 'lower' THEN l3 END AS sentiment_label FROM r)"
)


@query(_LOOKUP)
def lookup_sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.looked_up(s.answers(spark, sf_dir), s.lexicon(spark, sf_dir)).drop("raw")


_TEXTS = list(LIKERT_TEXTS.values())


@query(
    "WITH t AS (SELECT o_orderkey, CASE CAST(substr(o_orderpriority, 1, 1) AS INTEGER) "
    + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate([" A: Per niente d''accordo", "b", "Un po''  d''accordo", "d: completamente D''accordo"], 1))
    + f" ELSE 'e: vuota' END AS answer FROM orders) SELECT o_orderkey, CASE lower({_norm('answer')}) WHEN 'a: per niente d''accordo' THEN 1 WHEN 'b' THEN 2 WHEN 'un po'' d''accordo' THEN 3 WHEN 'd: completamente d''accordo' THEN 4 END AS score FROM t"
)
def likert_recode(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.substring("o_orderpriority", 1, 1)
    answer = F.when(n == "1", " A: Per niente d'accordo").when(n == "2", "b").when(n == "3", "Un po'  d'accordo").when(n == "4", "d: completamente D'accordo").otherwise("e: vuota")
    return s.table(spark, sf_dir, "orders").select("o_orderkey", tx.likert_score(answer).alias("score"))


def _bin(column: str, table: dict[str, str]) -> str:
    return f'CASE trim("{column}") ' + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + " END"


@query(
    f"WITH {s.PROFILE_SQL} SELECT respondent_id, CASE trim(\"Ruolo\") WHEN 'Insegnante di sostegno' THEN 'Sostegno' WHEN 'Insegnante curricolare' THEN 'Curricolare' END AS ruolo_2, {_bin('Grado', GRADE_BINS)} AS grado_2, {_bin('Anni esp', EXPERIENCE_BINS)} AS esperienza_2, "
    "CASE WHEN CAST(years AS DOUBLE) < -0.5 THEN 'nan' WHEN CAST(years AS DOUBLE) <= 4.5 THEN '0-4' WHEN CAST(years AS DOUBLE) <= 14.5 THEN '5-14' ELSE '15+' END AS exp_bin, lower(trim(segment)) AS ruolo_bin FROM profile_s"
)
def subgroup_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = reshape.with_bins(reshape.with_subgroups(s.profile_table(spark, sf_dir)), role="segment")
    return out.select("respondent_id", "ruolo_2", "grado_2", "esperienza_2", "exp_bin", "ruolo_bin")


@query(f"WITH {s.PROFILE_SQL}, {s.LIKERT_SQL} SELECT dataset, question, count(*) AS n FROM likert_s WHERE respondent_id IN (SELECT respondent_id FROM profile_s WHERE dataset = 'human' AND trim(\"Ruolo\") = 'Insegnante di sostegno') GROUP BY ALL")
def subgroup_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = reshape.ids_in_bin(reshape.with_subgroups(s.profile_table(spark, sf_dir)), "ruolo_2", "Sostegno")
    return reshape.only(s.likert(spark, sf_dir), ids).groupBy("dataset", "question").agg(F.count(F.lit(1)).alias("n"))


# ---- Likert items

_E = erfc_sql("sqrt(x / 2e0)")
_CHI = (
    f"WITH {s.LIKERT_SQL}, o AS (SELECT unnest([1, 2, 3, 4]) AS option), g AS (SELECT DISTINCT question, dataset FROM likert_s), "
    "n AS (SELECT g.question, g.dataset, o.option, count(l.score) AS n FROM g CROSS JOIN o LEFT JOIN likert_s l ON l.question = g.question AND l.dataset = g.dataset AND l.score = o.option GROUP BY ALL)"
)
_PROPS = _CHI + " SELECT question, dataset, option, n, round(CASE WHEN sum(n) OVER w > 0 THEN n / sum(n) OVER w ELSE 0 END, 6) + 0e0 AS prop FROM n WINDOW w AS (PARTITION BY question, dataset)"
_BH = (
    "adj AS (SELECT *, least(min(coalesce(p, 1e0) * m / r) OVER (PARTITION BY {family} ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1e0) AS p_adj "
    "FROM (SELECT *, row_number() OVER (PARTITION BY {family} ORDER BY coalesce(p, 1e0), {tie}) AS r, count(*) OVER (PARTITION BY {family}) AS m FROM {source}) ranked)"
)
_STARS = "CASE WHEN {0} < 0.001 THEN '***' WHEN {0} < 0.01 THEN '**' WHEN {0} < 0.05 THEN '*' ELSE '' END AS stars"


@query(_PROPS)
def likert_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg.proportions(s.likert(spark, sf_dir)).withColumn("prop", r6("prop"))


_CHI2 = (
    _CHI + ", b AS (SELECT m.question, m.dataset, CAST(h.n AS DOUBLE) AS a, CAST(m.n AS DOUBLE) AS b FROM n m JOIN n h ON h.question = m.question AND h.option = m.option AND h.dataset = 'human' WHERE m.dataset <> 'human'), "
    "t AS (SELECT *, sum(a) OVER w AS na, sum(b) OVER w AS nb FROM b WINDOW w AS (PARTITION BY question, dataset)), "
    "e AS (SELECT *, (a + b) * na / (na + nb) AS ea, (a + b) * nb / (na + nb) AS eb FROM t WHERE a + b > 0), "
    "c AS (SELECT question, dataset, sum((a - ea) * (a - ea) / ea + (b - eb) * (b - eb) / eb) AS x, count(*) - 1 AS dof FROM e GROUP BY ALL), "
    f"p AS (SELECT question, dataset, x, dof, {_E} + sqrt(2e0 * x / pi()) * exp(-x / 2e0) AS p FROM c), "
    + _BH.format(family="question", tie="dataset", source="p")
    + f" SELECT question, dataset, round(x, 6) + 0e0 AS statistic, dof, round(p, 9) + 0e0 AS p, round(p_adj, 9) + 0e0 AS p_adj, {_STARS.format('p_adj')} FROM adj"
)


@query(_CHI2)
def likert_chi2(spark: SparkSession, sf_dir: str) -> DataFrame:
    tests = analyses.likert_tables(s.likert(spark, sf_dir))[1]
    return tests.select("question", "dataset", r6("statistic"), "dof", rounded(F.col("p"), 9).alias("p"), rounded(F.col("p_adj"), 9).alias("p_adj"), "stars")


_INDEX = f"""WITH {s.LIKERT_SQL}, i AS (
  SELECT dataset, respondent_id, max(score) FILTER (question = 'q17') AS q17_score, max(score) FILTER (question = 'q18') AS q18_score, max(score) FILTER (question = 'q19') AS q19_score FROM likert_s GROUP BY ALL),
x AS (SELECT *, list_avg(list_filter([q17_score, q18_score, q19_score], lambda v: v IS NOT NULL)) AS v FROM i)"""


@query(_INDEX + " SELECT dataset, respondent_id, q17_score, q18_score, q19_score, round(v, 6) + 0e0 AS skepticism_index_S FROM x")
def skepticism_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyses.index_table(s.likert(spark, sf_dir)).withColumn("skepticism_index_S", r6("skepticism_index_S"))


def _mwu_sql(source: str, keys: str, tail: str) -> str:
    """SQL of the Mann-Whitney test over (keys, dataset, v)."""
    k = "".join(f"{c}, " for c in keys.split(",") if c)
    same = " AND ".join(f"h.{c} = m.{c}" for c in keys.split(",") if c) or "TRUE"
    return (
        f"f AS (SELECT {k}dataset, v FROM {source} WHERE v IS NOT NULL), g AS (SELECT DISTINCT {k}dataset FROM f WHERE dataset <> 'human'), "
        f"u AS (SELECT {''.join(f'm.{c}, ' for c in keys.split(',') if c)}m.dataset, 1 AS base, h.v FROM g m JOIN f h ON {same} AND h.dataset = 'human' UNION ALL SELECT {k}dataset, 0, v FROM f WHERE dataset <> 'human'), "
        f"k AS (SELECT *, rank() OVER (PARTITION BY {k}dataset ORDER BY v) + (count(*) OVER (PARTITION BY {k}dataset, v) - 1) / 2e0 AS r, count(*) OVER (PARTITION BY {k}dataset, v) AS t FROM u), "
        f"q AS (SELECT {k}dataset, CAST(sum(base) AS DOUBLE) AS n1, CAST(count(*) - sum(base) AS DOUBLE) AS n2, sum(r * base) AS r1, sum(CAST(t AS DOUBLE) * t - 1e0) AS ties FROM k GROUP BY ALL), "
        f"z AS (SELECT *, r1 - n1 * (n1 + 1e0) / 2e0 AS u1, n1 * n2 / 12e0 * ((n1 + n2 + 1e0) - ties / ((n1 + n2) * (n1 + n2 - 1e0))) AS var FROM q), "
        f"zz AS (SELECT *, CASE WHEN n1 >= 3 AND n2 >= 3 AND var > 0 THEN (greatest(u1, n1 * n2 - u1) - n1 * n2 / 2e0 - 5e-1) / sqrt(var) END AS z FROM z), "
        f"p AS (SELECT *, CASE WHEN n1 < 3 OR n2 < 3 THEN NULL WHEN z IS NULL OR z < 0 THEN 1e0 ELSE least({erfc_sql('(z / 1.4142135623730951e0)')}, 1e0) END AS p FROM zz), " + tail
    )


_SHIFT = "s AS (SELECT question, dataset, avg(v) AS mean FROM src GROUP BY ALL), "


def _shift_sql(source: str) -> str:
    return (
        f"WITH {source}, "
        + _SHIFT
        + _mwu_sql("src", "question", "j AS (SELECT m.question, m.dataset, m.mean - h.mean AS shift, p.p FROM s m LEFT JOIN s h ON h.question = m.question AND h.dataset = 'human' LEFT JOIN p ON p.question = m.question AND p.dataset = m.dataset WHERE m.dataset <> 'human'), ")
        + _BH.format(family="question", tie="dataset", source="j")
        + f" SELECT question, dataset, round(shift, 6) + 0e0 AS shift, round(p, 9) + 0e0 AS p, round(p_adj, 9) + 0e0 AS p_adj, {_STARS.format('p_adj')} FROM adj"
    )


def _shift(df: DataFrame) -> DataFrame:
    return df.select("question", "dataset", r6("shift"), rounded(F.col("p"), 9).alias("p"), rounded(F.col("p_adj"), 9).alias("p_adj"), "stars")


@query(_shift_sql(f"{s.OPEN_SQL}, src AS (SELECT question, dataset, sentiment_score AS v FROM open_s WHERE dataset IS NOT NULL)"))
def open_sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shift(analyses.sentiment_shift(s.open_answers(spark, sf_dir).where("dataset IS NOT NULL"), exact=False))


@query(_shift_sql(f"{s.WORDS_SQL}, src AS (SELECT question, dataset, sentiment_score AS v FROM word_s)"))
def wordassoc_sentiment_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shift(analyses.sentiment_shift(s.words(spark, sf_dir), exact=False))


@query(_shift_sql(rf"{s.OPEN_SQL}, src AS (SELECT question, dataset, CAST(len(regexp_extract_all(raw, '[\p{{L}}\p{{N}}_]+')) AS DOUBLE) AS v FROM open_s WHERE dataset IS NOT NULL)"))
def mwu_wordcount(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = analyses.open_wordcounts(s.open_answers(spark, sf_dir).where("dataset IS NOT NULL"))
    return _shift(analyses.sentiment_shift(counts, value="word_count", exact=False))


@query(
    _INDEX + ", src AS (SELECT 'S' AS question, dataset, v FROM x), " + _SHIFT
    + _mwu_sql("src", "question", "j AS (SELECT m.question, m.dataset, m.mean - h.mean AS shift, p.p FROM s m LEFT JOIN s h ON h.dataset = 'human' LEFT JOIN p ON p.dataset = m.dataset WHERE m.dataset <> 'human'), ")
    + _BH.format(family="question", tie="dataset", source="j")
    + " SELECT dataset, round(shift, 6) + 0e0 AS mean_diff_vs_human, round(p, 9) + 0e0 AS p, round(p_adj, 9) + 0e0 AS p_adj FROM adj"
)
def skepticism_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = analyses.index_table(s.likert(spark, sf_dir)).withColumn("value", F.col("skepticism_index_S"))
    return analyses.skepticism(index, exact=False).select("dataset", r6("mean_diff_vs_human"), rounded(F.col("p"), 9).alias("p"), rounded(F.col("p_adj"), 9).alias("p_adj"))


@query(f"WITH {s.OPEN_SQL}, m AS (SELECT question, dataset, avg(sentiment_score) AS mean FROM open_s WHERE dataset IS NOT NULL GROUP BY ALL) SELECT m.question, m.dataset, round(m.mean, 6) + 0e0 AS mean, round(h.mean, 6) + 0e0 AS base_mean, round(m.mean - h.mean, 6) + 0e0 AS shift FROM m LEFT JOIN m h ON h.question = m.question AND h.dataset = 'human' WHERE m.dataset <> 'human'")
def sentiment_mean_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.mean_shift(s.open_answers(spark, sf_dir).where("dataset IS NOT NULL"), value="sentiment_score").select("question", "dataset", r6("mean"), r6("base_mean"), r6("shift"))


@query("WITH t AS (SELECT l_returnflag AS family, l_orderkey, l_linenumber, CASE WHEN l_orderkey % 10 = 0 THEN NULL ELSE l_discount * l_tax END AS p FROM lineitem), " + _BH.format(family="family", tie="l_orderkey, l_linenumber", source="t") + f" SELECT family, l_orderkey, l_linenumber, round(p_adj, 9) + 0e0 AS p_adj, {_STARS.format('p')} FROM adj")
def bh_adjust(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = s.table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("family"), "l_orderkey", "l_linenumber", F.when(F.col("l_orderkey") % 10 != 0, F.col("l_discount") * F.col("l_tax")).alias("p"))
    out = stats.bh_adjust(t, ("family",), ties=("l_orderkey", "l_linenumber"))
    return out.select("family", "l_orderkey", "l_linenumber", rounded(F.col("p_adj"), 9).alias("p_adj"), stars(F.col("p")).alias("stars"))


# ---- word associations


@query(f"WITH {s.WORDS_SQL} SELECT question, dataset, count(key) AS total_n, count(DISTINCT key) AS unique_n, round(100e0 * count(DISTINCT key) / nullif(count(key), 0), 6) + 0e0 AS unique_pct FROM word_s GROUP BY ALL")
def unique_answer_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyses.unique_answers(s.words(spark, sf_dir)).withColumn("unique_pct", r6("unique_pct"))




def _events(spark: SparkSession, sf_dir: str) -> list[str]:
    return sorted(r[0] for r in s.table(spark, sf_dir, "events").select("event_type").distinct().collect())


@query(
    f"WITH {s.WORDS_SQL}, u AS (SELECT question, dataset, 100e0 * count(DISTINCT key) / nullif(count(key), 0) AS v FROM word_s GROUP BY ALL) SELECT question, "
    + ", ".join(f"round(max(v) FILTER (dataset = '{d}'), 6) + 0e0 AS \"{d}\"" for d in SYSTEMS)
    + " FROM u GROUP BY question"
)
def unique_pct_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = reshape.to_wide(agg.distinct_share(s.words(spark, sf_dir)), _events(spark, sf_dir), SYSTEMS, value="unique_pct")
    return wide.select("question", *[rounded(F.col(f"`{d}`")).alias(d) for d in SYSTEMS])


_ENTROPY = (
    "c AS (SELECT {k}, key, CAST(count(*) AS DOUBLE) AS c FROM {source} WHERE key IS NOT NULL GROUP BY ALL), "
    "t AS (SELECT *, sum(c) OVER (PARTITION BY {k}) AS n FROM c), "
    "h AS (SELECT {k}, max(n) AS n, CAST(count(*) AS DOUBLE) AS kk, sum(-(c / n) * ln(c / n + 1e-12)) AS h FROM t GROUP BY ALL), "
    "e AS (SELECT {k}, n, kk, CASE WHEN n < 2 THEN NULL WHEN kk = 1 THEN 0e0 ELSE h / ln(kk + 1e-12) END AS entropy FROM h)"
)


@query(f"WITH {s.WORDS_SQL}, " + _ENTROPY.format(k="question, dataset", source="word_s") + " SELECT question, dataset, CAST(n AS BIGINT) AS n, CAST(kk AS BIGINT) AS k, round(entropy, 6) + 0e0 AS entropy FROM e")
def entropy_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg.normalized_entropy(s.words(spark, sf_dir)).withColumn("entropy", r6("entropy"))


def _hex(text: str) -> str:
    return f"CAST(('0x' || substr({text}, 1, 8)) AS BIGINT)"


_BOOT = (
    f"WITH {s.WORDS_SQL}, ids AS (SELECT *, count(*) OVER (PARTITION BY question, dataset) AS n, row_number() OVER (PARTITION BY question, dataset ORDER BY respondent_id) - 1 AS slot FROM (SELECT DISTINCT question, dataset, respondent_id FROM word_s)), "
    "big AS (SELECT * FROM ids WHERE n >= 10), reps AS (SELECT unnest(range({reps})) AS rep), "
    "d AS (SELECT DISTINCT question, dataset, rep, " + _hex("md5('42|bootstrap|' || question || '|' || dataset || '|' || rep || '|' || slot)") + " % n AS slot FROM big CROSS JOIN reps), "
    "w AS (SELECT d.question, d.dataset, d.rep, s.key FROM d JOIN big i ON i.question = d.question AND i.dataset = d.dataset AND i.slot = d.slot JOIN word_s s ON s.question = d.question AND s.dataset = d.dataset AND s.respondent_id = i.respondent_id), "
)


@query(_BOOT.format(reps=BOOTSTRAPS) + _ENTROPY.format(k="question, dataset, rep", source="w") + " SELECT question, dataset, CAST(rep AS INTEGER) AS rep, round(entropy, 6) + 0e0 AS entropy FROM e")
def bootstrap_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.bootstrap_entropy(s.words(spark, sf_dir)).withColumn("entropy", r6("entropy"))


@query(
    _BOOT.format(reps=BOOTSTRAPS) + _ENTROPY.format(k="question, dataset, rep", source="w").replace("c AS", "bc AS").replace("FROM c)", "FROM bc)").replace("t AS", "bt AS").replace("FROM t ", "FROM bt ").replace("h AS (", "bh AS (").replace("FROM h)", "FROM bh)").replace("e AS (", "be AS (")
    + ", src AS (SELECT question, dataset, round(entropy, 9) AS v FROM be), "
    + _ENTROPY.format(k="question, dataset", source="word_s").replace("c AS", "pc AS").replace("FROM c)", "FROM pc)").replace("t AS", "pt AS").replace("FROM t ", "FROM pt ").replace("h AS (", "ph AS (").replace("FROM h)", "FROM ph)").replace("e AS (", "pe AS (") + ", "
    + _mwu_sql("src", "question", "j AS (SELECT m.question, m.dataset, h.entropy AS human, m.entropy AS model, m.entropy - h.entropy AS value, p.p FROM pe m LEFT JOIN pe h ON h.question = m.question AND h.dataset = 'human' LEFT JOIN p ON p.question = m.question AND p.dataset = m.dataset WHERE m.dataset <> 'human'), ")
    + _BH.format(family="question", tie="dataset", source="j")
    + " SELECT question, dataset, round(human, 6) + 0e0 AS human, round(model, 6) + 0e0 AS model, round(value, 6) + 0e0 AS value, round(abs(value), 6) + 0e0 AS abs_value, round(p, 9) + 0e0 AS p, round(p_adj, 9) + 0e0 AS p_adj FROM adj"
)
def entropy_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = analyses.entropy_delta(s.words(spark, sf_dir))
    return out.select("question", "dataset", r6("human"), r6("model"), r6("value"), r6("abs_value"), rounded(F.col("p"), 9).alias("p"), rounded(F.col("p_adj"), 9).alias("p_adj"))


# ---- keyness

_KEY = (
    f"WITH {s.KEYNESS_SQL}, x AS (SELECT question, dataset, unnest(tokens) AS token FROM key_s), "
    "c AS (SELECT question, token, count(*) FILTER (dataset = 'human') AS count_a, count(*) FILTER (dataset <> 'human') AS count_b FROM x GROUP BY ALL), "
    "t AS (SELECT *, CAST(sum(count_a) OVER w AS DOUBLE) AS na, CAST(sum(count_b) OVER w AS DOUBLE) AS nb, CAST(count(*) OVER w AS DOUBLE) AS v FROM c WINDOW w AS (PARTITION BY question)), "
    "k AS (SELECT *, (count_a + 1e-2) / (na + 1e-2 * v) AS pa, (count_b + 1e-2) / (nb + 1e-2 * v) AS pb FROM t WHERE count_a + count_b >= 5), "
    "l AS (SELECT *, ln(pb / (1e0 - pb)) - ln(pa / (1e0 - pa)) AS log_odds FROM k), "
    "zz AS (SELECT *, log_odds / sqrt(1e0 / (count_b + 1e-2) + 1e0 / (count_a + 1e-2)) AS z FROM l), "
    f"pp AS (SELECT *, {erfc_sql('(abs(z) / 1.4142135623730951e0)')} AS p FROM zz), " + _BH.format(family="question", tie="token", source="pp")
)


@query(_KEY + " SELECT question, token, count_a, count_b, round(log_odds, 6) + 0e0 AS log_odds, round(z, 6) + 0e0 AS z, round(p, 9) + 0e0 AS p, round(p_adj, 9) + 0e0 AS p_adj FROM adj")
def keyness_log_odds(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = keyness.log_odds(keyness.token_counts(s.keyness(spark, sf_dir)))
    return out.select("question", "token", "count_a", "count_b", r6("log_odds"), r6("z"), rounded(F.col("p"), 9).alias("p"), rounded(F.col("p_adj"), 9).alias("p_adj"))


@query(
    _KEY + ", sig AS (SELECT *, CASE WHEN z > 0 THEN 'system' ELSE 'human' END AS side FROM adj WHERE p_adj < 0.05 AND z <> 0), top AS (SELECT *, row_number() OVER (PARTITION BY question, side ORDER BY round(abs(z), 9) DESC, token) AS tr FROM sig) "
    "SELECT q.question, coalesce(string_agg(token, ';' ORDER BY tr) FILTER (side = 'human'), '') AS human, coalesce(string_agg(token, ';' ORDER BY tr) FILTER (side = 'system'), '') AS system "
    "FROM (SELECT DISTINCT question FROM adj) q LEFT JOIN top ON top.question = q.question AND tr <= 10 GROUP BY q.question"
)
def keyness_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    kdf = keyness.log_odds(keyness.token_counts(s.keyness(spark, sf_dir)))
    return keyness.top_terms(kdf.withColumn("z", F.round("z", 9)))


# ---- vectors and resampling

_ENERGY = (
    f"WITH {s.EMBEDDINGS_SQL}, d AS (SELECT a.question, a.dataset AS x, b.dataset AS y, avg(sqrt(greatest(2e0 - 2e0 * list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 0e0))) AS d FROM emb_s a JOIN emb_s b ON a.question = b.question AND ((a.dataset = b.dataset AND a.id < b.id) OR (a.dataset = 'human' AND b.dataset <> 'human')) GROUP BY ALL) "
    "SELECT c.question, c.y AS dataset, round(greatest(2e0 * c.d - h.d - m.d, 0e0), 6) + 0e0 AS value FROM d c LEFT JOIN d h ON h.question = c.question AND h.x = 'human' AND h.y = 'human' LEFT JOIN d m ON m.question = c.question AND m.x = c.y AND m.y = c.y WHERE c.x = 'human' AND c.y <> 'human'"
)


@query(_ENERGY)
def energy_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.energy_distance(s.embeddings(spark, sf_dir)).withColumn("value", r6("value"))


@query(_ENERGY)
def energy_distance_gemm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.permutation_test(s.embeddings(spark, sf_dir), n=1).select("question", "dataset", r6("value"))


def _resampled(units: str, drawn_by: str, reps: int, first: str, observed: bool) -> str:
    """CTE st (question, dataset, rep, value): energy distances where the ``first`` rows of each
    shuffle of u (question, dataset, label, base, e) are one side, and, as repetition -1, base rows."""
    return (
        f"u AS ({units}), reps AS (SELECT unnest(range({reps})) AS rep), "
        "pr AS (SELECT a.question, a.dataset, a.label AS i, b.label AS j, sqrt(greatest(2e0 - 2e0 * list_inner_product(CAST(a.e AS DOUBLE[]), CAST(b.e AS DOUBLE[])), 0e0)) AS d FROM u a JOIN u b ON a.question = b.question AND a.dataset = b.dataset AND a.label < b.label), "
        f"sz AS (SELECT question, dataset, CAST({first} AS BIGINT) AS n1, count(*) AS n FROM u GROUP BY ALL), "
        "tot AS (SELECT question, dataset, sum(d) AS t FROM pr GROUP BY ALL), "
        "ro AS (SELECT question, dataset, label, sum(d) AS s FROM (SELECT question, dataset, i AS label, d FROM pr UNION ALL SELECT question, dataset, j, d FROM pr) GROUP BY ALL), "
        f"o AS (SELECT question, dataset, rep, label, row_number() OVER (PARTITION BY question, dataset, rep ORDER BY md5('42|{drawn_by} || '|' || rep || '|' || label), label) AS r FROM u CROSS JOIN reps), "
        "sx AS (SELECT question, dataset, rep, label FROM o JOIN sz USING (question, dataset) WHERE r <= n1" + (" UNION ALL SELECT question, dataset, -1, label FROM u WHERE base = 1" if observed else "") + "), "
        "xx AS (SELECT a.question, a.dataset, a.rep, sum(d) AS xx FROM sx a JOIN pr ON pr.question = a.question AND pr.dataset = a.dataset AND pr.i = a.label JOIN sx b ON b.question = a.question AND b.dataset = a.dataset AND b.rep = a.rep AND b.label = pr.j GROUP BY ALL), "
        "xs AS (SELECT question, dataset, rep, sum(s) AS xs FROM sx JOIN ro USING (question, dataset, label) GROUP BY ALL), "
        "st AS (SELECT question, dataset, rep, greatest(2e0 * (xs - 2e0 * xx) / (n1 * (n - n1)) - 2e0 * xx / (n1 * (n1 - 1)) - 2e0 * (t - xs + xx) / ((n - n1) * (n - n1 - 1)), 0e0) AS value "
        "FROM xs JOIN xx USING (question, dataset, rep) JOIN sz USING (question, dataset) JOIN tot USING (question, dataset) WHERE n1 >= 2 AND n - n1 >= 2)"
    )


def _permutation_sql(source: str) -> str:
    units = (
        "SELECT m.question, m.dataset, '1|' || h.id AS label, 1 AS base, h.embedding AS e FROM (SELECT DISTINCT question, dataset FROM emb_s WHERE dataset <> 'human') m JOIN emb_s h ON h.question = m.question AND h.dataset = 'human' "
        "UNION ALL SELECT question, dataset, '0|' || id, 0, embedding FROM emb_s WHERE dataset <> 'human'"
    )
    return (
        f"WITH {source}, " + _resampled(units, "permutation|' || question || '|' || dataset", PERMUTATIONS, "sum(base)", True)
        + f", ob AS (SELECT question, dataset, value FROM st WHERE rep = -1), ge AS (SELECT question, dataset, any_value(ob.value) AS value, (count(*) FILTER (st.rep >= 0 AND st.value >= ob.value - 1e-12) + 1) / {PERMUTATIONS + 1}e0 AS p FROM st JOIN ob USING (question, dataset) GROUP BY ALL), "
        + "pt AS (SELECT question, dataset, value, p FROM (SELECT DISTINCT question, dataset FROM emb_s WHERE dataset <> 'human') LEFT JOIN ge USING (question, dataset)), " + _BH.format(family="question", tie="dataset", source="pt")
        + f" SELECT question, dataset, round(value, 6) + 0e0 AS value, round(p, 9) + 0e0 AS p, round(p_adj, 9) + 0e0 AS p_adj, {_STARS.format('p_adj')} FROM adj"
    )


def _permutation(df: DataFrame) -> DataFrame:
    return df.select("question", "dataset", r6("value"), rounded(F.col("p"), 9).alias("p"), rounded(F.col("p_adj"), 9).alias("p_adj"), "stars")


@query(_permutation_sql(s.EMBEDDINGS_SQL))
def permutation_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _permutation(analyses.embedding_fidelity(s.embeddings(spark, sf_dir)))


@query(_permutation_sql(s.WORD_EMBEDDINGS_SQL))
def word_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _permutation(analyses.word_energy(s.word_embeddings(spark, sf_dir)))


_BAND = (
    " SELECT question, count(value) AS n, round(min(value), 6) + 0e0 AS low, round(avg(value), 6) + 0e0 AS mean, round(max(value), 6) + 0e0 AS high, round(stddev_pop(value), 6) + 0e0 AS sd, round(quantile_cont(value, 0.25), 6) + 0e0 AS q25, round(quantile_cont(value, 0.5), 6) + 0e0 AS median, "
    "round(quantile_cont(value, 0.75), 6) + 0e0 AS q75, round(quantile_cont(value, 0.95), 6) + 0e0 AS q95, round(quantile_cont(abs(value), 0.95), 6) + 0e0 AS abs_q95 FROM {0} GROUP BY question"
)


def _band(df: DataFrame) -> DataFrame:
    out = agg.noise_band(df)
    return out.select(*[c if c in ("question", "n") else r6(c) for c in out.columns])


@query(f"WITH {s.EMBEDDINGS_SQL}, " + _resampled("SELECT question, dataset, CAST(id AS VARCHAR) AS label, 1 AS base, embedding AS e FROM emb_s WHERE dataset = 'human'", "split|' || question", SPLITS, "count(*) // 2", False) + _BAND.format("st"))
def embedding_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _band(analyses.embedding_noise(s.embeddings(spark, sf_dir)))


def _split_sql(source: str) -> str:
    return (
        f"WITH {source}, reps AS (SELECT unnest(range({SPLITS})) AS rep), "
        "o AS (SELECT question, rep, respondent_id, row_number() OVER (PARTITION BY question, rep ORDER BY md5('42|split|' || question || '|' || rep || '|' || respondent_id), respondent_id) AS r, count(*) OVER (PARTITION BY question, rep) AS n FROM (SELECT DISTINCT question, respondent_id FROM v) CROSS JOIN reps), "
        "f AS (SELECT o.question, o.rep, avg(v.v) FILTER (r <= n // 2) - avg(v.v) FILTER (r > n // 2) AS value FROM o JOIN v ON v.question = o.question AND v.respondent_id = o.respondent_id GROUP BY ALL)"
    )


_SPLIT = _split_sql(f"{s.OPEN_SQL}, v AS (SELECT question, respondent_id, sentiment_score AS v FROM open_s WHERE dataset = 'human')")


def _split(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = s.open_answers(spark, sf_dir).where(F.col("dataset") == BASELINE).withColumn("value", F.col("sentiment_score"))
    return resample.split_half_mean(people)


@query(_SPLIT + " SELECT question, CAST(rep AS INTEGER) AS rep, round(value, 6) + 0e0 AS value FROM f")
def split_half_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split(spark, sf_dir).withColumn("value", r6("value"))


@query(_SPLIT + _BAND.format("f"))
def noise_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _band(_split(spark, sf_dir))


@query(_split_sql(_INDEX.removeprefix("WITH ") + ", v AS (SELECT 'S' AS question, respondent_id, v FROM x WHERE dataset = 'human')") + _BAND.format("f"))
def index_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _band(analyses.index_noise(analyses.index_table(s.likert(spark, sf_dir))))


@query(
    rf"WITH {s.OPEN_SQL}, v AS (SELECT question, dataset, CAST(len(regexp_extract_all(raw, '[\p{{L}}\p{{N}}_]+')) AS DOUBLE) AS v FROM open_s WHERE dataset IS NOT NULL), "
    "q AS (SELECT question, dataset, count(*) AS n, quantile_cont(v, 0.25) AS q25, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q75 FROM v GROUP BY ALL) "
    "SELECT q.question, q.dataset, any_value(n) AS n, any_value(q25) AS q25, any_value(median) AS median, any_value(q75) AS q75, min(v) AS whisker_low, max(v) AS whisker_high FROM q JOIN v ON v.question = q.question AND v.dataset = q.dataset AND v >= q25 - 1.5 * (q75 - q25) AND v <= q75 + 1.5 * (q75 - q25) GROUP BY q.question, q.dataset"
)
def wordcount_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = analyses.open_wordcounts(s.open_answers(spark, sf_dir).where("dataset IS NOT NULL"))
    return agg.box_summary(counts, value="word_count")


# ---- enrichment and simulation


@query(f"SELECT DISTINCT n AS text FROM (SELECT {_norm('unnest([role, text])')} AS n FROM conversations) WHERE length(n) >= 3")
def distinct_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.distinct_answers(s.table(spark, sf_dir, "conversations"), ["role", "text"])


_VALUES = [":", "A.", "A)", "e", "vuota", "a: per niente d'accordo", "A: Per niente d'accordo", "per niente d'accordo", "", " ", "d", "f: x", "b: altro", "C:", "un po' d'accordo", "Axyz", "A. x"]


@query(
    "WITH t AS (SELECT unnest([" + ", ".join("'" + v.replace("'", "''") + "'" for v in _VALUES) + "]) AS answer), o AS (SELECT unnest([" + ", ".join("'" + v.replace("'", "''") + "'" for v in tx.OPTIONS) + "]) AS option), "
    "c AS (SELECT answer, lower(trim(answer)) AS low, rtrim(rtrim(string_split(lower(trim(answer)), ' ')[1], ':'), '.') AS code FROM t) "
    "SELECT answer, low <> '' AND (low IN (SELECT option FROM o) OR EXISTS (SELECT 1 FROM o WHERE starts_with(option, code))) AS valid, "
    "CASE WHEN substr(answer, 2, 2) IN (': ', '. ') THEN substr(answer, 4) ELSE answer END AS strict, CASE WHEN length(answer) > 3 THEN substr(answer, 4) ELSE answer END AS loose, trim(replace(answer, 'vuota', '')) AS void FROM c"
)
def answer_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.createDataFrame([(v,) for v in _VALUES], "answer string")
    c = F.col("answer")
    return t.select("answer", tx.valid_option(c).alias("valid"), tx.strip_code(c).alias("strict"), tx.strip_code(c, strict=False).alias("loose"), tx.without_void(c).alias("void"))


def _people(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = s.table(spark, sf_dir, "customer")
    role = F.when(F.col("c_custkey") % 3 == 0, enrich.TEACHERS[0]).when(F.col("c_custkey") % 3 == 1, enrich.TEACHERS[1]).otherwise("Altro")
    return c.select(F.col("c_custkey").alias("respondent_id"), F.col("c_mktsegment").alias("Genere"), F.col("c_nationkey").cast("string").alias("Età"), F.lit("Laurea").alias("Istruzione"), F.col("c_name").alias("Regione"), role.alias("Ruolo"), F.lit("5").alias("Anni esp"), F.lit("x").alias("Ambito"), F.when(F.col("c_custkey") % 2 == 0, enrich.UPPER).otherwise("Primaria").alias("Grado"), F.lit("liceo").alias("SSSG"))


@query(
    "WITH p AS (SELECT c_custkey AS respondent_id, c_custkey % 3 < 2 AS teacher, 'Answer a questionnaire as this person would.' || chr(10) || '- Genere: ' || c_mktsegment || chr(10) || '- Età: ' || c_nationkey || chr(10) || '- Istruzione: Laurea' || chr(10) || '- Regione: ' || c_name || chr(10) "
    "|| '- Ruolo: ' || CASE c_custkey % 3 WHEN 0 THEN 'Insegnante di sostegno' WHEN 1 THEN 'Insegnante curricolare' ELSE 'Altro' END || chr(10) AS head, CASE WHEN c_custkey % 2 = 0 THEN 'Secondaria di II grado' ELSE 'Primaria' END AS grade FROM customer), "
    "t AS (SELECT respondent_id, head || CASE WHEN teacher THEN '- Anni esp: 5' || chr(10) || '- Ambito: x' || chr(10) || '- Grado: ' || grade || chr(10) ELSE '' END || CASE WHEN teacher AND grade LIKE '%II grado' THEN '- SSSG: liceo' || chr(10) ELSE '' END "
    "|| 'Give one JSON object with the keys q1, q2 (a sentence each), q3 to q16 (one word each), q17' || CASE WHEN teacher THEN ', q18, q19' ELSE '' END || ' (one of " + "; ".join(tx.OPTIONS).replace("'", "''") + ").' || chr(10) AS prompt FROM p) "
    "SELECT respondent_id, length(prompt) AS n_chars, md5(prompt) AS prompt_md5 FROM t"
)
def prompt_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = enrich.profile_prompt()
    return _people(spark, sf_dir).select("respondent_id", F.length(p).cast("long").alias("n_chars"), F.md5(p).alias("prompt_md5"))


@query(
    "WITH g AS (SELECT item_id, " + _hex("md5(substr(t, i + 1, 3))") + " AS h FROM (SELECT item_id, t, unnest(range(greatest(1, length(t) - 2))) AS i FROM (SELECT item_id, coalesce(text, '') AS t FROM benchmark))), "
    "c AS (SELECT item_id, h % 64 AS d, sum(CASE WHEN (h & 1024) > 0 THEN 1 ELSE -1 END) AS c FROM g GROUP BY ALL), "
    "a AS (SELECT item_id, d, coalesce(c, 0) AS c FROM (SELECT item_id, unnest(range(64)) AS d FROM benchmark) LEFT JOIN c USING (item_id, d)) "
    "SELECT item_id, CAST(count(*) AS INTEGER) AS size, string_agg(CASE WHEN c > 0 THEN '+' WHEN c < 0 THEN '-' ELSE '0' END, '' ORDER BY d) AS signs, CAST(arg_max(d, c * 100 - d) AS BIGINT) AS top, 1e0 AS norm FROM a GROUP BY item_id"
)
def embed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each vector its size, the signs of its components, the place of the greatest and the norm."""
    e = F.col("embedding")
    sign = F.transform(e, lambda x: F.when(x > 0, "+").when(x < 0, "-").otherwise("0"))
    norm = F.sqrt(F.aggregate(e, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    out = vectors.embed(s.table(spark, sf_dir, "benchmark"), enrich.StubEmbedder)
    return out.select("item_id", F.size(e).alias("size"), F.array_join(sign, "").alias("signs"), (F.array_position(e, F.array_max(e)) - 1).alias("top"), rounded(norm, 5).alias("norm"))


_RAW = "CASE o_orderkey % 5 WHEN 0 THEN '[\"positivo\", [\"gioia\", \"noia\"]]' WHEN 1 THEN '[\"neutro\", []]' WHEN 2 THEN '[\"strano\", [\"paura\"]]' WHEN 3 THEN 'x' ELSE '[\"negativo\", [\"paura\", \"paura\"]]' END"


@query(
    "WITH t AS (SELECT o_orderkey, o_orderkey % 5 AS k FROM orders) SELECT o_orderkey, k IN (0, 1, 4) AS valid, CASE k WHEN 0 THEN 'gioia' WHEN 1 THEN '' WHEN 2 THEN 'paura' WHEN 4 THEN 'paura,paura' END AS emotions, CASE k WHEN 0 THEN 'noia' WHEN 1 THEN '' WHEN 2 THEN '' WHEN 4 THEN '' END AS unknown FROM t"
)
def enrichment_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("<think>so\n</think>```json\n"), F.expr(_RAW), F.lit("\n```"))
    t = s.table(spark, sf_dir, "orders").select("o_orderkey", tx.unfenced(tx.strip_think(raw)).alias("raw"))
    label = F.get_json_object("raw", "$[0]")
    emotions = F.from_json(F.get_json_object("raw", "$[1]"), "array<string>")
    return t.select("o_orderkey", tx.valid_enrichment(label, emotions).alias("valid"), F.array_join(tx.known_emotions(emotions), ",").alias("emotions"), F.array_join(tx.unknown_emotions(emotions), ",").alias("unknown"))


_MEMBERS = (
    f"{s.PROFILE_SQL}, m0 AS (SELECT respondent_id, unnest(['esperienza_2|' || {_bin('Anni esp', EXPERIENCE_BINS)}, 'ruolo_2|' || {_bin('Ruolo', ROLE_BINS)}, 'grado_2|' || {_bin('Grado', GRADE_BINS)}]) AS sub FROM profile_s WHERE dataset = 'human'), "
    f"members AS (SELECT DISTINCT respondent_id, sub FROM m0 WHERE sub IN (SELECT sub FROM m0 WHERE sub IS NOT NULL GROUP BY sub HAVING count(DISTINCT respondent_id) >= {MIN_IDS}))"
)


@query(f"WITH {_MEMBERS}, {s.LIKERT_SQL} SELECT split_part(sub, '|', 1) AS subgroup, split_part(sub, '|', 2) AS bin, question, dataset, count(*) AS n, round(avg(score), 6) + 0e0 AS mean FROM likert_s JOIN members USING (respondent_id) GROUP BY ALL")
def subgroup_suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = lambda df: df.groupBy("question", "dataset").agg(F.count(F.lit(1)).alias("n"), r6("mean", F.avg("score")))
    return analyses.subgroup_suite(reshape.with_subgroups(s.profile_table(spark, sf_dir)), s.likert(spark, sf_dir), means)


@query(_PROPS.replace("SELECT question, dataset, option, n, round(", "SELECT question, dataset, option, prop, round(coalesce(sum(prop0) OVER (PARTITION BY question, dataset ORDER BY option ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 6) + 0e0 AS start FROM (SELECT question, dataset, option, CASE WHEN sum(n) OVER w > 0 THEN n / sum(n) OVER w ELSE 0 END AS prop0, round(") .replace("WINDOW w AS (PARTITION BY question, dataset)", "WINDOW w AS (PARTITION BY question, dataset)) x"))
def likert_stacked(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = export.stacked_likert(agg.proportions(s.likert(spark, sf_dir)), SYSTEMS)
    return out.select("question", "dataset", "option", r6("prop"), r6("start"))


def _in_subgroups(name: str, source: str, table: str, key: str = "respondent_id") -> str:
    """A query's SQL over its table once for each subgroup, the subgroup put before the question."""
    rows = source.replace(f"{table} AS (", f"{table}0 AS (", 1)
    return ORACLE_SQL[name].replace(source, f"{_MEMBERS}, {rows}, {table} AS (SELECT o.* REPLACE (members.sub || '|' || o.question AS question) FROM {table}0 o JOIN members ON members.respondent_id = o.{key})", 1)


#: Analysis, its item, value and adjusted p, and its SQL.
_SUITE = (
    ("embedding_fidelity", "dataset", "value", "p_adj", _in_subgroups("permutation_test", s.EMBEDDINGS_SQL, "emb_s", "id")),
    ("word_energy", "dataset", "value", "p_adj", _in_subgroups("word_energy", s.WORD_EMBEDDINGS_SQL, "emb_s", "id")),
    ("open_sentiment", "dataset", "shift", "p_adj", _in_subgroups("open_sentiment", s.OPEN_SQL, "open_s")),
    ("wordcount_box", "dataset", "median", "NULL", _in_subgroups("wordcount_box", s.OPEN_SQL, "open_s")),
    ("wordassoc_sentiment", "dataset", "shift", "p_adj", _in_subgroups("wordassoc_sentiment_shift", s.WORDS_SQL, "word_s")),
    ("unique_answers", "dataset", "unique_pct", "NULL", _in_subgroups("unique_answer_pct", s.WORDS_SQL, "word_s")),
    ("entropy_delta", "dataset", "value", "p_adj", _in_subgroups("entropy_delta", s.WORDS_SQL, "word_s")),
    ("keyness", "token", "z", "p_adj", _in_subgroups("keyness_log_odds", s.KEYNESS_SQL, "key_s")),
    ("likert_props", "concat(dataset, ' ', CAST(option AS STRING))", "prop", "NULL", _in_subgroups("likert_props", s.LIKERT_SQL, "likert_s")),
    ("likert_chi2", "dataset", "statistic", "p_adj", _in_subgroups("likert_chi2", s.LIKERT_SQL, "likert_s")),
    (
        "skepticism", "dataset", "shift", "p_adj",
        _shift_sql(
            f"{_MEMBERS}, {s.LIKERT_SQL}, i AS (SELECT sub, dataset, respondent_id, max(score) FILTER (question = 'q17') AS a, max(score) FILTER (question = 'q18') AS b, max(score) FILTER (question = 'q19') AS c FROM likert_s JOIN members USING (respondent_id) GROUP BY ALL), "
            "src AS (SELECT sub || '|S' AS question, dataset, list_avg(list_filter([a, b, c], lambda v: v IS NOT NULL)) AS v FROM i)"
        ),
    ),
)


@query(
    " UNION ALL ".join(
        f"SELECT '{name}' AS analysis, split_part(question, '|', 1) AS subgroup, split_part(question, '|', 2) AS bin, split_part(question, '|', 3) AS question, {item} AS item, round(CAST({value} AS DOUBLE), 6) + 0e0 AS value, CAST({p} AS DOUBLE) AS p_adj FROM ({sql})"
        for name, item, value, p, sql in _SUITE
    )
)
def subgroup_analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_id = lambda df: df.withColumn("respondent_id", F.col("id"))
    tables = {
        "open": s.open_answers(spark, sf_dir).where("dataset IS NOT NULL"),
        "words": s.words(spark, sf_dir),
        "likert": s.likert(spark, sf_dir),
        "embeddings": by_id(s.embeddings(spark, sf_dir)),
        "word_embeddings": by_id(s.word_embeddings(spark, sf_dir)),
        "keyness": s.keyness(spark, sf_dir),
    }
    found = analyses.subgroup_analyses(reshape.with_subgroups(s.profile_table(spark, sf_dir)), tables, exact=False)
    out = None
    for name, item, value, p, _ in _SUITE:
        part = found[name].select(F.lit(name).alias("analysis"), "subgroup", "bin", "question", F.expr(item).alias("item"), r6("value", F.col(value)), rounded(F.expr(f"CAST({p} AS DOUBLE)"), 9).alias("p_adj"))
        out = part if out is None else out.unionByName(part)
    return out


@query(
    f"WITH l AS (SELECT lower(split_part(p_name, ' ', 1)) AS w, min(nullif(trim(lower(p_type)), '')) AS l FROM part GROUP BY 1), t AS (SELECT p_partkey, unnest(x) AS w, generate_subscripts(x, 1) AS pos FROM (SELECT p_partkey, regexp_extract_all(lower(p_name), '{TOKEN.replace(chr(39), chr(39) * 2)}') AS x FROM part)), "
    f"k AS (SELECT p_partkey, pos, w, coalesce(l, w) AS lemma FROM t LEFT JOIN l USING (w)) SELECT p_partkey, coalesce(string_agg(lemma, ';' ORDER BY pos) FILTER (w NOT IN ('blue', 'part') AND length(lemma) >= 3 AND NOT (length(lemma) < 6 AND contains(lemma, ' ')) AND regexp_matches(lemma, '{LETTERS}')), '') AS lemmas FROM k GROUP BY p_partkey"
)
def keyness_lemmas(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = s.table(spark, sf_dir, "part")
    lemmas = part.select(F.substring_index("p_name", " ", 1).alias("word"), F.col("p_type").alias("lemma"))
    out = lookup.keyness_lemmas(part, lemmas, ["p_partkey"], "p_name", ("blue", "part"))
    return out.select("p_partkey", F.array_join("tokens", ";").alias("lemmas"))
