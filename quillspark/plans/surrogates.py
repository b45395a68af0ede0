"""The driver's tables in the shapes of a study, as DataFrames and as SQL.

The study's own data isn't public, so its analyses run over stand-ins: documents for open
answers, orders for Likert items, events for word associations, embeddings, conversations for
keyness tokens, parts for a lexicon and customers for profiles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..schema import BASELINE, EXPERIENCE_BINS, GRADE_BINS

#: Datasets that rows are dealt to by number.
DEALT = ("human", "gpt", "gemma", "gpt-oss", "llama", "qwen")


#: Profile fields that customers are dealt, the last of each not to be recoded.
YEARS = (*EXPERIENCE_BINS, "nan")
GRADES = (*GRADE_BINS, " none ")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _of(c, *pairs):
    out = None
    for k, v in pairs:
        out = F.when(c == k, v) if out is None else out.when(c == k, v)
    return out


def open_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dataset, respondent_id, question, raw, sentiment_score."""
    labels = table(spark, sf_dir, "labels")
    score = F.when(F.col("toxic") == 1, -1).when(F.col("quality") == 1, 1).when(F.col("quality") == 0, 0)
    return table(spark, sf_dir, "documents").join(labels, "doc_id", "left").select(
        _of(F.col("lang"), ("en", BASELINE), ("fr", "gemma"), ("de", "llama"), ("es", "qwen")).alias("dataset"),
        F.col("doc_id").alias("respondent_id"),
        F.when(F.col("doc_id") % 2 == 0, "q1").otherwise("q2").alias("question"),
        F.col("text").alias("raw"),
        score.alias("sentiment_score"),
    )


OPEN_SQL = """open_s AS (
  SELECT CASE lang WHEN 'en' THEN 'human' WHEN 'fr' THEN 'gemma' WHEN 'de' THEN 'llama' WHEN 'es' THEN 'qwen' END AS dataset,
         doc_id AS respondent_id, CASE WHEN doc_id % 2 = 0 THEN 'q1' ELSE 'q2' END AS question, text AS raw,
         CASE WHEN toxic = 1 THEN -1 WHEN quality = 1 THEN 1 WHEN quality = 0 THEN 0 END AS sentiment_score
  FROM documents LEFT JOIN labels USING (doc_id))"""


def likert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dataset, respondent_id, question, score."""
    first = F.substring("o_orderpriority", 1, 1).cast("int")
    return table(spark, sf_dir, "orders").select(
        _of(F.col("o_orderstatus"), ("F", BASELINE), ("O", "gemma"), ("P", "llama")).alias("dataset"),
        F.col("o_custkey").alias("respondent_id"),
        F.concat(F.lit("q"), (F.lit(17) + F.col("o_orderkey") % 3).cast("string")).alias("question"),
        F.when(first <= 4, first).alias("score"),
    )


LIKERT_SQL = """likert_s AS (
  SELECT CASE o_orderstatus WHEN 'F' THEN 'human' WHEN 'O' THEN 'gemma' WHEN 'P' THEN 'llama' END AS dataset,
         o_custkey AS respondent_id, 'q' || CAST(17 + o_orderkey % 3 AS VARCHAR) AS question,
         CASE WHEN CAST(substr(o_orderpriority, 1, 1) AS INTEGER) <= 4 THEN CAST(substr(o_orderpriority, 1, 1) AS INTEGER) END AS score
  FROM orders)"""


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dataset, respondent_id, question, key, sentiment_score."""
    key = F.get_json_object("props", "$.k")
    names = F.array(*[F.lit(s) for s in DEALT])
    return table(spark, sf_dir, "events").select(
        F.element_at(names, (F.col("user_id") % 6 + 1).cast("int")).alias("dataset"),
        F.col("user_id").alias("respondent_id"),
        F.col("event_type").alias("question"),
        tx.answer_key(key).alias("key"),
        (key.cast("int") % 3 - 1).alias("sentiment_score"),
    )


WORDS_SQL = """word_s AS (
  SELECT CASE user_id % 6 WHEN 0 THEN 'human' WHEN 1 THEN 'gpt' WHEN 2 THEN 'gemma' WHEN 3 THEN 'gpt-oss' WHEN 4 THEN 'llama' ELSE 'qwen' END AS dataset,
         user_id AS respondent_id, event_type AS question, nullif(trim(json_extract_string(props, '$.k')), '') AS key,
         CAST(json_extract_string(props, '$.k') AS INTEGER) % 3 - 1 AS sentiment_score
  FROM events)"""


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dataset, question, id, embedding."""
    names = F.array(*[F.lit(s) for s in DEALT])
    return table(spark, sf_dir, "embeddings").where("label < 6").select(
        F.element_at(names, F.col("label") + 1).alias("dataset"),
        F.when(F.col("vec_id") % 2 == 0, "q1").otherwise("q2").alias("question"),
        F.col("vec_id").alias("id"),
        "embedding",
    )


EMBEDDINGS_SQL = """emb_s AS (
  SELECT CASE label WHEN 0 THEN 'human' WHEN 1 THEN 'gpt' WHEN 2 THEN 'gemma' WHEN 3 THEN 'gpt-oss' WHEN 4 THEN 'llama' ELSE 'qwen' END AS dataset,
         CASE WHEN vec_id % 2 = 0 THEN 'q1' ELSE 'q2' END AS question, vec_id AS id, embedding
  FROM embeddings WHERE label < 6)"""


def word_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dataset, question (q3 to q9), id, embedding: the same vectors as of word associations."""
    question = F.concat(F.lit("q"), (F.lit(3) + F.col("id") % 7).cast("string"))
    return embeddings(spark, sf_dir).withColumn("question", question)


WORD_EMBEDDINGS_SQL = EMBEDDINGS_SQL.replace("CASE WHEN vec_id % 2 = 0 THEN 'q1' ELSE 'q2' END", "'q' || CAST(3 + vec_id % 7 AS VARCHAR)")


def keyness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dataset, respondent_id, question, tokens (with repeats)."""
    return table(spark, sf_dir, "conversations").where(F.col("role").isin("user", "assistant")).select(
        F.when(F.col("role") == "user", BASELINE).otherwise("system").alias("dataset"),
        F.col("conv_id").alias("respondent_id"),
        F.when(F.col("turn") % 2 == 0, "q1").otherwise("q2").alias("question"),
        F.filter(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), F.lit(1)), lambda t: F.char_length(t) >= 3).alias("tokens"),
    )


KEYNESS_SQL = r"""key_s AS (
  SELECT CASE role WHEN 'user' THEN 'human' ELSE 'system' END AS dataset, conv_id AS respondent_id, CASE WHEN turn % 2 = 0 THEN 'q1' ELSE 'q2' END AS question,
         list_filter(regexp_extract_all(lower(text), '\p{L}+'), lambda t: length(t) >= 3) AS tokens
  FROM conversations WHERE role IN ('user', 'assistant'))"""


def lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """text, pos, label: names of parts and, later, some in capitals or with other spaces."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", F.element_at(F.array(F.lit("negativo"), F.lit("neutro"), F.lit("positivo")), (F.col("p_size") % 3 + 1)).alias("label"))
    odd = part.where("p_partkey % 3 = 0").select((F.col("p_partkey") + 1000000).alias("pos"), F.upper("p_name").alias("text"), "label")
    spaced = part.where("p_partkey % 5 = 0").select((F.col("p_partkey") + 2000000).alias("pos"), F.concat(F.lit(" "), F.regexp_replace("p_name", " ", "  ")).alias("text"), "label")
    return part.select(F.col("p_partkey").alias("pos"), F.col("p_name").alias("text"), "label").unionByName(odd).unionByName(spaced)


LEXICON_SQL = """part_s AS (SELECT p_partkey, p_name, CASE p_size % 3 WHEN 0 THEN 'negativo' WHEN 1 THEN 'neutro' ELSE 'positivo' END AS label FROM part),
lexicon_s AS (
  SELECT p_partkey AS pos, p_name AS text, label FROM part_s
  UNION ALL SELECT p_partkey + 1000000, upper(p_name), label FROM part_s WHERE p_partkey % 3 = 0
  UNION ALL SELECT p_partkey + 2000000, ' ' || replace(p_name, ' ', '  '), label FROM part_s WHERE p_partkey % 5 = 0)"""


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """answer_id, raw: part names in several spellings, and some that no lexicon has."""
    k = F.col("p_partkey")
    raw = F.when(k % 7 == 0, F.upper("p_name")).when(k % 7 == 1, F.concat(F.lit("  "), "p_name", F.lit("\t"))).when(k % 7 == 2, F.initcap("p_name")).when(k % 7 == 3, F.concat("p_name", F.lit(" x"))).when(k % 7 == 4, F.lit(" ")).otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select(k.alias("answer_id"), raw.alias("raw"))


def profile_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dataset, respondent_id, role, years and the recodable fields."""
    roles = F.when(F.col("c_mktsegment") == "BUILDING", " Insegnante di sostegno").when(F.col("c_mktsegment") == "MACHINERY", "Insegnante curricolare").when(F.col("c_mktsegment") == "FURNITURE", "none").otherwise(F.col("c_mktsegment"))
    return table(spark, sf_dir, "customer").select(
        F.when(F.col("c_custkey") % 2 == 0, BASELINE).otherwise("llama").alias("dataset"),
        F.col("c_custkey").alias("respondent_id"),
        roles.alias("Ruolo"),
        (F.col("c_nationkey") - 1).cast("string").alias("years"),
        F.col("c_mktsegment").alias("segment"),
        F.element_at(F.array(*[F.lit(x) for x in YEARS]), (F.col("c_nationkey") % len(YEARS) + 1).cast("int")).alias("Anni esp"),
        F.element_at(F.array(*[F.lit(x) for x in GRADES]), (F.col("c_custkey") % len(GRADES) + 1).cast("int")).alias("Grado"),
    )


PROFILE_SQL = f"""profile_s AS (
  SELECT CASE WHEN c_custkey % 2 = 0 THEN 'human' ELSE 'llama' END AS dataset, c_custkey AS respondent_id,
         CASE c_mktsegment WHEN 'BUILDING' THEN ' Insegnante di sostegno' WHEN 'MACHINERY' THEN 'Insegnante curricolare' WHEN 'FURNITURE' THEN 'none' ELSE c_mktsegment END AS "Ruolo",
         CAST(c_nationkey - 1 AS VARCHAR) AS years, c_mktsegment AS segment,
         {list(YEARS)}[c_nationkey % {len(YEARS)} + 1] AS "Anni esp", {list(GRADES)}[c_custkey % {len(GRADES)} + 1] AS "Grado"
  FROM customer)"""
