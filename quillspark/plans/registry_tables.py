"""Queries over sources and sinks, the builders of the study's tables, models in the loop, and what is
shown of the results, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.numeric import number, rounded
from ..operators import agg, enrich, reshape, stats
from ..schema import EMOTIONS, LEXICON, SENTIMENT, SYSTEMS
from ..sources import tables
from . import analyses, export
from . import surrogates as s
from .registry import _ENTROPY, _VALUES, LETTERS, ORACLE_SQL, TOKEN, _mwu_sql, _norm, _people, _split, query, r6

_TOKEN_SQL = TOKEN.replace("''", "'").replace("'", "''")


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# ---- sources and sinks


@query("SELECT CAST(c_custkey AS VARCHAR) AS respondent, coalesce(c_mktsegment, '') AS segment, '' AS missing FROM customer")
def wide_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = tables.read_wide(spark, f"{sf_dir}/customer.parquet", ["c_custkey", "c_mktsegment"])
    return reshape.titled(df, {"c_custkey": "respondent", "c_mktsegment": "segment", "absent": "missing"})


@query("SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name, p_brand, p_type, CAST(p_size AS VARCHAR) AS p_size FROM part")
def all_string_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.read_wide(spark, f"{sf_dir}/part.parquet").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")


@query("SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, ' \"' || c_name || '\"; ' || c_mktsegment AS note, CASE WHEN c_custkey % 2 = 0 THEN 'x,y' ELSE '' END AS tail FROM customer")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tables.scratch(spark, "csv")
    c = s.table(spark, sf_dir, "customer")
    note = F.concat(F.lit(' "'), "c_name", F.lit('"; '), "c_mktsegment")
    tables.write_csv(c.select("c_custkey", note.alias("note"), F.when(F.col("c_custkey") % 2 == 0, "x,y").alias("tail")), path)
    return tables.read_wide(spark, path, ["c_custkey", "note", "tail"], kind="csv")


@query(
    "WITH l AS (SELECT unnest(['pairs', 'objects', 'list']) AS layout), n AS (SELECT n_nationkey AS k, n_name FROM nation) "
    "SELECT layout, n_name AS text, CAST(row_number() OVER (PARTITION BY layout ORDER BY k) - 1 AS BIGINT) AS pos, CASE k % 4 WHEN 0 THEN 'positivo' WHEN 1 THEN 'neutro' WHEN 2 THEN 'negativo' END AS label, "
    "CASE WHEN k % 2 = 0 THEN 'gioia,però' ELSE '' END AS emotions FROM n CROSS JOIN l"
)
def lexicon_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lexicon written in each of its three layouts as JSON, and read again."""
    nations = s.table(spark, sf_dir, "nation").orderBy("n_nationkey").collect()  # one row a nation
    entries = [(r.n_name, (" Positivo", "neutro", "NEGATIVO", "")[r.n_nationkey % 4], ["gioia", "però"] if r.n_nationkey % 2 == 0 else []) for r in nations]
    layouts = {
        "pairs": {t: [label, e] for t, label, e in entries},
        "objects": {t: {"sentiment": label, "emotions": e} for t, label, e in entries},
        "list": [{"text": t, "sentiment": label, "emotions": e} for t, label, e in entries],
    }
    out = None
    for name, value in layouts.items():
        path = tables.scratch(spark, "lexicon")
        tables.write_json(spark, path, value)
        part = tables.read_lexicon(spark, path).select(F.lit(name).alias("layout"), "text", "pos", "label", F.array_join("emotions", ",").alias("emotions"))
        out = part if out is None else out.unionByName(part)
    return out


@query("SELECT DISTINCT n_name || ' of region ' || n_regionkey AS text FROM nation WHERE n_nationkey % 3 > 0 UNION SELECT r_name || ' land' FROM region WHERE length(r_name) >= 5")
def set_literal_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations, regions = (s.table(spark, sf_dir, t).collect() for t in ("nation", "region"))  # 25 rows and 5
    texts = [f"{r.n_name}  of region\t{r.n_regionkey} " if r.n_nationkey % 3 else r.n_name[:9] for r in nations] + [f"{r.r_name} land" for r in regions]
    path = tables.scratch(spark, "set")
    spark.createDataFrame([("{" + ", ".join(map(repr, [*texts, 7])) + "}",)], "value string").coalesce(1).write.text(path)
    return tables.read_set_literal(spark, path)


@query("SELECT o_orderkey, o_custkey, o_orderpriority FROM orders")
def append_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run that broke off after some rows goes on with the others."""
    path, o = tables.scratch(spark, "append"), s.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    tables.append_new(o.where("o_orderkey % 3 = 0"), path, "o_orderkey")
    return tables.append_new(o, path, "o_orderkey")


@query("SELECT 'kept' AS state, c_custkey, c_nationkey FROM customer UNION ALL SELECT 'again', c_custkey, c_nationkey + 1 FROM customer")
def memoised_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is complete isn't built again unless asked for."""
    c = s.table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    more = lambda: c.withColumn("c_nationkey", F.col("c_nationkey") + 1)
    first, second = tables.scratch(spark, "memo"), tables.scratch(spark, "memo")
    for path in (first, second):
        tables.materialize(spark, path, lambda: c)
    kept, again = tables.materialize(spark, first, more), tables.materialize(spark, second, more, recompute=True)
    return kept.select(F.lit("kept").alias("state"), "*").unionByName(again.select(F.lit("again").alias("state"), "*"))


# ---- the study's tables from a wide one

_OPEN_TEXT = "CASE c_custkey % 5 WHEN 0 THEN '  ' || c_name || '. Tutto  bene! ' WHEN 1 THEN 'x' WHEN 2 THEN c_mktsegment WHEN 3 THEN ' ' || lower(c_mktsegment) ELSE '12345' END"
_OTHER_TEXT = "CASE c_custkey % 3 WHEN 0 THEN c_mktsegment || ' 3 volte' WHEN 1 THEN lower(c_mktsegment) END"


def _word(j: int) -> str:
    return f"CASE (c_custkey + {j}) % 5 WHEN 0 THEN '' WHEN 1 THEN lower(c_mktsegment) WHEN 2 THEN c_mktsegment || '  {j}' WHEN 3 THEN 'ab' ELSE c_name END"


def _item(k: int) -> str:
    return f"CASE (c_custkey + {k}) % 5 WHEN 0 THEN 'a: per niente d' || chr(39) || 'accordo' WHEN 1 THEN ' B ' WHEN 2 THEN 'Un po' || chr(39) || '  d' || chr(39) || 'accordo' WHEN 3 THEN 'd' ELSE 'e: vuota' END"


#: Texts of the lexicon and their labels.
_LEXICON = {"building": "positivo", "machinery": "neutro", "furniture": "negativo"}


def _wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A questionnaire's wide table: id, two profile columns, two open answers, 14 words, 3 items."""
    answers = [F.expr(_word(j)).alias(f"W {j}") for j in range(3, 17)] + [F.expr(_item(k)).alias(f"L {k}") for k in range(17, 20)]
    return s.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ID"), F.col("c_mktsegment").alias("Genere"), F.col("c_nationkey").alias("Età"), F.expr(_OPEN_TEXT).alias("Positiva"), F.expr(_OTHER_TEXT).alias("Negativa"), *answers)


def _long_sql(questions: dict[str, str], features: str) -> str:
    rows = " UNION ALL ".join(f"SELECT CAST(c_custkey AS VARCHAR) AS respondent_id, '{q}' AS question, {e} AS raw FROM customer" for q, e in questions.items())
    labels = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _LEXICON.items())
    known = ", ".join(f"'{k}'" for k in _LEXICON)
    return (
        f"WITH a AS ({rows}), n AS (SELECT *, {_norm('raw')} AS norm FROM a), v AS (SELECT * FROM n WHERE length(norm) >= 3 AND regexp_matches(norm, '{LETTERS}')) "
        f"SELECT respondent_id, question, norm AS normalized_raw, lower(norm) AS entropy_key, {features}, CASE lower(norm) {labels} END AS sentiment_label, "
        f"CASE WHEN raw IN ({known}) THEN 'raw' WHEN norm IN ({known}) THEN 'norm' WHEN lower(norm) IN ({known}) THEN 'lower' ELSE 'missing' END AS sentiment_source FROM v"
    )


def _long(spark: SparkSession, sf_dir: str, is_open: bool) -> DataFrame:
    wide = _wide(spark, sf_dir)
    cmap = reshape.infer_column_map(wide)
    lexicon = spark.createDataFrame([(k, i, v, []) for i, (k, v) in enumerate(_LEXICON.items())], LEXICON)
    questions = {"q1": cmap.q1, "q2": cmap.q2} if is_open else cmap.words
    return analyses.build_long(wide, cmap, questions, "human", lexicon, is_open=is_open)


_KEPT = ("respondent_id", "question", "normalized_raw", "entropy_key")
_TOKENS = f"len(regexp_extract_all(norm, '{_TOKEN_SQL}'))"


@query(
    _long_sql(
        {"q1": _OPEN_TEXT, "q2": _OTHER_TEXT},
        rf"CAST({_TOKENS} AS BIGINT) AS n_words, round(89e0 + (300e0 * greatest(len(regexp_extract_all(norm, '[.!?]+')), 1) - 10e0 * len(regexp_extract_all(norm, '\p{{L}}'))) / {_TOKENS}, 6) + 0e0 AS gulpease",
    )
)
def build_open_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(spark, sf_dir, True).select(*_KEPT, F.col("n_words").cast("long").alias("n_words"), r6("gulpease"), "sentiment_label", "sentiment_source")


@query(_long_sql({f"q{j}": _word(j) for j in range(3, 17)}, f"CAST({_TOKENS} AS BIGINT) AS n_tokens, CAST({_TOKENS} = 1 AS INTEGER) AS one_word"))
def build_wordassoc_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(spark, sf_dir, False).select(*_KEPT, F.col("n_tokens").cast("long").alias("n_tokens"), "one_word", "sentiment_label", "sentiment_source")


def _score(k: int) -> str:
    return f"CASE WHEN (c_custkey + {k}) % 5 < 4 THEN CAST((c_custkey + {k}) % 5 + 1 AS INTEGER) END"


@query(
    "WITH l AS (SELECT CAST(c_custkey AS VARCHAR) AS respondent_id, " + ", ".join(f"{_score(k)} AS q{k}_score" for k in (17, 18, 19)) + " FROM customer) "
    "SELECT *, round(list_avg(list_filter([q17_score, q18_score, q19_score], lambda v: v IS NOT NULL)), 6) + 0e0 AS skepticism_index_S FROM l"
)
def build_likert(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = _wide(spark, sf_dir)
    out = analyses.build_likert(wide, reshape.infer_column_map(wide), "human")
    return out.drop("dataset").withColumn("skepticism_index_S", r6("skepticism_index_S"))


@query('SELECT CAST(c_custkey AS VARCHAR) AS respondent_id, c_mktsegment AS "Genere", c_nationkey AS eta FROM customer')
def build_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = _wide(spark, sf_dir)
    return reshape.profiles(wide, reshape.infer_column_map(wide)).withColumnRenamed("Età", "eta")


@query(
    f"WITH o AS (SELECT respondent_id, question, list_filter(list_transform(regexp_extract_all(normalized_raw, '{_TOKEN_SQL}'), lambda t: lower(t)), lambda t: length(t) >= 3 AND regexp_matches(t, '{LETTERS}') AND t NOT IN ('tutto', 'volte')) AS k "
    f"FROM ({ORACLE_SQL['build_open_long']})) SELECT respondent_id, question, array_to_string(k, ' ') AS tokens, CAST(len(k) AS INTEGER) AS n_tokens_keyness FROM o"
)
def build_keyness_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = analyses.build_keyness_tokens(_long(spark, sf_dir, True), ("tutto", "volte"))
    return out.select("respondent_id", "question", F.array_join("tokens", " ").alias("tokens"), "n_tokens_keyness")


@query(
    f"SELECT 'open_long' AS name, count(*) AS n FROM ({ORACLE_SQL['build_open_long']}) UNION ALL SELECT 'wordassoc_long', count(*) FROM ({ORACLE_SQL['build_wordassoc_long']}) UNION ALL SELECT 'likert', count(*) FROM customer UNION ALL SELECT 'profiles', count(*) FROM customer "
    f"UNION ALL SELECT 'keyness_tokens_open', count(*) FROM ({ORACLE_SQL['build_open_long']}) UNION ALL SELECT 'keyness_tokens_words', count(*) FROM ({ORACLE_SQL['build_wordassoc_long']}) UNION ALL SELECT 'coverage_summary', count(DISTINCT question) FROM ({ORACLE_SQL['build_open_long']}) "
    f"UNION ALL SELECT 'embeddings', count(*) FILTER (dataset = 'human') FROM (WITH {s.EMBEDDINGS_SQL} SELECT * FROM emb_s)"
)
def feature_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of people in every feature table, vectors included, after a write by dataset and a read."""
    wide = _wide(spark, sf_dir)
    cmap = reshape.infer_column_map(wide)
    opened, words = _long(spark, sf_dir, True), _long(spark, sf_dir, False)
    both = lambda df: df.withColumn("dataset", F.explode(F.array(F.lit("human"), F.lit("gpt"))))
    made = {
        "profiles": reshape.profiles(wide, cmap),
        "open_long": both(opened),
        "wordassoc_long": both(words),
        "likert": both(analyses.build_likert(wide, cmap, "human")),
        "keyness_tokens_open": both(analyses.build_keyness_tokens(opened)),
        "keyness_tokens_words": both(analyses.build_keyness_tokens(words)),
        "coverage_summary": both(agg.coverage(opened, tx.valid_answer(F.col("raw")))),
        "embeddings": s.embeddings(spark, sf_dir),
    }
    path = tables.scratch(spark, "features")
    tables.write_features(made, path)
    out = None
    for name, df in tables.read_features(spark, path, ["human"]).items():
        part = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        out = part if out is None else out.unionByName(part)
    return out


# ---- texts, numbers and guards

_NUMBERS = ["1", " 2.5 ", "-3e2", "", " ", "x", "1,5", "NaN", "Infinity", "-Infinity", "1d", "2f", "+4", ".5", "6."]


@query("SELECT raw, value FROM (VALUES " + ", ".join(f"({_quoted(v)}, {x})" for v, x in zip(_NUMBERS, ["1e0", "25e-1", "-3e2", *["NULL"] * 9, "4e0", "5e-1", "6e0"])) + ") AS t(raw, value)")
def numeric_coercion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(v,) for v in _NUMBERS], "raw string").select("raw", number(F.col("raw")).alias("value"))


@query(
    "WITH t AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN replace(text, ' ', chr(10) || chr(9)) WHEN turn % 3 = 1 THEN ' ' || text || chr(13) ELSE NULL END AS raw FROM conversations) "
    f"SELECT conv_id, turn, CASE WHEN raw IS NOT NULL THEN md5({_norm('raw')}) END AS key_md5, CAST(CASE WHEN {_norm('raw')} = '' THEN 0 ELSE len(string_split({_norm('raw')}, ' ')) END AS BIGINT) AS n_split, md5({_norm('raw')}) AS joined_md5 FROM t"
)
def keys_and_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("text")
    raw = F.when(F.col("turn") % 3 == 0, F.replace(c, F.lit(" "), F.lit("\n\t"))).when(F.col("turn") % 3 == 1, F.concat(F.lit(" "), c, F.lit("\r")))
    parts = tx.split_tokens(raw)
    return s.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(tx.json_key(raw)).alias("key_md5"), F.size(parts).cast("long").alias("n_split"), F.md5(F.array_join(parts, " ")).alias("joined_md5"))


@query(
    "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'positivo' WHEN 1 THEN 'neutro' END AS label, CASE WHEN o_orderkey % 4 = 0 THEN o_orderpriority END AS note, "
    "CASE WHEN o_orderstatus IN ('F', 'O') THEN 'b' ELSE 'e: vuota' END AS asked, CASE WHEN trim(o_orderstatus) = 'P' THEN NULL ELSE o_orderstatus END AS answer FROM orders"
)
def model_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies with thoughts, fences and no JSON, and what roles that aren't asked get."""
    k, note = F.col("o_orderkey") % 4, F.col("o_orderpriority")
    raw = (
        F.when(k == 0, F.concat(F.lit('<THINK>hm\n{"label": 1}</think>\n```json\n{"label": "positivo", "note": "'), note, F.lit('"}\n```')))
        .when(k == 1, '</think>\n{"label": "neutro"}')
        .when(k == 2, "I would say positivo")
        .otherwise("<think>{}</think>")
    )
    reply = tx.parsed(raw, "label string, note string")
    status = F.col("o_orderstatus")
    role = F.when(status == "F", enrich.TEACHERS[0]).when(status == "O", enrich.TEACHERS[1])
    return s.table(spark, sf_dir, "orders").select(
        "o_orderkey", reply["label"].alias("label"), reply["note"].alias("note"), tx.non_teacher_default(F.lit("b"), role, enrich.TEACHERS).alias("asked"), tx.answer_key(F.when(status == "P", "\t ").otherwise(F.concat(F.lit(" "), status))).alias("answer")
    )


@query(
    f"WITH a AS ({ORACLE_SQL['answer_validate']}), v AS (SELECT list(valid ORDER BY i) AS valid FROM (SELECT unnest([{', '.join(map(_quoted, _VALUES))}]) AS answer, unnest(range({len(_VALUES)})) AS i) JOIN a USING (answer)) "
    f"SELECT c_custkey, (c_custkey % 4 <> 1 AND c_custkey % 6 <> 5) AND valid[c_custkey % {len(_VALUES)} + 1] AND valid[c_custkey // 3 % {len(_VALUES)} + 1] AS complete FROM customer CROSS JOIN v"
)
def answers_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    text = [F.when(k % 4 != 1, F.col("c_name")).otherwise(" \t"), F.when(k % 6 != 5, F.col("c_mktsegment"))] + [F.col("c_name")] * 14
    values = F.array(*[F.lit(v) for v in _VALUES])
    items = [F.element_at(values, (i % len(_VALUES) + 1).cast("int")) for i in (k, F.floor(k / 3))] + [F.lit("D")]
    return s.table(spark, sf_dir, "customer").select("c_custkey", tx.valid_answers([*text, *items], items).alias("complete"))


_SMALL = "small AS (SELECT p_brand || '|' || p_size AS question, CASE WHEN p_partkey % 2 = 0 THEN 'human' ELSE 'gpt' END AS dataset, p_retailprice AS v, p_type AS key FROM part)"


def _small(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of a few rows each."""
    side = F.when(F.col("p_partkey") % 2 == 0, "human").otherwise("gpt")
    return s.table(spark, sf_dir, "part").select(F.concat_ws("|", "p_brand", "p_size").alias("question"), side.alias("dataset"), F.col("p_retailprice").alias("value"), F.col("p_type").alias("key"))


@query(f"WITH {_SMALL}, " + _mwu_sql("small", "question", "r AS (SELECT question, dataset, CAST(n1 AS BIGINT) AS n1, CAST(n2 AS BIGINT) AS n2, round(p, 9) + 0e0 AS p FROM p)") + " SELECT * FROM r")
def tests_of_few(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stats.mann_whitney(_small(spark, sf_dir), exact=False)
    return out.select("question", "dataset", "n1", "n2", rounded(F.col("p"), 9).alias("p"))


@query(f"WITH {_SMALL}, " + _ENTROPY.format(k="question, dataset", source="small") + " SELECT question, dataset, CAST(n AS BIGINT) AS n, round(entropy, 6) + 0e0 AS entropy FROM e")
def entropy_of_few(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg.normalized_entropy(_small(spark, sf_dir)).select("question", "dataset", "n", r6("entropy"))


# ---- models in the loop, by the stubs

_H = "CAST('0x' || md5({0}) AS UHUGEINT)"
_AGAIN = "CASE WHEN n = 1 THEN '' ELSE '(attempt ' || n || ')' || chr(10) END"
_OPTION = "CASE CAST((h >> {0}) % 4 AS INTEGER) " + " ".join(f"WHEN {i} THEN {_quoted(o[3:])}" for i, o in enumerate(tx.OPTIONS[:4])) + " END"
_SIMULATED = (
    ORACLE_SQL["prompt_build"].partition(" SELECT respondent_id, length(prompt)")[0]
    + f", a AS (SELECT respondent_id, n, {_H.format('prompt || ' + _AGAIN)} AS h FROM t CROSS JOIN (SELECT unnest([1, 2, 3]) AS n)), "
    "g AS (SELECT respondent_id, arg_min(h, n) FILTER (h % 5 <> 0) AS h, CAST(coalesce(min(n) FILTER (h % 5 <> 0), 3) AS INTEGER) AS attempts FROM a GROUP BY 1), "
    "o AS (SELECT CAST(respondent_id AS VARCHAR) AS respondent_id, "
    + ", ".join(f"coalesce('parola' || CAST((h >> {i}) % 50 AS VARCHAR), '') AS q{i + 1}" for i in range(16))
    + f", coalesce({_OPTION.format(0)}, '') AS q17, "
    + ", ".join(f"CASE WHEN respondent_id % 3 < 2 THEN coalesce({_OPTION.format(3 * i)}, '') ELSE '' END AS q{17 + i}" for i in (1, 2))
    + ", attempts, h IS NOT NULL AS ok FROM g)"
)


@query(_SIMULATED + " SELECT * FROM o")
def simulate_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.simulated(_people(spark, sf_dir), lambda: enrich.StubResponder(5))


@query(_SIMULATED + " SELECT count(*) AS respondents, CAST(sum(attempts) AS BIGINT) AS attempts, count(*) FILTER (NOT ok) AS failures, round(100e0 * count(*) FILTER (ok) / count(*), 6) + 0e0 AS success_pct FROM o")
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg.run_summary(simulate_answers(spark, sf_dir)).withColumn("success_pct", r6("success_pct"))


_CHOICE = "CASE CAST({0} AS INTEGER) {1} END"


@query(
    f"WITH d AS (SELECT DISTINCT n AS text FROM (SELECT {_norm('text')} AS n FROM conversations) WHERE length(n) >= 3), "
    f"a AS (SELECT text, n, {_H.format(_quoted(f'Give the sentiment ({", ".join(SENTIMENT)}) and the emotions (of {", ".join(EMOTIONS)}) of the text as JSON [sentiment, [emotions]].') + ' || chr(10) || ' + _quoted('[TEXT]') + ' || text || ' + _quoted('[/TEXT]') + ' || chr(10) || ' + _AGAIN)} AS h FROM d CROSS JOIN (SELECT unnest(range(1, 11)) AS n)), "
    "g AS (SELECT text, min(n) AS attempts, arg_min(h, n) AS h FROM a WHERE h % 7 <> 0 GROUP BY text) "
    f"SELECT text, CAST(attempts AS INTEGER) AS attempts, {_CHOICE.format('h % 3', ' '.join(f'WHEN {i} THEN {_quoted(x)}' for i, x in enumerate(SENTIMENT)))} AS label, {_CHOICE.format('h // 3 % 8', ' '.join(f'WHEN {i} THEN {_quoted(x)}' for i, x in enumerate(EMOTIONS)))} AS emotions FROM g"
)
def enrich_sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = enrich.labelled(s.table(spark, sf_dir, "conversations"), lambda: enrich.StubResponder(7))
    return out.withColumn("emotions", F.array_join("emotions", ","))


@query(
    f"WITH w AS (SELECT conv_id, turn, text, regexp_extract_all(coalesce(text, ''), '{_TOKEN_SQL}') AS words FROM conversations) "
    "SELECT conv_id, turn, CAST(len(words) AS BIGINT) AS n_words, md5(array_to_string(list_transform(words, lambda w: CASE WHEN lower(w) = 'the' THEN 'il' ELSE lower(w) END), ' ')) AS lemmas_md5, "
    "CAST(len(list_filter(regexp_extract_all(coalesce(text, ''), '[^.!?]*[.!?]+|[^.!?]+'), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13)) <> '')) AS INTEGER) AS n_sentences, "
    "CAST(len(list_filter(words, lambda w: lower(w) NOT IN ('the', 'and', 'of'))) AS INTEGER) AS n_unknown FROM w"
)
def annotated_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    backend = lambda: enrich.RegexBackend({"The": "il"}, {"the", "AND", "of"})
    out = enrich.annotated(s.table(spark, sf_dir, "conversations"), backend, "text")
    return out.select("conv_id", "turn", F.size("words").cast("long").alias("n_words"), F.md5(F.array_join("lemmas", " ")).alias("lemmas_md5"), "n_sentences", "n_unknown")


# ---- what is shown


@query(
    f"WITH c AS ({ORACLE_SQL['likert_chi2']}), q AS (SELECT DISTINCT question FROM c) SELECT question, "
    + ", ".join(f"max(statistic) FILTER (dataset = '{d}') AS {d}, max(stars) FILTER (dataset = '{d}') AS {d}_stars" for d in ("gemma", "llama", "qwen"))
    + " FROM q LEFT JOIN c USING (question) GROUP BY question"
)
def heat_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    tests = analyses.likert_tables(s.likert(spark, sf_dir))[1]
    names = ("gemma", "llama", "qwen")
    cells = export.heat_matrix(tests, ("q17", "q18", "q19"), names, value="statistic")
    return cells.select("question", *[rounded(F.col(n)).alias(n) for n in names], *[f"{n}_stars" for n in names])


@query(
    f"WITH v AS ({ORACLE_SQL['sentiment_mean_shift']}), b AS ({ORACLE_SQL['noise_band']}) "
    "SELECT question, v.dataset, v.shift, b.median AS noise_median, b.q25 AS noise_q25, b.q75 AS noise_q75, abs_q95 AS noise_high, -abs_q95 + 0e0 AS noise_low FROM v LEFT JOIN b USING (question)"
)
def noise_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    shifts = stats.mean_shift(s.open_answers(spark, sf_dir).where("dataset IS NOT NULL"), value="sentiment_score").select("question", "dataset", "shift")
    out = export.noise_plot(shifts, _split(spark, sf_dir), signed=True)
    return out.select("question", "dataset", *[r6(c) for c in ("shift", "noise_median", "noise_q25", "noise_q75", "noise_high", "noise_low")])


def _lines(spark: SparkSession, table: str, name: str) -> DataFrame:
    return spark.createDataFrame([(name, i, line) for i, line in enumerate(table.splitlines())], "name string, no int, line string")


_ESCAPED = "replace({0}, '_', chr(92) || '_')"
_FRAME = (
    "f AS (SELECT * FROM (VALUES (-4, chr(92) || 'begin{{tabular}}{{{spec}}}'), (-3, chr(92) || 'toprule'), (-2, {head} || ' ' || chr(92) || chr(92)), (-1, chr(92) || 'midrule'), (1000000, chr(92) || 'bottomrule'), (1000001, chr(92) || 'end{{tabular}}')) AS t(k, line)) "
    "SELECT '{name}' AS name, CAST(row_number() OVER (ORDER BY k) - 1 AS INTEGER) AS no, line FROM (SELECT * FROM f UNION ALL SELECT * FROM b)"
)


@query(
    f"WITH {s.WORDS_SQL}, u AS (SELECT question, dataset, 100e0 * count(DISTINCT key) / nullif(count(key), 0) AS v FROM word_s GROUP BY ALL), "
    "w AS (SELECT question, row_number() OVER (ORDER BY question) AS k, " + ", ".join(f"coalesce(format('{{:.1f}}', max(v) FILTER (dataset = '{d}')), '') AS s{i}" for i, d in enumerate(SYSTEMS)) + " FROM u GROUP BY question), "
    f"b AS (SELECT k, {_ESCAPED.format('question')} || ' & ' || " + " || ' & ' || ".join(f"s{i}" for i in range(len(SYSTEMS))) + " || ' ' || chr(92) || chr(92) AS line FROM w), "
    + _FRAME.format(spec="l" + "r" * len(SYSTEMS), head=_quoted("Question & " + " & ".join(SYSTEMS)), name="unique")
)
def latex_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    shares = agg.distinct_share(s.words(spark, sf_dir))
    questions = sorted(r[0] for r in shares.select("question").distinct().collect())  # one row a question
    return _lines(spark, export.unique_table(shares, questions, SYSTEMS), "unique")


@query(
    f"WITH t AS ({ORACLE_SQL['keyness_top10']}), b AS (SELECT row_number() OVER (ORDER BY question) AS k, question || ' & ' || replace(human, ';', ', ') || ' & ' || replace(system, ';', ', ') || ' ' || chr(92) || chr(92) AS line FROM t), "
    + _FRAME.format(spec="lll", head=_quoted("Question & Human & Systems"), name="keyness")
)
def latex_keyness(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import keyness

    odds = keyness.log_odds(keyness.token_counts(s.keyness(spark, sf_dir)))
    return _lines(spark, export.keyness_table(keyness.top_terms(odds.withColumn("z", F.round("z", 9)))), "keyness")
