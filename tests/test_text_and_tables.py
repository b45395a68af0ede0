import json

import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as tx
from quillspark.operators import enrich, lookup, reshape
from quillspark.plans import analyses, export
from quillspark.sources import tables
from quillspark.streaming import incremental


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(f(F.col("c"))).first()[0]


@pytest.mark.parametrize(("f", "value", "want"), [
    (tx.norm_ws, " a b \t c ", "a b c"), (tx.norm_ws, None, ""), (tx.norm_ws, "a  b\x1fc\x85", "a b c"),
    (tx.valid_answer, "ab", False), (tx.valid_answer, "123", False), (tx.valid_answer, "àèì", True), (tx.valid_answer, None, False),
    (tx.likert_score, "A: Per niente d'accordo", 1), (tx.likert_score, "un po' d'accordo", 3), (tx.likert_score, "D", 4), (tx.likert_score, "E: vuota", None), (tx.likert_score, None, None),
    (tx.valid_option, ":", True), (tx.valid_option, "A.", True), (tx.valid_option, "A)", False), (tx.valid_option, "e", True), (tx.valid_option, "vuota", False), (tx.valid_option, "", False),
    (tx.strip_code, "A: x", "x"), (tx.strip_code, "Axyz", "Axyz"), (tx.slug, " À b--C! ", "b-c"), (tx.question_no, "q10", 10), (tx.question_no, "x", 10**9),
    (tx.strip_think, "<think>a\nb</think>c\n</think>\n", "c"), (tx.unfenced, "```json\n{}\n```", "{}"), (tx.joined_list, "a; ;b;", "a, b"),
    (tx.one_word, "dell'aula", 1), (tx.word_count, "dell'aula è_1 ok", 4), (tx.gulpease, "", None), (tx.gulpease, "Ciao mondo.", 89 + (300 - 90) / 2),
])
def test_text_function(spark, f, value, want):
    got = one(spark, value, f)
    assert got == pytest.approx(want) if isinstance(want, float) else got == want


def test_years_bins(spark):
    got = [one(spark, v, tx.years_bin, "double") for v in (-0.6, -0.5, 4.5, 4.6, 14.5, 14.6, None)]
    assert got == ["nan", "0-4", "0-4", "5-14", "5-14", "15+", None]


def test_last_entry_wins_in_any_form(spark):
    lexicon = spark.createDataFrame([("importante", 0, "positivo"), ("Importante", 1, "neutro"), (" ben  fatto ", 2, "positivo"), ("vuoto", 3, None)], "text string, pos long, label string")
    rows = ["importante", "Importante", "IMPORTANTE", "ben fatto", "Ben\tFatto", "altro", " ", None, "vuoto"]
    got = lookup.looked_up(spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, raw string"), lexicon).orderBy("i").collect()
    assert [(r.sentiment_label, r.sentiment_score, r.sentiment_source) for r in got] == [
        ("neutro", 0, "raw"), ("neutro", 0, "raw"), ("neutro", 0, "lower"), ("positivo", 1, "raw"), ("positivo", 1, "lower"), (None, None, "missing"), (None, None, "missing"), (None, None, "missing"), (None, None, "raw")]


def test_spelling(spark):
    df = spark.createDataFrame([(1, "Buona scuola MIUR xyzt ab"), (2, None)], "i int, raw string")
    vocabulary = spark.createDataFrame([("buona",), ("Scuola",)], "word string")
    assert {r.i: (r.spell_n_errors, r.spell_has_errors) for r in lookup.spell_counts(df, vocabulary, ["i"]).collect()} == {1: (1, 1), 2: (0, 0)}


def wide(spark, n=3):
    names = ["ID", "Ruolo", "Anni esp", "Positiva", "Negativa", *[f"P{i}" for i in range(3, 20)]]
    rows = [(str(i), "Insegnante di sostegno", "Meno di 5 anni", "Una bella scuola. Davvero!", None, *["aula" if i else "" for _ in range(14)], "A: Per niente d'accordo", "c", "E: vuota") for i in range(n)]
    return spark.createDataFrame(rows, tables.all_strings(names))


def test_stage_tables_from_a_wide_one(spark):
    df = wide(spark)
    cmap = reshape.infer_column_map(df)
    assert cmap.profile == ("Ruolo", "Anni esp") and cmap.words["q3"] == "P3" and list(cmap.likert) == ["q17", "q18", "q19"]
    lexicon = spark.createDataFrame([("aula", 0, "positivo")], "text string, pos long, label string")
    words = analyses.build_long(df, cmap, cmap.words, "human", lexicon, is_open=False)
    assert words.count() == 28 and words.where("sentiment_score = 1 and one_word = 1").count() == 28
    opened = analyses.build_long(df, cmap, {"q1": cmap.q1, "q2": cmap.q2}, "human", lexicon, spark.createDataFrame([("una",), ("bella",)], "word string"))
    r = opened.first()
    assert opened.count() == 3 and (r.n_words, r.spell_n_errors, r.question) == (4, 2, "q1")
    likert = analyses.build_likert(df, cmap, "human").first()
    assert (likert.q17_score, likert.q18_score, likert.q19_score, likert.skepticism_index_S) == (1, 3, None, 2.0)
    assert analyses.build_keyness_tokens(opened, ("una",)).first().tokens == ["bella", "scuola", "davvero"]
    assert reshape.with_subgroups(reshape.profiles(df, cmap)).first().esperienza_2 == "Breve Esperienza"
    with pytest.raises(ValueError):
        reshape.infer_column_map(df.select("ID", "Positiva", "Negativa"))
    assert reshape.titled(spark.createDataFrame([("x", None)], "q1 string, q2 string"), {"q2": "B", "q1": "A", "q3": "C"}).first().asDict() == {"B": "", "A": "x", "C": ""}


@pytest.mark.parametrize("data", [{"Bene": ["Positivo ", ["gioia"]], "x": ["", []]}, {"Bene": {"sentiment": "positivo", "emotions": ["gioia"]}, "x": {"sentiment": None}}, [{"text": "Bene", "sentiment": "positivo", "emotions": ["gioia"]}, {"text": "x"}]])
def test_lexicon_layouts(spark, tmp_path, data):
    (tmp_path / "l.json").write_text(json.dumps(data))
    got = tables.read_lexicon(spark, str(tmp_path / "l.json")).orderBy("pos").collect()
    assert [tuple(r) for r in got] == [("Bene", 0, "positivo", ["gioia"]), ("x", 1, None, [])]


def test_lexicon_of_no_layout():
    for bad in ("x", [1], {"a": 1}):
        with pytest.raises(ValueError):
            tables.lexicon_rows(bad)


def test_sources_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([("human", "1", "a"), ("llama", "2", "b")], "dataset string, respondent_id string, raw string")
    calls = []
    build = lambda: calls.append(1) or df
    for recompute in (False, False, True):
        assert tables.materialize(spark, str(tmp_path / "m"), build, recompute).count() == 2
    assert len(calls) == 2
    tables.write_features({"open_long": df, "profiles": df.drop("dataset")}, str(tmp_path / "f"))
    found = tables.read_features(spark, str(tmp_path / "f"), ["human"], ("open_long", "profiles"))
    assert found["open_long"].count() == 1 and found["profiles"].count() == 2
    with pytest.raises(FileNotFoundError, match="likert"):
        tables.read_features(spark, str(tmp_path / "f"), names=("open_long", "likert"))
    assert tables.append_new(df, str(tmp_path / "a"), "respondent_id").count() == 2
    assert tables.append_new(df.union(spark.createDataFrame([("qwen", "3", "c")], df.schema)), str(tmp_path / "a"), "respondent_id").count() == 3
    tables.write_csv(df, str(tmp_path / "c"))
    assert tables.read_wide(spark, str(tmp_path / "c"), ["raw", "dataset"], "csv").columns == ["raw", "dataset"]
    assert tables.read_wide(spark, str(tmp_path / "none"), ["x"]).count() == 0 and tables.read_wide(spark, str(tmp_path / "c"), ["y"], "csv").count() == 0
    tables.write_json(spark, str(tmp_path / "j"), {"è": 1})
    assert json.loads("".join(r[0] for r in spark.read.text(str(tmp_path / "j"), wholetext=True).collect())) == {"è": 1}
    (tmp_path / "s.txt").write_text("{'abcdefghij  k', 'short', \"abcdefghij\"}")
    assert [r.text for r in tables.read_set_literal(spark, str(tmp_path / "s.txt")).collect()] == ["abcdefghij", "abcdefghij k"]


def test_latex(spark):
    shares = spark.createDataFrame([("q3", "human", 46.81), ("q10", "gpt", 4.04)], "question string, dataset string, unique_pct double")
    out = export.unique_table(shares, ["q3", "q10"], ["human", "gpt"])
    assert out.startswith(r"\begin{tabular}{lrr}") and r"q3 & 46.8 &  \\" in out and r"q10 &  & 4.0 \\" in out
    top = spark.createDataFrame([("q10", "a_b;c", ""), ("q3", "", "50%")], "question string, human string, system string")
    out = export.keyness_table(top)
    assert out.index("q3 &") < out.index("q10 &") and r"a\_b, c" in out and r"50\%" in out
    assert export.latex_escape("\\{") == r"\textbackslash{}\{"
    heat = export.heat_matrix(spark.createDataFrame([("q10", "x", 1.0, 0.01), ("q3", "x", 2.0, 0.2)], "question string, dataset string, value double, p_adj double"), ["q3", "q10"], ["x", "y"]).collect()
    assert [(r.question, r.x, r.y, r.x_stars) for r in heat] == [("q3", 2.0, None, ""), ("q10", 1.0, None, "*")]


def test_simulation_and_labels(spark):
    people = spark.createDataFrame([(str(i), "Insegnante curricolare" if i % 2 else "Altro", "Primaria", "f", str(20 + i), "x", "y", "1", "z", "s") for i in range(40)], "respondent_id string, Ruolo string, Grado string, Genere string, `Età` string, Istruzione string, Regione string, `Anni esp` string, Ambito string, SSSG string")
    got = enrich.simulated(people, lambda: enrich.StubResponder(4)).collect()
    assert len(got) == 40 and any(r.attempts > 1 for r in got)
    assert all((r.q1 == "") == (not r.ok) for r in got)
    assert all(r.q18 == r.q19 == "" for r in got if int(r.respondent_id) % 2 == 0)
    assert all(r.q18 in [t for t in ("per niente d'accordo", "abbastanza in disaccordo", "un po' d'accordo", "completamente d'accordo")] for r in got if r.ok and int(r.respondent_id) % 2)
    texts = spark.createDataFrame([("una cosa",), (" una  cosa ",), ("no",), (None,), ("altra",)], "text string")
    labels = enrich.labelled(texts, lambda: enrich.StubResponder()).collect()
    assert {r.text for r in labels} == {"una cosa", "altra"} and all("noia" not in r.emotions and len(r.emotions) == 1 for r in labels)
    assert enrich.flattened([{"text": "a"}, "b", {"content": ["c"]}, None]) == "abc"


def test_stream_counts(spark, tmp_path):
    df = spark.createDataFrame([("q", "human", k) for k in ("a", "a", "b", None)], "question string, dataset string, key string")
    for _ in range(2):
        df.write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
        incremental.count_stream(stream, str(tmp_path / "out"), str(tmp_path / "ck"), once=True).awaitTermination()
    r = incremental.unique_so_far(spark, str(tmp_path / "out")).first()
    assert (r.total_n, r.unique_n) == (6, 2) and 0.9 < incremental.entropy_so_far(spark, str(tmp_path / "out")).first().entropy < 1


def test_default_stopwords_leave_the_words_that_count(spark):
    from quillspark.schema import KEPT_WORDS

    words = analyses.default_stopwords(spark)
    assert len(KEPT_WORDS) == len(set(KEPT_WORDS)) == 50 and not set(words) & set(KEPT_WORDS) and {"il", "della", "che"} <= set(words)
    long = spark.createDataFrame([("d", "1", "q1", "Il futuro della scuola")], "dataset string, respondent_id string, question string, normalized_raw string")
    assert analyses.build_keyness_tokens(long).first().tokens == ["futuro", "scuola"]


def test_lemmas_for_keyness(spark):
    texts = spark.createDataFrame([(1, "Le scuole sono belle, belle"), (2, None), (3, "1234 di a"), (4, "c'era")], "id int, normalized_raw string")
    lemmas = spark.createDataFrame([("Scuole", "Scuola "), ("belle", "bello"), ("belle", "bella"), ("sono", "io x"), ("di", ""), ("le", None)], "word string, lemma string")
    got = {r.id: r.tokens for r in lookup.keyness_lemmas(texts, lemmas, ["id"], stopwords=("c'era",)).collect()}
    assert got == {1: ["scuola", "bella", "bella"], 2: [], 3: [], 4: []}
    assert lookup.keyness_lemmas(texts.limit(0), lemmas, ["id"]).count() == 0


def test_language_pipeline_behind_an_interface(spark):
    rows = [("Uno. Due! L'anno è bello?! Fine", 4, ["Uno", "Due", "L'anno", "è", "bello", "Fine"]), ("", 0, []), (None, 0, []), ("senza punto", 1, ["senza", "punto"])]
    df = spark.createDataFrame([(t, 1) for t, _, _ in rows], "normalized_raw string, words int").repartition(1)
    got = {r.normalized_raw: r for r in enrich.annotated(df).withColumn("n", tx.n_tokens(F.col("normalized_raw"))).collect()}
    for text, sentences, words in rows:
        r = got[text]
        assert (r.n_sentences, r.words, r.n, r.n_unknown) == (sentences, words, len(words), 0)
    one = enrich.annotated(df, lambda: enrich.RegexBackend({"Bello": "bella"}, ["uno", "due"])).where("normalized_raw LIKE 'Uno%'").first()
    assert one.lemmas == ["uno", "due", "l'anno", "è", "bella", "fine"] and one.n_unknown == 4


def test_a_table_without_its_mark_of_success_is_built_again(spark, tmp_path):
    path = tmp_path / "m"
    tables.materialize(spark, str(path), lambda: spark.range(2))
    assert tables.materialize(spark, str(path), lambda: spark.range(3)).count() == 2
    (path / "_SUCCESS").unlink()
    assert tables.materialize(spark, str(path), lambda: spark.range(3)).count() == 3


def test_subgroups_in_one_plan_are_the_subgroups_one_by_one(spark):
    people = spark.createDataFrame([("human", i, ("Sostegno", "Curricolare", None)[i % 3], "Lunga Esperienza" if i < 5 else None) for i in range(40)] + [("llama", 99, "Sostegno", None)], "dataset string, respondent_id long, ruolo_2 string, esperienza_2 string").withColumn("grado_2", F.lit(None).cast("string"))
    scores = spark.createDataFrame([(d, i, q, (i * 7 + len(d)) % 4 + 1) for d in ("human", "llama") for i in range(40) for q in ("q17", "q18")] + [("llama", None, "q17", 1)], "dataset string, respondent_id long, question string, score int")
    found = analyses.subgroup_analyses(people, {"likert": scores})
    assert set(found) == {"likert_props", "likert_chi2", "skepticism"}
    got = {tuple(r) for r in found["likert_props"].select("subgroup", "bin", "question", "dataset", "option", "n").collect()}
    from quillspark.operators import agg

    props = analyses.subgroup_suite(people, scores, agg.proportions)
    assert got == {tuple(r) for r in props.select("subgroup", "bin", "question", "dataset", "option", "n").collect()} and {g[1] for g in got} == {"Sostegno", "Curricolare"}


def test_spaces_and_suffixes(spark, tmp_path):
    from quillspark.functions.numeric import number
    from quillspark.sources import tables

    values = [" a ", "", '"x", y', "b\tc "]
    tables.write_csv(spark.createDataFrame([(v,) for v in values], "v string"), str(tmp_path / "c"))
    assert sorted(r.v for r in tables.read_wide(spark, str(tmp_path / "c"), ["v"], kind="csv").collect()) == sorted(values)
    texts = [" 1 ", "1d", "2F ", "-3e2", "NaN", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.x for r in df.select(number(F.col("t")).alias("x")).collect()] == [1.0, None, None, -300.0, None, None, None]
