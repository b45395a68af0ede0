"""Names, constants and record types of a questionnaire study.

A respondent answers two open questions (q1, q2), fourteen one-word associations (q3 to q16) and
three Likert items (q17 to q19). One table holds all datasets; the column ``dataset`` tells people
(the baseline) from the systems that simulate them.
"""

from __future__ import annotations

from pyspark.sql import types as T

BASELINE = "human"
#: In the order in which results are shown.
SYSTEMS = ("human", "gemma", "gpt-oss", "llama", "qwen", "gpt")
OPEN = ("q1", "q2")
WORDS = tuple(f"q{i}" for i in range(3, 17))
LIKERT = ("q17", "q18", "q19")
PROFILE = ("Genere", "Età", "Istruzione", "Ruolo", "Anni esp", "Ambito", "Grado", "SSSG", "Regione")

SEED = 42
SPLITS = 400
PERMUTATIONS = 800
BOOTSTRAPS = 500
MIN_TOTAL = 5
PRIOR = 0.01
ALPHA = 0.05
TOP = 10
MIN_CHARS = 3
MIN_IDS = 10

SENTIMENT = {"positivo": 1, "neutro": 0, "negativo": -1}
EMOTIONS = ("gioia", "fiducia", "paura", "sorpresa", "tristezza", "disgusto", "rabbia", "anticipazione")
LIKERT_TEXTS = {"a": "per niente d'accordo", "b": "abbastanza in disaccordo", "c": "un po' d'accordo", "d": "completamente d'accordo"}

#: Words that count although lists of stopwords have them.
KEPT_WORDS = (
    "futuro", "generale", "nessuno", "nuovo", "gruppo", "lavoro", "tutti", "tutto", "insieme", "nulla", "nessuna", "talvolta",
    "volte", "troppo", "lungo", "mancanza", "abbastanza", "vario", "varia", "altro", "dentro", "persone", "sempre", "minimi",
    "forza", "male", "lontano", "relativo", "magari", "poco", "niente", "più", "meno", "mai", "pochissimo", "vita", "spesso",
    "tempo", "contro", "grande", "brava", "pieno", "molto", "dovunque", "parecchio", "esempio", "grazie", "comunque",
    "finalmente", "bene",
)

#: Recodes of profile fields; what isn't listed becomes null.
SHORT, LONG = "Breve Esperienza", "Lunga Esperienza"
EXPERIENCE_BINS = {"Nessuna esperienza": SHORT, "Meno di 5 anni": SHORT, "Da 5 a 10 anni": SHORT, "Da 10 a 20 anni": LONG, "Più di 20 anni": LONG}
ROLE_BINS = {"Insegnante di sostegno": "Sostegno", "Insegnante curricolare": "Curricolare"}
GRADE_BINS = {"Infanzia": "Primaria+Infanzia", "Primaria": "Primaria+Infanzia", "Secondaria di I grado": "Secondaria (I+II)", "Secondaria di II grado": "Secondaria (I+II)"}

_s, _i, _d = T.StringType(), T.IntegerType(), T.DoubleType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


_TEXT = {"dataset": _s, "respondent_id": _s, "question": _s, "raw": _s, "normalized_raw": _s, "entropy_key": _s}
_TAIL = {"spell_has_errors": _i, "spell_n_errors": _i, "sentiment_label": _s, "sentiment_score": _i, "sentiment_source": _s}
OPEN_LONG = _struct(**_TEXT, n_words=_i, gulpease=_d, **_TAIL)
WORD_LONG = _struct(**_TEXT, n_tokens=_i, one_word=_i, **_TAIL)
LIKERT_TABLE = _struct(dataset=_s, respondent_id=_s, q17_score=_i, q18_score=_i, q19_score=_i, skepticism_index_S=_d)
KEYNESS_TOKENS = _struct(dataset=_s, respondent_id=_s, question=_s, tokens=T.ArrayType(_s), n_tokens_keyness=_i)
EMBEDDINGS = _struct(dataset=_s, respondent_id=_s, question=_s, embedding=T.ArrayType(T.FloatType()))
LEXICON = _struct(text=_s, pos=T.LongType(), label=_s, emotions=T.ArrayType(_s))
FEATURE_TABLES = ("profiles", "open_long", "wordassoc_long", "likert", "keyness_tokens_open", "keyness_tokens_words", "coverage_summary")
