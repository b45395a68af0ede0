"""Text Column functions. Null and empty text both mean missing, unless said otherwise."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import EMOTIONS, LIKERT_TEXTS, MIN_CHARS, SENTIMENT

#: White space as Python's str.split() sees it.
SPACE = r"[\s\x0b\x1c-\x1f\x85\p{Z}]+"
LETTER = r"[A-Za-zÀ-ÖØ-öø-ÿ]"
TOKEN = r"[\p{L}\p{N}_]+(?:['’][\p{L}\p{N}_]+)*"
WORD = r"[\p{L}\p{N}_]+"
SENTENCE_END = r"[.!?]+"


def safe(c: Column) -> Column:
    """Text, empty where missing."""
    return F.coalesce(c.cast("string"), F.lit(""))


def stripped(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, f"^{SPACE}|{SPACE}$", "")


def norm_ws(c: Column) -> Column:
    """Trimmed, each run of white space one space."""
    return F.trim(F.regexp_replace(safe(c), SPACE, " "))


def has_letter(c: Column) -> Column:
    return safe(c).rlike(LETTER)


def valid_answer(c: Column, min_chars: int = MIN_CHARS) -> Column:
    """True if the normalised text is long enough and has a letter."""
    n = norm_ws(c)
    return (F.char_length(n) >= min_chars) & has_letter(n)


def candidate(c: Column, min_chars: int = MIN_CHARS) -> Column:
    """True for text worth enriching: long enough when trimmed."""
    return F.coalesce(F.char_length(norm_ws(c)) >= min_chars, F.lit(False))


def entropy_key(c: Column) -> Column:
    return F.lower(norm_ws(c))


def answer_key(c: Column) -> Column:
    """The trimmed key, null where blank."""
    return F.nullif(stripped(safe(c)), F.lit(""))


def json_key(c: Column) -> Column:
    """A text as key of a JSON object: line ends and tabs to spaces, collapsed; null stays."""
    return F.when(c.isNotNull(), norm_ws(c))


def n_tokens(c: Column) -> Column:
    """Words by the default tokenizer: letters, digits and inner apostrophes."""
    return F.regexp_count(safe(c), F.lit(TOKEN))


def word_count(c: Column) -> Column:
    """Maximal runs of word characters."""
    return F.regexp_count(safe(c), F.lit(WORD))


def one_word(c: Column) -> Column:
    return (n_tokens(c) == 1).cast("int")


def gulpease(c: Column) -> Column:
    """89 + (300 sentences - 10 letters) / words; null without words. Sentences are runs of
    terminators, one at least."""
    words = n_tokens(c).cast("double")
    letters = F.regexp_count(safe(c), F.lit(r"\p{L}")).cast("double")
    sentences = F.greatest(F.regexp_count(safe(c), F.lit(SENTENCE_END)), F.lit(1)).cast("double")
    return F.when(words > 0, F.lit(89.0) + F.try_divide(F.lit(300.0) * sentences - F.lit(10.0) * letters, words))


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(safe(c), F.lit(TOKEN), F.lit(0))


def spellable(t: Column) -> Column:
    """Tokens that a vocabulary check looks at: 3 characters or more, with a letter, no acronym of
    up to 5 capitals."""
    acronym = (t == F.upper(t)) & (F.char_length(t) <= 5)
    return (F.char_length(t) >= 3) & has_letter(t) & ~acronym


def keyness_tokens(c: Column, stopwords: Sequence[str] = ()) -> Column:
    """Lower-case tokens of 3 characters or more that have a letter and aren't stopwords."""
    low = F.transform(tokens(c), lambda t: F.lower(t))
    stop = F.array(*[F.lit(s) for s in stopwords]).cast("array<string>")
    return F.filter(low, lambda t: (F.char_length(t) >= 3) & has_letter(t) & ~F.array_contains(stop, t))


def split_tokens(c: Column) -> Column:
    """A space-joined token string as an array; missing: empty."""
    return F.filter(F.split(stripped(safe(c)), SPACE), lambda t: t != "")


def joined_list(c: Column) -> Column:
    """``a; b;`` to ``a, b``."""
    return F.array_join(F.filter(F.transform(F.split(safe(c), ";"), lambda t: stripped(t)), lambda t: t != ""), ", ")


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(safe(c)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def question_no(c: Column) -> Column:
    """The first number in a question's name, 10**9 without one."""
    return F.coalesce(F.nullif(F.regexp_extract(safe(c), r"(\d+)", 1), F.lit("")).cast("int"), F.lit(10**9))


def recoded(c: Column, table: Mapping) -> Column:
    """Exact match; what isn't listed is null."""
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())])[c]


def bin_of(c: Column, table: Mapping[str, str]) -> Column:
    """A profile field recoded; blank, ``nan`` and ``none`` are null."""
    t = stripped(safe(c))
    return F.when(~F.lower(t).isin("", "nan", "none"), recoded(t, table))


def years_bin(x: Column) -> Column:
    """0-4, 5-14, 15+ of a number of years; null stays, below -0.5 is ``nan``."""
    return F.when(x < -0.5, "nan").when(x <= 4.5, "0-4").when(x <= 14.5, "5-14").when(x.isNotNull(), "15+")


def likert_score(c: Column) -> Column:
    """1 to 4 for ``a: text``, the text alone or the letter alone; anything else null."""
    table = {}
    for i, (code, text) in enumerate(LIKERT_TEXTS.items(), 1):
        table |= {f"{code}: {text}": i, text: i, code: i}
    return recoded(F.lower(norm_ws(c)), table)


def sentiment_score(c: Column) -> Column:
    return recoded(c, SENTIMENT)


def strip_code(c: Column, strict: bool = True) -> Column:
    """An answer without its option code: three characters go if the second and third are ``": "``
    or ``". "``; not strict: whenever there are more than three."""
    rest = F.substring(c, 4, 1 << 30)
    if strict:
        return F.when(F.substring(c, 2, 2).isin(": ", ". "), rest).otherwise(c)
    return F.when(F.char_length(c) > 3, rest).otherwise(c)


def without_void(c: Column) -> Column:
    return stripped(F.regexp_replace(c, "vuota", ""))


def non_teacher_default(answer: Column, role: Column, teachers: Sequence[str]) -> Column:
    """Roles that aren't asked the last items get the void option."""
    return F.when(F.coalesce(role, F.lit("")).isin(*teachers), answer).otherwise("e: vuota")


def strip_think(c: Column) -> Column:
    """Without ``<think>`` sections and lines that are only such a tag."""
    return stripped(F.regexp_replace(F.regexp_replace(c, r"(?is)<think>.*?</think>", ""), r"(?im)^\s*</?think>\s*$", ""))


def unfenced(c: Column) -> Column:
    """Without a code fence around it."""
    return stripped(F.regexp_replace(F.regexp_replace(stripped(c), r"^```[A-Za-z]*\s*", ""), r"\s*```$", ""))


def parsed(c: Column, schema: str) -> Column:
    """A JSON answer of a model, fence and thoughts removed; null where it isn't JSON."""
    return F.from_json(unfenced(strip_think(c)), schema)


def known_emotions(c: Column) -> Column:
    """The emotions of the list, order and repeats kept."""
    return F.filter(c, lambda e: e.isin(*EMOTIONS))


def unknown_emotions(c: Column) -> Column:
    return F.array_except(c, F.array(*[F.lit(e) for e in EMOTIONS]))


def valid_enrichment(label: Column, emotions: Column) -> Column:
    return F.coalesce(label.isin(*SENTIMENT) & emotions.isNotNull(), F.lit(False))


OPTIONS = tuple(f"{k}: {v}" for k, v in LIKERT_TEXTS.items()) + ("e: vuota",)


def valid_option(c: Column) -> Column:
    """One of the options in any case, or a code (first word without trailing ``:`` or ``.``) that
    begins one; so ``:`` is accepted and ``vuota`` is not."""
    low = F.lower(stripped(safe(c)))
    code = F.regexp_replace(F.regexp_replace(F.substring_index(low, " ", 1), ":+$", ""), r"\.+$", "")
    begins = F.exists(F.array(*[F.lit(o) for o in OPTIONS]), lambda o: F.startswith(o, code))
    return (low != "") & (low.isin(*OPTIONS) | begins)


def valid_answers(columns: Sequence[Column], likert: Sequence[Column]) -> Column:
    """All answers non-blank, the Likert ones options."""
    ok = F.lit(True)
    for c in [*columns, *likert]:
        ok = ok & (stripped(safe(c)) != "")
    for c in likert:
        ok = ok & valid_option(c)
    return ok
