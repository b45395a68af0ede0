"""Models in the loop: simulating respondents and labelling texts.

A responder is any object with ``answer(prompt) -> str``; it is made once a task. Prompts are
built and answers checked by Column expressions; only the calls run in Python, on distinct texts.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Collection, Iterator, Mapping, Sequence
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..schema import EMOTIONS, LIKERT_TEXTS, SENTIMENT

QUESTIONS = tuple(f"q{i}" for i in range(1, 20))
TEACHERS = ("Insegnante di sostegno", "Insegnante curricolare")
UPPER = "Secondaria di II grado"
#: Characters of texts that are annotated at once.
PIECE = 1 << 16


class Responder(Protocol):
    def answer(self, prompt: str) -> str: ...


class Embedder(Protocol):
    def encode(self, texts: list[str]): ...


class TextBackend(Protocol):
    """What a language pipeline says of a text: its sentences, and for each word the text, the
    lemma and whether the vocabulary has it. Made once a task."""

    def sentences(self, text: str) -> list[str]: ...

    def words(self, text: str) -> list[tuple[str, str, bool]]: ...


class RegexBackend:
    """The words and sentences of the Column functions, with a lemma dictionary and a vocabulary if
    there are any; without a vocabulary every word is known."""

    def __init__(self, lemmas: Mapping[str, str] | None = None, vocabulary: Collection[str] | None = None):
        self.lemmas = {k.lower(): v for k, v in (lemmas or {}).items()}
        self.vocabulary = None if vocabulary is None else {w.lower() for w in vocabulary}

    def sentences(self, text: str) -> list[str]:
        return [s.strip() for s in re.split(r"(?<=[.!?])(?![.!?])", text) if s.strip()]

    def words(self, text: str) -> list[tuple[str, str, bool]]:
        found = re.findall(r"\w+(?:['’]\w+)*", text)
        return [(w, self.lemmas.get(w.lower(), w.lower()), self.vocabulary is None or w.lower() in self.vocabulary) for w in found]


class StubResponder:
    """Answers like a model would, as a function of the prompt alone; for tests and dry runs.

    ``broken_every``: so many prompts (by digest) get an answer that doesn't parse."""

    def __init__(self, broken_every: int = 0):
        self.broken_every = broken_every

    def answer(self, prompt: str) -> str:
        h = int(hashlib.md5(prompt.encode()).hexdigest(), 16)
        if self.broken_every and h % self.broken_every == 0:
            return "no JSON today"
        if "[TEXT]" in prompt:
            return json.dumps([list(SENTIMENT)[h % 3], [EMOTIONS[h // 3 % len(EMOTIONS)], "noia"]])
        options = [f"{k}: {v}" for k, v in LIKERT_TEXTS.items()]
        out = {q: f"parola{(h >> i) % 50}" for i, q in enumerate(QUESTIONS[:16])}
        return "```json\n" + json.dumps(out | {q: options[(h >> (3 * i)) % 4] for i, q in enumerate(QUESTIONS[16:])}) + "\n```"


class StubEmbedder:
    """Hashed character trigrams."""

    def __init__(self, size: int = 64):
        self.size = size

    def encode(self, texts: list[str]):
        import numpy as np

        out = np.zeros((len(texts), self.size), np.float32)
        for i, t in enumerate(texts):
            for j in range(max(1, len(t) - 2)):
                h = int(hashlib.md5(t[j : j + 3].encode()).hexdigest()[:8], 16)
                out[i, h % self.size] += 1 if h & 1024 else -1
        return out


def profile_prompt(role: str = "Ruolo", grade: str = "Grado", always: Sequence[str] = ("Genere", "Età", "Istruzione", "Regione"), for_teachers: Sequence[str] = ("Anni esp", "Ambito", "Grado"), for_upper: str = "SSSG") -> Column:
    """A respondent's prompt: the fields that everyone has, those of teachers, and one more for
    teachers of the upper secondary level; the last two items are for teachers only."""
    line = lambda c: F.concat(F.lit(f"- {c}: "), tx.safe(F.col(f"`{c}`")), F.lit("\n"))
    teacher = F.trim(tx.safe(F.col(f"`{role}`"))).isin(*TEACHERS)
    upper = teacher & (F.trim(tx.safe(F.col(f"`{grade}`"))) == UPPER)
    blank = F.lit("")
    return F.concat(
        F.lit("Answer a questionnaire as this person would.\n"), *[line(c) for c in (*always, role)],
        F.when(teacher, F.concat(*[line(c) for c in for_teachers])).otherwise(blank), F.when(upper, line(for_upper)).otherwise(blank),
        F.lit("Give one JSON object with the keys q1, q2 (a sentence each), q3 to q16 (one word each), q17"),
        F.when(teacher, F.lit(", q18, q19")).otherwise(blank), F.lit(" (one of "), F.lit("; ".join(tx.OPTIONS)), F.lit(").\n"),
    )


def text_prompt(text: Column) -> Column:
    return F.concat(F.lit(f"Give the sentiment ({', '.join(SENTIMENT)}) and the emotions (of {', '.join(EMOTIONS)}) of the text as JSON [sentiment, [emotions]].\n[TEXT]"), text, F.lit("[/TEXT]\n"))


def flattened(content: object) -> str:
    """The text of a model's reply that may be a string, a list of strings or parts, or an object
    with ``text`` or ``content``."""
    if content is None:
        return ""
    if isinstance(content, str):
        return content
    if isinstance(content, (list, tuple)):
        return "".join(flattened(x) for x in content)
    get = content.get if isinstance(content, dict) else lambda k: getattr(content, k, None)
    for key in ("text", "content"):
        if get(key) is not None:
            return flattened(get(key))
    return ""


def _json(reply: str) -> object:
    reply = re.sub(r"(?is)<think>.*?</think>", "", reply)
    reply = re.sub(r"^```[A-Za-z]*\s*|\s*```$", "", reply.strip())
    try:
        return json.loads(reply)
    except ValueError:
        return None


_CODES = [o.lower() for o in tx.OPTIONS]


def _option(value: str) -> bool:
    low = value.strip().lower()
    return bool(low) and (low in _CODES or any(o.startswith(low.split(" ")[0].rstrip(":").rstrip(".")) for o in _CODES))


def complete(answers: object, teacher: bool = True) -> bool:
    """All items answered, not blank, and the Likert items by an option. What isn't asked of
    somebody who doesn't teach may be missing."""
    asked = QUESTIONS if teacher else QUESTIONS[:17]
    return isinstance(answers, dict) and all(isinstance(answers.get(q), str) and answers[q].strip() for q in asked) and all(_option(answers[q]) for q in asked[16:])


def simulated(profiles: DataFrame, responder: Callable[[], Responder], id_col: str = "respondent_id", prompt: Column | None = None, role: str = "Ruolo", retries: int = 3, strict: bool = True) -> DataFrame:
    """id, q1 to q19, attempts and ok: every profile is asked up to ``retries`` times; without a
    complete answer all items are empty. Option codes are taken off, and ``vuota`` from the last
    two items; non-teachers get these empty."""
    df = profiles.select(F.col(f"`{id_col}`").cast("string").alias("id"), (profile_prompt(role) if prompt is None else prompt).alias("prompt"), F.trim(tx.safe(F.col(f"`{role}`"))).isin(*TEACHERS).alias("teacher"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = responder()
        for pdf in batches:
            rows = []
            for who, text, teacher in pdf.itertuples(index=False):
                got, n = None, 0
                while n < retries and got is None:
                    n += 1
                    reply = _json(flattened(model.answer(text if n == 1 else f"{text}(attempt {n})\n")))
                    got = reply if complete(reply, teacher) else None
                ok = got is not None
                answers = [str(got.get(q, "")) if ok else "" for q in QUESTIONS]
                if ok and not teacher:
                    answers[17:] = ["e: vuota", "e: vuota"]
                rows.append((who, *answers, n, ok))
            yield pd.DataFrame(rows, columns=["id", *QUESTIONS, "attempts", "ok"])

    out = df.mapInPandas(run, "id string, " + ", ".join(f"{q} string" for q in QUESTIONS) + ", attempts int, ok boolean")
    for q in QUESTIONS[16:]:
        out = out.withColumn(q, tx.strip_code(F.col(q), strict))
    for q in QUESTIONS[17:]:
        out = out.withColumn(q, tx.without_void(F.col(q)))
    return out.withColumnRenamed("id", id_col)


def labelled(texts: DataFrame, responder: Callable[[], Responder], column: str = "text", retries: int = 10) -> DataFrame:
    """text, pos, label, emotions: each distinct text worth it is asked about once, up to
    ``retries`` times; only known emotions stay, and texts without a valid answer are left out."""
    distinct = texts.select(tx.norm_ws(F.col(column)).alias("text")).where(tx.candidate(F.col("text"))).distinct()
    df = distinct.select("text", text_prompt(F.col("text")).alias("prompt"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = responder()
        for pdf in batches:
            rows = []
            for text, prompt in pdf.itertuples(index=False):
                for n in range(1, retries + 1):
                    reply = _json(flattened(model.answer(prompt if n == 1 else f"{prompt}(attempt {n})\n")))
                    if isinstance(reply, dict) and reply:
                        reply = next(iter(reply.values()))
                    if isinstance(reply, list) and len(reply) == 2 and reply[0] in SENTIMENT and isinstance(reply[1], list):
                        rows.append((text, n, reply[0], [str(e) for e in reply[1]]))
                        break
            yield pd.DataFrame(rows, columns=["text", "attempts", "label", "emotions"])

    out = df.mapInPandas(run, "text string, attempts int, label string, emotions array<string>")
    return out.withColumn("emotions", tx.known_emotions(F.col("emotions")))


def pieces(texts: Sequence[str | None]) -> Iterator[slice]:
    """Stretches of texts of ``PIECE`` characters or one text."""
    start = size = 0
    for i, text in enumerate(texts):
        if i > start and size + len(text or "") > PIECE:
            yield slice(start, i)
            start, size = i, 0
        size += len(text or "")
    if start < len(texts):
        yield slice(start, len(texts))


def annotated(df: DataFrame, backend: Callable[[], TextBackend] = RegexBackend, column: str = "normalized_raw") -> DataFrame:
    """Adds words, lemmas, n_sentences and n_unknown by a language pipeline; null counts as empty.
    The columns replace those of the same names. Words take many times the memory of their text, so
    they are sent on after every ``PIECE`` characters."""
    new = ("words", "lemmas", "n_sentences", "n_unknown")
    df = df.drop(*new)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = backend()
        for pdf in batches:
            every = ["" if pd.isna(t) else t for t in pdf[column]]
            for part in pieces(every):
                texts = every[part]
                words = [model.words(t) for t in texts]
                yield pdf.iloc[part].assign(words=[[w[0] for w in ws] for ws in words], lemmas=[[w[1] for w in ws] for ws in words], n_sentences=[len(model.sentences(t)) for t in texts], n_unknown=[sum(not w[2] for w in ws) for ws in words])

    return df.mapInPandas(run, kinds + ", words array<string>, lemmas array<string>, n_sentences int, n_unknown int")
