"""Toxicity by a weighted lexicon (operator 4).

Texts are folded first: case, accents, look-alike letters of other scripts and
digits or signs in place of letters.  Lexicon entries are whole words and word
beginnings, weighted by the log odds that labelled documents hold them, and
exception phrases, two words that hold an entry but occur in clean documents,
weigh nothing.  All are matched at once by an Aho-Corasick automaton, longest
first, and the sum of weights is normalised by length.  The score is the
logistic of a few such measures.

Lexicon and logistic are fitted on at most ``SAMPLE`` labelled documents; every
document is scored over its whole text.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import parts, written

SAMPLE = 16_000
HELD_OUT = 2
THRESHOLD = 0.3
_STEMS = (4, 5, 6, 7)

# Characters and the Latin letters that they stand in for.
LOOK_ALIKES = {
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "€": "e", "l": "i",
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "i", "м": "m", "н": "h", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "у": "y", "ѵ": "v", "ԝ": "w", "х": "x",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "μ": "m", "ν": "v", "ο": "o", "ρ": "p", "σ": "s", "τ": "t", "υ": "u", "χ": "x", "ω": "w",
    "ı": "i", "ł": "i", "ø": "o", "đ": "d", "ß": "ss", "æ": "ae", "œ": "oe", "ſ": "s", "ɑ": "a", "ɡ": "g",
}


class _Folding(dict):
    """Code point to folded letters; anything else is a space, marks and invisible characters are nothing."""

    def __missing__(self, code: int) -> str:
        out = ""
        for c in unicodedata.normalize("NFKD", chr(code).lower()):
            for d in LOOK_ALIKES.get(c, c).lower():
                d = LOOK_ALIKES.get(d, d)
                kind = unicodedata.category(d[0])
                out += d if kind[0] == "L" else "" if kind in ("Mn", "Cf", "Me") else " "
        self[code] = out
        return out


_folding = _Folding()


def fold(text: str) -> list[str]:
    """Folded words of a text."""
    return text.translate(_folding).split()


@dataclass(frozen=True)
class Lexicon:
    """Weights of entries (" word " or " begin", folded), exception phrases, and the logistic's constants."""

    weights: dict[str, float]
    phrases: tuple[str, ...] = ()
    constants: tuple[float, ...] = (-4.0, 1.0, 0.5, 0.5)

    def automaton(self) -> ahocorasick.Automaton:
        machine = ahocorasick.Automaton()
        for entry, weight in self.weights.items():
            machine.add_word(entry, weight)
        for phrase in self.phrases:
            machine.add_word(phrase, 0.0)
        machine.add_word("\0", 0.0)  # never empty
        machine.make_automaton()
        return machine


def measure(machine: ahocorasick.Automaton, words: list[str]) -> tuple[float, float, float]:
    """Matched weight: in all (log), for the root of the length, and whether any."""
    weights = [w for _, w in machine.iter_long(" " + "  ".join(words) + " ") if w]
    total = float(sum(weights))
    return float(np.log1p(total)), total / (len(words) + 1.0) ** 0.5, float(bool(weights))


def labelled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(text, toxic) of at most ``sample`` training documents, chosen by a hash of doc_id."""
    known = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.where(~held_out())
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic")  # at most ``sample`` pairs of numbers


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == HELD_OUT, F.lit(False))


def _counts(train: DataFrame, spell) -> DataFrame:
    """(entry, toxic, clean): documents of either label that hold what ``spell`` makes of their words."""

    def run(batches):
        for batch in parts(batches, 4096):
            by: tuple[Counter, Counter] = (Counter(), Counter())
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                by[toxic].update(spell(fold(text or "")))
            entries = list(by[0].keys() | by[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(entries, pa.string()), *(pa.array([c[e] for e in entries], pa.int64()) for c in by[::-1])], ["entry", "toxic", "clean"])

    return train.mapInArrow(run, "entry string, toxic long, clean long").groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _entries(words: list[str]) -> set[str]:
    distinct = set(words)
    return {f" {w} " for w in distinct if len(w) > 2} | {f" {w[:n]}" for w in distinct for n in _STEMS if len(w) > n}


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Lexicon:
    """Lexicon, phrases and logistic from at most ``sample`` labelled documents.

    Entries and phrases are all those that pass their tests; there are no more
    of them than the words of the sample.  Without documents of both labels
    the lexicon is empty and the score is the rate of toxic ones.
    """
    train = written(labelled(docs, labels, sample))
    sizes = {r["toxic"]: r["n"] for r in train.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    if not n_toxic or not n_clean:
        rate = (n_toxic + 0.5) / (n_toxic + n_clean + 1.0)
        return Lexicon({}, (), (float(np.log(rate / (1 - rate))), 0.0, 0.0, 0.0))
    t, c = F.col("toxic") + 0.5, F.col("clean") + 0.5
    odds = F.log(t / (n_toxic + 1.0)) - F.log(c / (n_clean + 1.0))
    sure = odds - F.sqrt(1 / t + 1 / c)
    least = max(3, round(0.004 * n_toxic))
    best = _counts(train, _entries).where((F.col("toxic") >= least) & (sure > 1.5)).withColumn("weight", sure).orderBy(F.desc(F.col("toxic") * F.col("weight")), "entry")
    weights: dict[str, float] = {}
    for row in best.collect():
        # a beginning that another entry already begins with, or the word of one, adds nothing
        stem = row["entry"].rstrip()
        if not any(stem[:n] in weights for n in range(4, len(stem))):
            weights[row["entry"]] = float(row["weight"])
    held = tuple(weights)

    def phrases(words: list[str]) -> set[str]:
        hit = [f" {w} " in weights or any(f" {w[:n]}" in weights for n in _STEMS) for w in words]
        return {f" {words[i]}  {words[i + 1]} " for i in range(len(words) - 1) if hit[i] or hit[i + 1]}

    spared: tuple[str, ...] = ()
    if held:
        rows = _counts(train, phrases).where((F.col("clean") >= 3) & (F.col("clean") > 4 * F.col("toxic"))).orderBy(F.desc("clean"), "entry").collect()
        spared = tuple(r["entry"] for r in rows)
    draft = Lexicon(weights, spared)
    rows = _measured(train.select("toxic", "text"), draft, "toxic").collect()  # at most ``sample`` rows of four numbers
    return Lexicon(weights, spared, _logistic(np.array([r[1:4] for r in rows]), np.array([r["toxic"] for r in rows], float)))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Logistic regression with a little shrinkage, by Newton steps."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    ridge = np.diag([1e-6, 0.5, 0.5, 0.5])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(map(float, w))


def _measured(docs: DataFrame, lexicon: Lexicon, key: str) -> DataFrame:
    def run(batches):
        machine = lexicon.automaton()
        for batch in parts(batches, 512):
            found = [measure(machine, fold(t or "")) for t in batch.column("text").to_pylist()]
            columns = [pa.array(x, pa.float64()) for x in zip(*found, strict=True)] if found else [pa.array([], pa.float64())] * 3
            yield pa.RecordBatch.from_arrays([batch.column(key), *columns], [key, "total", "density", "some"])

    return docs.select(key, "text").mapInArrow(run, f"{key} {dict(docs.dtypes)[key]}, total double, density double, some double")


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id and score (0 to 1) of every document.

    One row per input row.  A null or empty text has no matches and gets the
    score of such; a null doc_id stays; equal rows score alike; an empty table
    gives an empty result; only doc_id (carried along) and text are used.
    """
    a, b, c, d = lexicon.constants
    z = F.lit(a) + b * F.col("total") + c * F.col("density") + d * F.col("some")
    return _measured(docs.select("doc_id", "text"), lexicon, "doc_id").select("doc_id", (1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))).alias("score"))


def without_toxic(docs: DataFrame, lexicon: Lexicon, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with all their columns.

    Scores as in ``score``: null and empty texts get that of a text without
    matches; a null doc_id and nulls in other columns stay as they are; equal
    rows go or stay together; an empty table gives an empty result; columns may
    have any names, as only ``text`` is used.
    """
    a, *rest = lexicon.constants

    def run(batches):
        machine = lexicon.automaton()
        for batch in parts(batches, 512):
            z = [a + float(np.dot(rest, measure(machine, fold(t or "")))) for t in batch.column("text").to_pylist()]
            yield batch.filter(pa.array(1 / (1 + np.exp(-np.clip(np.array(z), -30, 30))) < threshold, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    found = score(docs, fit(docs, labels))
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
