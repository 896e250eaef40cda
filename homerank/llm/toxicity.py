"""Toxicity: a weighted lexicon, learned from labels, matched by Aho-Corasick in folded text and normalised by length."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, fold_number, materialize, small_batches
from .quality import labelled_sample

#: Labelled rows, at most, from which the lexicon and its scale are fitted.
MAX_LABELLED = 20_000
#: A term is in so many toxic texts at least, and its log odds are so large.
LEAST_TEXTS, LEAST_WEIGHT = 5, 3.0
#: Lengths of word beginnings that may be terms beside whole words.
STEMS = (4, 5, 6, 7)

# Letters of other scripts that look like Latin ones, and signs used for letters. i, l, 1 and | count as one.
HOMOGLYPHS = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x",
    "ѕ": "s", "і": "i", "ї": "i", "ј": "j", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ь": "b", "г": "r", "п": "n",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "μ": "u", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ɩ": "i", "ʀ": "r", "ո": "n", "օ": "o",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "|": "i", "l": "i"}


def _table() -> dict[int, str]:
    table = {i: " " for i in range(128) if not chr(i).isalnum()}
    table |= {ord(a): "i" if b == "l" else b for a, b in {**HOMOGLYPHS, **DIGITS}.items()}
    table |= {0xFF41 + i: "i" if c == "l" else c for i, c in enumerate("abcdefghijklmnopqrstuvwxyz")}
    table |= {i: None for i in (0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF)}
    table |= {i: " " for i in (0x85, 0xA0, 0x2018, 0x2019, 0x201C, 0x201D, 0x2013, 0x2014, 0x2026, 0xBF, 0xA1, 0xAB, 0xBB)}
    return table


_FOLD = _table()


def fold(text: str) -> str:
    """Lower case, look-alikes and digit substitutions as plain letters, signs as spaces; a space at either end."""
    return f" {text.lower().translate(_FOLD)} "


@dataclass
class Lexicon:
    """terms: pattern -> weight; a pattern begins with a space, and ends with one if it is a whole word. exceptions: harmless phrases."""

    terms: dict[str, float]
    exceptions: list[str] = field(default_factory=list)
    scale: tuple[float, ...] = (-4.0, 2.0, 0.5, 0.5)


class Matcher:
    def __init__(self, lexicon: Lexicon):
        self.scale = np.array(lexicon.scale)
        self.automaton = ahocorasick.Automaton()
        for term, weight in lexicon.terms.items():
            self.automaton.add_word(term, (len(term), weight))
        for phrase in lexicon.exceptions:
            folded = fold(phrase)
            self.automaton.add_word(folded, (len(folded), None))
        if len(self.automaton):
            self.automaton.make_automaton()

    def hits(self, folded: str) -> dict[int, float]:
        """The heaviest term at each word's beginning, without words inside an exception phrase."""
        found: dict[int, float] = {}
        if not len(self.automaton):
            return found
        spans = []
        for end, (size, weight) in self.automaton.iter(folded):
            start = end - size + 1
            if weight is None:
                spans.append((start, end))
            else:
                found[start] = max(weight, found.get(start, 0.0))
        if not spans:
            return found
        # Both in the order of their beginnings: one pass, however many phrases and hits there are.
        out, spans, i, until = {}, sorted(spans), 0, -1
        for start in sorted(found):
            while i < len(spans) and spans[i][0] <= start:
                until = max(until, spans[i][1])
                i += 1
            if start >= until:
                out[start] = found[start]
        return out

    def features(self, text: str | None) -> tuple[float, float, float]:
        """Heaviest hit, sum of hits, and sum for each hundred characters, the last two as logarithms."""
        folded = fold(text or "")
        found = self.hits(folded)
        if not found:
            return 0.0, 0.0, 0.0
        total = sum(found.values())
        return max(found.values()), float(np.log1p(total)), float(np.log1p(100 * total / len(folded)))

    def score(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale[0] + features @ self.scale[1:], -60, 60)))


def _terms_of(folded: str) -> set[str]:
    out = set()
    for word in set(folded.split()):
        if len(word) > 1:
            out.add(f" {word} ")
        out.update(f" {word[:n]}" for n in STEMS if len(word) > n)
    return out


def _fit_scale(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, ...]:
    """Ridge logistic regression by Newton steps."""
    x = np.column_stack([np.ones(len(x)), x])
    w, penalty = np.zeros(x.shape[1]), ridge * len(x) / 100 * np.eye(x.shape[1])
    penalty[0, 0] = 1e-6
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (p - y) + penalty @ w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(map(float, w))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MAX_LABELLED, exceptions: tuple[str, ...] = ()) -> Lexicon:
    """A lexicon from a bounded sample of labelled texts (label column `toxic`, 0 or 1).

    Terms are whole words and word beginnings; a term's weight is the log of its share in toxic over that in clean texts.
    A pair of a word and a term is an exception where the term alone is toxic but clean texts have the pair more often.
    The sample of ids is broadcast, at most `most` rows; the driver gets the terms that reach the least weight in that sample, which bounds them, and three numbers a text.
    With no toxic or no clean text nothing is learned: every score is the share of toxic texts. Of several labels of one id the greatest
    counts; null labels, and labels without a text, are left out; null texts are empty.
    """
    spark = docs.sparkSession
    ids = labelled_sample(labels.filter(F.col("toxic").isNotNull()).groupBy(id_col).agg(F.max("toxic").alias("toxic")), id_col, most)
    sample = materialize(docs.select(id_col, F.col(text_col).alias("text")).join(F.broadcast(materialize(ids, "toxic-ids")), id_col), "toxic-sample")
    known = {int(r["toxic"] > 0): r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    clean, toxic = known.get(0, 0), known.get(1, 0)
    if not clean or not toxic:
        share = (toxic + 0.5) / (toxic + clean + 1)
        return Lexicon({}, list(exceptions), (float(np.log(share / (1 - share))), 0.0, 0.0, 0.0))

    def weight(t: str, c: str):
        return F.log((F.col(t) + 0.5) / (toxic + 1)) - F.log((F.col(c) + 0.5) / (clean + 1))

    def tally(pairs_of):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts: tuple[Counter, Counter] = (Counter(), Counter())
            for batch in batches:
                for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    counts[label > 0].update(pairs_of(fold(text or "")))
            terms = list(counts[0].keys() | counts[1].keys())
            for i in range(0, len(terms), 50_000):
                part = terms[i : i + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), *(pa.array([c[t] for t in part], pa.int64()) for c in counts)], ["term", "c", "t"])

        return small_batches(sample).select("text", "toxic").mapInArrow(run, "term string, c bigint, t bigint").groupBy("term").agg(F.sum("c").alias("c"), F.sum("t").alias("t"))

    terms = tally(_terms_of).filter(F.col("t") >= LEAST_TEXTS).withColumn("w", weight("t", "c")).filter(F.col("w") >= LEAST_WEIGHT)
    lexicon = Lexicon({r["term"]: r["w"] for r in sorted(terms.collect(), key=lambda r: (-r["w"], r["term"]))}, list(exceptions))
    bare = Matcher(lexicon)

    def phrases(folded: str) -> set[str]:
        out = set()
        for start in bare.hits(folded):
            before, after = folded[:start].rsplit(None, 1), folded[start + 1 :].split(None, 1)
            if before and after:
                out.add(f"{before[-1]} {after[0]}")
        return out

    harmless = tally(phrases).filter((F.col("c") >= LEAST_TEXTS) & (weight("t", "c") < 0))
    lexicon.exceptions += sorted(r["term"] for r in harmless.collect())
    final = Matcher(lexicon)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [final.features(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in x], pa.float64()) for i in range(3)] + [batch.column(1)], ["a", "b", "c", "toxic"])

    rows = sample.select("text", F.col("toxic").cast("double")).mapInArrow(measure, "a double, b double, c double, toxic double").collect()
    data = np.array(sorted(tuple(r) for r in rows))  # at most `most` rows, in one order at every run
    lexicon.scale = _fit_scale(data[:, :3], (data[:, 3] > 0).astype(float))
    return lexicon


def score_documents(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col (any column, a struct of a whole row too), score from 0 to 1, predicted: 1 from 0.5 on.

    A map over whole texts. Null and empty texts have no hits and get the lowest score. Repeated rows score alike; no rows give no rows.
    """
    send = docs.sparkSession.sparkContext.broadcast(lexicon)
    inner = docs.select(F.col(id_col), F.col(text_col).alias("__hr_text"))
    schema = T.StructType([inner.schema[0], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(send.value)
        for batch in batches:
            x = np.array([matcher.features(t) for t in batch.column(1).to_pylist()]).reshape(-1, 3)
            score = matcher.score(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], [id_col, "score", "predicted"])

    return small_batches(inner).mapInArrow(run, schema)


def drop_toxic(docs: DataFrame, lexicon: Lexicon, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, that are not predicted as toxic. Null and empty texts stay, repeated rows share one fate."""
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__hr_row"), F.col(text_col).alias("__hr_text"))
    return score_documents(row, lexicon, "__hr_row", "__hr_text").filter("predicted = 0").select("__hr_row.*")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    held_out = fold_number(F.col("doc_id"), 5) == 0
    scored = score_documents(docs, learn(docs.filter(~held_out), labels.filter(~held_out)))
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")
