"""Language ID by prediction by partial matching: byte context trees per language, frozen, score exact code lengths."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, fold_number, small_batches

#: Bytes of text in a block, about; a longer text makes a longer block.
BLOCK_BYTES = 500_000
#: Nodes of which the driver works out the distributions at once.
GROW_NODES = 2_000
#: Bytes of context at most.
DEPTH = 3
#: Texts, about, from which one language's tree is fitted: those whose hash of the id falls below a share.
TEXTS_PER_LANGUAGE = 4_000
#: A context is a node of the tree when it was seen so often in some language.
LEAST_SEEN = 8
#: Bytes of the trees, which every task gets, at most: more languages than fit are an error, never a smaller model.
MOST_TREE_BYTES = 512 << 20
SEED = 11
_PAD = 256  # stands before a text begins


def _windows(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of rows: first row, rows, symbols with DEPTH pads before each text, places of the text bytes, bytes of each text."""
    texts = pa.array(pc.fill_null(texts, "").to_pylist(), pa.large_string())
    _, offsets, data = texts.buffers()
    rows = len(texts)
    at = np.frombuffer(offsets, np.int64)[: rows + 1] if rows else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < rows:
        last = min(max(int(np.searchsorted(at, at[first] + BLOCK_BYTES)), first + 1), rows)
        sizes = np.diff(at[first : last + 1])
        places = np.arange(at[last] - at[first]) + np.repeat(DEPTH * np.arange(1, last - first + 1), sizes)
        symbols = np.full(len(places) + DEPTH * (last - first), _PAD, np.int64)
        symbols[places] = raw[at[first] : at[last]]
        yield first, last - first, symbols, places, sizes
        first = last


def training_sample(docs: DataFrame, id_col: str, lang_col: str, texts_per_language: int) -> DataFrame:
    """Rows with a language, thinned per language by a hash of the id to about so many."""
    known = docs.filter(F.col(lang_col).isNotNull())
    share = {r[lang_col]: min(1.0, texts_per_language / r["n"]) for r in known.groupBy(lang_col).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not share:
        return known
    draw = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit(SEED)), F.lit(1_000_000)) / F.lit(1e6)
    limits = F.create_map(*[F.lit(x) for kv in share.items() for x in kv])
    return known.filter(draw < limits[F.col(lang_col)])


def context_counts(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """lang, context (DEPTH symbols), symbol, n: each task counts its own, a shuffle sums them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(batch.column(1).to_pylist(), dtype=object)
            for lang in sorted(set(langs)):
                for _, _, s, places, _ in _windows(batch.column(0).filter(pa.array(langs == lang))):
                    key = np.zeros(len(places), np.int64)
                    for back in range(DEPTH, -1, -1):
                        key = key * 257 + s[places - back]
                    keys, n = np.unique(key, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys), pa.array(n.astype(np.int64))], ["lang", "key", "n"])

    return small_batches(docs).select(F.col(text_col), F.col(lang_col).cast("string")).mapInArrow(run, "lang string, key bigint, n bigint").groupBy("lang", "key").agg(F.sum("n").alias("n"))


@dataclass
class Trees:
    """The frozen trees of all languages, laid out for look-ups: classes of bytes, node of each context, bits by node, class and language."""

    languages: list[str]
    classes: np.ndarray
    nodes: np.ndarray
    bits: np.ndarray

    def lengths(self, texts: pa.Array) -> np.ndarray:
        """Exact code length in bits of each text under each language."""
        out, k = np.zeros((len(texts), len(self.languages))), int(self.classes.max()) + 1
        for first, rows, symbols, places, sizes in _windows(texts):
            c = self.classes[symbols]
            context = np.zeros(len(places), np.int64)
            for back in range(DEPTH, 0, -1):
                context = context * k + c[places - back]
            bits = self.bits[self.nodes[context], c[places]]
            some = np.flatnonzero(sizes)
            if len(some):
                out[first + some] = np.add.reduceat(bits, (np.cumsum(sizes) - sizes)[some], axis=0, dtype=np.float64)
        return out


def grow(counts: list[tuple[str, int, int]]) -> Trees:
    """Trees from (language, key, n).

    A node's distribution: with n symbols seen, q of them distinct, a symbol seen c times has (2c - 1) / 2n, and the
    escape q / 2n goes to the unseen symbols in proportion to the next shorter context, from which the seen ones are
    excluded. Below the empty context all 256 bytes are alike. Bytes that no training text has share one class, which
    changes no code length. A language that lacks a node answers with its next shorter context.
    """
    languages = sorted({r[0] for r in counts})
    key = np.array([r[1] for r in counts], dtype=np.int64)
    n = np.array([r[2] for r in counts], dtype=np.float64)
    lang = np.searchsorted(np.array(languages), [r[0] for r in counts]) if counts else np.zeros(0, int)
    symbols = np.stack([key // 257**b % 257 for b in range(DEPTH, -1, -1)], 1)
    seen = np.unique(symbols[symbols < _PAD])
    classes = np.full(257, len(seen), np.int64)
    classes[seen] = np.arange(len(seen))
    classes[_PAD] = len(seen) + 1
    k, own = len(seen) + 2, classes[symbols]
    weight = np.ones(k)
    weight[k - 2], weight[k - 1] = 256 - len(seen), 0  # bytes of a class
    spots = k**DEPTH
    nodes = np.zeros(spots, np.int32)
    rows = np.full((1, k, len(languages)), 1 / 256, np.float32)
    for depth in range(DEPTH + 1):
        # Contexts of this length as numbers; the longest contexts' table has k ** DEPTH places, the last symbols count least.
        context = np.zeros(len(own), np.int64)
        for j in range(DEPTH - depth, DEPTH):
            context = context * k + own[:, j]
        # Only contexts that occur are counted, by language.
        own_context, own_n = np.unique(context * len(languages) + lang, return_inverse=True) if len(own) else (context, context)
        total = np.bincount(own_n, n, len(own_context))
        kept = np.unique(own_context[total >= (LEAST_SEEN if depth else 1)] // max(len(languages), 1))
        if (len(rows) + len(kept)) * k * len(languages) * 4 > MOST_TREE_BYTES:
            raise ValueError(f"the trees of {len(languages)} languages would take more than {MOST_TREE_BYTES} bytes in every task; fit fewer texts a language")
        place = np.full(k**depth, -1, np.int64)
        place[kept] = np.arange(len(kept))
        # The next shorter context of a kept one, as its node so far.
        shorter = nodes[kept % k ** max(depth - 1, 0)] if depth else np.zeros(len(kept), np.int64)
        at, spot = place[context], np.argsort(place[context], kind="stable")
        made = [rows]
        for first in range(0, len(kept), GROW_NODES):
            last = min(first + GROW_NODES, len(kept))
            own_rows = spot[np.searchsorted(at[spot], first) : np.searchsorted(at[spot], last)]
            table = np.zeros((last - first, k, len(languages)))
            np.add.at(table, (at[own_rows] - first, own[own_rows, DEPTH], lang[own_rows]), n[own_rows])
            below = rows[shorter[first:last]].astype(np.float64)
            sums, distinct = table.sum(1, keepdims=True), (table > 0).sum(1, keepdims=True)
            rest = (np.where(table > 0, 0, below) * weight[None, :, None]).sum(1, keepdims=True)
            full = rest <= 0
            with np.errstate(divide="ignore", invalid="ignore"):
                mine = np.where(table > 0, (2 * table - 1) / (2 * sums) / np.where(full, 1 - distinct / (2 * sums), 1), distinct / (2 * sums) * below / np.where(full, 1, rest))
            made.append(np.where(sums >= (LEAST_SEEN if depth else 1), mine, below).astype(np.float32))
        rows = np.concatenate(made)
        start = len(rows) - len(kept)
        # Every longest context that ends in a kept one gets its node.
        wide = nodes.reshape(-1, k**depth)
        wide[:, kept] = start + np.arange(len(kept), dtype=np.int32)
    with np.errstate(divide="ignore"):
        bits = np.where(rows > 0, -np.log2(np.maximum(rows, 1e-30)), 0).astype(np.float32)
    return Trees(languages, classes, nodes, bits)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", texts_per_language: int = TEXTS_PER_LANGUAGE) -> Trees:
    """Trees from a bounded sample of the rows with a language; the driver gets the counts of byte contexts, not texts."""
    sample = training_sample(docs, id_col, lang_col, texts_per_language)
    return grow([tuple(r) for r in context_counts(sample, text_col, lang_col).collect()])


def predict(docs: DataFrame, trees: Trees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col (any column, a struct of a whole row too), lang_pred, score: the language with the shortest code and its posterior share.

    `und` with score 0 where the text is null or has no letter, or no language was learned. Ties go to the first
    language by name. Whole texts in blocks; repeated rows get repeated results; no rows give no rows.
    """
    send = docs.sparkSession.sparkContext.broadcast(trees)
    inner = docs.select(F.col(id_col), F.col(text_col).alias("__hr_text"))
    schema = T.StructType([inner.schema[0], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = send.value
        for batch in batches:
            texts = batch.column(1)
            letter = np.array([x is not None and any(map(str.isalpha, x)) for x in texts.to_pylist()], dtype=bool)
            pred, score = np.full(len(texts), "und", dtype=object), np.zeros(len(texts))
            if t.languages and len(texts):
                bits = t.lengths(texts)
                best = bits.argmin(1)
                share = 1 / np.exp2(-np.minimum(bits - bits.min(1, keepdims=True), 1000)).sum(1)
                pred, score = np.where(letter, np.array(t.languages, dtype=object)[best], "und"), np.where(letter, share, 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(pred), pa.string()), pa.array(score)], [id_col, "lang_pred", "score"])

    return small_batches(inner).mapInArrow(run, schema)


def keep_known(docs: DataFrame, trees: Trees, text_col: str = "text", least_score: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, with a language: those predicted as `und` or with a lower score go. Null and empty texts, and those
    without a letter, are `und`; repeated rows share one fate; no rows give no rows."""
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__hr_row"), F.col(text_col).alias("__hr_text"))
    return predict(row, trees, "__hr_row", "__hr_text").filter((F.col("lang_pred") != "und") & (F.col("score") >= least_score)).select("__hr_row.*")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = fold_number(F.col("doc_id"), 5) == 0
    pred = predict(docs, fit(docs.filter(~held_out)))
    return pred.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
