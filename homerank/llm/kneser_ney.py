"""Language-model scores: an interpolated modified Kneser-Ney bigram model, counted by Spark over all training texts.

The model is a set of sorted arrays in the shared folder, cut into shards: the vocabulary's word hashes with counts, and
the bigrams' keys with counts. Workers map them into memory and answer a block of tokens at a time, sorted, so that
look-ups run through the arrays in order.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared_arrays
from .common import documents, fold_number, scratch_path
from .word_hashes import blocks, mix64, sums_by_row

#: The end of a text, also what stands before its first word.
END_HASH = np.uint64(0x5BD1E9955BD1E995)
#: Entries that a task gathers before it merges them.
MERGE_ENTRIES = 2_000_000
#: Words whose statistics one task puts together, about.
HOME_WORDS = 500_000
HELD_OUT_MODULUS, HELD_OUT = 7, 2


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    every, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(every, kind="stable")
    every, n = every[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])) if len(every) else np.zeros(0, np.int64)
    return every[first], np.add.reduceat(n, first) if len(first) else n


class _Counter:
    """Counts by 64-bit key; merges as it grows."""

    def __init__(self):
        self.keys: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.held, self.limit = 0, MERGE_ENTRIES

    def add(self, keys: np.ndarray) -> None:
        unique, n = np.unique(keys, return_counts=True)
        self.keys.append(unique)
        self.counts.append(n.astype(np.uint64))
        self.held += len(unique)
        if self.held > self.limit:
            self.total()
            self.limit = max(MERGE_ENTRIES, 2 * self.held)

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        keys, counts = _merged(self.keys, self.counts)
        self.keys, self.counts, self.held = [keys], [counts], len(keys)
        return keys, counts


def _with_ends(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The token stream with END after each text, and where the ENDs are."""
    ends = np.cumsum(counts + 1) - 1
    out = np.empty(len(hashes) + len(counts), np.uint64)
    inner = np.ones(len(out), bool)
    inner[ends] = False
    out[inner], out[ends] = hashes, END_HASH
    return out, ends


@dataclass
class Model:
    """Where the arrays are and the numbers that go with them; small, whatever the corpus."""

    url: str
    bits: int
    sizes: list[int] = field(default_factory=list)  # words by vocabulary shard
    tokens: int = 0
    words: int = 0
    spread: int = 0  # contexts that occur more often than this are dealt over all bigram shards
    pairs: list[int] = field(default_factory=list)  # bigrams by shard
    discounts: tuple = ()
    low_discounts: tuple = ()
    low_total: int = 0
    low_rest: float = 1.0


class Reader:
    """The model's arrays, mapped by one worker."""

    def __init__(self, model: Model):
        self.m = model
        self.shift = np.uint64(64 - model.bits)
        self.offsets = np.concatenate([[0], np.cumsum(model.sizes)]).astype(np.int64)
        self.vocabulary = [shared_arrays.mapped(f"{model.url}/words-{i}", np.uint64, n) for i, n in enumerate(model.sizes)]
        self.count = [shared_arrays.mapped(f"{model.url}/counts-{i}", np.uint64, n) for i, n in enumerate(model.sizes)]
        if model.pairs:
            self.keys = [shared_arrays.mapped(f"{model.url}/pairs-{i}", np.uint64, n) for i, n in enumerate(model.pairs)]
            self.times = [shared_arrays.mapped(f"{model.url}/times-{i}", np.uint32, n) for i, n in enumerate(model.pairs)]
        if model.low_discounts:
            self.follows = [shared_arrays.mapped(f"{model.url}/follows-{i}", np.uint32, n) for i, n in enumerate(model.sizes)]
            self.rests = [shared_arrays.mapped(f"{model.url}/rests-{i}", np.float64, n) for i, n in enumerate(model.sizes)]

    def _in_shards(self, shard: np.ndarray, keys: np.ndarray, arrays: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Places of keys, sorted by (shard, key), in their shards' arrays; whether they are there."""
        at, there = np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        bounds = np.searchsorted(shard, np.arange(len(arrays) + 1))
        for i in np.flatnonzero(np.diff(bounds)):
            part, own = slice(bounds[i], bounds[i + 1]), arrays[i]
            if len(own):
                at[part] = np.minimum(np.searchsorted(own, keys[part]), len(own) - 1)
                there[part] = own[at[part]] == keys[part]
        return at, there

    def _gather(self, shard: np.ndarray, at: np.ndarray, arrays: list[np.ndarray], dtype) -> np.ndarray:
        out = np.zeros(len(at), dtype)
        bounds = np.searchsorted(shard, np.arange(len(arrays) + 1))
        for i in np.flatnonzero(np.diff(bounds)):
            if len(arrays[i]):
                out[bounds[i] : bounds[i + 1]] = arrays[i][at[bounds[i] : bounds[i + 1]]]
        return out

    def look_up(self, hashes: np.ndarray, scoring: bool = False) -> tuple[np.ndarray, ...]:
        """Of sorted distinct hashes: ids (-1 if unknown), counts and, for scoring, continuation counts and rests."""
        shard = (hashes >> self.shift).astype(np.int64) if self.m.bits else np.zeros(len(hashes), np.int64)
        at, there = self._in_shards(shard, hashes, self.vocabulary)
        out = [np.where(there, self.offsets[shard] + at, -1), np.where(there, self._gather(shard, at, self.count, np.uint64), 0)]
        if scoring:
            out += [np.where(there, self._gather(shard, at, self.follows, np.uint32), 0), np.where(there, self._gather(shard, at, self.rests, np.float64), 1.0)]
        return tuple(out)

    def pair_shard(self, left: np.ndarray, right: np.ndarray, often: np.ndarray) -> np.ndarray:
        key = np.where(often, (left << 32) | right, left << 32).astype(np.uint64)
        return (mix64(key + np.uint64(1)) >> self.shift).astype(np.int64) if self.m.bits else np.zeros(len(left), np.int64)

    def pair_counts(self, left: np.ndarray, right: np.ndarray, often: np.ndarray) -> np.ndarray:
        shard, keys = self.pair_shard(left, right, often), ((left << 32) | right).astype(np.uint64)
        order = np.lexsort((keys, shard))
        at, there = self._in_shards(shard[order], keys[order], self.keys)
        out = np.zeros(len(left), np.int64)
        out[order] = np.where(there, self._gather(shard[order], at, self.times, np.uint32), 0)
        return out


_readers: dict[tuple[str, int], Reader] = {}


def _reader(model: Model) -> Reader:
    """One reader per worker, of the last model that it was asked for."""
    stage = len(model.pairs) + len(model.low_discounts)
    if (model.url, stage) not in _readers:
        _readers.clear()
        _readers[model.url, stage] = Reader(model)
    return _readers[model.url, stage]


def _slices(keys_shard: np.ndarray, shards: int) -> Iterator[tuple[int, slice]]:
    bounds = np.searchsorted(keys_shard, np.arange(shards + 1))
    for i in np.flatnonzero(np.diff(bounds)):
        yield int(i), slice(bounds[i], bounds[i + 1])


_PART = "shard int, keys binary, counts binary"


def _part_batch(parts: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[0] for p in parts], pa.int32()), pa.array([p[1].tobytes() for p in parts], pa.binary()), pa.array([p[2].tobytes() for p in parts], pa.binary())], ["shard", "keys", "counts"])


def _joined(pdf: pd.DataFrame, key_type=np.uint64, count_type=np.uint64) -> tuple[np.ndarray, np.ndarray]:
    return _merged([np.frombuffer(b, key_type) for b in pdf["keys"]], [np.frombuffer(b, count_type) for b in pdf["counts"]])


def _count_of_counts(n: np.ndarray) -> list[int]:
    return [int((n == k).sum()) for k in (1, 2, 3, 4)]


def _discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts for counts 1, 2 and more; a small corpus without some of them falls back to 1/2, 1 and 3/2 at most."""
    y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    raw = [k - (k + 1) * y * b / a if a and b else k / 2 for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return tuple(min(max(d, 0.05), k - 0.05) for k, d in zip((1, 2, 3), raw))


def train(docs: DataFrame, text_col: str = "text") -> Model:
    """Counts the model over all rows of docs, in three passes of narrow shuffles; see the module's text.

    1. Words: each task counts its own, then shards of the hash range merge the counts and write the vocabulary.
    2. Bigrams: each task counts pairs of word ids and deals them by the left word, those of frequent left words by both;
       shards write sorted keys with counts.
    3. From each bigram shard come, by word, how many words precede it and how many follow it once, twice or more.
    The number of shards follows spark.sql.shuffle.partitions; a merge holds one shard, some millionths of the corpus on a
    large cluster. Files are written whole under final names, so tasks can run again.
    """
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bits = max(1, math.ceil(math.log2(2 * partitions)))
    shards, shift = 1 << bits, np.uint64(64 - bits)
    model = Model(scratch_path(spark, "lm"), bits)
    texts = docs.select(F.col(text_col))

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _Counter()
        for batch in batches:
            for _, _, hashes, counts in blocks(batch.column(0)):
                counter.add(_with_ends(hashes, counts)[0])
        keys, n = counter.total()
        yield _part_batch([(i, keys[s], n[s]) for i, s in _slices((keys >> shift).astype(np.int64), shards)])

    url = model.url

    def write_words(pdf: pd.DataFrame) -> pd.DataFrame:
        keys, n = _joined(pdf)
        shard = int(pdf["shard"].iloc[0])
        shared_arrays.write(f"{url}/words-{shard}", keys)
        shared_arrays.write(f"{url}/counts-{shard}", n)
        return pd.DataFrame({"shard": [shard], "n": [len(keys)], "tokens": [int(n.sum())]})

    sizes = [0] * shards
    for r in texts.mapInArrow(count_words, _PART).groupBy("shard").applyInPandas(write_words, "shard int, n bigint, tokens bigint").collect():
        sizes[r["shard"]] = r["n"]
        model.tokens += r["tokens"]
    model.sizes, model.words = sizes, sum(sizes)
    if model.words >> 32:
        raise ValueError("more different words than 32 bits can number")
    model.spread = max(1000, model.tokens // (16 * shards))
    first = Model(**vars(model))

    def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, counter = _reader(first), _Counter()
        for batch in batches:
            for _, _, hashes, counts in blocks(batch.column(0)):
                right, _ = _token_ids(reader, hashes, counts)
                counter.add(((_before(right, counts) << 32) | right).astype(np.uint64))
        keys, n = counter.total()
        left = (keys >> np.uint64(32)).astype(np.int64)
        often = _counts_of(reader, left) > first.spread
        shard = reader.pair_shard(left, (keys & np.uint64(0xFFFFFFFF)).astype(np.int64), often)
        order = np.argsort(shard, kind="stable")
        yield _part_batch([(i, keys[order[s]], n[order[s]].astype(np.uint32)) for i, s in _slices(shard[order], shards)])

    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    # Runs of vocabulary shards with about HOME_WORDS words each: one task puts a run's statistics together.
    home_of = (offsets[:-1] // HOME_WORDS).astype(np.int64)
    homes = int(home_of[-1]) + 1

    def write_pairs(pdf: pd.DataFrame) -> pd.DataFrame:
        keys, n = _merged([np.frombuffer(b, np.uint64) for b in pdf["keys"]], [np.frombuffer(b, np.uint32).astype(np.uint64) for b in pdf["counts"]])
        shard = int(pdf["shard"].iloc[0])
        shared_arrays.write(f"{url}/pairs-{shard}", keys)
        shared_arrays.write(f"{url}/times-{shard}", np.minimum(n, 0xFFFFFFFF).astype(np.uint32))
        left, right = (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
        words, preceded = np.unique(right, return_counts=True)
        start = np.flatnonzero(np.concatenate([[True], left[1:] != left[:-1]]))
        some = [np.add.reduceat((n == k) if k < 3 else (n >= 3), start, dtype=np.uint32) for k in (1, 2, 3)]
        rows = []
        for kind, ids, values in ((0, words, [preceded.astype(np.uint32)]), (1, left[start], some)):
            home = home_of[np.searchsorted(offsets, ids, side="right") - 1]
            for i, s in _slices(home, homes):
                rows.append((shard, len(keys), _count_of_counts(n), i, kind, ids[s].astype(np.int64).tobytes(), np.stack([v[s] for v in values], 1).tobytes()))
        return pd.DataFrame(rows, columns=["shard", "n", "ns", "home", "kind", "ids", "values"])

    stats = texts.mapInArrow(count_pairs, _PART).groupBy("shard").applyInPandas(write_pairs, "shard int, n bigint, ns array<bigint>, home int, kind int, ids binary, values binary")
    from .common import discard, materialize

    stats = materialize(stats, "lm-stats")
    model.pairs = [0] * shards
    totals = np.zeros(4, np.int64)
    for r in stats.groupBy("shard").agg(F.first("n").alias("n"), F.first("ns").alias("ns")).collect():
        model.pairs[r["shard"]] = r["n"]
        totals += np.array(r["ns"])
    model.discounts = _discounts(*map(int, totals))
    d = np.array(model.discounts)

    def write_stats(pdf: pd.DataFrame) -> pd.DataFrame:
        home = int(pdf["home"].iloc[0])
        own = np.flatnonzero(home_of == home)
        start, end = int(offsets[own[0]]), int(offsets[own[-1] + 1])
        follows, after = np.zeros(end - start, np.uint32), np.zeros((end - start, 3), np.uint32)
        for kind, ids, values in zip(pdf["kind"], pdf["ids"], pdf["values"]):
            at = np.frombuffer(ids, np.int64) - start  # distinct within a row
            if kind == 0:
                follows[at] += np.frombuffer(values, np.uint32)
            else:
                after[at] += np.frombuffer(values, np.uint32).reshape(-1, 3)
        for i in own.tolist():
            part = slice(int(offsets[i]) - start, int(offsets[i + 1]) - start)
            count = np.asarray(shared_arrays.mapped(f"{url}/counts-{i}", np.uint64, sizes[i]), dtype=np.float64)
            shared_arrays.write(f"{url}/follows-{i}", follows[part])
            shared_arrays.write(f"{url}/rests-{i}", after[part] @ d / np.maximum(count, 1))
        return pd.DataFrame({"total": [int(follows.sum())], "ns": [_count_of_counts(follows)], "more": [int((follows >= 3).sum())]})

    low, more = np.zeros(4, np.int64), 0
    for r in stats.groupBy("home").applyInPandas(write_stats, "total bigint, ns array<bigint>, more bigint").collect():
        model.low_total += r["total"]
        low += np.array(r["ns"])
        more += r["more"]
    discard(stats)
    model.low_discounts = _discounts(*map(int, low))
    model.low_rest = float(np.dot(model.low_discounts, [low[0], low[1], more])) / model.low_total if model.low_total else 1.0
    return model


def _token_ids(reader: Reader, hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    stream, ends = _with_ends(hashes, counts)
    unique, back = np.unique(stream, return_inverse=True)
    return reader.look_up(unique)[0][back], ends


def _before(ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The token before each: END before the first of a text. The stream ends with END."""
    return np.concatenate([ids[-1:], ids[:-1]])


def _counts_of(reader: Reader, ids: np.ndarray) -> np.ndarray:
    """Counts of words by sorted id."""
    shard = np.searchsorted(reader.offsets, ids, side="right") - 1
    return reader._gather(shard, ids - reader.offsets[shard], reader.count, np.uint64)


def _block_scores(reader: Reader, hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, ...]:
    m = reader.m
    stream, _ = _with_ends(hashes, counts)
    unique, back = np.unique(stream, return_inverse=True)
    ids, count, follows, rests = reader.look_up(unique, scoring=True)
    base = np.log10((count.astype(np.float64) + 1) / (m.tokens + m.words + 1))
    f = follows.astype(np.float64)
    low = np.maximum(f - np.array((0.0, *m.low_discounts))[np.minimum(follows, 3)], 0) / max(m.low_total, 1) + m.low_rest / (m.words + 1)
    right, left = back, _before(back, counts)
    pair, of = np.unique((left.astype(np.int64) << 32) | right, return_inverse=True)
    pl, pr = pair >> 32, pair & 0xFFFFFFFF
    known = (ids[pl] >= 0) & (ids[pr] >= 0)
    times = np.zeros(len(pair), np.int64)
    times[known] = reader.pair_counts(ids[pl[known]], ids[pr[known]], count[pl[known]] > m.spread)
    high = np.maximum(times - np.array((0.0, *m.discounts))[np.minimum(times, 3)], 0) / np.maximum(count[pl].astype(np.float64), 1)
    score = np.log10(high + rests[pl] * low[pr])
    sizes = counts + 1
    return sizes, sums_by_row((count > 0)[back].astype(np.int64), sizes), sums_by_row(base[back], sizes), sums_by_row(score[of], sizes)


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_tokens, n_known, train_tokens, base_score, score: log10 probabilities of each whole text and its end.

    A map without a shuffle. Null counts as empty: one token, the end. Words that the training texts lack share one
    place in the vocabulary; what follows them is predicted by the lower order alone. Repeated rows score alike.
    """
    id_type = docs.select(id_col).schema[0].dataType.simpleString()
    names = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _reader(model)
        for batch in batches:
            parts = [_block_scores(reader, hashes, counts) for _, _, hashes, counts in blocks(batch.column(1))]
            n, known, base, score = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, t) for i, t in enumerate((np.int64, np.int64, float, float)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(known), pa.array(np.full(len(n), model.tokens, np.int64)), pa.array(base), pa.array(score)], [id_col, *names])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {id_type}, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def op5_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = fold_number(F.col("doc_id"), HELD_OUT_MODULUS) == HELD_OUT
    scored = score_documents(docs, train(docs.filter(~held_out)))
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
