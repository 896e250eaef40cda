"""Packing: token pieces of documents are laid into sequences of one length by shortest-pack-first over the length histogram."""

from __future__ import annotations

import bisect
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, materialize, small_batches

SEQUENCE = 4096
END_ID = 2
#: Words of which a worker keeps the ids, in two generations; longer words are encoded each time.
CACHE_ENTRIES, CACHE_KEY_CHARS = 500_000, 64
#: Rows that one group ranks by sorting.
RANK_GROUP = 100_000
#: White space for str.split() but not for the tokenizer.
_ONLY_PYTHON_SPACE = "\x1c\x1d\x1e\x1f"


#: Bytes of text that are split and encoded at once, about; a longer text makes a longer block.
BLOCK_BYTES = 8 << 20
#: Stems that go to the tokenizer as one text.
STEMS_AT_ONCE = 1_000


#: Texts with other characters than these are encoded word by word: their letters may change their number in lower case or normal form.
_PLAIN_TEXT = "^[\\x00-\\x{012f}\\x{0131}-\\x{024f}\\x{2010}-\\x{2027}\\x{2030}-\\x{205e}\\x{20a0}-\\x{20bf}]*$"
#: A mark after a letter: the tokenizer never joins the two.
_MARK = "([a-z\u00aa\u00b5\u00ba\u00df-\u00f6\u00f8-\u024f])([!-&(-/:-@\\[-`{-~])"


class WordTokens:
    """Ids of words, for a tokenizer that splits at white space first and treats each word by itself."""

    def __init__(self, tokenizer_file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.of_stems = Tokenizer.from_file(tokenizer_file), Tokenizer.from_file(tokenizer_file)
        # For lower-case words of letters, where the rules before the merges change nothing.
        self.of_stems.normalizer = None
        self.of_stems.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.special = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def direct(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _stems(self, stems: list[str]) -> list[bytes]:
        """Ids of words of letters: many are encoded as one text, in which each ends with its one token that closes a word."""
        out = []
        parts = [stems[i : i + STEMS_AT_ONCE] for i in range(0, len(stems), STEMS_AT_ONCE)]
        for part, encoded in zip(parts, self.of_stems.encode_batch_fast([" ".join(p) for p in parts], add_special_tokens=False)):
            ids = np.array(encoded.ids, dtype="<u4")
            ends = (np.flatnonzero(self.closes[ids]) + 1) * 4
            if len(ends) == len(part):
                raw = ids.tobytes()
                out += [raw[a:b] for a, b in zip([0, *ends.tolist()], ends.tolist())]
            else:
                out += map(self.direct, part)
        return out

    def of_words(self, words: list[str]) -> list[bytes]:
        """Ids of each of distinct words as little-endian unsigned 32-bit integers."""
        if len(self.known) >= CACHE_ENTRIES:
            self.older, self.known = self.known, {}
        known, older = self.known.get, self.older.get
        out = [known(w) for w in words]
        missing = [i for i, ids in enumerate(out) if ids is None]
        stems = []
        for i in missing:
            word = words[i]
            out[i] = older(word)
            if out[i] is None:
                if word.isalpha() and (word.isascii() or max(word) < "\u0250") and word == word.lower():
                    stems.append(i)
                else:
                    out[i] = self.direct(word)
        for i, ids in zip(stems, self._stems([words[i] for i in stems])):
            out[i] = ids
        self.known.update((words[i], out[i]) for i in missing if len(words[i]) <= CACHE_KEY_CHARS)
        return out

    def _by_words(self, text: str) -> np.ndarray:
        """Ids of a text with any characters."""
        if any(s in text for s in self.special) or any(c in text for c in _ONLY_PYTHON_SPACE):
            return np.frombuffer(self.direct(text), "<u4")
        words = text.split()
        different = list(dict.fromkeys(words))
        ids = dict(zip(different, self.of_words(different)))
        return np.frombuffer(b"".join([ids[w] for w in words]), "<u4")

    def encode(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids of all texts end to end, ids of each text) for runs of rows of a string column; null counts as empty.

        Arrow lower-cases a block, parts marks from letters, splits it at white space and finds its different words; each is encoded once.
        """
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        first = 0
        while first < len(texts):
            done = int(sizes[first - 1]) if first else 0
            last = min(max(int(np.searchsorted(sizes, done + BLOCK_BYTES)), first + 1), len(texts))
            block = texts.slice(first, last - first)
            plain = pc.and_not(pc.match_substring_regex(block, _PLAIN_TEXT), pc.match_substring_regex(block, f"[{_ONLY_PYTHON_SPACE}]"))
            for s in self.special:
                plain = pc.and_not(plain, pc.match_substring(block, s))
            odd = np.flatnonzero(~plain.to_numpy(zero_copy_only=False))
            if len(odd):
                odd_texts = block.take(pa.array(odd)).to_pylist()
                block = pc.if_else(plain, block, pa.scalar("", pa.large_string()))
            split = pc.utf8_split_whitespace(pc.replace_substring_regex(pc.utf8_lower(block), _MARK, "\\1 \\2"))
            words = split.flatten().dictionary_encode()
            pieces = self.of_words(words.dictionary.to_pylist())
            pool, length = np.frombuffer(b"".join(pieces), "<u4"), np.array([len(p) // 4 for p in pieces], np.int64)
            codes = words.indices.to_numpy()
            taken = length[codes]
            ends = np.concatenate([[0], np.cumsum(taken)])
            ids = pool[np.repeat((np.cumsum(length) - length)[codes] - ends[:-1], taken) + np.arange(ends[-1])] if len(codes) else pool[:0]
            bounds = ends[split.offsets.to_numpy() - split.offsets[0].as_py()]
            if len(odd):
                parts, upto = [], 0
                counts = np.diff(bounds)
                for row, text in zip(odd.tolist(), odd_texts):
                    whole = self._by_words(text)
                    parts += [ids[upto : bounds[row]], whole]
                    upto, counts[row] = bounds[row], len(whole)
                yield np.concatenate([*parts, ids[upto:]]), counts
            else:
                yield ids, np.diff(bounds)
            first = last


_loaded: dict[str, WordTokens] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def cut_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_file: str | None = None, sequence: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens: each document's ids and the end id, cut into pieces of `sequence` ids and a rest.

    A map without a shuffle. Null and empty texts give the end id alone. Repeated rows give pieces of their own.
    """
    where = tokenizer_file or default_tokenizer()
    id_type = docs.select(id_col).schema[0].dataType.simpleString()
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if where not in _loaded:
            _loaded[where] = WordTokens(where)
        for batch in batches:
            take, rest, row = [], ([], [], [], []), 0
            for ids, counts in _loaded[where].encode(batch.column(1)):
                raw, at = ids.tobytes(), 0
                for n in counts.tolist():
                    own = raw[at : at + 4 * n] + end
                    for start in range(0, n + 1, sequence):
                        piece = own[4 * start : 4 * (start + sequence)]
                        take.append(row)
                        for column, value in zip(rest, (start, len(piece) // 4, zlib.crc32(piece), n + 1)):
                            column.append(value)
                    at, row = at + 4 * n, row + 1
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(take, pa.int64())), *(pa.array(c, pa.int64()) for c in rest)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return small_batches(docs).select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"doc_id {id_type}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint")


def shortest_pack_first(histogram: dict[int, int], sequence: int = SEQUENCE) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Patterns ((length, times), ...) with how many sequences have each, for a histogram of lengths of at most `sequence` entries.

    Lengths go longest first; each goes to the packs that are shortest so far, if it fits there, many packs of one
    pattern at a time, and else to new packs. The work depends on the histogram's entries, not on the documents.
    """
    # By pack length: patterns and their counts; `lengths` sorted.
    packs: dict[int, list[tuple[tuple[tuple[int, int], ...], int]]] = {}
    lengths: list[int] = []

    def put(size: int, pattern, count: int) -> None:
        if size not in packs:
            packs[size] = []
            bisect.insort(lengths, size)
        packs[size].append((pattern, count))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if not lengths or lengths[0] + length > sequence:
                # No pack takes it: new ones, each with as many of this length as fit.
                each = min(sequence // length, left)
                put(each * length, ((length, each),), left // each)
                left %= each
                continue
            size = lengths[0]
            pattern, count = packs[size].pop()
            if not packs[size]:
                del packs[size]
                lengths.pop(0)
            # As many pieces at once as keep this pack among the shortest.
            upto = lengths[0] if lengths else sequence
            times = max(1, min((upto - size) // length if upto > size else 1, (sequence - size) // length, -(-left // count)))
            used = min(count, left // times) or 1
            times = min(times, left)
            if used < count:
                put(size, pattern, count - used)
            joined = (*pattern[:-1], (length, pattern[-1][1] + times)) if pattern[-1][0] == length else (*pattern, (length, times))
            put(size + times * length, joined, used)
            left -= used * times
    return [x for size in lengths for x in packs[size]]


def slots(patterns: list[tuple[tuple[tuple[int, int], ...], int]], first_sequence: int = 0) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, pieces in a sequence, first sequence, offset) for each length of each pattern.

    A piece of that length with rank r lies in sequence `first + (r - first rank) // pieces` at
    `offset + (r - first rank) % pieces * length`.
    """
    out, rank, sequence_id = [], {}, first_sequence
    for pattern, count in patterns:
        offset = 0
        for length, times in pattern:
            out.append((length, rank.get(length, 0), times, sequence_id, offset))
            rank[length] = rank.get(length, 0) + count * times
            offset += times * length
        sequence_id += count
    return sorted(out)


def ranked_by_length(pieces: DataFrame) -> DataFrame:
    """pieces with `rank`: 0, 1, ... within each length, in no order of meaning.

    A length may hold a third of all pieces, so each is dealt into groups by a hash of the id; groups are ranked by
    themselves and shifted by the sizes of the groups before. The sizes have a row for each length and group.
    """
    rows = pieces.count()
    groups = max(1, -(-rows // RANK_GROUP), 4 * int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = pieces.withColumn("__hr_group", F.pmod(F.xxhash64("doc_id", "start", F.lit(7)), F.lit(groups)))
    in_group = Window.partitionBy("length", "__hr_group").orderBy("doc_id", "start")
    sizes = dealt.groupBy("length", "__hr_group").agg(F.count(F.lit(1)).alias("__hr_n"))
    before = Window.partitionBy("length").orderBy("__hr_group").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.withColumn("__hr_shift", F.coalesce(F.sum("__hr_n").over(before), F.lit(0))).drop("__hr_n")
    local = dealt.withColumn("__hr_local", F.row_number().over(in_group) - 1)
    return local.join(shifts, ["length", "__hr_group"]).withColumn("rank", F.col("__hr_local") + F.col("__hr_shift")).drop("__hr_group", "__hr_local", "__hr_shift")


def pack_pieces(pieces: DataFrame, sequence: int = SEQUENCE) -> DataFrame:
    """pieces (doc_id, start, length, ...) with sequence_id and offset.

    Only the histogram of lengths, at most `sequence` rows, reaches the driver. Full pieces are sequences by themselves.
    The patterns come back to the pieces by length and rank: a search in a sorted table whose size depends on the
    patterns alone (at most `sequence` lengths in some thousand patterns). No pieces give no rows.
    """
    spark = pieces.sparkSession
    histogram = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    table = slots(shortest_pack_first(histogram, sequence))
    lengths, firsts, times, sequences, offsets = (np.array(c, dtype=np.int64) for c in (zip(*table) if table else ([],) * 5))
    send = spark.sparkContext.broadcast((lengths * (1 << 44) + firsts, lengths, firsts, times, sequences, offsets))
    ranked = ranked_by_length(pieces)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, lengths, firsts, times, sequences, offsets = send.value
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.searchsorted(keys, length * (1 << 44) + rank, side="right") - 1
            nth = rank - firsts[at]
            columns = [batch.column(c) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequences[at] + nth // times[at]), pa.array(offsets[at] + nth % times[at] * length)], [*kept, "sequence_id", "offset"])

    kept = pieces.columns
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return ranked.mapInArrow(place, f"{fields}, sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_file: str | None = None, sequence: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (see cut_documents, pack_pieces)."""
    pieces = materialize(cut_documents(docs, id_col, text_col, tokenizer_file, sequence, end_id), "pieces")
    return pack_pieces(pieces, sequence)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir))
