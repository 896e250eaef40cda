"""Byte-level BPE: exact merges by backtracking over Aho-Corasick matches, and decoding."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, small_batches

#: Entries that a worker keeps of the ids of chunks, pieces and of the answers for token pairs; a full cache is emptied.
CACHE_ENTRIES = 500_000
#: Longer chunks are encoded but not kept.
CACHE_KEY_CHARS = 64


class ByteBpe:
    """Encoder and decoder for one rank file.

    A text is split by `pattern`; each piece is a token itself, or gets the one sequence of tokens in which all
    neighbours are compatible, which is what merging by rank gives. Two neighbours are compatible when no merge across
    their border comes before the merges that build them; the answers are kept. The search starts from the longest match at each
    place, found by one automaton over bytes mapped to Latin-1, and takes back a token only when nothing follows it;
    a place from which nothing follows is never tried again, so the work is linear in the piece.
    """

    def __init__(self, rank_file: str, pattern: str):
        with open(rank_file, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.pattern = regex.compile(pattern)
        self.bytes_of = {i: b for b, i in self.ranks.items()}
        self.automaton = ahocorasick.Automaton()
        self.parts: dict[bytes, list[bytes]] = {}
        for token, rank in self.ranks.items():
            parts = self.merge(token, 2)
            if len(token) == 1 or len(parts) == 2:
                self.parts[token] = parts
                self.automaton.add_word(token.decode("latin-1"), (rank, len(token)))
        self.automaton.make_automaton()
        self.length_of = {rank: len(token) for token, rank in self.ranks.items()}
        #: The next shorter token that begins the same, for those that have one.
        self.shorter = {self.ranks[t]: r for t in self.parts for r in [next((self.ranks[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in self.parts), None)] if r is not None}
        self.compatible: dict[tuple[int, int], bool] = {}
        self.pieces = Pieces(self)
        self.chunks = Chunks(self)

    def merge(self, data: bytes, stop: int = 1) -> list[bytes]:
        """Plain merging, lowest rank first, until `stop` parts are left or none can be merged: the definition."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > stop:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _edge(self, token: bytes, side: int) -> list[tuple[bytes, int]]:
        """What stands at one border of a token while it is built: each part, and the rank of the merge that takes it up."""
        out = [(token, 1 << 60)]
        while len(token) > 1:
            rank, token = self.ranks[token], self.parts[token][side]
            out.append((token, rank))
        return out[::-1]

    def _pair(self, left: int, right: int) -> bool:
        known = self.compatible.get((left, right))
        if known is None:
            if len(self.compatible) >= 4 * CACHE_ENTRIES:
                self.compatible.clear()
            a, b = self._edge(self.bytes_of[left], 1), self._edge(self.bytes_of[right], 0)
            i = j = 0
            known = True
            while i < len(a) and j < len(b):
                (x, x_until), (y, y_until) = a[i], b[j]
                rank = self.ranks.get(x + y, 1 << 60)
                # Of equal ranks the leftmost merge comes first: that inside `left`, else that across the border.
                if rank < x_until and rank <= y_until and rank < 1 << 60:
                    known = False
                    break
                i, j = (i + 1, j) if x_until <= y_until else (i, j + 1)
            self.compatible[left, right] = known
        return known

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        size = len(piece)
        # The longest token at each place that is still to be tried; None where nothing follows.
        next_at: list[int | None] = [None] * size
        for end, (rank, length) in self.automaton.iter(piece.decode("latin-1")):
            next_at[end - length + 1] = rank
        length_of, ids, pos = self.length_of, [], 0
        while pos < size:
            token = next_at[pos]
            while token is not None:
                end = pos + length_of[token]
                if (end == size or next_at[end] is not None) and (not ids or self._pair(ids[-1], token)):
                    break
                token = self.shorter.get(token)
            next_at[pos] = token
            if token is not None:
                ids.append(token)
                pos = end
            else:
                # Nothing follows the token before; its place goes on with the next shorter one.
                back = ids.pop()
                pos -= length_of[back]
                next_at[pos] = self.shorter.get(back)
        return ids

    def by_pattern(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.pattern.findall(text)))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers.

        A space between two characters that are no white space always begins a match of the pattern, so the text is cut
        there and the ids of each chunk are kept; a text with other runs of white space is split by the pattern as a whole.
        """
        first, *rest = text.split(" ")
        if not rest or not first or first[-1].isspace():
            return self.by_pattern(text)
        last = rest.pop()
        if not last or last[0].isspace():
            return self.by_pattern(text)
        try:
            return b"".join([self.by_pattern(first), *map(self.chunks.__getitem__, rest), self.by_pattern(" " + last)])
        except _Loose:
            return self.by_pattern(text)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class _Loose(Exception):
    """A chunk that begins or ends with white space: its matches may reach beyond it."""


class Kept(dict):
    """Ids by key, in two generations of CACHE_ENTRIES: what was asked for of late stays."""

    def __init__(self):
        self.older: dict[str, bytes] = {}

    def make(self, key: str) -> bytes:
        raise NotImplementedError

    def __missing__(self, key: str) -> bytes:
        ids = self.older.get(key)
        if ids is None:
            ids = self.make(key)
        if len(key) <= CACHE_KEY_CHARS:
            if len(self) >= CACHE_ENTRIES:
                self.older = dict(self)
                self.clear()
            self[key] = ids
        return ids


class Pieces(Kept):
    def __init__(self, bpe: ByteBpe):
        super().__init__()
        self.bpe = bpe

    def make(self, key: str) -> bytes:
        return np.array(self.bpe.encode_piece(key.encode("utf-8")), dtype="<u4").tobytes()


class Chunks(Kept):
    def __init__(self, bpe: ByteBpe):
        super().__init__()
        self.bpe = bpe

    def make(self, key: str) -> bytes:
        if not key or key[0].isspace() or key[-1].isspace():
            raise _Loose
        if key.isalpha():
            return self.bpe.pieces[" " + key]
        if key[-1] in ".," and key[:-1].isalpha():
            return self.bpe.pieces[" " + key[:-1]] + self.bpe.pieces[key[-1]]
        return self.bpe.by_pattern(" " + key)


_loaded: dict[tuple[str, str], ByteBpe] = {}


def load(rank_file: str, pattern: str) -> ByteBpe:
    """One encoder per worker process and rank file."""
    if (rank_file, pattern) not in _loaded:
        _loaded[rank_file, pattern] = ByteBpe(rank_file, pattern)
    return _loaded[rank_file, pattern]


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rank_file: str | None = None, pattern: str | None = None, keep_ids: bool = True) -> DataFrame:
    """id_col, n_tokens, ids (little-endian unsigned 32-bit integers, with keep_ids), ids_sha256, decoded_sha256.

    A map over the rows without a shuffle: whole texts of any length, in memory one Arrow batch at a time. Null counts as
    empty and gives no tokens. Repeated rows give repeated results; other columns are ignored; no rows give no rows.
    The rank file is read by path on each executor.
    """
    own_file, own_pattern = default_vocabulary() if rank_file is None or pattern is None else (rank_file, pattern)
    where = (rank_file or own_file, pattern or own_pattern)
    fields = ["n_tokens bigint", *["ids binary"] * keep_ids, "ids_sha256 string", "decoded_sha256 string"]
    id_type = docs.select(id_col).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(*where)
        for batch in batches:
            out: list[list] = [[] for _ in fields]
            for text in batch.column(1).to_pylist():
                ids = bpe.encode(text or "")
                row = [len(ids) // 4, *[ids] * keep_ids, hashlib.sha256(ids).hexdigest(), hashlib.sha256(bpe.decode(ids)).hexdigest()]
                for column, value in zip(out, row):
                    column.append(value)
            types = [pa.int64(), *[pa.binary()] * keep_ids, pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(out, types))], [id_col, *(f.split()[0] for f in fields)])

    return small_batches(docs).select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {id_type}, " + ", ".join(fields))


def decode_documents(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", rank_file: str | None = None) -> DataFrame:
    """id_col, text: the text of each row's ids; null ids count as none. Ids must come from the same rank file."""
    where = (rank_file or default_vocabulary()[0], default_vocabulary()[1])
    id_type = encoded.select(id_col).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(*where)
        for batch in batches:
            texts = [bpe.decode(ids or b"").decode("utf-8") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [id_col, "text"])

    return encoded.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {id_type}, text string")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(documents(spark, sf_dir), keep_ids=False)
