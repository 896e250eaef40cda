"""SentencePiece encoding and decoding: longest-prefix normalisation that keeps offsets, BPE merges by score, spans of original bytes."""

from __future__ import annotations

import hashlib
import heapq
import math
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_bpe import Kept
from .common import documents, small_batches

SPACE = "▁"
#: Kinds of pieces and the BPE model type, as numbered in the model file's format. Fixed values.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
BPE_MODEL = 2
#: Runs of more symbols than this are merged by a heap, shorter ones by scanning.
SCAN_SYMBOLS = 24


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of one protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or varint()
            yield key >> 3, data[at : at + size]
            at += size


class CharacterMap:
    """The rules of a compiled character map: a double-array trie from byte strings to places in a block of results that end with NUL."""

    def __init__(self, blob: bytes):
        self.rules: dict[str, str] = {}
        if blob:
            size = struct.unpack_from("<I", blob)[0]
            self.units = np.frombuffer(blob, "<u4", size // 4, 4).astype(np.int64)
            self.results = blob[4 + size :]
            for key, value in self._keys():
                self.rules[key.decode("utf-8")] = self.results[value : self.results.index(b"\0", value)].decode("utf-8")
        self.longest = max(map(len, self.rules), default=0)
        alone = {k for k in self.rules if len(k) == 1}
        later = {k[1] for k in self.rules if len(k) > 1}
        parts = [f"[{''.join(map(re.escape, sorted(alone)))}]"] * bool(alone) + [f".(?=[{''.join(map(re.escape, sorted(later)))}])"] * bool(later)
        #: Finds the places where a rule can begin.
        self.begins = re.compile("|".join(parts), re.S) if parts else None

    def _step(self, nodes: np.ndarray) -> np.ndarray:
        unit = self.units[nodes]
        return nodes ^ (unit >> 10 << ((unit & 512) >> 6))

    def _keys(self) -> Iterator[tuple[bytes, int]]:
        """All keys with their values, one level of the trie at a time."""
        labels = np.arange(1, 256)
        nodes, keys = self._step(np.zeros(1, np.int64)), [b""]
        while len(nodes):
            below = nodes[:, None] ^ labels
            inside = below < len(self.units)
            found = inside & ((self.units[np.where(inside, below, 0)] & 0x800000FF) == labels)
            rows, columns = np.nonzero(found)
            units = self.units[below[rows, columns]]
            keys = [keys[r] + bytes([labels[c]]) for r, c in zip(rows, columns)]
            nodes = self._step(below[rows, columns])
            for i in np.nonzero(units >> 8 & 1)[0]:
                yield keys[i], int(self.units[nodes[i]] & 0x7FFFFFFF)

    def at(self, text: str, i: int) -> tuple[str, str] | None:
        """The longest key that text has at i, with its result."""
        for size in range(min(self.longest, len(text) - i), 0, -1):
            key = text[i : i + size]
            if key in self.rules:
                return key, self.rules[key]
        return None


class Alignment:
    """Where the bytes of a normalised text come from: runs that were copied, and results of rules, which stand at one place."""

    def __init__(self):
        self.runs: list[tuple[int, int, bool]] = []

    def add(self, normal: int, original: int, copied: bool) -> None:
        self.runs.append((normal, original, copied))

    def original(self, places: np.ndarray, end_normal: int, end_original: int) -> np.ndarray:
        """Places in the original's bytes for places in the normalised bytes that are borders of characters."""
        normal, original, copied = (np.array(x, np.int64) for x in zip(*self.runs, (end_normal, end_original, False)))
        return self._at(places, normal, original, copied)

    @staticmethod
    def _at(places: np.ndarray, normal: np.ndarray, original: np.ndarray, copied: np.ndarray) -> np.ndarray:
        run = np.searchsorted(normal, places, side="right") - 1
        return original[run] + np.where(copied[run] == 1, places - normal[run], 0)


class PlainAlignment(Alignment):
    """The alignment of a text in which spaces alone are replaced, each by one that is `wider` bytes longer, and `added` bytes stand before it."""

    def __init__(self, raw: bytes, added: int, wider: int):
        super().__init__()
        spaces = np.flatnonzero(np.frombuffer(raw, np.uint8) == 32)
        at = added + spaces + wider * np.arange(len(spaces))
        after = np.ones(len(spaces), np.int64)
        first = [0] * bool(added)
        # The added bytes, then what stands before the first space, then each space and what follows it.
        self.normal = np.concatenate([first, [added], np.column_stack([at, at + 1 + wider]).ravel()]).astype(np.int64)
        self.begin = np.concatenate([first, [0], np.column_stack([spaces, spaces + 1]).ravel()]).astype(np.int64)
        self.copied = np.concatenate([first, [1], np.column_stack([0 * after, after]).ravel()]).astype(np.int64)

    def original(self, places: np.ndarray, end_normal: int, end_original: int) -> np.ndarray:
        normal, original, copied = (np.append(x, y) for x, y in ((self.normal, end_normal), (self.begin, end_original), (self.copied, 0)))
        return self._at(places, normal, original, copied)


class Normalizer:
    """What is done to a text before it is cut into pieces, by the model's settings."""

    def __init__(self, spec: bytes, matched: tuple[str, ...] = (), space_last: bool = False):
        own = dict(_fields(spec))
        self.map = CharacterMap(own.get(2, b""))
        self.prefix, self.squeeze, self.escape = bool(own.get(3, 1)), bool(own.get(4, 1)), bool(own.get(5, 1))
        self.space_last = space_last
        self.matched = re.compile("|".join(map(re.escape, sorted(matched, key=len, reverse=True)))) if matched else None
        self.plain = self.map.begins is None and not self.squeeze and self.escape and not matched and not space_last

    def _parts(self, text: str) -> Iterator[tuple[str, str, bool]]:
        """Original and normalised text, in turn: user-defined pieces as they are, else the longest rule, else what no rule touches."""
        places = sorted({m.start() for find in (self.map.begins, self.matched) if find for m in find.finditer(text)})
        done = 0
        for i in places:
            if i < done:
                continue
            own = self.matched.match(text, i) if self.matched else None
            rule = (own[0], own[0]) if own else self.map.at(text, i)
            if rule is None:
                continue
            if done < i:
                yield text[done:i], text[done:i], True
            yield *rule, False
            done = i + len(rule[0])
        if done < len(text):
            yield text[done:], text[done:], True

    def run(self, text: str) -> tuple[str, Alignment, int, int]:
        """The normalised text, its alignment, and how many bytes long it is and how many of the original it stands for."""
        space = SPACE if self.escape else " "
        width = len(space.encode("utf-8"))
        if self.plain and text:
            raw, added = text.encode("utf-8"), width * self.prefix
            made = (space if self.prefix else "") + text.replace(" ", space)
            return made, PlainAlignment(raw, added, width - 1), added + len(raw) + (width - 1) * text.count(" "), len(raw)
        out, align, normal, original = [], Alignment(), 0, 0
        parts, dropping = [], self.squeeze
        for raw, made, copied in self._parts(text) if text else ():
            begin, size = original, len(raw.encode("utf-8"))
            original += size
            if not copied:
                kept = made.lstrip(" ") if dropping else made
                if kept:
                    dropping = self.squeeze and kept.endswith(" ")
                    parts.append((begin, kept, False))
                continue
            for piece in re.findall(" |[^ ]+", made):
                if piece != " " or not dropping:
                    parts.append((begin, piece, piece != " "))
                    dropping = self.squeeze and piece == " "
                begin += len(piece.encode("utf-8"))
        if self.squeeze:
            while parts and parts[-1][1].endswith((" ", SPACE)):
                begin, piece, copied = parts.pop()
                kept = piece.rstrip(f" {SPACE}")
                original = begin + len(kept.encode("utf-8")) * copied
                if kept:
                    parts.append((begin, kept, copied))
        if not parts:
            return "", align, 0, original
        if self.prefix and not self.space_last:
            align.add(0, parts[0][0], False)
            out.append(space)
            normal += width
        for begin, piece, copied in parts:
            align.add(normal, begin, copied)
            made = piece.replace(" ", space)
            out.append(made)
            normal += len(made.encode("utf-8"))
        if self.prefix and self.space_last:
            align.add(normal, original, False)
            out.append(space)
            normal += width
        return "".join(out), align, normal, original


class Model:
    """A BPE model file of SentencePiece, read into tables. It encodes units that begin with spaces; those that come again are kept."""

    def __init__(self, model_file: str):
        with open(model_file, "rb") as f:
            self._read(f.read())

    def _read(self, data: bytes) -> None:
        self.pieces: list[str] = []
        self.kinds: list[int] = []
        self.score: dict[str, float] = {}
        self.id_of: dict[str, int] = {}
        own: dict[int, bytes] = {}
        for field, value in _fields(data):
            if field != 1:
                own[field] = value
                continue
            piece = dict(_fields(value))
            text, kind = piece[1].decode("utf-8"), piece.get(3, NORMAL)
            if kind in (NORMAL, USER_DEFINED, UNUSED):
                self.score[text] = struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0]
                self.id_of[text] = len(self.pieces)
            self.pieces.append(text)
            self.kinds.append(kind)
        trainer = dict(_fields(own.get(2, b"")))
        if trainer.get(3, 1) != BPE_MODEL:
            raise ValueError("only BPE models are encoded here")
        matched = tuple(p for p, k in zip(self.pieces, self.kinds) if k == USER_DEFINED)
        self.normalizer = Normalizer(own.get(3, b""), matched, bool(trainer.get(24, 0)))
        self.denormalizer = Normalizer(own[5]) if dict(_fields(own.get(5, b""))).get(2) else None
        self.fixed = self.normalizer.matched
        self.fixed_or_one = re.compile(f"{self.fixed.pattern}|." if self.fixed else ".", re.S)
        self.unused = {p for p, k in zip(self.pieces, self.kinds) if k == UNUSED}
        self.unknown, self.end = self.kinds.index(UNKNOWN), self.pieces.index(trainer.get(47, b"</s>").decode("utf-8"))
        self.byte_id = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == BYTE} if trainer.get(35, 0) else {}
        self.unknown_surface = trainer.get(44, " ⁇ ".encode()).decode("utf-8")
        #: Units end before a run of spaces if no piece has a space after another character.
        self.by_space = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.score) and not matched
        #: Two characters that are neighbours in no piece are never merged.
        self.neighbours = {p[i : i + 2] for p in self.score for i in range(len(p) - 1)}
        self.surface = [self._surface(i) for i in range(len(self.pieces))]
        self.surface_bytes = [x if isinstance(x, bytes) else x.encode("utf-8") for x in self.surface]
        self.size = [len(x.encode("utf-8")) for x in self.pieces]
        self.decimal = [str(i) for i in range(len(self.pieces))]
        self.units = Units(self)

    def _surface(self, i: int) -> str | bytes:
        kind = self.kinds[i]
        if kind == BYTE:
            return bytes([int(self.pieces[i][3:5], 16)])
        return "" if kind == CONTROL else self.unknown_surface if kind == UNKNOWN else self.pieces[i].replace(SPACE, " ")

    def symbols(self, unit: str) -> Iterator[list[str]]:
        """The unit's characters (user-defined pieces whole), in runs between which nothing can be merged."""
        every = self.fixed_or_one.findall(unit) if self.fixed else unit
        run = [every[0]]
        for a, b in zip(every, every[1:]):
            if a[-1] + b[0] in self.neighbours:
                run.append(b)
            else:
                yield run
                run = [b]
        yield run

    def merge(self, symbols: list[str] | str) -> list[str]:
        """Merge neighbours, best score first and leftmost of equals, until nothing merges; unused pieces are taken apart again."""
        frozen = self.fixed
        stands = [bool(frozen and frozen.fullmatch(s)) for s in symbols] if frozen else None
        split: dict[str, tuple[str, str]] = {}
        parts = list(symbols)
        if len(parts) <= SCAN_SYMBOLS and not frozen:
            none, score = -math.inf, self.score.get
            scores = [score(a + b, none) for a, b in zip(parts, parts[1:])]
            while scores and (best := max(scores)) > none:
                at = scores.index(best)
                both = parts[at] + parts[at + 1]
                if self.unused and both in self.unused:
                    split[both] = parts[at], parts[at + 1]
                parts[at] = both
                del parts[at + 1]
                del scores[at]
                if at:
                    scores[at - 1] = score(parts[at - 1] + both, none)
                if at < len(scores):
                    scores[at] = score(both + parts[at + 1], none)
        elif len(parts) > 1:
            before, after = list(range(-1, len(parts) - 1)), [*range(1, len(parts)), -1]
            agenda: list[tuple[float, int, int, str]] = []

            def offer(i: int, j: int) -> None:
                if i >= 0 and j >= 0 and not (stands and (stands[i] or stands[j])):
                    both = parts[i] + parts[j]
                    score = self.score.get(both)
                    if score is not None:
                        if both in self.unused:
                            split[both] = parts[i], parts[j]
                        heapq.heappush(agenda, (-score, i, j, both))

            for i in range(len(parts) - 1):
                offer(i, i + 1)
            while agenda:
                _, i, j, both = heapq.heappop(agenda)
                if not parts[i] or not parts[j] or after[i] != j or parts[i] + parts[j] != both:
                    continue
                parts[i], parts[j] = both, ""
                after[i] = after[j]
                if after[j] >= 0:
                    before[after[j]] = i
                offer(before[i], i)
                offer(i, after[i])
            parts = [p for p in parts if p]
        return [x for p in parts for x in self._apart(p, split)] if split else parts

    def _apart(self, piece: str, split: dict[str, tuple[str, str]]) -> list[str]:
        if piece not in self.unused or piece not in split:
            return [piece]
        return [x for half in split[piece] for x in self._apart(half, split)]

    def encode_unit(self, unit: str) -> tuple[bytes, bytes]:
        """Ids and the bytes of normalised text that each takes (of the bytes of an unknown character, the last one takes all)."""
        # A short unit needs no runs: between them nothing has a score.
        pieces = self.merge(unit) if len(unit) <= SCAN_SYMBOLS and not self.fixed else [x for run in self.symbols(unit) for x in self.merge(run)]
        found = list(map(self.id_of.get, pieces))
        if None not in found:
            form = f"<{len(found)}I"
            return struct.pack(form, *found), struct.pack(form, *map(self.size.__getitem__, found))
        ids, sizes = [], []
        for piece, known in zip(pieces, found):
            size = len(piece.encode("utf-8"))
            if known is not None:
                ids.append(known)
                sizes.append(size)
            elif self.byte_id:
                ids += [self.byte_id[b] for b in piece.encode("utf-8")]
                sizes += [0] * (size - 1) + [size]
            else:
                ids.append(self.unknown)
                sizes.append(size)
        return np.array(ids, "<u4").tobytes(), np.array(sizes, "<u4").tobytes()

    def _units(self, normal: str) -> list[str]:
        return re.findall(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+", normal) if self.by_space else [normal]

    def encode(self, text: str) -> bytes:
        """Ids without marks, as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        return self._joined(b"".join([u[0] for u in self._encoded(self.normalizer.run(text)[0])]))

    def _encoded(self, normal: str) -> list[tuple[bytes, bytes]]:
        """What encode_unit gives for each unit of a normalised text; where single spaces alone begin them they are looked up by their words."""
        if self.by_space and normal.startswith(SPACE):
            words = normal.split(SPACE)
            del words[0]
            if "" not in words:
                return list(map(self.units.__getitem__, words))
        return [self.unit(u) for u in self._units(normal)]

    def unit(self, unit: str) -> tuple[bytes, bytes]:
        """A unit of normalised text; that of one space and a word is kept by the word."""
        return self.units[unit[1:]] if unit.startswith(SPACE) and not unit.startswith(SPACE, 1) and len(unit) > 1 else self.encode_unit(unit)

    def _joined(self, ids: bytes) -> bytes:
        """Neighbouring unknown pieces are one, where the model has no pieces for bytes."""
        if self.byte_id:
            return ids
        every = np.frombuffer(ids, "<u4")
        again = np.zeros(len(every), bool)
        again[1:] = (every[1:] == self.unknown) & (every[:-1] == self.unknown)
        return every[~again].tobytes()

    def encode_spans(self, text: str) -> tuple[bytes, np.ndarray, np.ndarray]:
        """Ids, and where the original bytes of each piece begin and end: the added space has none, and of the bytes of one unknown
        character only the last one has a span."""
        normal, align, size, original = self.normalizer.run(text)
        units = self._encoded(normal)
        ids = b"".join([u[0] for u in units])
        if not ids:
            return b"", np.zeros(0, np.int64), np.zeros(0, np.int64)
        borders = np.cumsum(np.frombuffer(b"\0\0\0\0" + b"".join([u[1] for u in units]), "<u4").astype(np.int64))
        places = align.original(borders, size, original)
        begin, end = places[:-1], places[1:]
        if not self.byte_id:
            every = np.frombuffer(ids, "<u4")
            again = np.zeros(len(every), bool)
            again[1:] = (every[1:] == self.unknown) & (every[:-1] == self.unknown)
            last = np.append(~again[1:], True)
            return every[~again].tobytes(), begin[~again], end[last]
        return ids, begin, end

    def decode(self, ids: list[int]) -> str:
        """The text of ids: marks give nothing, bytes become characters (U+FFFD where they are none), and the first space that the
        encoder adds goes."""
        if not self.denormalizer and ids and self.kinds[ids[0]] == NORMAL:
            # No piece without text stands between bytes, which are one text then.
            every = list(map(self.surface_bytes.__getitem__, ids))
            if self.normalizer.prefix or self.normalizer.squeeze:
                every[0] = every[0].removeprefix(b" ")
            if b"" not in every[:-1]:
                try:
                    return b"".join(every).decode("utf-8")
                except UnicodeDecodeError:
                    pass
        parts = list(map(self.surface.__getitem__, ids))
        if self.normalizer.prefix or self.normalizer.squeeze:
            for i, x in enumerate(ids):
                if self.kinds[x] == CONTROL:
                    continue
                if self.kinds[x] in (BYTE, UNKNOWN):
                    break
                whole, parts[i] = parts[i], parts[i].removeprefix(" ")
                if parts[i] or (whole and not self.normalizer.squeeze):
                    break
        try:
            out = "".join(parts)
        except TypeError:
            out = _with_bytes(parts)
        return self.denormalizer.run(out)[0] if self.denormalizer else out


def _with_bytes(parts: list[str | bytes]) -> str:
    """The text of pieces of which some are bytes. A piece that is no byte ends a character even if it has no text itself."""
    if "" not in parts[:-1]:
        try:
            return b"".join(p if isinstance(p, bytes) else p.encode("utf-8") for p in parts).decode("utf-8")
        except UnicodeDecodeError:
            pass
    return "".join(_characters(parts))


def _characters(parts: list[str | bytes]) -> Iterator[str]:
    """Texts as they are; runs of bytes character by character, each byte that begins none as U+FFFD."""
    run = b""
    for part in [*parts, ""]:
        if isinstance(part, bytes):
            run += part
            continue
        while run:
            for size in (1, 2, 3, 4):
                try:
                    yield run[:size].decode("utf-8")
                    run = run[size:]
                    break
                except UnicodeDecodeError:
                    continue
            else:
                yield "�"
                run = run[1:]
        yield part


class Units(Kept):
    """What encode_unit gives for one space and a word, by the word."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model

    def make(self, key: str) -> tuple[bytes, bytes]:
        return self.model.encode_unit(SPACE + key)


_loaded: dict[str, Model] = {}


def load(model_file: str) -> Model:
    """One model per worker process and file."""
    if model_file not in _loaded:
        _loaded[model_file] = Model(model_file)
    return _loaded[model_file]


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_file: str | None = None, with_end: bool = True, keep_ids: bool = True, keep_spans: bool = False) -> DataFrame:
    """id_col, n_tokens, ids_sha256, decoded_sha256; with keep_ids the ids, with keep_spans where each piece begins and ends in the
    original text's UTF-8 bytes.

    A map over the rows without a shuffle: whole texts of any length, one Arrow batch at a time; words that come again are encoded
    once in a worker and kept in a bounded table. Null counts as empty, which has the end id alone (its span is empty, at the end of
    the text). Repeated rows give repeated results, null ids stay null, other columns are ignored, and no rows give no rows. The model
    file is read by path on each executor.
    """
    where = model_file or default_model()
    fields = ["n_tokens bigint", "ids_sha256 string", "decoded_sha256 string", *["ids array<int>"] * keep_ids, *["begins array<bigint>", "ends array<bigint>"] * keep_spans]
    types = [pa.int64(), pa.string(), pa.string(), *[pa.list_(pa.int32())] * keep_ids, *[pa.list_(pa.int64())] * (2 * keep_spans)]
    id_type = docs.select(id_col).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(where)
        for batch in batches:
            out: list[list] = [[] for _ in fields]
            for text in batch.column(1).to_pylist():
                text = text or ""
                if keep_spans:
                    packed, begin, end = model.encode_spans(text)
                    spans = [np.append(x, [len(text.encode("utf-8"))] * with_end) for x in (begin, end)]
                else:
                    packed, spans = model.encode(text), []
                ids = np.frombuffer(packed, "<u4").tolist() + [model.end] * with_end
                hashed = hashlib.sha256(" ".join(map(model.decimal.__getitem__, ids)).encode("ascii")).hexdigest()
                decoded = hashlib.sha256(model.decode(ids).encode("utf-8")).hexdigest()
                for column, value in zip(out, [len(ids), hashed, decoded, *[ids] * keep_ids, *spans]):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(out, types))], [id_col, *(f.split()[0] for f in fields)])

    return small_batches(docs).select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {id_type}, " + ", ".join(fields))


def decode_documents(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model_file: str | None = None) -> DataFrame:
    """id_col, text: the text of each row's ids. Null counts as no ids; ids beyond the model's raise an error."""
    where = model_file or default_model()
    id_type = encoded.select(id_col).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(where)
        for batch in batches:
            texts = [model.decode(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [id_col, "text"])

    return encoded.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {id_type}, text string")


def op13_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digests, and spans_hash: xxhash64 of where the pieces begin and end in the original's bytes."""
    made = encode_documents(documents(spark, sf_dir), keep_ids=False, keep_spans=True)
    return made.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", F.xxhash64("begins", "ends").alias("spans_hash"))
