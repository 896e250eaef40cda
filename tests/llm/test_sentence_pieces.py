"""SentencePiece operator against the library: ids, spans and decoding, with the given model and with other normalisers put into it."""

import hashlib
import random

import numpy as np
import pytest

pytest.importorskip("homerank.llm")
import sentencepiece  # noqa: E402
from test_operators import AWKWARD, SCHEMA  # noqa: E402

from homerank.llm import sentence_pieces  # noqa: E402

ALPHABET = [*"abcdeehtonisr ,.'\n\t  ▁éÜ日本語🎉́\x00<s>123 ", "▁▁", "  ", "the ", "ing", "ﬁ", "①", "Ａ", "각"]
EDGES = ["", " ", "  ", "a", " a", "a ", "\n", "▁", "▁a", "a▁ ▁", "日本 語🎉 x  y\n\nz", "a" * 3000, "<s> </s> <0x41>", "a" * 30 + " " * 40 + "b"]


def texts(n):
    rnd = random.Random(7)
    return EDGES + ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(1, 60))) for _ in range(n)]


def agrees(library, model, every):
    for text in every:
        want = library.encode(text)
        ids, begins, ends = model.encode_spans(text)
        assert np.frombuffer(model.encode(text), "<u4").tolist() == want == np.frombuffer(ids, "<u4").tolist(), text
        assert list(zip(begins.tolist(), ends.tolist())) == [(p.begin, p.end) for p in library.encode(text, return_type="proto").pieces], text
        assert model.decode(want) == library.decode(want), text


def test_given_model():
    library, model = sentencepiece.SentencePieceProcessor(model_file=sentence_pieces.default_model()), sentence_pieces.load(sentence_pieces.default_model())
    agrees(library, model, texts(1500))
    rnd = random.Random(3)
    for _ in range(1500):  # ids that no text has: broken characters, marks between bytes
        ids = [rnd.choice([0, 1, 2, rnd.randint(3, 258), rnd.randint(3, 258), rnd.randint(259, 31999)]) for _ in range(rnd.randint(1, 8))]
        assert model.decode(ids) == library.decode(ids), ids


def _number(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _with_normalizer(character_map: bytes, prefix: int, squeeze: int) -> bytes:
    out = b""
    with open(sentence_pieces.default_model(), "rb") as f:
        for field, value in sentence_pieces._fields(f.read()):
            if field == 3:
                value = (b"\x12" + _number(len(character_map)) + character_map if character_map else b"") + b"\x18" + bytes([prefix]) + b"\x20" + bytes([squeeze])
            out += _number(field << 3 | 2) + _number(len(value)) + value
    return out


@pytest.mark.parametrize("rule", ["identity", "nmt_nfkc", "nmt_nfkc_cf"])
@pytest.mark.parametrize("prefix, squeeze", [(0, 0), (1, 1), (0, 1)])
def test_other_normalizers(tmp_path, rule, prefix, squeeze):
    spec = dict(sentence_pieces._fields(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto()))[3]
    path = tmp_path / "own.model"
    path.write_bytes(_with_normalizer(dict(sentence_pieces._fields(spec)).get(2, b""), prefix, squeeze))
    agrees(sentencepiece.SentencePieceProcessor(model_file=str(path)), sentence_pieces.Model(str(path)), texts(400))


def test_documents(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=sentence_pieces.default_model())
    docs = spark.createDataFrame([(i, t, "en", "clash", 0.5) for i, t in AWKWARD], SCHEMA)
    rows = sentence_pieces.encode_documents(docs, keep_spans=True).collect()
    want = sorted((library.encode(t or "", add_eos=True) for _, t in AWKWARD), key=repr)
    assert sorted((r["ids"] for r in rows), key=repr) == want
    whole = {tuple(library.encode(t or "", add_eos=True)): t or "" for _, t in AWKWARD}
    for r in rows:
        text = whole[tuple(r["ids"])]
        assert r["n_tokens"] == len(r["ids"]) == len(r["begins"]) == len(r["ends"])
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, r["ids"])).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(r["ids"]).encode()).hexdigest()
        # Spans stand side by side and cover the text.
        assert b"".join(text.encode()[a:b] for a, b in zip(r["begins"], r["ends"])).decode() == text
    back = {(r["doc_id"], r["text"]) for r in sentence_pieces.decode_documents(sentence_pieces.encode_documents(docs)).collect()}
    assert back == {(i, t or "") for i, t in AWKWARD}
    assert sentence_pieces.encode_documents(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query(spark, sf):
    library = sentencepiece.SentencePieceProcessor(model_file=sentence_pieces.default_model())
    text = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = sentence_pieces.op13_sentence_pieces(spark, sf).collect()
    assert len(rows) == len(text)
    for r in rows:
        ids = library.encode(text[r["doc_id"]], add_eos=True)
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_query_aligns_every_text(spark, sf, monkeypatch):
    """The query's rows come with the spans of their pieces, and plain texts are normalised and aligned like all others."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    library = sentencepiece.SentencePieceProcessor(model_file=sentence_pieces.default_model())
    spans = []
    for r in docs.select("doc_id", "text").collect():
        pieces, size = library.encode(r["text"] or "", return_type="proto").pieces, len((r["text"] or "").encode("utf-8"))
        spans.append((r["doc_id"], [p.begin for p in pieces] + [size], [p.end for p in pieces] + [size]))
    want = spark.createDataFrame(spans, "doc_id bigint, begins array<bigint>, ends array<bigint>").select("doc_id", F.xxhash64("begins", "ends").alias("spans_hash"))
    rows = sentence_pieces.op13_sentence_pieces(spark, sf)
    assert rows.columns[:4] == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert rows.select("doc_id", "spans_hash").exceptAll(want).isEmpty()
    seen = []
    run = sentence_pieces.Normalizer.run
    monkeypatch.setattr(sentence_pieces.Normalizer, "run", lambda self, text: seen.append(text) or run(self, text))
    sentence_pieces.load(sentence_pieces.default_model()).encode("plain words")
    assert seen == ["plain words"]


def test_short_units_and_bytes_take_the_short_way(monkeypatch):
    """Units of a few characters are merged without looking for runs, bytes are decoded as one text; both as the long ways do."""
    model = sentence_pieces.Model(sentence_pieces.default_model())
    rnd = random.Random(13)
    words = ["".join(rnd.choice("aeinrst▁E0é漢‍😀") for _ in range(rnd.randint(1, 20))) for _ in range(400)]
    runs = [[x for run in model.symbols(w) for x in model.merge(run)] for w in words]
    texts = [f"plain words {w.replace('▁', ' ')}" for w in words]
    longs = ["".join(sentence_pieces._characters([model.surface[i] for i in np.frombuffer(model.encode(t), "<u4").tolist()])).removeprefix(" ") for t in texts]
    monkeypatch.setattr(sentence_pieces.Model, "symbols", lambda *a: 1 / 0)
    monkeypatch.setattr(sentence_pieces, "_with_bytes", lambda *a: 1 / 0)
    model = sentence_pieces.Model(sentence_pieces.default_model())
    for w, pieces in zip(words, runs):
        ids = [i for p in pieces for i in ([model.id_of[p]] if p in model.id_of else [model.byte_id[b] for b in p.encode("utf-8")])]
        assert np.frombuffer(model.encode_unit(w)[0], "<u4").tolist() == ids
    assert [model.decode(np.frombuffer(model.encode(t), "<u4").tolist()) for t in texts] == longs == texts
