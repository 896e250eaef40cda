"""The text operators against brute force, round trips and held-out rows, on awkward small tables."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

pytest.importorskip("homerank.llm")
from compare import connect, same  # noqa: E402

from homerank.llm import byte_bpe, exact_dedup, fingerprints, html_extract, kneser_ney, language_id, near_dedup, packing, quality, toxicity  # noqa: E402

SCHEMA = "doc_id bigint, text string, lang string, keep_id string, score double"
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
AWKWARD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "One"), (6, "ONE two"), (7, "one two"), (7, "one two"), (8, LONG), (9, LONG + " end"), (10, "É one"), (11, "é one"),
    (12, "a" * 5000), (13, "the quick brown fox jumps over the lazy dog again and again"), (14, "the quick brown fox jumps over the lazy dog again and again!"), (15, "日本 語🎉 x  y\n\nz"), (None, "no id"),
]
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return re.findall("[^\x20\x09-\x0d]+", (t or "").translate(AZ))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", "clash", 0.5) for i, t in AWKWARD], SCHEMA).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact_dedup(spark, sf, docs, empty):
    assert same(exact_dedup.op1_exact_dedup(spark, sf), connect(sf), exact_dedup.ORACLE_SQL) == ""
    for hashed in (None, lambda text: text.substr(1, 0)):  # the second makes all hashes collide
        got = {r["doc_id"]: r for r in exact_dedup.exact_dedup(docs, keep="max", content_hash=hashed).collect()}
        assert got[1]["keep_id"] == 2 and got[4]["keep_id"] == 5 and got[7]["keep_id"] == 7 and got[7]["group_size"] == 3 and got[10]["kept"] and got[11]["kept"]
        assert got[5]["text_sha256"] == hashlib.sha256(b"one").hexdigest()
    assert sorted(r["doc_id"] or 0 for r in exact_dedup.drop_exact_copies(docs, keep="max").collect()) == [0, 2, 3, 5, 7, 8, 9, 10, 11, 12, 13, 14, 15]
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_byte_bpe_equals_tiktoken(docs, empty):
    import tiktoken

    file, pattern = byte_bpe.default_vocabulary()
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=byte_bpe.load(file, pattern).ranks, special_tokens={})
    rows = byte_bpe.encode_documents(docs).collect()
    texts = defaultdict(set)
    for i, t in AWKWARD:
        texts[i].add(t or "")
    for r in rows:
        assert np.frombuffer(r["ids"], "<u4").tolist() in [library.encode_ordinary(t) for t in texts[r["doc_id"]]]
        assert r["decoded_sha256"] in {hashlib.sha256(t.encode()).hexdigest() for t in texts[r["doc_id"]]}
    back = {(r["doc_id"], r["text"]) for r in byte_bpe.decode_documents(byte_bpe.encode_documents(docs)).collect()}
    assert back == {(i, t or "") for i, t in AWKWARD}
    assert byte_bpe.encode_documents(empty).count() == 0


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    ids = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for i, t in AWKWARD}
    seen, rows = defaultdict(set), packing.pack_documents(docs).collect()
    for r in rows:
        own = ids[r["doc_id"]]
        piece = own[r["start"] : r["start"] + r["length"]]
        assert len(piece) == r["length"] and r["doc_tokens"] == len(own) and r["ids_crc32"] == zlib.crc32(np.array(piece, "<u4").tobytes())
        seen[r["sequence_id"]].add((r["offset"], r["length"]))
    assert sum(r["length"] for r in rows) == sum(len(ids[i]) for i, _ in AWKWARD)
    for parts in seen.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.SEQUENCE
    assert packing.pack_documents(empty).count() == 0


@pytest.mark.parametrize("histogram", [{1: 10**9}, {2049: 3, 2047: 1, 5: 10_000}, {4096: 5}, {i: i * 7 % 13 + 1 for i in range(1, 4096)}])
def test_shortest_pack_first(histogram):
    patterns, placed = packing.shortest_pack_first(histogram), Counter()
    for pattern, count in patterns:
        assert sum(n * t for n, t in pattern) <= packing.SEQUENCE
        for n, t in pattern:
            placed[n] += t * count
    assert placed == histogram


def plain_prints(text):
    """(hash, position) by the plain definition, window by window."""
    import xxhash

    signed = lambda x: x - (1 << 64) if x >> 63 else x
    of = lambda t: xxhash.xxh64(t.encode(), seed=42).intdigest()
    pair = lambda a, b: xxhash.xxh64(b.to_bytes(8, "little"), seed=xxhash.xxh64(a.to_bytes(8, "little"), seed=42).intdigest()).intdigest()
    tokens = []
    for run in re.findall(r"[^\t\n\x0b\f\r ]+", text):
        tokens += [run] if len(run) <= 16 else [run[i : i + 16] for i in range(len(run))]
    if not text:
        return tokens, []
    h = [of(t) for t in tokens]
    if len(h) >= fingerprints.K:
        grams = [pair(pair(pair(h[i], h[i + 1]), pair(h[i + 2], h[i + 3])), h[i + 4]) for i in range(len(h) - 4)]
    else:
        grams = [of(" ".join(tokens) if tokens else text)]
    top = [signed(g >> 1) >> fingerprints.POSITION_BITS for g in grams]
    kept = []
    for i in range(max(len(top) - fingerprints.W, 0) + 1):
        window = range(i, min(i + fingerprints.W, len(top)))
        least = min(window, key=lambda j: (top[j], -j))
        if (top[least], least) not in kept[-1:]:
            kept.append((top[least], least))
    return tokens, kept


def test_fingerprints(spark, docs, empty):
    rows = {r["doc_id"]: r for r in fingerprints.fingerprint_documents(docs.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])).collect()}
    order = sorted((i, t or "") for i, t in dict(AWKWARD).items() if i)
    read = lambda prints: [(x >> fingerprints.POSITION_BITS, fingerprints._MASK - (x & fingerprints._MASK)) for x in prints]
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    for k, (i, t) in enumerate(order):
        after, q = order[(k + 1) % len(order)][1], len(t) // 4
        edited = t[: len(t) - q] + after[:q]
        own, changed, following = ([x for x in plain_prints(x)[1]] for x in (t, edited, after))
        assert rows[i]["n_chars"] == len(t) and rows[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert read(rows[i]["prints"]) == own and read(rows[i]["edited_prints"]) == changed
        sets = [{x for x, _ in found} for found in (own, changed, following)]
        assert math.isclose(rows[i]["near_edited"], like(sets[0], sets[1])) and math.isclose(rows[i]["near_next"], like(sets[0], sets[2]))
        if len(plain_prints(t)[0]) >= fingerprints.K + fingerprints.W - 1:
            at = sorted(p for _, p in read(rows[i]["prints"]))
            assert all(b - a <= fingerprints.W for a, b in zip(at, at[1:]))  # every window has one
    assert rows[8]["near_next"] > 0.9 and rows[2]["prints"] == []
    assert fingerprints.fingerprint_documents(empty).count() == 0


def test_fingerprints_of_text_without_spaces(spark):
    """A shared passage is found at any place in its run."""
    passage = "".join(chr(0x4E00 + i * 37 % 5000) for i in range(40))
    rows = [(i, "".join(chr(0x6000 + (i * 91 + j * 13) % 3000) for j in range(i)) + passage + "末" * 20) for i in range(17)]
    made = fingerprints.fingerprint_documents(spark.createDataFrame(rows, "doc_id bigint, text string"))
    sets = {r["doc_id"]: {x >> fingerprints.POSITION_BITS for x in r["prints"]} for r in made.collect()}
    assert all(sets[0] & sets[i] for i in sets)


def brute_components(rows, k):
    sets = {}
    for i, t in rows:
        w = words(t)
        sets[i] = frozenset(zip(*[w[j:] for j in range(k)])) if len(w) >= k else frozenset([tuple(w)]) if w else frozenset()
    label = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return {i: (len(sets[i]), label[i]) for i in sets}


def test_word_ids_equal_the_whole_texts_ids():
    """Words by themselves, with marks parted from letters, give the ids of the whole text; letters that turn into letter and sign too."""
    import random

    import pyarrow as pa
    import pyarrow.compute as pc

    def same_as_whole(texts):
        for made in ([texts], [[t] for t in texts]):
            for group in made:
                got = list(tokens.encode(pa.array(group, pa.string())))
                assert b"".join(ids.tobytes() for ids, _ in got) == b"".join(tokens.direct(t or "") for t in group), group
                assert [n for _, counts in got for n in counts] == [len(tokens.direct(t or "")) // 4 for t in group]

    tokens = packing.WordTokens(packing.default_tokenizer())
    same_as_whole(["Hello, world!! it's; don't!! x.. 12!? . !x", "\u0130, \u0130stanbul! Straße, é! \u0149. \ufb01n! \u0958, \u0958!! x²!", "ΑΣ. ΟΔΟΣ!! a|b | e\u0301\u0301, 日本。 日本!", "<|endoftext|> hi!", "", "a\x1cb c\x1fd", None, "ª º µ \u01c4, ĳ ŀ. A\u030aa ſt 's's \u2019s", "x" * 300])
    rng = random.Random(5)
    signs = [chr(c) for c in [*range(32, 0x250), *range(0x250, 0x2000, 3), *range(0x2000, 0xD000, 41), 0x1D400, 0x10400]]
    for _ in range(300):
        same_as_whole(["".join(rng.choice(signs if rng.random() < 0.5 else "abc .,!?'sÉé") for _ in range(rng.randint(1, 30))) for _ in range(3)])
    for c in range(0x250):
        assert c == 0x130 or pc.utf8_lower(pa.array([chr(c)]))[0].as_py() == chr(c).lower()


def test_packing_equals_plain_shortest_pack_first():
    """One piece at a time, longest first, into the shortest open pack that it fits: the same pack lengths, and little padding."""
    rng = np.random.default_rng(2)
    for pieces in (rng.integers(1, 4097, 500).tolist(), (rng.pareto(1.2, 3000) * 60 + 2).clip(2, 4096).astype(int).tolist(), [2048] * 7 + [1] * 50, [1500] * 9 + [1000] * 4):
        packs = []
        for n in sorted(pieces, reverse=True):
            packs.sort()
            if packs and packs[0] + n <= packing.SEQUENCE:
                packs[0] += n
            else:
                packs.append(n)
        got = Counter()
        for pattern, count in packing.shortest_pack_first(Counter(pieces)):
            got[sum(n * t for n, t in pattern)] += count
        assert got == Counter(packs)
        assert sum(got.values()) <= 1.5 * -(-sum(pieces) // packing.SEQUENCE) + 1


def test_nodes_that_stay_large_lose_no_links(spark):
    """With leaves of one member every node is large; each document is linked with its neighbours in a row only, not with the first."""
    rng = np.random.default_rng(9)
    rows, base = [], [f"s{i}" for i in range(100)]
    for c in range(12):
        rows.append((50 - c if c % 2 else c, " ".join(base)))
        for j in range(4):
            base[(7 * c + j) % 100] = f"new{c}_{j}"
    rows += [(200 + i, " ".join(rng.choice([f"z{i}" for i in range(50)], 30))) for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = brute_components(rows, 2)
    assert len({c for _, c in want.values()}) == 6
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_dedup(df, words=2, leaf=1, rounds=0).collect()}
    assert got == want


def test_nodes_that_fall_apart_lose_no_links(spark):
    """Pairs little above the threshold, in nodes that all count as large and come apart as they branch on."""
    rows = []
    for g in range(40):
        base = [f"p{g}_{i}" for i in range(101)]
        rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join([*base[:91], *(f"q{g}_{i}" for i in range(10))]))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = brute_components(rows, 2)
    assert len({c for _, c in want.values()}) == 40
    for rounds in (1, 3):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_dedup(df, words=2, leaf=1, rounds=rounds).collect()}
        assert got == want


@pytest.mark.parametrize("depth", [2, 4, 6])
def test_trees_hold_the_target(depth):
    """Pairs at the threshold, drawn: each value is shared by 80 of a hundred."""
    rng, n = np.random.default_rng(4), 40_000
    a = rng.integers(0, 1 << 32, (n, near_dedup.VALUES), dtype=np.uint32)
    b = np.where(rng.random(a.shape) < 0.8, a, rng.integers(0, 1 << 32, a.shape, dtype=np.uint32))
    met = np.zeros(n, bool)
    for root in near_dedup._roots(near_dedup.tree_count(depth, near_dedup.TARGET_RECALL)):
        start = np.full(n, root, np.uint64)
        paths = [set(zip(*(x.tolist() for x in near_dedup._branch_out(start, v, depth)))) for v in (a, b)]
        met[[row for row, _ in paths[0] & paths[1]]] = True
    near = near_dedup._estimate(a.astype(np.uint8), b.astype(np.uint8)) >= near_dedup._LEAST_ESTIMATE
    assert 1 - (met & near).mean() < 2 * (1 - near_dedup.TARGET_RECALL)


def test_pages_of_one_template_lose_no_links(spark):
    """Pairs little above the threshold among texts that share much: all others are little below it, and all are in nodes that count as large."""
    template, rows = [f"t{i}" for i in range(89)], []
    for g in range(60):
        own = [f"p{g}_{i}" for i in range(5)]
        rows += [(2 * g + c, " ".join([*template, *own, *(f"q{g}_{c}_{i}" for i in range(10))])) for c in range(2)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = brute_components(rows, 2)
    assert len({c for _, c in want.values()}) == 60
    for rounds in (0, 2):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_dedup(df, words=2, leaf=20, rounds=rounds).collect()}
        assert got == want


def test_near_dedup_equals_brute_force(spark, docs, empty):
    rng = np.random.default_rng(3)
    vocabulary = [f"v{i}" for i in range(400)]
    rows = [(i, t) for i, t in AWKWARD if i is not None]
    for g in range(12):
        base = rng.choice(vocabulary, 60).tolist()
        for c in range(6):
            copy = list(base)
            for j in rng.integers(0, 60, c):
                copy[j] = f"new{g}_{c}_{j}"
            rows.append((100 + 10 * g + c, " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    for k in (2, 5):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_dedup(df, words=k).collect()}
        assert got == brute_components(rows, k)
    assert near_dedup.near_dedup(empty).count() == 0


def test_language_model(spark, docs, empty):
    rows = [(1, "a b a b c"), (2, "A b  c a"), (3, ""), (4, "b c c a b"), (5, "z a b")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    train = df.filter("doc_id < 5")
    model = kneser_ney.train(train)
    got = {r["doc_id"]: r for r in kneser_ney.score_documents(df, model).collect()}
    counts = Counter(x for _, t in rows[:4] for x in [*words(t), None])
    n, v = sum(counts.values()), len(counts)
    for i, t in rows:
        tokens = [*words(t), None]
        assert (got[i]["n_tokens"], got[i]["n_known"], got[i]["train_tokens"]) == (len(tokens), sum(x in counts for x in tokens), n)
        assert math.isclose(got[i]["base_score"], sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in tokens), rel_tol=1e-9)
    # One-word texts, with the end after them: probabilities after a known context add up to one.
    every = spark.createDataFrame([(i, w) for i, w in enumerate(["a", "b", "c", "", "unknown"])], "doc_id bigint, text string")
    after = {r["doc_id"]: 10 ** r["score"] for r in kneser_ney.score_documents(every, model).collect()}
    assert after[3] < 1 and all(0 < p < 1 for p in after.values())
    pairs = Counter(p for _, t in rows[:4] for p in zip([None, *words(t)], [*words(t), None]))
    high = kneser_ney._discounts(*[sum(c == k for c in pairs.values()) for k in (1, 2, 3, 4)])
    follows = Counter(b for _, b in pairs)
    low = kneser_ney._discounts(*[sum(c == k for c in follows.values()) for k in (1, 2, 3, 4)])
    take = lambda d, c: d[min(c, 3) - 1] if c else 0.0
    rest = sum(take(low, c) for c in follows.values()) / len(pairs)

    def p(a, b):
        lower = max(follows[b] - take(low, follows[b]), 0) / len(pairs) + rest / (v + 1)
        if a not in counts:
            return lower
        own = [c for (x, _), c in pairs.items() if x == a]
        return (max(pairs[a, b] - take(high, pairs[a, b]), 0) + sum(take(high, c) for c in own) * lower) / sum(own)

    assert math.isclose(sum(p("a", b) for b in [*counts, "?"]), 1, rel_tol=1e-9)
    for i, t in rows:
        stream = [None, *words(t), None]
        assert math.isclose(got[i]["score"], sum(math.log10(p(a, b)) for a, b in zip(stream, stream[1:])), rel_tol=1e-6)
    none = kneser_ney.train(empty)
    assert none.tokens == 0 and kneser_ney.score_documents(docs, none).count() == len(AWKWARD)


def test_language_id(spark, sf, docs, empty):
    from pyspark.sql import functions as F

    rows = language_id.op10_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id").filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()
    assert rows[0] > 0.95
    trees = language_id.fit(docs)
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.predict(docs, trees).collect()}
    assert got[1] == got[2] == got[3] == "und" and got[13] == "en"
    assert language_id.keep_known(docs, trees).columns == docs.columns
    assert {r["lang_pred"] for r in language_id.predict(docs, language_id.fit(empty)).collect()} == {"und"}
    # A node's probabilities add up to one over all bytes.
    seen = len(set(trees.classes[:256])) - int((trees.classes[:256] == trees.classes.max() - 1).any())
    k = int(trees.classes.max()) + 1
    weight = np.ones(k)
    weight[k - 2], weight[k - 1] = 256 - (k - 2), 0
    assert seen >= 1 and np.allclose((np.exp2(-trees.bits[:, :, 0].astype(float)) * weight).sum(1), 1, atol=1e-3)


def test_toxicity(spark, docs, empty):
    rows = [(i, f"some plain words here {i} and more") for i in range(40)] + [(100 + i, f"you are a vilest{i} fool {i}") for i in range(12)]
    labels = spark.createDataFrame([(i, int(i >= 100)) for i, _ in rows], "doc_id bigint, toxic int")
    train = spark.createDataFrame(rows, "doc_id bigint, text string")
    lexicon = toxicity.learn(train, labels)
    more = spark.createDataFrame([(1, "such a f00l"), (2, "plain words"), (3, None), (4, "VILESTxyz"), (5, "fооl")], "doc_id bigint, text string")
    assert {r["doc_id"]: r["predicted"] for r in toxicity.score_documents(more, lexicon).collect()} == {1: 1, 2: 0, 3: 0, 4: 1, 5: 1}
    harmless = toxicity.Matcher(toxicity.Lexicon({" fooi ": 4.0}, ["fool proof"]))
    assert harmless.hits(toxicity.fold("fool proof")) == {} and harmless.hits(toxicity.fold("a fool")) != {}
    assert toxicity.drop_toxic(docs, lexicon).columns == docs.columns
    assert {r["predicted"] for r in toxicity.score_documents(docs, toxicity.learn(empty, labels)).collect()} <= {0, 1}


def test_html(spark):
    page = '<html><head><title>x</title></head><body><nav><a>Menu</a></nav><div class="ad">Buy</div><article><h1>A &amp; B</h1><p><b>One\n two<br>three.<p>Four<script>var t="</p>";</script> five</p><div class="comments"><p>no</p></div></article><footer>&copy;</footer>'
    blocks = [f'<html><body><div class=box><p>Same line</p></div><main><p>Text {i}</p><p>Other {i}</p></main></body></html>' for i in range(20)]
    bare = [f"<div><span>Always</span><div class=x>Body number {i}</div></div>" for i in range(20)]
    rows = [(1, "http://one.example/a", page), (2, None, None), (3, "::bad", ""), (4, "http://[bad", "plain < text")]
    rows += [(10 + i, "http://two.example/", b) for i, b in enumerate(blocks)] + [(50 + i, "http://three.example/", b) for i, b in enumerate(bare)]
    got = {r["page_id"]: r["text"] for r in html_extract.extract_pages(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got[1] == "A & B\n\nOne two three.\n\nFour five" and got[2] == got[3] == "" and got[4] == "plain < text"
    assert got[12] == "Text 2\n\nOther 2" and got[53] == "Body number 3"


def site(i, more=""):
    return f"<html><body><div class=box><p>Same a</p><p>Same b</p><p>Same c</p>{more}</div><div class=text><p>Text {i} of this page</p><p>Other {i}</p></div></body></html>"


def test_html_copies_are_one_page(spark):
    rows = [(1, "http://one.example/a", site(1)), (2, "http://one.example/a?utm_source=x", site(1)), (3, "http://one.example/a#top", site(1))]
    rows += [(10 + i, f"http://two.example/{i}", f"<body><article><p>Text {max(i, 7)}</p><p>Other {max(i, 7)}</p></article></body>") for i in range(10)]
    rows += [(100 + i, f"http://three.example/{i}", site(i // 3, "<p>Only here</p>" if i // 3 == 4 else "")) for i in range(60)]
    got = {r["page_id"]: r["text"] for r in html_extract.extract_pages(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    # What all pages of another host have is no content here either; a branch goes whole.
    assert got[1] == got[2] == got[3] == "Text 1 of this page\n\nOther 1"
    assert all(got[10 + i] == f"Text {max(i, 7)}\n\nOther {max(i, 7)}" for i in range(10))
    assert all(got[100 + i] == f"Text {i // 3} of this page\n\nOther {i // 3}" for i in range(60))


def test_html_joins_equal_broadcast(spark, monkeypatch):
    """Hosts that Java's URI refuses or does not name."""
    hosts = ["http://a_b.example/{}", "http://büro.example/{}", "http://c.example/x y|{}", "http://D.example/{{{}}}", "::bad{}", "http://[bad{}"]
    rows = [(100 * h + i, host.format(i), site(i).replace("Same", f"Same {h}")) for h, host in enumerate(hosts) for i in range(20)] + [(1000, None, None), (1000, None, None)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    read = lambda: sorted((r["page_id"], r["url"] or "", r["text"], r["n_chars"]) for r in html_extract.extract_pages(df).collect())
    sent = read()
    monkeypatch.setattr(html_extract, "BROADCAST_BYTES", 0)
    assert read() == sent
    texts = {i: t for i, _, t, _ in sent}
    assert len(sent) == len(rows) and texts[3] == texts[103] == texts[203] == texts[303] == "Text 3 of this page\n\nOther 3"


def test_quality_equals_plain_resampling(spark):
    """Log ratios, noise and the draw, recomputed row by row; n-grams meet their buckets through the operator's own hash of words."""
    import pyarrow as pa
    import xxhash

    rng = np.random.default_rng(8)
    rows = [(i, " ".join(rng.choice([f"w{j}" for j in range(30 if i % 3 else 90)], rng.integers(0, 40)))) for i in range(200)] + [(900, None), (901, ""), (902, "one")]
    target = rows[:60:2]

    def buckets(text):
        (_, _, values, _), = quality._row_buckets(pa.array([text], pa.string()))
        own = values.tolist()
        n = len(words(text))
        assert len(own) == max(2 * n - 1, 0)
        return Counter(own)

    def model(texts):
        total = sum((buckets(t) for _, t in texts), Counter())
        return lambda b: math.log((total[b] + 1) / (sum(total.values()) + quality.BUCKETS))

    good, raw = model(target), model(rows)
    want = {i: sum(n * (good(b) - raw(b)) for b, n in buckets(t).items()) for i, t in rows}
    hashed = lambda i: xxhash.xxh64(quality.SEED.to_bytes(4, "little"), seed=xxhash.xxh64(i.to_bytes(8, "little"), seed=42).intdigest()).intdigest()
    keys = {i: w - math.log(-math.log(((hashed(i) >> 11) + 0.5) / (1 << 53))) for i, w in want.items()}
    first = sorted(keys, key=lambda i: (-keys[i], i))[:50]
    df = lambda part: spark.createDataFrame(part, "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in quality.resample(df(rows), df(target), 50 / len(rows)).collect()}
    assert all(math.isclose(got[i]["log_ratio"], want[i], abs_tol=1e-9) and math.isclose(got[i]["gumbel_key"], keys[i], abs_tol=1e-9) for i in want)
    assert {i for i in got if got[i]["kept"]} == set(first)


def test_quality(spark, docs, empty):
    good = [(i, "plain clean words in a row again") for i in range(50)]
    raw = spark.createDataFrame(good + [(100 + i, "%% $$ junk !! %% $$ junk !! " * 3) for i in range(10)], "doc_id bigint, text string")
    got = quality.resample(raw, spark.createDataFrame(good, "doc_id bigint, text string"), 50 / 60).collect()
    assert sum(r["kept"] for r in got) == 50 and all(r["kept"] for r in got if r["doc_id"] < 100)
    assert sum(r["kept"] for r in quality.resample(docs, docs, 0.5).collect()) in (8, 9)
    assert quality.resample(empty, empty, 0.5).count() == 0


def test_html_markup_marks_nothing_by_halves(spark):
    """Names that only contain a noise word, headers of an article, formulas, and layout around an article stay."""
    keep = [
        '<article><div class="entry-header"><h1>T</h1></div><p>Body</p></article>', '<article><div class="share-price"><p>T</p></div><p>Body</p></article>', '<div class="content with-sidebar"><article><p>T</p><p>Body</p></article></div>',
        '<article><header><h1>T</h1></header><p>Body</p></article>', '<div id="page-header-main"><article><p>T</p><p>Body</p></article></div>', '<article><p>T</p><div class="related-posts"><p>x</p></div><p>Body</p><div class="social share"><p>y</p></div></article>',
    ]
    for page in keep:
        assert html_extract.extract(page, set()) == "T\n\nBody", page
    assert html_extract.extract("<article><p>Let <math><mi>x</mi></math> be 1</p></article>", set()) == "Let x be 1"
    assert html_extract.extract('<div class="site-footer">a</div><div class="ad-slot">b</div><div class="cookie-notice">c</div><p>d</p>', set()) == "d"


@pytest.mark.parametrize("part", ["<button>", "<svg>", "<div>", "<li>", "</div>", "<p>x", "<td>", "<object><object></object>", "</p><b>", "<ul><div>"])
def test_html_takes_linear_time(part):
    import time

    page = "<p>first</p>" + part * (1_000_000 // len(part)) + "<p>last</p>"
    start = time.process_time()
    blocks, _ = html_extract.blocks_of(page)
    assert time.process_time() - start < 8 and blocks[0][4] == "first"


def test_html_repeated_empty_and_long(spark):
    schema = "page_id bigint, url string, html string, text string, n_chars string, host string, path string, feature string"
    long = "<body>" + "".join(f"<p>paragraph {i}</p>" for i in range(60_000)) + "</body>"
    df = spark.createDataFrame([(1, "http://a.example/", long, "t", "n", "h", "p", "f")] * 2 + [(None, None, None, None, None, None, None, None)], schema)
    rows = html_extract.extract_pages(df).collect()
    assert sorted((r["page_id"] or 0, r["text"].count("\n\n")) for r in rows) == [(0, 0), (1, 59_999), (1, 59_999)]
    assert html_extract.extract_pages(df.limit(0)).count() == 0


def test_content_features_hold_every_word():
    """A change of any word of a block, however long, changes its features; what is not near the change stays."""
    for n in (1, 2, 5, 17, 60, 400):
        words = [f"w{i * i % 1009}" for i in range(n)]
        own = html_extract.content_features(" ".join(words))
        for i in range(n):
            other = html_extract.content_features(" ".join([*words[:i], "changed", *words[i + 1 :]]))
            assert set(own) != set(other) and (n < 60 or set(own) & set(other))


def test_style_tree_equals_brute_force(spark):
    """Content, layout and importance of every node of two hosts, recomputed page by page."""
    rng = np.random.default_rng(5)
    made = lambda i: f"<body><div class=a><p>{rng.choice(['one', 'two', f'own {i}'])}</p></div><div class=b><p>always</p>{'<ul>' + '<li>x</li>' * (i % 3) + '</ul>' if i % 4 else ''}</div><p>the long text of page {i // 2} of them all</p></body>"
    rows = [(f"http://{h}.example/", made(i)) for h in ("h", "g") for i in range(17)]
    df = spark.createDataFrame([(i, u, p) for i, (u, p) in enumerate([*rows, *rows[:4]])], "page_id bigint, url string, html string")
    got = {(r["host"], r["path"]): (r["content"], r["layout"], r["importance"]) for r in html_extract.style_tree(html_extract.page_features(df)).collect()}
    spread, own, counts, shapes, above = defaultdict(set), defaultdict(list), defaultdict(set), defaultdict(set), {}
    for url, page in [*rows, *rows[:4]]:
        host = html_extract.host_of(url)
        blocks, nodes = html_extract.blocks_of(page)
        sign = html_extract.page_sign(blocks)
        for path, parent, _, _, text in blocks:
            above[host, path] = parent
            for f in html_extract.content_features(text):
                spread[f].add(sign)
                own[host, path].append(f)
        for path, n in Counter(b[0] for b in blocks).items():
            counts[host, path].add((n, sign))
        for path, children in nodes:
            shapes[host, path].add((children, sign))

    def diversity(seen):
        n = Counter(x for x, _ in seen)
        total = sum(n.values())
        return sum(-c / total * math.log(c / total) for c in n.values()) / math.log(total) if total > 1 else 0.0

    assert set(got) == set(own) and any(above.values())
    for (host, path), features in own.items():
        everywhere = [f for (_, p), fs in own.items() if p == path for f in fs]
        alone = lambda fs: sum(len(spread[f]) == 1 for f in fs)
        content = (alone(features) + html_extract.PRIOR * alone(everywhere) / len(everywhere)) / (len(features) + html_extract.PRIOR)
        layout = max(diversity(counts[host, path]), diversity(shapes[host, above[host, path]]) if above[host, path] else 0.0)
        assert np.allclose(got[host, path], (content, layout, 0.75 * content + 0.25 * layout))


def test_style_tree_without_markup(spark):
    """On all pages, with no name of an element, class or role counting: what markup says is noise goes, what stands in articles stays."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    low = defaultdict(set)
    for r in html_extract.low_nodes(html_extract.page_features(pages)).collect():
        low[r["host"]].add(r["path"])
    assert low
    noise, content = Counter(), Counter()
    for r in pages.collect():
        gone = low[html_extract.host_of(r["url"])]
        for path, _, article, marked, _ in html_extract.blocks_of(r["html"])[0]:
            (noise if marked else content)[path in gone] += 1
    assert noise[True] >= 0.9 * noise.total() and content[False] >= 0.99 * content.total(), (noise, content)


def test_language_needs_a_letter(docs):
    trees = language_id.fit(docs)
    rows = docs.sparkSession.createDataFrame([(1, "½"), (2, "②③"), (3, "12 Ⅷ _"), (4, "a½"), (5, "語")], "doc_id bigint, text string")
    assert {r["doc_id"] for r in language_id.predict(rows, trees).collect() if r["lang_pred"] == "und"} == {1, 2, 3}


def test_code_lengths_equal_plain_matching(spark):
    """Escape method D with exclusion, byte by byte, for two small languages; ties go to the first name."""
    train = [(i, t, lang) for i, (t, lang) in enumerate([("abababac abab", "x")] * 9 + [("bbcbbc bcb", "y")] * 9)]
    trees = language_id.fit(spark.createDataFrame(train, "doc_id bigint, text string, lang string"))

    def length(text, lang):
        counts = defaultdict(Counter)
        for _, t, own in train:
            s = [256] * 3 + list(t.encode())
            for j in range(3, len(s)):
                for d in range(4):
                    counts[own, tuple(s[j - d : j])][s[j]] += 1

        def dist(context):
            below = dist(context[1:]) if context else {b: 1 / 256 for b in range(256)}
            own = counts.get((lang, context), {})
            n, q = sum(own.values()), len(own)
            if n < (language_id.LEAST_SEEN if context else 1):
                return below
            rest = sum(v for b, v in below.items() if b not in own)
            return {b: (2 * own[b] - 1) / (2 * n) if b in own else q / (2 * n) * below[b] / rest for b in range(256)}

        s = [256] * 3 + list(text.encode())
        return sum(-math.log2(dist(tuple(s[j - 3 : j]))[s[j]]) for j in range(3, len(s)))

    import pyarrow as pa

    texts = ["abab", "bcb cbb", "zz", "abé", ""]
    got = trees.lengths(pa.array(texts))
    for t, row in zip(texts, got):
        assert np.allclose(row, [length(t, "x"), length(t, "y")], rtol=1e-4, atol=1e-4), t
    same_trees = language_id.fit(spark.createDataFrame([(i, "abc abc", lang) for i, lang in enumerate("yxyxyxyx")], "doc_id bigint, text string, lang string"))
    assert {r["lang_pred"] for r in language_id.predict(spark.createDataFrame([(1, "abc")], "doc_id bigint, text string"), same_trees).collect()} == {"x"}


def test_word_hashes_take_little_memory_beside_the_text():
    import tracemalloc

    import pyarrow as pa

    from homerank.llm.word_hashes import blocks

    texts = pa.array([f"word{i} and so on " * 500 for i in range(500)])
    list(blocks(texts.slice(0, 5)))
    tracemalloc.start()
    try:
        for _ in blocks(texts):
            pass
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert most < 30e6
