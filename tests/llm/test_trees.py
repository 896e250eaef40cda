"""Conversation tries and Merkle manifests against brute force and SQL."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

pytest.importorskip("homerank.llm")
from compare import connect, same  # noqa: E402

from homerank.llm import merkle, prefix_trie, ranking  # noqa: E402

TURNS = "conv_id bigint, turn bigint, role string, text string, depth string, a bigint"


def sha(data):
    return hashlib.sha256(data.encode()).hexdigest()


def brute_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, hashlib.md5(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).digest(), (role or "", text or "")))
    said = {c: [x[-1] for x in sorted(v)] for c, v in own.items()}
    members = defaultdict(list)
    for c in sorted(said):
        h = zlib.crc32(str(c).encode()) % 9
        whole = said.get(c - c % 5, [])[:h] + said[c][h:]
        for d in range(len(whole) + 1):
            members[tuple(whole[:d])].append((c, d == len(whole)))
    children, out = defaultdict(list), {}
    for node in members:
        if node:
            children[node[:-1]].append(node)
    for node in sorted(members, key=len, reverse=True):
        last = len(node[-1][1].encode()) if node else 0
        leaves = sum(out[k][3] for k in children[node]) if children[node] else 1
        saved = (len(members[node]) - 1) * last + sum(out[k][4] for k in children[node])
        ends = ",".join(str(c) for c, end in members[node] if end)
        parent = members[node[:-1]][0][0] if node else None
        out[node] = (members[node][0][0], len(node), parent, leaves, saved, len(members[node]), len(children[node]), sha(ends))
    return sorted(((x[0], x[1], x[2], x[5], x[6], x[3], x[4], x[7]) for x in out.values()), key=repr)


def spark_trie(spark, rows, block=prefix_trie.BLOCK):
    table = spark.createDataFrame([(*r, "clash", 1) for r in rows], TURNS)
    return sorted((tuple(r) for r in prefix_trie.conversation_trie(table, block).collect()), key=repr)


def test_trie_query(spark, sf):
    assert same(prefix_trie.op11_prefix_trie(spark, sf), connect(sf), prefix_trie.ORACLE_SQL) == ""
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted((tuple(r) for r in prefix_trie.op11_prefix_trie(spark, sf).collect()), key=repr) == brute_trie(rows)


def test_awkward_conversations(spark):
    rnd = random.Random(5)
    rows = [(0, i, "user", "x") for i in range(70)] + [(1, i, "user", f"{i % 3}") for i in range(40)]  # chains
    rows += [(7, 3, "user", "no base"), (8, 0, None, None), (None, 1, "user", "lost"), (25, None, "user", "null first"), (25, 0, "user", "then"), (25, 0, "user", "then"), (25, 0, "b", "tie")]
    rows += [(c, t, rnd.choice(["user", "bot"]), rnd.choice(["a", "b", "é"])) for c in range(100, 160) for t in range(rnd.randint(1, 14))]
    rows += [(c, t, "user", "same") for c in range(3000, 3040, 5) for t in range(5)]  # copies, in more than one block of ids
    rnd.shuffle(rows)
    assert spark_trie(spark, rows, block=4) == brute_trie(rows)


def test_no_conversations(spark):
    assert spark_trie(spark, []) == []


def test_rank(spark):
    rnd = random.Random(2)
    rows = [("hot" if rnd.random() < 0.7 else f"k{rnd.randint(0, 9)}", rnd.choice([None, 1, 2, rnd.randint(0, 999)])) for _ in range(3000)] + [("hot", 5)] * 2000
    table = spark.createDataFrame(rows, "k string, v int").repartition(7)
    got = defaultdict(list)
    from pyspark.sql import functions as F

    for r in ranking.ranked(table, "k", [F.col("v").asc_nulls_first()], "rank").collect():
        got[r["k"]].append((r["index"], r["v"]))
    for k, own in got.items():
        assert [i for i, _ in sorted(own)] == list(range(len(own)))
        assert [v for _, v in sorted(own)] == sorted((v for key, v in rows if key == k), key=lambda v: (v is not None, v or 0))
    assert sum(map(len, got.values())) == len(rows)


def enc(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def brute_merkle(rows):
    """Rows (doc_id, source, lang, n_chars, text) -> per document the contract's columns."""

    def grow(level):
        levels = [level]
        while len(levels[-1]) > 1:
            levels.append([sha("".join(levels[-1][i : i + 3])) for i in range(0, len(levels[-1]), 3)])
        return levels

    trees = defaultdict(list)
    for r in rows:
        even = zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 2 == 0
        claim = (*r[:4], r[4].replace("\n", "") if even and r[4] is not None else r[4])
        trees[r[1]].append((r[0] is not None, r[0] or 0, sha("".join(map(enc, r))), sha("".join(map(enc, claim))), r[0]))
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    levels = {s: grow([x[2] for x in sorted(trees[s])]) for s in names}
    top = grow([levels[s][-1][0] for s in names])
    out = []
    for at, s in enumerate(names):
        for i, (_, _, leaf, claim, doc_id) in enumerate(sorted(trees[s])):
            proof, folded = "", claim
            for rows_of, place in ((levels[s], i), (top, at)):
                for level in rows_of[:-1]:
                    run = level[place - place % 3 : place - place % 3 + 3]
                    proof += "".join(run[: place % 3] + run[place % 3 + 1 :])
                    folded, place = sha("".join(run[: place % 3] + [folded] + run[place % 3 + 1 :])), place // 3
            out.append((doc_id, leaf, levels[s][-1][0], top[-1][0], sha(proof), folded, folded == top[-1][0]))
    return sorted(out, key=repr)


DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, tree string, leaf string"


def test_merkle_query(spark, sf):
    assert same(merkle.op12_merkle(spark, sf), connect(sf), merkle.ORACLE_SQL) == ""


def test_awkward_documents(spark, tmp_path):
    rows = [(i, "hot", "en", i % 5, f"t{i}\n" if i % 3 else "t") for i in range(1500)]  # three blocks, the last one short
    rows += [(i, f"own{i}", None, None, "") for i in range(2000, 2040)] + [(3000, None, "en", 1, "a\nb"), (3001, None, None, None, None), (None, None, "x", 2, "n\n"), (3000, None, "en", 1, "a\nb")]
    rows += [(4000, "", "en", 2, "empty source"), (4001, "é\n", "en", 2, "x" * 100_000)]
    table = spark.createDataFrame([(i, t, l, s, n, "clash", "clash") for i, s, l, n, t in rows], DOCS)
    table.write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((tuple(r) for r in merkle.op12_merkle(spark, str(tmp_path)).collect()), key=repr)
    assert got == brute_merkle(rows)
    # Proofs of some leaves only, which fetch their neighbours too, are the same proofs.
    wanted = spark.createDataFrame([(i,) for i in (0, 1, 2, 700, 1499, 2003, 3000, 4001, 9999)], "doc_id bigint")
    some = merkle.manifest(table).multiproofs(wanted, with_siblings=True).collect()
    whole = {r[0]: r for r in got}
    assert sorted(r["doc_id"] for r in some) == [0, 1, 2, 700, 1499, 2003, 3000, 3000, 4001]
    for r in some:
        assert r["verified"] and r["proof_sha256"] == sha(r["siblings"]) and (r["doc_id"] == 3000 or r["proof_sha256"] == whole[r["doc_id"]][4])


def test_octopus_asks_for_least():
    for n in (1, 2, 3, 4, 26, 27, 28, 100):
        levels = [[str(i) for i in range(n)]]
        while len(levels[-1]) > 1:
            levels.append([merkle.parent(levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
        rnd = random.Random(n)
        for wanted in ([0], [n - 1], range(n), rnd.sample(range(n), -(-n // 3))):
            asked = merkle.missing(wanted, n)
            assert len(asked) == len(set(asked)) and (len(set(wanted)) < n or not asked)
            paths = merkle.Paths({i: levels[0][i] for i in wanted}, {(k, i): levels[k][i] for k, i in asked}, n)
            assert paths.root == levels[-1][0] and all(paths.fold(i, levels[0][i]) == paths.root for i in wanted)
            # No asked node follows from the wanted ones and the other asked ones.
            for k, i in asked:
                assert not {j for j in wanted if j // 3**k == i}


def test_no_documents(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    empty = merkle.op12_merkle(spark, str(tmp_path))
    assert empty.count() == 0 and empty.columns == [f.split()[0] for f in merkle.PROOFS.split(", ")]
