"""MinHash near-dedup: a Chosen Path similarity join over shingle sets, links confirmed on the full sets, and components."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, fits_broadcast, materialize, small_batches
from .word_hashes import blocks, mix64

#: Least similarity in hundredths.
LEAST = 80
#: MinHash values of a set; one byte of each is sent along for estimates.
VALUES = 64
#: Share of linked pairs that meet in some tree.
TARGET_RECALL = 0.9995
#: Nodes up to this size, also by the bytes of their sets, are compared exhaustively; larger ones branch on.
LEAF = 4_000
LEAF_BYTES = 100 << 20
#: Levels by which a large node branches on at once, and how often, before what stays open in it is compared block by block.
DEEPER, ROUNDS = 2, 1
#: One node in so many branches by two values, the others by one: 1.25 on average, the inverse of the threshold, so a pair at
#: the threshold goes on in one child on average at every level and is not thinned out as one branch a node would thin it.
TWO_IN = 4
#: Members of the blocks by which large nodes are compared, in leaves: each row is sent once for every block of the others.
BLOCK_LEAVES = 5
#: Pairs whose estimate lies this many standard deviations below the threshold are still confirmed on the full sets.
DEVIATIONS = 4.0
SEED = 77
_U = np.uint64
_MULTIPLIERS = mix64(np.arange(1, VALUES + 1, dtype=np.uint64) * _U(0xA0761D6478BD642F)) | _U(1)


def shingle_sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The distinct k-word shingles of each text as sorted hashes; of a shorter text its whole sequence; none without words."""
    for _, _, hashes, counts in blocks(texts):
        with np.errstate(over="ignore"):
            grams = hashes.copy()
            for j in range(1, k):
                grams[: len(hashes) - j] = mix64(grams[: len(hashes) - j] * _U(3) + hashes[j:]) if len(hashes) > j else grams[:0]
        at = 0
        for n in counts.tolist():
            if n >= k:
                yield np.unique(grams[at : at + n - k + 1])
            elif n:
                whole = mix64(hashes[at : at + 1])
                for x in hashes[at + 1 : at + n]:
                    whole = mix64(whole * _U(5) + x)
                yield whole
            else:
                yield hashes[:0]
            at += n


def _minhash(items: np.ndarray) -> np.ndarray:
    """VALUES minima as 32-bit integers."""
    least = np.full(VALUES, 0xFFFFFFFFFFFFFFFF, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(0, len(items), 8192):
            least = np.minimum(least, (items[i : i + 8192, None] * _MULTIPLIERS).min(0))
    return (mix64(least) >> _U(32)).astype(np.uint32)


def _sets(docs: DataFrame, id_col: str, text_col: str, k: int, what: str) -> DataFrame:
    """doc_id, n_shingles, set_key and either the MinHash values or the whole set."""
    id_type = docs.select(id_col).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, keys, last = [], [], []
            for items in shingle_sets(batch.column(1), k):
                sizes.append(len(items))
                keys.append(xxhash.xxh3_128_digest(items.tobytes()))
                last.append((_minhash(items) if what == "values" else items).tobytes() if len(items) else b"")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(last, pa.binary())], ["doc_id", "n_shingles", "set_key", what])

    return small_batches(docs).select(id_col, text_col).mapInArrow(run, f"doc_id {id_type}, n_shingles bigint, set_key binary, {what} binary")


def _branch_out(node: np.ndarray, values: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, node) of all paths `levels` down from each row's node: the node itself draws by which minwise tokens its members branch."""
    rows = np.arange(len(node))
    for _ in range(levels):
        draw = mix64(node + _U(SEED))
        first = (draw % _U(VALUES)).astype(np.int64)
        more = mix64(draw)
        two = np.flatnonzero((more >> _U(40)) % _U(TWO_IN) == 0)
        second = (first[two] + 1 + (more[two] % _U(VALUES - 1)).astype(np.int64)) % VALUES
        rows, node, chosen = np.concatenate([rows, rows[two]]), np.concatenate([node, node[two]]), np.concatenate([first, second])
        node = mix64(node ^ mix64((values[rows, chosen].astype(np.uint64) << _U(8)) + chosen.astype(np.uint64)))
    return rows, node


def _roots(trees: int) -> np.ndarray:
    return mix64(np.arange(1, trees + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15) + _U(SEED))


def _node_rows(classes: DataFrame, trees: int, depth: int) -> DataFrame:
    """node, rep, n_shingles for each class and each of its paths in each tree, `depth` levels below the root."""
    roots = _roots(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint32).reshape(-1, VALUES)
            for root in roots:
                rows, node = _branch_out(np.full(len(values), root, np.uint64), values, depth)
                at = pa.array(rows)
                yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), batch.column(0).take(at), batch.column(1).take(at)], ["node", "rep", "n_shingles"])

    return classes.select("rep", "n_shingles", "values").mapInArrow(run, _NODE_ROW)


_NODE_ROW = "node bigint, rep bigint, n_shingles bigint"


def _branch(rows: DataFrame, levels: int) -> DataFrame:
    """The rows of _node_rows some levels further down; they come with their values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint32).reshape(-1, VALUES)
            at, node = _branch_out(batch.column(0).to_numpy().view(np.uint64), values, levels)
            take = pa.array(at)
            yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), batch.column(1).take(take), batch.column(2).take(take)], ["node", "rep", "n_shingles"])

    return rows.select("node", "rep", "n_shingles", "values").mapInArrow(run, _NODE_ROW)


def chosen_path_nodes(classes: DataFrame, trees: int, depth: int, leaf: int = LEAF, leaf_bytes: int = LEAF_BYTES, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame | None]:
    """(node, rep) of all small nodes with two members or more, and (node, rep, n_shingles, n, bytes) of those that are larger at
    `depth`, n and bytes being the node's. Of nodes with the same members, which a group of near copies makes in every tree, one is kept.

    The first `depth` levels are taken at once, as nodes above are large. Large nodes branch on, which finds many of their links early but
    parts some of their pairs; so each is returned as a whole too.

    Node sizes come from a map-side aggregation, so a node with a third of all rows is no hot group; the sizes are written
    and joined back on the node, which adaptive execution splits where a node is hot.
    """
    level, small, large = _node_rows(classes, trees, depth), None, None
    fits = (F.col("n") <= leaf) & (F.col("bytes") <= leaf_bytes)
    for at in range(rounds + 1):
        sizes = level.groupBy("node").agg(F.count(F.lit(1)).alias("n"), (8 * F.sum("n_shingles")).alias("bytes"), F.bit_xor(F.xxhash64("rep")).alias("members"))
        sizes = materialize(sizes.filter("n > 1"), "node-sizes")
        own = materialize(sizes.filter(~fits).groupBy("n", "bytes", "members").agg(F.min("node").alias("node")), "node-large")
        members = materialize(level.join(sizes.filter(fits).select("node", "n", "bytes").unionByName(own.select("node", "n", "bytes")), "node"), "node-members")
        part = members.filter(fits).select("node", "rep")
        small = part if small is None else small.unionByName(part)
        last = members.filter(~fits)
        if own.isEmpty():
            break
        large = last.select("node", "rep", "n_shingles", "n", "bytes") if large is None else large
        if at < rounds:
            level = _branch(last.join(classes.select("rep", "values"), "rep"), DEEPER)
    return small, large


def _estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity from one byte of each MinHash value."""
    same = np.count_nonzero(a == b, axis=-1) / VALUES
    return (same - 1 / 256) / (1 - 1 / 256)


#: Estimates from here on are confirmed.
_LEAST_ESTIMATE = LEAST / 100 - DEVIATIONS * math.sqrt(LEAST / 100 * (1 - LEAST / 100) / VALUES)


def tree_count(depth: int, target_recall: float) -> int:
    """So many trees that a pair at the threshold meets in one, and is estimated near enough, with the target recall.

    All trees branch by the same VALUES minima, so the share of them that a pair has in common, not the pair's similarity, is
    what each branch keeps it together with: the recall is the mean over that share, which is binomial.
    """
    likely = [math.comb(VALUES, m) * (LEAST / 100) ** m * (1 - LEAST / 100) ** (VALUES - m) for m in range(VALUES + 1)]
    near = [m for m in range(1, VALUES + 1) if (m / VALUES - 1 / 256) / (1 - 1 / 256) >= _LEAST_ESTIMATE]
    if sum(likely[m] for m in near) <= target_recall:
        raise ValueError(f"{VALUES} MinHash values cannot give a recall of {target_recall}")
    trees = 1
    met = {m: _survival(m / VALUES, depth) for m in near}
    while sum(likely[m] * (1 - (1 - met[m]) ** trees) for m in near) < target_recall:
        trees += 1
    return trees


def _survival(shared: float, depth: int) -> float:
    """How likely a pair with that share of values in common is together in some node of one tree, `depth` levels down."""
    alive = 1.0
    for _ in range(depth):
        lost = 1 - shared * alive
        alive = 1 - (lost * (TWO_IN - 1) + lost * lost) / TWO_IN
    return alive


class _Forest:
    """Union-find over small integers."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def roots(self) -> np.ndarray:
        return np.array([self.root(x) for x in range(len(self.up))])


class _Node:
    """Members of one node, to be compared exhaustively."""

    def __init__(self, table: pa.Table):
        self.n = len(table)
        self.rep, self.sizes, self.node = table.column("rep").to_numpy(), table.column("n_shingles").to_numpy(), table.column("node")[0].as_py()
        self.sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(-1, VALUES)
        # The small nodes of each member that come before this one by id.
        homes = [h.values.to_numpy() for h in table.column("homes")]
        self.before = [h[h < self.node] for h in homes]

    def candidates(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Later members that i must be compared with here, by size and estimate, and the estimates: those it meets in no node with a lesser id."""
        sizes = self.sizes[i + 1 :]
        j = np.flatnonzero(np.minimum(self.sizes[i], sizes) * 100 >= LEAST * np.maximum(self.sizes[i], sizes)) + i + 1
        estimate = _estimate(self.sketch[j], self.sketch[i])
        j, estimate = j[estimate >= _LEAST_ESTIMATE], estimate[estimate >= _LEAST_ESTIMATE]
        if len(j) and len(self.before[i]):
            counts = np.array([len(self.before[x]) for x in j])
            if counts.any():
                shared = np.isin(np.concatenate([self.before[x] for x in j]), self.before[i])
                new = np.bincount(np.repeat(np.arange(len(j)), counts), shared, len(j)) == 0
                j, estimate = j[new], estimate[new]
        return j, estimate

    def involved(self) -> np.ndarray:
        some = np.zeros(self.n, bool)
        for i in range(self.n - 1):
            j, _ = self.candidates(i)
            if len(j):
                some[i] = True
                some[j] = True
        return some

    def links(self, items: list[np.ndarray]) -> list[tuple[int, int]]:
        """Confirmed links that join what is linked here: candidates go nearest first, those joined already are passed over."""
        found = [(np.full(len(j), i, np.int32), j.astype(np.int32), e.astype(np.float32)) for i in range(self.n - 1) for j, e in [self.candidates(i)] if len(j)]
        if not found:
            return []
        a, b, estimate = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(-estimate, kind="stable")
        a, b = a[order], b[order]
        forest, out = _Forest(self.n), []
        while len(a):
            for i, j in zip(a[:2000].tolist(), b[:2000].tolist()):
                ri, rj = forest.root(i), forest.root(j)
                if ri != rj and similar(items[i], items[j]):
                    forest.up[max(ri, rj)] = min(ri, rj)
                    out.append((int(min(self.rep[i], self.rep[j])), int(max(self.rep[i], self.rep[j]))))
            roots = forest.roots()
            a, b = a[2000:], b[2000:]
            open_ = roots[a] != roots[b]
            a, b = a[open_], b[open_]
        return out


def similar(u: np.ndarray, v: np.ndarray) -> bool:
    """Whether two sets of sorted distinct hashes have LEAST hundredths of their union in common."""
    both = np.concatenate([u, v])
    both.sort(kind="stable")
    shared = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * shared >= LEAST * (len(u) + len(v) - shared)


def _by_node(rows: DataFrame, handle, schema: str) -> DataFrame:
    """handle(table of one node) for every node: rows are dealt by node, sorted, and read node by node."""

    def nodes_of(table: pa.Table) -> Iterator[pa.RecordBatch]:
        if len(table):
            node = table.column("node").to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]])).tolist()
            parts = [x for s, e in zip(starts, [*starts[1:], len(node)]) if e - s > 1 for x in [handle(table.slice(s, e - s))] if x is not None]
            if parts:
                yield from pa.concat_tables([pa.Table.from_batches([p]) for p in parts]).combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if tail is None else pa.concat_tables([tail, table])
            node = table.column("node").to_numpy()
            cut = int(np.flatnonzero(node != node[-1])[-1]) + 1 if len(node) and (node != node[-1]).any() else 0
            yield from nodes_of(table.slice(0, cut))
            tail = table.slice(cut)
        if tail is not None:
            yield from nodes_of(tail)

    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(2 * partitions, "node").sortWithinPartitions("node").mapInArrow(run, schema)


def confirmed_links(small: DataFrame, classes: DataFrame, docs: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """Links (a, b) of class representatives found in the small nodes: a spanning forest of all links of each node.

    Two passes over the nodes. The first compares members by size and estimate and keeps those with something to confirm;
    each pair is the matter of the node with the least id in which it meets. The second gets their full sets and confirms exactly.
    """
    homes = small.groupBy("rep").agg(F.collect_list("node").alias("homes"))  # some nodes for each tree
    facts = materialize(homes.join(classes.select("rep", "n_shingles", "sketch"), "rep"), "node-facts")
    rows = small.join(facts, "rep").select("node", "rep", "n_shingles", "sketch", "homes")

    def keep(table: pa.Table) -> pa.RecordBatch | None:
        some = _Node(table).involved()
        return table.select(["node", "rep"]).filter(pa.array(some)).combine_chunks().to_batches()[0] if some.any() else None

    chosen = materialize(_by_node(rows, keep, "node bigint, rep bigint"), "node-chosen")
    sets = full_sets(chosen.select(F.col("rep").alias(id_col)).distinct(), docs, id_col, text_col, k)
    full = chosen.join(facts, "rep").join(sets.select(F.col("doc_id").alias("rep"), "items"), "rep")

    def link(table: pa.Table) -> pa.RecordBatch | None:
        items = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("items")]
        out = _Node(table).links(items)
        return pa.RecordBatch.from_arrays([pa.array([p[0] for p in out], pa.int64()), pa.array([p[1] for p in out], pa.int64())], ["a", "b"]) if out else None

    return _by_node(full.select("node", "rep", "n_shingles", "sketch", "homes", "items"), link, "a bigint, b bigint")


def full_sets(ids: DataFrame, docs: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """doc_id, items: the full sets, made anew from the texts of these documents alone, which a broadcast of their ids finds
    while those stay below the limit, and a shuffle beyond."""
    ids = materialize(ids, "set-ids")
    wanted = F.broadcast(ids) if fits_broadcast(ids, 64) else ids
    own = docs.select(id_col, text_col).join(wanted, id_col, "left_semi")
    return materialize(_sets(own, id_col, text_col, k, "items").select("doc_id", "items").dropDuplicates(["doc_id"]), "sets")


def _star_pairs(large: DataFrame) -> DataFrame:
    """For large nodes: each member with the node's least one, with which most near copies are linked."""
    least = materialize(large.groupBy("node").agg(F.min("rep").alias("a")), "node-least")
    return large.join(least, "node").filter("rep > a").select("a", F.col("rep").alias("b")).distinct()


def open_blocks(large: DataFrame, labels: DataFrame, leaf: int = LEAF, leaf_bytes: int = LEAF_BYTES) -> DataFrame | None:
    """(node, rep): the large nodes cut into blocks, so that every two members of different components meet in one.

    Members outside the component of a node's least member are open. A pair whose ends are in different components has an
    open end, so it is enough to bring each block of open members together with each block of the node. None if nothing is open.
    """
    own = large.join(labels, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    own = materialize(own, "large-members")
    home = own.groupBy("node").agg(F.min(F.struct("rep", "component")).getField("component").alias("home"))
    marked = materialize(own.join(materialize(home, "large-homes"), "node").withColumn("open", F.col("component") != F.col("home")), "large-marked")
    share = lambda n, size: F.ceil(F.greatest(n / F.lit(BLOCK_LEAVES * leaf / 2), size / F.lit(BLOCK_LEAVES * leaf_bytes / 2)))
    opened = marked.filter("open").groupBy("node").agg(F.count(F.lit(1)).alias("m"), (8 * F.sum("n_shingles")).alias("open_bytes"))
    opened = materialize(opened.withColumn("open_blocks", share(F.col("m"), F.col("open_bytes"))).select("node", "open_blocks"), "large-open")
    if opened.isEmpty():
        return None
    cut = marked.join(opened, "node").withColumn("all_blocks", share(F.col("n"), F.col("bytes")))
    block = lambda count, salt: F.pmod(F.xxhash64("rep", F.lit(salt)), count)
    every = cut.select("node", "rep", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("open_blocks") - 1)).alias("i"), block(F.col("all_blocks"), 1).alias("j"))
    some = cut.filter("open").select("node", "rep", block(F.col("open_blocks"), 2).alias("i"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("all_blocks") - 1)).alias("j"))
    met = every.unionByName(some).select(F.xxhash64("node", "i", "j").alias("node"), "rep")
    return materialize(met.distinct(), "large-blocks")


def confirm(pairs: DataFrame, docs: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """Those of pairs (a, b) whose full shingle sets are similar enough, exactly."""
    sets = full_sets(pairs.select(F.explode(F.array("a", "b")).alias(id_col)).distinct(), docs, id_col, text_col, k)
    left = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("items").alias("x")), "a")
    both = left.join(sets.select(F.col("doc_id").alias("b"), F.col("items").alias("y")), "b").select("a", "b", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [similar(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)) for x, y in zip(batch.column(2), batch.column(3))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """(rep, component): the least member reachable by edges (a, b), for every rep in an edge. Alternating large and small stars.

    Every round is written to the shared folder; the rounds end when the edges no longer change.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        if large:
            both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        else:
            both = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        joined = both.join(least, "u")
        if large:
            out = joined.filter("v > u").select(F.col("m").alias("a"), F.col("v").alias("b"))
        else:
            out = joined.select(F.col("m").alias("a"), F.col("v").alias("b")).unionByName(least.select(F.col("m").alias("a"), F.col("u").alias("b")))
        return out.filter("a <> b").distinct()

    now, before = materialize(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges"), None
    while True:
        mark = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if mark == before or not mark["n"]:
            break
        before = mark
        now = materialize(star(star(now, True), False), "edges")
    return now.select(F.col("b").alias("rep"), F.col("a").alias("component")).unionByName(now.select(F.col("a").alias("rep"), F.col("a").alias("component"))).groupBy("rep").agg(F.min("component").alias("component"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, target_recall: float = TARGET_RECALL, leaf: int = LEAF, rounds: int = ROUNDS) -> DataFrame:
    """One row per input row: id_col, n_shingles, component_id, kept.

    Documents are linked when their sets of distinct `words`-word shingles (A-Z lower-cased) have at least 80 hundredths of
    their union in common. component_id is the least id reachable over links; kept marks the document with that id. Documents
    with one and the same set are one class from the start, so copies make no pairs. Then, tree by tree: from the root, each
    node draws the MinHash values, one or two, by which its members branch; small nodes are compared exhaustively by estimates, and
    what comes near the threshold is confirmed on the full sets, in the first node in which a pair meets, unless links confirmed there
    join the two already. Trees are repeated until a pair at the threshold meets in one with the target recall. Large nodes
    branch on for the links that this finds; then their members are confirmed against the least one, and what all this leaves in
    other components is compared with the whole node, block by block, so that no pair that met there is lost.

    Null and empty texts and texts of white space have no set, link with nothing and keep themselves; ids are 64-bit integers,
    rows with one id are one document. Repeated rows get repeated results; no rows give no rows; other columns are ignored.
    """
    base = materialize(_sets(docs, id_col, text_col, words, "values"), "near-base")
    classes = materialize(
        base.filter("n_shingles > 0").groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.min("n_shingles").alias("n_shingles"), F.min("values").alias("values")).withColumn("sketch", _sketch("values")),
        "near-classes",
    )
    n = classes.count()
    depth = max(2, math.ceil(math.log10(max(n, 10))) - 2)
    trees = tree_count(depth, target_recall)
    small, large = chosen_path_nodes(classes, trees, depth, leaf, rounds=rounds)
    links = materialize(confirmed_links(small, classes, docs, id_col, text_col, words), "links")
    if large is not None:
        links = links.unionByName(materialize(confirm(materialize(_star_pairs(large), "pairs"), docs, id_col, text_col, words), "links"))
        met = open_blocks(large, materialize(components(links), "labels"), leaf)
        if met is not None:
            links = links.unionByName(materialize(confirmed_links(met, classes, docs, id_col, text_col, words), "links"))
    labels = materialize(components(links), "labels")
    of_class = materialize(classes.select("set_key", "rep").join(labels, "rep", "left").select("set_key", F.coalesce("component", "rep").alias("component")), "class-labels")
    out = base.drop("values").join(of_class, "set_key", "left")
    component = F.coalesce(F.when(F.col("n_shingles") > 0, F.col("component")), F.col("doc_id"))
    return out.select(F.col("doc_id").alias(id_col), "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def _sketch(values: str):
    """One byte of each 32-bit value, in order: every fourth pair of hex digits."""
    return F.unhex(F.regexp_replace(F.hex(values), "(..)......", "$1"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5) -> DataFrame:
    """The rows of docs, all columns, that stay: one document of each component."""
    kept = near_dedup(docs, id_col, text_col, words).filter("kept").select(F.col(id_col).alias("__hr_id"))
    return docs.join(materialize(kept.distinct(), "near-kept"), F.col(id_col).eqNullSafe(F.col("__hr_id")), "left_semi")


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(documents(spark, sf_dir), words=2)
