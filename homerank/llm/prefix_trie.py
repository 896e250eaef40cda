"""Trie of conversation prefixes, with subtree totals by parallel tree contraction: rake leaves, compress chains, then expand again."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize
from .ranking import ranked

#: Turns of a conversation that one window takes, and conversation ids (as a power of two) that one row of ends takes.
BLOCK, ENDS_BITS = 1024, 10
#: How many turns a conversation can take over from another one.
MOST_HEAD = 8
LANES = ("s0", "s1", "s2", "s3")
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()


def read_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, content (128-bit hash of role and text), n_bytes of the text; texts are read here and nowhere else.

    Null roles and texts are empty. Rows without a conv_id belong to no conversation and are left out."""
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.unhex(F.md5(whole.cast("binary"))).alias("content"), F.octet_length(text).cast("bigint").alias("n_bytes")
    )


def head_of(conv_id: Column) -> Column:
    return F.crc32(conv_id.cast("string").cast("binary")) % (MOST_HEAD + 1)


def base_of(conv_id: Column) -> Column:
    return conv_id - conv_id % 5


def rebuilt(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rebuilt turns (conv_id, index, content, n_bytes) and conversations (conv_id, size), from ranked turns: the first h turns of the
    conversation's base, then its own after its first h."""
    counts = materialize(rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")), "trie-counts")
    h, base = head_of(F.col("conv_id")), base_of(F.col("conv_id"))
    bases = counts.filter(base == F.col("conv_id")).select(F.col("conv_id").alias("base"), F.least("n", F.lit(MOST_HEAD)).alias("n_base"))
    heads = counts.withColumn("base", base).join(bases, "base", "left")
    taken = F.least(h, F.coalesce(F.col("n_base"), F.lit(0)))
    sizes = materialize(heads.select("conv_id", taken.alias("taken"), (taken + F.greatest(F.col("n") - h, F.lit(0))).alias("size")), "trie-sizes")
    own = rows.filter(F.col("index") >= h).select("conv_id", F.lit(True).alias("own"), "index", "content", "n_bytes")
    # At most nine ids have one base; those that are no conversation go in the join.
    ids = F.filter(F.sequence(F.col("conv_id") - 4, F.col("conv_id") + 4), lambda c: base_of(c) == F.col("conv_id"))
    lent = rows.filter((base == F.col("conv_id")) & (F.col("index") < MOST_HEAD)).select(F.explode(ids).alias("to"), "index", "content", "n_bytes")
    lent = lent.filter(F.col("index") < head_of(F.col("to"))).select(F.col("to").alias("conv_id"), F.lit(False).alias("own"), "index", "content", "n_bytes")
    every = own.unionByName(lent).join(sizes.select("conv_id", "taken"), "conv_id")
    place = F.when(F.col("own"), F.col("taken") + F.col("index") - h).otherwise(F.col("index"))
    return every.select("conv_id", place.alias("index"), "content", "n_bytes"), sizes.select("conv_id", "size")


def _running(rows: DataFrame, longest: int, block: int) -> DataFrame:
    """rows (conv_id, index, lanes, ...) with lanes summed up to each row. A window takes `block` rows; what stands before it comes from
    the sums of blocks, which are summed in the same way."""
    at = F.expr(f"index div {block}")
    rows = rows.withColumn("block", at).repartition("conv_id", "block")
    window = Window.partitionBy("conv_id", "block").orderBy("index").rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumns({c: F.sum(c).over(window) for c in LANES})
    if longest > block:
        totals = rows.groupBy("conv_id", "block").agg(*[F.sum(c).alias(c) for c in LANES]).withColumnRenamed("block", "index")
        before = _running(totals, -(-longest // block), block).select("conv_id", (F.col("index") + 1).alias("block"), *[F.col(c).alias(f"b_{c}") for c in LANES])
        local = local.join(before, ["conv_id", "block"], "left").withColumns({c: F.col(c) + F.coalesce(F.col(f"b_{c}"), F.lit(0)) for c in LANES}).drop(*[f"b_{c}" for c in LANES])
    return local.drop("block")


def _name(depth: Column, lanes: list[Column]) -> list[Column]:
    """128 bits that name a prefix; the root's are zero."""
    return [F.when(depth == 0, F.lit(0).cast("bigint")).otherwise(F.xxhash64(F.lit(seed), depth, *lanes)) for seed in (1, 2)]


def prefixes(turns: DataFrame, sizes: DataFrame, block: int = BLOCK) -> DataFrame:
    """Each conversation's prefixes: conv_id, depth, their names (a, b), their parents' (pa, pb), n_bytes of the last text, ends (whether
    the conversation ends here).

    A prefix is named by sums over its turns of 4 x 32 bits that hash place and content: a sum can be taken in blocks, so one
    conversation with a third of all turns is cut up like others."""
    depth = F.col("index") + 1
    hashes = [F.xxhash64(F.lit(seed), "index", "content") for seed in (3, 4)]
    low, high = (lambda x: x.bitwiseAND(0xFFFFFFFF)), (lambda x: F.shiftrightunsigned(x, 32))
    own = dict(zip(LANES, (low(hashes[0]), high(hashes[0]), low(hashes[1]), high(hashes[1]))))
    rows = turns.withColumns(own).drop("content").withColumns({f"o_{c}": F.col(c) for c in LANES})
    longest = sizes.agg(F.max("size")).first()[0] or 0
    rows = _running(rows, longest, block).join(sizes, "conv_id")
    a, b = _name(depth, [F.col(c) for c in LANES])
    pa_, pb = _name(depth - 1, [F.col(c) - F.col(f"o_{c}") for c in LANES])
    return rows.select("conv_id", depth.alias("depth"), a.alias("a"), b.alias("b"), pa_.alias("pa"), pb.alias("pb"), "n_bytes", (depth == F.col("size")).alias("ends"))


def trie_nodes(paths: DataFrame, sizes: DataFrame) -> DataFrame:
    """One row a distinct prefix, the root included: a, b, pa, pb, conv_id, depth, n_convs, n_bytes, n_children. Members are counted
    before they are sent, so a first turn that all conversations share is a few rows."""
    inner = paths.groupBy("a", "b").agg(
        F.first("pa").alias("pa"), F.first("pb").alias("pb"), F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.count(F.lit(1)).alias("n_convs"), F.first("n_bytes").alias("n_bytes")
    )
    zero, null = F.lit(0).cast("bigint"), F.lit(None).cast("bigint")
    root = sizes.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).filter("n_convs > 0").select(zero.alias("a"), zero.alias("b"), null.alias("pa"), null.alias("pb"), "conv_id", zero.alias("depth"), "n_convs", zero.alias("n_bytes"))
    nodes = materialize(inner.unionByName(root), "trie-prefixes")
    children = nodes.filter("depth > 0").groupBy(F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count(F.lit(1)).alias("n_children"))
    return materialize(nodes.join(children, ["a", "b"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "trie-nodes")


def contract(nodes: DataFrame, values: list[str]) -> DataFrame:
    """a, b and the sum over each node's subtree of each of `values` (columns of nodes: a, b, pa, pb, depth, n_children, values; one root
    at depth 0).

    Each round rakes: leaves hand their sums to their parents and go, with their totals known; and compresses: nodes with one child
    left that come before their neighbours in the chain (an order that first takes every other one) hand their own sums to their
    parents and their child to their place, and are noted. Rounds are logarithmic in the nodes even where a chain is long. When the root
    is alone, the noted nodes are expanded in reverse: a node's total is its own sum then and its child's total.
    Sums to one parent are added before they are sent. Each round is two tables in the shared folder.
    """
    key, above = ["a", "b"], [F.col("pa").alias("a"), F.col("pb").alias("b")]
    sums = [F.sum(v).alias(f"x_{v}") for v in values]
    plus = {v: F.col(v) + F.coalesce(F.col(f"x_{v}"), F.lit(0)) for v in values}
    extra = [f"x_{v}" for v in values]
    state = nodes.select("a", "b", "pa", "pb", "depth", F.col("n_children").alias("n"), *values)
    rounds: list[tuple[DataFrame, DataFrame | None]] = []
    while True:
        leaf = (F.col("n") == 0) & (F.col("depth") > 0)
        push = state.filter(leaf).groupBy(*above).agg(F.count(F.lit(1)).alias("x_n"), *sums)
        raked = state.join(push, key, "left").withColumn("raked", leaf).withColumns(plus | {"n": F.col("n") - F.coalesce(F.col("x_n"), F.lit(0))}).drop("x_n", *extra)
        table = materialize(raked, f"trie-raked-{len(rounds)}")
        rest = table.filter("NOT raked").drop("raked")
        if rest.filter("depth > 0").isEmpty():
            rounds.append((table, None))
            break
        # Trailing zeros of the depth first: of a chain every other node is a local least.
        order = F.expr("bit_count((depth & -depth) - 1)").cast("bigint") * (1 << 52) + F.pmod(F.xxhash64(F.lit(len(rounds)), *key), F.lit(1 << 52))
        chain = (F.col("n") == 1) & (F.col("depth") > 0)
        ordered = rest.withColumn("rank", F.when(chain, order))
        below = ordered.filter("depth > 0").groupBy(*above).agg(F.min(F.struct("a", "b", "rank")).alias("child"))
        pairs = ordered.filter(chain).join(below, key)
        later = pairs.filter(F.col("rank") < F.col("child.rank")).select("child.a", "child.b")
        least = pairs.filter(F.coalesce(F.col("rank") < F.col("child.rank"), F.lit(True))).join(later, key, "left_anti")
        spliced = materialize(least.select("a", "b", "pa", "pb", F.col("child.a").alias("ca"), F.col("child.b").alias("cb"), *values), f"trie-spliced-{len(rounds)}")
        rounds.append((table, spliced))
        moves = spliced.select(F.col("ca").alias("a"), F.col("cb").alias("b"), F.col("pa").alias("m_pa"), F.col("pb").alias("m_pb"))
        adds = spliced.groupBy(*above).agg(*sums)
        kept = rest.join(spliced.select(*key), key, "left_anti").join(moves, key, "left").join(adds, key, "left")
        state = kept.withColumns(plus | {c: F.coalesce(F.col(f"m_{c}"), F.col(c)) for c in ("pa", "pb")}).drop("m_pa", "m_pb", *extra)
    known = rounds[-1][0].select(*key, *values)
    for number in reversed(range(len(rounds) - 1)):
        table, spliced = rounds[number]
        child = known.select(F.col("a").alias("ca"), F.col("b").alias("cb"), *[F.col(v).alias(f"x_{v}") for v in values])
        expanded = spliced.join(child, ["ca", "cb"]).withColumns(plus).select(*key, *values)
        known = known.unionByName(materialize(expanded, f"trie-expanded-{number}")).unionByName(table.filter("raked").select(*key, *values))
    return known


def _end_hashes(paths: DataFrame, sizes: DataFrame) -> DataFrame:
    """a, b, ends_sha256 of nodes at which conversations end. Their ids are sorted and joined in blocks of 1024 ids; the blocks of a node
    run in order through one hash, none held longer than it takes."""
    ends = paths.filter("ends").select("a", "b", "conv_id").unionByName(sizes.filter("size = 0").select(F.lit(0).cast("bigint").alias("a"), F.lit(0).cast("bigint").alias("b"), "conv_id"))
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    blocks = ends.groupBy("a", "b", F.shiftright("conv_id", ENDS_BITS).alias("block")).agg(ids.alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest = None, None
        for batch in batches:
            out: list[tuple[int, int, str]] = []
            for a, b, ids in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if (a, b) == node:
                    digest.update(b"," + ids.encode("ascii"))
                    continue
                if node:
                    out.append((*node, digest.hexdigest()))
                node, digest = (a, b), hashlib.sha256(ids.encode("ascii"))
            yield _ended(out)
        yield _ended([(*node, digest.hexdigest())] if node else [])

    ordered = blocks.repartition("a", "b").sortWithinPartitions("a", "b", "block").select("a", "b", "ids")
    return ordered.mapInArrow(run, "a bigint, b bigint, ends_sha256 string")


def _ended(rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string()))], ["a", "b", "ends_sha256"])


def prefix_trie(turns: DataFrame, sizes: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row a distinct prefix of the conversations: conv_id (least member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256.

    turns: conv_id, index (from 0, without gaps), content, n_bytes; sizes: conv_id, size, for each conversation, those without turns
    too (they are members of the root alone). Conversations that are equal share all their nodes. No conversations give no rows.
    """
    paths = materialize(prefixes(turns, sizes, block), "trie-paths")
    nodes = trie_nodes(paths, sizes)
    own = nodes.withColumns({"n_leaves": (F.col("n_children") == 0).cast("bigint"), "saved_tokens": (F.col("n_convs") - 1) * F.col("n_bytes")})
    if nodes.isEmpty():
        totals = own.select("a", "b", "n_leaves", "saved_tokens")
    else:
        totals = contract(own, ["n_leaves", "saved_tokens"])
    parents = nodes.select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent_conv_id"))
    rows = nodes.join(totals, ["a", "b"]).join(_end_hashes(paths, sizes), ["a", "b"], "left").join(parents, ["pa", "pb"], "left")
    return rows.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY_SHA256)).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """The trie of rebuilt conversations (see `rebuilt`), from conv_id, turn, role, text in any order.

    Turns stand by `turn`, null first; equal turns stand by their content's hash, so repeated rows are turns of their own in a defined
    order. Null roles and texts are empty; rows without conv_id are left out; other columns, whatever their names, are ignored.
    """
    turns = materialize(read_turns(conversations), "trie-turns")
    rows = ranked(turns, "conv_id", [F.col("turn").asc_nulls_first(), F.col("content"), F.col("n_bytes")], "trie")
    return prefix_trie(*rebuilt(rows), block)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


#: CRC-32 of a decimal number, bit by bit, as DuckDB SQL.
CRC32_SQL = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST({0} AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT))),
    lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, i: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)"""

ORACLE_SQL = f"""
WITH ordered AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT conv_id, {CRC32_SQL.format("conv_id")} % 9 AS h FROM (SELECT DISTINCT conv_id FROM ordered)
), parts AS (
  SELECT c.conv_id, 0 AS own, o.place, o.role, o.text FROM convs c JOIN ordered o ON o.conv_id = c.conv_id - c.conv_id % 5 AND o.place <= c.h
  UNION ALL
  SELECT c.conv_id, 1, o.place, o.role, o.text FROM convs c JOIN ordered o ON o.conv_id = c.conv_id AND o.place > c.h
), turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY own, place) AS depth, sha256(length(role) || ':' || role || text) AS said, octet_length(encode(text)) AS n_bytes FROM parts
), paths AS (
  SELECT conv_id, depth, sha256(string_agg(said, '') OVER (PARTITION BY conv_id ORDER BY depth)) AS node,
    coalesce(sha256(string_agg(said, '') OVER (PARTITION BY conv_id ORDER BY depth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), 'root') AS above, n_bytes,
    depth = max(depth) OVER (PARTITION BY conv_id) AS ends
  FROM turns
  UNION ALL
  SELECT c.conv_id, 0, 'root', NULL, 0, NOT EXISTS (SELECT 1 FROM turns t WHERE t.conv_id = c.conv_id) FROM convs c
), nodes AS (
  SELECT node, any_value(above) AS above, min(conv_id) AS conv_id, any_value(depth) AS depth, count(*) AS n_convs, (count(*) - 1) * any_value(n_bytes) AS saved,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
  FROM paths GROUP BY node
), children AS (SELECT above AS node, count(*) AS n FROM nodes WHERE above IS NOT NULL GROUP BY above
), totals AS (
  SELECT p.node, sum(n.saved) AS saved_tokens, sum(CASE WHEN c.n IS NULL THEN 1 ELSE 0 END) AS n_leaves
  FROM nodes n JOIN paths p ON p.conv_id = n.conv_id AND p.depth <= n.depth LEFT JOIN children c ON c.node = n.node GROUP BY p.node
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n, 0) AS n_children, CAST(t.n_leaves AS BIGINT) AS n_leaves, CAST(t.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes n JOIN totals t ON t.node = n.node LEFT JOIN nodes p ON p.node = n.above LEFT JOIN children c ON c.node = n.node
"""
