"""Merkle manifest of a dataset: a tree for each group, one over the groups, and octopus multiproofs by partitions of leaves."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, fold_number, materialize
from .ranking import ranked

#: Children of a node, levels that one task builds at a time, and so leaves of a partition.
ARITY, LEVELS = 3, 6
BLOCK = ARITY**LEVELS
#: The tree over the groups' roots. Trees of groups are named "" (no group) or "s" and the group's value, in the order of bytes.
TOP = "t"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_digest(fields: Iterable[Column]) -> Column:
    """SHA-256 over the fields: `-` for null, else the number of UTF-8 bytes, `:` and the value."""
    parts = []
    for field in fields:
        value = field.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256))


def tree_name(group: Column) -> Column:
    return F.coalesce(F.concat(F.lit("s"), group.cast("string")), F.lit(""))


def height(leaves: int) -> int:
    levels = 0
    while leaves > 1:
        leaves, levels = -(-leaves // ARITY), levels + 1
    return levels


def parent(children: list[str]) -> str:
    return hashlib.sha256("".join(children).encode("ascii")).hexdigest()


def missing(indices: Iterable[int], leaves: int) -> list[tuple[int, int]]:
    """(level, index) of the nodes that must be fetched to prove these leaves of a tree: siblings on their paths, without those that
    follow from the leaves and from other fetched nodes. Each is named once, however many paths it stands beside."""
    out, known, count = [], sorted(set(indices)), leaves
    for level in range(height(leaves)):
        own, above = set(known), sorted({i // ARITY for i in known})
        out += [(level, i) for p in above for i in range(p * ARITY, min(p * ARITY + ARITY, count)) if i not in own]
        known, count = above, -(-count // ARITY)
    return out


class Paths:
    """What one partition knows of a tree: its own leaves, the fetched nodes, and the interiors that follow from both."""

    def __init__(self, own: dict[int, str], fetched: dict[tuple[int, int], str], leaves: int):
        self.levels = [dict(own)]
        count, self.runs = leaves, []
        for level in range(height(leaves)):
            at = self.levels[-1] | {i: d for (k, i), d in fetched.items() if k == level}
            self.levels[-1] = at
            above = {p: parent([at[i] for i in range(p * ARITY, min(p * ARITY + ARITY, count))]) for p in {i // ARITY for i in self.levels[level]}}
            self.runs.append(count)
            self.levels.append(above)
            count = -(-count // ARITY)
        self.root = self.levels[-1][0]
        self._shared: dict[tuple[int, int], str] = {}

    def siblings(self, level: int, index: int) -> tuple[str, str]:
        """The run's other nodes, left and right of this one."""
        at, first = self.levels[level], index - index % ARITY
        return "".join(at[i] for i in range(first, index)), "".join(at[i] for i in range(index + 1, min(first + ARITY, self.runs[level])))

    def proof(self, index: int, level: int = 0) -> str:
        """All siblings up to the root, in order; what stands above a run is put together once for all its leaves."""
        if level == len(self.runs):
            return ""
        up = (level + 1, index // ARITY)
        if up not in self._shared:
            self._shared[up] = self.proof(up[1], up[0])
        return "".join(self.siblings(level, index)) + self._shared[up]

    def fold(self, index: int, digest: str) -> str:
        """The root that follows from a digest at a leaf's place and the siblings."""
        for level in range(len(self.runs)):
            left, right = self.siblings(level, index)
            digest, index = hashlib.sha256(f"{left}{digest}{right}".encode("ascii")).hexdigest(), index // ARITY
        return digest


def _rows(batch: pa.RecordBatch) -> Iterator[list]:
    """Rows one by one: a row holds a whole block of leaves, so a batch of them is never unpacked at once."""
    for i in range(batch.num_rows):
        yield [column[i].as_py() for column in batch.columns]


def _blocks(leaves: DataFrame, counts: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """(tree, block, n, indices, digests, extra...): BLOCK neighbouring leaves (tree, index, digest, extra...) of a tree in a row."""
    rows = F.array_sort(F.collect_list(F.struct("index", "digest", *extra)))
    grouped = leaves.groupBy("tree", F.floor(F.col("index") / BLOCK).alias("block")).agg(rows.alias("rows"))
    arrays = [F.col("rows.index").alias("indices"), F.col("rows.digest").alias("digests"), *[F.col(f"rows.{c}").alias(c) for c in extra]]
    return grouped.join(counts, "tree").select("tree", "block", "n", *arrays)


NODES = "tree string, level int, index bigint, digest binary, n bigint"


def _grow(blocks: DataFrame, base: int) -> DataFrame:
    """Nodes of the LEVELS levels above `base`, from blocks of the nodes of that level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for tree, block, n, digests in _rows(batch):
                row, first, top = [d.hex() for d in digests], block * BLOCK, height(n)
                for level in range(base + 1, min(base + LEVELS, top) + 1):
                    row, first = [parent(row[i : i + ARITY]) for i in range(0, len(row), ARITY)], first // ARITY
                    for column, values in zip(out, ([tree] * len(row), [level] * len(row), range(first, first + len(row)), map(bytes.fromhex, row), [n] * len(row))):
                        column += values
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.int64()))], ["tree", "level", "index", "digest", "n"])

    return blocks.select("tree", "block", "n", "digests").mapInArrow(run, NODES)


def build(blocks: DataFrame, most: int, name: str) -> DataFrame:
    """All interior nodes of the trees whose leaves stand in `blocks`; most: the leaves of the largest tree."""
    base, out = 0, []
    while True:
        nodes = materialize(_grow(blocks, base), f"{name}-nodes-{base}")
        out.append(nodes)
        base += LEVELS
        if base >= height(most):
            break
        unfinished = nodes.filter((F.col("level") == base) & (F.col("n") > ARITY**base))
        counts = unfinished.select("tree", "n").filter(F.col("index") == 0)
        blocks = _blocks(unfinished.drop("n"), counts)
    whole = out[0]
    for nodes in out[1:]:
        whole = whole.unionByName(nodes)
    return whole


def _roots(blocks: DataFrame, nodes: DataFrame) -> DataFrame:
    """(tree, digest, n) of each tree: its only node at its height; a lone leaf itself."""
    heights = F.when(F.col("n") <= 1, 0)
    for level in range(1, 41):
        heights = heights.when(F.col("n") <= ARITY**level if ARITY**level < 1 << 62 else F.lit(True), level)
    lone = blocks.filter(F.col("n") == 1).select("tree", F.col("digests")[0].alias("digest"), "n")
    return nodes.filter(F.col("level") == heights).select("tree", "digest", "n").unionByName(lone)


class Manifest:
    """A dataset's trees: parts (BLOCK leaves in a row, with ids and claimed digests), nodes, and each group's place in the tree of groups."""

    def __init__(self, leaves: DataFrame, name: str = "merkle"):
        """leaves: tree, doc_id, leaf, claimed. Within a tree they stand by doc_id (null first), then by digest."""
        self.spark, self.name = leaves.sparkSession, name
        rows = ranked(materialize(leaves, f"{name}-leaves"), "tree", [F.col("doc_id").asc_nulls_first(), F.col("leaf"), F.col("claimed")], name)
        rows = rows.withColumnRenamed("leaf", "digest")
        counts = rows.groupBy("tree").agg(F.count(F.lit(1)).alias("n"))
        self.parts = materialize(_blocks(rows, counts, ("doc_id", "claimed")), f"{name}-parts")
        self.empty = self.parts.isEmpty()
        if self.empty:
            return
        own = build(self.parts, self.parts.agg(F.max("n")).first()[0], name)
        roots = materialize(_roots(self.parts, own), f"{name}-roots")
        tops = materialize(ranked(roots.withColumns({"of": F.col("tree"), "tree": F.lit(TOP)}).drop("n"), "tree", [F.col("of")], f"{name}-top"), f"{name}-tops")
        self.groups = tops.count()
        blocks = materialize(_blocks(tops, tops.groupBy("tree").agg(F.count(F.lit(1)).alias("n")), ("of",)), f"{name}-top-parts")
        top = build(blocks, self.groups, f"{name}-top")
        self.root = _roots(blocks, top).first()["digest"].hex()
        self.nodes = own.unionByName(top)
        #: The leaves of the tree of groups, which proofs of single groups fetch.
        self.bottom = tops.select("tree", F.lit(0).alias("level"), "index", "digest")
        self.places = tops.select(F.col("of").alias("tree"), F.col("index").alias("place"))

    def multiproofs(self, wanted: DataFrame | None = None, with_siblings: bool = False) -> DataFrame:
        """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of each leaf, or of those whose doc_id is in `wanted`
        (doc_id, without repeats); with_siblings: the proofs themselves too, siblings' digests up to the root in one string.

        Each part computes which nodes all its proofs lack, each once; one join fetches them; the part then derives what its paths
        share and writes each proof by itself. What is fetched for a part is at most two nodes a level, beside, where only some
        leaves are wanted, their neighbours.
        """
        parts = self.parts
        nodes = self.nodes.select("tree", "level", "index", "digest").unionByName(self.bottom)
        if wanted is not None:
            flat = parts.select("tree", "block", "n", F.explode(F.arrays_zip("indices", "digests", "doc_id", "claimed")).alias("x")).select("tree", "block", "n", "x.*")
            nodes = nodes.unionByName(flat.select("tree", F.lit(0).alias("level"), F.col("indices").alias("index"), F.col("digests").alias("digest")))
            some = flat.join(wanted.select("doc_id"), "doc_id", "left_semi")
            rows = F.array_sort(F.collect_list(F.struct("indices", "digests", "doc_id", "claimed")))
            parts = some.groupBy("tree", "block", "n").agg(rows.alias("rows")).select("tree", "block", "n", *[F.col(f"rows.{c}").alias(c) for c in ("indices", "digests", "doc_id", "claimed")])
        parts = parts.join(self.places, "tree")
        groups, root = self.groups, self.root

        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out: list[tuple] = []
                for tree, block, n, place, indices in _rows(batch):
                    out += [(tree, block, of, *at) for of, coordinates in ((tree, missing(indices, n)), (TOP, missing([place], groups))) for at in coordinates]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 5, (pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64()))], ["tree", "block", "of", "level", "index"])

        asked = parts.select("tree", "block", "n", "place", "indices").mapInArrow(ask, "tree string, block bigint, of string, level int, index bigint")
        found = asked.join(nodes.withColumnRenamed("tree", "of"), ["of", "level", "index"])
        fetched = found.groupBy("tree", "block").agg(F.collect_list(F.struct(F.col("of") == TOP, "level", "index", "digest")).alias("fetched"))
        fields = ["leaf string", "subroot string", "root string", "proof_sha256 string", "folded_root string", "verified boolean", *["siblings string"] * with_siblings]

        def prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, types = ["doc_id", *(f.split()[0] for f in fields)], [pa.int64(), *[pa.bool_() if f.endswith("boolean") else pa.string() for f in fields]]
            for batch in batches:
                for n, place, indices, digests, doc_ids, claimed, nodes in _rows(batch):
                    got: tuple[dict, dict] = ({}, {})
                    for top, level, index, digest in (x.values() for x in nodes or ()):
                        got[top][level, index] = digest.hex()
                    own = Paths({i: d.hex() for i, d in zip(indices, digests)}, got[0], n)
                    above = Paths({place: own.root}, got[1], groups)
                    shared = above.proof(place)
                    out: list[tuple] = []
                    for index, doc_id, digest, claim in zip(indices, doc_ids, digests, claimed):
                        siblings = own.proof(index) + shared
                        folded = above.fold(place, own.fold(index, claim.hex()))
                        out.append((doc_id, digest.hex(), own.root, root, hashlib.sha256(siblings.encode("ascii")).hexdigest(), folded, folded == root, siblings)[: len(names)])
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

        whole = parts.join(fetched, ["tree", "block"], "left").select("n", "place", "indices", "digests", "doc_id", "claimed", "fetched")
        return whole.mapInArrow(prove, "doc_id bigint, " + ", ".join(fields))


PROOFS = "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, group: str = "source", id_col: str = "doc_id", claim: dict[str, Column] | None = None) -> Manifest:
    """The trees over all rows of docs; id_col is an integer. claim: columns as someone claims them to be, in place of docs' own, by name;
    the proofs then tell for each row whether the claim is what the manifest holds.

    Nulls in any field have an own mark, so null and empty differ; rows without a group form the first tree; rows without an id come
    first in theirs. Repeated rows are leaves of their own. Columns beside `fields` and `group` are ignored, whatever their names.
    One group may hold most rows: leaves are ranked in ranges and built in blocks of 729.
    """
    claims = claim or {}
    leaf = leaf_digest(F.col(f) for f in fields)
    said = leaf_digest(claims.get(f, F.col(f)) for f in fields) if claims else leaf
    return Manifest(docs.select(tree_name(F.col(group)).alias("tree"), F.col(id_col).cast("bigint").alias("doc_id"), leaf.alias("leaf"), said.alias("claimed")))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's proof, where half of the documents (by crc32 of the id; a null id counts as empty text) lost their line ends."""
    tampered = F.when(fold_number(F.col("doc_id"), 2) == 0, F.regexp_replace("text", "\n", "")).otherwise(F.col("text"))
    trees = manifest(documents(spark, sf_dir), claim={"text": tampered})
    return spark.createDataFrame([], PROOFS) if trees.empty else trees.multiproofs()


def _crc_even(column: str) -> str:
    from .prefix_trie import CRC32_SQL

    return f"{CRC32_SQL.format(column)} % 2 = 0"


def _field(value: str) -> str:
    return f"coalesce(octet_length(encode({value})) || ':' || {value}, '-')"


_LEAF_SQL = "sha256(" + " || ".join([*(_field(f"CAST({f} AS VARCHAR)") for f in FIELDS[:-1]), "{text}"]) + ")"

ORACLE_SQL = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, coalesce('s' || source, '') AS tree, {_LEAF_SQL.format(text=_field("text"))} AS leaf,
    CASE WHEN {_crc_even("doc_id")} THEN {_LEAF_SQL.format(text=_field("replace(text, chr(10), '')"))} ELSE {_LEAF_SQL.format(text=_field("text"))} END AS claimed
  FROM documents
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf, claimed) - 1 AS place FROM leaves
), nodes AS (
  SELECT tree, 0 AS level, place, leaf AS digest, count(*) OVER (PARTITION BY tree) AS n FROM placed
  UNION ALL
  SELECT tree, any_value(level) + 1, place // 3, sha256(string_agg(digest, '' ORDER BY place)), count(*) OVER (PARTITION BY tree) FROM nodes WHERE n > 1 GROUP BY tree, place // 3
), subroots AS (
  SELECT tree, digest AS subroot, row_number() OVER (ORDER BY encode(tree)) - 1 AS place, level AS height FROM nodes WHERE n = 1
), tops AS (
  SELECT 0 AS level, place, subroot AS digest, count(*) OVER () AS n FROM subroots
  UNION ALL
  SELECT any_value(level) + 1, place // 3, sha256(string_agg(digest, '' ORDER BY place)), count(*) OVER () FROM tops WHERE n > 1 GROUP BY place // 3
), every AS (
  SELECT tree, level, place, digest FROM nodes UNION ALL SELECT 't', level, place, digest FROM tops
), sides AS (
  SELECT a.tree, a.level, a.place, coalesce(string_agg(b.digest, '' ORDER BY b.place) FILTER (WHERE b.place < a.place), '') AS lower, coalesce(string_agg(b.digest, '' ORDER BY b.place) FILTER (WHERE b.place > a.place), '') AS higher
  FROM every a JOIN every b ON a.tree = b.tree AND a.level = b.level AND a.place // 3 = b.place // 3 GROUP BY ALL
), climb AS (
  SELECT p.doc_id, p.tree AS home, p.place AS own, p.tree, 0 AS level, p.place, p.claimed AS folded, '' AS proof, s.height, s.place AS of_home FROM placed p JOIN subroots s ON s.tree = p.tree
  UNION ALL
  SELECT doc_id, home, own, CASE WHEN up THEN 't' ELSE c.tree END, CASE WHEN up THEN 0 ELSE c.level + 1 END, CASE WHEN up THEN of_home ELSE c.place // 3 END,
    CASE WHEN up THEN folded ELSE sha256(lower || folded || higher) END, CASE WHEN up THEN proof ELSE proof || lower || higher END,
    CASE WHEN up THEN (SELECT max(level) FROM tops) ELSE height END, of_home
  FROM (SELECT *, level = height AND tree <> 't' AS up FROM climb WHERE tree <> 't' OR level < height) c JOIN sides s ON s.tree = c.tree AND s.level = c.level AND s.place = c.place
)
SELECT c.doc_id, p.leaf, s.subroot, t.digest AS root, sha256(c.proof) AS proof_sha256, c.folded AS folded_root, c.folded = t.digest AS verified
FROM climb c JOIN placed p ON p.tree = c.home AND p.place = c.own JOIN subroots s ON s.tree = c.home JOIN (SELECT digest FROM tops WHERE n = 1) t ON true
WHERE c.tree = 't' AND c.level = c.height
"""
