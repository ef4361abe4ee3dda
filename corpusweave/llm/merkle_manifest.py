"""Merkle dataset manifest: a tree per source, a tree over the sources, and proofs for rows.

Checkpoint-and-recompute: of a tree's levels only every `stride`-th is kept as a table
(a band). A block is an aligned subtree of one band's nodes: `fan_in ** stride` neighbours
and the levels above them up to the next band. Proofs are taken from the top band down:
each block gets the proof of its top node, makes its missing interior nodes anew from the stored ones,
hands the siblings out to its nodes and forgets the rest.

A hot source is no problem: rows are numbered by ranges of (source, id), and everything
else is keyed by (source, block), where a block has a fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusweave.functions.ordered import Ordered
from corpusweave.llm.storage import written

FAN_IN, STRIDE = 3, 4
HEX = 64
PROOF = "array<struct<place:int,siblings:string>>"
NODES = "tree string, pos long, node string, top boolean"


def encoded_field(value: Column) -> Column:
    """`-` for null, else UTF-8 byte count, colon and value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(*fields: Column) -> Column:
    return F.sha2(F.concat(*[encoded_field(f) for f in fields]), 256)


def joined_digest(digests: list[str]) -> str:
    return sha256("".join(digests).encode()).hexdigest()


def subtree(nodes: list[str], fan_in: int, stride: int, top: bool) -> list[list[str]]:
    """Levels of one block, the given nodes first; a top block ends with a single node, another one after `stride` steps."""
    levels = [nodes]
    while len(levels[-1]) > 1 if top else len(levels) <= stride:
        below = levels[-1]
        levels.append([joined_digest(below[i : i + fan_in]) for i in range(0, len(below), fan_in)])
    return levels


def siblings(levels: list[list[str]], k: int, fan_in: int) -> list[tuple[int, str]]:
    """Place within its run, and the run's other digests, of node `k` and its ancestors inside the block."""
    out = []
    for level in levels[:-1]:
        run = level[k - k % fan_in : k - k % fan_in + fan_in]
        place = k % fan_in
        out.append((place, "".join(run[:place] + run[place + 1 :])))
        k //= fan_in
    return out


@dataclass(frozen=True)
class Forest:
    """Trees over numbered nodes. `bands[k]` holds level `k * stride` (tree, pos, node); `tops` one node per tree."""

    bands: list[DataFrame]
    tops: DataFrame
    fan_in: int
    stride: int

    def blocks(self, k: int, extra: tuple[str, ...] = ()) -> DataFrame:
        """tree, block, top and the nodes of each block of band `k` in order, with `extra` columns of the band."""
        size = self.fan_in**self.stride
        band = self.bands[k].withColumn("block", F.floor(F.col("pos") / size))
        rows = band.groupBy("tree", "block").agg(F.array_sort(F.collect_list(F.struct("pos", "node", *extra))).alias("nodes"))
        widths = rows.groupBy("tree").agg((F.count("*") == 1).alias("top"))
        return rows.join(widths, "tree")


def _folded(fan_in: int, stride: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tops = batch["top"].to_pylist()
            above = [subtree([n["node"] for n in nodes], fan_in, stride, top)[-1][0] for nodes, top in zip(batch["nodes"].to_pylist(), tops)]
            yield pa.RecordBatch.from_arrays([batch["tree"], batch["block"], pa.array(above, pa.string()), batch["top"]], ["tree", "pos", "node", "top"])

    return run


def grow(leaves: DataFrame, fan_in: int = FAN_IN, stride: int = STRIDE) -> Forest:
    """Trees over `leaves` (tree, pos from 0 without gaps, node, other columns); one round per band."""
    bands, tops = [leaves], None
    while True:
        forest = Forest(bands, None, fan_in, stride)
        above = written(forest.blocks(len(bands) - 1).mapInArrow(_folded(fan_in, stride), NODES), "merkle-band")
        ended = above.filter("top").select("tree", "node")
        tops = ended if tops is None else tops.union(ended)
        rest = above.filter("not top").select("tree", "pos", "node")
        if rest.isEmpty():
            return Forest(bands, tops, fan_in, stride)
        bands.append(rest)


def _expanded(fan_in: int, stride: int, extra: tuple[str, ...], schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tree, nodes, top, proof, subroot, root in zip(*(batch[c].to_pylist() for c in ("tree", "nodes", "top", "proof", "subroot", "root"))):
                levels = subtree([n["node"] for n in nodes], fan_in, stride, top)
                above = [(p["place"], p["siblings"]) for p in proof]
                own = [siblings(levels, k, fan_in) + above for k in range(len(nodes))]
                n = len(nodes)
                columns = {"tree": [tree] * n, "subroot": [subroot] * n, "root": [root] * n,
                           "proof": [[{"place": a, "siblings": b} for a, b in p] for p in own]}
                columns |= {c: [x[c] for x in nodes] for c in ("pos", "node", *extra)}
                yield pa.RecordBatch.from_pydict({f.name: pa.array(columns[f.name], f.type) for f in schema}, schema=schema)

    return run


def extract(forest: Forest, above: DataFrame, extra: tuple[str, ...] = (), wanted: DataFrame | None = None) -> DataFrame:
    """tree, pos, node, proof, subroot, root and `extra` columns for the nodes of the lowest band.

    `above` (tree, proof, subroot, root) goes on where a tree ends. `wanted` (tree, pos) limits the
    work to blocks with a wanted node; all nodes of those blocks come out.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    size = forest.fan_in**forest.stride
    needed = [None] * len(forest.bands)
    if wanted is not None:
        for k in range(len(forest.bands)):
            needed[k] = wanted.select("tree", F.floor(F.col("pos") / size ** (k + 1)).alias("block")).distinct()
    out = None
    for k in reversed(range(len(forest.bands))):
        more = extra if k == 0 else ()
        blocks = forest.blocks(k, more)
        if needed[k] is not None:
            blocks = blocks.join(needed[k], ["tree", "block"], "left_semi")
        ended = blocks.filter("top").join(above, "tree").select("tree", "block", "top", "nodes", "proof", "subroot", "root")
        if out is None:
            given = ended
        else:
            parents = out.select("tree", F.col("pos").alias("block"), "proof", "subroot", "root")
            given = ended.union(blocks.filter("not top").join(parents, ["tree", "block"]).select("tree", "block", "top", "nodes", "proof", "subroot", "root"))
        fields = StructType([forest.bands[k].schema[c] for c in ("tree", "pos", "node", *more)])
        schema = StructType.fromDDL(f"proof {PROOF}, subroot string, root string")
        schema = StructType([*fields.fields, *schema.fields])
        out = given.mapInArrow(_expanded(forest.fan_in, forest.stride, more, to_arrow_schema(schema)), schema)
    return out


@dataclass(frozen=True)
class Manifest:
    """`rows` and `sources` trees of a table; see `build_manifest`."""

    rows: Forest
    sources: Forest

    def root(self) -> DataFrame:
        """The root digest, one row; none for an empty table."""
        return self.sources.tops.select(F.col("node").alias("root"))

    def proofs(self, condition: Column | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
        """leaf, proof, subroot, root and the columns in `carry` of each row, or of those that meet `condition` (on the leaves' columns)."""
        root = self.sources.tops.select(F.lit("").alias("tree"), F.col("node").alias("root"))
        none = F.array().cast(PROOF)
        trees = extract(self.sources, root.select("tree", none.alias("proof"), F.lit("").alias("subroot"), "root"), ("source_tree",))
        above = trees.select(F.col("source_tree").alias("tree"), "proof", F.col("node").alias("subroot"), "root")
        wanted = None if condition is None else self.rows.bands[0].filter(condition).select("tree", "pos")
        out = extract(self.rows, above, carry, wanted)
        if wanted is not None:
            out = out.join(wanted, ["tree", "pos"], "left_semi")
        return out.withColumnRenamed("node", "leaf").select(*carry, "leaf", "proof", "subroot", "root")


def build_manifest(docs: DataFrame, leaf: Column, also: dict[str, Column] | None = None, fan_in: int = FAN_IN, stride: int = STRIDE) -> Manifest:
    """A manifest of `docs` (doc_id, source and whatever `leaf` needs): `leaf` is a row's digest, `also` names more columns to keep beside it.

    Per source, leaves ascend by doc_id (nulls first, then by digest). While a level has more than one node, every `fan_in`
    neighbours become the digest of their digests, joined; the last run may be shorter. The nodes that remain, one per
    source, ordered by source (null first, then by UTF-8 bytes), make one more tree. A null source and an empty one are two
    sources; rows with null ids and repeated rows are leaves like all others (equal rows have equal leaves at neighbouring
    places); an empty table has no root; other columns, of whatever name, are ignored.
    """
    tree = F.when(F.col("source").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("source")))
    own = docs.select(tree.alias("tree"), F.col("doc_id").alias("doc_id"), leaf.alias("node"), *[c.alias(n) for n, c in (also or {}).items()])
    numbered = Ordered(own, ["tree"], [F.col("doc_id").asc_nulls_first(), F.col("node")]).row_number("pos").result()
    rows = grow(written(numbered.withColumn("pos", F.col("pos") - 1), "merkle-leaves"), fan_in, stride)
    tops = rows.tops.withColumnRenamed("tree", "source_tree")
    ranked = Ordered(tops.withColumn("tree", F.lit("")), ["tree"], ["source_tree"]).row_number("pos").result()
    sources = grow(written(ranked.withColumn("pos", F.col("pos") - 1), "merkle-sources"), fan_in, stride)
    return Manifest(rows, sources)


def proof_digest(proof: Column) -> Column:
    """Digest of a proof's siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda p: p["siblings"]), ""), 256)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that `leaf` leads to by `proof`."""

    def step(digest: Column, p: Column) -> Column:
        cut = p["place"] * HEX
        return F.sha2(F.concat(F.substr(p["siblings"], F.lit(1), cut), digest, F.substr(p["siblings"], cut + 1)), 256)

    return F.aggregate(proof, leaf, step)


def op11_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    even = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.lit(False))
    tampered = F.when(even, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    manifest = build_manifest(docs, leaf_digest(*fields), {"shown": leaf_digest(*fields[:-1], tampered)})
    out = manifest.proofs(carry=("doc_id", "shown")).withColumn("folded_root", folded(F.col("shown"), F.col("proof")))
    return out.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root",
                      (F.col("folded_root") == F.col("root")).alias("verified"))


_BITS = "list_reduce([c::BIGINT, 1, 2, 3, 4, 5, 6, 7, 8], lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)"
_H = "sha256(concat({}))"
_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen({0}::VARCHAR)::VARCHAR || ':' || {0}::VARCHAR END"


def _leaf_sql(text: str) -> str:
    return _H.format(", ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars", text)))


ORACLE = f"""
WITH RECURSIVE crc_table AS (SELECT list({_BITS} ORDER BY c) AS t FROM (SELECT unnest(range(256)) AS c)),
rows_in AS (
  SELECT *, row_number() OVER () AS row_no,
    xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
      lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]))) AS crc
  FROM documents, crc_table),
leaves AS (
  SELECT row_no, doc_id, source, {_leaf_sql('text')} AS leaf,
    {_leaf_sql("(CASE WHEN crc % 2 = 0 THEN replace(text, chr(10), '') ELSE text END)")} AS shown FROM rows_in),
placed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
                  count(*) OVER (PARTITION BY source) AS n, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree FROM leaves),
low(tree, lvl, pos, node, n) AS (
  SELECT tree, 0, pos, leaf, n FROM placed
  UNION ALL
  SELECT tree, lvl + 1, pos // 3, sha256(string_agg(node, '' ORDER BY pos)), (n + 2) // 3 FROM low WHERE n > 1 GROUP BY tree, lvl, pos // 3, n),
subroots AS (SELECT tree, lvl AS height, node FROM low WHERE n = 1),
high(lvl, pos, node, n) AS (
  SELECT 0, tree, node, (SELECT count(*) FROM subroots) FROM subroots
  UNION ALL
  SELECT lvl + 1, pos // 3, sha256(string_agg(node, '' ORDER BY pos)), (n + 2) // 3 FROM high WHERE n > 1 GROUP BY lvl, pos // 3, n),
steps AS (
  SELECT p.row_no, l.lvl, coalesce(string_agg(l.node, '' ORDER BY l.pos) FILTER (l.pos < p.pos // pow(3, l.lvl)::BIGINT), '') AS before,
         coalesce(string_agg(l.node, '' ORDER BY l.pos) FILTER (l.pos > p.pos // pow(3, l.lvl)::BIGINT), '') AS behind
  FROM placed p JOIN low l ON l.tree = p.tree AND l.n > 1 AND l.pos // 3 = p.pos // pow(3, l.lvl + 1)::BIGINT GROUP BY ALL
  UNION ALL
  SELECT p.row_no, s.height + h.lvl, coalesce(string_agg(h.node, '' ORDER BY h.pos) FILTER (h.pos < p.tree // pow(3, h.lvl)::BIGINT), ''),
         coalesce(string_agg(h.node, '' ORDER BY h.pos) FILTER (h.pos > p.tree // pow(3, h.lvl)::BIGINT), '')
  FROM placed p JOIN subroots s ON s.tree = p.tree JOIN high h ON h.n > 1 AND h.pos // 3 = p.tree // pow(3, h.lvl + 1)::BIGINT
  GROUP BY p.row_no, s.height, h.lvl, p.tree),
walk(row_no, lvl, digest) AS (
  SELECT row_no, 0, shown FROM placed
  UNION ALL
  SELECT w.row_no, w.lvl + 1, sha256(s.before || w.digest || s.behind) FROM walk w JOIN steps s ON s.row_no = w.row_no AND s.lvl = w.lvl),
ends AS (SELECT row_no, arg_max(digest, lvl) AS folded_root FROM walk GROUP BY row_no),
proofs AS (SELECT row_no, sha256(string_agg(before || behind, '' ORDER BY lvl)) AS proof_sha256 FROM steps GROUP BY row_no)
SELECT p.doc_id, p.leaf, s.node AS subroot, r.node AS root, coalesce(q.proof_sha256, sha256('')) AS proof_sha256, e.folded_root, e.folded_root = r.node AS verified
FROM placed p JOIN subroots s ON s.tree = p.tree JOIN (SELECT node FROM high WHERE n = 1) r ON true JOIN ends e ON e.row_no = p.row_no LEFT JOIN proofs q ON q.row_no = p.row_no
"""

QUERIES = {"op11_merkle_manifest": (op11_merkle_manifest, ORACLE)}
