"""Merkle manifest of a dataset by nested rollups of rank digits.

Every row becomes a leaf digest; the leaves of a language form a binary tree in
id order, the trees' roots one more. A leaf's rank in its tree is cut into digits
of DIGIT bits: rows of equal upper digits are grouped into a run, runs into a
block, each grouping nesting what it takes away as an array of structs beside the
levels of digests above it. A block holds at most 2 ** (2 * DIGIT) leaves, and the
blocks' digests are the leaves of the next layer, however large the table. On
the way back the path to the root is handed to a block by grouping with it, and
transform and explode unfold the nested structs into proofs; nothing is joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadence.llm.common import saved
from cadence.operators.blocks import row_index

#: Bits of a rank digit (children of a run, runs of a block: 2 ** DIGIT), and digits of a block.
DIGIT = 5
BLOCK = 2 * DIGIT
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*texts) -> Column:
    """Lowercase hex sha256 of the texts one after another."""
    return F.sha2(F.concat(*texts), 256)


def field(c: Column) -> Column:
    """A value as the leaf has it: ``-`` if null, else its UTF-8 bytes, ``:`` and itself."""
    text = c.cast("string")
    return F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(**changed: Column) -> Column:
    return digest(*[field(changed.get(c, F.col(c))) for c in FIELDS])


def _levels(nodes: Column, n: Column, base: int) -> Column:
    """Digests of DIGIT levels above ``nodes``, these first: an array of arrays. A
    tree of ``n`` leaves ends where one node is left; from there levels repeat."""
    def above(levels: Column, j: Column) -> Column:
        last = F.element_at(levels, -1)
        pairs = F.transform(F.sequence(F.lit(0), F.floor((F.size(last) - 1) / 2).cast("int")),
                            lambda i: digest(F.get(last, 2 * i), F.coalesce(F.get(last, 2 * i + 1), F.lit(""))))
        return F.concat(levels, F.array(F.when(n > F.pow(F.lit(2.0), j + base), pairs).otherwise(last)))
    return F.aggregate(F.sequence(F.lit(0), F.lit(DIGIT - 1)), F.array(nodes), above)


def _top(levels: Column) -> Column:
    return F.get(F.element_at(levels, -1), F.lit(0))


def _steps(levels: Column, at: Column, n: Column, base: int) -> Column:
    """The siblings (left, right; both null where a node is alone) on the way up from child ``at``."""
    bits = F.when(n > 1, F.length(F.bin(n - 1))).otherwise(0)  # levels above the leaves of the whole tree
    count = F.greatest(F.lit(0), F.least(F.lit(DIGIT), bits - base))

    def step(level: Column, j: Column) -> Column:
        x = F.floor(at / F.pow(F.lit(2.0), j)).cast("int")
        return F.struct(F.when(x % 2 == 1, F.get(level, x - 1)).alias("left"), F.when(x % 2 == 0, F.get(level, x + 1)).alias("right"))
    return F.transform(F.slice(levels, F.lit(1), count), step)


def rolled(nodes: DataFrame, base: int, *kept: str) -> DataFrame:
    """Blocks (tree, n, block, runs, levels, hash) of ``nodes`` (tree, n, rank, hash
    and ``kept``): first the low digit of the rank is grouped away, then the next.
    All but the first grouping find their rows where they are."""
    def digit(k: int) -> Column:
        return F.shiftright("rank", k * DIGIT).bitwiseAND(F.lit(2**DIGIT - 1).cast("long")).cast("int")
    d = nodes.select("tree", "n", F.shiftright("rank", BLOCK).alias("block"), digit(1).alias("d1"),
                     F.struct(digit(0).alias("d0"), "hash", *kept).alias("kid")).repartition("tree", "block")
    runs = d.groupBy("tree", "n", "block", "d1").agg(F.array_sort(F.collect_list("kid")).alias("kids"))
    runs = runs.withColumn("up", _levels(F.col("kids.hash"), F.col("n"), base))
    run = F.struct("d1", _top(F.col("up")).alias("hash"), "kids", "up")
    blocks = runs.groupBy("tree", "n", "block").agg(F.array_sort(F.collect_list(run)).alias("runs"))
    blocks = blocks.withColumn("levels", _levels(F.col("runs.hash"), F.col("n"), base + DIGIT))
    return blocks.withColumn("hash", _top(F.col("levels")))


def unfolded(blocks: DataFrame, paths: DataFrame, base: int) -> DataFrame:
    """(tree, block, subroot, root, kid, path) for every child in ``blocks``: its
    siblings up to the root, from ``paths`` (tree, block, subroot, root, path)."""
    own, carried = ("n", "runs", "levels"), ("subroot", "root", "path")
    both = blocks.select("tree", "block", *own).unionByName(paths.select("tree", "block", *carried), allowMissingColumns=True)
    d = both.groupBy("tree", "block").agg(*[F.first(c, ignorenulls=True).alias(c) for c in (*own, *carried)])

    def kids(run: Column) -> Column:
        above = F.concat(_steps(F.col("levels"), run["d1"], F.col("n"), base + DIGIT), F.col("path"))
        return F.transform(run["kids"], lambda kid: F.struct(
            kid.alias("kid"), F.concat(_steps(run["up"], kid["d0"], F.col("n"), base), above).alias("path"),
            (run["d1"].cast("long") * 2**DIGIT + kid["d0"]).alias("at")))
    d = d.select("tree", "block", "subroot", "root", F.explode(F.flatten(F.transform("runs", kids))).alias("x"))
    return d.select("tree", (F.col("block") * 2**BLOCK + F.col("x.at")).alias("rank"), "subroot", "root", "x.kid", "x.path")


def _layers(nodes: DataFrame, *kept: str) -> list[DataFrame]:
    """Blocks of every layer, the lowest first; the last has one block a tree."""
    most = nodes.agg(F.max("n")).first()[0] or 0
    layers = [saved(rolled(nodes, 0, *kept), "blocks")]
    while most > 2 ** (BLOCK * len(layers)):
        upper = layers[-1].select("tree", "n", F.col("block").alias("rank"), "hash")
        layers.append(saved(rolled(upper, BLOCK * len(layers)), "blocks"))
    return layers


def _down(layers: list[DataFrame], paths: DataFrame) -> DataFrame:
    """Children of the lowest layer with their paths, from those of the trees (tree, subroot, root, path)."""
    paths = paths.withColumn("block", F.lit(0).cast("long"))
    for k in range(len(layers) - 1, -1, -1):
        out = unfolded(layers[k], paths, BLOCK * k)
        paths = out.withColumnRenamed("rank", "block")
    return out


PATH = "array<struct<left: string, right: string>>"


def manifest(leaves: DataFrame, *kept: str) -> DataFrame:
    """(tree, hash, ``kept``, subroot, root, path), a row for each row of ``leaves``
    (tree, order, hash and ``kept``).

    The leaves of a tree ascend by ``order``, null first; equal ones by digest, so
    that repeated rows are neighbours and ties don't depend on the partitioning.
    ``path`` holds a step for every level up to the root, with the sibling on
    its side or none. An empty table gives no rows."""
    nodes = row_index(leaves, ["tree"], ["order", "hash"], None, "rank", total="n")
    nodes = saved(nodes.select("tree", "n", (F.col("rank") - 1).alias("rank"), "hash", *kept), "leaves")
    layers = _layers(nodes, *kept)
    trees = layers[-1].select(F.lit("").alias("tree"), F.col("tree").alias("order"), "hash")
    trees = row_index(trees, ["tree"], ["order"], None, "rank", total="n")
    trees = saved(trees.select("tree", "n", (F.col("rank") - 1).alias("rank"), "hash", F.col("order").alias("name")), "trees")
    upper = _layers(trees, "name")
    root = upper[-1].select("tree", F.col("hash").alias("root"), F.lit(None).cast("string").alias("subroot"),
                            F.array().cast(PATH).alias("path"))
    top = _down(upper, root).select(F.col("kid.name").alias("tree"), F.col("kid.hash").alias("subroot"), "root", "path")
    return _down(layers, top).select("tree", "kid.hash", *[f"kid.{c}" for c in kept], "subroot", "root", "path")


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf's digest and its path lead to."""
    return F.aggregate(path, start, lambda h, s: digest(F.coalesce(s["left"], F.lit("")), h, F.coalesce(s["right"], F.lit(""))))


def proof(path: Column) -> Column:
    """The siblings of a path one after another, from the leaf up, left to right."""
    return F.concat_ws("", F.transform(path, lambda s: F.coalesce(s["left"], s["right"], F.lit(""))))


def document_manifest(docs: DataFrame, tampered: Column) -> DataFrame:
    """(doc_id, lang, leaf, subroot, root, path, candidate) for each row of ``docs``:
    one tree a language, and the leaf that the row would have with ``tampered`` for
    its n_chars.

    Null fields have digests of their own; a null language is a tree like any other
    and comes first, a null id is the first of its tree. Empty and very long texts
    are whole. Rows that agree in all fields have equal leaves. Columns other than
    the five of a leaf are not read."""
    leaves = docs.select("doc_id", F.col("lang").cast("string").alias("tree"), F.col("doc_id").alias("order"), leaf().alias("hash"),
                         leaf(n_chars=tampered).alias("candidate"))
    m = manifest(saved(leaves, "digests"), "doc_id", "candidate")
    return m.select("doc_id", F.col("tree").alias("lang"), F.col("hash").alias("leaf"), "subroot", "root", "path", "candidate")


def query(spark, sf_dir: str) -> DataFrame:
    """op13: all ``documents``; where 7 divides the crc32 of doc_id, one is added to n_chars."""
    marked = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False))
    m = document_manifest(spark.read.parquet(f"{sf_dir}/documents.parquet"),
                          F.when(marked, F.col("n_chars") + 1).otherwise(F.col("n_chars")))
    m = m.withColumn("folded_root", folded(F.col("candidate"), F.col("path")))
    return m.select("doc_id", "leaf", "subroot", "root", F.sha2(proof(F.col("path")), 256).alias("proof_sha256"),
                    "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _field(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN '-' ELSE CAST(octet_length(encode(CAST({c} AS VARCHAR))) AS VARCHAR) || ':' || CAST({c} AS VARCHAR) END"


_LEAF = " || ".join(map(_field, FIELDS))
_CRC = ("xor(list_reduce([4294967295] || flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), "
        "lambda ch: [CAST(ascii(ch) AS BIGINT), 0, 0, 0, 0, 0, 0, 0])), "
        "lambda c, x: xor(xor(c, x) >> 1, (xor(c, x) & 1) * 3988292384)), 4294967295)")

#: Levels by recursion, pair by pair; siblings by position; then the fold of every leaf, level by level.
SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, lang, sha256({_LEAF}) AS leaf,
    sha256({_LEAF.replace("n_chars", "m_chars")}) AS candidate
  FROM (SELECT *, CASE WHEN {_CRC} % 7 = 0 THEN n_chars + 1 ELSE n_chars END AS m_chars FROM documents)),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM d),
up AS (
  SELECT lang, 0 AS lvl, pos, leaf AS h, n FROM leaves
  UNION ALL
  SELECT lang, lvl + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2 FROM up WHERE n > 1 GROUP BY lang, lvl, pos // 2, n),
subroots AS (
  SELECT lang, h AS subroot, lvl AS height, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM up WHERE n = 1),
top AS (
  SELECT 0 AS lvl, pos, subroot AS h, n FROM subroots
  UNION ALL
  SELECT lvl + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2 FROM top WHERE n > 1 GROUP BY lvl, pos // 2, n),
own AS (
  SELECT l.doc_id, l.leaf, l.candidate, l.lang, l.pos, s.subroot, s.height, s.pos AS tpos FROM leaves l JOIN subroots s ON l.lang IS NOT DISTINCT FROM s.lang),
steps AS (
  SELECT o.lang, o.pos AS leaf_pos, u.lvl AS step, xor(o.pos >> u.lvl, 1) AS sib, u.h
  FROM own o JOIN up u ON u.lang IS NOT DISTINCT FROM o.lang AND u.lvl < o.height AND u.pos = xor(o.pos >> u.lvl, 1)
  UNION ALL
  SELECT o.lang, o.pos, o.height + t.lvl, xor(o.tpos >> t.lvl, 1), t.h
  FROM own o JOIN top t ON t.pos = xor(o.tpos >> t.lvl, 1) WHERE t.n > 1),
ends AS (SELECT h AS root, lvl AS theight FROM top WHERE n = 1),
fold AS (
  SELECT lang, pos, 0 AS step, height + theight AS height, candidate AS h FROM own, ends
  UNION ALL
  SELECT f.lang, f.pos, f.step + 1, f.height, sha256(CASE WHEN s.h IS NULL THEN f.h WHEN s.sib % 2 = 0 THEN s.h || f.h ELSE f.h || s.h END)
  FROM fold f LEFT JOIN steps s ON s.lang IS NOT DISTINCT FROM f.lang AND s.leaf_pos = f.pos AND s.step = f.step WHERE f.step < f.height),
proofs AS (SELECT lang, leaf_pos, string_agg(h, '' ORDER BY step) AS siblings FROM steps GROUP BY ALL)
SELECT o.doc_id, o.leaf, o.subroot, e.root, sha256(coalesce(p.siblings, '')) AS proof_sha256, f.h AS folded_root, f.h = e.root AS verified
FROM own o CROSS JOIN ends e
LEFT JOIN proofs p ON p.lang IS NOT DISTINCT FROM o.lang AND p.leaf_pos = o.pos
JOIN fold f ON f.lang IS NOT DISTINCT FROM o.lang AND f.pos = o.pos AND f.step = f.height"""
