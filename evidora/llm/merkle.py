"""Merkle manifest of a table by butterfly exchange.

Every row is a leaf. The leaves of a source, ordered by id, form a tree in which runs of `FANOUT` nodes hash to their parent;
the roots of the sources form a tree of the same kind above them. A block is an aligned subtree of `BLOCK` leaves. Blocks
hash their own subtrees; then, round by round, the blocks that differ in one digit of their number (to the base `FANOUT`)
swap the roots they stand for, and each of them hashes the common ancestor again. After a round a block stands for a subtree
`FANOUT` times as large and knows the siblings on its way up, so no pass back down the tree is needed. Sources swap their roots
in the same way.

A round is one exchange of one narrow row per block (and of stand-ins for the missing partners at a tree's right edge), dealt by
tree and digits: at most `FANOUT` rows meet, however many leaves a source has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidora.llm import text as tx
from evidora.llm.components import remove, stored

FANOUT = 16
#: Levels of the tree inside a block.
LEVELS = 2
BLOCK = FANOUT**LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: Column) -> Column:
    """Lowercase hexadecimal SHA-256 of the parts one after the other."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def encoded(value: Column) -> Column:
    """A value with its length in bytes before it, so that no two lists of values read alike; `-` for null."""
    plain = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(plain).cast("string"), F.lit(":"), plain), F.lit("-"))


def leaf(*values: Column) -> Column:
    return digest(*(encoded(v) for v in values))


def folded(path: Column, start: Column) -> Column:
    """The root that a leaf gives with the siblings of a path."""
    return F.aggregate(path, start, lambda node, side: digest(side["left"], node, side["right"]))


def proof_digest(path: Column) -> Column:
    """Digest of all siblings of a path, from the leaf up and from left to right."""
    return digest(F.array_join(F.transform(path, lambda side: F.concat(side["left"], side["right"])), ""))


def _whole(value: Column, by: int | Column) -> Column:
    return F.floor(value / by).cast("long")


def _joined(nodes: Column) -> Column:
    return F.array_join(nodes, "")


def _parents(nodes: Column) -> Column:
    """Hashes of runs of nodes."""
    runs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / FANOUT).cast("int"))
    return F.transform(runs, lambda run: digest(_joined(F.slice(nodes, run * FANOUT + 1, FANOUT))))


def _sides(nodes: Column, at: Column) -> Column:
    """The other nodes of the run that holds number `at`, before and behind it."""
    own = at % FANOUT
    left, right = F.slice(nodes, at - own + 1, own), F.slice(nodes, at + 2, FANOUT - 1 - own)
    return F.struct(_joined(left).alias("left"), _joined(right).alias("right"))


def _numbered(rows: DataFrame, *order: str) -> DataFrame:
    """The rows with `rank` in their `tree` by the order, and `leaves`, the number of rows of the tree.

    Rows are dealt by ranges of tree and order, so a large tree lies in many parts; the numbers of rows of the parts, one row per
    part and tree, say how many rows of the tree lie before a part.
    """
    keys = ["tree", *order]
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    ordered, _ = stored(dealt.withColumn("at", F.monotonically_increasing_id()), "ordered")
    ordered = ordered.withColumn("part", F.shiftright("at", 33))
    parts = ordered.groupBy("tree", "part").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(
        "tree",
        "part",
        (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"),
        F.sum("n").over(Window.partitionBy("tree")).alias("leaves"),
    )
    parts, _ = stored(parts, "parts")
    numbered = ordered.join(parts, ["tree", "part"])
    return numbered.withColumn("rank", F.col("at") + F.col("shift")).drop("at", "part", "shift")


def _swapped(state: DataFrame, most: int) -> DataFrame:
    """All rounds among the blocks of each tree: `node` becomes the tree's root, `path` grows by one entry a level.

    `state` has `tree`, `block` (numbers from 0), `blocks` (how many the tree has), `node`, `path`; `most` is the largest `blocks`.
    A last subtree with fewer blocks than the others lacks partners for some of theirs; its blocks stand in for those in turn.
    """
    width = 1
    while width < most:
        group, low = _whole(F.col("block"), width), F.col("block") % width
        last = _whole(F.col("blocks") - 1, width)
        members = F.col("blocks") - last * width
        ragged = (group == last) & (group % FANOUT > 0) & (members < width)
        places = F.when(ragged, F.sequence(low, F.lit(width - 1).cast("long"), members)).otherwise(F.array(low))
        sent = state.select(
            "*",
            (group % FANOUT).alias("digit"),
            _whole(group, FANOUT).alias("high"),
            low.alias("low"),
            F.explode(places).alias("place"),
        )
        own = F.col("place") == F.col("low")
        sent = sent.withColumn("path", F.when(own, F.col("path")))
        group = Window.partitionBy("tree", "high", "place")
        met = sent.withColumn("met", F.sort_array(F.collect_list(F.struct("digit", "node")).over(group))).where(own)

        def nodes(which, met=F.col("met")) -> Column:
            return F.array_join(F.transform(F.filter(met, which), lambda x: x["node"]), "")

        left, right = nodes(lambda x: x["digit"] < F.col("digit")), nodes(lambda x: x["digit"] > F.col("digit"))
        met = met.withColumn("side", F.struct(left.alias("left"), right.alias("right")))
        more = F.col("blocks") > width
        state = met.select(
            "tree",
            "block",
            "blocks",
            F.when(more, digest("side.left", "node", "side.right")).otherwise(F.col("node")).alias("node"),
            F.when(more, F.concat("path", F.array("side"))).otherwise(F.col("path")).alias("path"),
        )
        width *= FANOUT
    return state


def manifest(
    docs: DataFrame,
    *,
    fields: tuple[str, ...] = FIELDS,
    id_col: str = "doc_id",
    source_col: str = "source",
    carry: dict[str, Column] | None = None,
) -> DataFrame:
    """One row per input row: `doc_id` (long), `source`, `leaf`, `subroot` (of its source), `root`, `path` (array of
    `{left, right}`: the sibling digests before and behind, from the leaf's level up), then the columns of `carry`.

    A leaf hashes `fields` in order. Sources are ordered by code point, null first, as a source of its own; leaves of a source by
    id (null first), then by leaf, so rows with one id have a fixed order and rows that repeat in whole may change places only
    with each other. Null and empty values hash differently. A level with one node left ends a tree: a source of one row has
    its leaf as subroot, and a table of one source its subroot as root. An empty table gives an empty result. Columns besides
    those named are not looked at; `carry` may be computed from any.
    """
    extra = carry or {}
    source = F.col(source_col).cast("string")
    made = docs.select(
        F.when(source.isNull(), "").otherwise(F.concat(F.lit("="), source)).alias("tree"),
        F.col(id_col).cast("long").alias("doc_id"),
        leaf(*(F.col(c) for c in fields)).alias("leaf"),
        # Tells rows apart that repeat in whole, so that many of them don't have to lie in one range.
        F.xxhash64(F.monotonically_increasing_id()).alias("salt"),
        F.struct(F.lit(0).alias("none"), *(c.alias(name) for name, c in extra.items())).alias("carried"),
    )
    made, path = stored(made, "leaves")
    rows = _numbered(made, "doc_id", "leaf", "salt").withColumn("block", _whole(F.col("rank"), BLOCK))
    packed = rows.groupBy("tree", "block").agg(
        F.first("leaves").alias("leaves"),
        F.sort_array(F.collect_list(F.struct("rank", "doc_id", "leaf", "carried"))).alias("rows"),
    )
    leaves = F.transform("rows", lambda row: row["leaf"])
    levels = [leaves]
    for level in range(LEVELS):
        more = F.col("leaves") > FANOUT**level
        levels.append(F.when(more, _parents(levels[-1])).otherwise(levels[-1]))
    packed, _ = stored(packed.withColumn("node", levels[-1][0]), "blocks")
    remove(docs.sparkSession, path)

    no_path = F.array().cast("array<struct<left: string, right: string>>")
    blocks = F.floor((F.col("leaves") - 1) / BLOCK).cast("long") + 1
    state = packed.select("tree", "block", blocks.alias("blocks"), "node", no_path.alias("path"))
    most = state.agg(F.max("blocks")).first()[0] or 0
    inner, _ = stored(_swapped(state, most), "paths")
    tops = inner.where("block = 0").select(F.lit("").alias("tree"), F.col("tree").alias("source"), "node")
    tops = _numbered(tops, "source").select(
        "source", "tree", F.col("rank").alias("block"), F.col("leaves").alias("blocks"), "node", no_path.alias("path")
    )
    tops, _ = stored(tops, "sources")
    sources = tops.count()
    roots = _swapped(tops.drop("source"), sources).select("block", F.col("node").alias("root"), F.col("path").alias("top"))
    roots = tops.join(roots, "block").select(F.col("source").alias("tree"), "root", "top")
    # A source with many blocks is spread over as many keys as their square root.
    keys = F.ceil(F.sqrt("blocks")).cast("long")
    spread = inner.where("block = 0").select("tree", F.explode(F.sequence(F.lit(0), keys - 1)).alias("key"))
    spread = spread.join(roots, "tree")
    inner = inner.withColumn("key", F.col("block") % keys).join(spread, ["tree", "key"])
    inner = inner.select(
        "tree", "block", F.col("node").alias("subroot"), "root", F.concat("path", "top").alias("upper")
    )
    whole = packed.drop("node").join(inner, ["tree", "block"])
    whole = whole.withColumn("level0", leaves)
    for level in range(1, LEVELS):
        more = F.col("leaves") > FANOUT ** (level - 1)
        below = F.col(f"level{level - 1}")
        whole = whole.withColumn(f"level{level}", F.when(more, _parents(below)).otherwise(below))

    def row(one: Column, at: Column) -> Column:
        own = [
            F.when(
                F.col("leaves") > FANOUT**level,
                F.array(_sides(F.col(f"level{level}"), F.floor(at / FANOUT**level).cast("int"))),
            ).otherwise(no_path)
            for level in range(LEVELS)
        ]
        return F.struct(
            one["doc_id"].alias("doc_id"),
            one["leaf"].alias("leaf"),
            F.concat(*own, F.col("upper")).alias("path"),
            one["carried"].alias("carried"),
        )

    each = whole.select("tree", "subroot", "root", F.inline(F.transform("rows", row)))
    return each.select(
        "doc_id",
        F.when(F.col("tree") != "", F.substr("tree", F.lit(2))).alias("source"),
        "leaf",
        "subroot",
        "root",
        "path",
        *(F.col("carried")[name].alias(name) for name in extra),
    )


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves, roots and proof digests of all documents, and what the proofs say about tampered texts."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    struck = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    held = leaf(*(tx.lower_ascii(F.col("text")) if c == "text" else F.col(c) for c in FIELDS))
    rows = manifest(docs, carry={"held": F.when(struck, held)})
    rows = rows.withColumn("folded_root", folded(F.col("path"), F.coalesce("held", "leaf")))
    return rows.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        proof_digest(F.col("path")).alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def _field(value: str) -> str:
    return f"coalesce(CAST(strlen(CAST({value} AS VARCHAR)) AS VARCHAR) || ':' || CAST({value} AS VARCHAR), '-')"


def _leaf_sql(text: str) -> str:
    return f"sha256({' || '.join(_field(c) for c in (*FIELDS[:-1], text))})"


OP11_SQL = rf"""
WITH RECURSIVE sources AS (
  SELECT source, row_number() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS s FROM (SELECT DISTINCT source FROM documents)
), hashed AS (
  SELECT doc_id, source, {_leaf_sql("text")} AS leaf,
    {_leaf_sql("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS struck,
    xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, len(CAST(doc_id AS VARCHAR)) + 1),
        lambda p: CAST(ascii(CAST(doc_id AS VARCHAR)[p]) AS BIGINT))),
      lambda c, b: list_reduce(list_prepend(xor(c, b), CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[])),
        lambda a, z: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END)), 4294967295) AS crc
  FROM documents
), leaves AS (
  SELECT row_number() OVER () AS d, doc_id, s, leaf, CASE WHEN crc % 5 = 0 THEN struck ELSE leaf END AS held,
    row_number() OVER (PARTITION BY s ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i
  FROM hashed h JOIN sources q ON h.source IS NOT DISTINCT FROM q.source
), nodes AS (
  SELECT s, 0 AS level, i, leaf AS h FROM leaves
  UNION ALL
  SELECT s, level + 1, i // 16, sha256(string_agg(h, '' ORDER BY i))
  FROM (SELECT *, count(*) OVER (PARTITION BY s) AS n FROM nodes) WHERE n > 1 GROUP BY s, level, i // 16
), subroots AS (
  SELECT s, arg_max(h, level) AS subroot, max(level) AS high FROM nodes GROUP BY s
), tops AS (
  SELECT 0 AS level, s AS i, subroot AS h FROM subroots
  UNION ALL
  SELECT level + 1, i // 16, sha256(string_agg(h, '' ORDER BY i))
  FROM (SELECT *, count(*) OVER () AS n FROM tops) WHERE n > 1 GROUP BY level, i // 16
), roots AS (
  SELECT arg_max(h, level) AS root, max(level) AS high FROM tops
), inner_fold AS (
  SELECT d, s, 0 AS level, i, held AS h, '' AS seen FROM leaves
  UNION ALL
  SELECT f.d, f.s, f.level + 1, f.i // 16, sha256(string_agg(CASE WHEN n.i = f.i THEN f.h ELSE n.h END, '' ORDER BY n.i)),
    f.seen || coalesce(string_agg(n.h, '' ORDER BY n.i) FILTER (WHERE n.i <> f.i), '')
  FROM inner_fold f JOIN nodes n ON n.s = f.s AND n.level = f.level AND n.i // 16 = f.i // 16
    JOIN subroots r ON r.s = f.s AND f.level < r.high
  GROUP BY f.d, f.s, f.level, f.i, f.h, f.seen
), outer_fold AS (
  SELECT f.d, 0 AS level, f.s AS i, f.h, f.seen FROM inner_fold f JOIN subroots r ON r.s = f.s AND r.high = f.level
  UNION ALL
  SELECT f.d, f.level + 1, f.i // 16, sha256(string_agg(CASE WHEN n.i = f.i THEN f.h ELSE n.h END, '' ORDER BY n.i)),
    f.seen || coalesce(string_agg(n.h, '' ORDER BY n.i) FILTER (WHERE n.i <> f.i), '')
  FROM outer_fold f JOIN tops n ON n.level = f.level AND n.i // 16 = f.i // 16 JOIN roots r ON f.level < r.high
  GROUP BY f.d, f.level, f.i, f.h, f.seen
)
SELECT l.doc_id, l.leaf, q.subroot, r.root, sha256(f.seen) AS proof_sha256, f.h AS folded_root, f.h = r.root AS verified
FROM leaves l JOIN subroots q ON q.s = l.s CROSS JOIN roots r JOIN outer_fold f ON f.d = l.d AND f.level = r.high
"""
