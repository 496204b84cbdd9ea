"""Merkle manifests of a table: a digest for each row, for each group of rows and for the table, and a proof for each row.

H is SHA-256 in lowercase hex, of its inputs one after the other, digests as hex text.  The rows of a group are leaves in
ascending order; every ``fan`` consecutive nodes have their H as parent, up to one node, the group's subroot.  The
subroots, in the order of the groups, are the leaves of one more tree, whose last node is the root.

Levels are built from below and written.  Proofs are pushed from above: a level's nodes are joined to their children,
and each child puts its siblings before what its parent inherited.  A node is found by its group and number, so a group
that holds most of the rows is dealt out like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import oracle
from .names import fresh
from .scratch import dropped, saved

FAN = 3
#: The number of a partition is above these bits of monotonically_increasing_id.
_IN_PARTITION = 33


def joined(*parts: Column) -> Column:
    """H of text columns."""
    return F.sha2(F.concat(*parts), 256)


def leaf_digest(columns: list[Column]) -> Column:
    """H of the values in order: each as its number of UTF-8 bytes, a colon and itself (integers decimal), null as ``-``."""
    texts = [c.cast("string") for c in columns]
    return joined(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts))


def _numbered(rows: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """rows (written) with i, the place in its group from 0, and n, the group's number of rows; and what was written.

    Rows are cut into ranges of (group, order); counts of groups in ranges give each range's first place, so no task numbers
    a whole group.
    """
    keys = ["group", *order, "uid"]
    ranged = rows.withColumn("uid", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    kept = saved(ranged.drop("uid").withColumn("at", F.monotonically_increasing_id()), "merkle-leaves")
    kept_ranged = kept.withColumn("range", F.shiftright("at", _IN_PARTITION))
    counts = kept_ranged.groupBy("group", "range").agg(F.count("*").alias("m"), F.min("at").alias("first"))
    by_group = Window.partitionBy("group")  # one row for each range of a group
    before = F.coalesce(F.sum("m").over(by_group.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = counts.select(F.col("group").alias("g"), F.col("range").alias("r"), "first", before.alias("before"), F.sum("m").over(by_group).alias("n"))
    out = kept_ranged.join(places, F.col("group").eqNullSafe(F.col("g")) & (F.col("range") == F.col("r")))
    return out.withColumn("i", F.col("before") + F.col("at") - F.col("first")).drop("at", "range", "g", "r", "first", "before"), kept


class Forest:
    """The trees of all groups of rows.

    leaves: rows with i and n; levels: for level 1 and up, written tables of group, i, n (nodes of this level in the group),
    node and kids (the digests below it, in order).
    """

    def __init__(self, rows: DataFrame, order: list[str], node: str, fan: int = FAN):
        self.fan, self.node = fan, node
        self.leaves, self.kept = _numbered(rows, order)
        self.levels: list[DataFrame] = []
        most = self.leaves.agg(F.max("n")).first()[0] or 0
        below = self.leaves.select("group", "i", "n", F.col(node).alias("node"))
        while most > 1:
            runs = below.where("n > 1").groupBy("group", F.expr(f"i div {fan}").alias("i")).agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("i", "node"))).alias("kids"))
            kids = F.transform("kids", lambda x: x["node"])
            level = runs.select("group", "i", F.expr(f"(n + {fan - 1}) div {fan}").alias("n"), F.sha2(F.array_join(kids, ""), 256).alias("node"), kids.alias("kids"))
            self.levels.append(saved(level, "merkle-level"))
            below, most = self.levels[-1], -(-most // fan)

    def tops(self) -> DataFrame:
        """group and top, the last node of each group."""
        out = self.leaves.where("n = 1").select("group", F.col(self.node).alias("top"))
        for level in self.levels:
            out = out.union(level.where("n = 1").select("group", "node"))
        return out

    def proved(self, inherited: DataFrame, carried: list[str]) -> DataFrame:
        """leaves with carried columns and proof: siblings left and right of each node on the way up, from the leaf on.

        inherited: for each group `of`, proof (what follows the group's last node) and the carried columns.
        """
        here = lambda below: F.struct(F.array_join(F.slice("kids", 1, below), "").alias("left"), F.array_join(F.slice("kids", below + 2, self.fan), "").alias("right"))
        of_top = lambda df: df.where("n = 1").join(inherited, F.col("group").eqNullSafe(F.col("of"))).drop("of")
        same = lambda parent: F.col("group").eqNullSafe(F.col("g")) & (parent == F.col("p"))
        named = lambda df: df.select(F.col("group").alias("g"), F.col("i").alias("p"), "kids", "proof", *carried)
        above = None
        for level in reversed(self.levels):
            nodes = level.drop("node")
            found = of_top(nodes).select("group", "i", "kids", "proof", *carried)
            if above is not None:
                place = (F.col("i") % self.fan).cast("int")
                own = nodes.withColumnRenamed("kids", "own").join(named(above), same(F.expr(f"i div {self.fan}")))
                found = found.union(own.select("group", "i", F.col("own").alias("kids"), F.concat(F.array(here(place)), "proof").alias("proof"), *carried))
            above = found
        alone = of_top(self.leaves)
        if above is None:
            return alone
        place = (F.col("i") % self.fan).cast("int")
        below = self.leaves.join(named(above), same(F.expr(f"i div {self.fan}"))).withColumn("proof", F.concat(F.array(here(place)), "proof"))
        return below.select(*alone.columns).union(alone)


_PROOF = "array<struct<left:string,right:string>>"


def folded(leaf: Column, proof: Column) -> Column:
    """The digest at the end of the way that starts with a leaf's digest and passes the siblings of a proof."""
    return F.aggregate(proof, leaf, lambda node, x: joined(x["left"], node, x["right"]))


def proof_digest(proof: Column) -> Column:
    return F.sha2(F.array_join(F.transform(proof, lambda x: F.concat(x["left"], x["right"])), ""), 256)


def merkle_manifest(df: DataFrame, columns: list[str], id_col: str = "doc_id", group_col: str = "source", fan: int = FAN) -> DataFrame:
    """df's columns but those of `columns`, id_col and group_col only if named in neither; see below for the rest.

    Returns for each row of df: id and group (by df's names), leaf, subroot, root and proof (array of left and right), and
    any other column of df that `columns` does not name.  Columns of df named like these are left out of the result, unless
    they are the id or the group.

    Rows with equal ids are leaves of their own, in the order of their digests.  Null ids come first in their group, and
    the null group first of all.  Null and empty texts have digests of their own.  An empty df gives an empty result.
    """
    made = {"leaf", "subroot", "root", "proof"}
    rest = [c for c in df.columns if c not in (id_col, group_col) and c not in columns and c.lower() not in made]
    leaf, group, key, *more = fresh(df.limit(0).select(*(F.lit(1).alias(n) for n in ("group", "i", "n", "uid", "at"))), "leaf", "group_", "key", *(f"c{k}" for k in range(len(rest))))
    quoted = lambda c: F.col(f"`{c}`")
    rows = df.select(quoted(group_col).alias("group"), quoted(id_col).alias(key), leaf_digest([quoted(c) for c in columns]).alias(leaf), *(quoted(c).alias(m) for c, m in zip(rest, more, strict=True)))
    forest = Forest(rows, [key, leaf], leaf, fan)
    tops = saved(forest.tops().select(F.lit(0).alias("group"), F.col("group").alias("name"), "top"), "merkle-tops")
    trunk = Forest(tops, ["name"], "top", fan)
    last = trunk.tops().first()
    root = F.lit(last["top"] if last else None).cast("string")
    bases = trunk.proved(df.sparkSession.range(1).select(F.lit(0).alias("of"), F.array().cast(_PROOF).alias("proof")), [])
    bases = saved(bases.select(F.col("name").alias("of"), "proof", F.col("top").alias("subroot")), "merkle-bases")
    dropped(tops, trunk.kept, *trunk.levels)
    out = forest.proved(bases, ["subroot"])
    return out.select(F.col(key).alias(id_col), F.col("group").alias(group_col), *(F.col(m).alias(c) for c, m in zip(rest, more, strict=True)), leaf, "subroot", root.alias("root"), "proof")


COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf, subroot, root and proof; and whether a changed copy of it still folds to the root.

    The copy of a document whose id has an even crc32 lacks its line feeds; a null text stays, and so does a null id's.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    changed = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    text = F.when(changed, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    tampered = leaf_digest([F.col(c) if c != "text" else text for c in COLUMNS])
    out = merkle_manifest(docs.withColumn("found", tampered), COLUMNS)
    out = out.withColumns({"folded_root": folded(F.col("found"), F.col("proof")), "proof_sha256": proof_digest(F.col("proof"))})
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


_SIDE = "coalesce(string_agg(node, '' ORDER BY i) FILTER (WHERE i {} pos), '')"
ORACLE_SQL = f"""
WITH RECURSIVE crc AS (
  SELECT doc_id, {oracle.crc32('doc_id::VARCHAR')} AS crc
  FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL)
), d AS (
  SELECT doc_id, source, text, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
    || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
    CASE WHEN crc % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS other FROM documents LEFT JOIN crc USING (doc_id)
), leaf AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n, row_number() OVER () AS row FROM (
    SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(other) || ':' || other, '-')) AS found FROM d)
), lists AS (
  SELECT source, 0 AS l, list(leaf ORDER BY i) AS h FROM leaf GROUP BY source
  UNION ALL SELECT source, l + 1, [sha256(array_to_string(h[3 * j + 1 : 3 * j + 3], '')) FOR j IN range((len(h) + 2) // 3)] FROM lists WHERE len(h) > 1
), top AS (
  SELECT source, l AS height, h[1] AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM lists WHERE len(h) = 1
), trunk AS (
  SELECT 0 AS l, list(subroot ORDER BY i) AS h FROM top
  UNION ALL SELECT l + 1, [sha256(array_to_string(h[3 * j + 1 : 3 * j + 3], '')) FOR j IN range((len(h) + 2) // 3)] FROM trunk WHERE len(h) > 1
), nodes AS (
  SELECT source, l, unnest(h) AS node, generate_subscripts(h, 1) - 1 AS i, false AS up FROM lists WHERE len(h) > 1
  UNION ALL SELECT NULL, l, unnest(h), generate_subscripts(h, 1) - 1, true FROM trunk WHERE len(h) > 1
), way AS (
  SELECT row, source, l, i // (3 ** l)::BIGINT AS pos, false AS up, l AS step FROM leaf JOIN (SELECT source, l FROM lists WHERE len(h) > 1) USING (source)
  UNION ALL SELECT row, leaf.source, l, leaf.i // (3 ** l)::BIGINT, false, l FROM leaf, (SELECT l FROM lists WHERE len(h) > 1 AND source IS NULL) x WHERE leaf.source IS NULL
  UNION ALL SELECT row, NULL, l, t.i // (3 ** l)::BIGINT, true, t.height + l FROM leaf JOIN top t ON leaf.source IS NOT DISTINCT FROM t.source, (SELECT l FROM trunk WHERE len(h) > 1) x
), side AS (
  SELECT row, step, {_SIDE.format('<')} AS l, {_SIDE.format('>')} AS r
  FROM way JOIN nodes ON way.l = nodes.l AND way.up = nodes.up AND way.source IS NOT DISTINCT FROM nodes.source AND way.pos // 3 = nodes.i // 3 GROUP BY row, step
), fold AS (
  SELECT row, 0::BIGINT AS step, found AS node FROM leaf
  UNION ALL SELECT row, step + 1, sha256(side.l || node || side.r) FROM fold JOIN side USING (row, step)
), last AS (SELECT row, arg_max(node, step) AS folded_root FROM fold GROUP BY row
), proof AS (SELECT row, string_agg(l || r, '' ORDER BY step) AS proof FROM side GROUP BY row)
SELECT doc_id, leaf, subroot, (SELECT h[1] FROM trunk WHERE len(h) = 1) AS root, sha256(coalesce(proof, '')) AS proof_sha256, folded_root,
  folded_root = (SELECT h[1] FROM trunk WHERE len(h) = 1) AS verified
FROM leaf JOIN top t ON leaf.source IS NOT DISTINCT FROM t.source JOIN last USING (row) LEFT JOIN proof USING (row)
"""
