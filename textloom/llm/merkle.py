"""Merkle manifest of a dataset (operator 11), in DataFrame functions only.

A row's leaf is the digest of its fields. Leaves of a group are placed by sorted partitions, so
that no group is sorted in one task. Levels are windows: partitioned by group and parent place, a
full-frame ``collect_list`` in order holds a run's digests, which are the parent's preimage and each
child's siblings at once; one row a run stays, and its digest is a node of the next level.
Proofs come down the same tables: a parent hands its path to its run, so each level
costs one join of a third as many rows as the one below.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .session import read_table, staged

FANOUT, FIELDS = 3, ("doc_id", "source", "lang", "n_chars", "text")
_STEP = "array<struct<before:string,after:string>>"


def digest(*fields: Column) -> Column:
    """Lowercase hex SHA-256 of fields: each ``-`` if null, else its bytes in UTF-8, ``:`` and itself."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``idx``, a row's place (from 0, by ``order``, nulls first) in its group ``grp``, and ``size``, the rows of the group.

    Rows are dealt out by ranges of (grp, order), so a group of any size lies in many partitions;
    a place is that in the partition plus the group's rows in earlier ones.
    """
    tie = "_scan"  # equal rows are dealt out, too
    ranged = rows.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange("grp", *order, tie).sortWithinPartitions("grp", *order, tie).drop(tie)
    sorted_rows = staged(ranged.withColumn("at", F.monotonically_increasing_id()), "sorted").withColumn("part", F.shiftrightunsigned("at", 33))
    runs = sorted_rows.groupBy("grp", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    group = Window.partitionBy("grp")
    before = F.sum("n").over(group.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    starts = runs.select("grp", "part", (before - F.col("first")).alias("shift"), F.sum("n").over(group).alias("size"))
    return sorted_rows.join(starts, ["grp", "part"]).withColumn("idx", F.col("at") + F.col("shift")).drop("at", "part", "shift")


class Forest:
    """The trees over rows (grp, idx, size, digest, and columns of ``load``), a tree a group."""

    def __init__(self, rows: DataFrame, load: list[str], fanout: int = FANOUT):
        self.load, self.levels = load, []
        parent, run = F.floor(F.col("idx") / fanout).cast("bigint"), Window.partitionBy("grp", "parent").orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        roots, nodes, most = [], rows, 0
        for level in range(1, 64):
            cells = F.collect_list(F.struct("digest", *(load if level == 1 else []))).over(run)
            kids = nodes.withColumn("parent", parent).withColumn("kids", cells)
            runs = staged(kids.filter(F.col("idx") % fanout == 0).select("grp", "parent", "size", "kids"), "runs")
            self.levels.append(runs)
            most = -(-most // fanout) if level > 1 else runs.agg(F.max("size")).first()[0] or 0  # nodes of the largest tree
            lone = F.lit(level == 1) & (F.col("size") == 1)  # a tree of one leaf is that leaf
            made = F.when(lone, F.col("kids")[0]["digest"]).otherwise(F.sha2(F.array_join("kids.digest", ""), 256))
            up = runs.select("grp", F.col("parent").alias("idx"), F.ceil(F.col("size") / fanout).cast("bigint").alias("size"), made.alias("digest"))
            roots.append(up.filter("size = 1").select("grp", "digest", F.lit(level).alias("height")))
            if most <= fanout:
                break
            nodes = up.filter("size > 1")
        self.fanout, self.roots = fanout, roots[0]
        for more in roots[1:]:
            self.roots = self.roots.unionByName(more)

    def proofs(self, tops: DataFrame) -> DataFrame:
        """The rows' ``digest`` and ``load`` with ``path``, the steps from a leaf up, and the other columns of ``tops``: (grp, height, path, ...), a row a tree."""
        keep = [c for c in tops.columns if c not in ("grp", "height", "path")]
        known = None
        for level in range(len(self.levels), 0, -1):
            own = tops.filter(F.col("height") == level).select("grp", F.lit(0).cast("bigint").alias("parent"), "path", *keep)
            if known is None:
                known = own
            else:
                known = known.select("grp", F.col("idx").alias("parent"), "path", *keep).unionByName(own)
            met = known.join(self.levels[level - 1], ["grp", "parent"])
            each = met.select("grp", "parent", "path", "size", *keep, F.col("kids.digest").alias("run"), F.posexplode("kids").alias("k", "kid"))
            step = F.struct(F.array_join(F.slice("run", 1, F.col("k")), "").alias("before"), F.array_join(F.slice("run", F.col("k") + 2, self.fanout), "").alias("after"))
            lone = F.lit(level == 1) & (F.col("size") == 1)
            path = F.when(lone, F.col("path")).otherwise(F.concat(F.array(step), "path"))
            out = [F.col("kid.digest").alias("digest"), *[F.col(f"kid.{c}").alias(c) for c in self.load]] if level == 1 else []
            known = each.select("grp", (F.col("parent") * self.fanout + F.col("k")).alias("idx"), path.alias("path"), *keep, *out)
        return known.drop("grp", "idx")


def manifest(rows: DataFrame, leaf: str, group: str, order: list[str], load: list[str], fanout: int = FANOUT) -> DataFrame:
    """(``load``, leaf, subroot, root, path) for each row: its digest, its group's, all groups', and the proof from one to the other.

    Within groups rows ascend by ``order``, nulls first; groups ascend by their UTF-8 bytes, the
    null group first. ``path`` has for each level the digests before and after the node, as one
    string each. An empty table has no root and gives no rows; ties of all of ``order`` keep any
    order, so include the leaf where that matters.
    """
    key = F.coalesce(F.concat(F.lit("+"), F.col(group).cast("string")), F.lit(""))
    made = rows.select(key.alias("grp"), F.col(leaf).alias("digest"), *[c for c in dict.fromkeys([*order, *load]) if c != leaf])
    leaves = placed(staged(made, "leaves"), [c if c != leaf else "digest" for c in order])  # texts are not read again to find the ranges
    trees = Forest(leaves, load, fanout)
    subroots = staged(trees.roots, "subroots")
    above = subroots.select(F.lit("").alias("grp"), "digest", F.col("grp").alias("name"), "height")
    top = Forest(placed(above, ["name"]), ["name", "height"], fanout)
    root = top.roots.select("grp", "height", F.array().cast(_STEP).alias("path"), F.col("digest").alias("root"))
    tops = staged(top.proofs(root).select(F.col("name").alias("grp"), "height", "path", F.col("digest").alias("subroot"), "root"), "tops")
    return trees.proofs(tops).select(*load, F.col("digest").alias("leaf"), "subroot", "root", "path")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its proof give."""
    return F.aggregate(path, leaf, lambda acc, step: F.sha2(F.concat(step["before"], acc, step["after"]), 256))


def proof_digest(path: Column) -> Column:
    return F.sha2(F.array_join(F.transform(path, lambda step: F.concat(step["before"], step["after"])), ""), 256)


def dataset_manifest(docs: DataFrame, tampered: dict[str, Column] | None = None, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", group_col: str = "source", fanout: int = FANOUT) -> DataFrame:
    """(doc_id, leaf, subroot, root, path, folded_root, verified) for each row of ``docs``.

    ``tampered`` puts other values in place of some fields before the proof is checked. Nulls may
    be in any field and are no value; ids come null first, then ascending, rows that share an id
    by their leaves; rows equal in all fields are leaves each. Texts may be empty or of any
    length and are read once, never shuffled; other columns are ignored.
    """
    kind = dict(docs.dtypes)[id_col]
    leaf, other = digest(*map(F.col, fields)), digest(*[(tampered or {}).get(f, F.col(f)) for f in fields])
    same = [t.eqNullSafe(F.col(f)) for f, t in (tampered or {}).items()]
    found = F.when(~reduce(and_, same), other) if same else F.lit(None).cast("string")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(group_col).alias("source"), leaf.alias("leaf"), found.alias("found"))
    made = manifest(rows, "leaf", "source", ["doc_id", "leaf"], ["doc_id", "found"], fanout)
    made = made.withColumn("folded_root", folded(F.coalesce("found", "leaf"), F.col("path")))
    return made.select(F.col("doc_id").cast(kind).alias("doc_id"), "leaf", "subroot", "root", "path", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf and proof; where 2 divides the id's CRC-32, what is checked has lost its line feeds."""
    hit = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    text = F.when(hit, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    made = dataset_manifest(read_table(spark, sf_dir, "documents"), {"text": text})
    return made.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", "verified")


#: The unsigned CRC-32 is taken byte by byte and bit by bit; levels of all sources and then of the subroots go up in one recursion each.
ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce('+' || source, '') AS grp, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
    lambda c, b: list_reduce(list_concat([xor(c, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, (x & 1) * 3988292384 + y))) & 1 = 1 AS hit,
  concat(coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'), coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-')) AS head,
  text, replace(text, chr(10), '') AS cut FROM documents),
l AS MATERIALIZED (SELECT doc_id, grp, sha256(concat(head, coalesce(strlen(text) || ':' || text, '-'))) AS leaf, CASE WHEN hit THEN sha256(concat(head, coalesce(strlen(cut) || ':' || cut, '-'))) END AS found,
  row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST) - 1 AS idx, count(*) OVER (PARTITION BY grp) AS size FROM d),
up AS (SELECT 0 AS lvl, grp, idx, size, leaf AS h FROM l
  UNION ALL SELECT min(lvl) + 1, grp, idx // 3, CAST(ceil(min(size) / 3.0) AS BIGINT), sha256(string_agg(h, '' ORDER BY idx)) FROM up WHERE size > 1 GROUP BY grp, idx // 3),
s AS MATERIALIZED (SELECT grp, lvl AS height, h AS subroot, row_number() OVER (ORDER BY encode(grp)) - 1 AS idx, count(*) OVER () AS size FROM up WHERE size = 1),
top AS (SELECT 0 AS lvl, idx, size, subroot AS h FROM s
  UNION ALL SELECT min(lvl) + 1, idx // 3, CAST(ceil(min(size) / 3.0) AS BIGINT), sha256(string_agg(h, '' ORDER BY idx)) FROM top WHERE size > 1 GROUP BY idx // 3),
steps AS MATERIALIZED (
  SELECT doc_id, u.lvl AS lvl, coalesce(string_agg(u.h, '' ORDER BY u.idx) FILTER (u.idx < l.idx // p), '') AS before, coalesce(string_agg(u.h, '' ORDER BY u.idx) FILTER (u.idx > l.idx // p), '') AS after
    FROM l, up u, (SELECT range AS e, CAST(pow(3, range) AS BIGINT) AS p FROM range(30)) WHERE u.grp = l.grp AND u.lvl = e AND u.size > 1 AND u.idx // 3 = l.idx // p // 3 GROUP BY doc_id, l.idx, p, u.lvl
  UNION ALL SELECT doc_id, s.height + u.lvl, coalesce(string_agg(u.h, '' ORDER BY u.idx) FILTER (u.idx < s.idx // p), ''), coalesce(string_agg(u.h, '' ORDER BY u.idx) FILTER (u.idx > s.idx // p), '')
    FROM l JOIN s USING (grp), top u, (SELECT range AS e, CAST(pow(3, range) AS BIGINT) AS p FROM range(30)) WHERE u.lvl = e AND u.size > 1 AND u.idx // 3 = s.idx // p // 3 GROUP BY doc_id, s.idx, s.height, p, u.lvl),
proof AS (SELECT doc_id, sha256(string_agg(before || after, '' ORDER BY lvl)) AS proof FROM steps GROUP BY doc_id),
fold AS (SELECT doc_id, 0 AS lvl, coalesce(found, leaf) AS h FROM l UNION ALL SELECT doc_id, fold.lvl + 1, sha256(before || h || after) FROM fold JOIN steps USING (doc_id, lvl))
SELECT l.doc_id, leaf, subroot, root, coalesce(proof, sha256('')) AS proof_sha256, folded AS folded_root, folded = root AS verified
FROM l JOIN s USING (grp) LEFT JOIN proof USING (doc_id) JOIN (SELECT doc_id, max_by(h, lvl) AS folded FROM fold GROUP BY doc_id) USING (doc_id), (SELECT h AS root FROM top WHERE size = 1)
"""
