"""N-gram Jaccard self-join with Bayesian candidate pruning (operator 10).

Texts are sets of word 5-grams (a text of one to four words is one shingle). Texts with one
set form one node, whatever their ids, so copies are never compared. Nodes that agree on a band of five MinHash
values are candidates; a bucket of candidates is cut into blocks, and a task gets one pair of
blocks with the nodes' signatures. It compares pairs 16 values at a time and drops a pair as
soon as the posterior probability that its similarity reaches the threshold (uniform prior,
binomial agreement) falls below the tolerance. Survivors are verified on their shingle sets.
A node's surviving partners in a task are one row, and only counts and a spanning forest leave
verification, never all pairs of a group; components of the forests are the classes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .repeats import LAST, document
from .session import fresh, read_table, staged
from .vectext import Words, mix, signed, slabs, utf8

SHINGLE, THRESHOLD, TOLERANCE = 5, 0.8, 1e-4
BANDS, ROWS, STEP, VALUES = 25, 5, 16, 128
#: Nodes, and shingles of all its nodes, of a block on average; a task holds the signatures, or the shingles of survivors, of two blocks.
BLOCK, WEIGHT = 512, 1 << 23
_random = np.random.default_rng(11)
_A = _random.integers(0, 1 << 31, VALUES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _random.integers(0, 1 << 32, VALUES, dtype=np.uint32)


def shingle_hashes(data: np.ndarray, offs: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a slab's shingles in the order of rows, and each row's first (one more at the end)."""
    words = Words(data, offs)
    hashes = words.hashes()
    at, found = words.windows(hashes, size)
    row = words.row[at]
    count = np.diff(words.first)
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        whole = np.array([int(mix(np.array([sum(int(h) * pow(0x9E3779B97F4A7C15, k, 1 << 64) for k, h in enumerate(hashes[words.first[r] : words.first[r + 1]])) % (1 << 64)], np.uint64))[0]) for r in short], np.uint64)
        row, found = np.append(row, short), np.append(found, whole)
        order = np.argsort(row, kind="stable")
        row, found = row[order], found[order]
    return found, np.searchsorted(row, np.arange(len(offs)))


def minhash(shingles: np.ndarray) -> np.ndarray:
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    best = np.full(VALUES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(low), 2048):
        np.minimum(best, (low[i : i + 2048, None] * _A + _B).min(axis=0), out=best)
    return best


def least_agreement(threshold: float, tolerance: float) -> list[int]:
    """For 16, 32, ... compared values the least agreement at which P(similarity >= threshold) is still ``tolerance``."""
    out = []
    for n in range(STEP, VALUES + 1, STEP):
        total, m = 0.0, -1
        while total < tolerance:  # P(J >= t | m of n agree) = P(Binomial(n + 1, t) <= m)
            m += 1
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return out


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offs = utf8(batch.column(2))
        for i, j in slabs(offs):
            found, first = shingle_hashes(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
            f0, f1, n, sig = [], [], [], []
            for a, b in zip(first[:-1], first[1:], strict=True):
                own = np.unique(found[a:b])
                n.append(len(own))
                f0.append(mix(own).sum(dtype=np.uint64))
                f1.append(mix(own ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64))
                sig.append(minhash(own).tobytes() if len(own) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(signed(np.array(f0, np.uint64))), pa.array(signed(np.array(f1, np.uint64))), pa.array(n, pa.int64()), pa.array(sig, pa.binary())], names=["doc", "row", "f0", "f1", "n", "sig"])


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    salt = mix(np.arange(1, BANDS + 1, dtype=np.uint64))
    for batch in batches:
        if not batch.num_rows:
            continue
        sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(-1, VALUES)[:, : BANDS * ROWS].reshape(-1, BANDS, ROWS).astype(np.uint64)
        key = salt[None, :].repeat(len(sig), 0)
        for r in range(ROWS):
            key = mix(key ^ sig[:, :, r])
        node, n = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 2))
        band = np.tile(np.arange(BANDS, dtype=np.int32), len(sig))
        yield pa.RecordBatch.from_arrays([pa.array(signed(key.ravel())), pa.array(band), pa.array(np.repeat(node, BANDS)), pa.array(np.repeat(n, BANDS))], names=["bucket", "band", "node", "n"])


def _pairs(group: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs inside each run of equal values of ``group``, some at a time."""
    n = len(group)
    for d in range(1, n):
        a = np.flatnonzero(group[:-d] == group[d:])
        if not len(a):
            return
        for i in range(0, len(a), 1 << 15):
            yield a[i : i + (1 << 15)], a[i : i + (1 << 15)] + d


def _pruned(batches: Iterator[pa.RecordBatch], least: list[int], threshold: float) -> Iterator[pa.RecordBatch]:
    """Of tasks' members (in the order of tasks) those in pairs that neither their sizes nor the posterior rules out, with their later partners."""
    rest: pa.Table | None = None

    def settle(table: pa.Table) -> Iterator[pa.RecordBatch]:
        bucket, i, j, block, band, node, mult, n = (table.column(c).to_numpy() for c in ("bucket", "i", "j", "block", "band", "node", "mult", "n"))
        sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint32).reshape(-1, VALUES)
        group = np.cumsum(np.append(True, (bucket[1:] != bucket[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])))
        out = []
        for a, b in _pairs(group):
            keep = (np.minimum(n[a], n[b]) >= threshold * np.maximum(n[a], n[b]) * (1 - 1e-12)) & ((i[a] == j[a]) | (block[a] != block[b]))
            a, b = a[keep], b[keep]
            agree = np.zeros(len(a), np.int64)
            for k, need in enumerate(least):
                s = slice(k * STEP, (k + 1) * STEP)
                agree += (sig[a, s] == sig[b, s]).sum(axis=1)
                keep = agree >= need
                a, b, agree = a[keep], b[keep], agree[keep]
            if len(a):
                both = (sig[a, : BANDS * ROWS] == sig[b, : BANDS * ROWS]).reshape(-1, BANDS, ROWS).all(axis=2)
                keep = both.argmax(axis=1) == band[a]  # a pair counts in its first band only
                out.append((a[keep], b[keep]))
        if out:
            a, b = (np.concatenate(x) for x in zip(*out, strict=True))
            order = np.argsort(a, kind="stable")
            a, b = a[order], b[order]
            own = np.unique(np.concatenate([a, b]))
            partners = pa.ListArray.from_arrays(pa.array(np.append(np.searchsorted(a, own), len(a)).astype(np.int32)), pa.array(node[b]))
            task = signed(mix(mix(bucket[own].view(np.uint64)) + (i[own].astype(np.uint64) << np.uint64(32)) + j[own].astype(np.uint64)))
            yield pa.RecordBatch.from_arrays([pa.array(task), pa.array(node[own]), pa.array(mult[own]), partners], names=["task", "node", "mult", "partners"])

    for batch in batches:
        table = pa.Table.from_batches([batch])
        if rest is not None:
            table = pa.concat_tables([rest, table])
        last = [table.column(c)[-1].as_py() for c in ("bucket", "i", "j")] if table.num_rows else None
        if last is None:
            continue
        bucket, i, j = (table.column(c).to_numpy() for c in ("bucket", "i", "j"))
        cut = int(np.argmax((bucket == last[0]) & (i == last[1]) & (j == last[2])))
        if cut:
            yield from settle(table.slice(0, cut).combine_chunks())
        rest = table.slice(cut)
    if rest is not None and rest.num_rows:
        yield from settle(rest.combine_chunks())


def _shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, shingles) of rows (node, text); rows of a node that follow each other count once."""
    last = None
    for batch in batches:
        data, offs = utf8(batch.column(1))
        nodes, out = batch.column(0).to_pylist(), []
        for i, j in slabs(offs):
            found, first = shingle_hashes(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
            for k, a, b in zip(nodes[i:j], first[:-1], first[1:], strict=True):
                if k != last:
                    out.append((k, np.unique(found[a:b]).tobytes()))
                last = k
        node, sets = zip(*out, strict=True) if out else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(sets, pa.binary())], names=["node", "shingles"])


def _settled(rows: list[tuple[int, int, list[int], bytes]], threshold: float) -> list[tuple[int, int, int, int]]:
    """Links of a task's nodes (0, node, node, documents) and a spanning forest (1, node, root, 0), for (node, mult, partners, shingles)."""
    at = {node: k for k, (node, *_) in enumerate(rows)}
    sets = [np.frombuffer(x[3], np.uint64) for x in rows]
    size = np.array([len(x) for x in sets])
    known, local = np.unique(np.concatenate(sets), return_inverse=True)
    first = np.append(0, np.cumsum(size))
    ids = [local[first[k] : first[k + 1]] for k in range(len(rows))]
    mult, links, root = np.array([x[1] for x in rows]), np.zeros(len(rows), np.int64), list(range(len(rows)))

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    mine = np.zeros(len(known), bool)
    for k, (_, _, partners, _) in enumerate(rows):
        if not partners:
            continue
        other = np.array([at[p] for p in partners])
        mine[ids[k]] = True
        begin = np.append(0, np.cumsum(size[other]))[:-1]
        shared = np.add.reduceat(mine[np.concatenate([ids[x] for x in other])].astype(np.int64), begin)
        mine[ids[k]] = False
        near = other[shared >= threshold * (size[k] + size[other] - shared) * (1 - 1e-12)]
        links[k] += mult[near].sum()
        np.add.at(links, near, mult[k])
        for x in near.tolist():
            x, y = top(x), top(k)
            root[max(x, y)] = min(x, y)
    nodes = [x[0] for x in rows]
    return [(0, nodes[k], nodes[k], int(n)) for k, n in enumerate(links) if n] + [(1, nodes[k], nodes[top(k)], 0) for k in range(len(rows)) if top(k) != k]


def _verified(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """The links and forests of all tasks, whose rows come together."""
    task, held, out = None, [], []

    def made() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) if out else [(), (), (), ()]
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int8()), *(pa.array(c, pa.int64()) for c in columns[1:])], names=["kind", "a", "b", "n"])

    for batch in batches:
        for t, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if t != task and held:
                out.extend(_settled(held, threshold))
                held = []
            task = t
            held.append(tuple(row))
        yield made()
    if held:
        out.extend(_settled(held, threshold))
    yield made()


def row_classes(docs: DataFrame, threshold: float, tolerance: float, id_col: str, text_col: str) -> DataFrame:
    """(doc, row, n, class_doc, class_row, links) of every row: what tells it apart (``repeats.document``), its shingles, the first document of its class and its links."""
    if not 0.5 <= threshold <= 1:
        raise ValueError("threshold must be from 0.5 to 1")
    doc, row = document(id_col, text_col)
    texts = docs.select(doc.alias("doc"), row.alias("row"), F.col(text_col).cast("string").alias("text"))
    made = staged(texts.mapInArrow(_signatures, "doc bigint, row bigint, f0 bigint, f1 bigint, n bigint, sig binary"), "signatures")
    real = made.filter("n > 0")
    # a node for each set of shingles, with its first document; numbered once, as it is written
    grouped = real.groupBy("f0", "f1").agg(F.min(F.struct("doc", "row")).alias("first"), F.count(F.lit(1)).alias("mult"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    nodes = staged(grouped.withColumn("node", F.monotonically_increasing_id()), "nodes")
    bands = nodes.select("node", "sig", "n").mapInArrow(_bands, "bucket bigint, band int, node bigint, n bigint")
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n") / WEIGHT)).cast("int")
    full = staged(bands.groupBy("bucket").agg(F.min("node").alias("x"), F.max("node").alias("y"), blocks.alias("blocks")).filter("x <> y").select("bucket", "blocks"), "buckets")
    members = bands.select("bucket", "band", "node").join(full, "bucket").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    tasks = members.select("bucket", "band", "node", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select("bucket", "band", "node", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    least = least_agreement(threshold, tolerance)
    held = tasks.join(nodes, "node").select("bucket", "i", "j", "block", "band", "node", "mult", "n", "sig").repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "node")
    asked = staged(held.mapInArrow(lambda b: _pruned(b, least, threshold), "task bigint, node bigint, mult bigint, partners array<bigint>"), "asked")
    # merge joins at every size: a text moves once for each node, whatever the number of nodes that are asked for
    ids = asked.select("node").distinct().join(nodes.select("node", "first.doc", "first.row"), "node")
    sets = texts.join(ids.hint("merge"), ["doc", "row"]).select("node", "text").mapInArrow(_shingle_rows, "node bigint, shingles binary")
    sets = sets.groupBy("node").agg(F.first("shingles").alias("shingles"))  # rows that are equal
    rows = asked.join(sets.hint("merge"), "node").select("task", "node", "mult", "partners", "shingles").repartition("task").sortWithinPartitions("task", "node")
    verified = staged(rows.mapInArrow(lambda b: _verified(b, threshold), "kind tinyint, a bigint, b bigint, n bigint"), "verified")
    labels = components(verified.filter("kind = 1").select("a", "b"))
    links = verified.filter("kind = 0").groupBy("a").agg(F.sum("n").alias("links"))
    known = nodes.select("node", "f0", "f1", "first", "mult").join(labels, "node", "left").join(links, F.col("node") == F.col("a"), "left")
    known = staged(known.select("node", "f0", "f1", "first", F.coalesce("class", "node").alias("class"), (F.col("mult") - 1 + F.coalesce("links", F.lit(0))).alias("links")), "known")
    heads = known.groupBy("class").agg(F.min("first").alias("head"))
    known = staged(known.join(heads, "class").select("f0", "f1", F.col("head.doc").alias("class_doc"), F.col("head.row").alias("class_row"), "links"), "classes")  # written, so that the join can split a hot set
    rest = made.filter("n = 0").select("doc", "row", "n", F.col("doc").alias("class_doc"), F.col("row").alias("class_row"), F.lit(0).cast("bigint").alias("links"))
    return real.select("doc", "row", "f0", "f1", "n").join(known, ["f0", "f1"]).select("doc", "row", "n", "class_doc", "class_row", "links").union(rest)


def jaccard_classes(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, class_id (least id of its class), n_links, n_shingles.

    n_links counts the other rows of similarity ``threshold`` or more, copies included: rows that
    are equal, or share an id, count one by one. Texts without words, null ones among them, link
    to nothing. Null ids are greater than all others and stay null, also as the class_id of a
    class without any id. Texts may have any length; an empty table gives an empty one; other
    columns are ignored. Two texts at the threshold exactly miss each other's bands with
    probability 5e-5, closer ones less often.
    """
    kind = dict(docs.dtypes)[id_col]
    rows = row_classes(docs, threshold, tolerance, id_col, text_col)
    own, head = (F.when(F.col(c) != LAST, F.col(c)).cast(kind) for c in ("doc", "class_doc"))
    return rows.select(own.alias("doc_id"), head.alias("class_id"), F.col("links").alias("n_links"), F.col("n").alias("n_shingles"))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(read_table(spark, sf_dir, "documents"))


def one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each class, all columns as they were.

    First is the least id, null last, then the least hash of the text; of rows equal in both,
    one stays, any of them. Texts without words are of no class and stay, repeated rows too;
    texts may have any length; of an empty table nothing is left.
    """
    doc, row = document("doc_id", "text")
    d, r, many = fresh("doc"), fresh("row"), fresh("many")
    rows = row_classes(docs.select("doc_id", "text"), THRESHOLD, TOLERANCE, "doc_id", "text").filter("n > 0")
    first = (F.col("doc") == F.col("class_doc")) & (F.col("row") == F.col("class_row"))
    marks = rows.groupBy(F.col("doc").alias(d), F.col("row").alias(r)).agg(F.max(first).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1 OR NOT first")
    marks = staged(marks.select(d, r, F.col("first").alias(many)), "marks")  # true: several rows of which one stays, false: none stays
    own = docs.withColumn(d, doc).withColumn(r, row)
    others = own.join(marks.select(d, r), [d, r], "left_anti")
    several = own.join(marks.filter(F.col(many)).select(d, r), [d, r], "left_semi").dropDuplicates([d, r])
    return others.select(*docs.columns).union(several.select(*docs.columns))


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(generate_series(1, len(ws) - 4), lambda i: array_to_string(ws[i:i + 4], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE k >= 0.8 * (na.n + nb.n - k)),
r AS (SELECT a AS node, b AS seen FROM e UNION SELECT r.node, e.b FROM r JOIN e ON r.seen = e.a),
c AS (SELECT node, least(node, min(seen)) AS class_id FROM r GROUP BY node),
l AS (SELECT a, count(*) AS n_links FROM e GROUP BY a)
SELECT w.doc_id, coalesce(class_id, w.doc_id) AS class_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.node = w.doc_id LEFT JOIN l ON l.a = w.doc_id
"""
