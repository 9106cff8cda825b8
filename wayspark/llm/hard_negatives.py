"""Operator 12, mining of hard negatives by branch-and-bound in ball trees.

Vectors are whole numbers (256 times the components, rounded down), so scores are exact.
Each part of the table becomes ball trees of at most TREE_ROWS vectors, written once as
rows of packed arrays. A node knows its centre c and radius r, so the inner product of an
anchor q with any vector in it lies within q.c - |q| r and q.c + |q| r. A search walks a tree
with a block of anchors at once, those bounded off dropping out at each node; it skips a node
whose bounds lie outside the wanted window of scores, or strictly beneath the k-th score so
far (or level with it, if no smaller id is in it). A task carries its best k from tree to tree
and gives them once; Spark merges those of all tasks.

Two searches: the k best rows of an anchor's own label are its positives; then the best rows
of other labels within each positive's window of scores are its negatives. The anchors are a
stated set of queries; they are held against the trees in blocks of ANCHORS, the only thing
that is broadcast.

Edge cases: rows with a null label, a null vector or a component that is null, infinite or
not a number take no part. Vectors of different lengths count as filled up with zeros; an
empty one scores 0 with all. Repeated ids are rows of their own (an anchor that comes twice
is mined twice), ties go to the smaller vec_id, a null vec_id last. An anchor without other
rows of its label has no positives; a positive of negative score has no window and so no
rows. An empty table, or one without anchors, gives no rows. Components whose scores would
pass 2**53 are multiplied as Python integers; a score beyond 64 bits is an error. There is no
text, long or short; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from wayspark.functions.durable import durable, release

SCALE = 256
TREE_ROWS, LEAF = 8192, 32
#: Anchors of a block; with 64 components they take 4 MB.
ANCHORS = 8192
POSITIVES, NEGATIVES = 5, 10
#: A negative's score is between these hundredths of the positive's.
WINDOW = (30, 90)
#: Null ids come last.
NO_ID = (1 << 63) - 1
EXACT = float(1 << 53)

TREE = "rows binary, ids binary, uids binary, labels binary, nodes binary, width int"


@dataclass
class Tree:
    """Vectors in the order of the leaves; node k holds rows ``lo`` to ``hi`` and its children follow it (``right``: 0 in a leaf)."""

    rows: np.ndarray
    ids: np.ndarray
    uids: np.ndarray
    labels: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    right: np.ndarray
    radius: np.ndarray
    least: np.ndarray
    centre: np.ndarray

    @staticmethod
    def build(rows: np.ndarray, ids: np.ndarray, uids: np.ndarray, labels: np.ndarray) -> Tree:
        """Split at the median along the line through two far points, down to LEAF rows or equal ones."""
        order = np.arange(len(rows))
        nodes: list[list] = []

        def grow(lo: int, hi: int) -> int:
            own = rows[order[lo:hi]]
            centre = own.mean(axis=0)
            far = np.sqrt(((own - centre) ** 2).sum(axis=1))
            radius = float(far.max())
            node = len(nodes)
            nodes.append([lo, hi, 0, radius * (1 + 1e-9) + 1e-9, ids[order[lo:hi]].min(), centre])
            if hi - lo > LEAF and radius > 0:
                a = own[far.argmax()]
                b = own[((own - a) ** 2).sum(axis=1).argmax()]
                half = (hi - lo) // 2
                order[lo:hi] = order[lo:hi][np.argpartition(own @ (b - a), half)]
                grow(lo, lo + half)
                nodes[node][2] = grow(lo + half, hi)
            return node

        grow(0, len(rows))
        cols = [np.array([n[k] for n in nodes]) for k in range(6)]
        return Tree(rows[order], ids[order], uids[order], labels[order], *cols)

    def packed(self) -> tuple:
        nodes = np.column_stack([self.lo, self.hi, self.right, self.radius.view(np.int64), self.least]).astype(np.int64)
        return (self.rows.tobytes(), self.ids.tobytes(), self.uids.tobytes(), self.labels.tobytes(), nodes.tobytes() + self.centre.tobytes(), self.rows.shape[1])

    @staticmethod
    def unpacked(rows: bytes, ids: bytes, uids: bytes, labels: bytes, nodes: bytes, width: int) -> Tree:
        ids_ = np.frombuffer(ids, np.int64)
        n = len(nodes) // (8 * (5 + width))
        head = np.frombuffer(nodes, np.int64, n * 5).reshape(n, 5)
        centre = np.frombuffer(nodes, np.float64, n * width, n * 40).reshape(n, width)
        return Tree(
            np.frombuffer(rows, np.float64).reshape(len(ids_), width), ids_, np.frombuffer(uids, np.int64), np.frombuffer(labels, np.int64),
            head[:, 0], head[:, 1], head[:, 2], np.ascontiguousarray(head[:, 3]).view(np.float64), head[:, 4], centre,
        )


def widened(rows: np.ndarray, width: int) -> np.ndarray:
    return rows if rows.shape[1] >= width else np.pad(rows, ((0, 0), (0, width - rows.shape[1])))


def dot(a: np.ndarray, b: np.ndarray, small: bool) -> np.ndarray:
    """Inner products of whole numbers, exactly; ``small`` says that doubles hold them."""
    if small:
        return (a @ b.T).astype(np.int64)
    return np.array([[sum(int(x) * int(y) for x, y in zip(r, s, strict=True)) for s in b] for r in a], dtype=np.int64)


class Best:
    """For each query (an anchor and a window of scores) the k best rows so far."""

    def __init__(self, anchors: np.ndarray, uids: np.ndarray, labels: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool, k: int):
        self.anchors, self.uids, self.labels, self.low, self.high, self.same, self.k = anchors, uids, labels, low, high, same, k
        self.size = np.sqrt((anchors**2).sum(axis=1))
        n = len(anchors)
        self.score = np.zeros((n, k), dtype=np.int64)
        self.id = np.zeros((n, k), dtype=np.int64)
        self.have = np.zeros((n, k), dtype=bool)
        self.kth = np.full(n, -np.inf)  # the k-th score, once there are k
        self.kth_id = np.full(n, NO_ID)

    def search(self, tree: Tree) -> None:
        width = max(tree.rows.shape[1], self.anchors.shape[1])
        anchors, centre, rows = widened(self.anchors, width), widened(tree.centre, width), widened(tree.rows, width)
        middle = anchors @ centre.T
        small = np.abs(anchors).max(initial=0) * np.abs(rows).max(initial=0) * max(width, 1) < EXACT
        slack = 1e-9 * (np.abs(middle) + self.size[:, None] * tree.radius) + 1e-6

        def bounds(node: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            spread = self.size[at] * tree.radius[node] + slack[at, node]
            return middle[at, node] - spread, middle[at, node] + spread

        todo = [(0, np.arange(len(anchors)))]
        while todo:
            node, at = todo.pop()
            low, high = bounds(node, at)
            live = (high >= self.low[at]) & (low <= self.high[at]) & (high >= self.kth[at])
            at = at[live]
            if not len(at):
                continue
            lo, hi, right = tree.lo[node], tree.hi[node], tree.right[node]
            if not right:
                self.take(tree, rows, lo, hi, anchors, at, small)
                continue
            # first the child that promises the higher scores
            pair = sorted((node + 1, int(right)), key=lambda c: middle[at, c].sum())
            todo.extend((c, at) for c in pair)

    def take(self, tree: Tree, rows: np.ndarray, lo: int, hi: int, anchors: np.ndarray, at: np.ndarray, small: bool) -> None:
        for a in range(lo, hi, 4 * LEAF):  # a leaf of equal vectors may be wide
            b = min(a + 4 * LEAF, hi)
            score = dot(anchors[at], rows[a:b], small)
            same = self.labels[at][:, None] == tree.labels[a:b]
            fits = (same & (self.uids[at][:, None] != tree.uids[a:b])) if self.same else ~same
            fits &= (score >= self.low[at][:, None]) & (score <= self.high[at][:, None])
            fits &= (score > self.kth[at][:, None]) | ((score == self.kth[at][:, None]) & (tree.ids[a:b] < self.kth_id[at][:, None]))
            some = fits.any(axis=1)
            if not some.any():
                continue
            own, n = at[some], b - a
            scores = np.concatenate([self.score[own], score[some]], axis=1)
            ids = np.concatenate([self.id[own], np.broadcast_to(tree.ids[a:b], (len(own), n))], axis=1)
            have = np.concatenate([self.have[own], fits[some]], axis=1)
            first = np.lexsort((ids, -scores, ~have), axis=1)[:, : self.k]
            self.score[own], self.id[own], self.have[own] = (np.take_along_axis(x, first, axis=1) for x in (scores, ids, have))
            full = own[self.have[own].all(axis=1)]
            self.kth[full], self.kth_id[full] = self.score[full, -1], self.id[full, -1]


def taking_part(embeddings: DataFrame) -> DataFrame:
    """vec_id, label, vec: whole numbers as doubles, of the rows that take part."""
    x = F.col("embedding").cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return embeddings.where(F.col("label").isNotNull() & x.isNotNull() & finite).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.transform(x, lambda v: F.floor(v * SCALE).cast("double")).alias("vec")
    )


def _matrix(column: pa.Array) -> np.ndarray:
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.cumsum(np.asarray(column.value_lengths()))
    sizes = np.diff(ends, prepend=0)
    width = int(sizes.max()) if len(sizes) else 0
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width).astype(np.float64)
    out = np.zeros((len(sizes), width))
    for r, (e, n) in enumerate(zip(ends, sizes, strict=True)):
        out[r, :n] = flat[e - n : e]
    return out


def ball_trees(rows: DataFrame) -> DataFrame:
    """The trees over ``rows`` (uid, vec_id, label, vec), one a row."""
    cols = ("uid", "vec_id", "label")
    schema = pa.schema([*((n, pa.binary()) for n in ("rows", "ids", "uids", "labels", "nodes")), ("width", pa.int32())])

    def tree_of(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        uid, ids, label = (t.column(c).fill_null(NO_ID).to_numpy().astype(np.int64) for c in cols)
        packed = Tree.build(_matrix(t.column("vec").chunk(0)), ids, uid, label).packed()
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(packed, schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, TREE_ROWS - n)
                batch = batch.slice(part.num_rows)
                held.append(part)
                n += part.num_rows
                if n == TREE_ROWS:
                    yield tree_of(held)
                    held, n = [], 0
        if held:
            yield tree_of(held)

    return rows.select(*cols, "vec").mapInArrow(run, TREE)


def best_rows(trees: DataFrame, queries: DataFrame, same: bool, k: int, block: int = ANCHORS) -> DataFrame:
    """query, score, id, rank: the k best rows of each query, ties by id.

    ``queries`` has query (from 0, without gaps), uid, label, vec and the window low, high of
    scores (nulls: none). A row of another label fits, or (``same``) another row of the label.
    """
    found = None
    blocks = queries.withColumn("_block", F.floor(F.col("query") / block))
    for b in range((queries.agg(F.max("query")).first()[0] or 0) // block + 1 if not queries.isEmpty() else 0):
        own = blocks.where(F.col("_block") == b).orderBy("query").toArrow().combine_chunks()  # a block at most
        value = lambda c, default: own.column(c).cast(pa.float64()).fill_null(default).to_numpy()  # noqa: E731, B023
        given = trees.sparkSession.sparkContext.broadcast((
            own.column("query").to_numpy(), _matrix(own.column("vec").chunk(0)), own.column("uid").to_numpy(), own.column("label").to_numpy(),
            value("low", -np.inf), value("high", np.inf),
        ))

        def run(batches, given=given):
            query, vec, uid, label, low, high = given.value
            best = Best(vec, uid, label, low, high, same, k)
            for batch in batches:
                for row in zip(*(batch.column(c).to_pylist() for c in batch.schema.names), strict=True):
                    best.search(Tree.unpacked(*row))
            at, to = np.nonzero(best.have)
            yield pa.RecordBatch.from_pydict({"query": pa.array(query[at], pa.int64()), "score": pa.array(best.score[at, to], pa.int64()), "id": pa.array(best.id[at, to], pa.int64())})

        part = durable(trees.mapInArrow(run, "query long, score long, id long"), "best")
        given.destroy()
        found = part if found is None else found.unionByName(part)
    if found is None:
        return trees.sparkSession.createDataFrame([], "query long, score long, id long, rank int")
    order = W.partitionBy("query").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def numbered(df: DataFrame, name: str, order: str) -> DataFrame:
    """A number from 0 without gaps, by ranges of ``order``: offsets of partitions, not one window over all."""
    held = durable(df.repartitionByRange(order).sortWithinPartitions(order).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_at", 33)
    sizes = held.groupBy(part.alias("_part")).agg(F.count("*").alias("n")).orderBy("_part").collect()  # a row a partition
    before, offsets = 0, []
    for r in sizes:
        offsets.append((r["_part"], before))
        before += r["n"]
    if not offsets:
        return held.withColumn(name, F.lit(0).cast("long")).drop("_at")
    base = F.create_map(*(F.lit(v) for pair in offsets for v in pair))
    return held.withColumn(name, (F.element_at(base, part) + F.col("_at").bitwiseAND((1 << 33) - 1)).cast("long")).drop("_at")


def mined(rows: DataFrame, anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, window: tuple[int, int] = WINDOW) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``rows`` has vec_id, label and vec (whole numbers as doubles); ``anchor`` says which
    rows are anchors.
    """
    own = durable(rows.withColumn("uid", F.monotonically_increasing_id()), "vectors")
    trees = durable(ball_trees(own), "trees")
    nothing = F.lit(None).cast("double")
    anchors = durable(numbered(own.where(anchor), "query", "uid"), "anchors")
    release(own)
    real = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    first = best_rows(trees, anchors.withColumns({"low": nothing, "high": nothing}), True, positives)
    found = durable(first.select(F.col("query").alias("anchor"), F.col("score").alias("positive_score"), real("id").alias("positive_id")), "positives")
    least, most = window
    # whole scores s with least * p <= 100 * s <= most * p
    low, high = F.expr(f"ceil({least} * positive_score / 100D)"), F.expr(f"floor({most} * positive_score / 100D)")
    pairs = found.where("positive_score >= 0").join(anchors.withColumnRenamed("query", "anchor"), "anchor").withColumn("_n", F.monotonically_increasing_id())
    pairs = durable(numbered(pairs.withColumns({"low": low.cast("double"), "high": high.cast("double")}), "query", "_n"), "windows")
    best = best_rows(trees, pairs, False, negatives)
    return best.join(pairs.select("query", "vec_id", "positive_id", "positive_score"), "query").select(
        F.col("vec_id").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"), real("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = taking_part(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return mined(rows, F.coalesce(F.col("vec_id") % 100 == 0, F.lit(False)))


#: All pairs of anchors and rows.
ORACLE = """
with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as vec, row_number() over () as uid
    from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as anchor_id, a.uid as anchor, b.vec_id as id, b.uid, a.label = b.label as same, list_inner_product(a.vec, b.vec)::bigint as score
    from v a, v b where a.vec_id % 100 = 0 and a.uid <> b.uid),
p as (select * from s where same qualify row_number() over (partition by anchor order by score desc, id nulls last) <= 5),
n as (select p.anchor_id, p.id as positive_id, p.score as positive_score, s.id as negative_id, s.score as negative_score,
    row_number() over (partition by p.anchor, p.uid order by s.score desc, s.id nulls last)::integer as rank
    from p join s on s.anchor = p.anchor and not s.same and 30 * p.score <= 100 * s.score and 100 * s.score <= 90 * p.score)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from n where rank <= 10"""

QUERIES = {"op12_hard_negatives": query}
ORACLE_SQL = {"op12_hard_negatives": ORACLE}
