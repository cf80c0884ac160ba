"""N-gram Jaccard join by a blocked sparse product of the document by n-gram incidence matrix.

Two documents link if their sets of word shingles have a Jaccard index of at least
``PERCENT / 100``. Equal sets are one class, compared once.

1. Columns are ordered rare before frequent, then by hash. Shingles whose hash is in the lowest
   quarter, which is where rare columns are taken from, are counted exactly; the others by lossy
   counting, merged over partitions. A set of n shingles with the size bound T = ceil(J n) puts
   its first n - T + k columns into the product: linked sets share at least k of them.
2. The product is formed column by column. A column of few sets gives partial overlap counts, which
   are summed over the columns; pairs of unfit sizes are dropped. Of a column of many sets only the
   membership is kept. Two sets share no more long columns than the one with fewer has, so a pair
   is dropped if its count and that number stay under k, and only sets with k long columns or more
   can link without a short one: those of a long column are held together by a star. Columns of very
   frequent shingles are told apart before the product, so that none of them is gathered in a task.
3. What hangs together by 2 is a bundle. Each bundle is cut into blocks of a bounded number of rows and
   of shingles that meet pairwise in tasks; a task multiplies its rows' incidence, a slice of columns at a time, over
   all shingles, so the overlaps and the decision are exact. It returns a spanning forest, not pairs.

Any order of columns gives the same links, so the frequent ones only save work.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, forget, likely, release_memory, shuffle_partitions, written
from .components import components
from .shingles import each_shingle_sets, mix, shingle_sets

PERCENT = 85
WIDTH = 4
#: Linked sets must share this many of the columns that enter the product (fewer if they are smaller).
SHARED = 4
#: A column of at most this many sets gives pairs, a longer one memberships.
SHORT = 32
#: Shingles with smaller hashes are all counted; others count where a run of ``RUN`` shingles has them so often ...
COUNTED, RUN, OFTEN = np.uint64(1 << 62), 1 << 20, 2
#: ... and are frequent from this total on; the order knows at most so many.
FREQUENT, MOST_FREQUENT = 32, 1_000_000
#: Columns of shingles with this total are counted before the product; long ones never reach a task as a whole.
HOT = 1024
#: Least and most rows of a block, and its shingles, on average. A text is shipped once for each block of its bundle.
LEAST_ROWS, MOST_ROWS, BLOCK_SHINGLES = 256, 1024, 1 << 19


def frequent_shingles(texts: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of frequent shingles, ``MOST_FREQUENT`` at most, sorted, and the totals found, from all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def counted() -> Iterator[pa.RecordBatch]:
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            often = (counts >= OFTEN) | (values < COUNTED)
            values, counts = values[often], counts[often]
            for i in range(0, len(values), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(values[i : i + (1 << 16)].view(np.int64)), pa.array(counts[i : i + (1 << 16)].astype(np.int64))], names=["h", "n"])

        for whole in batches:
            for sets in each_shingle_sets(whole.column(0), width):
                held += sets
                n += sum(map(len, sets))
                if n >= RUN:
                    yield from counted()
                    held, n = [], 0
        if held:
            yield from counted()
        held = []
        release_memory()

    totals = texts.select("t").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT)
    top = totals.orderBy(F.desc("n"), "h").limit(MOST_FREQUENT).toPandas()
    h, n = top["h"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64)
    order = np.argsort(h)
    return h[order], n[order]


def least_overlap(n: np.ndarray | int, percent: int) -> np.ndarray | int:
    """The least overlap of a set of ``n`` with one that it links with."""
    return -(-n * percent // 100)


def _signer(frequent: np.ndarray, percent: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in bounded(whole, 1):
                n, c1, c2, first = [], [], [], []
                for s in shingle_sets(batch.column(1), width):
                    n.append(len(s))
                    c1.append(np.bitwise_xor.reduce(s, initial=np.uint64(0)))
                    c2.append(mix(s + np.uint64(1)).sum(dtype=np.uint64))
                    if len(s):
                        t = int(least_overlap(len(s), percent))
                        often = frequent[np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)] == s if len(frequent) else np.zeros(len(s), bool)
                        first.append(np.concatenate([s[~often], s[often]])[: len(s) - t + min(SHARED, t)].view(np.int64))
                    else:
                        first.append(np.zeros(0, np.int64))
                numbers = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (n, c1, c2)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *numbers, pa.array(first, pa.list_(pa.int64()))], names=["doc_id", "n", "c1", "c2", "first"])
        release_memory()

    return run


def _multiply_columns(percent: int):
    """Columns, sorted by (h, n, rep), into pairs (u, v, need) and memberships (u, column, -need) of long ones.

    ``need`` is how many columns a link of the pair, or of the member, shares at least.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = rep = n = np.zeros(0, np.int64)  # rows of the column that is not complete yet
        starred = False  # whether that column is long for sure; then only its first row, emitted already, is kept

        def emit(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal h, rep, n, starred
            begins = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
            sizes = np.diff(np.concatenate([begins, [len(h)]]))
            long = sizes > SHORT
            if starred and len(sizes):
                long[0] = True
            done = np.ones(len(sizes), bool)
            if not last and len(sizes):
                done[-1] = long[-1]
            us, vs, needs = [], [], []
            for k in np.flatnonzero(long & done).tolist():
                rows = slice(begins[k] + (starred and k == 0), begins[k] + sizes[k])
                us.append(rep[rows])
                vs.append(h[rows])
                needs.append(-np.minimum(SHARED, least_overlap(n[rows], percent)))
            for size in np.unique(sizes[~long & done & (sizes > 1)]).tolist():
                at = begins[(sizes == size) & ~long & done]
                i, j = np.triu_indices(size, 1)
                a, b = (at[:, None] + i).reshape(-1), (at[:, None] + j).reshape(-1)
                fit = (100 * n[a] >= percent * n[b]) & (rep[a] != rep[b])
                a, b = a[fit], b[fit]
                us.append(np.maximum(rep[a], rep[b]))
                vs.append(np.minimum(rep[a], rep[b]))
                needs.append(np.minimum(SHARED, least_overlap(np.minimum(n[a], n[b]), percent)))
            if last or not len(sizes):
                keep = slice(0, 0)
            else:
                starred = bool(long[-1])
                keep = slice(begins[-1], begins[-1] + 1 if starred else len(h))
            h, rep, n = h[keep], rep[keep], n[keep]
            if us:
                u, v, need = (np.concatenate(x) for x in (us, vs, needs))
                for i in range(0, len(u), 1 << 18):
                    part = slice(i, i + (1 << 18))
                    yield pa.RecordBatch.from_arrays([pa.array(u[part]), pa.array(v[part]), pa.array(need[part].astype(np.int32))], names=["u", "v", "need"])

        for batch in batches:
            h, rep, n = (np.concatenate([x, c.to_numpy()]) for x, c in zip((h, rep, n), batch.columns, strict=True))
            yield from emit(False)
        yield from emit(True)

    return run


def _product(columns: DataFrame, hot: np.ndarray, percent: int) -> list[DataFrame]:
    """Tables of pairs and memberships of the columns (h, rep, n), as ``_multiply_columns`` tells them.

    ``hot``: at most ``MOST_FREQUENT`` hashes. A long column among them gives its memberships right here.
    """
    rest, out = columns, []
    if len(hot):
        spark = columns.sparkSession
        hashes = spark.createDataFrame(pa.table({"k": hot.view(np.int64)}))  # at most 8 MB
        sizes = columns.join(F.broadcast(hashes), F.col("h") == F.col("k"), "left_semi").groupBy("h").agg(F.count("*").alias("size"))
        long = F.broadcast(written(sizes.where(F.col("size") > SHORT).select(F.col("h").alias("k")), "hot-columns"))
        rest = columns.join(long, F.col("h") == F.col("k"), "left_anti")
        need = F.least(F.lit(SHARED), F.ceil(F.col("n") * percent / 100)).cast("int")
        out.append(columns.join(long, F.col("h") == F.col("k"), "left_semi").select(F.col("rep").alias("u"), F.col("h").alias("v"), (-need).alias("need")))
    dealt = rest.select("h", "rep", "n").repartition(shuffle_partitions(columns.sparkSession), "h").sortWithinPartitions("h", "n", "rep")
    out.append(dealt.mapInArrow(_multiply_columns(percent), "u long, v long, need int"))
    return [written(x, "partial") for x in out]


def _pairs(partial: DataFrame, long: DataFrame) -> DataFrame:
    """Pairs that may share as many columns as they need. ``long``: how many long columns each u has."""
    summed = partial.where("need > 0").groupBy("u", "v", "need").agg(F.count("*").alias("shared"))
    for side in ("u", "v"):
        summed = summed.join(long.select(F.col("u").alias(f"of_{side}"), F.col("long").alias(f"long_{side}")), F.col(side) == F.col(f"of_{side}"), "left")
    unseen = F.least(F.coalesce("long_u", F.lit(0)), F.coalesce("long_v", F.lit(0)))
    return summed.where(F.col("shared") + unseen >= F.col("need")).select("u", "v")


def _stars(partial: DataFrame, long: DataFrame) -> list[DataFrame]:
    """Members of a long column that have enough long columns to link by them alone, each with the least; and the tables read."""
    long = long.withColumnRenamed("u", "rep")
    able = written(partial.where("need < 0").join(long, F.col("u") == F.col("rep")).where("long >= -need").select("rep", F.col("v").alias("h")), "long-members")
    least = written(able.groupBy("h").agg(F.min("rep").alias("least")), "long-least")
    named = least.withColumnRenamed("h", "k")
    return [able.join(named, F.col("h") == F.col("k")).where("rep <> least").select(F.col("rep").alias("u"), F.col("least").alias("v")).distinct(), able, least]


def _same_ids(able: DataFrame, classes: DataFrame) -> DataFrame:
    """Edges from an id to the representatives of its texts, for ids with texts of several classes."""
    key = F.struct("n", "c1", "c2")
    several = able.groupBy("doc_id").agg(F.min(key).alias("a"), F.max(key).alias("b")).where("a <> b").select(F.col("doc_id").alias("d"))
    mine = able.join(several, F.col("doc_id") == F.col("d"), "left_semi").select("doc_id", "n", "c1", "c2")
    return mine.join(classes, ["n", "c1", "c2"]).select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))


def overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of the sets of ``a`` with those of ``b``, columns in slices."""
    rows = np.repeat(np.arange(len(a) + len(b)), [len(s) for s in (*a, *b)])
    values, column, counts = np.unique(np.concatenate([*a, *b, np.zeros(0, np.uint64)]), return_inverse=True, return_counts=True)
    shared = counts > 1
    keep = shared[column]
    number = np.cumsum(shared) - 1
    rows, column = rows[keep], number[column[keep]]
    order = np.argsort(column, kind="stable")
    rows, column = rows[order], column[order]
    out = np.zeros((len(a), len(b)), np.float64)
    width = max(1024, (1 << 21) // max(1, len(a) + len(b)))
    for start in range(0, int(shared.sum()), width):
        lo, hi = np.searchsorted(column, [start, start + width])
        slab = np.zeros((len(a) + len(b), min(width, int(shared.sum()) - start)), np.float32)
        slab[rows[lo:hi], column[lo:hi] - start] = 1
        out += slab[: len(a)] @ slab[len(a) :].T  # counts under 2^24 are exact
    return out.astype(np.int64)


def link_blocks(ids: np.ndarray, sets: list[np.ndarray], own: np.ndarray, low: int, high: int, percent: int) -> list[tuple[int, int]]:
    """Spanning forest (id, root) of the links between two blocks of a bundle, or within one."""
    a, b = np.flatnonzero(own == low), np.flatnonzero(own == high)
    if not len(a) or not len(b):
        return []
    common = overlaps([sets[i] for i in a], [sets[i] for i in b])
    n = np.array([len(s) for s in sets], np.int64)
    linked = (100 * common >= percent * (n[a][:, None] + n[b][None, :] - common)) & (common > 0)
    root = np.arange(len(sets))

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for x, row in enumerate(linked):
        for r in np.unique(root[b[row]]).tolist():
            s, t = find(int(a[x])), find(r)
            if s != t:
                s, t = (s, t) if ids[s] <= ids[t] else (t, s)
                root[t] = s
    return [(int(ids[k]), int(ids[find(k)])) for k in range(len(sets)) if find(k) != k]


def _multiply_blocks(percent: int, width: int):
    """Rows sorted by (bundle, low, high); each group's links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, own, sets = None, [], [], []

        def finish() -> list[tuple[int, int]]:
            if key is None:
                return []
            return link_blocks(np.array(ids, np.int64), sets, np.array(own), key[1], key[2], percent)

        def batch_of(rows: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([u for u, _ in rows], pa.int64()), pa.array([v for _, v in rows], pa.int64())], names=["u", "v"])

        for whole in batches:
            rows = []
            for batch in bounded(whole, 5):
                hashed = shingle_sets(batch.column(5), width)
                for bundle, low, high, mine, doc, found in zip(*(c.to_pylist() for c in batch.columns[:5]), hashed, strict=True):
                    if (bundle, low, high) != key:
                        rows += finish()
                        key, ids, own, sets = (bundle, low, high), [], [], []
                    ids.append(doc)
                    own.append(mine)
                    sets.append(found)
            if rows:
                yield batch_of(rows)
        if rows := finish():
            yield batch_of(rows)
        sets = []
        release_memory()

    return run


def ngram_join(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT, width: int = WIDTH) -> DataFrame:
    """Per row: ``doc_id``, ``n_shingles`` and ``component_id`` (least id reachable by links).

    A null or empty text has no shingles and links with nothing: its component is its own id. Rows
    with one ``doc_id`` are one node, whatever their texts; a row with a null id links with nothing
    and has a null component. Other columns are not read, whatever their names; an empty table
    gives an empty one. A text of any length is taken whole.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("t"))
    frequent, totals = frequent_shingles(rows, width)
    signed = written(rows.mapInArrow(_signer(frequent, percent, width), "doc_id long, n long, c1 long, c2 long, first array<long>"), "signatures")
    able = signed.where("n > 0 and doc_id is not null")
    classes = written(able.groupBy("n", "c1", "c2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("m"), F.any_value("first").alias("first")), "classes")
    parts = shuffle_partitions(spark)

    tables = _product(classes.select(F.explode("first").alias("h"), "rep", "n"), frequent[totals >= HOT], percent)
    partial = tables[0] if len(tables) == 1 else tables[0].union(tables[1])
    long = written(partial.where("need < 0").groupBy("u").agg(F.count("*").alias("long")), "long-columns")
    stars, *read = _stars(partial, long)
    bundles = written(components(_pairs(partial, long).union(stars)).select(F.col("node").alias("rep"), F.col("component").alias("bundle")), "bundles")
    forget(*tables, long, *read)

    sized = bundles.join(classes.select(F.col("rep").alias("r"), "n"), F.col("rep") == F.col("r"))
    sizes = written(sized.groupBy("bundle").agg(F.count("*").alias("size"), F.sum("n").alias("shingles")), "bundle-sizes")
    # Rows of a block grow with the root of large bundles, and the number of tasks in proportion to them.
    rows_of = F.least(F.lit(MOST_ROWS), F.greatest(F.lit(LEAST_ROWS), F.floor(2 * F.sqrt("size"))))
    count = F.greatest(F.ceil(F.col("size") / rows_of), F.least(F.ceil(F.col("shingles") / BLOCK_SHINGLES), F.col("size"))).cast("int")
    blocks = bundles.join(sizes, "bundle").withColumn("blocks", count)
    dealt = blocks.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).select("rep", "bundle", "blocks", "own")
    near = likely(rows, "doc_id", dealt, "rep")
    members = near.join(dealt, near["doc_id"] == dealt["rep"]).select("bundle", "blocks", "own", "doc_id", "t")
    paired = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tasks = paired.select("bundle", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "doc_id", "t")
    groups = tasks.repartition(parts, "bundle", "low", "high").sortWithinPartitions("bundle", "low", "high")
    links = groups.mapInArrow(_multiply_blocks(percent, width), "u long, v long")
    reached = components(links.union(_same_ids(able, classes)))

    # Only classes of several rows or with links are looked up; Spark splits the rows of a large class.
    told = classes.join(reached, F.col("rep") == F.col("node"), "left").where("m > 1 or component is not null")
    told = written(told.select(F.col("c1").alias("k1"), F.col("c2").alias("k2"), F.col("n").alias("kn"), F.coalesce("component", "rep").alias("component")), "told")
    forget(bundles, sizes, classes)
    out = signed.select("doc_id", "n", "c1", "c2").join(told, (F.col("c1") == F.col("k1")) & (F.col("c2") == F.col("k2")) & (F.col("n") == F.col("kn")), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def op3_ngram_join(spark, sf_dir: str) -> DataFrame:
    """Shingle set sizes and components of all documents."""
    return ngram_join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
