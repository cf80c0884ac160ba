"""Embedding near-duplicates through a pivot-permutation index.

Every vector is described by its nearest reference points (pivots) in order. Pivots have inverted
lists; two vectors are compared if they share at least ``SHARED`` of their ``PREFIX`` nearest pivots.
Such a pair meets in a list of the first ``PREFIX - SHARED + 1`` pivots of either, so only these are
posted. Long lists are cut into blocks that meet pairwise in tasks of bounded size; a task counts
shared pivots and cosines by matrix products, keeps the pairs that meet there first, and returns
link counts and a spanning forest, never pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .components import components

LEAST_COSINE = 0.98
PREFIX, SHARED = 8, 3
#: Vectors of a list that meet another block in one task.
BLOCK = 512
MOST_PIVOTS = 4096


def pivot_count(n: int) -> int:
    """A power of two near the root of the number of vectors: lists then have about as many members as there are lists."""
    return int(min(MOST_PIVOTS, max(64, 2 ** round(np.log2(max(n, 1)) / 2))))


def choose_pivots(vectors: np.ndarray, n: int) -> np.ndarray:
    """Up to ``n`` unit vectors no two of which have a cosine of 0.9; filled up with fixed random directions."""
    dim = vectors.shape[1]
    picked, k = np.zeros((n, dim)), 0
    for v in vectors:
        if k == n:
            break
        if not k or float(np.max(picked[:k] @ v)) < 0.9:
            picked[k], k = v, k + 1
    random = np.random.default_rng(dim).standard_normal((n - k, dim))
    return np.concatenate([picked[:k], random / np.linalg.norm(random, axis=1, keepdims=True)])


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow or underflow in the squares
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def usable(embedding: str = "embedding", label: str = "label"):
    """Whether a vector can link: label and vector not null, all components finite, one of them not 0."""
    e = F.col(embedding)
    finite = ~F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(F.col(label).isNotNull() & finite & F.exists(e, lambda x: x != 0), F.lit(False))


def near_vectors(df: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", least: float = LEAST_COSINE, block: int = BLOCK, sample_per_pivot: int = 8) -> DataFrame:
    """Per row: ``vec_id``, ``n_links``, ``component_id`` and ``kept``.

    Rows link if their labels are equal and their vectors, of the same length, have a cosine of at
    least ``least``. Equal vectors of a label are one class: compared once, and linked to each
    other. A null ``vec_id`` has no links. A repeated ``vec_id`` counts as two vectors with one id,
    repeated rows as links to each other. Other columns are not read, whatever their names; an empty
    table gives an empty one. A vector of any length must fit a task. The pivots are fitted on a bounded sample of ``sample_per_pivot`` vectors each.
    """
    spark = df.sparkSession
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(embedding, lambda x: x.cast("double")).alias("e"), F.col(label).alias("label"))
    rows = rows.withColumn("ok", usable("e", "label") & F.col("vec_id").isNotNull())
    # Two hashes with different seeds: the literal in front changes the seed for all components.
    keyed = rows.where("ok").withColumns({"h1": F.xxhash64("e"), "h2": F.xxhash64(F.lit(1), "e"), "dim": F.size("e")})
    key = ["label", "dim", "h1", "h2"]
    classes = written(keyed.groupBy(*key).agg(F.min("vec_id").alias("rep"), F.count("*").alias("m"), F.any_value("e").alias("e")), "vectors")
    n = classes.count()
    pivots = _sampled_pivots(classes, n, sample_per_pivot)
    described = written(classes.select("label", "dim", "rep", "m", "e").mapInArrow(_describer(pivots), "label string, dim int, rep long, m long, e array<double>, near array<int>"), "described")

    # Post each vector in its rarest pivots; the order is any fixed one, here list length, then number.
    sizes = written(described.select("label", "dim", F.explode("near").alias("p")).groupBy("label", "dim", "p").agg(F.count("*").alias("size")), "lists")
    ranked = described.select("rep", "label", "dim", F.explode("near").alias("p")).join(sizes, ["label", "dim", "p"]).groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("size", "p"))).alias("order"))
    posted = described.join(ranked, "rep").withColumn("order", F.slice("order", 1, PREFIX - SHARED + 1))
    posted = written(posted.withColumn("posted", F.col("order.p")), "posted")
    lists = written(posted.select("label", "dim", F.explode("posted").alias("p")).groupBy("label", "dim", "p").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")).where("blocks > 0"), "lists")
    at = posted.select("label", "dim", "rep", "m", "e", "near", "posted", F.explode("posted").alias("p")).join(lists, ["label", "dim", "p"])
    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    paired = at.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tasks = paired.withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other")}).drop("blocks", "other")
    found = written(tasks.groupBy("label", "dim", "p", "low", "high").applyInArrow(_comparer(least), "rep long, links long, root long"), "links")

    reached = components(found.select(F.col("rep").alias("u"), F.col("root").alias("v")))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    told = written(classes.select(*key, "rep", "m").join(links, "rep", "left").join(reached, F.col("rep") == F.col("node"), "left").select(*key, "rep", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("links"), F.coalesce("component", "rep").alias("component")), "told")
    # Members look up their class; Spark splits the members of a large one.
    members = keyed.select(*key, "vec_id").join(told, key).select("vec_id", F.col("links").alias("n_links"), F.col("component").alias("component_id"))
    alone = rows.where("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return members.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _sampled_pivots(classes: DataFrame, n: int, per_pivot: int) -> dict[int, np.ndarray]:
    count = pivot_count(n)
    share = min(1.0, per_pivot * count / max(n, 1))
    drawn = classes.where(F.pmod(F.xxhash64("rep", F.lit(3)), F.lit(1 << 30)) < share * (1 << 30)).select("rep", "dim", "e").limit(2 * per_pivot * count).collect()
    by_dim: dict[int, list] = {}
    for r in sorted(drawn, key=lambda r: (hash((r["rep"], 11)), r["rep"])):
        by_dim.setdefault(r["dim"], []).append(r["e"])
    made = {d: choose_pivots(unit(np.array(v)), count) for d, v in by_dim.items()}
    return made | {0: np.zeros((count, 0))}


def _describer(pivots: dict[int, np.ndarray]):
    count = len(pivots[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(1).to_numpy()
            near = np.zeros((batch.num_rows, PREFIX), np.int32)
            vectors: list = [None] * batch.num_rows
            for d in np.unique(dims).tolist():
                at = np.flatnonzero(dims == d)
                x = unit(batch.column(4).take(pa.array(at)).flatten().to_numpy().reshape(len(at), d))
                if d not in pivots:
                    pivots[d] = choose_pivots(np.zeros((0, d)), count)
                near[at] = np.argsort(-(x @ pivots[d].T), axis=1, kind="stable")[:, :PREFIX]
                for i, v in zip(at.tolist(), x, strict=True):
                    vectors[i] = v
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), *[batch.column(i) for i in (1, 2, 3)], pa.array(vectors, pa.list_(pa.float64())), pa.array(list(near), pa.list_(pa.int32()))], names=["label", "dim", "rep", "m", "e", "near"])

    return run


def _comparer(least: float):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        p, low, high = (k.as_py() for k in key[2:])
        n = table.num_rows
        matrix = lambda name: table[name].combine_chunks().flatten().to_numpy().reshape(n, -1)
        rep, m, own = (table[c].to_numpy() for c in ("rep", "m", "own"))
        x, near, posted = matrix("e"), matrix("near"), matrix("posted")
        a, b = np.flatnonzero(own == low), np.flatnonzero(own == high)
        pivots, place = np.unique(near, return_inverse=True)
        has = np.zeros((n, len(pivots)), np.float32)
        np.put_along_axis(has, place.reshape(n, -1), 1, axis=1)
        # Retrieval by the number of shared pivots, then the exact cosine.
        linked = (has[a] @ has[b].T >= SHARED) & (x[a] @ x[b].T >= least)
        if low == high:
            linked &= a[:, None] < b[None, :]
        i, j = np.nonzero(linked)
        i, j = a[i], b[j]
        # A pair counts in the smallest pivot that both are posted in.
        common = posted[i][:, :, None] == posted[j][:, None, :]
        first = np.where(common.any(2), posted[i], np.iinfo(np.int32).max).min(axis=1) if len(i) else i
        i, j = i[first == p], j[first == p]
        links = np.bincount(i, m[j], minlength=n) + np.bincount(j, m[i], minlength=n)
        root = np.arange(n)

        def find(k: int) -> int:
            while root[k] != k:
                root[k] = root[root[k]]
                k = root[k]
            return k

        # Rows of the same block pair mostly hang together, so whole rows are united at once.
        for k in np.unique(i):
            for r in np.unique(root[j[i == k]]):
                s, t = find(int(k)), find(int(r))
                if s != t:
                    root[max(s, t, key=lambda q: rep[q])] = min(s, t, key=lambda q: rep[q])
        some = np.flatnonzero(links > 0)
        return pa.table({"rep": pa.array(rep[some], pa.int64()), "links": pa.array(links[some].astype(np.int64)), "root": pa.array([int(rep[find(int(k))]) for k in some], pa.int64())})

    return run


def op2_near_vectors(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all embeddings."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))
