"""Vectors and topics: nearest neighbours, shortlists, centroids, memberships, seeds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType

from quillspark.functions import text as T
from quillspark.session import cut_lineage


def exploded(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    return vectors.select(key, F.posexplode(vector).alias("dim", "x"))


def mean_vectors(vectors: DataFrame, group: str, vector: str, digits: int = 4) -> DataFrame:
    """(group, dim, mean): mean-pooled vectors, one value a row; partial sums combine map-side."""
    return vectors.select(group, F.posexplode(vector).alias("dim", "x")).groupBy(group, "dim").agg(F.round(F.avg(F.col("x").cast("double")), digits).alias("mean"))


def centroids(vectors: DataFrame, group: str, vector: str, centred: bool = True) -> DataFrame:
    """(group, centroid): mean vector of each group, minus the mean of all vectors if centred."""
    rows = vectors.select(group, F.posexplode(vector).alias("dim", "x")).withColumn("x", F.col("x").cast("double"))
    means = rows.groupBy(group, "dim").agg(F.avg("x").alias("m"))
    if centred:
        every = rows.groupBy("dim").agg(F.avg("x").alias("all"))  # as many rows as dimensions
        means = means.join(F.broadcast(every), "dim").withColumn("m", F.col("m") - F.col("all"))
    packed = F.transform(F.array_sort(F.collect_list(F.struct("dim", "m"))), lambda p: p["m"])
    return means.groupBy(group).agg(packed.alias("centroid"))


#: Queries that are sent to the vectors at once (some 10 MB of them).
QUERY_BLOCK = 20_000
#: Vectors that an index is fitted on, most cells of it, and vectors of a cell that are searched in one task.
INDEX_SAMPLE, INDEX_CELLS, CELL_ROWS = 20_000, 1024, 50_000


def _ranked(rows: DataFrame, k: int, per_source: int | None) -> DataFrame:
    if per_source:
        w = Window.partitionBy("query_id", "source").orderBy("distance", "vec_id")
        rows = rows.withColumn("r", F.row_number().over(w)).where(F.col("r") <= per_source).drop("r")
    w = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    return rows.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def query_blocks(queries: DataFrame) -> Iterator[DataFrame]:
    """The queries in blocks of about QUERY_BLOCK, by a hash of their id."""
    blocks = -(-queries.count() // QUERY_BLOCK)
    for n in range(max(blocks, 1)):
        yield queries if blocks <= 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == n)


#: Queries that are compared with a batch of vectors at once.
QUERIES_AT_ONCE = 1_000


def _compared(rows: list, pick):
    """A function over Arrow batches of (vec_id, source, embedding, ...): the rows that pick(distances, batch, first query) chooses a
    query, with their exact squared distances, summed in the order of the dimensions. rows: a block of queries, collected."""
    ids = np.array([r["query_id"] for r in rows], dtype=object)
    q = np.array([r["query"] for r in rows], np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows or not len(q):
                continue
            x = np.stack(b.column("embedding").to_numpy(zero_copy_only=False)).astype(np.float64)
            for s in range(0, len(q), QUERIES_AT_ONCE):
                y = q[s : s + QUERIES_AT_ONCE]
                near = (y * y).sum(1)[:, None] - 2 * y @ x.T + (x * x).sum(1)
                at, of = pick(near, b, s)
                exact = np.zeros(len(at))
                for k in range(x.shape[1]):
                    exact += (y[at, k] - x[of, k]) ** 2
                names = ["query_id", "vec_id", "source", "distance"]
                yield pa.RecordBatch.from_arrays([pa.array(ids[s + at].tolist(), pa.int64()), b.column("vec_id").take(pa.array(of)), b.column("source").take(pa.array(of)), pa.array(exact)], names=names)

    return run


#: Distances are compared rounded to four places; the product that finds candidates is not as exact as their sum.
SLACK = 1.1e-4


def _least(near: np.ndarray, k: int) -> np.ndarray:
    """Which entries of each row are among its k least, or may be after rounding."""
    if near.shape[1] <= k:
        return np.ones(near.shape, bool)
    return near <= np.partition(near, k - 1, axis=1)[:, k - 1 : k] + SLACK


def nearest(queries: DataFrame, vectors: DataFrame, k: int, per_source: int | None = None) -> DataFrame:
    """(query_id, vec_id, source, distance, rank): exact nearest vectors of a stated set of queries by squared distance.

    queries: (query_id, query), sent to the vectors in blocks of about QUERY_BLOCK; vectors: (vec_id, source, embedding). Each batch
    is one matrix product, of which the candidates' distances are computed exactly; only the best of a batch are shuffled. For many
    queries see indexed_nearest.
    """

    def pick(near: np.ndarray, batch: pa.RecordBatch, _: int) -> tuple[np.ndarray, np.ndarray]:
        if not per_source:
            return np.nonzero(_least(near, k))
        source = np.array(batch.column("source").to_pylist(), dtype=object)
        found = [(at, cols[of]) for s in set(source) for cols in [np.flatnonzero(source == s)] for at, of in [np.nonzero(_least(near[:, cols], per_source))]]
        return np.concatenate([a for a, _ in found]), np.concatenate([o for _, o in found])

    rows = vectors.where("embedding is not null").select("vec_id", "source", "embedding")
    source_type = dict(rows.dtypes)["source"]
    out = None
    for part in query_blocks(queries.where("query is not null")):
        found = rows.mapInArrow(_compared(part.collect(), pick), f"query_id long, vec_id {dict(rows.dtypes)['vec_id']}, source {source_type}, distance double")
        found = _ranked(found.withColumn("distance", F.round("distance", 4)), k, per_source)
        out = found if out is None else out.unionByName(found)
    return out


def fit_cells(vectors: DataFrame, sample: int = INDEX_SAMPLE, rounds: int = 8):
    """Centres of an inverted index: k-means on at most that many vectors, the first by a hash of their id."""
    n = vectors.count()
    limit = (1 << 40) if n <= sample else int((1 << 40) * 1.2 * sample / n)
    rows = vectors.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 40)) < limit).select("vec_id", "embedding").collect()
    x = np.array([r["embedding"] for r in sorted(rows, key=lambda r: r["vec_id"])[:sample]], np.float64)
    if not len(x):
        return x
    cells = min(INDEX_CELLS, max(1, int(n**0.5)), len(x))
    centres = x[np.linspace(0, len(x) - 1, cells).astype(int)].copy()
    for _ in range(rounds):
        near = ((x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)).argmin(1)
        for c in range(cells):
            if (near == c).any():
                centres[c] = x[near == c].mean(0)
    return centres


def indexed_nearest(queries: DataFrame, vectors: DataFrame, k: int, probes: int = 8, per_source: int | None = None) -> DataFrame:
    """As nearest, and the same rows, by an inverted index: every vector is filed under its nearest centre.

    A query meets its nearest cells first. The k-th distance found there bounds the true one, so a cell is left out only if its
    radius shows that none of its vectors can come nearer; all others are searched too, for blocks of queries as in nearest. The
    index is fitted on a bounded sample, but holds every row. A cell of more than CELL_ROWS vectors is split, and its queries are
    sent to each part, so no cell is one task's work.
    """
    vectors, queries = vectors.where("embedding is not null"), queries.where("query is not null")
    centres = fit_cells(vectors)
    if not len(centres):
        return nearest(queries, vectors, k, per_source)

    def to_centres(v: pd.Series) -> tuple[np.ndarray, np.ndarray]:
        x = np.stack(v.to_numpy()).astype(np.float64)
        return x, (centres * centres).sum(1) - 2 * x @ centres.T

    def cells_of(m: int):
        @F.pandas_udf(ArrayType(IntegerType()))
        def run(v: pd.Series) -> pd.Series:
            if not len(v):
                return pd.Series([], dtype=object)
            return pd.Series(list(np.argsort(to_centres(v)[1], axis=1, kind="stable")[:, :m].astype(np.int32)))

        return run

    @F.pandas_udf("double")
    def reach(v: pd.Series, cell: pd.Series) -> pd.Series:
        x = np.stack(v.to_numpy()).astype(np.float64) if len(v) else np.zeros((0, centres.shape[1]))
        return pd.Series(np.linalg.norm(x - centres[cell.to_numpy(int)], axis=1))

    filed = vectors.withColumn("cell", F.element_at(cells_of(1)("embedding"), 1))
    sizes = filed.groupBy("cell").agg(F.ceil(F.count("*") / CELL_ROWS).cast("int").alias("parts"), F.max(reach("embedding", "cell")).alias("radius")).collect()  # a row a cell
    parts = vectors.sparkSession.createDataFrame([(r["cell"], r["parts"]) for r in sizes], "cell int, parts int")
    radius = np.full(len(centres), -np.inf)  # empty cells are never searched
    radius[[r["cell"] for r in sizes]] = [r["radius"] for r in sizes]
    in_parts = filed.join(F.broadcast(parts), "cell").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int")).drop("parts")
    asked = queries.withColumn("cell", F.explode(cells_of(min(probes, len(centres)))("query"))).join(F.broadcast(parts), "cell")
    asked = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    d = F.round(T.squared_distance(F.col("query"), F.col("embedding")), 4).alias("distance")
    near = cut_lineage(_ranked(asked.join(in_parts, ["cell", "part"]).select("query_id", "vec_id", "source", d), k, per_source), "near")

    @F.pandas_udf(ArrayType(BooleanType()))
    def open_cells(v: pd.Series, bound: pd.Series) -> pd.Series:
        if not len(v):
            return pd.Series([], dtype=object)
        x, to = to_centres(v)
        least = np.sqrt(np.maximum(to + (x * x).sum(1)[:, None], 0)) - radius
        # distances are rounded to four places, and equal ones rank by id
        found = least <= np.sqrt(bound.to_numpy(float) + 1e-4)[:, None] * (1 + 1e-6) + 1e-6
        np.put_along_axis(found, np.argsort(to, axis=1, kind="stable")[:, : min(probes, len(centres))], False, axis=1)
        return pd.Series(list(found))

    bounds = near.where(F.col("rank") == k).select("query_id", F.col("distance").alias("bound"))
    left = queries.join(bounds, "query_id", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
    left = cut_lineage(left.withColumn("open", open_cells("query", "bound")).where(F.exists("open", lambda x: x)), "open")
    out = near.drop("rank")
    types = dict(filed.dtypes)
    for part in query_blocks(left):
        asked_rows = part.collect()
        open_ = np.array([r["open"] for r in asked_rows], bool)
        bound = np.array([r["bound"] for r in asked_rows], float)

        def pick(near: np.ndarray, batch: pa.RecordBatch, first: int, open_=open_, bound=bound) -> tuple[np.ndarray, np.ndarray]:
            mine = slice(first, first + len(near))
            return np.nonzero(open_[mine][:, batch.column("cell").to_numpy()] & (near <= bound[mine, None] + SLACK))

        met = filed.select("vec_id", "source", "embedding", "cell").mapInArrow(_compared(asked_rows, pick), f"query_id long, vec_id {types['vec_id']}, source {types['source']}, distance double")
        out = out.unionByName(met.withColumn("distance", F.round("distance", 4)))
    return _ranked(out, k, per_source)


def best_distances(queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """(source, distance): least distance of any query to a vector of the source."""

    def pick(near: np.ndarray, batch: pa.RecordBatch, _: int) -> tuple[np.ndarray, np.ndarray]:
        source = np.array(batch.column("source").to_pylist(), dtype=object)
        found = [(near[:, cols], cols) for s in set(source) for cols in [np.flatnonzero(source == s)]]
        best = [(*np.unravel_index(part.argmin(), part.shape), cols) for part, cols in found]
        return np.array([a for a, _, _ in best]), np.array([cols[o] for _, o, cols in best])

    rows = vectors.where("embedding is not null").select("vec_id", "source", "embedding")
    out = None
    for part in query_blocks(queries.where("query is not null")):
        found = rows.mapInArrow(_compared(part.collect(), pick), f"query_id long, vec_id {dict(rows.dtypes)['vec_id']}, source {dict(rows.dtypes)['source']}, distance double")
        out = found if out is None else out.unionByName(found)
    return out.groupBy("source").agg(F.round(F.min("distance"), 4).alias("distance"))


def unit(v: Column) -> Column:
    norm = F.sqrt(T.dot(v, v))
    return F.when(norm > 0, F.transform(v, lambda x: x / norm)).otherwise(v)


#: Most numbers of a matrix of centroids that is sent to the vectors (64 MB).
MATRIX_NUMBERS = 8_000_000


def memberships(vectors: DataFrame, vector: str, label: str, key: str, ratio: float = 0.5, most: int = 8) -> DataFrame:
    """(key, topic, weight): cosine of centred vectors and centroids; kept if positive, at least ratio of the best, and among the
    first by weight (ties by the topic as text); the assigned topic always.

    The centroids are sent to the vectors, which stay where they are: a matrix product a batch, no shuffle. Their size is checked;
    beyond MATRIX_NUMBERS the pairs are made by a join.
    """
    vectors = vectors.where(F.col(vector).isNotNull())
    cents = cut_lineage(centroids(vectors.where(F.col(label) >= 0), label, vector).withColumnRenamed(label, "topic"), "centroids")
    every = exploded(vectors, key, vector).groupBy("dim").agg(F.avg(F.col("x").cast("double")).alias("m"))
    mean = every.agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "m"))), lambda p: p["m"]).alias("mean"))
    size = cents.agg(F.sum(F.size("centroid"))).first()[0] or 0
    if size > MATRIX_NUMBERS:
        return _joined_memberships(vectors, vector, label, key, cents, mean, ratio, most)
    rows = sorted(cents.select(F.col("topic").cast("string").alias("topic"), "centroid").collect(), key=lambda r: r["topic"])
    topics, c, m = np.array([r["topic"] for r in rows], dtype=object), np.array([r["centroid"] for r in rows], np.float64), mean.first()["mean"]
    place = {t: i for i, t in enumerate(topics)}
    m, lengths = np.array(m or [], np.float64), np.sqrt((c * c).sum(-1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows or not len(topics):
                continue
            x = np.stack(b.column("v").to_numpy(zero_copy_only=False)).astype(np.float64) - m
            norm = np.sqrt((x * x).sum(1))[:, None] * lengths
            weight = np.round(np.divide(x @ c.T, norm, out=np.zeros(norm.shape), where=norm > 0), 6)
            rank = np.empty(weight.shape, np.int64)  # topics are in order of their text, so a stable sort breaks ties by it
            np.put_along_axis(rank, np.argsort(-weight, axis=1, kind="stable"), np.arange(weight.shape[1])[None, :], axis=1)
            kept = (weight > 0) & (weight >= ratio * weight.max(1, keepdims=True)) & (rank < most)
            for i, t in enumerate(b.column("assigned").to_pylist()):
                if t in place:
                    kept[i, place[t]] = True
            at, of = np.nonzero(kept)
            yield pa.RecordBatch.from_arrays([b.column("k").take(pa.array(at)), pa.array(topics[of].tolist(), pa.string()), pa.array(weight[at, of])], names=[key, "topic", "weight"])

    asked = vectors.select(F.col(key).alias("k"), F.col(label).cast("string").alias("assigned"), F.col(vector).alias("v"))
    return asked.mapInArrow(run, f"`{key}` {dict(asked.dtypes)['k']}, topic string, weight double")


def _joined_memberships(vectors: DataFrame, vector: str, label: str, key: str, cents: DataFrame, mean: DataFrame, ratio: float, most: int) -> DataFrame:
    centred = vectors.crossJoin(F.broadcast(mean)).select(key, F.col(label).alias("assigned"), F.zip_with(vector, "mean", lambda x, m: x.cast("double") - m).alias("v"))
    weight = F.round(T.cosine(F.col("v"), F.col("centroid")), 6)
    rows = centred.crossJoin(cents).select(key, "assigned", F.col("topic").cast("string").alias("topic"), weight.alias("weight"))
    w = Window.partitionBy(key)
    rows = rows.withColumn("best", F.max("weight").over(w)).withColumn("rank", F.row_number().over(w.orderBy(F.desc("weight"), "topic")))
    kept = (F.col("weight") > 0) & (F.col("weight") >= ratio * F.col("best")) & (F.col("rank") <= most)
    return rows.where(kept | (F.col("topic") == F.col("assigned").cast("string"))).select(key, "topic", "weight")


def seed_matches(seeds: DataFrame, vectors: DataFrame, least: float = 0.15, most: int = 25) -> DataFrame:
    """(seed, key, score, considered, rank): documents at or above the least cosine with a seed; considered counts before the cap.

    Counts combine map-side and the cap is taken before the shuffle, so no seed's matches meet in one task. seeds are written by hand.
    """
    score = F.round(T.cosine(F.col("seed_vector"), F.col("embedding")), 6)
    rows = vectors.crossJoin(F.broadcast(seeds)).select("seed", F.col("vec_id").alias("key"), score.alias("score")).where(F.col("score") >= least)
    counts = rows.groupBy("seed").agg(F.count("*").alias("considered"))
    w = Window.partitionBy("seed").orderBy(F.desc("score"), "key")
    return rows.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= most).join(F.broadcast(counts), "seed").select("seed", "key", "score", "considered", "rank")


def greedy_pairs(candidates: list[tuple[float, str, str]], floor: float = 0.45) -> list[tuple[str, str, float]]:
    """One-to-one naming of topics by phrases: best cosine first, each phrase and topic used once. Topics are few."""
    used_p, used_t, out = set(), set(), []
    for score, phrase, topic in sorted(candidates, key=lambda c: (-c[0], c[1], c[2])):
        if score >= floor and phrase not in used_p and topic not in used_t:
            used_p.add(phrase)
            used_t.add(topic)
            out.append((phrase, topic, score))
    return out


def align(cosines, threshold: float = 0.62, gap: float = 0.25, most: int = 3) -> list[tuple[float, list[tuple[int, int]]]]:
    """Local alignments of two sentence sequences by a matrix of cosines, the strongest first, no row used twice.

    A cell gains its cosine minus the threshold, a gap costs; ties prefer the diagonal, then up, then left.
    """
    c = np.asarray(cosines, float)
    if c.size == 0:
        return []
    n, m = c.shape
    score, move = np.zeros((n + 1, m + 1)), np.zeros((n + 1, m + 1), np.int8)
    for d in range(2, n + m + 1):  # cells of an anti-diagonal depend on the two before it only
        i = np.arange(max(1, d - m), min(n, d - 1) + 1)
        j = d - i
        options = np.stack([np.zeros(len(i)), score[i, j - 1] - gap, score[i - 1, j] - gap, score[i - 1, j - 1] + c[i - 1, j - 1] - threshold])
        best = 3 - options[::-1].argmax(0)  # of equals the diagonal, then up, then left
        score[i, j], move[i, j] = options[best, np.arange(len(i))], best
    used, out = set(), []
    for _ in range(most):
        free = score.copy()
        free[[0, *used], :] = 0.0
        at = int(free.argmax())  # the first of equals: the least i, then the least j
        best, (i, j) = free.flat[at], divmod(at, m + 1)
        if best <= 0:
            break
        path, clash = [], False
        while i > 0 and j > 0 and move[i, j]:
            clash |= i in used
            if move[i, j] == 3:
                path.append((i - 1, j - 1))
                used.add(i)
                i, j = i - 1, j - 1
            elif move[i, j] == 2:
                used.add(i)
                i -= 1
            else:
                j -= 1
        if path and not clash:
            out.append((float(best), path[::-1]))
    return out


def fit_clusters(vectors: DataFrame, key: str, vector: str, clusters: int = 10, seed: int = 42) -> DataFrame:
    """(key, cluster): k-means over all vectors, distributed; fewer clusters where there are fewer vectors, none for an empty table."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = vectors.where(F.col(vector).isNotNull()).select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    n = rows.count()
    if n < 2:
        return rows.select(key, F.lit(0).alias("cluster"))
    model = KMeans(k=min(clusters, n), seed=seed, predictionCol="cluster").fit(rows)
    return model.transform(rows).select(key, "cluster")


def hashed_vectors(texts: DataFrame, key: str, text: str, dims: int = 256) -> DataFrame:
    """(key, vector): hashed counts of the words of each text, of unit length; a text without words has zeros."""
    from pyspark.ml.feature import HashingTF, Normalizer
    from pyspark.ml.functions import vector_to_array

    rows = texts.select(key, T.bm25_tokens(F.coalesce(F.col(text), F.lit(""))).alias("words"))
    hashed = HashingTF(numFeatures=dims, inputCol="words", outputCol="counts").transform(rows)
    return Normalizer(inputCol="counts", outputCol="unit").transform(hashed).select(key, vector_to_array("unit").alias("vector"))
