"""Vector store reads: exact nearest neighbours, pages, counts and checks."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvale.functions.text import fallback_embedding

#: Embedding sizes by model; other models have 768.
MODEL_DIMENSIONS = {"text-embedding-3-small": 1536, "text-embedding-3-large": 3072, "text-embedding-ada-002": 1536, "text-embedding-004": 768, "text-embedding-005": 768}
DEFAULT_DIMENSION = 768
COLLECTIONS = ("code_symbols", "code_files", "code_modules")
MAX_EMBEDDED_CHARS = 12_000
#: Queries and rows of one matrix product, pairs computed anew at a time, and what a product may be off by, rounding included.
QUERY_TILE, ROW_TILE, PAIR_TILE, MARGIN = 1_000, 2_000, 100_000, 4e-9


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def distance(a: Column, b: Column, space: str = "cosine") -> Column:
    """Distance of two vectors: cosine (1 - cos), l2 (squared, as vector stores report it) or ip (1 - dot). Null for unequal lengths."""
    if space == "cosine":
        value = 1 - _dot(a, b) / F.sqrt(_dot(a, a) * _dot(b, b))
    elif space == "l2":
        value = F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    elif space == "ip":
        value = 1 - _dot(a, b)
    else:
        raise ValueError(f"unknown space: {space}")
    return F.when(F.size(a) == F.size(b), value)


def _literal(vector: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def top_k(vectors: DataFrame, query: list[float], k: int, space: str = "cosine", where: Column | None = None) -> DataFrame:
    """The k rows nearest to query, with distance; ties by id. One pass, each task keeps k rows."""
    rows = vectors if where is None else vectors.where(where)
    return rows.withColumn("distance", distance(F.col("embedding"), _literal(query), space)).where("distance IS NOT NULL").orderBy("distance", "id").limit(k)


def top_k_per_collection(vectors: DataFrame, query: list[float], k: int, space: str = "cosine") -> DataFrame:
    """The k nearest rows of each collection, in one job; the group limit is applied before the shuffle."""
    ranked = vectors.withColumn("distance", distance(F.col("embedding"), _literal(query), space)).where("distance IS NOT NULL")
    return ranked.withColumn("rank", F.row_number().over(Window.partitionBy("collection").orderBy("distance", "id"))).where(F.col("rank") <= k)


def _seq_dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row dot products, summed in the order of the components, as _dot does."""
    total = np.zeros(len(a))
    for n in range(a.shape[1]):
        total += a[:, n] * b[:, n]
    return total


class _Nearest:
    """The k best of each query among the vectors seen so far, by rounded cosine distance, then id.

    One matrix product gives distances to within MARGIN; only what may still enter is then computed exactly."""

    def __init__(self, queries: np.ndarray, k: int):
        self.q, self.k = queries, k
        self.norm = _seq_dot(queries, queries)
        with np.errstate(all="ignore"):
            self.unit = queries / np.sqrt(self.norm)[:, None]
        self.best: list[list] = [[] for _ in queries]
        self.bound = np.full(len(queries), np.inf)

    def add(self, ids: list, rows: np.ndarray) -> None:
        norm = _seq_dot(rows, rows)
        with np.errstate(all="ignore"):
            unit = rows / np.sqrt(norm)[:, None]
            for at in range(0, len(self.q), QUERY_TILE):
                part = slice(at, at + QUERY_TILE)
                near = 1 - self.unit[part] @ unit.T
                held = ~(near > (self.bound[part] + MARGIN)[:, None])  # NaN may enter too
                if len(ids) > 4 * self.k:  # the k-th of this tile bounds what may enter
                    kth = np.partition(np.where(np.isnan(near), np.inf, near), self.k - 1, axis=1)[:, self.k - 1] if np.isinf(self.bound[part]).any() else None
                    held &= ~(near > (kth + MARGIN)[:, None]) if kth is not None else True
                which, row = np.nonzero(held)
                which += at
                exact = np.concatenate([1 - _seq_dot(rows[r], self.q[w]) / np.sqrt(norm[r] * self.norm[w]) for w, r in ((which[n : n + PAIR_TILE], row[n : n + PAIR_TILE]) for n in range(0, max(1, len(which)), PAIR_TILE))])
                rounded = np.where(np.isnan(exact), np.inf, np.floor(exact * 1e9 + 0.5) / 1e9)
                for n in np.flatnonzero(np.diff(which, prepend=-1)):
                    w = which[n]
                    end = np.searchsorted(which, w, side="right")
                    fresh = [(rounded[m], ids[row[m]], exact[m]) for m in range(n, end)]
                    self.best[w] = heapq.nsmallest(self.k, self.best[w] + fresh, key=lambda x: x[:2])
                    if len(self.best[w]) == self.k:
                        self.bound[w] = self.best[w][-1][0]


def _nearest(asked: DataFrame, k: int):
    """Partition function over (id, embedding): the k best of each asked vector within the partition."""
    groups: dict[int, tuple[list, list]] = {}
    for r in asked.collect():
        if r["query"] is not None and None not in r["query"]:
            names, rows = groups.setdefault(len(r["query"]), ([], []))
            names.append(r["query_id"])
            rows.append(r["query"])
    shipped = asked.sparkSession.sparkContext.broadcast({n: (names, np.array(rows, dtype=np.float64)) for n, (names, rows) in groups.items() if n})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = {n: _Nearest(rows, k) for n, (_, rows) in shipped.value.items()}
        for batch in batches:
            batch = batch[[e is not None for e in batch["embedding"]]]
            for n, own in batch.groupby(batch["embedding"].map(len)):
                if n not in best:
                    continue
                good = [e.dtype != object or all(x is not None for x in e) for e in own["embedding"]]
                own = own[good]
                for at in range(0, len(own), ROW_TILE):
                    some = own.iloc[at : at + ROW_TILE]
                    best[n].add(some["id"].tolist(), np.stack([np.asarray(e, dtype=np.float64) for e in some["embedding"]]))
        for n, found in best.items():
            rows = [(name, i, d) for name, top in zip(shipped.value[n][0], found.best) for _, i, d in top]
            yield pd.DataFrame(rows, columns=["query_id", "id", "distance"])

    return run


def top_k_many(vectors: DataFrame, queries: DataFrame, k: int, space: str = "cosine", block: int = 20_000) -> DataFrame:
    """(query_id, id, distance, rank): the k nearest rows for each query (query_id, query), exactly; distances count to 9 places.

    Queries meet all rows in blocks of about block, each small enough to be broadcast; each partition keeps its own k best of a
    query before the shuffle. Cosine distances are matrix products, what may count is computed anew in order of components. The
    job stays one comparison for each query and row."""
    blocks = max(1, -(-queries.count() // block))
    kinds = dict(vectors.dtypes) | dict(queries.dtypes)
    found = None
    for n in range(blocks):
        some = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == n)
        if space == "cosine":
            near = vectors.select("id", "embedding").mapInPandas(_nearest(some.select("query_id", "query"), k), f"query_id {kinds['query_id']}, id {kinds['id']}, distance double")
        else:
            pairs = vectors.select("id", "embedding").join(F.broadcast(some.select("query_id", "query")), how="inner", on=F.lit(True))
            near = pairs.select("query_id", "id", distance(F.col("embedding"), F.col("query"), space).alias("distance")).where("distance IS NOT NULL")
        ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("distance", 9), "id"))).where(F.col("rank") <= k)
        found = ranked if found is None else found.unionByName(ranked)
    return found


def page(rows: DataFrame, limit: int, offset: int = 0, where: Column | None = None) -> DataFrame:
    """Rows by id, from offset on."""
    if not (1 <= limit <= 1000 and 0 <= offset <= 100_000):
        raise ValueError("limit must be 1 to 1000 and offset 0 to 100000")
    return (rows if where is None else rows.where(where)).orderBy("id").offset(offset).limit(limit)


def collection_counts(vectors: DataFrame, repo: str | None = None) -> DataFrame:
    """(collection, total, of_repo) counts."""
    of_repo = F.count_if(F.col("repo_id") == repo) if repo else F.count(F.lit(1))
    return vectors.groupBy("collection").agg(F.count(F.lit(1)).alias("total"), of_repo.alias("of_repo"))


def collection_diagnostics(vectors: DataFrame, names: list[str], repo: str | None = None) -> DataFrame:
    """(collection, total, of_repo, error) of each named collection: one that is not there has an error, the others stand."""
    asked = vectors.sparkSession.createDataFrame([(n,) for n in names], "collection string")
    rows = asked.join(collection_counts(vectors, repo), "collection", "left")
    return rows.select("collection", "total", "of_repo", F.when(F.col("total").isNull(), F.concat(F.lit("collection not found: "), F.col("collection"))).alias("error"))


def total_of(vectors: DataFrame, repo: str, collections: tuple[str, ...] = COLLECTIONS) -> DataFrame:
    """One row: the number of a repository's vectors in some collections."""
    return vectors.where((F.col("repo_id") == repo) & F.col("collection").isin(*collections)).agg(F.count(F.lit(1)).alias("total"))


def model_dimension(model: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in MODEL_DIMENSIONS.items() for x in pair])
    return F.try_element_at(known, model)


def embed(rows: DataFrame, text: str = "text", dimension: int = 256) -> DataFrame:
    """Adds embedding: the offline fallback over the first characters of a text. A real provider takes its place as a pandas UDF."""
    return rows.withColumn("embedding", fallback_embedding(F.substring(F.col(text), 1, MAX_EMBEDDED_CHARS), dimension))


def checked(vectors: DataFrame, dimension: int) -> DataFrame:
    """The same rows; fails at run time if a vector has another size."""
    return vectors.where(F.assert_true(F.size("embedding") == dimension, F.lit(f"vectors must have {dimension} components")).isNull())


def compatibility(runtime: DataFrame, model: str) -> DataFrame:
    """Whether a query's model fits the model of a repository's last ingestion: null when either is unknown."""
    asked, last = model_dimension(F.lit(model)), model_dimension(F.col("embedding_model"))
    blank = F.coalesce(F.col("embedding_model"), F.lit("")) == ""
    reason = (
        F.when(blank, "repo_runtime_embedding_unknown")
        .when(asked.isNull() | last.isNull(), "embedding_dimension_unknown")
        .when(asked != last, "embedding_dimension_mismatch")
        .otherwise("embedding_compatible")
    )
    return runtime.select(
        "repo_id",
        asked.cast("long").alias("query_dimension"),
        F.when(~blank, last).cast("long").alias("last_dimension"),
        reason.alias("reason"),
        F.when(reason == "embedding_compatible", True).when(reason == "embedding_dimension_mismatch", False).alias("compatible"),
    )


#: What each read operation of the administration needs.
OPERATIONS = {"list": (), "count": ("collection",), "metadata": ("collection",), "get": ("collection",), "peek": ("collection",), "query": ("collection", "query_text")}


def admin_read(vectors: DataFrame, operation: str, collection: str | None = None, query_text: str | None = None, limit: int = 10, offset: int = 0, n_results: int = 10, where: Column | None = None) -> DataFrame:
    """Checks an administration request and runs it: list, count, metadata, get, peek (no offset) or query by text."""
    if operation not in OPERATIONS:
        raise ValueError(f"unknown operation: {operation}")
    given = {"collection": collection, "query_text": query_text}
    missing = [a for a in OPERATIONS[operation] if not given[a]]
    if missing:
        raise ValueError(f"{operation} needs {', '.join(missing)}")
    if not 1 <= n_results <= 100:
        raise ValueError("n_results must be 1 to 100")
    if operation == "list":
        return vectors.select("collection").distinct().orderBy("collection")
    own = vectors.where(F.col("collection") == collection)
    if operation == "count":
        return (own if where is None else own.where(where)).agg(F.count(F.lit(1)).alias("total"))
    if operation == "metadata":
        return own.groupBy("collection").agg(F.count(F.lit(1)).alias("total"), F.max(F.size("embedding")).alias("dimension"))
    if operation == "peek":
        return page(own, limit, 0)
    if operation == "get":
        return page(own, limit, offset, where)
    size = own.select(F.size("embedding").alias("n")).first()
    if size is None:
        return own.withColumn("distance", F.lit(None).cast("double"))
    asked = own.sparkSession.range(1).select(fallback_embedding(F.lit(query_text), size["n"]).alias("e")).first()["e"]
    return top_k(own, asked, n_results, where=where)
