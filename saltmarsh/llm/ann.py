"""Approximate nearest neighbours by additive quantisation with exact reranking.

A vector is approximated by a sum of ``BOOKS`` full-dimensional codewords, one of each codebook. Codebooks
start as k-means of what the ones before leave over, on a bounded sample, and are then fitted together by
least squares in turn with encoding. Encoding keeps the ``BEAM`` best partial sums. With the codes a
vector's norm is stored, as its ratio to the norm of the sum. A query makes one table of inner products
with all codewords; a vector's score is the sum of its entries times that ratio.

Vectors are coded as directions, and their lengths are kept in double precision, so numbers beyond single
precision are ranked as any other. Every row is indexed. Queries and rows are dealt to blocks by a hash of their
row number; a query block meets each row block once. There the ``RERANK`` rows of the best scores go on to exact
inner products in double precision, and the best ``top`` of those leave the meeting. The share of a block that is
reranked is the same at any number of blocks, and so is what a task holds.

Defined cases: null vectors, null ids, vectors that are empty, zero, or hold null or non-finite numbers take no
part; vectors of different lengths have no inner product, so each length is searched on its own (one job for
each); rows that repeat an id are queries and candidates of their own, and only the query's own row is none of its
candidates; equal scores go to the smaller id; an inner product that is no number, as of infinite parts, is the
least; where no query or no other row is left the result is empty; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saltmarsh.session import numbered

BOOKS, WORDS, BEAM = 24, 64, 4
FIT_ROWS = 8192
FIT_ROUNDS = 2
RERANK = 288
TOP = 20
QUERY_BLOCK, ROW_BLOCK = 4096, 8192
QUERY_STEP = 20


@dataclass
class Quantiser:
    """Codebooks as (books, words, dimension)."""

    books: np.ndarray

    @staticmethod
    def fit(x: np.ndarray, books: int = BOOKS, words: int = WORDS, rounds: int = FIT_ROUNDS) -> Quantiser:
        rng = np.random.default_rng(11)
        x = x.astype(np.float32)
        left, made = x.copy(), []
        for _ in range(books):
            centres = left[rng.choice(len(left), words, replace=len(left) < words)].copy()
            for _ in range(8):
                nearest = _nearest(left, centres)
                counts = np.bincount(nearest, minlength=words)
                sums = np.zeros_like(centres)
                np.add.at(sums, nearest, left)
                empty = counts == 0
                centres[~empty] = sums[~empty] / counts[~empty, None]
            made.append(centres)
            left -= centres[_nearest(left, centres)]
        out = Quantiser(np.stack(made))
        for _ in range(rounds):
            codes = out.encode(x).astype(np.int64) + np.arange(books) * words
            gram = np.zeros((books * words, books * words))
            right = np.zeros((books * words, x.shape[1]))
            for a in range(books):
                np.add.at(right, codes[:, a], x)
                for b in range(books):
                    np.add.at(gram, (codes[:, a], codes[:, b]), 1.0)
            gram[np.diag_indices_from(gram)] += 1.0
            # The ridge pulls to the books so far, which keeps unused words in place.
            right += out.books.reshape(books * words, -1)
            out = Quantiser(np.linalg.solve(gram, right).reshape(out.books.shape).astype(np.float32))
        return out

    def encode(self, x: np.ndarray, beam: int = BEAM) -> np.ndarray:
        """Codes as (rows, books), by beam search."""
        out = []
        for k in range(0, len(x), 2048):
            out.append(self._encode(x[k : k + 2048].astype(np.float32), beam))
        return np.concatenate(out) if out else np.zeros((0, len(self.books)), np.uint8)

    def _encode(self, x: np.ndarray, beam: int) -> np.ndarray:
        n, d = x.shape
        words = self.books.shape[1]
        left = x[:, None, :]  # rows, beams, dimension
        codes = np.zeros((n, 1, 0), np.uint8)
        for book in self.books:
            error = (book * book).sum(axis=1) - 2 * (left.reshape(-1, d) @ book.T).reshape(n, left.shape[1], words)
            error += (left * left).sum(axis=2)[:, :, None]
            flat = error.reshape(n, -1)
            keep = min(beam, flat.shape[1])
            best = np.argpartition(flat, keep - 1, axis=1)[:, :keep]
            which, word = best // words, best % words
            rows = np.arange(n)[:, None]
            left = left[rows, which] - book[word]
            codes = np.concatenate([codes[rows, which], word[:, :, None].astype(np.uint8)], axis=2)
        least = (left * left).sum(axis=2).argmin(axis=1)
        return codes[np.arange(n), least]

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return sum(self.books[m][codes[:, m]] for m in range(len(self.books)))

    def ratios(self, x: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The stored norms: those of the vectors over those of their sums."""
        made = np.linalg.norm(self.decode(codes), axis=1)
        return np.where(made > 0, np.linalg.norm(x, axis=1) / np.maximum(made, 1e-30), 1.0).astype(np.float32)

    def scores(self, queries: np.ndarray, codes: np.ndarray, ratios: np.ndarray) -> np.ndarray:
        """(queries, rows) estimated inner products, by table."""
        out = np.zeros((len(queries), len(codes)), np.float32)
        for m, book in enumerate(self.books):
            out += (queries.astype(np.float32) @ book.T)[:, codes[:, m]]
        return out * ratios


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres * centres).sum(axis=1) - 2 * (x @ centres.T)).argmin(axis=1)


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(row, vec_id, v) of the rows that take part, v as an array of doubles, or of floats if given as such."""
    v = F.col("v")
    kind = "array<float>" if dict(vectors.dtypes)[vec_col] == "array<float>" else "array<double>"
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast(kind).alias("v"))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = rows.where(F.col("vec_id").isNotNull() & v.isNotNull() & F.coalesce(fine, F.lit(False)))
    return numbered(rows, "row").select("row", "vec_id", "v")


def directions(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of length one, in single precision, and the lengths in double precision."""
    most = np.abs(x).max(axis=1, keepdims=True)
    scaled = x / most
    length = np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))
    with np.errstate(over="ignore"):
        return (scaled / length).astype(np.float32), np.minimum(most * length, np.finfo(np.float64).max)[:, 0]


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def best_of(scores: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """The places of the n greatest scores, of equal ones the smaller ids; ``ids`` ascend."""
    if len(scores) <= n:
        return np.arange(len(scores))
    line = np.partition(scores, len(scores) - n)[len(scores) - n]
    above = np.flatnonzero(scores > line)
    return np.concatenate([above, np.flatnonzero(scores == line)[: n - len(above)]])


def search(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", query_step: int = QUERY_STEP, top: int = TOP, rerank: int = RERANK) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``top`` nearest of every row whose id ``query_step`` divides."""
    rows = usable(vectors, id_col, vec_col)
    found = [_search(rows.where(F.size("v") == r["d"]), query_step, top, rerank) for r in rows.groupBy(F.size("v").alias("d")).count().orderBy("d").collect()]
    if not found:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return reduce(DataFrame.unionByName, found)


def _search(rows: DataFrame, query_step: int, top: int, rerank: int) -> DataFrame:
    """``search`` among rows of one length."""
    is_query = F.col("vec_id") % query_step == 0
    n, n_queries = rows.agg(F.count("*"), F.count_if(is_query)).first()
    if not n_queries:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sample = _matrix(rows.orderBy(F.xxhash64("vec_id"), "vec_id", "row").limit(FIT_ROWS).select("v").toArrow().column(0))
    quantiser = Quantiser.fit(np.unique(directions(sample)[0], axis=0))
    row_blocks, query_blocks = -(-n // ROW_BLOCK), -(-n_queries // QUERY_BLOCK)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(2))
            if not len(x):
                continue
            x, lengths = directions(x)
            codes = quantiser.encode(x)
            norms = lengths * quantiser.ratios(x, codes)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norms, pa.float64())], ["row", "vec_id", "v", "codes", "norm"])

    def dealt(blocks: int, salt: int):
        return F.pmod(F.xxhash64("row", F.lit(salt)), F.lit(blocks)).cast("int")

    index = rows.mapInArrow(encode, f"row long, vec_id long, v {dict(rows.dtypes)['v']}, codes binary, norm double")
    index = index.select("*", dealt(row_blocks, 1).alias("rb"), F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("qb"))
    queries = rows.where(is_query).select("row", "vec_id", "v", dealt(query_blocks, 2).alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1))).alias("rb"))

    def meet(q: pa.Table, r: pa.Table) -> pa.Table:
        found_rows, found_ids, lists = [], [], []
        if q.num_rows and r.num_rows:
            ids, number = r.column("vec_id").to_numpy(), r.column("row").to_numpy()
            order = np.lexsort((number, ids))
            ids, number, vectors = ids[order], number[order], _matrix(r.column("v"))[order]
            codes = np.frombuffer(b"".join(r.column("codes").to_pylist()), np.uint8).reshape(len(ids), -1)[order]
            norms = r.column("norm").to_numpy()[order]
            norms = (norms / norms.max()).astype(np.float32)  # scores are compared within the block
            place = dict(zip(number.tolist(), range(len(number))))
            x = _matrix(q.column("v"))
            turned = directions(x)[0]
            of = list(zip(q.column("row").to_pylist(), q.column("vec_id").to_pylist()))
            for k in range(0, len(of), 128):
                scores = quantiser.scores(turned[k : k + 128], codes, norms)
                for i, (row, query) in enumerate(of[k : k + 128]):
                    if row in place:
                        scores[i, place[row]] = -np.inf
                    at = np.sort(best_of(scores[i], ids, rerank))
                    at = at[scores[i, at] > -np.inf]
                    with np.errstate(over="ignore", invalid="ignore"):
                        exact = (vectors[at] * x[k + i]).sum(axis=1)  # the same for equal vectors wherever they stand
                    exact[np.isnan(exact)] = -np.inf
                    best = best_of(exact, ids[at], top)
                    found_rows.append(row)
                    found_ids.append(query)
                    lists.append(ids[at[best]].tobytes() + exact[best].tobytes())
        return pa.table([pa.array(found_rows, pa.int64()), pa.array(found_ids, pa.int64()), pa.array(lists, pa.binary())], names=["row", "query_id", "found"])

    met = queries.groupBy("qb", "rb").cogroup(index.groupBy("qb", "rb")).applyInArrow(meet, "row long, query_id long, found binary")

    def merge(table: pa.Table) -> pa.Table:
        ids, scores = [], []
        for body in table.column("found").to_pylist():
            k = len(body) // 16
            ids.append(np.frombuffer(body, np.int64, k))
            scores.append(np.frombuffer(body, np.float64, k, 8 * k))
        ids, scores = np.concatenate(ids), np.concatenate(scores)
        order = np.lexsort((ids, -scores))[:top]
        query = np.full(len(order), table.column("query_id")[0].as_py(), np.int64)
        return pa.table([pa.array(query), pa.array(np.arange(1, len(order) + 1, dtype=np.int32)), pa.array(ids[order]), pa.array(scores[order])], names=["query_id", "rank", "vec_id", "score"])

    return met.groupBy("row").applyInArrow(merge, "query_id long, rank int, vec_id long, score double")
