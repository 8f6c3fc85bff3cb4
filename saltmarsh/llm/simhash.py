"""SimHash near-duplicates: positional byte index, count filter, check, components.

A document's fingerprint has the bits set in over half of the XXH64 values (seed 42) of its shingles of
three words, repeats included. Two fingerprints link at ``MAX_BITS`` or fewer differing bits. So they
differ in at most three of their eight bytes and share five or more, each at its own position: the guaranteed
minimum of matches. Postings of single positional bytes would hold one fingerprint in 256 each, and their pairs
grow with the square of that; so the index posts four positional bytes at a time, and 14 such postings are
enough. Its position sets are the blocks of a Steiner quadruple system on eight points, whose complements hold
every triple of positions, so that whichever bytes differ, one set avoids them all. In a list, the shared
positional bytes of a pair are tallied, pairs with fewer than five go, and the differing bits of the rest are
counted.

Lists are read as streams, sorted by posting. One of more than ``LIST_MOST`` fingerprints is not compared as a
whole: its fingerprints are posted again with a fifth positional byte, each of the other four in turn, as linked
ones share one of those. What then shares a list differs in 24 bits at most, of which there are ``2 ** 24``
fingerprints, and neighbours are looked up by flipping up to three of the bits, so that time is in proportion to
the list.

Equal fingerprints are one class before all that; a list gives the links of a spanning forest of its
linked fingerprints rather than all pairs, and components are found by alternating star contractions,
all as tables.

Defined cases: null and empty texts, and texts of white space, have the fingerprint 0 and link as any
other; texts of fewer than three words have one shingle; a null id counts as a row, but never names a
component, which is null if all its ids are; repeated rows are rows of one class; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saltmarsh.llm._text import safe_name
from saltmarsh.session import cut, numbered

SEED = 42
SHINGLE = 3
MAX_BITS = 3
#: Bytes that two linked fingerprints share at least.
MIN_SHARED = 8 - MAX_BITS
#: Position sets {a, b, c, a ^ b ^ c}: 14 blocks of which one avoids any three positions.
BLOCKS = sorted({tuple(sorted((a, b, c, a ^ b ^ c))) for a in range(8) for b in range(a) for c in range(b)})
#: Shingles whose bits are counted at once.
PART = 1 << 16
#: Fingerprints of one list of four bytes; longer lists are divided by a fifth.
LIST_MOST = 4096


def fingerprint(text: bytes) -> int:
    """The fingerprint of one text."""
    words = text.lower().split()  # on bytes: A-Z, and the six ASCII white-space characters
    if not words:
        return 0
    n = max(1, len(words) - SHINGLE + 1)
    body = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    first = np.zeros(n, np.int64)
    first[1:] = ends[: n - 1] + 1
    last = ends[len(words) - n :]
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for k in range(0, n, PART):
        h = np.array([digest(body[s:e], SEED) for s, e in zip(first[k : k + PART].tolist(), last[k : k + PART].tolist())], np.uint64)
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(sum(1 << b for b in np.flatnonzero(2 * counts > n).tolist()))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", long_cols: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fp) with the fingerprint as a signed long, and the columns ``long_cols`` as given."""
    names = ["doc_id", "fp", *long_cols]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            values = np.fromiter((fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64)), *batch.columns[2:]], names)

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"), *long_cols)
    return slim.mapInArrow(run, ", ".join(f"`{x}` long" for x in names))


def _near_pairs(front: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """Which of ``rest`` are linked to one of ``front``, pair by pair."""
    found = np.zeros(len(rest), bool)
    step = max(1, (1 << 18) // len(rest))
    for k in range(0, len(front), step):
        differ = front[k : k + step, None] ^ rest[None, :]
        shared = (differ.view(np.uint8).reshape(*differ.shape, 8) == 0).sum(axis=2)
        _, at = np.nonzero(shared >= MIN_SHARED)
        near = np.bitwise_count(differ[shared >= MIN_SHARED]) <= MAX_BITS
        found[at[near]] = True
    return found


def _near_flips(front: np.ndarray, rest: np.ndarray, flips: np.ndarray) -> np.ndarray:
    """Which of ``rest`` (ascending) are linked to one of ``front``, by flipped bits."""
    found = np.zeros(len(rest), bool)
    for k in range(0, len(front), 64):
        wanted = (front[k : k + 64, None] ^ flips[None, :]).ravel()
        at = np.minimum(np.searchsorted(rest, wanted), len(rest) - 1)
        found[at[rest[at] == wanted]] = True
    return found


def spanning_links(values: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect the fingerprints of one list that are linked, directly or through others."""
    links = []
    rest = np.unique(values)
    free = int(np.bitwise_or.reduce(rest ^ rest[0])) if len(rest) else 0
    bits = [1 << b for b in range(64) if free >> b & 1]
    n = len(bits)
    few = n + n * (n - 1) // 2 + n * (n - 1) * (n - 2) // 6 < len(rest)
    flips = np.array([sum(x) for k in (1, 2, 3) for x in combinations(bits, k)], np.uint64) if few else None
    while len(rest) > 1:
        root, rest = rest[0], rest[1:]
        front = np.array([root], np.uint64)
        while len(front) and len(rest):
            found = _near_pairs(front, rest) if flips is None or len(rest) < len(flips) else _near_flips(front, rest, flips)
            front, rest = rest[found], rest[~found]
            links += [(int(root), int(x)) for x in front]
    return links


def _lists(batches: Iterator[pa.RecordBatch], most: int | None) -> Iterator[tuple[int, np.ndarray, bool]]:
    """(posting, fingerprints, whether that is its whole list) of (key, fp) sorted by key; single ones are left out.

    A list of over ``most`` comes in parts.
    """
    key, held, size, over = None, [], 0, False

    def done() -> Iterator[tuple[int, np.ndarray, bool]]:
        if over or size > 1:
            yield key, np.concatenate(held), not over

    for batch in batches:
        keys, fps = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
        if not len(keys):
            continue
        cuts = np.append(np.flatnonzero(np.append(True, keys[1:] != keys[:-1])), len(keys))
        wide = np.flatnonzero(np.diff(cuts) > 1).tolist()
        for k in sorted({0, len(cuts) - 2, *wide}):
            s, e = int(cuts[k]), int(cuts[k + 1])
            if keys[s] != key:
                yield from done()
                key, held, size, over = keys[s], [], 0, False
            held.append(fps[s:e])
            size += e - s
            if most is not None and size > most:
                over = True
                yield key, np.concatenate(held), False
                held, size = [np.zeros(0, np.uint64)], 0
    yield from done()


def _linked(posted: DataFrame, most: int | None) -> DataFrame:
    """(a, b, key, fp): the links of each list of (key, fp), or its postings where it is longer than ``most``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["a", "b", "key", "fp"]
        for key, fps, whole in _lists(batches, most):
            if whole:
                ends = np.array(spanning_links(fps), np.uint64).reshape(-1, 2).view(np.int64)
                none = pa.nulls(len(ends), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1]), none, none], names)
            else:
                none = pa.nulls(len(fps), pa.int64())
                yield pa.RecordBatch.from_arrays([none, none, pa.array(np.full(len(fps), key, np.int64)), pa.array(fps.view(np.int64))], names)

    return posted.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long, key long, fp long")


def links(distinct: DataFrame) -> DataFrame:
    """(a, b), a < b as unsigned: links whose components are those of all pairs within ``MAX_BITS``."""
    fp = F.col("fp")

    def byte(k: int):
        return F.shiftrightunsigned(fp, 8 * k).bitwiseAND(F.lit(0xFF))

    keys, more = [], []
    for number, block in enumerate(BLOCKS):
        key = F.lit(number).cast("long")
        for k in block:
            key = F.shiftleft(key, 8).bitwiseOR(byte(k))
        keys.append(key)
        more.append(F.array(*[F.shiftleft(F.shiftleft(F.col("key"), 3).bitwiseOR(F.lit(k).cast("long")), 8).bitwiseOR(byte(k)) for k in range(8) if k not in block]))
    found = cut(_linked(distinct.select(F.explode(F.array(*keys)).alias("key"), "fp"), LIST_MOST))
    near = found.where(F.col("fp").isNull()).select("a", "b")
    long_ = found.where(F.col("fp").isNotNull())
    if long_.isEmpty():
        return near.distinct()
    again = long_.select(F.explode(F.element_at(F.array(*more), (F.shiftrightunsigned("key", 32) + 1).cast("int"))).alias("key"), "fp")
    return near.unionByName(_linked(again, None).select("a", "b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); the root is the least node it can reach.

    Large stars and small stars in turn until the edges stay the same. Minima are aggregated before they
    are shuffled, and neighbours are never gathered.
    """
    now = cut(edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).where("hi <> lo").distinct())
    mark = None
    while True:
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(now.select("lo", "hi"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).where("hi <> lo").distinct()
        lowest = large.groupBy("hi").agg(F.min("lo").alias("m"))
        kept = lowest.select("hi", F.col("m").alias("lo"))
        down = large.join(lowest, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        now = cut(kept.union(down).distinct())
        new = now.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if tuple(new) == mark:
            return now.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
        mark = tuple(new)


def rooted(distinct: DataFrame) -> DataFrame:
    """The rows of ``distinct``, one a fingerprint, with the least fingerprint of their component as ``root``."""
    roots = components(links(distinct))
    return distinct.join(roots, distinct.fp == roots.node, "left").select(*distinct.columns, F.coalesce("root", "fp").alias("root"))


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``."""
    rows = cut(fingerprints(docs, id_col, text_col))
    distinct = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least_id")))
    grouped = rooted(distinct)
    named = grouped.groupBy("root").agg(F.min("least_id").alias("component_id"))
    classes = cut(grouped.join(named, "root").select("fp", "component_id"))
    return rows.join(classes, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, columns as given: that of the least id, null ids last.

    Of rows that share that id the one of the least text hash stays, and of equal texts any one.
    """
    row = safe_name([*docs.columns, "doc_id", "fp", "text", "hash"], "row_no")
    hash_ = safe_name([*docs.columns, "doc_id", "fp", "text", row], "text_hash")
    rows = numbered(docs, row)
    marked = fingerprints(rows.withColumn(hash_, F.xxhash64(text_col)), id_col, text_col, (hash_, row))
    # A class and then a component is one row before its rows are compared, however many it has.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col(hash_).alias("hash"), F.col(row).alias("row")))
    grouped = rooted(cut(marked.groupBy("fp").agg(first.alias("first"))))
    stay = grouped.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.row").alias("stays"))
    return rows.join(stay, rows[row] == stay["stays"], "left_semi").drop(row)
