"""Benchmark decontamination with a generalised suffix automaton of the items' words.

Words are runs of bytes that are digits, letters (A-Z lowered) or above 127. The automaton holds every
sequence of consecutive words of every item. A document's words stream through it; after each word it
knows the longest run ending there that some item has. Where that reaches ``WINDOW`` words, the last
``WINDOW`` words are a window of an item; an item of fewer words is one window as a whole. Every word
inside an occurrence is hit; the share of hit words decides.

Words come from whole-array operations on the bytes; those unknown to every item send the automaton back
to its start, so only runs of known words that could hold a window are streamed one by one (and compared
as bytes, not as hashes).

Items are read in shards of at most ``SHARD_WORDS`` words (an item of more is a shard of its own), one automaton
each; a document's hits are the union over the shards. Shards follow one another: the documents are scanned once
for each, and what was hit is written before the next is read, so that driver and tasks hold one shard.

Defined cases: a null text has no words; an item without words has no window; a null item id cannot be
listed, so its windows are hit but it is not counted; an id that repeats counts once; a document
without words is clean; repeated rows are found alike; without documents the result is empty, without items no
word is hit; other columns are kept by ``clean`` and not read otherwise.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saltmarsh.llm._text import ASCII_LOWER, rows_of, runs, safe_name, slices, span_hashes
from saltmarsh.session import cut, numbered

WINDOW = 13
#: A document with hit words is contaminated if they are one in this many or more.
COVERAGE = 20
SHARD_WORDS = 200_000
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_IS_WORD = np.zeros(256, bool)
_IS_WORD[48:58] = _IS_WORD[97:123] = _IS_WORD[128:] = True


def words_of(text: bytes) -> list[bytes]:
    return _WORD.findall(text.lower())


class SuffixAutomaton:
    """All runs of consecutive words of a set of items, with the items that hold each window."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.step: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]
        coded = []
        for name, words in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]
            if ids:
                coded.append((name, ids))
                self._add(ids)
        #: (state, window length) to the ids of the items that have that window.
        self.items: dict[tuple[int, int], set] = {}
        self.lengths = sorted({min(window, len(ids)) for _, ids in coded})
        for name, ids in coded:
            n = min(window, len(ids))
            for k, (state, length) in enumerate(self.stream(ids)):
                if k + 1 >= n and length >= n:
                    self.items.setdefault((self.at(state, n), n), set()).add(name)
        self.shortest = min(self.lengths, default=0)

    def _add(self, ids: list[int]) -> None:
        last = 0
        for c in ids:
            if c in self.step[last]:
                q = self.step[last][c]
                last = q if self.size[q] == self.size[last] + 1 else self._split(last, c, q)
                continue
            new = len(self.size)
            self.step.append({})
            self.link.append(0)
            self.size.append(self.size[last] + 1)
            p = last
            while p >= 0 and c not in self.step[p]:
                self.step[p][c] = new
                p = self.link[p]
            if p >= 0:
                q = self.step[p][c]
                self.link[new] = q if self.size[q] == self.size[p] + 1 else self._split(p, c, q)
            last = new

    def _split(self, p: int, c: int, q: int) -> int:
        twin = len(self.size)
        self.step.append(dict(self.step[q]))
        self.link.append(self.link[q])
        self.size.append(self.size[p] + 1)
        self.link[q] = twin
        while p >= 0 and self.step[p].get(c) == q:
            self.step[p][c] = twin
            p = self.link[p]
        return twin

    def stream(self, ids: list[int]) -> Iterator[tuple[int, int]]:
        """After each word: the state, and the length of the longest run ending there that an item has."""
        state, length = 0, 0
        for c in ids:
            while state and c not in self.step[state]:
                state = self.link[state]
                length = self.size[state]
            if c in self.step[state]:
                state = self.step[state][c]
                length += 1
            yield state, length

    def at(self, state: int, n: int) -> int:
        """The state of the last ``n`` words of what ``state`` matched."""
        while self.size[self.link[state]] >= n:
            state = self.link[state]
        return state

    def hits(self, ids: list[int]) -> tuple[np.ndarray, set]:
        """Which words are inside a window's occurrence, and the items of those windows."""
        edge = np.zeros(len(ids) + 1, np.int64)
        found: set = set()
        for k, (state, length) in enumerate(self.stream(ids)):
            for n in self.lengths:
                if n > length:
                    break
                if (names := self.items.get((self.at(state, n), n))) is not None:
                    found |= names
                    edge[k + 1 - n] += 1
                    edge[k + 1] -= 1
        return np.cumsum(edge[:-1]) > 0, found


class Scanner:
    """Finds one shard's windows in batches of documents."""

    def __init__(self, automaton: SuffixAutomaton):
        self.automaton = automaton
        spelled = list(automaton.vocabulary)
        data = np.frombuffer(b"".join(spelled), np.uint8)
        ends = np.cumsum([len(x) for x in spelled], dtype=np.int64) if spelled else np.zeros(0, np.int64)
        h = span_hashes(data, np.concatenate([[0], ends[:-1]]).astype(np.int64), ends) if spelled else np.zeros(0, np.uint64)
        self.known = np.zeros(1 << 20, bool)
        self.known[(h >> np.uint64(44)).astype(np.int64)] = True

    def scan(self, column) -> Iterator[tuple[int, int, list[tuple[int, int]], set]]:
        """For each row: its number of words, the number of hit words, hit byte spans, items."""
        for first, end, data, offsets in slices(column):
            low = ASCII_LOWER[data]
            starts, ends = runs(_IS_WORD[low], offsets)
            row = rows_of(starts, offsets)
            n_words = np.bincount(row, minlength=end - first)
            out: list = [(int(n), 0, [], set()) for n in n_words]
            if len(starts) and self.automaton.shortest:
                known = self.known[(span_hashes(low, starts, ends) >> np.uint64(44)).astype(np.int64)]
                word_offsets = np.concatenate([[0], np.cumsum(n_words)])
                a, b = runs(known, word_offsets)
                long = b - a >= self.automaton.shortest
                for s, e in zip(a[long].tolist(), b[long].tolist()):
                    ids = [self.automaton.vocabulary.get(low[x:y].tobytes(), -1) for x, y in zip(starts[s:e].tolist(), ends[s:e].tolist())]
                    hit, items = self.automaton.hits(ids)
                    if items:
                        r = int(row[s])
                        _, n_hit, spans, had = out[r]
                        x, y = runs(hit, np.array([0, len(hit)]))
                        spans += [(int(starts[s + i] - offsets[r]), int(ends[s + j - 1] - offsets[r]), int(s + i - word_offsets[r]), int(s + j - word_offsets[r])) for i, j in zip(x.tolist(), y.tolist())]
                        out[r] = (out[r][0], n_hit + int(hit.sum()), spans, had | items)
            yield from out


def _shards(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[str | None, list[bytes]]]]:
    """The items a shard at a time; the driver holds one shard."""
    shard, held = [], 0
    for item in benchmark.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).cast("string").alias("t")).toLocalIterator():
        words = words_of((item["t"] or "").encode())
        if held and held + len(words) > SHARD_WORDS:
            yield shard
            shard, held = [], 0
        shard.append((item["i"], words))
        held += len(words)
    yield shard


def scan(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, spans, items): hit spans by bytes and by words, and the items found, for every row."""
    schema = "doc_id long, row_ long, n_words long, spans array<struct<start:int,end:int,first_word:int,end_word:int>>, items array<string>"
    kind = pa.schema([("doc_id", pa.int64()), ("row_", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(pa.struct([(n, pa.int32()) for n in ("start", "end", "first_word", "end_word")]))), ("items", pa.list_(pa.string()))])
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))

    def over(rows: DataFrame, automaton: SuffixAutomaton, hits_only: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:  # the automaton goes along as a broadcast
            scanner = Scanner(automaton)
            for batch in batches:
                n, spans, items = [], [], []
                for n_words, _, where, found in scanner.scan(batch.column("text")):
                    n.append(n_words)
                    spans.append([dict(zip(("start", "end", "first_word", "end_word"), x)) for x in where])
                    items.append(sorted(found - {None}))
                out = pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row_"), pa.array(n, pa.int64()), pa.array(spans, kind.field("spans").type), pa.array(items, kind.field("items").type)], schema=kind)
                yield out.filter(pa.array([bool(x) for x in spans], pa.bool_())) if hits_only else out

        return rows.mapInArrow(run, schema)

    shards = _shards(benchmark, item_col, item_text_col)
    first, second = SuffixAutomaton(next(shards), window), next(shards, None)
    if second is None:
        return over(slim.withColumn("row_", F.lit(0).cast("long")), first, False).drop("row_")
    # Rows are told apart by id and text, so that each shard's finding joins its own row's.
    counted = slim.withColumn("row_", F.xxhash64("doc_id", "text"))
    base = cut(over(counted, first, False))
    found = base
    while second is not None:
        found = found.unionByName(cut(over(counted, SuffixAutomaton(second, window), True)))
        second = next(shards, None)
    hit = found.where(F.size("items") + F.size("spans") > 0)
    merged = hit.groupBy("doc_id", "row_").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    joined = base.select("doc_id", "row_", "n_words").alias("b").join(merged.alias("m"), F.col("b.doc_id").eqNullSafe(F.col("m.doc_id")) & (F.col("b.row_") == F.col("m.row_")), "left")
    spans = F.coalesce(F.col("m.spans"), F.array().cast(kind_spans := "array<struct<start:int,end:int,first_word:int,end_word:int>>"))
    # Spans of several shards may overlap: sweep them into disjoint ones.
    swept = F.aggregate(
        spans,
        F.array().cast(kind_spans),
        lambda acc, x: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["end_word"] >= x["first_word"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], x["end"]).alias("end"), F.element_at(acc, -1)["first_word"].alias("first_word"), F.greatest(F.element_at(acc, -1)["end_word"], x["end_word"]).alias("end_word"))))).otherwise(F.concat(acc, F.array(x))),
    )
    return joined.select(F.col("b.doc_id").alias("doc_id"), F.col("b.n_words").alias("n_words"), swept.alias("spans"), F.coalesce(F.col("m.items"), F.array().cast("array<string>")).alias("items"))


def judged(found: DataFrame) -> DataFrame:
    """Adds n_hit, n_items, items_sha256 and contaminated to the rows of ``scan``."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + (x["end_word"] - x["first_word"]).cast("long"))
    return (
        found.withColumn("n_hit", n_hit)
        .withColumn("n_items", F.size("items").cast("long"))
        .withColumn("items_sha256", F.sha2(F.concat_ws(",", "items").cast("binary"), 256))
        .withColumn("contaminated", (F.col("n_hit") > 0) & (COVERAGE * F.col("n_hit") >= F.col("n_words")))
    )


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that are not contaminated, columns as given; each row goes or stays by its own text, whatever its id."""
    shards = _shards(benchmark, "item_id", "text")
    first = next(shards)
    if next(shards, None) is None:
        automaton, at = SuffixAutomaton(first), docs.columns.index(text_col)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            scanner = Scanner(automaton)
            for batch in batches:
                keep = [not n_hit or COVERAGE * n_hit < n_words for n_words, n_hit, _, _ in scanner.scan(batch.column(at))]
                yield batch.filter(pa.array(keep, pa.bool_()))

        return docs.mapInArrow(run, docs.schema)
    # Shards find parts of a row's spans, so their findings meet by a number of the row.
    row = safe_name(docs.columns, "row_no")
    rows = numbered(docs, row)
    bad = judged(scan(rows, benchmark, row, text_col)).where("contaminated").select(F.col("doc_id").alias("goes"))
    return rows.join(bad, rows[row] == bad["goes"], "left_anti").drop(row)


def remove_spans(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    """The text without the given byte spans, as a span-removing caller wants it."""
    if text is None:
        return None
    body, at, kept = text.encode(), 0, []
    for start, end in sorted(spans):
        kept.append(body[at : max(at, start)])
        at = max(at, end)
    return b"".join([*kept, body[at:]]).decode()


def digest(names: list[str]) -> str:
    """What ``items_sha256`` is for these ids."""
    return hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
