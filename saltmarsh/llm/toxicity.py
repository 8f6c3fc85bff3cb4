"""Toxicity scores from a factorization machine over hashed terms.

A document is the set of its terms (words, ASCII lowered), hashed to ``BUCKETS``. Its logit is
w0 + sum of w_i + sum over pairs of <v_i, v_j>: the pairs let two terms together, such as an insult and
the mention of a group, weigh more or less than both alone. The machine is fitted on at most
``FIT_ROWS`` labelled documents (those of the least hash of their id, so that the choice is the same in
every run), by mini-batch Adam on the log loss with decay.

Buckets that say nothing keep zero weights, so that random words add no noise to long documents. Of the buckets
that ``MIN_DOCS`` fitted documents have, two kinds get weights and factors, however many they are:

* those whose presence departs from independence of the label by more than ``ALONE`` standard deviations;
* those that say something together. After a fit of the first kind, the second-order gradient of the loss in the
  factors is the matrix of the sums, over the documents that hold two terms, of what the machine still gets
  wrong. It is formed for the ``PAIR_TERMS`` most frequent terms (rarer ones meet too seldom in the fitted
  documents to tell); pairs whose sum departs by more than ``TOGETHER`` standard deviations join, whatever
  their terms say alone, and the matrix's leading directions are their factors' first values.

Defined cases: null and empty texts have no term and score sigmoid(w0); null labels, labels other than 0
and 1 and labels of a null id are not learned from; an id with several labels counts as 1 if one is;
without labelled rows of both kinds the score is the share of label 1 (0.5 if there are none at all);
repeated rows score alike; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saltmarsh.llm._text import ASCII_LOWER, rows_of, runs, slices, span_hashes

BUCKET_BITS = 20
FIT_ROWS = 12_000
MIN_DOCS = 4
#: Standard deviations from independence that a term shows alone.
ALONE = 4.0
FACTORS = 4
#: Terms that are looked at in pairs, the standard deviations that a pair shows, and its fitted documents at least.
PAIR_TERMS = 2048
TOGETHER = 7.0
PAIR_DOCS = 8
#: Mini-batches in all, and documents of one.
STEPS = 2000
BATCH = 256
RATE = 0.03
DECAY = 2e-3
THRESHOLD = 0.7
_IS_TERM = np.zeros(256, bool)
_IS_TERM[48:58] = _IS_TERM[97:123] = _IS_TERM[128:] = True


def terms(column) -> Iterator[np.ndarray]:
    """The sorted distinct buckets of each row's terms."""
    for first, end, data, offsets in slices(column):
        low = ASCII_LOWER[data]
        starts, ends = runs(_IS_TERM[low], offsets)
        buckets = (span_hashes(low, starts, ends) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64) if len(starts) else np.zeros(0, np.int64)
        keys = np.unique((rows_of(starts, offsets) << BUCKET_BITS) | buckets)
        cuts = np.searchsorted(keys, np.arange(end - first + 1) << BUCKET_BITS)
        keys &= (1 << BUCKET_BITS) - 1
        for k in range(end - first):
            yield keys[cuts[k] : cuts[k + 1]]


@dataclass
class Machine:
    """Weights by dense term number; ``number`` takes a bucket to it (0: no weight)."""

    number: np.ndarray
    w0: float
    w: np.ndarray
    v: np.ndarray

    def logits(self, sets: list[np.ndarray]) -> np.ndarray:
        sizes = np.fromiter(map(len, sets), np.int64, len(sets))
        flat = self.number[np.concatenate(sets)] if len(sets) and sizes.sum() else np.zeros(0, np.int32)
        doc = np.repeat(np.arange(len(sets)), sizes)
        keep = flat > 0
        return self._sum(flat[keep], doc[keep], len(sets))

    def scores(self, column) -> np.ndarray:
        """The score of each row of a column of texts."""
        kept = [s[self.number[s] > 0] for s in terms(column)]
        return 1 / (1 + np.exp(-np.clip(self.logits(kept), -30, 30)))

    def _sum(self, flat: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
        out = self.w0 + np.bincount(doc, self.w[flat], n)
        for k in range(self.v.shape[1]):
            x = self.v[flat, k]
            out += 0.5 * (np.bincount(doc, x, n) ** 2 - np.bincount(doc, x * x, n))
        return out


def fit(sets: list[np.ndarray], y: np.ndarray, seed: int = 7) -> Machine:
    """Fit a machine to term sets and 0/1 labels."""
    none = np.zeros(1 << BUCKET_BITS, np.int32)
    share = float(np.clip(y.mean(), 1e-4, 1 - 1e-4)) if len(y) else 0.5
    w0 = float(np.log(share / (1 - share)))
    if len(y) == 0 or y.min() == y.max():
        return Machine(none, w0, np.zeros(1), np.zeros((1, FACTORS)))
    flat = np.concatenate(sets)
    doc = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    n_all = np.bincount(flat, minlength=1 << BUCKET_BITS).astype(float)
    n_pos = np.bincount(flat, y[doc], 1 << BUCKET_BITS)
    expected = n_all * share
    z = (n_pos - expected) / np.sqrt(np.maximum(expected * (1 - share) * (1 - n_all / len(y)), 1e-9))
    alone = np.flatnonzero((np.abs(z) > ALONE) & (n_all >= MIN_DOCS))
    machine = _descend(flat, doc, y, w0, alone, np.zeros((len(alone), FACTORS)), seed)
    p = 1 / (1 + np.exp(-np.clip(machine._sum(machine.number[flat], doc, len(y)), -30, 30)))
    usable = np.flatnonzero(n_all >= max(MIN_DOCS, PAIR_DOCS))
    usable = np.sort(usable[np.argsort(-n_all[usable], kind="stable")][:PAIR_TERMS])
    together, first = _together(flat, doc, y, p, usable)
    if not len(together):
        return machine
    chosen = np.union1d(alone, together)
    start = np.zeros((len(chosen), FACTORS))
    start[np.searchsorted(chosen, together)] = first
    return _descend(flat, doc, y, w0, chosen, start, seed)


def _together(flat: np.ndarray, doc: np.ndarray, y: np.ndarray, p: np.ndarray, usable: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The terms among ``usable`` of which pairs tell where the chances ``p`` are off, and first values of their factors."""
    number = np.full(1 << BUCKET_BITS, -1, np.int32)
    number[usable] = np.arange(len(usable))
    term = number[flat]
    doc, term = doc[term >= 0], term[term >= 0]
    sums, counts, spread = (np.zeros((len(usable), len(usable)), np.float32) for _ in range(3))
    for low in range(0, len(y), 1024):
        s, e = np.searchsorted(doc, [low, low + 1024])
        held = np.zeros((min(1024, len(y) - low), len(usable)), np.float32)
        held[doc[s:e] - low, term[s:e]] = 1
        chance = p[low : low + 1024, None].astype(np.float32)
        sums += held.T @ (held * (y[low : low + 1024, None].astype(np.float32) - chance))
        counts += held.T @ held
        spread += held.T @ (held * chance * (1 - chance))
    z = np.where(counts >= PAIR_DOCS, sums / np.sqrt(np.maximum(spread, 1.0)), 0)
    np.fill_diagonal(z, 0)
    found = np.flatnonzero((np.abs(z) > TOGETHER).any(axis=1))
    first = np.zeros((len(found), FACTORS))
    if len(found):
        kept = z[np.ix_(found, found)].astype(np.float64)
        values, vectors = np.linalg.eigh(np.where(np.abs(kept) > TOGETHER, kept, 0))
        lead = [k for k in np.argsort(-values)[:FACTORS] if values[k] > 0]
        first[:, : len(lead)] = vectors[:, lead]
    return usable[found], first


def _descend(flat: np.ndarray, doc: np.ndarray, y: np.ndarray, w0: float, chosen: np.ndarray, start: np.ndarray, seed: int) -> Machine:
    """A machine whose terms are the buckets ``chosen``, fitted from the factors ``start``."""
    number = np.zeros(1 << BUCKET_BITS, np.int32)
    number[chosen] = np.arange(1, len(chosen) + 1)
    rng = np.random.default_rng(seed)
    factors = rng.normal(0, 0.02, (len(chosen) + 1, FACTORS))
    factors[1:] += start
    theta = {"w": np.zeros(len(chosen) + 1), "v": factors, "w0": np.array([w0])}
    first = {k: np.zeros_like(x) for k, x in theta.items()}
    second = {k: np.zeros_like(x) for k, x in theta.items()}
    flat = number[flat]
    doc, flat = doc[flat > 0], flat[flat > 0]
    bounds = np.searchsorted(doc, np.arange(len(y) + 1))
    step = 0
    while step < STEPS and len(chosen):
        order = rng.permutation(len(y))
        for k in range(0, len(order), BATCH):
            part = order[k : k + BATCH]
            at = np.concatenate([np.arange(bounds[i], bounds[i + 1]) for i in part])
            f = flat[at]
            d = np.repeat(np.arange(len(part)), bounds[part + 1] - bounds[part])
            m = Machine(number, float(theta["w0"][0]), theta["w"], theta["v"])
            g = (1 / (1 + np.exp(-np.clip(m._sum(f, d, len(part)), -30, 30))) - y[part]) / len(part)
            total = np.stack([np.bincount(d, theta["v"][f, j], len(part)) for j in range(FACTORS)], axis=1)
            grad = {"w0": np.array([g.sum()]), "w": np.bincount(f, g[d], len(theta["w"])) + DECAY * theta["w"] / len(part)}
            inner = g[d, None] * (total[d] - theta["v"][f])
            grad["v"] = np.stack([np.bincount(f, inner[:, j], len(theta["w"])) for j in range(FACTORS)], axis=1) + 10 * DECAY * theta["v"] / len(part)
            step += 1
            for name, x in grad.items():
                first[name] = 0.9 * first[name] + 0.1 * x
                second[name] = 0.999 * second[name] + 0.001 * x * x
                theta[name] = theta[name] - RATE * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8)
    theta["w"][0], theta["v"][0] = 0, 0
    return Machine(number, float(theta["w0"][0]), theta["w"], theta["v"])


def held_out(doc_id: Column) -> Column:
    """True where the CRC-32 of the id, as text, leaves 1 modulo 3."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_rows: int = FIT_ROWS) -> Machine:
    """A machine fitted on at most ``fit_rows`` labelled documents that are not held out."""
    key, label = labels[id_col], labels[label_col]
    usable = labels.where(label.isin(0, 1) & key.isNotNull() & ~held_out(key))
    by_id = usable.groupBy(key.cast("long").alias("label_id")).agg(F.max(label.cast("int")).alias("y"))
    present = docs.select(F.col(id_col).cast("long").alias("label_id")).distinct()
    chosen = by_id.join(present, "label_id", "left_semi").orderBy(F.xxhash64("label_id"), "label_id").limit(fit_rows)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    rows = slim.join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id")).select("doc_id", "y", "text")  # fit_rows rows of two numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = pa.array([s.astype(np.int32).tobytes() for s in terms(batch.column(2))], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), sets], ["doc_id", "y", "terms"])

    found = rows.mapInArrow(run, "doc_id long, y int, terms binary").toArrow().sort_by("doc_id")
    # Repeated ids can only add a few rows to the bound; the first of each id counts.
    ids = found.column("doc_id").to_numpy()
    lead = np.ones(len(ids), bool)
    lead[1:] = ids[1:] != ids[:-1]
    sets = [np.frombuffer(x, np.int32).astype(np.int64) for x, ok in zip(found.column("terms").to_pylist(), lead) if ok]
    return fit(sets, found.column("y").to_numpy()[lead].astype(float))


def packed(machine: Machine) -> Callable[[], Machine]:
    """The machine as it travels, without its empty buckets."""
    used = np.flatnonzero(machine.number)
    numbers, w0, w, v = machine.number[used], machine.w0, machine.w, machine.v

    def load() -> Machine:
        number = np.zeros(1 << BUCKET_BITS, np.int32)
        number[used] = numbers
        return Machine(number, w0, w, v)

    return load


def score(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) for every row of ``docs``."""
    load = packed(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = load()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(m.scores(batch.column(1)))], ["doc_id", "score"])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return slim.mapInArrow(run, "doc_id long, score double")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that score below ``threshold``, columns as given; each row goes or stays by its own text, whatever its id."""
    load = packed(train(docs, labels, id_col, text_col))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = load()
        for batch in batches:
            yield batch.filter(pa.array(m.scores(batch.column(at)) < threshold))

    return docs.mapInArrow(run, docs.schema)
