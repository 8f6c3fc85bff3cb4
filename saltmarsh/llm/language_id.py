"""Language mixtures: expectation-maximisation over byte n-grams, the set chosen by penalised likelihood.

A language is a smoothed distribution over ``2 ** BITS`` hashed byte trigrams (ASCII lowered, everything
that is no letter a space), counted over at most ``FIT_ROWS`` documents of known language (those of the
least hash of their id). A document's trigrams are taken as drawn from a mixture of the languages; EM finds
the proportions. Languages are taken in by falling proportion, and each set is fitted again, as long as
the log-likelihood gains more than ``PENALTY`` times half the log of the number of trigrams. The
prediction is the greatest proportion's language, the score that proportion.

Defined cases: null texts and texts without a letter are ``und`` with score 0, as is every text if there is
nothing to learn from; rows of a null language or id teach nothing; texts of one letter have a trigram, as
a space is put at both ends; repeated rows are predicted alike; ties go to the language that sorts first;
other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saltmarsh.llm._text import ASCII_LOWER, slices

BITS = 15
FIT_ROWS = 12_000
SMOOTHING = 0.1
PENALTY = 4.0
ROUNDS = 12
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
_FOLD = ASCII_LOWER.copy()
_FOLD[[*range(0, 65), *range(91, 97), *range(123, 128)]] = 32


def gram_counts(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and counts of one text's trigrams."""
    folded = np.concatenate([[32], _FOLD[text], [32]]).astype(np.uint32)
    code = (folded[:-2] << 16) | (folded[1:-1] << 8) | folded[2:]
    code = code[(folded[1:-1] != 32) | ((folded[:-2] != 32) & (folded[2:] != 32))]
    bucket = (code * np.uint32(2654435761)) >> np.uint32(32 - BITS)
    if len(bucket) < 4096:
        return np.unique(bucket, return_counts=True)
    counts = np.bincount(bucket, minlength=1 << BITS)
    at = np.flatnonzero(counts)
    return at, counts[at]


@dataclass
class Languages:
    """Names, and log-probabilities by bucket and language."""

    names: list[str]
    logs: np.ndarray

    def mixture(self, at: np.ndarray, counts: np.ndarray) -> tuple[list[int], np.ndarray]:
        """The chosen languages, greatest proportion first, and their proportions."""
        logs = self.logs[at]
        n = counts.sum()
        single = counts @ logs
        best = int(np.argmax(single))
        if len(self.names) == 1:
            return [0], np.ones(1)
        p = np.exp(logs - logs.max(axis=1, keepdims=True))
        share, _ = _em(p, counts, np.full(len(self.names), 1 / len(self.names)))
        order = np.argsort(-share, kind="stable").tolist()
        order.remove(best)
        order.insert(0, best)
        chosen, value = [best], float(single[best])
        shares = np.ones(1)
        top = counts @ logs.max(axis=1)
        for k in order[1:]:
            trial = [*chosen, k]
            start = np.maximum(share[trial], 1e-3)
            fitted, gain = _em(p[:, trial], counts, start / start.sum())
            likelihood = gain + top
            if likelihood - value <= PENALTY * 0.5 * np.log(max(n, 2)):
                break
            chosen, value, shares = trial, likelihood, fitted
        by = np.argsort(-shares, kind="stable")
        return [chosen[k] for k in by.tolist()], shares[by]


def _em(p: np.ndarray, counts: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, float]:
    """Proportions after some rounds, and the log-likelihood of scaled probabilities ``p``."""
    n = counts.sum()
    for _ in range(ROUNDS):
        total = p @ share
        new = share * ((counts / total) @ p) / n
        done = np.abs(new - share).max() < 1e-4
        share = new
        if done:
            break
    return share, float(counts @ np.log(p @ share))


def held_out(doc_id):
    """True where the CRC-32 of the id, as text, leaves 1 modulo 3."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fit_rows: int = FIT_ROWS) -> Languages:
    """Distributions of the languages of at most ``fit_rows`` rows that are not held out."""
    key, lang = F.col(id_col), F.col(lang_col)
    learnable = docs.where(key.isNotNull() & lang.isNotNull() & F.col(text_col).isNotNull() & ~held_out(key))
    usable = learnable.select(key.cast("long").alias("doc_id"), lang.cast("string").alias("lang"), F.col(text_col).cast("binary").alias("text"))
    chosen = usable.select(F.col("doc_id").alias("fit_id")).distinct().orderBy(F.xxhash64("fit_id"), "fit_id").limit(fit_rows)
    slim = usable.join(F.broadcast(chosen), F.col("doc_id") == F.col("fit_id"), "left_semi").select("lang", "text").repartition(8)  # fit_rows numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            names = batch.column(0).to_pylist()
            for first, end, data, offsets in slices(batch.column(1)):
                for k in range(end - first):
                    at, counts = gram_counts(data[offsets[k] : offsets[k + 1]])
                    total.setdefault(names[first + k], np.zeros(1 << BITS, np.int64))[at] += counts
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["lang", "counts"])

    summed: dict[str, np.ndarray] = {}
    for row in slim.mapInArrow(run, "lang string, counts binary").toLocalIterator():
        summed[row["lang"]] = summed.get(row["lang"], 0) + np.frombuffer(bytes(row["counts"]), np.int64)
    names = sorted(summed)
    if not names:
        return Languages([], np.zeros((1 << BITS, 0)))
    counts = np.stack([summed[x] for x in names], axis=1).astype(float)
    # Each language leans on what all have in common where it has seen little.
    common = (counts.sum(axis=1) + SMOOTHING) / (counts.sum() + SMOOTHING * len(counts))
    weight = 500.0
    p = (counts + weight * common[:, None]) / (counts.sum(axis=0) + weight)
    return Languages(names, np.log(p))


def predict(docs: DataFrame, languages: Languages, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, languages) for every row of ``docs``."""
    names, logs = languages.names, languages.logs.astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Languages(names, logs.astype(float))
        for batch in batches:
            texts, scores, sets = [], [], []
            for first, end, data, offsets in slices(batch.column(1)):
                for k in range(end - first):
                    body = data[offsets[k] : offsets[k + 1]]
                    if not names or not _LETTER.search(body.tobytes().decode(errors="replace")):
                        chosen, shares = [], np.zeros(1)
                    else:
                        chosen, shares = model.mixture(*gram_counts(body))
                    texts.append(names[chosen[0]] if chosen else UNKNOWN)
                    scores.append(float(np.clip(shares[0], 0, 1)))
                    sets.append([names[x] for x in chosen])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(scores, pa.float64()), pa.array(sets, pa.list_(pa.string()))], ["doc_id", "lang_pred", "score", "languages"])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return slim.mapInArrow(run, "doc_id long, lang_pred string, score double, languages array<string>")
