"""URL filters: rules first, then the ratio of two character language models.

A rule is a host and a path; it fits the host and its subdomains if the url's path starts with the
rule's, and the longest rule that fits decides. Urls that rules decide also teach the method: two
Markov models of up to ``ORDER`` characters of context, one of accepted and one of rejected urls, in which
each context leans on the next shorter one by how many characters have followed it (Witten-Bell). A url
that no rule fits is blocked where its log-likelihood difference per character passes a line, which is
set so that both kinds are told apart best.

The models count every distinct url that rules decide. The line is set on the same urls, each scored by models that
leave out its fold, one of ``KEPT_OUT``. Counts stay a table of runs of ``ORDER`` + 1 bytes: a character's probability follows from
the runs that share its last two context bytes, which meet in one bucket, and from the counts of single bytes
and pairs, at most 65,536 a fold and kind, which are collected. Ratios are counted in cells of 1 / ``CELLS``, and the line lies between two cells.

Defined cases: null urls and urls without ``://`` have an empty host and path, fit no rule and are allowed;
without urls of both kinds to learn from, urls that no rule fits are allowed; repeated rows are judged
alike; equally long rules are told apart by their text, the smaller first; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saltmarsh.llm.suffix_dedup import gram_hashes
from saltmarsh.session import bounded_batches, cut, numbered

#: Fixed values: (host, path, verdict).
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
ORDER = 5
#: Urls are dealt to so many folds, each kept out of the counts where it is scored to set the line.
KEPT_OUT = 5
#: Fold of what is kept out nowhere, and of urls that are scored by all counts.
NO_FOLD = -1
#: Log-ratios are summed as integers of this unit, so that sums do not depend on their order.
UNIT = 1 << 30
CELLS = 1 << 14
#: Rows of counts that a bucket holds on average at most.
BUCKET_ROWS = 1 << 19
_SPLIT = re.compile(r"[/?#]")
_PATH_END = re.compile(r"[?#]")
_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def parts(url: str | None) -> tuple[str, str]:
    """(host, path) of a url."""
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    cut = m.start() if (m := _SPLIT.search(rest)) else len(rest)
    tail = rest[cut:]
    end = m.start() if (m := _PATH_END.search(tail)) else len(tail)
    return rest[:cut].translate(_LOWER), tail[:end]


class Rules:
    """Finds the longest rule that fits by looking up the host's suffixes."""

    def __init__(self, rules=RULES):
        self.by_host: dict[str, list[tuple[str, str, str]]] = {}
        for host, path, verdict in rules:
            self.by_host.setdefault(host, []).append((host + path, path, verdict))

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """(rule, verdict) or None."""
        best = None
        at = 0
        while host:
            for rule, prefix, verdict in self.by_host.get(host[at:], ()):
                if path.startswith(prefix) and (best is None or (-len(rule), rule) < (-len(best[0]), best[0])):
                    best = rule, verdict
            at = host.find(".", at) + 1
            if at == 0:
                break
        return best


def _flat(urls: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all urls, each after ORDER start marks and before an end mark; places of its characters, and its number."""
    pad = b"\x02" * ORDER
    bodies = [pad + x.encode() + b"\x03" for x in urls]
    data = np.frombuffer(b"".join(bodies) + b"\x03" * ORDER, np.uint8)
    sizes = np.array([len(x) for x in bodies], np.int64)
    begins = np.cumsum(sizes) - sizes
    n = sizes - ORDER
    of = np.repeat(np.arange(len(urls)), n)
    place = np.repeat(begins + ORDER - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    return data, place, of


@dataclass
class Markov:
    """For each order: sorted hashes of contexts with a character, their counts; of contexts, their totals and kinds."""

    tables: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]

    @staticmethod
    def fit(urls: list[str]) -> Markov:
        data, place, _ = _flat(urls)
        tables = []
        for k in range(ORDER + 1):
            long = gram_hashes(data, k + 1)[place - k]
            seen, first, counts = np.unique(long, return_index=True, return_counts=True)
            short = gram_hashes(data, k)[place - k] if k else np.zeros(len(place), np.uint64)
            contexts, where = np.unique(short[first], return_inverse=True)
            total = np.bincount(where, counts, len(contexts))
            kinds = np.bincount(where, minlength=len(contexts))
            tables.append((seen, counts.astype(np.float64), contexts, total, kinds.astype(np.float64)))
        return Markov(tables)

    def logs(self, data: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Log-probability of each character."""
        p = np.full(len(place), 1 / 256)
        for k, (seen, counts, contexts, total, kinds) in enumerate(self.tables):
            n = _look(seen, counts, gram_hashes(data, k + 1)[place - k])
            short = gram_hashes(data, k)[place - k] if k else np.zeros(len(place), np.uint64)
            all_, t = _look(contexts, total, short), _look(contexts, kinds, short)
            p = np.where(all_ > 0, (n + t * p) / np.maximum(all_ + t, 1), p)
        return np.log(p)


def _look(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], 0.0)


@dataclass
class Judge:
    """The two models and the line, of urls in memory; without models all is allowed."""

    accepted: Markov | None
    rejected: Markov | None
    line: float

    def ratios(self, urls: list[str]) -> np.ndarray:
        """How much likelier a rejected url is, per character, in logs."""
        if not urls:
            return np.zeros(0)
        data, place, of = _flat(urls)
        gap = self.rejected.logs(data, place) - self.accepted.logs(data, place)
        return np.bincount(of, gap, len(urls)) / np.bincount(of, minlength=len(urls))

    def blocks(self, urls: list[str]) -> np.ndarray:
        if self.accepted is None or not urls:
            return np.zeros(len(urls), bool)
        return self.ratios(urls) > self.line


def fit(accepted: list[str], rejected: list[str]) -> Judge:
    """Models of both kinds of url in memory, and the line that tells the kept-out ones apart best."""
    if not accepted or not rejected:
        return Judge(None, None, 0.0)
    sets = [(x[::KEPT_OUT] if len(x) >= 2 * KEPT_OUT else x, [u for k, u in enumerate(x) if k % KEPT_OUT] if len(x) >= 2 * KEPT_OUT else x) for x in (accepted, rejected)]
    judge = Judge(Markov.fit(sets[0][1]), Markov.fit(sets[1][1]), 0.0)
    low, high = judge.ratios(sets[0][0]), judge.ratios(sets[1][0])
    values = np.unique(np.concatenate([low, high]))
    judge.line = _line(values, *(np.bincount(np.searchsorted(values, x), minlength=len(values)) for x in (low, high)))
    return judge


def _line(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> float:
    """The line between ascending values, of ``low`` accepted and ``high`` rejected urls each, that tells both kinds apart best."""
    lines = (values[:-1] + values[1:]) / 2 if len(values) > 1 else np.zeros(1)
    # Balanced accuracy; of equal lines the middle one.
    upto = [np.cumsum(x)[: len(lines)] / x.sum() for x in (low, high)]
    right = upto[0] + 1 - upto[1]
    best = np.flatnonzero(right >= right.max() - 1e-12)
    return float(lines[best[len(best) // 2]])


def _runs(urls: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The last ``ORDER`` + 1 bytes up to each character as an integer, and the number of its url."""
    data, place, of = _flat(urls)
    run = np.zeros(len(place), np.int64)
    for k in range(ORDER, -1, -1):
        run = run << 8 | data[place - k]
    return run, of


def _lent(runs: np.ndarray, counts: np.ndarray, wanted: np.ndarray, order: int, p: np.ndarray) -> np.ndarray:
    """Probabilities of the wanted runs at an order, leaning on ``p`` of the next shorter one."""
    mask = (1 << 8 * (order + 1)) - 1
    seen, where = np.unique(runs & mask, return_inverse=True)
    n = np.bincount(where, counts, len(seen))
    contexts, where = np.unique(seen >> 8, return_inverse=True)
    total, kinds = np.bincount(where, n, len(contexts)), np.bincount(where, minlength=len(contexts)).astype(float)
    if not len(seen):
        return p
    key = wanted & mask
    all_, t = _look(contexts, total, key >> 8), _look(contexts, kinds, key >> 8)
    return np.where(all_ > 0, (_look(seen, n, key) + t * p) / np.maximum(all_ + t, 1), p)


@dataclass
class TrainedJudge:
    """Counts of runs of all decided urls, by fold and kind, and the line; without counts all is allowed."""

    spark: SparkSession
    counts: DataFrame | None = None
    few: pa.Table | None = None
    buckets: int = 1
    line: float = 0.0

    def scored(self, urls: DataFrame) -> DataFrame:
        """(id, ratio) of ``urls`` (id, u, fold), by counts without the fold."""

        def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                run, of = _runs(batch.column(1).to_pylist())
                for k in range(0, len(run), 1 << 16):
                    at = pa.array(of[k : k + (1 << 16)])
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(2).take(at), pa.array(run[k : k + (1 << 16)])], ["id", "fold", "run"])

        here = urls.select("id", "u", "fold").mapInArrow(runs, "id long, fold int, run long")
        gaps = cut(self._gaps(here.select("fold", "run").distinct()))
        summed = here.join(gaps, ["fold", "run"]).groupBy("id").agg(F.sum("gap").alias("gap"), F.count("*").alias("n"))
        return summed.select("id", (F.col("gap") / UNIT / F.col("n")).alias("ratio"))

    def _gaps(self, wanted: DataFrame) -> DataFrame:
        """(fold, run, gap): how much likelier rejected urls go on so, in logs."""
        few = [self.few.column(c).to_numpy() for c in ("run", "fold", "bad", "n")]

        def meet(left: pa.Table, right: pa.Table) -> pa.Table:
            run, fold, bad, n = (left.column(c).to_numpy() for c in ("run", "fold", "bad", "n"))
            asked, of = right.column("run").to_numpy(), right.column("fold").to_numpy()
            gap = np.zeros(len(asked))
            for f in np.unique(of):
                at = np.flatnonzero(of == f)
                for kind, sign in ((False, -1), (True, 1)):
                    p = np.full(len(at), 1 / 256)
                    short, long = (few[2] == kind) & (few[1] != f), (bad == kind) & (fold != f)
                    if f == NO_FOLD:
                        short, long = few[2] == kind, bad == kind
                    for order in range(ORDER + 1):
                        runs, counts = (few[0][short], few[3][short]) if order < 2 else (run[long], n[long])
                        p = _lent(runs, counts, asked[at], order, p)
                    gap[at] += sign * np.log(p)
            return pa.table([right.column("fold"), right.column("run"), pa.array(np.round(gap * UNIT).astype(np.int64))], names=["fold", "run", "gap"])

        bucket = F.pmod(F.xxhash64(F.shiftright("run", 8).bitwiseAND(0xFFFF)), F.lit(self.buckets)).alias("bucket")
        both = self.counts.groupBy(bucket).cogroup(wanted.groupBy(bucket))
        return both.applyInArrow(meet, "fold int, run long, gap long")

    def ratios(self, urls: list[str]) -> np.ndarray:
        """How much likelier a rejected url is, per character, in logs."""
        rows = self.spark.createDataFrame(list(enumerate(urls)), "id long, u string").withColumn("fold", F.lit(NO_FOLD))
        found = dict(self.scored(rows).collect())
        return np.array([found[k] for k in range(len(urls))])

    def blocks(self, urls: list[str]) -> np.ndarray:
        if self.counts is None or not urls:
            return np.zeros(len(urls), bool)
        return np.floor(self.ratios(urls) * CELLS) > self.line

    def blocked(self, urls: DataFrame) -> DataFrame:
        """Those of the distinct urls (u) that are blocked."""
        rows = numbered(urls, "id").withColumn("fold", F.lit(NO_FOLD))
        bad = self.scored(rows).where(F.floor(F.col("ratio") * CELLS) > self.line)
        return rows.join(bad, "id", "left_semi").select("u")


def train(pages: DataFrame, rules=RULES, url_col: str = "url") -> TrainedJudge:
    """A judge fitted on all urls that rules decide."""
    spark = pages.sparkSession
    bounded_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Rules(rules)
        for batch in batches:
            kept = [(h + p, r[1] == "block") for h, p in map(parts, batch.column(0).to_pylist()) if (r := known.find(h, p))]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in kept], pa.string()), pa.array([x for _, x in kept], pa.bool_())], ["u", "bad"])

    decided = numbered(pages.select(F.col(url_col).cast("string").alias("u")).mapInArrow(run, "u string, bad boolean").distinct(), "id")
    sizes = dict(decided.groupBy("bad").count().collect())
    if len(sizes) < 2:
        return TrainedJudge(spark)
    # A kind of few urls is kept out nowhere.
    whole = F.lit(False)
    for bad, n in sizes.items():
        whole |= F.lit(n < 2 * KEPT_OUT) & (F.col("bad") == bad)
    fold = F.pmod(F.xxhash64("u"), F.lit(KEPT_OUT)).cast("int")
    urls = decided.withColumn("fold", F.when(whole, F.lit(NO_FOLD)).otherwise(fold))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            run, of = _runs(batch.column(0).to_pylist())
            fold, bad = batch.column(1).to_numpy().astype(np.int64), batch.column(2).to_numpy(zero_copy_only=False)
            key, n = np.unique(run << 8 | (fold[of] - NO_FOLD) << 1 | bad[of], return_counts=True)
            columns = [key >> 8, ((key >> 1 & 127) + NO_FOLD).astype(np.int32), (key & 1).astype(bool), n]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["run", "fold", "bad", "n"])

    rows = urls.select("u", "fold", "bad").mapInArrow(count, "run long, fold int, bad boolean, n long")
    counts = cut(rows.groupBy("run", "fold", "bad").agg(F.sum("n").alias("n")))
    few = counts.groupBy(F.col("run").bitwiseAND(0xFFFF).alias("run"), "fold", "bad").agg(F.sum("n").alias("n")).toArrow()
    judge = TrainedJudge(spark, counts, few, max(16, -(-counts.count() // BUCKET_ROWS)))
    kinds = judge.scored(urls).join(urls.select("id", "bad"), "id").groupBy(F.floor(F.col("ratio") * CELLS).alias("cell"))
    cells = kinds.agg(F.count_if(~F.col("bad")).alias("low"), F.count_if(F.col("bad")).alias("high")).orderBy("cell").toArrow()
    judge.line = _line(*(cells.column(c).to_numpy() for c in ("cell", "low", "high")))
    return judge


def filter_urls(pages: DataFrame, judge: TrainedJudge, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of ``pages``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Rules(rules)
        for batch in batches:
            split = [parts(x) for x in batch.column(1).to_pylist()]
            found = [known.find(h, p) for h, p in split]
            verdicts = [r[1] if r else None if h + p else "allow" for r, (h, p) in zip(found, split)]
            columns = [[h for h, _ in split], [p for _, p in split], [r and r[0] for r in found], verdicts]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.string()) for x in columns)], ["page_id", "host", "path", "rule", "verdict"])

    slim = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"))
    ruled = slim.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string")
    if judge.counts is None:
        return ruled.withColumn("verdict", F.coalesce("verdict", F.lit("allow")))
    u = F.concat("host", "path")
    blocked = judge.blocked(ruled.where(F.col("verdict").isNull()).select(u.alias("u")).distinct())
    judged = ruled.withColumn("u", u).join(blocked.withColumn("bad", F.lit("block")), "u", "left")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("verdict", "bad", F.lit("allow")).alias("verdict"))
