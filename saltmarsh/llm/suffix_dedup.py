"""Removal of repeated byte strings, found with suffix arrays built by two-stage sorting.

Every byte covered by a ``LENGTH``-byte string that also starts earlier (in a smaller doc_id, or earlier in
the same document) goes; strings are judged on the input and never cross documents.

1. *Routing.* Each string of ``LENGTH`` bytes (a window) is assigned the ``GRAM``-byte gram inside it with
   the least hash, its anchor. Equal windows have equal anchors, so windows meet by their anchors' hashes, and a
   run of windows with one anchor travels as one stretch of text, also where the anchor occurs in it again
   and again, as in periodic text. Grams that are frequent in the whole corpus are chosen only by windows that have no other, so a
   common line does not draw the unique text around it.
2. *Sharing.* Anchors are counted; only those that occur twice go on. A document's stretches around them
   are cut out.
3. *Suffix arrays.* The stretches of one bucket of anchors form one text. Of its suffixes that begin a
   window (or are needed to place one), those smaller than their successor are sorted directly; the
   others are induced by one scan of the buckets of first characters, smallest first: a suffix that is
   larger than its successor goes to the front of its own bucket when the scan passes the successor. Common
   prefixes of neighbours then tell the classes of equal windows; all but the earliest of a class repeat.
4. Anchors of frequent grams are dealt to as many buckets as their number needs. Windows that are the
   earliest of their class there meet again in a second round of suffix arrays, once per longer gram around
   the anchor, chosen as the anchors were.
5. Repeated windows are joined to their documents, whose covered bytes go.

Defined cases: a null text is empty and has nothing to remove; texts shorter than ``LENGTH`` bytes stay;
rows that share a doc_id are one document as far as "earlier" goes, so equal rows keep the same bytes (such
rows are told apart by a 32-bit checksum of their texts); a null id counts as the smallest; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saltmarsh.llm._text import SLICE_BYTES, mix, slices

LENGTH = 100
GRAM = 20
#: Anchors of one counting bucket, and of one suffix array if all of them were shared.
COUNT_BUCKET = 1 << 16
SORT_BUCKET = 1 << 13
#: Anchors of one task's buckets, if all of them were shared.
ROUTE = 1 << 16
#: A gram is frequent if it is one in this many of all grams or more: there are at most as many such grams.
FREQUENT = 1 << 15
#: Bytes of text whose grams a task counts at once.
COUNTED_BYTES = 2 << 20
#: Bytes of the gram by which what a frequent anchor leaves over meets.
LONG_GRAM = 64
#: Bytes of stretches that the second round sorts at once; one key's are never parted.
SECOND_BYTES = 1 << 20
#: Windows of one stretch: longer runs are cut.
MOST_WINDOWS = 1024
#: Windows of one anchor that meet in one bucket of the first round.
SALTED = 1 << 15
_TOP = np.uint64(1 << 63)


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A 63-bit hash of the ``gram`` bytes from each position on, by joining halves."""
    if len(data) < gram:
        return np.zeros(0, np.uint64)
    h = data.astype(np.uint64) + np.uint64(1)
    base = 0x9E3779B97F4A7C15
    done, out, at = 1, None, 0
    power = h  # hashes of spans of `done` bytes
    rest = gram
    while rest:
        if rest & 1:
            if out is None:
                out, at = power, done
            else:
                n = len(data) - at - done + 1
                out = out[:n] * np.uint64(pow(base, done, 1 << 64)) + power[at : at + n]
                at += done
        rest >>= 1
        if rest:
            n = len(power) - done
            power = power[:n] * np.uint64(pow(base, done, 1 << 64)) + power[done : done + n]
            done *= 2
    return mix(out[: len(data) - gram + 1]) >> np.uint64(1)


def _sliding(extreme: np.ufunc, x: np.ndarray, width: int) -> np.ndarray:
    """The least or greatest of ``width`` values from each place on."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = extreme(x[:-step], x[step:])
        have += step
    return x


def anchors(data: np.ndarray, offsets: np.ndarray, frequent: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """(row, hash, first window, end window, whether its gram occurs there twice) of every anchor; windows as offsets in ``data``.

    ``frequent`` are sorted hashes of grams that a window takes only if it has no other.
    """
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, np.zeros(0, np.uint64), none, none, np.zeros(0, bool)
    h = gram_hashes(data, gram)
    if len(frequent):
        h = np.where(_isin(h, frequent), h | _TOP, h)
    least = _sliding(np.minimum, h, length - gram + 1)
    n = len(least)
    inside = np.ones(n, bool)  # windows that stay in one row
    for k in offsets[1:-1].tolist():
        inside[max(0, k - length + 1) : min(k, n)] = False
    # Neighbours with equal minima have one anchor, whatever place in them it has.
    change = np.ones(n, bool)
    change[1:] = (least[1:] != least[:-1]) | ~inside[:-1] | ~inside[1:]
    starts = np.flatnonzero(change & inside)
    if not len(starts):
        return none, np.zeros(0, np.uint64), none, none, np.zeros(0, bool)
    ends = np.append(np.flatnonzero(change), n)
    ends = ends[np.searchsorted(ends, starts, side="right")]
    value = least[starts]
    # Places whose gram is the least of a window: those that are as great as the greatest of their windows' minima.
    reach = length - gram + 1
    low = np.where(inside, least, 0)
    low = np.concatenate([np.zeros(reach - 1, np.uint64), low, np.zeros(reach - 1, np.uint64)])
    places = np.flatnonzero(_sliding(np.maximum, low, reach) == h)
    a, b = np.searchsorted(places, starts), np.searchsorted(places, ends + reach - 1)
    own, k, open_ = np.zeros(len(starts), np.int64), a.copy(), np.arange(len(starts))
    while len(open_):
        own[open_] += h[places[k[open_]]] == value[open_]
        k[open_] += 1
        open_ = open_[(k[open_] < b[open_]) & (own[open_] < 2)]
    # A run of equal minima, however many places of its gram it spans, is one stretch; long ones are cut.
    parts = -(-(ends - starts) // MOST_WINDOWS)
    of = np.repeat(np.arange(len(starts)), parts)
    first = starts[of] + MOST_WINDOWS * (np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts))
    end = np.minimum(first + MOST_WINDOWS, ends[of])
    return np.searchsorted(offsets, first, side="right") - 1, value[of] & ~_TOP, first, end, own[of] > 1


def _isin(x: np.ndarray, sorted_values: np.ndarray) -> np.ndarray:
    """Membership, by a table of 16 bits first."""
    table = np.zeros(1 << 16, bool)
    table[(sorted_values >> np.uint64(47)).astype(np.int64)] = True
    out = table[(x >> np.uint64(47)).astype(np.int64)]
    at = np.flatnonzero(out)
    near = np.minimum(np.searchsorted(sorted_values, x[at]), len(sorted_values) - 1)
    out[at] = sorted_values[near] == x[at]
    return out


def suffix_order(text: np.ndarray, seven: np.ndarray, wanted: np.ndarray, words: int) -> np.ndarray:
    """The positions with ``wanted`` set, ordered by the suffixes of ``text`` that start there.

    ``text`` holds 0 after each stretch and bytes plus one elsewhere; ``seven`` is ``packed(text)``. Suffixes
    are told apart by ``words`` * 7 characters at least, and ``text`` ends in as many zeros. Positions that a
    wanted one needs to be induced are added here and dropped.
    """
    n = len(text)
    # A suffix is smaller than its successor where its first character is, or where that is equal and
    # the successor is smaller than the one after it; the 0 after a stretch is sorted directly.
    less = text[:-1] < text[1:]
    same = text[:-1] == text[1:]
    small = np.append(less, True)
    idx = np.where(same, n, np.arange(n - 1))
    following = np.minimum.accumulate(idx[::-1])[::-1]  # the next place whose neighbour differs
    ok = following < n
    small[:-1] = np.where(ok, less[np.minimum(following, n - 2)], True)
    small[text == 0] = True
    # A wanted larger suffix needs its successors up to the first smaller one.
    need = wanted.copy()
    large_at = np.flatnonzero(wanted & ~small)
    while len(large_at):
        large_at = large_at + 1
        large_at = large_at[~need[large_at]]
        need[large_at] = True
        large_at = large_at[~small[large_at]]
    direct = sorted_directly(seven, np.flatnonzero(need & small), words)
    first = text[direct]
    bounds = np.searchsorted(first, np.arange(258))
    induced: dict[int, list[np.ndarray]] = {}
    out = []
    take = need & ~small
    for c in np.unique(text[np.flatnonzero(need)]).tolist():
        front = induced.pop(c, [])
        k = 0
        while k < len(front):  # runs of one character fill their own bucket's front
            before = front[k] - 1
            before = before[(before >= 0)]
            before = before[take[before] & (text[before] == c)]
            if len(before):
                front.append(before)
            k += 1
        bucket = np.concatenate([*front, direct[bounds[c] : bounds[c + 1]]])
        out.append(bucket)
        before = bucket - 1
        before = before[before >= 0]
        before = before[take[before] & (text[before] > c)]
        if len(before):
            chars = text[before]
            by = np.argsort(chars, kind="stable")
            before, chars = before[by], chars[by]
            edges = np.flatnonzero(np.append(True, chars[1:] != chars[:-1]))
            for s, part in zip(chars[edges].tolist(), np.split(before, edges[1:])):
                induced.setdefault(s, []).append(part)
    found = np.concatenate(out) if out else np.zeros(0, np.int64)
    return found[wanted[found]]


def sorted_directly(seven: np.ndarray, places: np.ndarray, words: int) -> np.ndarray:
    """``places`` by the suffixes there, told apart by ``words`` words of ``seven``; equal ones in any order.

    Each round sorts the groups that are still tied by the first word in which their members differ; a group
    whose members agree in all words is done.
    """
    key = seven[places]
    order = np.argsort(key)
    places, key = places[order], key[order]
    number = np.cumsum(np.append(True, key[1:] != key[:-1])[: len(key)]) - 1
    at = np.flatnonzero(np.bincount(number)[number] > 1) if len(key) else number
    group, done = number[at], 1
    while len(at):
        here = places[at]
        pair = np.flatnonzero(group[1:] == group[:-1])
        same = np.full(len(at), words)
        same[pair] = common_words(seven, here[pair], here[pair + 1], done, words)
        lead = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        shared = np.repeat(np.minimum.reduceat(same, lead), np.diff(np.append(lead, len(at))))
        open_ = shared < words
        at, group, here, shared = at[open_], group[open_], here[open_], shared[open_]
        if not len(at):
            break
        word = seven[here + 7 * shared]
        order = np.lexsort((word, group))
        word = word[order]
        places[at] = here[order]
        number = np.cumsum(np.append(True, (group[1:] != group[:-1]) | (word[1:] != word[:-1]))) - 1
        keep = np.bincount(number)[number] > 1
        at, group, done = at[keep], number[keep], int(shared.min()) + 1
    return places


def common_words(seven: np.ndarray, a: np.ndarray, b: np.ndarray, done: int, words: int) -> np.ndarray:
    """How many of ``words`` words the suffixes a[k] and b[k] share from the start; the first ``done`` are known to."""
    out = np.full(len(a), words, np.int64)
    live = np.arange(len(a))
    a, b = a + 7 * done, b + 7 * done
    for w in range(done, words):
        same = seven[a] == seven[b]
        if not same.all():
            out[live[~same]] = w
            live, a, b = live[same], a[same], b[same]
        a, b = a + 7, b + 7
    return out


def packed(text: np.ndarray) -> np.ndarray:
    """The seven characters from each position on as one number, nine bits each, that orders as they do."""
    wide = np.zeros(len(text) + 8, np.uint64)
    wide[: len(text)] = text
    two = (wide[:-1] << np.uint64(9)) | wide[1:]
    four = (two[:-2] << np.uint64(18)) | two[2:]
    n = len(text)
    return (four[:n] << np.uint64(27)) | (two[4 : n + 4] << np.uint64(9)) | wide[6 : n + 6]


def repeated(data: np.ndarray, begins: np.ndarray, n_windows: np.ndarray, places: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Which windows of some stretches of ``data``, one after another, repeat an earlier one.

    A stretch begins at ``begins`` and holds ``n_windows`` windows. ``places`` orders the stretches' first
    windows: document and offset as one number, so that the windows of a stretch have the numbers after it.
    """
    sizes = n_windows + length - 1
    words = -(-length // 7)
    text = np.zeros(int(sizes.sum()) + len(sizes) + 7 * words + 8, np.uint16)
    own = np.cumsum(sizes + 1) - sizes - 1  # a 0 stays after each stretch
    text[_spread(own, sizes)] = data[_spread(begins, sizes)]
    text[_spread(own, sizes)] += 1
    begins = own
    number = np.arange(int(n_windows.sum())) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)
    starts = np.repeat(begins, n_windows) + number
    wanted = np.zeros(len(text), bool)
    wanted[starts] = True
    seven = packed(text)
    order = suffix_order(text, seven, wanted, words)
    place = np.zeros(len(text), np.int64)
    place[starts] = np.repeat(places, n_windows) + number
    again = np.zeros(len(text), bool)
    if len(order) > 1:
        equal = common_prefix(seven, order[:-1], order[1:], length) >= length
        lead = np.flatnonzero(np.append(True, ~equal))
        there = place[order]
        earliest = np.minimum.reduceat(there, lead)
        again[order] = there > np.repeat(earliest, np.diff(np.append(lead, len(order))))
    return again[starts]


def common_prefix(seven: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Lengths, up to ``most``, of the common prefixes of suffixes a[k] and b[k]."""
    out = np.zeros(len(a), np.int64)
    live = np.arange(len(a))
    words = -(-most // 7)
    for w in range(words):
        differ = seven[a[live] + 7 * w] ^ seven[b[live] + 7 * w]
        ended = np.flatnonzero(differ)
        if len(ended):
            left = differ[ended]
            out[live[ended]] = 7 * w + sum((left >> np.uint64(9 * (6 - k)) == 0).astype(np.int64) for k in range(7))
            live = live[differ == 0]
    out[live] = 7 * words
    return np.minimum(out, most)


def _pieces(batch_column, length: int = LENGTH):
    """(first row, data, offsets, offset of the data in its row): slices, a very long row in several pieces."""
    for first, end, data, offsets in slices(batch_column):
        if end - first > 1 or len(data) <= 2 * SLICE_BYTES:
            yield first, data, offsets, 0
            continue
        for at in range(0, max(1, len(data) - length + 1), SLICE_BYTES):
            part = data[at : at + SLICE_BYTES + length - 1]
            yield first, part, np.array([0, len(part)]), at


def _pack(columns: list[np.ndarray]) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"".join([len(columns[0]).to_bytes(8, "little"), *(x.tobytes() for x in columns)]))


def _unpack(body: bytes, kinds: list) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(body)
    n, at, out = int.from_bytes(raw[:8], "little"), 8, []
    for kind in kinds:
        out.append(np.frombuffer(raw, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return out


#: What is kept of an anchor: hash, document, checksum, first window, windows (and TWICE, if its gram occurs twice).
TWICE = 1 << 15
_ANCHOR = [np.uint64, np.int64, np.uint64, np.uint32, np.uint16]
#: What is kept of a shared one: bucket, hash, first window, windows, dealt to several buckets.
_SHARED = [np.uint32, np.uint64, np.uint32, np.uint16, np.uint8]


def _counted_together(column, length: int, gram: int) -> Iterator[np.ndarray]:
    """The sorted hashes of the grams of about ``COUNTED_BYTES`` bytes of text at a time."""
    held, size = [], 0
    for _, data, _, _ in _pieces(column, length):
        held.append(gram_hashes(data, gram))
        size += len(held[-1])
        if size >= COUNTED_BYTES:
            yield np.sort(np.concatenate(held))
            held, size = [], 0
    if size:
        yield np.sort(np.concatenate(held))


def _frequent_grams(slim: DataFrame, length: int, gram: int) -> tuple[np.ndarray, int]:
    """Hashes of the frequent grams, sorted, and the number of grams in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, found, many = 0, [], []
            for h in _counted_together(batch.column(2), length, gram):
                n += len(h)
                cuts = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
                counts = np.diff(np.append(cuts, len(h)))
                often = counts * 2 * FREQUENT >= max(len(h), 6 * FREQUENT)
                found.append(h[cuts[often]])
                many.append(counts[often])
            hashes = np.concatenate([*found, np.array([_TOP])]).view(np.int64)
            counts = np.concatenate([*many, np.array([n])]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(hashes), pa.array(counts)], ["h", "n"])

    counted = slim.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    mark = np.array([_TOP]).view(np.int64)[0].item()
    total = counted.where(F.col("h") == mark).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    often = counted.where((F.col("h") != mark) & (F.col("n") * FREQUENT >= max(total, 4 * FREQUENT))).select("h").toArrow()
    return np.sort(often.column(0).to_numpy().view(np.uint64)), total


def _anchor_rows(slim: DataFrame, frequent: np.ndarray, routes: int, length: int, gram: int) -> DataFrame:
    """(route, anchors) with the anchors of a batch that go one way packed together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            sums = batch.column(1).to_numpy().view(np.uint64)
            held: list[list[np.ndarray]] = []
            for first_row, data, offsets, shift in _pieces(batch.column(2), length):
                row, h, first, end, twice = anchors(data, offsets, frequent, length, gram)
                if len(row):
                    within = first - offsets[row] + shift
                    held.append([h, ids[first_row + row], sums[first_row + row], within.astype(np.uint32), (end - first + TWICE * twice).astype(np.uint16)])
            if not held:
                continue
            columns = [np.concatenate(x) for x in zip(*held)]
            h = columns[0]
            spread = _isin(h, frequent) if len(frequent) else np.zeros(len(h), bool)
            by = mix(np.where(spread, h ^ mix(columns[1].view(np.uint64)), h)) % np.uint64(routes)
            order = np.argsort(by, kind="stable")
            by = by[order]
            columns = [x[order] for x in columns]
            cuts = np.append(np.flatnonzero(np.append(True, by[1:] != by[:-1])), len(by))
            bodies = [_pack([x[s:e] for x in columns]) for s, e in zip(cuts[:-1], cuts[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(by[cuts[:-1]].astype(np.int64)), pa.array(bodies, pa.binary())], ["route", "anchors"])

    return slim.mapInArrow(run, "route long, anchors binary")


def _shared_rows(routed: DataFrame, frequent: np.ndarray, buckets: int) -> DataFrame:
    """(did, sum, shared): of each document, the anchors that occur elsewhere too."""

    def run(table: pa.Table) -> pa.Table:
        held = [_unpack(x, _ANCHOR) for x in table.column("anchors").to_pylist()]
        h, ids, sums, first, n = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(h)
        h, ids, sums, first, n = (x[order] for x in (h, ids, sums, first, n))
        twice = n >= TWICE
        n = n % np.uint16(TWICE)
        lead = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        counts = np.diff(np.append(lead, len(h)))
        upto = np.cumsum(n, dtype=np.int64)
        before = upto - n
        windows = np.add.reduceat(n, lead, dtype=np.int64)
        nth = before - np.repeat(before[lead], counts)
        counts, windows = np.repeat(counts, counts), np.repeat(windows, counts)
        often = _isin(h, frequent) if len(frequent) else np.zeros(len(h), bool)
        dealt = often | (windows > SALTED)
        route = np.uint64(table.column("route")[0].as_py())
        salt = np.where(dealt, (nth // SALTED + 1).astype(np.uint64) * np.uint64(0x9E3779B1) + np.where(often, route + np.uint64(1), 0).astype(np.uint64), 0)
        bucket = (mix(h + mix(salt.astype(np.uint64))) % np.uint64(buckets)).astype(np.uint32)
        keep = np.flatnonzero(often | (counts > 1) | twice)
        keep = keep[np.lexsort([sums[keep], ids[keep]])]
        ids, sums = ids[keep], sums[keep]
        columns = [bucket[keep], h[keep], first[keep], n[keep], dealt[keep].astype(np.uint8)]
        cuts = np.append(np.flatnonzero(np.append(True, (ids[1:] != ids[:-1]) | (sums[1:] != sums[:-1]))), len(ids)) if len(ids) else np.zeros(1, np.int64)
        bodies = [b"".join([int(e - s).to_bytes(8, "little"), *(x[s:e].tobytes() for x in columns)]) for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
        return pa.table([pa.array(ids[cuts[:-1]]) if len(ids) else pa.array([], pa.int64()), pa.array(sums[cuts[:-1]].view(np.int64)) if len(ids) else pa.array([], pa.int64()), pa.array(bodies, pa.binary())], names=["did", "sum", "shared"])

    return routed.groupBy("route").applyInArrow(run, "did long, sum long, shared binary")


#: What is kept of a stretch: bucket, hash, dealt to several buckets, document, checksum, first window, windows.
_STRETCH = [np.uint32, np.uint64, np.uint8, np.int64, np.uint64, np.uint32, np.uint16]


def _stretches(joined: DataFrame, routes: int, length: int) -> DataFrame:
    """(route, stretches): the text around every shared anchor, from (did, sum, text, shared).

    The stretches of a batch whose buckets go one way are packed together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacker = zstandard.ZstdDecompressor()
        packer = zstandard.ZstdCompressor(level=3)
        held: list[list[np.ndarray]] = []
        texts: list[bytes] = []
        begins: list[np.ndarray] = []
        size = rows = 0

        def done() -> Iterator[pa.RecordBatch]:
            columns = [np.concatenate(x) for x in zip(*held)]
            data = np.frombuffer(b"".join(texts), np.uint8)
            begin = np.concatenate(begins)
            by = columns[0] % np.uint32(routes)
            order = np.lexsort((columns[0], by))
            columns, begin, by = [x[order] for x in columns], begin[order], by[order]
            cuts = np.append(np.flatnonzero(np.append(True, by[1:] != by[:-1])), len(by))
            bodies = []
            for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                body = data[_spread(begin[s:e], columns[6][s:e].astype(np.int64) + length - 1)]
                bodies.append(packer.compress(b"".join([(e - s).to_bytes(8, "little"), *(x[s:e].tobytes() for x in columns), body.tobytes()])))
            held.clear(), texts.clear(), begins.clear()
            yield pa.RecordBatch.from_arrays([pa.array(by[cuts[:-1]].astype(np.int64)), pa.array(bodies, pa.binary())], ["route", "stretches"])

        for batch in batches:
            for did, check, body, parts in zip(*(batch.column(k) for k in ("did", "sum", "text", "shared"))):
                if not parts.is_valid:
                    continue
                text = unpacker.decompress(body.as_buffer().to_pybytes())
                for part in parts.as_py():
                    n, at, columns = int.from_bytes(part[:8], "little"), 8, []
                    for kind in _SHARED:
                        columns.append(np.frombuffer(part, kind, n, at))
                        at += n * np.dtype(kind).itemsize
                    bucket, h, first, count, dealt = columns
                    held.append([bucket, h, dealt, np.full(n, did.as_py(), np.int64), np.full(n, check.as_py(), np.int64).view(np.uint64), first, count])
                    begins.append(first.astype(np.int64) + size)
                    rows += n
                texts.append(text)
                size += len(text)
                if rows >= 1 << 17:
                    yield from done()
                    size = rows = 0
        if rows:
            yield from done()

    return joined.select("did", "sum", "text", "shared").mapInArrow(run, "route long, stretches binary")


def _spread(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The indices first[k] .. first[k] + counts[k] of every k, one after another."""
    return np.arange(int(counts.sum())) + np.repeat(first - (np.cumsum(counts) - counts), counts)


_FOUND = "did long, sum long, start long, end long, h long, first long, body binary"


def _bucket(columns: list[np.ndarray], data: np.ndarray, begins: np.ndarray, last: bool, length: int) -> pa.Table:
    """The work of one bucket: its repeated windows as byte ranges, and before the last round the stretches that go on."""
    _, h, dealt, ids, sums, first, windows = columns
    first, n_windows = first.astype(np.int64), windows.astype(np.int64)
    _, document = np.unique(ids, return_inverse=True)
    named = (sums & np.uint64(1)).astype(np.int64)  # a null id is before the least id
    again = repeated(data, begins, n_windows, (2 * document.astype(np.int64) + named << 40) + first, length)
    opens = np.cumsum(n_windows) - n_windows
    of = np.repeat(np.arange(len(ids)), n_windows)
    # Ranges of windows that repeat, stretch by stretch.
    edge = np.append(True, of[1:] != of[:-1])
    start = np.flatnonzero(again & (edge | ~np.append(False, again[:-1])))
    stop = np.flatnonzero(again & (np.append(edge[1:], True) | ~np.append(again[1:], False)))
    row = of[start]
    out = [ids[row], sums[row].view(np.int64), first[row] + start - opens[row], first[row] + stop - opens[row] + length]
    none = pa.nulls(len(row), pa.int64())
    found = pa.table([*(pa.array(x) for x in out), none, none, pa.nulls(len(row), pa.binary())], names=["did", "sum", "start", "end", "h", "first", "body"])
    if last:
        return found
    on = np.flatnonzero((np.add.reduceat(~again, opens) > 0) & (dealt > 0))
    # They meet by a longer gram, so that the contexts of one frequent anchor part ways.
    sizes = n_windows[on] + length - 1
    text = data[_spread(begins[on], sizes)]
    row, longer, begin, end, _ = anchors(text, np.append(0, np.cumsum(sizes)), np.zeros(0, np.uint64), length, LONG_GRAM * length // LENGTH)
    bodies = [text[s : e + length - 1].tobytes() for s, e in zip(begin.tolist(), end.tolist())]
    first = first[on[row]] + begin - (np.cumsum(sizes) - sizes)[row]
    h, on = mix(h[on[row]] + mix(longer)), on[row]
    none = pa.nulls(len(on), pa.int64())
    rest = pa.table([pa.array(ids[on]), pa.array(sums[on].view(np.int64)), none, none, pa.array(h.view(np.int64)), pa.array(first), pa.array(bodies, pa.binary())], names=found.column_names)
    return pa.concat_tables([found, rest])


def _first_round(length: int):
    """Suffix arrays over the stretches of one route, bucket by bucket."""

    def run(table: pa.Table) -> pa.Table:
        unpacker = zstandard.ZstdDecompressor()
        held, texts = [], []
        for small in table.column("stretches"):
            body = unpacker.decompress(small.as_buffer().to_pybytes())
            n, at, columns = int.from_bytes(body[:8], "little"), 8, []
            for kind in _STRETCH:
                columns.append(np.frombuffer(body, kind, n, at))
                at += n * np.dtype(kind).itemsize
            held.append(columns)
            texts.append(body[at:])
        columns = [np.concatenate(x) for x in zip(*held)]
        data = np.frombuffer(b"".join(texts), np.uint8)
        sizes = columns[6].astype(np.int64) + length - 1
        begins = np.cumsum(sizes) - sizes
        order = np.argsort(columns[0], kind="stable")
        columns, begins = [x[order] for x in columns], begins[order]
        cuts = np.append(np.flatnonzero(np.append(True, columns[0][1:] != columns[0][:-1])), len(order)).tolist()
        return pa.concat_tables([_bucket([x[s:e] for x in columns], data, begins[s:e], False, length) for s, e in zip(cuts[:-1], cuts[1:])])

    return run


def _second_round(length: int):
    """Suffix arrays over the stretches that went on, anchor by anchor; ranges pass through."""
    names = ["did", "sum", "start", "end"]

    def work(table: pa.Table) -> pa.Table:
        bodies = table.column("body").to_pylist()
        sizes = np.array([len(x) for x in bodies], np.int64)
        none = np.zeros(len(bodies), np.uint64)
        columns = [none, none, none, table.column("did").to_numpy(), table.column("sum").to_numpy().view(np.uint64), table.column("first").to_numpy(), sizes - length + 1]
        return _bucket(columns, np.frombuffer(b"".join(bodies), np.uint8), np.cumsum(sizes) - sizes, True, length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        size = 0
        for batch in batches:
            table = pa.Table.from_batches([batch])
            body = table.column("body")
            last = len(table) - body.null_count  # these come first
            if last:
                held.append(table.slice(0, last))
                size += body.nbytes
            if size > SECOND_BYTES:  # whole keys of them at once
                whole = pa.concat_tables(held)
                key = whole.column("k").to_numpy()
                ends = np.flatnonzero(key[1:] != key[:-1]) + 1
                if len(ends):
                    yield from work(whole.slice(0, int(ends[-1]))).select(names).to_batches()
                    whole = whole.slice(int(ends[-1]))
                held, size = [whole], 0 if len(ends) else size
            if last < len(table):
                yield from table.slice(last).select(names).to_batches()
        if held and len(whole := pa.concat_tables(held)):
            yield from work(whole).select(names).to_batches()

    return run


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) for every row of ``docs``; ``kept`` are the bytes that stay."""
    body = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    key = F.col(id_col).cast("long")
    # The sum tells rows of one id apart; its last bit whether there is an id.
    sum_ = F.xxhash64(body).bitwiseAND(F.lit(-2)).bitwiseOR(key.isNotNull().cast("long"))
    slim = docs.select(F.coalesce(key, F.lit(-(1 << 63))).alias("did"), sum_.alias("sum"), body.alias("text"))
    frequent, n_grams = _frequent_grams(slim, length, gram)
    n_anchors = 2 * n_grams // (length - gram + 2)
    routed = _anchor_rows(slim, frequent, max(256, n_anchors // COUNT_BUCKET), length, gram)
    shared = _shared_rows(routed, frequent, max(256, n_anchors // SORT_BUCKET))

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            small = pa.array([packer.compress(x.as_buffer().to_pybytes()) for x in batch.column(2)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), small], ["did", "sum", "text"])

    texts = slim.mapInArrow(squeeze, "did long, sum long, text binary")
    by_row = shared.groupBy("did", "sum").agg(F.collect_list("shared").alias("shared"))
    # Both joins have the texts on their left and nothing between, so that the plan shuffles them once.
    routes = max(256, n_anchors // ROUTE)
    around = _stretches(texts.join(by_row.hint("merge"), ["did", "sum"], "left"), routes, length)
    once = around.groupBy("route").applyInArrow(_first_round(length), _FOUND)
    # What goes on to the second round meets by its anchor; ranges ride along on their document.
    meet = once.withColumn("k", F.coalesce("h", F.xxhash64("did", "start"))).repartition("k").sortWithinPartitions(F.col("body").isNull(), "k")
    found = meet.mapInArrow(_second_round(length), "did long, sum long, start long, end long")
    ranges = found.groupBy("did", "sum").agg(F.collect_list(F.struct("start", "end")).alias("ranges"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacker = zstandard.ZstdDecompressor()
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for did, check, small, found in zip(batch.column("did").to_pylist(), batch.column("sum").to_pylist(), batch.column("text"), batch.column("ranges")):
                text = unpacker.decompress(small.as_buffer().to_pybytes())
                spans: list[list[int]] = []
                if found.is_valid and len(found):
                    flat = found.values
                    both = np.stack([flat.field(0).to_numpy(), flat.field(1).to_numpy()], axis=1)
                    both = both[np.argsort(both[:, 0], kind="stable")]
                    upto = np.maximum.accumulate(both[:, 1])
                    cuts = np.flatnonzero(np.append(True, both[1:, 0] > upto[:-1]))
                    spans = np.stack([both[cuts, 0], upto[np.append(cuts[1:] - 1, len(both) - 1)]], axis=1).tolist()
                at, kept = 0, []
                for s, e in spans:
                    kept.append(text[at:s])
                    at = e
                kept.append(text[at:])
                rest = b"".join(kept)
                for values, x in zip(out, (did if check & 1 else None, len(text), len(text) - len(rest), len(spans), rest)):
                    values.append(x)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return texts.join(ranges.hint("merge"), ["did", "sum"], "left").select("did", "sum", "text", "ranges").mapInArrow(keep, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def removed_sha256(kept: bytes) -> str:
    """What the query's digest is for these bytes."""
    return hashlib.sha256(kept).hexdigest()
