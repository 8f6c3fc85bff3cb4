"""Token-ID output in training order: packed sequences, a keyed permutation, fixed-stride shards.

Texts become token ids, each text closed by the end id. Documents are dealt to groups by a hash of id and text
and stand in a group by that hash, so that their order depends on the rows alone and not on files or splits. The
ids of a group are packed into sequences of ``seq_len`` ids, the last filled up with end ids. Sequences are
numbered 0..n-1 (groups in order, then their sequences). A Feistel network keyed by the seed permutes the
least power of four that holds n; a number that lands at n or above walks on through the network until it
lands below (cycle-walking), which permutes 0..n-1 itself. The image is the sequence's slot, its place in
training order. Shard k holds slots k * per_shard up to (k + 1) * per_shard, one after another, each
``seq_len`` little-endian integers of two or four bytes and a line feed that Spark's text writer adds: the
stride is ``seq_len * width + 1``, so a reader that stopped at a slot resumes by one seek.

Texts are cut before a space that follows a non-space, and each distinct piece is encoded once: a piece's
ids depend on the piece alone, as the vocabulary's pattern never joins a non-space to white space after it.
Known pieces are looked up by their spelling.

Each text is tokenized once: packed sequences are written to the shared folder, counted there and then sent to
their shards. The driver gets one count a group, ``MOST_GROUPS`` at most.

Defined cases: a null text has no ids and no end id; an empty text is one end id; bytes that are no UTF-8 count
as replacement characters; repeated rows (of one group, as their hashes are equal) are packed as often as they
stand; a null id hashes as any other value; an empty table has no sequence; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saltmarsh.session import cut, freed_shuffles

SEQ_LEN = 1024
#: Sequences of a shard.
PER_SHARD = 4096
ROUNDS = 4
SEED = "order-1"
#: A byte-level vocabulary as ranks; the id after its last is free and closes a text.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space before a space: such texts are cut by CUT instead of at every space.
AWKWARD = re.compile(r"\s ")
CUT = re.compile(r"(?<=\S)(?=[\t-\r ])")
#: Pieces that a task remembers, and characters whose pieces it looks up at once.
REMEMBERED = 400_000
SLICE_CHARS = 1 << 20
#: Bytes of text of a group; beyond so many groups, groups grow.
GROUP_BYTES = 4 << 20
MOST_GROUPS = 1 << 16
#: Sequences that are written, or sent to their shards, together.
BLOCK, SENT = 128, 12288
#: Range partitions of shards; beyond so many shards, a partition holds several.
MOST_PARTS = 1 << 16


class Encoder:
    """Texts to ids as little-endian bytes, by distinct pieces."""

    def __init__(self, vocabulary: bytes):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        self.end = max(ranks.values()) + 1
        self.kind = f"<u{id_width(vocabulary)}"
        self.closing = np.array([self.end], self.kind).tobytes()
        self.inner = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.lengths = np.zeros(self.end, np.int64)
        for spelled, rank in ranks.items():
            self.lengths[rank] = len(spelled)
        self.spaced: dict[str, bytes] = {}  # what stands after a space, with that space
        self.other: dict[str, bytes] = {"": b""}

    def _one(self, piece: str) -> bytes:
        return np.array(self.inner.encode_ordinary(piece), self.kind).tobytes()

    def _learn(self, missing: set[str]) -> None:
        """Encode words that stand after a space; those that do not end in white space go as one text."""
        joined = list(missing)
        text = " " + " ".join(joined)
        if AWKWARD.search(text) or text[-1].isspace():
            joined = [w for w in missing if w and not w[-1].isspace()]
            text = " " + " ".join(joined)
            for w in missing.difference(joined):
                self.spaced[w] = self._one(" " + w)
        if not joined:
            return
        ids = np.array(self.inner.encode_ordinary(text), np.int64)
        size = np.fromiter(map(len, joined if text.isascii() else map(str.encode, joined)), np.int64, len(joined)) + 1
        width = int(self.kind[2:])
        cuts = ((np.searchsorted(np.cumsum(self.lengths[ids]), np.cumsum(size)) + 1) * width).tolist()
        body = ids.astype(self.kind).tobytes()
        self.spaced.update(zip(joined, map(body.__getitem__, map(slice, [0, *cuts], cuts))))

    def _pieces(self, text: str) -> tuple[list[str], list[str] | None]:
        """The text's first piece and the words after its spaces; or, of an awkward text, None and all pieces."""
        if AWKWARD.search(text):
            return CUT.split(text), None
        first, *words = text.split(" ")
        return [first], words

    def _looked_up(self, parts: list[tuple[list[str], list[str] | None]]) -> Iterator[bytes]:
        if len(self.spaced) + len(self.other) > REMEMBERED:
            self.spaced, self.other = {}, {"": b""}
        missing = set(chain.from_iterable(words for _, words in parts if words)).difference(self.spaced)
        self._learn(missing)
        for pieces, words in parts:
            for piece in pieces:
                if piece not in self.other:
                    self.other[piece] = self._one(piece)
            yield b"".join(chain(map(self.other.__getitem__, pieces), map(self.spaced.__getitem__, words or ())))

    def encode(self, column) -> Iterator[bytes]:
        """Each row's ids with the end id; a null row has none."""
        held: list = []
        size = 0
        for body in column:
            if not body.is_valid:
                held.append(None)
                continue
            text = body.as_buffer().to_pybytes().decode(errors="replace")
            held.append(segments := [])
            at = 0
            while len(text) - at > SLICE_CHARS and (m := CUT.search(text, at + SLICE_CHARS)):
                segments.append(b"".join(self._looked_up([self._pieces(text[at : m.start()])])))
                at = m.start()
            segments.append(self._pieces(text[at:]))
            size += len(text) - at
            if size >= SLICE_CHARS:
                yield from self._done(held)
                held, size = [], 0
        yield from self._done(held)

    def _done(self, held: list) -> Iterator[bytes]:
        found = self._looked_up([x[-1] for x in held if x is not None])
        for x in held:
            yield b"" if x is None else b"".join([*x[:-1], next(found), self.closing])


def id_width(vocabulary: bytes) -> int:
    """Bytes of one id: 2 where every id and the end id fit, else 4."""
    return 2 if max(int(line.split()[1]) for line in vocabulary.splitlines() if line) + 1 < 1 << 16 else 4


def blocks(batches: Iterator[pa.RecordBatch], encoder: Encoder, seq_len: int) -> Iterator[tuple[int, int, int, bytes]]:
    """(group, number of the first, sequences, their bytes) from batches of (group, text), group by group; a group's last is filled up."""
    stride = seq_len * len(encoder.closing)
    group, done = None, 0
    held: list[bytes] = []
    size = 0

    def taken(last: bool) -> Iterator[tuple[int, int, int, bytes]]:
        nonlocal held, size, done
        body = b"".join(held)
        if last:
            body += encoder.closing * (-len(body) % stride // len(encoder.closing))
        whole = len(body) // stride
        for k in range(0, whole, BLOCK):
            n = min(BLOCK, whole - k)
            yield group, done + k, n, body[k * stride : (k + n) * stride]
        held, size, done = [body[whole * stride :]], len(body) - whole * stride, done + whole

    for batch in batches:
        for of, ids in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1))):
            if of != group:
                if group is not None:
                    yield from taken(True)
                group, done, held, size = of, 0, [], 0
            held.append(ids)
            size += len(ids)
            if size >= 8 * BLOCK * stride:
                yield from taken(False)
    if group is not None:
        yield from taken(True)


def round_keys(seed: str, rounds: int = ROUNDS) -> list[int]:
    """One positive 30-bit key a round."""
    return [int.from_bytes(hashlib.sha256(f"{seed}:{k}".encode()).digest()[:4], "big") >> 2 for k in range(rounds)]


def half_bits(n: int) -> int:
    """Bits of one half of the least power of four that holds n."""
    return max(1, (max(1, n - 1).bit_length() + 1) // 2)


def permute(x: np.ndarray, n: int, seed: str = SEED) -> np.ndarray:
    """The slots of sequence numbers below n."""
    bits = half_bits(n)
    mask = np.uint64((1 << bits) - 1)
    keys = [np.uint64(k) for k in round_keys(seed)]

    def network(v: np.ndarray) -> np.ndarray:
        left, right = v >> np.uint64(bits), v & mask
        for k in keys:
            f = (right + k) * np.uint64(0x9E3779B97F4A7C15)
            f = (f ^ (f >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((f >> np.uint64(31)) & mask)
        return (left << np.uint64(bits)) | right

    out = network(np.asarray(x, np.uint64))
    while (out >= n).any():
        far = out >= n
        out[far] = network(out[far])
    return out.astype(np.int64)


def packed_sequences(docs: DataFrame, id_col: str, text_col: str, seq_len: int, ranks: bytes) -> DataFrame:
    """(grp, first, n, body): blocks of sequences, written to the shared folder."""
    slim = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("binary").alias("text"))
    size = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(1, min(MOST_GROUPS, -(-size // GROUP_BYTES)))
    hashed = slim.withColumn("hash", F.xxhash64("id", "text"))
    dealt = hashed.withColumn("grp", F.pmod("hash", F.lit(groups)).cast("int"))
    ordered = dealt.repartition("grp").sortWithinPartitions("grp", "hash", "id", "text").select("grp", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3)
        for group, first, n, body in blocks(batches, Encoder(ranks), seq_len):
            yield pa.RecordBatch.from_arrays([pa.array([group], pa.int32()), pa.array([first], pa.int64()), pa.array([n], pa.int64()), pa.array([packer.compress(body)], pa.binary())], ["grp", "first", "n", "body"])

    return cut(ordered.mapInArrow(run, "grp int, first long, n long, body binary"))


def training_order(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", seq_len: int = SEQ_LEN, per_shard: int = PER_SHARD, seed: str = SEED, vocabulary: str = VOCABULARY) -> tuple[DataFrame, int]:
    """((shard, slot, payload) for every sequence, shard by shard in slot order; number of sequences).

    ``payload`` is the sequence as little-endian bytes.
    """
    with open(vocabulary, "rb") as file:  # on the driver; executors get its bytes
        ranks = file.read()
    stride = seq_len * id_width(ranks)
    packed = packed_sequences(docs, id_col, text_col, seq_len, ranks)
    counts = packed.groupBy("grp").agg(F.sum("n").alias("n")).orderBy("grp").toArrow()  # MOST_GROUPS rows at most
    n = int(counts.column("n").to_numpy().sum())
    before = np.zeros((counts.column("grp").to_numpy().max() if len(counts) else 0) + 1, np.int64)
    before[counts.column("grp").to_numpy()] = np.cumsum(counts.column("n").to_numpy()) - counts.column("n").to_numpy()
    shards = max(1, -(-n // per_shard))
    parts = min(shards, MOST_PARTS)
    part_slots = -(-shards // parts) * per_shard

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, unpacker = zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()
        held: list[bytes] = []
        numbers: list[np.ndarray] = []
        size = 0

        def done() -> Iterator[pa.RecordBatch]:
            slots = permute(np.concatenate(numbers), n, seed)
            rows = np.frombuffer(b"".join(held), np.uint8).reshape(-1, stride)
            held.clear(), numbers.clear()
            order = np.argsort(slots)
            slots, part = slots[order], slots[order] // part_slots
            cuts = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])), len(part)).tolist()
            bodies = [packer.compress(slots[s:e].tobytes() + rows[order[s:e]].tobytes()) for s, e in zip(cuts[:-1], cuts[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(part[cuts[:-1]].astype(np.int32)), pa.array(bodies, pa.binary())], ["part", "body"])

        for batch in batches:
            for group, first, many, body in zip(*(batch.column(k).to_pylist() for k in range(4))):
                held.append(unpacker.decompress(body))
                numbers.append(before[group] + first + np.arange(many))
                size += many
                if size >= SENT:
                    yield from done()
                    size = 0
        if size:
            yield from done()

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacker = zstandard.ZstdDecompressor()
        for batch in batches:
            for small in batch.column(1):
                body = unpacker.decompress(small.as_buffer().to_pybytes())
                many = len(body) // (8 + stride)
                slots = np.frombuffer(body, np.int64, many)
                payload = pa.FixedSizeBinaryArray.from_buffers(pa.binary(stride), many, [None, pa.py_buffer(body[8 * many :])]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(slots // per_shard), pa.array(slots), payload], ["shard", "slot", "payload"])

    sent = packed.mapInArrow(send, "part int, body binary").repartitionById(parts, F.col("part"))
    return sent.mapInArrow(unpack, "shard long, slot long, payload binary").sortWithinPartitions("shard", "slot"), n


def write_shards(ordered: DataFrame, path: str) -> DataFrame:
    """Write ``training_order``'s rows as one fixed-stride file a shard; returns (shard, content) of the files.

    Spark's own writer commits them, so a lost executor leaves no part of a shard behind.
    """
    with freed_shuffles(ordered.sparkSession):
        ordered.select("shard", F.col("payload").cast("string").alias("value")).write.partitionBy("shard").option("lineSep", "\n").text(path)
    files = ordered.sparkSession.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(path)
    return files.select(F.regexp_extract("path", r"shard=(\d+)", 1).cast("long").alias("shard"), "content")


def read_slots(content: bytes, start: int, count: int, seq_len: int = SEQ_LEN, width: int = 2) -> np.ndarray:
    """Sequences ``start`` up to ``start + count`` of one shard file, by their place alone."""
    stride = seq_len * width + 1
    part = np.frombuffer(content, np.uint8)[start * stride : (start + count) * stride].reshape(-1, stride)
    return np.ascontiguousarray(part[:, :-1]).view(f"<u{width}")


def manifest(files: DataFrame, seq_len: int = SEQ_LEN, per_shard: int = PER_SHARD, width: int = 2) -> DataFrame:
    """(slot, shard, byte_offset, sequence_sha256) of every sequence in the files of ``write_shards``."""
    stride = seq_len * width + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                body = content.as_buffer().to_pybytes()
                if len(body) % stride:
                    raise ValueError(f"shard {shard} is not a whole number of records")
                at = np.arange(len(body) // stride)
                hashes = [hashlib.sha256(body[k * stride : (k + 1) * stride - 1]).hexdigest() for k in at.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(shard * per_shard + at), pa.array(np.full(len(at), shard)), pa.array(at * stride), pa.array(hashes, pa.string())], ["slot", "shard", "byte_offset", "sequence_sha256"])

    return files.mapInArrow(run, "slot long, shard long, byte_offset long, sequence_sha256 string")
