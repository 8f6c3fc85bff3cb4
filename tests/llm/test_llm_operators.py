"""Each operator against a plain version of its rule, with nulls, empty and long texts, ties, repeats and extra columns."""

import base64
import hashlib
import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from saltmarsh.llm import ann, decontaminate, language_id, mixing, secrets, simhash, suffix_dedup, token_output, toxicity, url_filter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, copies int"


def table(spark, rows):
    """Documents with an extra column whose name an operator uses itself."""
    full = [(i, t, lang, src, None if t is None else len(t), 1) for i, t, lang, src in rows]
    return spark.createDataFrame(full, SCHEMA)


def words(rng, n, letters="abcdefgh"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def odd_rows():
    rng = random.Random(3)
    rows = [(k, words(rng, rng.choice([1, 3, 40, 200])), rng.choice(["en", "fr"]), rng.choice(["a", "b", None])) for k in range(40)]
    rows += [(100, None, "en", "a"), (101, "", None, "b"), (102, "  \t\n", "fr", "b"), (None, words(rng, 30), "en", None), (None, None, None, None)]
    rows += [rows[5], rows[5], (103, rows[5][1], "en", "a"), (104, words(rng, 20000), "en", "a"), (105, "\0 é   x", "fr", "a")]
    return rows


# 1


def brute_repeats(rows, length=100):
    low = -(1 << 63)
    key = lambda i, k: (low if i is None else i, k)
    seen = {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - length + 1):
            w = b[k : k + length]
            seen[w] = min(seen.get(w, (1 << 62, 0)), key(i, k))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] < key(i, k):
                gone[k : k + length] = True
        spans = int((gone & ~np.append(False, gone[:-1])).sum()) if len(b) else 0
        out.append((i, len(b), int(gone.sum()), spans, np.frombuffer(b, np.uint8)[~gone].tobytes()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("salted", [1 << 15, 200])
def test_suffix_dedup(spark, odd_rows, salted, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SALTED", salted)
    rng = random.Random(5)
    base = ["".join(rng.choice("ab c") for _ in range(n)) for n in (50, 100, 150, 400)]
    more = [(200 + k, "".join(rng.choice([rng.choice(base), rng.choice(base)[10:130], "a" * 150, "\0" * 120 + "b", "éàü" * 40, words(rng, 9)]) for _ in range(rng.randint(0, 5))), "en", "a") for k in range(60)]
    rows = [r for r in odd_rows if r[0] != 104] + more
    got = suffix_dedup.suffix_dedup(table(spark, rows)).collect()
    assert sorted([(r[0], r[1], r[2], r[3], bytes(r[4])) for r in got], key=repr) == brute_repeats([(r[0], r[1]) for r in rows])


def test_suffix_order_is_the_order_of_suffixes():
    rng = random.Random(1)
    for _ in range(30):
        body = bytes(rng.choice(b"aab\0c") for _ in range(rng.randint(1, 200)))
        text = np.concatenate([np.frombuffer(body, np.uint8).astype(np.uint16) + 1, np.zeros(7 * 40, np.uint16)])
        wanted = np.zeros(len(text), bool)
        wanted[: len(body)] = True
        order = suffix_dedup.suffix_order(text, suffix_dedup.packed(text), wanted, 30)
        assert order.tolist() == sorted(range(len(body)), key=lambda k: [c + 1 for c in body[k:]])


def test_anchor_windows_cover_each_window_once():
    rng = random.Random(2)
    for frequent in (np.zeros(0, np.uint64), None):
        data = np.frombuffer(bytes(rng.choice(b"ab") for _ in range(3000)) + b"z" * 700, np.uint8)
        offsets = np.array([0, 50, 149, 149, 900, 3700])
        if frequent is None:
            frequent = np.unique(suffix_dedup.gram_hashes(data)[::7])
        row, h, first, end, twice = suffix_dedup.anchors(data, offsets, frequent)
        grams = suffix_dedup.gram_hashes(data)
        assert [(grams[s : e + 80] == v).sum() > 1 for s, e, v in zip(first, end, h)] == twice.tolist()
        got = sorted((r, k) for r, s, e in zip(row, first, end) for k in range(s, e))
        assert got == [(r, k) for r in range(5) for k in range(offsets[r], offsets[r + 1] - 99)]


# 2


def test_secrets(spark, odd_rows):
    der = bytes([0x30, 26, 2, 1, 0, 4, 21]) + b"k" * 21
    token = ".".join(base64.urlsafe_b64encode(x).decode().rstrip("=") for x in (b'{"alg":"HS256"}', b'{"sub":"1"}', b"signature"))
    ssh = base64.b64encode(b"".join(len(x).to_bytes(4, "big") + x for x in (b"ssh-ed25519", b"p" * 32))).decode()
    texts = {
        300: f"é password: token: abcdefgh PassWD='{'x' * 8}' api_key=abc ſecret=abcdefgh",
        301: f"AKIA{'Z' * 16} AKIA{'Z' * 15} {'0a' * 12}",
        302: f"jwt {token} end",
        303: f"key {base64.b64encode(der * 1).decode()} and {ssh}",
        304: "hex " + der.hex(),
        305: base64.b64encode(b"just some longer text here, no key").decode(),
    }
    rows = odd_rows + [(k, t, "en", "a") for k, t in texts.items()]
    got = {r.doc_id: r for r in secrets.scan(table(spark, rows)).collect() if r.doc_id is not None}
    for i, t, *_ in rows:
        if i is None:
            continue
        t = t or ""
        base = [(m.start(), 0, m.end()) for m in secrets.ASSIGN.finditer(t) if len(m[2]) >= 6]
        base += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        base += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        line = ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in sorted(base))
        assert got[i].base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(x[1] == k for x in base) for k in range(3))
    kinds = {i: [x.kind for x in got[i].found] for i in texts}
    assert kinds[300] == ["assign"] and kinds[302] == ["jwt"] and kinds[303] == ["der", "public"] and "der" in kinds[304] and kinds[305] == []


def test_secrets_reach_real_key_files():
    der = bytes([0x30, 0x82, 1, 7, 2, 1, 0, 4, 0x82, 1, 0]) + bytes(range(256))
    locked = bytes([0x30, 55, 0x30, 13, 6, 3, 42, 3, 4, 0x30, 6, 4, 4]) + b"salt" + bytes([4, 38]) + b"\xfb\xff" * 19
    digest = bytes([0x30, 49, 0x30, 13, 6, 9, 96, 134, 72, 1, 101, 3, 4, 2, 1, 5, 0, 4, 32]) + b"d" * 32
    ssh = b"".join(len(x).to_bytes(4, "big") + x for x in (b"ssh-rsa", b"\1\0\1", b"\0" + b"\xfb\xef" * 128))
    std, url = base64.b64encode(der).decode(), base64.urlsafe_b64encode(der).decode().rstrip("=")
    wire = base64.b64encode(ssh).decode()
    lines = [std[k : k + 64] for k in range(0, len(std), 64)]
    head, foot = "-----BEGIN PRIVATE KEY-----", "-----END PRIVATE KEY-----"
    escaped = "\\n".join([head, *lines, foot])
    cipher = base64.b64encode(b"c" * 64).decode()
    legacy = f"-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,{'0A' * 16}\n\n{cipher}\n-----END RSA PRIVATE KEY-----"
    cases = [
        ("ssl_key=", std, " end", "der"),
        ("key=", wire, "\n", "public"),
        ("x=", url, "&y", "der"),
        ('{"private_key": "', escaped, '\\n"}', "der"),
        ("", legacy, "", "der"),
        ("k: ", "\n  ".join(lines), "\nend of key", "der"),
        ('"', "\\n".join(lines), '"', "der"),
        ('"-----BEGIN PUBLIC KEY-----\\n', "\\n".join(lines), '\\n-----END PUBLIC KEY-----"', "der"),
        ('{"k":"', std.replace("/", "\\/"), '"}', "der"),
        ("k=", base64.b64encode(locked).decode(), "", "der"),
        ("ssh-rsa ", "\n".join(wire[k : k + 70] for k in range(0, len(wire), 70)), " me@host", "public"),
    ]
    for before, key, after, kind in cases:
        assert (secrets.KINDS.index(kind), len(before), len(before + key)) in [(k, s, e) for s, k, e in secrets.confirmed_spans(before + key + after)], before
    for text in (std[:-4], "x" + std, base64.b64encode(digest).decode(), legacy.replace(cipher, cipher[:-8] + "\n")):
        assert secrets.confirmed_spans(text) == []


def tlv(tag, *parts):
    body = b"".join(parts)
    size = bytes([len(body)]) if len(body) < 128 else bytes([0x82]) + len(body).to_bytes(2, "big")
    return bytes([tag]) + size + body


def test_only_private_keys_are_secrets():
    number = lambda n: tlv(2, b"\x01" + b"n" * n)
    zero, oid = tlv(2, b"\0"), tlv(6, b"\x2a\x03\x04")
    rsa = tlv(0x30, zero, *(number(40) for _ in range(8)))
    pkcs8 = tlv(0x30, zero, tlv(0x30, oid, tlv(5)), tlv(4, rsa))
    locked = tlv(0x30, tlv(0x30, oid, tlv(0x30, tlv(4, b"saltsalt"))), tlv(4, b"c" * 64))
    curve = tlv(0x30, tlv(2, b"\1"), tlv(4, b"k" * 32), tlv(0xA0, oid))
    public = tlv(0x30, tlv(0x30, oid, tlv(5)), tlv(3, b"\0" + b"p" * 64))
    signature = tlv(0x30, number(32), number(32))
    string = lambda x: len(x).to_bytes(4, "big") + x
    wire = string(b"ssh-ed25519") + string(b"p" * 32)
    inner = b"abcdabcd" + string(b"ssh-ed25519") + string(b"p" * 32) + string(b"s" * 64) + string(b"me")
    inner += bytes(range(1, 1 + -len(inner) % 8))
    openssh = secrets.MAGIC + string(b"none") + string(b"none") + string(b"") + (1).to_bytes(4, "big") + string(wire) + string(inner)
    coded = lambda x: base64.b64encode(x).decode()
    for body, kind in [(rsa, "der"), (pkcs8, "der"), (locked, "der"), (curve, "der"), (public, "public"), (signature, None), (wire, "public"), (openssh, "ssh")]:
        found = [(secrets.KINDS[k], s, e) for s, k, e in secrets.confirmed_spans(f"k={coded(body)} x")]
        assert found == ([(kind, 2, 2 + len(coded(body)))] if kind else []), kind
    for broken in (openssh[:-8], openssh.replace(b"abcdabcd", b"abcdabce"), openssh.replace(string(wire), string(b"x" * len(wire)))):
        assert not [x for x in secrets.confirmed_spans(f"k={coded(broken)} x") if secrets.KINDS[x[1]] == "ssh"]
    lines = "\n".join(coded(openssh)[k : k + 70] for k in range(0, len(coded(openssh)), 70))
    armoured = f"-----BEGIN OPENSSH PRIVATE KEY-----\n{lines}\n-----END OPENSSH PRIVATE KEY-----"
    assert secrets.confirmed_spans(armoured) == [(0, secrets.SSH, len(armoured))]


def test_secrets_of_deeply_nested_headers():
    deep = base64.urlsafe_b64encode(b"[" * 200_000).decode().rstrip("=")
    assert secrets.confirmed_spans(f"a {deep}.{deep}.x b") == []
    assert secrets.confirmed_spans("M" * 300_000) == [] and secrets.confirmed_spans("AAAA" * 100_000) == []


# 3


def brute_windows(text, items, window=13):
    ws = decontaminate.words_of((text or "").encode())
    hit, found = [False] * len(ws), set()
    for name, item in items:
        iw = decontaminate.words_of((item or "").encode())
        n = min(window, len(iw))
        for k in range(len(iw) - n + 1 if n else 0):
            for j in range(len(ws) - n + 1):
                if ws[j : j + n] == iw[k : k + n]:
                    hit[j : j + n] = [True] * n
                    found.add(name)
    found -= {None}
    digest = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
    return len(ws), sum(hit), len(found), digest, sum(hit) > 0 and 20 * sum(hit) >= len(ws)


@pytest.mark.parametrize("shard", [200_000, 20])
def test_decontamination(spark, odd_rows, shard, monkeypatch):
    monkeypatch.setattr(decontaminate, "SHARD_WORDS", shard)
    rng = random.Random(7)
    items = [(10, words(rng, 30)), (9, words(rng, 14)), (2, "One two"), (3, None), (4, "..."), (None, words(rng, 20)), (5, "aa " * 20), (9, words(rng, 15))]
    rows = [r for r in odd_rows if r[0] != 104]
    rows += [(400 + k, words(rng, 20) + " " + " ".join(t.split()[a : a + n]).upper() + "! " + words(rng, 30), "en", "a") for k, (t, a, n) in enumerate([(items[0][1], 3, 13), (items[0][1], 0, 12), (items[1][1], 0, 14), (items[5][1], 2, 15), ("aa " * 30, 0, 30), ("x one two", 0, 3)])]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    docs = table(spark, rows)
    got = sorted(map(tuple, decontaminate.judged(decontaminate.scan(docs, benchmark)).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()), key=repr)
    assert got == sorted([(i, *brute_windows(t, items)) for i, t, *_ in rows], key=repr)
    bad = {r[0] for r in got if r[5]} - {None}
    kept = decontaminate.clean(docs, benchmark)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(r[0] for r in rows if r[0] is not None and r[0] not in bad)
    assert decontaminate.remove_spans("aébc", [(1, 3)]) == "abc"


# 4


def test_permutation_and_encoder(monkeypatch):
    for n in (1, 2, 3, 7, 100, 4097):
        assert sorted(token_output.permute(np.arange(n), n).tolist()) == list(range(n))
    encoder = token_output.Encoder(open(token_output.VOCABULARY, "rb").read())
    texts = ["", None, " ", "x  y  z", "hello  world\n\n  it's ", "a　b c", "   q", "tail \n", "a\x1cb \x85c", "日本 語"]
    rng = random.Random(59)
    texts += ["".join(rng.choice([" ", " ", "a", "é", "\n", "7", ".", "\u3000", "'s", "\t", "\x1c"]) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    for limits in ({}, {"SLICE_CHARS": 7, "REMEMBERED": 5}):
        for name, value in limits.items():
            monkeypatch.setattr(token_output, name, value)
        for text, ids in zip(texts, encoder.encode(pa.array(texts, pa.string()).cast(pa.binary()))):
            assert np.frombuffer(ids, encoder.kind).tolist() == ([] if text is None else [*encoder.inner.encode_ordinary(text), encoder.end])


def test_pieces_of_equal_polynomial_hash_keep_their_ids():
    encoder = token_output.Encoder(open(token_output.VOCABULARY, "rb").read())
    bits = [0]
    while len(bits) < 2048:
        bits += [1 - b for b in bits]
    texts = ["".join("ab"[b ^ flip] for b in bits) for flip in (0, 1)]
    for text, ids in zip(texts, encoder.encode(pa.array(texts).cast(pa.binary()))):
        assert np.frombuffer(ids, encoder.kind).tolist() == [*encoder.inner.encode_ordinary(text), encoder.end]


def test_training_order_does_not_depend_on_splits(spark, odd_rows):
    docs = table(spark, odd_rows)
    found = [sorted(map(tuple, token_output.training_order(docs.repartition(n), seq_len=64, per_shard=16)[0].collect())) for n in (1, 7)]
    assert found[0] == found[1]


def test_token_output_round_trip(spark, odd_rows, tmp_path):
    docs = table(spark, odd_rows)
    ordered, n = token_output.training_order(docs, seq_len=64, per_shard=16)
    files = token_output.write_shards(ordered, f"file://{tmp_path}/out")
    listed = token_output.manifest(files, 64, 16).collect()
    assert sorted(r.slot for r in listed) == list(range(n))
    shards = {r.shard: bytes(r.content) for r in files.collect()}
    slots = {r.slot: token_output.read_slots(shards[r.shard], r.byte_offset // 129, 1, 64)[0] for r in listed}
    order = token_output.permute(np.arange(n), n)
    encoder = token_output.Encoder(open(token_output.VOCABULARY, "rb").read())
    stream = np.concatenate([slots[s] for s in order.tolist()]).tolist()
    texts, now = [], []
    for x in stream:
        if x == encoder.end:
            texts.append(encoder.inner.decode(now))
            now = []
        else:
            now.append(x)
    found, want = sorted(t for t in texts if t), sorted(t for _, t, *_ in odd_rows if t)
    assert found == want
    empty, none = token_output.training_order(docs.limit(0))
    assert none == 0 and empty.count() == 0


# 5


def brute_groups(rows):
    def fp(t):
        ws = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        sh = [b" ".join(ws[k : k + 3]) for k in range(max(1, len(ws) - 2))] if ws else []
        hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0

    fps = [fp(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 3:
                root[find(a)] = find(b)
    least = {}
    for k, r in enumerate(rows):
        if r[0] is not None:
            least[find(k)] = min(least.get(find(k), r[0]), r[0])
    return sorted([(r[0], fps[k], least.get(find(k))) for k, r in enumerate(rows)], key=repr)


@pytest.mark.parametrize("most", [4096, 2])
def test_simhash(spark, odd_rows, most, monkeypatch):
    monkeypatch.setattr(simhash, "LIST_MOST", most)
    rng = random.Random(11)
    base = words(rng, 150)
    near = [(500 + k, " ".join(w if rng.random() > 0.004 else "zz" for w in base.split()), "en", "a") for k in range(25)]
    rows = [r for r in odd_rows if r[0] != 104] + near + [(600, "One", "en", "a"), (601, "one", "en", "a"), (602, "a b", "en", "a")]
    got = simhash.simhash_groups(table(spark, rows)).collect()
    assert sorted([(r.doc_id, r.fp % (1 << 64), r.component_id) for r in got], key=repr) == brute_groups(rows)


def test_keep_one_of_repeated_rows_and_null_ids(spark):
    rng = random.Random(43)
    a, b, c, d, e = (words(rng, 60) for _ in range(5))
    rows = [(1, a)] * 3 + [(9, a), (None, b), (None, b), (None, b), (None, c), (7, c), (1, d), (2, d), (4, e), (4, e + "  "), (5, "One"), (5, "other")]
    for n in (1, 4):
        docs = table(spark, [(i, t, "en", "s") for i, t in rows]).repartition(n)
        got = simhash.keep_one(docs)
        assert got.columns == docs.columns
        assert sorted([(r.doc_id, r.text.strip()) for r in got.collect()], key=repr) == sorted([(1, a), (None, b), (7, c), (1, d), (4, e), (5, "One"), (5, "other")], key=repr)


def test_simhash_blocks_and_links():
    assert len(simhash.BLOCKS) == 14
    for a in range(8):
        for b in range(a):
            for c in range(b):
                assert any(not {a, b, c} & set(block) for block in simhash.BLOCKS)
    values = np.array([0, 7, 0x3F, 0xFFFF], np.uint64)
    assert {x for link in simhash.spanning_links(values) for x in link} == {0, 7, 0x3F}
    rng = np.random.default_rng(2)
    many = np.unique(rng.integers(0, 1 << 13, 3000).astype(np.uint64) << np.uint64(7))
    front, rest = many[:50], many[50:]
    flips = np.array([sum(x) for k in (1, 2, 3) for x in itertools.combinations([1 << b for b in range(7, 20)], k)], np.uint64)
    assert (simhash._near_flips(front, rest, flips) == simhash._near_pairs(front, rest)).all()


# 6


def test_language(spark):
    rng = random.Random(13)
    rows = [(k, words(rng, 60, "abcde" if k % 2 else "uvwxy"), "aa" if k % 2 else "uu", "s") for k in range(90)]
    rows += [(200, None, "aa", "s"), (201, "123 !?", "uu", "s"), (202, words(rng, 40, "abcde"), None, "s"), (None, words(rng, 40, "uvwxy"), "aa", "s"), (203, "a", "aa", "s"), (204, "½ ② Ⅷ", "uu", "s")]
    docs = table(spark, rows).withColumn("fit_id", F.lit(1))
    got = {r.doc_id: r for r in language_id.predict(docs, language_id.train(docs)).collect()}
    assert all(got[i].lang_pred == lang for i, t, lang, _ in rows[:90])
    assert got[200].lang_pred == got[201].lang_pred == got[204].lang_pred == "und" and got[202].lang_pred == "aa" and got[None].lang_pred == "uu"
    assert all(0 <= r.score <= 1 for r in got.values())
    mixed = table(spark, [(1, words(rng, 80, "abcde") + " " + words(rng, 80, "uvwxy"), None, None)])
    assert sorted(language_id.predict(mixed, language_id.train(docs)).first().languages) == ["aa", "uu"]
    assert language_id.predict(docs, language_id.train(docs.limit(0))).first().lang_pred == "und"


# 7


def test_toxicity(spark):
    rng = random.Random(17)
    rows = [(k, words(rng, 60) + (" badword " if k % 5 == 0 else " ") + words(rng, 5), "en", "s") for k in range(400)]
    docs = table(spark, rows + [(None, "badword", "en", "s"), (900, None, "en", "s"), (901, "", "en", "s")])
    labels = spark.createDataFrame([(k, 1, int(k % 5 == 0)) for k in range(400)] + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    machine = toxicity.train(docs, labels)
    got = {r.doc_id: r.score for r in toxicity.score(docs, machine).collect()}
    assert all((got[k] >= 0.7) == (k % 5 == 0) for k in range(400)) and got[None] >= 0.7 and got[900] == got[901] < 0.7
    assert toxicity.drop_toxic(docs, labels).columns == docs.columns
    none = toxicity.train(docs, labels.limit(0))
    assert all(r.score == 0.5 for r in toxicity.score(docs, none).collect())


def test_rejected_rows_go_by_row(spark):
    rng = random.Random(47)
    rows = [(k, words(rng, 60) + (" badword " if k % 5 == 0 else " ") + words(rng, 5), "en", "s") for k in range(400)]
    odd = [(None, "badword", "en", "s"), (None, "kept", "en", "s"), (0, "kept", "fr", "s"), (1, "badword", "fr", "s")]
    docs = table(spark, rows + odd)
    labels = spark.createDataFrame([(k, 1, int(k % 5 == 0)) for k in range(2, 400)], "doc_id long, quality int, toxic int")
    want = sorted([(i, t) for i, t, *_ in rows + odd if "badword" not in t], key=repr)
    assert sorted([(r.doc_id, r.text) for r in toxicity.drop_toxic(docs, labels).collect()], key=repr) == want
    benchmark = spark.createDataFrame([(1, "badword")], "item_id long, text string")
    few = table(spark, odd)
    assert sorted([(r.doc_id, r.text) for r in decontaminate.clean(few, benchmark).collect()], key=repr) == [(0, "kept"), (None, "kept")]


def test_factors_learn_pairs():
    rng = np.random.default_rng(0)
    sets, y = [], []
    for _ in range(1200):
        a, b = rng.random(2) < 0.5
        sets.append(np.array(sorted({1} if a else set()) + ([2] if b else []) + [3], np.int64))
        y.append(float(a and b))
    machine = toxicity.fit(sets, np.array(y))
    both, one = machine.logits([np.array([1, 2, 3]), np.array([1, 3])])
    assert both > 0 > one


@pytest.mark.parametrize("others", [0, 20])
def test_factors_learn_pairs_that_say_nothing_alone(others):
    rng = np.random.default_rng(1)
    sets, y = [], []
    for _ in range(2000):
        a, b = rng.random(2) < 0.5
        more = (10 + rng.choice(300, others, replace=False)).tolist()
        sets.append(np.array(sorted(([1] if a else []) + ([2] if b else []) + [3, *more]), np.int64))
        y.append(float(a != b))
    machine = toxicity.fit(sets[:1200], np.array(y[:1200]))
    right = (machine.logits([s[machine.number[s] > 0] for s in sets[1200:]]) > 0) == np.array(y[1200:])
    assert right.mean() > 0.95


# 8


def test_mixing(spark, odd_rows):
    rng = random.Random(19)
    rows = odd_rows + [(1000 + k, words(rng, rng.randint(1, 60)), "en", rng.choice(["a", "a", "a", "b", "c", "d"])) for k in range(600)]
    docs = table(spark, rows)
    got = mixing.pareto_mix(docs).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixing.pareto_mix(docs.repartition(7)).collect()), key=repr)
    tied = table(spark, [(None, words(rng, rng.randint(3000, 3040)), "en", "ab"[k % 2]) for k in range(40)])
    assert [sorted(r.taken for r in mixing.pareto_mix(tied.repartition(n)).collect()) for n in (2, 5)] == [sorted(r.taken for r in mixing.pareto_mix(tied).collect())] * 2
    assert len(got) == len(rows) and all(0 <= r.taken <= 3 * r.size for r in got)
    total = sum(r.size for r in got)
    by = {}
    for r in got:
        t = by.setdefault((r.source_size, r.target), [0, 0])
        t[0] += r.taken
        t[1] = max(t[1], r.size)
    assert sum(t for _, t in by) == pytest.approx(total)
    assert all(abs(taken - target) <= largest for (_, target), (taken, largest) in by.items())
    named = docs.withColumn("copy_no", F.lit(1))
    assert mixing.mix_rows(named).columns == named.columns
    assert mixing.pareto_mix(docs.limit(0)).count() == 0


def test_mixed_rows_have_their_own_copies(spark):
    rng = random.Random(53)
    rows = [(rng.choice([None, k, 3]), f"t{k} " + words(rng, rng.randint(1, 60)), "en", rng.choice(["a", "a", "a", "b", "c"])) for k in range(300)]
    docs = table(spark, rows)
    want, got = {}, {}
    for r in mixing.pareto_mix(docs).collect():
        want[r.target] = want.get(r.target, 0) + r.taken
    for r in mixing.mix_rows(docs).collect():
        got[r.source] = got.get(r.source, 0) + len(r.text.split())
    assert sorted(got.values()) == sorted(x for x in want.values() if x)
    assert all(abs(taken - target) <= 62 for target, taken in want.items())


# 9


def test_urls(spark):
    cases = {
        "https://WWW.example.com/en/x?q#f": ("www.example.com", "/en/x", "www.example.com/en/", "allow"),
        "http://a.example.com/en/": ("a.example.com", "/en/", "example.com/en/", "block"),
        "http://example.com": ("example.com", "", None, None),
        "http://x.net/fr/1": ("x.net", "/fr/1", "net/fr/", "block"),
        "http://xnet/fr/1": ("xnet", "/fr/1", None, None),
        "no scheme": ("", "", None, "allow"),
        "http://b.com/?x": ("b.com", "/", "com/", "allow"),
    }
    rng = random.Random(23)
    urls = [f"http://{words(rng, 1)}.good.com/p{k}" for k in range(60)] + [f"http://spam{k}.net/fr/{k}" for k in range(60)]
    rows = [(k, u, "x") for k, u in enumerate([*cases, None, *urls])]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string")
    judge = url_filter.train(pages)
    got = {r.page_id: r for r in url_filter.filter_urls(pages, judge).collect()}
    for k, (url, (host, path, rule, verdict)) in enumerate(cases.items()):
        assert (got[k].host, got[k].path, got[k].rule) == (host, path, rule)
        assert got[k].verdict == verdict or verdict is None
    assert got[len(cases)].verdict == "allow"
    bad, good = judge.ratios(["spam7.org/fr/7", "abc.good.org/p5"])
    assert bad > good and judge.blocks(["spam7.org/fr/7"])[0]
    assert not url_filter.fit([], ["x"]).blocks(["x"])[0]


# 10


def test_ann(spark):
    rng = np.random.default_rng(29)
    x = rng.normal(size=(900, 16)).astype(np.float32)
    x[100:140] = x[100]
    rows = [(k, x[k].tolist(), 0) for k in range(900)]
    rows += [(2000, None, 0), (2020, [0.0] * 16, 0), (2040, [float("nan")] * 16, 0), (2060, [1.0] * 3, 0), (None, [1.0] * 16, 0), (2080, [None] * 16, 0)]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")).collect()
    hit = 0
    for q in range(0, 900, 20):
        s = x.astype(float) @ x[q].astype(float)
        s[q] = -np.inf
        want = np.lexsort((np.arange(900), -s))[:20]
        own = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in own] == list(range(1, 21))
        assert np.allclose([r.score for r in own], s[[r.vec_id for r in own]], atol=1e-9)
        hit += len(set(want.tolist()) & {r.vec_id for r in own})
    assert {r.query_id for r in got} == set(range(0, 900, 20)) and hit >= 0.9 * 45 * 20
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0])], "vec_id long, embedding array<double>")
    assert [(r.rank, r.vec_id) for r in ann.search(few).orderBy("rank").collect()] == [(1, 1), (2, 2)]
    assert ann.search(few.limit(0)).count() == 0


def test_ann_takes_every_row(spark):
    schema = "vec_id long, embedding array<double>"
    large = [(k, [1e60 * (k + 1), -1e60 * ((7 * k) % 41), 3e59]) for k in range(41)]
    found = ann.search(spark.createDataFrame(large, schema)).collect()
    for q in (0, 20, 40):
        x = np.array([v for _, v in large])
        s = (x * x[q]).sum(axis=1)
        s[q] = -np.inf
        own = sorted((r for r in found if r.query_id == q), key=lambda r: r.rank)
        assert [r.vec_id for r in own] == np.lexsort((np.arange(41), -s))[:20].tolist() and [r.score for r in own] == s[[r.vec_id for r in own]].tolist()
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (0, [1.0, 0.0]), (3, [1.0, 1.0]), (20, [1.0, 2.0, 3.0]), (5, [1.0, 0.0, 0.0])]
    found = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in ann.search(spark.createDataFrame(rows, schema)).collect())
    assert found == sorted([*[(0, 1, 0, 1.0), (0, 2, 3, 1.0), (0, 3, 0, 0.0)] * 2, (0, 1, 3, 1.0), (0, 2, 0, 0.0), (0, 3, 0, 0.0), (20, 1, 5, 1.0)])


# plain versions of the models


def test_periodic_text_travels_about_once():
    for period in (1, 2, 7, 60):
        data = np.frombuffer((bytes(range(65, 65 + period)) * 20_000)[:20_000], np.uint8)
        row, _, first, end, twice = suffix_dedup.anchors(data, np.array([0, len(data)]), np.zeros(0, np.uint64))
        assert (end - first + suffix_dedup.LENGTH - 1).sum() <= 1.2 * len(data) and twice.all()


def test_suffix_dedup_tells_no_id_from_the_least_id(spark):
    rng = random.Random(67)
    text = "".join(rng.choice("abcdef ") for _ in range(300))
    rows = [(None, text, "en", "a"), (-(1 << 63), text, "en", "a"), (None, text + "x", "en", "a"), (5, "q" * 260, "en", "a")]
    got = sorted([(r.doc_id, r.n_bytes, r.n_removed) for r in suffix_dedup.suffix_dedup(table(spark, rows)).collect()], key=repr)
    assert got == sorted([(None, 300, 0), (-(1 << 63), 300, 300), (None, 301, 0), (5, 260, 259)], key=repr)


def test_mixture_is_the_plain_expectation_maximisation():
    rng = random.Random(71)
    names = ["aa", "bb", "cc"]
    logs = np.log(np.random.default_rng(3).dirichlet(np.ones(1 << language_id.BITS) * 0.05 + 0.01, 3).T + 1e-9)
    model = language_id.Languages(names, logs)
    for size in (1, 5, 80, 400, 400):
        at, counts = language_id.gram_counts(np.frombuffer(words(rng, size).encode(), np.uint8))
        chosen, shares = model.mixture(at, counts)

        def fitted(members):
            share = [1 / len(members)] * len(members)
            for _ in range(3000):
                new = [0.0] * len(members)
                for b, c in zip(at.tolist(), counts.tolist()):
                    p = [s * np.exp(logs[b, k]) for s, k in zip(share, members)]
                    new = [n + c * x / sum(p) for n, x in zip(new, p)]
                new = [x / counts.sum() for x in new]
                if max(abs(x - y) for x, y in zip(new, share)) < 1e-7:
                    break
                share = new
            value = sum(c * np.log(sum(s * np.exp(logs[b, k]) for s, k in zip(share, members))) for b, c in zip(at.tolist(), counts.tolist()))
            return share, value

        share, value = fitted(chosen)
        assert abs(sum(shares) - 1) < 1e-6 and np.allclose(sorted(shares), sorted(share), atol=0.05)
        reached = counts @ np.log(np.exp(logs[np.ix_(at, chosen)]) @ shares)
        assert reached <= value + 1e-6 and reached > value - max(0.5, 0.002 * abs(value))
        line = language_id.PENALTY * 0.5 * np.log(max(counts.sum(), 2))
        single = max(fitted([k])[1] for k in range(3))
        assert len(chosen) == 1 or reached - single > line * (len(chosen) - 1) - 0.5


def test_markov_is_the_plain_witten_bell():
    rng = random.Random(73)
    urls = [f"{words(rng, 1)}.site.org/{words(rng, 2).replace(' ', '/')}" for _ in range(40)]
    model = url_filter.Markov.fit(urls)
    counts = {}
    for u in urls:
        body = b"\x02" * url_filter.ORDER + u.encode() + b"\x03"
        for k in range(url_filter.ORDER, len(body)):
            for n in range(url_filter.ORDER + 1):
                counts.setdefault(body[k - n : k], {}).setdefault(body[k], 0)
                counts[body[k - n : k]][body[k]] += 1

    def plain(context, c):
        p = 1 / 256
        for n in range(url_filter.ORDER + 1):
            seen = counts.get(context[len(context) - n :], {})
            if seen:
                p = (seen.get(c, 0) + len(seen) * p) / (sum(seen.values()) + len(seen))
        return p

    for u in [*urls[:5], "new.site.org/zz", "é/x"]:
        data, place, _ = url_filter._flat([u])
        body = b"\x02" * url_filter.ORDER + u.encode() + b"\x03"
        want = [np.log(plain(body[k - url_filter.ORDER : k], body[k])) for k in range(url_filter.ORDER, len(body))]
        assert np.allclose(model.logs(data, place), want)


def test_odd_rows_of_language_and_urls(spark, odd_rows):
    docs = table(spark, odd_rows)
    found = language_id.predict(docs, language_id.train(docs)).collect()
    assert len(found) == len(odd_rows)
    of = {}
    for r in found:
        of.setdefault(r.doc_id, set()).add(r.lang_pred)
    assert len(of[5]) == 1 and of[5] == of[103] and of[101] == of[102] == {"und"}
    pages = spark.createDataFrame([(k, u, "x") for k, u in enumerate([None, "", "://", "http://a.com/", "http://a.com/", "http://" + "x" * 100_000 + ".net/fr/"])], "page_id long, url string, rule string")
    judged = {r.page_id: r for r in url_filter.filter_urls(pages, url_filter.train(pages)).collect()}
    assert judged[3].verdict == judged[4].verdict == "allow" and judged[5].rule == "net/fr/" and judged[0].host == judged[2].host == ""
    assert url_filter.filter_urls(pages.limit(0), url_filter.train(pages.limit(0))).count() == 0
    assert language_id.predict(docs.limit(0), language_id.train(docs)).count() == 0
