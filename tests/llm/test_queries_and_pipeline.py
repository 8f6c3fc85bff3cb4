"""The registered queries by their columns, and the stages of the pipeline, against plain versions."""

import hashlib
import random
import re
import zlib
from pathlib import Path

import duckdb
import pytest
import xxhash

import corpus_pipeline
from saltmarsh.llm import token_output
from saltmarsh.llm.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row_no long"


def words(rng, n, letters="abcdefgh"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """A folder of tables: null and repeated ids, repeated rows, empty and null texts, a clashing column."""
    rng = random.Random(61)
    item = words(rng, 20, "mnopq")
    rows = [(k, words(rng, 50) + (" badword" if k % 6 == 0 else ""), "en", rng.choice(["a", "a", "b", None]), 1, k) for k in range(240)]
    rows += [(None, rows[k][1], "en", "a", 1, 0) for k in (1, 2, 6)] + [rows[1], rows[1], (3, rows[4][1] + " x", "fr", "b", 1, 0)]
    rows += [(300 + k, words(rng, 20) + " " + item + " " + words(rng, 20), "en", "b", 1, 0) for k in range(4)] + [(None, item, "en", None, 1, 0)]
    rows += [(400, None, "en", "a", None, 0), (401, "", "en", "a", 0, 0), (402, " \t", None, None, 2, 0), (None, None, None, None, None, None), (403, words(rng, 30_000), "en", "b", 1, 0)]
    folder = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"file://{folder}/documents.parquet")
    spark.createDataFrame([(1, item), (None, words(rng, 15)), (2, None)], "item_id long, text string").write.parquet(f"file://{folder}/benchmark.parquet")
    spark.createDataFrame([(k, 1, int(k % 6 == 0)) for k in range(240)] + [(None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"file://{folder}/labels.parquet")
    return f"file://{folder}", rows


def fingerprint(text):
    ws = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    hs = [xxhash.xxh64_intdigest(b" ".join(ws[k : k + 3]), 42) for k in range(max(1, len(ws) - 2))] if ws else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_stages(spark, small):
    """Each stage on what the one before kept, by rows; the classifier's own scores stand for its model."""
    folder, rows = small
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    key = lambda r: repr(tuple(r))
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_duplicates", "decontamination", "mixing", "token_output"]
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        if name != "token_output":
            assert docs.columns == SCHEMA.replace(" long", "").replace(" string", "").split(", ")
        kept[name] = sorted(map(tuple, docs.collect()), key=key)
        docs = spark.createDataFrame(kept[name], docs.schema) if name != "token_output" else docs
    assert kept["toxicity"] == sorted([r for r in rows if "badword" not in (r[1] or "")], key=key)

    left = kept["toxicity"]
    prints = [fingerprint(r[1]) for r in left]
    root = list(range(len(left)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(left)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                root[find(a)] = find(b)
    groups = {}
    for k, r in enumerate(left):
        groups.setdefault(find(k), []).append(r)
    stays = kept["near_duplicates"]
    assert len(stays) == len(groups)
    for group in groups.values():
        ids = [r[0] for r in group if r[0] is not None]
        one = [r for r in stays if r in group]
        assert len(one) == 1 and one[0][0] == (min(ids) if ids else None)

    item = next(r[1] for r in rows if r[0] == 300).split()[20:40]
    windows = {tuple(item[k : k + 13]) for k in range(8)}

    def contaminated(text):
        ws = re.findall("[0-9a-z]+", (text or "").lower())
        hit = [False] * len(ws)
        for k in range(len(ws) - 12):
            if tuple(ws[k : k + 13]) in windows:
                hit[k : k + 13] = [True] * 13
        return any(hit) and 20 * sum(hit) >= len(ws)

    assert kept["decontamination"] == [r for r in stays if not contaminated(r[1])]

    mixed = kept["mixing"]
    base = kept["decontamination"]
    assert set(mixed) <= set(base) and max(mixed.count(r) for r in set(mixed)) <= 3
    size = lambda rs: sum(len((r[1] or "").split()) for r in rs)
    sources = sorted({r[3] for r in base}, key=lambda s: (s is None, s or ""))
    have = {s: size([r for r in base if r[3] == s]) for s in sources}
    total, want = sum(have.values()), {}
    weight = dict(zip(sources, (5, 2, 1)))
    while any(s not in want for s in sources):
        left_over, open_ = total - sum(want.values()), [s for s in sources if s not in want]
        share = {s: left_over * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 3 * have[s]]
        want |= {s: 3.0 * have[s] for s in over} if over else share
    for s in sources:
        longest = max(len((r[1] or "").split()) for r in base if r[3] == s)
        assert abs(size([r for r in mixed if r[3] == s]) - want[s]) <= longest

    encoder = token_output.Encoder(open(token_output.VOCABULARY, "rb").read())
    n_ids = sum(len(encoder.inner.encode_ordinary(r[1])) + 1 for r in mixed if r[1] is not None)
    assert [r[0] for r in sorted(kept["token_output"])] == list(range(-(-n_ids // token_output.SEQ_LEN)))


def test_stages_of_empty_tables(spark, small, tmp_path):
    folder, _ = small
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"file://{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0


def test_digests_of_the_queries(spark, small):
    folder, rows = small
    found = QUERIES["op5_simhash"](spark, folder).collect()
    assert sorted(r.fingerprint for r in found) == sorted(f"{fingerprint(r[1]):016x}" for r in rows)
    kept = {r.doc_id: r for r in QUERIES["op1_suffix_dedup"](spark, folder).collect()}
    text = next(r[1] for r in rows if r[0] == 403)
    assert kept[403].kept_sha256 == hashlib.sha256(text.encode()).hexdigest() and kept[403].n_removed == 0
    assert kept[400].kept_sha256 == hashlib.sha256(b"").hexdigest() and kept[400].n_bytes == 0
    scored = QUERIES["op7_toxicity"](spark, folder).collect()
    assert len(scored) == len(rows) and all(r.predicted == int(r.score >= 0.7) for r in scored)
    assert all(r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 3 == 1) for r in scored)


@pytest.mark.skipif(not Path(DATA).exists(), reason="no tables here")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    for file in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    got = QUERIES[name](spark, DATA)
    found = con.execute(ORACLES[name])
    columns = [d[0] for d in found.description]
    rounded = lambda rs: sorted([tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rs], key=repr)
    assert rounded(map(tuple, got.select(*columns).collect())) == rounded(found.fetchall())
