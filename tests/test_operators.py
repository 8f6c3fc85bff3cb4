"""Behaviour of the corpus, preference, governance, source and stream operators on small tables."""

import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from saltmarsh.operators import corpus as C
from saltmarsh.operators import governance as G
from saltmarsh.operators import preference as P
from saltmarsh.operators import reports as RP
from saltmarsh.operators import vectors as V
from saltmarsh.sources import readers as R
from saltmarsh.streaming import sessions as S


def test_condition_last_user(spark):
    turns = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 2, "user", "c"), (2, 0, "assistant", "d")], "c long, t long, role string, text string")
    out = {(r.c, r.t): r.text for r in C.condition_last_user(turns, "c", "t", F.lit("!")).collect()}
    assert out == {(1, 0): "a", (1, 1): "b", (1, 2): "!c", (2, 0): "d"}


def test_quota_and_pairs(spark):
    counts = spark.createDataFrame([("a", 30), ("b", 10)], "theme string, n long")
    assert {r.theme: r.quota for r in C.theme_quotas(counts, "theme", "n", 400).collect()} == {"a": 300, "b": 100}
    drafts = spark.createDataFrame([("x", 0, "a" * 10), ("x", 1, "a" * 14), ("x", 2, "a" * 200)], "id string, d long, text string")
    assert [(r.left_draft, r.right_draft) for r in C.drawn_pairs(drafts, "id", "d", "text", 9, 10).collect()] == [(0, 1)]
    assert C.drawn_pairs(drafts, "id", "d", "text", 9).count() == 3


def test_window_shuffle_is_a_permutation(spark):
    rows = spark.range(50).select((F.col("id") / 10).cast("int").alias("g"), "id")
    out = C.window_shuffle(rows, "g", "id", buffer_groups=2).collect()
    assert sorted(r.position for r in out) == list(range(50))
    for w in {r.shuffle_window for r in out}:
        assert len({r.g for r in out if r.shuffle_window == w}) <= 2
    assert [r.position for r in sorted(out, key=lambda r: r.id)] != [r.position for r in sorted(C.window_shuffle(rows, "g", "id", epoch=1).collect(), key=lambda r: r.id)]


def test_greedy_and_relational_near_duplicates_differ(spark):
    items = [(0, "abcdefghij"), (1, "abcdefghik"), (2, "zbcdefghik")]
    pairs = C.near_duplicate_pairs(spark.createDataFrame(items, "k long, t string"), "k", "t", 0.7, 2.0).collect()
    assert {(r.a, r.b) for r in pairs} == {(0, 1), (1, 2)}
    assert C.greedy_kept([(str(k), t) for k, t in items], 0.7, 2.0) == ["0", "2"]


def _judged(spark, rows):
    return spark.createDataFrame(rows, "winner string, second_side string")


def test_tally(spark):
    always_left = [("left", "left")] * 5 + [("left", "right")] * 5
    r = P.tally(_judged(spark, always_left)).first()
    assert (r.side_bias, r.residual_bias, r.seat_balanced_share) == (0.5, 0.0, 0.5)
    r = P.tally(_judged(spark, [("left", "left")] * 75 + [("left", "right")] * 25)).first()
    assert r.residual_bias == 0.25
    r = P.tally(_judged(spark, [("left", "left")] * 6 + [("right", "left")] * 4)).first()
    assert r.second_share == 0.6 and r.verdict == "not won" and r.side_bias is None
    assert P.tally(_judged(spark, [("tie", "left")])).first().verdict == "all ties"


def test_swap_compares_texts(spark):
    first = spark.createDataFrame([("k", "x", "y", "near", 3, "left", "left")], "key string, left string, right string, bin string, gap long, longer_side string, winner string")
    again = P.swapped(first)
    assert again.first().longer_side == "right" and again.first().key == "k~swap"
    same = P.flip_rates(P.matched_rounds(first, again.withColumn("winner", F.lit("right")))).first()
    assert (same.decided_twice, same.flips) == (1, 0)
    assert P.flip_rates(P.matched_rounds(first, again.withColumn("winner", F.lit("left")))).first().flips == 1


def test_refusals(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), (None, 3)], "k string, v long")
    with pytest.raises(PySparkException, match="missing or repeats"):
        G.unique_keys(rows, "k").collect()
    with pytest.raises(PySparkException, match="more than one judge"):
        G.one_value(rows, "v", "judge").collect()
    assert G.one_value(rows.limit(1), "v", "judge").count() == 1


def test_scrub(spark):
    doc = json.dumps({"a": "/home/me/x.wav", "note": "/home/me/kept", "b": ["/Users/u/y", "see /home/me/z"]})
    out = json.loads(spark.createDataFrame([(doc,)], "d string").select(G.scrubbed(F.col("d"), ("note",))).first()[0])
    assert out == {"a": "x.wav", "note": "/home/me/kept", "b": ["y", "see /home/me/z"]}
    ratio = spark.createDataFrame([("a" * 30, "a" * 30), ("abc", None)], "a string, b string").select(G.verbatim(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in ratio] == [True, None]


def test_row_groups(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    pq.write_table(pa.table({"x": list(range(250))}), tmp_path / "t.parquet", row_group_size=37)
    groups = R.row_groups(spark, f"file://{tmp_path}")
    assert tuple(R.described(groups).first()) == (250, 7, 37)
    asked = spark.createDataFrame([(0,), (36,), (37,), (-1,)], "i long")
    assert {r.i: (r.row_group, r.within) for r in R.located(groups, asked, "i").collect()} == {0: (0, 0), 36: (0, 36), 37: (1, 0), -1: (6, 27)}
    with pytest.raises(PySparkException, match="out of range"):
        R.located(groups, spark.createDataFrame([(250,)], "i long"), "i").collect()
    with pytest.raises(PySparkException, match="too large"):
        R.checked_groups(groups, 1).collect()
    again = f"file://{tmp_path}/out"
    assert R.repartitioned(spark, f"file://{tmp_path}/t.parquet", again, 100).count() == 250
    assert sorted(r.num_rows for r in R.row_groups(spark, again).collect()) == [50, 100, 100]
    assert R.one_row_copy(spark, f"file://{tmp_path}/t.parquet", f"file://{tmp_path}/one").collect() == [(0,)]
    # Groups of very different sizes, empty ones among them.
    wide = spark.createDataFrame([("f", 0, 1000, 0), ("f", 1, 0, 1000), ("f", 2, 1, 1000), ("f", 3, 2, 1001)], "file string, row_group int, num_rows long, offset long")
    found = R.located(wide, spark.range(1003).withColumnRenamed("id", "i"), "i").collect()
    assert sorted((r.i, r.row_group, r.within) for r in found) == [(i, 0, i) for i in range(1000)] + [(1000, 2, 0), (1001, 3, 0), (1002, 3, 1)]


def test_readers(spark, tmp_path):
    (tmp_path / "rows.jsonl").write_text('{"id": "a", "extra": 1}\n\n{"id": "b"}\n')
    assert [r.id for r in R.read_jsonl(spark, f"file://{tmp_path}/rows.jsonl", "id string", ("id",)).collect()] == ["a", "b"]
    (tmp_path / "train.log").write_text("===== proj 2026 =====\nEpoch:[1/6](50/31224), loss: 9.084, text: 2.19, audio: 6.89, lr: 0.0005\nnoise\n===== full x =====\nEpoch:[1/6](100/31224), loss: 8.0, text: 2.0, audio: 6.0, lr: 2e-5\n")
    rows = R.read_training_log(spark, f"file://{tmp_path}/train.log").collect()
    assert [(r.run, r.epoch, r.step, r.loss, r.lr) for r in rows] == [("proj", 1, 50, 9.084, 0.0005), ("full", 1, 100, 8.0, 2e-5)]


def test_clusters(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [1.0, 0.05]), (4, [0.0, 1.0]), (5, [0.0, 0.0]), (6, None)], "id long, v array<double>")
    edges = V.similar_pairs(vectors, "id", "v", 0.9)
    assert {(r.a, r.b) for r in edges.collect()} == {(1, 2), (1, 3), (2, 3)}
    assert {r.member for r in V.speaker_clusters(edges, vectors, "id", 3).collect()} == {1, 2, 3}


def test_endpoint_needs_speech_first():
    state, out = {}, []
    for seq, energy in enumerate([0.001] * 30 + [0.1] * 10 + [0.001] * 20):
        state, found = S.endpoint_step(state, {"seq": seq, "energy": energy})
        out += found
    assert out == [{"kind": "endpoint", "value": "54"}]


def test_stream_equals_replay(spark, tmp_path):
    rows = spark.createDataFrame([(str(s), k, "x" * (50 * (k + s) % 170)) for s in range(3) for k in range(9)], "session string, seq long, text string")
    step = lambda state, event: S.context_step(state, event, 120)
    for lo in range(0, 9, 3):
        rows.where(f"seq >= {lo} AND seq < {lo + 3}").coalesce(1).write.parquet(f"{tmp_path}/in/{lo}")
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    query = S.stream(source, step).writeStream.format("memory").queryName("dropped").trigger(availableNow=True).start()
    query.awaitTermination()
    key = lambda r: (r.session, r.seq, r.value)
    assert sorted(map(key, spark.table("dropped").collect())) == sorted(map(key, S.replay(rows, step).collect()))


def test_reports(spark):
    from saltmarsh.operators import reports as N

    docs = spark.createDataFrame([([("a", "/x/y.wav"), ("b", None)],)], "samples array<struct<id:string,audio_path:string>>")
    assert [s.audio_path for s in N.repointed(docs, "/out/", "abc").first().samples] == ["/out/y.wav", None]
    rows = spark.createDataFrame([("a", False), ("b", False)], "id string, transcribed boolean")
    with pytest.raises(PySparkException, match="nothing was transcribed"):
        N.transcribed(rows).collect()
    assert N.transcribed(rows.limit(0)).count() == 0
    voices = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0], [1.0, 0.0]), ([0.0, 1.0], [1.0, 0.0], [1.0, 0.0])], "v array<double>, c array<double>, r array<double>")
    assert [r.weak for r in N.identity(voices, "v", "c", "r").collect()] == [False, True]
    tensors = spark.createDataFrame([("embed.weight", [9, 512])], "name string, shape array<int>")
    assert N.shape_name(tensors, "name", "shape", "^embed", {512: "small"}).first().model == "small"
    with pytest.raises(PySparkException, match="no known shape"):
        N.shape_name(tensors, "name", "shape", "^embed", {768: "base"}).collect()
    judged = spark.createDataFrame([("j", "m")], "judge string, model string")
    with pytest.raises(PySparkException, match="lineage"):
        N.independent_judge(judged, "judge", "model", {"j": "x", "m": "x"}).collect()
    assert spark.range(1).select(N.judge_provenance("m", "e", "t").alias("p")).first().p.model == "m"


def test_workbooks_and_waves(spark, tmp_path):
    import wave
    import zipfile

    from saltmarsh.sources import readers

    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    shared = f"<sst {main}><si><t>file</t></si><si><r><t>sc</t></r><r><t>ore</t></r></si></sst>"
    sheet = f'<worksheet {main}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row r="2"><c r="A2" t="inlineStr"><is><t>001</t></is></c><c r="B2"><v>4</v></c><c r="C2"/></row></sheetData></worksheet>'
    for name in ("rater 2.xlsx", "rater 3.xlsx"):
        (tmp_path / "round").mkdir(exist_ok=True)
        with zipfile.ZipFile(tmp_path / "round" / name, "w") as book:
            book.writestr("xl/sharedStrings.xml", shared)
            book.writestr("xl/worksheets/sheet1.xml", sheet)
    (tmp_path / "round" / "rater 3.csv").write_text("file,score\n001,5\n")
    got = sorted(map(tuple, readers.read_workbooks(spark, str(tmp_path)).select("rater", "line", "cells").collect()))
    assert got == [(2, 1, {"A": "file", "B": "score"}), (2, 2, {"A": "001", "B": "4", "C": None})]
    with wave.open(str(tmp_path / "a.wav"), "wb") as sound:
        sound.setnchannels(1), sound.setsampwidth(2), sound.setframerate(8000)
        sound.writeframes(b"\x00\x00\xff\x7f\x00\x80")
    found = readers.read_waves(spark, str(tmp_path)).collect()
    assert [(r.rate, r.channels, r.samples) for r in found] == [(8000, 1, [0.0, 32767 / 32768, -1.0])]


def test_names_of_voices_are_text(spark):
    from saltmarsh.operators import vectors

    voices = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [1.0, 0.0]), ("c", [0.0, 1.0])], "voice string, v array<double>")
    clips = spark.createDataFrame([(1, "a", [1.0, 0.0]), (2, "b", [0.9, 0.1])], "clip long, own string, e array<double>")
    got = {r.clip: (r.nearest, r.hit) for r in vectors.identify(clips, voices, "clip", "own", "e").collect()}
    assert got == {1: ("a", True), 2: ("a", False)}


def test_voices_by_blocks_are_voices_at_once(spark, monkeypatch):
    import random

    rng = random.Random(1)
    rows = [(f"v{k}", [rng.uniform(-1, 1) for _ in range(4)]) for k in range(20)]
    voices = spark.createDataFrame([*rows, ("w", rows[0][1])], "voice string, v array<double>")
    clips = spark.createDataFrame([(k, f"v{k % 20}", [rng.uniform(-1, 1) for _ in range(4)]) for k in range(30)], "c long, own string, e array<double>")
    whole = sorted(V.identify(clips, voices, "c", "own", "e").collect())
    monkeypatch.setattr(V, "FEW_VOICES", 6)
    assert sorted(V.identify(clips, voices, "c", "own", "e").collect()) == whole


def test_clone_report(spark):
    kind = "id string, similarity double, hit boolean"
    before = spark.createDataFrame([("a/1", 0.5, False), ("a/2", 0.5, True), ("b/1", 0.6, True), ("c/9", 0.1, True)], kind)
    after = spark.createDataFrame([("a/1", 0.7, True), ("a/2", 0.7, True), ("b/1", 0.8, True), ("d/1", 0.9, True)], kind)
    out = sorted(RP.clone_report(after, before).collect())
    assert [(r.voice, r.clips, round(r.similarity, 9), r.hits) for r in out] == [("a", 2, 0.2, 1), ("b", 1, 0.2, 0)]
    # Every voice gains alike: no spread, so the gain is one. Hits gain in one voice of two.
    assert {(r.similarity_verdict, r.hit_verdict) for r in out} == {("improved", "indistinguishable, report only")}


def test_valid_pairs(spark):
    kind = "id string, text string, x double"
    a = spark.createDataFrame([("1", "t", 1.0), ("2", "u", 2.0), (None, "v", 3.0)], kind)
    b = spark.createDataFrame([("1", "t", 1.5), ("2", "u", 2.5), ("", "v", 3.5)], kind)
    assert sorted(tuple(r) for r in RP.valid_pairs(a, b, "id", "text", ["x"]).collect()) == [("1", 1.0, 1.5), ("2", 2.0, 2.5)]
    other = b.withColumn("text", F.when(F.col("id") == "2", "changed").otherwise(F.col("text")))
    assert RP.valid_pairs(a, other, "id", "text", ["x"]).isEmpty()
    assert RP.valid_pairs(a, b.where("id = '1'"), "id", "text", ["x"]).isEmpty()


def test_babble(spark):
    import numpy as np

    from saltmarsh.functions.audio import samples
    from saltmarsh.operators.noise import babbled

    rng = np.random.default_rng(3)
    bodies = [(k, (rng.normal(0, 3000, n)).astype("<i2").tobytes()) for k, n in enumerate((800, 400, 1600, 10, 0))]
    clips = spark.createDataFrame([*[(k, bytearray(b)) for k, b in bodies], (9, None)], "k long, body binary")
    one, two = (sorted((r.k, r.body and bytes(r.body)) for r in babbled(clips, "k", "body", 10.0).collect()) for _ in range(2))
    assert one == two and [k for k, _ in one] == [0, 1, 2, 3, 4, 9]
    out = dict(one)
    assert out[9] is None and out[4] == b""
    for k, body in bodies[:3]:
        x, y = samples(body).astype(float), samples(out[k]).astype(float)
        noise = y - x
        assert len(x) == len(y)
        assert abs(10 * np.log10((x * x).mean() / (noise * noise).mean()) - 10) < 0.1
