"""Named values of the text, statistics and audio functions."""

import math
import struct

import pytest
from pyspark.sql import functions as F

from saltmarsh.functions import audio as A
from saltmarsh.functions import quantiles as Q
from saltmarsh.functions import stats as S
from saltmarsh.functions import text as T


def one(spark, expr, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return row.select(expr).first()[0]


@pytest.mark.parametrize("a, b, edits", [("kitten", "sitting", 3), ("", "abc", 3), ("今天天气", "今天天汽", 1)])
def test_edit_distance(spark, a, b, edits):
    assert one(spark, F.levenshtein(F.lit(a), F.lit(b))) == edits


def test_error_rate(spark):
    rate = T.error_rate(F.col("r"), F.col("h"))
    for h in ("今天天汽真好", "今天天气真", "今天天气真的好"):
        assert one(spark, rate, r="今天天气真好", h=h) == pytest.approx(1 / 6)
    assert one(spark, rate, r="", h="x") == float("inf")
    assert one(spark, rate, r="", h="") == 0


def test_normalised(spark):
    assert one(spark, T.normalised(F.col("t")), t="Ｈｅｌｌｏ，世界！") == "hello世界"


@pytest.mark.parametrize("text, expected", [("", 0.0), ("abcdefgh", 0.0), ("a" * 20, 1 - 1 / 13), ("abcdefghij", 0.0)])
def test_repetition(spark, text, expected):
    assert one(spark, T.repetition(F.col("t")), t=text) == pytest.approx(expected)


@pytest.mark.parametrize("a, b, alike", [("面怎么煮好吃", "怎么煮面好吃", True), ("怎么挑西瓜", "怎么挑螃蟹", False)])
def test_alike(spark, a, b, alike):
    bi = one(spark, T.jaccard(T.bigram_set(F.col("a")), T.bigram_set(F.col("b"))), a=a, b=b)
    ch = one(spark, T.jaccard(T.character_set(F.col("a")), T.character_set(F.col("b"))), a=a, b=b)
    assert (bi >= 0.6 or ch >= 0.9) == alike


@pytest.mark.parametrize("text, expected", [("你好。再见", "你好。"), ("短，句", None), ("a" * 15 + "," + "b" * 10, "a" * 15 + ","), ("a" * 5 + "," + "b" * 30, None), ("", None)])
def test_first_clause(spark, text, expected):
    from saltmarsh.streaming.sessions import first_utterance

    assert one(spark, T.first_clause(F.col("t")), t=text) == expected
    assert first_utterance(text) == expected


def test_clean_for_speech(spark):
    assert one(spark, T.clean_for_speech(F.col("t")), t="**好**（小声）走\n\n吧——。，") == "好，小声，走。吧"


def test_parsed_lines(spark):
    assert one(spark, T.parsed_lines(F.col("t")), t="以下是：\n1. 「怎么煮面好吃？」\n- 2、今天天气好吗\n好") == ["怎么煮面好吃", "今天天气好吗"]


def test_codes(spark):
    codes = F.array(*[F.lit(k) for k in range(19)])
    assert one(spark, T.codebook(codes, 1)) == [1, 9]
    assert one(spark, T.audio_frames(codes)) == 3
    assert [(c["start"], len(c["codes"])) for c in one(spark, T.chunked(codes, 8, 3))] == [(0, 8), (8, 11), (16, 6)]
    assert one(spark, T.codebook(F.array().cast("array<int>"), 1)) == []
    assert one(spark, T.reply_span(F.array(F.lit(1), F.lit(2), F.lit(3)), F.array(F.lit(1)))) == [2, 3]
    assert one(spark, T.reply_span(F.array(F.lit(1)), F.array(F.lit(1)))) is None


def test_quantiles(spark):
    x = F.array(*[F.lit(v) for v in (100, 200, 300, 400, 5000)])
    assert one(spark, Q.index_capped(x, 0.95)) == 5000 and one(spark, Q.index_capped(x, 0.5)) == 300
    y = F.array(*[F.lit(v) for v in range(40)])
    assert one(spark, Q.index_capped(y, 0.95)) == 38 and one(spark, Q.minus_one(y, 0.95)) == 37
    assert one(spark, Q.upper_median(y)) == 20 and one(spark, Q.upper_median(F.array().cast("array<int>"))) is None


def test_noise_floor(spark):
    assert S.noise_floor_values([1.0]) == float("inf")
    few, many = [k % 7 for k in range(20)], [k % 7 for k in range(400)]
    assert S.noise_floor_values(few) > S.noise_floor_values(many)
    groups = [[g * 1.0] * 20 for g in range(6)]
    assert S.cluster_noise_floor_values(groups) > S.noise_floor_values([v for g in groups for v in g])
    rows = spark.createDataFrame([(k, k % 2, float(k % 7)) for k in range(80)], "id long, g long, v double")
    assert {r["g"]: r["n"] for r in S.noise_floor(rows, "g", "v", "id").collect()} == {0: 40, 1: 40}


def test_verdicts(spark):
    assert one(spark, S.verdict(F.lit(0.3), F.lit(0.3))) == "indistinguishable"
    assert one(spark, S.verdict(F.lit(-0.4), F.lit(0.3))) == "improved"
    assert one(spark, S.verdict(F.lit(0.4), F.lit(0.3), True, 0.5)) == "regressed, report only"
    assert one(spark, S.preference_loss(F.lit(0.0))) == pytest.approx(math.log(2))
    assert one(spark, S.attenuated(F.lit(0.6), F.lit(1.0))) is None
    assert one(spark, S.half_precision_step(F.lit(1.0))) == 2.0**-10


def test_audio(spark):
    body = struct.pack("<6h", 0, 32767, 32767, -32768, 100, 0)
    assert A.clipping(body) == (0.5, 3)
    assert A.energy(b"") == 0.0 and A.trimmed(b"\0" * 2000) == b""
    assert len(A.resampled(body, 16000, 8000)) == 6
    assert max(abs(A.samples(A.peak_normalised(body)))) <= 0.95 * 32768
    assert A.scale_for_snr(1.0, 0.5, 20.0) == pytest.approx(0.2) and A.scale_for_snr(0.0, 1.0, 3) == 0
    assert len(A.wav_header(10, 16000)) == 44
    assert spark.createDataFrame([(body,), (None,)], "b binary").select(A.silent(F.col("b"))).collect()[0][0] is False


def test_spelled_numbers(spark):
    from saltmarsh.functions import text as T

    cases = {"二零二一": "2021", "二十三": "23", "十": "10", "一百零五": "105", "两万三千": "23000", "一亿零二十万": "100200000", "三点一四": "3.14", "百": "百", "九〇": "90", "一千万": "10000000", "十十": "十十"}
    assert {k: T.spelled_number(k) for k in cases} == {**cases}
    rows = spark.createDataFrame([("二零二一年九月二十三日",), (None,), ("一般",)], "t string")
    assert [r[0] for r in rows.select(T.numerals_folded("t")).collect()] == ["2021年9月23日", None, "1般"]


def test_array_floor_is_the_portable_floor(spark):
    from saltmarsh.functions import stats as S

    values = [(k, float((k * 37) % 101), k % 9) for k in range(120)]
    rows = spark.createDataFrame(values, "id long, v double, g long")
    one = S.portable_floor(rows, "v", ["id"]).first()["floor"]
    assert abs(one - S.noise_floor_values([v for _, v, _ in values], 200, 1)) < 1e-9
    groups = [[v for _, v, g in values if g == k] for k in range(9)]
    assert abs(S.portable_floor(rows, "v", ["g"], clustered=True).first()["floor"] - S.cluster_noise_floor_values(groups, 200, 1)) < 1e-9


def test_ranks_of_groups_are_those_of_sorted_lists(spark):
    from saltmarsh.functions import quantiles as Q

    values = {"a": [k * 37 % 1009 / 10 for k in range(3000)], "b": [5.0] * 700 + [1.0], "c": [2.0], None: [3.0, 1.0], "d": []}
    rows = [(g, float(v)) for g, x in values.items() for v in x] + [("d", None), ("a", None)]
    table = spark.createDataFrame(rows, "g string, v double").repartition(5)
    n = F.col("n")
    ranks = {"low": F.lit(0), "upper": Q.upper_rank(n), "p95": Q.capped_rank(n, 0.95), "past": n}
    got = {r.g: (r.n, r.low, r.upper, r.p95, r.past) for r in Q.at_ranks(table, "g", "v", ranks, buckets=16).collect()}
    plain = {g: sorted(x) for g, x in values.items() if x}
    assert got == {g: (len(x), x[0], x[len(x) // 2], x[min(int(0.95 * len(x)), len(x) - 1)], None) for g, x in plain.items()}


def test_large_tables_are_numbered_by_ranges(spark, monkeypatch):
    from saltmarsh.functions import stats as S

    rows = spark.range(300).select("id", (F.col("id") * 7 % 31).cast("double").alias("v"))
    whole = S.portable_floor(rows, "v", ["id"]).first()
    monkeypatch.setattr(S, "_ONE_TASK", 64)
    assert S.portable_floor(rows, "v", ["id"]).first() == pytest.approx(tuple(whole))
