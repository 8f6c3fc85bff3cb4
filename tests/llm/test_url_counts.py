"""The models of op9 count every decided url."""

import random

import numpy as np

from saltmarsh.llm import url_filter


def test_all_decided_urls_are_counted(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "BUCKET_ROWS", 1 << 12)
    rng = random.Random(31)
    word = lambda: "".join(rng.choices("abcdefghé", k=rng.randrange(1, 7)))
    good = sorted({f"{word()}{k}.com/{word()}" for k in range(8_300)})
    bad = sorted({f"{word()}.{word()}{k}.net/fr/{word()}" for k in range(30)})
    pages = spark.createDataFrame([(k, "http://" + u) for k, u in enumerate([*good, *bad, *bad])], "page_id long, url string")
    judge = url_filter.train(pages)
    accepted, rejected = url_filter.Markov.fit(good), url_filter.Markov.fit(bad)
    asked = ["new.org/fr/x", good[0], bad[0], good[-1], "abc.de/é", "z"]
    data, place, of = url_filter._flat(asked)
    gap = np.bincount(of, rejected.logs(data, place) - accepted.logs(data, place)) / np.bincount(of)
    assert np.allclose(judge.ratios(asked), gap, atol=1e-8)
    # A fold is scored by the counts without it.
    fold = {r.u: r.fold for r in spark.createDataFrame([(u,) for u in good + bad], "u string").selectExpr("u", "cast(pmod(xxhash64(u), 5) as int) as fold").collect()}
    accepted, rejected = (url_filter.Markov.fit([u for u in x if fold[u] != 2]) for x in (good, bad))
    data, place, of = url_filter._flat(asked)
    gap = np.bincount(of, rejected.logs(data, place) - accepted.logs(data, place)) / np.bincount(of)
    found = dict(judge.scored(spark.createDataFrame([(k, u, 2) for k, u in enumerate(asked)], "id long, u string, fold int")).collect())
    assert np.allclose([found[k] for k in range(len(asked))], gap, atol=1e-8)
