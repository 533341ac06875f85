from __future__ import annotations

import hashlib
import math
from collections import Counter

import pytest

from quernstone.llm import mixing


def draws(name, mean, parts, seed=17):
    def one(j):
        u = (int(hashlib.md5(f"{seed}:{name}:{j}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        k, c = 0, math.exp(-mean)
        while c < u and k < 2000:
            k += 1
            c += math.exp(-mean + k * math.log(mean) - math.lgamma(k + 1))
        return k

    return sum(one(j) for j in range(1, parts + 1))


@pytest.mark.parametrize("limit", [mixing.BROADCAST_SOURCES, -1])
def test_copies_match_brute_force_with_nulls_ties_and_clashing_names(spark, monkeypatch, limit):
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", limit)
    docs = [(i, "abcd" * (i % 9), ["a", "b", None][i % 3]) for i in range(300)] + [(None, f"text {i}", "a") for i in range(200)]
    docs += [(None, None, "b"), (7, "abcdabcd", "b"), (7, "abcdabcd", "b"), (900, "", "empty"), (901, None, "empty")]
    df = spark.createDataFrame([(*d, 1.0, 2, "p", "k") for d in docs], "doc_id long, text string, source string, rate double, parts int, cdf string, mix_key string").repartition(4)
    size = Counter()
    for _, t, s in docs:
        size[s] += len(t or "")
    weight = {s: math.sqrt(n) for s, n in size.items()}
    rate = {s: weight[s] / sum(weight.values()) * sum(size.values()) / n if n else 1.0 for s, n in size.items()}
    want = Counter()
    for d, t, s in docs:
        name = d if d is not None else "null:" + hashlib.md5((t or "").encode()).hexdigest()
        want[d, t, s] += draws(name, rate[s], 1)
    got = mixing.mixed_documents(df)
    assert got.columns == df.columns
    assert Counter((r.doc_id, r.text, r.source) for r in got.collect()) == +want
    assert sum(want[d, t, s] for d, t, s in docs if d is None) > 100  # rows without an id draw one by one
    keys = [r.mix_key for r in mixing.mix(df).select("mix_key").collect()]
    assert keys == sorted(keys)
    assert mixing.mixed_documents(df.limit(0)).count() == 0


def test_large_means_are_split_into_parts(spark):
    df = spark.createDataFrame([(1, "ab", "s"), (2, "cd", "t")], "doc_id long, text string, source string")
    got = Counter(r.doc_id for r in mixing.mix(df, budget=450.0).collect())
    assert got == {i: draws(i, 150.0, 3) for i in (1, 2)}
    only = mixing.mix(df, weights={"s": 1.0}, budget=3.0).collect()
    assert {r.doc_id for r in only} == {1}
