from __future__ import annotations

import numpy as np
import pytest

from quernstone.llm import phrase_dedup as pd


def brute(docs, span):
    words = {d: (t or "").encode().split() for d, t in docs}
    first = {}
    for d in sorted(words):
        for i in range(len(words[d]) - span + 1):
            first.setdefault(tuple(words[d][i : i + span]), d)
    out = {}
    for d, w in words.items():
        gone = set()
        for i in range(len(w) - span + 1):
            if first[tuple(w[i : i + span])] < d:
                gone.update(range(i, i + span))
        out[d] = (len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode())
    return out


def corpus(span, seed):
    rng = np.random.default_rng(seed)
    vocab = [f"v{i}" for i in range(60)] + ["É", "x\x0b", "日"]
    draw = lambda n: list(rng.choice(vocab, n))
    passages = [draw(int(rng.integers(span - 2, 4 * span))) for _ in range(6)]
    docs = [None, "", " \n ", "a b"]
    for _ in range(60):
        w = draw(int(rng.integers(0, 2 * span)))
        for _ in range(int(rng.integers(0, 3))):
            p = passages[int(rng.integers(6))]
            a = int(rng.integers(0, max(1, len(p) - span + 3)))
            w += p[a : a + int(rng.integers(span - 1, len(p) + 1))] + draw(int(rng.integers(0, 5)))
        docs.append(" ".join(w))
    docs += [" ".join(passages[0] * 3)] * 4 + ["same " * (3 * span), "same " * (2 * span), "same " * (span - 1)]
    return list(enumerate(docs))


@pytest.mark.parametrize(("span", "seed"), [(50, 1), (10, 2)])
def test_removal_matches_brute_force(spark, span, seed):
    docs = corpus(span, seed)
    df = spark.createDataFrame([(d, t, "y") for d, t in docs], "doc_id long, text string, shard string").repartition(3)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in pd.remove_repeats(df, span=span, shard_bytes=6000).collect()}
    want = brute(docs, span)
    assert {d: v for d, v in got.items() if v != want[d]} == {}
    assert got.keys() == want.keys() and sum(v[1] for v in want.values()) > 500


def test_repeated_rows_null_ids_and_empty_tables(spark):
    text = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(4, text), (4, text), (None, text), (7, text + " more")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in pd.remove_repeats(df).collect())
    assert got == [(0, 60, 0), (4, 60, 0), (4, 60, 0), (7, 61, 60)]
    assert pd.remove_repeats(df.limit(0)).count() == 0


def test_every_window_of_a_passage_holds_a_piece():
    for span in (10, 50, 51):
        for n in range(1, 130):
            first = np.zeros(200, bool)
            first[7 : 7 + n] = True
            pieces = list(pd.phrases(first, first, span))
            assert all(any(s >= a and e <= a + span for s, e in pieces) for a in range(7, 7 + n))
            assert all(7 <= s and e <= 7 + n + span - 1 for s, e in pieces)


def test_the_shuffled_way_gives_the_same(spark, monkeypatch):
    docs = corpus(10, 5)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    monkeypatch.setattr(pd, "SPARSE", -1)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in pd.remove_repeats(df, span=10, shard_bytes=9000).collect()}
    assert got == brute(docs, 10)


def test_rows_without_an_id_pass_through(spark):
    text = " ".join(f"w{i}" for i in range(120))
    df = spark.createDataFrame([(1, text), (2, text)] + [(None, text)] * 50 + [(None, None), (None, " a\x0b b ")], "doc_id long, text string").repartition(3)
    got = sorted(((r.doc_id or 0, r.n_words, r.n_removed, r.kept_text) for r in pd.remove_repeats(df).collect()))
    assert got == sorted([(1, 120, 0, text), (2, 120, 120, "")] + [(0, 120, 0, text)] * 50 + [(0, 0, 0, ""), (0, 2, 0, "a b")])
