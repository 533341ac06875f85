from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quernstone.llm import packing, token_counts
from quernstone.llm.bpe import tokenizer

HF = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
TRICKY = [None, "", " ", "\n", "a", " a", "a ", "a  b", "a\nb", "a \nb", "a\n b", "a\n\nb", "don't stop", "a b", "a  b", "é\tü", "<|endoftext|> x", "x<|endoftext|>", "1 22 333", "　x", "a" * 3000, "word " * 3000, "\x1cq\x1dr"]


def reference(text):
    return HF.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("text", TRICKY)
def test_ids_equal_the_reference_library(text):
    assert tokenizer().ids(text).tolist() == reference(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab Z\n\t'sé.,1  \x85日ﬁ\U0001f600"), max_size=40))
def test_ids_equal_the_reference_library_on_any_text(text):
    assert tokenizer().ids(text).tolist() == reference(text)


def test_differencing_is_a_near_equal_partition():
    rng = np.random.default_rng(1)
    sizes = rng.integers(8, 2048, 400)
    out = packing.differencing(sizes, 150)
    assert sorted(i for x in out for i in x) == list(range(400)) and len(out) == 150
    assert packing.differencing(np.array([8, 7, 6, 5, 4]), 2) is not None
    assert sorted(sum([8, 7, 6, 5, 4][i] for i in x) for x in packing.differencing(np.array([8, 7, 6, 5, 4]), 2)) == [14, 16]


def check_pieces(rows, texts):
    """texts: by row, with unique ids."""
    ids = {d: np.array([*reference(t), 1], "<u4") for d, t in texts}
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
        assert r.doc_tokens == len(ids[r.doc_id]) and r.length > 0
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
    assert by_doc.keys() == ids.keys()
    for d, p in by_doc.items():
        at = 0
        for r in sorted(p, key=lambda r: r.start):
            assert r.start == at
            at += r.length
        assert at == len(ids[d])
    used = 0
    for p in by_seq.values():
        at = 0
        for r in sorted(p, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
        used += at
    return used / (2048 * len(by_seq))


def test_pieces_cover_each_document_once(spark):
    rng = np.random.default_rng(2)
    texts = [(i, t) for i, t in enumerate(TRICKY)]
    texts += [(100 + i, " ".join(rng.choice(["alpha", "be", "gammas", "d."], rng.integers(1, 3000)))) for i in range(300)]
    df = spark.createDataFrame([(i, t, 1) for i, t in texts], "doc_id long, text string, length int").repartition(2)
    rows = packing.pack(df).collect()
    assert check_pieces(rows, texts) > 0.97


def test_repeated_rows_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "same text")] * 3 + [(None, None)], "doc_id long, text string")
    rows = packing.pack(df).collect()
    assert sorted((r.doc_id or 0, r.length) for r in rows) == [(0, 1), (1, 3), (1, 3), (1, 3)]
    assert packing.pack(df.limit(0)).count() == 0
    assert token_counts.token_counts(df.limit(0)).count() == 0


def test_histogram_answers_every_limit(spark):
    texts = [(i, "a b c " * (i % 37)) for i in range(500)] + [(900, None), (901, "")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    n = np.array([len(reference(t)) + 1 for _, t in texts])
    hist = token_counts.histogram(token_counts.lengths(df, extra=1))
    rows = token_counts.suffix_sums(hist, width=16).collect()
    assert len(rows) == len(set(n))
    for r in rows:
        k = r.n_tokens
        assert (r.n_docs, r.docs_below, r.docs_from) == ((n == k).sum(), (n < k).sum(), (n >= k).sum())
        assert (r.tokens_from, r.total_tokens, r.truncated_tokens) == (n[n >= k].sum(), n.sum(), np.minimum(n, k).sum())
        assert abs(r.quantile - (n <= k).mean()) < 1e-12
    assert token_counts.truncated_total(hist, 50) == np.minimum(n, 50).sum()
