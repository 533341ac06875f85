from __future__ import annotations

import pytest

from quernstone.llm import quality

LONG = " ".join(f"term{i}" for i in range(60))
OWN = "one sentence that only this text has and that has more than ten words in it, number {}"


@pytest.fixture(params=[quality.BROADCAST_LINES, -1])
def either_way(request, monkeypatch):
    monkeypatch.setattr(quality, "BROADCAST_LINES", request.param)


def frame(spark, docs):
    return spark.createDataFrame([(i, t, "host", 7, "own") for i, t in enumerate(docs)], "doc_id long, text string, source string, n_chars long, kept string").repartition(3)


def test_long_lines_are_counted_and_deplete(spark, either_way):
    docs = [f"{LONG}\n{OWN.format(i)}" for i in range(11)] + [OWN.format(99)]
    rows = {r.doc_id: r for r in quality.with_verdict(frame(spark, docs).drop("kept")).collect()}
    assert len(LONG) > 200 and [rows[i].n_line_words for i in range(12)] == [len(LONG.split())] * 11 + [0]
    assert [rows[i].kept for i in range(12)] == [False] * 11 + [True]


def test_at_the_limit_long_lines_stay(spark, either_way):
    docs = [f"{LONG}\n{OWN.format(i)}" for i in range(10)]
    assert all(r.kept and r.n_line_words == 0 for r in quality.with_verdict(frame(spark, docs).drop("kept")).collect())


def test_lines_above_the_limit_are_taken_off_the_texts(spark, either_way):
    """Long and short ones, each time they occur; all else, blank lines too, stays."""
    body = lambda i: "\n".join(" ".join(f"w{i}x{k}x{j}" for j in range(12)) for k in range(6))
    docs = [f"  ALL rights\treserved\n\n{body(i)}\n{LONG}\nAll  Rights reserved\n" for i in range(11)] + ["All rights\n" + body(99) + "\n", None]
    got = quality.kept_documents(frame(spark, docs))
    want = {i: f"\n{body(i)}\n" for i in range(11)} | {11: docs[11]}
    assert got.columns == ["doc_id", "text", "source", "n_chars", "kept"]
    assert {r.doc_id: (r.text, r.n_chars, r.kept) for r in got.collect()} == {i: (t, len(t) if i < 11 else 7, "own") for i, t in want.items()}


def test_nulls_empty_tables_repeated_rows_and_clashing_names(spark, either_way):
    docs = [None, "", "one two", f"{LONG}\n{OWN.format(1)}", f"{LONG}\n{OWN.format(1)}", "many " * 40, " ".join(f"v{i}" for i in range(30_000))]
    df = frame(spark, docs).withColumn("source", quality.F.when(quality.F.col("doc_id") < 3, "host")).withColumns({"q_words": quality.F.lit("mine"), "Q_text": quality.F.lit(3)})
    out = quality.with_verdict(df)
    assert set(df.columns) <= set(out.columns)
    rows = {r.doc_id: r for r in out.collect()}
    assert [rows[i].n_words for i in range(7)] == [0, 0, 2, *[len(docs[3].split())] * 2, 40, 30_000] and {(r.q_words, r.Q_text) for r in rows.values()} == {("mine", 3)}
    assert [rows[i].kept for i in range(7)] == [False, False, False, True, True, False, True]
    assert quality.kept_documents(df).columns == df.columns and quality.with_verdict(df.limit(0)).count() == 0
