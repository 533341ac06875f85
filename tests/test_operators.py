from __future__ import annotations

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quernstone.functions import constants as k
from quernstone.functions import extract
from quernstone.operators import association as a
from quernstone.operators import evaluation as ev
from quernstone.operators import evidence, external, graph, scoring
from quernstone.sources import html, tables


def baskets(spark, rows):
    return spark.createDataFrame([(i, sorted(r), False) for i, r in enumerate(rows)], "basket_id long, items array<string>, flag boolean")


def test_support_and_lift(spark):
    rows = {r.pair_key: r for r in a.pair_statistics(baskets(spark, ["AB", "ABC", "AC"])).collect()}
    assert (rows["A||B"].pair_count, rows["A||B"].support, rows["A||B"].lift) == (2, pytest.approx(2 / 3), 1.0)
    for r in rows.values():
        assert 0 <= r.support <= 1 and r.lift * r.frequency_a * r.frequency_b == pytest.approx(r.pair_count * 3)
    assert a.pair_statistics(baskets(spark, ["A", ""])).count() == 0


def test_itemsets_match_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = ["".join(rng.choice(list("ABCDEFG"), int(rng.integers(0, 6)), replace=False)) for _ in range(60)]
    for n in (3, 4):
        want = {c: v for c in itertools.combinations("ABCDEFG", n) if (v := sum(set(c) <= set(r) for r in rows)) >= 2}
        assert {tuple(r["items"]): r["n"] for r in a.itemsets(baskets(spark, rows), n, 2).collect()} == want


def test_baskets_of_itemsets_come_from_their_own_rows(spark):
    rng = np.random.default_rng(2)
    rows = ["".join(rng.choice(list("ABCDEFG"), int(rng.integers(0, 7)), replace=False)) for _ in range(60)] + ["AXYZ"]
    for n in (2, 4):
        want = sorted((c, i) for c in itertools.combinations("ABCDEFGXYZ", n) for i, r in enumerate(rows) if set(c) <= set(r) and sum(set(c) <= set(x) for x in rows) >= 2)
        got = a.itemset_baskets(baskets(spark, rows), n, 2)
        assert sorted((tuple(r["items"]), r.basket_id) for r in got.collect()) == want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join LeftSemi" in plan and "Join Inner" not in plan  # no set is paired with baskets that only share an item with it


def test_names_break_ties(spark):
    df = spark.createDataFrame([("A", "C", 2, 1.0, 0.5), ("A", "B", 2, 1.0, 0.5)], "item_a string, item_b string, pair_count long, lift double, support double")
    assert a.stable_rank(df, "support", "r").orderBy("r").first().item_b == "B"


def brute_betweenness(edges, weighted):
    nodes = sorted({x for e in edges for x in e[:2]})
    total = dict.fromkeys(nodes, 0.0)
    near = {v: {} for v in nodes}
    for x, y, w in edges:
        near[x][y] = near[y][x] = 1.0 / w if weighted else 1.0
    def paths(s, t):
        best, out = math.inf, []
        stack = [(s, 0.0, (s,))]
        while stack:
            v, d, p = stack.pop()
            if d > best + 1e-12:
                continue
            if v == t:
                if d < best - 1e-12:
                    best, out = d, []
                out.append(p)
                continue
            stack += [(u, d + c, (*p, u)) for u, c in near[v].items() if u not in p]
        return [p for p in out]
    for s, t in itertools.combinations(nodes, 2):
        ps = paths(s, t)
        for p in ps:
            for v in p[1:-1]:
                total[v] += 1 / len(ps)
    n = len(nodes)
    return {v: x * 2 / ((n - 1) * (n - 2)) if n > 2 else x for v, x in total.items()}


@pytest.mark.parametrize("weighted", [True, False])
def test_betweenness_matches_brute_force(spark, weighted):
    rng = np.random.default_rng(3)
    edges = [(x, y, int(rng.choice([1, 2, 4, 8]))) for x, y in itertools.combinations("ABCDEFG", 2) if rng.random() < 0.45]
    df = spark.createDataFrame(edges, "item_a string, item_b string, weight long")
    got = {r.node: r.betweenness for r in graph.betweenness(df, weighted).collect()}
    assert got == pytest.approx(brute_betweenness(edges, weighted))
    star = spark.createDataFrame([("A", "B", 3), ("B", "C", 2)], "item_a string, item_b string, weight long")
    assert {r.node: r.betweenness for r in graph.betweenness(star).collect()} == {"A": 0.0, "B": 1.0, "C": 0.0}
    assert graph.betweenness(star.limit(0)).count() == 0


def test_communities_split_two_cliques(spark):
    edges = [(x, y, 3.0) for g in ("ABCD", "EFGH") for x, y in itertools.combinations(g, 2)] + [("D", "E", 1.0)]
    c = graph.louvain(edges)
    assert len(set(c.values())) == 2 and c["A"] == c["D"] != c["E"] and graph.modularity(edges, c) > 0.35


def test_constant_columns_scale_to_zero_and_clipping(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (1000.0, 5.0)], "x double, y double")
    rows = scoring.with_scaled(df, {"x": "nx", "y": "ny"}).collect()
    assert {r.ny for r in rows} == {0.0} and {r.nx for r in rows} >= {0.0, 1.0}


def test_shrinkage_prefers_more_evidence(spark):
    df = spark.createDataFrame([("A", "B", 2, 2), ("A", "C", 5, 4), ("X", "Y", 20, 2)], "item_a string, item_b string, evidence long, positive long")
    r = {x.item_b: x.s for x in scoring.smoothed(df, {"s": ("positive", "evidence")}).collect()}
    assert r["C"] > r["B"] > r["Y"]


def test_there_are_21_settings_and_36_thresholds(spark):
    assert len(scoring.weight_settings()) == 21 and scoring.threshold_grid(spark).count() == 36


def test_rank_statistics(spark):
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate([(1, 1), (2, 2), (3, 3), (3, 1)])], "k int, x double, y double")
    assert ev.spearman(df.filter("k < 3"), "x", "y").first()["spearman"] == pytest.approx(1.0)
    assert ev.spearman(df.filter("k < 1"), "x", "y").first()["spearman"] is None
    assert ev.kendall(df, "k", "x", "y").first()["kendall"] == pytest.approx((3 + 0 - 1) / 4)


def test_agreement_at_k(spark):
    ks = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    ranking = spark.createDataFrame([("p", 1), ("q", 2), ("r", 3), ("s", 4)], "pair_key string, rank int")
    got = {r.k: r for r in ev.at_k(ranking, spark.createDataFrame([("p",), ("q",)], "pair_key string"), "pair_key", ks).collect()}
    assert got[1].common == 1 and got[2].precision == 1.0 and got[3].recall == 1.0


def test_kappa_and_final_labels(spark):
    df = spark.createDataFrame([("f", "1", "1"), ("f", "1", "0"), ("g", "1", "1"), ("g", None, "1")], "field string, a string, b string")
    got = {r.field: r for r in ev.cohen_kappa(df, "field", "a", "b").collect()}
    assert got["f"].n == 2 and got["f"].agreement == 0.5 and got["f"].kappa == pytest.approx(0.0) and got["g"].kappa is None
    rows = spark.createDataFrame([(None, "x", False), (None, "x", True), ("y", "x", True), ("y", None, False)], "r string, a string, n boolean")
    label, source = ev.final_label("r", "a", F.col("n"))
    assert [r[0] for r in rows.select(source).collect()] == ["auto", "unresolved", "reviewer", "reviewer"]
    assert [r[0] for r in rows.select(label).collect()] == ["x", None, "y", "y"]


NAMES = ["グレープミント", "グレープ", "ミント", "バニラ", "レモン", "ライム"]


def evidence_of(spark, body):
    d = extract.Dictionary([(n, n) for n in NAMES])
    lex = extract.Lexicon({"taste:fresh": ["爽やか"]}, ["美味しい", "爽やか"], ["苦手"])
    docs = spark.createDataFrame([("R1", body, d.extract(body), d.extract("グレープミント"), [])], "doc_id string, text string, items array<string>, title_items array<string>, summary_items array<string>")
    s = evidence.sentence_table(docs, extract.extractor(d), extract.analyser(lex), (["のおすすめミックス$"], ["公式"]), (["加える"], ["甘さ"]))
    pairs = spark.createDataFrame([("グレープ", "ミント", 1)], "item_a string, item_b string, pair_count long")
    return docs, evidence.evidence_rows(docs, s, pairs), pairs


def test_only_sentences_with_both_are_evidence(spark):
    _, rows, pairs = evidence_of(spark, "グレープは美味しい。ミントは爽やか。")
    r = evidence.pair_features(rows, pairs).first()
    assert (r.evidence_docs, r.same_has_positive_docs, r.doc_has_positive_docs) == (0, 0, 1)


def test_sentences_are_not_sorted_by_pair(spark):
    _, rows, _ = evidence_of(spark, "グレープは美味しい。グレープとミントは爽やか。ミントは苦手。")
    assert [(r.sentence_index, r.same_sentence) for r in rows.collect()] == [(1, True)]
    assert "Window" not in rows._jdf.queryExecution().optimizedPlan().toString()


def test_explicit_mixes_and_templates(spark):
    docs, rows, pairs = evidence_of(spark, "グレープとミントをミックスすると爽やかです。グレープとミントをミックスすると爽やかです。")
    r = evidence.pair_features(rows, pairs).first()
    assert (r.evidence_docs, r.same_has_explicit_mix_docs, r.rows_has_positive) == (1, 1, 2)
    assert evidence.deduplicated(rows).count() == 1 and evidence.representative_contexts(rows).count() == 1
    f = evidence.pair_flags(docs, rows, pairs).first()
    assert f.has_explicit_mix and not f.excluded
    _, rows, pairs = evidence_of(spark, "グレープとミントのおすすめミックス")
    r = evidence.pair_features(rows, pairs).first()
    assert (r.evidence_docs, r.template_rows) == (0, 1)


def test_names_are_looked_for_once_and_in_sentences(spark, tmp_path):
    from quernstone.plans import text_chain

    texts = ["For. the was\nfrom this? with", "x for the was for.this", None, "", "...", "waſ forma"] + ["was with " * 50_000 + "."]
    docs = spark.createDataFrame([(i % 5, v) for i, v in enumerate(texts)], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    found = text_chain._found(spark, str(tmp_path))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython [run(sentence#") == plan.count("ArrowEvalPython") == 1
    d = text_chain._dictionary()
    assert sorted(r["items"] for r in text_chain._named(found).collect()) == sorted(d.extract(v) for v in texts)
    assert not any(set(n) & set(text_chain.MARKS + "\r\n") or n != n.strip() for n in text_chain.NAMES)
    s = evidence.sentence_table(docs, extract.extractor(d), extract.analyser(text_chain.LEXICON), text_chain.TEMPLATES, text_chain.ROLES, marks=text_chain.MARKS)
    assert s._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 2


def test_fold_keeps_the_length():
    for v in ("", "abc", "straße", "ﬁn", "ſıŉ", "ΐx", "グレープ a"):
        assert extract.fold(v) == "".join(u if len(u := c.upper()) == 1 else c for c in v)


def test_external_statuses(spark):
    articles = spark.createDataFrame([("A1", "ミント"), ("A2", " ")], "article_id string, target_raw string")
    cells = [("A1", 0, 0, 0, "名前", True), ("A1", 0, 1, 0, "レモン/ライム", True), ("A1", 0, 2, 0, "パイン", True), ("A1", 0, 3, 0, "ミント", True), ("A1", 0, 4, 0, "", True), ("A1", 0, 5, 0, "×", True), ("A1", 0, 6, 0, "レモン", True), ("A1", 1, 0, 0, "h", False), ("A1", 1, 1, 0, "バニラ", False), ("A2", 0, 0, 0, "h", True), ("A2", 0, 1, 0, "バニラ", True)]
    df = spark.createDataFrame(cells, "article_id string, table_index int, row_index int, cell_index int, cell_text string, is_recommended boolean")
    known = F.array(*map(F.lit, NAMES))
    got = external.extracted_pairs(articles, df, lambda c: F.when(F.array_contains(known, c), c).otherwise(F.lit("")))
    rows = [(r.raw, r.status, r.exclusion_reason, r.pair_key, r.is_duplicate) for r in got.orderBy("article_id", "row_index", "raw").collect()]
    assert rows == [
        ("ライム", "ok", "", "ミント||ライム", False), ("レモン", "ok", "", "ミント||レモン", False), ("パイン", "unresolved", "recommended_flavor_unregistered", "", False), ("ミント", "excluded", "self_pair", "", False),
        (None, "excluded", "empty_cell", "", False), ("×", "excluded", "explicit_none_marker", "", False), ("レモン", "ok", "", "ミント||レモン", True), ("バニラ", "unresolved", "missing_target_flavor", "", False),
    ]
    assert external.unique_pairs(got).count() == 2
    ranking = spark.createDataFrame([("ミント||レモン",)], "pair_key string")
    sim = {r.scenario: r.valid_rows for r in external.what_if(got, ranking, {"baseline": {}, "extended": k.EXTENDED}).collect()}
    assert sim["baseline"] == 3 < sim["extended"] == 4


def test_articles_keep_the_first_of_shared_keys(spark):
    df = spark.createDataFrame([(1, "u1", "t1"), (2, "u1", "t2"), (3, "u3", "t2"), (4, "u4", "t1"), (5, "", "")], "n long, url string, title string")
    assert {r.n: r.kept_order for r in external.deduplicate_articles(df, ["url", "title"], "n").collect()} == {1: 1, 2: 1, 3: 3, 4: 1, 5: 5}


PAGE = """<html><head><title>T</title><link rel="canonical" href="https://e.org/a"><meta name="author" content="Ann"></head><body><nav><a href="/x">menu</a></nav>
<h1>Head</h1><time datetime="2024-01-02"></time><p>One <b>two</b></p><h2>おすすめミックス</h2><table><tr><th>名前</th></tr><tr><td>レモン</td></tr></table><ul><li>a</li><li>b</li></ul>
<h2>特徴</h2><blockquote class="embed"><p>skip</p></blockquote><script>var x="<p>";</script><p>last</body></html>"""


def test_article_pages(spark):
    parsed = html.articles(spark.createDataFrame([(1, PAGE), (2, None)], "page_id long, html string"))
    r = parsed.filter("page_id = 1").first()
    assert (r.title, r.canonical, r.author, r.published) == ("T", "https://e.org/a", "Ann", "2024-01-02")
    assert [p.text for p in r.paragraphs] == ["One two", "last"] and [i.text for i in r["items"]] == ["a", "b"]
    cells = html.exploded(parsed, "cells").collect()
    assert [(c.row_index, c.text, c.is_recommended) for c in cells] == [(0, "名前", True), (1, "レモン", True)]
    assert html.exploded(parsed, "paragraphs").filter("is_recommended").count() == 0
    assert html.flat_articles(parsed).count() == 2


def test_listing_pages():
    page = '<aside><article class="item"><a href="/no">x</a></article></aside><div class="blog_list"><article class="item"><a href="/a">A</a></article><article class="item"><a href="/a">A</a></article><article class="item"><a href="https://other.org/b">B</a></article></div><a rel="next" href="/p2">n</a>'
    assert html.parse_listing(page, "https://e.org/list", "e.org") == ([("https://e.org/a", "A")], "https://e.org/p2")


def test_csv_and_reports(spark, tmp_path):
    df = spark.createDataFrame([("a\nb", 'q"x', "日本")], "x string, y string, z string")
    tables.write_csv(df, str(tmp_path / "c"))
    assert tables.read_csv(spark, str(tmp_path / "c")).collect() == df.collect()
    with pytest.raises(Exception):
        tables.write_csv(df, str(tmp_path / "c"))
    (tmp_path / "bom.csv").write_bytes("﻿a,b\n1,2\n".encode())
    assert tables.read_csv(spark, str(tmp_path / "bom.csv")).columns == ["a", "b"]
    once = tables.upsert_section("# Title", "s", "body")
    assert tables.upsert_section(once, "s", "body") == once and "new" in tables.upsert_section(once, "s", "new")
    assert tables.markdown(df).startswith("| x | y | z |")
