from __future__ import annotations

from quernstone.operators import labels


def test_the_first_rule_that_holds_decides(spark):
    rows = [
        (1, "", "グレープとミントをミックスすると爽やかでおいしいです。", "グレープ", "ミント"),
        (2, "", "グレープ、ミント、バニラなど種類が豊富なお店でした。", "グレープ", "ミント"),
        (3, "t", "", "グレープ", "ミント"),
        (4, "", "グレープだけの話をしているかなり長い文章です。", "グレープ", "ミント"),
        (5, "", "グレープとミントを7:3で入れてみたらよかったです。", "グレープ", "ミント"),
        (6, "", "グレープは甘くておいしい。そしてミントは爽やかです。", "グレープ", "ミント"),
    ]
    df = spark.createDataFrame(rows, "id int, title string, context string, item_a string, item_b string")
    got = {r.id: (r.auto_label, r.matched_rule) for r in labels.classified(df).collect()}
    assert got == {
        1: ("explicit_mix", "explicit_keyword"), 2: ("co_mention_only", "list_keyword"), 3: ("unclear", "title_only"),
        4: ("unclear", "missing_target_item"), 5: ("probable_mix", "ratio"), 6: ("co_mention_only", "separate_context_mentions"),
    }


def test_aliases_take_one_name(spark):
    items = spark.createDataFrame([("mint", 2), ("MINT", 9), ("Mints", 1), ("コーラ", 1), ("コーラー", 4)], "item string, frequency long")
    cand = {(r.item_a, r.item_b): r.match for r in labels.alias_candidates(items).collect()}
    assert cand[("MINT", "mint")] == "format" and cand[("MINT", "Mints")] == "singular" and cand[("コーラ", "コーラー")] == "katakana"
    m = labels.alias_map(items, labels.alias_candidates(items))
    assert {r["item"]: r.canonical for r in m.collect()} == {"MINT": "MINT", "mint": "MINT"}
    df = spark.createDataFrame([(1, ["mint", "MINT"]), (2, ["x"])], "i int, items array<string>")
    assert {r.i: (r["items"], r.changed) for r in labels.mapped_items(df, m, "i").collect()} == {1: (["MINT"], True), 2: (["x"], False)}
