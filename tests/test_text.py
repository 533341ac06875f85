from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quernstone.functions import extract as x
from quernstone.functions import text as t

NAMES = ["グレープミント", "カルダモンミルク", "グレープ", "ミント", "バニラ", "マンゴー", "メロン"]
DICT = x.Dictionary([(n, n) for n in NAMES])


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("グレープミントが好き", ["グレープミント"]),
        ("グレープとミントのミックス", ["グレープ", "ミント"]),
        (None, []),
        ("", []),
        ("マンゴーのメロン", ["マンゴー", "メロン"]),
        ("Groß ﬁn ミント", ["ミント"]),
        ("新ミント", []),
    ],
)
def test_longest_names_win_within_boundaries(text, want):
    assert DICT.extract(text) == want


def test_boundary_modes_differ():
    strict = x.Dictionary([("ミント", "ミント")], boundary="strict")
    assert DICT.extract("にミント") == ["ミント"] and strict.extract("にミント") == []
    word = x.Dictionary([("mint", "mint")], boundary="word")
    assert word.extract("peppermint Mint.") == ["mint"] and word.extract("peppermint") == []


def test_negation():
    assert x.lexicon_matches("この組み合わせは美味しくない", ["美味しい"]) == ([], ["美味しい"])
    assert x.lexicon_matches("とても美味しい", ["美味しい"]) == (["美味しい"], [])
    lex = x.Lexicon({"taste:sweetness": ["甘い"], "experience:smoothness": ["吸いやすい"]}, ["吸いやすい"], ["強すぎる", "苦手", "合わない"])
    a = lex.analyse("甘くないので吸いやすい。")
    assert a["negated"] == ["taste:sweetness:甘い"] and a["has_positive"]
    for bad in ("強すぎる", "苦手で吸えない", "合わない"):
        assert lex.analyse(bad)["has_negative"]


def test_sentences_and_keys(spark):
    assert one(spark, t.sentences(F.col("s")), s="一。二！三\n\n　四 \r\n") == ["一。", "二！", "三", "四"]
    assert one(spark, t.ordered_key(F.lit("レモン"), F.lit("ミント"))) == "ミント||レモン"
    assert one(spark, t.ordered_key(F.lit(""), F.lit("ミント"))) == ""
    assert one(spark, t.directed_key(F.lit("a"), F.lit("b"))) == "a -> b"
    assert one(spark, t.utrim(F.col("s")), s="　\xa0x y\x85") == "x y"
    assert one(spark, t.mix_keywords(F.col("s")), s="メインにA、アクセントにBを加えた") == ["加え", "メイン", "アクセント"]
    assert one(spark, t.cell_tokens(F.col("s")), s="レモン/ライム、・バニラ") == ["レモン", "ライム", "バニラ"]
    assert one(spark, t.compare_key(F.col("s")), s="Ａ・b　Ｃ（d）_!") == "abcd!"
    assert one(spark, t.snippet(F.col("s"), F.lit("xx"), 2), s="abcxxdef") == "bcxxde"


def test_dates(spark):
    assert str(one(spark, t.japanese_date(F.col("s")), s="5月 3, 2021")) == "2021-05-03"
    assert str(one(spark, t.japanese_date(F.col("s")), s="12月 30, 2025")) == "2025-12-30"
    assert one(spark, t.japanese_date(F.col("s")), s="someday") is None
    assert str(one(spark, t.any_date(F.col("s")), s="2024/1/5")) == "2024-01-05"


def test_parent_child_explicit_mix_and_headings(spark):
    assert one(spark, t.parent_child(F.lit("グレープ"), F.lit("グレープミント"))) is True
    assert one(spark, t.explicit_mix(F.col("s"), F.lit("グレープ"), F.lit("ミント")), s="グレープとミントをミックスすると爽やかです。") == "グレープとミントをミックス"
    assert one(spark, t.explicit_mix(F.col("s"), F.lit("グレープ"), F.lit("ミント")), s="グレープ×ミント") == "グレープ×ミント"
    assert one(spark, t.explicit_mix(F.col("s"), F.lit("グレープ"), F.lit("ミント")), s="グレープは美味しい。") is None
    for s, want in (("オススメミックス", True), ("相性が良いフレーバー", True), ("特徴", False)):
        assert one(spark, t.is_recommended_heading(F.col("s")), s=s) is want


def test_keys_of_equal_names(spark):
    assert one(spark, t.singular_key(F.lit("berries"))) == "BERRY" and one(spark, t.singular_key(F.lit("peaches"))) == "PEACH"
    assert one(spark, t.katakana_key(F.lit("コーラー"))) == "コラ"
    assert one(spark, t.template_hit(F.col("s"), ["^a"], ["b"]), s="ab") == "^a"


def test_dictionary_of_a_catalogue(spark):
    df = spark.createDataFrame([(1, "Mango(マンゴー)"), (2, "MANGO"), (3, "Mint"), (4, "nan"), (5, " ")], "n int, name string")
    got = {r.pattern: r.canonical for r in x.build_dictionary(df, "name", "n").collect()}
    assert got == {"マンゴー": "マンゴー", "MANGO": "マンゴー", "MINT": "MINT"}


def test_contexts():
    assert x.matched_context("Aは良い。AとBは良い。", "A", "B") == "AとBは良い。"
    assert x.matched_context("Aは良い。Bは良い。", "A", "B") == "Aは良い。 Bは良い。"


def test_rules_of_mixes_roles_and_segments(spark):
    mix = lambda s, a="グレープ", b="ミント": one(spark, t.explicit_mix(F.col("s"), F.lit(a), F.lit(b)), s=s)
    assert mix("グレープにミントを足すと良い") == "グレープにミントを足す" and mix("ミントが強いグレープも少し足した") == "ミントが強いグレープも少し足した"
    assert mix("グレープとミントをブレンド") is None and mix("グレープ" + "あ" * 13 + "ミントのミックス") is None
    assert one(spark, t.parent_child_reason(F.lit("グレープ・ミント"), F.lit("ミント"))) == "ミント is contained in グレープ・ミント"
    assert one(spark, t.parent_child(F.lit("A-b"), F.lit("ab"))) is False
    assert tuple(one(spark, t.role_terms(F.col("s"), ["足す", "入れる"], ["爽やか"]), s="爽やかさを足す")) == ("action+effect", "足す", "爽やか")
    assert one(spark, t.role_rule(F.col("s"), ["足す"], ["爽やか"]), s="爽やか") == "effect" and one(spark, t.role_rule(F.col("s"), ["足す"], ["x"]), s="") == ""
    assert one(spark, t.segments(F.col("a"), F.col("b")), a="題！副題", b="一・二。 三\n\n四?") == ["題", "副題", "一", "・二", "三", "四"]


def test_keys_by_script(spark):
    key = lambda f, s: one(spark, f(F.col("s")), s=s)
    assert key(t.format_key, "ａ  b") == "A B" and key(t.format_key, "aミント") == "aミント"
    assert key(t.symbol_key, "Earl-Grey & (tea)!") == "EARLGREYTEA!" and key(t.singular_key, "gas") == "GAS" and key(t.singular_key, "bus") == "BUS"
    assert key(t.singular_key, "plums") == "PLUM" and key(t.singular_key, "ミントs") == "ミントs" and key(t.katakana_key, "ミルク ティー") == "ミルクティ"
    assert key(t.katakana_key, "Aー") == "Aー"


def test_names_of_cells():
    assert x.single_name(DICT, "グレープとミント（強め）") == "グレープ" and x.single_name(DICT, " ミ・ント ") == "" and x.single_name(DICT, None) == ""
    assert x.name_candidates("ミント", ["グレープミント", "ミント味", "バニラ", "ミ・ント"]) == ["ミ・ント", "ミント味", "グレープミント"]
    assert x.name_candidates("・", ["ミント"]) == []


def test_extraction_and_negation_match_plain_scans():
    """Against readings of the rules that look at one pattern and one place at a time."""
    import random
    import re

    rng, parts = random.Random(5), [*NAMES, "の", "新", "a", "ミン", "あまり", "甘い", "甘く", "ない", "食べる", "食べ", "ません", "しない", "。", "x1"]
    d = x.Dictionary([(n, n.lower()) for n in [*NAMES, "Ax1", "mintx"]])
    for _ in range(400):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        taken, want = set(), set()
        for p in sorted([*NAMES, "AX1", "MINTX"], key=len, reverse=True):
            for m in re.finditer(f"(?={re.escape(p)})", text.upper()):
                a, b = m.start(), m.start() + len(p)
                if not taken & set(range(a, b)) and d.stands_alone(text, a, b):
                    taken |= set(range(a, b))
                    want.add(p.lower())
        assert d.extract(text) == sorted(want), text
        plain, against = x.lexicon_matches(text, ["甘い", "食べる"])
        for term in ("甘い", "食べる"):
            n = len(re.findall(term, text))
            bad = sum(bool(re.search("ない|ません|なく", text[m.end() : m.end() + 8]) or ("あまり" in text[max(0, m.start() - 4) : m.start()] and re.search("ない|なく|ません", text[max(0, m.start() - 4) : m.end() + 8]))) for m in re.finditer(term, text))
            forms = {"甘い": "甘く(?:ない|なく|ません|ではない|じゃない)", "食べる": "食べ(?:ら?(?:ない|なく|なかった|ません)|とは思わない|しない|できない)"}
            assert (plain.count(term), against.count(term)) == ((n - bad, bad) if n else (0, int(bool(re.search(forms[term], text))))), (text, term)
