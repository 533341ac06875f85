"""Fixed values that results depend on, as plain text."""

# Words that announce a mix, in their order of mention.
MIX_KEYWORDS = ["ミックス", "組み合わせ", "ブレンド", "合わせ", "入れ", "加え", "メイン", "アクセント", "配合"]
# Hiragana that may stand beside a name without being part of it.
BOUNDARY = "とのにへがをやもでなだかはばまでよりねよぞさし"
# Negation words, and endings that negate by themselves.
NEGATIONS = ["ない", "なく", "ません", "ではない", "じゃない"]
HARD_NEGATIONS = ["しない", "できない", "とは思わない"]
SOFT_PREFIXES = ["あまり", "それほど"]
# Japanese names and the Latin ones verified to mean the same.
VERIFIED_ALIASES = {"ライチ": "LYCHEE", "マンゴー": "MANGO", "チョコレート": "CHOCOLATE", "アールグレイ": "EARL GREY", "グレープフルーツ": "GRAPEFRUIT", "グレープ": "GRAPE", "コーラ": "COLA", "キウイ": "KIWI"}
# Cells that say "none".
NONE_MARKERS = ["×", "x", "X", "なし", "無し", "-", "―", "ー"]
# Name overrides of the two what-if dictionaries; the second adds to the first.
CONSERVATIVE = {"すいか": "デクラウド　スイカ", "スイカ": "デクラウド　スイカ", "ゆず": "デクラウド　ゆず", "コーヒー": "デクラウド　コーヒー", "ミルクティ": "デクラウド　ミルクティー", "ミルクティー": "デクラウド　ミルクティー"}
EXTENDED = {**CONSERVATIVE, "チャイ": "スパイスドチャイ", "パイン": "デクラウド　パイナップル", "洋ナシ": "デクラウド　ペアー"}
# The brand of a name without one; headings of recommended mixes; months as pages write them.
UNKNOWN_BRAND = "不明"
RECOMMENDED_HEADINGS = ["おすすめミックス", "相性が良いフレーバー", "相性の良いフレーバー"]
JAPANESE_MONTHS = {f"{m}月": n for m, n in zip(range(1, 13), "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split(), strict=True)}
# Signs that join two names in a mix.
MIX_SIGNS = ["×", "✕", "x", "X", "+", "＋", "/", "／"]
# Words that end the phrases "A .. B .. verb", "AとB .. verb" and "AにBをverb".
FREE_VERBS = ["ミックス", "混ぜる", "混ぜた", "組み合わせる", "組み合わせた", "組み合わせ", "加える", "加えた", "足す", "足した"]
JOINED_VERBS = ["ミックス", "混ぜる", "混ぜた", "組み合わせる", "組み合わせた", "組み合わせ"]
INTO_VERBS = ["加える", "足す", "混ぜる"]
# Endings that negate a verb in place of its last character.
VERB_NEGATIVES = ["ない", "らない", "なく", "らなく", "なかった", "らなかった", "ません", "らません", "とは思わない", "しない", "できない"]
# Characters around a term within which a negation counts.
AFTER, BEFORE = 8, 4
