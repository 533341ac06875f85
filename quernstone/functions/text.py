"""Scalar text functions as native expressions; NFKC, which Spark lacks, is an Arrow UDF.

White space is Unicode's throughout (Java's \\s and Spark's trim know ASCII only).
"""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import constants as k

SPACE = r"[\s\p{Z}\x{85}\x{1c}-\x{1f}]"


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def utrim(x: Column) -> Column:
    return F.regexp_replace(x, rf"^{SPACE}+|{SPACE}+$", F.lit(""))


def collapse(x: Column) -> Column:
    return utrim(F.regexp_replace(x, rf"{SPACE}+", F.lit(" ")))


def without_marks(x: Column) -> Column:
    """Letters and digits alone, lower case."""
    return F.regexp_replace(F.lower(x), rf"{SPACE}|[\p{{P}}\p{{S}}]", F.lit(""))


def compare_key(x: Column) -> Column:
    """Without white space and a fixed set of signs, lower case; other punctuation stays."""
    return F.regexp_replace(F.lower(nfkc(x)), rf"{SPACE}|[-_/\\|・･.()（）\[\]【】]", F.lit(""))


def heading_key(x: Column) -> Column:
    return without_marks(F.replace(nfkc(x), F.lit("オススメ"), F.lit("おすすめ")))


def sentences(x: Column, marks: str = "。！？!?") -> Column:
    """Pieces that end with a mark or a line, trimmed, none empty."""
    parts = F.split(F.regexp_replace(x, r"\r\n?", F.lit("\n")), rf"(?<=[{marks}])|\n+")
    return F.filter(F.transform(parts, utrim), lambda s: s != "")


def segments(title: Column, context: Column) -> Column:
    """Pieces of title and context between end marks and lines; a middle dot begins a line and stays."""
    whole = F.concat_ws("\n", F.nullif(title, F.lit("")), F.nullif(context, F.lit("")))
    parts = F.split(F.replace(whole, F.lit("・"), F.lit("\n・")), r"[。！？!?\n]")
    return F.filter(F.transform(parts, utrim), lambda s: s != "")


def found_terms(x: Column, terms: list[str]) -> Column:
    """Those terms that x contains, in the terms' order."""
    return F.filter(F.array(*map(F.lit, terms)), lambda t: F.contains(x, t))


def mix_keywords(x: Column) -> Column:
    return found_terms(x, k.MIX_KEYWORDS)


def any_term(x: Column, terms: list[str]) -> Column:
    """Without a lambda, since x may hold a Python function."""
    return F.coalesce(reduce(lambda a, b: a | b, [F.contains(x, F.lit(term)) for term in terms]), F.lit(False))


def merged(values: Column) -> Column:
    """Sorted distinct non-empty values, joined by a bar."""
    return F.array_join(F.array_sort(F.array_distinct(F.filter(values, lambda v: v.isNotNull() & (v != "")))), "|")


def name_and_brand(raw_name: Column, raw_brand: Column) -> tuple[Column, Column]:
    """'flavor - BRAND(..)' in parts; the brand's own column wins, without what is in brackets."""
    own = utrim(F.regexp_replace(F.coalesce(raw_brand, F.lit("")), r"[(（].*$", F.lit("")))
    tail = utrim(F.regexp_extract(raw_name, r"^.*\s-\s([^(（]+)", 1))
    name = utrim(F.regexp_replace(raw_name, r"\s-\s[^-]*$", F.lit("")))
    return name, F.when(own != "", own).when(tail != "", tail).otherwise(F.lit(k.UNKNOWN_BRAND))


def has_japanese(x: Column) -> Column:
    return x.rlike(r"[\x{3040}-\x{30ff}\x{4e00}-\x{9fff}]")


def has_ascii_letters(x: Column) -> Column:
    return x.rlike("[A-Za-z]")


def is_ascii(x: Column) -> Column:
    return x.rlike(r"^[\x00-\x7f]*$")


def canonical_and_patterns(name: Column) -> tuple[Column, Column]:
    """Katakana in brackets wins as the label; Latin names are upper-cased; Latin patterns have three characters at least."""
    inner = utrim(F.regexp_extract(name, r"[(（]([^)）]*[\x{30a0}-\x{30ff}][^)）]*)[)）]", 1))
    outer = utrim(F.regexp_replace(name, r"[(（].*?[)）]", F.lit("")))
    label = F.when(inner != "", inner).when(is_ascii(outer), F.upper(outer)).otherwise(outer)
    latin = F.when(has_ascii_letters(outer) & (F.length(outer) >= 3), F.upper(outer))
    own = F.when(inner != "", inner).when(~is_ascii(outer), outer)
    return label, F.array_distinct(F.array_compact(F.array(own, latin)))


def _latin(x: Column) -> Column:
    """Has ASCII letters and no kana or kanji."""
    return has_ascii_letters(x) & ~x.rlike("[ぁ-んァ-ヶー一-龥]")


def format_key(x: Column) -> Column:
    """Width and white space alike; Latin names in upper case."""
    plain = collapse(nfkc(x))
    return F.when(_latin(plain), F.upper(plain)).otherwise(plain)


def symbol_key(x: Column) -> Column:
    return F.regexp_replace(format_key(x), rf"{SPACE}|[-_–—/・･'\"`´’‘.,&()（）]", F.lit(""))


def singular_key(x: Column) -> Column:
    """Of Latin names, without signs: IES to Y from five characters on; ES, or else S, off from four on."""
    f = format_key(x)
    word = F.regexp_replace(f, "[^A-Z0-9 ]", F.lit(""))
    cut = lambda n: F.left(word, F.length(word) - n)
    ends = lambda tail, least: word.endswith(tail) & (F.length(word) >= least)
    return F.when(~_latin(f), f).when(ends("IES", 5), F.concat(cut(3), F.lit("Y"))).when(ends("ES", 4), cut(2)).when(ends("S", 4), cut(1)).otherwise(word)


def katakana_key(x: Column) -> Column:
    plain = collapse(nfkc(x))
    return F.when(has_ascii_letters(plain), plain).otherwise(F.regexp_replace(plain, rf"{SPACE}|[ー・･]", F.lit("")))


def template_hit(x: Column, regexes: list[str], contains: list[str]) -> Column:
    """The first pattern that matches: regular expressions before plain terms; null if none does."""
    return F.coalesce(*[F.when(x.rlike(r), F.lit(r)) for r in regexes], *[F.when(x.contains(c), F.lit(c)) for c in contains], F.lit(None).cast("string"))


def explicit_mix(sentence: Column, a: Column, b: Column) -> Column:
    """The matched text where both names are joined by a sign, or by a phrase with gaps of at most 12 characters; null otherwise.
    Forms are tried in this order, each with the names in either order: a sign, free gaps, と before the second name, に and を."""
    q = lambda n: F.concat(F.lit(r"\Q"), n, F.lit(r"\E"))
    gap, one_of = r".{0,12}", lambda words: "(?:" + "|".join(words) + ")"
    forms = [(r"\s*[" + "".join(k.MIX_SIGNS) + r"]\s*", ""), (gap, gap + one_of(k.FREE_VERBS)), ("と", gap + one_of(k.JOINED_VERBS)), ("に", "を" + one_of(k.INTO_VERBS))]
    patterns = [F.concat(q(x), F.lit(between), q(y), F.lit(after)) for between, after in forms for x, y in ((a, b), (b, a))]
    hits = [F.nullif(F.call_function("regexp_extract", sentence, p, F.lit(0)), F.lit("")) for p in patterns]
    return F.when(F.contains(sentence, a) & F.contains(sentence, b), F.coalesce(*hits))


def parent_child_reason(a: Column, b: Column) -> Column:
    """Which name's key holds the other's, where the keys differ; blank if neither does."""
    x, y = compare_key(a), compare_key(b)
    within = lambda p, q: F.concat(p, F.lit(" is contained in "), q)
    differ = (x != y) & (x != "") & (y != "")
    return F.when(differ & F.contains(y, x), within(a, b)).when(differ & F.contains(x, y), within(b, a)).otherwise(F.lit(""))


def parent_child(a: Column, b: Column) -> Column:
    return parent_child_reason(a, b) != ""


def role_terms(sentence: Column, actions: list[str], effects: list[str]) -> Column:
    """(rule, action, effect): the first term of each list that occurs; rule: action+effect, action, effect or blank."""
    act, eff = (F.try_element_at(found_terms(sentence, terms), F.lit(1)) for terms in (actions, effects))
    rule = F.concat_ws("+", F.when(act.isNotNull(), "action"), F.when(eff.isNotNull(), "effect"))
    return F.struct(rule.alias("rule"), F.coalesce(act, F.lit("")).alias("action"), F.coalesce(eff, F.lit("")).alias("effect"))


def role_rule(sentence: Column, actions: list[str], effects: list[str]) -> Column:
    return role_terms(sentence, actions, effects)["rule"]


def japanese_date(x: Column) -> Column:
    """'5月 3, 2021' as a date; longer month names are replaced first; null if it isn't one."""
    for month in sorted(k.JAPANESE_MONTHS, key=len, reverse=True):
        x = F.replace(x, F.lit(month), F.lit(k.JAPANESE_MONTHS[month]))
    return F.to_date(F.try_to_timestamp(collapse(x), F.lit("MMM d, yyyy")))


def any_date(x: Column) -> Column:
    return F.coalesce(*[F.to_date(F.try_to_timestamp(utrim(x), F.lit(f))) for f in ("yyyy.M.d", "yyyy-M-d", "yyyy/M/d")])


def ratio_text(n: Column, d: Column) -> Column:
    return F.when(d == 0, F.lit("0/0 (0.0%)")).otherwise(F.format_string("%d/%d (%.1f%%)", n.cast("long"), d.cast("long"), (100 * n / F.nullif(d, F.lit(0))).cast("double")))


def snippet(x: Column, needle: Column, span: int = 100) -> Column:
    """The first occurrence with `span` characters on either side; blank if there is none."""
    at = F.position(needle, x)
    start = F.greatest(at - span, F.lit(1))
    return F.when(at > 0, F.substring(x, start, at - start + F.length(needle) + span)).otherwise(F.lit(""))


def ordered_key(a: Column, b: Column) -> Column:
    """Sorted pair; blank if a member is."""
    ok = (F.coalesce(a, F.lit("")) != "") & (F.coalesce(b, F.lit("")) != "")
    return F.when(ok, F.array_join(F.array_sort(F.array(a, b)), "||")).otherwise(F.lit(""))


def directed_key(a: Column, b: Column) -> Column:
    ok = (F.coalesce(a, F.lit("")) != "") & (F.coalesce(b, F.lit("")) != "")
    return F.when(ok, F.concat_ws(" -> ", a, b)).otherwise(F.lit(""))


def cell_tokens(x: Column) -> Column:
    parts = F.split(x, rf"{SPACE}+|[/／|｜、,，]+")
    return F.filter(F.transform(parts, lambda t: F.regexp_replace(t, "^[・･;；:：]+|[・･;；:：]+$", F.lit(""))), lambda t: t != "")


def is_recommended_heading(x: Column) -> Column:
    return any_term(heading_key(x), k.RECOMMENDED_HEADINGS)


def url_slug(x: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(x, r"[?#].*$", F.lit("")), r"([^/]+)/*$", 1)


def url_domain(x: Column) -> Column:
    return F.lower(F.regexp_extract(x, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1))


def url_plain(x: Column) -> Column:
    return F.regexp_replace(utrim(x), "/+$", F.lit(""))


def heading_list(raw: Column) -> Column:
    return F.coalesce(F.from_json(raw, "array<string>"), F.array().cast("array<string>"))
