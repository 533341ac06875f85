"""Dictionary extraction, negation-aware lexicon matching and the rules over them, as Arrow UDFs over a compiled lexicon.

A lexicon is bounded (a catalogue's names, a few hundred terms) and travels inside the UDF. Offsets are taken on a fold of the
text that keeps its length: a character whose upper case is longer stays as it is.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field
from functools import cached_property

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructField, StructType

from . import constants as k
from . import text as t


def fold(text: str) -> str:
    """Upper case, by character where it would be longer than the text: no character's upper case is shorter than one."""
    if len(whole := text.upper()) == len(text):
        return whole
    return "".join(u if len(u := c.upper()) == 1 else c for c in text)


#: Per boundary dialect: kinds of characters that may not stand before a name, and characters that may all the same.
_DIALECTS = {"particles": ({"Lo", "Ll", "Lu", "Nd"}, k.BOUNDARY), "strict": ({"Lo", "Ll", "Lu", "Nd"}, ""), "letters": ({"Lo"}, "")}


def automaton(keys) -> ahocorasick.Automaton:
    """Over the keys; a match is reported with its key."""
    out = ahocorasick.Automaton()
    for key in keys:
        out.add_word(key, key)
    out.make_automaton()
    return out


def occurrences(machine: ahocorasick.Automaton, text: str):
    """(start, key) of every occurrence, overlapping ones too, in one pass."""
    return [(end + 1 - len(key), key) for end, key in machine.iter(text)] if len(machine) else []


@dataclass
class Dictionary:
    """Patterns and their labels; longer patterns win, equal ones in the order given.

    boundary: "particles" lets hiragana particles stand beside a name, "strict" doesn't, "letters" only minds kana and kanji before it, and
    "word" wants no letter or digit on either side.
    """

    patterns: list[tuple[str, str]]
    boundary: str = "particles"
    least: int = 3
    labels: dict[str, str] = field(init=False)

    def __post_init__(self):
        self.labels = {}
        for p, label in self.patterns:
            if len(p) >= self.least or not p.isascii():
                self.labels.setdefault(fold(p), label)
        self.rank = {p: i for i, p in enumerate(sorted(self.labels, key=len, reverse=True))}

    @cached_property
    def machine(self):
        return automaton(self.labels)

    def __getstate__(self):
        return {name: v for name, v in vars(self).items() if name != "machine"}  # compiled anew in each worker

    def stands_alone(self, text: str, start: int, end: int) -> bool:
        """Whether the dialect sees the occurrence as a name of its own."""
        left, right = text[max(start - 1, 0) : start], text[end : end + 1]
        if self.boundary == "word":
            return not (left.isalnum() or right.isalnum())
        kinds, free = _DIALECTS[self.boundary]
        ideographic = lambda c: bool(c) and unicodedata.category(c) == "Lo"
        held_left = ideographic(text[start]) and bool(left) and unicodedata.category(left) in kinds and left not in free
        held_right = ideographic(text[end - 1]) and ideographic(right) and right not in free
        return not (held_left or held_right)

    def extract(self, text: str | None) -> list[str]:
        """Labels of the occurrences that stand alone and overlap no better one: by pattern, then by place."""
        if not text:
            return []
        hits = [(self.rank[p], a, a + len(p), p) for a, p in occurrences(self.machine, fold(text))]
        if not hits:
            return []
        found, covered = set(), bytearray(len(text))
        for _, a, b, p in sorted(hits):
            if 1 not in covered[a:b] and self.stands_alone(text, a, b):
                covered[a:b] = bytes([1]) * (b - a)
                found.add(self.labels[p])
        return sorted(found)


def extractor(d: Dictionary):
    """Marked as not deterministic, though it is: else the optimizer moves a filter on the names below it and has them looked for twice."""

    @F.pandas_udf(ArrayType(StringType()))
    def run(s: pd.Series) -> pd.Series:
        return s.map(d.extract)

    return run.asNondeterministic()


def plain_key(text: str | None) -> str:
    """compare_key() for a single string."""
    return re.sub(r"[\s\-_/\\|・･.()（）\[\]【】]", "", unicodedata.normalize("NFKC", text or "").lower())


def single_name(d: Dictionary, raw: str | None) -> str:
    """The one name meant by a cell without what is in brackets: of several, the one that the whole cell equals, else the first; blank if none."""
    cell = re.sub(r"[（(].*?[)）]", "", re.sub(r"\s+", " ", unicodedata.normalize("NFKC", raw or "")).strip()).strip()
    names = d.extract(cell)
    return next((n for n in names if plain_key(n) == plain_key(cell)), names[0] if names else "")


def name_candidates(raw: str | None, names: list[str]) -> list[str]:
    """Names whose key holds the cell's key or lies in it: closest in length first, then the shorter, then by name."""
    key = plain_key(raw)
    keyed = [(plain_key(n), n) for n in names] if key else []
    return [n for *_, n in sorted((abs(len(x) - len(key)), len(x), n) for x, n in keyed if x and (key in x or x in key))]


def single_names(d: Dictionary):
    @F.pandas_udf(StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: single_name(d, x))

    return run


def candidates(names: list[str]):
    """The names that a cell may mean, best first."""

    @F.pandas_udf(ArrayType(StringType()))
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: name_candidates(x, names))

    return run


def build_dictionary(catalogue: DataFrame, name_col: str, order_col: str) -> DataFrame:
    """(pattern, canonical, position) of a catalogue: Latin names that one Japanese name alone explains take it; verified
    aliases are added; the first row to claim a pattern keeps it."""
    clean = t.utrim(F.col(name_col))
    rows = catalogue.select(clean.alias("name"), F.col(order_col).alias("position")).filter((F.col("name") != "") & (F.lower("name") != "nan"))
    label, patterns = t.canonical_and_patterns(F.col("name"))
    rows = rows.select("position", label.alias("canonical"), patterns.alias("patterns"))
    latin = rows.select(F.col("canonical").alias("ja"), F.explode("patterns").alias("en")).filter(t.has_japanese(F.col("ja")) & t.has_ascii_letters(F.col("en")))
    one = latin.groupBy("en").agg(F.collect_set("ja").alias("all")).filter(F.size("all") == 1).select("en", F.get("all", F.lit(0)).alias("ja"))
    rows = rows.join(one, rows["canonical"] == one["en"], "left")
    aliases = F.create_map(*[F.lit(x) for kv in k.VERIFIED_ALIASES.items() for x in kv])
    final = F.coalesce("ja", "canonical")
    rows = rows.select("position", final.alias("canonical"), F.array_compact(F.concat(F.array(F.col("ja")), F.col("patterns"), F.array(F.try_element_at(aliases, final)))).alias("patterns"))
    flat = rows.select("position", "canonical", F.explode("patterns").alias("pattern")).filter((F.length("pattern") >= 3) | ~t.is_ascii(F.col("pattern")))
    return flat.groupBy("pattern").agg(F.min_by("canonical", "position").alias("canonical"), F.min("position").alias("position"))


# --- lexicon -----------------------------------------------------------------------------------------------


class Matcher:
    """Groups of terms, all in one automaton with the negations and the terms' negative conjugations."""

    def __init__(self, groups: dict[str, list[str]], negations: list[str]):
        self.groups, self.negations = groups, set(negations) | set(k.HARD_NEGATIONS)
        stems = {t: t[:-1] for terms in groups.values() for t in terms}
        endings = {"い": ["く" + n for n in negations], "る": k.VERB_NEGATIVES}
        self.conjugated = {t: [stem + e for e in endings.get(t[-1:], [])] for t, stem in stems.items()}
        self.plain_negations = set(negations)
        keys = {*stems, *self.negations, *k.SOFT_PREFIXES, *(c for forms in self.conjugated.values() for c in forms)}
        self.machine = automaton(x for x in keys if x)

    def matches(self, text: str) -> dict[str, tuple[list[str], list[str]]]:
        """(plain, negated) occurrences of each group's terms. A term that doesn't occur itself still counts as negated in its negative conjugation."""
        places: dict[str, list[int]] = {}
        for start, key in sorted(occurrences(self.machine, text)):
            at = places.setdefault(key, [])
            if not at or key not in self.conjugated or start >= at[-1] + len(key):  # a term's occurrences don't overlap
                at.append(start)

        def within(keys, lo: int, hi: int) -> bool:
            return any(lo <= a and a + len(key) <= hi for key in keys for a in places.get(key, ()))

        def is_negated(a: int, b: int) -> bool:
            """A negation soon after the term, or one around it that a weakening word before it announces."""
            lo, hi = max(0, a - k.BEFORE), b + k.AFTER
            return within(self.negations, b, hi) or (within(k.SOFT_PREFIXES, lo, a) and within(self.plain_negations, lo, hi))

        out = {}
        for name, terms in self.groups.items():
            plain, against = [], []
            for term in terms:
                for a in places.get(term, ()):
                    (against if is_negated(a, a + len(term)) else plain).append(term)
                if term not in places and any(form in places for form in self.conjugated[term]):
                    against.append(term)
            out[name] = (plain, against)
        return out


def lexicon_matches(text: str, terms: list[str], negations: list[str] = k.NEGATIONS) -> tuple[list[str], list[str]]:
    return Matcher({"": terms}, negations).matches(text)[""]


@dataclass
class Lexicon:
    categories: dict[str, list[str]]
    positive: list[str]
    negative: list[str]
    negations: list[str] = field(default_factory=lambda: list(k.NEGATIONS))

    @cached_property
    def matcher(self) -> Matcher:
        return Matcher({f"c:{name}": terms for name, terms in self.categories.items()} | {"positive": self.positive}, self.negations)

    def __getstate__(self):
        return {name: v for name, v in vars(self).items() if name != "matcher"}

    def analyse(self, text: str | None) -> dict:
        """Negative terms are plain substrings; a negated positive term is negative too."""
        found = self.matcher.matches(text or "")
        plain, against = found.pop("positive")
        listed = lambda side: [f"{name[2:]}:{x}" for name, both in found.items() for x in both[side]]
        return {"matched": listed(0), "negated": listed(1), "has_positive": bool(plain), "has_negative": bool(against) or any(x in (text or "") for x in self.negative)}


LEXICON_TYPE = StructType([StructField("matched", ArrayType(StringType())), StructField("negated", ArrayType(StringType())), StructField("has_positive", BooleanType()), StructField("has_negative", BooleanType())])


def analyser(lexicon: Lexicon):
    """Marked as extractor() is: what is said in a sentence is looked for once."""

    @F.pandas_udf(LEXICON_TYPE)
    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([lexicon.analyse(x) for x in s], columns=["matched", "negated", "has_positive", "has_negative"])

    return run.asNondeterministic()


def matched_context(text: str | None, a: str, b: str, limit: int = 300) -> str:
    """The sentence with both names, else up to four that bridge them, else a stretch of characters, else the text's head."""
    text = text or ""
    parts = [s.strip() for s in re.split(r"(?<=[。！？!?])|\n+", text) if s.strip()]
    for s in parts:
        if a in s and b in s:
            return s[:limit]
    where = [[i for i, s in enumerate(parts) if x in s] for x in (a, b)]
    near = [(abs(i - j), min(i, j), max(i, j)) for i in where[0] for j in where[1]]
    if near and min(near)[0] <= 3:
        _, lo, hi = min(near)
        return " ".join(parts[lo : hi + 1])[:limit]
    at = [x for x in (text.find(a), text.find(b)) if x >= 0]
    return text[max(0, min(at) - 80) : min(at) + 220][:limit] if at else text[:limit]


def contexts(text: Column, a: Column, b: Column) -> Column:
    @F.pandas_udf(StringType())
    def run(x: pd.Series, p: pd.Series, q: pd.Series) -> pd.Series:
        return pd.Series([matched_context(*v) for v in zip(x, p, q, strict=True)])

    return run(text, a, b)
