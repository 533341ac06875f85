"""Secret scans: patterns, and sliding-window entropy over candidate strings. DataFrame functions only.

Three base patterns give spans of kinds assign, access and hex. Kind entropy comes from candidate strings (runs of at least
`window` characters of a token alphabet with both a digit and a letter): Shannon entropy of each window is compared
with the limit of the candidate's character class, and windows above it that overlap or touch are one span. A window's entropy is
log2(window) - sum(c * log2(c)) / window over its characters' counts c; the counts and that sum (in millionths, so that it is
exact) are updated by the one character that enters and the one that leaves. Candidates on the allow-list give no spans.

Positions are in code points, end exclusive. A pattern's places come from one pass that extracts each match with the
gap before it; the pass is anchored at the last match's end, so its time is linear in the text.

Defined results: a null or empty text has no spans; repeated rows get the same answer each; an empty table gives no
rows; other columns stay, those named like a result are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .names import shielded

WINDOW = 20
#: Entropy limits by character class of the whole candidate: lower-case hexadecimal, or any.
LIMITS = {"hex": 3.0, "any": 3.5}
# Texts that mark a placeholder, in lower case.
PLACEHOLDERS = ["example", "placeholder", "changeme", "dummy", "sample", "xxxxxx", "abcdefghij", "0123456789", "1234567890"]
UUID = "^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"


def either(word: str) -> str:
    """A pattern for the word with its ASCII letters in either case."""
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


ASSIGN = "(?:" + "|".join(either(w) for w in ("password", "passwd", "secret", "token", "api_?key")) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "(AKIA[A-Z0-9]{14,})"
HEX = "([0-9a-f]{16,})"
CANDIDATE = "([A-Za-z0-9+/_=-]{%d,})" % WINDOW
_SPAN = "array<struct<start:bigint,kind_no:int,end:bigint,kind:string>>"


def _placed(df: DataFrame, name: str, pattern: str, likely: Column, with_value: bool = False) -> DataFrame:
    """Adds name: (start, hit, value) of each match, in order; `likely` is a cheap test that every text with a match passes.

    The arrays are zipped before any lambda reads them: the optimizer may move a column that a lambda names into the lambda, and
    a pattern would then run once for each match.
    """
    p, none = F.lit(r"(?s)\G(.*?)(" + pattern + ")"), F.array().cast("array<string>")
    part = lambda sure, g: F.when(sure, F.regexp_extract_all(F.col("s_text"), p, F.lit(g))).otherwise(none)
    df = df.withColumn(f"{name}_gap", part(likely, 1))
    some = F.size(f"{name}_gap") > 0
    zipped = F.arrays_zip(F.col(f"{name}_gap").alias("gap"), part(some, 2).alias("hit"), part(some & F.lit(with_value), 3).alias("value"))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<start:bigint,hit:string,value:string>>").alias("all"))

    def step(a: Column, z: Column) -> Column:
        begin = a["at"] + F.length(z["0"])
        one = F.struct(begin.alias("start"), z["1"].alias("hit"), z["2"].alias("value"))
        return F.struct((begin + F.length(z["1"])).alias("at"), F.concat(a["all"], F.array(one)).alias("all"))

    plain = F.transform(zipped, lambda z: F.struct(z["gap"].alias("0"), z["hit"].alias("1"), z["value"].alias("2")))
    return df.withColumn(name, F.aggregate(plain, start, step, lambda a: a["all"])).drop(f"{name}_gap")


def _span(start: Column, end: Column, kind: str, no: int) -> Column:
    return F.struct(start.alias("start"), F.lit(no).alias("kind_no"), end.alias("end"), F.lit(kind).alias("kind"))


def millionths(window: int) -> list[int]:
    """c * log2(c) for each count c, in millionths."""
    return [0] + [round(c * math.log2(c) * 1e6) for c in range(1, window + 1)]


def ceiling(limit: float, window: int) -> int:
    """The largest sum of millionths at which a window's entropy is still at the limit."""
    return math.floor(window * (math.log2(window) - limit) * 1e6)


def entropy_runs(text: Column, top: Column, window: int = WINDOW) -> Column:
    """(first, end) of each run of overlapping or touching windows whose sum is at most `top`.

    State: the counts of the alphabet's characters in the window, their sum in millionths, and the runs so far.
    """
    cost = F.array(*[F.lit(v) for v in millionths(window)])
    at = lambda i: F.instr(F.lit(ALPHABET), F.substring(text, i + 1, F.lit(1)))
    zero = F.struct(
        F.array_repeat(F.lit(0), len(ALPHABET) + 1).alias("counts"),
        F.lit(0).cast("bigint").alias("sum"),
        F.array().cast("array<struct<first:int,end:int>>").alias("runs"),
    )

    def step(a: Column, i: Column) -> Column:
        come, gone = at(i), F.when(i >= window, at(i - window)).otherwise(F.lit(-1))
        moved = F.transform(a["counts"], lambda c, k: c + (k == come).cast("int") - (k == gone).cast("int"))
        before, left = F.get(a["counts"], come), F.get(a["counts"], gone)
        change = F.when(come == gone, F.lit(0)).otherwise(
            F.get(cost, before + 1) - F.get(cost, before) + F.when(gone < 0, F.lit(0)).otherwise(F.get(cost, left - 1) - F.get(cost, left))
        )
        total = a["sum"] + change
        first, last = i - window + 1, F.element_at(F.when(F.size(a["runs"]) > 0, a["runs"]).otherwise(F.array(F.struct(F.lit(-1).alias("first"), F.lit(-1).alias("end")))), -1)
        grown = F.concat(F.slice(a["runs"], F.lit(1), F.size(a["runs"]) - 1), F.array(F.struct(last["first"].alias("first"), (i + 1).alias("end"))))
        new = F.concat(a["runs"], F.array(F.struct(first.alias("first"), (i + 1).alias("end"))))
        above = (i + 1 >= window) & (total <= top)
        runs = F.when(~above, a["runs"]).when(last["end"] >= first, grown).otherwise(new)
        return F.struct(moved.alias("counts"), total.alias("sum"), runs.alias("runs"))

    return F.aggregate(F.sequence(F.lit(0), F.length(text) - 1), zero, step)["runs"]


def allowed(value: Column, placeholders: list[str]) -> Column:
    low = F.lower(value)
    out = value.rlike(UUID)
    for p in placeholders:
        out = out | low.contains(p)
    return out


def scan(df: DataFrame, text_col: str = "text", placeholders: list[str] | None = None, limits: dict[str, float] | None = None) -> DataFrame:
    """Adds base_spans and all_spans, arrays of (start, kind_no, end, kind) in order."""
    placeholders, limits = PLACEHOLDERS if placeholders is None else placeholders, limits or LIMITS
    df, back = shielded(df, "s_", text_col)
    text = F.col("s_text")
    x = df.withColumn("s_text", F.coalesce(F.col(text_col), F.lit("")))
    x = _placed(x, "s_assign", ASSIGN, text.rlike("(?:" + "|".join(either(w) for w in ("pass", "secret", "token", "api")) + ")"), with_value=True)
    x = _placed(x, "s_access", ACCESS, text.contains("AKIA"))
    x = _placed(x, "s_hex", HEX, text.rlike("[0-9a-f]{16}"))
    x = _placed(x, "s_any", CANDIDATE, text.rlike("[A-Za-z0-9+/_=-]{%d}" % WINDOW))
    good = F.filter("s_any", lambda c: c["hit"].rlike("[0-9]") & c["hit"].rlike("[A-Za-z]") & ~allowed(c["hit"], placeholders))
    x = x.withColumn("s_any", good)
    top = lambda c: F.when(c["hit"].rlike("^[0-9a-f]+$"), F.lit(ceiling(limits["hex"], WINDOW))).otherwise(F.lit(ceiling(limits["any"], WINDOW)))
    topped = F.transform("s_any", lambda c: F.struct(c["start"].alias("start"), c["hit"].alias("hit"), top(c).alias("top")))
    x = x.withColumn("s_any", F.transform(topped, lambda c: F.struct(c["start"].alias("start"), entropy_runs(c["hit"], c["top"]).alias("runs"))))
    end = lambda c: c["start"] + F.length(c["hit"])
    base = F.concat(
        F.transform(F.filter("s_assign", lambda c: F.length(c["value"]) >= 12), lambda c: _span(c["start"], end(c), "assign", 0)),
        F.transform("s_access", lambda c: _span(c["start"], end(c), "access", 1)),
        F.transform("s_hex", lambda c: _span(c["start"], end(c), "hex", 2)),
    ).cast(_SPAN)
    more = F.flatten(F.transform("s_any", lambda c: F.transform(c["runs"], lambda r: _span(c["start"] + r["first"], c["start"] + r["end"], "entropy", 3)))).cast(_SPAN)
    x = x.withColumn("base_spans", F.array_sort(base))
    x = x.withColumn("all_spans", F.array_sort(F.concat("base_spans", more)))
    return x.drop("s_text", "s_assign", "s_access", "s_hex", "s_any").withColumnsRenamed(back)


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def counted(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with each stretch of overlapping spans replaced by the mark. A text without spans stays as it is."""
    zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def step(a: Column, s: Column) -> Column:
        gap = F.substring(text, (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int"))
        fresh = (s["start"] >= a["at"]) & ((s["start"] > a["at"]) | (a["at"] == 0))
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.when(fresh, F.concat(a["out"], gap, F.lit(mark))).otherwise(a["out"]).alias("out"))

    done = F.aggregate(spans, zero, step, lambda a: F.concat(a["out"], F.substring(text, (a["at"] + 1).cast("int"), F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)
