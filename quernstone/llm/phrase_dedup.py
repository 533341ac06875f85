"""Removal of passages that an earlier document already has, with sharded Aho-Corasick automata.

A window is `span` consecutive words. Each word covered by a window whose words also stand in a document with a smaller id
goes; windows are judged on the input.

1. Candidates: of each window, the smallest hash among its (span / 2)-word n-grams is its anchor. Equal windows have equal anchors, so a
   window can recur only if its anchor does. Anchors are few (about 1 in 13 words) and summed within tasks.
2. Confirmation: windows with a recurring anchor, by the hash of all their words, keep the smallest id that has them. Which anchors recur
   is told by a broadcast bitmap of fixed size while it is sparse (what it lets through by chance doesn't recur and falls
   out here), and beyond that by a shuffle of anchors and texts.
3. Location: documents are dealt into shards of bounded size. Of a shard's recurring passages, pieces of span / 2 words are compiled
   into an automaton over word numbers; all of the shard's documents stream through it, and the windows around each
   occurrence are looked up among the confirmed ones. Any window of a passage holds one whole piece, so none is missed.

A passage that a third of the documents share is one row a task in the sums, and one phrase in each shard.

Defined results: null or empty texts have no words; repeated rows (equal ids) don't remove each other's words; a row without an id
neither loses words nor costs others any; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import compress

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing
from .scratch import forget, written

SHARD_BYTES = 6 << 20
#: Bits of the bitmap (16 MB), and recurring anchors up to which it is used.
BITS, SPARSE = 1 << 27, 16_000_000
_NO_ID = np.iinfo(np.int64).min


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` consecutive values (the last width - 1 places are not meaningful)."""
    m, have = h.copy(), 1
    while have < width:
        step = min(have, width - have)
        m[: len(m) - step] = np.minimum(m[: len(m) - step], m[step:])
        have += step
    return m


class Windows:
    """Of a chunk of documents: anchor of the window from each word on, and whether there is one."""

    def __init__(self, w: hashing.Words, span: int):
        self.w, half = w, span // 2
        grams, _ = w.grams(half)
        self.anchor = _least(grams, span - half + 1)
        room = np.repeat(w.first[1:], np.diff(w.first)) - np.arange(len(w.hash))
        self.ok = room >= span
        self.doc = np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))


def anchors(df: DataFrame, span: int) -> DataFrame:
    """(anchor, doc_id), repeated where a document has an anchor again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for a, _, w in hashing.chunks(batch.column(1), lower=False):
                x = Windows(w, span)
                at = np.flatnonzero(x.ok)
                if len(at):
                    h, d = x.anchor[at], x.doc[at]
                    new = np.concatenate([[True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])])
                    yield pa.RecordBatch.from_arrays([pa.array(h[new].view(np.int64)), pa.array(ids[a + d[new]])], names=["anchor", "doc_id"])

    return df.filter("doc_id is not null").select("doc_id", "text").mapInArrow(run, "anchor long, doc_id long")


def _members(values: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each value is in the sorted table, and where."""
    at = np.minimum(np.searchsorted(table, values), max(len(table) - 1, 0))
    return (table[at] == values) if len(table) else np.zeros(len(values), bool), at


def _columns(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [table.column(n).to_numpy() for n in names]


def shard_of(ids: np.ndarray, shards: int) -> np.ndarray:
    """As with_shard has it."""
    one, at = np.unique(ids, return_inverse=True)
    return np.array([zlib.crc32(b"%d" % i) % shards for i in one.tolist()], np.int32)[at] if len(ids) else np.empty(0, np.int32)


def _summed(windows: list, owners: list, shards: int) -> dict[str, np.ndarray]:
    """One row for each window and shard: the smallest and the largest id that has it."""
    w, d = (np.concatenate(c) if c else np.empty(0, t) for c, t in ((windows, np.uint64), (owners, np.int64)))
    shard = shard_of(d, shards)
    order = np.lexsort((d, shard, w))
    w, d, shard = w[order], d[order], shard[order]
    first = np.flatnonzero(np.concatenate([[True], (w[1:] != w[:-1]) | (shard[1:] != shard[:-1])])) if len(w) else np.empty(0, np.int64)
    last = np.append(first[1:], len(w)) - 1 if len(w) else first
    return {"window": w[first].view(np.int64), "shard": shard[first], "lo": d[first], "hi": d[last]}


_WINDOWS = "window long, shard int, lo long, hi long"


def windows_by_bitmap(df: DataFrame, bitmap, span: int, shards: int) -> DataFrame:
    """Windows whose anchor's bit is set, summed within each batch. Nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = bitmap.value
        for batch in batches:
            ids, windows, owners = batch.column(0).to_numpy(zero_copy_only=False), [], []
            for a, _, w in hashing.chunks(batch.column(1), lower=False):
                x = Windows(w, span)
                at = np.flatnonzero(x.ok)
                spot = x.anchor[at] % np.uint64(BITS)
                at = at[(bits[spot >> np.uint64(6)] >> (spot & np.uint64(63))) & np.uint64(1) > 0]
                windows.append(w.grams(span)[0][at])
                owners.append(ids[a + x.doc[at]])
            yield pa.RecordBatch.from_pydict({k: pa.array(v) for k, v in _summed(windows, owners, shards).items()})

    return df.filter("doc_id is not null").select("doc_id", "text").mapInArrow(run, _WINDOWS)


def windows_by_shuffle(docs: DataFrame, hits: DataFrame, span: int, shards: int) -> DataFrame:
    """The same, where documents meet their recurring anchors by shard. docs: (shard, doc_id, text); hits: (shard, anchor)."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        known = np.unique(_columns(right, "anchor")[0].view(np.uint64)) if right.num_rows else np.empty(0, np.uint64)
        ids = left.column("doc_id").combine_chunks()
        valid, ids = ids.is_valid().to_numpy(zero_copy_only=False), pc.fill_null(ids, 0).to_numpy()
        windows, owners = [], []
        for a, _, w in hashing.chunks(left.column("text"), lower=False) if len(known) else ():
            x = Windows(w, span)
            at = np.flatnonzero(x.ok & valid[a + x.doc])
            at = at[_members(x.anchor[at], known)[0]]
            windows.append(w.grams(span)[0][at])
            owners.append(ids[a + x.doc[at]])
        return pa.table({k: pa.array(v) for k, v in _summed(windows, owners, shards).items()})

    return docs.groupBy("shard").cogroup(hits.groupBy("shard")).applyInArrow(run, _WINDOWS)


def confirmed_windows(windows: DataFrame) -> DataFrame:
    """(shard, window, owner) for each shard that has the window in a document after its owner, the smallest id of all.

    Equal windows meet once, sorted; they stream through in runs, of which only the owner is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, least = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            w, shard, lo, hi = (batch.column(i).to_numpy() for i in range(4))
            first = np.concatenate([[True], w[1:] != w[:-1]])
            owner = lo[np.maximum.accumulate(np.where(first, np.arange(len(w)), 0))]  # rows of a window are sorted by lo
            if w[0] == current:
                owner[w == current] = least
            current, least = w[-1], owner[-1]
            late = hi > owner
            yield pa.RecordBatch.from_arrays([pa.array(shard[late]), pa.array(w[late]), pa.array(owner[late])], names=["shard", "window", "owner"])

    return windows.repartition("window").sortWithinPartitions("window", "lo").mapInArrow(run, "shard int, window long, owner long")


def phrases(first: np.ndarray, ok: np.ndarray, span: int) -> Iterator[tuple[int, int]]:
    """(start, end) of pieces of span // 2 words that cover the runs of windows starting where `first` is set."""
    half = span // 2
    edge = np.diff(np.concatenate([[False], first, [False]]).astype(np.int8))
    for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True):
        for s in range(a, b + span - half, half):  # words a to b + span - 2; the windows' last piece ends within them
            if s + half <= b + span - 1:
                yield s, s + half


def located(docs: DataFrame, confirmed: DataFrame, span: int) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text) of all documents. confirmed: (shard, window, owner)."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        window, owner = _columns(right, "window", "owner") if right.num_rows else (np.empty(0, np.int64), np.empty(0, np.int64))
        window = window.view(np.uint64)
        order = np.argsort(window)
        window, owner = window[order], owner[order]
        text = left.column("text").combine_chunks()
        ids = left.column("doc_id").combine_chunks()
        number = pc.fill_null(ids, _NO_ID).to_numpy()
        counts, gone, kept = [], [], []
        parts = list(hashing.chunks(text, lower=False))
        automaton, vocabulary = (_compile(parts, window, span) if len(window) else (None, None))
        for a, b, w in parts:
            mask = _covered(w, number[a:b], automaton, vocabulary, window, owner, span) if automaton is not None else np.zeros(len(w.hash), bool)
            for d in range(a, b):
                i, j = int(w.first[d - a]), int(w.first[d - a + 1])
                words = (text[d].as_buffer().to_pybytes() if text[d].is_valid else b"").split()
                lost = int(mask[i:j].sum())
                counts.append(j - i)
                gone.append(lost)
                kept.append(b" ".join(compress(words, (~mask[i:j]).tolist()) if lost else words).decode())
        return pa.table({"doc_id": ids, "n_words": pa.array(counts, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "kept_text": pa.array(kept, pa.string())})

    return docs.groupBy("shard").cogroup(confirmed.groupBy("shard")).applyInArrow(run, "doc_id long, n_words long, n_removed long, kept_text string")


def _compile(parts: list, window: np.ndarray, span: int):
    """The automaton of a shard's recurring passages over word numbers, each taken where the shard has it first."""
    seen, pieces = np.zeros(len(window), bool), []
    for _, _, w in parts:
        x = Windows(w, span)
        at = np.flatnonzero(x.ok)
        found, where = _members(w.grams(span)[0][at], window)
        at, where = at[found], where[found]
        first = np.zeros(len(w.hash), bool)
        _, one = np.unique(where, return_index=True)
        one = one[~seen[where[one]]]
        first[at[one]] = True
        seen[where] = True
        pieces += [w.hash[s:e] for s, e in phrases(first, x.ok, span)]
    vocabulary = np.unique(np.concatenate(pieces)) if pieces else np.empty(0, np.uint64)
    if not pieces:
        return None, vocabulary
    automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH, ahocorasick.KEY_SEQUENCE)
    for p in pieces:
        automaton.add_word(tuple((np.searchsorted(vocabulary, p) + 1).tolist()))
    automaton.make_automaton()
    return automaton, vocabulary


def _covered(w: hashing.Words, number: np.ndarray, automaton, vocabulary, window, owner, span: int) -> np.ndarray:
    """Which words go. The documents of a chunk are one sequence: pieces found across an edge belong to no window."""
    n, half = len(w.hash), span // 2
    known, at = _members(w.hash, vocabulary)
    ends = np.array([e for e, _ in automaton.iter(tuple(np.where(known, at + 1, 0).tolist()))], np.int64) if n else np.empty(0, np.int64)
    near = np.zeros(n + 1, np.int64)  # starts of windows that hold a found piece
    np.add.at(near, np.maximum(ends + 1 - span, 0), 1)
    np.add.at(near, ends + 2 - half, -1)
    x = Windows(w, span)
    starts = np.flatnonzero((np.cumsum(near)[:n] > 0) & x.ok)
    mark = np.zeros(n + 1, np.int64)
    if len(starts):
        found, where = _members(w.grams(span)[0][starts], window)
        starts, where = starts[found], where[found]
        starts = starts[owner[where] < number[x.doc[starts]]]
        np.add.at(mark, starts, 1)
        np.add.at(mark, starts + span, -1)
    return np.cumsum(mark)[:n] > 0


def bitmap_of(often: DataFrame) -> np.ndarray:
    """BITS bits; the driver gets at most one row for each of their BITS / 64 words."""
    spot = F.pmod(F.col("anchor"), F.lit(BITS))
    words = often.select(F.shiftright(spot, 6).alias("word"), F.pmod(spot, F.lit(64)).cast("int").alias("bit"))
    rows = words.groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")).toPandas()
    out = np.zeros(BITS // 64, np.uint64)
    out[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64).view(np.uint64)
    return out


def with_shard(df: DataFrame, shards: int) -> DataFrame:
    """Adds shard, by the id; rows without one go by their text."""
    name = F.col("doc_id").cast("string")
    name = F.coalesce(name, F.md5("text"), F.lit("")) if "text" in df.columns else name
    return df.withColumn("shard", (F.crc32(name.cast("binary")) % shards).cast("int"))


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = 50, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text), a row for each row of df."""
    docs = df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].alias("text"))
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    shards = max(1, -(-int(size) // shard_bytes))
    dealt = with_shard(docs, shards)
    often = written(anchors(docs, span).groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi").select("anchor"), "anchors", large=True)
    if often.count() <= SPARSE:
        windows = windows_by_bitmap(docs, df.sparkSession.sparkContext.broadcast(bitmap_of(often)), span, shards)
    else:
        rows = anchors(docs, span).join(often, "anchor", "left_semi")
        windows = windows_by_shuffle(dealt, with_shard(rows, shards).select("shard", "anchor"), span, shards)
    found = written(confirmed_windows(windows), "windows", large=True)
    forget(often)
    return located(dealt.filter("doc_id is not null"), found.distinct(), span).unionByName(_unchanged(docs.filter("doc_id is null")))


def _unchanged(docs: DataFrame) -> DataFrame:
    """The result's rows for rows without an id, wherever they are: a third of all may lack one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [(x.as_buffer().to_pybytes() if x.is_valid else b"").split() for x in batch.column(1)]
            none = pa.array(np.zeros(len(words), np.int64))
            cols = [batch.column(0), pa.array([len(w) for w in words], pa.int64()), none, pa.array([b" ".join(w).decode() for w in words], pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_words", "n_removed", "kept_text"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_text string")
