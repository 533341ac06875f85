from __future__ import annotations

from quernstone.plans import documents


def test_every_item_is_searched_for_wherever_it_is(spark, tmp_path):
    """More items than any list of bounded size; phrases from inside an item, and items that are shorter than a phrase."""
    items = [(i, f"item {i} asks how many stones the old mill at stream {i} has in its southern wall") for i in range(10_050)]
    items += [(20_000, "ab"), (20_001, "two words"), (20_004, None), (20_005, " "), (20_006, "  " + items[7][1].replace(" ", "\n")), (20_007, "x y " * 9)]
    docs = [(1, "so " + items[10_049][1]), (1, "another row of this id: " + items[7][1]), (None, "no id, cab, ab two  words here"), (3, "two wordsworth cab"), (4, "only its middle: stones the old mill at stream 55 has in its"), (5, "stones the old mill at stream"), (6, ""), (7, None), (8, "x y " * 30)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    phrases = {}
    for i, p in items:
        w = (p or "").split()
        for j in range(max(len(w) - 7, min(len(w), 1))):
            phrases.setdefault(tuple(w[j : j + 8]), set()).add(i)
    want = []
    for d, text in docs:
        w, found = (text or "").split(), {}
        for k in range(1, 9):
            for j in range(len(w) - k + 1):
                for i in phrases.get(tuple(w[j : j + k]), ()):
                    found.setdefault(i, set()).add(tuple(w[j : j + k]))
        want += [(d or 0, i, len(f)) for i, f in found.items()]
    got = documents.contamination_hits(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id or 0, r.item_id, r.n_phrases) for r in got) == sorted(want)
    assert {(1, 10_049), (1, 20_006), (0, 20_000), (0, 20_001), (4, 55), (8, 20_007)} <= {(d, i) for d, i, _ in want}
    assert all(r.context for r in got)
