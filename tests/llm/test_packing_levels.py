"""Levels of the packing on pieces too long to share bins."""

from collections import Counter, defaultdict

from corpusweave.llm import packing


def test_long_pieces_stay_in_groups(spark, monkeypatch):
    sizes, whole = [], packing._pack_groups

    def noted(items, groups, capacity, seed):
        out = whole(items, groups, capacity, seed)
        sizes.append(max(r["count"] for r in out.groupBy("pack_group").count().collect()))
        return out

    monkeypatch.setattr(packing, "_pack_groups", noted)
    lengths = [513 + k for k in range(300)] + [1024, 400, 100]
    rows = spark.createDataFrame(list(enumerate(lengths)), "doc_id long, length long")
    got = packing.pack(rows, group_items=16).collect()
    assert max(sizes) < 60, sizes  # about 16 each, by hash
    assert Counter(r.length for r in got) == Counter(lengths)
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for members in map(sorted, bins.values()):
        assert [o for o, _ in members] == [sum(n for _, n in members[:k]) for k in range(len(members))] and sum(n for _, n in members) <= 1024
