import random
import zlib
from collections import Counter, defaultdict

from rulelens.llm.sharding import edit_map, numbered, read_map, shard, slot_bytes, write_map

SCHEMA = "doc_id bigint, text string, shard int, slot bigint, size int, bytes int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, 1, 1, 1) for i, t in rows], SCHEMA)


def sizes_of(spark, sizes):
    return spark.createDataFrame(list(enumerate(sizes)), "slot int, bytes bigint")


def dealt(sizes, shards, previous=None):
    """The map by its definition: `{slot: shard}`."""
    total, loads, held, out, free = sum(sizes), [0] * shards, Counter(), {}, []
    for slot, size in sorted(enumerate(sizes), key=lambda x: (-x[1], x[0])):
        at = previous[slot] if previous else shards
        held[at] += size
        if at < shards and held[at] * shards <= total:
            out[slot] = at
        else:
            free.append(slot)
    for slot, at in out.items():
        loads[at] += sizes[slot]
    for slot in free:
        out[slot] = loads.index(min(loads))
        loads[out[slot]] += sizes[slot]
    return out


def test_rows_map_one_to_one_with_gapless_places(spark):
    rnd = random.Random(2)
    rows = [(i, "é" * rnd.randint(0, 60)) for i in range(3000)] + [(7, "x" * 9000), (8, None), (None, "n"), (None, None), (5, ""), (5, "")]
    got = shard(frame(spark, rows), 16).collect()
    key = lambda x: (x[0] is None, *x[1:], x[0] or 0)
    want = [(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows]
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in got), key=key) == sorted(want, key=key)
    places, bytes_, homes = defaultdict(list), Counter(), defaultdict(set)
    for r in got:
        places[r["shard"]].append((r["slot"], r["doc_id"] is not None, r["doc_id"] or 0))
        bytes_[r["shard"]] += r["size"]
        homes[r["virtual_slot"]].add(r["shard"])
    for own in places.values():
        own.sort()
        assert [p for p, _, _ in own] == list(range(len(own)))
        assert [x[1:] for x in own] == sorted(x[1:] for x in own)
    assert set(places) == set(range(16)) and all(len(h) == 1 for h in homes.values())
    assert max(bytes_.values()) - min(bytes_.values()) < 200
    assert {(r["law"], r["grown_shard"]) for r in got} == {("bytes", None)}


def test_map_is_dealt_and_edited(spark):
    rnd = random.Random(4)
    sizes = [rnd.choice([0, 1, 5, rnd.randint(0, 500)]) for _ in range(300)]
    table = sizes_of(spark, sizes)
    as_dict = lambda m: {r["slot"]: r["shard"] for r in m.collect()}
    first = edit_map(table, 7)
    old = as_dict(first)
    assert old == dealt(sizes, 7)
    for shards in (8, 5):
        new = as_dict(edit_map(table, shards, first))
        assert new == dealt(sizes, shards, old) and set(new.values()) == set(range(shards))
        loads = Counter()
        for slot, at in new.items():
            loads[at] += sizes[slot]
        assert max(loads.values()) - min(loads.values()) <= max(sizes)
    grown = as_dict(edit_map(table, 8, first))
    moved = sum(sizes[s] for s in old if old[s] != grown[s])
    assert moved < sum(sizes) / 8 + 7 * max(sizes)
    sizes[3] += 4000
    assert as_dict(edit_map(sizes_of(spark, sizes), 7, first)) == dealt(sizes, 7, old)


def test_versions_stay(spark, tmp_path):
    folder, docs = str(tmp_path / "map"), frame(spark, [(i, "x" * i) for i in range(200)])
    before = {r["doc_id"]: r["shard"] for r in shard(docs, 4, 64, folder=folder).collect()}
    more = docs.unionByName(frame(spark, [(i, "y" * 50) for i in range(200, 260)]))
    later = {r["doc_id"]: r["shard"] for r in shard(more, 4, 64, folder=folder).collect()}
    assert before.items() <= later.items()
    rows = spark.createDataFrame([(s, 10) for s in range(64)], "slot int, size bigint")
    write_map(edit_map(slot_bytes(rows, 64), 5, read_map(spark, folder, 0)), folder, 1)
    write_map(edit_map(slot_bytes(rows, 64), 2), folder, 1)
    assert {r["shard"] for r in read_map(spark, folder, 1).collect()} == set(range(5))
    assert {r["shard"] for r in read_map(spark, folder, 0).collect()} == set(range(4))


def test_empty_table_and_one_hot_id(spark):
    assert shard(frame(spark, [])).count() == 0
    got = shard(frame(spark, [(1, "same")] * 500 + [(2, "other")]), 3).collect()
    for at in {r["shard"] for r in got}:
        own = sorted(r["slot"] for r in got if r["shard"] == at)
        assert own == list(range(len(own)))
    rows = spark.range(1000).selectExpr("cast(id % 3 as int) as shard", "id div 10 as k", "id as row")
    assert sorted(r["place"] for r in numbered(rows, ["k", "row"]).filter("shard = 1").collect()) == list(range(333))
