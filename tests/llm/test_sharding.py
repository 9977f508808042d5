import random
import zlib
from collections import Counter, defaultdict

import pytest

from corpusmill.llm.sharding import best_fit, pack, shard_by_size


def test_best_fit_takes_the_tightest_bin():
    assert best_fit([(6, 0), (5, 1), (4, 2), (3, 3)], 2, 9) == {0: 0, 1: 1, 2: 1, 3: 0}
    assert best_fit([(6, 0), (5, 1)], 1, 9) is None
    assert pack([], 3) == {}
    rng = random.Random(2)
    sizes = [(rng.randint(1, 100), i) for i in range(2000)]
    load = Counter()
    for parcel, b in pack(sizes, 24).items():
        load[b] += dict((p, s) for s, p in sizes)[parcel]
    mean = sum(s for s, _ in sizes) / 24
    assert max(load.values()) <= 1.01 * mean and min(load.values()) >= 0.97 * mean


@pytest.mark.parametrize("parcels", [1, 512])
def test_rows_sizes_groups_and_slots(docs, rows, parcels):
    got = shard_by_size(docs, shards=4, parcels=parcels).collect()
    exp = Counter((r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert Counter((r["id"], r["size"], r["text_crc32"]) for r in got) == exp
    slots, groups = defaultdict(list), defaultdict(set)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        groups[r["text_crc32"]].add(r["shard"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(4))
    assert all(len(g) == 1 for g in groups.values())


def test_near_equal_on_many_groups(spark):
    rng = random.Random(3)
    df = spark.createDataFrame([(i, "x" * rng.randint(1, 900) + str(i)) for i in range(3000)] +
                               [(9000 + i, "copy" * 20) for i in range(60)], "doc_id long, text string")
    load = Counter()
    for r in shard_by_size(df, shards=24).collect():
        load[r["shard"]] += r["size"]
    mean = sum(load.values()) / 24
    assert len(load) == 24 and max(load.values()) <= 1.01 * mean and min(load.values()) >= 0.95 * mean


def test_empty(empty):
    assert shard_by_size(empty).count() == 0
