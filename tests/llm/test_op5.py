from collections import Counter

import pytest

from neurograph.llm import queries, sharding

SF = "/root/testdata/sf0.01"


def brute(shards, slots):
    """Turns taken one by one, over whole preference lists."""
    from hashlib import md5

    lists = []
    for s in shards:
        d = md5(s.encode()).hexdigest()
        offset, skip = int(d[:15], 16) % slots, int(d[15:30], 16) % (slots - 1) + 1
        lists.append([(offset + k * skip) % slots for k in range(slots)])
    table, turn = {}, 0
    while len(table) < slots:
        k = turn % len(shards)
        table[next(s for s in lists[k] if s not in table)] = k
        turn += 1
    return [table[s] for s in range(slots)]


@pytest.mark.parametrize(("n", "slots"), [(1, 7), (3, 7), (7, 7), (5, 101), (16, 251)])
def test_table(n, slots):
    shards = [f"s{k}" for k in range(n)]
    table = sharding.fill(shards, slots)
    assert table == brute(shards, slots)
    counts = Counter(table)
    assert len(counts) == n and max(counts.values()) - min(counts.values()) <= 1


def test_few_keys_move():
    a, b = sharding.fill([f"s{k}" for k in range(16)], 10_007), sharding.fill([f"s{k}" for k in range(15)], 10_007)
    moved = sum(x != y for x, y in zip(a, b, strict=True) if x != 15)
    assert moved < 0.12 * len(a)


def test_bad_parameters():
    for shards, slots in (([], 7), (["a"], 8), (["a", "a"], 7), ([str(k) for k in range(8)], 7)):
        with pytest.raises(ValueError):
            sharding.fill(shards, slots)


def test_query_and_edges(spark, edges, nothing):
    rows = queries.op5_sharding(spark, SF).collect()
    assert len({r.doc_id for r in rows}) == len(rows) == 1000 and len({r.shard for r in rows}) == 64
    df = edges.withColumnRenamed("stats", "Shard")
    out = sharding.place(df, "doc_id", ["a", "b"], 101)
    assert out.columns == ["doc_id", "text", "fp", "slot", "shard"] and out.count() == df.count()
    assert len({(r.doc_id, r.shard) for r in out.collect()}) == len({r.doc_id for r in out.collect()})
    assert sharding.place(nothing, "doc_id", ["a"], 7).count() == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_clashing_names(spark):
    rows = sharding.place(spark.createDataFrame([(1, "a", "b", "c", "d", "e")], "doc_id bigint, slot_ string, shard_ string, at string, owner string, Slot string"), "doc_id", ["x", "y"], 7)
    assert rows.columns == ["doc_id", "slot_", "shard_", "at", "owner", "slot", "shard"]
    assert tuple(rows.first())[:5] == (1, "a", "b", "c", "d")
