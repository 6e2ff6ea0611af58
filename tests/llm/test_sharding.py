import hashlib
from collections import Counter

import pytest

from passagemill.llm import sharding


def plain_table(shards, slots):
    """Whole permutations, claimed by turns."""
    number = lambda what, s: int.from_bytes(hashlib.md5(f"{what}:{s}".encode()).digest()[:8], "big")
    prefer = [[(number("offset", s) + k * (number("step", s) % (slots - 1) + 1)) % slots for k in range(slots)] for s in shards]
    table, turn = {}, 0
    while len(table) < slots:
        own = prefer[turn % len(shards)]
        table[next(p for p in own if p not in table)] = turn % len(shards)
        turn += 1
    return [table[i] for i in range(slots)]


def test_table_matches_whole_permutations():
    for shards, slots in ((["a"], 7), (["a", "b", "c"], 101), ([f"s{i}" for i in range(11)], 211)):
        assert sharding.fill_table(shards, slots) == plain_table(shards, slots)


def test_shares_are_even_and_a_lost_shard_moves_little():
    shards = [f"s{i}" for i in range(20)]
    table = sharding.fill_table(shards, 8191)
    sizes = Counter(table).values()
    assert max(sizes) - min(sizes) <= 1
    fewer = sharding.fill_table(shards[:7] + shards[8:], 8191)
    names = [shards[i] for i in table]
    after = [(shards[:7] + shards[8:])[i] for i in fewer]
    moved = sum(a != b for a, b in zip(names, after) if a != "s7")
    assert moved < 0.1 * 8191


def test_bad_arguments():
    for shards, slots in (([], 7), (["a", "a"], 7), (["a"], 8), (["a", "b", "c"], 2)):
        with pytest.raises(ValueError, match="shard|slots"):
            sharding.fill_table(shards, slots)


def plain_place(key, shards, slots):
    digest = hashlib.md5(("" if key is None else str(key)).encode()).hexdigest()
    slot = int(digest[:15], 16) % slots
    return slot, shards[sharding.fill_table(shards, slots)[slot]]


def test_all_documents_and_odd_rows(spark, sf):
    shards = [f"s{i}" for i in range(8)]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = sharding.place(docs, "doc_id", shards, 1009)
    assert got.columns == [*docs.columns, "slot", "shard"]
    assert all((r.slot, r.shard) == plain_place(r.doc_id, shards, 1009) for r in got.collect())
    odd = spark.createDataFrame([(None, 1), (3, 2), (3, 2)], "doc_id long, slot int")
    rows = sharding.place(odd, "doc_id", shards, 1009).collect()
    assert sorted((r.slot, r.shard) for r in rows) == sorted(plain_place(k, shards, 1009) for k in (None, 3, 3))
    assert sharding.place(odd.limit(0), "doc_id", shards, 1009).count() == 0
    clash = spark.createDataFrame([(1, 2, "x", 3)], "doc_id long, _slot int, _shard string, _at int")
    (row,) = sharding.place(clash, "doc_id", shards, 1009).collect()
    assert (row._slot, row._shard, row._at) == (2, "x", 3) and (row.slot, row.shard) == plain_place(1, shards, 1009)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


def test_written_shards_hold_every_row(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    path = str(tmp_path / "shards")
    sharding.write_shards(docs, "doc_id", ["a", "b", "c"], path, 101, files=2)
    back = spark.read.parquet(path)
    assert back.count() == docs.count()
    assert all(r.shard == plain_place(r.doc_id, ["a", "b", "c"], 101)[1] for r in back.select("doc_id", "shard").collect())
