"""Sharding by a permutation-filled lookup table.

Each shard has its own permutation of the slots of a prime-sized table (an offset and a step taken from its
name). Shards take turns; at its turn a shard claims the first slot of its permutation that is still free.
The filled table spreads slots evenly (shares differ by at most one slot) and changes little when a shard
comes or goes. A row's key hashes to a slot; the table is broadcast, so placing a row is one look-up.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagemill.llm.common import free_names, quoted

#: A prime; at 1,024 shards every shard has 127 or 128 slots.
SLOTS = 131_071
MAX_SLOTS = 4_194_301


def _number(name: str, purpose: str) -> int:
    return int.from_bytes(hashlib.md5(f"{purpose}:{name}".encode()).digest()[:8], "big")


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def fill_table(shards: Sequence[str], slots: int = SLOTS) -> list[int]:
    """For each slot the index of its shard. ``slots`` is a prime, at least the number of shards."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shard names must be given and differ")
    if not is_prime(slots) or not len(shards) <= slots <= MAX_SLOTS:
        raise ValueError(f"slots must be a prime from the number of shards to {MAX_SLOTS}")
    place = [_number(s, "offset") % slots for s in shards]
    step = [_number(s, "step") % (slots - 1) + 1 if slots > 2 else 1 for s in shards]
    table = [-1] * slots
    free = slots
    while True:
        for i in range(len(shards)):
            at = place[i]
            while table[at] >= 0:
                at = (at + step[i]) % slots
            table[at] = i
            place[i] = (at + step[i]) % slots
            free -= 1
            if not free:
                return table


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """60 bits of the MD5 of the key as text, modulo the table's size; a null key hashes as the empty text."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long"), F.lit(slots)).cast("int")


def place(df: DataFrame, key: str, shards: Sequence[str], slots: int = SLOTS) -> DataFrame:
    """``df`` with ``slot`` int and ``shard`` string (columns of these names are replaced).

    Every row and every other column is kept: null keys go to the slot of the empty text, equal keys to the same shard, an empty
    table gives no rows. No shuffle; the broadcast table has ``slots`` rows, at most ``MAX_SLOTS``.
    """
    at, name = free_names(df, "at", "name")
    table = pa.table({at: pa.array(range(slots), pa.int32()), name: [shards[i] for i in fill_table(shards, slots)]})
    lookup = F.broadcast(df.sparkSession.createDataFrame(table))
    rest = df.drop("slot", "shard") if key not in ("slot", "shard") else df
    placed = rest.withColumn(at, slot_of(F.col(key), slots)).join(lookup, at)
    return placed.withColumns({"slot": F.col(at), "shard": F.col(name)}).drop(at, name)


def write_shards(df: DataFrame, key: str, shards: Sequence[str], path: str, slots: int = SLOTS, files: int = 1) -> None:
    """Parquet with one folder per shard and up to ``files`` files in each.

    Rows are dealt by (shard, salt), the salt being a further hash of the whole row, so that a key that
    holds a third of the rows can be written by ``files`` tasks.
    """
    placed = place(df, key, shards, slots)
    (salt,) = free_names(placed, "salt")
    dealt = placed.withColumn(salt, F.pmod(F.xxhash64(*quoted(df.columns)), F.lit(files)))
    dealt.repartition("shard", salt).drop(salt).write.partitionBy("shard").parquet(path)
