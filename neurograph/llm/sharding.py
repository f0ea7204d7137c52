"""Operator 5, sharding by a permutation-filled lookup table; DataFrame functions only.

Every shard has a preference order of the slots of a table of prime size (an offset and a skip, from hashes of its name). The shards take
turns: each claims the next slot of its order that is free, until the table is full. A key's place is the shard that owns the slot of the
key's hash: one look-up, shards get equal shares to within one turn, and few keys move when a shard comes or goes.

Defined results: a null key is placed like the text ``null``; repeated keys share a place; an empty table gives an empty result; extra
columns stay, and a column called like an output column is replaced.
"""

from __future__ import annotations

import json
from hashlib import md5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from neurograph.llm.common import free_name

#: Largest table that is broadcast.
MOST_SLOTS = 1_048_583


def is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def fill(shards: list[str], slots: int) -> list[int]:
    """Owner of each slot, by number in ``shards``. Driver only; its size is the parameter ``slots``."""
    if not is_prime(slots) or slots > MOST_SLOTS or not 0 < len(shards) <= slots or len(set(shards)) != len(shards):
        raise ValueError(f"the slots must be a prime of at most {MOST_SLOTS}, and the shards distinct and no more than the slots")
    orders = []
    for s in shards:
        d = md5(s.encode()).hexdigest()
        orders.append([int(d[:15], 16) % slots, int(d[15:30], 16) % (slots - 1) + 1])
    table, left = [-1] * slots, slots
    while left:
        for k, order in enumerate(orders[:left] if left < len(orders) else orders):
            at, skip = order
            while table[at] >= 0:
                at = (at + skip) % slots
            table[at], order[0] = k, (at + skip) % slots
            left -= 1
    return table


def slot(key: Column, slots: int) -> Column:
    """A key's slot: 60 bits of its MD5."""
    text = F.coalesce(key.cast("string"), F.lit("null"))
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint"), F.lit(slots))


def place(df: DataFrame, key: str, shards: list[str], slots: int = 65_537) -> DataFrame:
    """``df`` with ``slot`` bigint and ``shard`` string."""
    spark = df.sparkSession
    at = free_name(df, "at")
    owners = spark.range(1).select(F.posexplode(F.from_json(F.lit(json.dumps(fill(shards, slots))), "array<int>")).alias(at, "owner"))
    names = F.from_json(F.lit(json.dumps(shards)), "array<string>")
    lookup = owners.select(F.col(at).cast("bigint").alias(at), names[F.col("owner")].alias("shard"))
    rest = [c for c in df.columns if c.lower() not in ("slot", "shard")]
    placed = df.select(*[df[c] for c in rest], slot(df[key], slots).alias("slot"))
    # at most MOST_SLOTS rows, whatever the size of df
    return placed.join(F.broadcast(lookup), F.col("slot") == F.col(at)).select(*[placed[c] for c in rest], "slot", "shard")
