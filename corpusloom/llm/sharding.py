"""Sharding by a permutation-filled lookup table.

Every shard has a preference order over the slots of a prime-sized table: a start and a step from hashes of its name,
which visit each slot once. Shards take turns; each claims its most preferred slot that is still free, until none
is. So all shards hold the same number of slots up to one, and with a shard more or less most slots keep their shard.
The table depends on the shard names alone, not on the data: it is broadcast, and a key's slot is a hash modulo its
size.

Defined cases: a null key is placed like the empty string; equal keys go to the same shard; an empty table gives no
rows; the columns of the input stay, but columns named ``slot`` and ``shard`` are replaced.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Slots of the table: a prime, over a hundred times the number of shards for an even load.
SLOTS = 65_537


def hash_of(text: str, salt: str) -> int:
    return int(hashlib.md5(f"{salt}:{text}".encode(), usedforsecurity=False).hexdigest()[:15], 16)


def lookup_table(shards: list[str], slots: int = SLOTS) -> list[int]:
    """For each slot the number of the shard that claimed it."""
    if not shards or len(set(shards)) < len(shards) or len(shards) > slots:
        raise ValueError("shards need distinct names, one at least and no more than there are slots")
    if slots < 2 or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("the number of slots must be prime")
    at = [hash_of(s, "start") % slots for s in shards]
    step = [hash_of(s, "step") % (slots - 1) + 1 for s in shards]
    table, left = [-1] * slots, slots
    while True:
        for number in range(len(shards)):
            while table[at[number]] >= 0:
                at[number] = (at[number] + step[number]) % slots
            table[at[number]] = number
            left -= 1
            if not left:
                return table


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("bigint") % slots


def place(rows: DataFrame, key: str, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """Add ``slot`` and ``shard`` (its name). The broadcast table has ``slots`` rows, whatever the input."""
    table = [(slot, shards[number]) for slot, number in enumerate(lookup_table(shards, slots))]
    claimed = rows.sparkSession.createDataFrame(table, "slot bigint, shard string")
    keyed = rows.drop("slot", "shard").withColumn("slot", slot_of(F.col(f"`{key}`"), slots))
    return keyed.join(F.broadcast(claimed), "slot").select(*[F.col(f"`{c}`") for c in keyed.columns if c != "slot"], "slot", "shard")
