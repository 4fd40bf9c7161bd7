"""Operator 3: placement of keys on shards by a permutation-filled lookup table.

Each shard has a permutation of the slots of a prime-sized table (offset and skip
from a hash of its name). The shards take turns, each claiming the next free slot
of its permutation, until the table is full; so loads differ by at most one slot,
and adding or removing a shard moves few slots. A key's shard is then one lookup,
table[hash(key) mod size].

The table is small and of fixed size (``slots`` rows, checked), so it is broadcast;
placement is one narrow pass without a shuffle, whatever the distribution of keys.

Defined cases: a null key goes to the slot of the empty string; equal keys
(repeated rows) go to the same shard; an empty table gives no rows; without shards
or with fewer slots than shards a ValueError is raised; a column of df that has the
name of one to be added is a ValueError that tells how to name it otherwise.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_SLOTS = 1 << 20


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def lookup_table(shards: list[str], slots: int) -> list[int]:
    """Index of the owning shard for each slot."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shard names must be given and distinct")
    if not is_prime(slots) or not len(shards) <= slots <= MAX_SLOTS:
        raise ValueError(f"slots must be a prime between the number of shards and {MAX_SLOTS}")
    turns = [(_number(f"offset:{s}") % slots, _number(f"skip:{s}") % (slots - 1) + 1 if slots > 2 else 1) for s in shards]
    taken = [-1] * slots
    at = [0] * len(shards)
    left = slots
    while left:
        for k, (offset, skip) in enumerate(turns):
            while taken[slot := (offset + at[k] * skip) % slots] >= 0:
                at[k] += 1
            taken[slot] = k
            left -= 1
            if not left:
                break
    return taken


def key_slot(key: Column, slots: int) -> Column:
    """Slot of a key: the first 60 bits of its md5, modulo the table's size."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long") % F.lit(slots)


def place(df: DataFrame, key_col: str, shards: list[str], slots: int = 4099, *, prefix: str = "") -> DataFrame:
    """df with columns slot and shard (named with the prefix, where df has such names)."""
    names = [f"{prefix}slot", f"{prefix}shard"]
    if clash := set(names) & set(df.columns):
        raise ValueError(f"df has {sorted(clash)}; give a prefix")
    owners = lookup_table(shards, slots)
    owner = df.sparkSession.createDataFrame([(i, shards[k]) for i, k in enumerate(owners)], f"`{names[0]}` long, `{names[1]}` string")
    slotted = df.withColumn(names[0], key_slot(df[f"`{key_col}`"], slots))
    return slotted.join(F.broadcast(owner), names[0]).select(*[slotted[f"`{c}`"] for c in df.columns], *names)


def write_shards(df: DataFrame, key_col: str, shards: list[str], path: str, slots: int = 4099, files: int = 1, *, shard_col: str = "shard") -> None:
    """One folder for each shard, named by shard_col (a ValueError where df has such a column); the rows' own columns are in the files.

    Rows are dealt by slot and a salt of their content and of the partition they are read in, so a shard, and a row
    that stands in many places, is written by several tasks, and a task that is run again deals alike.
    """
    if shard_col in df.columns:
        raise ValueError(f"df has a column {shard_col}; name another shard_col")
    own = "_"
    while any(c.startswith(own) for c in df.columns):
        own += "_"
    placed = place(df, key_col, shards, slots, prefix=own)
    content = F.xxhash64(*[F.to_json(F.struct(placed[f"`{c}`"])) for c in df.columns])
    salted = placed.withColumn(f"{own}salt", F.pmod(content + F.spark_partition_id(), F.lit(files)))
    dealt = salted.repartition(len(shards) * files, f"{own}shard", f"{own}salt")
    dealt.drop(f"{own}slot", f"{own}salt").withColumnRenamed(f"{own}shard", shard_col).write.partitionBy(shard_col).parquet(path)
