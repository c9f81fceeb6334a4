"""Sharding by balanced label propagation, in DataFrame operations only (operator 4).

Documents with equal texts are linked.  Every document starts in a shard that its id
decides; in each round the documents of a group move towards the shard that holds most
of the group, as far as that shard has room: how many may go from one shard to another
is a quota, made of the room left there and of the moves in the opposite direction.
Unlinked documents are neutral, so they come last and fill every shard to its exact
count.  Shards differ by one row at most (law ``rows``).

The rounds work on atoms, the documents of one group in one of 128 residues of the
id's hash.  A group, even one with a third of all rows, has no more atoms than that, so
no task gets an unbounded group; and an atom is a small share of a shard, so a large
group fills shards without being moved whole.  A round's quotas are the only numbers
that reach the driver, shards times shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm._store import freeze

SHARDS = 16
RESIDUES = 128
ROUNDS = 6
#: Documents that are numbered in one task, about.
NUMBERED = 50_000


def base_columns(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and the group of equal texts (null for a null text)."""
    text = F.col("text").cast("string")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.when(text.isNotNull(), F.xxhash64(text)).alias("same"),
    )


def _quota(moves: dict[tuple[int, int], int], room: list[int], shards: int) -> list[list[float]]:
    """The share of the moves from one shard to another that may happen."""
    out = [[0.0] * shards for _ in range(shards)]
    wanted = [sum(moves.get((a, b), 0) for a in range(shards)) for b in range(shards)]
    for (a, b), n in moves.items():
        swapped = min(n, moves.get((b, a), 0))
        free = max(0, room[b]) * n / wanted[b]
        out[a][b] = min(1.0, (swapped + free) / n)
    return out


def _propagate(atoms: DataFrame, targets: list[int], rounds: int) -> DataFrame:
    """``atoms`` (same, text_crc32, size, residue, n, shard) after the rounds."""
    group = ["same", "text_crc32", "size"]
    shards = len(targets)
    for turn in range(rounds):
        held = {r["shard"]: r["n"] for r in atoms.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
        room = [targets[s] - (held.get(s) or 0) for s in range(shards)]
        weights = atoms.groupBy(*group).agg(F.array(*(F.coalesce(F.sum(F.when(F.col("shard") == s, F.col("n"))), F.lit(0)) for s in range(shards))).alias("weight"))
        # The heaviest shard of the group among its own and those with room; ties by a hash that the whole group shares.
        choices = [
            F.when(
                F.lit(room[s] > 0) | (F.col("shard") == s),
                F.struct(F.get("weight", F.lit(s)).alias("w"), F.xxhash64("same", F.lit(s)).alias("tie"), F.lit(s).alias("s")),
            )
            for s in range(shards)
        ]
        wishing = freeze(atoms.join(weights, group).withColumn("wish", F.array_max(F.array_compact(F.array(*choices)))["s"]).drop("weight"), "wishes")
        moves = {(r["shard"], r["wish"]): r["n"] for r in wishing.where("wish != shard").groupBy("shard", "wish").agg(F.sum("n").alias("n")).collect()}
        if not moves:
            return wishing.drop("wish")
        quota = F.array(*(F.array(*map(F.lit, row)) for row in _quota(moves, room, shards)))
        chance = F.pmod(F.xxhash64("same", "residue", F.lit(turn)), F.lit(1 << 20)) / F.lit(1 << 20)
        goes = chance < F.get(F.get(quota, F.col("shard")), F.col("wish"))
        atoms = wishing.withColumn("shard", F.when(goes, F.col("wish")).otherwise(F.col("shard"))).drop("wish")
    return freeze(atoms, "atoms")


def _by_shard(values: list[int], shard: Column) -> Column:
    return F.get(F.array(*(F.lit(v).cast("long") for v in values)), shard)


def _numbered(placed: DataFrame, n_rows: int) -> DataFrame:
    """``placed`` with a gapless ``slot`` in each shard, linked documents first, by sums over small parts."""
    parts = max(1, -(-n_rows // NUMBERED))
    rows = placed.withColumn("part", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(parts)))
    key = ["shard", "single", "part"]
    before = Window.partitionBy("shard").orderBy("single", "part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = rows.groupBy(*key).agg(F.count("*").alias("n")).select(*key, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    own = Window.partitionBy(*key).orderBy("doc_id", "text_crc32", "size")
    return rows.withColumn("nth", F.row_number().over(own)).join(firsts, key).withColumn("slot", F.col("first") + F.col("nth") - 1).drop("part", "nth", "first")


def shard_documents(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """A shard and a slot in it for each row of ``docs`` (doc_id, text), equal texts together as far as shards have room.

    Returns doc_id, size (UTF-8 bytes of the text and 1), text_crc32, law (``rows``),
    shard, slot (from 0 without a gap in each shard) and grown_shard (null under this law).
    A null text has size 1, checksum 0 and no group; empty texts are equal texts;
    repeated rows each get a slot; a null doc_id is a value like others; no rows give no
    rows; further columns are ignored.
    """
    group = ["same", "text_crc32", "size"]
    residue = F.pmod(F.xxhash64("doc_id"), F.lit(RESIDUES)).cast("int")
    rows = freeze(base_columns(docs).withColumn("residue", residue), "documents")
    n_rows = rows.count()
    targets = [n_rows // shards + (s < n_rows % shards) for s in range(shards)]
    cells = freeze(rows.where("same is not null").groupBy(*group, "residue").agg(F.count("*").alias("n")), "cells")
    linked = cells.join(cells.groupBy(*group).agg(F.sum("n").alias("all")).where("all > 1").drop("all"), group)
    # Residues are dealt to shards so that ids with a common factor don't meet.
    start = F.pmod(F.xxhash64("residue"), F.lit(shards)).cast("int")
    atoms = _propagate(freeze(linked.withColumn("shard", start), "atoms"), targets, rounds)
    found = rows.join(atoms.select(*group, "residue", F.col("shard").alias("moved")), [*group, "residue"], "left")
    placed = freeze(
        found.select("doc_id", "size", "text_crc32", F.coalesce("moved", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(shards)).cast("int")).alias("shard"), F.col("moved").isNull().alias("single")),
        "placed",
    )
    held = {r["shard"]: r["n"] for r in placed.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    counts = [held.get(s, 0) for s in range(shards)]
    # What lies beyond a shard's target, unlinked documents first, goes on to the shards that lack rows.
    over = [max(0, c - t) for c, t in zip(counts, targets)]
    lack = [max(0, t - c) for c, t in zip(counts, targets)]
    over_first = [sum(over[:s]) for s in range(shards)]
    lack_first = [sum(lack[:s]) for s in range(shards)]
    numbered = _numbered(placed, n_rows).withColumn("beyond", F.col("slot") - _by_shard(targets, F.col("shard")))
    turn = F.col("beyond") + _by_shard(over_first, F.col("shard"))
    to = F.lit(0)
    for s in range(shards):
        if lack[s]:
            to = F.when(F.col("turn") >= lack_first[s], F.lit(s)).otherwise(to)
    moved = numbered.withColumn("turn", F.when(F.col("beyond") >= 0, turn)).withColumn("to", F.when(F.col("turn").isNotNull(), to))
    slot = F.when(F.col("to").isNotNull(), F.col("turn") - _by_shard(lack_first, F.col("to")) + _by_shard(counts, F.col("to"))).otherwise(F.col("slot"))
    return moved.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.coalesce("to", "shard").alias("shard"), slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def cut_links(sharded: DataFrame) -> DataFrame:
    """How many links between equal texts a sharding cuts (``cut``), of all (``links``); each copy is linked to its group's heaviest shard."""
    cells = sharded.groupBy("text_crc32", "size", "shard").agg(F.count("*").alias("n"))
    groups = cells.groupBy("text_crc32", "size").agg(F.sum("n").alias("n"), F.max("n").alias("most"))
    return groups.where("n > 1").agg(F.sum(F.col("n") - F.col("most")).alias("cut"), F.sum(F.col("n") - 1).alias("links"))
