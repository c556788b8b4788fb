"""Mixing sources to target weights by cube-method balanced sampling.

A document of a source whose target is r times its size is taken floor(r) times for sure and once more
with probability r - floor(r). The cube method settles those probabilities: a random walk inside the
unit cube along vectors that leave both the token total and the document total unchanged (the null
space of the two constraints over three documents at a time), until every probability is 0 or 1
but for two at most. Large documents walk first, so what is left over is small.

Shards of bounded size walk on their own; what each leaves over (two documents, and ten small ones that are
kept out) is gathered and walks again, level after level, until a source has one shard. What the last walk leaves
is the landing problem: of all roundings, the one nearest to the token total, then to the document total. A document
so much larger than the rest that a walk cannot move it, nor the landing make up for it, is drawn by its own
probability first, and the others' probabilities take up the difference. A source of any size is so many shards, and
every level shrinks by some hundreds.
"""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from gridloom.session import Scratch, lean_group, ship

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, SHARE, CEILING = (3.0, 1.0, 2.0), 1.5, 2.0
#: Documents in a shard, about.
SHARD = 4096
#: Documents kept for the landing.
LANDING = 10
#: Sources up to which their table is broadcast; beyond, it is joined by shuffles.
BROADCAST_SOURCES = 100_000
_EPS = 1e-9


def sizes(docs: DataFrame) -> DataFrame:
    """``docs`` with ``size``: how many words ``[^\\x20\\x09-\\x0D]+`` its text has (null: 0)."""
    return docs.withColumn("size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"))


def targets(sized: DataFrame, scratch: Scratch, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, ceiling: float = CEILING) -> DataFrame:
    """source, source_size, source_docs and target of every source.

    Sources in code-point order, null last, weigh ``weights`` in turn and split ``share`` of all sizes;
    none gets over ``ceiling`` times its size, and what that leaves is split again among the others.
    Ranks come from per-partition counts after a range exchange; only totals reach the driver.
    """
    spark = sized.sparkSession
    found = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_docs"))
    order = (F.col("source").isNull(), F.col("source"))
    held = scratch.save(found.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "sources")
    held = held.withColumn("part", F.shiftright("at", 33))
    counts = held.groupBy("part").agg(F.count("*").alias("n"))
    before = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # one row per partition
    rank = (F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))) % len(weights)
    weight = F.element_at(F.array(*map(F.lit, weights)), (rank + 1).cast("int"))
    held = scratch.save(held.join(F.broadcast(before), "part").select("source", "source_size", "source_docs", weight.alias("weight")), "weights")
    total = held.agg(F.sum("source_size")).first()[0] or 0
    cap, level = F.col("source_size") * ceiling, 0.0
    while True:
        # the level that splits what the capped sources leave; a source once capped stays so
        over = F.col("weight") * level >= cap
        taken, left = held.agg(F.sum(F.when(over, cap).otherwise(0.0)), F.sum(F.when(over, 0.0).otherwise(F.col("weight")))).first()
        new = (share * total - (taken or 0.0)) / left if left else level
        if not left or new <= level * (1 + 1e-12):
            break
        level = new
    return held.select("source", "source_size", "source_docs", F.least(F.col("weight") * level, cap).alias("target"))


def walk(p: list[float], x: list[float], rng: random.Random) -> list[float]:
    """Flight phase for the totals of ``x`` and of documents: at most two entries stay between 0 and 1."""
    live = [k for k in range(len(p)) if _EPS < p[k] < 1 - _EPS]
    held, ahead = live[:3], 3
    while len(held) == 3:
        a, b, c = held
        # u is orthogonal to (1, 1, 1) and to the sizes
        u = (x[c] - x[b], x[a] - x[c], x[b] - x[a])
        if not any(u):
            u = (1.0, -1.0, 0.0)  # equal sizes
        up = down = float("inf")
        for k, v in zip(held, u):
            if v > 0:
                up, down = min(up, (1 - p[k]) / v), min(down, p[k] / v)
            elif v < 0:
                up, down = min(up, p[k] / -v), min(down, (1 - p[k]) / -v)
        step = up if rng.random() * (up + down) < down else -down
        for k, v in zip(held, u):
            p[k] = min(1.0, max(0.0, p[k] + step * v))
        held = [k for k in held if _EPS < p[k] < 1 - _EPS]
        while len(held) < 3 and ahead < len(live):
            held.append(live[ahead])
            ahead += 1
    return p


def land(p: list[float], x: list[float]) -> list[float]:
    """Rounds the last entries: of all roundings, the one whose tokens come nearest to their expectation, then whose documents do."""
    live = [k for k in range(len(p)) if _EPS < p[k] < 1 - _EPS]
    if live:
        bits = (np.arange(1 << len(live))[:, None] >> np.arange(len(live))) & 1
        q, y = np.asarray([p[k] for k in live]), np.asarray([x[k] for k in live])
        off = np.round(np.abs(bits @ y - q @ y), 6), np.abs(bits.sum(axis=1) - q.sum())
        for k, bit in zip(live, bits[np.lexsort((off[1], off[0]))[0]].tolist()):
            p[k] = float(bit)
    return [float(round(v)) for v in p]


def _small(p: list[float], x: list[float]) -> set[int]:
    """LANDING open documents of the smaller half, spread over its sizes (fewer where there are not so many)."""
    live = sorted((k for k in range(len(p)) if _EPS < p[k] < 1 - _EPS), key=lambda k: x[k])
    half = [k for k in live[: max(LANDING, len(live) // 2)] if x[k] > 0]
    return {half[j * len(half) // LANDING] for j in range(LANDING)} if len(half) >= LANDING else set(half)


def thin(p: list[float], x: list[float], rng: random.Random) -> list[float]:
    """A walk that leaves its two documents and the small ones open."""
    out = _small(p, x)
    walked = walk([0.0 if k in out else v for k, v in enumerate(p)], x, rng)
    return [p[k] if k in out else v for k, v in enumerate(walked)]


def draw(p: list[float], x: list[float], k: int, rng: random.Random) -> list[float] | None:
    """Document ``k`` in or out by its probability; the other open ones take up the difference in tokens, each in proportion
    to p (1 - p), so that every probability stays what it was in expectation. Where only one of the two can be made up
    for, it is that one; None where neither can.
    """
    others = [j for j in range(len(p)) if j != k and _EPS < p[j] < 1 - _EPS]
    fits = {1.0: sum(p[j] * x[j] for j in others) >= 2 * (1 - p[k]) * x[k], 0.0: sum((1 - p[j]) * x[j] for j in others) >= 2 * p[k] * x[k]}
    drawn = 1.0 if rng.random() < p[k] else 0.0
    if not fits[drawn]:
        drawn = 1.0 - drawn
        if not fits[drawn]:
            return None
    q = list(p)
    q[k] = drawn
    missing = (p[k] - drawn) * x[k]
    for _ in range(20):  # more than once where probabilities reach 0 or 1
        room = [(j, q[j] * (1 - q[j])) for j in others if _EPS < q[j] < 1 - _EPS]
        total = sum(w * x[j] for j, w in room)
        if abs(missing) < 0.01 or total <= 0:
            break
        step = missing / total
        for j, w in room:
            new = min(1.0, max(0.0, q[j] + step * w))
            missing -= (new - q[j]) * x[j]
            q[j] = new
    return q


def flight(p: list[float], x: list[float], rng: random.Random) -> list[float]:
    """``thin``, once more after each document that it left open and that the small ones could not make up for was drawn."""
    while True:
        left, out = thin(p, x, rng), _small(p, x)
        stuck = [k for k in range(len(p)) if _EPS < left[k] < 1 - _EPS and k not in out]
        large = max(stuck, key=lambda k: x[k], default=None)
        if large is None or min(left[large], 1 - left[large]) * x[large] <= sum(x[k] for k in out) / 4:
            return left
        drawn = draw(p, x, large, rng)
        if drawn is None:
            return left
        p = drawn


def settle(p: list[float], x: list[float], rng: random.Random) -> list[float]:
    """The last walk of a source and its landing, whose 2**(LANDING + 2) roundings hold one close to any total."""
    return land(flight(p, x, rng), x)


def _level(rows: DataFrame, seed: int, last: bool) -> DataFrame:
    """One walk per (source, shard); on the last level also the landing."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "key", "row"], ascending=[False, True, True], kind="stable")
        rng = random.Random(f"{seed}:{int(pdf['source_key'].iloc[0])}:{int(pdf['shard'].iloc[0])}")
        x = pdf["size"].astype(float).tolist()
        p = (settle if last else flight)(pdf["p"].tolist(), x, rng)
        return pdf.assign(p=p)

    return rows.groupBy("source_key", "shard").applyInPandas(lean_group(run), rows.schema)


def sample(docs: DataFrame, scratch: Scratch | None = None, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, ceiling: float = CEILING, seed: int = 6, shard: int = SHARD) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target and copies (0, 1 or 2).

    The copies of a source's documents add up to nearly its target words. A null text has size 0, a
    null source is one of its own, a null doc_id is a document like others; repeated rows are each drawn for
    themselves. Sizes of 0 throughout give targets of 0. The draw depends on the rows alone (ids,
    sizes, sources and the seed), so reruns agree whatever the partitions. An empty table gives no row.
    """
    spark = docs.sparkSession
    ship(spark)
    scratch = scratch or Scratch(spark, "mixing")
    sized = scratch.save(sizes(docs.select("doc_id", "source", "text")).select("doc_id", "source", "size", F.xxhash64("text").alias("tie")), "sizes")
    goal = scratch.save(targets(sized, scratch, weights, share, ceiling), "targets")
    n_sources = goal.count()
    source_key = F.xxhash64(F.coalesce("source", F.lit("")), F.col("source").isNull())
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    goal = goal.select(
        source_key.alias("source_key"), F.col("source").alias("__source"), "source_size", "target",
        F.floor(ratio + 1e-12).cast("long").alias("base"), F.greatest(F.lit(0.0), ratio - F.floor(ratio + 1e-12)).alias("p"),
        F.ceil(F.col("source_docs") / shard).alias("shards"),
    )
    keyed = sized.select("doc_id", "size", "tie", source_key.alias("source_key"))
    joined = keyed.join(F.broadcast(goal) if n_sources <= BROADCAST_SOURCES else goal, "source_key")
    rows = joined.withColumn("key", F.xxhash64("doc_id", "tie", F.lit(seed)))
    # repeated rows are alike, so which of them is which does not matter
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("key", F.lit(1)), "shards")).withColumn("row", F.lit(0).cast("long"))
    left = min(LANDING + 2, shard // 2)
    plain = ["doc_id", "__source", "source_key", "size", "source_size", "target", "base", "key", "row", "shard", "shards", "p"]
    rows = rows.select(*plain)
    settled, number, most = [], 0, int(goal.agg(F.max("shards")).first()[0] or 1)
    open_ = (F.col("p") > _EPS) & (F.col("p") < 1 - _EPS)
    while True:
        last = most <= 1
        walked = scratch.save(_level(rows, seed + number, last), f"level{number}")
        if last:
            settled.append(walked)
            break
        settled.append(walked.where(~open_))
        # a dozen documents of each shard are left: the next level has a shard for every `shard` of them
        most = -(-left * most // shard)
        number += 1
        rows = walked.where(open_).withColumn("shards", F.ceil(F.col("shards") * left / shard)).withColumn("shard", F.pmod(F.xxhash64("key", F.lit(1 + number)), "shards")).select(*plain)
    out = settled[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    return out.select("doc_id", F.col("__source").alias("source"), "size", "source_size", "target", (F.col("base") + F.round("p").cast("long")).alias("copies"))


def mix(docs: DataFrame, scratch: Scratch | None = None, **options) -> DataFrame:
    """The mixture: each row of ``docs`` as often as it was drawn, with its columns.

    Rows are matched to their draws by doc_id, source, size and the hash of their text; of rows alike in
    all of these any may stand for another.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "mixing")
    drawn = sample(docs.select("doc_id", "source", "text"), scratch, **options)
    # rows that are alike share what they drew together
    def keyed(df: DataFrame) -> DataFrame:
        return df.select("*", F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("__d"), F.col("doc_id").isNull().alias("__dn"), F.coalesce("source", F.lit("")).alias("__s"), F.col("source").isNull().alias("__sn"))

    keys = ["__d", "__dn", "__s", "__sn", "__size"]
    total = keyed(drawn.withColumnRenamed("size", "__size")).groupBy(*keys).agg(F.sum("copies").alias("__total"), F.count("*").alias("__n"))
    sized = docs.withColumn("__size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"))
    matched = keyed(sized).join(total, keys)
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.xxhash64(*docs.columns)))
    copies = F.floor(F.col("__total") / F.col("__n")) + (place <= F.col("__total") % F.col("__n")).cast("long")
    return matched.withColumn("__copies", copies.cast("int")).where("__copies > 0").withColumn("__k", F.explode(F.sequence(F.lit(1), "__copies"))).select(*docs.columns)
