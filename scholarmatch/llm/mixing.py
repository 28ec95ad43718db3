"""Mixing sources to target weights by Pfair scheduling.

Each source's rows, in a hash order, are cut into blocks of ``block_rows``. A source of weight w gives its block j the
release time floor(j/w) and the deadline ceil((j+1)/w); in every slot the released block with the earliest deadline is
taken (ties: the source that sorts first). As the weights add up to one, every block gets a slot between its release
and its deadline, so at any time a source with rows left is less than one block away from its share. Once a source is
used up its slots stay empty, or go to blocks that are released by then. No row is dropped or repeated.

The weights are the targets themselves to the precision of a double (whole shares of about 2^60), for any number of
sources. One task finds only the state at the start of each stretch of ``STRETCH`` blocks; the stretches are then
scheduled side by side.

Defined cases: a null source is a source of its own; null ids come first in their place of the hash order; repeated
rows follow one another; an empty table gives an empty result; texts are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block.
BLOCK_ROWS = 16
#: Weight of a source without a target, where there are targets.
UNNAMED = 1 / 1024
#: Shares that weights are counted in, about as many as a long holds.
FINE = 1 << 60
#: Blocks of a stretch that is scheduled on its own.
STRETCH = 1024
#: Without given targets a source's weight is its row count to this power.
TEMPERATURE = 0.5


def fine_shares(counts: DataFrame, targets: dict | None, temperature: float) -> DataFrame:
    """source, n, k, idx, q: shares k of all shares q, about ``FINE``; a target of zero counts as none."""
    everything = Window.partitionBy(F.lit(0))  # one row per source
    if targets is not None and any(not 0 <= float(w) < math.inf for w in targets.values()):
        raise ValueError("target weights are finite and not negative")
    if targets is None:
        weight = F.pow(F.col("n").cast("double"), F.lit(float(temperature)))
    else:
        known = [x for s, w in targets.items() if w for x in (F.lit(s), F.lit(float(w)))]
        weight = F.coalesce(F.element_at(F.create_map(*known), F.col("source")) if known else F.lit(None).cast("double"), F.lit(UNNAMED))
    by_name = everything.orderBy(F.col("source").asc_nulls_first())
    part = F.col("weight") / F.sum("weight").over(by_name.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    dealt = counts.withColumn("weight", weight).withColumn("k", F.greatest(F.lit(1), F.round(part * float(FINE)).cast("long")))
    return dealt.select("source", "n", "k", (F.row_number().over(by_name) - 1).alias("idx"), F.sum("k").over(everything).alias("q"))


def blocks_in_slots(share: DataFrame, block_rows: int) -> DataFrame:
    """idx, block, release, deadline, slot, k, q: the earliest-deadline-first schedule of all blocks."""
    never = 1 << 62  # release of a source that is used up
    one = F.struct("idx", "k", F.ceil(F.col("n") / block_rows).cast("long").alias("n"))
    listed = share.agg(F.array_sort(F.collect_list(one)).alias("l"), F.max("q").cast("decimal(19,0)").alias("q")).where("size(l) > 0")
    listed = listed.withColumn("total", F.expr("aggregate(l, 0L, (s, x) -> s + x.n)"))

    def at(j: str, i: str, up: bool) -> str:
        k = f"cast(l[{i}].k as decimal(19,0))"
        return f"((cast({j} as decimal(18,0)) * q{f' + {k} - 1' if up else ''}) div {k})"

    def step(u: str, then: str) -> str:
        """``then`` of the block p (t, d, i) taken in state u: blocks a, their releases r and deadlines d by source, next slot t."""
        ready = f"transform(filter(sequence(0, size(l) - 1), i -> {u}.r[i] <= t), i -> named_struct('t', t, 'd', {u}.d[i], 'i', i))"
        return f"transform(array(greatest({u}.t, array_min({u}.r))), t -> transform(array(array_min({ready})), p -> {then})[0])[0]"

    def after(u: str) -> str:
        j = f"({u}.a[p.i] + 1)"
        more = lambda x: f"if({j} < l[p.i].n, {x}, {never}L)"
        put = lambda f, x: f"transform({u}.{f}, (x, n) -> if(n = p.i, {x}, x))"
        return (
            f"named_struct('a', {put('a', j)}, 'r', {put('r', more(at(j, 'p.i', False)))}, "
            f"'d', {put('d', more(at(f'({j} + 1)', 'p.i', True)))}, 't', p.t + 1)"
        )

    start = f"named_struct('a', array_repeat(0L, size(l)), 'r', array_repeat(0L, size(l)), 'd', transform(sequence(0, size(l) - 1), i -> {at('1', 'i', True)}), 't', 0L)"
    state = "struct<a:array<bigint>,r:array<bigint>,d:array<bigint>,t:bigint>"
    walk = f"aggregate(sequence(1, {STRETCH}), v.u, (u, y) -> {step('u', after('u'))})"
    marks = (
        f"aggregate(sequence(1L, (total + {STRETCH - 1}) div {STRETCH}), named_struct('u', {start}, 'out', cast(array() as array<{state}>)), "
        f"(v, m) -> named_struct('u', {walk}, 'out', concat(v.out, array(v.u)))).out"
    )
    spread = share.sparkSession.sparkContext.defaultParallelism
    begun = listed.selectExpr("l", "q", "total", f"posexplode({marks}) AS (m, u)").repartition(spread, "m")
    block = "named_struct('idx', p.i, 'block', v.u.a[p.i], 'release', v.u.r[p.i], 'deadline', p.d, 'slot', p.t, 'k', l[p.i].k, 'q', q)"
    kind = "array<struct<idx:int,block:bigint,release:bigint,deadline:bigint,slot:bigint,k:bigint,q:decimal(19,0)>>"
    taken = step("v.u", f"named_struct('u', {after('v.u')}, 'out', concat(v.out, array({block})))")
    many = f"sequence(1L, least({STRETCH}L, total - m * {STRETCH}L))"
    return begun.selectExpr(f"aggregate({many}, named_struct('u', u, 'out', cast(array() as {kind})), (v, y) -> {taken}).out AS out").select(F.inline("out"))


def placed(docs: DataFrame, targets: dict | None, block_rows: int, temperature: float, id_col: str, source_col: str) -> DataFrame:
    """The rows of ``docs`` as the struct ``row``, with id, source, _slot, _offset, _block, _release, _deadline, _w."""
    docs = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"))
    counts = docs.groupBy("source").agg(F.count("*").alias("n"))
    most = counts.agg(F.max("n").alias("most")).first()["most"] or 1
    # A source is numbered in chunks of its hash order: as many rows in a chunk as chunks, but 1024 at least.
    digits = max(0, round(math.log(most / max(1024, math.sqrt(most)), 16)))
    hashed = docs.withColumn("_h", F.md5(F.coalesce(F.col("id").cast("string"), F.lit("")))).withColumn("_chunk", F.substring("_h", 1, digits))
    key = F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), F.col("source")))
    hashed = hashed.withColumn("_s", key)
    inner = Window.partitionBy("_s", "_chunk").orderBy("_h", F.col("id").asc_nulls_first())
    sizes = hashed.groupBy("_s", "_chunk").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_s").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_s", "_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    numbered = hashed.withColumn("_in", F.row_number().over(inner)).join(offsets, ["_s", "_chunk"])
    at = F.col("_before") + F.col("_in") - 1
    share = fine_shares(counts, targets, temperature)
    first, last = F.floor(F.col("_before") / block_rows), F.floor((F.col("_before") + F.col("_n") - 1) / block_rows)
    spans = sizes.join(offsets, ["_s", "_chunk"]).select("_s", "_chunk", first.alias("_first"), F.explode(F.sequence(first, last)).alias("block"))
    names = share.select(key.alias("_s"), "idx")
    found = spans.join(blocks_in_slots(share, block_rows).join(names, "idx").drop("idx"), ["_s", "block"])
    # The places of a chunk's blocks come to its rows as one list, so that rows are not dealt out again.
    lists = found.groupBy("_s", "_chunk").agg(
        F.min("_first").alias("_first"), F.array_sort(F.collect_list(F.struct("block", "slot", "release", "deadline", (F.col("k") / F.col("q")).cast("double").alias("w")))).alias("_places")
    )
    done = numbered.withColumn("_block", F.floor(at / block_rows)).withColumn("_offset", F.pmod(at, F.lit(block_rows))).join(lists, ["_s", "_chunk"])
    place = F.element_at("_places", (F.col("_block") - F.col("_first") + 1).cast("int"))
    return done.withColumn("_p", place).select(
        "row", "id", "source", F.col("_p.slot").alias("_slot"), "_offset", "_block", F.col("_p.w").alias("_w"),
        F.col("_p.release").alias("_release"), F.col("_p.deadline").alias("_deadline"),
    )


def mix_schedule(
    docs: DataFrame, targets: dict | None = None, block_rows: int = BLOCK_ROWS, temperature: float = TEMPERATURE,
    id_col: str = "doc_id", source_col: str = "source",
) -> DataFrame:
    """doc_id, source, weight, block, release, deadline, slot, offset: the place of every row in the mix.

    The mix is the order by (slot, offset). ``targets`` maps sources to weights (one not named weighs ``UNNAMED``);
    without it weights are row counts to the power ``temperature``.
    """
    return placed(docs.select(id_col, source_col), targets, block_rows, temperature, id_col, source_col).select(
        F.col("id").alias("doc_id"), "source", F.col("_w").alias("weight"), F.col("_block").alias("block"), F.col("_release").alias("release"),
        F.col("_deadline").alias("deadline"), F.col("_slot").alias("slot"), F.col("_offset").alias("offset"),
    )


def place_rows(
    docs: DataFrame, targets: dict | None = None, block_rows: int = BLOCK_ROWS, temperature: float = TEMPERATURE,
    id_col: str = "doc_id", source_col: str = "source",
) -> DataFrame:
    """All rows of ``docs`` with ``mix_slot`` and ``mix_offset``, in that order: sorted shards, each a stretch of slots, one after the other."""
    mixed = placed(docs, targets, block_rows, temperature, id_col, source_col)
    return mixed.repartitionByRange("_slot", "_offset").sortWithinPartitions("_slot", "_offset").select(
        "row.*", F.col("_slot").alias("mix_slot"), F.col("_offset").alias("mix_offset")
    )


def mix_rows(
    docs: DataFrame, targets: dict | None = None, block_rows: int = BLOCK_ROWS, temperature: float = TEMPERATURE,
    id_col: str = "doc_id", source_col: str = "source",
) -> DataFrame:
    """All rows of ``docs`` in the order of the mix, without their places."""
    mixed = placed(docs, targets, block_rows, temperature, id_col, source_col)
    return mixed.repartitionByRange("_slot", "_offset").sortWithinPartitions("_slot", "_offset").select("row.*")
