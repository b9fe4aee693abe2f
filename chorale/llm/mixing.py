"""Mixing sources to target weights by Pfair scheduling, in DataFrame functions only.

A task i with weight w_i owns a sequence of blocks; its block j (from 0) is released at floor(j / w_i) and due at
ceil((j + 1) / w_i). Each slot takes the released block with the earliest deadline, so after t slots a task has had more than
w_i * t - 1 and less than w_i * t + 1 blocks. Weights are shares of a cycle of q slots, so the schedule repeats after q slots.

Sources that have a target are tasks of their own. All others have the same share and are one task, whose slots they take by
turns: of K slots each gets K / n of them, rounded up or down, so together with the task's own deviation, of which it bears an
n-th, a source still deviates by less than one block. Only the slots of sources with a target are worked out, by a fold with a
step for each of them: the earliest slot at which one is released and either due no later than the others' next block or faced
by none that is released follows by arithmetic, and the slots between belong to the others. So the work and the memory of the
schedule depend on the targets, however many sources there are.

Rows of a source are put in a shuffled but fixed order by a hash of doc_id. A row's rank in its source comes from counts of
(source, hash range), so that a source with most of the rows is spread over many tasks; blocks follow from ranks, and slots
from blocks by arithmetic. A source that runs out leaves its later slots empty, the others keep their proportions, and position
numbers the rows without gaps, by sums over ranges of slots. No row is dropped or repeated.

Defined results: a null source is a source of its own, named by null; sources without a target share the rest weight each;
rows with the same doc_id are ordered among each other arbitrarily but all kept, and rows without one go by their other columns
(equal rows stay together, in one task); an empty table gives an empty result; columns named mix_block, mix_slot or mix_position
are replaced, others are kept whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .util import small, table, with_known

#: Shares of the sources in the mix, and of any source that isn't named.
TARGETS = {"src0": 8, "src1": 6, "src2": 5, "src3": 4}
REST = 3
BLOCK_ROWS = 32
#: Rows in a hash range of a source and sources in a range of them, about; and how many ranges there are at most.
RANGE_ROWS, RANGES = 500, 1 << 20
#: Blocks in a range of slots, about.
RANGE_BLOCKS = 50_000
MADE = ("mix_block", "mix_slot", "mix_position")


def hash_range(h: Column, ranges: int) -> Column:
    """Which of so many equal ranges a hash of hexadecimal digits falls in."""
    return F.shiftright(F.conv(F.substring(h, 1, 8), 16, 10).cast("long") * ranges, 32)


def source_key(source: Column) -> Column:
    return F.struct(source.isNull().alias("none"), F.coalesce(source.cast("string"), F.lit("")).alias("name"))


def numbered(others: DataFrame, n: int, range_rows: int) -> DataFrame:
    """others(sk, ...), n in number, with m: their numbers from 0, by hash."""
    h = F.md5(F.col("sk.name").cast("binary"))
    at = others.withColumn("h", h).withColumn("part", hash_range(F.col("h"), max(1, -(-n // range_rows))))
    # a row for each range: the sums over all of them are one task's work
    before = F.sum("k").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = table(at.groupBy("part").agg(F.count(F.lit(1)).alias("k")).select("part", F.coalesce(before, F.lit(0)).alias("start"), "k"))
    local = F.row_number().over(Window.partitionBy("part").orderBy("h", "sk")) - 1
    return with_known(at.withColumn("local", local), starts, ["part"], "k").select("sk", "n", "share", "named", (F.col("start") + F.col("local")).alias("m"))


def schedule(named: DataFrame, rest_slots: int) -> DataFrame:
    """named(source, share) and the others' slots in a cycle -> source, share, j (block of the cycle) and slot; the others have the slots left over."""
    listed = named.agg(F.array_sort(F.collect_list(F.struct(F.col("source").isNull().alias("last"), "source", "share"))).alias("s"))
    listed = listed.selectExpr("s", "aggregate(s, 0L, (a, x) -> a + x.share) AS own").where("own > 0").selectExpr("s", "own", f"own + {rest_slots}L AS q", f"{rest_slots}L AS r")
    # n blocks are placed so far, the next slot is t, and source i comes to its block k[i], released at {begin} and due at {due}
    begin, due = "((a.k[i] * q) div x.share)", "(((a.k[i] + 1) * q + x.share - 1) div x.share)"
    alone = "((r + a.n * q + own - 1) div own)"  # from here on, the others' next block isn't released if they get all slots before
    first = f"array_min(transform(s, (x, i) -> greatest(a.t, {begin}, least({alone}, a.n + (r * ({due} - 1)) div q))))"
    pick = f"array_min(filter(transform(s, (x, i) -> if({begin} <= at, named_struct('d', {due}, 'i', i), null)), v -> v is not null)).i"
    fold = f"""aggregate(sequence(1L, own), named_struct('n', 0L, 't', 0L, 'k', transform(s, x -> 0L), 'took', cast(array() as array<struct<i: int, j: bigint, slot: bigint>>)),
        (a, step) -> element_at(transform(array({first}), at -> element_at(transform(array({pick}), chosen -> named_struct(
            'n', a.n + 1, 't', at + 1, 'k', transform(a.k, (k, i) -> k + if(i = chosen, 1L, 0L)),
            'took', concat(a.took, array(named_struct('i', chosen, 'j', a.k[chosen], 'slot', at))))), 1)), 1),
        a -> a.took)"""
    return listed.select("s", F.explode(F.expr(fold)).alias("x")).selectExpr("s[x.i].source AS source", "s[x.i].share AS share", "x.j AS j", "x.slot AS slot")


def share_of(targets: dict[str, int], rest: int) -> tuple[Column, Column]:
    """The share of a source, and whether it has a target."""
    share, named = F.lit(rest), F.lit(False)
    for name, p in targets.items():
        share, named = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(p)).otherwise(share), named | F.col("source").eqNullSafe(F.lit(name))
    return share.cast("long"), named


def slots(sources: DataFrame, targets: dict[str, int], rest: int, range_rows: int) -> tuple[DataFrame, Column]:
    """sources(sk, n, share, named) with m and taken, and the slot of the block b of such a row."""
    others = sources.where("not named")
    n_others = others.count() if rest > 0 else 0
    per_cycle = rest * n_others
    own = schedule(sources.where("named").select(F.col("sk.name").alias("name"), F.col("sk.none").alias("none"), "share").select(F.when(~F.col("none"), F.col("name")).alias("source"), "share"), per_cycle)
    own = table(own)
    q = per_cycle + (sources.where("named").agg(F.sum("share")).first()[0] or 0)
    # the slots of a source with a target; their number depends on the targets only
    of = own.groupBy(source_key(F.col("source")).alias("sk")).agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "slot"))), lambda x: x["slot"]).alias("own"))
    with_target = sources.where("named").join(F.broadcast(of), "sk", "left").withColumn("m", F.lit(0).cast("long"))
    gaps = F.array_sort(F.array(*[F.lit(r.slot).cast("long") for r in own.select("slot").collect()]).cast("array<bigint>"))
    without = numbered(others, n_others, range_rows).withColumn("own", F.lit(None).cast("array<bigint>"))
    every = with_target.select("sk", "n", "share", "named", "m", "own").unionByName(without.select("sk", "n", "share", "named", "m", "own")) if n_others else with_target
    turn = F.col("b") * n_others + F.col("m")
    k = F.pmod(turn, F.lit(max(per_cycle, 1)))
    free = k + F.size(F.filter(gaps, lambda s, i: s - i <= k))
    slot = F.when(F.col("named"), F.expr("b div share") * q + F.expr("own[cast(b % share as int)]")).otherwise(F.expr(f"(b * {n_others}L + m) div {max(per_cycle, 1)}L") * q + free)
    return every, slot.cast("long")


def mix(df: DataFrame, targets: dict[str, int] = TARGETS, rest: int = REST, block_rows: int = BLOCK_ROWS, range_rows: int = RANGE_ROWS) -> DataFrame:
    """df with mix_block (number of the block in its source), mix_slot (where the block stands in the mix) and mix_position.

    All columns are kept; a source whose share is zero isn't in the mix. Positions count rows of all sources in the order of
    slots, and within a block in the order of ranks.
    """
    own_columns = [c for c in df.columns if c not in MADE]
    h = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.xxhash64(*[F.col(f"`{c}`") for c in own_columns]).cast("string")).cast("binary"))
    share, named = share_of(targets, rest)
    counts = df.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    sources = table(counts.select(source_key(F.col("source")).alias("sk"), "n", share.alias("share"), named.alias("named")).where("share > 0"))
    total = sources.agg(F.sum("n")).first()[0] or 0
    part = hash_range(h, min(RANGES, max(1, -(-total // range_rows))))
    # a row's own columns travel as one, so that their names don't matter here
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in own_columns]).alias("row"), source_key(F.col("source")).alias("sk"), F.col("doc_id").alias("id"), h.alias("h"), part.alias("part"))
    known = rows.groupBy("sk", "part").agg(F.count(F.lit(1)).alias("k"))
    before = F.sum("k").over(Window.partitionBy("sk").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    start = table(known.select("sk", "part", F.coalesce(before, F.lit(0)).alias("start"), "k"))
    told, slot = slots(sources, targets, rest, range_rows)
    told = table(told.withColumn("parts", F.least("n", F.lit(RANGES))))
    # blocks begin in the ranges of their source, so no list of a source's blocks is made
    of = with_known(start, told, ["sk"], "parts").where("share is not null")
    first, last = F.ceil(F.col("start") / block_rows).cast("long"), F.floor((F.col("start") + F.col("k") - 1) / block_rows).cast("long")
    blocks = of.where(first <= last).select("sk", "n", "share", "named", "m", "own", F.explode(F.sequence(first, last)).alias("b"))
    blocks = blocks.select("sk", "b", slot.alias("slot"), F.least(F.lit(block_rows), F.col("n") - F.col("b") * block_rows).alias("rows"))
    n_blocks = total // block_rows + told.count()
    ranges = max(1, -(-n_blocks // RANGE_BLOCKS))
    placed = table(blocks.repartitionByRange(ranges, "slot").withColumn("at", F.spark_partition_id()))
    # rows in earlier slots: those of earlier ranges, and of earlier slots of the same range
    sums = placed.groupBy("at").agg(F.sum("rows").alias("k")).select("at", F.coalesce(F.sum("k").over(Window.orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("behind"))
    inside = F.coalesce(F.sum("rows").over(Window.partitionBy("at").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = placed.select("sk", "b", "slot", "at", inside.alias("inside")).join(small(sums, ranges), "at")
    placed = table(placed.select(F.col("sk").alias("b_sk"), "b", "slot", (F.col("behind") + F.col("inside")).alias("ahead")))
    marks = small(start.select(F.col("sk").alias("s_sk"), F.col("part").alias("s_part"), "start"), start.count())
    rows = rows.join(marks, (F.col("sk") == F.col("s_sk")) & (F.col("part") == F.col("s_part")))
    local = F.row_number().over(Window.partitionBy("sk", "part").orderBy("h", "id")) - 1
    rows = rows.withColumn("rank", F.col("start") + local).withColumn("mix_block", F.floor(F.col("rank") / block_rows).cast("long"))
    out = rows.join(small(placed, placed.count()), (F.col("sk") == F.col("b_sk")) & (F.col("mix_block") == F.col("b")))
    return out.select("row.*", "mix_block", F.col("slot").alias("mix_slot"), (F.col("ahead") + F.col("rank") - F.col("mix_block") * block_rows).alias("mix_position"))


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each document stands in the mix; the texts themselves needn't be read for that."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source"))


ORACLE = {
    # slot by slot: sources with a target in order of name, and behind them all others as one task, whose slots go round
    "op1_mix_sources": """
        with recursive src as (
            select source, count(*) as n, case source when 'src0' then 8 when 'src1' then 6 when 'src2' then 5 when 'src3' then 4 end::bigint as p
            from documents group by source),
        others as (select source, row_number() over (order by md5(coalesce(source, '')), source nulls last) - 1 as m from src where p is null),
        tasks as (select source, p, false as all_others from src where p is not null
                  union all select null, (select count(*) from others) * 3, true where (select count(*) from others) > 0),
        lists as (select list(p order by all_others, source) as p, list(source order by all_others, source) as names, list(all_others order by all_others, source) as o, sum(p)::bigint as q from tasks),
        sched(t, served, i) as (
            select 0::bigint, list_transform(p, lambda x: 0::bigint), 0::bigint from lists
            union all
            select t + 1, list_transform(served, lambda k, j: k + case when j = pick then 1 else 0 end), pick
            from (select t, served, list_sort(list_filter(list_transform(served, lambda k, j:
                      case when (k * q) // p[j] <= t then {'d': ((k + 1) * q + p[j] - 1) // p[j], 'j': j} end), lambda x: x is not null))[1].j as pick
                  from sched, lists where t < q)),
        cyc as (select t - 1 as slot, names[i] as source, o[i] as all_others, p[i] as p, q, row_number() over (partition by i order by t) - 1 as j from sched, lists where t > 0),
        ranked as (select doc_id, source, row_number() over (partition by source order by md5(coalesce(cast(doc_id as varchar), '')), doc_id) - 1 as rank from documents),
        turns as (
            select doc_id, r.source, rank, m is not null as all_others,
                   case when m is null then rank // 32 else (rank // 32) * (select count(*) from others) + m end as turn
            from ranked r left join others on r.source is not distinct from others.source),
        placed as (
            select doc_id, r.source, rank, rank // 32 as mix_block, (turn // p) * q + slot as mix_slot
            from turns r join cyc on r.all_others = cyc.all_others and (r.all_others or r.source = cyc.source) and turn % p = j)
        select doc_id, source, mix_block, mix_slot, row_number() over (order by mix_slot, rank) - 1 as mix_position from placed"""
}
QUERIES = {"op1_mix_sources": op1_mix_sources}
