"""P3: mixing sources to target shares by blocks of fixed length.

Every pool (a source's contaminated or clean records) is laid out as one sequence of units, records or
characters, and cut into blocks of fixed length. A plan's output is a number of shards, in groups that each
hold an even part of every pool's slots; the slots of each shard are divided over the pools by multinomial
draws under the condition that the group's totals come out exactly. A slot's block is found through a pseudorandom permutation of the pool's block numbers, a new
one for each pass over the pool, so a pool is used up evenly before anything repeats. Slots and blocks
then meet in one equi-join on (pool, block number).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.operators.scaling import salted_prefix
from tracelake.session import materialise, read, require_columns

#: Characters in a block of a plan sized in characters. A plan sized in records has one record in a block.
BLOCK_CHARS = 256
#: Shards in a group. A group is drawn by one task; its numbers stay far below the limits of the exact draw.
GROUP_SHARDS = 256
#: Plans and sources in one call; both are arguments of the mixer, not data, and are planned on the driver.
MAX_TARGET_ROWS = 100_000

SCHEMA = (
    "plan_id string, source string, is_contamination boolean, shard bigint, slot bigint, original_idx bigint, "
    "start_unit bigint, end_unit bigint, use_no int, size_unit string"
)


def permute(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1 at ``index``: a four-round Feistel network with cycle walking."""
    if n <= 1:
        return np.zeros_like(index)
    half = max(1, (int(n - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & mask
        for r in range(4):
            z = right + np.uint64((key * 0x9E3779B97F4A7C15 + r * 0xBF58476D1CE4E5B9) & (2**64 - 1))
            z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((z ^ (z >> np.uint64(31))) & mask)
        return left << np.uint64(half) | right

    with np.errstate(over="ignore"):
        x = once(index.astype(np.uint64))
        while (out := x >= np.uint64(n)).any():
            x[out] = once(x[out])
    return x.astype(np.int64)


def conditioned_multinomial(totals: list[int], shards: int, rng: np.random.Generator) -> np.ndarray:
    """Counts ``[shard, pool]``: multinomial draws per shard, given that each pool's sum is its total."""
    left = np.array(totals, dtype=np.int64)
    counts = np.zeros((shards, len(totals)), dtype=np.int64)
    for s in range(shards):
        # one hypergeometric draw per pool, given what the pools before it took
        rest = int(left.sum())
        need = rest // (shards - s)
        for k in range(len(totals)):
            if need == 0:
                break
            rest -= int(left[k])
            got = need if rest == 0 else int(rng.hypergeometric(int(left[k]), rest, need))
            counts[s, k] = got
            need -= got
        left -= counts[s]
    return counts


def normal_source(column: str = "source") -> F.Column:
    """Spellings of a source brought together: case, outer blanks and - for _; names are compared whole."""
    return F.nullif(F.regexp_replace(F.lower(F.trim(F.col(column))), "-", "_"), F.lit(""))


def records_of(corpus: DataFrame) -> DataFrame:
    """One narrow row per ``original_idx`` with its source, flag and size; repeated rows count once.

    A record without text and messages can't be used and is left out; so is one without key or source. A
    null flag takes the source's majority (ties: clean).
    """
    require_columns(corpus, "text", "messages", "source", "is_contamination", "original_idx")
    rows = corpus.select(
        "original_idx", normal_source().alias("source"), "is_contamination",
        F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"),
        ((F.length(F.trim(F.coalesce("text", F.lit("")))) > 0) | (F.size(F.coalesce("messages", F.array())) > 0)).alias("usable"),
    ).where("original_idx is not null")
    one = rows.groupBy("original_idx").agg(F.max("source").alias("source"), F.max("is_contamination").alias("flag"), F.max("n_chars").alias("n_chars"), F.max("usable").alias("usable"))
    one = one.where("usable and source is not null")
    major = one.groupBy("source").agg((F.sum(F.when(F.col("flag"), 1).when(~F.col("flag"), -1).otherwise(0)) > 0).alias("major"))
    return one.join(major, "source").select("original_idx", "source", F.coalesce("flag", "major").alias("is_contamination"), "n_chars")


def plan_slots(targets: list, pools: dict) -> list[dict]:
    """For each plan and pool the number of slots.

    ``targets`` are rows of mix_targets, ``pools`` gives units and blocks by (source, flag, unit). Shares
    are percent of ``total_size``; where a plan's add up to more than 100 they are scaled to 100. A
    source's target is divided over its clean and contaminated records as they are available. The
    contaminated targets are scaled down to ``contamination_percentage`` of ``total_size`` and to
    ``contamination_size`` records if they come to more; what a source loses by that its clean records
    take over. No pool gets more slots than its blocks times ``max_repeats`` (null: no limit). A null
    limit doesn't bind; what a source can't fill stays open and shows in the report.
    """
    out = []
    plans: dict = {}
    for t in targets:
        plans.setdefault(t["plan_id"], []).append(t)
    for plan_id, rows in plans.items():
        unit = "records" if (rows[0]["size_unit"] or "records") == "records" else "characters"
        total = rows[0]["total_size"] or 0
        scale = min(1.0, 100.0 / max(sum(max(r["target_share"] or 0, 0) for r in rows), 1e-9))
        want = {}
        for r in rows:
            goal = max(r["target_share"] or 0, 0) * scale / 100 * total
            have = {f: pools.get((r["source"], f, unit), {"units": 0, "records": 0}) for f in (True, False)}
            both = have[True]["units"] + have[False]["units"]
            for f in (True, False):
                want[r["source"], f] = goal * (have[f]["units"] / both if both else float(not f))
        dirty = [k for k in want if k[1] and want[k] > 0]
        used = sum(want[k] for k in dirty)
        limit = np.inf
        if rows[0]["contamination_percentage"] is not None:
            limit = rows[0]["contamination_percentage"] / 100 * total
        if rows[0]["contamination_size"] is not None and dirty:
            in_records = sum(want[k] / max(pools[k[0], True, unit]["units"] / max(pools[k[0], True, unit]["records"], 1), 1e-9) for k in dirty)
            limit = min(limit, rows[0]["contamination_size"] * used / max(in_records, 1e-9))
        if used > limit:
            for k in dirty:
                cut = want[k] * (1 - limit / used)
                want[k] -= cut
                want[k[0], False] += cut
        for r in rows:
            for f in (True, False):
                pool = pools.get((r["source"], f, unit))
                if pool and pool["blocks"]:
                    # the last block of a pool is short
                    slots = round(want[r["source"], f] * pool["blocks"] / pool["units"])
                    if r["max_repeats"] is not None:
                        slots = min(slots, pool["blocks"] * r["max_repeats"])
                    # neighbouring blocks touch the fewest records, which contamination_size counts: a run from a place that the seed picks
                    near = f and unit == "characters" and r["contamination_size"] is not None
                    blocks = min(pool["blocks"], max(int(slots), 1)) if near else pool["blocks"]
                    seed = int(r["mix_seed"] or 0)
                    first = int(np.random.default_rng([seed & 0xFFFFFFFF, *r["source"].encode()]).integers(pool["blocks"])) if near else 0
                    out.append({"plan_id": plan_id, "source": r["source"], "flag": f, "unit": unit, "all": pool["blocks"], "blocks": blocks, "first": first, "slots": int(slots), "seed": seed})
    return out


def mix(corpus: DataFrame, targets: DataFrame, slots_per_shard: int = 1000, buckets: int | None = None) -> DataFrame:
    """``plan_id, source, is_contamination, shard, slot, original_idx, start_unit, end_unit, use_no, size_unit``.

    One row for each piece of a record in a slot. In a plan by records a slot is one record and the units
    are 0 to 1; in one by characters a slot is a block of the pool's joined texts and a row is the part
    of one text in it, characters ``start_unit`` to ``end_unit``. ``use_no`` counts the passes over the
    pool from 0 and stays below ``max_repeats``. Empty corpus or targets give an empty result; sources
    without records, null shares and plans of size 0 give no rows. The same seed gives the same mixture.
    """
    spark = corpus.sparkSession
    rows = targets.select("plan_id", normal_source().alias("source"), "target_share", "max_repeats", "size_unit", "total_size", "contamination_percentage", "contamination_size", "mix_seed").where("plan_id is not null and source is not null").orderBy("plan_id", "source").limit(MAX_TARGET_ROWS + 1).collect()
    if len(rows) > MAX_TARGET_ROWS:
        raise ValueError("too many rows of targets to plan at once")
    names = sorted({r["source"] for r in rows})
    records = records_of(corpus)
    wanted = materialise(records.where(F.col("source").isin(names)) if names else records.limit(0))
    units = wanted.select("original_idx", "source", "is_contamination", F.explode(F.array(
        F.struct(F.lit("records").alias("unit"), F.lit(1).cast("long").alias("size"), F.lit(1).cast("long").alias("block")),
        F.struct(F.lit("characters").alias("unit"), F.col("n_chars").alias("size"), F.lit(BLOCK_CHARS).cast("long").alias("block")),
    )).alias("u")).select("original_idx", "source", "is_contamination", "u.*").where("size > 0")
    pools = {
        (r["source"], r["is_contamination"], r["unit"]): {"units": r["units"], "records": r["records"], "blocks": -(-r["units"] // r["block"])}
        for r in units.groupBy("source", "is_contamination", "unit", "block").agg(F.sum("size").alias("units"), F.count("*").alias("records")).collect()
    }
    planned = plan_slots(rows, pools)
    plans = []
    for plan_id in sorted({p["plan_id"] for p in planned}):
        own = [p for p in planned if p["plan_id"] == plan_id]
        groups = max(1, -(-sum(p["slots"] for p in own) // (slots_per_shard * GROUP_SHARDS)))
        plans.append((plan_id, groups, own[0]["seed"], own[0]["unit"], *([p[c] for p in own] for c in ("source", "flag", "all", "blocks", "first", "slots"))))
    plan_schema = "plan_id string, groups bigint, seed bigint, unit string, sources array<string>, flags array<boolean>, all array<bigint>, blocks array<bigint>, first array<bigint>, totals array<bigint>"

    def fill(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        step = 100_000
        for frame in frames:
            for j in frame.itertuples(index=False):
                g, groups = int(j.group), int(j.groups)
                totals, blocks, pool_blocks, first = ([int(x) for x in c] for c in (j.totals, j.blocks, j.all, j.first))
                # every group gets an even part of each pool's slots
                base = np.array([t * g // groups for t in totals], dtype=np.int64)
                mine = [t * (g + 1) // groups - t * g // groups for t in totals]
                shards = max(1, -(-sum(mine) // slots_per_shard))
                counts = conditioned_multinomial(mine, shards, np.random.default_rng([int(j.seed) & 0xFFFFFFFF, g]))
                before = base + np.cumsum(counts, axis=0) - counts
                for s in range(shards):
                    shard = g * GROUP_SHARDS * 2 + s
                    ends = np.cumsum(counts[s])
                    size = int(ends[-1])
                    for lo in range(0, size, step):
                        slot = np.arange(lo, min(size, lo + step), dtype=np.int64)
                        at = permute(slot, size, int(j.seed) * 1_000_003 + shard)
                        pool = np.searchsorted(ends, at, side="right")
                        nth = at - (ends - counts[s])[pool] + before[s][pool]
                        n = np.asarray(blocks, dtype=np.int64)[pool]
                        use, inner = nth // n, nth % n
                        block = np.zeros(len(slot), dtype=np.int64)
                        for p, u in {*zip(pool.tolist(), use.tolist())}:
                            here = (pool == p) & (use == u)
                            block[here] = (first[p] + permute(inner[here], blocks[p], (int(j.seed) * 4099 + p) * 65_537 + u + 1)) % pool_blocks[p]
                        yield pd.DataFrame({"plan_id": j.plan_id, "source": np.asarray(j.sources, dtype=object)[pool], "is_contamination": np.asarray(j.flags, dtype=bool)[pool], "unit": j.unit, "shard": shard, "slot": slot, "block_no": block, "use_no": use.astype(np.int32)})

    jobs = spark.createDataFrame(plans, plan_schema).withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)))
    slots = jobs.repartition(max(1, min(sum(p[1] for p in plans), 4 * spark.sparkContext.defaultParallelism)), "plan_id", "group").mapInPandas(
        fill, "plan_id string, source string, is_contamination boolean, unit string, shard bigint, slot bigint, block_no bigint, use_no int"
    )
    pieces = salted_prefix(units, ["source", "is_contamination", "unit"], ["original_idx"], F.col("size"), "first", buckets)
    pieces = pieces.withColumn("block_no", F.explode(F.sequence(F.floor(F.col("first") / F.col("block")), F.floor((F.col("first") + F.col("size") - 1) / F.col("block"))))).select(
        "source", "is_contamination", "unit", "block_no", "original_idx",
        F.greatest(F.lit(0).cast("long"), F.col("block_no") * F.col("block") - F.col("first")).alias("start_unit"),
        F.least(F.col("size"), (F.col("block_no") + 1) * F.col("block") - F.col("first")).alias("end_unit"),
    )
    # the planner takes the slots for as small as the jobs they come from, and would send them to every executor
    return slots.hint("merge").join(pieces, ["source", "is_contamination", "unit", "block_no"]).select(
        "plan_id", "source", "is_contamination", "shard", "slot", "original_idx", "start_unit", "end_unit", "use_no", F.col("unit").alias("size_unit")
    )


def report(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per plan and source of ``targets``: the share asked for and reached, sizes, records and most uses."""
    got = mixed.groupBy("plan_id", "source").agg(
        F.sum(F.col("end_unit") - F.col("start_unit")).alias("size"), F.countDistinct("original_idx").alias("n_records"), F.max("use_no").alias("last_use"),
        F.sum(F.when(F.col("is_contamination"), F.col("end_unit") - F.col("start_unit")).otherwise(0)).alias("contaminated"),
    )
    asked = targets.select("plan_id", normal_source().alias("source"), "target_share", "total_size")
    rows = asked.join(got, ["plan_id", "source"], "left")
    all_of = rows.groupBy("plan_id").agg(F.sum("size").alias("plan_size"))
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    return rows.join(all_of, "plan_id").select(
        "plan_id", "source", "target_share", F.round(100.0 * n("size") / F.nullif(n("total_size"), F.lit(0)), 4).alias("share_of_total"),
        F.round(100.0 * n("size") / F.nullif(n("plan_size"), F.lit(0)), 4).alias("share_of_mixture"),
        n("size").alias("size"), n("contaminated").alias("contaminated_size"), n("n_records").alias("n_records"), F.coalesce(F.col("last_use") + 1, F.lit(0)).alias("most_uses"),
    )


def p3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "mixed_corpus"), read(spark, sf_dir, "mix_targets"))


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = read(spark, sf_dir, "mix_targets")
    return report(mix(read(spark, sf_dir, "mixed_corpus"), targets), targets)
