"""Mixing sources to target weights by Pfair scheduling.

A source's rows form blocks of BLOCK_ROWS. With weight w its k-th block (from 0) is released at slot floor(k / w) and due
before slot ceil((k + 1) / w); in every slot the released block with the earliest deadline goes, so in each prefix of a
phase each source is less than one block from its share. Small whole weights repeat after a period, so one period is
simulated; all others are simulated as the exact rational numbers that they are. When a source has no block left, a new phase begins with the weights of
the others in proportion. No row is dropped or repeated.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hindcast.llm.common import shared_dir

BLOCK_ROWS, EXPONENT = 16, 0.5
#: Rows in a numbering bucket of a source; so many rows of a source meet in one task, however large the source is.
BUCKET_ROWS = 1000
#: Whole weights of so many sources at most, that add up to so much at most, are laid out by their period.
MOST_SOURCES, MOST_PERIOD = 500, 10_000
#: Slots of the schedule that the driver holds at once.
PIECE = 1 << 18


def one_period(shares: dict) -> dict:
    """The slots of each source's blocks in one period, by earliest deadline among the released ones."""
    period = sum(shares.values())
    names = sorted(shares, key=str)
    released, waiting = [], [(0, -(-period // shares[s]), n, 0) for n, s in enumerate(names)]
    heapq.heapify(waiting)
    slots: dict = {s: [] for s in names}
    for slot in range(period):
        while waiting and waiting[0][0] <= slot:
            _, due, n, k = heapq.heappop(waiting)
            heapq.heappush(released, (due, n, k))
        due, n, k = heapq.heappop(released)
        slots[names[n]].append(slot)
        share = shares[names[n]]
        if k + 1 < share:
            heapq.heappush(waiting, ((k + 1) * period // share, -(-(k + 2) * period // share), n, k + 1))
    return slots


def phases(blocks: dict, shares: dict) -> list[tuple]:
    """(source, first, end, start, share, period, slots): blocks first..end of the source run in slots from start on."""
    done, start, out, every = dict.fromkeys(blocks, 0), 0, [], shares
    while left := [s for s in blocks if done[s] < blocks[s]]:
        shares = {s: every[s] for s in left}
        slots, length = one_period(shares), sum(shares.values())
        at = lambda s, k: k // shares[s] * length + slots[s][k % shares[s]]
        stop = min(at(s, blocks[s] - done[s] - 1) for s in left) + 1
        for s in left:
            n = stop // length * shares[s] + sum(x < stop % length for x in slots[s])
            out.append((s, done[s], done[s] + n, start, shares[s], length, slots[s]))
            done[s] += n
        start += stop
    return out


def simulated(blocks: dict, weights: dict, piece: int = PIECE) -> Iterator[tuple[list, list, int]]:
    """Pieces (sources, blocks, first slot) of the schedule of exact weights: source and block of each slot from the first on.

    Weights are taken as the rational numbers that they are, so nothing is rounded and no period is needed. A source's
    first block of a phase comes from a list by falling weight, so a new phase costs nothing for sources that it doesn't
    run, however many there are. Once one source is left, its blocks just follow and aren't listed.
    """
    exact = {s: Fraction(weights[s]) for s in blocks if blocks[s]}
    scale = math.lcm(*(w.denominator for w in exact.values()))
    names = sorted(exact, key=lambda s: (-exact[s], str(s)))
    amounts, left = [int(exact[s] * scale) for s in names], [blocks[s] for s in names]
    n, total, done, first = len(names), sum(amounts), [0] * len(names), 0
    after, before = [*range(1, n + 1), 0], [n, *range(n)]  # a ring of the sources with blocks left; n is its head
    sources, ks = [], []
    while left and after[n] != before[n]:
        released, waiting, fresh, slot = [], [], after[n], 0
        while True:
            while waiting and waiting[0][0] <= slot:
                _, due, s, k = heapq.heappop(waiting)
                heapq.heappush(released, (due, s, k))
            if fresh != n and (not released or (-(-total // amounts[fresh]), fresh) < released[0][:2]):
                s, k, fresh = fresh, 0, after[fresh]
            else:
                _, s, k = heapq.heappop(released)
            sources.append(names[s])
            ks.append(done[s])
            done[s] += 1
            slot += 1
            if len(ks) == piece:
                yield sources, ks, first
                sources, ks, first = [], [], first + piece
            if done[s] == left[s]:
                after[before[s]], before[after[s]] = after[s], before[s]
                total -= amounts[s]
                break
            heapq.heappush(waiting, ((k + 1) * total // amounts[s], -(-(k + 2) * total // amounts[s]), s, k + 1))
    if ks:
        yield sources, ks, first


def positioned(df: DataFrame, weights: dict | None = None, source_col: str = "source", id_col: str = "doc_id", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """df with block (of the row's source, from 0), slot (from 0, one block each) and position, which no two rows share.

    position is the slot's number times block_rows plus the row's place in its block: sorted by it, rows are in the
    order of the schedule (a number is left out only where a source's last block isn't full). Columns of these names
    are replaced. weights: of each source, positive numbers, by default the square root of its rows, and 1 for sources
    without one; they hold exactly, for any number of sources. Rows of a source are taken in the order of the hash of
    their id. A null source is a source, null ids are ids; an empty table gives an empty result.
    """
    spark = df.sparkSession
    df = df.drop("block", "slot", "position")
    # a key that is never null, so that the numbering and its join need the rows dealt out only once
    key = lambda c: F.coalesce(F.concat(F.lit("s"), c.cast("string")), F.lit("n"))
    found = df.groupBy(source_col).count().select(source_col, key(F.col(source_col)), "count").collect()
    sizes, keys = {r[0]: r[2] for r in found}, {r[0]: r[1] for r in found}
    weights = weights if weights is not None else {s: float(n) ** EXPONENT for s, n in sizes.items()}
    weights = {s: weights.get(s, 1) for s in sizes}
    blocks = {s: -(-n // block_rows) for s, n in sizes.items()}

    buckets = max(1, sum(sizes.values()) // BUCKET_ROWS)
    df = df.withColumns({"__hash": F.xxhash64(id_col), "__source": key(F.col(source_col))}).withColumn("__bucket", F.pmod("__hash", F.lit(buckets)))
    counts = df.groupBy("__source", "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.partitionBy("__source").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("__source", "__bucket", "__n", F.coalesce(before, F.lit(0)).alias("__before"))
    periodic = all(isinstance(w, int) for w in weights.values()) and sum(weights.values()) <= MOST_PERIOD and len(sizes) <= MOST_SOURCES
    if not periodic:
        counts = with_slots(spark, counts, simulated(blocks, weights), keys, blocks, block_rows)
    numbered = df.withColumn("__row", F.row_number().over(Window.partitionBy("__source", "__bucket").orderBy("__hash", id_col))).join(counts, ["__source", "__bucket"])
    numbered = numbered.withColumn("__at", F.col("__before") + F.col("__row") - 1).withColumn("block", F.floor(F.col("__at") / block_rows))
    if periodic:
        rows: dict = {}
        for s, *phase in phases(blocks, weights):
            rows.setdefault(keys[s], []).append(tuple(phase))
        shape = "__source string, phases array<struct<first:bigint,end:bigint,start:bigint,share:bigint,period:bigint,slots:array<int>>>"
        known = numbered.join(F.broadcast(spark.createDataFrame(list(rows.items()), shape)), "__source", "left")
        known = known.withColumn("__phase", F.filter("phases", lambda p: (p["first"] <= F.col("block")) & (F.col("block") < p["end"]))[0])
        step = F.col("block") - F.col("__phase.first")
        slot = F.col("__phase.start") + F.floor(step / F.col("__phase.share")) * F.col("__phase.period") + F.get("__phase.slots", (step % F.col("__phase.share")).cast("int"))
    else:
        known = numbered
        slot = F.get("__slots", (F.col("block") - F.floor(F.col("__before") / block_rows)).cast("int"))["slot"]
    known = known.withColumn("slot", slot.cast("long")).withColumn("position", F.col("slot") * block_rows + F.col("__at") % block_rows)
    return known.select(*df.columns[: df.columns.index("__hash")], "block", "slot", "position")


def with_slots(spark: SparkSession, counts: DataFrame, schedule: Iterator[tuple], keys: dict, blocks: dict, block_rows: int) -> DataFrame:
    """counts with __slots, the (block, slot) of every block that has rows in the bucket, in the order of blocks.

    The schedule goes to the shared folder piece by piece, so the driver holds one piece of it; it meets the buckets' blocks
    in a join by block, not the rows.
    """
    shape = "__source string, block bigint, slot bigint"
    root, n, rest = shared_dir(spark), 0, Counter(blocks)
    for n, (sources, ks, first) in enumerate(schedule, 1):
        piece = pa.table({"__source": [keys[s] for s in sources], "block": pa.array(ks, pa.int64()), "slot": pa.array(range(first, first + len(ks)), pa.int64())})
        spark.createDataFrame(piece, shape).write.parquet(f"{root}/schedule/piece={n}")
        rest.subtract(sources)
    plan = spark.read.schema(shape).parquet(f"{root}/schedule").drop("piece") if n else spark.createDataFrame([], shape)
    of = F.sequence(F.floor(F.col("__before") / block_rows), F.floor((F.col("__before") + F.col("__n") - 1) / block_rows))
    met = counts.withColumn("block", F.explode(of)).join(plan, ["__source", "block"], "left")
    # unlisted blocks are those of the source that is left last; they fill the last slots up to the end
    offset = sum(blocks.values()) - max((blocks[s] for s, k in rest.items() if k), default=0)
    met = met.withColumn("slot", F.coalesce("slot", F.col("block") + offset))
    return met.groupBy("__source", "__bucket", "__before").agg(F.array_sort(F.collect_list(F.struct("block", "slot"))).alias("__slots"))


def scheduled(df: DataFrame, weights: dict | None = None, source_col: str = "source", id_col: str = "doc_id", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """df with block and slot, as positioned gives them."""
    return positioned(df, weights, source_col, id_col, block_rows).drop("position")


def mixed(df: DataFrame, weights: dict | None = None, source_col: str = "source", id_col: str = "doc_id") -> DataFrame:
    """df's rows and columns in the order of their positions; a reader of files must sort by position again."""
    return positioned(df, weights, source_col, id_col).orderBy("position").select(*df.columns)
