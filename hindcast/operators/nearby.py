"""Distances of events that are a few days apart, worked out in NumPy inside the tasks that hold stretches of the calendar.

Events are (event_id, d, emb, more): each stretch of WIDE days gets its own events and those up to `reach` days from it, so
an event is copied about three times however many are near it, and pairs are never joined.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hindcast.operators.retrieval import CELLS, _matrix, _words
from hindcast.operators.statistics import density_clusters

#: Days of a stretch, and events of it that are held at once.
WIDE, HELD = 14, 2000


def _stretched(events: DataFrame, reach: int) -> DataFrame:
    """events with day, and __block for each stretch that they are in or near to; events without an id or a day are left out."""
    day = F.unix_date("d")
    near = F.sequence(F.floor((F.col("day") - reach) / WIDE), F.floor((F.col("day") + reach) / WIDE))
    return events.where("event_id is not null and d is not null").withColumn("day", day).withColumn("__block", F.explode(near))


def _coded(events: DataFrame, unlike: dict[str, float]) -> DataFrame:
    return events.select(*(F.when(F.col(c).isNotNull(), F.xxhash64(c)).alias(c) if c in unlike else F.col(c) for c in events.columns))


def _unit(column, width: int) -> np.ndarray:
    """Vectors of length one as rows; not numbers where there is none."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    out = np.full((len(column), width), np.nan)
    known = column.is_valid().to_numpy(zero_copy_only=False)
    if known.any() and width:
        out[known] = _matrix(column.drop_null())
    return out


def _width(column) -> int:
    known = column.drop_null()
    return len(known[0]) if len(known) else 0


def _codes(column) -> tuple[np.ndarray, np.ndarray]:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.fill_null(0).to_numpy(zero_copy_only=False), column.is_null().to_numpy(zero_copy_only=False)


def _differ(a: tuple, b: tuple) -> np.ndarray:
    """1 where codes differ, not a number where either has none."""
    out = (a[0][:, None] != b[0][None]).astype(float)
    out[a[1]] = np.nan
    out[:, b[1]] = np.nan
    return out


def pairs(events: DataFrame, reach: int, vectors: float, words: float, unlike: dict[str, float]) -> DataFrame:
    """(a, b, dist): each pair of events at most `reach` days apart once, a the smaller id, and the weighted distance of vectors
    (half of one less the cosine), words (1 less their share in common; two empty bags are alike) and unlike columns.

    events is (event_id, d, emb, bag, and the columns of unlike); words meet by 64-bit hashes. dist is null where the vector or
    a column of either is. Of each stretch HELD events are held, and all near ones stream past them.
    """
    names = list(unlike)
    rows = _coded(events.select("event_id", "d", "emb", F.transform("bag", lambda w: F.xxhash64(w)).alias("bag"), *names), unlike)
    near = _stretched(rows, reach)
    own = near.where(F.floor(F.col("day") / WIDE) == F.col("__block"))
    # a stretch with many events has several pieces, each with some of them
    pieces = own.groupBy("__block").agg(F.ceil(F.count(F.lit(1)) / HELD).cast("int").alias("__pieces"))
    own = own.join(F.broadcast(pieces), "__block").withColumn("__piece", F.pmod(F.xxhash64("event_id"), "__pieces").cast("int")).withColumn("__guest", F.lit(0))
    guests = near.join(F.broadcast(pieces), "__block").withColumn("__piece", F.explode(F.sequence(F.lit(0), F.col("__pieces") - 1))).withColumn("__guest", F.lit(1))
    columns = ["__block", "__piece", "__guest", "event_id", "day", "emb", "bag", *names]
    dealt = own.select(*columns).unionByName(guests.select(*columns)).repartition("__block", "__piece").sortWithinPartitions("__block", "__piece", "__guest")

    def met(home: dict, t: pa.RecordBatch):
        ids, day, codes = t.column(3).to_numpy(), t.column(4).to_numpy(), [_codes(t.column(7 + k)) for k in range(len(names))]
        dist = vectors * (1 - np.einsum("ij,kj->ik", home["emb"], _unit(t.column(5), home["emb"].shape[1]))) / 2
        if words:
            flat, n = _words(t.column(6))
            ends, known, lists = np.cumsum(n), home["known"], home["lists"]
            place = np.minimum(np.searchsorted(known, flat), max(len(known) - 1, 0))
            found = known[place] == flat if len(known) else np.zeros(len(flat), bool)
            both = np.zeros(dist.shape)
            for k, end in enumerate(ends):
                part = slice(end - n[k], end)
                mine = place[part][found[part]]
                m = lists[mine + 1] - lists[mine]
                at = np.repeat(lists[mine] - np.cumsum(m) + m, m) + np.arange(m.sum())
                both[:, k] = np.bincount(home["held"][at], minlength=len(dist))
            either = home["n"][:, None] + n[None] - both
            dist += words * (1 - np.where(either == 0, 1.0, both / np.maximum(either, 1)))
        for one, other, w in zip(home["codes"], codes, unlike.values(), strict=True):
            dist += w * _differ(one, other)
        q, c = np.nonzero((home["ids"][:, None] < ids[None]) & (np.abs(home["day"][:, None] - day[None]) <= reach))
        d = dist[q, c]
        return pa.RecordBatch.from_arrays([pa.array(home["ids"][q]), pa.array(ids[c]), pa.array(d, mask=np.isnan(d))], names=["a", "b", "dist"])

    def held(batches: list) -> dict:
        t = pa.Table.from_batches(batches).combine_chunks()
        ids, day = t["event_id"].to_numpy(), t["day"].to_numpy()
        flat, n = _words(t["bag"].combine_chunks())
        known, w = np.unique(flat, return_inverse=True)
        order = np.argsort(w, kind="stable")
        lists = np.concatenate([[0], np.cumsum(np.bincount(w, minlength=len(known)))])
        return {"ids": ids, "day": day, "emb": _unit(t["emb"], _width(t["emb"])), "codes": [_codes(t[c]) for c in names], "n": n, "known": known, "lists": lists, "held": np.repeat(np.arange(len(ids), dtype=np.int32), n)[order]}

    def run(batches):
        key, waiting, home = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            block, piece, guest = (batch.column(k).to_numpy() for k in range(3))
            cuts = np.flatnonzero((np.diff(block) != 0) | (np.diff(piece) != 0) | (np.diff(guest) != 0)) + 1
            for a, b in itertools.pairwise([0, *cuts.tolist(), len(block)]):
                part = batch.slice(a, b - a)
                if (block[a], piece[a]) != key:
                    key, waiting, home = (block[a], piece[a]), [], None
                if not guest[a]:
                    waiting.append(part)
                    continue
                home = home or (held(waiting) if waiting else None)
                if home:
                    step = max(1, CELLS // len(home["ids"]))
                    for k in range(0, part.num_rows, step):
                        yield met(home, part.slice(k, step))

    return dealt.mapInArrow(run, "a long, b long, dist double")


def local_clusters(events: DataFrame, reach: int, vectors: float, unlike: dict[str, float], least: int = 3) -> DataFrame:
    """(event_id, size, cohesion, role): the density cluster of each event among those at most `reach` days from it.

    Distances are those of pairs() without words; events of a window that are more than `reach` days apart, or have the same
    id, are at distance one. All events of a day have the same window, which is clustered once. A task holds the events of a
    stretch, and the distances of one window; an event without a day is on its own.
    """
    names = list(unlike)
    rows = _stretched(_coded(events.select("event_id", "d", "emb", *names), unlike), reach).select("__block", "event_id", "day", "emb", *names)

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("event_id", "ascending"), ("day", "ascending")])
        block, ids, day = t["__block"][0].as_py(), t["event_id"].to_numpy(), t["day"].to_numpy()
        m, codes = _unit(t["emb"], _width(t["emb"])), [_codes(t[c]) for c in names]
        out = {"event_id": [], "size": [], "cohesion": [], "role": []}
        for today in np.unique(day[np.floor_divide(day, WIDE) == block]).tolist():
            w = np.flatnonzero(np.abs(day - today) <= reach)
            own, when = ids[w], day[w]
            d = vectors * (1 - np.einsum("ij,kj->ik", m[w], m[w])) / 2
            for (code, none), weight in zip(codes, unlike.values(), strict=True):
                d += weight * _differ((code[w], none[w]), (code[w], none[w]))
            d[(np.abs(when[:, None] - when[None]) > reach) | (own[:, None] == own[None])] = 1.0
            np.fill_diagonal(d, 0)
            labels, found = density_clusters(d, least), {}
            for k in np.flatnonzero(when == today).tolist():
                label = int(labels[k])
                if label < 0 or label not in found:
                    mine = np.flatnonzero(labels == label) if label >= 0 else np.array([k])
                    spread = int(when[mine].max() - when[mine].min())
                    upper = d[np.ix_(mine, mine)][np.triu_indices(len(mine), 1)]
                    role = "NOVEL" if len(mine) <= 1 else "REPEAT" if spread <= 2 else "REGIME-MARKER" if len(mine) >= 3 and spread >= 7 else "CONTINUATION"
                    found[label] = len(mine), float(1 - upper.mean()) if len(upper) else 1.0, role
                for c, v in zip(out, (int(own[k]), *found[label]), strict=True):
                    out[c].append(v)
        return pa.table(out, schema=pa.schema([("event_id", pa.int64()), ("size", pa.int64()), ("cohesion", pa.float64()), ("role", pa.string())]))

    found = rows.groupBy("__block").applyInArrow(run, "event_id long, size long, cohesion double, role string")
    alone = events.where("event_id is not null and d is null").select("event_id", F.lit(1).cast("long").alias("size"), F.lit(1.0).alias("cohesion"), F.lit("NOVEL").alias("role"))
    return found.unionByName(alone)
