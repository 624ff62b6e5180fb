"""Line dedup: exact reference-count tables behind sharded cuckoo filters, with insertions and deletions of documents.

A line's key is the line without the white space at its ends, A-Z lower-cased. Keys of at least MIN_POINTS code
points that are in two documents or more lose all their lines except in the smallest doc_id that holds them.

The store keeps, in a folder that all machines share: postings (key, doc_id, sign), one written table for each
insertion or deletion; counts (key, docs, first_doc), the exact reference counts; and for each shard of the key space, of
about SHARD_KEYS keys, a cuckoo filter of the keys in two documents or more. A later insertion or deletion recomputes the counts of the keys it
touches, and adds to or takes from the filters only the keys that became repeated or ceased to be, so that inserting
documents and deleting them again gives the former decisions. Decisions ask the filters first, and the exact table
only for the postings that may be repeated.

Null texts are one empty line. Rows with a null doc_id are neither counted nor changed. Rows of equal doc_id are one
document. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField

from hindcast.llm.common import WORD_BREAKS, shared_dir, texts, with_arrow, written

MIN_POINTS = 10
STRIPPED = WORD_BREAKS.encode()
SLOTS, KICKS, FILL = 4, 200, 0.8
#: Keys that a shard has at most when there are more than LEAST_SHARDS, so that no task builds a large filter.
SHARD_KEYS, LEAST_SHARDS = 250_000, 64
#: Filters up to this many bytes in all are broadcast; beyond, every posting is looked up in the exact table.
MOST_FILTER_BYTES = 64 << 20


def line_key(line: bytes) -> bytes | None:
    """The key of a line, or None if it is too short to count."""
    key = line.strip(STRIPPED).lower()
    if len(key) < 4 * MIN_POINTS and len(key.decode("utf-8", "replace")) < MIN_POINTS:
        return None
    return key


class CuckooFilter:
    """16-bit fingerprints in buckets of four; a key has two buckets. What finds no place after KICKS moves is stashed.

    hi and lo are the halves of the key's 128-bit hash.
    """

    def __init__(self, buckets: int, table: bytes | None = None, stash: bytes | None = None) -> None:
        self.mask = buckets - 1
        self.table = np.frombuffer(table, np.uint16).reshape(buckets, SLOTS).copy() if table else np.zeros((buckets, SLOTS), np.uint16)
        self.stash: list[int] = list(np.frombuffer(stash, np.uint64).tolist()) if stash else []

    @staticmethod
    def buckets_for(keys: int) -> int:
        return 1 << max(2, int(keys / (SLOTS * FILL))).bit_length()

    def places(self, hi, lo):
        mark = (np.asarray(hi, np.int64).view(np.uint64) % np.uint64(65535) + np.uint64(1)).astype(np.uint64)
        first = np.asarray(lo, np.int64).view(np.uint64) & np.uint64(self.mask)
        return mark, first, self.other(first, mark)

    def other(self, at, mark):
        return (at ^ (mark * np.uint64(0x5BD1E995))) & np.uint64(self.mask)

    def add(self, hi, lo) -> None:
        """Adds many keys: those that find a free slot in one of their buckets at once, the few others by moving entries."""
        mark, first, second = self.places(hi, lo)
        left = np.arange(len(mark))
        for at in (first, second):
            left = left[~self.fill(at[left], mark[left])]
        for k in left.tolist():
            self.push(int(mark[k]), int(first[k]))

    def fill(self, at: np.ndarray, mark: np.ndarray) -> np.ndarray:
        """Puts each mark into its bucket as long as slots are free there, in order; whether it found one."""
        order = np.argsort(at, kind="stable")
        at, new = at[order], np.concatenate([[True], at[order][1:] != at[order][:-1]])[: len(at)]
        begins = np.flatnonzero(new)
        place = np.arange(len(at)) - np.repeat(begins, np.diff(np.concatenate([begins, [len(at)]])))
        taken = self.table[at] != 0
        fits = place < SLOTS - taken.sum(1)
        free = np.argsort(taken[fits], 1, kind="stable")[np.arange(int(fits.sum())), place[fits]]
        self.table[at[fits], free] = mark[order][fits]
        out = np.zeros(len(at), bool)
        out[order[fits]] = True
        return out

    def push(self, mark: int, at: int) -> None:
        """Puts a mark into a full bucket: its entries move to their other buckets in turn."""
        for n in range(KICKS):
            slot = n % SLOTS
            mark, self.table[at, slot] = int(self.table[at, slot]), mark
            at = (at ^ (mark * 0x5BD1E995)) & self.mask
            free = np.flatnonzero(self.table[at] == 0)
            if len(free):
                self.table[at, free[0]] = mark
                return
        self.stash.append(mark << 40 | at)

    def remove(self, hi: int, lo: int) -> None:
        mark, first, second = (int(x[0]) for x in self.places([hi], [lo]))
        for at in (first, second):
            held = np.flatnonzero(self.table[at] == mark)
            if len(held):
                self.table[at, held[0]] = 0
                return
        for at in (first, second):
            if mark << 40 | at in self.stash:
                self.stash.remove(mark << 40 | at)
                return

    def has(self, hi, lo) -> np.ndarray:
        mark, first, second = self.places(hi, lo)
        wanted = mark.astype(np.uint16)[:, None]
        found = (self.table[first] == wanted).any(1) | (self.table[second] == wanted).any(1)
        if self.stash:
            held = np.array(self.stash, np.uint64)
            found |= np.isin(mark << np.uint64(40) | first, held) | np.isin(mark << np.uint64(40) | second, held)
        return found


def shard_of(hi, shards: int):
    return (np.asarray(hi, np.int64).view(np.uint64) >> np.uint64(40)) % np.uint64(shards)


def postings(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(hi, lo, doc_id): each counted key of each document, once for each row of it."""

    def run(batches):
        for batch in batches:
            ids, hashes = [], []
            for doc_id, text in zip(batch.column(batch.schema.get_field_index(id_col)).to_pylist(), texts(batch, text_col), strict=True):
                keys = {k for line in text.encode("utf-8", "replace").split(b"\n") if (k := line_key(line)) is not None}
                hashes += map(xxhash.xxh3_128_digest, keys)
                ids += [doc_id] * len(keys)
            both = np.frombuffer(b"".join(hashes), ">i8").astype(np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(ids, pa.int64())], names=["hi", "lo", "doc_id"])

    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias(id_col), text_col)
    return rows.mapInArrow(run, "hi long, lo long, doc_id long")


class LineStore:
    """The incremental state; insert() and delete() may follow each other in any order.

    A shard has about `shard_keys` keys when the filters are built, so there are more shards the more repeated keys there
    are (LEAST_SHARDS at least); filters without room for a change are built anew.
    """

    def __init__(self, spark: SparkSession, root: str | None = None, shard_keys: int = SHARD_KEYS) -> None:
        self.root, self.shard_keys, self.shards, self.moves = root or shared_dir(spark), shard_keys, 1, 0
        self.log: list[DataFrame] = []
        self.counts: DataFrame | None = None
        self.filters: DataFrame | None = None

    def live(self) -> DataFrame:
        if len(self.log) == 1:
            return self.log[0].select("hi", "lo", "doc_id")
        every = self.log[0]
        for more in self.log[1:]:
            every = every.unionByName(more)
        return every.groupBy("hi", "lo", "doc_id").agg(F.sum("sign").alias("n")).where("n > 0").drop("n")

    def insert(self, docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> None:
        """Documents that are there already stay once."""
        new = postings(docs, text_col, id_col).distinct()
        if self.log:
            new = new.join(self.live(), ["hi", "lo", "doc_id"], "left_anti")
        self._move(new.withColumn("sign", F.lit(1)))

    def delete(self, ids: DataFrame) -> None:
        """ids: a column doc_id; ids that aren't there are no error."""
        if self.log:
            self._move(self.live().join(ids.select("doc_id").distinct(), "doc_id", "left_semi").select("hi", "lo", "doc_id", F.lit(-1).alias("sign")))

    def _move(self, change: DataFrame) -> None:
        n, self.moves = self.moves, self.moves + 1
        self.log.append(written(change, self.root, f"postings-{n}"))
        live, before = self.live(), self.counts
        if before is not None:
            touched = self.log[-1].select("hi", "lo").distinct()
            live = live.join(touched, ["hi", "lo"], "left_semi")
        now = live.groupBy("hi", "lo").agg(F.count(F.lit(1)).alias("docs"), F.min("doc_id").alias("first_doc"))
        if before is not None:
            now = now.unionByName(before.join(touched, ["hi", "lo"], "left_anti"))
        self.counts = written(now, self.root, f"counts-{n}")
        repeated = self.counts.where("docs > 1").select("hi", "lo")
        if before is not None:
            was = before.where("docs > 1").select("hi", "lo")
            changes = repeated.join(was, ["hi", "lo"], "left_anti").withColumn("add", F.lit(True)).unionByName(was.join(repeated, ["hi", "lo"], "left_anti").withColumn("add", F.lit(False)))
            room = self.filters.agg(F.min(F.col("buckets") * SLOTS * FILL - F.col("held"))).first()[0] if self.filters.head(1) else None
            if room is not None and changes.count() <= room:
                self.filters = written(self._changed(changes, self.filters), self.root, f"filters-{n}")
                return
        self.shards = max(LEAST_SHARDS, repeated.count() // self.shard_keys)
        self.filters = written(self._changed(repeated.withColumn("add", F.lit(True)), None), self.root, f"filters-{n}")

    def _changed(self, changes: DataFrame, filters: DataFrame | None) -> DataFrame:
        """The filters of all shards after changes; a group is the changed keys of one shard."""
        shards = self.shards

        def renew(key: tuple, new: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
            if len(old):
                held = CuckooFilter(int(old.buckets[0]), old.cells[0], old.stash[0])
                n = int(old.held[0])
            else:
                held, n = CuckooFilter(CuckooFilter.buckets_for(len(new))), 0
            gone = new[~new["add"]]
            for hi, lo in zip(gone.hi, gone.lo, strict=True):
                held.remove(int(hi), int(lo))
            more = new[new["add"]]
            held.add(more.hi.to_numpy(), more.lo.to_numpy())
            n += len(more) - len(gone)
            return pd.DataFrame({"shard": [key[0]], "buckets": [held.mask + 1], "held": [n], "cells": [held.table.tobytes()], "stash": [np.array(held.stash, np.uint64).tobytes()]})

        schema = "shard long, buckets long, held long, cells binary, stash binary"
        keyed = changes.withColumn("shard", F.shiftrightunsigned("hi", 40) % shards)
        old = filters if filters is not None else changes.sparkSession.createDataFrame([], schema)
        return keyed.groupBy("shard").cogroup(old.groupBy("shard")).applyInPandas(renew, schema)

    def candidates(self) -> DataFrame:
        """The live postings whose key passes its shard's filter; all of them if the filters are too large to broadcast."""
        live, shards = self.live(), self.shards
        total = self.filters.agg(F.sum(F.length("cells") + F.length("stash"))).first()[0] or 0
        if total > MOST_FILTER_BYTES:
            return live
        shared = live.sparkSession.sparkContext.broadcast({r.shard: (r.buckets, bytes(r.cells), bytes(r.stash)) for r in self.filters.collect()})

        def run(batches):
            filters = {k: CuckooFilter(*x) for k, x in shared.value.items()}
            for batch in batches:
                hi, lo = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
                shard, keep = shard_of(hi, shards), np.zeros(len(hi), bool)
                for k in np.unique(shard):
                    if int(k) in filters:
                        own = np.flatnonzero(shard == k)
                        keep[own] = filters[int(k)].has(hi[own], lo[own])
                yield batch.filter(pa.array(keep))

        return live.mapInArrow(run, live.schema)

    def drops(self) -> DataFrame:
        """(doc_id, dropped): for each document that loses lines, the keys it loses."""
        repeated = self.counts.where("docs > 1").select("hi", "lo", "first_doc")
        lost = self.candidates().join(repeated, ["hi", "lo"]).where("doc_id <> first_doc")
        return lost.groupBy("doc_id").agg(F.collect_list(F.struct("hi", "lo")).alias("dropped"))


def without(docs: DataFrame, drops: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """docs with kept (the text without the dropped lines), n_lines (before) and n_dropped; these names are replaced."""
    drops = drops.select(F.col("doc_id").alias("__of"), F.col("dropped").alias("__dropped"))
    joined = docs.join(drops, docs[id_col] == drops["__of"], "left").drop("__of")

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        kept, lines, dropped = [], [], []
        for text, lost in zip(texts(batch, text_col), batch.column(batch.schema.get_field_index("__dropped")).to_pylist(), strict=True):
            n = text.count("\n") + 1
            lines.append(n)
            if not lost:
                kept.append(text)
                dropped.append(0)
                continue
            gone = {(x["hi"].to_bytes(8, "big", signed=True) + x["lo"].to_bytes(8, "big", signed=True)) for x in lost}
            stay = [x for x in text.encode("utf-8", "replace").split(b"\n") if (k := line_key(x)) is None or xxhash.xxh3_128_digest(k) not in gone]
            kept.append(b"\n".join(stay).decode("utf-8", "replace"))
            dropped.append(n - len(stay))
        return [pa.array(kept, pa.string()), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())]

    fields = [StructField("kept", StringType()), StructField("n_lines", LongType()), StructField("n_dropped", LongType())]
    return with_arrow(joined, run, fields).drop("__dropped")


def dedup(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", root: str | None = None) -> DataFrame:
    """docs with kept, n_lines and n_dropped, all documents inserted at once into a new store."""
    store = LineStore(docs.sparkSession, root)
    store.insert(docs, text_col, id_col)
    return without(docs, store.drops(), text_col, id_col)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of every document."""
    return dedup(docs.select("doc_id", "text")).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
with lines as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as n
  from documents
), keyed as (
  select doc_id, n, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k
  from lines
), repeated as (
  select k, min(doc_id) as first_doc from keyed where length(k) >= 10 group by k having count(distinct doc_id) >= 2
), judged as (
  select doc_id, n, line, coalesce(doc_id <> first_doc, false) as gone from keyed left join repeated using (k)
)
select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by n) filter (where not gone), '')) as kept_sha256
from judged group by doc_id
"""
