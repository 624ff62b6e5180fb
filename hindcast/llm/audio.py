"""Media columns: chroma fingerprints of audio, their alignment and the search for a recording among all others.

Audio is mono 8-bit PCM in a binary column. Frames that overlap are transformed, their energy is gathered in twelve pitch
classes, smoothed over five frames and normalised; frames are long enough to part the semitones of the lowest octave used. On
the integral image of these rows sixteen filters compare two areas each; a filter's value is quantised to two bits in Gray
code, and the bits of all filters make one packed 32-bit integer for each place. Two recordings are aligned at the most
frequent offset of equal integers, all of which vote, and their distance there is the share of bits that differ in the
overlap.

The search looks up every integer of every recording among those of the stated queries, in blocks; no integer is too common
and no recording has too few. Equal integers vote for offsets as in an alignment, and a query matches what overlaps it by
LEAST places or more at the winning offset with few differing bits. Recordings of equal fingerprints, of any length, are one
in the search, so that copies don't meet copies.

Null and empty recordings have no integers, and an error of 1 to others and 0 to each other. One shorter than a frame is
one frame with silence. Rows of one id are recordings of their own; a null id is in no search.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, LongType, StructField

from hindcast.llm.common import forget, shared_dir, with_arrow, written
from hindcast.llm.winnow import with_next

SMOOTH = np.array([0.25, 0.75, 1.0, 0.75, 0.25])
#: Samples that are transformed at once.
CHUNK = 1 << 19
#: The filters: kind (0 halves in time, 1 halves in pitch, 2 a checkerboard, 3 the middle third in time), first class, classes, frames.
FILTERS = [(k % 4, 3 * k % 9, 2 + k % 3 if k % 4 else 1 + k % 3, 4 + 2 * (k % 5) if k % 4 != 3 else 6 + 3 * (k % 3)) for k in range(16)]
WIDEST = max(f[3] for f in FILTERS)
STEP = 0.15
GRAY = np.array([0, 1, 3, 2], np.uint32)
#: Places that a match overlaps at least, and the error up to which it is one.
LEAST, MOST_ERROR = 8, 0.15
#: Integers of the queries that are looked up at once; votes that are counted at once, and those of one recording beyond which
#: its alignments are made one by one.
BLOCK, VOTES, MANY = 1 << 22, 1 << 20, 1 << 23


@dataclass(frozen=True)
class Pitch:
    """How sound is cut: samples a second, samples of a frame and between frames, and the pitches that count, in hertz."""

    rate: int
    frame: int
    hop: int
    low: float
    high: float

    @cached_property
    def classes(self) -> np.ndarray:
        """Which class each bin of the spectrum counts for."""
        if self.rate / self.frame > self.low * (2 ** (1 / 12) - 1):
            raise ValueError("the frame is too short to part semitones at the lowest pitch")
        out = np.zeros((self.frame // 2 + 1, 12), np.float32)
        for k, f in enumerate(np.arange(self.frame // 2 + 1) * self.rate / self.frame):
            if self.low <= f <= self.high:
                out[k, int(round(12 * np.log2(f / 440.0))) % 12] = 1
        return out

    @cached_property
    def window(self) -> np.ndarray:
        return np.hanning(self.frame).astype(np.float32)


#: Sound of eight thousand samples a second, and short recordings of few samples such as documents read as sound.
SOUND, SHORT = Pitch(8000, 4096, 512, 110.0, 3520.0), Pitch(500, 256, 64, 55.0, 220.0)


def chroma(samples: np.ndarray, pitch: Pitch = SOUND) -> np.ndarray:
    """A normalised row of twelve classes for each frame; fewer samples than a frame count as one frame with silence."""
    if len(samples) < pitch.frame:
        samples = np.concatenate([samples, np.zeros(pitch.frame - len(samples), samples.dtype)])
    frames = np.lib.stride_tricks.sliding_window_view(samples, pitch.frame)[:: pitch.hop]
    step = max(1, CHUNK // pitch.frame)
    rows = np.concatenate([(np.abs(np.fft.rfft(frames[k : k + step] * pitch.window)) ** 2).astype(np.float32) @ pitch.classes for k in range(0, len(frames), step)])
    padded = np.concatenate([rows[:1], rows[:1], rows, rows[-1:], rows[-1:]])
    smooth = sum(w * padded[k : k + len(rows)] for k, w in enumerate(SMOOTH))
    return smooth / np.maximum(np.linalg.norm(smooth, axis=1, keepdims=True), 1e-9)


def fingerprint(audio: bytes | None, pitch: Pitch = SOUND) -> np.ndarray:
    """The packed integers of a recording; none for a null or empty one. Short ones are padded with their last row."""
    if not audio:
        return np.zeros(0, np.uint32)
    rows = chroma(np.frombuffer(audio, np.uint8).astype(np.float32) - 128, pitch)
    if len(rows) < WIDEST:
        rows = np.concatenate([rows, np.repeat(rows[-1:], WIDEST - len(rows), 0)])
    image = np.zeros((len(rows) + 1, 13))
    image[1:, 1:] = rows.cumsum(0).cumsum(1)
    n = len(rows) - WIDEST + 1

    def area(t: int, y: int, frames: int, classes: int) -> np.ndarray:
        return image[t + frames : t + frames + n, y + classes] - image[t : t + n, y + classes] - image[t + frames : t + frames + n, y] + image[t : t + n, y]

    out = np.zeros(n, np.uint32)
    for kind, y, classes, frames in FILTERS:
        whole, half, high = area(0, y, frames, classes), frames // 2, classes // 2
        if kind == 0:
            a = area(0, y, half, classes)
        elif kind == 1:
            a = area(0, y, frames, high)
        elif kind == 2:
            a = area(0, y, half, high) + area(half, y + high, frames - half, classes - high)
        else:
            a = area(frames // 3, y, frames // 3, classes)
        value = np.log1p(a) - np.log1p(whole - a)
        level = (value > -STEP).astype(int) + (value > 0) + (value > STEP)
        out = out << np.uint32(2) | GRAY[level]
    return out


def votes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many places i of a and j of b hold equal integers, by offset i - j from 1 - len(b) on.

    An integer that both have often, such as silence, is counted by a correlation, others pair by pair; both are exact.
    """
    n = len(a) + len(b) - 1
    out = np.zeros(n, np.int64)
    values, of = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = of[: len(a)], of[len(a) :]
    inside = np.bincount(y, minlength=len(values))
    often = np.flatnonzero(np.bincount(x, minlength=len(values)) * inside > 16 * n)
    for v in often:
        size = 1 << (n - 1).bit_length()
        out += np.rint(np.fft.irfft(np.fft.rfft(x == v, size) * np.fft.rfft((y == v)[::-1], size), size)[:n]).astype(np.int64)
    order = np.argsort(y, kind="stable")
    begins = np.cumsum(inside) - inside
    inside[often] = 0
    many = inside[x]
    for part in np.array_split(np.arange(len(a)), 1 + int(many.sum()) // (1 << 20)):
        i = np.repeat(part, many[part])
        heads = np.cumsum(many[part]) - many[part]
        j = order[np.arange(len(i)) + np.repeat(begins[x[part]] - heads, many[part])]
        out += np.bincount(i - j + len(b) - 1, minlength=n)
    return out


def align(a: np.ndarray, b: np.ndarray) -> tuple[int, float]:
    """(offset, error): b begins at place offset of a; error is the share of differing bits in the overlap.

    The offset is the commonest among equal integers (the smallest in amount, then the negative one, of equals); without
    any it is 0. Two empty recordings have error 0, an empty and another have 1.
    """
    if not len(a) or not len(b):
        return 0, float(len(a) != len(b))
    found = votes(a, b)
    offset = 0
    if found.max():
        best = np.flatnonzero(found == found.max()) - (len(b) - 1)
        offset = int(best[np.lexsort((best, np.abs(best)))[0]])
    u, v = a[max(0, offset) :], b[max(0, -offset) :]
    n = min(len(u), len(v))
    return offset, float(np.bitwise_count(u[:n] ^ v[:n]).sum() / (32 * n)) if n else 1.0


def with_fingerprints(df: DataFrame, audio_col: str, out: str = "fingerprint", pitch: Pitch = SOUND) -> DataFrame:
    """df with the packed integers of each whole recording as binary; one pass without a shuffle."""
    return with_arrow(df, lambda batch: [pa.array([fingerprint(x, pitch).tobytes() for x in batch.column(batch.schema.get_field_index(audio_col)).to_pylist()], pa.binary())], [StructField(out, BinaryType())])


def aligned(df: DataFrame, pairs: list[tuple[str, str, str, str]]) -> DataFrame:
    """df with, for each of pairs (a, b, offset, error), the offset and the error of the fingerprints in columns a and b."""

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        out = []
        for a, b, *_ in pairs:
            columns = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (a, b))
            found = [align(*(np.frombuffer(x or b"", np.uint32) for x in p)) for p in zip(*columns, strict=True)]
            out += [pa.array([x for x, _ in found], pa.int64()), pa.array([x for _, x in found], pa.float64())]
        return out

    return with_arrow(df, run, [f for *_, offset, error in pairs for f in (StructField(offset, LongType()), StructField(error, DoubleType()))])


@dataclass(frozen=True)
class Block:
    """Queries that are searched for at once: their integers in order of value, with query and place, and their whole prints."""

    names: np.ndarray
    prints: np.ndarray
    begins: np.ndarray
    values: np.ndarray
    of: np.ndarray
    place: np.ndarray

    @classmethod
    def made(cls, names: list[int], prints: list[bytes]) -> Block:
        lengths = np.array([len(p) // 4 for p in prints], np.int64)
        begins = np.concatenate([[0], np.cumsum(lengths)])
        every = np.frombuffer(b"".join(prints), np.uint32)
        order = np.argsort(every, kind="stable")
        of = np.repeat(np.arange(len(prints), dtype=np.int64), lengths)
        place = np.arange(len(every), dtype=np.int64) - begins[of]
        return cls(np.array(names, np.int64), every, begins, every[order], of[order], place[order])

    def one(self, q: int) -> np.ndarray:
        return self.prints[self.begins[q] : self.begins[q + 1]]


def voted(block: Block, values: np.ndarray, row: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, query, offset) of each pair of a row and a query that share an integer, at the offset that align() would choose."""
    low, high = np.searchsorted(block.values, values), np.searchsorted(block.values, values, "right")
    n = high - low
    at = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
    rows, q, offset = np.repeat(row, n), block.of[at], block.place[at] - np.repeat(place, n)
    order = np.lexsort((offset, q, rows))
    rows, q, offset = rows[order], q[order], offset[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (q[1:] != q[:-1]) | (offset[1:] != offset[:-1])
    heads = np.flatnonzero(new)
    count = np.diff(np.append(heads, len(rows)))
    rows, q, offset = rows[heads], q[heads], offset[heads]
    best = np.lexsort((offset, np.abs(offset), -count, q, rows))
    rows, q, offset = rows[best], q[best], offset[best]
    first = np.ones(len(rows), bool)
    first[1:] = (rows[1:] != rows[:-1]) | (q[1:] != q[:-1])
    return rows[first], q[first], offset[first]


def found_in(block: Block, prints: list[bytes], least: int, most: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, query, offset, error) of the matches of a block's queries with the recordings of a batch."""
    lengths = np.array([len(p) // 4 for p in prints], np.int64)
    begins = np.concatenate([[0], np.cumsum(lengths)])
    every = np.frombuffer(b"".join(prints), np.uint32)
    row = np.repeat(np.arange(len(prints)), lengths)
    place = np.arange(len(every)) - begins[row]
    hits = np.searchsorted(block.values, every, "right") - np.searchsorted(block.values, every)
    per_row = np.bincount(row, hits, len(prints)).astype(np.int64)
    out: list[tuple] = []

    def judged(r: np.ndarray, q: np.ndarray, offset: np.ndarray) -> None:
        """Keeps the pairs that overlap enough and differ little; their overlaps are compared end to end."""
        size = np.diff(block.begins)[q]
        a, b = np.maximum(offset, 0), np.maximum(-offset, 0)
        n = np.minimum(size - a, lengths[r] - b)
        r, q, offset, a, b, n = (x[n >= least] for x in (r, q, offset, a, b, n))
        for part in np.array_split(np.arange(len(r)), 1 + int(n.sum()) // VOTES):
            if len(part):
                m = n[part]
                step = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
                x = block.prints[np.repeat(block.begins[q[part]] + a[part], m) + step] ^ every[np.repeat(begins[r[part]] + b[part], m) + step]
                error = np.add.reduceat(np.bitwise_count(x).astype(np.int64), np.cumsum(m) - m) / (32 * m)
                close = error <= most
                out.append((r[part][close], q[part][close], offset[part][close], error[close]))

    for r in np.flatnonzero(per_row > MANY):  # sound that is the same for long: pair by pair, by correlation
        mine = every[begins[r] : begins[r + 1]]
        low, high = np.searchsorted(block.values, np.unique(mine)), np.searchsorted(block.values, np.unique(mine), "right")
        for q in np.unique(np.concatenate([block.of[i:j] for i, j in zip(low, high, strict=True)])):
            judged(np.array([r]), np.array([q]), np.array([align(block.one(q), mine)[0]]))
    some = np.flatnonzero((per_row > 0) & (per_row <= MANY))
    cuts = np.flatnonzero(np.diff(np.cumsum(per_row[some]) // VOTES)) + 1
    for part in np.split(some, cuts):
        if len(part):
            own = np.isin(row, part)
            judged(*voted(block, every[own], row[own], place[own]))
    empty = (np.zeros(0, np.int64),) * 3 + (np.zeros(0),)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else empty


def searched(one: DataFrame, asked: DataFrame, least: int = LEAST, most: float = MOST_ERROR) -> DataFrame:
    """(mine, id, offset, error, copies): what each asked place of `one` (place, id, copies, fingerprint) matches but itself.

    Queries are broadcast in blocks of about BLOCK integers, and every recording is held against a block where it lies:
    nothing is shuffled but the matches. The number of blocks grows with the queries, which are a stated part of all rows.
    """
    queries = one.join(asked.select(F.col("mine").alias("place")).distinct(), "place", "left_semi").where("length(fingerprint) > 0").select("place", "fingerprint")
    total = queries.agg(F.sum(F.length("fingerprint") / 4)).first()[0] or 0
    blocks, out = max(1, -(-int(total) // BLOCK)), None
    for k in range(blocks):
        t = (queries.where(F.pmod(F.xxhash64("place"), F.lit(blocks)) == k) if blocks > 1 else queries).toArrow()
        if not t.num_rows:
            continue
        shared = one.sparkSession.sparkContext.broadcast(Block.made(t["place"].to_pylist(), t["fingerprint"].to_pylist()))

        def run(batches, shared=shared):
            block = shared.value
            for batch in batches:
                if batch.num_rows:
                    r, q, offset, error = found_in(block, [x or b"" for x in batch.column(3).to_pylist()], least, most)
                    other = batch.column(0).to_numpy()[r] != block.names[q]
                    r, q, offset, error = r[other], q[other], offset[other], error[other]
                    yield pa.RecordBatch.from_arrays([pa.array(block.names[q]), batch.column(1).take(pa.array(r)), pa.array(offset), pa.array(error), batch.column(2).take(pa.array(r))], names=["mine", "id", "offset", "error", "copies"])

        found = one.select("place", "id", "copies", "fingerprint").mapInArrow(run, "mine long, id long, offset long, error double, copies long")
        out = found if out is None else out.unionByName(found)
    return out if out is not None else one.sparkSession.createDataFrame([], "mine long, id long, offset long, error double, copies long")


def matches(prints: DataFrame, queries: DataFrame, id_col: str = "doc_id", root: str | None = None) -> DataFrame:
    """(query, id, offset, error, copies): for each query the recordings that it matches; id begins at place offset of query.

    Both tables have an id and a column fingerprint. Recordings of equal fingerprints are one, named by the least id; copies
    is their number. Every match by the definition of searched() is found.
    """
    root = root or shared_dir(prints.sparkSession)
    mark = [F.xxhash64("fingerprint").alias("p"), F.xxhash64("fingerprint", F.lit(1)).alias("q")]
    known = prints.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), *mark)
    classes = written(known.groupBy("p", "q").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies")), root, "classes")
    one = prints.select(F.col(id_col).cast("long").alias("id"), "fingerprint", *mark).join(classes, ["id", "p", "q"]).groupBy("id", "p", "q").agg(F.first("fingerprint").alias("fingerprint"), F.first("copies").alias("copies"))
    one = written(one.withColumn("place", F.monotonically_increasing_id()), root, "different")
    asked = queries.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("query"), *mark).distinct().join(one.select("p", "q", F.col("place").alias("mine")), ["p", "q"])
    asked = written(asked.select("query", "mine"), root, "asked")
    far = searched(one, asked)
    # the others of a query's own class are its exact copies
    same = one.where("copies > 1").select(F.col("place").alias("mine"), "id", F.lit(0).cast("long").alias("offset"), F.lit(0.0).alias("error"), (F.col("copies") - 1).alias("copies"))
    return asked.join(far.unionByName(same), "mine").select("query", "id", "offset", "error", "copies")


def softened(audio: bytes | None, hop: int) -> bytes:
    """A recording from its second quarter of frames to the third, at half the volume."""
    samples = np.frombuffer(audio or b"", np.uint8).astype(np.int16)
    quarter = len(samples) // 4 // hop * hop
    return ((samples[quarter : len(samples) - quarter] - 128) // 2 + 128).astype(np.uint8).tobytes()


def recordings(docs: DataFrame, pitch: Pitch = SHORT) -> DataFrame:
    """Each document's bytes as a recording, aligned with its own quieter excerpt and with the next recording, and searched.

    doc_id, n_places, fingerprint_sha256, excerpt_at (where the excerpt was cut), excerpt_offset, excerpt_error,
    next_offset, next_error; for ids divisible by 50 n_matches among all other recordings, and the best one's match_id (the
    least id with that fingerprint, of equal errors the smallest), match_offset and match_error, else null. A single
    recording is its own next.
    """
    spark, root = docs.sparkSession, shared_dir(docs.sparkSession)
    df = docs.select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("audio"))

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        audio = batch.column(batch.schema.get_field_index("audio")).to_pylist()
        return [pa.array([fingerprint(x, pitch).tobytes() for x in audio], pa.binary()), pa.array([fingerprint(softened(x, pitch.hop), pitch).tobytes() for x in audio], pa.binary()), pa.array([len(x) // 4 // pitch.hop for x in audio], pa.int64())]

    prints = with_arrow(df, run, [StructField("fingerprint", BinaryType()), StructField("excerpt", BinaryType()), StructField("excerpt_at", LongType())]).drop("audio")
    prints = written(prints, root, "fingerprints")
    found = matches(prints, prints.where("doc_id % 50 = 0 and length(fingerprint) > 0"), root=f"{root}/search")
    best = F.min(F.struct("error", "id", "offset")).alias("b")
    found = written(found.distinct().groupBy("query").agg(best, F.sum("copies").alias("n_matches")), root, "matches")
    rows, window = with_next(prints, text_col="fingerprint")
    rows = rows.withColumn("next", F.lead("fingerprint").over(window)).where("not __again")
    rows = aligned(rows.select("doc_id", "fingerprint", "excerpt", "excerpt_at", "next"), [("fingerprint", "excerpt", "excerpt_offset", "excerpt_error"), ("fingerprint", "next", "next_offset", "next_error")])
    rows = rows.select("doc_id", (F.length("fingerprint") / 4).cast("long").alias("n_places"), F.sha2("fingerprint", 256).alias("fingerprint_sha256"), "excerpt_at", "excerpt_offset", "excerpt_error", "next_offset", "next_error")
    n = F.when(F.col("doc_id") % 50 == 0, F.coalesce("n_matches", F.lit(0)))
    out = rows.join(found, rows["doc_id"] == found["query"], "left").select(*rows.columns, n.cast("long").alias("n_matches"), F.col("b.id").alias("match_id"), F.col("b.offset").alias("match_offset"), F.col("b.error").alias("match_error"))
    out = written(out, root, "result")
    forget(spark, root, "fingerprints", "matches", "search")
    return out
