"""Byte-level BPE encoding and decoding.

A text is cut into pieces by the tokenizer's pattern. In each piece a segment tree over the byte positions holds,
at the start of every live token, the rank of the pair that it forms with its right neighbour; a node keeps the
smaller of its children, and as the position is part of the key, the leftmost of equals. A merge takes the root
and updates the merged token, its left neighbour and the token that went, each in logarithmic time.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Callable

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField

from hindcast.llm.common import texts, with_arrow

POSITION_BITS = 40
NONE = 1 << 100
#: Pieces longer than this are encoded anew each time; a worker keeps at most so many others.
KEPT_PIECE, KEPT_PIECES = 64, 600_000


def load_ranks(path: str) -> dict[bytes, int]:
    """A .tiktoken file: lines of a base64 token and its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ranks of a piece's tokens; merges in order of rank, the leftmost first."""
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    n = len(piece)
    if n < 2:
        return [ranks[piece]] if n else []
    size = 1 << (n - 1).bit_length()
    tree = [NONE] * (2 * size)
    get = ranks.get
    for i in range(n - 1):
        if (rank := get(piece[i : i + 2])) is not None:
            tree[size + i] = rank << POSITION_BITS | i
    for i in range(size - 1, 0, -1):
        left, right = tree[2 * i], tree[2 * i + 1]
        tree[i] = left if left < right else right
    after = list(range(1, n + 1))
    before = list(range(-1, n))

    def put(i: int, key: int) -> None:
        i += size
        tree[i] = key
        while i > 1:
            other = tree[i ^ 1]
            i >>= 1
            if other < key:
                key = other
            if tree[i] == key:
                return
            tree[i] = key

    mask = (1 << POSITION_BITS) - 1
    while (top := tree[1]) != NONE:
        i = top & mask
        gone = after[i]
        end = after[gone]
        after[i] = end
        before[end] = i
        put(gone, NONE)
        rank = get(piece[i : after[end]]) if end < n else None
        put(i, NONE if rank is None else rank << POSITION_BITS | i)
        if (left := before[i]) >= 0:
            rank = get(piece[left:end])
            put(left, NONE if rank is None else rank << POSITION_BITS | left)
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : after[i]]])
        i = after[i]
    return out


class Codec:
    """Encodes and decodes texts in a worker; short pieces that recur are kept."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks, self.find, self.kept = ranks, regex.compile(pattern).findall, {}
        self.tokens: dict[int, bytes] = {rank: token for token, rank in ranks.items()}

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        kept, ranks = self.kept, self.ranks
        for piece in self.find(text):
            if (ids := kept.get(piece)) is None:
                ids = tuple(merge_piece(piece.encode("utf-8", "replace"), ranks))
                if len(piece) <= KEPT_PIECE:
                    if len(kept) >= KEPT_PIECES:
                        kept.clear()
                    kept[piece] = ids
            out += ids
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


_CODECS: dict[str, Codec] = {}


def _shared_codec(spark: SparkSession, path: str, pattern: str) -> Callable[[], Codec]:
    """The vocabulary, of fixed size, is broadcast; each worker builds one codec of it."""
    ranks, key = spark.sparkContext.broadcast(load_ranks(path)), uuid.uuid4().hex

    def codec() -> Codec:
        if key not in _CODECS:
            _CODECS.clear()
            _CODECS[key] = Codec(ranks.value, pattern)
        return _CODECS[key]

    return codec


def encode(df: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", ids_col: str = "ids", decoded_col: str | None = None) -> DataFrame:
    """df with ids_col, the token ids of each whole text (null is the empty text: no ids); special tokens are text.

    With decoded_col, also the bytes that the ids decode to. One pass over the rows without a shuffle; rows, their
    order in a partition and other columns stay. Columns named as the results are replaced.
    """
    codec = _shared_codec(df.sparkSession, ranks_path, pattern)

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        of = codec()
        ids = [of.encode(t) for t in texts(batch, text_col)]
        return [pa.array(ids, pa.list_(pa.int32()))] + ([pa.array([of.decode(x) for x in ids], pa.binary())] if decoded_col else [])

    fields = [StructField(ids_col, ArrayType(IntegerType()))] + ([StructField(decoded_col, BinaryType())] if decoded_col else [])
    return with_arrow(df, run, fields)


def decode(df: DataFrame, ranks_path: str, pattern: str, ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """df with decoded_col, the bytes of the tokens in ids_col (null or none: no bytes). An unknown id is an error."""
    codec = _shared_codec(df.sparkSession, ranks_path, pattern)

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        return [pa.array([codec().decode(x or []) for x in batch.column(batch.schema.get_field_index(ids_col)).to_pylist()], pa.binary())]

    return with_arrow(df, run, [StructField(decoded_col, BinaryType())])


def digests(df: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    coded = encode(df.select("doc_id", "text"), ranks_path, pattern, decoded_col="decoded")
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
