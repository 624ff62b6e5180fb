"""LM scoring by logistic context mixing.

A text is its lower-cased words and one end. Every word is coded by binary decisions. The WORDS commonest words and
the end are leaves of a weight-balanced tree, whose order keeps the words of one group of documents (here: language) next to
each other, so that its first decisions tell the groups apart. Another word is coded as the leaf `escape`, then by the
decisions of a Huffman tree of bytes for each of its bytes and a space.

Bit predictors look up hashed contexts. In the word tree these are the node itself, the node after the previous word, and
the two previous words, whose commonest successor predicts the decisions on its path; in a spelled word the last one to
four bytes and the whole word so far. Their predictions, in the logistic domain, are combined by weights that a gate
chooses: how sure the two previous words are of their successor, and in a spelled word how often the word so far was
seen. The weights are learned from all training texts, each predictor without what a decision itself added to its counts:
Spark counts the decisions in the tree by their gate, bit and rounded inputs, and each Newton step sums over these counts
and over the decisions of all spelled words, each word as often as it occurs.
While a text is scored the mix is refined over the whole of it: a hashed predictor of how far the text's own decisions
are from the mix, a weight for each kind of gate and one for the own predictor take Newton steps after each block of words
was predicted, so that the result stays the log probability of the text. Blocks grow with the words before them.

All counts are aggregated over all training texts: Spark sums the words, the bits by hashed context in tables of fixed
size, and the successors of two words in shards whose number grows with the tokens; successors that occur once are no
prediction. The tables grow with the tokens up to a bound and are broadcast. A word's own count for the base is looked up
by its hash; the sorted hashes of the vocabulary are broadcast up to MOST_VOCABULARY words, beyond that the counts are
joined.

A null or blank text is the end alone. Rows of one doc_id are texts of their own and a null id is in no held-out fold.
With nothing to learn from, every word is spelled by even bits. Words of any length are scored whole.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, replace
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField

from hindcast.llm.common import in_fold, shared_dir, small_batches, texts, with_arrow, written

WORDS = 1 << 17
#: Words of a batch, by its bytes, that are looked up at once, texts that are scored side by side.
CHUNK, ABREAST = 1 << 16, 512
#: Decisions whose inputs are looked up at once, and words that are spelled at once in training.
AT_ONCE, WORDS_AT_ONCE = 1 << 17, 10_000
MOST_VOCABULARY = 4_000_000
#: Different words, and successors of two words, that a task holds before it sends their counts.
HELD_WORDS, HELD_PAIRS = 250_000, 1 << 21
DISCOUNT = 0.75
SPACE, ESCAPE, END = 32, b"\x00escape", b"\n"
#: Bits of each table's size for spelled words: contexts of one to four bytes, and the word so far.
TABLES = (14, 16, 19, 21, 22)
#: Bits of the size of the tables after one word, and after two words as they grow with the tokens; keys in a shard.
ONE_BITS, TWO_BITS, SHARD = 19, (14, 23), 1 << 21
#: A key of two words is a hash above the bits of the next word's leaf.
LEAF_BITS = 18
BLOB, PART = 14, 1 << 17
#: A stored prediction is in steps of 1/SCALE, at most LIMIT; DOUBT draws rarely seen contexts to even odds.
SCALE, LIMIT = 2048.0, 15.0
DOUBT, ONE_DOUBT = (0.0, 0.0, 1.0, 3.0, 0.3), 2.0
#: Gates of spelled words by the count of the word so far (below 0.5, 2, 8, 64, more) and the weights that the fit starts from.
GATES = np.array([0.5, 2, 8, 64])
WEIGHTS = np.array([[0.13, 0.16, 0.64, 0.57, 0.0], [0.21, 0.20, 0.42, 0.34, 0.18], [0.17, 0.16, 0.34, 0.49, 0.38], [0.11, 0.16, 0.26, 0.43, 0.46], [0.05, 0.03, 0.15, 0.41, 0.42]], np.float32)
#: Gates of the tree: 0 without a predicted word, else by how often it (2, 3, 4 to 7, more) and others (none, a quarter, as many, more) came.
TREE_GATES = 17
#: Weights in the tree that the fit starts from: the node, the node after a word, the predicted word.
TREE_WEIGHTS = np.array([[1.0, 0.0, 0.0]] + [[1.0, 0.0, 1.0]] * (TREE_GATES - 1), np.float32)
#: The mixing weights are fitted in so many Newton steps. Inputs in the tree, between -16 and 16, have so many bits of a cell's key.
STEPS, PRIOR, CELL_BITS = 4, 20.0, 9
#: The text's own predictor: bits of its table for the word tree's nodes and as many for spelled words, and how much must be seen before it counts.
OWN_BITS, OWN_PRIOR = 11, 1.5
#: The adaptive weights are those of the combined prediction, one for each of KINDS of gates (in the tree without and with a
#: prediction, spelled words new and known), and of the own one; WEIGHT_PRIOR holds them near one.
KINDS, WEIGHT_PRIOR = 4, 60.0
#: What was learned is used from the next block of words on; a block has a word, and one more for each BLOCK words before it.
BLOCK = 32
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").lower().split()


def split(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts as words_of() has them, one after another, and how many each text has; null is the empty text."""
    found = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(column, "")))
    words, ends = found.flatten(), found.offsets.to_numpy().astype(np.int64)
    some = pc.greater(pc.binary_length(words), 0)
    before = np.concatenate([[0], np.cumsum(some.to_numpy(zero_copy_only=False))])
    return words.filter(some).cast(pa.binary()), np.diff(before[ends - ends[0]])


def signs(bit: np.ndarray) -> np.ndarray:
    return bit.astype(np.float32) * 2 - 1


def stretched(zeros: np.ndarray, ones: np.ndarray, doubt: float) -> np.ndarray:
    """The log odds of a one, drawn to even odds where little was counted."""
    n = zeros + ones
    return np.clip(np.log((ones + 0.4) / (zeros + 0.4)) * n / np.maximum(n + doubt, 1e-9), -LIMIT, LIMIT)


def gate_of(code: np.ndarray) -> np.ndarray:
    """The gate of a predicted word: code holds how often it came in its low four bits, and others in its high ones; 0 is no prediction."""
    n, m = code & 15, code >> 4
    often = np.searchsorted([3, 4, 8], n, "right")
    sure = np.where(m == 0, 0, np.where(4 * m <= n, 1, np.where(m <= n, 2, 3)))
    return np.where(n < 2, 0, 1 + 4 * often + sure).astype(np.uint8)


GATE_OF = gate_of(np.arange(256))


def huffman(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lengths, nodes, bits) of a Huffman code of 256 bytes, each seen once more than counted; nodes[byte, k] is the inner
    node at the k-th decision."""
    heap = [(int(c) + 1, k, k) for k, c in enumerate(counts)]
    heapq.heapify(heap)
    parent: dict[int, tuple[int, int]] = {}
    made = 256
    while len(heap) > 1:
        (a, _, x), (b, _, y) = heapq.heappop(heap), heapq.heappop(heap)
        parent[x], parent[y] = (made, 0), (made, 1)
        heapq.heappush(heap, (a + b, made, made))
        made += 1
    paths = []
    for byte in range(256):
        path, at = [], byte
        while at in parent:
            at, bit = parent[at]
            path.append((at - 256, bit))
        paths.append(path[::-1])
    lengths = np.array([len(p) for p in paths])
    nodes, bits = np.zeros((256, lengths.max()), np.uint64), np.zeros((256, lengths.max()), bool)
    for byte, path in enumerate(paths):
        for k, (node, bit) in enumerate(path):
            nodes[byte, k], bits[byte, k] = node, bit
    return lengths, nodes, bits


def characters(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Of the bytes of all words with a space after them: where each word's begin, the bytes, and their contexts in each table."""
    flat = np.frombuffer(b"".join(w + b" " for w in words), np.uint8)
    sizes = np.array([len(w) + 1 for w in words], int)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    place = np.arange(len(flat)) - np.repeat(starts[:-1], sizes)
    before, contexts = flat.astype(np.uint64) + np.uint64(1), []
    context = np.zeros(len(flat), np.uint64)
    for k in range(1, 5):
        last = np.zeros(len(flat), np.uint64)
        last[k:] = before[:-k]
        last[place < k] = 0
        context = context * np.uint64(257) + last
        contexts.append(context)
    powers = np.ones(int(sizes.max()) if len(sizes) else 1, np.uint64)
    powers[1:] = _M1
    powers = np.cumprod(powers)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(before * powers[place])])
    contexts.append(sums[:-1] - np.repeat(sums[starts[:-1]], sizes))
    return starts, flat, contexts


def byte_rows(flat: np.ndarray, contexts: list[np.ndarray], sizes: list[int], code: tuple) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Of the decisions of bytes: how many each has, the bits, and for each of the contexts the slots in its table of so many bits."""
    lengths, nodes, bits = code
    n = lengths[flat]
    ends = np.cumsum(n)
    row = np.arange(ends[-1] if len(ends) else 0) + np.repeat(flat * np.int64(nodes.shape[1]) - (ends - n), n)
    node, bit, slots = ((nodes + np.uint64(1)) * _M3).ravel().take(row), bits.ravel().take(row), []
    for k, (x, size) in enumerate(zip(contexts, sizes, strict=True)):
        h = (x + np.uint64(k + 1)) * _M2
        h ^= h >> np.uint64(29)
        h = np.repeat(h * _M1, n)
        h += node
        h *= _M2
        h >>= np.uint64(64 - size)
        slots.append(h.view(np.int64))
    return n, bit, slots


def bit_rows(words: list[bytes], code: tuple) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
    """Of the decisions of all words with a space after them: where each word's begin, the bits, the slots in each table,
    and the slot in a segment's own table."""
    starts, flat, contexts = characters(words)
    n, bit, slots = byte_rows(flat, [*contexts, contexts[1]], [*TABLES, OWN_BITS], code)
    own = slots.pop() + (1 << OWN_BITS)
    return np.concatenate([[0], np.cumsum(n)])[starts], bit, slots, own


def beginnings(words: list[bytes], times: np.ndarray, code: tuple) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """(bits, slots, times) of the decisions of words that come so many times; a beginning that neighbours share is there once,
    with the times of all of them."""
    starts, flat, contexts = characters(words)
    sizes, key = np.diff(starts), ((contexts[-1] + np.uint64(1)) * _M2 + flat) * _M1
    # a byte whose word goes on as the one before does stands for that one's, and so on
    above = np.arange(len(flat)) - np.repeat(np.concatenate([[0], sizes])[: len(sizes)], sizes)
    of = np.where((above < np.repeat(starts[:-1], sizes)) & (above >= 0) & (key[above] == key), above, np.arange(len(flat)))
    while (of != (further := of[of])).any():
        of = further
    first, weight = np.flatnonzero(of == np.arange(len(flat))), np.bincount(of, np.repeat(times, sizes), len(flat))
    n, bit, slots = byte_rows(flat[first], [x[first] for x in contexts], TABLES, code)
    return bit, slots, np.repeat(weight[first], n)


def word_tree(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, bits, predictions, nodes) of the paths to the leaves of a weight-balanced tree in the order given; nodes are
    numbered from the root on, level by level."""
    total = np.concatenate([[0.0], np.cumsum(weights)])
    leaf = np.arange(len(weights))
    low, high = np.zeros(len(weights), int), np.full(len(weights), len(weights))
    made, rows = 0, []
    while len(leaf):
        open_ = high - low > 1
        leaf, low, high = leaf[open_], low[open_], high[open_]
        if not len(leaf):
            break
        node = made + np.cumsum(np.concatenate([[False], low[1:] != low[:-1]]))
        made = int(node[-1]) + 1
        half = (total[low] + total[high]) / 2
        cut = np.searchsorted(total, half)
        cut = np.clip(np.where(half - total[cut - 1] < total[cut] - half, cut - 1, cut), low + 1, high - 1)
        right = leaf >= cut
        rows.append((leaf.astype(np.int32), right, np.log((total[high] - total[cut]) / (total[cut] - total[low])).astype(np.float32), node.astype(np.int32)))
        low, high = np.where(right, cut, low), np.where(right, high, cut)
    if not rows:
        return np.array([0] * (len(weights) + 1)), np.zeros(0, bool), np.zeros(0, np.float32), np.zeros(0, np.int32)
    columns = [list(x) for x in zip(*rows, strict=True)]
    rows.clear()
    leaf = np.concatenate(columns[0])
    starts, order = np.concatenate([[0], np.cumsum(np.bincount(leaf, minlength=len(weights)))]), np.argsort(leaf, kind="stable").astype(np.int32)
    columns[0], leaf, out = None, None, []
    while len(columns) > 1:
        out.append(np.concatenate(columns.pop(1))[order])
    return starts, *out


def vocabulary(training: DataFrame, group_col: str) -> DataFrame:
    """(word, n, mainly) over all training texts: a word's count and the group of documents that has it most; the end counts
    as the word of one newline. Partial sums are taken in each task."""

    def run(batches):
        held, size = [], 0

        def summed():
            found = pa.concat_tables(held).group_by(["word", "group"], use_threads=False).aggregate([("n", "sum")])
            return found.select(["word", "group", "n_sum"]).rename_columns(["word", "group", "n"])

        for batch in batches:
            words, n = split(batch.column(0))
            groups = batch.column(1)
            for word, group in ((words, groups.take(pa.array(np.repeat(np.arange(len(n)), n)))), (pa.array([END] * len(n), pa.binary()), groups)):
                held.append(pa.table({"word": word, "group": group, "n": np.ones(len(word), np.int64)}))
                size += len(word)
            if size >= 4 * HELD_WORDS:
                held = [summed()]
                size = len(held[0])
                if size > HELD_WORDS:
                    yield from held[0].combine_chunks().to_batches()
                    held, size = [], 0
        if held:
            yield from summed().combine_chunks().to_batches()

    apart = training.select("text", F.col(group_col).cast("string")).mapInArrow(run, "word binary, group string, n long")
    return apart.groupBy("word", "group").agg(F.sum("n").alias("n")).groupBy("word").agg(F.sum("n").alias("n"), F.max_by("group", F.struct("n", "group")).alias("mainly"))


def byte_counts(vocab: DataFrame) -> np.ndarray:
    """How often each byte is in the vocabulary's words, a word counting once, with a space after each."""

    def run(batches):
        total = np.zeros(256)
        for batch in batches:
            joined_ = b" ".join(batch.column(0).to_pylist()) + b" "
            total += np.bincount(np.frombuffer(joined_, np.uint8), minlength=256)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(256)), pa.array(total)], names=["byte", "n"])

    out = np.zeros(256)
    for r in vocab.select("word").mapInArrow(run, "byte long, n double").groupBy("byte").agg(F.sum("n").alias("n")).collect():
        out[r["byte"]] = r["n"]
    return out


def merged(data: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(zeros, ones) of a blob of a table, from what the tasks sent."""
    z, o = np.zeros(1 << BLOB, np.float64), np.zeros(1 << BLOB, np.float64)
    for part in data:
        n = len(part) // 10
        held = np.frombuffer(part, np.uint16, n)
        z[held] += np.frombuffer(part, np.float32, n, 2 * n)
        o[held] += np.frombuffer(part, np.float32, n, 6 * n)
    return z, o


def blobs(k: int, seen: np.ndarray, size: int):
    """The rows (k, blob, data) of what isn't zero in a table of 2 ** size slots, zeros and ones by turns."""
    for blob in range(0, 1 << size, 1 << BLOB):
        z, o = (seen[2 * blob + b : 2 * (blob + (1 << BLOB)) : 2] for b in (0, 1))
        held = np.flatnonzero(z + o).astype(np.uint16)
        if len(held):
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([blob >> BLOB]), pa.array([held.tobytes() + z[held].astype(np.float32).tobytes() + o[held].astype(np.float32).tobytes()])], names=["k", "blob", "data"])


def tables(vocab: DataFrame, code: tuple) -> list[np.ndarray]:
    """(zeros, ones) in each table of the spelled words' predictors, each different word counting once: what is to be spelled
    is rare or new. Words lie in their order, so that a task's words share their beginnings; a task adds up its words in
    tables of fixed size and sends what isn't zero, in blobs."""
    shared = vocab.sparkSession.sparkContext.broadcast(code)

    def add(batches):
        seen = [np.zeros(2 << b, np.float32) for b in TABLES]
        for batch in longer(batches, WORDS_AT_ONCE):
            bit, slots, times = beginnings(batch.column(0).to_numpy(zero_copy_only=False).tolist(), np.ones(len(batch)), shared.value)
            for k, slot in enumerate(slots):
                np.add.at(seen[k], slot << 1 | bit, times.astype(np.float32))
        for k in range(len(TABLES)):
            yield from blobs(k, seen[k], TABLES[k])

    def merge(key, pdf):
        z, o = (np.minimum(x, 60_000).astype(np.float16) for x in merged(pdf["data"]))
        return pd.DataFrame({"k": [key[0]], "blob": [key[1]], "data": [z.tobytes() + o.tobytes()]})

    dealt = vocab.select("word").mapInArrow(add, "k long, blob long, data binary")
    out = [np.zeros((2, 1 << b), np.float16) for b in TABLES]
    for r in dealt.groupBy("k", "blob").applyInPandas(merge, "k long, blob long, data binary").toLocalIterator():
        put(out[r["k"]], r["blob"], np.frombuffer(r["data"], np.float16).reshape(2, -1))
    shared.destroy()
    return out


def in_parts(fn, table: np.ndarray) -> np.ndarray:
    """What fn makes of a table's zeros and ones, PART slots at a time to save memory."""
    return np.concatenate([fn(table[:, at : at + PART].astype(np.float32)) for at in range(0, table.shape[1], PART)])


def put(table: np.ndarray, blob: int, data: np.ndarray) -> None:
    """Sets a blob of a table of any size; the rows are the zeros and the ones."""
    part = table[:, blob << BLOB : (blob + 1) << BLOB]
    part[:] = data[:, : part.shape[1]]


@dataclass
class Model:
    """words: the leaves of the word tree in order, the escape first; counts: their training counts. spelled: (zeros, ones) by
    table; one: those after one word; two: the check byte, code and leaf that two words predict."""

    words: list[bytes]
    counts: np.ndarray
    code: tuple
    spelled: list | None = None
    one: np.ndarray | None = None
    two: tuple | None = None
    tree_weights: np.ndarray | None = None
    byte_weights: np.ndarray | None = None

    def grow(self) -> None:
        """What a worker derives once from the words."""
        if hasattr(self, "ids"):
            return
        # absolute discounting: what is taken from the words is the escape's
        weights = np.maximum(self.counts - DISCOUNT, 1 - DISCOUNT)
        weights[0] = self.counts[0] + DISCOUNT * len(self.counts)
        self.starts, bit, p, node = word_tree(weights)
        self.lengths = np.diff(self.starts)
        self.node, self.bit, self.codes = node, bit, path_codes(self.starts, bit)
        # the predictions of the nodes as they speak for the bit
        p *= signs(bit)
        self.signed = p
        own = np.arange(node.max(initial=0) + 1)
        self.own = np.where(own < 1 << OWN_BITS - 1, own, (1 << OWN_BITS - 1) + (own * 2654435761 >> 7) % (1 << OWN_BITS - 1)).astype(np.int16)[node]
        self.hashes = (np.arange(len(self.words), dtype=np.uint64) + np.uint64(1)) * _M2
        self.ids = WordIds(self.words)

    @property
    def p(self) -> np.ndarray:
        """The predictions of the tree's rows."""
        return self.signed * signs(self.bit)

    def prepare(self) -> None:
        """What a worker derives once from the words and the tables."""
        self.grow()
        if not hasattr(self, "first"):
            self.predict()

    def predict(self) -> None:
        """The predictions that follow from the counts in the tables."""
        self.first = stretched(*self.one.astype(np.float32), ONE_DOUBT).astype(np.float32)
        self.tables = [in_parts(lambda x, d=d: (stretched(*x, d) * SCALE).astype(np.int16), t) for t, d in zip(self.spelled, DOUBT, strict=True)]
        self.seen = in_parts(lambda x: np.searchsorted(GATES, x.sum(0), "right").astype(np.uint8), self.spelled[-1])

    def without_counts(self) -> Model:
        """The same for scoring only: predictions in place of the counts that they follow from."""
        out = replace(self)
        out.predict()
        out.spelled = out.one = None
        return out

    @cached_property
    def cells_of(self) -> tuple[np.ndarray, np.ndarray]:
        """For the fit: the rounded predictions of the tree's rows, and after one word by slot and bit, as they speak for the bit."""
        after = less_one(self.one, ONE_DOUBT)
        after[::2] *= -1
        return rounded(self.signed), rounded(after)

    @cached_property
    def spelled_less(self) -> tuple[list[np.ndarray], np.ndarray]:
        """For the fit: the predictions in spelled words by table, slot and bit, as they speak for the bit, and the gates."""

        def gates(x: np.ndarray) -> np.ndarray:
            z, o = x
            return np.searchsorted(GATES, np.stack([np.maximum(z - 1, 0) + o, z + np.maximum(o - 1, 0)], 1).ravel(), "right").astype(np.uint8)

        def less(x: np.ndarray, doubt: float) -> np.ndarray:
            out = (less_one(x, doubt) * SCALE).astype(np.int16)
            out[::2] *= -1
            return out

        return [in_parts(lambda x, d=d: less(x, d), t) for t, d in zip(self.spelled, DOUBT, strict=True)], in_parts(gates, self.spelled[-1])

    def contexts(self, ids: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the word before each token and of the two before; begins are the texts' first tokens."""
        others = np.fromiter(map(xxhash.xxh3_64_intdigest, self.ids.others), np.uint64, len(self.ids.others))
        own = np.concatenate([self.hashes, others])[ids]
        one, two = np.zeros(len(ids), np.uint64), np.zeros(len(ids), np.uint64)
        one[1:] = own[:-1]
        one[begins] = 0
        two[1:] = one[:-1]
        two[begins] = 0
        two = (one ^ (two >> np.uint64(31))) * _M1 + two * _M3
        two = (two ^ (two >> np.uint64(29))) * _M2
        return one * _M2, two ^ (two >> np.uint64(32))

    def leaves(self, ids: np.ndarray) -> np.ndarray:
        return np.where(ids < len(self.words), ids, 0)

    def rows(self, begins: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The tree's rows of n decisions each from begins on, one after another."""
        ends = np.cumsum(n)
        return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begins - (ends - n), n)

    def one_slots(self, one: np.ndarray, n: np.ndarray, row: np.ndarray) -> np.ndarray:
        h = self.node.take(row).astype(np.uint64)
        h *= _M3
        h += np.repeat(one, n)
        h *= _M1
        h >>= np.uint64(64 - ONE_BITS)
        return h.view(np.int64)

    def predicted(self, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(leaf, code) that the hashes of two words predict; code 0 is no prediction."""
        check, code, leaf = self.two
        bits = (len(check) - 1).bit_length()
        at = (two >> np.uint64(64 - bits)).astype(np.int64)
        return leaf[at], np.where(check[at] == (two >> np.uint64(64 - bits - 8)).astype(np.uint8), code[at], 0)

    def agreed(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many decisions from the root on two leaves have in common, all where they are equal."""
        out, still = np.zeros(len(a), np.int64), np.ones(len(a), bool)
        for code in self.codes:
            x = code[a] ^ code[b]
            for k in (1, 2, 4, 8, 16, 32):
                x |= x >> np.uint64(k)
            out += (64 - np.bitwise_count(x).astype(np.int64)) * still
            still &= x == 0
        return np.where(still, self.lengths[a], out)

    def stretches(self, leaf: np.ndarray, guessed: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(gate, n, right) of tokens: the first n decisions are on the predicted leaf's path and have the gate, the others have
        gate 0; right tells whether the predicted bit is right in the last of the n too, as it is before."""
        gate, n, right = GATE_OF[code], np.zeros(len(leaf), np.int64), guessed == leaf
        on = np.flatnonzero(gate)
        n[on] = self.agreed(leaf[on], guessed[on]) + ~right[on]
        return gate, n, right

    def in_tree(self, token: np.ndarray, step: np.ndarray | int, n: np.ndarray, leaf: np.ndarray, one: np.ndarray, gate: np.ndarray | None = None, right: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
        """For n decisions each of tokens in the tree, from a step on: the combined predictions as they speak for the bit, the
        bits as -1.0 and 1.0 and the own slots. Without a gate no leaf is predicted there."""
        row = self.rows(self.starts[leaf[token]] + step, n)
        sign, first, w = signs(self.bit.take(row)), self.first.take(self.one_slots(one[token], n, row)), self.tree_weights
        first *= sign
        if gate is None:
            return self.signed.take(row) * w[0, 0] + first * w[0, 1], sign, self.own.take(row)
        gate = gate[token]
        combined = self.signed.take(row) * np.repeat(w[gate, 0], n) + first * np.repeat(w[gate, 1], n) + np.repeat(w[gate, 2], n)
        wrong = ~right[token]
        combined[np.cumsum(n)[wrong] - 1] -= 2 * w[gate[wrong], 2]
        return combined, sign, self.own.take(row)

    def in_bytes(self, words: list[bytes]) -> tuple[np.ndarray, ...]:
        """For the decisions of spelled words: where each word's begin, the same, and whether the word so far is known."""
        starts, bit, slots, own = bit_rows(words, self.code)
        gate, z = self.seen.take(slots[-1]), np.zeros(len(bit), np.float32)
        for k, slot in enumerate(slots):
            z += self.tables[k].take(slot) * np.ascontiguousarray(self.byte_weights[:, k]).take(gate)
        sign = signs(bit)
        z *= sign
        z *= np.float32(1 / SCALE)
        return starts, z, sign, own, gate > 2

    def score(self, ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Natural log probabilities of texts that lie one after another in ids, up to ends, a 0 before all."""
        out, (one, two) = np.zeros(len(ends) - 1), self.contexts(ids, ends[:-1])
        for at in range(0, len(out), ABREAST):
            some = ends[at : at + ABREAST + 1]
            part = slice(some[0], some[-1])
            out[at : at + ABREAST] = self.mixed(ids[part], one[part], two[part], some - some[0])
        return out

    def blocks(self, ids: np.ndarray, one: np.ndarray, two: np.ndarray, ends: np.ndarray):
        """The decisions of texts that go side by side, by blocks of their tokens, as laid_out() has them."""
        tree, count, leaf = len(self.words), len(ends) - 1, self.leaves(ids)
        guessed, code = self.predicted(two)
        gate, on, right = self.stretches(leaf, guessed, code)
        rest, spelled = self.lengths[leaf] - on, ids >= tree
        text = np.repeat(np.arange(count), np.diff(ends))
        # a word that isn't in the tree is two tokens, the escape and its spelling
        place = np.arange(len(ids)) + np.cumsum(spelled) - spelled
        place -= place[ends[:-1]][text]
        edges = [0]
        while edges[-1] < place.max() + 2:
            edges.append(edges[-1] + 1 + edges[-1] // BLOCK)
        block = [np.searchsorted(edges, x, "right").astype(np.uint16) - 1 for x in (place, place[spelled] + 1)]
        order, later = (np.argsort(x, kind="stable") for x in block)
        found = [(order[rest[order] > 0], rest), (order[on[order] > 0], on), (np.flatnonzero(spelled)[later], np.full(len(ids), 40))]
        at = [block[0][found[0][0]], block[0][found[1][0]], block[1][later]]
        cuts = [np.searchsorted(x, np.arange(len(edges))) for x in at]
        work = sum(np.concatenate([[0], np.cumsum(n[token])])[cut] for (token, n), cut in zip(found, cuts, strict=True))
        begin = 0
        while begin < len(edges) - 1:
            end = max(begin + 1, int(np.searchsorted(work, work[begin] + AT_ONCE, "right")) - 1)
            (no, yes, other), when = (list(x) for x in zip(*((token[cut[begin] : cut[end]], x[cut[begin] : cut[end]]) for (token, _), x, cut in zip(found, at, cuts, strict=True)), strict=True))
            parts = [(when[0], text[no], rest[no], *self.in_tree(no, on[no], rest[no], leaf, one)), (when[1], text[yes], on[yes], *self.in_tree(yes, 0, on[yes], leaf, one, gate, right))]
            starts, *rows, known = self.in_bytes([self.ids.others[k] for k in (ids[other] - tree).tolist()])
            known_before = np.concatenate([[0], np.cumsum(known)])[starts]
            for some, before in ((~known, starts - known_before), (known, known_before)):
                parts.append((when[2], text[other], np.diff(before), *(x[some] for x in rows)))
            yield laid_out(parts, begin, end)
            begin = end

    def mixed(self, ids: np.ndarray, one: np.ndarray, two: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The same for texts that go side by side, block by block; a block is predicted by what was learned before it."""
        count = len(ends) - 1
        # what a slot of the own predictor has learned, and in the imaginary part how much it has seen
        table = np.full(count << OWN_BITS + 1, OWN_PRIOR * 1j, np.complex64)
        w, v, total = np.ones(count * KINDS, np.float32), np.ones(count, np.float32), np.zeros(count)
        w_sure, v_sure = np.full(count * KINDS, WEIGHT_PRIOR, np.float32), np.full(count, WEIGHT_PRIOR, np.float32)
        for ranges, gates, sizes, combined, bits, slots in self.blocks(ids, one, two, ends):
            missed, learned = 1 / (1 + np.exp(np.minimum(combined, 80))), np.empty(len(combined), np.complex64)
            learned.real, learned.imag = missed * bits, missed * (1 - missed)
            for here, there in ranges:
                gate, n, x, slot = gates[here], sizes[here], combined[there], slots[there]
                of, heads, seen = gate // KINDS, np.cumsum(n) - n, table.take(slot)
                s = seen.real / seen.imag
                s *= bits[there]
                z = x * np.repeat(w[gate], n) + s * np.repeat(v[of], n)
                e = np.exp(-np.clip(z, -30, 30, out=z))
                total -= np.bincount(of, np.add.reduceat(np.log(e + np.float32(1)), heads), count)
                p = e / (1 + e)
                curve, by_x, by_s = p * (1 - p), x * p, s * p
                w_sure[gate] += np.add.reduceat(x * x * curve, heads)
                w[gate] += np.add.reduceat(by_x, heads) / w_sure[gate]
                v_sure += np.bincount(of, np.add.reduceat(s * s * curve, heads), count).astype(np.float32)
                v += np.bincount(of, np.add.reduceat(by_s, heads), count).astype(np.float32) / v_sure
                np.add.at(table, slot, learned[there])
        return total


def path_codes(starts: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """The bits of the paths to the leaves, the first one highest, in as many rows of 64 as the longest path needs."""
    n = np.diff(starts)
    out = np.zeros((1 + max(n.max() - 1, 0) // 64, len(n)), np.uint64)
    for k in range(n.max()):
        leaf = np.flatnonzero(n > k)
        out[k // 64, leaf] |= bit[starts[leaf] + k].astype(np.uint64) << np.uint64(63 - k % 64)
    return out


def laid_out(parts: list[tuple], begin: int, end: int) -> tuple:
    """(ranges, gates, sizes, combined, bits, slots) of blocks from begin to end.

    parts has for each kind of gate the block, text and number of decisions of each token, ordered by block and text, then
    the decisions. A block's decisions lie by kind, then by text, in stretches that have their weights in common; sizes
    are theirs, and ranges has the slices of each block's stretches and decisions. Slots are those of all texts.
    """
    found = []
    for kind, (block, text, n, combined, bits, own) in enumerate(parts):
        own = own + np.repeat(text << OWN_BITS + 1, n)
        some = np.flatnonzero(n)
        block, text, n = block[some], text[some], n[some]
        heads = np.flatnonzero(np.concatenate([[True], (block[1:] != block[:-1]) | (text[1:] != text[:-1])])[: len(n)])
        size = np.add.reduceat(n, heads) if len(n) else n
        cut = np.searchsorted(block[heads], np.arange(begin, end + 1))
        found.append((cut, np.concatenate([[0], np.cumsum(size)])[cut], (text[heads] * KINDS + kind, size), (combined, bits, own)))
    stretches, rows = ([np.concatenate([x[k][i][x[at][b] : x[at][b + 1]] for b in range(end - begin) for x in found]) for i in range(len(found[0][k]))] for at, k in ((0, 2), (1, 3)))
    here, there = (sum(x[at] for x in found).tolist() for at in (0, 1))
    ranges = [(slice(a, b), slice(c, d)) for a, b, c, d in zip(here, here[1:], there, there[1:], strict=False) if b > a]
    return ranges, *stretches, *rows


class WordIds:
    """Ids of the tree's words; other words of a chunk get the next ones."""

    def __init__(self, words: list[bytes]) -> None:
        # no word holds a space, so none is taken for the escape
        self.words, self.others = pa.array([b" ", *words[1:]], pa.binary()), []

    def of(self, words: pa.Array) -> np.ndarray:
        found = pc.index_in(words, self.words)
        other = words.filter(found.is_null()).dictionary_encode()
        out = pc.fill_null(found, 0).to_numpy().astype(np.int64)
        out[found.is_null().to_numpy(zero_copy_only=False)] = len(self.words) + other.indices.to_numpy()
        self.others = other.dictionary.to_numpy(zero_copy_only=False).tolist()
        return out


def chunked(column: pa.Array, ids: WordIds):
    """(slice, ids, ends, bytes): the tokens of about CHUNK words of texts at once, the end after each text."""
    size = pc.fill_null(pc.binary_length(column), 0).to_numpy().astype(np.int64)
    before, at = np.concatenate([[0], np.cumsum(size)]), 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(before, before[at] + 6 * CHUNK, "right")) - 1)
        words, n = split(column[at:end])
        ends = np.concatenate([[0], np.cumsum(n + 1)])
        out = np.ones(ends[-1], np.int64)
        out[np.arange(len(words)) + np.repeat(np.arange(end - at), n)] = ids.of(words)
        total = np.concatenate([[0], np.cumsum(pc.binary_length(words).to_numpy(), dtype=np.int64)])
        yield slice(at, end), out, ends, np.diff(total[ends - np.arange(len(ends))]) + n + 1
        at = end


def longer(batches, rows: int):
    """The same rows in batches of so many at least, but for the last."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) >= rows:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def two_bits(tokens: int) -> int:
    return int(min(max(tokens.bit_length() - 2, TWO_BITS[0]), TWO_BITS[1]))


def context_tables(training: DataFrame, model: Model, tokens: int) -> tuple[np.ndarray, tuple]:
    """The tables after one and after two words, of all training texts.

    A task sends the bits after one word as blobs of a table of fixed size. Successors of two words are sent as packed keys
    with their counts, in shards of the leading bits of their hash; a shard has about SHARD keys however many there are,
    as its keys are summed in each task first, and gives its part of the table.
    """
    shared, bits = training.sparkSession.sparkContext.broadcast(model), two_bits(tokens)
    lead = min(bits, max(0, (tokens // SHARD).bit_length()))
    low = np.uint64((1 << LEAF_BITS) - 1)
    small_batches(training.sparkSession)

    def run(batches):
        of = shared.value
        of.grow()
        seen, held, size = np.zeros(2 << ONE_BITS), [], 0

        def sent():
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            edges = np.searchsorted(keys, np.arange(1, 1 << lead, dtype=np.uint64) << np.uint64(64 - lead)) if lead else np.zeros(0, int)
            edges = np.concatenate([[0], edges, [len(keys)]])
            some = np.flatnonzero(np.diff(edges))
            data = [keys[a:b].tobytes() + n[a:b].astype(np.uint32).tobytes() for a, b in zip(edges[some].tolist(), edges[some + 1].tolist(), strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(some), 1)), pa.array(some), pa.array(data, pa.binary())], names=["k", "blob", "data"])

        for batch in batches:
            for _, ids, ends, _ in chunked(batch.column(0), of.ids):
                leaf, (one, two) = of.leaves(ids), of.contexts(ids, ends[:-1])
                row = of.rows(of.starts[leaf], of.lengths[leaf])
                np.add.at(seen, of.one_slots(one, of.lengths[leaf], row) << 1 | of.bit.take(row), 1.0)
                held.append(two & ~low | leaf.astype(np.uint64))
                size += len(ids)
                if size >= HELD_PAIRS:
                    yield sent()
                    held, size = [], 0
        if held:
            yield sent()
        yield from blobs(0, seen, ONE_BITS)

    def merge(key, pdf):
        if key[0] == 0:
            return pd.DataFrame({"k": [0], "blob": [key[1]], "data": [b"".join(x.astype(np.float32).tobytes() for x in merged(pdf["data"]))]})
        parts = [(len(d) // 12, d) for d in pdf["data"]]
        keys = np.concatenate([np.frombuffer(d, np.uint64, n) for n, d in parts])
        n = np.concatenate([np.frombuffer(d, np.uint32, n, 8 * n) for n, d in parts])
        return pd.DataFrame({"k": [1], "blob": [key[1]], "data": [b"".join(x.tobytes() for x in successors(keys, n, bits, lead, key[1]))]})

    # each task has a table after one word of its own, so tasks are as few as keep all cores busy for a while
    apart = training.select("text").mapInArrow(run, "k long, blob long, data binary")
    one, size = np.zeros((2, 1 << ONE_BITS), np.float32), 1 << bits
    check, code, leaf = np.zeros(size, np.uint8), np.zeros(size, np.uint8), np.zeros(size, np.int32)
    for r in apart.groupBy("k", "blob").applyInPandas(merge, "k long, blob long, data binary").toLocalIterator():
        if r["k"] == 0:
            put(one, r["blob"], np.frombuffer(r["data"], np.float32).reshape(2, -1))
        else:
            n = size >> lead
            part = slice(r["blob"] * n, (r["blob"] + 1) * n)
            check[part], code[part], leaf[part] = np.frombuffer(r["data"], np.uint8, n), np.frombuffer(r["data"], np.uint8, n, n), np.frombuffer(r["data"], np.int32, n, 2 * n)
    shared.destroy()
    return one, (check, code, leaf)


def successors(keys: np.ndarray, counts: np.ndarray, bits: int, lead: int, shard: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(check, code, leaf) of a shard's slots: the commonest successor of the two words that have it most often there."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order].astype(np.int64)
    begins = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    keys, counts = keys[begins], np.add.reduceat(counts, begins)
    pair = keys >> np.uint64(LEAF_BITS)
    begins = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
    total, most = np.add.reduceat(counts, begins), np.maximum.reduceat(counts, begins)
    of = np.repeat(np.arange(len(begins)), np.diff(np.concatenate([begins, [len(keys)]])))
    best = np.flatnonzero((counts == most[of]) & (counts >= 2))
    # of equal ones the first; a slot is taken by the pair that has its successor most often
    best = best[np.unique(of[best], return_index=True)[1]]
    n, others, key = counts[best], total[of[best]] - counts[best], keys[best]
    slot = (key >> np.uint64(64 - bits)).astype(np.int64) - (shard << bits - lead)
    take = np.lexsort((key, -n, slot))
    take = take[np.unique(slot[take], return_index=True)[1]]
    size = 1 << bits - lead
    check, code, leaf = np.zeros(size, np.uint8), np.zeros(size, np.uint8), np.zeros(size, np.int32)
    at = slot[take]
    check[at] = (key[take] >> np.uint64(64 - bits - 8)).astype(np.uint8)
    code[at] = np.minimum(n[take], 15) | np.minimum(others[take], 15) << 4
    leaf[at] = (key[take] & np.uint64((1 << LEAF_BITS) - 1)).astype(np.int32)
    return check, code, leaf


def rounded(x: np.ndarray) -> np.ndarray:
    return np.clip(np.rint((x + 16) * (1 << CELL_BITS - 5)), 0, (1 << CELL_BITS) - 1).astype(np.uint16)


def less_one(table: np.ndarray, doubt: float) -> np.ndarray:
    """The prediction of each slot for a decision that was a zero, then a one, without that decision."""
    z, o = table.astype(np.float32)
    return np.stack([stretched(np.maximum(z - 1, 0), o, doubt), stretched(z, np.maximum(o - 1, 0), doubt)], 1).ravel()


def cells_in_tree(model: Model, ids: np.ndarray, ends: np.ndarray):
    """Cells, some at a time, of the decisions of training texts in the tree, without what they were counted for.

    A cell is a stretch (0 for the gate 0, else an odd number where the predicted leaf is wrong, an even one where it is
    right) and the rounded predictions of the node and after one word, as they speak for the bit.
    """
    leaf, (one, two) = model.leaves(ids), model.contexts(ids, ends[:-1])
    guessed, code = model.predicted(two)
    n, m, right = code & 15, code >> 4, guessed == leaf
    # a count of 15 stands for more, of which one is no loss
    less = np.where(right, n - ((n > 0) & (n < 15)), n) | np.where(right, m, m - ((m > 0) & (m < 15))) << 4
    gate, on, right = model.stretches(leaf, guessed, np.where(code == 0, 0, less))
    p, after = model.cells_of
    for begins, n in ((model.starts[leaf] + on, model.lengths[leaf] - on), (model.starts[leaf], on)):
        row = model.rows(begins, n)
        cell = p.take(row).astype(np.int64) << CELL_BITS
        cell |= after.take(model.one_slots(one, n, row) << 1 | model.bit.take(row))
        if n is on:
            cell += np.repeat(gate.astype(np.int64) << 1 + 2 * CELL_BITS, n)
            cell[np.cumsum(n)[(n > 0) & ~right] - 1] -= 1 << 2 * CELL_BITS
        yield cell


def inputs_of(cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(inputs, gate) of cells; the inputs speak for the bit."""
    p, after = ((cell >> k * CELL_BITS & (1 << CELL_BITS) - 1) / (1 << CELL_BITS - 5) - 16 for k in (1, 0))
    stretch = cell >> 2 * CELL_BITS
    return np.stack([p, after, np.where(stretch == 0, 0, 1 - 2 * (stretch & 1))]), stretch + 1 >> 1


def decisions(training: DataFrame, model: Model, root: str) -> DataFrame:
    """(cell, n): how many decisions of all training texts in the tree are in each cell; the model has no spelled words' tables yet."""
    shared = training.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        of, seen, size = shared.value, np.zeros(2 * TREE_GATES - 1 << 2 * CELL_BITS, np.int32), 0
        of.grow()

        def sent():
            cell = np.flatnonzero(seen)
            return pa.RecordBatch.from_arrays([pa.array(cell), pa.array(seen[cell].astype(np.int64))], names=["cell", "n"])

        for batch in batches:
            for _, ids, ends, _ in chunked(batch.column(0), of.ids):
                for cell in cells_in_tree(of, ids, ends):
                    if size + len(cell) >= 1 << 31:
                        yield sent()
                        seen[:], size = 0, 0
                    np.add.at(seen, cell, np.int32(1))
                    size += len(cell)
        yield sent()

    found = training.select("text").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    found = written(found, root, "cells")
    shared.destroy()
    return found


def slopes(x: np.ndarray, gate: np.ndarray, times: np.ndarray, w: np.ndarray) -> np.ndarray:
    """For each gate the slope of the log probability of so many decisions each by its weights w, and the curvature; x has a
    row for each input, as it speaks for the bit."""
    sums = np.zeros((*w.shape, w.shape[1] + 1))
    for g in range(len(w)):
        own = np.flatnonzero(gate == g)
        if len(own):
            u, t = x[:, own], times[own].astype(x.dtype)
            p = 1 / (1 + np.exp(np.clip(w[g].astype(x.dtype) @ u, -30, 30)))
            sums[g, :, 0] = u @ (t * p)
            sums[g, :, 1:] = u * (t * p * (1 - p)) @ u.T
    return sums


def fitted(cells: DataFrame, rare: DataFrame, model: Model) -> None:
    """Learns the mixing weights of each gate by Newton's method on the log loss of the decisions of all training texts.

    PRIOR holds the weights of gates that are rarely met near where they start.
    """
    weights, starts = [TREE_WEIGHTS.astype(float), WEIGHTS.astype(float)], (TREE_WEIGHTS, WEIGHTS)
    shared = cells.sparkSession.sparkContext.broadcast(Model([], np.zeros(0), model.code, model.spelled))

    def row(k: int, sums: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([k]), pa.array([sums.tobytes()])], names=["part", "sums"])

    for _ in range(STEPS):

        def in_tree(batches, w=weights[0]):
            sums = np.zeros((*w.shape, w.shape[1] + 1))
            for batch in batches:
                sums += slopes(*inputs_of(batch.column(0).to_numpy()), batch.column(1).to_numpy(), w)
            yield row(0, sums)

        def in_words(batches, w=weights[1]):
            sums = np.zeros((*w.shape, w.shape[1] + 1))
            for batch in longer(batches, WORDS_AT_ONCE):
                (spelled, gate), words = shared.value.spelled_less, batch.column(0).to_numpy(zero_copy_only=False).tolist()
                bit, slots, n = beginnings(words, batch.column(1).to_numpy(), shared.value.code)
                slots = [slot << 1 | bit for slot in slots]
                x = np.stack([t.take(slot) for t, slot in zip(spelled, slots, strict=True)]) * np.float32(1 / SCALE)
                sums += slopes(x, gate.take(slots[-1]), n, w)
            yield row(1, sums)

        kind, total = "part long, sums binary", [np.zeros((*w.shape, w.shape[1] + 1)) for w in weights]
        for r in cells.mapInArrow(in_tree, kind).union(rare.select("word", "n").mapInArrow(in_words, kind)).collect():
            total[r["part"]] += np.frombuffer(r["sums"]).reshape(total[r["part"]].shape)
        for w, start, part in zip(weights, starts, total, strict=True):
            for g in range(len(w)):
                step = np.linalg.solve(part[g, :, 1:] + PRIOR * np.eye(w.shape[1]), part[g, :, 0] - PRIOR * (w[g] - start[g]))
                w[g] += np.clip(step, -1, 1)
    shared.destroy()
    model.tree_weights, model.byte_weights = (w.astype(np.float32) for w in weights)


def train(docs: DataFrame, root: str, group_col: str = "lang") -> tuple[Model, DataFrame, int, int]:
    """The model, the vocabulary with its counts, the number of tokens and of different ones, of the documents that aren't
    held out. The group only orders the tree; scoring doesn't see it."""
    training = docs.where(~in_fold("doc_id", 7, 2))
    vocab = written(vocabulary(training, group_col), root, "vocabulary")
    tokens, kinds = vocab.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    common = vocab.where(F.col("word") != F.lit(bytearray(END))).orderBy(F.desc("n"), "word").limit(WORDS).toArrow()
    ends = vocab.where(F.col("word") == F.lit(bytearray(END))).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    leaves = sorted(zip((x or "" for x in common["mainly"].to_pylist()), common["word"].to_pylist(), common["n"].to_pylist(), strict=True))
    words = [ESCAPE, END, *(w for _, w, _ in leaves)]
    counts = np.array([tokens - ends - sum(n for *_, n in leaves), ends, *(n for *_, n in leaves)])
    rare = vocab.where(F.col("word") != F.lit(bytearray(END)))
    if leaves:
        least = min(n for *_, n in leaves)
        last = max(w for _, w, n in leaves if n == least)
        rare = rare.where((F.col("n") == 1) | (F.col("n") < least) | ((F.col("n") == least) & (F.col("word") > F.lit(bytearray(last)))))
    # in their order, so that neighbours share their beginnings
    rare = written(rare.select("word", "n").repartitionByRange(1 + kinds // 250_000, "word").sortWithinPartitions("word"), root, "rare")
    model = Model(words, counts, huffman(byte_counts(rare)))
    one, two = context_tables(training, model, tokens)
    model.one, model.two = one, two
    cells = decisions(training, model, root)
    model.spelled = tables(rare, model.code)
    fitted(cells, rare, model)
    return model, vocab, tokens, kinds


def hashed(vocab: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The sorted 64-bit hashes of the vocabulary and the counts in that order."""

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        return [pa.array(np.array([xxhash.xxh3_64_intdigest(w) for w in batch.column(0).to_pylist()], np.uint64).view(np.int64))]

    found = with_arrow(vocab, run, [StructField("h", LongType())]).select("h", "n").toArrow()
    h, n = found["h"].to_numpy().view(np.uint64), found["n"].to_numpy()
    order = np.argsort(h)
    return h[order], n[order].astype(np.int32 if not len(n) or n.max() < 2**31 else np.int64)


def scored(df: DataFrame, model: Model, counts: tuple[np.ndarray, np.ndarray] | None, tokens: int, kinds: int, text_col: str = "text") -> DataFrame:
    """df with n_tokens, n_known, base_score, score and bits_per_byte of each whole text; null is the empty text.

    counts are the vocabulary's hashes and counts; without them n_known and base_score are null, for joined() to fill.
    """
    shared = df.sparkSession.sparkContext.broadcast((model.without_counts(), counts))

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        of, known = shared.value
        of.prepare()
        whole, tree = batch.column(batch.schema.get_field_index(text_col)), len(of.words)
        tokens_, known_, base, score, bits = (np.zeros(len(whole)) for _ in range(5))
        for part, ids, ends, sizes in chunked(whole, of.ids):
            others = of.ids.others
            tokens_[part] = np.diff(ends)
            if known:
                c = np.concatenate([of.counts, np.zeros(len(others), np.int64)])
                h = np.fromiter(map(xxhash.xxh3_64_intdigest, others), np.uint64, len(others))
                if len(known[0]):
                    row = np.minimum(np.searchsorted(known[0], h), len(known[0]) - 1)
                    c[tree:] = np.where(known[0][row] == h, known[1][row], 0)
                known_[part] = np.add.reduceat((c > 0)[ids].astype(np.int64), ends[:-1])
                base[part] = np.add.reduceat(np.log10((c + 1) / (tokens + kinds + 1))[ids], ends[:-1])
            logp = of.score(ids, ends)
            score[part] = logp / np.log(10)
            bits[part] = -logp / np.log(2) / sizes
        out = [pa.array(tokens_.astype(np.int64)), pa.array(known_.astype(np.int64)), pa.array(base), pa.array(score), pa.array(bits)]
        if not known:
            out[1:3] = [pa.nulls(len(whole), pa.int64()), pa.nulls(len(whole), pa.float64())]
        return out

    fields = [StructField("n_tokens", LongType()), StructField("n_known", LongType()), StructField("base_score", DoubleType()), StructField("score", DoubleType()), StructField("bits_per_byte", DoubleType())]
    return with_arrow(df, run, fields)


def joined(df: DataFrame, vocab: DataFrame, tokens: int, kinds: int, text_col: str = "text") -> DataFrame:
    """n_known and base_score by a join of each text's words with the vocabulary, for vocabularies of any size."""

    def run(batches):
        for batch in batches:
            rows, words, times = [], [], []
            for row, text in zip(batch.column(0).to_pylist(), texts(batch), strict=True):
                found: dict[bytes, int] = {b"\n": 1}
                for w in words_of(text):
                    found[w] = found.get(w, 0) + 1
                rows += [row] * len(found)
                words += found
                times += found.values()
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(words, pa.binary()), pa.array(times, pa.int64())], names=["__row", "word", "times"])

    apart = df.select("__row", F.col(text_col).alias("text")).mapInArrow(run, "__row long, word binary, times long").join(vocab, "word", "left")
    c = F.coalesce("n", F.lit(0))
    sums = apart.groupBy("__row").agg(F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("n_known"), F.sum(F.col("times") * F.log10((c + 1) / F.lit(float(tokens + kinds + 1)))).alias("base_score"))
    return df.drop("n_known", "base_score").join(sums, "__row", "left")


def documents_scored(docs: DataFrame, most_vocabulary: int = MOST_VOCABULARY) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte of every document."""
    root = shared_dir(docs.sparkSession)
    model, vocab, tokens, kinds = train(docs, root)
    docs = docs.select("doc_id", "text")
    if kinds <= most_vocabulary:
        out = scored(docs, model, hashed(vocab), tokens, kinds)
    else:
        numbered = written(scored(docs.withColumn("__row", F.monotonically_increasing_id()), model, None, tokens, kinds), root, "scored")
        out = joined(numbered, vocab, tokens, kinds)
    held = in_fold("doc_id", 7, 2).alias("held_out")
    return out.select("doc_id", held, "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score", "bits_per_byte")
