"""Language identification by interpolated Kneser-Ney character language models.

Text is lower-cased, runs of anything but letters and apostrophes become one space, and each model predicts
every character from the ORDER - 1 before it. The highest order uses counts, the lower ones the number of different
characters seen before (continuation counts), each discounted by D_k = n1 / (n1 + 2 n2) of its order and language and
interpolated with the next lower order; the lowest is uniform. The models of all languages share, for each order,
one array of n-grams sorted by hash with a directory of its leading bits, and one row of probabilities a language.

A text belongs to the language of the lowest cross-entropy per character. Its score is the share of that language
in a softmax of the total cross-entropies, damped by a temperature; the calibrated rejection marks texts whose
cross-entropy is above what all but REJECTED of the language's texts have. Both are fitted on training texts, about
CALIBRATION for each language, and at most a tenth of them, by models that were not trained on these texts.

Counting is a Spark aggregation over all training texts. A symbol is the code point itself; those beyond 16 bits share
SPARE symbols by their last bits. Up to MOST_GRAMS different n-grams of the highest order are collected and the models are
broadcast. Beyond that nothing is left out: the counts stay tables, the probabilities of the texts' n-grams are found by
joins, order by order, and joined to the texts.

Rows of one doc_id are texts of their own; a null id is in no held-out fold. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, LongType, StringType, StructField

from hindcast.llm.common import in_fold, shared_dir, small_batches, texts, with_arrow, written

ORDER, REJECTED, MOST_GRAMS = 4, 0.001, 8_000_000
#: Texts of each language that calibrate the temperature and the rejection, in the mean.
CALIBRATION = 500
#: Of the texts' n-grams, so many that are in most texts are joined by broadcast, as each has a row for every text.
HOT = 10_000
#: Characters that are taken in at once; only a single longer text exceeds it.
CHUNK = 1 << 20
BREAK = re.compile(r"[\W\d_]+")
MIX = np.uint64(0x9E3779B97F4A7C15)
#: Symbols of code points beyond 16 bits: so many from the surrogates' place on, which no text holds.
SURROGATES, SPARE = 0xD800, 0x800


def symbols_of(texts_: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The normal form of all texts as one array of symbols, each text between spaces, and where each begins."""
    forms = [" " + BREAK.sub(" ", t.lower()).strip() + " " for t in texts_]
    flat = np.frombuffer("".join(forms).encode("utf-32-le", "replace"), np.uint32)
    if len(flat) and flat.max() > 0xFFFF:
        flat = np.where(flat > 0xFFFF, SURROGATES + flat % SPARE, flat)
    return flat.astype(np.uint16), np.concatenate([[0], np.cumsum([len(f) for f in forms])])


def chunks(texts_: list[str]):
    """Slices of the texts of about CHUNK characters."""
    start, size = 0, 0
    for k, text in enumerate(texts_):
        size += len(text)
        if size >= CHUNK:
            yield slice(start, k + 1)
            start, size = k + 1, 0
    if start < len(texts_):
        yield slice(start, len(texts_))


def packed(symbols: np.ndarray, n: int) -> np.ndarray:
    """n-grams ending at each place from n - 1 on, sixteen bits a symbol."""
    out = symbols[n - 1 :].astype(np.uint64)
    for k in range(1, n):
        out |= symbols[n - 1 - k : len(symbols) - k].astype(np.uint64) << np.uint64(16 * k)
    return out


def lowest(n: int) -> np.uint64:
    """The bits of n symbols."""
    return np.uint64((1 << 16 * n) - 1)


def counted(training: DataFrame, languages: list[str]) -> DataFrame:
    """(own, lang, gram, n) of the highest order over all training texts, by the column own and the language's number; partial
    sums are taken in each task."""
    which = {x: k for k, x in enumerate(languages)}
    small_batches(training.sparkSession)

    def run(batches):
        for batch in batches:
            whole, of = texts(batch), [2 * which[x] + y for x, y in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            found: dict[int, list] = {}
            for part in chunks(whole):
                kinds = np.array(of[part])
                for kind in np.unique(kinds):
                    symbols, starts = symbols_of([t for t, k in zip(whole[part], kinds, strict=True) if k == kind])
                    if len(symbols) < ORDER:
                        continue
                    inside = np.ones(len(symbols) - ORDER + 1, bool)
                    for k in range(1, ORDER):  # n-grams that begin so near a text's end are no n-grams
                        inside[np.minimum(starts[1:] - k, len(inside) - 1)[starts[1:] - k < len(inside)]] = False
                    found.setdefault(int(kind), []).append(np.unique(packed(symbols, ORDER)[inside], return_counts=True))
            for kind, parts in found.items():
                grams, of_gram = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
                n = np.bincount(of_gram, np.concatenate([n for _, n in parts]), len(grams)).astype(np.int64)
                columns = [pa.array(np.full(len(grams), bool(kind % 2))), pa.array(np.full(len(grams), kind // 2, np.int32)), pa.array(grams.view(np.int64)), pa.array(n)]
                yield pa.RecordBatch.from_arrays(columns, names=["own", "lang", "gram", "n"])

    apart = training.select("text", "lang", "own").mapInArrow(run, "own boolean, lang int, gram long, n long")
    return apart.groupBy("own", "lang", "gram").agg(F.sum("n").alias("n"))


class Grams:
    """n-grams in the order of their hash, with a directory of the leading bits of the hash."""

    def __init__(self, grams: np.ndarray) -> None:
        hashes = grams * MIX
        self.order = np.argsort(hashes)
        self.grams = grams[self.order]
        self.bits = max(1, int(len(grams)).bit_length())
        leading = hashes[self.order] >> np.uint64(64 - self.bits)
        self.starts = np.searchsorted(leading, np.arange((1 << self.bits) + 1, dtype=np.uint64)).astype(np.int32)
        self.deepest = int(np.diff(self.starts).max()) if len(grams) else 0

    def find(self, grams: np.ndarray) -> np.ndarray:
        """The row of each n-gram, -1 if it isn't there."""
        lead = (grams * MIX >> np.uint64(64 - self.bits)).astype(np.int64)
        at, end = self.starts[lead], self.starts[lead + 1]
        last = max(0, len(self.grams) - 1)
        found = np.where((at < end) & (self.grams[np.minimum(at, last)] == grams), at, -1) if len(self.grams) else np.full(len(grams), -1)
        left = np.flatnonzero((found < 0) & (end - at > 1))
        for depth in range(1, self.deepest):
            if not len(left):
                break
            row = at[left] + depth
            inside = row < end[left]
            left, row = left[inside], row[inside]
            hit = self.grams[row] == grams[left]
            found[left[hit]] = row[hit]
            left = left[~hit]
        return found


@dataclass
class Models:
    languages: list[str]
    #: For each order from the highest: its n-grams and log probabilities, and contexts with their log back-off weights.
    levels: list = field(default_factory=list)
    uniform: float = 0.0
    temperature: float = 1.0
    limits: np.ndarray | None = None

    def log_probabilities(self, grams: np.ndarray) -> np.ndarray:
        """A row for each language and n-gram of the highest order."""
        out = np.zeros((len(grams), len(self.languages)), np.float32)
        left = np.arange(len(grams))
        for n, (known, logp, contexts, backoff) in zip(range(ORDER, 0, -1), self.levels, strict=True):
            own = grams[left] & lowest(n)
            row = known.find(own)
            hit = row >= 0
            out[left[hit]] += logp[row[hit]]
            left, own = left[~hit], own[~hit]
            if not len(left):
                return out
            context = contexts.find(own >> np.uint64(16))
            seen = context >= 0
            out[left[seen]] += backoff[context[seen]]
        out[left] += self.uniform
        return out

    def entropies(self, texts_: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Nats per character of each text for each language, and the number of characters predicted."""
        found = [self.chunk_entropies(texts_[part]) for part in chunks(texts_)]
        return np.concatenate([e for e, _ in found] or [np.zeros((0, len(self.languages)))]), np.concatenate([n for _, n in found] or [np.zeros(0, int)])

    def chunk_entropies(self, texts_: list[str]) -> tuple[np.ndarray, np.ndarray]:
        symbols, starts = symbols_of(texts_)
        sums, chars = np.zeros((len(texts_), len(self.languages))), np.maximum(np.diff(starts) - (ORDER - 1), 0)
        own = np.flatnonzero(chars)
        if len(own):
            # a text's own n-grams end from its ORDER-th character on; each text is summed alone, so it is the same in any batch
            logp = np.concatenate([self.log_probabilities(packed(symbols, ORDER)), np.zeros((1, len(self.languages)), np.float32)])
            edges = np.stack([starts[own], starts[own] + chars[own]], 1).ravel()
            sums[own] = np.add.reduceat(logp, edges, axis=0, dtype=np.float64)[::2]
        return -sums / np.maximum(chars, 1)[:, None], chars


def kneser_ney(gram: np.ndarray, lang: np.ndarray, counts: np.ndarray, languages: list[str]) -> Models:
    """Models of the counts of the n-grams of the highest order."""
    model, n_lang = Models(languages), len(languages)
    raw = []
    for n in range(ORDER, 0, -1):
        grams, row = np.unique(gram, return_inverse=True)
        c = np.zeros((len(grams), n_lang))
        np.add.at(c, (row, lang), counts)
        contexts, of = np.unique(grams >> np.uint64(16), return_inverse=True)
        total, kinds = np.zeros((len(contexts), n_lang)), np.zeros((len(contexts), n_lang))
        np.add.at(total, of, c)
        np.add.at(kinds, of, c > 0)
        once, twice = (c == 1).sum(0), (c == 2).sum(0)
        discount = np.where(once > 0, once / np.maximum(once + 2 * twice, 1), 0.5)
        raw.append((n, grams, c, contexts, of, total, kinds, np.clip(discount, 0.05, 0.95)))
        if n > 1:  # continuation counts: each n-gram once for each language that has it
            at, lang = np.nonzero(c > 0)
            gram, counts = grams[at] & lowest(n - 1), np.ones(len(at))
    # the lowest order is interpolated with an even share for each symbol seen and one for all others
    model.uniform, lower = -float(np.log(len(raw[-1][1]) + 1)), None
    for n, grams, c, contexts, of, total, kinds, discount in reversed(raw):
        with np.errstate(divide="ignore", invalid="ignore"):
            weight = np.where(total > 0, discount * kinds / np.maximum(total, 1e-300), 1.0)
            weight = np.clip(weight, 1e-6, 1.0)
            p = np.where(total[of] > 0, np.maximum(c - discount, 0) / np.maximum(total[of], 1e-300), 0.0)
        if lower is None:
            below = np.full((len(grams), n_lang), np.exp(model.uniform))
        else:
            known, logp = lower
            below = np.exp(logp[known.find(grams & lowest(n - 1))])
        p = p + weight[of] * below
        index, context_index = Grams(grams), Grams(contexts)
        logp = np.log(p[index.order]).astype(np.float32)
        model.levels.insert(0, (index, logp, context_index, np.log(weight[context_index.order]).astype(np.float32)))
        lower = (index, logp)
    return model


def calibrate(model: Models, entropy: np.ndarray, chars: np.ndarray, own: np.ndarray) -> None:
    """The temperature of the softmax by log loss, and each language's cross-entropy limit; a language without texts has none."""
    model.limits = np.full(len(model.languages), np.inf)
    for k in range(len(model.languages)):
        if (mine := entropy[(own == k) & (chars > 0), k]).size:
            model.limits[k] = np.quantile(mine, 1 - REJECTED)
    if not len(own):
        return
    best = np.inf
    for t in np.geomspace(1, 200, 40):
        p = shares(entropy, chars, t)
        loss = -np.log(np.clip(p[np.arange(len(own)), own], 1e-9, 1)).mean()
        if loss < best:
            best, model.temperature = loss, float(t)


def shares(entropy: np.ndarray, chars: np.ndarray, temperature: float) -> np.ndarray:
    x = -entropy * np.minimum(chars, 500)[:, None] / temperature
    x = np.exp(x - x.max(1, keepdims=True))
    return x / x.sum(1, keepdims=True)


def grams_of(df: DataFrame, text_col: str) -> DataFrame:
    """(__row, gram, times): the n-grams of the highest order in each text and how often they are there."""
    small_batches(df.sparkSession)

    def run(batches):
        for batch in batches:
            rows, whole = batch.column(0).to_pylist(), texts(batch)
            for part in chunks(whole):
                symbols, starts = symbols_of(whole[part])
                for row, a, b in zip(rows[part], starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                    if b - a >= ORDER:
                        grams, n = np.unique(packed(symbols[a:b], ORDER), return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(grams), row)), pa.array(grams.view(np.int64)), pa.array(n)], names=["__row", "gram", "times"])

    return df.select("__row", F.col(text_col).alias("text")).mapInArrow(run, "__row long, gram long, times long")


@dataclass
class JoinedModels:
    """The same models as tables, for n-grams of any number: counts has (lang, gram, n) of the highest order."""

    languages: list[str]
    counts: DataFrame
    root: str
    temperature: float = 1.0
    limits: np.ndarray | None = None

    def log_probabilities(self, grams: DataFrame) -> DataFrame:
        """(gram, logp) of different n-grams of the highest order; logp is an array by language."""
        levels, counts = {}, self.counts.select("lang", "gram", "n")
        for n in range(ORDER, 0, -1):
            levels[n] = counts
            if n > 1:
                counts = counts.groupBy("lang", F.col("gram").bitwiseAND(int(lowest(n - 1))).alias("gram")).agg(F.count(F.lit(1)).alias("n"))
                counts = written(counts, self.root, f"level-{n - 1}") if n == ORDER else counts
        even, found = 1.0 / (levels[1].select("gram").distinct().count() + 1), None
        for n in range(1, ORDER + 1):
            level, cast = levels[n], F.broadcast if n <= 2 else (lambda df: df)
            discounts = [0.5] * len(self.languages)
            for r in level.groupBy("lang").agg(F.count_if(F.col("n") == 1).alias("once"), F.count_if(F.col("n") == 2).alias("twice")).collect():
                if r["once"]:
                    discounts[r["lang"]] = r["once"] / (r["once"] + 2 * r["twice"])
            discount = F.array(*(F.lit(float(np.clip(x, 0.05, 0.95))) for x in discounts))[F.col("lang")]
            contexts = level.groupBy("lang", F.shiftrightunsigned("gram", 16).alias("context")).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"))
            asked = grams if n == ORDER else grams.select(F.col("gram").bitwiseAND(int(lowest(n))).alias("gram")).distinct()
            asked = asked.select("gram", F.shiftrightunsigned("gram", 16).alias("context"), F.explode(F.array(*map(F.lit, range(len(self.languages))))).alias("lang"))
            asked = asked.join(cast(level), ["lang", "gram"], "left").join(cast(contexts), ["lang", "context"], "left")
            if found is None:
                below = F.lit(even)
            else:
                asked = asked.withColumn("lower", F.col("gram").bitwiseAND(int(lowest(n - 1)))).join(cast(found.toDF("lang", "lower", "below")), ["lang", "lower"])
                below = F.col("below")
            weight = F.coalesce(F.greatest(F.lit(1e-6), F.least(F.lit(1.0), discount * F.col("kinds") / F.col("total"))), F.lit(1.0))
            own = F.coalesce(F.greatest(F.col("n") - discount, F.lit(0.0)) / F.col("total"), F.lit(0.0))
            found = asked.select("lang", "gram", (own + weight * below).alias("p"))
        by_language = F.sort_array(F.collect_list(F.struct("lang", F.log("p").alias("logp"))))
        return found.groupBy("gram").agg(by_language["logp"].alias("logp"))

    def entropies(self, df: DataFrame, name: str, text_col: str = "text") -> DataFrame:
        """df with entropy, nats per character for each language, and chars of each text."""
        numbered = written(df.withColumn("__row", F.monotonically_increasing_id()), self.root, f"{name}-texts")
        rows = written(grams_of(numbered, text_col), self.root, f"{name}-grams")
        asked = rows.groupBy("gram").agg(F.count(F.lit(1)).alias("rows"))
        hot = written(asked.orderBy(F.desc("rows"), "gram").limit(HOT).select("gram"), self.root, f"{name}-hot")
        logp = written(self.log_probabilities(asked.select("gram")), self.root, f"{name}-logp")
        both = rows.join(F.broadcast(logp.join(F.broadcast(hot), "gram")), "gram").unionByName(rows.join(F.broadcast(hot), "gram", "left_anti").join(logp, "gram"))
        chars = F.sum("times")
        sums = both.groupBy("__row").agg(F.array(*(-F.sum(F.col("times") * F.col("logp")[k]) / chars for k in range(len(self.languages)))).alias("entropy"), chars.alias("chars"))
        none = F.array(*[F.lit(0.0)] * len(self.languages))
        joined = numbered.drop("entropy", "chars").join(sums, "__row", "left").drop("__row")
        return joined.withColumns({"entropy": F.coalesce("entropy", none), "chars": F.coalesce("chars", F.lit(0))})


def train(docs: DataFrame, most_grams: int = MOST_GRAMS) -> Models | JoinedModels | None:
    """Models of the documents outside the held-out fold that have a language; None if there is none."""
    usable = docs.where(F.col("lang").isNotNull() & ~in_fold("doc_id", 4, 2)).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "lang")
    sizes = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}
    languages = sorted(sizes)
    if not languages:
        return None
    share = F.create_map(*(F.lit(y) for x in languages for y in (x, int(1e6 * min(0.1, CALIBRATION / sizes[x])))))
    usable = usable.withColumn("own", F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.element_at(share, F.col("lang")))
    root = shared_dir(docs.sparkSession)
    counts = written(counted(usable, languages), root, "counts")
    whole, rest = (x.groupBy("lang", "gram").agg(F.sum("n").alias("n")) for x in (counts, counts.where("not own")))

    def model_of(rows: DataFrame) -> Models:
        found = rows.toArrow()
        return kneser_ney(found["gram"].to_numpy().view(np.uint64), found["lang"].to_numpy(), found["n"].to_numpy().astype(float), languages)

    if whole.count() > most_grams:
        model = JoinedModels(languages, written(whole, root, "whole"), f"{root}/whole-model")
        sample = JoinedModels(languages, written(rest, root, "rest"), f"{root}/rest-model").entropies(usable.where("own"), "sample")
    else:
        model = model_of(whole)
        others = docs.sparkSession.sparkContext.broadcast(model_of(rest))

        def run(batch: pa.RecordBatch) -> list[pa.Array]:
            entropy, chars = others.value.entropies(texts(batch))
            return [pa.array(entropy.tolist(), pa.list_(pa.float64())), pa.array(chars, pa.int64())]

        sample = with_arrow(usable.where("own"), run, [StructField("entropy", ArrayType(DoubleType())), StructField("chars", LongType())])
    sample = sample.orderBy(F.xxhash64("doc_id"), "doc_id", "chars").select("entropy", "chars", "lang").collect()
    own = np.array([languages.index(r["lang"]) for r in sample], int)
    calibrate(model, np.array([r["entropy"] for r in sample]).reshape(-1, len(languages)), np.array([r["chars"] for r in sample], int), own)
    return model


def identify(df: DataFrame, model: Models | JoinedModels | None, text_col: str = "text") -> DataFrame:
    """df with lang_pred, score and rejected for each whole text; columns of these names are replaced.

    lang_pred is `und` with score 0 where the text is null or has no letter, or nothing was learned; ties go to the
    first language in order of name. rejected: the cross-entropy is above the language's calibrated limit.
    """
    wide = isinstance(model, JoinedModels)
    kept = [c for c in df.columns if c not in ("lang_pred", "score", "rejected")]
    if wide:
        found = model.entropies(df.select(F.struct(*kept).alias("__own"), F.col(text_col).alias("text")), "all")
        model, df, text_col = replace(model, counts=None), found, "text"
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        of, whole = shared.value, texts(batch, text_col)
        pred, score, rejected = ["und"] * len(whole), np.zeros(len(whole)), np.ones(len(whole), bool)
        have = [k for k, t in enumerate(whole) if any(map(str.isalpha, t))] if of else []
        if have:
            if wide:
                entropy, chars = (batch.column(batch.schema.get_field_index(c)).take(pa.array(have)) for c in ("entropy", "chars"))
                entropy, chars = np.array(entropy.to_pylist()), chars.to_numpy()
            else:
                entropy, chars = of.entropies([whole[k] for k in have])
            best, share = entropy.argmin(1), shares(entropy, chars, of.temperature)
            for j, k in enumerate(have):
                pred[k] = of.languages[best[j]]
            score[have] = share[np.arange(len(have)), best]
            rejected[have] = entropy[np.arange(len(have)), best] > of.limits[best]
        return [pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())]

    out = with_arrow(df, run, [StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("rejected", BooleanType())])
    return out.select("__own.*", "lang_pred", "score", "rejected") if wide else out


def predicted(docs: DataFrame, most_grams: int = MOST_GRAMS) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of every document."""
    return identify(docs.select("doc_id", "text"), train(docs, most_grams)).select("doc_id", in_fold("doc_id", 4, 2).alias("held_out"), "lang_pred", "score", "rejected")
