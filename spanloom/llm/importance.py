"""Quality classifier by importance resampling with hashed n-gram models.

Two generative models over hashed unigrams and bigrams: one of the target (texts labelled good) and one of the
raw text (every whole text of the corpus). Each n-gram falls into one of a fixed number of buckets and every
bucket has a share in both models; the log ratio of the two is what an n-gram adds to a text's weight. Texts
are drawn without replacement by Gumbel top-k: those with the k largest of log weight plus Gumbel noise.

Smoothing. Both models add a pseudo-count, in proportion to their sizes. Buckets of so few n-grams that the
target would be expected to have less than ``unknown`` of them share one class, as words outside the vocabulary
of a language model do: else each n-gram that only one text has would count against that text.

Length. A sum over a whole text mostly measures its length, and hides a few foreign words in a long one. The
weight is therefore taken relative to what a target text of the same length has on average, and a text is as
much like the target as its least likely window of WINDOW tokens, over all windows of the whole text.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, encoded, materialise

#: Labelled texts that the target model is fitted on at most, in order of a hash of their id.
MAX_LABELS = 50_000
#: log2 of the buckets of unigrams, and of those of bigrams.
BITS = 20
#: Pseudo-count of a bucket in the target model, and expected count below which buckets share one class.
PSEUDO, UNKNOWN = 0.02, 20.0
#: Tokens of a window, which starts at every half of one.
WINDOW = 64
#: Of the good labelled rows that the models were not fitted on, the share whose weight the drawn number is set by.
KEEP = 0.995
#: Weights are divided by this before the Gumbel noise is added; 1 draws in proportion to the importance.
TEMPERATURE = 1.0
SEED = 42
_TOKEN = re.compile(rb"[0-9a-z\x80-\xff]+|[^\s0-9a-z\x80-\xff]")
_BLANK = re.compile(rb"\s")
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: Bytes of a text taken apart at a time; pieces end before white space, which no token crosses.
PIECE = 1 << 20
#: Hash that stands before the first token.
_START = 2


def pieces(text: bytes, size: int = PIECE) -> Iterator[bytes]:
    at = 0
    while at < len(text):
        found = _BLANK.search(text, at + size)
        end = found.start() if found else len(text)
        yield text[at:end]
        at = end


def buckets(text: bytes, bits: int = BITS) -> np.ndarray:
    """(2, tokens): the bucket of each token, and of the bigram that ends with it, above those of tokens."""
    out, last, shift = [], _START, np.uint64(64 - bits)
    for piece in pieces(text):
        h = np.array([last, *map(zlib.crc32, _TOKEN.findall(piece.lower()))], np.uint64)
        last, here, before = int(h[-1]), h[1:], h[:-1]
        out.append(np.stack(((here * _A) >> shift, (((before * _A + here) * _B) >> shift) + np.uint64(1 << bits))).astype(np.int32))
    return np.concatenate(out, axis=1) if out else np.zeros((2, 0), np.int32)


def least_window(values: np.ndarray, window: int = WINDOW) -> float:
    """The smallest sum over a window; over all values if they are fewer."""
    if len(values) <= window:
        return float(values.sum())
    total = np.concatenate(([0.0], np.cumsum(values)))
    first = np.append(np.arange(0, len(values) - window, max(1, window // 2)), len(values) - window)
    return float((total[first + window] - total[first]).min())


def count_buckets(docs: DataFrame, fitted: DataFrame, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Counts of each bucket over all texts of docs (doc_id, text), and over those whose id is in ``fitted`` (doc_id, distinct).

    One pass over the texts. A task adds up its buckets before the shuffle, and the driver gets a row per bucket.
    """
    size = 2 << bits
    bound_batches(docs.sparkSession)

    def run(batches):
        raw, target = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for b in batches:
            for t, own in zip(b.column("text"), b.column("own").to_pylist()):
                at, n = np.unique(buckets(encoded(t.as_py()), bits), return_counts=True)
                raw[at] += n
                if own:
                    target[at] += n
        held = np.flatnonzero(raw)
        for i in range(0, len(held), 1 << 16):
            at = held[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(raw[at]), pa.array(target[at])], ["bucket", "raw", "target"])

    rows = docs.select("doc_id", "text").join(F.broadcast(fitted.select("doc_id", F.lit(True).alias("own"))), "doc_id", "left").select("text", "own")
    sums = rows.mapInArrow(run, "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    found, raw, target = sums.toArrow(), np.zeros(size), np.zeros(size)
    at = found.column("bucket").to_numpy()
    raw[at], target[at] = found.column("raw").to_numpy(), found.column("target").to_numpy()
    return raw, target


def log_ratios(raw: np.ndarray, target: np.ndarray, pseudo: float = PSEUDO, unknown: float = UNKNOWN) -> np.ndarray:
    """Log of target share over raw share of each bucket, less half of its mean over target tokens, as a token has two n-grams."""
    if not target.sum():
        return np.zeros(len(raw))
    expected = raw * (target.sum() / raw.sum())
    out, rare = np.log((target + pseudo) / (expected + pseudo)), expected < unknown
    if rare.any():
        out[rare] = math.log((target[rare].sum() + pseudo) / (expected[rare].sum() + pseudo))
    return out - (out * target).sum() / target.sum()


def log_weights(docs: DataFrame, fitted: DataFrame, bits: int = BITS, window: int = WINDOW, pseudo: float = PSEUDO, unknown: float = UNKNOWN) -> DataFrame:
    """(doc_id, weight): log of target over raw probability of each text's least likely window, see above.

    The raw model counts every text of docs, the target model those whose id is in ``fitted``. Null or empty
    text: weight 0. Ratios (4 bytes for each of the fixed number of buckets) are broadcast.
    """
    ratios = log_ratios(*count_buckets(docs, fitted, bits), pseudo, unknown).astype(np.float32)
    held = docs.sparkSession.sparkContext.broadcast(ratios)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        ratio = held.value
        for b in batches:
            w = [least_window(ratio[buckets(encoded(t.as_py()), bits)].sum(axis=0, dtype=np.float64), window) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(w, pa.float64())], ["doc_id", "weight"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, weight double")


def perturbed(weights: DataFrame, temperature: float = TEMPERATURE, seed: int = SEED) -> DataFrame:
    """Adds ``key``: weight / temperature plus Gumbel noise that a hash of the id and the seed decides."""
    u = (F.pmod(F.xxhash64(F.col("doc_id"), F.lit(seed)), F.lit(1 << 53)) + 0.5) / float(1 << 53)
    return weights.withColumn("key", F.col("weight") / temperature - F.log(-F.log(u)))


def kth_largest(df: DataFrame, column: str, k: int, bins: int = 4096) -> float | None:
    """The exact k-th largest value of a double column, by counting in ever narrower ranges: no sort, no row
    reaches the driver but the counts of at most ``bins`` ranges. None if there are fewer than k values."""
    n, lo, hi = df.agg(F.count(column), F.min(column), F.max(column)).first()
    if k < 1 or n < k:
        return None
    while lo < hi:
        step = (hi - lo) / bins
        if step == 0 or lo + step == lo:
            values = df.where(F.col(column).between(lo, hi)).groupBy(column).count().orderBy(F.desc(column)).collect()
            for v, c in values:
                if k <= c:
                    return v
                k -= c
        at = F.least(F.lit(bins - 1), F.floor((F.col(column) - lo) / step))
        found = df.where(F.col(column).between(lo, hi)).groupBy(at.alias("at")).agg(F.count("*").alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).collect()
        for r in sorted(found, key=lambda r: -r["at"]):
            if k <= r["n"]:
                lo, hi = r["lo"], r["hi"]
                break
            k -= r["n"]
    return lo


def gumbel_top_k(weights: DataFrame, k: int, temperature: float = TEMPERATURE, seed: int = SEED) -> DataFrame:
    """Adds ``key`` and ``kept``: true for the rows whose perturbed weight is among the k largest (ties all kept)."""
    keyed = perturbed(weights, temperature, seed)
    least = kth_largest(keyed, "key", k)
    if least is None:
        return keyed.withColumn("kept", F.lit(k >= 1))
    return keyed.withColumn("kept", F.col("key") >= least)


def split_labels(labels: DataFrame, max_labels: int = MAX_LABELS) -> tuple[DataFrame, DataFrame]:
    """(doc_id, good), one row per id: the good ones that the target model is fitted on, and those that set the number to draw.

    Half of the ids, by a hash, goes to either. A row of labels with a null doesn't count; an id is good if all of
    its rows have quality 1 and are not toxic.
    """
    known = labels.where("doc_id is not null and quality is not null and toxic is not null")
    known = known.groupBy("doc_id").agg(F.min((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("good"))
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    return known.where(half & F.col("good")).orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id").limit(max_labels), known.where(~half)


def number_to_draw(weights: DataFrame, held_out: DataFrame, keep: float = KEEP) -> int:
    """Rows whose weight is at least that which ``keep`` of the held-out good rows reach; all rows without held-out rows of both kinds."""
    known = weights.join(held_out, "doc_id")
    good = known.where("good").select("weight")
    n_good, n_bad = known.agg(F.count_if("good"), F.count_if(~F.col("good"))).first()
    least = kth_largest(good, "weight", max(1, math.ceil(keep * n_good))) if n_good and n_bad else None
    return weights.count() if least is None else weights.where(F.col("weight") >= least).count()


def classify(docs: DataFrame, labels: DataFrame, k: int | None = None, max_labels: int = MAX_LABELS, temperature: float = TEMPERATURE, seed: int = SEED, **model) -> DataFrame:
    """(doc_id, weight, key, kept) for every row of docs (doc_id, text): the k rows that are drawn have ``kept``.

    ``labels`` has doc_id, quality, toxic. k is the number of rows to draw; without one it is set by labelled
    rows that the models were not fitted on, see number_to_draw(). ``model``: bits, window, pseudo, unknown of
    log_weights(). Extra columns are ignored. Without labels of both kinds all rows are kept. Null and empty
    texts have weight 0. Rows with equal ids get the same noise and are drawn each by their own weight; rows
    with a null id are drawn like others. Ties at the k-th place are all kept. An empty table gives no rows.
    """
    fitted, held_out = split_labels(labels.select("doc_id", "quality", "toxic"), max_labels)
    weights = materialise(log_weights(docs, fitted, **model), "weights")
    return gumbel_top_k(weights, number_to_draw(weights, held_out) if k is None else k, temperature, seed)
