"""SimHash near-duplicates by covering locality-sensitive hashing.

Covering: give each of the 64 bit places a non-zero vector of r + 1 bits. Mask v (one for each non-zero
vector v, 2^(r+1) - 1 in all) keeps the places whose vector has odd inner product with v. The places in
which two fingerprints within radius r differ span at most r dimensions, so some v is orthogonal to all
of them: that table masks them out and the pair meets there. No pair within the radius is missed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, checkpoint, encoded, materialise
from .components import connected_components

BITS = 64
#: Shingles hashed at a time within one text.
CHUNK = 1 << 16


def covering_masks(places: list[int], radius: int) -> list[int]:
    """Masks over the given bit places such that any two words within the radius agree under one of them.

    With fewer places than vectors the largest vectors are dealt: those with the top bit set are an affine
    space, on which every mask keeps half of the places or all, so that none is left with a bit or two.
    """
    n = (1 << (radius + 1)) - 1
    vector = {p: i % n + 1 if len(places) >= n else n - i for i, p in enumerate(places)}
    return [sum(1 << p for p in places if (vector[p] & v).bit_count() & 1) for v in range(1, n + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _votes(hashes, total: np.ndarray) -> int:
    h = np.array(hashes, dtype="<u8")
    total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return len(h)


def simhash(text: bytes, k: int, seed: int = 42) -> int:
    """Fingerprint of the k-word shingles (repeats included) of a text, ASCII letters in lower case.

    Fewer than k words: the whole sequence is the one shingle. No word: zero. A bit is 1 if it is set in
    over half of the shingles' XXH64.
    """
    words = text.lower().split()
    if not words:
        return 0
    digest, total, n = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64), 0
    if len(words) <= k:
        n = _votes([digest(b" ".join(words), seed)], total)
    else:
        for at in range(0, len(words) - k + 1, CHUNK):
            part = words[at : at + CHUNK + k - 1]
            line = b" ".join(part)
            ends = np.cumsum([len(w) + 1 for w in part])
            starts = [0, *ends[: len(part) - k].tolist()]
            n += _votes([digest(line[a:b], seed) for a, b in zip(starts, (ends[k - 1 :] - 1).tolist())], total)
    return int(np.packbits(total * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, seed: int = 42) -> DataFrame:
    """``(doc_id, fp)``: the 64-bit fingerprint of each whole text as a signed long. Null text: no words."""
    bound_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            fps = [_signed(simhash(encoded(t.as_py()), k, seed)) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


def _keep(mask: int, bits: str = "fp"):
    return F.col(bits).bitwiseAND(F.lit(_signed(mask)))


def _roots(fps: np.ndarray, ids: np.ndarray, radius: int) -> np.ndarray:
    """For each member of a bucket, the smallest id that links within the radius reach inside the bucket."""
    n, label = len(fps), ids.copy()
    near = []
    for a in range(0, n, 256):
        near.append(np.bitwise_count(fps[a : a + 256, None] ^ fps[None, :]) <= radius)
    near = np.concatenate(near)
    while True:
        new = np.array([label[row].min() for row in near])
        if (new == label).all():
            return label
        label = new


def _edges_in_buckets(groups: DataFrame, radius: int) -> DataFrame:
    """groups: a list column ``m`` of structs (id, fp). Emits for each member a link to its local root, never all pairs."""

    def run(batches):
        for b in batches:
            a_out, b_out = [], []
            for x in b.column(0):
                v = x.values
                ids = v.field("id").to_numpy()
                fps = v.field("fp").to_numpy().view(np.uint64)
                if len(ids) == 2:
                    if int(fps[0] ^ fps[1]).bit_count() <= radius:
                        a_out.append([ids[0]])
                        b_out.append([ids[1]])
                    continue
                root = _roots(fps, ids, radius)
                far = root != ids
                a_out.append(ids[far])
                b_out.append(root[far])
            cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(cat(a_out), pa.int64()), pa.array(cat(b_out), pa.int64())], ["a", "b"])

    return groups.mapInArrow(run, "a long, b long")


def covering_links(nodes: DataFrame, radius: int = 2) -> DataFrame:
    """Links ``(a, b)`` between ids whose distinct fingerprints are joined by steps of at most ``radius`` bits.

    ``nodes``: one row ``(id, fp)`` per distinct fingerprint. Level 1 deals every fingerprint to
    2^(r+1) - 1 masked tables and counts the buckets (pre-aggregated, so a hot bucket is a row per task).
    Pairs alone in a bucket are compared at once. Members of larger buckets are dealt again by a covering
    of the bits their table masked out; what is then still free is so few bits that a bucket holds at most
    2^free distinct fingerprints (4,096 for radius 2), a bound that the data can't exceed. No bucket is cut
    and none can grow with the corpus.
    """
    bound_batches(nodes.sparkSession)
    full = (1 << BITS) - 1
    first = covering_masks(list(range(BITS)), radius)
    second = [[m | s for s in covering_masks([p for p in range(BITS) if not m >> p & 1], radius)] for m in first]
    free = max((full & ~m).bit_count() for row in second for m in row)
    if free > 12:
        raise ValueError("this radius leaves buckets without a useful bound")
    keyed = nodes.select("id", "fp", F.posexplode(F.array(*[_keep(m) for m in first])).alias("t", "key"))
    buckets = keyed.groupBy("t", "key").agg(F.count("*").alias("n"), F.min(F.struct("id", "fp")).alias("x"), F.max(F.struct("id", "fp")).alias("y")).where("n > 1")
    buckets = checkpoint(buckets)
    pairs = buckets.where("n = 2").where(F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= radius).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
    crowded = keyed.join(buckets.where("n > 2").select("t", "key"), ["t", "key"])
    table = F.array(*[F.array(*[F.lit(_signed(m)) for m in row]) for row in second])
    again = crowded.select("id", "fp", "t", F.posexplode(F.transform(F.element_at(table, F.col("t") + 1), lambda m: F.col("fp").bitwiseAND(m))).alias("u", "key"))
    groups = again.groupBy("t", "u", "key").agg(F.collect_list(F.struct("id", "fp")).alias("m")).where(F.size("m") > 1).select("m")
    return pairs.unionByName(_edges_in_buckets(groups, radius)).distinct()


def near_duplicate_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, radius: int = 2, seed: int = 42) -> DataFrame:
    """``(doc_id, fp, component_id)`` for every row of docs.

    Texts with equal fingerprints form one node (its smallest id); nodes link at ``radius`` or fewer
    differing bits. component_id is the smallest doc_id reachable. Repeated rows keep their rows; a null
    id keeps its row and gets a component only if its fingerprint has another id. An empty table gives no
    rows; extra columns are ignored.
    """
    fps = materialise(fingerprints(docs, id_col, text_col, k, seed), "fp")
    nodes = checkpoint(fps.groupBy("fp").agg(F.min("doc_id").alias("id")))
    roots = connected_components(covering_links(nodes.where("id is not null"), radius))
    named = nodes.join(roots, nodes["id"] == roots["node"], "left").select("fp", F.coalesce("root", "id").alias("component_id"))
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")
