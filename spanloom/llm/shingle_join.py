"""Self-join of texts by the Jaccard similarity of their sets of k-word shingles: SimHash links first, then an exact join.

SimHash: fingerprints of the sets of shingles meet by covering locality-sensitive hashing, and each link is
verified on the whole sets. That joins most copies at little cost. A similarity of 0.8 moves about ten of 64
bits, too many for a covering radius that is of use, so an exact join finds whatever fingerprints miss.

Bitmap filter: a set's shingles fall into MAP bits. Each bit that only one of two sets has is a shingle that they
do not share, which bounds what they share from above.

Prefix filter: the shingles of all texts stand in one order, common ones last. Two sets of a similarity of
at least s share one of the first |T| - ceil(s |T|) + 1 shingles of each. Positional filter: at the first
shingle they share, each has at least s / (1 + s) (|A| + |B|) left. All three are proven, so no pair is missed;
what passes meets a bitmap filter of WIDE bits, and what passes that is verified on the whole sets. The order decides only how much passes, never what is found.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, checkpoint, claim, encoded, materialise, release
from .components import connected_components
from .simhash import BITS, _signed, covering_links

#: Common shingles are learnt from so many texts, or from every STEP-th where that is more; in how many of them one is
#: common, and how many are told apart.
SAMPLE, STEP, COMMON, MAX_COMMON = 8_000, 8, 3, 100_000
#: A bucket's members are verified against pivots first: one for DENSE members of a bucket, at most PIVOTS, in one round
#: and in as many more, up to ROUNDS, as members have over DENSE open pairs on average and each round takes a tenth of
#: what is open. All pairs come after.
DENSE, PIVOTS, ROUNDS = 16, 8, 6
EPS = 1e-6
#: Words of 64 bits of a set's bitmap.
MAP = 8
_MAPS = [f"m{i}" for i in range(MAP)]
#: Bits of the bitmap that candidates are compared by before their texts are moved.
WIDE = 2048
#: Texts that pairs name, up to which their ids are broadcast so that only those texts are moved.
FEW_IDS = 500_000
#: Links up to which their components are settled on the driver, at 16 bytes each.
FEW_LINKS = 250_000
#: Bits in which fingerprints of the SimHash links may differ.
RADIUS = 2
#: Bytes of texts and their shingles that a task remembers while it verifies.
HELD = 32 << 20


def shingles(text: bytes, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles, ASCII letters in lower case; of all words if fewer than k."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    m = min(k, len(words))
    n = len(words) - m + 1
    h = w[:n]
    for at in range(1, m):
        h = _stir(h) + w[at : at + n]
    return np.unique(_stir(h))


def _stir(h: np.ndarray) -> np.ndarray:
    """A one-to-one mix of 64-bit words, so that the order of what is added between two of them counts."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def fingerprint(h: np.ndarray) -> int:
    """SimHash of a set of shingle hashes: a bit is 1 if it is set in over half of them."""
    if not len(h):
        return 0
    total = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, BITS // 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * total > len(h), bitorder="little").view("<u8")[0])


def bitmap(h: np.ndarray, bits: int) -> np.ndarray:
    """Bytes of a bitmap in which each hash sets one bit."""
    out = np.zeros(bits, bool)
    out[(h >> np.uint64(20)) % np.uint64(bits)] = True
    return np.packbits(out)


def similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (len(a) + len(b) - both) - EPS


def common_shingles(docs: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (sorted) of shingles that many of a sample of texts have, and in how many."""

    def run(batches):
        for b in batches:
            h = [shingles(encoded(t.as_py()), k) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(h).view(np.int64) if h else [], pa.int64())], ["h"])

    step = min(STEP, max(1, docs.count() // SAMPLE))
    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(step)) == 0).select("text").mapInArrow(run, "h long")
    found = some.groupBy("h").count().where(F.col("count") >= COMMON).orderBy(F.desc("count"), "h").limit(MAX_COMMON).toPandas()
    h = found["h"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(h)
    return h[order], found["count"].to_numpy(np.int64)[order]


def _prefixes(docs: DataFrame, k: int, similarity: float) -> DataFrame:
    """(doc_id, sig, size, fp, m0.., wide, prefix): digest, size, fingerprint and two bitmaps of the set of shingles, and those of its prefix in the order of all."""
    held = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, k))

    def run(batches):
        claim("shingles")
        common, often = held.value
        for b in batches:
            rows = []
            for t in b.column(1):
                h = shingles(encoded(t.as_py()), k)
                sig = xxhash.xxh3_128_digest(h.tobytes())
                rank = np.zeros(len(h), np.int64)
                if len(common) and len(h):
                    at = np.minimum(np.searchsorted(common, h), len(common) - 1)
                    rank = np.where(common[at] == h, often[at], 0)
                first = np.lexsort((h, rank))[: len(h) - math.ceil(similarity * len(h) - EPS) + 1]
                rows.append((sig, len(h), _signed(fingerprint(h)), bitmap(h, 64 * MAP).view(np.int64), bitmap(h, WIDE).tobytes(), h[first].view(np.int64)))
            sigs, sizes, fps, maps, wide, prefix = zip(*rows) if rows else ((),) * 6
            maps = np.array(maps, np.int64).reshape(-1, MAP)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sigs, pa.binary()), pa.array(sizes, pa.int32()), pa.array(fps, pa.int64()), *(pa.array(maps[:, i]) for i in range(MAP)), pa.array(wide, pa.binary()), pa.array(prefix, pa.list_(pa.int64()))], ["doc_id", "sig", "size", "fp", *_MAPS, "wide", "prefix"])

    return docs.mapInArrow(run, f"doc_id long, sig binary, size int, fp long, {', '.join(f'{m} long' for m in _MAPS)}, wide binary, prefix array<long>")


def verified(pairs: DataFrame, docs: DataFrame, k: int, similarity: float) -> DataFrame:
    """Those of the pairs (a, b) of ids whose texts' similarity, counted on the whole sets, reaches the given one."""
    bound_batches(docs.sparkSession)

    def run(batches):
        claim("shingles")
        held, room = {}, HELD

        def of(text):
            nonlocal room
            if text not in held:
                if room < 0:
                    held.clear()
                    room = HELD
                held[text] = shingles(text, k)
                room -= len(text) + held[text].nbytes
            return held[text]

        for batch in batches:
            ok = [similar(of(encoded(s.as_py())), of(encoded(t.as_py())), similarity) for s, t in zip(batch.column(2), batch.column(3))]
            yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    texts = docs.select("doc_id", "text")
    ids = checkpoint(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    if ids.count() <= FEW_IDS:
        texts = texts.join(F.broadcast(ids), "doc_id", "left_semi")
    right = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("t")), "b")
    both = right.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("s")), "a")
    return both.select("a", "b", "s", "t").mapInArrow(run, "a long, b long")


def _may(x: str, y: str, similarity: float):
    """Whether two members of one bucket may be similar, by the positional and the bitmap filter. ``left``: shingles from the shared one on."""
    a, b = (lambda c: F.col(f"{x}.{c}")), (lambda c: F.col(f"{y}.{c}"))
    need = (a("size") + b("size")) * (similarity / (1 + similarity)) - EPS
    alone = lambda p, q: reduce(add, (F.bit_count(p(m).bitwiseAND(F.bitwise_not(q(m)))) for m in _MAPS))
    return (F.least(a("left"), b("left")) >= need) & (a("size") - alone(a, b) >= need) & (b("size") - alone(b, a) >= need)


def plausible(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) that the bitmaps of WIDE bits don't rule out. A bit that one set alone has is a shingle that they don't share."""

    def run(batches):
        for b in batches:
            m, n = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint64).reshape(-1, WIDE // 64) for i in (2, 3))
            x, y = (b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (4, 5))
            least = np.minimum(x - np.bitwise_count(m & ~n).sum(axis=1, dtype=np.int64), y - np.bitwise_count(n & ~m).sum(axis=1, dtype=np.int64))
            yield b.select([0, 1]).filter(pa.array(least >= (x + y) * (similarity / (1 + similarity)) - EPS))

    right = pairs.join(nodes.select(F.col("id").alias("b"), F.col("wide").alias("n"), F.col("size").alias("y")), "b")
    both = right.join(nodes.select(F.col("id").alias("a"), F.col("wide").alias("m"), F.col("size").alias("x")), "a")
    return both.select("a", "b", "m", "n", "x", "y").mapInArrow(run, "a long, b long").distinct()


def simhash_links(nodes: DataFrame, docs: DataFrame, k: int, similarity: float) -> DataFrame:
    """Verified links (a, b) between nodes (id, fp) whose fingerprints are equal or joined by steps of RADIUS bits."""
    first = checkpoint(nodes.groupBy("fp").agg(F.min("id").alias("id")))
    equal = nodes.join(first.withColumnRenamed("id", "a"), "fp").where("id <> a").select("a", F.col("id").alias("b"))
    near = covering_links(first, RADIUS).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    found = checkpoint(equal.unionByName(near).distinct())
    release(docs.sparkSession)
    return checkpoint(verified(found, docs, k, similarity))


def similar_links(nodes: DataFrame, docs: DataFrame, k: int, similarity: float) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of nodes of at least the similarity.

    ``nodes``: (id, size, fp, m0.., wide, prefix). SimHash links come first. A bucket has all nodes with one shingle in their
    prefix. Each bucket's members are verified against a few of them, again while buckets hold many pairs that no
    links join yet, so that a group of copies costs rows by its size and not by its square. Then every pair of members of a bucket that is not joined already and passes the filter is
    verified: no bucket is cut.
    """
    links = simhash_links(nodes, docs, k, similarity)
    roots = connected_components(links, few=FEW_LINKS).withColumnRenamed("node", "id")
    keyed = nodes.select("id", F.posexplode("prefix").alias("at", "key"))
    shared = keyed.groupBy("key").count().where("count > 1").select("key")
    of = nodes.select("id", "size", *_MAPS).join(roots, "id", "left").withColumn("comp", F.coalesce("root", "id")).drop("root")
    # sizes and bitmaps join what is left: most shingles are of one text alone
    members = keyed.join(shared, "key").join(of, "id").select("key", "id", "size", (F.col("size") - F.col("at")).alias("left"), *_MAPS, "comp")
    members = materialise(members, "buckets")
    release(docs.sparkSession)
    before = math.inf
    for round_ in range(ROUNDS + 1):
        parts = members.groupBy("key", "comp").agg(F.count("*").alias("n")).groupBy("key").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("joined"), F.count("*").alias("comps")).where("comps > 1")
        parts = checkpoint(parts)
        n, open_ = parts.agg(F.sum("n"), F.sum(F.col("n") * F.col("n") - F.col("joined")) / 2).first()
        if not n or round_ and (open_ <= DENSE * n or 10 * open_ > 9 * before) or round_ == ROUNDS:
            members = members.join(parts.select("key"), "key", "left_semi")
            break
        members = members.join(parts.select("key", "n"), "key")
        before = float(open_)
        m = F.struct("id", "size", "left", "comp", *_MAPS)
        chance = F.xxhash64("id", F.lit(round_))
        share = F.least(F.greatest(F.floor(F.col("n") / DENSE), F.lit(1)), F.lit(PIVOTS))
        pivots = members.groupBy("key", F.pmod(chance, share).alias("part")).agg(F.min(F.struct(chance.alias("h"), m.alias("x")))["x"].alias("x")).drop("part")
        pairs = members.select("key", m.alias("y")).join(pivots, "key").where((F.col("x.comp") != F.col("y.comp")) & _may("x", "y", similarity))
        pairs = checkpoint(pairs.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct())
        pairs = checkpoint(plausible(pairs, nodes, similarity))
        new = verified(pairs, docs, k, similarity)
        links = checkpoint(links.unionByName(new))
        roots = connected_components(links, few=FEW_LINKS).withColumnRenamed("node", "id")
        members = checkpoint(members.drop("comp", "n").join(roots, "id", "left").withColumn("comp", F.coalesce("root", "id")).drop("root"))
        del parts, pivots, pairs, new
        release(docs.sparkSession)
    x, y = members.alias("x"), members.alias("y")
    rest = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.id") < F.col("y.id")) & (F.col("x.comp") != F.col("y.comp")) & _may("x", "y", similarity))
    pairs = checkpoint(rest.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct())
    del parts, members, rest, x, y
    release(docs.sparkSession)
    pairs = checkpoint(plausible(pairs, nodes, similarity))
    links = checkpoint(links.unionByName(verified(pairs, docs, k, similarity)))
    release(docs.sparkSession)
    return links


def similar_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, similarity: float = 0.8) -> DataFrame:
    """``(doc_id, component_id)``: texts joined by steps of a Jaccard similarity of k-word shingles of at least ``similarity``.

    The similarity is that of the sets of 64-bit shingle hashes, and exact on them. Equal sets are one node.
    Rows without an id are left out; rows with one id are one document. Texts without words are equal to each
    other.
    """
    bound_batches(docs.sparkSession)
    docs = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = materialise(_prefixes(docs, k, similarity), "prefixes")
    ids = checkpoint(found.groupBy("sig").agg(F.min("doc_id").alias("id")))
    same = found.select("doc_id", "sig").join(ids, "sig")
    nodes = found.join(ids, "sig").where("doc_id = id").dropDuplicates(["sig", "id"]).select("id", "size", "fp", *_MAPS, "wide", "prefix")
    # a repeated id with different texts joins their nodes; copies follow their node and need no links
    several = same.groupBy("doc_id").agg(F.min("id").alias("a"), F.max("id").alias("last")).where("a <> last")
    also = same.join(several, "doc_id").where("id <> a").select("a", F.col("id").alias("b"))
    roots = connected_components(similar_links(nodes, docs, k, similarity).unionByName(also), few=FEW_LINKS)
    named = ids.join(roots, ids["id"] == roots["node"], "left").select("sig", F.coalesce("root", "id").alias("component_id"))
    return found.select("doc_id", "sig").join(named, "sig").select("doc_id", "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs without all but one document, that of the smallest id, of each group of near copies.

    Groups are joined by pairs whose similarity is counted exactly, see similar_components(). Rows with one id are
    one document, of which one row stays. Rows without an id stay, as nothing names them; a null or empty text
    is a text without words, of which one document stays. Other columns are passed on whatever they are called.
    An empty table gives no rows.
    """
    found = similar_components(docs, id_col, text_col, k, similarity)
    keep = found.where("doc_id = component_id").select(F.col("doc_id").alias(id_col)).distinct()
    named = docs.join(keep, id_col).dropDuplicates([id_col]).select(docs.columns)
    return named.unionByName(docs.where(F.col(id_col).isNull()))
