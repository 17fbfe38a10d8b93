"""Exact removal of long repeated byte strings with a sparse suffix array (deep-shallow sorting).

A byte is removed if it lies in a string of ``window`` bytes that starts anywhere else too. Every window
has one anchor, the leftmost smallest hash among its 64-byte grams. Equal windows have equal anchors at
equal places, so they meet in the group of that gram's hash; only grams that occur twice are followed.
The suffixes that start at the anchors of a group and the reversed prefixes that end there are sorted
deep-shallow: multikey quicksort to a shallow depth, then a blind trie for each group that still agrees.
Two windows at distance a before their anchors are equal if and only if the suffixes share window - a
bytes and the prefixes a bytes, which the two arrays of common-prefix lengths tell for all members at once.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, claim, encoded, materialise, packed

GRAM = 64
#: Window starts treated at a time within a text; positions in a block fit into 20 bits.
BLOCK = 1 << 18
#: Depth to which multikey quicksort goes, in steps of STEP bytes.
SHALLOW, STEP = 128, 64
#: Anchors sorted together in a task; a group is never cut.
SORT_ROWS = 4096
#: Groups with more anchors than this are settled by counting hashes of their windows, with map-side sums.
HOT = 20_000
#: Parts that the occurrences of a window are dealt to when they meet its count, so that a common one makes no hot task.
SALT = 16
_PLACE = np.uint64((1 << 20) - 1)


def _byte_table() -> np.ndarray:
    x = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTES = _byte_table()


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """64-bit hash of every 64-byte gram, built by doubling."""
    h, factor, m = _BYTES[data], 0x9E3779B97F4A7C15, 1
    while m < GRAM:
        h = h[:-m] * np.uint64(factor) + h[m:]
        factor, m = factor * factor % (1 << 64), 2 * m
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def anchors(text: bytes, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places q of the anchors, the smallest and largest distance a of their windows (start q - a), and their hashes."""
    starts, width = len(text) - window + 1, window - GRAM + 1
    if starts < 1:
        z = np.zeros(0, np.int64)
        return z, z, z, z
    data, out = np.frombuffer(text, np.uint8), []
    for at in range(0, starts, BLOCK):
        n = min(BLOCK, starts - at)
        g = gram_hashes(data[at : at + n + window - 1])
        key = (g & ~_PLACE) | np.arange(len(g), dtype=np.uint64)
        m, span = key, 1
        while 2 * span <= width:
            m, span = np.minimum(m[:-span], m[span:]), 2 * span
        if span < width:
            m = np.minimum(m[: n + 0], m[width - span : width - span + n])
        place = (m[:n] & _PLACE).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        last = np.concatenate((first[1:], [n])) - 1
        q = place[first]
        out.append((q + at, q - last, q - first, g[q].view(np.int64)))
    return tuple(np.concatenate(x) for x in zip(*out))


def common_prefix(x: bytes, y: bytes) -> int:
    n = min(len(x), len(y))
    d = int.from_bytes(x[:n], "big") ^ int.from_bytes(y[:n], "big")
    return n - (d.bit_length() + 7) // 8


def _multikey(strings: list[bytes], rows: list[int], depth: int, out: list[int]) -> None:
    """Append rows to out in order of strings[row][depth:]."""
    stack = [(rows, depth)]
    while stack:
        rows, depth = stack.pop()
        if len(rows) == 1:
            out.append(rows[0])
        elif depth >= SHALLOW:
            _blind_sort(strings, rows, out)
        else:
            pivot = strings[rows[len(rows) // 2]][depth : depth + STEP]
            less, same, more = [], [], []
            for r in rows:
                x = strings[r][depth : depth + STEP]
                (same if x == pivot else less if x < pivot else more).append(r)
            if more:
                stack.append((more, depth))
            if len(pivot) < STEP:  # they end here, all alike
                stack.extend(((r,), depth) for r in reversed(same))
            else:
                stack.append((same, depth + STEP))
            if less:
                stack.append((less, depth))


def _blind_sort(strings: list[bytes], rows: list[int], out: list[int]) -> None:
    """Order rows with a blind trie: descend by branching bytes alone, compare once, insert where they part."""
    # a leaf is a list of rows with one string; a branch is (depth, {byte or -1: child})
    root = [rows[0]]
    for r in rows[1:]:
        x, node = strings[r], root
        while isinstance(node, tuple):
            d, kids = node
            node = kids.get(x[d] if d < len(x) else -1) or next(iter(kids.values()))
        y = strings[node[0]]
        if x == y:
            node.append(r)
            continue
        p = common_prefix(x, y)
        cx, cy = (x[p] if p < len(x) else -1), (y[p] if p < len(y) else -1)
        parent, node = None, root
        while isinstance(node, tuple) and node[0] < p:
            parent, node = node, node[1][x[node[0]] if node[0] < len(x) else -1]
        if isinstance(node, tuple) and node[0] == p:
            node[1][cx] = [r]
        else:
            branch = (p, {cy: node, cx: [r]})
            if parent is None:
                root = branch
            else:
                parent[1][x[parent[0]] if parent[0] < len(x) else -1] = branch
    stack = [root]
    while stack:
        node = stack.pop()
        if isinstance(node, tuple):
            stack.extend(kid for _, kid in sorted(node[1].items(), key=lambda k: -k[0]))
        else:
            out.extend(node)


def deep_shallow(strings: list[bytes], group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the strings within runs of equal group, and the common prefix with the one before (-1 at a run's first)."""
    n, order = len(strings), []
    cuts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))).tolist() + [n]
    for a, b in zip(cuts, cuts[1:]):
        _multikey(strings, list(range(a, b)), 0, order)
    lcp = np.full(n, -1, np.int64)
    firsts = set(cuts)
    for i in range(1, n):
        if i not in firsts:
            lcp[i] = common_prefix(strings[order[i - 1]], strings[order[i]])
    return np.array(order, np.int64), lcp


def repeated_reach(group: np.ndarray, left: list[bytes], right: list[bytes], lo: np.ndarray, hi: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """For each anchor, the smallest and largest distance a whose window has an equal elsewhere (largest -1: none)."""
    n = len(left)
    ro, rl = deep_shallow(right, group)
    lo_, ll = deep_shallow([x[::-1] for x in left], group)
    near, far = np.full(n, window, np.int64), np.full(n, -1, np.int64)
    cr, cl = np.empty(n, np.int64), np.empty(n, np.int64)
    for a in range(int(lo.min()), int(hi.max()) + 1):
        member = np.flatnonzero((lo <= a) & (a <= hi))
        if len(member) < 2:
            continue
        cr[ro] = np.cumsum(rl < window - a)
        cl[lo_] = np.cumsum(ll < a)
        key = cr[member] * (n + 1) + cl[member]
        by = np.argsort(key, kind="stable")
        same = key[by[1:]] == key[by[:-1]]
        dup = member[by[np.concatenate((same, [False])) | np.concatenate(([False], same))]]
        near[dup] = np.minimum(near[dup], a)
        far[dup] = a
    return near, far


_REF = "rid long, did long"


def _find_anchors(keyed: DataFrame, window: int) -> DataFrame:
    def run(batches):
        for b in batches:
            rid, did, rows = b.column("rid").to_pylist(), b.column("did").to_pylist(), []
            for i, t in enumerate(b.column("text")):
                q, lo, hi, h = anchors(encoded(t.as_py()), window)
                if len(q):
                    rows.append((i, q, lo, hi, h))
            size = np.array([len(r[1]) for r in rows], np.int64)
            at = np.repeat(np.array([r[0] for r in rows], np.int64), size)
            cols = [np.concatenate([r[k] for r in rows]) if rows else np.zeros(0, np.int64) for k in (1, 2, 3, 4)]
            take = lambda x: pa.array(np.array(x, np.int64)[at])
            yield pa.RecordBatch.from_arrays([take(rid), take(did), pa.array(cols[0]), pa.array(cols[1].astype(np.int32)), pa.array(cols[2].astype(np.int32)), pa.array(cols[3])], ["rid", "did", "q", "lo", "hi", "h"])

    return keyed.mapInArrow(run, f"{_REF}, q long, lo int, hi int, h long")


def _contexts(found: DataFrame, window: int) -> DataFrame:
    """The bytes around each anchor. Equal ones of one text become one row with all their places."""

    def run(batches):
        for b in batches:
            out = []
            for rid, did, t, marks in zip(*(b.column(c) for c in ("rid", "did", "text", "marks"))):
                text, own = encoded(t.as_py()), {}
                for m in marks.as_py():
                    q, lo, hi = m["q"], m["lo"], m["hi"]
                    own.setdefault((m["h"], lo, hi, text[q - hi : q], text[q : q + window - lo]), []).append(q)
                rid, did = rid.as_py(), did.as_py()
                out += [(h, rid, did, qs, lo, hi, x, y) for (h, lo, hi, x, y), qs in own.items()]
                if len(out) > 8192:
                    yield _context_batch(out)
                    out = []
            yield _context_batch(out)

    return found.mapInArrow(run, f"h long, {_REF}, qs array<long>, lo int, hi int, left binary, right binary")


def _context_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
    cols = list(zip(*rows)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["h", "rid", "did", "qs", "lo", "hi", "left", "right"])


def _sorted_spans(contexts: DataFrame, window: int) -> DataFrame:
    """Repeated spans of the groups, each wholly in one task, in batches cut between groups."""

    def settle(parts):
        t = pa.Table.from_batches(parts)
        h, lo, hi = (t.column(c).to_numpy().astype(np.int64) for c in ("h", "lo", "hi"))
        near, far = repeated_reach(h, t.column("left").to_pylist(), t.column("right").to_pylist(), lo, hi, window)
        qs, rid, did = t.column("qs").to_pylist(), t.column("rid").to_numpy(), t.column("did").to_numpy()
        many = np.array([len(x) > 1 for x in qs])
        near, far = np.where(many, lo, near), np.where(many, hi, far)
        rows = np.flatnonzero(far >= 0)
        size = np.array([len(qs[r]) for r in rows], np.int64)
        at = np.repeat(rows, size)
        q = np.array([x for r in rows for x in qs[r]], np.int64)
        return pa.RecordBatch.from_arrays([pa.array(rid[at]), pa.array(did[at]), pa.array(q - far[at]), pa.array(q - near[at] + window)], ["rid", "did", "s", "e"])

    def run(batches):
        claim("suffix")
        held, n = [], 0
        for b in batches:
            h = b.column("h").to_numpy()
            while n + len(h) >= SORT_ROWS and len(h):
                # up to the end of the group that holds the last row of a full batch
                last = h[max(0, SORT_ROWS - n - 1)] if n < SORT_ROWS else held[-1].column("h")[-1].as_py()
                k = int(np.searchsorted(h, last, "right"))
                if k == len(h):
                    break
                yield settle([*held, b.slice(0, k)] if k else held)
                b, h, held, n = b.slice(k), h[k:], [], 0
            if len(h):
                held.append(b)
                n += len(h)
        if n:
            yield settle(held)

    return contexts.repartition("h").sortWithinPartitions("h").mapInArrow(run, f"{_REF}, s long, e long")


def _counted_spans(contexts: DataFrame, window: int) -> DataFrame:
    """The same for groups of any size: 128-bit hashes of their windows, counted with map-side sums."""

    def run(batches):
        for b in batches:
            for h, rid, did, qs, lo, hi, left, right in zip(*(c.to_pylist() for c in b.columns)):
                text = left + right
                ws = [xxhash.xxh3_128_digest(text[hi - a : hi - a + window]) for a in range(lo, hi + 1)]
                s = [q - a for q in qs for a in range(lo, hi + 1)]
                yield pa.RecordBatch.from_arrays([pa.array(ws * len(qs), pa.binary()), pa.array([rid] * len(s)), pa.array([did] * len(s)), pa.array(s, pa.int64())], ["w", "rid", "did", "s"])

    w = contexts.mapInArrow(run, f"w binary, {_REF}, s long").withColumn("part", F.pmod(F.xxhash64("rid", "did", "s"), F.lit(SALT)).cast("int"))
    again = w.groupBy("w").agg(F.count("*").alias("n")).where("n > 1").select("w", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("part"))
    return w.join(again, ["w", "part"]).select("rid", "did", "s", (F.col("s") + window).alias("e"))


def _cut(text: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, list[tuple[int, int]]]:
    runs: list[list[int]] = []
    for s, e in sorted(spans):
        if runs and s <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], e)
        else:
            runs.append([s, e])
    kept, at = [], 0
    for s, e in runs:
        kept.append(text[at:s])
        at = e
    return b"".join([*kept, text[at:]]), [(s, e) for s, e in runs]


RESULTS = "kept binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string"


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 400, hot: int = HOT, whole_rows: bool = False) -> DataFrame:
    """Every row of docs with ``kept`` (remaining bytes), ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256``
    and ``kept_text`` (without characters of which a part was removed).

    Columns: doc_id, then those above; with ``whole_rows`` a struct ``row`` of all columns of docs in place of
    doc_id, so that no column of docs can clash. Other columns are ignored. Ids may be of any type that can be
    hashed. Null text counts as empty; texts shorter than the window keep all their bytes. Repeated rows are
    copies of each other. An empty table gives no rows. Windows never cross texts. A window of the same text,
    overlapping or not, counts as elsewhere. Strings are judged on the input. Groups of at most ``hot`` anchors
    are sorted whole in one task; larger ones are counted by window hash, which no skew can gather in a task.
    Anchors and the repeated grams are written to the shared folder. What repeats within one text is held as
    one row, whose anchors can be as many as its bytes where the text is a single character over and over.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    if window < 2 * GRAM:
        raise ValueError(f"window must be at least {2 * GRAM} bytes")
    whole = docs.select(packed(docs, id_col, text_col, whole_rows).alias("row"))
    place = whole.schema["row"].dataType.names.index(text_col)
    text = F.col("row")[text_col]
    # two hashes name a row; rows of one id and text have one name and one fate
    own_id = F.col("row")[id_col]
    keyed = whole.withColumn("rid", F.xxhash64(own_id, text)).withColumn("did", F.xxhash64(F.lit(window), text, own_id))
    texts = keyed.select("rid", "did", text.alias("text"))
    marks = materialise(_find_anchors(texts.where(F.octet_length("text") >= window), window), "anchors")
    grams = materialise(marks.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"), "grams")
    follow = marks.join(grams, "h").groupBy("rid", "did").agg(F.collect_list(F.struct("q", "lo", "hi", "h", "n")).alias("marks"))
    found = texts.join(follow, ["rid", "did"]).select("rid", "did", "text", "marks")
    cool = _contexts(found.withColumn("marks", F.filter("marks", lambda m: m["n"] <= hot)), window)
    spans = _sorted_spans(cool, window)
    if (grams.agg(F.max("n")).first()[0] or 0) > hot:
        spans = spans.unionByName(_counted_spans(_contexts(found.withColumn("marks", F.filter("marks", lambda m: m["n"] > hot)), window), window))
    spans = spans.groupBy("rid", "did").agg(F.collect_set(F.struct("s", "e")).alias("spans"))

    def run(batches):
        for b in batches:
            out = []
            for t, spans in zip(b.column("row").field(place), b.column("spans")):
                text = encoded(t.as_py())
                kept, runs = _cut(text, [(x["s"], x["e"]) for x in spans.as_py() or ()])
                out.append((kept, len(text), len(text) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore")))
            cols = list(zip(*out)) or [()] * 6
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column("row"), *(pa.array(c, k) for c, k in zip(cols, kinds))], ["row", "kept", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"])

    joined = keyed.join(spans, ["rid", "did"], "left").select("row", "spans")
    done = joined.mapInArrow(run, f"row {whole.schema['row'].dataType.simpleString()}, {RESULTS}")
    return done if whole_rows else done.select(F.col("row")[id_col].alias("doc_id"), *done.columns[1:])
