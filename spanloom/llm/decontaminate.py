"""Benchmark decontamination: one Aho-Corasick automaton over all windows of the normalised test items.

Texts are normalised byte by byte (A-Z to a-z, other ASCII outside [0-9a-z] to a blank), so offsets in the
normalised text are offsets in the original. Each text is scanned once.
"""

from __future__ import annotations

import hashlib
import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_BYTES, bound_batches, cache, claim, encoded, materialise

WINDOW = 13
#: Characters of patterns in one automaton (about 40 bytes of memory each); more items are dealt to more automata.
AUTOMATON_CHARS = 4_000_000
_built = cache()
_serial = itertools.count()
_HITS = "runs array<struct<a:long,b:long>>, items array<string>"
_FOUND = "n_words long, runs array<struct<a:long,b:long>>, spans array<struct<a:long,b:long>>, items array<string>"


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


def item_windows(text: bytes, window: int = WINDOW) -> list[tuple[str, int]]:
    """Each run of ``window`` words as `` w1 w2 ... ``, or the whole item if it has fewer, but not none."""
    w = [x.decode("utf-8", "surrogatepass") for x in words_of(text)]
    n = min(window, len(w))
    return [(f" {' '.join(w[i : i + n])} ", n) for i in range(len(w) - n + 1)] if n else []


def build(items: list[tuple[str, bytes]], window: int = WINDOW):
    """The automaton, or None if no item has a word. Values: (words in the window, item ids)."""
    import ahocorasick

    held: dict[str, tuple[int, set]] = {}
    for item, text in items:
        for pattern, n in item_windows(text, window):
            held.setdefault(pattern, (n, set()))[1].add(item)
    if not held:
        return None
    a = ahocorasick.Automaton()
    for pattern, value in held.items():
        a.add_word(pattern, value)
    a.make_automaton()
    return a


def scan(automaton, text: bytes) -> tuple[int, list[tuple[int, int]], set]:
    """Number of words, the merged runs of hit words (first, last), and the items with occurring windows."""
    words = words_of(text)
    if automaton is None or not words:
        return len(words), [], set()
    line = b" ".join([b"", *words, b""]).decode("utf-8", "surrogatepass")
    hits = list(automaton.iter(line))
    if not hits:
        return len(words), [], set()
    ends = np.cumsum([len(w.decode("utf-8", "surrogatepass")) + 1 for w in words])
    last = np.searchsorted(ends, [at for at, _ in hits]).tolist()
    runs: list[list[int]] = []
    for a, b in sorted((b - n + 1, b) for b, (_, (n, _)) in zip(last, hits)):
        if runs and a <= runs[-1][1] + 1:
            runs[-1][1] = max(runs[-1][1], b)
        else:
            runs.append([a, b])
    return len(words), [(a, b) for a, b in runs], set().union(*(items for _, (_, items) in hits))


def _byte_spans(text: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    at = [m.span() for m in re.finditer(rb"[^ ]+", text.translate(WORD_BYTES))]
    return [(at[a][0], at[b][1]) for a, b in runs]


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, automaton_chars: int = AUTOMATON_CHARS) -> DataFrame:
    """For every row of docs: id, ``n_words``, ``n_hit``, ``items`` (sorted strings), ``spans`` (byte offsets in the text).

    ``benchmark`` has ``item_id`` and ``text``; items without id or words match nothing. A null text has no
    words. Repeated rows and items count once each. The size of the patterns is computed before anything is
    collected: items are dealt by hash to as many automata as keep each under ``automaton_chars``, every one
    of which is broadcast and scanned for in a job of its own, so that a benchmark of any size is covered whole.
    Null ids keep their rows; an empty table of documents gives no rows, an empty benchmark no hits; other
    columns are ignored.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("item_id"), "text")
    size = items.agg(F.sum(F.length("text") * window)).first()[0] or 0
    shards = max(1, -(-int(size) // automaton_chars))
    kind = docs.schema[id_col].dataType.simpleString()
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    if shards == 1:
        held = spark.sparkContext.broadcast([(r[0], encoded(r[1])) for r in items.collect()])
        found = docs.mapInArrow(_scanner(held, f"{next(_serial)}-{id(held)}", window), f"doc_id {kind}, {_FOUND}")
    else:
        found = _scan_by_shard(docs, items, shards, window, kind)
    n_hit = F.aggregate("runs", F.lit(0).cast("long"), lambda n, r: n + r["b"] - r["a"] + 1)
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), "items", F.transform("spans", lambda s: F.struct(s["a"].alias("start"), s["b"].alias("end"))).alias("spans"))


def _scan_by_shard(docs: DataFrame, items: DataFrame, shards: int, window: int, kind: str) -> DataFrame:
    """Scan for every shard in a job of its own, one automaton at a time; what each finds is written and joined back by row."""
    keyed = docs.withColumn("rid", F.xxhash64("doc_id", "text")).withColumn("did", F.xxhash64(F.lit(window), "text", "doc_id"))
    hits = None
    for k in range(shards):
        own = items.where(F.pmod(F.xxhash64("item_id"), F.lit(shards)) == k)
        held = docs.sparkSession.sparkContext.broadcast([(r[0], encoded(r[1])) for r in own.collect()])
        found = materialise(keyed.select("rid", "did", "text").mapInArrow(_finder(held, f"{next(_serial)}-{id(held)}", window), f"rid long, did long, {_HITS}"), f"shard{k}")
        held.unpersist()
        hits = found if hits is None else hits.unionByName(found)
    # equal rows found the same, so sets leave one of each
    hits = hits.groupBy("rid", "did").agg(F.flatten(F.collect_set("runs")).alias("found"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    out = keyed.join(hits, ["rid", "did"], "left").select("doc_id", "text", "found", "items")

    def run(batches):
        for b in batches:
            rows = []
            for t, found, items_ in zip(b.column("text"), b.column("found"), b.column("items")):
                text, runs = encoded(t.as_py()), []
                for a, e in sorted((x["a"], x["b"]) for x in found.as_py() or ()):
                    if runs and a <= runs[-1][1] + 1:
                        runs[-1][1] = max(runs[-1][1], e)
                    else:
                        runs.append([a, e])
                rows.append((len(words_of(text)), runs, _byte_spans(text, runs) if runs else [], items_.as_py() or []))
            yield _found_batch(b.column("doc_id"), rows)

    return out.mapInArrow(run, f"doc_id {kind}, {_FOUND}")


_RUNS = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))


def _pairs(x) -> list[dict]:
    return [{"a": a, "b": b} for a, b in x]


def _found_batch(ids, rows) -> pa.RecordBatch:
    n, runs, spans, items = zip(*rows) if rows else ((),) * 4
    return pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array([_pairs(x) for x in runs], _RUNS), pa.array([_pairs(x) for x in spans], _RUNS), pa.array(items, pa.list_(pa.string()))], ["doc_id", "n_words", "runs", "spans", "items"])


def _automaton(held, key: str, window: int):
    """One automaton per Python worker and broadcast; older ones are let go."""
    if key not in _built:
        _built.clear()
        _built[key] = build(held.value, window)
    return _built[key]


def _scanner(held, key: str, window: int):
    def run(batches):
        claim("decontaminate")
        automaton = _automaton(held, key, window)
        for b in batches:
            rows = []
            for t in b.column("text"):
                text = encoded(t.as_py())
                n, runs, items = scan(automaton, text)
                rows.append((n, runs, _byte_spans(text, runs) if runs else [], sorted(items)))
            yield _found_batch(b.column("doc_id"), rows)

    return run


def _finder(held, key: str, window: int):
    """Runs and items of the rows that have any."""

    def run(batches):
        claim("decontaminate")
        automaton = _automaton(held, key, window)
        for b in batches:
            rows = []
            for i, t in enumerate(b.column("text")):
                _, runs, items = scan(automaton, encoded(t.as_py()))
                if runs:
                    rows.append((i, _pairs(runs), sorted(items)))
            at, runs, items = zip(*rows) if rows else ((),) * 3
            at = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("rid").take(at), b.column("did").take(at), pa.array(runs, _RUNS), pa.array(items, pa.list_(pa.string()))], ["rid", "did", "runs", "items"])

    return run


def digest_of(items: str = "items"):
    """Lower-case hex SHA-256 of the comma-joined item ids."""
    return F.sha2(F.array_join(items, ",").cast("binary"), 256)
