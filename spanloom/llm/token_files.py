"""Token ids in binary frames, packed by a context-mixing range coder.

A frame holds whole documents in order and is cut into blocks of BLOCK ids. Every block starts from empty
memories, has its own coded words and its own CRC-32, and can be decoded without any other. The coder
mixes three predictions for each id: the id that last followed the two ids before it (order 2), the id
that last followed the one before it (order 1), and the shares of the frame's ids (order 0). Orders 2 and 1
weigh as much as such predictions came true over the frame, by the runs of successes of both. Shares and
weights are counted before coding and lie in the frame's header. One range-coder step per id codes which
prediction holds and, if neither order 2 nor 1 does, the id's share of [0, 2^20). The blocks of a frame
advance together as numpy lanes, so the cost per id is a few vector operations.

Frames are rows of a Parquet dataset, so they lie in any store that Spark writes, with its commit protocol.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable
from itertools import accumulate, chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, cache, claim

MAGIC = b"SPTK\x02"
_HEAD = "<QIHII"
BLOCK = 4096
#: Ids from which a frame is closed after the document that reaches them, if half as many follow.
FRAME = 6_000_000
#: log2 of the slots of the order-1 and order-2 memories of a block.
SLOTS = 10
#: Runs told apart in an entry of a memory: empty, new, then successes; the two orders' and whether they agree make a context.
STATES = 8
_CONTEXTS = 2 * STATES * STATES
#: log2 of the total of order 0's shares.
SHARE = 20
#: Steps whose model is worked out together when coding.
CHUNK = 64
_LOW63, _LOW31 = (1 << 63) - 1, (1 << 31) - 1
_SLOT = np.int32((1 << SLOTS) - 1)


def _memories(lanes: int) -> tuple[np.ndarray, np.ndarray]:
    """Entries (id | state << 16) of order 2, then of order 1, of all lanes; and where each lane's begin."""
    row = np.arange(lanes, dtype=np.int64) << SLOTS
    return np.zeros(2 * lanes << SLOTS, np.int32), np.stack([row, row + (lanes << SLOTS)])


def _lanes(ids: np.ndarray) -> tuple[np.ndarray, int]:
    """ids as (steps, lanes), padded with zeros in the last lane."""
    lanes = max(1, -(-len(ids) // BLOCK))
    steps = BLOCK if lanes > 1 else max(1, len(ids))
    out = np.zeros(lanes * steps, np.int32)
    out[: len(ids)] = ids
    return np.ascontiguousarray(out.reshape(lanes, steps).T), lanes


def _outcomes(steps: np.ndarray, lanes: int) -> np.ndarray:
    """Context of each id, plus _CONTEXTS times what told it: 0 order 2, 1 order 1, 2 neither."""
    found = np.empty(steps.shape, np.uint16)
    slots, base = _memories(lanes)
    last = np.zeros((2, lanes), np.int32)
    new = np.empty((2, lanes), np.int32)
    for k in range(0, len(steps), CHUNK):
        x = steps[k : k + CHUNK]
        before = np.concatenate([last, x])
        at, e = np.empty((len(x), 2, lanes), np.int64), np.empty((len(x), 2, lanes), np.int32)
        np.bitwise_and(before[1:-1] + before[:-2] * 37, _SLOT, out=at[:, 0])
        np.bitwise_and(before[1:-1], _SLOT, out=at[:, 1])
        at += base
        for one, i, entry in zip(x, at, e):
            slots.take(i, out=entry, mode="clip")
            np.copyto(new, one)
            np.copyto(new, entry, where=(entry & 0xFFFF) == one)
            new += 65536
            slots[i] = new
        last = before[-2:]
        ids, state = e & 0xFFFF, np.minimum(e >> 16, STATES - 1)
        ok = ids == x[:, None]
        context = ((ids[:, 0] == ids[:, 1]) * STATES + state[:, 0]) * STATES + state[:, 1]
        found[k : k + CHUNK] = context + np.where(ok[:, 0], 0, np.where(ok[:, 1], _CONTEXTS, 2 * _CONTEXTS))
    return found


def _weights(outcomes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights of orders 2 and 1 in each context, of 65536; order 0 keeps a sixteenth of the whole."""
    n = np.bincount(outcomes.ravel(), minlength=3 * _CONTEXTS).reshape(3, _CONTEXTS)
    total = n.sum(axis=0) + 1
    w2 = np.clip(n[0] * 65536 // total, 1, 61439)
    w1 = np.clip(n[1] * 65536 // total, 1, 61440 - w2)
    w1[_CONTEXTS // 2 :] = 0
    return w2, w1


def _shares(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids that occur, and the share of each, at least 1."""
    n = np.bincount(ids)
    there = np.flatnonzero(n)
    n = n[there]
    f = n * ((1 << SHARE) - len(n)) // n.sum() + 1
    f[n.argmax()] += (1 << SHARE) - f.sum()
    return there, f


def pack(ids: np.ndarray) -> bytes:
    """One frame: header, weights and shares, CRC-32 and number of 32-bit words of each block, then the blocks' words. Ids are below 65536."""
    steps, lanes = _lanes(ids)
    outcomes = _outcomes(steps, lanes)
    w2, w1 = _weights(outcomes)
    there, shares = _shares(steps.ravel())
    share_of, cum_of = np.zeros(there[-1] + 1, np.int64), np.zeros(there[-1] + 1, np.int64)
    share_of[there], cum_of[there] = shares, np.cumsum(shares) - shares
    starts, sizes = np.concatenate([0 * w2, w2, w2 + w1]), np.concatenate([w2, w1, 65536 - w2 - w1])
    # signed, but kept below 2^63: a carry shows as the sign
    low, rng = np.zeros(lanes, np.int64), np.full(lanes, _LOW63)
    width = len(steps) + 4
    words, n_words = np.zeros(lanes * width, np.uint32), np.arange(lanes, dtype=np.int64) * width
    unit, part = np.empty(lanes, np.int64), np.empty(lanes, np.int64)
    for k in range(0, len(steps), CHUNK):
        x, told = steps[k : k + CHUNK], outcomes[k : k + CHUNK]
        by0 = (told >= 2 * _CONTEXTS).astype(np.int64)
        c, f = cum_of.take(x) * by0, share_of.take(x) * by0 + (1 - by0)
        # the part of a prediction, then in order 0's part the id's own
        for start, size, shift, cum, share in zip(starts.take(told), sizes.take(told), by0 * SHARE, c, f):
            np.right_shift(rng, 16, out=unit)
            start *= unit
            low += start
            np.multiply(unit, size, out=part)
            part >>= shift
            cum *= part
            low += cum
            np.multiply(part, share, out=rng)
            carry = (low < 0).nonzero()[0]
            if len(carry):
                low[carry] &= _LOW63
                _carry(words, n_words, carry)
            need = (rng < 1 << 31).nonzero()[0]
            if len(need):
                at, x_low = n_words.take(need), low.take(need)
                words[at] = x_low >> 31
                n_words[need] = at + 1
                low[need] = (x_low & _LOW31) << 32
                rng[need] = rng.take(need) << 32
    for _ in range(2):
        words[n_words] = low >> 31
        n_words += 1
        low = (low & _LOW31) << 32
    words, n_words = words.reshape(lanes, width), n_words - np.arange(lanes) * width
    crcs = [zlib.crc32(ids[k * BLOCK : (k + 1) * BLOCK].astype("<u4").tobytes()) for k in range(lanes)]
    # bytes of one weight lie together, which zlib packs better
    model = np.concatenate([w2, w1, np.diff(there, prepend=0), shares]).astype("<u4")
    model = zlib.compress(model.view(np.uint8).reshape(-1, 4).T.tobytes())
    head = MAGIC + struct.pack(_HEAD, len(ids), lanes, BLOCK, len(there), len(model))
    return b"".join([head, model, np.array(crcs, "<u4").tobytes(), n_words.astype("<u4").tobytes(), *(words[k, : n_words[k]].astype("<u4").tobytes() for k in range(lanes))])


def _carry(words: np.ndarray, n_words: np.ndarray, lanes: np.ndarray) -> None:
    at = n_words[lanes] - 1
    while len(at):
        words[at] += np.uint32(1)
        at = at[words[at] == 0] - 1


def unpack(frame: bytes, block: int | None = None) -> np.ndarray:
    """The ids of a frame, or of one block alone. Raises ValueError where a checksum or the header is wrong."""
    if frame[: len(MAGIC)] != MAGIC:
        raise ValueError("not a frame of token ids")
    total, lanes, width, n_there, n_model = struct.unpack_from(_HEAD, frame, len(MAGIC))
    at = len(MAGIC) + struct.calcsize(_HEAD)
    try:
        model = np.frombuffer(zlib.decompress(frame[at : at + n_model]), np.uint8)
    except zlib.error as e:
        raise ValueError("the header is damaged") from e
    model = np.ascontiguousarray(model.reshape(4, -1).T).view("<u4").ravel().astype(np.int64)
    w2, w1, there, shares = np.split(model, [_CONTEXTS, 2 * _CONTEXTS, 2 * _CONTEXTS + n_there])
    at += n_model
    crcs = np.frombuffer(frame, "<u4", lanes, at)
    n_words = np.frombuffer(frame, "<u4", lanes, at + 4 * lanes).astype(np.int64)
    firsts = np.cumsum(n_words) - n_words
    coded = np.frombuffer(frame, "<u4", int(n_words.sum()), at + 8 * lanes)
    pick = np.arange(lanes) if block is None else np.array([block])
    n_steps = width if lanes > 1 else max(1, total)
    ids = _decode(np.concatenate([coded, np.zeros(4, "<u4")]), firsts[pick], w2, w1, np.cumsum(there), shares, n_steps)
    for j, k in enumerate(pick):
        if zlib.crc32(ids[j, : min(width, total - k * width)].astype("<u4").tobytes()) != crcs[k]:
            raise ValueError(f"block {k} is damaged")
    return ids.ravel()[:total] if block is None else ids[0, : min(width, total - block * width)]


def _decode(coded: np.ndarray, at: np.ndarray, w2: np.ndarray, w1: np.ndarray, there: np.ndarray, shares: np.ndarray, n_steps: int) -> np.ndarray:
    lanes = len(at)
    # code is kept relative to low, which then need not be known
    code = (coded[at].astype(np.int64) << 31) | (coded[at + 1] >> 1)
    # a window of 63 bits reads the words one bit late
    late, at = ((coded[:-1] & 1) << np.uint32(31)) | (coded[1:] >> np.uint32(1)), at + 1
    rng = np.full(lanes, _LOW63)
    w21, w0 = w2 + w1, 65536 - w2 - w1
    rank = np.repeat(np.arange(len(there), dtype=np.uint16), shares)
    cums, there = np.cumsum(shares) - shares, there.astype(np.int32)
    slots, base = _memories(lanes)
    out = np.empty((n_steps, lanes), np.int32)
    x, hashed = np.zeros(lanes, np.int32), np.zeros(lanes, np.int32)
    i = np.empty((2, lanes), np.int64)
    e, ids, state, new = (np.empty((2, lanes), np.int32) for _ in range(4))
    context, unit, end2, end1, part, share, cum, found = (np.empty(lanes, np.int64) for _ in range(8))
    for step in range(n_steps):
        hashed += x
        np.bitwise_and(hashed, _SLOT, out=i[0])
        np.bitwise_and(x, _SLOT, out=i[1])
        i += base
        slots.take(i, out=e, mode="clip")
        np.bitwise_and(e, 0xFFFF, out=ids)
        np.right_shift(e, 16, out=state)
        np.minimum(state, STATES - 1, out=state)
        np.multiply(ids[0] == ids[1], STATES, out=context)
        context += state[0]
        context *= STATES
        context += state[1]
        np.right_shift(rng, 16, out=unit)
        w2.take(context, out=end2, mode="clip")
        end2 *= unit
        w21.take(context, out=end1, mode="clip")
        end1 *= unit
        w0.take(context, out=part, mode="clip")
        part *= unit
        part >>= SHARE
        np.multiply(x, 37, out=hashed)
        # order 0 for all lanes, as most ids come from it; then the predicted ones are put in their place
        np.subtract(code, end1, out=found)
        by0, by2 = found >= 0, code < end2
        np.floor_divide(found.view(np.uint64), part.view(np.uint64), out=found.view(np.uint64))
        found = rank.take(found, mode="clip").astype(np.int64)
        x = there.take(found, out=out[step], mode="clip")
        cums.take(found, out=cum, mode="clip")
        cum *= part
        cum += end1
        shares.take(found, out=share, mode="clip")
        share *= part
        np.copyto(x, ids[1], where=~by0)
        np.copyto(x, ids[0], where=by2)
        start = np.where(by0, cum, end2)
        start[by2] = 0
        end1 -= end2
        rng = np.where(by0, share, end1)
        np.copyto(rng, end2, where=by2)
        code -= start
        need = (rng < 1 << 31).nonzero()[0]
        if len(need):
            place = at.take(need)
            code[need] = (code.take(need) << 32) | late.take(place, mode="clip")
            at[need] = place + 1
            rng[need] = rng.take(need) << 32
        np.copyto(new, x)
        np.copyto(new, e, where=ids == x)
        new += 65536
        slots[i] = new
    return np.ascontiguousarray(out.T)


#: Encoded words remembered in a worker; later ones are encoded as they come.
MEMO = 700_000
_MARK = "<|endoftext|>"
#: The signs that the vocabulary has for bytes: printable characters of Latin-1 themselves, the rest in order; blanks part words here.
_SIGNS = {b: chr(b) for b in range(256)} | {b: chr(256 + k) for k, b in enumerate([*range(33), *range(127, 161), 173]) if b != 32}
#: ASCII marks at the end of a word that always start a pre-token of their own after an ASCII letter or digit.
_TAIL = b".,;:!?#*$%&"
_ALNUM = frozenset(b"abcdefghijklmnopqrstuvwxyz0123456789")


def _is_word(p: bytes) -> bool:
    """Whether p is one run of small Latin letters: normal form and pre-tokenizer leave it whole, and its last id alone ends a word."""
    if p.isascii():
        return p.isalpha() and p.islower()
    s = p.decode("utf-8", "replace")
    return s.isalpha() and max(s) < "\u0250" and s == s.lower()


class WordEncoder:
    """Ids of whole texts, as the library gives them. The pre-tokenizer drops white space and never crosses
    it, so a text is the sequence of its parts between ASCII blanks; each part is encoded once and remembered.

    The normalizer lower-cases, so ASCII capitals may be lowered before; not where marks that compose with
    letters (U+0300 to U+036F) could make one character of a capital, nor where a special string could arise."""

    def __init__(self, path: str):
        from .token_counts import tokenizer

        self.t, _, self.special = tokenizer(path)
        self.mark = self.t.token_to_id(_MARK)
        self.memo: dict[bytes, bytes] = {}
        # the same model without normalizer and pattern, for words that both leave as they are; their bytes get their signs here
        from tokenizers import Tokenizer, pre_tokenizers

        self.bare = Tokenizer(self.t.model)
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.last = np.zeros(self.t.get_vocab_size(), bool)
        self.last[[i for x, i in self.t.get_vocab(with_added_tokens=False).items() if x.endswith("</w>")]] = True

    def _parts(self, text: bytes) -> list[bytes]:
        return (text if b"<|" in text or b"\xcc" in text or b"\xcd" in text else text.lower()).split()

    def _encode(self, parts: set[bytes]) -> dict[bytes, bytes]:
        """Ids of each part and of whatever it was taken apart into."""
        out, whole, plain = {}, {}, set()
        for p in parts:
            if p.isalpha():
                plain.add(p)
                continue
            if b"<|" in p:
                s = p.decode("utf-8", "replace")
                if any(x in s for x in self.special):
                    out[p] = np.array(self.t.encode(s, add_special_tokens=False).ids, "<u2").tobytes()
                    continue
            head = p.rstrip(_TAIL)
            if len(head) < len(p) and head and head[-1] in _ALNUM:
                whole[p] = head, p[len(head) :]
            else:
                plain.add(p)
        for pair in whole.values():
            plain.update(pair)
        memo, words, other = self.memo, [], []
        for p in plain:
            if p not in memo:
                (words if _is_word(p) else other).append(p)
        self._cut(out, words, b" ", lambda x: x.decode("latin-1").translate(_SIGNS), self.bare, self.last, 0)
        self._cut(out, other, b" <|endoftext|> ", lambda x: x.decode("utf-8", "replace"), self.t, np.arange(len(self.last)) == self.mark, 2)
        for p, (head, tail) in whole.items():
            out[p] = (out.get(head) or memo[head]) + (out.get(tail) or memo[tail])
        return out

    @staticmethod
    def _cut(out: dict[bytes, bytes], parts: list[bytes], between: bytes, read: Callable[[bytes], str], t, stops: np.ndarray, width: int) -> None:
        """Encode parts 200 at a time; each ends after an id of stops (width 0) or before it (width 2 bytes)."""
        for at in range(0, len(parts), 200):
            some = parts[at : at + 200]
            ids = np.array(t.encode_batch_fast([read(between.join(some))], add_special_tokens=False)[0].ids, "<u2")
            cuts = (2 * np.flatnonzero(stops[ids]) + (2 - width)).tolist()
            small = ids.tobytes()
            out.update(zip(some, [small[a:b] for a, b in zip([0, *(c + width for c in cuts)], [*cuts, len(small)])]))

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        """Ids as little-endian unsigned 16-bit integers."""
        parts = [self._parts(t) for t in texts]
        flat = list(chain.from_iterable(parts))
        found = list(map(self.memo.get, flat))
        gaps = [k for k, x in enumerate(found) if x is None]
        fresh = self._encode({flat[k] for k in gaps})
        for k in gaps:
            found[k] = fresh[flat[k]]
        if len(self.memo) + len(fresh) <= MEMO:
            self.memo.update(fresh)
        ends = list(accumulate(map(len, parts), initial=0))
        return [b"".join(found[a:b]) for a, b in pairwise(ends)]


_encoders = cache()


def encoder(path: str) -> WordEncoder:
    """One encoder, with what it remembers, per worker and file."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, frame: int = FRAME) -> None:
    """Encode every whole text (null: empty), append ``end_id``, write frames in ascending id order.

    Range-partitioned and sorted by the id (ties by text), nulls first. A frame is closed after the document
    that reaches ``frame`` ids if at least half as many follow, else they join it, as a short frame costs as
    many steps as a long one. No document crosses frames, and a task holds one frame and a half at a time. The
    dataset has ``(part, seq, doc_ids, n_tokens, ids)``: the documents of the frame in order, their lengths,
    and the packed ids. Extra columns are ignored; an empty table writes an empty dataset.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").withColumn("part", F.spark_partition_id())

    def run(batches):
        claim("files")
        encode, held, n, seq, part, full, n_full = encoder(tokenizer_path), [], 0, 0, 0, 0, 0
        end = np.array([end_id], "<u2").tobytes()

        def close(held):
            ids = np.frombuffer(b"".join([x for _, x in held]), "<u2")
            sizes = [len(x) // 2 for _, x in held]
            kinds = (pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary())
            cols = (part, seq, [d for d, _ in held], sizes, pack(ids))
            return pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(cols, kinds)], ["part", "seq", "doc_ids", "n_tokens", "ids"])

        for b in batches:
            for at in range(0, b.num_rows, 2000):
                some = b.slice(at, 2000)
                part = some.column("part")[0].as_py()
                texts = [t or b"" for t in some.column("text").cast(pa.binary()).to_pylist()]
                for d, x in zip(some.column("doc_id").to_pylist(), encode(texts)):
                    held.append((d, x + end))
                    n += len(x) // 2 + 1
                    if full and n - n_full >= frame / 2:
                        yield close(held[:full])
                        held, n, seq, full = held[full:], n - n_full, seq + 1, 0
                    if not full and n >= frame:
                        full, n_full = len(held), n
        if held:
            yield close(held)

    rows.mapInArrow(run, "part int, seq int, doc_ids array<long>, n_tokens array<long>, ids binary").write.parquet(path)


def read_tokens(spark, path: str) -> DataFrame:
    """``(part, seq, pos, doc_id, n_tokens, ids)`` per document, ids as little-endian unsigned 32-bit integers; all checksums are verified."""
    return _read(spark, path, lambda x: x.astype("<u4").tobytes(), "ids binary", pa.binary())


def _read(spark, path: str, value, column: str, kind) -> DataFrame:
    # a frame is a row of its own: small Arrow batches keep one or two in a worker
    bound_batches(spark)

    def run(batches):
        for b in batches:
            for part, seq, docs, sizes, frame in zip(*(b.column(c) for c in ("part", "seq", "doc_ids", "n_tokens", "ids"))):
                ids, docs, sizes = unpack(frame.as_py()), docs.as_py(), sizes.as_py()
                ends = np.cumsum(sizes).tolist()
                out = [value(ids[e - n : e]) for n, e in zip(sizes, ends)]
                k = len(docs)
                cols = [pa.array([part.as_py()] * k, pa.int32()), pa.array([seq.as_py()] * k, pa.int32()), pa.array(range(k), pa.int64()), pa.array([e - n for n, e in zip(sizes, ends)], pa.int64()), pa.array(docs, pa.int64()), pa.array(sizes, pa.int64()), pa.array(out, kind)]
                yield pa.RecordBatch.from_arrays(cols, ["part", "seq", "pos", "at", "doc_id", "n_tokens", column.split()[0]])

    return spark.read.parquet(path).mapInArrow(run, f"part int, seq int, pos long, at long, doc_id long, n_tokens long, {column}")


def token_digests(spark, path: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every document in the files at path, from the decoded ids.

    start: ids of all documents before it. The frames' sizes are summed per part first; only the parts'
    totals (one row per written partition) are put in order, and within a part only its frames.
    """
    from pyspark.sql import Window

    frames = spark.read.parquet(path).select("part", "seq", F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    parts = frames.groupBy("part").agg(F.sum("n").alias("n"))
    before = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("part_at"))
    inside = frames.select("part", "seq", F.coalesce(F.sum("n").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("frame_at"))
    offsets = inside.join(before, "part").select("part", "seq", (F.col("part_at") + F.col("frame_at")).alias("first"))
    docs = _read(spark, path, lambda x: zlib.crc32(x.astype("<u4").tobytes()), "ids_crc32 long", pa.int64())
    return docs.join(offsets, ["part", "seq"]).select("doc_id", (F.col("first") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
