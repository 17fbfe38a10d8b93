"""SentencePiece encoding and decoding of whole texts with a given model, without training.

A segment (white-space marks and the characters up to the next mark) is cut by a Viterbi pass over its
lattice of pieces. Segments of equal length advance together: hashes of all their substrings probe the
sorted hashes of the pieces, and at each place the vectorised maximum over the pieces that end there is
stored with its backpointer. For unigram models the score of a path is the sum of its pieces' scores. A BPE
model doesn't choose by sums: there, a path is admissible if each two neighbouring pieces are what merging
yields for their joint string, and exactly one path is; the maximum then picks the one admissible piece.
The ids are those of the sentencepiece library for the same file.
"""

from __future__ import annotations

import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, cache, claim, packed

MARK = "▁"
_SEGMENT = re.compile(" +[^ ]*|[^ ]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Segments and pairs of pieces remembered in a worker.
MEMO, PAIRS = 1_000_000, 1_500_000
#: Segments up to this length are advanced together, longer ones alone.
TOGETHER = 64
_codecs = cache()


def _fields(b: bytes):
    """(field, value) of a protocol buffer message."""
    i = 0

    def varint():
        nonlocal i
        n = shift = 0
        while True:
            x = b[i]
            i += 1
            n |= (x & 127) << shift
            shift += 7
            if x < 128:
                return n

    while i < len(b):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        else:
            n = varint() if tag & 7 == 2 else {5: 4, 1: 8}[tag & 7]
            yield tag >> 3, b[i : i + n]
            i += n


class Codec:
    """Encoder and decoder for a model file with identity normalisation, unigram or BPE, with byte fallback or not."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            model = list(_fields(f.read()))
        self.pieces, self.scores, kinds = [], [], []
        for field, v in model:
            if field == 1:
                d = dict(_fields(v))
                self.pieces.append(d[1].decode())
                self.scores.append(struct.unpack("<f", d[2])[0] if 2 in d else 0.0)
                kinds.append(d.get(3, 1))
        trainer = dict(_fields(next((v for f, v in model if f == 2), b"")))
        normal = dict(_fields(next((v for f, v in model if f == 3), b"")))
        if normal.get(2) or normal.get(4, 1):
            raise ValueError("only models that leave the text as it is are supported")
        self.prefix = bool(normal.get(3, 1))
        self.bpe = trainer.get(3, 1) == 2
        self.unknown = kinds.index(2)
        bytes_at = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, kinds)) if k == 6}
        self.bytes = [bytes_at[b] for b in range(256)] if len(bytes_at) == 256 else None
        self.byte_of = {i: b for b, i in bytes_at.items()}
        self.id_of = {p: i for i, (p, k) in enumerate(zip(self.pieces, kinds)) if k in (1, 4)}
        #: What each id stands for in a decoded text.
        self.said = [bytes([self.byte_of[i]]) if i in self.byte_of else b"" if k == 3 else " ⁇ ".encode() if k == 2 else p.encode() for i, (p, k) in enumerate(zip(self.pieces, kinds))]
        self.cut = not any(MARK in p.lstrip(MARK) for p in self.id_of)
        self.longest = max(map(len, self.id_of), default=1)
        self.rank = {p: (-self.scores[i]) for p, i in self.id_of.items()}
        #: Score of a character without a piece: ten below the lowest of a usual piece.
        self.worst = min((self.scores[i] for i, k in enumerate(kinds) if k == 1), default=0.0) - 10.0
        self.memo: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}
        usable = [p for p in self.id_of if not self.bpe or self._merge(p) == [p]]
        keys = np.array([self._hash(p) for p in usable], np.uint64)
        order = np.argsort(keys)
        self.keys, self.key_ids = keys[order], np.array([self.id_of[p] for p in usable], np.int64)[order]
        if len(np.unique(self.keys)) != len(self.keys):
            raise ValueError("two pieces have one hash")

    @staticmethod
    def _hash(s: str) -> int:
        h = 0
        for c in s:
            h = (h * int(_BASE) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    def _merge(self, s: str) -> list[str]:
        """Greedy merging: the best-ranked neighbouring pair that makes a piece, leftmost first."""
        parts, rank = list(s), self.rank
        while len(parts) > 1:
            best = min(((rank.get(a + b, np.inf), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))))
            if best[0] == np.inf:
                break
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _joined(self, a: int, b: int) -> bool:
        key = a * len(self.pieces) + b
        ok = self.pairs.get(key)
        if ok is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            x, y = self.pieces[a], self.pieces[b]
            ok = self.pairs[key] = self._merge(x + y) == [x, y]
        return ok

    def _matches(self, codes: np.ndarray) -> np.ndarray:
        """[length - 1, segment, start] -> piece id or -1."""
        n, size = codes.shape
        out = np.full((min(self.longest, size), n, size), -1, np.int64)
        if not len(self.keys):
            return out
        h = np.zeros((n, size), np.uint64)
        for k in range(out.shape[0]):
            h = h[:, : size - k] * _BASE + codes[:, k:].astype(np.uint64) + np.uint64(1)
            at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
            out[k, :, : size - k] = np.where(self.keys[at] == h, self.key_ids[at], -1)
        return out

    def _admissible(self, last: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Whether each piece may follow the last one (-2: start, -1: a character without a piece)."""
        keys = np.where(last < 0, -1, last * len(self.pieces) + piece).tolist()
        known = list(map(self.pairs.get, keys))
        for i, (k, ok) in enumerate(zip(keys, known)):
            if ok is None:
                known[i] = k < 0 or self._joined(int(last[i]), int(piece[i]))
        return np.array(known, bool)

    def _viterbi(self, codes: np.ndarray) -> list[list[int]]:
        """Pieces of segments of one length; -1 for a character without a piece."""
        n, size = codes.shape
        m = self._matches(codes)
        last = np.full((n, size + 1), -1, np.int64)
        last[:, 0] = -2
        back = np.zeros((n, size + 1), np.int32)
        score = np.zeros((n, size + 1))
        values = np.array(self.scores)
        for j in range(1, size + 1):
            top = np.full(n, -np.inf)
            for k in range(min(len(m), j), 0, -1):
                i = j - k
                piece = m[k - 1, :, i]
                rows = np.flatnonzero((piece >= 0) & (~np.isfinite(top) if self.bpe else True) & (score[:, i] > -np.inf))
                if self.bpe and len(rows):
                    rows = rows[self._admissible(last[rows, i], piece[rows])]
                if not len(rows):
                    continue
                value = np.zeros(len(rows)) if self.bpe else score[rows, i] + values[piece[rows]]
                better = value > top[rows]
                rows = rows[better]
                top[rows], last[rows, j], back[rows, j] = value[better], piece[rows], i
            # a character without a piece may stand alone
            lone = (m[0, :, j - 1] < 0) & (score[:, j - 1] > -np.inf)
            lone = np.flatnonzero(lone & ~np.isfinite(top) if self.bpe else lone & (score[:, j - 1] + self.worst > top))
            top[lone], last[lone, j], back[lone, j] = score[lone, j - 1] + self.worst, -1, j - 1
            score[:, j] = np.where(np.isfinite(top), 0.0, top) if self.bpe else top
        out = []
        for r in range(n):
            path, j = [], size
            while j:
                path.append((int(last[r, j]), int(back[r, j])))
                j = path[-1][1]
            out.append(path[::-1])
        return out

    def _ids(self, segment: str, path: list[tuple[int, int]]) -> bytes:
        ids: list[int] = []
        for piece, at in path:
            if piece >= 0:
                ids.append(piece)
            elif self.bytes:
                ids += [self.bytes[b] for b in segment[at].encode("utf-8", "surrogatepass")]
            elif not ids or ids[-1] != self.unknown:
                ids.append(self.unknown)
        return np.array(ids, "<u4").tobytes()

    def _encode(self, segments: list[str]) -> dict[str, bytes]:
        by_size: dict[int, list[str]] = {}
        for s in segments:
            by_size.setdefault(len(s), []).append(s)
        out = {}
        for size, group in by_size.items():
            step = 4096 if size <= TOGETHER else 1
            for at in range(0, len(group), step):
                some = group[at : at + step]
                codes = np.frombuffer("".join(some).replace(" ", MARK).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(some), size)
                for s, path in zip(some, self._viterbi(codes) if size <= 4096 else [self._alone(some[0], codes)]):
                    out[s] = self._ids(s, path)
        return out

    def _alone(self, segment: str, codes: np.ndarray) -> list[tuple[int, int]]:
        """The same for one very long segment, place by place over blocks of substring matches."""
        size, width = len(segment), self.longest
        last, back, score = [-2] + [-1] * size, [0] * (size + 1), [0.0] + [-np.inf] * size
        block = 1 << 16
        ready, m = 0, None
        for j in range(1, size + 1):
            if m is None or j > ready:
                start = max(0, j - width)
                ready = min(size, j + block)
                m = self._matches(codes[:, start:ready])[:, 0, :]
            for k in range(min(width, j, len(m)), 0, -1):
                i = j - k
                piece = int(m[k - 1, i - start])
                if piece >= 0 and (last[i] < 0 or not self.bpe or self._joined(last[i], piece)):
                    value = 0.0 if self.bpe else score[i] + self.scores[piece]
                    if value > score[j]:
                        score[j], last[j], back[j] = value, piece, i
                    if self.bpe:
                        break
            if score[j] == -np.inf or not self.bpe and m[0, j - 1 - start] < 0 and score[j - 1] + self.worst > score[j]:
                score[j], last[j], back[j] = score[j - 1] + (0 if self.bpe else self.worst), -1, j - 1
        path, j = [], size
        while j:
            path.append((last[j], back[j]))
            j = back[j]
        return path[::-1]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text; null and empty texts have none."""
        cut = []
        for t in texts:
            # blanks stand for marks until a segment is cut, which keeps what is remembered small
            s = (" " if self.prefix and t else "") + (t or "").replace(MARK, " ")
            cut.append(_SEGMENT.findall(s) if self.cut else [s] if s else [])
        memo = self.memo
        fresh = self._encode([s for s in set().union(*cut) if s not in memo]) if cut else {}
        if len(memo) < MEMO:
            memo.update(fresh)
        return [np.frombuffer(b"".join([memo[s] if s in memo else fresh[s] for s in c]), "<u4") for c in cut]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: bytes are joined, marks become blanks, and the mark before the text goes."""
        out = b"".join(map(self.said.__getitem__, ids.tolist()))
        s = out.decode("utf-8", "replace").replace(MARK, " ")
        return s[1:] if self.prefix and s.startswith(" ") else s


def codec(path: str) -> Codec:
    """One codec per worker and file."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode_texts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", whole_rows: bool = False) -> DataFrame:
    """Every row with ``n_pieces``, ``ids`` (array), ``ids_crc32`` (of little-endian unsigned 32-bit ids) and ``decoded``.

    Columns: doc_id, then those above; with ``whole_rows`` a struct ``row`` of all columns of docs in place of
    doc_id, so that no column of docs can clash. Other columns are ignored. Null text counts as empty; repeated
    rows are encoded each; an empty table gives no rows; a text is encoded whole, however long. ``path`` names a
    model file that every executor has. decoded equals the text unless it holds the mark itself.
    """
    bound_batches(docs.sparkSession)
    rows = docs.select(packed(docs, id_col, text_col, whole_rows).alias("row"))
    place = rows.schema["row"].dataType.names.index(text_col)

    def run(batches):
        claim("sentencepiece")
        c = codec(path)
        for b in batches:
            texts = b.column("row").field(place)
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                ids = c.encode(texts.slice(at, 1000).to_pylist())
                sizes = np.cumsum([0, *map(len, ids)])
                flat = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *ids]).astype(np.int32)))
                cols = [part.column("row"), pa.array([len(x) for x in ids], pa.int64()), flat, pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64()), pa.array([c.decode(x) for x in ids], pa.string())]
                yield pa.RecordBatch.from_arrays(cols, ["row", "n_pieces", "ids", "ids_crc32", "decoded"])

    done = rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, n_pieces long, ids array<int>, ids_crc32 long, decoded string")
    return done if whole_rows else done.select(F.col("row")[id_col].alias("doc_id"), *done.columns[1:])
