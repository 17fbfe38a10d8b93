"""Token counts of whole texts, with overlap resynchronisation for huge documents.

Texts of ordinary length are counted by pre-token: the pattern of byte-level BPE never joins a character
that is not white space to white space after it, so a text falls into units (an optional blank and the
characters up to the next white space, or white space alone) whose tokens don't depend on each other. A
unit is encoded once by the library and remembered. Huge texts are encoded in overlapping chunks with
offsets; neighbouring chunks are spliced at a place where both have a token boundary between a character
and white space after it, and the overlap is widened while there is no such place.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, cache, claim

#: Unicode White_Space, which is what ``\\s`` means to the library.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
UNIT = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]")
_BOUNDARY = re.compile(f"(?<=[^{SPACE}])(?=[{SPACE}])")
#: Characters from which a text counts as huge, of a chunk, and of the first overlap.
HUGE, CHUNK, OVERLAP = 40_000, 16_384, 256
#: Units remembered in a worker; later ones are encoded as they come.
MEMO = 400_000
_tokenizers = cache()


def tokenizer(path: str):
    """The library's tokenizer for a .json file, one per worker."""
    if path not in _tokenizers:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        _tokenizers[path] = (t, {}, tuple(x.content for x in t.get_added_tokens_decoder().values()))
    return _tokenizers[path]


#: White space of two or more characters before a word: all but its last character is one unit.
_LONG = re.compile(f"[{SPACE}]{{2,}}(?=[^{SPACE}])")
_RUNS = re.compile(f"[{SPACE}]+|[^{SPACE}]+")


def _exact_units(text: str) -> list[str]:
    out, runs = [], _RUNS.findall(text)
    i, n = 0, len(runs)
    while i < n:
        r = runs[i]
        if r[0] in _SPACES:
            if i + 1 == n:
                out.append(r)
                break
            if len(r) > 1:
                out.append(r[:-1])
            if r[-1] == " ":
                out.append(" " + runs[i + 1])
                i += 2
                continue
            out.append(r[-1])
        else:
            out.append(r)
        i += 1
    return out


_SPACES = frozenset(c for c in map(chr, range(0x3001)) if re.match(f"[{SPACE}]", c))


def pre_units(text: str) -> list[str]:
    """Parts of a text that the pre-tokenizer treats apart."""
    return _exact_units(text) if _LONG.search(text) else UNIT.findall(text)


def chunk_boundaries(left: list[tuple[int, int]], right: list[tuple[int, int]], text: str, lo: int, hi: int) -> int | None:
    """A place in (lo, hi) where both encodings have a boundary that white space proves stable; the middle-most."""
    common = {a for a, _ in left} & {a for a, _ in right}
    good = [m.start() for m in _BOUNDARY.finditer(text, lo, hi) if lo < m.start() < hi and m.start() in common]
    return min(good, key=lambda p: abs(2 * p - lo - hi)) if good else None


def count_huge(encode, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of a text of any length. encode(text) gives the (start, end) offsets of its tokens in characters.

    The tokens before a splice come from the left chunk and those from it on from the right one. Without a
    proven common boundary the overlap doubles, in the end to the whole text.
    """
    total, at, done = 0, 0, False  # at: a proven boundary, or the start
    while not done:
        wide = overlap
        left_end = min(len(text), at + chunk + wide)
        while True:
            left = [(a + at, b + at) for a, b in encode(text[at:left_end])]
            if left_end == len(text):
                total, done = total + len(left), True
                break
            start = max(at, left_end - 2 * wide)
            right = [(a + start, b + start) for a, b in encode(text[start : min(len(text), left_end + wide)])]
            cut = chunk_boundaries(left, right, text, start, left_end)
            if cut is not None and cut > at:
                total += sum(a < cut for a, _ in left)
                at = cut
                break
            wide *= 2
            left_end = min(len(text), at + chunk + wide)
    return total


def unit_counts(t, units: list[str]) -> list[int]:
    """Tokens of each unit. Units without a line break are encoded many at a time, set apart by line breaks,
    which are pre-tokens (and so tokens) of their own before a word."""
    out: list[int] = [0] * len(units)
    plain = [i for i, u in enumerate(units) if u.strip()]
    for i in set(range(len(units))).difference(plain):
        out[i] = len(t.encode(units[i], add_special_tokens=False))
    line = t.token_to_id("\u010a")
    for at in range(0, len(plain), 1000):
        part = plain[at : at + 1000]
        ids = np.array(t.encode("\n".join([units[i] for i in part]), add_special_tokens=False).ids)
        cuts = np.flatnonzero(ids == line)
        for i, n in zip(part, np.diff(cuts, prepend=-1, append=len(ids)).tolist()):
            out[i] = n - 1
    return out


def counter(path: str, huge: int = HUGE, memo_size: int = MEMO):
    """A function from a list of texts (None: empty) to their token counts."""
    t, memo, special = tokenizer(path)
    encode = lambda x: t.encode(x, add_special_tokens=False).offsets

    def count(texts: list[str | None]) -> list[int]:
        out, waiting = [], []
        for x in texts:
            if not x:
                out.append(0)
            elif any(s in x for s in special):
                out.append(len(t.encode(x, add_special_tokens=False).ids))
            elif len(x) >= huge:
                out.append(count_huge(encode, x))
            else:
                waiting.append((len(out), pre_units(x)))
                out.append(0)
        new = [u for u in set().union(*(us for _, us in waiting)) if u not in memo]
        fresh = dict(zip(new, unit_counts(t, new)))
        if len(memo) < memo_size:
            memo.update(fresh)
            get = memo.__getitem__
        else:
            get = lambda u: memo[u] if u in memo else fresh[u]
        for i, us in waiting:
            out[i] = sum(map(get, us))
        return out

    return count


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """``(id, n_bytes, n_tokens, over_limit)`` for every row: UTF-8 bytes, library tokens, whether over ``limit``.

    Null text counts as empty; repeated rows and null ids count as rows; an empty table gives no rows; other
    columns are ignored; a text is counted whole, however long. ``path`` names a tokenizers .json file that every executor has. Special
    strings inside texts are handled as the library's default; such texts are encoded in one piece.
    """
    bound_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        claim("counts")
        count = counter(path)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                n = count(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
