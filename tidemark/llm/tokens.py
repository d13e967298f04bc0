"""Token counts by prefix dynamic programming.

``PrefixCounts`` holds the exact token count at every character prefix of one
text, so truncation and budget questions need no second encoding.  Over a
DataFrame, :func:`count_tokens` takes each distinct piece's count at its last
prefix, keeps the running count at the piece ends, and opens the one piece
where the limit falls.

Nulls and empty texts count 0 tokens.  Rows are kept one for one, repeated and
null ids included; further columns of the input aren't returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import bpe
from tidemark.llm.runtime import prepare
from tidemark.llm.textvec import chunks

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fit_bytes long"


def _is_blank(piece: bytes) -> bool:
    """Whether the piece is white space; all signs of a piece are of one class, but for a blank before."""
    return bool(bpe.classes(np.frombuffer(piece, np.uint8))[0][-1] == bpe.BLANK)


def _at_bytes(enc: bpe.PieceEncoder, raw: bytes, starts: list[int], ends: list[int], number: list[int], total: int) -> np.ndarray:
    """Token counts of the text cut at each byte from starts[0] to ends[-1].

    ``total``: tokens before the first piece.  Besides the counts inside each
    piece, three cuts change how the text before them is split: blanks at the
    end of a text are one piece, a cut clitic is an apostrophe and a letter,
    and a cut special string is plain text.
    """
    base = starts[0]
    out = np.full(ends[-1] - base + 1, total, np.int64)
    run = (b"", 0)  # the blank piece right before, and the tokens before it
    plain = (base, total)  # where the piece right before begins, and the tokens before it
    for s, e, k in zip(starts, ends, number, strict=True):
        piece = raw[s:e]
        here = out[s - base : e - base + 1]
        if k < 0:
            for j in range(1, e - s):
                here[j] = plain[1] + enc.total(raw[plain[0] : s + j])
            total += 1
            here[-1], run, plain = total, (b"", 0), (e, total)
            continue
        inner = enc.prefix_counts(piece)
        here[1:] = [total + c for c in inner[1:]]
        if piece in (b"'re", b"'ve", b"'ll"):
            here[2] = total + enc.prefix_counts(b"'")[-1] + enc.prefix_counts(piece[1:2])[-1]
        blank = _is_blank(piece)
        if run[0] and (blank or piece[:1] == b" "):
            head = piece if blank else b" "
            here[len(head)] = run[1] + enc.prefix_counts(run[0] + head)[-1]
        run = (piece, total) if blank else (b"", 0)
        plain = (s, total)
        total += inner[-1]
    return out


class PrefixCounts:
    """Exact token counts of ``text[:0]``, ``text[:1]``, ..., ``text``."""

    def __init__(self, text: str, path: str | None = None) -> None:
        enc = bpe.encoder(path or bpe.default_path())
        raw = text.encode()
        data = np.frombuffer(raw, np.uint8)
        starts, ends, number = enc.cut(data, np.array([0, len(raw)]))
        at_byte = _at_bytes(enc, raw, starts.tolist(), ends.tolist(), number.tolist(), 0) if raw else np.zeros(1, np.int64)
        self.counts = at_byte[np.append((data & 0xC0) != 0x80, True)]

    def __len__(self) -> int:
        return int(self.counts[-1])

    def longest(self, budget: int) -> int:
        """Characters of the longest prefix of at most ``budget`` tokens."""
        return int(np.flatnonzero(self.counts <= budget)[-1]) if budget >= 0 else 0


def _fit(enc: bpe.PieceEncoder, raw: bytes, starts: np.ndarray, ends: np.ndarray, number: np.ndarray, totals: np.ndarray, limit: int) -> int:
    """Bytes of the longest prefix of at most ``limit`` tokens; totals[j]: tokens before piece j."""
    j = int(np.searchsorted(totals, limit, "right")) - 1  # the piece that passes the limit
    low, high = max(0, j - 3), min(len(starts), j + 3)
    base, most = int(starts[low]), int(starts[j]) + (limit + 1) * enc.longest
    if most < ends[j]:  # a cut so far on has too many tokens, each being short
        high, ends = j + 1, np.minimum(ends, most)
    counts = _at_bytes(enc, raw, starts[low:high].tolist(), ends[low:high].tolist(), number[low:high].tolist(), int(totals[low]))
    for i in np.flatnonzero(counts <= limit)[::-1].tolist():
        if base + i >= len(raw) or raw[base + i] & 0xC0 != 0x80:
            return base + i
    return base


def count_tokens(docs: DataFrame, limit: int = 512, path: str | None = None) -> DataFrame:
    """One row per document: bytes, exact tokens, whether over ``limit``, and the
    bytes of the longest prefix that stays within it."""
    prepare(docs.sparkSession)
    path = path or bpe.default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = bpe.encoder(path)
        for batch in batches:
            for a, b, data, offsets in chunks(batch.column(1)):
                starts, ends, number = enc.cut(data, offsets)
                total = np.concatenate([[0], np.cumsum(enc.counts(number))])
                first = np.searchsorted(starts, offsets)
                tokens = total[first[1:]] - total[first[:-1]]
                size = np.diff(offsets)
                fit = size.copy()
                for i in np.flatnonzero(tokens > limit).tolist():
                    f, g, o = first[i], first[i + 1], offsets[i]
                    fit[i] = _fit(enc, data[o : offsets[i + 1]].tobytes(), starts[f:g] - o, ends[f:g] - o, number[f:g], total[f : g + 1] - total[f], limit)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(size), pa.array(tokens), pa.array(tokens > limit), pa.array(fit)], ["doc_id", "n_bytes", "n_tokens", "over_limit", "fit_bytes"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)
