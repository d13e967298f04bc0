"""Byte-level BPE over whole batches, and prefix token counts.

A text is cut into pieces as the vocabulary's pattern does (runs of letters,
numbers, other signs and white space, a leading blank kept with what follows,
English clitics apart).  BPE never merges across pieces, so each distinct piece
of a batch is looked at once and the rest is array indexing.

Counts come from prefix dynamic programming within the piece: the last token of
the prefix of length i is the one token t ending at i that may follow the last
token of the prefix of length i - len(t), and count[i] = count[i - len(t)] + 1.
The tokens that end at each byte are found by one pass of an automaton over all
new pieces, so the time is linear in their bytes.  Ids come from the tokenizers
library, piece by piece.

Two tokens may stand side by side if no merge across their border is ever the
next one.  While BPE builds them, the token at the border on each side passes
through a chain of growing tokens, and merges are made in the order of their
ids; so a merge of two such tokens is made if its id is below those of the
merges that would take either of them away.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
from array import array

import numpy as np

from tidemark.llm.textvec import factorize, span_hashes

LETTER, NUMBER, OTHER, BLANK = 1, 2, 3, 4
#: Distinct pieces, and ids of all of them, that are remembered between batches; beyond it the memory starts anew.
REMEMBERED, REMEMBERED_IDS = 1_000_000, 8_000_000
#: Pairs of tokens of which it is remembered whether they may stand side by side.
PAIRS = 400_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@functools.cache
def _classes() -> np.ndarray:
    """The pattern's class of every code point."""
    import regex

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    out = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (BLANK, r"\s+")):
        for m in regex.finditer(pattern, every):
            a, b = m.span()
            if b > 0xD800:  # the surrogates are left out above
                b += 0x800
                a += 0x800 if a >= 0xD800 else 0
            out[a:b] = kind
    return out


def classes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class of each byte's character, and whether the byte begins a character."""
    table = _classes()
    cls = table[:256][data]
    lead = np.ones(len(data), bool)
    high = np.flatnonzero(data >= 0x80)
    if len(high):
        b = data[high]
        lead[high[b < 0xC0]] = False
        pad = np.concatenate([data, np.zeros(3, np.uint8)])
        for low, top, bits, extra in ((0xC0, 0xE0, 0x1F, 1), (0xE0, 0xF0, 0x0F, 2), (0xF0, 0x100, 0x07, 3)):
            at = high[(b >= low) & (b < top)]
            if len(at):
                point = pad[at].astype(np.int64) & bits
                for k in range(1, extra + 1):
                    point = (point << 6) | (pad[at + k] & 0x3F)
                kind = table[np.minimum(point, 0x10FFFF)]
                cls[at] = kind
                for k in range(1, extra + 1):
                    cls[np.minimum(at + k, len(data) - 1)] = kind
    return cls, lead


def pieces(data: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Starts of the pieces; ``edges`` are the texts' starts and the end of the last."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64)
    cls, lead = classes(data)
    edge = np.zeros(n + 1, bool)
    edge[edges] = True
    change = edge[:-1].copy()
    change[1:] |= cls[1:] != cls[:-1]
    blank = cls == BLANK
    start = change.copy()
    # The last character of a blank run before a sign of the same text is cut off ...
    run_end = np.flatnonzero(blank & np.append(change[1:], True)) + 1
    run_end = run_end[~edge[run_end]]
    last = run_end - 1
    while len(step := np.flatnonzero(~lead[last])):
        last[step] -= 1
    start[last] = True
    # ... and if it is an ASCII blank it belongs to the next piece.
    start[run_end[data[run_end - 1] == 32]] = False
    # Clitics: an apostrophe that begins a piece, and the letters after it.
    quote = np.flatnonzero((data[:-1] == 0x27) & start[:-1] & change[1:] & ~edge[1:-1] & (cls[1:] == LETTER))
    for i in quote.tolist():
        two = bytes(data[i + 1 : i + 3])
        # both letters must lie in this text
        length = 2 if two[:1] in (b"s", b"t", b"m", b"d") else 3 if two in (b"re", b"ve", b"ll") and not edge[i + 2] else 0
        if length:
            start[i + 1] = False
            if i + length < n:
                start[i + length] = True
    return np.flatnonzero(start)


class _Memory:
    """Numbers of the pieces met so far, by hash, and what was learned of each."""

    def __init__(self) -> None:
        self.hashes = np.zeros(0, np.uint64)  # sorted
        self.number = np.zeros(0, np.int64)  # of the piece with this hash
        self.size = np.zeros(0, np.int64)
        self.begin = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of the pieces with these hashes, -1 for a new one."""
        if not len(self.hashes):
            return np.full(len(hashes), -1, np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.number[at], -1)

    def add(self, hashes: np.ndarray, size: np.ndarray, ids: np.ndarray) -> None:
        self.begin = np.concatenate([self.begin, len(self.ids) + np.cumsum(size) - size])
        number = np.concatenate([self.number, len(self.size) + np.arange(len(size))])
        self.size, self.ids = np.concatenate([self.size, size]), np.concatenate([self.ids, ids])
        hashes = np.concatenate([self.hashes, hashes])
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.number = hashes[order], number[order]

    @property
    def full(self) -> bool:
        return len(self.hashes) > REMEMBERED or len(self.ids) > REMEMBERED_IDS


class PieceEncoder:
    """Counts and encodes texts as the tokenizer file does, without adding special tokens.

    Special strings inside a text become their one token, which is the
    library's default.  Made once per Python worker by :func:`encoder`.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a worker has one core
        import ahocorasick

        self.path = path
        spec = json.load(open(path, encoding="utf-8"))
        pre = spec.get("pre_tokenizer") or {}
        model = spec["model"]
        if spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or model["type"] != "BPE" or model.get("dropout") or model.get("ignore_merges"):
            raise ValueError("only plain byte-level BPE files can be counted by prefix")
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        signs = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
        self.special = {t["content"].encode(): t["id"] for t in spec["added_tokens"] if t["special"]}
        raw = {bytes(signs[c] for c in token): i for token, i in model["vocab"].items() if token.encode() not in self.special}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        parts = [tuple(raw[bytes(signs[c] for c in side)] for side in m) for m in merges]
        ids = [raw[bytes(signs[c] for c in a + b)] for a, b in merges]
        if ids != sorted(ids) or len(set(ids)) != len(ids) or any(max(x) >= i for x, i in zip(parts, ids, strict=True)):
            raise ValueError("merges must be in the order of their ids")
        self.longest = max(map(len, raw))
        self.merged = dict(zip(parts, ids, strict=True))
        self.parts = dict(zip(ids, parts, strict=True))
        self.edges: dict[tuple[int, int], list[tuple[int, int]]] = {}
        self.beside: dict[int, bool] = {}  # by first << 32 | second
        self.automaton = ahocorasick.Automaton()
        for token, i in raw.items():
            self.automaton.add_word(token.decode("latin-1"), (i, len(token)))
        self.automaton.make_automaton()
        self.counted, self.encoded = _Memory(), _Memory()

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The tokens that stand at the token's right (1) or left (0) end while it is built, each with its successor."""
        if (token, side) not in self.edges:
            out, after = [(token, 1 << 62)], token
            while after in self.parts:
                before = self.parts[after][side]
                out.append((before, after))
                after = before
            self.edges[token, side] = out
        return self.edges[token, side]

    def may_follow(self, first: int, second: int) -> bool:
        """Whether BPE of the joined bytes of two tokens gives just these tokens."""
        if len(self.beside) >= PAIRS:
            self.beside.clear()
        merged, right, left = self.merged, self._edge(first, 1), self._edge(second, 0)
        out = True
        for a, x in right:
            for b, y in left:
                m = merged.get((a, b))
                # of two equal merges the left one is made first
                if m is not None and m < x and m <= y:
                    out = False
                    break
            if not out:
                break
        self.beside[first << 32 | second] = out
        return out

    def prefix_counts(self, joined: bytes, begin: list[int] | None = None) -> array:
        """Exact token counts of joined[:0], joined[:1], ..., joined, a piece; ``begin``: of several
        pieces, each followed by a byte more, whose counts start anew there."""
        text = joined.decode("latin-1")
        last = array("i", bytes(4 * (len(text) + 2)))  # token + 2, 1 where a piece begins, 0 where not known
        count = array("i", bytes(4 * (len(text) + 2)))
        last[0] = 1
        if begin is not None:
            marked = list(text)
            for k in begin:
                last[k] = 1
                if k:
                    marked[k - 1] = "\u0100"  # no token holds it
            text = "".join(marked)
        known, may_follow = self.beside.get, self.may_follow
        for end, (token, size) in self.automaton.iter(text):
            at = end + 1
            # where a piece ends, the place after the next byte begins anew; its own place is still free
            if not last[at]:
                before = last[at - size]
                if before > 1:
                    fits = known(before - 2 << 32 | token)
                    if fits is None:
                        fits = may_follow(before - 2, token)
                    if not fits:
                        continue
                elif not before:
                    continue
                last[at] = token + 2
                count[at] = count[at - size] + 1
        return count[: len(joined) + 1]

    def piece_totals(self, texts: list[bytes]) -> np.ndarray:
        """Tokens of each piece: its count at the last prefix."""
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(size + 1)
        counts = np.frombuffer(self.prefix_counts(b"\0".join(texts), (ends - size - 1).tolist()), np.int32)
        return counts[ends - 1].astype(np.int64)

    def _ids(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of ids of each piece, and all ids, from the library."""
        found = [e.ids for e in _library(self.path).encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)]
        size = np.fromiter(map(len, found), np.int64, len(found))
        return size, np.fromiter(itertools.chain.from_iterable(found), np.uint32, int(size.sum()))

    def cut(self, data: np.ndarray, offsets: np.ndarray, with_ids: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Piece starts, piece ends and the number in the memory of each piece, -1 - id for special strings."""
        edges, special = offsets, {}
        whole = data.tobytes()
        for mark, token in self.special.items():
            at = whole.find(mark)
            while at >= 0:
                text = int(np.searchsorted(offsets, at, "right")) - 1
                if at + len(mark) <= offsets[text + 1]:
                    special[at] = (token, at + len(mark))
                    at = whole.find(mark, at + len(mark))
                else:
                    at = whole.find(mark, at + 1)
        if special:
            edges = np.unique(np.concatenate([offsets, [*special], [e for _, e in special.values()]]))
        starts = pieces(data, edges)
        if special:  # what lies inside a special string isn't cut
            begin = np.array(sorted(special))
            end = np.array([special[int(b)][1] for b in begin])
            k = np.searchsorted(begin, starts, "right") - 1
            starts = starts[(k < 0) | (starts == begin[k]) | (starts >= end[k])]
        ends = np.append(starts[1:], len(data))[: len(starts)]
        hashes = span_hashes(data, starts, ends)
        codes, where = factorize(hashes)
        if (memory := self.encoded if with_ids else self.counted).full:
            memory.__init__()
        keys = hashes[where]
        got = memory.find(keys)
        new = np.flatnonzero(got < 0)
        if len(new):
            s, e = starts[where[new]].tolist(), ends[where[new]].tolist()
            texts = [whole[i:j] for i, j in zip(s, e, strict=True)]
            size, ids = self._ids(texts) if with_ids else (self.piece_totals(texts), np.zeros(0, np.uint32))
            memory.add(keys[new], size, ids)
            got = memory.find(keys)
        number = got[codes]
        for at, (token, _) in special.items():
            number[np.searchsorted(starts, at)] = -1 - token
        return starts, ends, number

    def counts(self, number: np.ndarray, memory: _Memory | None = None) -> np.ndarray:
        size = (memory or self.counted).size
        return np.where(number < 0, 1, size[np.maximum(number, 0)]) if len(size) else np.ones(len(number), np.int64)

    def encode_batch(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and where each text's ids begin."""
        starts, _, number = self.cut(data, offsets, with_ids=True)
        memory = self.encoded
        size = self.counts(number, memory)
        ends = np.cumsum(size)
        begin = np.where(number < 0, 0, memory.begin[np.maximum(number, 0)]) if len(memory.begin) else np.zeros(len(number), np.int64)
        at = np.repeat(begin - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)
        out = memory.ids[at] if len(memory.ids) else np.zeros(len(at), np.uint32)
        for k in np.flatnonzero(number < 0).tolist():
            out[ends[k] - 1] = -1 - number[k]
        return out, np.concatenate([[0], ends])[np.searchsorted(starts, offsets)]

    def total(self, text: bytes) -> int:
        """Tokens of a text without special strings."""
        data = np.frombuffer(text, np.uint8)
        starts = pieces(data, np.array([0, len(data)])).tolist()
        return int(self.piece_totals([text[a:b] for a, b in itertools.pairwise([*starts, len(data)])]).sum()) if text else 0


@functools.cache
def _library(path: str):  # noqa: ANN202 - the library is loaded in the worker
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.cache
def encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)
