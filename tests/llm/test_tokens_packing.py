import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tidemark.llm import bpe
from tidemark.llm.packing import draw_batches, pack
from tidemark.llm.tokens import PrefixCounts, count_tokens

SCHEMA = "doc_id long, text string, n_tokens string"
SIGNS = [" ", "  ", "\n", "\t", "'", "s", "'re", "'ll", "a", "B", "é", "ß", "1", "²", "!", "<|endoftext|>", "<|", "日", " ", "　", "😀", "ñ", "'S", "t", "m", "...", "'t", "\r\n", "'d", "the", "ing"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.default_path())


def texts(n, longest=14, seed=1):
    r = random.Random(seed)
    return ["".join(r.choice(SIGNS) for _ in range(r.randint(0, longest))) for _ in range(n)]


def odd(spark):
    rows = [(1, t, "x") for t in texts(40)] + [(None, "a", None), (2, None, None), (3, "", None), (4, "word " * 30000, None), (5, "x" * 3000, None), (5, "x" * 3000, None), (6, " " * 900, None)]
    return rows, spark.createDataFrame(rows, SCHEMA)


def test_prefix_counts_at_every_prefix(library):
    for t in texts(250):
        got = PrefixCounts(t).counts.tolist()
        assert got == [len(library.encode(t[:i], add_special_tokens=False).ids) for i in range(len(t) + 1)], t


def test_tokens_side_by_side(library):
    """``may_follow`` against the library, for pairs of random tokens and of repeated signs."""
    enc, r = bpe.encoder(bpe.default_path()), random.Random(5)
    words = ["a" * k for k in range(1, 9)] + ["th", "the", "in", "ing", "er", "ers", "re", "ab", "ra", "aba", "erer", "inging"]
    tokens = sorted({i for w in words for i in library.encode(w, add_special_tokens=False).ids} | {r.randrange(50_000) for _ in range(400)})
    text = {i: library.decode([i]) for i in tokens}
    tokens = [i for i in tokens if text[i].isalpha() and text[i].isascii()]
    pairs = [(a, b) for a in tokens[:60] for b in tokens[:60]] + [(r.choice(tokens), r.choice(tokens)) for _ in range(4000)]
    want = [library.encode(text[a] + text[b], add_special_tokens=False).ids == [a, b] for a, b in pairs]
    assert [enc.may_follow(a, b) for a, b in pairs] == want and 100 < sum(want) < len(pairs) - 100


def test_dp_totals_and_ids_over_whole_tables(library):
    """The dynamic programme's totals, and ids, equal the library's for whole texts of all tables' documents."""
    import pyarrow.parquet as pq

    from tidemark.llm.textvec import chunks

    enc = bpe.encoder(bpe.default_path())
    column = pq.read_table("/root/testdata/sf0.01/documents.parquet").column("text")
    for a, b, data, offsets in chunks(column, 1 << 20):
        want = [e.ids for e in library.encode_batch([t.as_py() or "" for t in column.slice(a, b - a)], add_special_tokens=False)]
        starts, _, number = enc.cut(data, offsets)
        total = np.concatenate([[0], np.cumsum(enc.counts(number))])
        assert np.diff(total[np.searchsorted(starts, offsets)]).tolist() == list(map(len, want))
        ids, first = enc.encode_batch(data, offsets)
        assert ids.tolist() == [i for w in want for i in w] and np.diff(first).tolist() == list(map(len, want))


def test_memory_of_pieces_is_bounded(library, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 5)
    monkeypatch.setattr(bpe, "PAIRS", 3)
    enc = bpe.PieceEncoder(bpe.default_path())
    for t in texts(60, seed=9):
        data = np.frombuffer(t.encode(), np.uint8)
        _, _, number = enc.cut(data, np.array([0, len(data)]))
        assert int(enc.counts(number).sum()) == len(library.encode(t, add_special_tokens=False).ids)
        assert enc.encode_batch(data, np.array([0, len(data)]))[0].tolist() == library.encode(t, add_special_tokens=False).ids
        assert len(enc.counted.hashes) <= 5 + 15 and len(enc.beside) <= 3


def test_long_unbroken_pieces(library):
    r = random.Random(3)
    for t in ("".join(r.choice("abcdefghijklmnop") for _ in range(100_000)), "a" * 30_000, "日" * 20_000, "=-" * 30_000):
        assert len(PrefixCounts(t)) == len(library.encode(t, add_special_tokens=False).ids)


def test_counts_match_library(spark, library):
    rows, df = odd(spark)
    limit = 20
    got = count_tokens(df, limit).collect()
    assert len(got) == len(rows)
    for row, (doc_id, text, _) in zip(got, rows, strict=True):
        text = text or ""
        n = len(library.encode(text, add_special_tokens=False).ids)
        assert (row.doc_id, row.n_bytes, row.n_tokens, row.over_limit) == (doc_id, len(text.encode()), n, n > limit)
        if len(text) < 5000:
            best = text[: PrefixCounts(text).longest(limit)]
            assert row.fit_bytes == len(best.encode()), text
    assert count_tokens(df.limit(0)).count() == 0


def test_pack_round_trip(spark, library):
    rows, df = odd(spark)
    got = pack(df, longest=64, with_ids=True).collect()
    assert len({r.sequence_id for r in got}) == len(got)
    flat, at = [], 0
    for doc_id, text, _ in rows:
        want = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        mine = []
        while len(mine) < len(want):
            r = got[at]
            assert (r.doc_id, r.start, r.doc_tokens, r.offset) == (doc_id, len(mine), len(want), 0)
            assert r.length == len(r.ids) == 1 << r.bucket and r.length <= 64
            assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
            mine += r.ids
            at += 1
        assert mine == want
        flat += mine
    assert at == len(got)
    assert pack(df.limit(0)).count() == 0


def test_batches_are_drawn_bucket_by_bucket(spark):
    _, df = odd(spark)
    packed = pack(df, longest=64, with_ids=True)
    rows = {r.sequence_id: r for r in packed.collect()}
    for tokens in (256, 1):
        got = draw_batches(packed, tokens).collect()
        assert len({b.batch_id for b in got}) == len(got)
        assert sorted(i for b in got for i in b.sequence_ids) == sorted(rows)
        for b in got:
            assert {rows[i].bucket for i in b.sequence_ids} == {b.bucket} and b.n_sequences == len(b.sequence_ids)
            assert len(b.ids) == b.n_sequences << b.bucket and (len(b.ids) <= tokens or b.n_sequences == 1)
            assert b.ids == [t for i in b.sequence_ids for t in rows[i].ids]
    assert sum(b.n_sequences << b.bucket == 256 for b in draw_batches(packed, 256).collect()) > 100
    assert draw_batches(pack(df.limit(0))).count() == 0 and "ids" not in draw_batches(pack(df)).columns
