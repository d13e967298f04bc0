"""Near-duplicate documents by SimHash and random bit sampling.

Each document's set of five-word shingles gives a SimHash of ``BITS`` bits.
Documents with equal sets are one class from the start, so copies are neither
compared nor expanded.  Several tables group the classes by sampled bits;
within a group, pairs at a small Hamming distance are linked.  Groups are read
in an order refined by additional bits and cut into capped blocks, a large group
also into several tasks; what lies in different blocks of one group is compared
afterwards, but only across families that aren't linked yet, in tasks of two
blocks.  More bits are sampled of a larger corpus.

Sampling misses some pairs.  So classes whose prefixes share enough shingles
are linked too: in one order of all shingles, the rarer first, sets as similar
as asked for always share one of their first ``n - ceil(similarity n) + 1``.
Linked classes make families; within a family every pair is verified by the
exact Jaccard similarity of the shingle sets, unless both are already joined.

Rows: every input row gives one row.  A null or empty text, or one of white
space only, has no shingles, links with nothing and is kept.  Rows with equal
texts are in one class, also when their ids are equal.  Rows with a null id
take part, but are kept only where no row of the class has an id.  One id and
text of each class is kept, so near copies that share an id are reduced too.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.graph import components, join_classes
from tidemark.llm.runtime import among, cut_lineage, prepare
from tidemark.llm.textvec import U64, chunks, mix, shingles, span_hashes, words

BITS = 256
WORDS64 = BITS // 64
WIDTH = 5
SIG = [f"s{k}" for k in range(WORDS64)]
#: Row i has the bits of byte i, one to a byte.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64).ravel()
_STEP = 16384
#: One of so many classes is looked at for hot groups, which are split into so many parts.
SAMPLED, PARTS = 64, 64


def unique_shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, and where each text's begin."""
    starts, ends, first = words(data, offsets)
    found, at = shingles(span_hashes(data, starts, ends), first, WIDTH)
    parts = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        part = np.sort(found[a:b])
        parts.append(part[np.append(True, part[1:] != part[:-1])] if b > a else part)
    lengths = np.array([len(p) for p in parts], np.int64)
    return (np.concatenate(parts) if parts else found), np.concatenate([[0], np.cumsum(lengths)])


def signatures(found: np.ndarray, at: np.ndarray) -> np.ndarray:
    """SimHash of each set: the signs of sums over its members, as ``WORDS64`` words."""
    n = len(at) - 1
    total = np.zeros((n, BITS), np.int32)
    salts = U64(0xD1B54A32D192ED03) * np.arange(1, WORDS64 + 1, dtype=np.uint64)
    # up to 255 members fit into eight one-byte counters of a word
    cuts = np.unique(np.concatenate([at, *[np.arange(a, b, 255) for a, b in zip(at[:-1], at[1:], strict=True) if b - a > 255]])) if len(found) else np.zeros(1, np.int64)
    cuts = cuts[cuts < len(found)]
    owner = np.searchsorted(at, cuts, "right") - 1
    k = 0
    while k < len(cuts):
        to = max(k + 1, int(np.searchsorted(cuts, cuts[k] + _STEP)))
        a, b = cuts[k], cuts[to] if to < len(cuts) else len(found)
        bits = mix(found[a:b, None] ^ salts[None, :]).view(np.uint8)
        sums = np.add.reduceat(_SPREAD[bits], cuts[k:to] - a, axis=0)
        np.add.at(total, owner[k:to], np.ascontiguousarray(sums).view(np.uint8).astype(np.int32))
        k = to
    size = np.diff(at).astype(np.int32)[:, None]
    return np.packbits(2 * total > size, axis=1, bitorder="little").view(np.uint64)


def common_shingles(docs: DataFrame, sample: int = 16_000, share: int = 16, least: int = 3, most: int = 1_000_000) -> tuple[np.ndarray, np.ndarray]:
    """The commonest shingles of about ``sample`` texts, or of one text of ``share`` if those are more, sorted, and in how many each is.

    They only set an order, so what the sample misses costs time, no pair.  A
    shingle that it misses is in a few dozen texts, whatever their number; in a
    fixed sample it would be in ever more, and their pairs grow with the square.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in chunks(batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(unique_shingles(data, offsets)[0].view(np.int64))], ["shingle"])

    share = max(1, min(share, docs.count() // sample))
    texts = docs.filter(F.pmod(F.xxhash64("text"), F.lit(share)) == 0).select(F.col("text").cast("string"))
    found = texts.mapInArrow(run, "shingle long").groupBy("shingle").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    rows = cut_lineage(found.orderBy(F.desc("n"), "shingle").limit(most)).toArrow()
    shingle, n = rows.column("shingle").to_numpy().view(U64), rows.column("n").to_numpy()
    order = np.argsort(shingle)
    return shingle[order], n[order]


def prefixes(found: np.ndarray, at: np.ndarray, common: tuple[np.ndarray, np.ndarray], similarity: float) -> pa.Array:
    """Of each sorted set, the members that come first (by number in ``common``, then by hash)."""
    shingle, often = common
    rank = np.zeros(len(found), np.int64)
    if len(shingle):
        k = np.minimum(np.searchsorted(shingle, found), len(shingle) - 1)
        rank = np.where(shingle[k] == found, often[k], 0)
    size = np.diff(at)
    length = np.where(size > 0, size - np.ceil(similarity * size - 1e-9).astype(np.int64) + 1, 0)
    parts = []
    for a, b, m in zip(at[:-1].tolist(), at[1:].tolist(), length.tolist(), strict=True):
        part = found[a:b]
        parts.append((part[np.lexsort((part, rank[a:b]))] if rank[a:b].any() else part)[:m])
    values = np.concatenate(parts) if parts else found[:0]
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length)]).astype(np.int32)), pa.array(values.view(np.int64)))


def sketch(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """doc_id, text_key, node (hash of the shingle set), n shingles, the SimHash and the prefix; node is null without shingles."""
    prepare(docs.sparkSession)
    common = common_shingles(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in chunks(batch.column(2)):
                found, at = unique_shingles(data, offsets)
                sig = signatures(found, at).view(np.int64)
                size = np.diff(at)
                node = [int.from_bytes(hashlib.blake2b(found[i:j].tobytes(), digest_size=8).digest(), "little", signed=True) if j > i else None for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(node, pa.int64()), pa.array(size), *[pa.array(np.ascontiguousarray(sig[:, k])) for k in range(WORDS64)], prefixes(found, at, common, similarity)], ["doc_id", "text_key", "node", "n", *SIG, "prefix"])

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_key"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, text_key long, node long, n long, " + ", ".join(f"{c} long" for c in SIG) + ", prefix array<long>")


class _Forest:
    """Union-find over row numbers."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        a, b = self.root(i), self.root(j)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def _close(sig: np.ndarray, distance: int, role: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs i < j of rows within the distance, with it; ``role``: only pairs of different roles."""
    left, right, far = [], [], []
    for i in range(len(sig) - 1):
        d = np.bitwise_count(sig[i + 1 :] ^ sig[i]).sum(axis=1)
        ok = d <= distance
        if role is not None:
            ok &= role[i + 1 :] != role[i]
        if (j := np.flatnonzero(ok)).size:
            left.append(np.full(len(j), i))
            right.append(j + i + 1)
            far.append(d[j])
    if not left:
        none = np.zeros(0, np.int64)
        return none, none, none
    return np.concatenate(left), np.concatenate(right), np.concatenate(far)


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[np.ndarray]]:
    """The columns of whole groups: batches of rows, cut only where the first ``keys`` columns change."""
    rest: list[list[np.ndarray]] = []
    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        n = len(columns[0])
        if n == 0:
            continue
        same = np.ones(n - 1, bool)
        for c in columns[:keys]:
            same &= c[1:] == c[:-1]
        change = np.flatnonzero(~same) + 1
        if rest and any(rest[-1][k][-1] != columns[k][0] for k in range(keys)):
            yield [np.concatenate(c) for c in zip(*rest, strict=True)]
            rest = []
        if len(change):
            cut = change[-1]
            rest.append([c[:cut] for c in columns])
            yield [np.concatenate(c) for c in zip(*rest, strict=True)]
            rest = [[c[cut:] for c in columns]]
        else:
            rest.append(columns)
    if rest:
        yield [np.concatenate(c) for c in zip(*rest, strict=True)]


def _bounds(columns: list[np.ndarray], keys: int) -> np.ndarray:
    n = len(columns[0])
    same = np.ones(n - 1, bool)
    for c in columns[:keys]:
        same &= c[1:] == c[:-1]
    return np.concatenate([[0], np.flatnonzero(~same) + 1, [n]])


def _edges(node: np.ndarray, sig: np.ndarray, distance: int, role: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the pairs within the distance."""
    i, j, _ = _close(sig, distance, role)
    forest = _Forest(len(node))
    take = [k for k, (a, b) in enumerate(zip(i.tolist(), j.tolist(), strict=True)) if forest.join(a, b)]
    return node[i[take]], node[j[take]]


def _small(columns: list[np.ndarray], bounds: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of many small groups at once: rows are compared with the k-th next of their group."""
    size = np.diff(bounds)
    left = np.repeat(bounds[1:], size) - np.arange(bounds[0], bounds[-1]) - 1
    rows = np.arange(bounds[0], bounds[-1])
    node, sig = columns[1], columns[2]
    a, b = [], []
    k = 1
    rows, left = rows[left >= 1], left[left >= 1]
    while len(rows):
        near = np.bitwise_count(sig[rows] ^ sig[rows + k]).sum(axis=1) <= distance
        a.append(node[rows[near]])
        b.append(node[rows[near] + k])
        k += 1
        rows, left = rows[left >= k], left[left >= k]
    return (np.concatenate(a), np.concatenate(b)) if a else (node[:0], node[:0])


def _table_keys(sig: np.ndarray, tables: int, bits: int, more: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """For each table, the key of sampled bits and that of the additional bits."""
    rng = np.random.default_rng(seed)
    flat = np.unpackbits(sig.view(np.uint8), axis=1, bitorder="little")
    keys = np.empty((tables, len(sig)), np.int64)
    extra = np.empty((tables, len(sig)), np.int64)
    for t in range(tables):
        chosen = rng.permutation(BITS)[: bits + more]
        keys[t] = (flat[:, chosen[:bits]].astype(np.float64) @ (2.0 ** np.arange(bits))).astype(np.int64) + (t << 48)
        extra[t] = (flat[:, chosen[bits:]].astype(np.float64) @ (2.0 ** np.arange(more))).astype(np.int64)
    return keys, extra


def _signs(batch: pa.RecordBatch, at: int) -> np.ndarray:
    return np.stack([batch.column(at + k).to_numpy() for k in range(WORDS64)], axis=1).view(np.uint64)


def _candidates(nodes: DataFrame, distance: int, tables: int, bits: int, cap: int, seed: int) -> DataFrame:
    """Edges (a, b) that connect all classes which share a group and lie within the distance."""
    more = 16

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 2000):
                part = batch.slice(low, 2000)
                sig = np.ascontiguousarray(_signs(part, 1))
                keys, extra = _table_keys(sig, tables, bits, more, seed)
                n = len(sig)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(extra.ravel()), pa.array(np.tile(part.column(0).to_numpy(), tables)), *[pa.array(np.tile(np.ascontiguousarray(sig[:, k]).view(np.int64), tables)) for k in range(WORDS64)]], names) if n else part

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted by key and additional bits; a block is at most ``cap`` rows of a group.  Rows of
        groups of several blocks come out again (block >= 0), for the pairs across blocks, as do
        those of the parts of a group that is split.  The part's number is in the block's."""

        def blocks() -> Iterator[tuple[np.ndarray, ...]]:
            held, key, block = [], None, 0
            for batch in batches:
                k, node, sig, part = batch.column(0).to_numpy(), batch.column(2).to_numpy(), _signs(batch, 3), batch.column(3 + WORDS64).to_numpy()
                if not len(k):
                    continue
                bounds = _bounds([k, part], 2)
                size = np.diff(bounds)
                # groups within the batch that are small go together, all but the last, which may go on
                for g in range(len(size)):
                    a, b = bounds[g], bounds[g + 1]
                    if key != (k[a], part[a]):
                        if key is not None:
                            yield key[0], block, held
                        held, block = [], int(part[a]) << 32
                    key = k[a], part[a]
                    while a < b:
                        room = cap - sum(len(h[0]) for h in held)
                        held.append((node[a : min(b, a + room)], sig[a : min(b, a + room)]))
                        a = min(b, a + room)
                        if a < b:
                            yield key[0], block, held
                            held, block = [], block + 1
            if held:
                yield key[0], block, held

        yield from _link_blocks(blocks(), distance)

    names = ["key", "extra", "node", *SIG]
    signs = ", ".join(f"{c} long" for c in SIG)
    def keyed(rows: DataFrame) -> DataFrame:
        return rows.select("node", *SIG).mapInArrow(spread, f"key long, extra long, node long, {signs}")

    # groups of more than a thousandth of all classes, at most a thousand a table, are split at random
    sample, least = nodes.filter(F.pmod(F.xxhash64("node"), F.lit(SAMPLED)) == 0), max(16 * cap, nodes.count() // 1000)
    hot = keyed(sample).groupBy("key").agg((SAMPLED * F.count("*")).alias("n")).filter(F.col("n") > least).select("key", F.lit(True).alias("hot"))
    part = F.when(F.col("hot"), 1 + F.pmod(F.xxhash64("node", "key"), F.lit(PARTS))).otherwise(F.lit(0)).cast("long")
    spread_rows = keyed(nodes).join(F.broadcast(hot), "key", "left").withColumn("part", part).drop("hot")
    sorted_rows = spread_rows.repartition("key", "part").sortWithinPartitions("key", "part", "extra", "node")
    out = cut_lineage(sorted_rows.mapInArrow(link, f"a long, b long, block long, key long, {signs}"))
    edges = out.filter("block < 0").select("a", "b").distinct()
    over = out.filter("block >= 0").select("key", "block", F.col("a").alias("node"), *SIG)
    if over.isEmpty():
        return edges
    return edges.unionByName(_across_blocks(over, components(edges), distance, cap))


def _link_blocks(blocks: Iterator[tuple], distance: int) -> Iterator[pa.RecordBatch]:
    a_out, b_out, waiting = [], [], []

    def flush() -> pa.RecordBatch:
        a = np.concatenate(a_out) if a_out else np.zeros(0, np.int64)
        b = np.concatenate(b_out) if b_out else np.zeros(0, np.int64)
        none = pa.nulls(len(a), pa.int64())
        a_out.clear()
        b_out.clear()
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.full(len(a), -1, np.int64)), *[none] * (1 + WORDS64)], ["a", "b", "block", "key", *SIG])

    def small() -> None:
        if waiting:
            size = np.array([len(w[0]) for w in waiting])
            a, b = _small([size, np.concatenate([w[0] for w in waiting]), np.concatenate([w[1] for w in waiting])], np.concatenate([[0], np.cumsum(size)]), distance)
            a_out.append(a)
            b_out.append(b)
            waiting.clear()

    many, last = 0, None
    for key, block, held in blocks:
        node = np.concatenate([h[0] for h in held])
        sig = np.concatenate([h[1] for h in held])
        if len(node) <= 64:
            if len(node) > 1:
                waiting.append((node, sig))
                many += len(node)
                if many > 50_000:
                    small()
                    many = 0
        else:
            a, b = _edges(node, sig, distance)
            a_out.append(a)
            b_out.append(b)
        if block == 1 and last is not None:
            yield _over(*last)
        if block >= 1:
            yield _over(key, block, node, sig)
        last = (key, block, node, sig) if block == 0 else None
        if sum(map(len, a_out)) > 100_000:
            yield flush()
    small()
    yield flush()


def _over(key: int, block: int, node: np.ndarray, sig: np.ndarray) -> pa.RecordBatch:
    n = len(node)
    return pa.RecordBatch.from_arrays([pa.array(node), pa.nulls(n, pa.int64()), pa.array(np.full(n, block, np.int64)), pa.array(np.full(n, key, np.int64)), *[pa.array(np.ascontiguousarray(sig[:, k]).view(np.int64)) for k in range(WORDS64)]], ["a", "b", "block", "key", *SIG])


def _across_blocks(over: DataFrame, found: DataFrame, distance: int, cap: int) -> DataFrame:
    """Links between different blocks of one group.

    Only pairs of different components matter.  The group's largest component
    isn't compared with itself: the other rows are, in chunks, with each block.
    """
    # numbered by part and place there: from 0 on within each key
    placed = over.select("key", "block").distinct().withColumn("number", F.row_number().over(Window.partitionBy("key").orderBy("block")) - 1)
    over = over.join(placed, ["key", "block"]).withColumn("block", F.col("number")).drop("number")
    rows = cut_lineage(over.join(found, "node", "left").withColumn("component", F.coalesce("component", "node")))
    sizes = rows.groupBy("key", "component").agg(F.count("*").alias("n"), F.max("block").alias("block"))
    of_key = sizes.groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("most"), (F.max("block") + 1).alias("n_blocks"), F.sum("n").alias("n"), F.max("n").alias("n_most"))
    of_key = of_key.withColumn("n_chunks", F.ceil((F.col("n") - F.col("n_most")) / cap).cast("int")).drop("n", "n_most").filter("n_chunks > 0")
    rows = rows.join(of_key, "key")
    one = rows.select("key", "block", F.explode(F.sequence(F.lit(0), F.col("n_chunks") - 1)).alias("chunk"), F.lit(0).alias("role"), "node", "component", *SIG)
    chunk = F.pmod(F.xxhash64("node"), F.col("n_chunks")).cast("int")
    other = rows.filter("component <> most").select("key", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("block"), chunk.alias("chunk"), F.lit(1).alias("role"), "node", "component", *SIG)

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in _groups(batches, 3):
            bounds = _bounds(columns, 3)
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                sig = np.stack([columns[6 + k][a:b] for k in range(WORDS64)], axis=1).view(np.uint64)
                left, right = _edges(columns[4][a:b], sig, distance, columns[3][a:b])
                yield pa.RecordBatch.from_arrays([pa.array(left), pa.array(right)], ["a", "b"])

    tasks = one.unionByName(other).repartition("key", "block", "chunk").sortWithinPartitions("key", "block", "chunk", "role", "node")
    return tasks.mapInArrow(link, "a long, b long").distinct()


def _prefix_edges(rows: DataFrame, families: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of classes of different families that may be similar enough: by their sizes, and
    by how many shingles their prefixes share, as at most the rest of one set can be common besides."""
    share = similarity / (1 + similarity)

    def least(n: np.ndarray, m: np.ndarray) -> np.ndarray:
        rest = np.ceil(similarity * np.maximum(n, m) - 1e-9) - 1
        return np.ceil(share * (n + m) - 1e-9 - rest).astype(np.int64)

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, node, n, family in _groups(batches, 1):
            new = np.append(True, (key[1:] != key[:-1]) | (node[1:] != node[:-1]))
            key, node, n, family = key[new], node[new], n[new], family[new]

            def pairs(i: np.ndarray, j: np.ndarray, node=node, n=n, family=family) -> pa.RecordBatch:
                ok = (np.minimum(n[i], n[j]) >= similarity * np.maximum(n[i], n[j]) - 1e-9) & (family[i] != family[j])
                i, j = np.broadcast_to(i, ok.shape)[ok], j[ok]
                return pa.RecordBatch.from_arrays([pa.array(np.minimum(node[i], node[j])), pa.array(np.maximum(node[i], node[j])), pa.array(least(n[i], n[j]))], ["a", "b", "least"])

            bounds = _bounds([key], 1)
            size = np.diff(bounds)
            left = np.repeat(bounds[1:], size) - np.arange(len(key)) - 1
            i, left = (x[np.repeat(size <= 64, size)] for x in (np.arange(len(key)), left))
            k = 1
            while len(i := i[left >= k]):
                left = left[left >= k]
                yield pairs(i, i + k)
                k += 1
            for g in np.flatnonzero(size > 64).tolist():
                own = family[bounds[g] : bounds[g + 1]]
                if (own == own[0]).all():  # copies of one family need no more links
                    continue
                for x in range(bounds[g], bounds[g + 1] - 1):
                    yield pairs(np.array([x]), np.arange(x + 1, bounds[g + 1]))

    each = rows.filter("node is not null").select("node", "n", "prefix").join(families, "node", "left")
    each = each.select(F.explode("prefix").alias("key"), "node", "n", F.coalesce("component", "node").alias("family"))
    found = each.repartition("key").sortWithinPartitions("key", "node").mapInArrow(link, "a long, b long, least long")
    return found.groupBy("a", "b").agg(F.count("*").alias("n"), F.max("least").alias("least")).filter("n >= least").select("a", "b")


def _join_rest(sets: list[np.ndarray], role: np.ndarray | None, similarity: float, forest: _Forest) -> list[tuple[int, int]]:
    """Join all similar sets that aren't joined yet, from the sizes of their intersections; the new links.

    One of such two sets isn't in the largest part, so that part's sets needn't be looked up.
    """
    parts = np.array([forest.root(k) for k in range(len(sets))])
    found, n_found = np.unique(parts, return_counts=True)
    if len(found) == 1:
        return []
    size = np.array([len(x) for x in sets])
    order = np.argsort(members := np.concatenate(sets), kind="stable")
    members, owner = members[order], np.repeat(np.arange(len(sets)), size)[order]
    links = []
    for i in np.flatnonzero(parts != found[np.argmax(n_found)]).tolist():
        fits = (parts != parts[i]) & (np.minimum(size, size[i]) >= similarity * np.maximum(size, size[i]) - 1e-9)
        if role is not None:
            fits &= role != role[i]
        if not fits.any():
            continue
        low = np.searchsorted(members, sets[i])
        many = np.searchsorted(members, sets[i], "right") - low
        at = np.repeat(low - np.cumsum(many) + many, many) + np.arange(many.sum())
        both = np.bincount(owner[at], minlength=len(sets))
        for j in np.flatnonzero(fits & (both >= similarity * (size + size[i] - both) - 1e-9)).tolist():
            if forest.join(i, j):
                links.append((i, j))
    return links


def _verify(texts: DataFrame, families: DataFrame, distance: int, similarity: float, block: int) -> DataFrame:
    """Edges between classes of a family whose shingle sets are similar enough.

    ``families``: node, family, block and n_blocks.  A family of several blocks
    is compared in tasks of two blocks.
    """
    part = F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("other")
    rows = texts.select("node", "text", "family", "block", part, *SIG)
    rows = rows.select("family", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "node", *SIG, "text")
    rows = rows.repartition("family", "low", "high").sortWithinPartitions("family", "low", "high", "node")

    def flush(key: tuple, held: list) -> pa.RecordBatch:
        seen: dict[int, int] = {}
        for k, h in enumerate(held):
            seen.setdefault(h[0], k)
        held = [held[k] for k in seen.values()]
        node = np.array([h[0] for h in held], np.int64)
        sig = np.stack([h[1] for h in held])
        role = np.array([h[2] for h in held]) if key[1] != key[2] else None
        i, j, far = _close(sig, distance, role)
        forest, a, b = _Forest(len(held)), [], []
        for k in np.argsort(far, kind="stable").tolist():
            x, y = int(i[k]), int(j[k])
            if forest.root(x) == forest.root(y):
                continue
            one, two = held[x][3], held[y][3]
            low, high = sorted((len(one), len(two)))
            if low < similarity * high - 1e-9:
                continue
            both = len(np.intersect1d(one, two, assume_unique=True))
            if both >= similarity * (low + high - both) - 1e-9:
                forest.join(x, y)
                a.append(node[x])
                b.append(node[y])
        for x, y in _join_rest([h[3] for h in held], role, similarity, forest):
            a.append(node[x])
            b.append(node[y])
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            family, low, high, own, node = (batch.column(k).to_numpy() for k in range(5))
            sig = _signs(batch, 5)
            for a, b, data, offsets in chunks(batch.column(5 + WORDS64)):
                found, at = unique_shingles(data, offsets)
                for r in range(a, b):
                    here = (family[r], low[r], high[r])
                    if here != key:
                        if len(held) > 1:
                            yield flush(key, held)
                        key, held = here, []
                    held.append((int(node[r]), sig[r], own[r], found[at[r - a] : at[r - a + 1]].copy()))
        if len(held) > 1:
            yield flush(key, held)

    return rows.mapInArrow(run, "a long, b long")


def sampled_bits(classes: int) -> int:
    return 14 + max(0, (max(classes, 1) - 1) // 10_000_000).bit_length()


def near_duplicates(docs: DataFrame, similarity: float = 0.8, distance: int = 56, tables: int = 40, bits: int | None = None, cap: int = 4096, block: int = 1024, seed: int = 7) -> DataFrame:
    """doc_id, text_key (xxhash64 of the text), class_id (smallest id of the class) and kept, for every row.

    ``tables`` groupings by ``bits`` sampled bits; ``distance``: candidates'
    largest Hamming distance of ``BITS`` bits (at a similarity of 0.8 about 39,
    with a deviation of 6); ``cap``: rows of a group compared at once;
    ``block``: classes of a family compared in one task.  ``bits`` are 14, and
    one more for each doubling beyond ten million classes, so that groups don't
    grow with the corpus.  These numbers set the time that is taken; which pairs
    are found doesn't depend on them.
    """
    rows = cut_lineage(sketch(docs, similarity))
    nodes = rows.filter("node is not null").groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")).alias("at"), F.first("n").alias("n"), F.count("*").alias("times"), *[F.first(c).alias(c) for c in SIG])
    nodes = cut_lineage(nodes)
    bits = bits or sampled_bits(nodes.count())
    sampled = components(_candidates(nodes, distance, tables, bits, cap, seed))
    exact = _prefix_edges(rows, sampled, similarity)
    found = components(sampled.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(exact))
    size = F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("n") / 2_000_000)).cast("int")
    family = found.join(nodes, "node").groupBy("component").agg(size.alias("n_blocks"))
    family = found.join(family, "component").select("node", F.col("component").alias("family"), "n_blocks", F.pmod(F.xxhash64("node"), F.col("n_blocks")).cast("int").alias("block"))
    family = cut_lineage(family.join(nodes, "node").select("node", "family", "n_blocks", "block", "at.doc_id", "at.text_key", *SIG))
    text = docs.select(F.col("doc_id").cast("long").alias("d"), F.xxhash64("text").alias("k"), F.col("text").cast("string").alias("text"))
    # only classes that have a family are compared, so the other texts aren't shuffled
    texts = among(text, F.col("k"), family, "text_key").join(family, F.expr("k = text_key and d <=> doc_id"))
    linked = components(_verify(texts, family, distance, similarity, block))
    of_node = nodes.select("node", "at", "times").join(linked, "node", "left").withColumn("component", F.coalesce("component", "node"))
    class_of = of_node.groupBy("component").agg(F.min("at").alias("first"))
    of_node = cut_lineage(of_node.join(class_of, "component").select("node", "first", "times"))
    kept = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_key") == F.col("first.text_key"))
    out = join_classes(rows.select("doc_id", "text_key", "node"), of_node, "node")
    alone = F.col("node").isNull()
    return out.select("doc_id", "text_key", F.when(alone, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("class_id"), (alone | kept).alias("kept"))
