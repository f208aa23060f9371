"""SimHash near-dedup with bit-sliced comparison.

A document's fingerprint has a bit set if more than half of its shingles' hashes have it.
Fingerprints are compared inside blocks that share a key.  Bits are stored vertically: plane j
holds bit j of 64 fingerprints in a word, so one XOR gives 64 differences; carry-save counters
of a few planes add them up, and a word is abandoned once all its fingerprints exceed the radius.

Two ways to the blocks:

* ``pigeonhole`` (exact): the 64 bits in four parts; fingerprints that differ in at most 2 bits
  agree in two of the parts at least, so each gets the six pairs of parts as keys (32 bits each).
* ``shingles``: bands of minimum shingle hashes, for radii that no pigeonhole serves.  With 16
  bands of 4, texts of similarity 0.8 meet in a block with probability 0.9998.

Equal fingerprints are one member, whatever their number.  A pigeonhole block of more than TILE members
is split by parts of the bits that its key leaves free; one that is still larger (or of shingles) into tiles and the pairs of tiles, so no task gets more than two tiles; from a block come
the edges of its local components (fewer than it has members), never its pairs.

With a percent, such a component only says which members to verify.  Equal sets of distinct shingles
are one member then, whose set is read once; all members of a component meet in its tiles, where
links are verified by the exact Jaccard similarity of the sets.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opstables.llm.common import fits_broadcast, keyed, slices, stored, utf8

TILE = 1024
#: Shingle hashes of a tile whose members are verified.
TILE_HASHES = 500_000
#: Comparisons of a fingerprint with a word of 64 that a worker holds at a time.
CELLS = 50_000
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


@dataclass(frozen=True)
class Sketching:
    """shingle: words in a shingle; bits: of a fingerprint (a multiple of 64); radius: differing bits that still link.

    percent: Jaccard similarity of the distinct shingles that a link must have, too; without it the radius decides, and repeats count.
    """

    shingle: int = 3
    bits: int = 64
    radius: int = 2
    blocks: str = "pigeonhole"
    bands: int = 16
    band_rows: int = 4
    percent: int | None = None

    def __post_init__(self) -> None:
        if self.blocks == "pigeonhole" and (self.bits != 64 or self.radius > 2):
            raise ValueError("pigeonhole blocks are for 64 bits and a radius of 2 at most")


#: Five words and a Jaccard similarity of 0.8: 39 of 256 bits differ there on average, with a deviation of 6.
NEAR_COPIES = Sketching(shingle=5, bits=256, radius=54, blocks="shingles", percent=80)


def shingle_hashes(text: bytes, k: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of k words, repeats included; of all words if there are fewer; none without words."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if n <= k:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = [0, *(ends[: n - k] + 1).tolist()]
    h = xxhash.xxh64_intdigest
    return np.fromiter([h(joined[a:b], 42) for a, b in zip(starts, ends[k - 1 :].tolist(), strict=True)], np.uint64, n - k + 1)


def _mixed(h: np.ndarray, i: int) -> np.ndarray:
    """Further hashes from a hash; the 0th is the hash itself."""
    if not i:
        return h
    h = h + np.uint64(i * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def fingerprint(h: np.ndarray, bits: int = 64) -> bytes:
    """Big-endian; all zero without hashes."""
    words = []
    for i in range(bits // 64):
        total = np.zeros(64, np.int64)
        for at in range(0, len(h), 255 * 64):  # sums of up to 255 bits fit a byte
            part = np.unpackbits(_mixed(h[at : at + 255 * 64], i).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            full = len(part) // 255 * 255
            total += part[:full].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64) + part[full:].sum(axis=0, dtype=np.uint8)
        words.append(np.packbits(2 * total > len(h), bitorder="little").tobytes()[::-1])
    return b"".join(words)


def _pigeonhole_keys(fp: bytes) -> list[int]:
    x = int.from_bytes(fp, "big")
    parts = [x >> s & 0xFFFF for s in (0, 16, 32, 48)]
    return [i << 32 | parts[a] << 16 | parts[b] for i, (a, b) in enumerate(itertools.combinations(range(4), 2))]


def _shingle_keys(h: np.ndarray, how: Sketching) -> list[int]:
    if not len(h):
        return [0]
    n = how.bands * how.band_rows
    mult = _mixed(np.arange(1, n + 1, dtype=np.uint64), 7) | np.uint64(1)
    least = np.full(n, _ALL)
    for at in range(0, len(h), 512):
        np.minimum(least, (h[at : at + 512, None] * mult[None, :]).min(axis=0), out=least)
    rows = np.ascontiguousarray(least.reshape(how.bands, how.band_rows))
    return [int.from_bytes(xxhash.xxh64_digest(r.tobytes(), i), "big", signed=True) for i, r in enumerate(rows)]


def _hashes(text: bytes, how: Sketching) -> np.ndarray:
    h = shingle_hashes(text, how.shingle)
    return h if how.percent is None else np.unique(h)


def _sketch(batches: Iterator[pa.RecordBatch], how: Sketching) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            fps, keys, same, size = [], [], [], []
            for text in utf8(part.column("text")):
                h = _hashes(text, how)
                fps.append(fingerprint(h, how.bits))
                keys.append(_pigeonhole_keys(fps[-1]) if how.blocks == "pigeonhole" else _shingle_keys(h, how))
                same.append(xxhash.xxh128_digest(h.tobytes()))
                size.append(len(h))
            found = {"doc_id": part.column("doc_id"), "text_key": part.column("text_key"), "fp": pa.array(fps, pa.binary()), "blocks": pa.array(keys, pa.list_(pa.int64()))}
            if how.percent is not None:
                found |= {"same": pa.array(same, pa.binary()), "size": pa.array(size, pa.int64())}
            yield pa.RecordBatch.from_pydict(found)


def links(bits: np.ndarray, end: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i < j) of rows of the same group at most radius bits apart, CELLS comparisons of a row with a word at a time.

    bits: a row of 0 and 1 for each fingerprint, groups one after another; end: of each row's group.
    """
    n, width = bits.shape
    lanes = np.zeros((width, -(-n // 64) * 64), np.uint8)
    lanes[:, :n] = bits.T
    planes = np.packbits(lanes, axis=1, bitorder="little").view(np.uint64)
    rows = np.arange(n)
    first, last = (rows + 1) // 64, (end - 1) // 64
    count = np.where(rows + 1 < end, last - first + 1, 0)
    total = np.cumsum(count)
    cuts = np.searchsorted(total, np.arange(CELLS, total[-1] + CELLS, CELLS)) + 1
    at = 0
    for cut in np.unique(np.minimum(cuts, n)):
        own, at = rows[at:cut], cut
        query = np.repeat(own, count[own])
        word = first[query] + np.arange(len(query)) - np.repeat(np.cumsum(count[own]) - count[own], count[own])
        low = np.maximum(query + 1, word * 64) - word * 64
        high = np.minimum(end[query], word * 64 + 64) - word * 64
        size = (high - low).astype(np.uint64)
        valid = np.where(size >= 64, _ALL, (np.uint64(1) << np.minimum(size, 63)) - np.uint64(1)) << np.minimum(low, 63).astype(np.uint64)
        yield from _compare(planes, bits, query, word, ~valid, radius)


def _compare(planes: np.ndarray, bits: np.ndarray, query: np.ndarray, word: np.ndarray, over: np.ndarray, radius: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """over: the lanes of each cell (a query and a word of 64 fingerprints) that don't count, or no longer."""
    counters = np.zeros((max(1, radius.bit_length()), len(query)), np.uint64)
    for j in range(len(planes)):
        carry = planes[j][word] ^ (-bits[:, j].astype(np.int64)).view(np.uint64)[query]
        for c in counters:  # carry-save: a half adder for each bit of the counters
            carry, up = c & carry, c ^ carry
            c[:] = up
        over |= carry
        if j % 8 == 7:
            over |= _exceeds(counters, radius)
            alive = over != _ALL
            if not alive.any():
                return []
            if alive.mean() < 0.7:
                counters, query, word, over = counters[:, alive], query[alive], word[alive], over[alive]
    over |= _exceeds(counters, radius)
    alive = over != _ALL
    hits = np.unpackbits((~over[alive]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    cell, lane = np.nonzero(hits)
    return [(query[alive][cell], word[alive][cell] * 64 + lane)]


def _exceeds(counters: np.ndarray, radius: int) -> np.ndarray:
    more, equal = np.zeros_like(counters[0]), np.full_like(counters[0], _ALL)
    for bit in range(len(counters) - 1, -1, -1):
        if radius >> bit & 1:
            equal &= counters[bit]
        else:
            more |= equal & counters[bit]
            equal &= ~counters[bit]
    return more


def merged(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Roots (each row's least connected row) after the links i-j are added; the links can then be dropped."""
    i, j = root[i], root[j]
    apart = i != j
    i, j = i[apart], j[apart]
    if len(i):
        pair = np.unique(np.maximum(i, j) * len(root) + np.minimum(i, j))
        i, j = pair // len(root), pair % len(root)
    while len(i):
        new = root.copy()
        np.minimum.at(new, i, new[j])
        new = new[new]
        root = new[root]
        i, j = root[i], root[j]
        apart = i != j
        i, j = np.maximum(i[apart], j[apart]), np.minimum(i[apart], j[apart])
    while (root[root] != root).any():
        root = root[root]
    return root


def _block_edges(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """(a, b): members a of a block, each with the smallest member b of its local component."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pa.compute.list_value_length(batch.column("reps")).to_numpy(zero_copy_only=False).astype(np.int64)
        begin = 0
        totals = np.cumsum(lengths)
        while begin < batch.num_rows:  # some 30,000 members at a time
            done = totals[begin - 1] if begin else 0
            stop = max(begin + 1, int(np.searchsorted(totals, done + 30_000)))
            part, size = batch.slice(begin, stop - begin), lengths[begin:stop]
            reps = part.column("reps").flatten().to_numpy().astype(np.int64)
            fps = np.frombuffer(b"".join(part.column("fps").flatten().to_pylist()), np.uint8).reshape(len(reps), -1)
            group = np.repeat(np.arange(len(size)), size)
            order = np.lexsort((reps, group))
            reps, bits = reps[order], np.unpackbits(fps[order], axis=1)
            ends = np.cumsum(size)
            root = np.arange(len(reps))
            for i, j in links(bits, ends[group], radius):
                root = merged(root, i, j)
            at = np.flatnonzero(reps[root] != reps)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(reps[at]), pa.array(reps[root[at]])], names=["a", "b"])
            begin = stop


def components(edges: DataFrame) -> DataFrame:
    """(a, root): for each node with an edge, other than a root, the smallest node of its connected component.

    edges: (a, b) of longs with a > b.  Rounds of large-star and small-star, each written to the
    shared folder; a hub's edges are pre-aggregated and joined back by skew-split joins.
    """
    now, sign = stored(edges.distinct(), "edges"), None
    while True:
        found = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if not found[0] or found == sign:
            return now.withColumnRenamed("b", "root")
        sign = found
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.unionByName(least.where("m < a").select("a", F.col("m").alias("b"))).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = stored(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "edges")


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets have that Jaccard similarity; two empty ones have."""
    if len(a) > len(b):
        a, b = b, a
    if 100 * len(a) < percent * len(b):
        return False
    if not len(b):
        return True
    common = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


#: The 16-bit parts, from the lowest, that a pigeonhole key does not fix: the key's number, as _pigeonhole_keys gives it, -> two parts.
_FREE = tuple(tuple(sorted(set(range(4)) - set(pair))) for pair in itertools.combinations(range(4), 2))


def _split_hot(keys: DataFrame, how: Sketching) -> DataFrame:
    """keys (key, rep, fp) with the blocks of more than TILE members split further, where that loses no link.

    Pigeonhole blocks only: the key fixes 32 of the 64 bits; of the other 32 in three parts (11, 11 and 10 bits), fingerprints
    within 2 bits agree in one at least.  So a member of a hot block goes to three of 5,120 smaller ones, not to as many
    pairs of tiles as there are tiles.
    """
    if how.blocks != "pigeonhole":
        return keys
    hot = stored(keys.groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > TILE).select("key", F.lit(True).alias("hot")), "hot-blocks")
    small = fits_broadcast(hot.count(), 16)
    digits = F.hex("fp")
    parts = [F.conv(F.substring(digits, at, 4), 16, 10).cast("long") for at in (13, 9, 5, 1)]  # from the lowest
    number = F.shiftright("key", 32)
    free = F.element_at(F.array(*(F.shiftleft(parts[b], 16).bitwiseOR(parts[a]) for a, b in _FREE)), (number + 1).cast("int"))
    # the free bits are part of the key, so only like parts meet; two blocks whose hashes clash are one: more comparisons, the same links
    cuts = ((0, 11), (11, 11), (22, 10))
    finer = F.array(*(F.xxhash64("key", F.lit(i), F.shiftright(free, at).bitwiseAND(F.lit(2**width - 1))) for i, (at, width) in enumerate(cuts)))
    marked = keys.join(F.broadcast(hot) if small else hot, "key", "left")
    return marked.select(F.explode(F.when(F.col("hot"), finer).otherwise(F.array("key"))).alias("key"), "rep", "fp")


def _sets(batches: Iterator[pa.RecordBatch], how: Sketching) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            sets = pa.array([_hashes(text, how).tobytes() for text in utf8(part.column("text"))], pa.binary())
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("group", "tiles", "rep", "fp")), sets], names=["group", "tiles", "rep", "fp", "shingles"])


def _verified_edges(batches: Iterator[pa.RecordBatch], how: Sketching) -> Iterator[pa.RecordBatch]:
    """(a, b) of each run of rows of a component and pair of tiles: members a, each with the smallest member b that verified links lead to."""
    rows = (r for batch in batches for part in slices(batch, "shingles") for r in zip(*(part.column(c).to_pylist() for c in ("group", "pair", "rep", "fp", "shingles")), strict=True))
    for _, run in itertools.groupby(rows, key=lambda r: r[:2]):
        members = sorted(((rep, fp, np.frombuffer(x, np.uint64)) for _, _, rep, fp, x in run), key=lambda m: m[0])
        n = len(members)
        if n < 2:
            continue
        bits = np.unpackbits(np.frombuffer(b"".join(m[1] for m in members), np.uint8).reshape(n, -1), axis=1)
        root = np.arange(n)
        for i, j in links(bits, np.full(n, n), how.radius):
            for at in range(0, len(i), 4096):
                a, b = i[at : at + 4096], j[at : at + 4096]
                apart = root[a] != root[b]
                for x, y in zip(a[apart].tolist(), b[apart].tolist(), strict=True):
                    low, high = sorted((root[x], root[y]))
                    if low != high and similar(members[x][2], members[y][2], how.percent):
                        root[root == high] = low
        reps = np.array([m[0] for m in members], np.int64)
        at = np.flatnonzero(reps[root] != reps)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(reps[at]), pa.array(reps[root[at]])], names=["a", "b"])


def _pairs_of_tiles(own: Column, tiles: Column) -> Column:
    """The pairs of tiles that a member of the tile `own` belongs to."""
    others = F.filter(F.sequence(F.lit(0), tiles - 1), lambda t: (t != own) | (tiles == 1))  # a pair of tiles compares within each, too
    return F.transform(others, lambda t: F.least(t, own) * tiles + F.greatest(t, own))


def _verified_roots(docs: DataFrame, named: DataFrame, how: Sketching) -> DataFrame:
    """(a, root) by verified links; named: members with size and the group that their candidate links lead to."""
    tiles = F.greatest(F.ceil(F.count("*") / TILE), F.ceil(F.sum("size") / TILE_HASHES)).cast("int")
    sizes = named.groupBy("group").agg(F.count("*").alias("members"), tiles.alias("tiles")).where("members > 1")
    wanted = stored(named.join(sizes, "group").select("rep", F.col("first.doc_id").alias("rep_id"), F.col("first.text_key").alias("rep_key"), "fp", "group", "tiles"), "candidates")
    small = fits_broadcast(wanted.count(), 60 + how.bits // 8)
    rows = keyed(docs)
    # repeated rows bring the same set again, which changes nothing
    found = rows.join(F.broadcast(wanted) if small else wanted, (rows["doc_id"] == wanted["rep_id"]) & (rows["text_key"] == wanted["rep_key"])).select("group", "tiles", "rep", "fp", "text")
    sets = found.mapInArrow(lambda it: _sets(it, how), "group long, tiles int, rep long, fp binary, shingles binary")
    own = F.pmod(F.xxhash64("rep"), "tiles").cast("int")
    tiled = sets.select("group", F.explode(_pairs_of_tiles(own, F.col("tiles"))).alias("pair"), "rep", "fp", "shingles")
    runs = tiled.repartition("group", "pair").sortWithinPartitions("group", "pair")
    return components(runs.mapInArrow(lambda it: _verified_edges(it, how), "a long, b long"))


def near_groups(docs: DataFrame, how: Sketching = Sketching()) -> DataFrame:
    """doc_id, text_key, fp (binary, big-endian), component_id, is_first: one row for each row of docs.

    Words are runs of other characters than white space, A-Z lower-cased.  A text without words (null,
    too) has the fingerprint zero and is linked like any other.  component_id is the smallest doc_id
    reachable by links; is_first marks the row with that doc_id and, of several texts of it, the least
    text_key (and rows that repeat it).  Both are null for rows without doc_id.  Texts that share a
    doc_id are members of their own: only links connect them.
    """
    verified = how.percent is not None
    kind = ["fp", "same", "size"] if verified else ["fp"]
    spread = keyed(docs).mapInArrow(lambda it: _sketch(it, how), "doc_id long, text_key long, fp binary, blocks array<long>" + ", same binary, size long" * verified)
    sketches = stored(spread, "sketches")
    equal = sketches.where("doc_id IS NOT NULL").groupBy(*kind, "blocks").agg(F.min(F.struct("doc_id", "text_key")).alias("first"), F.count("*").alias("n"))
    gathered = equal.groupBy(*kind).agg(F.min("first").alias("first"), F.sum("n").alias("n"), F.array_distinct(F.flatten(F.collect_list("blocks"))).alias("blocks"))
    # the numbers are stored with the members, so they are given once
    members = stored(gathered.withColumn("rep", F.monotonically_increasing_id()), "members")
    keys = _split_hot(members.select(F.explode("blocks").alias("key"), "rep", "fp"), how)
    sizes = keys.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    tiles = F.ceil(F.col("size") / TILE).cast("int")
    own = F.pmod(F.xxhash64("rep"), tiles).cast("int")
    tiled = keys.join(sizes, "key").select("key", F.explode(_pairs_of_tiles(own, tiles)).alias("pair"), "rep", "fp")
    blocks = tiled.groupBy("key", "pair").agg(F.collect_list("rep").alias("reps"), F.collect_list("fp").alias("fps"))
    roots = components(blocks.select("reps", "fps").mapInArrow(lambda it: _block_edges(it, how.radius), "a long, b long"))
    if verified:
        roots = _verified_roots(docs, members.join(roots, members["rep"] == roots["a"], "left").select(*members.columns, F.coalesce("root", "rep").alias("group")), how)
    by = "same" if verified else "fp"
    # a member that is alone needs no row here
    classes = stored(_firsts(members, roots).where("n > 1 OR first <> own").select(by, "first"), "classes")
    small = fits_broadcast(classes.count(), 60 + how.bits // 8)
    out = sketches.select("doc_id", "text_key", *dict.fromkeys(["fp", by])).join(F.broadcast(classes) if small else classes, by, "left")
    known = F.col("doc_id").isNotNull()
    least = F.coalesce("first", F.struct("doc_id", "text_key"))
    first = (F.col("doc_id") == least["doc_id"]) & (F.col("text_key") == least["text_key"])
    return out.select("doc_id", "text_key", "fp", F.when(known, least["doc_id"]).alias("component_id"), F.when(known, first).alias("is_first"))


def _firsts(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Members with the least (doc_id, text_key) of their component as `first`, and their own as `own`."""
    nodes = roots.unionByName(roots.select(F.col("root").alias("a"), "root").distinct())
    least = members.select("rep", "first").join(nodes, F.col("rep") == F.col("a")).groupBy("root").agg(F.min("first").alias("least"))
    known = nodes.join(least, "root").select("a", "least")
    return members.join(known, members["rep"] == known["a"], "left").select(*(members[c] for c in members.columns if c != "first"), F.coalesce("least", "first").alias("first"), members["first"].alias("own"))
