"""Byte-level BPE by replaying merges over the vocabulary of a whole corpus.

The words of all texts that are not tokens themselves are counted over the corpus.  The most frequent
ones (a bounded number of bounded words) are replayed together, partition by partition of the
vocabulary: an inverted index leads from a band of neighbouring ranks to the positions of the token pairs
that make them; bands are taken in rising order, all words that hold such pairs merge those of their own least rank
in one step, and only the neighbours of merged positions are looked up anew.  Each word's merges come in the order in which
they would come if it were encoded alone: at any step its least rank, leftmost first.  All positions
of a rank in a word are merged in one step, up to the first whose merge makes a pair of lower rank,
so runs take time in proportion to their length.

The encoded words are broadcast: their size is bounded by construction.  The rest of a corpus's words
(rare ones, most of them in one text) fit no broadcast, and bringing their ids back to the texts would
shuffle more than the texts; a task replays them in the same way, all its new words at a time, and
remembers them up to a bound (dropping them costs time, not results).  Texts wait, as numbers of pieces,
until some WAITING_BYTES of them are there.  Texts are never shuffled.

The pattern is slow, and most of a text is said again: so texts are cut into pieces at places where matches
always end (see Cuts), pieces are counted and looked up, and the pattern goes over each new piece only.
"""

from __future__ import annotations

import base64
import heapq
import itertools
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opstables.llm.common import list_array, slices, stored, text_col

#: The pattern whose matches end before each space that a character other than white space follows.
SPACED = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words of the corpus that are broadcast, and bytes of the longest.
VOCABULARY_WORDS, VOCABULARY_BYTES = 250_000, 48
#: Words (and bytes of them) and pieces that a task remembers; bytes of text that wait for a replay; bytes of words replayed together.
REMEMBERED_WORDS, REMEMBERED_BYTES, REMEMBERED_PIECES = 100_000, 10_000_000, 120_000
WAITING_BYTES, REPLAYED_BYTES = 16_000_000, 1_500_000
#: Neighbouring ranks whose pairs are looked up together.
BAND = 64
#: Text whose pieces wait as one batch, in bytes (a longer text is taken alone).
ENCODED_BYTES = 1_000_000
#: Ids that are decoded together.
DECODED_IDS = 2_000_000
_NONE = np.int32(2**31 - 1)


def load_ranks(path: str) -> dict[bytes, int]:
    """A file of lines "base64-token rank"."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines()) if a}


class Merges:
    """The merge table as sorted arrays: pair of tokens -> rank of their concatenation."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.width = max(ranks.values()) + 1
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a * self.width + b] = rank
        self.keys = np.array(sorted(pairs), np.int64)
        self.values = np.array([pairs[k] for k in self.keys.tolist()], np.int32)
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        # most pairs of single bytes are looked up: a table for those
        self.byte_pairs = self._search(np.repeat(self.bytes, 256), np.tile(self.bytes, 256)).reshape(256, 256)

    def _search(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) * self.width + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.values[at], _NONE)

    def encode(self, words: list[bytes]) -> list[bytes]:
        """For each word its token ids, as the bytes of an int32 array.  A word that is a token is that token."""
        whole = [self.ranks.get(w) for w in words]
        rest = [w for w, r in zip(words, whole, strict=True) if r is None]
        done = iter(self._replay(rest))
        return [next(done) if r is None else np.int32(r).tobytes() for r in whole]

    def _replay(self, words: list[bytes]) -> list[bytes]:
        if not words:
            return []
        raw = np.frombuffer(b"".join(words), np.uint8)
        size = np.fromiter(map(len, words), np.int64, len(words))
        n, ends = len(raw), np.cumsum(size)
        word = np.repeat(np.arange(len(words), dtype=np.int32), size)
        token = self.bytes[raw]
        following, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        rank = np.full(n + 1, _NONE)  # of the pair that starts here
        rank[: n - 1] = self.byte_pairs[raw[:-1], raw[1:]]
        following[ends - 1] = n  # n stands for no neighbour
        before[ends - size] = n
        rank[ends - 1] = _NONE
        alive = np.ones(n, bool)
        least = np.full(len(words), _NONE)  # scratch: a word's least rank in a band, then where it must stop

        index: dict[int, list[np.ndarray]] = {}  # band of ranks -> positions of pairs that make such tokens
        queue: list[int] = []

        def enter(at: np.ndarray) -> None:
            """Positions into the index, by the pairs that start there."""
            r = rank[at]
            at, r = at[r != _NONE], r[r != _NONE]
            if not len(at):
                return
            band = r // BAND
            order = np.argsort(band, kind="stable")
            at, band = at[order], band[order]
            cuts = np.concatenate([[0], np.flatnonzero(band[1:] != band[:-1]) + 1])
            for key, part in zip(band[cuts].tolist(), np.split(at, cuts[1:]), strict=True):
                if key in index:
                    index[key].append(part)
                    continue
                index[key] = [part]
                heapq.heappush(queue, key)

        enter(np.arange(n, dtype=np.int32))
        while queue:
            key = heapq.heappop(queue)
            parts = index.pop(key)
            band = np.concatenate(parts) if len(parts) > 1 else parts[0]
            band = np.sort(band[rank[band] // BAND == key])
            if not len(band):
                continue
            band = band[np.append(True, band[1:] != band[:-1])]
            # each word's pairs of its least rank
            own = word[band]
            np.minimum.at(least, own, rank[band])
            at = band[rank[band] == least[own]]
            least[own] = _NONE
            # leftmost first: in a run of overlapping pairs every other one is merged
            touches = np.zeros(len(at), bool)
            touches[1:] = following[at[:-1]] == at[1:]
            head = np.flatnonzero(~touches)
            taken = at[(np.arange(len(at)) - np.repeat(head, np.diff(np.append(head, len(at))))) % 2 == 0]
            r = rank[taken]
            # the pairs that each merge makes: with what stands left of it by then, and with what stands right of it still
            right, left = following[following[taken]], before[taken]
            merged_left = np.zeros(len(taken), bool)
            merged_left[1:] = right[:-1] == taken[1:]
            left_token = np.where(merged_left, r, token[np.minimum(left, n - 1)])
            left_rank = np.where(left < n, self._search(left_token, r), _NONE)
            right_rank = np.where(right < n, self._search(r, token[np.minimum(right, n - 1)]), _NONE)
            lower = np.minimum(left_rank, right_rank) < r
            if lower.any():  # a word goes on after its first such merge only when the lower pair has had its turn
                own = word[taken]
                np.minimum.at(least, own[lower], taken[lower])
                goes_on = taken <= least[own]
                least[own] = _NONE
                taken, r, left_rank, right_rank, left, merged_left = (x[goes_on] for x in (taken, r, left_rank, right_rank, left, merged_left))
            gone = following[taken]
            right = following[gone]
            token[taken] = r
            alive[gone] = False
            rank[gone] = _NONE
            following[taken] = right
            has = right < n
            before[right[has]] = taken[has]
            # a merge that the next one follows at once makes a pair with it, not with what stood there
            rank[taken] = right_rank
            rank[taken[:-1][merged_left[1:]]] = left_rank[1:][merged_left[1:]]
            alone = (left < n) & ~merged_left
            left = left[alone]
            rank[left] = left_rank[alone]
            enter(np.concatenate([taken, left, band]))
        kept = token[alive].astype(np.int32).tobytes()
        stops = (4 * np.cumsum(np.bincount(word[alive], minlength=len(words)))).tolist()
        return [kept[a:b] for a, b in zip([0, *stops], stops, strict=False)]


#: Words, the ids of all of them, where each one's ids end (0 first).
Vocabulary = tuple[list[str], np.ndarray, np.ndarray]


class Cuts:
    """Texts in pieces, pieces in words (the matches of the pattern): the words of a text are those of its pieces in turn.

    With the pattern SPACED, a piece ends before each space that no white space follows: only runs of white space hold
    a space after their start, and such a run gives its last character back.  What stands behind the end of a piece
    changes nothing in it, for the pattern looks only for white space there, or the end.  A piece is named without the
    space that it starts with, and the first piece of a text has one more.  With any other pattern the words are the pieces.
    """

    def __init__(self, pattern: str) -> None:
        self.split = regex.compile(pattern)
        self.pieces: Callable[[str], list[str]] = self.split.findall
        self.words: Callable[[str], list[str]] = lambda piece: [piece]
        if pattern == SPACED:
            self.spaces, self.odd = re.compile(r" (?=\S)"), re.compile(r" (?!\S)")
            self.pieces, self.words = self._pieces, self._words

    def _pieces(self, text: str) -> list[str]:
        found = self.spaces.split(text) if self.odd.search(text) else text.split(" ")
        found[0] = f" {found[0]}"
        return found

    def _words(self, piece: str) -> list[str]:
        if piece.isalpha():
            return [f" {piece}"]
        if piece[-1] in ".,;:!?" and piece[:-1].isalpha():
            return [f" {piece[:-1]}", piece[-1]]
        return self.split.findall(piece[1:] if piece[0] == " " else f" {piece}")


def _counted(batches: Iterator[pa.RecordBatch], ranks: dict[bytes, int], pattern: str) -> Iterator[pa.RecordBatch]:
    """(word, n): words that are no tokens and not too long, counted in parts of a task."""
    cuts, pieces = Cuts(pattern), Counter()

    def found() -> pa.RecordBatch:
        counts = defaultdict(int)
        for piece, n in pieces.items():
            for word in cuts.words(piece):
                counts[word] += n
        pieces.clear()
        rows = pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])
        short = pa.compute.less_equal(pa.compute.binary_length(rows.column("word")), VOCABULARY_BYTES)
        new = np.fromiter((w.encode() not in ranks for w in counts), bool, len(counts))
        return rows.filter(pa.compute.and_(short, pa.array(new)))

    for batch in batches:
        for part in slices(batch):
            for text in part.column("text").to_pylist():
                pieces.update(cuts.pieces(text))
                if len(pieces) > REMEMBERED_PIECES:
                    yield found()
    yield found()


def corpus_vocabulary(docs: DataFrame, ranks: dict[bytes, int], pattern: str, most: int = VOCABULARY_WORDS) -> Vocabulary:
    """The corpus's most frequent words with their ids, replayed by partitions of the vocabulary.

    Words are taken by classes of like counts (16 to a doubling), the largest first, as long as they are at
    most `most`: so no task sorts the vocabulary, and the classes are some hundreds, whatever the corpus.
    """
    return _vocabulary(docs, docs.sparkSession.sparkContext.broadcast(Merges(ranks)), pattern, most)  # a vocabulary file, of fixed size


def _vocabulary(docs: DataFrame, shared: Broadcast, pattern: str, most: int) -> Vocabulary:
    rows = docs.select(text_col().alias("text"))
    counted = rows.mapInArrow(lambda it: _counted(it, shared.value.ranks, pattern), "word string, n long")
    several = counted.groupBy("word").agg(F.sum("n").alias("n")).where("n > 1")
    counts = stored(several.select("word", F.floor(16 * F.log2("n")).cast("int").alias("class")), "word-counts")
    limit, left = 1 << 30, most
    for r in sorted(counts.groupBy("class").agg(F.count("*").alias("words")).collect(), key=lambda r: -r["class"]):
        if r["words"] > left:
            break
        limit, left = r["class"], left - r["words"]
    words = counts.where(F.col("class") >= limit)

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = shared.value.encode([w.encode() for w in batch.column("word").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("word"), pa.array(found, pa.binary())], names=["word", "ids"])

    encoded = words.select("word").repartition("word").mapInArrow(replay, "word string, ids binary").toArrow()  # most rows of bounded size
    found = encoded.column("ids").to_pylist()
    ends = np.concatenate([[0], np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) // 4)])
    return encoded.column("word").to_pylist(), np.frombuffer(b"".join(found), np.int32), ends


class _Numbered:
    """Numbered strings and their token ids; those known at first come first and stay."""

    def __init__(self, known: Vocabulary) -> None:
        self.known = known
        self.clear()

    def clear(self) -> None:
        names, ids, ends = self.known
        self.number: defaultdict[str, int] = defaultdict(itertools.count(len(names)).__next__, zip(names, range(len(names)), strict=True))
        self.ids, self.ends, self.bytes = [ids], [ends], 0

    def full(self, most: int) -> bool:
        return len(self.number) > len(self.known[0]) + most or self.bytes > REMEMBERED_BYTES

    def new(self) -> list[str]:
        """Those that have numbers and no ids yet."""
        return list(itertools.islice(self.number, sum(map(len, self.ends)) - 1, None))

    def add(self, sizes: np.ndarray, ids: np.ndarray) -> None:
        """The ids of the next ones, so many each."""
        self.ids.append(ids)
        self.ends.append(self.ends[-1][-1] + np.cumsum(sizes))

    def spell(self, codes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids in each row, all their ids) for rows of so many numbers."""
        if len(self.ids) > 1:
            self.ids, self.ends = [np.concatenate(self.ids)], [np.concatenate(self.ends)]
        start, ends = self.ends[0][codes], self.ends[0][codes + 1]
        stops = np.concatenate([[0], np.cumsum(ends - start)])
        places = np.arange(stops[-1]) + np.repeat(start - stops[:-1], ends - start)
        return np.diff(stops[np.concatenate([[0], np.cumsum(sizes)])]), self.ids[0][places]


class _Words(_Numbered):
    """Words: those of the corpus's vocabulary, and those that a task remembers."""

    def __init__(self, merges: Merges, vocabulary: Vocabulary) -> None:
        super().__init__(vocabulary)
        self.merges = merges

    def replay(self) -> None:
        new = [w.encode() for w in self.new()]
        total = np.cumsum(np.fromiter(map(len, new), np.int64, len(new)))
        self.bytes += int(total[-1]) if len(new) else 0
        at = 0
        while at < len(new):
            stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + REPLAYED_BYTES, side="right")))
            found = self.merges.encode(new[at:stop])
            self.add(np.fromiter(map(len, found), np.int64, len(found)) // 4, np.frombuffer(b"".join(found), np.int32))
            at = stop


class _Pieces(_Numbered):
    """Pieces of texts; their ids are those of their words."""

    def __init__(self, words: _Words, cuts: Cuts) -> None:
        super().__init__(([], np.zeros(0, np.int32), np.zeros(1, np.int64)))
        self.words, self.cuts = words, cuts

    def replay(self) -> None:
        new = self.new()
        if not new:
            return
        sizes, codes = _numbers(map(self.cuts.words, new), self.words)
        self.words.replay()
        self.add(*self.words.spell(codes, sizes))
        self.bytes += sum(map(len, new))
        if self.words.full(REMEMBERED_WORDS):
            self.words.clear()


def _numbers(rows: Iterator[list[str]], names: _Numbered) -> tuple[np.ndarray, np.ndarray]:
    """(strings in each row, the numbers of all)."""
    sizes = []

    def each() -> Iterator[list[str]]:
        for row in rows:
            sizes.append(len(row))
            yield row

    codes = np.fromiter(map(names.number.__getitem__, itertools.chain.from_iterable(each())), np.int32)
    return np.array(sizes, np.int64), codes


def _encode(batches: Iterator[pa.RecordBatch], ranks: dict[bytes, int] | Merges, pattern: str, vocabulary: Vocabulary) -> Iterator[pa.RecordBatch]:
    cuts = Cuts(pattern)
    pieces = _Pieces(_Words(Merges(ranks) if isinstance(ranks, dict) else ranks, vocabulary), cuts)
    waiting: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []
    held = 0

    def spelled() -> Iterator[pa.RecordBatch]:
        pieces.replay()
        for ids, sizes, codes in waiting:
            lengths, values = pieces.spell(codes, sizes)
            yield pa.RecordBatch.from_arrays([ids, list_array(lengths, pa.array(values))], names=["doc_id", "ids"])
        waiting.clear()
        if pieces.full(REMEMBERED_PIECES):
            pieces.clear()

    for batch in batches:
        for part in slices(batch, most=ENCODED_BYTES):
            sizes, codes = _numbers(map(cuts.pieces, part.column("text").to_pylist()), pieces)
            waiting.append((pa.array(part.column("doc_id").to_pylist(), pa.int64()), sizes, codes))
            held += part.column("text").nbytes
            if held > WAITING_BYTES or len(pieces.number) > REMEMBERED_PIECES:
                yield from spelled()
                held = 0
    yield from spelled()


def _encoder(docs: DataFrame, ranks: dict[bytes, int], pattern: str, most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    spark = docs.sparkSession.sparkContext
    table = spark.broadcast(Merges(ranks))  # a file of fixed size; tasks would take longer to make it of the ranks
    shared = spark.broadcast(_vocabulary(docs, table, pattern, most))  # at most `most` bounded words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _encode(batches, table.value, pattern, shared.value)

    return run


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, most: int = VOCABULARY_WORDS) -> DataFrame:
    """doc_id, ids (array of int): one row for each row of docs, whole texts, no special tokens.

    Each match of the pattern is encoded by itself.  Null and empty texts give an empty array.  most: the
    words of the corpus that are encoded beforehand (the time depends on it, not the ids).
    """
    return docs.select("doc_id", text_col().alias("text")).mapInArrow(_encoder(docs, ranks, pattern, most), "doc_id long, ids array<int>")


def round_trip(docs: DataFrame, ranks: dict[bytes, int], pattern: str, most: int = VOCABULARY_WORDS) -> DataFrame:
    """decode(encode(docs)), each batch of ids decoded in the worker that made it: half the workers, and ids cross once."""
    encoded, decoded = _encoder(docs, ranks, pattern, most), _decoder(docs, ranks)
    return docs.select("doc_id", text_col().alias("text")).mapInArrow(lambda batches: decoded(encoded(batches)), "doc_id long, ids array<int>, decoded binary")


def _decoded(rows: pa.ListArray, table: pa.LargeBinaryArray, gaps: np.ndarray) -> pa.BinaryArray:
    """The bytes of each row's ids: those of all its tokens, one after another, lie between two offsets.  gaps: ids that are no tokens."""
    offsets = rows.offsets.to_numpy()
    ids = rows.values.slice(offsets[0], offsets[-1] - offsets[0])
    if ids.null_count or (gaps.any() and gaps[ids.to_numpy()].any()):
        raise ValueError("an id that is no token")
    spelled = table.take(ids)
    ends, data = np.zeros(1, np.int64), pa.py_buffer(b"")
    if len(spelled):
        ends, data = np.frombuffer(spelled.buffers()[1], np.int64, len(spelled) + 1, 8 * spelled.offset), spelled.buffers()[2] or data
    found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(rows), [None, pa.py_buffer(ends[offsets - offsets[0]]), data])
    return pa.compute.if_else(rows.is_valid(), found.cast(pa.binary()), pa.scalar(None, pa.binary()))


def _bounded(batch: pa.RecordBatch, most: int = DECODED_IDS) -> Iterator[tuple[int, pa.ListArray]]:
    """(first row, ids) of the batch in runs of rows of at most `most` ids (a longer row is a run of its own)."""
    ids = batch.column("ids")
    sizes = pa.compute.list_value_length(ids).fill_null(0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and total + n > most:
            yield start, ids.slice(start, i - start)
            start, total = i, 0
        total += n
    if len(ids):
        yield start, ids.slice(start)


def _decoder(df: DataFrame, ranks: dict[bytes, int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    tokens = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    shared = df.sparkSession.sparkContext.broadcast((tokens, np.array(sorted(ranks.values()), np.int32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, known = pa.array(shared.value[0], pa.large_binary()), shared.value[1]
        gaps = np.ones(len(table), bool)
        gaps[known] = False
        for batch in batches:
            for start, part in _bounded(batch):
                yield batch.slice(start, len(part)).append_column("decoded", _decoded(part, table, gaps))

    return run


def decode(encoded: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """All columns of encoded and decoded (binary): the bytes of the ids.  Null ids decode to null."""
    from pyspark.sql.types import BinaryType, StructField, StructType

    return encoded.mapInArrow(_decoder(encoded, ranks), StructType([*encoded.schema.fields, StructField("decoded", BinaryType())]))
