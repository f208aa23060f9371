"""Spelling variants: words of a corpus that one edit separates, and the frequent word that each stands for.

Words are vectors of letter counts.  One inserted or deleted letter moves such a vector by a squared
distance of 1, one replaced letter by 2 (or 0 and 2, never more), so NumPy products of blocks of vectors,
|a|^2 + |b|^2 - 2ab, leave few pairs to be verified letter by letter.

A block holds the words of one length with the same numbers of letters of six classes: an edit changes one
or two of these numbers by one, so a block meets itself, 15 blocks of its length and 6 of the next.
A block of many words is cut into tiles by hash; a task holds two tiles at a time, and the pairs of
tiles are dealt by tile, whatever the block's size.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opstables.llm.common import slices, stored, utf8

_RUN = re.compile("[a-zÀ-ÿ]+")
#: Fixed values of the damage: one run of so many loses a letter.
DAMAGE_EVERY = 199
#: Letters of about equal frequency each; all others are the sixth class.
CLASSES = ("emp", "tduz", "asy", "ohck", "irl")
#: Words, and letters, of a tile.
TILE_WORDS, TILE_LETTERS = 1024, 1_000_000
#: Distinct words that a task counts before it hands them on.
HELD_WORDS = 200_000
#: Letters that are compared at a time.
_COMPARED = 16_000_000
#: Longer words have counts whose squares float32 can't hold exactly.
_EXACT = 2000
_LETTERS = np.array([*range(97, 123), *range(0xC0, 0x100)])


def _occurrences(batches: Iterator[pa.RecordBatch], min_letters: int) -> Iterator[pa.RecordBatch]:
    """Partial counts of words: the damage depends on document and run only, so a text's equal runs are one."""
    found: Counter[str] = Counter()

    def held() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])
        found.clear()
        return out

    for part in (p for batch in batches for p in slices(batch)):
        for doc, text in zip(part.column("doc_id").to_pylist(), utf8(part.column("text")), strict=True):
            start = zlib.crc32(f"{'' if doc is None else doc}:".encode())
            for run, n in Counter(_RUN.findall(text.lower().decode())).items():
                if len(run) < min_letters:
                    continue
                h = zlib.crc32(run.encode(), start)
                if h % DAMAGE_EVERY == 0:
                    run = run[: h % len(run)] + run[h % len(run) + 1 :]
                    if len(run) < min_letters:
                        continue
                found[run] += n
            if len(found) >= HELD_WORDS:
                yield held()
    yield held()


def words(docs: DataFrame, min_letters: int = 6, min_count: int = 5) -> DataFrame:
    """word, n: the words of all texts with so many letters and occurrences, a few of them damaged (see variants)."""
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    partial = texts.mapInArrow(lambda it: _occurrences(it, min_letters), "word string, n long")
    return partial.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def _numbers() -> list[Column]:
    """Length and letters of each counted class."""
    size = F.char_length("word")
    return [size, *(size - F.char_length(F.translate("word", letters, "")) for letters in CLASSES)]


def _moves() -> list[tuple[int, ...]]:
    """What to add to a block's numbers for the blocks that it meets, each pair of blocks once."""
    unit = [tuple(int(i == k) for i in range(len(CLASSES))) for k in range(len(CLASSES))] + [(0,) * len(CLASSES)]
    replaced = [(0, *(x - y for x, y in zip(a, b, strict=True))) for a, b in combinations(unit, 2)]
    return [(0,) * (len(CLASSES) + 1), *replaced, *((1, *a) for a in unit)]


def _tiles(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """block, tile, size, words (joined), ns; and block, tiles."""
    blocked = found.select("word", "n", F.array(*_numbers()).alias("block"))
    letters = F.count("*") * F.col("block")[0]
    blocks = blocked.groupBy("block").agg(F.ceil(F.greatest(F.count("*") / TILE_WORDS, letters / TILE_LETTERS)).cast("int").alias("tiles"))
    blocks = stored(blocks, "spelling-blocks")
    placed = blocked.join(blocks, "block").withColumn("tile", F.pmod(F.xxhash64("word"), F.col("tiles")).cast("int"))
    tiles = placed.groupBy("block", "tile").agg(F.collect_list(F.struct("word", "n")).alias("members"))
    return tiles.select("block", "tile", F.array_join("members.word", "").alias("words"), F.col("members.n").alias("ns")), blocks


def _vectors(letters: np.ndarray) -> np.ndarray:
    n, size = letters.shape
    at = letters.astype(np.int64) + 256 * np.arange(n)[:, None]
    return np.bincount(at.ravel(), minlength=256 * n).reshape(n, 256)[:, _LETTERS].astype(np.float32 if size < _EXACT else np.float64)


def _one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether each row of b is that of a with one letter replaced (if of the same length) or inserted."""
    if a.shape[1] == b.shape[1]:
        return (a != b).sum(1) == 1
    head, tail = a == b[:, :-1], a == b[:, 1:]
    same_head = np.where(head.all(1), a.shape[1], (~head).argmax(1))
    same_tail = np.where(tail.all(1), a.shape[1], (~tail[:, ::-1]).argmax(1))
    return same_head + same_tail >= a.shape[1]


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Both directions of each near pair of two tiles."""
    for batch in batches:
        for row in batch.to_pylist():
            a, b = (np.frombuffer(row[x].encode("latin-1"), np.uint8).reshape(len(row[ns]), -1) for x, ns in (("words", "ns"), ("other_words", "other_ns")))
            va, vb = _vectors(a), _vectors(b)
            apart = (va * va).sum(1)[:, None] + (vb * vb).sum(1)[None, :] - 2 * (va @ vb.T)
            i, j = np.nonzero(apart <= 2)
            if row["same"]:
                i, j = i[i < j], j[i < j]
            step = max(1, _COMPARED // b.shape[1])
            near = np.concatenate([_one_edit(a[i[k : k + step]], b[j[k : k + step]]) for k in range(0, len(i), step)] or [np.zeros(0, bool)])
            i, j = i[near], j[near]
            if not len(i):
                continue
            word, other = ([bytes(x[k]).decode("latin-1") for k in at.tolist()] for x, at in ((a, i), (b, j)))
            n, other_n = np.array(row["ns"], np.int64)[i], np.array(row["other_ns"], np.int64)[j]
            yield pa.RecordBatch.from_arrays(
                [pa.array(word + other), pa.array(other + word), pa.array(np.concatenate([other_n, n]))], names=["word", "near", "near_n"]
            )


def near_pairs(found: DataFrame) -> DataFrame:
    """word, near, near_n: each pair of different words (of word, n) that one edit separates, in both directions."""
    tiles, blocks = _tiles(found)
    tiles = stored(tiles, "spelling-tiles")
    moved = F.explode(F.array(*(F.array(*(F.col("block")[i] + d for i, d in enumerate(move))) for move in _moves())))
    sides = tiles.withColumn("met", moved).join(blocks.withColumnRenamed("block", "met"), "met")
    same_block = F.col("block") == F.col("met")
    pairs = sides.withColumn("met_tile", F.explode(F.expr("sequence(IF(block = met, tile, 0), tiles - 1)"))).withColumn("same", same_block & (F.col("tile") == F.col("met_tile")))
    others = tiles.select(F.col("block").alias("met"), F.col("tile").alias("met_tile"), F.col("words").alias("other_words"), F.col("ns").alias("other_ns"))
    both = pairs.join(others, ["met", "met_tile"]).select("words", "ns", "other_words", "other_ns", "same")
    return both.mapInArrow(_near, "word string, near string, near_n long")


def _roots(forms: DataFrame) -> DataFrame:
    """word, root of (word, form): pointers double until none moves.

    A form has `times` its word's occurrences, so chains are as long as a logarithm of the largest count, and the
    rounds as many as a logarithm of that.
    """
    at = stored(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        ahead = at.select(F.col("word").alias("via"), F.col("root").alias("next"))
        moved = at.join(ahead, at["root"] == ahead["via"], "left")
        at = stored(moved.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        if at.where("moved").isEmpty():
            return at.select("word", "root")
        at = at.select("word", "root")


def variants(docs: DataFrame, min_letters: int = 6, min_count: int = 5, times: int = 5) -> DataFrame:
    """word, form, root, n, n_near, form_n: one row for each distinct word of docs (doc_id, text).

    A word is a maximal run of A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased (no other letter is); where 199 divides
    the crc32 of `doc_id:run`, the run has lost a letter.  Words have min_letters code points and min_count occurrences
    at least.  Near words are one inserted, deleted or replaced code point apart; a word's form is its most frequent near
    word (ties: the first in code-point order), if that is at least `times` as frequent; root follows forms to the last.

    Null and empty texts have no words; a null doc_id counts as the empty text; repeated rows count each time.  Texts of any
    length are read whole and words of any length compared whole; an empty table gives no rows.  Other columns of docs aren't read.
    """
    found = stored(words(docs, min_letters, min_count), "spelling-words")
    # the least of (-n, near) is the most frequent, then the first
    best = near_pairs(found).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    judged = found.join(best, "word", "left").withColumn("form_n", F.when(-F.col("best.less") >= times * F.col("n"), -F.col("best.less")))
    judged = stored(judged.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("form_n").isNotNull(), F.col("best.near")).alias("form"), "form_n"), "spelling-forms")
    roots = _roots(judged.where("form IS NOT NULL"))
    return judged.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
