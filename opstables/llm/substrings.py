"""Substring dedup over a de Bruijn graph of word k-mers, compacted to paths.

Nodes are runs of k-1 words; a window of k words is an edge from its first k-1 words to its last k-1.
Of every edge that several documents hold, the smallest doc_id is the source; elsewhere the words
that it covers go.

1. Anchors.  Equal windows have the same least inner 5-gram.  Only windows whose anchor
   several documents hold can be repeated; all others are done.  Anchors are a fifth of the
   windows, and each travels as two hashes' worth of bytes.
2. Edges.  The remaining windows (once for each text that repeats one) are brought together by their two
   nodes, in waves (each is a part of the nodes, so only a part of the windows is in shuffle files at once).  An edge's occurrence
   with the least doc_id gives its source coordinates; those in later documents are copies.
3. Paths.  Each node's in- and out-degree is counted over the distinct repeated edges; at a node with one
   of either, the edge after it continues the edge before it.  Edges that continue one another in a
   source's order are one segment; segments that continue one another across sources are joined to
   paths by pointer doubling, whose rounds are bounded, so that cycles end.
4. Copies.  A document's copies are runs along the source coordinates, cut where segments end.
   A source spells each piece asked for (a hash of its words at these coordinates), and the words of a
   copy go only if they are spelled alike; so a clash of node hashes removes nothing.

Hot passages: an edge's occurrences are streamed through a window, which spills; all later tables are
bounded by the documents' own lengths or by the number of copied windows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opstables.llm.common import SPACES, fits_broadcast, keyed, slices, stored, utf8
from opstables.operators.dag import lineage
from opstables.sources.scratch import owned

WINDOW, ANCHOR = 13, 5
_SLICE = 2_000_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Parts in which the windows are brought together.
WAVES = 2


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _hashes(h: np.ndarray, k: int, base: np.uint64) -> np.ndarray:
    """A hash of each run of k word hashes."""
    n = max(0, len(h) - k + 1)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * base + h[j : j + n]
    return _mix(out)


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES.encode())] = True
#: Words of more bytes are hashed one by one.
_LONG_WORD = 256


def _word_hashes(buffer: bytes, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A hash of each word, eight bytes at a time over all words; buffer goes on for eight bytes after the last."""
    lanes = np.ndarray(len(buffer) - 7, "<u8", buffer, strides=(1,))  # the eight bytes from each place on
    out = _mix(size.astype(np.uint64) * _BASE)
    at = np.flatnonzero(size <= _LONG_WORD)
    for done in range(0, _LONG_WORD, 8):
        at = at[size[at] > done]
        if not len(at):
            break
        unused = np.uint64(8) * np.maximum(8 - (size[at] - done), 0).astype(np.uint64)
        lane = (lanes[start[at] + done].astype(np.uint64) << unused) >> unused
        out[at] = _mix((out[at] ^ lane) * _BASE)
    for i in np.flatnonzero(size > _LONG_WORD).tolist():
        out[i] = xxhash.xxh64_intdigest(buffer[start[i] : start[i] + size[i]])
    return out


class Words:
    """The words of some texts, one after another."""

    def __init__(self, texts: list[bytes]) -> None:
        buffer = b" ".join([*texts, bytes(8)])
        text = np.cumsum([0, *(len(t) + 1 for t in texts)])  # where each begins; then the zeros, which are no text
        space = _IS_SPACE[np.frombuffer(buffer, np.uint8)[: text[-1]]]
        edges = np.flatnonzero(np.diff(space, prepend=True))  # words begin and end in turn: a space ends the last text
        first, stop = edges[::2], edges[1::2]
        self.doc = np.searchsorted(text[1:], first, side="right")
        self.size = np.bincount(self.doc, minlength=len(texts))
        self.start = np.cumsum(self.size) - self.size
        self.hash = _word_hashes(buffer, first, stop - first)

    def windows(self, k: int) -> np.ndarray:
        """First positions of the windows within one text."""
        n = len(self.hash) - k + 1
        return np.flatnonzero(self.doc[:n] == self.doc[k - 1 :]) if n > 0 else np.zeros(0, np.int64)

    def anchors(self, k: int, inner: int) -> tuple[np.ndarray, np.ndarray]:
        """(first positions of the windows, the least inner hash of each)."""
        at = self.windows(k)
        if not len(at):
            return at, np.zeros(0, np.uint64)
        least = _hashes(self.hash, inner, _BASE)
        width, n = 1, k - inner + 1
        while width * 2 <= n:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < n:
            least = np.minimum(least[: len(least) - (n - width)], least[n - width :])
        return at, least[at]

    def ordinals(self, at: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        """The number, within its text, of the run of windows of equal anchor that each window is in."""
        doc = self.doc[at]
        new = np.ones(len(at), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
        run = np.cumsum(new) - 1
        head = np.ones(len(at), bool)
        head[1:] = doc[1:] != doc[:-1]
        return run - np.repeat(run[head], np.diff(np.append(np.flatnonzero(head), len(at))))


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(anchor, doc_id, tag, run): a row for each run of windows with the same anchor."""
    for batch in batches:
        for part in slices(batch, most=_SLICE):
            w = Words(utf8(part.column("text")))
            at, anchor = w.anchors(WINDOW, ANCHOR)
            if not len(at):
                continue
            run = w.ordinals(at, anchor)
            first = np.ones(len(at), bool)
            first[1:] = (run[1:] != run[:-1]) | (w.doc[at[1:]] != w.doc[at[:-1]])
            rows = pa.array(w.doc[at[first]])
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchor[first].view(np.int64)), part.column("doc_id").take(rows), part.column("tag").take(rows), pa.array(run[first].astype(np.int32))],
                names=["anchor", "doc_id", "tag", "run"],
            )


def _candidates(w: Words, own_runs: list) -> np.ndarray:
    """First positions of the windows whose anchor other documents hold, too: those of all runs but the text's own."""
    at, anchor = w.anchors(WINDOW, ANCHOR)
    if not len(at):
        return at
    run, base = w.ordinals(at, anchor), np.zeros(len(w.size) + 1, np.int64)
    counts = np.zeros(len(w.size), np.int64)
    np.maximum.at(counts, w.doc[at], run + 1)
    base[1:] = np.cumsum(counts)
    own = np.zeros(base[-1], bool)
    for i, runs in enumerate(own_runs):
        if runs is not None:
            own[base[i] + np.asarray(runs, np.int64)] = True
    return at[~own[base[w.doc[at]] + run]]


def _lists(column: pa.Array) -> list:
    """Lists of ints as arrays, null as None."""
    return [x.values.to_numpy() if x.is_valid else None for x in column]


def _firsts(before: np.ndarray, after: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, list]:
    """Of windows in order: those that stand first in their text, and for each the others of it that equal it (an empty list if none does)."""
    mixed = _mix((before.view(np.uint64) * _BASE) ^ after.view(np.uint64) + doc.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    order = np.argsort(mixed, kind="stable")
    again = np.flatnonzero(mixed[order[1:]] == mixed[order[:-1]])
    if not len(again):
        return np.arange(len(doc)), []
    some = np.sort(np.union1d(order[again], order[again + 1]))
    by = some[np.lexsort((some, after[some], before[some], doc[some]))]
    new = np.ones(len(by), bool)
    new[1:] = (doc[by[1:]] != doc[by[:-1]]) | (before[by[1:]] != before[by[:-1]]) | (after[by[1:]] != after[by[:-1]])
    groups = {int(g[0]): g[1:] for g in np.split(by, np.flatnonzero(new)[1:]) if len(g) > 1}
    later = np.zeros(len(doc), bool)
    later[by[~new]] = True
    first = np.flatnonzero(~later)
    return first, [groups.get(int(i)) for i in first]


def _edge_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(before, after, doc_id, place, more): the nodes of each window that may be repeated, where it stands first in its text, and where else."""
    for batch in batches:
        for part in slices(batch, most=_SLICE):
            w = Words(utf8(part.column("text")))
            at = _candidates(w, _lists(part.column("own_runs")))
            if not len(at):
                continue
            node = _hashes(w.hash, WINDOW - 1, _BASE).view(np.int64)
            # which of the texts of its doc_id (there is one, as a rule), and the position in it
            place = (np.repeat(part.column("tag").to_numpy().astype(np.int64), w.size)[at] << 32) | (at - w.start[w.doc[at]])
            first, more = _firsts(node[at], node[at + 1], w.doc[at])
            at = at[first]
            others = pa.array([place[x] if x is not None else None for x in more], pa.list_(pa.int64())) if more else pa.nulls(len(at), pa.list_(pa.int64()))
            names = ["before", "after", "doc_id", "place", "more"]
            yield pa.RecordBatch.from_arrays([pa.array(node[at]), pa.array(node[at + 1]), part.column("doc_id").take(pa.array(w.doc[at])), pa.array(place[first]), others], names=names)


def _runs(batches: Iterator[pa.RecordBatch], follows: str) -> Iterator[pa.RecordBatch]:
    """Of rows (doc_id, place, {follows}_doc, {follows}_place) sorted by doc_id and place: (first row of each run, n).

    A row goes on if it stands one place after the row before it, of the same document, and, for
    "src", if so do its source coordinates; for "prev", if these are the row before.  A run that
    a batch cuts is given as two.
    """
    names = ["doc_id", "place", f"{follows}_doc", f"{follows}_place"]
    for batch in batches:
        if not batch.num_rows:
            continue
        doc, place = (batch.column(c).to_numpy() for c in names[:2])
        other_doc, other = (batch.column(c).fill_null(-1).to_numpy(zero_copy_only=False) for c in names[2:])
        first = np.ones(len(doc), bool)
        first[1:] = (doc[1:] != doc[:-1]) | (place[1:] != place[:-1])
        kept = np.flatnonzero(first)  # rows that repeat a document's text bring the same places again
        doc, place, other_doc, other = doc[kept], place[kept], other_doc[kept], other[kept]
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (place[1:] != place[:-1] + 1)
        if follows == "src":
            new[1:] |= (other_doc[1:] != other_doc[:-1]) | (other[1:] != other[:-1] + 1)
        else:
            new[1:] |= (other_doc[1:] != doc[:-1]) | (other[1:] != place[:-1])
        heads = np.flatnonzero(new)
        rows = batch.select(names).take(pa.array(kept[heads]))
        yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(np.diff(np.append(heads, len(doc))))], names=[*names, "n"])


def _spelling(words: list[bytes], pos: int, n: int) -> bytes:
    """A hash of the words that n windows from pos on cover; words hold no white space, so a space joins them unambiguously."""
    return xxhash.xxh3_128_digest(b" ".join(words[pos : pos + n + WINDOW - 1]))


def _spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(src_doc, src_place, n, spelling) for the pieces that are asked of each source text."""
    for batch in batches:
        for part in slices(batch, most=_SLICE):
            out: list[tuple[int, int, int, bytes]] = []
            for doc, text, wanted in zip(part.column("doc_id").to_pylist(), utf8(part.column("text")), part.column("wanted").to_pylist(), strict=True):
                words = text.split()
                out += [(doc, x["src_place"], x["n"], _spelling(words, x["src_place"] & 0xFFFFFFFF, x["n"])) for x in wanted]
            columns = list(zip(*out, strict=True)) or [[], [], [], []]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["src_doc", "src_place", "n", "spelling"])


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, most=_SLICE):
            n_words, removed, paths, texts = [], [], [], []
            for text, pieces in zip(utf8(part.column("text")), part.column("pieces").to_pylist(), strict=True):
                words = text.split()
                n_words.append(len(words))
                gone, found = np.zeros(len(words) + 1, np.int64), set()
                for x in pieces or ():
                    if _spelling(words, x["pos"], x["n"]) == x["spelling"]:
                        gone[x["pos"]] += 1
                        gone[x["pos"] + x["n"] + WINDOW - 1] -= 1
                        found.add(x["path"])
                if found:
                    covered = np.cumsum(gone)[:-1] > 0
                    words = [w for w, g in zip(words, covered.tolist(), strict=True) if not g]
                removed.append(n_words[-1] - len(words))
                paths.append(len(found))
                texts.append(b" ".join(words).decode())
            values = [pa.array(n_words, pa.int64()), pa.array(removed, pa.int64()), pa.array(paths, pa.int64()), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_key"), *values], names=["doc_id", "text_key", "n_words", "n_removed", "n_paths", "kept_text"])


def occurrences(edges: DataFrame) -> DataFrame:
    """Of edges that several documents hold: the source's occurrence (is_source, with its nodes) and those in later documents, with source coordinates."""
    same = Window.partitionBy("before", "after").orderBy("doc_id", "place")
    whole = same.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = edges.select(
        "before", "after", "doc_id", "place", "more", F.first("doc_id").over(same).alias("src_doc"), F.first("place").over(same).alias("src_place"), F.last("doc_id").over(whole).alias("last"), (F.row_number().over(same) == 1).alias("is_source")
    ).where("last > src_doc AND (is_source OR doc_id > src_doc)")
    nodes = (F.when(F.col("is_source"), F.col(c)).alias(c) for c in ("before", "after"))
    # a text that repeats the edge is one row up to here, so a hot edge has no more rows than there are texts with it
    places = F.when(F.col("is_source") | F.col("more").isNull(), F.array("place")).otherwise(F.array_append("more", F.col("place")))
    return rows.select("doc_id", F.explode(places).alias("place"), "src_doc", "src_place", "is_source", *nodes)


def compact(edges: DataFrame) -> DataFrame:
    """Distinct edges (doc_id, place: source coordinates; before, after: nodes) as segments: (src_doc, src_place, n, path).

    path: the number of the first segment of the nonbranching path that a segment is part of.
    """
    ends = edges.select("doc_id", "place", F.inline(F.array(F.struct(F.col("before").alias("node"), F.lit(False).alias("enters")), F.struct(F.col("after").alias("node"), F.lit(True).alias("enters")))))
    at = Window.partitionBy("node")
    n_in, n_out = F.count_if("enters").over(at), F.count_if(~F.col("enters")).over(at)
    only = F.max(F.when(F.col("enters"), F.struct("doc_id", "place"))).over(at)
    leaving = ends.select("doc_id", "place", "enters", F.when((n_in == 1) & (n_out == 1), only).alias("prev")).where("NOT enters")
    # an edge of one node leads to itself
    rows = leaving.select("doc_id", "place", F.when(F.struct("doc_id", "place") != F.col("prev"), F.col("prev")).alias("prev")).select("doc_id", "place", F.col("prev.doc_id").alias("prev_doc"), F.col("prev.place").alias("prev_place"))
    ordered = rows.repartition("doc_id").sortWithinPartitions("doc_id", "place")
    runs = ordered.mapInArrow(lambda it: _runs(it, "prev"), "doc_id long, place long, prev_doc long, prev_place long, n long")
    segments = stored(runs.withColumn("segment", F.monotonically_increasing_id()), "segments")
    lasts = segments.select(F.col("segment").alias("from_id"), F.col("doc_id").alias("last_doc"), (F.col("place") + F.col("n") - 1).alias("last_place"))
    links = segments.join(lasts, (F.col("prev_doc") == F.col("last_doc")) & (F.col("prev_place") == F.col("last_place")), "left").select(F.col("segment").alias("id"), "from_id")
    roots = lineage(links)  # those on cycles have none, and are paths of their own
    named = segments.join(roots, segments["segment"] == roots["node"])
    return named.select(F.col("doc_id").alias("src_doc"), F.col("place").alias("src_place"), "n", F.coalesce("root", "segment").alias("path"))


def _chunks(rows: DataFrame, chunk: int) -> DataFrame:
    """rows (src_place, n, ...) for each chunk of source places that they reach into."""
    return rows.withColumn("chunk", F.explode(F.sequence(F.expr(f"src_place DIV {chunk}"), F.expr(f"(src_place + n - 1) DIV {chunk}"))))


def cut_at_segments(copies: DataFrame, segments: DataFrame, chunk: int = 4096) -> DataFrame:
    """copies (doc_id, place, src_doc, src_place, n) in pieces that lie within one segment each, with its path.

    They meet by chunks of the source, so no copy meets more of a source than it copies, and some.
    """
    by_chunk = _chunks(segments, chunk).groupBy("src_doc", "chunk").agg(F.collect_list(F.struct(F.col("src_place").alias("at"), F.col("n").alias("length"), "path")).alias("segments"))
    met = _chunks(copies, chunk).join(by_chunk, ["src_doc", "chunk"])
    low, high = F.greatest("src_place", "at", F.col("chunk") * chunk), F.least(F.expr("src_place + n"), F.expr("at + length"), (F.col("chunk") + 1) * chunk)
    near = F.filter("segments", lambda s: (s["at"] < F.expr("src_place + n")) & (s["at"] + s["length"] > F.col("src_place")))
    pieces = met.select("doc_id", "place", "src_doc", "src_place", "n", "chunk", F.inline(near)).withColumns({"low": low, "high": high}).where("low < high")
    return pieces.select("doc_id", F.expr("place + (low - src_place)").alias("place"), "src_doc", F.col("low").alias("src_place"), F.expr("high - low").alias("n"), "path")


def _tag(place: str) -> Column:
    return F.shiftright(place, 32).cast("int")


def dedup_substrings(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, n_words, n_removed, n_paths, kept_text: one row for each row of docs.

    Words are runs of other characters than white space, unchanged; kept ones are joined by one
    space.  A word goes if it is in a window of 13 words whose words also start in a document
    with a smaller doc_id (on the input, not on what is left); n_paths: the paths that the removed
    windows are on.  Texts of fewer words, empty and null ones stay as they are, and so do rows without
    doc_id.  Rows that share a doc_id, repeated or with another text, remove nothing from each other.
    """
    spark = docs.sparkSession
    d = keyed(docs).withColumn("tag", F.col("text_key").bitwiseAND(F.lit(2**31 - 1)).cast("int"))
    known = d.where("doc_id IS NOT NULL").select("doc_id", "tag", "text")
    anchors = known.mapInArrow(_anchor_rows, "anchor long, doc_id long, tag int, run int")
    held = anchors.groupBy("anchor").agg(F.count("*").alias("n"), F.min("doc_id").alias("doc_id"), F.min("tag").alias("tag"), F.min("run").alias("run"))
    # an anchor of a single run: no window with it stands anywhere else
    lone = held.where("n = 1").groupBy("doc_id", "tag").agg(F.collect_list("run").alias("own_runs"))
    with owned(spark) as made:
        own = stored(lone, "own-anchors")
        edges = stored(known.join(own, ["doc_id", "tag"], "left").mapInArrow(_edge_rows, "before long, after long, doc_id long, place long, more array<long>"), "edges")
        waves = [stored(occurrences(edges.where(F.pmod("before", F.lit(WAVES)) == i)), "occurrences") for i in range(WAVES)]
        del made[2:]  # the first two go
    found = reduce(DataFrame.unionByName, waves)
    segments = stored(compact(found.where("is_source").select("doc_id", "place", "before", "after")), "paths")
    ordered = found.where("NOT is_source").select("doc_id", "place", "src_doc", "src_place").repartition("doc_id").sortWithinPartitions("doc_id", "place")
    copies = stored(ordered.mapInArrow(lambda it: _runs(it, "src"), "doc_id long, place long, src_doc long, src_place long, n long"), "copies")
    pieces = stored(cut_at_segments(copies, segments), "pieces")
    asked = pieces.select("src_doc", "src_place", "n").distinct()
    wanted = stored(asked.groupBy("src_doc", _tag("src_place").alias("src_tag")).agg(F.collect_list(F.struct("src_place", "n")).alias("wanted")), "wanted")
    small = fits_broadcast(wanted.agg(F.coalesce(F.sum(F.size("wanted")), F.lit(0))).first()[0], 80)
    sources = known.join(F.broadcast(wanted) if small else wanted, (F.col("doc_id") == F.col("src_doc")) & (F.col("tag") == F.col("src_tag"))).select("doc_id", "text", "wanted")
    spelled = sources.mapInArrow(_spelled, "src_doc long, src_place long, n long, spelling binary").distinct()
    spelled = F.broadcast(spelled) if small else spelled  # a hot piece meets its copies where they are
    piece = F.struct(F.col("place").bitwiseAND(F.lit(2**32 - 1)).alias("pos"), "n", "spelling", "path")
    checked = pieces.join(spelled, ["src_doc", "src_place", "n"]).groupBy("doc_id", _tag("place").alias("tag")).agg(F.collect_list(piece).alias("pieces"))
    both = d.join(stored(checked, "passages"), ["doc_id", "tag"], "left").select("doc_id", "text_key", "text", "pieces")
    return both.mapInArrow(_remove, "doc_id long, text_key long, n_words long, n_removed long, n_paths long, kept_text string")
