"""Secret scans with corpus-wide ownership frequency.

Patterns find candidate secrets in every text; the hashes of their values are counted by
distinct owners and repositories over the corpus.  A value that many owners or repositories
hold is an example that people copy; one that a single owner holds in few repositories, and
that looks random, may be live.

The counts are pre-aggregated twice (hash, owner, repository; then hash), so a value that
a third of all documents hold is a row for each owner and repository before it is counted.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opstables.llm.common import carried, fits_broadcast, keyed, restored, same_row, slices, stored, text_col

#: kind -> (pattern, group that is the secret, least length of it, one of these must be in the text (lower-cased)).
#: The first three are fixed; the others add the formats of known issuers.
KINDS: dict[str, tuple[re.Pattern[str], int, int, tuple[str, ...]]] = {
    "assign": (
        re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE),
        2, 6, ("passw", "secret", "token", "apikey", "api_key"),
    ),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 20, ("akia",)),
    "hex": (re.compile(r"[0-9a-f]+"), 0, 24, ()),
    "github": (re.compile(r"gh[pousr]_[A-Za-z0-9]+"), 0, 40, ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    "slack": (re.compile(r"xox[abprs]-[A-Za-z0-9-]+"), 0, 20, ("xox",)),
    "jwt": (re.compile(r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"), 0, 40, ("eyj",)),
    "pem": (re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END [A-Z ]*PRIVATE KEY-----"), 0, 60, ("private key",)),
}
BASE_KINDS = ("assign", "access", "hex")
_ORDER = {kind: i for i, kind in enumerate(KINDS)}
#: Only runs that can be long enough: the same spans as all runs, the short ones dropped.
_LONG_HEX = re.compile(r"[0-9a-f]{24,}")
#: An example has this many owners, or stands in this many repositories, at least.
COPIED_OWNERS, COPIED_REPOS = 3, 5
_DOTTED = re.compile(r"[A-Za-z0-9_.-]+")
_PLACEHOLDER = re.compile(r"example|sample|dummy|placeholder|changeme|redacted|test|xxxx|0000|1234", re.IGNORECASE)

SPANS = "array<struct<kind: string, start: int, end: int, value: binary, random: boolean>>"
_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.binary()), ("random", pa.bool_())])


def looks_random(value: str) -> bool:
    """At least 3 bits of entropy a character, digits among them, and no word that marks an example."""
    n = len(value)
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    return entropy >= 3 and any(c.isdigit() for c in value) and not _PLACEHOLDER.search(value)


def _signed_tokens(text: str) -> Iterator[tuple[int, int]]:
    """The matches of the jwt pattern, by one pass over the runs between dots: each start in a long run would be tried anew by the pattern itself."""
    for m in _DOTTED.finditer(text):
        runs, at, i = m[0].split("."), m.start(), 0
        while i + 2 < len(runs):
            start, step = runs[i].find("eyJ"), 1
            if 0 <= start < len(runs[i]) - 3 and runs[i + 1].startswith("eyJ") and len(runs[i + 1]) > 3 and runs[i + 2]:
                step = 3
                yield at + start, at + sum(map(len, runs[i : i + 3])) + 2
            at += sum(len(r) + 1 for r in runs[i : i + step])
            i += step


def _matches(kind: str, pattern: re.Pattern[str], group: int, text: str) -> Iterator[tuple[int, int, str]]:
    if kind == "jwt":
        return ((a, b, text[a:b]) for a, b in _signed_tokens(text))
    return ((m.start(), m.end(), m[group]) for m in (_LONG_HEX if kind == "hex" else pattern).finditer(text))


def find_spans(text: str) -> list[dict]:
    """The spans of all kinds, leftmost and not overlapping within a kind, by start and kind; offsets in code points."""
    low, found = text.lower(), []
    for kind, (pattern, group, least, signs) in KINDS.items():
        if signs and not any(s in low for s in signs):
            continue
        for start, end, value in _matches(kind, pattern, group, text):
            if len(value) >= least:
                found.append({"kind": kind, "start": start, "end": end, "value": xxhash.xxh3_128_digest(value.encode()), "random": looks_random(value)})
    return sorted(found, key=lambda s: (s["start"], _ORDER[s["kind"]]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            spans = [find_spans(t) for t in part.column("text").to_pylist()]
            names = ["doc_id", "text_key", "owner", "repo"]
            yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array(spans, pa.list_(_SPAN))], names=[*names, "spans"])


def find_secrets(docs: DataFrame, owner: Column, repo: Column, copied_owners: int = COPIED_OWNERS, copied_repos: int = COPIED_REPOS) -> DataFrame:
    """doc_id, text_key, spans: one row for each row of docs; a span has kind, start, end, n_owners, n_repos, verdict.

    verdict: "example" if copied_owners or more hold the value, or copied_repos or more repositories do;
    else "live" if one owner holds it and it looks random, else "unclear".  Null owners and repositories count as one named "".  Texts without
    secrets (empty and null ones, too) have an empty array.
    """
    named = docs.select("doc_id", "text", F.coalesce(owner.cast("string"), F.lit("")).alias("owner"), F.coalesce(repo.cast("string"), F.lit("")).alias("repo"))
    scanned = stored(keyed(named, "owner", "repo").mapInArrow(_scan, f"doc_id long, text_key long, owner string, repo string, spans {SPANS}"), "secret-spans")
    held = scanned.select("doc_id", "text_key", "owner", "repo", F.explode("spans").alias("s"))
    places = held.select("s.value", "owner", "repo").distinct()
    owned = places.select("value", "owner").distinct().groupBy("value").agg(F.count("*").alias("n_owners"))
    in_repos = places.select("value", "repo").distinct().groupBy("value").agg(F.count("*").alias("n_repos"))
    counts = stored(owned.join(in_repos, "value"), "secret-counts")
    small = fits_broadcast(counts.count(), 60)
    judged = held.select("doc_id", "text_key", "s.*").join(F.broadcast(counts) if small else counts, "value")
    verdict = F.when((F.col("n_owners") >= copied_owners) | (F.col("n_repos") >= copied_repos), "example").when((F.col("n_owners") == 1) & F.col("random"), "live").otherwise("unclear")
    order = F.create_map(*(F.lit(x) for kv in _ORDER.items() for x in kv))
    span = F.struct("start", order[F.col("kind")].alias("rank"), "kind", "end", "n_owners", "n_repos", verdict.alias("verdict"))
    by_doc = judged.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_set(span)).alias("judged"))
    rows = scanned.select("doc_id", "text_key")
    out = rows.join(by_doc, same_row(rows, by_doc), "left").select(rows["doc_id"], rows["text_key"], "judged")
    kept = F.transform("judged", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["n_owners"].alias("n_owners"), s["n_repos"].alias("n_repos"), s["verdict"].alias("verdict")))
    empty = F.array().cast("array<struct<kind: string, start: int, end: int, n_owners: bigint, n_repos: bigint, verdict: string>>")
    return out.select("doc_id", "text_key", F.coalesce(kept, empty).alias("spans"))


def span_text(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact_live(docs: DataFrame, found: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs, with each live span of its text (overlapping ones as one) replaced by the mark; n_chars, if there, follows.

    found: of find_secrets.  Rows without live spans stay as they are, null texts too.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("live").to_pylist(), strict=True):
                parts, at = [], 0
                for start, end in sorted((s["start"], s["end"]) for s in spans or ()):
                    if start >= at:
                        parts += [text[at:start], mark]
                    at = max(at, end)
                out.append("".join([*parts, text[at:]]) if spans else text)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(out, pa.string())], names=["row", "text"])

    live = F.transform(F.filter("spans", lambda s: s["verdict"] == "live"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    hits = found.select(F.col("doc_id").alias("id"), F.col("text_key").alias("key"), live.alias("live")).where(F.size("live") > 0)
    hits = stored(hits.dropDuplicates(["id", "key"]), "live-spans")
    small = fits_broadcast(hits.count(), 64)
    rows = docs.select(carried(docs).alias("row"), F.col("doc_id").alias("own_id"), F.xxhash64(text_col()).alias("own_key"), text_col().alias("text"))
    joined = rows.join(F.broadcast(hits) if small else hits, F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own_key") == F.col("key")), "left").select("row", "text", "live")
    out = joined.mapInArrow(cut, joined.drop("live").schema)
    return out.select(*restored(F.col("text"), docs, "row"))
