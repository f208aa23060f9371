"""Quality rules as a short-circuit cascade, with DataFrame and SQL functions only.

Every rule rejects on a predicate over features of the text.  A rule's cost (seconds to
evaluate it alone) and selectivity (share it rejects) are measured on a bounded sample of
rows; the rules then stand in one CASE, those with the most rejections per cost first.
A feature is computed inside the CASE, where the first rule that needs it stands, and bound
there for the rules behind it: a text that a cheap rule rejects never pays for the dear ones.
The order changes the time only: a text is kept if no rule rejects it.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opstables.llm.common import SPACES, text_col

#: The sample for costs: rows, the share of rows read that it takes (so that it is spread over more of them), code points of each, timed runs.
SAMPLE_ROWS, SAMPLE_SHARE, SAMPLE_CHARS, RUNS = 200, 0.01, 20_000, 2


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body uses it, and only where this expression is evaluated."""
    return F.get(F.transform(F.array(value), body), 0)


def words(text: Column) -> Column:
    """The runs of other characters than white space."""
    for space in SPACES[1:]:
        text = F.replace(text, F.lit(space), F.lit(" "))
    return F.array_remove(F.split(text, " "), "")


def word_chars(text: Column) -> Column:
    for space in SPACES:
        text = F.replace(text, F.lit(space), F.lit(""))
    return F.char_length(text).cast("long")


def symbols(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long")


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    return bound(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def window_hash(*window: Column) -> Column:
    return F.xxhash64(*window)


def repeat_words(w: Column) -> Column:
    """Words in 3-word windows found twice or more.

    Texts whose windows all differ by their hashes are done.  In others, hashes (their lower 32
    bits, above the places) are sorted; windows that share one are sorted by their words and
    counted as repeated if the three words equal a neighbour's, so hashes decide nothing alone.
    """

    def window(i: Column) -> list[Column]:
        return [F.get(w, i + k) for k in range(3)]

    def beside(rows: Column, same: Callable[[Column, Column], Column]) -> Column:
        """The rows that are the same as the one before or after."""
        return F.filter(rows, lambda x, i: same(x, F.get(rows, i - 1)) | same(x, F.get(rows, i + 1)))

    def repeated(hashes: Column) -> Column:
        keys = F.sort_array(F.transform(hashes, lambda h, i: F.shiftleft(h, 32).bitwiseOR(i.cast("long"))))
        alike = bound(keys, lambda ks: beside(ks, lambda a, b: F.shiftright(a, 32) == F.shiftright(b, 32)))
        spelled = F.sort_array(F.transform(alike, lambda k: bound(k.bitwiseAND(F.lit(2**32 - 1)).cast("int"), lambda i: F.struct(F.array(*window(i)).alias("words"), i.alias("place")))))
        equal = bound(spelled, lambda rows: beside(rows, lambda a, b: a["words"] == b["words"]))
        return bound(F.sort_array(F.transform(equal, lambda r: r["place"])), covered)

    def covered(places: Column) -> Column:
        """Words that 3-word windows at these sorted places cover."""
        steps = F.transform(places, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(places, i + 1) - p, F.lit(3))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda s, x: s + x)

    hashes = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: window_hash(*window(i)))
    several = bound(hashes, lambda hs: F.when(F.size(F.array_distinct(hs)) == F.size(hs), F.lit(0).cast("long")).otherwise(repeated(hs)))
    return F.when(F.size(w) < 4, F.lit(0).cast("long")).otherwise(several)


#: Feature -> the features (or text) that it is computed from, and how.
FEATURES: dict[str, tuple[tuple[str, ...], Callable[..., Column]]] = {
    "words": (("text",), words),
    "n_words": (("words",), lambda w: F.size(w).cast("long")),
    "word_chars": (("text",), word_chars),
    "n_symbols": (("text",), symbols),
    "n_marks": (("text",), lambda t: F.regexp_count(t, F.lit("[!?]")).cast("long")),
    "n_upper": (("text",), lambda t: F.regexp_count(t, F.lit(r"\p{Lu}")).cast("long")),
    "n_lines": (("text",), lambda t: F.regexp_count(t, F.lit(r"\n")).cast("long") + 1),
    "n_dup_lines": (("text",), duplicate_lines),
    "n_repeat_words": (("words",), repeat_words),
}


@dataclass(frozen=True)
class Rule:
    """Rejects texts for which the predicate over its features is true."""

    name: str
    features: tuple[str, ...]
    rejects: Callable[..., Column]

    def hit(self, known: dict[str, Column]) -> Column:
        return F.coalesce(self.rejects(*(known[f] for f in self.features)), F.lit(False))


BASE_RULES = (
    Rule("too short", ("n_words",), lambda n: n < 50),
    Rule("repeats itself", ("n_words", "n_repeat_words"), lambda n, k: 100 * k > 50 * n),
)
RULES = (
    *BASE_RULES,
    Rule("symbols", ("word_chars", "n_symbols"), lambda n, k: 100 * k > 5 * n),
    Rule("marks", ("word_chars", "n_marks"), lambda n, k: 100 * k > 10 * n),
    Rule("capitals", ("word_chars", "n_upper"), lambda n, k: 100 * k > 60 * n),
    Rule("word length", ("n_words", "word_chars"), lambda n, c: (c < 2 * n) | (c > 25 * n)),
    Rule("repeated lines", ("n_lines", "n_dup_lines"), lambda n, k: (n >= 4) & (100 * k > 50 * n)),
)


def _missing(names: tuple[str, ...], known: dict[str, Column]) -> list[str]:
    """The features among names and those below them that aren't known, each after what it needs."""
    found: list[str] = []
    for name in names:
        if name not in known and name not in found:
            found += [f for f in _missing(FEATURES[name][0], known) if f not in found]
            found.append(name)
    return found


def with_known(known: dict[str, Column], names: list[str], body: Callable[[dict[str, Column]], Column]) -> Column:
    """body of the known features and of those named, which are computed here, once each."""
    if not names:
        return body(known)
    needs, of = FEATURES[names[0]]
    return bound(of(*(known[n] for n in needs)), lambda value: with_known(known | {names[0]: value}, names[1:], body))


def cascade(rules: list[Rule], known: dict[str, Column]) -> Column:
    """True unless a rule rejects; the rules are tried in this order, and none after the first that rejects.

    known: text, and features that are columns already.
    """
    if not rules:
        return F.lit(True)
    first, rest = rules[0], rules[1:]
    return with_known(known, _missing(first.features, known), lambda k: F.when(first.hit(k), F.lit(False)).otherwise(cascade(rest, k)))


def with_features(docs: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Adds the features as columns; docs has a column text without nulls.

    All are computed in one projection, so neither the text nor its words are copied from step to step.
    """
    if not names:
        return docs
    text = {"text": F.col("text")}
    found = with_known(text, _missing(names, text), lambda k: F.struct(*(k[n].alias(n) for n in names)))
    return docs.withColumn("_found", found).select(*docs.columns, *(F.col(f"_found.{n}").alias(n) for n in names))


def rule_order(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> list[tuple[Rule, float, float]]:
    """(rule, seconds, share rejected), by rejections per second.

    Measured on at most sample_rows rows of bounded length, picked from some sample_rows / SAMPLE_SHARE
    rows; the seconds are the least of RUNS runs after a first one, less those of counting alone.
    """
    spark = docs.sparkSession
    texts = docs.select(F.substring(text_col(), 1, SAMPLE_CHARS).alias("text"))
    rows = texts.sample(SAMPLE_SHARE, seed=9).limit(sample_rows).collect() or texts.limit(sample_rows).collect()
    sample = spark.createDataFrame(rows, "text string").coalesce(1).cache()
    total = max(1, sample.count())

    def timed(hit: Column) -> tuple[float, int]:
        counted, seconds = sample.agg(F.count_if(hit)), []
        rejected = counted.first()[0]
        for _ in range(RUNS):
            began = time.perf_counter()
            counted.collect()
            seconds.append(time.perf_counter() - began)
        return min(seconds), rejected

    base, _ = timed(F.octet_length("text") < 0)
    found = []
    for rule in rules:
        seconds, rejected = timed(~cascade([rule], {"text": F.col("text")}))
        found.append((rule, max(seconds - base, 1e-4), rejected / total))
    sample.unpersist()
    return sorted(found, key=lambda x: -x[2] / x[1])


def quality_verdicts(docs: DataFrame, rules: tuple[Rule, ...] = RULES, show: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the features to show, kept: one row for each row of docs.

    Null counts as the empty text.  An empty text has no words and so is too short; a very
    long one is taken whole.  A feature that isn't shown is computed only for texts that
    reach its rule; those shown are computed for all.
    """
    order = [rule for rule, _, _ in rule_order(docs, rules)]
    rows = with_features(docs.select("doc_id", text_col().alias("text")), show)
    known = {c: F.col(c) for c in ("text", *show)}
    return rows.select("doc_id", *show, cascade(order, known).alias("kept"))
