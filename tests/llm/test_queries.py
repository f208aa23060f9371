"""The registered corpus queries against their SQL, and the pipeline stage by stage."""

import collections
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from compare import same  # noqa: E402
from opstables.llm import queries  # noqa: E402
from opstables.llm.common import documents, stored  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    assert same(spark, SMALL, queries.QUERIES[name], queries.ORACLES[name]) > 0


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES) - {"op11_conversation_repair"}))
def test_query_has_every_document(spark, name):
    ids = {r.doc_id for r in queries.QUERIES[name](spark, SMALL).select("doc_id").distinct().collect()}
    assert ids == {r.doc_id for r in documents(spark, SMALL).select("doc_id").collect()}


def test_held_out_quality(spark):
    from pyspark.sql import functions as F

    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = queries.QUERIES["op10_quality_classifier"](spark, sf).join(labels, "doc_id").where("held_out")
    assert rows.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0] > 0.95


def test_pipeline(spark):
    import corpus_pipeline

    docs = documents(spark, SMALL)
    columns = docs.columns
    extra = docs.limit(0).selectExpr("CAST(900000 AS BIGINT) AS doc_id", "CAST(NULL AS STRING) AS text", "lang", "source", "n_chars")
    docs = docs.unionByName(extra)
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.count()
        docs = stored(stage(spark, docs, SMALL), "test")
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns and 0 < docs.count() <= before
            assert docs.where("text IS NOT NULL AND n_chars <> char_length(text)").isEmpty() or i == 0
    assert docs.where("start + size > 2048").isEmpty()
    assert stored(corpus_pipeline.run(spark, SMALL), "test").count() == docs.count()


#: Names that an operator or stage uses, or has used, for columns of its own.
CLASHING = ("gone", "marked_id", "live_spans", "live_doc", "live_key", "live", "id", "key", "own_id", "own_key", "row", "rest", "is_first", "first", "keep", "rep", "group", "n", "score", "label", "size", "bin", "piece", "pool", "spans", "a.b")


@pytest.mark.parametrize("limit", [32_000_000, -1])
def test_stages_keep_clashing_columns_and_rows_that_share_an_id(spark, monkeypatch, limit):
    import corpus_pipeline
    from opstables.llm import common

    monkeypatch.setattr(common, "BROADCAST_BYTES", limit)
    long = " ".join(f"w{i}" for i in range(90))
    token = "token = q7Zr9KxW2mVb4TnY8sLd"
    rows = [(1, long), (1, "another text of the same id, which is about other things altogether, and keeps its row"), (2, long + " tail"), (2, long + " tail"), (3, "unique words only here " + token), (None, long), (None, long), (4, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING)
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or ""), *CLASHING) for d, t in rows], schema)
    want = {
        "quality classifier": None,
        "line dedup": collections.Counter([(1, rows[0][1]), (1, rows[1][1]), (2, long + " tail"), (2, long + " tail"), (3, rows[4][1]), (None, long), (None, long), (4, None)]),
        "simhash near-dedup": collections.Counter([(1, rows[0][1]), (1, rows[1][1]), (3, rows[4][1]), (None, long), (None, long), (4, None)]),
        "secret scans": collections.Counter([*rows[:4], (3, "unique words only here [SECRET]"), *rows[5:]]),
    }
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stored(stage(spark, docs, SMALL), "test")
        assert out.columns == docs.columns
        got = out.collect()
        assert all(tuple(r[c] for c in CLASHING) == CLASHING for r in got)
        if want[name] is not None:
            assert collections.Counter((r.doc_id, r.text) for r in got) == want[name]
    assert stored(corpus_pipeline.STAGES[-1][1](spark, docs, SMALL), "test").count() == len(rows)


def test_pipeline_content(spark):
    """Stages 2 to 4 on all small documents against brute force over whole texts."""
    import re

    import corpus_pipeline
    from opstables.llm import secrets

    planted = spark.createDataFrame([(900001, "a text that holds\ntoken = q7Zr9KxW2mVb4TnY8sLd\nof one owner", "en", "s", 60)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = stored(documents(spark, SMALL).unionByName(planted), "test")
    stages = dict(corpus_pipeline.STAGES)
    rows = {r.doc_id: r for r in docs.collect()}
    assert len(rows) == docs.count()

    def key(line):
        k = "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
        return k if len(k) >= 10 else None

    first = {}
    for d in sorted(rows):
        for line in (rows[d].text or "").split("\n"):
            first.setdefault(key(line), d)
    text = {d: None if r.text is None else "\n".join(x for x in r.text.split("\n") if key(x) is None or first[key(x)] == d) for d, r in rows.items()}
    after = stored(stages["line dedup"](spark, docs, SMALL), "test")
    assert {r.doc_id: r.text for r in after.collect()} == text

    sets = {}
    for d, t in text.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} - {()}
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a in sorted(sets):
        for b in sorted(sets):
            x, y = sets[a], sets[b]
            if a < b and (len(x & y) >= 0.8 * len(x | y) if x | y else True) and find(a) != find(b):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    kept = {d for d in sets if find(d) == d}
    assert 0 < len(kept) < len(sets)
    after = stored(stages["simhash near-dedup"](spark, after, SMALL), "test")
    assert {r.doc_id: r.text for r in after.collect()} == {d: text[d] for d in kept}

    held = collections.defaultdict(set)
    for d in kept:
        for s in secrets.find_spans(text[d] or ""):
            held[s["value"]].add((rows[d].source, rows[d].lang))
    want = {}
    for d in kept:
        live, new, at = [], "", 0
        for s in secrets.find_spans(text[d] or ""):
            places = held[s["value"]]
            if s["random"] and len({o for o, _ in places}) == 1 and len(places) < 5:
                live.append((s["start"], s["end"]))
        for a, b in sorted(live):
            if a >= at:
                new += text[d][at:a] + "[SECRET]"
            at = max(at, b)
        want[d] = new + text[d][at:] if live else text[d]
    after = stored(stages["secret scans"](spark, after, SMALL), "test")
    assert {r.doc_id: r.text for r in after.collect()} == want
    assert any("[SECRET]" in (t or "") for t in want.values())
    packed = stages["best-fit packing"](spark, after, SMALL).collect()
    size = collections.Counter()
    for r in packed:
        size[r.doc_id] += r.size
    assert size == {d: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) + 1 for d, t in want.items()}


def test_near_copies_found_and_left_alone(spark):
    """Recall and precision of the pipeline's near copies over whole tables, by brute force over all pairs that share a shingle."""
    from opstables.llm import simhash

    docs = documents(spark, "/root/testdata/sf0.01")
    sets, holders = {}, collections.defaultdict(list)
    for r in docs.collect():
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in r.text or "").split()
        sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} - {()}
    for d, x in sets.items():
        for shingle in x:
            holders[shingle].append(d)
    common = collections.Counter((a, b) for ids in holders.values() for i, a in enumerate(ids) for b in ids[i + 1 :] if a < b)
    linked = {(a, b) for (a, b), n in common.items() if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n)}
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a, b in sorted(linked):
        low, high = sorted((find(a), find(b)))
        root[high] = low
    empty = sorted(d for d, x in sets.items() if not x)
    for d in empty[1:]:
        root[find(d)] = empty[0]
    group = {r.doc_id: r.component_id for r in simhash.near_groups(docs, simhash.NEAR_COPIES).collect()}
    found = sum(group[a] == group[b] for a, b in linked)
    assert len(linked) > 50 and found == len(linked)  # recall 1 on these tables
    assert group == {d: find(d) for d in sets}  # and nothing else is grouped


def test_pipeline_takes_awkward_documents(spark):
    import corpus_pipeline

    rows = [(1, None, "en", "a", 0), (2, "", "en", None, 0), (3, " \n ", None, "a", 3), (None, "no id here", "en", "a", 10), (4, "same text " * 40, "en", "a", 400), (4, "same text " * 40, "en", "a", 400), (5, "same text " * 40, "en", "b", 400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[1:]:
        docs = stored(stage(spark, docs, SMALL), "test")
    assert docs.count() > 0
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        empty = stored(stage(spark, empty, SMALL), "test")
    assert empty.count() == 0
