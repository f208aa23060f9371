"""Spelling variants, WARC packages and conversation repair against plain models."""

import collections
import hashlib
import io
import itertools
import random
import re
import struct
import zipfile
import zlib
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from opstables.llm import archives, common, conversations, grammar, queries, secrets, spelling, warc

SMALL = "/root/testdata/sf0.001"


# --- spelling ---


def plain_variants(docs, least=5, times=5):
    n = collections.Counter()
    for doc, text in docs:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for run in re.findall("[a-zÀ-ÿ]+", low):
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            word = run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run
            if len(word) >= 6:
                n[word] += 1
    n = {w: c for w, c in n.items() if c >= least}

    def one_edit(a, b):
        if len(a) > len(b):
            a, b = b, a
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    near = {w: [v for v in n if v != w and abs(len(v) - len(w)) < 2 and one_edit(w, v)] for w in n}
    form = {w: min(vs, key=lambda v: (-n[v], v)) if vs else None for w, vs in near.items()}
    form = {w: f if f and n[f] >= times * n[w] else None for w, f in form.items()}
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


def spelling_docs():
    rng = random.Random(3)
    base = ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(6, 10))) for _ in range(60)]
    docs = []
    for i in range(300):
        words = []
        for _ in range(60):
            w = base[min(int(rng.expovariate(0.15)), len(base) - 1)]
            if rng.random() < 0.3:
                k = rng.randrange(len(w))
                w = rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice("abcdeÉ×") + w[k:], w[:k] + rng.choice("abcdeé") + w[k + 1 :]])
            words.append(w.upper() if rng.random() < 0.1 else w)
        docs.append((None if i % 50 == 0 else i % 290, ", ".join(words)))
    long = "ab" * 3000  # words whose counts float32 can't square
    docs += [(1000 + i, f"{long} {long[:-1]} {long[:-2]}c{long[-1]} ") for i in range(6)]
    # three steps of over five times each: abcdef < abcdeg < abcdhg < abchhg
    docs += [(2000 + i, " ".join(["abcdefzz"] * (i < 8) + ["abcdegzz"] * (i < 50) + ["abcdhgzz"] * (i < 300) + ["abchhgzz"] * 3)) for i in range(625)]
    return docs + [(500, None), (501, ""), (502, "...1234 abc"), (50, "repeated repeated"), (50, "repeated repeated"), (50, "repeatxd repeated")]


@pytest.mark.parametrize("tile", [1024, 2])
def test_variants(spark, monkeypatch, tile):
    monkeypatch.setattr(spelling, "TILE_WORDS", tile)
    docs = spelling_docs()
    df = spark.createDataFrame([(d, t, "w", "n", 1) for d, t in docs], "doc_id long, text string, word string, block string, n int").repartition(5)
    got = [tuple(r) for r in spelling.variants(df).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_variants(docs)
    roots = {w: root for w, _, root, *_ in got}
    assert roots["abcdefzz"] == "abchhgzz" and sum(r[4] for r in got) > 100
    assert spelling.variants(df.limit(0)).count() == 0


def test_blocks_meet_once():
    moves = spelling._moves()
    assert len(moves) == 22 and len({*moves, *(tuple(-x for x in m) for m in moves)}) == 43


# --- warc ---


def page_rows():
    rng = random.Random(4)
    body = "<p>" + "shared payload é " * 20 + "</p>"
    rows = [(i, f"http://h{i % 7}.example.org/p {i}?q=%20", "<html>" + "".join(rng.choice("abc é\r\n") for _ in range(rng.randrange(300)))) for i in range(300)]
    rows += [(1000 + i, "http://x.org/", body) for i in range(40)] + [(999, None, body), (None, "http://none/", body), (999, None, body)]
    rows += [(2000, "u", None), (2001, "u", ""), (2002, "not a url", "short"), (2003, "v", "short"), (2004, "v", "x" * 3_000_000), (2005, "w", "x" * 3_000_000), (None, None, None)]
    rows += [(None, "n1", "only without ids " * 20), (None, "n2", "only without ids " * 20)]
    return rows


@pytest.mark.parametrize(("records", "limit"), [(20_000, 32_000_000), (13, -1)])
def test_archives_round_trip(spark, monkeypatch, records, limit):
    monkeypatch.setattr(warc, "ARCHIVE_RECORDS", records)
    monkeypatch.setattr(warc, "LARGE_BYTES", 10**9 if limit > 0 else 5000)
    monkeypatch.setattr(warc, "RANGE_BYTES", 2000)
    monkeypatch.setattr(common, "BROADCAST_BYTES", limit)
    rows = page_rows()
    pages = spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id long, url string, html string, digest string, first int").repartition(4)
    written = warc.write_archives(pages)
    assert written.agg(F.sum("records")).first()[0] == len(rows) and written.count() >= (4 if records > 1000 else 20)
    first = {}
    for p, _, html in rows:
        if p is not None and len((html or "").encode()) >= 100:
            first[html] = min(p, first.get(html, p))
    want = collections.Counter()
    for p, _, html in rows:
        payload = (html or "").encode()
        again = html in first and (p is None or p > first[html])
        want[p, len(payload), hashlib.sha256(payload).hexdigest(), "revisit" if again else "response", first[html] if again else None] += 1
    got = collections.Counter(tuple(r) for r in warc.read_records(written).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())
    assert got == want
    back = collections.Counter((r.page_id, r.html) for r in warc.read_pages(written).collect())
    assert back == collections.Counter((p, html or "") for p, _, html in rows)
    urls = {r.page_id: r.url for r in warc.read_records(written).collect()}
    assert urls[5] == "http://h5.example.org/p%205?q=%20" and urls[999] is None


def test_archives_empty(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    written = warc.write_archives(none)
    assert written.count() == 0 and warc.read_records(written).count() == 0 and warc.read_pages(written).count() == 0


def zip_of(members, before=b"", comment=b""):
    out = io.BytesIO()
    out.write(before)
    with zipfile.ZipFile(out, "a" if before else "w") as z:
        z.comment = comment
        for name, data, method in members:
            z.writestr(zipfile.ZipInfo(name), data, compress_type=method)
    return out.getvalue()


def ranges_of(data):
    from pyarrow import BufferReader

    return archives.Ranges(BufferReader(data))


@pytest.mark.parametrize("before", [b"", b"a program before the package"])
@pytest.mark.parametrize("comment", [b"", b"with PK\x05\x06 in the comment" * 3])
@pytest.mark.parametrize("zip64", [False, True])
def test_directories(monkeypatch, before, comment, zip64):
    if zip64:
        monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 5)
        monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    members = [("archive/é.warc", b"first" * 10, 0), ("indexes/index.cdxj", b"", 0), ("packed.txt", b"x" * 1000, 8)]
    data = zip_of(members, before, comment)
    assert (archives.END64 in data) == zip64
    ranges = ranges_of(data)
    found = list(archives.members(ranges))
    assert [m.name for m in found] == [n for n, _, _ in members] and [m.method for m in found] == [0, 0, 8]
    assert ranges.read(found[0].start, found[0].size) == members[0][1]


def test_directories_beyond_32_bits():
    """An entry with all of its 64-bit values, as packages of over 4 GB have."""
    data = b"stored bytes"
    local = archives.LOCAL + struct.pack("<HHHHHIIIHH", 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, 5, 0) + b"a.bin"
    extra = struct.pack("<HHQQQ", 1, 24, len(data), len(data), 0)
    central = archives.CENTRAL + struct.pack("<HHHHHHIIIHHHHHII", 45, 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, 5, len(extra), 0, 0, 0, 0, 0xFFFFFFFF) + b"a.bin" + extra
    start = len(local) + len(data)
    end64 = archives.END64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, 1, 1, len(central), start)
    locator = archives.LOCATOR64 + struct.pack("<IQI", 0, start + len(central), 1)
    end = archives.END + struct.pack("<HHHHIIH", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    ranges = ranges_of(local + data + central + end64 + locator + end)
    (member,) = archives.members(ranges)
    assert ranges.read(member.start, member.size) == data


def test_foreign_packages():
    """Members without an index are walked; packed indexes are read; what is compressed as a whole is refused."""
    import gzip

    records = [warc._record(i, "http://a/", b"payload %d" % i, hashlib.sha256(b"payload %d" % i).hexdigest(), None, "2020-01-01T00:00:00Z") for i in range(50)]
    plain, packed = b"".join(records), b"".join(map(gzip.compress, records))
    ranges = ranges_of(zip_of([("archive/a.warc", plain, 0), ("archive/b.warc.gz", packed, 0)]))
    got = [(name, ranges.read(start, n)) for name, start, n in archives.entries(ranges)]
    assert [x for name, x in got if name.endswith("warc")] == records
    assert [gzip.decompress(x) for name, x in got if name.endswith("gz")] == records
    index = b'!meta {"format": "cdxj"}\n' + b'a)/ 2020 {"offset": "%d", "length": "%d", "filename": "a.warc"}\n' % (len(records[0]), len(records[1]))
    ranges = ranges_of(zip_of([("archive/a.warc", plain, 0), ("indexes/index.cdx.gz", gzip.compress(index), 0)]))
    assert [ranges.read(start, n) for _, start, n in archives.entries(ranges)] == [records[1]]
    with pytest.raises(ValueError, match="stored"):
        list(archives.entries(ranges_of(zip_of([("archive/a.warc", plain, 8)]))))
    for bad in (b"", b"no package", zip_of([("a", b"b", 0)])[:-5]):
        with pytest.raises(ValueError):
            list(archives.members(ranges_of(bad)))
    assert warc._parsed(records[3], True)[:3] == (3, "http://a/", "response")
    with pytest.raises(ValueError, match="damaged"):
        warc._parsed(records[3].replace(b"payload 3", b"payload 4"), False)


# --- conversations ---


def plain_repair(rows):
    """Cost and audit by a search over turns and states; rows: their symbols."""
    states = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    layer = {"": (0, "")}

    def inserts(layer):
        out = dict(layer)
        for _ in range(3):
            for s, (c, w) in list(out.items()):
                for t in states[s]:
                    if t != "s":
                        new = (c + 5, w + "I")
                        out[states[s][t]] = min(out.get(states[s][t], new), new)
        return out

    for symbol in rows:
        layer, out = inserts(layer), {}
        for s, (c, w) in layer.items():
            ways = [(s, c + 2, w + "D")]
            if symbol != "x":
                more = 5 if symbol.isupper() else 0
                if symbol.lower() in states[s]:
                    ways.append((states[s][symbol.lower()], c + more, w + "K"))
                ways += [(states[s][t], c + 1 + more, w + "R") for t in states[s] if t != "s"]
            for t, *new in ways:
                out[t] = min(out.get(t, tuple(new)), tuple(new))
        layer = out
    return min(v for s, v in inserts(layer).items() if s in ("", "a"))


def all_repairs(rows):
    """Every sequence of edits with at most two inserts at a place, for a few rows."""
    pattern = re.compile("(s?(ua)+)?")
    found = []
    options = []
    for symbol in rows:
        edits = [("D", 2, "")]
        if symbol != "x":
            more = 5 if symbol.isupper() else 0
            edits += [("R", 1 + more, "u"), ("R", 1 + more, "a")] + [("K", more, symbol.lower())]
        options.append(edits)
    gaps = ["", "u", "a", "ua", "au"]
    for edits in itertools.product(*options):
        for ins in itertools.product(gaps, repeat=len(rows) + 1):
            roles = ins[0] + "".join(e[2] + g for e, g in zip(edits, ins[1:], strict=True))
            if pattern.fullmatch(roles):
                audit = "I" * len(ins[0]) + "".join(e[0] + "I" * len(g) for e, g in zip(edits, ins[1:], strict=True))
                found.append((sum(e[1] for e in edits) + 5 * sum(map(len, ins)), audit))
    return min(found)


def by_grammar(rules, sequences):
    out = []
    for m in rules.matrices(sequences):
        out.append(grammar.finish(grammar.times(grammar.UNCHANGED[:4] + [None] * 12, m)[:4]))
    return out


def test_grammar_equals_every_repair():
    sequences = ["".join(q) for n in range(3) for q in itertools.product("xsuaoSUAO", repeat=n)]
    rng = random.Random(8)
    sequences += ["".join(rng.choice("xsuaoSUAO") for _ in range(3)) for _ in range(60)]
    want = [all_repairs(q) for q in sequences]
    assert [plain_repair(q) for q in sequences] == want
    assert by_grammar(grammar.Grammar(), sequences) == want


def test_grammar_equals_search():
    rng = random.Random(9)
    sequences = ["".join(rng.choice("xsuaoSUAO" if k % 2 else "uauauauauUxa") for _ in range(rng.randrange(40))) for k in range(300)] + ["u" * 37, "a" * 64, "ua" * 300, "au" * 301, "o" * 200]
    sequences.append("".join(rng.choice("xsuaoSUAO") for _ in range(5000)))
    rules = grammar.Grammar()
    assert by_grammar(rules, sequences) == [plain_repair(q) for q in sequences]
    assert len(rules) > 50
    for q, symbols in zip(sequences, rules.compressed(sequences), strict=True):
        parts = {v: k for k, v in rules._rules.items()}

        def expand(x):
            return expand(parts[x][0]) + expand(parts[x][1]) if x in parts else grammar.SYMBOLS[x]

        assert "".join(map(expand, symbols)) == q
    assert len(rules.compressed(["ua" * 300])[0]) < 20


def test_ropes():
    rng = random.Random(10)
    for _ in range(300):
        made = []
        for _ in range(2):
            rope, text = grammar.leaf(""), ""
            for _ in range(rng.randrange(6)):
                part = "".join(rng.choice("DK") for _ in range(rng.randrange(4)))
                left = rng.random() < 0.5
                rope, text = (grammar.joined(grammar.leaf(part), rope), part + text) if left else (grammar.joined(rope, grammar.leaf(part)), text + part)
            made.append((rope, text))
        (a, ta), (b, tb) = made
        assert grammar.text_of(a) == ta and grammar.before(a, b) == (ta < tb)


def plain_conversations(rows):
    shown = lambda x: " " if x is None else str(x)
    by_conv = {c: [] for c, *_ in rows}
    for c, turn, role, text in rows:
        h = zlib.crc32(f"{shown(c)}:{shown(turn)}".encode()) % 20
        role, text = shown(role), shown(text)
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        by_conv[c] += [] if h == 0 else [(turn, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
    out = {}
    for c, turns in by_conv.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], hashlib.md5(t[2].encode()).hexdigest()))
        known = {t for t, _, _ in turns} - {None}
        n, seen, symbols = collections.Counter(), set(), ""
        for _, role, text in turns:
            stripped = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not stripped else "duplicate" if (role, text) in seen else "truncated" if stripped[-1] not in ".!?" else ""
            seen.add((role, text))
            n[fault] += 1
            initial = role[:1] if role[:1] in set("sua") else "o"
            symbols += "x" if fault in ("blank", "duplicate") else initial.upper() if fault else initial
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(turns))
        cost, audit = plain_repair(symbols)
        lines, at, last = [], iter(turns), ""
        for edit in audit:
            role, text = ("", "") if edit == "I" else next(at)[1:]
            if edit != "D":
                role = role if edit == "K" else "assistant" if last == "u" else "user"
                last = role[0]
                lines.append(f"{role}:{text}")
        gaps = max(known) - min(known) + 1 - len(known) if known else 0
        out[c] = (gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def conversation_rows():
    rng = random.Random(12)
    texts = ["Yes.", "No!", "Why?", "cut off", "", " \t", "Ends with space. \n", "é.", None, "a.b.c", "end "]
    rows = []
    for c in [*range(150), None]:
        for turn in range(rng.randrange(9)):
            role = rng.choice(["user", "assistant"] * 6 + ["system", "tool", "", None]) if rng.random() < 0.5 else ("user", "assistant")[turn % 2]
            rows.append((c, rng.choice([turn] * 9 + [turn * 3, None]), role, rng.choice(texts) if rng.random() < 0.4 else f"turn {rng.random()}."))
    rows += [(900, t, ("user", "assistant")[t % 2], f"Long {t % 700}.") for t in range(3000)]  # repeats far apart
    rows += [(901, 7, "user", "same.")] * 50
    return rows + rng.sample(rows, 40)


@pytest.mark.parametrize(("piece", "limit"), [(65_536, 32_000_000), (7, -1)])
def test_conversations(spark, monkeypatch, piece, limit):
    monkeypatch.setattr(conversations, "PIECE_TURNS", piece)
    monkeypatch.setattr(common, "BROADCAST_BYTES", limit)
    rows = [(*r, "x", 1) for r in conversation_rows()]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, fault string, n int").repartition(3)
    reader = SimpleNamespace(parquet=lambda path: df)
    got = queries.QUERIES["op11_conversation_repair"](SimpleNamespace(read=reader), "given")
    want = plain_conversations(conversation_rows())
    found = {r.conv_id: tuple(r)[1:] for r in got.collect()}
    assert found.keys() == want.keys()
    assert {c: v for c, v in found.items() if v != want[c]} == {}


def test_conversations_of_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r.conv_id: tuple(r)[1:] for r in queries.QUERIES["op11_conversation_repair"](spark, SMALL).collect()}
    assert got == plain_conversations(rows)


def test_conversations_empty(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    audits = conversations.audits(conversations.damaged(none))
    assert audits.count() == 0 and conversations.digests(conversations.repaired(none, audits)).count() == 0


# --- secrets ---


def test_signed_tokens_are_those_of_the_pattern():
    rng = random.Random(13)
    pattern = secrets.KINDS["jwt"][0]
    for _ in range(3000):
        text = "".join(rng.choice(["eyJ", "eyJ", ".", ".", "a", "-", " ", "é", "eyJab.eyJcd.x"]) for _ in range(rng.randrange(25)))
        assert list(secrets._signed_tokens(text)) == [m.span() for m in pattern.finditer(text)], text


@pytest.mark.parametrize("piece", ["eyJ", "eyJa.", "eyJa.eyJb.", "token ", "token=", "AKIA", "0a", "ghp_", "xoxb-", "-----BEGIN ", "-----BEGIN PRIVATE KEY-----", "-----BEGIN PRIVATE KEY-----a ", "secret" + " " * 50, "A ", "-"])
def test_a_megabyte_of_any_start_is_scanned_in_time(piece):
    import time

    text = piece * (1_000_000 // len(piece))
    began = time.perf_counter()
    secrets.find_spans(text)
    assert time.perf_counter() - began < 5


def test_ids_are_decoded_by_columns():
    """Slices, nulls, empty rows and rows beyond the bound; a null id or an unknown one fails."""
    import numpy as np
    import pyarrow as pa

    from opstables.llm import bpe

    rows = [[1, 2], None, [], [3] * 7, [0, 3], []]
    table = [b"a", b"bc", "ä".encode(), b""]
    column = pa.array([[0], *rows, [1]], pa.list_(pa.int32())).slice(1, len(rows))
    got = bpe._decoded(column, pa.array(table, pa.large_binary()), np.zeros(4, bool))
    assert got.to_pylist() == [None if x is None else b"".join(table[i] for i in x) for x in rows] and got.type == pa.binary()
    assert bpe._decoded(column.slice(1, 2), pa.array(table, pa.large_binary()), np.zeros(4, bool)).to_pylist() == [None, b""]
    batch = pa.RecordBatch.from_arrays([column], names=["ids"])
    assert [(at, len(part)) for at, part in bpe._bounded(batch, 5)] == [(0, 3), (3, 1), (4, 2)]
    for wrong in ([None], [7], [2]):
        with pytest.raises((ValueError, IndexError)):
            bpe._decoded(pa.array([wrong], pa.list_(pa.int32())), pa.array(table, pa.large_binary()), np.array([False, False, True, False]))


def test_words_are_found_and_hashed_by_columns(monkeypatch):
    """As bytes.split() gives them: every white space, empty texts, zeros, words of every length up to and over the bound; equal hashes for equal words only."""
    from opstables.llm import substrings

    rng = random.Random(5)
    alphabet = ["a", "b", "ä", "\0", " ", "\u0085", "語"]
    words = ["".join(rng.choices(alphabet, k=rng.choice([1, 2, 3, 7, 8, 9, 15, 16, 17, 40]))) for _ in range(300)] + ["x" * n for n in range(1, 300)] + ["a\0", "a", "a\0\0"]
    texts = ["", " \t", *("".join(w + rng.choice([" ", "\t", "\n\n", "\x0b", "\x0c", "\r"]) for w in rng.choices(words, k=200)) for _ in range(20)), "end", ""]
    raw = [t.encode() for t in texts]
    w = substrings.Words(raw)
    split = [x for t in raw for x in t.split()]
    assert w.size.tolist() == [len(t.split()) for t in raw] and w.doc.tolist() == [i for i, t in enumerate(raw) for _ in t.split()]
    assert len(set(zip(split, w.hash.tolist(), strict=True))) == len(set(split)) == len(set(w.hash.tolist()))
    assert len(substrings.Words([]).hash) == 0 and len(substrings.Words([b""]).hash) == 0
    calls = []
    monkeypatch.setattr(substrings.xxhash, "xxh64_intdigest", lambda b: calls.append(b) or 0)
    substrings.Words([b"short words " * 100 + b"y" * 300])
    assert calls == [b"y" * 300]  # only long ones are hashed one by one


def test_cuts_change_no_match():
    import regex
    from opstables.llm import bpe

    split, cuts = regex.compile(bpe.SPACED), bpe.Cuts(bpe.SPACED)
    rng = random.Random(13)
    parts = [" ", " ", "\n", "\t", "\r", "\x1c", "\x85", "\xa0", "\u2003", "\u3000", "a", "Zz", "\xe9", "\u4e2d", "7", "\xbd", "'s", "'", ".", ",", "!?", "\u0301", "\U0001f600", "\x00"]
    texts = ["", " ", "  ", " a", "a ", "a b  c\n d \ne", *("".join(rng.choices(parts, k=rng.randrange(1, 12))) for _ in range(20_000))]
    for text in texts:
        assert [w for p in cuts.pieces(text) for w in cuts.words(p)] == split.findall(text), repr(text)
    # the rules about single characters hold for every one
    for c in map(chr, itertools.chain(range(0xD800), range(0xE000, 0x110000))):
        text = f"x {c} {c}. q{c}"
        assert [w for p in cuts.pieces(text) for w in cuts.words(p)] == split.findall(text), hex(ord(c))
    other = bpe.Cuts(r"\w+|\W")
    assert [w for p in other.pieces("a b  c") for w in other.words(p)] == ["a", " ", "b", " ", " ", "c"]


@pytest.mark.parametrize("remembered", [3, 400_000])
def test_the_pattern_goes_over_a_piece_once(monkeypatch, remembered):
    import pyarrow as pa
    from opstables.llm import bpe

    ranks = {bytes([b]): b for b in range(256)} | {b" a": 256, b"bc": 257, b" abc": 258, b"aa": 300}
    texts = ["abc abc, aaaa\n x", "", " abc abc,  abc's", None, "aaaaaaa abc, q"] * 50
    batch = pa.RecordBatch.from_pylist([{"doc_id": i, "text": t or ""} for i, t in enumerate(texts)], pa.schema([("doc_id", pa.int64()), ("text", pa.string())]))
    want = [r for b in bpe._encode(iter([batch]), ranks, f"(?:{bpe.SPACED})", ([], bpe.np.zeros(0, bpe.np.int32), bpe.np.zeros(1, bpe.np.int64))) for r in b.to_pylist()]
    monkeypatch.setattr(bpe, "REMEMBERED_PIECES", remembered)
    seen, findall = [], bpe.Cuts._words
    monkeypatch.setattr(bpe.Cuts, "_words", lambda self, piece: seen.append(piece) or findall(self, piece))
    got = [r for b in bpe._encode(iter([batch]), ranks, bpe.SPACED, ([], bpe.np.zeros(0, bpe.np.int32), bpe.np.zeros(1, bpe.np.int64))) for r in b.to_pylist()]
    assert got == want and len(got) == len(texts)
    assert len(seen) == len(set(seen)) < 20


def test_a_band_of_ranks_is_one_step(monkeypatch):
    from opstables.llm import bpe

    rng = random.Random(14)
    ranks = {bytes([b]): b for b in range(256)}
    while len(ranks) < 900:
        a, b = rng.choice(list(ranks)[97:99] + list(ranks)[256:] or [b"a"]), rng.choice(list(ranks)[97:100])
        if len(a + b) < 8:
            ranks.setdefault(a + b, len(ranks))
        ranks.setdefault(bytes(rng.choices(b"abcd", k=rng.randrange(2, 6))), len(ranks))
    words = sorted({bytes(rng.choices(b"abcd", k=rng.randrange(1, 40))) for _ in range(400)} | {b"a" * 5_000, b"ab" * 3_000})
    steps, heappop = [], bpe.heapq.heappop
    monkeypatch.setattr(bpe.heapq, "heappop", lambda queue: steps.append(1) or heappop(queue))
    got, n = {}, {}
    for band in (1, 64, 4096):
        monkeypatch.setattr(bpe, "BAND", band)
        steps.clear()
        got[band], n[band] = bpe.Merges(ranks).encode(words), len(steps)
    assert got[1] == got[64] == got[4096] and n[64] < n[1]


def test_ids_are_decoded_where_they_are_made(spark):
    from opstables.llm import bpe

    ranks = {bytes([b]): b for b in range(256)} | {b" a": 256, b"bc": 257}
    docs = spark.createDataFrame([(1, "abc  bc\n\xe9"), (2, None), (3, "")], "doc_id long, text string")
    found = bpe.round_trip(docs, ranks, bpe.SPACED)
    assert sorted(found.collect()) == sorted(bpe.decode(bpe.encode(docs, ranks, bpe.SPACED), ranks).collect())
    assert {r.doc_id: bytes(r.decoded).decode() for r in found.collect()} == {1: "abc  bc\n\xe9", 2: "", 3: ""}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
