"""Merkle proofs, the filter audit and De Bruijn spans against brute force, on small and awkward tables."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sitegauge.llm import audit, debruijn, merkle
from sitegauge.llm.queries import QUERIES

#: Columns beyond those of the table have names that the operators use themselves.
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, tree string, at long, n long, digest string, keep long, level int, part string, E boolean, copy long, doc long, spans string, sum long, __row long"
EXTRA = ("x", 1, 2, "y", 3, 4, "z", True, 5, 6, "s", 7, 8)


def rows():
    """Null and empty texts, ties, repeated rows, null ids, null and empty languages, long texts, shared passages."""
    rng = random.Random(4)
    word = lambda: rng.choice(["alpha", "Beta", "gamma", "Ünï", "漢字", "d-e", "f"]) + str(rng.randrange(40))
    passage = " ".join(word() for _ in range(60))
    own = lambda n: " ".join(word() for _ in range(n))
    texts = [
        None, "", "   ", "one", own(12), own(13), passage, f"{own(20)} {passage} {own(5)}", f"{passage}\n\n{passage}", passage.upper(), " ".join(passage.split()[10:40]),
        " ".join(passage.split()[5:30] + ["x"] + passage.split()[30:]), "la " * 400, "la " * 90, "ab cd " * 60, "cd ab " * 60, own(3000), passage, passage, "A B C D #", "a b c " * 50, None, "",
    ]
    out = [(k * 3 % 23, t, ("en", None, "", "de")[k % 4], (None, "s")[k % 2], None if k % 5 == 0 else len(t or "")) for k, t in enumerate(texts)]
    out += [out[6], (4, passage + " tail", "en", "s", 9), (None, passage, "fr", None, 1), (None, None, None, None, None), (50, own(40) + " " + out[16][1][:900], "en", "s", 7)]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, *EXTRA) for r in rows()], COLUMNS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(0, 1, 0, 9), (3, 0, 1, 9), (6, 1, 1, 9), (6, 0, 0, 9), (None, 1, 1, 9), (9, None, None, 9), (99, 1, 1, 9)], "doc_id long, quality int, toxic int, good int")


# 11 -----------------------------------------------------------------------------------------------

def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    doc_id, text, lang, source, n_chars = row
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def tree(nodes):
    """The last node and, for each first node, its siblings with their side (None: hashed alone)."""
    paths, groups = [[] for _ in nodes], [[k] for k in range(len(nodes))]
    while len(nodes) > 1:
        for k, members in enumerate(groups):
            other = k ^ 1
            for m in members:
                paths[m].append((nodes[other], other < k) if other < len(nodes) else None)
        nodes = [sha("".join(nodes[k : k + 2])) for k in range(0, len(nodes), 2)]
        groups = [sum(groups[k : k + 2], []) for k in range(0, len(groups), 2)]
    return nodes[0], paths


def manifest(table):
    by_lang = defaultdict(list)
    for r in table:
        by_lang[r[2]].append(r)
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    ordered = {x: sorted(by_lang[x], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for x in langs}
    subs = {x: tree([leaf(r) for r in ordered[x]]) for x in langs}
    root, above = tree([subs[x][0] for x in langs])
    out = []
    for k, x in enumerate(langs):
        for r, path in zip(ordered[x], subs[x][1], strict=True):
            path = [*path, *above[k]]
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[4] is not None
            node = leaf((*r[:4], r[4] + 1)) if changed else leaf(r)
            for step in path:
                node = sha(node) if step is None else sha(step[0] + node if step[1] else node + step[0])
            out.append((r[0], leaf(r), subs[x][0], root, sha("".join(s[0] for s in path if s)), node, node == root))
    return sorted(map(repr, out))


def proofs_of(df):
    fields = [F.col(f) + 1 if f == "n_chars" else F.col(f) for f in merkle.FIELDS]
    tampered = F.when(F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False)), merkle.leaf(fields))
    found = merkle.proofs(df, "lang", ["doc_id"], merkle.FIELDS, F.struct("doc_id", tampered.alias("tampered")))
    end = merkle.folded(F.coalesce("keep.tampered", "leaf"), F.col("proof"), F.col("bits"))
    found = found.select("keep.doc_id", "leaf", "subroot", "root", F.sha2(F.array_join("proof", ""), 256), end.alias("end"), (end == F.col("root")).alias("ok"))
    return sorted(repr(tuple(r)) for r in found.collect())


def test_merkle_is_brute_force(docs, empty):
    assert proofs_of(docs) == manifest(rows())
    assert proofs_of(empty) == []


@pytest.mark.parametrize("sizes", [(1,), (2,), (1, 1, 1), (5, 1), (1030, 3, 512)])
def test_merkle_shapes(spark, sizes):
    """One row, one language, low trees beside one that needs a second round of blocks."""
    table = [(1000 * g + k, f"t{k}", f"l{g}", "s", k) for g, n in enumerate(sizes) for k in range(n)]
    assert proofs_of(spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long")) == manifest(table)


def test_merkle_without_broadcast(docs, monkeypatch):
    monkeypatch.setattr(merkle, "BROADCAST_BYTES", 0)
    assert proofs_of(docs) == manifest(rows())


# 12 -----------------------------------------------------------------------------------------------

def test_gallop_and_merge():
    rng = random.Random(2)
    for _ in range(200):
        lists = [sorted(rng.sample(range(60), rng.randrange(40))) for _ in range(rng.randrange(1, 6))]
        counts = audit.merged(lists)
        for mask in range(1, 1 << len(lists)):
            held = [x for x in range(60) if all((x in ids) == bool(mask >> k & 1) for k, ids in enumerate(lists))]
            assert counts[mask] == len(held)
        ids, start = lists[0], rng.randrange(len(lists[0]) + 1)
        for limit in range(-1, 62):
            assert audit.gallop(ids, start, limit) == next((k for k in range(start, len(ids)) if ids[k] >= limit), len(ids))


def judged(table, marks):
    least = {}
    for r in table:
        if r[0] is not None:
            least[r[1] or ""] = min(least.get(r[1] or "", r[0]), r[0])
    for doc_id, text, lang, *_ in table:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        copy = text in least and (doc_id is None or doc_id > least[text])
        fails = "".join(f for f, bad in zip("ABCDE", (
            len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), bool(re.search(r"[#$%&*|]", text)), copy), strict=True) if bad)
        mine = [m for m in marks if m[0] is not None and m[0] == doc_id]
        yield lang or "", fails, any(m[1] == 1 for m in mine), any(m[2] == 1 for m in mine)


def audited(table, marks):
    known, out = list(judged(table, marks)), []
    for part in {k[0] for k in known}:
        mine, shares, lines = [k for k in known if k[0] == part], defaultdict(int), []
        for order in itertools.permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [k for k in left if f in k[1]]
                left = [k for k in left if f not in k[1]]
                shares[f] += len(gone)
                lines.append((part, "".join(order), step, len(left), len(gone), sum(f in k[1] for k in mine) - len(gone), sum(k[1] == f for k in mine), sum(k[2] for k in gone), sum(k[3] for k in gone)))
        out += [(*line, shares[line[1][line[2] - 1]]) for line in lines]
    return sorted(out)


@pytest.mark.parametrize("range_rows", [audit.RANGE_ROWS, 2])
def test_audit_is_brute_force(docs, empty, labels, monkeypatch, range_rows):
    monkeypatch.setattr(audit, "RANGE_ROWS", range_rows)
    got = audit.audit(docs, labels).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    assert sorted(map(tuple, got.collect())) == audited(rows(), [tuple(r) for r in labels.collect()])
    assert audit.audit(empty, labels).count() == 0
    assert audit.audit(docs, labels.limit(0)).where("good_lost + toxic_lost > 0").count() == 0


def test_postings_are_sorted_lists(docs, labels):
    flags = [*audit.FILTERS, *audit.MARKS]
    known = audit.judged(docs, labels)
    lists = audit.postings(known, flags).collect()
    for f in flags:
        assert sum(len(r[f]) for r in lists) == known.where(f).count()
        assert all(r[f] == sorted(set(r[f])) for r in lists)
    assert sum(r.n for r in lists) == len(rows())


# 13 -----------------------------------------------------------------------------------------------

def windows_of(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return words, [tuple(words[k : k + 13]) for k in range(len(words) - 12)]


def deduplicated(table):
    least, out = {}, []
    for r in table:
        if r[0] is not None:
            for w in windows_of(r[1])[1]:
                least[w] = min(least.get(w, r[0]), r[0])
    for r in table:
        words, windows = windows_of(r[1])
        gone = {p for k, w in enumerate(windows) if w in least and (r[0] is None or least[w] < r[0]) for p in range(k, k + 13)}
        out.append((r[0], len(words), len(gone), " ".join(w for k, w in enumerate(words) if k not in gone), 0))
    return sorted(map(repr, out))


def test_spans_are_brute_force(docs, empty):
    assert sorted(repr(tuple(r)) for r in debruijn.deduplicated(docs).drop("n_paths").collect()) == deduplicated(rows())
    assert debruijn.deduplicated(empty).count() == 0


def test_spans_of_random_graphs(spark):
    """Few words, so that paths branch, close to rings and overlap at every place."""
    rng = random.Random(8)
    bits = [" ".join(rng.choice("ab") for _ in range(rng.choice((13, 30)))) for _ in range(6)]
    table = [(k, " ".join(rng.choice(bits) for _ in range(rng.randrange(1, 6)))) for k in range(40)]
    df = spark.createDataFrame(table, "doc_id long, text string")
    assert sorted(repr(tuple(r)) for r in debruijn.deduplicated(df).drop("n_paths").collect()) == deduplicated(table)


def test_units_cover_every_window_once():
    rng = np.random.default_rng(3)
    hashes = rng.integers(0, 50, 4000).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    first = np.array([0, 5, 5, 17, 30, 30, 1200, 4000])
    text, start, windows, seeds, keys = debruijn.units(hashes, first)
    covered = [(t, s + k) for t, s, n in zip(text.tolist(), start.tolist(), windows.tolist(), strict=True) for k in range(n)]
    assert covered == [(t, k) for t in range(7) for k in range(first[t + 1] - first[t] - 12)]
    spelled = {}
    for t, s, n, key in zip(text.tolist(), start.tolist(), windows.tolist(), keys.tolist(), strict=True):
        words = tuple(hashes[first[t] + s : first[t] + s + n + 12].tolist())
        assert spelled.setdefault(key, words) == words


def test_paths_are_compacted(spark):
    """A passage is one path from end to end, and every place that repeats it is a span along it."""
    words = [f"w{k}" for k in range(80)]
    table = [(1, "x " + " ".join(words) + " y"), (2, " ".join(words)), (3, "z " + " ".join(words[20:60]) + " v"), (None, " ".join(words[:30])), (9, "q " * 3 + " ".join(words[40:]))]
    df = spark.createDataFrame(table, "doc_id long, text string")
    rows, unique = debruijn._prepared(df)
    _, distinct, _, edges = debruijn.repeated(rows, unique)
    found = debruijn.compacted(debruijn.segments_of(distinct, edges)).collect()
    assert sum(e.windows for e in found) == 68 and {(e.path_doc, e.path_pos) for e in found} == {(1, 1)}
    places = sorted((e.path_at, e.windows) for e in found)
    assert places[0][0] == 0 and all(a + n == b for (a, n), (b, _) in itertools.pairwise(places))
    spans = {(r.doc, r.start, r.words): (r.source_doc, r.source_start, r.path_at) for r in debruijn.spans(df).collect()}
    assert spans == {(2, 0, 80): (1, 1, 0), (3, 1, 40): (1, 21, 20), (debruijn.LAST, 0, 30): (1, 1, 0), (9, 3, 40): (1, 41, 40)}
    assert {r.doc_id: r.n_paths for r in debruijn.deduplicated(df).collect()} == {1: 0, 2: 1, 3: 1, None: 1, 9: 1}


def test_pieces_of_several_sources_are_one_path(spark):
    """The middle stands first in another document than the ends: three pieces, chained by their nodes."""
    words = [f"w{k}" for k in range(100)]
    table = [(1, " ".join(words[:40])), (2, " ".join(words[20:70])), (3, " ".join(words[50:])), (4, " ".join(words)), (5, "a " + " ".join(words))]
    rows, unique = debruijn._prepared(spark.createDataFrame(table, "doc_id long, text string"))
    _, distinct, _, edges = debruijn.repeated(rows, unique)
    found = debruijn.compacted(debruijn.segments_of(distinct, edges)).collect()
    assert sum(e.windows for e in found) == 88 and {(e.path_doc, e.path_pos) for e in found} == {(1, 0)}
    places = sorted((e.path_at, e.windows) for e in found)
    assert places[0][0] == 0 and all(a + n == b for (a, n), (b, _) in itertools.pairwise(places))


def test_units_with_other_words_are_refused():
    unit = lambda digest: [{"start": 0, "windows": 2, "digest": digest, "found": [{"k": 1, "n": 1}]}]
    kind = pa.list_(pa.struct([("start", pa.int64()), ("windows", pa.int64()), ("digest", pa.binary()), ("found", pa.list_(pa.struct([("k", pa.int32()), ("n", pa.int32())])))]))
    words = " ".join(map(str, range(16)))
    right = hashlib.blake2b(" ".join(map(str, range(14))).encode(), digest_size=8).digest()
    batch = pa.record_batch({"doc_id": pa.array([1, 2]), "text": pa.array([words, words.replace(" ", "  ")]), "units": pa.array([unit(b"?"), unit(right)], kind), "n_paths": pa.array([1, 1], pa.int64())})
    out = next(debruijn._stripped(iter([batch])))
    assert out.column("kept_text").to_pylist() == [words, "0 14 15"] and out.column("n_refused").to_pylist() == [1, 0]


@pytest.mark.parametrize("name", ["op11_merkle_proofs", "op12_filter_audit", "op13_debruijn_spans"])
def test_columns(spark, name):
    assert QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
