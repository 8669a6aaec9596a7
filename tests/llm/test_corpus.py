"""Corpus operators against brute force, exact round trips and held-out labels, on small and awkward tables."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from sitegauge.llm import ctw, decontam, langid, minhash, mix, pii, telephony, token_blocks, toxicity, warc
from sitegauge.llm.common import utf8
from sitegauge.llm.queries import QUERIES
from sitegauge.llm.words import LETTERED, SPACED, word_bounds, word_hashes
from sitegauge.session import shared_scratch

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
#: Columns beyond those of the table, with names that operators use themselves.
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, node long, size long, score double, band string"


def awkward():
    """Null and empty texts, ties, repeated rows, a null id, signs of several bytes, a long text."""
    base = "the cat sat on the mat and then it went away to see the world outside"
    texts = [None, "", "   ", "One", base, base, base + " again", "Ünïcode ß – “quoted” 漢字 \U0001f600 x", "a b\x1cc  d \n e", "word " * 3000, base.upper(), base]
    rows = [(k, t, ("en", None)[k % 2], ("a", "b", None)[k % 3], len(t or ""), 1, 2, 3.0, "x") for k, t in enumerate(texts)]
    return [*rows, rows[4], (None, base, "en", "a", 5, 1, 2, 3.0, "x")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(awkward(), COLUMNS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


def lower(text):
    return (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def spaced(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(text))


def lettered(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def test_words_match_patterns():
    texts = [t for _, t, *_ in awkward()]
    data, offsets = utf8(pa.array(texts, pa.string()))
    for kind, split in ((SPACED, spaced), (LETTERED, lettered)):
        starts, ends, first = word_bounds(data, offsets, kind)
        raw = data.tobytes()
        hashes, by_word = word_hashes(data, starts, ends).tolist(), {}
        for k, t in enumerate(texts):
            words = split(t)
            assert [lower(raw[a:b].decode()) for a, b in zip(starts[first[k] : first[k + 1]], ends[first[k] : first[k + 1]], strict=True)] == words
            for w, h in zip(words, hashes[first[k] : first[k + 1]], strict=True):
                assert by_word.setdefault(w, h) == h
        assert len(set(by_word.values())) == len(by_word)


# 1 ------------------------------------------------------------------------------------------------

PII_TEXTS = [
    "a@b.c_d@e.f, x.y+z@mail-1.example.com. @no.com me@host", "1.2.3.4.5.6.7.8 999.1.1.1 0010.020.030.0040 1.2.3", "4539 1488 0343 6467 and 4539-1488-0343-6468, 4539148803436467",
    "+1 (017) 555-7713, +49 30 1234567 +12 +", "card 4 5 3 9 1 4 8 8 0 3 4 3 6 4 6 7 8 tel (555) 123-4567", "John Smith at x [at] host [dot] com", "@" * 50 + "+" * 50 + "9" * 400,
]


def base_by_pattern(text):
    text, out = text or "", []
    out += [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 16 <= len(d) <= 19 and sum(x if k % 2 == 0 else x * 2 - 9 * (x > 4) for k, x in enumerate(d)) % 10 == 0:
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def test_pii_base_spans():
    for text in [*PII_TEXTS, *(t or "" for _, t, *_ in awkward())]:
        assert [(pii.KINDS[k], a, b) for k, a, b in pii.base_spans(text)] == base_by_pattern(text), text


def test_pii_query(spark):
    got = {r.doc_id: r for r in QUERIES["op1_weak_supervision_pii"](spark, SMALL).collect()}
    for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect():
        spans = base_by_pattern(r.text)
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        row = got[r.doc_id]
        assert row.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [sum(s[0] == k for s in spans) for k in pii.KINDS[:4]]
        assert set(filter(None, listed.split(","))) <= set(row.spans.split(","))


def test_pii_adds_supported_spans(spark, docs, empty):
    texts = [f"my name is {a} {b}, call (555) 12{k}-4567 or +1 (212) 555-01{k}{k}" for k, (a, b) in enumerate(itertools.product(("John", "Mary"), ("Stone", "Rivers")))] * 5
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = pii.detect(rows).collect()
    assert all(any(s.kind == "name" and not s.base for s in r.spans) and sum(s.base for s in r.spans) == 1 for r in found)
    for r in found:
        spans = sorted((s.start, s.stop) for s in r.spans)
        assert all(a[1] <= b[0] for a, b in itertools.pairwise(spans))
    assert pii.detect(docs).count() == len(awkward())
    assert pii.detect(empty).count() == 0


def test_reliabilities_find_the_bad_labeler():
    rng = np.random.default_rng(1)
    truth = rng.random(4000) < 0.4
    right = (0.95, 0.9, 0.9, 0.85, 0.5)
    votes = np.stack([np.where(rng.random(4000) < p, np.where(truth, 1, 2), np.where(truth, 2, 1)) for p in right], axis=1)
    p, table = pii.reliabilities(votes, np.ones(4000))
    assert ((p > 0.5) == truth).mean() > 0.97
    assert table[1, 0, 1] > 0.9 and abs(table[1, 4, 1] - 0.5) < 0.06


# 2 ------------------------------------------------------------------------------------------------

def test_warc_round_trip(spark):
    fake = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    long = "x" * 150
    pages = [(1, "u1", "a" + fake * 3 + "tail"), (2, "u\r\n2", long), (3, None, long), (4, "u", ""), (5, "u", None), (6, "u", "short"), (7, "u", "short"), (8, "u", "é" * 80 + "\r\n\r\n"), (None, "u", long), (2, "u", long)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("digest", F.lit(1))
    path = f"{shared_scratch(spark)}/warc"
    warc.write(df, path)
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read(spark, path).collect()]
    want = []
    for i, _, h in pages:
        raw = (h or "").encode()
        ref = 2 if h == long and i != 2 else None
        want.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if ref else "response", ref))
    assert sorted(got, key=str) == sorted(want, key=str)
    assert warc.candidates(spark, path).count() > len(pages)


def test_warc_empty(spark):
    path = f"{shared_scratch(spark)}/warc"
    warc.write(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read(spark, path).count() == 0


def test_warc_long_urls(spark):
    """Heads above 64 KiB are found, a URL that ends like a magic is none, and the pages behind them stay."""
    urls = ["http://a/1", "http://a/" + "x" * 70_000, "http://a/?WARC/1.1", "http://a/" + "é" * 200_000, "http://a/5"]
    path = f"{shared_scratch(spark)}/warc"
    warc.write(spark.createDataFrame([(k, u, f"page {k} " * 20) for k, u in enumerate(urls)], "page_id long, url string, html string").coalesce(1), path)
    assert sorted((r.page_id, r.url) for r in warc.read(spark, path).collect()) == list(enumerate(urls))


def test_warc_broken_chain(spark, tmp_path):
    path = f"{shared_scratch(spark)}/warc"
    warc.write(spark.createDataFrame([(k, "http://a", f"page {k} " * 20) for k in range(9)], "page_id long, url string, html string").coalesce(1), path)
    whole = spark.read.format("binaryFile").load(path).first().content
    at = [m.start() for m in re.finditer(rb"WARC/1\.1\r\n", whole)]
    for name, content in (("cut", whole[:-9]), ("middle", whole[: at[4]] + b"X" + whole[at[4] + 1 :]), ("first", b"X" + whole[1:])):
        (tmp_path / name).mkdir()
        (tmp_path / name / "part-0").write_bytes(content)
        with pytest.raises(ValueError, match="followed to the end"):
            warc.read(spark, str(tmp_path / name))


# 3 ------------------------------------------------------------------------------------------------

def test_blocks_round_trip():
    rng = np.random.default_rng(3)
    for n in (0, 1, 127, 128, 129, 1000):
        for top in (1, 2, 300, 65536):
            ids = np.where(rng.random(n) < 0.05, 65535, rng.integers(0, top, n)).astype("<u2")
            starts, body = token_blocks.pack(ids)
            raw = np.frombuffer(body, np.uint8)
            assert (token_blocks.unpack(starts, raw).reshape(-1)[:n] == ids).all()
            if len(starts):
                last = token_blocks.unpack(starts, raw, np.array([len(starts) - 1]))[0]
                assert (last[: n - 128 * (len(starts) - 1)] == ids[128 * (len(starts) - 1) :]).all()


def test_memo_gives_the_tokenizers_ids():
    direct = Tokenizer.from_file(VOCABULARY)
    texts = [t or "" for _, t, *_ in awkward()] + PII_TEXTS + [" lead", "trail ", "  two  spaces\t\n x", "don't 'll we'll.", "x—, y…. (z)   em", "a  \n  b .. c"]
    for _ in range(2):  # the second time from the memo
        got = token_blocks.encoder(VOCABULARY).ids(texts)
        assert [np.frombuffer(g, "<u2").tolist() for g in got] == [direct.encode(t, add_special_tokens=False).ids for t in texts]


def test_token_files(docs, empty):
    got = token_blocks.digests(docs, VOCABULARY).collect()
    direct = Tokenizer.from_file(VOCABULARY)
    want = Counter()
    for i, t, *_ in awkward():
        ids = [*direct.encode(t or "", add_special_tokens=False).ids, 0]
        want[i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    ordered = sorted(got, key=lambda r: r.start)
    assert [r.start for r in ordered] == list(itertools.accumulate([0, *(r.n_tokens for r in ordered[:-1])]))
    assert [r.doc_id for r in ordered] == sorted((r.doc_id for r in got), key=lambda i: (i is not None, i))
    assert token_blocks.digests(empty, VOCABULARY).count() == 0


# 4 ------------------------------------------------------------------------------------------------

def test_knapsack_is_exact():
    rng = np.random.default_rng(4)
    for _ in range(60):
        lengths = np.sort(rng.choice(np.arange(1, 30), 5, replace=False))
        counts = rng.integers(1, 4, 5)
        budget = int(rng.integers(0, (lengths * counts).sum() + 5))
        taken = mix.fitted(lengths, counts, budget)
        assert (0 <= taken).all() and (taken <= counts).all()
        reach = {sum(x * y for x, y in zip(c, lengths, strict=True)) for c in itertools.product(*(range(b + 1) for b in counts))}
        assert (taken * lengths).sum() == max(r for r in reach if r <= budget)


def test_targets():
    assert mix.targets([10, 10, 10], [5, 2, 1]) == pytest.approx([20, 50 / 3, 25 / 3])
    assert mix.targets([], []) == [] and mix.targets([0], [5]) == [0]


def test_mix(spark, docs, empty):
    sizes = {(i, s): len(spaced(t)) for i, t, _, s, *_ in awkward()}
    got = mix.plan(docs).collect()
    assert len(got) == len(awkward()) and all(r["size"] == sizes[r.doc_id, r.source] and 0 <= r.taken <= 2 * r["size"] for r in got)
    assert sorted(map(str, got)) == sorted(map(str, mix.plan(docs).collect()))
    out = mix.mixed(docs)
    assert out.columns == docs.columns
    taken = Counter(r.doc_id for r in out.collect())
    assert sum(taken[i] * 1 for i in taken) == sum(r.copies for r in got)
    assert mix.plan(empty).count() == 0 and mix.mixed(empty).count() == 0
    hot = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("same words in all of these").alias("text"), F.when(F.col("id") % 3 > 0, "a").otherwise("b").alias("source"))
    for r in mix.plan(hot).groupBy("source").agg(F.first("target").alias("t"), F.sum("taken").alias("taken")).collect():
        assert abs(r.t - r.taken) <= 6


# 5 and 9 ------------------------------------------------------------------------------------------

def test_language(spark, docs, empty):
    got = QUERIES["op5_string_kernel_language"](spark, MIDDLE).join(spark.read.parquet(f"{MIDDLE}/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = got.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert held > 0.95 and got.where("score < 0 OR score > 1").isEmpty()
    model = langid.fit(docs)  # one language alone
    rows = {r.doc_id: (r.lang_pred, r.score) for r in langid.identified(docs, model).collect()}
    assert rows[0] == rows[1] == rows[2] == ("und", 0.0) and rows[3] == ("en", 1.0)
    assert langid.fit(empty) is None
    assert {r.lang_pred for r in langid.identified(docs, None).collect()} == {"und"}
    assert langid.identified(empty, model).count() == 0


def test_kernel_is_the_shared_share():
    feature = np.arange(langid.SLOTS)
    model = langid.KernelModel(["x", "y"], feature, np.zeros((0, 0)), np.zeros((0, 0)))
    grams = lambda t: {t[k : k + n] for n in langid.SIZES for k in range(len(t) - n + 1)}
    a, b = "banana split", "bandana"
    small = langid.present(*langid.characters(*utf8(pa.array([a, b]))), langid.SIZES, langid.SLOTS)
    sets = [set(small[1][small[0] == k].tolist()) for k in (0, 1)]
    assert [len(s) for s in sets] == [len(grams(a)), len(grams(b))] and len(sets[0] & sets[1]) == len(grams(a) & grams(b))
    assert model.languages == ["x", "y"]


def test_toxicity(spark, docs, empty):
    rows = [(k, f"some plain words number {k} " + ("you awful scoundrel" if k % 4 == 0 else "and so on")) for k in range(400)]
    texts = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k, _ in rows] + [(5000, 1), (None, None)], "doc_id long, toxic int").withColumn("text", F.lit("clash"))
    model = toxicity.fit(texts, toxicity.training_labels(labels))
    got = {r.doc_id: r.score for r in toxicity.scored(texts, model, ["doc_id"]).collect()}
    assert all((got[k] >= 0.5) == (k % 4 == 0) for k, _ in rows)
    kept = toxicity.without_toxic(docs, model)
    assert kept.columns == docs.columns and kept.count() == len(awkward())
    assert toxicity.scored(empty, model, ["doc_id"]).count() == 0
    none = toxicity.fit(texts, labels.where("false"))
    assert all(r.score < 0.5 for r in toxicity.scored(docs, none, ["doc_id"]).collect())


def test_toxicity_of_rare_wording(spark):
    """Wording of few toxic texts has features, however many slots the common toxic wording fills."""
    rng = np.random.default_rng(9)
    letters = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    common, rows = letters(4000), []
    for k in range(1000):
        text, toxic = letters(60), int(k % 4 == 0)
        rows.append((k, text + (("" if not toxic else " §¶¤±" if k % 32 == 0 else common)), toxic))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    assert len(model.weight) > 4096
    got = {r.doc_id: r.score for r in toxicity.scored(df, model, ["doc_id"]).collect()}
    assert all((got[k] >= 0.5) == bool(toxic) for k, _, toxic in rows)


# 6 ------------------------------------------------------------------------------------------------

def kt(zeros, ones):
    return math.lgamma(zeros + 0.5) + math.lgamma(ones + 0.5) - math.log(math.pi) - math.lgamma(zeros + ones + 1)


def naive_tree(texts, depth):
    """Counts of every node: (decision, context) with the nearest byte first."""
    counts = Counter()
    for t in texts:
        line = b"\0" * depth + lower(t).encode() + b"\0"
        for at in range(depth, len(line)):
            for bit in range(8):
                node, one = (line[at] | 256) >> (8 - bit), line[at] >> (7 - bit) & 1
                for d in range(depth + 1):
                    counts[node, line[at - d : at][::-1], one] += 1
    return counts


def naive_score(counts, text, depth):
    children = {}
    for node, context, _ in counts:
        if context:
            children.setdefault((node, context[:-1]), set()).add(context)

    def mixture(node, context):
        own = kt(counts[node, context, 0], counts[node, context, 1])
        if len(context) == depth:
            return own
        return np.logaddexp(own, sum(mixture(node, c) for c in children.get((node, context), ()))) - math.log(2)

    line, total = b"\0" * depth + lower(text).encode() + b"\0", 0.0
    for at in range(depth, len(line)):
        for bit in range(8):
            node, one = (line[at] | 256) >> (8 - bit), line[at] >> (7 - bit) & 1
            p = None
            for d in range(depth, -1, -1):
                context = line[at - d : at][::-1]
                zeros, ones = counts[node, context, 0], counts[node, context, 1]
                own = ((ones if one else zeros) + 0.5) / (zeros + ones + 1)
                stop = 1.0 if d == depth else math.exp(kt(zeros, ones) - math.log(2) - mixture(node, context))
                p = own if p is None else stop * own + (1 - stop) * p
            total += math.log10(p)
    return total


def test_context_trees_are_built_a_block_of_suffixes_at_a_time(monkeypatch):
    rng = np.random.default_rng(5)
    code, n = np.unique(rng.integers(0, 1 << 40, 6000) & 0x03030F030F, return_counts=True)
    order = np.argsort((code >> 8) & 0xFFFF, kind="stable")
    code, n = code[order], n[order]
    batches = [pa.RecordBatch.from_pydict({"code": code[x : x + 50], "n": n[x : x + 50]}) for x in range(0, len(code), 50)]

    def told(rows: list) -> tuple[dict, dict]:
        table = pa.Table.from_batches(rows).to_pylist()
        sums = {}
        for r in table:
            if r["node"] is not None:
                at = sums.setdefault((r["nearest"], r["node"]), np.zeros(3))
                at += [r["zeros"], r["ones"], r["log_mix"]]
        return {r["code"]: r["below"] for r in table if r["node"] is None}, sums

    whole = told(list(ctw._suffix_trees(iter(batches))))
    monkeypatch.setattr(ctw, "TREE_ROWS", 200)
    read = []
    blocks = ctw._suffix_trees(read.append(b.num_rows) or b for b in batches)
    first = next(blocks)
    assert sum(read) < len(code) / 4
    below, sums = told([first, *blocks])
    assert below == whole[0] and len(below) == len(code)
    assert sums.keys() == whole[1].keys()
    assert all(np.allclose(sums[k], whole[1][k], rtol=1e-12) for k in sums)


def test_context_trees_against_recursion(spark):
    texts = ["Abracadabra", "abra cad", "", None, "banana", "zzz é"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r for r in ctw.scored(rows, F.col("doc_id") < 4).collect()}
    counts = naive_tree(texts[:4], ctw.DEPTH)
    for k, t in enumerate(texts):
        assert got[k].score == pytest.approx(naive_score(counts, t, ctw.DEPTH), abs=1e-7)
    words = Counter(w for t in texts[:4] for w in [*spaced(t), None])
    n, v = sum(words.values()), len(words)
    for k, t in enumerate(texts):
        tokens = [*spaced(t), None]
        assert got[k].base_score == pytest.approx(sum(math.log10((words[w] + 1) / (n + v + 1)) for w in tokens))
        assert (got[k].n_tokens, got[k].n_known, got[k].train_tokens) == (len(tokens), sum(words[w] > 0 for w in tokens), n)


def test_context_trees_of_awkward_tables(docs, empty):
    assert ctw.scored(docs, F.lit(True)).count() == len(awkward())
    assert ctw.scored(empty, F.lit(True)).count() == 0
    nothing = ctw.scored(docs, F.lit(False)).where("doc_id = 3").first()
    assert nothing.score == pytest.approx(4 * 8 * math.log10(0.5)) and nothing.train_tokens == 0 and nothing.base_score == 0


# 7 ------------------------------------------------------------------------------------------------

def test_sample_tables():
    assert telephony.TABLES[telephony.MULAW][[0, 127, 128, 255]].tolist() == [-32124, 0, 32124, 0]
    assert telephony.TABLES[telephony.ALAW][[0xD5, 0x55, 0xAA, 0x2A]].tolist() == [8, -8, 32256, -32256]


def test_adpcm_against_steps():
    rng = np.random.default_rng(7)
    blocks = rng.integers(0, 256, (5, telephony.UNIT), dtype=np.uint8)
    for block, row in zip(blocks, telephony.adpcm(blocks), strict=True):
        sample, index, want = 0, 0, [0]
        for byte in block.tolist():
            for code in (byte & 15, byte >> 4):
                step = int(telephony.STEPS[index])
                change = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
                sample = max(-32768, min(32767, sample - change if code & 8 else sample + change))
                index = max(0, min(88, index + (-1 if code & 7 < 4 else 2 * (code & 3) + 2)))
                want.append(sample)
        assert row.tolist() == want


def test_media(docs, empty):
    for codec in telephony.NAMES:
        payload = telephony.payload_of("é" * 500)
        assert telephony.parsed(telephony.wav(payload, codec))[1].tobytes() == payload
    got = telephony.decoded(telephony.stored_media(docs)).collect()
    want = Counter()
    for i, t, *_ in awkward():
        p = (t or "").encode()
        p += b" " * (max(192, -(-len(p) // 192) * 192) - len(p))
        want[i, len((t or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:])] += 1
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == want
    assert all(len(r.pcm) == 2 * r.pcm_samples and zlib.crc32(r.pcm) == r.pcm_crc32 for r in got)
    assert len({(r.feature, r.media_sha256) for r in got if r.doc_id in (4, 5, 11, None)}) == 1
    assert telephony.decoded(telephony.stored_media(empty)).count() == 0


# 8 ------------------------------------------------------------------------------------------------

def brute_classes(rows):
    sets = [({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()) for w in (spaced(t) for _, t in rows)]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in itertools.combinations(range(len(rows)), 2):
        shared = len(sets[a] & sets[b])
        if shared and 100 * shared >= 75 * len(sets[a] | sets[b]):
            root[find(a)] = find(b)
    out = Counter()
    for k, (i, _) in enumerate(rows):
        same = [rows[j][0] for j in range(len(rows)) if find(j) == find(k) and rows[j][0] is not None]
        least = min(same, default=None) if sets[k] else i
        out[i, len(sets[k]), least, i == least] += 1
    return out


def test_near_duplicates_against_all_pairs(spark):
    rng = np.random.default_rng(8)
    rows = [(i, t) for i, t, *_ in awkward()]
    for group in range(6):  # near copies of several strengths, linked directly, through others, or not at all
        base = [f"w{x}" for x in rng.integers(0, 500, 120)]
        for _ in range(25):
            copy = list(base)
            for at in rng.choice(120, rng.integers(0, 7), replace=False):
                copy[at] = f"e{rng.integers(0, 10**6)}"
            rows.append((100 + len(rows), " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit(1))
    got = minhash.near_duplicates(df).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == brute_classes(rows)


def test_one_of_each(docs, empty):
    out = minhash.one_of_each(docs)
    assert out.columns == docs.columns
    assert sorted((r.doc_id for r in out.collect()), key=str) == sorted([0, 1, 2, 3, 4, 7, 8, 9], key=str)
    assert minhash.one_of_each(empty).count() == 0 and minhash.near_duplicates(empty).count() == 0


def test_long_chain_of_links(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(200, 300), (300, 250)], "a long, b long")
    got = {r.node: r.root for r in minhash.components(edges).collect()}
    assert got == {**{k: 0 for k in range(61)}, **{k: 200 for k in (200, 250, 300)}}


# 10 -----------------------------------------------------------------------------------------------

ITEMS = [(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"), (2, "Short item here"), (2, "short ITEM, here!"), (3, None), (4, "…"), (None, "one two three four"), (5, "alpha beta gamma delta epsilon zeta eta theta iota kappa xi")]
SUSPECTS = [
    "start Alpha beta-gamma delta epsilon zeta eta theta iota kappa then", "alpha beta gamma delta epsilon zeta eta theta iota", "beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu",
    "a short item here and one two three four", "short item", None, "", "here short item here short item here", "alpha " * 40,
]


def brute_hits(text, items):
    words, hit, found = lettered(text), set(), set()
    for i, t in items:
        w = lettered(t)
        n = min(10, len(w))
        for k in range(len(w) - n + 1) if w else ():
            for at in range(len(words) - n + 1):
                if words[at : at + n] == w[k : k + n]:
                    hit.update(range(at, at + n))
                    found.add(i)
    return len(words), len(hit), sorted(str(i) for i in found if i is not None)


@pytest.mark.parametrize("automaton_words", [400_000, 4])
def test_contamination_against_windows(spark, automaton_words, monkeypatch):
    monkeypatch.setattr(decontam.automata, "__defaults__", (decontam.WINDOW, automaton_words))
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontam.contamination(spark.createDataFrame(list(enumerate(SUSPECTS)), "doc_id long, text string"), items)
    for r in got.collect():
        assert (r.n_words, sum(b - a for a, b in r.spans), list(r["items"])) == brute_hits(SUSPECTS[r.doc_id], ITEMS), SUSPECTS[r.doc_id]


def test_decontaminated_text(spark, docs, empty):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    filler = "quite different words that no item has at all in any place whatever " * 2
    rows = spark.createDataFrame([(1, filler + SUSPECTS[0] + " " + filler, 9), (2, SUSPECTS[0], 9), (3, None, None), (4, "clean text", 10)], "doc_id long, text string, n_chars int")
    got = {r.doc_id: r for r in decontam.decontaminate(rows, items).collect()}
    assert set(got) == {1, 3, 4} and got[4].text == "clean text" and got[3].text is None and got[3].n_chars == 0
    assert "beta" not in got[1].text and got[1].text.startswith(filler) and got[1].n_chars == len(got[1].text)
    out = decontam.decontaminate(docs, items)
    assert out.columns == docs.columns and out.count() == len(awkward())
    assert decontam.decontaminate(empty, items).count() == 0
    assert decontam.decontaminate(docs, items.where("false")).count() == len(awkward())


# pipeline -----------------------------------------------------------------------------------------

def test_pipeline(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, frames = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, SMALL), name.replace(" ", "-"))
        frames.append(docs)
    assert all(f.columns == columns for f in frames[:-1])
    clean, single, apart, mixed, tokens = ([r.asDict() for r in f.collect()] for f in frames)
    classes = brute_classes([(r["doc_id"], r["text"]) for r in clean])
    assert sorted(r["doc_id"] for r in single) == sorted(i for (i, _, _, kept), n in classes.items() if kept)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    dirty = {r["doc_id"]: brute_hits(r["text"], items) for r in single}
    assert {r["doc_id"] for r in apart} == {i for i, (n, hit, _) in dirty.items() if hit <= 0.5 * n}
    assert all(brute_hits(r["text"], items)[1] == 0 for r in apart)
    assert {r["doc_id"]: r["text"] for r in single if not dirty[r["doc_id"]][1]}.items() <= {r["doc_id"]: r["text"] for r in apart}.items()
    assert {r["doc_id"] for r in mixed} <= {r["doc_id"] for r in apart} and max(Counter(r["doc_id"] for r in mixed).values()) <= 2
    direct = Tokenizer.from_file(VOCABULARY)
    want = Counter((r["doc_id"], zlib.crc32(np.array([*direct.encode(r["text"] or "", add_special_tokens=False).ids, 0], "<u4").tobytes())) for r in mixed)
    assert Counter((r["doc_id"], r["ids_crc32"]) for r in tokens) == want
