"""What the contracts of the corpus operators name, on the inputs that once broke them."""

import itertools
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from sitegauge.llm import mix, token_blocks, toxicity, warc
from sitegauge.session import shared_scratch

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def test_special_strings_are_the_librarys_tokens(spark):
    direct = Tokenizer.from_file(VOCABULARY)
    texts = ["<|endoftext|>", "a <|endoftext|> b", "x<|endoftext|>y  z<|endoftext|>", "<|endoftext| >", " <|endoftext|>\n\n", "plain words"]
    assert direct.encode(texts[0], add_special_tokens=False).ids == [50256]
    for _ in range(2):
        got = token_blocks.encoder(VOCABULARY).ids(texts)
        assert [np.frombuffer(g, "<u2").tolist() for g in got] == [direct.encode(t, add_special_tokens=False).ids for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in token_blocks.digests(df, VOCABULARY).collect():
        ids = [*direct.encode(texts[r.doc_id], add_special_tokens=False).ids, 0]
        assert (r.n_tokens, r.ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))


@pytest.mark.parametrize(("lengths", "counts", "budget", "want"), [
    ([4, 6], [2, 2], 12, 12), ([70_000, 80_000, 100_000], [1, 1, 1], 150_000, 150_000), ([50_003, 50_007, 50_001, 49_999, 50_010], [1] * 5, 165_009, 150_020),
    ([1_000_000, 3], [5, 2], 2_000_004, 2_000_003), ([7], [3], 0, 0), ([200_000, 1], [3, 10], 150_000, 10),
])
def test_budgets_that_few_documents_hit(lengths, counts, budget, want):
    taken = mix.fitted(np.array(lengths), np.array(counts), budget)
    assert (taken <= counts).all() and (taken * lengths).sum() == want


def test_subsets_in_wide_cells_are_near_the_best():
    rng = np.random.default_rng(5)
    for _ in range(30):
        words = rng.integers(1, 4000, 12).tolist()
        budget = int(rng.integers(1, sum(words)))
        best = max(s for n in range(13) for c in itertools.combinations(words, n) if (s := sum(c)) <= budget)
        for window in (1 << 16, 500, 20):
            chosen = mix.subset(words, budget, window)
            total = sum(words[k] for k in chosen)
            assert len(set(chosen)) == len(chosen) and total <= budget and total >= best - (budget // window + 1) * len(words)
            assert window < 1 << 16 or total == best


def test_a_source_of_few_long_documents_nears_its_target(spark):
    long = [(k, "w " * n, "a") for k, n in enumerate((70_000, 80_000, 100_000, 60_000))]
    short = [(100 + k, "v " * 50, "b") for k in range(2000)]
    df = spark.createDataFrame([*long, *short], "doc_id long, text string, source string")
    for r in mix.plan(df).groupBy("source").agg(F.first("target").alias("t"), F.sum("taken").alias("taken")).collect():
        assert abs(r.t - r.taken) <= 50 if r.source == "b" else abs(r.t - r.taken) <= 0.1 * r.t


#: Names that some stage uses for a column of its own.
HELPERS = "sum n copies copy size node root score band label toxic apart features key bucket rank held ahead more extra target taken place name start words spans digest part id at doc seed unit".split()


def test_every_stage_takes_columns_of_any_name(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)
    wide = docs.select("*", *[F.lit(k).alias(h.upper() if k % 2 else h) for k, h in enumerate(HELPERS)])
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, wide, "/root/testdata/sf0.001")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == wide.columns, name
        assert out.count() > 0, name


def test_a_rare_label_is_in_the_sample(spark):
    rows = [(k, f"some plain words number {k} " + ("you awful scoundrel" if k % 100 == 0 else "and so on"), int(k % 100 == 0)) for k in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    for fit_rows in (20, 12_000):
        model = toxicity.fit(df.select("doc_id", "text"), df.select("doc_id", "toxic"), fit_rows)
        got = {r.doc_id: r.score for r in toxicity.scored(df, model, ["doc_id"]).collect()}
        assert max(s for k, s in got.items() if k % 100) < 0.5 <= min(s for k, s in got.items() if k % 100 == 0), fit_rows


def test_ratios_and_gradient_of_the_classifier(spark):
    """Log-count ratios counted anew, and a numeric gradient of the loss that Spark sums."""
    rows = [(k, "ab cd" if k % 3 else "xy cd", int(k % 3 == 0)) for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    data = [np.frombuffer(t.encode(), np.uint8) for _, t, _ in rows]
    offsets = np.concatenate([[0], np.cumsum([len(d) for d in data])])
    owner, slot = toxicity.present(*toxicity.characters(np.concatenate(data), offsets), toxicity.SIZES, toxicity.SLOTS)
    label = np.array([t for *_, t in rows])
    counts = np.stack([np.bincount(slot[label[owner] == k], minlength=toxicity.SLOTS) for k in (0, 1)])
    ratio = np.log((counts[1] + 1) / (100 + 2)) - np.log((counts[0] + 1) / (200 + 2))
    kept = np.flatnonzero(model.feature >= 0)
    assert len(kept) and all((model.weight[model.feature[s]] > 0) or model.weight[model.feature[s]] * ratio[s] <= 0 or ratio[s] < 0 for s in kept)
    assert set(kept) >= {s for s in np.flatnonzero(counts.any(axis=0)) if abs(ratio[s]) > 3}
    scale, point = ratio[kept], np.random.default_rng(1).normal(size=len(kept) + 1) * 0.1
    feature = np.full(toxicity.SLOTS, -1)
    feature[kept] = np.arange(len(kept))
    packed = df.withColumn("apart", F.lit(False)).mapInArrow(toxicity._rows_of_features(feature), "toxic bigint, apart boolean, features binary").select("toxic", "features")
    loss, by = toxicity._loss(packed, scale, point)
    for k in (0, len(kept) // 2, len(kept)):
        step = np.zeros(len(point))
        step[k] = 1e-5
        up, down = (toxicity._loss(packed, scale, point + s)[0] for s in (step, -step))
        assert abs((up - down) / 2e-5 - by[k]) < 1e-3 * max(1, abs(by[k]))
    z = point[-1] + np.bincount(owner[feature[slot] >= 0], (scale * point[:-1])[feature[slot][feature[slot] >= 0]], minlength=300)
    assert abs(loss - (np.logaddexp(0, z) - label * z).sum()) < 1e-6


def test_one_long_page_does_not_split_the_others(spark):
    pages = spark.range(3000).select(F.col("id").alias("page_id"), F.lit("http://a").alias("url"), F.when(F.col("id") == 7, F.repeat(F.lit("x"), 70_000_000)).when(F.col("id") == 8, F.repeat(F.lit("y"), 400_000)).otherwise(F.concat(F.lit("page "), "id")).alias("html"))
    path = f"{shared_scratch(spark)}/warc"
    warc.write(pages.coalesce(2), path)
    assert spark.read.format("binaryFile").load(path).select("path").distinct().count() <= 8
    back = {r.page_id: r.payload_bytes for r in warc.read(spark, path).collect()}
    assert len(back) == 3000 and back[7] == 70_000_000 and back[8] == 400_000 and back[9] == 6


def test_pcm_of_telephony_sample_by_sample(spark):
    """Features and resampled PCM of op7's rows, recomputed from the stored file one sample at a time."""
    import zlib

    from sitegauge.llm import telephony

    texts = [None, "", "a", "é" * 500, "The quick brown fox. " * 40, *[f"{k} word" * (k % 9 + 1) for k in range(12)]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    media = telephony.stored_media(docs)
    files = {r["doc_id"]: bytes(r["media"]) for r in media.collect()}
    seen = set()
    for row in telephony.decoded(media).collect():
        codec, payload = telephony.parsed(files[row["doc_id"]])
        seen.add(codec)
        if codec == telephony.ADPCM:
            pcm = [int(v) for block in payload.reshape(-1, telephony.UNIT) for v in telephony.adpcm(block[None])[0]]
        else:
            pcm = [int(telephony.TABLES[codec][byte]) for byte in payload]
        turns = sum((a < 0) != (b < 0) for a, b in zip(pcm, pcm[1:]))
        assert row["feature"].split(":")[1:] == [str(v) for v in (len(pcm), sum(v * v for v in pcm) // len(pcm), max(map(abs, pcm)), sum(map(abs, pcm)) // len(pcm), turns)]
        at = lambda k: pcm[min(max(k, 0), len(pcm) - 1)]  # noqa: B023, E731
        wide = []
        for k, v in enumerate(pcm):
            between = (150 * (at(k) + at(k + 1)) - 25 * (at(k - 1) + at(k + 2)) + 3 * (at(k - 2) + at(k + 3)) + 128) >> 8
            wide += [v, min(max(between, -32768), 32767)]
        stored = b"".join(v.to_bytes(2, "little", signed=True) for v in wide)
        assert bytes(row["pcm"]) == stored and row["pcm_samples"] == len(wide) and row["pcm_crc32"] == zlib.crc32(stored)
    assert seen == set(telephony.NAMES)
