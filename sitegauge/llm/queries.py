"""The corpus queries, one per operator, over whole tables, and the SQL that must agree where SQL can say it."""

from __future__ import annotations

import itertools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegauge.llm import audit, ctw, debruijn, decontam, langid, merkle, minhash, mix, pii, telephony, token_blocks, toxicity, warc
from sitegauge.llm.common import fold, stored, table
from sitegauge.session import shared_scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document that lie in a window of a benchmark item, and the items found."""
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


_LOWER = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_LETTERED = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_SPACED = r"[^\x20\x09-\x0D]+"

SQL["op10_benchmark_decontamination"] = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER.format('text')}, '{_LETTERED}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER.format('text')}, '{_LETTERED}') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, m, array_to_string(w[i : i + m - 1], ' ') AS k
  FROM (SELECT item_id, w, least(10, len(w)) AS m, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
runs AS (
  SELECT doc_id, m, i, array_to_string(w[i : i + m - 1], ' ') AS k
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM win) WHERE len(w) >= m)),
hits AS (SELECT doc_id, i, m, item_id FROM runs JOIN win USING (m, k)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hits) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


@query
def op8_bbit_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of each document among near-duplicates."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


SQL["op8_bbit_minhash"] = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER.format('text')}, '{_SPACED}') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS k
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y USING (k) WHERE x.doc_id < y.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 75 * (na.n + nb.n - c)),
l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT a AS doc_id, a AS reach FROM l UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.reach),
c AS (SELECT doc_id, min(reach) AS component_id FROM r GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, doc_id) AS component_id, coalesce(component_id, doc_id) = doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""


@query
def op9_nb_linear_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of each document; the fifth fold of ids is never learned."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, toxicity.training_labels(table(spark, sf_dir, "labels")))
    score = toxicity.scored(docs, model, ["doc_id"])
    return score.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op5_string_kernel_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of each document; the third fold of four is never learned."""
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(fold("doc_id", 4) != 2))
    return langid.identified(docs, model).select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


@query
def op3_patched_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of all documents, read back."""
    return token_blocks.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op4_subset_sum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of each document."""
    return mix.plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query
def op6_context_tree_weighting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probability of each document by context-tree weighting; the third fold of seven is never learned."""
    held_out = fold("doc_id", 7) == 2
    out = ctw.scored(table(spark, sf_dir, "documents"), ~held_out)
    bits = -F.col("score") * F.lit(3.321928094887362) / F.col("n_bytes")
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", bits.alias("bits_per_byte"))


@query
def op2_boundary_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all pages as WARC archives and read them back by verified boundaries."""
    path = f"{shared_scratch(spark)}/warc"
    warc.write(table(spark, sf_dir, "pages"), path)
    return warc.read(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL["op2_boundary_chains"] = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d)
SELECT page_id, n AS payload_bytes, d AS payload_digest,
       CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN f USING (d)
"""


@query
def op7_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Store all texts as telephony audio, read the stored bytes back and describe them; with the resampled PCM of each."""
    media = stored(telephony.stored_media(table(spark, sf_dir, "documents")), "media")
    return telephony.decoded(media)


@query
def op1_weak_supervision_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data of each document."""
    found = pii.detect(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
    number = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(number, pii.KINDS[: pii.BASE]), F.sha2(listed(base), 256).alias("base_sha256"), listed("spans").alias("spans"))


@query
def op11_merkle_proofs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, subroot, root and proof of each document, and the root folded from rows of which a seventh is tampered with."""
    fields = [F.col(f) + 1 if f == "n_chars" else F.col(f) for f in merkle.FIELDS]
    changed = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False))
    keep = F.struct("doc_id", F.when(changed, merkle.leaf(fields)).alias("tampered"))
    found = merkle.proofs(table(spark, sf_dir, "documents"), "lang", ["doc_id"], merkle.FIELDS, keep)
    folded = merkle.folded(F.coalesce("keep.tampered", "leaf"), F.col("proof"), F.col("bits"))
    found = found.withColumn("folded_root", folded)
    return found.select(
        "keep.doc_id", "leaf", "subroot", "root", F.sha2(F.array_join("proof", ""), 256).alias("proof_sha256"),
        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"),
    )


_CRC32 = """xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split({0}, ''), lambda c: ascii(c)::BIGINT)),
  lambda r, c: list_reduce(list_concat([xor(r, c)], range(8)), lambda x, k: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)"""
_FIELD = "coalesce(strlen({0}::VARCHAR) || ':' || {0}::VARCHAR, '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(f) for f in merkle.FIELDS) + ")"

SQL["op11_merkle_proofs"] = f"""
WITH RECURSIVE leaves AS (
  SELECT *, coalesce('=' || lang, '') AS tree, {_LEAF} AS leaf,
         CASE WHEN {_CRC32.format('doc_id::VARCHAR')} % 7 = 0 THEN {_LEAF.replace('n_chars', '(n_chars + 1)')} ELSE {_LEAF} END AS changed
  FROM documents),
numbers AS (SELECT doc_id, tree, leaf, changed, row_number() OVER (PARTITION BY tree ORDER BY doc_id, leaf) - 1 AS place FROM leaves),
levels AS (
  SELECT tree, 0 AS level, list(leaf ORDER BY place) AS h FROM numbers GROUP BY tree
  UNION ALL
  SELECT tree, level + 1, list_transform(range(0, len(h), 2), lambda i: sha256(h[i + 1] || coalesce(h[i + 2], ''))) FROM levels WHERE len(h) > 1),
subroots AS (SELECT tree, h[1] AS subroot, row_number() OVER (ORDER BY tree) - 1 AS rank FROM levels WHERE len(h) = 1),
upper AS (
  SELECT 0 AS level, list(subroot ORDER BY rank) AS h FROM subroots
  UNION ALL
  SELECT level + 1, list_transform(range(0, len(h), 2), lambda i: sha256(h[i + 1] || coalesce(h[i + 2], ''))) FROM upper WHERE len(h) > 1),
top AS (SELECT h[1] AS root FROM upper WHERE len(h) = 1),
steps AS (
  SELECT n.tree, n.place, l.level AS step, (n.place >> l.level) & 1 AS side, coalesce(l.h[xor(n.place >> l.level, 1) + 1], '') AS sibling
  FROM numbers n JOIN levels l USING (tree) WHERE len(l.h) > 1
  UNION ALL
  SELECT n.tree, n.place, 1000 + u.level, (s.rank >> u.level) & 1, coalesce(u.h[xor(s.rank >> u.level, 1) + 1], '')
  FROM numbers n JOIN subroots s USING (tree), upper u WHERE len(u.h) > 1),
proofs AS (SELECT tree, place, list(sibling ORDER BY step) AS siblings, list(side ORDER BY step) AS sides FROM steps GROUP BY tree, place),
fold AS (
  SELECT n.tree, n.place, 0 AS k, changed AS node FROM numbers n
  UNION ALL
  SELECT f.tree, f.place, k + 1, sha256(CASE WHEN sides[k + 1] = 1 THEN siblings[k + 1] || node ELSE node || siblings[k + 1] END)
  FROM fold f JOIN proofs p USING (tree, place) WHERE k < len(siblings)),
ends AS (SELECT tree, place, arg_max(node, k) AS folded_root FROM fold GROUP BY tree, place)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(array_to_string(siblings, ''), '')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM numbers n JOIN subroots USING (tree) JOIN ends USING (tree, place) LEFT JOIN proofs USING (tree, place), top
"""


@query
def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of five filters removes in each order of them, by language."""
    found = audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


_PERMUTED = "SELECT a || b || c || d || e AS filter_order FROM " + ", ".join(f"(SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS {x}) AS t{x}" for x in "abcde")
_PERMUTED += " WHERE " + " AND ".join(f"{x} <> {y}" for x, y in itertools.combinations("abcde", 2))

SQL["op12_filter_audit"] = f"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '{_SPACED}') AS words FROM t),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         (len(words) < 100)::INT AS a, (100 * len(list_distinct(words)) < 80 * len(words))::INT AS b,
         (100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 10 * length(text))::INT AS c,
         regexp_matches(text, '[#$%&*|]')::INT AS d, coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)::INT AS e
  FROM w LEFT JOIN l USING (doc_id)),
fails AS (
  SELECT part, CASE WHEN a = 1 THEN 'A' ELSE '' END || CASE WHEN b = 1 THEN 'B' ELSE '' END || CASE WHEN c = 1 THEN 'C' ELSE '' END
               || CASE WHEN d = 1 THEN 'D' ELSE '' END || CASE WHEN e = 1 THEN 'E' ELSE '' END AS failed,
         count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
  FROM f GROUP BY ALL),
o AS ({_PERMUTED}),
s AS (SELECT filter_order, unnest(range(1, 6)) AS step FROM o),
p AS (SELECT filter_order, step, filter_order[step] AS own, filter_order[1 : step - 1] AS before FROM s),
x AS (
  SELECT part, filter_order, step, own, n, good, toxic, contains(failed, own) AS fails,
         before <> '' AND regexp_matches(failed, '[' || coalesce(nullif(before, ''), '-') || ']') AS gone, failed = own AS alone
  FROM fails, p),
r AS (
  SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (NOT gone AND NOT fails), 0) AS kept, coalesce(sum(n) FILTER (NOT gone AND fails), 0) AS removed,
         coalesce(sum(n) FILTER (gone AND fails), 0) AS redundant, coalesce(sum(n) FILTER (alone), 0) AS unique_fails,
         coalesce(sum(good) FILTER (NOT gone AND fails), 0) AS good_lost, coalesce(sum(toxic) FILTER (NOT gone AND fails), 0) AS toxic_lost
  FROM x GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
       good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM r
"""


@query
def op13_debruijn_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier document has."""
    found = debruijn.deduplicated(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


SQL["op13_debruijn_spans"] = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_SPACED}') AS w FROM documents),
k AS (SELECT doc_id, i, hash(array_to_string(w[i : i + 12], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
f AS (SELECT h, min(doc_id) AS first FROM k GROUP BY h),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM k JOIN f USING (h) WHERE first < doc_id),
x AS (SELECT doc_id, list(p) AS gone, count(*) AS n FROM g GROUP BY doc_id),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text FROM words ANTI JOIN g USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN x USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
