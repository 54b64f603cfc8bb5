"""The registered queries: one ``opN_<name>`` per operator, over its whole table, in the contract's columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cashcurve.llm import (ann, decontaminate, hard_negatives, html_text, langid, packing, pieces, pii, quality, sharding, simhash, spelling,
                           toxicity)
from cashcurve.llm.common import fold_is, read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(fn):
    QUERIES[fn.__name__] = fn
    return fn


@register
def op3_hyperdimensional_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; prototypes from the documents outside the held-out fold."""
    held_out = fold_is(F.col("doc_id"), 5, 0)
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    prototypes = langid.train_prototypes(docs, "text", "lang", ~held_out & F.col("doc_id").isNotNull())
    return langid.identify(docs.select("doc_id", held_out.alias("held_out"), "text"), prototypes)


@register
def op4_wu_manber_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows of ten words found in every document."""
    report = decontaminate.contamination_report(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return report.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


# Windows as strings of words joined by blanks, found by equality at every position of every document.
ORACLE["op4_wu_manber_decontamination"] = """
    WITH d AS (SELECT row_number() OVER () AS row_id, doc_id, regexp_extract_all(translate(coalesce(text, ''),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
    b AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, regexp_extract_all(translate(coalesce(text, ''),
                 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
    sized AS (SELECT item, w, least(len(w), 10) AS n FROM b WHERE len(w) > 0),
    windows AS (SELECT DISTINCT item, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS pat
                FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM sized)),
    lengths AS (SELECT DISTINCT n FROM windows),
    places AS (SELECT row_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lengths WHERE len(w) >= n),
    grams AS (SELECT row_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS pat FROM places),
    found AS (SELECT g.row_id, g.i, g.n, x.item FROM grams g JOIN windows x ON x.n = g.n AND x.pat = g.pat),
    hit AS (SELECT row_id, count(DISTINCT p) AS n_hit FROM (SELECT row_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY 1),
    items AS (SELECT row_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
              FROM (SELECT DISTINCT row_id, item FROM found) GROUP BY 1)
    SELECT d.doc_id, len(d.w) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(t.n_items, 0) AS n_items,
           sha256(coalesce(t.items, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN hit h ON h.row_id = d.row_id LEFT JOIN items t ON t.row_id = d.row_id"""


@register
def op9_crf_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document by the word field trained outside the held-out fold."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", fold_is(F.col("doc_id"), 3, 1).alias("held_out"), "text")
    model = toxicity.train(docs, read_table(spark, sf_dir, "labels"), ~fold_is(F.col("doc_id"), 3, 1))
    df, t = toxicity.score(docs, model)
    return df.select("doc_id", "held_out", F.col(t)["score"].alias("score"),
                     (F.col(t)["score"] >= model.cut).cast("int").alias("predicted"), F.col(t)["top"].alias("top_marginal"),
                     F.col(t)["expected"].alias("expected_words"), F.col(t)["spans"].alias("spans"))


@register
def op2_random_indexing_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document by the network trained outside the held-out fold."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", fold_is(F.col("doc_id"), 5, 0).alias("held_out"), "text")
    model = quality.train(docs, read_table(spark, sf_dir, "labels"), ~fold_is(F.col("doc_id"), 5, 0))
    return quality.score(docs, model)


@register
def op5_shared_prefix_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of every document and whether they decode to its text."""
    return pieces.round_trip(read_table(spark, sf_dir, "documents"))


@register
def op10_site_template_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page without the subtrees that recur on its host."""
    return html_text.main_text(read_table(spark, sf_dir, "pages"))


@register
def op7_simhash_byte_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


@register
def op1_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest vectors of every hundredth embedding."""
    return ann.search(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@register
def op6_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of near equal bytes."""
    return sharding.shard_documents(read_table(spark, sf_dir, "documents"))


@register
def op8_boosted_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    docs = read_table(spark, sf_dir, "documents")
    return pii.find(docs, pii.train(docs))


@register
def op11_permuterm_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants of all words of the documents: near words, forms and roots."""
    return spelling.variants(read_table(spark, sf_dir, "documents"))


@register
def op12_strassen_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth embedding, per positive."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


@register
def op13_least_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4096 tokens."""
    return packing.pack(read_table(spark, sf_dir, "documents"))
