"""The numbered queries over the corpus tables and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwell.llm import bpe, cap_filters, digest_index, divergence, filter_audit, forest, langid, license_scan, mixing
from maskwell.llm import quality, sharding, simhash, sql, token_files
from maskwell.shared import materialize, new_path

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and class of every document; see :func:`simhash.simhash_classes`."""
    classes = simhash.simhash_classes(_read(spark, sf_dir, "documents"), words_per_shingle=4, radius=4)
    return classes.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and class of every vector; see :func:`cap_filters.link_embeddings`."""
    return cap_filters.link_embeddings(_read(spark, sf_dir, "embeddings"), cosine=0.93)


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest vectors found of every vector whose id is divisible by 100."""
    return forest.nearest_neighbours(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document; learnt from the folds other than 0."""
    docs = _read(spark, sf_dir, "documents")
    model = langid.train(docs.where(fold(F.col("doc_id")) != 0))
    scored = langid.with_language(docs, model)
    held_out = F.coalesce(fold(F.col("row.doc_id")) == 0, F.lit(False))
    return scored.select("row.doc_id", held_out.alias("held_out"), "lang_pred", "score")


def with_digests(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` of encoded documents."""
    decoded = bpe.decode_documents(encoded, tokenizer_path)
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(listed, 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def op3_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the text decoded from them, for every document."""
    return with_digests(bpe.encode_documents(_read(spark, sf_dir, "documents"), BYTE_BPE), BYTE_BPE)


WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, length and checksum of every document's ids, from the ORC files written."""
    path = new_path(spark, "token-files")
    token_files.write_token_files(_read(spark, sf_dir, "documents"), path, WORD_BPE, end_id=1)
    return token_files.token_positions(token_files.read_token_files(spark, path))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence labels of every document; see :func:`license_scan.label_documents`."""
    return license_scan.label_documents(_read(spark, sf_dir, "documents"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document: text evidence, site priors and whether it is kept.

    The source stands for the host and the language for the path.
    """
    docs = _read(spark, sf_dir, "documents")
    model = quality.train(docs, _read(spark, sf_dir, "labels"))
    rated = quality.with_quality(docs, model, host="source", path="lang")
    return rated.select(
        "row.doc_id", "p_text", "host_mean", "path_mean", "quality", (F.col("quality") >= QUALITY_THRESHOLD).alias("kept")
    )


QUALITY_THRESHOLD = 0.5

#: The documents have no domain: the number in a source's name, modulo 4, stands in for it.
DOMAIN = "concat('d', cast(try_cast(regexp_extract(source, '([0-9]+)$', 1) as int) % 4 as string))"
MIX_WEIGHTS = {
    "domain": {"d0": 4, "d1": 3, "d2": 2, "d3": 1},
    "lang": {"en": 5, "de": 2, "fr": 2, "es": 1},
    "source": {},
}
MIX_EPOCHS = 4
MIX_SEED = 20


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of every document that the mix takes; see :func:`mixing.with_copies`."""
    mixed = mixing.with_copies(
        _read(spark, sf_dir, "documents"), MIX_WEIGHTS, max_epochs=MIX_EPOCHS, seed=MIX_SEED, domain=DOMAIN
    )
    return mixed.where("copies > 0").select("row.doc_id", "domain", "lang", "source", "n_tokens", "copies")


SHARDS = [f"shard-{k:02d}" for k in range(32)]
SLOTS = 4099


def op9_shard_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slot and shard of every document; see :func:`sharding.with_shard`."""
    placed = sharding.with_shard(_read(spark, sf_dir, "documents"), "doc_id", SHARDS, SLOTS)
    return placed.select("row.doc_id", "slot", "shard")


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The copy that stays of every document's text, from an index of earlier documents.

    Documents of the folds other than 0 are the history that the index is built over; those of
    fold 0, and null ids, arrive later and are looked up.
    """
    docs = _read(spark, sf_dir, "documents")
    slim = materialize(digest_index.document_digests(docs), "digests")
    earlier = F.coalesce(fold(F.col("id")) != 0, F.lit(False))
    known = materialize(digest_index.group_digests(slim.where(earlier)), "known-digests")
    arrived = digest_index.group_digests(slim.where(~earlier))
    n_known = known.count()
    shards = digest_index.shards_for(n_known)
    index = materialize(digest_index.build_index(known, shards), "digest-index")
    blocks = -(-digest_index.shards_for(slim.where(~earlier).count()) // shards)
    merged = digest_index.merge_groups(arrived, index, shards, blocks)
    marked = digest_index.mark_repeats(slim, merged)
    return marked.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of five filters in every order, per source; see :func:`filter_audit.audit_orders`."""
    cells = filter_audit.failure_cells(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"), part="source")
    return filter_audit.audit_orders(cells)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of every source from each other of its language, and its own terms; see :func:`divergence.audit`."""
    return divergence.audit(_read(spark, sf_dir, "documents"))


QUERIES["op1_embedding_near_dedup"] = op1_embedding_near_dedup
QUERIES["op2_language_id"] = op2_language_id
QUERIES["op3_bpe_encode_decode"] = op3_bpe_encode_decode
QUERIES["op4_token_files"] = op4_token_files
QUERIES["op5_license_scan"] = op5_license_scan
QUERIES["op6_quality_classifier"] = op6_quality_classifier
QUERIES["op7_simhash_near_dedup"] = op7_simhash_near_dedup
QUERIES["op8_mix_sources"] = op8_mix_sources
QUERIES["op9_shard_documents"] = op9_shard_documents
QUERIES["op10_nearest_neighbours"] = op10_nearest_neighbours
QUERIES["op11_exact_dedup"] = op11_exact_dedup
QUERIES["op12_filter_audit"] = op12_filter_audit
QUERIES["op13_source_divergence"] = op13_source_divergence
ORACLE_SQL.update(sql.oracle_sql())
