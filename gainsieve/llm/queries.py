"""The registered queries of this folder and their SQL."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import functions as F

from gainsieve.llm import kneser_ney, oracles
from gainsieve.llm.bpe import round_trip
from gainsieve.llm.collocations import collocations
from gainsieve.llm.common import fold_of, table
from gainsieve.llm.packing import pack_documents
from gainsieve.llm.periodic import periodic_runs
from gainsieve.llm.quality import MEASURES, clean_documents
from gainsieve.llm.resharding import reshard
from gainsieve.llm.simhash import near_duplicates
from gainsieve.llm.suffixes import remove_repeats
from gainsieve.llm.token_counts import token_counts
from gainsieve.llm.topk import top_k
from gainsieve.llm.toxicity import learn, score_documents
from gainsieve.llm.vector_links import near_vectors

TOXIC_FROM = 0.3
SHARDS = 8
LANGUAGE_MODEL_ORDER = 3


def op1_quality(spark, sf_dir):
    """Line-first cleaning of all documents: measures and verdicts."""
    judged = clean_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", *MEASURES, "base_failed", "kept", "n_lines", "n_bad_lines", "clean_chars")


def op2_packing(spark, sf_dir):
    """All documents packed into sequences of at most 2,048 tokens."""
    return pack_documents(table(spark, sf_dir, "documents"), "doc_id")


def op3_resharding(spark, sf_dir):
    """All documents from shards by source, which are uneven, to 8 of equal bytes, moving the fewest."""
    text = F.coalesce("text", F.lit(""))
    old = F.pmod(F.crc32(F.coalesce("source", F.lit("")).cast("binary")), F.lit(SHARDS))
    crc = F.crc32(text.cast("binary"))
    placed = reshard(table(spark, sf_dir, "documents"), "doc_id", F.octet_length(text) + 1, old, SHARDS, SHARDS, {"text_crc32": crc})
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard")


def op4_exact_top_k(spark, sf_dir):
    """The 5 highest inner products of every 50th vector with all others."""
    return top_k(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("id") % 50 == 0)


def op5_suffix_dedup(spark, sf_dir):
    """Bytes of all documents in 100-byte strings that also start earlier, removed."""
    left = remove_repeats(table(spark, sf_dir, "documents"), "doc_id")
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op6_token_counts(spark, sf_dir):
    """Greedy word-piece lengths of all documents."""
    return token_counts(table(spark, sf_dir, "documents"), "doc_id")


def op7_simhash(spark, sf_dir):
    """Near-duplicate components of all documents."""
    return near_duplicates(table(spark, sf_dir, "documents"), "doc_id")


def toxicity_model(spark, sf_dir):
    """A model of the labels outside the held-out fold."""
    labels = table(spark, sf_dir, "labels").where(fold_of("doc_id", 4) != 2)
    return learn(table(spark, sf_dir, "documents"), labels)


def toxicity_scores(spark, docs, sf_dir):
    """``doc_id, score`` of ``docs`` by that model."""
    return score_documents(docs, toxicity_model(spark, sf_dir), "doc_id")


def op8_toxicity(spark, sf_dir):
    """Toxicity of all documents by compression distance."""
    scores = toxicity_scores(spark, table(spark, sf_dir, "documents"), sf_dir)
    return scores.select("doc_id", (fold_of("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"))


def op9_byte_bpe(spark, sf_dir):
    """Encoding of all documents and its decoding, as digests."""
    return round_trip(table(spark, sf_dir, "documents"), "doc_id")


def op10_language_model(spark, sf_dir):
    """Kneser-Ney scores of all documents, learnt outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    model = kneser_ney.train(docs.where(fold_of("doc_id", 7) != 2), order=LANGUAGE_MODEL_ORDER)
    scores = kneser_ney.score(docs, model, "doc_id")
    return scores.select("doc_id", (fold_of("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op11_vector_links(spark, sf_dir):
    """Near-duplicate components of all vectors at a cosine of 0.95."""
    return near_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


def looped(doc_id, n):
    """The order of the words of every tenth document or so: from word a on, the next p words over and over."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.append(np.arange(a), a + np.arange(n - a) % p)


def op12_periodic_runs(spark, sf_dir):
    """All periodic runs of all documents, some of which are looped first, as digests."""
    found = periodic_runs(table(spark, sf_dir, "documents"), "doc_id", order=looped)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], -r["start"], -r["period"])))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    told = found.select("doc_id", "runs", "collapsed", best.alias("best")).select("*", (-F.col("best.col2")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.col3")).alias("period"))
    return told.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "start", "length", "period", F.expr("(1000 * length) div period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_collocations(spark, sf_dir):
    """The 2,000 best collocations of every language."""
    return collocations(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in [op1_quality, op2_packing, op3_resharding, op4_exact_top_k, op5_suffix_dedup, op6_token_counts, op7_simhash, op8_toxicity, op9_byte_bpe, op10_language_model, op11_vector_links, op12_periodic_runs, op13_collocations]}

ORACLES = {"op1_quality": oracles.QUALITY, "op4_exact_top_k": oracles.TOP_K, "op11_vector_links": oracles.VECTOR_LINKS, "op13_collocations": oracles.COLLOCATIONS}
