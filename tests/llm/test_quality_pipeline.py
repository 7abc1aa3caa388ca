"""Quality rules against plain Python, and the stages of the pipeline."""

import re
import zlib
from collections import Counter
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F
from test_simhash import plain_components, plain_fingerprint
from test_suffixes import plain

import corpus_pipeline
from gainsieve.llm.quality import clean_documents

BLANK = r"[\x20\x09-\x0D]"


def measures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if count[g] > 1 for k in range(3)}
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered), failed


def test_measures(frame, documents):
    judged = clean_documents(frame)
    assert set(frame.columns) <= {*judged.columns, "kept"}
    for rows in (judged.collect(), judged.where("kept OR NOT kept").where("n_repeat_words >= 0").collect()):
        got = Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in rows)
        assert got == Counter((k, *measures(t)) for k, t in documents)
    assert clean_documents(frame.limit(0)).count() == 0


@pytest.mark.parametrize(
    "line, bad",
    [
        ("Home | About | Contact | Help", True),
        ("Home > News", True),
        ("The price is a > b, as shown above.", False),
        ("WORDS!! SHOUTED!! OUT!!", True),
        ("One word*** and then nothing of the kind in a long enough line.", False),
        ("All Rights Reserved.", True),
        ("A line of prose.", False),
        ("An ordinary line without an end", False),
        ("x## y%% z", True),
    ],
)
def test_lines(spark, line, bad):
    prose = " ".join(f"word{i}" for i in range(60)) + "."
    row = clean_documents(spark.createDataFrame([(1, f"{prose}\n{line}\n\n")], "doc_id long, text string")).first()
    assert (row["n_lines"], row["n_bad_lines"], row["kept"]) == (2, int(bad), True)
    assert row["clean_text"] == (prose if bad else f"{prose}\n{line}")


def test_stages(spark, sf_dir, frame):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = docs.limit(1).select((F.col("doc_id") + 5000).alias("doc_id"), F.lit(None).cast("string").alias("text"), "lang", "source", "n_chars")
    docs = docs.unionByName(odd)
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "toxicity", "simhash_near_dedup", "suffix_dedup", "best_fit_packing"]
    cleaned = corpus_pipeline.materialise(stages["quality_rules"](spark, docs, sf_dir))
    assert cleaned.columns == docs.columns
    kept = {r["doc_id"] for r in clean_documents(docs).where("kept").collect()}
    assert {r["doc_id"] for r in cleaned.collect()} == kept
    mild = stages["toxicity"](spark, cleaned, sf_dir)
    assert mild.columns == docs.columns and {r["doc_id"] for r in mild.collect()} <= kept
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    unlike = corpus_pipeline.materialise(stages["simhash_near_dedup"](spark, docs, sf_dir))
    prints = {k: plain_fingerprint(t) for k, t in texts}
    label = plain_components(prints, [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 3])
    assert sorted(r["doc_id"] for r in unlike.collect()) == sorted(k for k in prints if label[k] == k)
    left = stages["suffix_dedup"](spark, docs, sf_dir)
    assert left.columns == docs.columns
    expected = {k: bytes_left.decode("utf-8", "ignore") for k, _, _, _, bytes_left in plain(texts, 100)}
    assert {r["doc_id"]: r["text"] or "" for r in left.collect()} == expected
    packed = stages["best_fit_packing"](spark, docs, sf_dir)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == set(prints)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf_dir).count() == 0, name


def test_stages_with_null_and_repeated_ids(spark, sf_dir, monkeypatch):
    """Every row is judged by its own text, whatever its id; ``source`` tells the rows apart."""
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("source", F.col("doc_id").cast("string"))
    verdict = lambda text: zlib.crc32((text or "").encode()) % 2
    monkeypatch.setattr(corpus_pipeline, "toxicity_model", lambda spark, sf_dir: SimpleNamespace(score=lambda text: float(verdict(text))))
    docs = docs.where("doc_id % 3 < 2").withColumn("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("doc_id") % 6))
    docs = corpus_pipeline.materialise(docs.unionByName(docs.where("length(source) = 2")))
    rows = docs.collect()
    sources = lambda rows: Counter(r["source"] for r in rows)
    assert {r["doc_id"] for r in rows} == {None, 0, 4} and max(sources(rows).values()) == 2
    cleaned = stages["quality_rules"](spark, docs, sf_dir).collect()
    assert sources(cleaned) == sources(clean_documents(docs).where("kept").collect())
    mild = stages["toxicity"](spark, docs, sf_dir).collect()
    assert sources(mild) == sources(r for r in rows if not verdict(r["text"]))
    assert 0 < len(mild) < len(rows)
    prints = {r["source"]: plain_fingerprint(r["text"]) for r in rows}
    label = plain_components(prints, [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 3])
    first = {}
    for r in rows:
        order = (r["doc_id"] is None, r["doc_id"] or 0)
        first[label[r["source"]]] = min(order, first.get(label[r["source"]], order))
    unlike = stages["simhash_near_dedup"](spark, docs, sf_dir).collect()
    assert Counter((label[r["source"]], r["doc_id"] is None, r["doc_id"] or 0) for r in unlike) == Counter((k, *v) for k, v in first.items())
    left = stages["suffix_dedup"](spark, docs, sf_dir)
    assert left.columns == docs.columns
    expected = Counter()
    for (k, _, _, _, kept), n in plain([(r["doc_id"], r["text"]) for r in rows], 100).items():
        expected[k, kept.decode("utf-8", "ignore")] += n
    left = left.collect()
    assert Counter((r["doc_id"], r["text"]) for r in left) == expected and sources(left) == sources(rows)
    packed = stages["best_fit_packing"](spark, docs, sf_dir)
    assert packed.where("piece = 0").count() == len(rows)


def test_stages_with_clashing_columns(spark, sf_dir):
    """Names that the stages use inside are columns like any other."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40)
    names = ["_score", "_row", "row", "_key", "_null", "_new_text", "clean_text", "_clean", "kept", "docs", "k", "fp", "carried"]
    wide = corpus_pipeline.materialise(docs.select("*", *(F.col("doc_id").cast("string").alias(n) for n in names)))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, wide, sf_dir)
        assert out.columns == wide.columns, name
        rows = out.collect()
        assert rows and all(r[n] == str(r["doc_id"]) for r in rows for n in names), name
        assert sorted(r["doc_id"] for r in rows) == sorted(r["doc_id"] for r in stage(spark, docs, sf_dir).collect()), name
