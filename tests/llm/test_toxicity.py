"""Toxicity: held-out accuracy, odd inputs, one class only."""

import pickle
import random
from collections import Counter

import pytest
import zstandard
from pyspark.sql import functions as F

from gainsieve.llm import toxicity as T
from gainsieve.llm.toxicity import CompressionModel, learn, score_documents, train, with_scores


@pytest.fixture(scope="module")
def rows():
    dice = random.Random(3)
    syllables = "an the re on at en nd ti es or te of ed is it al ar st to nt".split()
    word = lambda: "".join(dice.choices(syllables, k=dice.randint(1, 3)))
    out = []
    for i in range(900):
        words = [word() for _ in range(dice.randint(20, 300))]
        if i % 5 == 0:
            for at in dice.choices(range(len(words)), k=max(2, len(words) // 50)):
                words[at] = dice.choice(["Grumbleby,", "snorkwort", "zabblefisk."])
        out.append((" ".join(words), int(i % 5 == 0)))
    return out


def test_held_out(rows):
    model = pickle.loads(pickle.dumps(train(rows[:600])))
    wrong = [label for text, label in rows[600:] if (model.score(text) >= 0.3) != label]
    assert len(wrong) <= 6, wrong
    assert all(0 <= model.score(t) <= 1 for t in (None, "", " ", "x", "\U0001f600" * 9))


def test_order_of_rows_plays_no_part(rows):
    model = train(rows[:150])
    assert len(model.toxic) > len(model.ordinary) and max(model.weights) > 1
    for seed in range(5):
        mixed = rows[:150]
        random.Random(seed).shuffle(mixed)
        again = train(mixed)
        assert (again.ordinary, again.toxic, again.weights, again.line) == (model.ordinary, model.toxic, model.weights, model.line)


@pytest.mark.parametrize("words", [1, 3])
def test_windows_measured_by_hand(rows, words):
    """Kinds of windows from the lengths that zstandard gives under the two dictionaries."""
    model = train(rows[:150], words)
    text = rows[5][0] + " Grumbleby snorkwort's " + rows[6][0]
    plain = zstandard.ZstdCompressionParameters.from_level(T.LEVEL, write_content_size=False, write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
    lengths = []
    for content in (model.ordinary, model.toxic):
        own = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        lengths.append(lambda data, own=own: len(zstandard.ZstdCompressor(dict_data=own, compression_params=plain).compress(data)))
    each, expected = text.lower().split(), [0] * T.KINDS
    for at in range(0, len(each), words):
        bare = " ".join(each[at : at + words]).strip(T.EDGES)
        data = b"".join(bytes((b, b ^ 0x5A, (b * 7 + 13) & 255, (b * 31 + 101) & 255)) for b in f" {bare} ".encode())
        ordinary, toxic = (length(data) for length in lengths)
        expected[min(max(ordinary - toxic, 0), T.MOST_SAVED) * T.LEFT_STEPS + min(toxic // T.LEFT_STEP, T.LEFT_STEPS - 1)] += 1
    assert model.savings(text).tolist() == expected


def test_runs_by_length(rows):
    texts = [(i % T.TURNS, t) for i, (t, _) in enumerate(rows[:40])]
    plain = Counter(r for _, t in texts for r in T.runs(t))
    found = T.frequent_runs(texts, 3)
    assert sum(found, Counter()) == {r: n for r, n in plain.items() if n >= 3}
    assert found[1] == Counter(r for i, t in texts if i == 1 for r in T.runs(t) if plain[r] >= 3)


def test_nothing_learnt_is_told():
    with pytest.warns(UserWarning, match="no window tells"):
        train([("the same words", i % 2) for i in range(40)])


def test_scores_replace_a_column(spark, frame, rows):
    model = train(rows[:150])
    scored = with_scores(frame.withColumn("SCORE", F.lit("x")).drop("score"), model)
    assert scored.columns[-1] == "score" and [c.lower() for c in scored.columns].count("score") == 1
    assert {(r["doc_id"], r["score"]) for r in scored.collect()} == {tuple(r) for r in score_documents(frame, model, "doc_id").collect()}


def test_one_class():
    assert train([]).score("a b") == pytest.approx(0, abs=1e-6)
    assert train([("a", 1), (None, 1)]).score("a") > 0.99
    assert isinstance(train([("a", 0), ("b", 1)]), CompressionModel)


def test_tables(spark, frame, documents, rows):
    labelled = spark.createDataFrame([(i, t, y) for i, (t, y) in enumerate(rows)], "doc_id long, text string, toxic int")
    labels = labelled.select("doc_id", F.when(F.col("doc_id") != 7, F.col("toxic")).alias("toxic"))
    model = learn(labelled, labels, sample=(300, 100))
    scores = score_documents(frame, model, "doc_id")
    assert scores.count() == len(documents) and scores.where("score BETWEEN 0 AND 1").count() == len(documents)
    assert score_documents(frame.limit(0), learn(labelled, labels.limit(0)), "doc_id").count() == 0
