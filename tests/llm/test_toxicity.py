import math
import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chunkloom.llm import queries, toxicity
from chunkloom.llm.toxicity import Lexicon, fold

LEX = Lexicon({" idiot ": 9.0, fold("clown"): 9.0, " trash ": 9.0, " viie": 3.0})


@pytest.mark.parametrize("text", ["you idiot", "IDIOT!!", "1d10t", "an ìdíöt", "\u0456\u0501\u0456\u043et", "id\u200biot", "ｉｄｉｏｔ", "c10wn", "the trash can holds trash", "idiot$$$", "x idi0t%%%", "vile vilest vileness"])
def test_caught(text):
    assert LEX.score(text) >= toxicity.THRESHOLD


@pytest.mark.parametrize("text", [None, "", "  ", "!!! 123", "a clown fish", "the trash can", "idiotic", "downtown", "Clown-Fish", "one vileness"])
def test_left_alone(text):
    assert LEX.score(text) < toxicity.THRESHOLD


def test_length_counts_slowly():
    scores = [LEX.score("idiot " + "fine " * n) for n in (1, 100, 5_000, 200_000)]
    assert scores == sorted(scores, reverse=True) and scores[2] >= toxicity.THRESHOLD and 0 <= min(scores) <= max(scores) <= 1


def test_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    rows = queries.op3_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").select("predicted", "toxic").collect()
    hit = sum(r.predicted and r.toxic for r in rows)
    assert hit / sum(r.toxic for r in rows) > 0.9 and hit / sum(r.predicted for r in rows) > 0.9


def test_held_out_labels_are_not_read(spark):
    docs = spark.createDataFrame([(i, f"plain words number{i} {'vile' if i % 2 else 'nice'} c{i} d") for i in range(400)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    lexicon = toxicity.fit_lexicon(docs, labels.filter(~toxicity.held_out()))
    other = toxicity.fit_lexicon(docs, labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic"))).filter(~toxicity.held_out()))
    assert list(lexicon.weights) == [fold("vile")] and lexicon.weights == other.weights


def test_copies_do_not_make_terms(spark):
    docs = spark.createDataFrame([(i, "one copied text with its own words") for i in range(100)] + [(100 + i, f"clean text {i}") for i in range(100)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") < 100).cast("int").alias("toxic"))
    assert toxicity.fit_lexicon(docs, labels).weights == {}


def test_terms_do_not_depend_on_partitions(spark):
    """An insult of independent texts, which a copied text of a third of the toxic rows holds too."""
    r = random.Random(5)
    words = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(7)) for _ in range(n))
    toxic = [f"{words(4)} vile {words(4)}" for _ in range(60)] + [f"copied words that are vile {words(6)}"] * 240 + [words(9) for _ in range(420)]
    docs = spark.createDataFrame(list(enumerate(toxic + [words(9) for _ in range(720)])), "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") < len(toxic)).cast("int").alias("toxic"))
    few, many = (toxicity.fit_lexicon(docs.repartition(n), labels) for n in (1, 300))
    assert fold("vile") in few.weights and few.weights == many.weights and few.curve == pytest.approx(many.curve)


def test_repeated_documents_change_nothing(spark):
    """The same rows twice under other ids, in 1, 8 and 64 partitions: one lexicon."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    twice = lambda df: df.unionByName(df.withColumn("doc_id", F.col("doc_id") + 1_000_000))
    found = [toxicity.fit_lexicon(twice(docs).repartition(n), twice(labels)) for n in (1, 8, 64)]
    assert found[0].weights and all(x.weights == found[0].weights for x in found)
    assert toxicity.fit_lexicon(docs, labels).weights == found[0].weights


def naive_weigh(lexicon, text):
    """Every term and phrase looked for at every place."""
    folded = fold(text or "")
    spared = [(i, i + len(p)) for p in map(fold, lexicon.exceptions) for i in range(len(folded)) if folded.startswith(p, i)]
    total = 0.0
    for i, c in enumerate(folded):
        if c == " ":
            hits = [(w, i + len(t)) for t, w in lexicon.weights.items() if folded.startswith(t, i)]
            heaviest = max((w for w, _ in hits), default=0)
            if hits and not any(a <= i and stop <= b for w, stop in hits if w == heaviest for a, b in spared):
                total += heaviest
    return total


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["idiot", "1d10t", "idiotic", "clown", "clowns", "clown fish", "Clown-Fish", "trash", "trash can", "trashy", "vile", "vileness", "vi1e", "the", "x", "!", "0", "class clown", "\u0456diot"]), max_size=12).map(" ".join))
def test_against_a_naive_matcher(text):
    total, words = LEX.weigh(text)
    assert total == pytest.approx(naive_weigh(LEX, text)) and words in (0, len(fold(text).split()))


def test_query_against_a_naive_scorer(spark, sf_dir, monkeypatch):
    """Every document's score from the fitted lexicon, matched naively."""
    fitted = []
    real = toxicity.fit_lexicon
    monkeypatch.setattr(toxicity, "fit_lexicon", lambda *x, **y: fitted.append(real(*x, **y)) or fitted[-1])
    sf = "/root/testdata/sf0.01"
    rows = queries.op3_toxicity(spark, sf).collect()
    lexicon = fitted[0]
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert lexicon.weights and len(rows) == len(texts)
    for r in rows:
        total = naive_weigh(lexicon, texts[r.doc_id])
        z = lexicon.curve[0] + lexicon.curve[1] * math.log1p(total) + lexicon.curve[2] * math.log1p(len(fold(texts[r.doc_id]).split()) / toxicity.LENGTH_AT)
        assert r.score == pytest.approx(1 / (1 + math.exp(-z)) if total else 0.0) and r.predicted == (r.score >= 0.3)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "idiot", 5, True)], "doc_id long, text string, predicted int, held_out boolean")
    assert [(r.doc_id, r.predicted, r.held_out) for r in toxicity.score_toxicity(docs, LEX, keep=docs.columns).collect()] == [(1, 5, True)]


def test_tables(spark):
    docs = spark.createDataFrame([(1, None, "x"), (None, "idiot", "y"), (2, "idiot", None), (2, "idiot", None), (3, "", "")], "doc_id long, text string, lang string")
    got = toxicity.score_toxicity(docs, LEX, keep=["doc_id", "lang"])
    assert [(r.doc_id, round(r.score, 2)) for r in got.collect()] == [(1, 0), (None, 0.95), (2, 0.95), (2, 0.95), (3, 0)]
    assert toxicity.score_toxicity(docs.limit(0), LEX).count() == 0
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.fit_lexicon(docs, none).weights == {}
    assert toxicity.score_toxicity(docs.withColumn("Score", F.lit(1)), LEX, keep=["doc_id", "Score"]).columns == ["doc_id", "score"]
    assert [r.h for r in docs.select(toxicity.held_out().alias("h")).collect()].count(None) == 0


def test_very_long_texts_through_spark(spark):
    """The only insult stands at the end of megabytes of innocent words."""
    rows = [(1, "fine words " * 300_000 + "idiot"), (2, "fine words " * 300_000), (3, "idiot " * 300_000)]
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(spark.createDataFrame(rows, "doc_id long, text string"), LEX).collect()}
    assert 0 < got[1] < got[3] and got[2] == 0 and got[3] > 0.9
