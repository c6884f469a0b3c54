from collections import Counter

import pytest
from pyspark.sql import functions as F

from chunkloom.llm import langid, queries


def grams(text):
    """Brute force: padded words, 1- to 3-grams."""
    out, word = Counter(), ""
    flat = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    s = " " + " ".join(flat) + " " if flat else ""
    out.update(c for c in s if c != " ")
    out.update(s[i : i + 2] for i in range(len(s) - 1))
    out.update(s[i : i + 3] for i in range(len(s) - 2) if s[i + 1] != " ")
    return out


def packed(gram):
    key = 0
    for c in gram:
        key = key << 21 | (langid.BLANK if c == " " else ord(c))
    return key


@pytest.mark.parametrize("text", ["", "a", "Ab cd!", "...", " x  y1z ", "Ünïcödé 日本 \U00010400", "aaa aaa"])
def test_counts_against_brute_force(text):
    keys, counts = langid.count_grams(text)
    assert dict(zip(keys.tolist(), counts.tolist())) == {packed(g): n for g, n in grams(text).items()}


def test_long_texts_count_in_slices(monkeypatch):
    text = "the quick brown fox, 12 jumps; " * 50
    whole = langid.count_grams(text)
    for size in (1, 7, 64, 1_000):
        monkeypatch.setattr(langid, "SLICE", size)
        part = langid.count_grams(text)
        assert (whole[0] == part[0]).all() and (whole[1] == part[1]).all()


def brute(text, profiles, size):
    c = Counter()
    for g, n in grams(text or "").items():
        c[packed(g)] += n
    own = sorted(c, key=lambda k: (-c[k], k))[:size]
    if not own:
        return "und", 0.0
    far = {lang: sum(abs(i - p.index(k)) if k in p else size for i, k in enumerate(own)) for lang, p in profiles.items()}
    best = min(sorted(far), key=far.get)
    return best, 1 - far[best] / (size * len(own))


def test_distance_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    profiles = langid.fit_profiles(docs.filter(~langid.held_out()))
    got = {r.doc_id: (r.lang_pred, r.score) for r in queries.op6_language_id(spark, sf_dir).collect()}
    for r in docs.collect():
        lang, score = brute(r.text, profiles, langid.PROFILE_SIZE)
        assert got[r.doc_id][0] == lang and abs(got[r.doc_id][1] - score) < 1e-12


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    r = queries.op6_language_id(spark, sf).join(docs, "doc_id").filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("a")).first()
    assert r.a > 0.97


def test_held_out_rows_are_not_read(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    changed = docs.withColumn("lang", F.when(langid.held_out(), F.lit("xx")).otherwise(F.col("lang")))
    assert langid.fit_profiles(docs.filter(~langid.held_out())) == langid.fit_profiles(changed.filter(~langid.held_out()))


def test_tables(spark):
    docs = spark.createDataFrame([(1, None, "en"), (None, "hello", "en"), (2, "12 !", None), (3, "", "fr"), (3, "", "fr")], "doc_id long, text string, lang string")
    profiles = {"fr": [ord("e"), ord("l")], "en": [ord("e"), ord("l")]}
    got = langid.predict_languages(docs, profiles).collect()
    assert [r.lang_pred for r in got] == ["und", "en", "und", "und", "und"]  # a tie goes to the first name
    assert all(0 <= r.score <= 1 for r in got)
    assert [r.lang_pred for r in langid.predict_languages(docs, {}).collect()] == ["und"] * 5
    assert langid.fit_profiles(docs.limit(0)) == {} and langid.predict_languages(docs.limit(0), profiles).count() == 0
    assert langid.predict_languages(docs.withColumn("score", F.lit(1)), profiles, keep=["doc_id", "score"]).columns == ["doc_id", "lang_pred", "score"]


def test_very_long_texts_through_spark(spark):
    """Texts of several slices, one of them with letters in its last slice only."""
    german, english = "der hund und die katze sind nicht im haus ", "the dog and the cat are not in the house "
    docs = spark.createDataFrame([(i, t * 20, lang) for i, (t, lang) in enumerate([(german, "de"), (english, "en")] * 10)], "doc_id long, text string, lang string")
    profiles = langid.fit_profiles(docs)
    long = spark.createDataFrame([(1, english * 60_000), (4, "1 2 3 " * 500_000 + german * 20), (2, "1 2 3 " * 500_000), (3, german * 60_000)], "doc_id long, text string")
    got = {r.doc_id: r.lang_pred for r in langid.predict_languages(long, profiles).collect()}
    assert got == {1: "en", 2: "und", 3: "de", 4: "de"}
