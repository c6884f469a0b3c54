import re

import corpus_pipeline
from chunkloom.llm import langid, minhash, packing, toxicity
from tests.llm.test_minhash import brute


def test_stages_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    rows = {r.doc_id: r.text for r in docs.collect()}
    out = docs
    kept = dict(rows)
    lexicon = toxicity.fit_lexicon(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~toxicity.held_out()))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, out, sf_dir)
        if name == "language_id":
            kept = {i: t for i, t in kept.items() if t and any(c.isalpha() for c in t)}
        elif name == "toxicity":
            kept = {i: t for i, t in kept.items() if lexicon.score(t) < toxicity.THRESHOLD}
        elif name == "near_duplicates":
            kept = {i: t for i, t in kept.items() if brute(list(kept.items()))[i][2]} if len(kept) < 5 else {i: kept[i] for i, v in brute(list(kept.items())).items() if v[2]}
        if name != "packing":
            assert out.columns == columns
            assert {r.doc_id: r.text for r in out.collect()} == kept
    tokens = {}
    for r in out.collect():
        tokens[r.doc_id] = tokens.get(r.doc_id, 0) + r.n_tokens
    assert tokens == {i: len(re.findall(r"\S+", t)) for i, t in kept.items()}
    assert corpus_pipeline.run(spark, sf_dir).count() == out.count()
    assert [len(corpus_pipeline.STAGES), langid.PROFILE_SIZE > 0, minhash.PERCENT, packing.CAPACITIES[-1]] == [4, True, 75, 4096]


def test_odd_documents(spark, sf_dir):
    rows = [(1, None, "en", "s", 0), (2, "", "en", "s", 0), (3, "!!! 123", None, None, None), (None, "bonjour les amis de la maison", "fr", "s", 3), (5, "hello the world of the words", "en", "s", 3), (5, "hello the world of the words", "en", "s", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = docs.selectExpr("*", "1 AS score", "'x' AS lang_pred", "2 AS c0", "3 AS bin_id")
    names = out.columns
    for _, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, out, sf_dir)
        assert out.columns == names
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=repr) == [(5, rows[4][1]), (None, rows[3][1])]
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, sf_dir)
    assert empty.count() == 0
