import hashlib
import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from chunkloom.llm import bpe, queries

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def same(library, text):
    want = library.encode(text, add_special_tokens=False).ids
    got = bpe.codec(PATH).encode(text)
    assert got == want
    assert bpe.codec(PATH).decode(got) == library.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("text", ["", "   ", "Hello, World!", "don't can'T it's 'S", "<|startoftext|>a <|endoftext|>b<|STARTOFTEXT|>", "aaaaaaaaaaaaaaaaaaaa hahahahaha", "ΑΣ ΣΑΣ", "İI Ⅳ²½", "a\x1cb\x85c\u2028d\u200be", "\U0001f600\U0001f468‍\U0001f469 中文", "e\u0301 \u212b \ufb01", "x" * 5_000, "word " * 20_000])
def test_as_the_library(library, text):
    same(library, text)


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(max_codepoint=0x24FF, exclude_categories=["Cs", "Cn"]), max_size=30))
def test_any_text_as_the_library(library, text):
    same(library, text)


def test_every_code_point_between_letters_as_the_library(library):
    texts = [f"a{chr(i)}b" for i in range(0x110000) if not 0xD800 <= i <= 0xDFFF]
    codec = bpe.codec(PATH)
    for s in range(0, len(texts), 20_000):
        for text, want in zip(texts[s : s + 20_000], library.encode_batch(texts[s : s + 20_000], add_special_tokens=False)):
            assert codec.encode(text) == want.ids, ascii(text)


def test_states_and_rows():
    """Every pair of tokens: the table's arc says whether BPE leaves the pair alone."""
    a, r = bpe.codec(PATH).automaton, random.Random(8)
    tokens = [t for t in a.labels if t not in a.dead]
    inner = [t for t in tokens if not a.labels[t].endswith("</w>")]

    def spelled(t):
        return [t] if t not in a.parts else spelled(a.parts[t][0]) + spelled(a.parts[t][1])

    rank = {pair: (n, a.vocab[a.labels[pair[0]] + a.labels[pair[1]]]) for pair, n in a.rank.items()}
    for _ in range(3_000):
        x, y = r.choice(inner), r.choice(tokens)
        assert a.arc(x, y) == (naive(spelled(x) + spelled(y), rank) == [x, y])
    assert len(a.rows) <= len(a.numbers) + 1 and all(row == sorted(set(row)) for row in a.rows)


def test_joined_tokens_as_the_library(library):
    r, tokens = random.Random(5), [t.replace("</w>", "") for t in library.get_vocab()]
    for _ in range(3_000):
        same(library, "".join(r.choice(tokens) for _ in range(r.randint(1, 4))))


def naive(word: list[int], rank: dict) -> list[int]:
    while True:
        best = min((rank.get(p, (1 << 60, 0)) + (i,) for i, p in enumerate(zip(word, word[1:]))), default=(1 << 60, 0, 0))
        if best[0] == 1 << 60:
            return word
        word = word[: best[2]] + [best[1]] + word[best[2] + 2 :]


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 10**9))
def test_automaton_against_merging_by_rank(seed):
    """Random merge lists over three letters, among them doubled tokens and tokens that no merge can reach."""
    r = random.Random(seed)
    vocab = {c + e: i for i, (c, e) in enumerate((c, e) for c in "abc" for e in ("", "</w>"))}
    merges, rank = [], {}
    for _ in range(12):
        u = r.choice([t for t in vocab if not t.endswith("</w>")])
        v = r.choice(list(vocab))
        if u + v not in vocab:
            vocab[u + v] = len(vocab)
            rank[vocab[u], vocab[v]] = (len(merges), vocab[u + v])
            merges.append((u, v))
    a = bpe.Automaton(vocab, merges, "</w>")
    for _ in range(40):
        word = "".join(r.choice("abc") for _ in range(r.randint(1, 9)))
        assert a.encode_word(word) == naive([vocab[c] for c in word[:-1]] + [vocab[word[-1] + "</w>"]], rank)


def test_query_and_tables(spark, sf_dir, library):
    rows = {r.doc_id: r for r in queries.op2_bpe(spark, sf_dir).collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert rows.keys() == texts.keys()
    for i, text in texts.items():
        ids = library.encode(text, add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert (rows[i].n_tokens, rows[i].ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert rows[i].decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()
    df = spark.createDataFrame([(1, None, 0), (None, "a b", 0), (2, "", 0), (2, "a b", 0)], "doc_id long, text string, n_tokens int")
    empty = hashlib.sha256(b"").hexdigest()
    got = bpe.encode_digests(df, PATH).collect()
    assert [r.n_tokens for r in got] == [0, 2, 0, 2] and got[0].ids_sha256 == got[2].decoded_sha256 == empty
    encoded = bpe.encode(df, PATH)
    assert [r.text for r in bpe.decode(encoded, PATH).collect()] == ["", "a</w> b</w>", "", "a</w> b</w>"]
    assert bpe.encode_digests(df.limit(0), PATH).count() == 0


def test_memo_starts_anew():
    c = bpe.Codec(PATH, cache_words=10)
    text = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200))
    assert c.digest(text) == bpe.codec(PATH).digest(text) and len(c.memo) <= 10
