import html as html_lib
import random
import re

import numpy as np
import pytest

from chunkloom.llm import extract, queries

PAGE = """<!doctype html><html><head><title>T</title><style>p{{}}</style></head><body><nav><ul><li><a href="/">Home</a></li><li>More</li></ul></nav>
<div class="cookie-notice">We use cookies</div><article><h1>Head &amp; line</h1><p>{0}<br>second&nbsp;line <em>joi</em>ned</p><form><p>form</p></form>
<aside>side</aside><script>var t="</article><p>no</p>";</script><section class="comments"><article class="comment"><p>reader says</p></article></section><p>Last.</p></article>
<div class="ad">Buy</div><footer>&copy; us</footer></body></html>"""


def test_article_without_everything_else():
    assert extract.extract_bundle([PAGE.format("First &lt;b&gt;")]) == ["Head & line\n\nFirst <b> second line joined\n\nLast."]


@pytest.mark.parametrize(("source", "text"), [
    (None, ""), ("", ""), ("   ", ""), ("plain", "plain"), ("a < b", "a < b"), ("<p>x<!-- y", "x"), ("<p>x</p><p cl", "x"), ("<p>x &am", "x &am"), ("<p>&amp;lt;", "&lt;"),
    ("<p>a<p>b<div>c<span>d</span></div>", "a\n\nb\n\ncd"), ("<script>x", ""), ("<p>\U0001f600 é</p>", "\U0001f600 é"), ("<p hidden>x</p><p>y</p>", "y"), ("<main><header><h1>t</h1></header><p>x</p></main><p>out</p>", "t\n\nx"),
])
def test_edge_pages(source, text):
    assert extract.extract_bundle([source]) == [text]


def test_article_copies_on_one_host_stay():
    assert extract.extract_bundle([PAGE.format("same " * 30)] * 5) == ["Head & line\n\n" + " ".join(["same"] * 30) + " second line joined\n\nLast."] * 5


def test_repeated_runs_go_where_markup_is_silent():
    r = random.Random(1)
    shared = "Welcome to our portal of good things please read on"
    bodies = [" ".join(f"w{r.randrange(10_000)}" for _ in range(40)) for _ in range(6)]
    pages = [f"<html><body><div>{shared}</div><div>{b}</div></body></html>" for b in bodies]
    assert extract.extract_bundle(pages) == bodies
    assert extract.extract_bundle(pages[:1]) == [f"{shared}\n\n{bodies[0]}"]  # a single page repeats nothing
    assert extract.extract_bundle(pages[:1] * 3) == [f"{shared}\n\n{bodies[0]}"] * 3  # copies are one page


def test_repeats_against_brute_force():
    r = np.random.default_rng(3)
    for _ in range(30):
        streams = [r.integers(0, 3, r.integers(0, 40)) for _ in range(5)]
        digests = list(range(5))
        reach, length, starts = extract.covered(streams, digests, 4)
        owners: dict[tuple, set] = {}
        for k, s in enumerate(streams):
            for i in range(len(s) - 3):
                owners.setdefault(tuple(s[i : i + 4]), set()).add(k)
        for k, s in enumerate(streams):
            want = np.zeros(len(s), int)
            for i in range(len(s) - 3):
                n = len(owners[tuple(s[i : i + 4])])
                if n > 1:
                    want[i : i + 4] = np.maximum(want[i : i + 4], n)
            assert (reach[starts[k] : starts[k + 1]] == want).all()
            # The longest run with another stream that covers a position.
            longest = np.zeros(len(s), int)
            for j, other in enumerate(streams):
                for x in range(len(s) if j != k else 0):
                    for y in range(len(other)):
                        n = 0
                        while x + n < len(s) and y + n < len(other) and s[x + n] == other[y + n]:
                            n += 1
                        if n >= 4:
                            longest[x : x + n] = np.maximum(longest[x : x + n], n)
            assert (length[starts[k] : starts[k + 1]] == longest).all()


def test_suffix_array_and_common_prefixes():
    r = np.random.default_rng(4)
    for _ in range(30):
        streams = [r.integers(0, 2, r.integers(1, 40)) for _ in range(4)] * 2
        tokens, size = np.concatenate(streams), [len(s) for s in streams]
        ends = np.repeat(np.cumsum(size), size)
        suffixes, lcp, _, _ = extract.suffix_array(tokens, ends, 4)
        whole = [tuple(tokens[i : ends[i]]) for i in range(len(tokens))]
        assert sorted(suffixes.tolist()) == list(range(len(tokens)))
        for i, j, n in zip(suffixes[:-1], suffixes[1:], lcp):
            same = next((k for k, (x, y) in enumerate(zip(whole[i], whole[j])) if x != y), min(len(whole[i]), len(whole[j])))
            assert whole[i] <= whole[j] and n == (same if same >= 4 else 0)


def articles(sf_dir):
    import pyarrow.parquet as pq

    rows = pq.read_table(f"{sf_dir}/pages.parquet").to_pylist()
    return {x["page_id"]: extract.extract_bundle([re.search("<article>.*</article>", x["html"], re.S)[0]])[0] for x in rows}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_returns_the_articles(spark, sf):
    got = {x.page_id: x.text for x in queries.op1_host_suffix_array(spark, f"/root/testdata/{sf}").collect()}
    assert got == articles(f"/root/testdata/{sf}")


def test_without_repetition_the_result_is_another(monkeypatch):
    """On sf0.01, in one bundle: without the suffix array's runs, the adverts stay on all pages."""
    import pyarrow.parquet as pq

    rows = pq.read_table("/root/testdata/sf0.01/pages.parquet").to_pylist()
    want, pages = list(articles("/root/testdata/sf0.01").values()), [x["html"] for x in rows]
    assert extract.extract_bundle(pages) == want
    real = extract.covered
    monkeypatch.setattr(extract, "covered", lambda *x: (lambda r: extract.Runs(np.zeros_like(r.pages), np.zeros_like(r.length), r.starts))(real(*x)))
    assert all(a != b for a, b in zip(extract.extract_bundle(pages), want))


def test_repeated_lines_in_articles():
    """A line in most articles of a host goes; articles that are copied to other pages stay whole, and so do passages of a few."""
    r = random.Random(2)
    words = lambda n: " ".join(f"w{r.randrange(10_000)}" for _ in range(n))
    line, passage, copied = words(12), words(60), words(100)
    bodies = [words(100) + (" " + passage if i < 9 else "") for i in range(40)]
    page = lambda body, i: f"<nav>menu {i}</nav><article><p>{body}</p><p>{line}</p></article>"
    assert extract.extract_bundle([page(b, i) for i, b in enumerate(bodies)]) == bodies
    same = [f"<nav>menu {i}</nav><article><p>{copied}</p></article>" for i in range(40)]
    assert extract.extract_bundle(same) == [copied] * 40


def test_slots_are_judged_by_what_repeats():
    r = random.Random(6)
    words = lambda n: " ".join(f"w{r.randrange(10_000)}" for _ in range(n))
    lines = [words(5) for _ in range(10)]
    article = [words(50) for _ in range(200)]
    # Text beside the article: of a template's ten lines in one slot, of its own on every page in the other.
    own = [words(30) for _ in range(200)]
    pages = [f"<div class=x>{lines[i % 10]}</div><article>{article[i]}</article><section>{own[i]}</section>" for i in range(200)]
    assert extract.extract_bundle(pages) == [f"{a}\n\n{o}" for a, o in zip(article, own)]
    # Reader comments differ everywhere and go all the same.
    pages = [f"<article>{article[i]}<div class=comments>{own[i]}</div></article>" for i in range(200)]
    assert extract.extract_bundle(pages) == article


def test_table_with_nulls_repeats_and_other_columns(spark):
    rows = [(1, "http://h.org/a", PAGE.format("x"), "z"), (1, "http://h.org/a", PAGE.format("x"), "z"), (2, None, None, None), (None, "h", "<p>t</p>", None), (3, "http://h.org/b", "", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, bundle string")
    got = sorted(((r.page_id, r.url, r.text, r.n_chars) for r in extract.extract_main_text(df).collect()), key=repr)
    want = "Head & line\n\nx second line joined\n\nLast."
    assert got == sorted([(1, "http://h.org/a", want, len(want))] * 2 + [(2, None, "", 0), (None, "h", "t", 1), (3, "http://h.org/b", "", 0)], key=repr)
    assert extract.extract_main_text(df.limit(0)).count() == 0


def test_large_hosts_are_dealt_on(spark):
    df = spark.createDataFrame([(i, f"http://h.org/{i}", PAGE.format(f"text {i}")) for i in range(60)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in extract.extract_main_text(df, bundle_bytes=5_000).collect()}
    assert got == {i: f"Head & line\n\ntext {i} second line joined\n\nLast." for i in range(60)}


def test_repeats_across_bundles_are_found(spark):
    r = random.Random(7)
    words = lambda n: " ".join(f"w{r.randrange(10_000)}" for _ in range(n))
    lines = [words(12) for _ in range(30)]
    # Each line stands on two pages of 60; bundles of about three pages hardly ever hold both.
    rows = [(i, f"http://h.org/{i}", f"<body><div>{lines[i % 30]}</div><div>{words(40)}</div></body>") for i in range(60)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {x.page_id: x.text for x in extract.extract_main_text(df, bundle_bytes=1_500).collect()}
    assert got == {i: h.split("<div>")[2].split("</div>")[0] for i, _, h in rows}
    whole = dict(zip(range(60), extract.extract_bundle([h for _, _, h in rows])))
    assert got == whole


def test_long_page():
    body = "".join(f"<p>word{i} &eacute;</p>" for i in range(20_000))
    assert extract.extract_bundle([f"<article>{body}</article>"])[0] == "\n\n".join(html_lib.unescape(f"word{i} &eacute;") for i in range(20_000))


def test_one_bundle_and_many_agree(spark):
    """Copies, articles and prose boilerplate of a host, and text that repeats an article only."""
    r = random.Random(8)
    words = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    prose, passage = words(40), words(12)
    pages = [f"<div>{prose}</div><div>{words(30)}</div>" for _ in range(12)] + [f"<div>{words(30)}</div>" for _ in range(20)]
    pages += [f"<div>{words(60)}</div>"] * 150  # copies are one page
    pages += [f"<article><p>{words(20)}</p><p>{passage}</p></article>", f"<div>{passage}</div><div>{words(20)}</div>"]
    df = spark.createDataFrame([(i, "http://a.example/x", p) for i, p in enumerate(pages)], "page_id long, url string, html string").repartition(4)
    one, many = ({x.page_id: x.text for x in extract.extract_main_text(df, bundle_bytes=b).collect()} for b in (1 << 30, 3_000))
    assert one == many and len(one) == len(pages)
    assert not any(prose in x for x in one.values()) and passage in one[len(pages) - 2] and passage not in one[len(pages) - 1]


@pytest.mark.parametrize("seed", [1, 2])
def test_results_do_not_depend_on_bundles(spark, seed):
    """Lines in about half of a host's articles, slots whose text few pages share, short prose that some pages share, and copies with other markup."""
    r = random.Random(seed)
    words = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    lines, side, prose = [words(12) for _ in range(8)], [words(9) for _ in range(40)], [words(30) for _ in range(3)]
    pages = []
    for i in range(90):
        inner = "".join(f"<p>{x}</p>" for k, x in enumerate(lines) if r.random() < 0.3 + 0.06 * k)
        body = f"<article><p>{words(120)}</p>{inner}</article>" + (f"<div class=promo>{r.choice(side)}</div>" if i % 2 else f"<div class=extra>{words(9) if i % 4 else r.choice(side)}</div>")
        pages += [body] * r.choice([1, 1, 1, 6]) + [body.replace("promo", "social").replace("extra", "more")] * (i % 5 == 0)
    pages += [f"<div>{r.choice(side)}</div><div>{words(40)}</div><div>{r.choice(prose)}</div>" for _ in range(30)]
    r.shuffle(pages)
    df = spark.createDataFrame([(i, "http://a.example/x", p) for i, p in enumerate(pages)], "page_id long, url string, html string").repartition(4)
    whole = dict(enumerate(extract.extract_bundle(pages)))
    for size in (1 << 30, 50_000, 10_000, 2_000):
        assert {x.page_id: x.text for x in extract.extract_main_text(df, bundle_bytes=size).collect()} == whole
    assert any(lines[7] in p and lines[7] not in whole[i] for i, p in enumerate(pages)) and any(lines[0] in x for x in whole.values())


def test_runs_of_a_class():
    r = np.random.default_rng(5)
    for _ in range(20):
        streams = [r.integers(0, 3, r.integers(0, 30)) for _ in range(r.integers(1, 12))]
        owners: dict[int, set] = {}
        for k, s in enumerate(streams):
            for m in extract.marks(s, 4).tolist():
                owners.setdefault(m, set()).add(k)
        assert len(owners) == len({tuple(s[i : i + 4]) for s in streams for i in range(len(s) - 3)})
        got = dict(zip(*(x.tolist() for x in extract.usual_in_class(streams, 4))))
        assert got == {m: len(o) for m, o in owners.items() if len(o) >= max(1, extract.CLASS_SHARE * len(streams))}
