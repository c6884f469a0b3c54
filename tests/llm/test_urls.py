import pytest
from pyspark.sql import functions as F

from chunkloom.llm import url_filter


def host_path(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.index(c) for c in "/?#" if c in rest] or [len(rest)])
    tail = rest[cut:]
    end = min([tail.index(c) for c in "?#" if c in tail] or [len(tail)])
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut]), tail[:end]


def rule(host, path):
    fits = []
    for text, says in url_filter.RULES:
        h, _, p = text.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fits.append((len(text), text, says))
    return max(fits)[1:] if fits else (None, None)


URLS = [None, "", "nothing", "http://", "http://A.ORG", "http://A.ORG/", "https://m.example.org/es/5?x#y", "x://example.org/en/12", "x://example.org/en/2", "http://evilorg/", "http://é.Com/fr/1", "http://a.com/de/", "http://a.com/de", "http://a.net#/x", "a://b://c/d", "http://a.net/en/1\n/2", "http://a.com:80/fr/1", "http://a.com/fr/" + "x/" * 500]


def test_hosts_paths_and_rules(spark):
    df = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)], "page_id long, url string").withColumn("host", F.lit("clash"))
    got = {r.page_id: r for r in url_filter.judge_urls(df).collect()}
    for i, u in enumerate(URLS):
        host, path = host_path(u)
        assert (got[i].host, got[i].path) == (host, path), u
        name, says = rule(host, path)
        assert got[i].rule == name and got[i].verdict == (says or got[i].verdict) and got[i].verdict in ("allow", "block")


def test_templates_carry_labels_to_other_hosts(spark):
    rows = [f"http://h{k}.example.org/es/{i}" for k in range(3) for i in range(40)] + [f"http://h{k}.org/en/{i}" for k in range(3) for i in range(40)] + [f"http://n.net/{x}/{i}" for x in ("es", "en") for i in range(5)]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(rows)], "page_id long, url string")
    got = url_filter.judge_urls(df).filter("host = 'n.net'").select("template", "verdict").distinct().collect()
    assert {(r.template, r.verdict) for r in got} == {("/es/{n}", "block"), ("/en/{n}", "allow")}


def test_variable_segments_become_wildcards(spark):
    df = spark.createDataFrame([(i, f"http://a.net/user/name{chr(97 + i % 26)}{chr(97 + i // 26)}/post") for i in range(100)], "page_id long, url string")
    assert {r.template for r in url_filter.judge_urls(df).select("template").distinct().collect()} == {"/user/{*}/post"}


def test_no_labels_no_rows_repeats(spark):
    df = spark.createDataFrame([(1, "http://a.net/x"), (1, "http://a.net/x"), (None, None)], "page_id long, url string")
    assert sorted(((r.page_id, r.rule, r.verdict) for r in url_filter.judge_urls(df).collect()), key=repr) == sorted([(1, None, "allow")] * 2 + [(None, None, "allow")], key=repr)
    assert url_filter.judge_urls(df.limit(0)).count() == 0


@pytest.mark.parametrize("word", ["Python", "Pandas", "Arrow"])
def test_plan_is_native(spark, sf_dir, word):
    plan = url_filter.judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))._jdf.queryExecution().toString()
    assert word not in plan


def test_the_tree_has_no_depth_limit(spark):
    """Labels deep below a common path tell branches apart, and long tails are no trouble."""
    deep = "/".join(f"d{i}" for i in range(9))
    rows = [f"http://h{k}.example.org/es/{deep}/{i}" for k in range(3) for i in range(20)] + [f"http://n.net/{x}/{deep}/{i}" for x in ("es", "en") for i in range(5)]
    rows += [f"http://{h}/de/fr/{deep}/bad/{i}" for h in ("a.com", "b.com") for i in range(20)] + [f"http://b.net/de/fr/{deep}/{x}/{i}" for x in ("bad", "good") for i in range(10)]
    rows += [f"http://h{k}.org/{x}/{i}" for x in (f"en/{deep}", f"de/fr/{deep}/good") for k in range(3) for i in range(20)]
    rows += ["http://long.net/" + "x/" * 3_000, "http://long.net/" + "y/" * 3_000]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(rows)], "page_id long, url string")
    got = {(r.template, r.verdict) for r in url_filter.judge_urls(df).filter("host IN ('n.net', 'b.net')").select("template", "verdict").distinct().collect()}
    assert got == {(f"/es/{deep}/{{n}}", "block"), (f"/en/{deep}/{{n}}", "allow"), (f"/de/fr/{deep}/bad/{{n}}", "block"), (f"/de/fr/{deep}/good/{{n}}", "allow")}


def test_branches_that_look_alike_are_merged(spark):
    """Branches without a difference fall together with all that lies below; one whose continuation differs stays apart."""
    rows = [f"http://a.net/{x}/news/{i}" for x in ("red", "green", "blue") for i in range(40)] + [f"http://a.net/about{x}" for x in "abcdefghijklmnopqrstuvwxyz"] + ["http://a.net/feed"] * 60
    df = spark.createDataFrame([(i, u) for i, u in enumerate(rows)], "page_id long, url string")
    got = {r.template for r in url_filter.judge_urls(df).select("template").distinct().collect()}
    assert "/{~}/news/{n}" not in got and {"/red/news/{n}", "/green/news/{n}", "/blue/news/{n}"} <= got  # they go on, the parent's average does not quite
    only = spark.createDataFrame([(i, u) for i, u in enumerate(rows[:120])], "page_id long, url string")
    assert {r.template for r in url_filter.judge_urls(only).select("template").distinct().collect()} == {"/{~}/news/{n}"}
