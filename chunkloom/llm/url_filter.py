"""URL filters (native): rules, and a path-template tree per host judged by smoothed labelled purity.

Only DataFrame functions are used. Every page is judged: first by the longest fitting rule, else by its template.

The tree. A path is cut at ``/`` into segments; digits and other id-like shapes become typed wildcards at once, so the
urls of a host fall together into few *shapes* before anything is shuffled. From the root down, a literal segment becomes
``{*}`` where its parent has many different children and few rows for each, at any depth; a branch of a single row is not divided
on, and of its tail what lies behind ``TAIL`` segments is one wildcard ``{**}``. Then sibling branches, with all that lies below them, are merged into ``{~}`` where neither their
smoothed purity nor their continuation (the share of rows that go on below) can be told apart from that of all branches of their parent;
equal names below merged branches fall together. Branches are compared with their parent's sums, which merging leaves as they are, so all levels
are merged at once. A template's purity is its share of
block labels, shrunk towards that of the same unmerged templates over all hosts, which is shrunk towards the overall share.

Defined results. Null url or no ``://``: host and path are empty and no rule fits; such pages share the template of the
empty host. An empty path fits only rules with an empty path. Ties between rules of equal length go to the smaller rule
string. Repeated rows are judged alike, each counts as evidence. Extra columns are ignored; an empty table gives an
empty result. With no labelled page at all everything unmatched is allowed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chunkloom.llm._common import Scratch

#: (rule, verdict); a rule is host + path. These are the rules of the query's contract.
RULES: tuple[tuple[str, str], ...] = (
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
)
MIN_CHILDREN = 20  # a parent with more different children than this ...
MAX_ROWS_PER_CHILD = 2.0  # ... and at most so many rows for each has a variable segment
PRIOR = 8.0  # labelled pages that the wider estimate is worth
BLOCK_AT = 0.5  # a template with at least this smoothed purity of block labels is rejected
Z_SIMILAR = 1.96  # sibling branches within so many standard errors of their parent are merged
MARGIN = 0.05  # and differences of shares below this do not count
TAIL = 6  # segments of a single row's tail that stay apart
ORACLE_LEVELS = 8  # levels that the SQL writes out; the tree itself has as many as its paths

#: Shapes of segments, first fit: pattern and wildcard. The oracle uses the same list.
SHAPES: tuple[tuple[str, str], ...] = (
    (r"^[0-9]+$", "{n}"),
    (r"^[0-9]+\.[A-Za-z]{1,5}$", "{n}.x"),
    (r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f-]{27}$", "{uuid}"),
    (r"^[0-9A-Fa-f]{16,}$", "{hex}"),
    (r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$", "{date}"),
    (r"^[^0-9]*[0-9]{4,}[^0-9]*$", "{id}"),
)


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """Rule and verdict of the longest rule that fits; null if none does.

    The rules are a list of the caller's, compiled into one expression tree: keep it to some hundreds.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), [-ord(c) for c in r[0]])):  # the last that fits wins
        name, _, tail = text.partition("/")
        start = "/" + tail if "/" in text else ""
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def shape_of(segment: Column) -> Column:
    out = segment
    for pattern, name in reversed(SHAPES):
        out = F.when(segment.rlike(pattern), name).otherwise(out)
    return out


def judge_urls(
    pages: DataFrame,
    rules: Sequence[tuple[str, str]] = RULES,
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    min_children: int = MIN_CHILDREN,
    max_rows_per_child: float = MAX_ROWS_PER_CHILD,
    prior: float = PRIOR,
    block_at: float = BLOCK_AT,
    z_similar: float = Z_SIMILAR,
) -> DataFrame:
    """Per page: id, host, path, rule, verdict, template and purity (both of the template tree)."""
    url = F.col(url_col)
    parsed = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    rule, says = longest_rule(F.col("host"), F.col("path"), rules)
    segments = F.split(F.regexp_replace("path", "^/", ""), "/")
    judged = parsed.withColumns({"rule": rule, "says": says, "shape": F.array_join(F.transform(segments, shape_of), "/")})

    # One row per host and shape, written once: everything below works on these few rows, not on pages.
    scratch = Scratch(pages.sparkSession, "url-filter")
    shapes = judged.groupBy("host", "shape").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("says") == "block").alias("n_block"),
        F.count("says").alias("n_label"),
    )
    shapes = scratch.table(shapes, "shapes")
    tree = _templates(shapes, scratch, min_children, max_rows_per_child)
    overall = tree.agg(F.coalesce(F.try_divide(F.sum("n_block"), F.sum("n_label")), F.lit(0.0)).alias("base")).first()["base"]
    k, base = F.lit(prior), F.lit(float(overall if overall is not None else 0.0))
    wider = (F.col("t_block") + k * base) / (F.col("t_label") + k)

    # The nodes of all levels with their smoothed purity and their continuation, and their parents' averages.
    sums = lambda *names: [F.sum(c).alias(c) for c in names]
    path = ["level", "parent", "last"]
    steps = tree.withColumn("level", F.explode(F.sequence(F.lit(1), F.size("labels"))))
    steps = steps.withColumns({"parent": F.array_join(F.slice("labels", F.lit(1), F.col("level") - 1), "/"), "last": F.element_at("labels", F.col("level")), "deep": F.when(F.size("labels") > F.col("level"), F.col("n")).otherwise(F.lit(0))})
    nodes = scratch.table(steps.groupBy("host", *path).agg(*sums("n", "n_block", "n_label", "deep")), "nodes")
    wide = nodes.groupBy(*path).agg(F.sum("n_block").alias("t_block"), F.sum("n_label").alias("t_label"))
    nodes = nodes.join(wide, path).withColumn("pure", (F.col("n_block") + k * wider) / (F.col("n_label") + k))
    up = nodes.groupBy("host", "level", "parent").agg((F.sum(F.col("n") * F.col("pure")) / F.sum("n")).alias("p"), (F.sum("deep") / F.sum("n")).alias("q"))
    near = lambda x, mean, count: F.abs(x - mean) <= F.lit(z_similar) * F.sqrt(F.greatest(mean * (1 - mean), F.lit(0.0)) / count) + F.lit(MARGIN)
    nodes = nodes.join(up, ["host", "level", "parent"]).withColumn("alike", near(F.col("pure"), F.col("p"), F.col("n_label") + k) & near(F.col("deep") / F.col("n"), F.col("q"), F.col("n")))
    several = nodes.groupBy("host", "level", "parent").agg((F.count_if("alike") > 1).alias("several"))
    nodes = nodes.join(several, ["host", "level", "parent"]).select("host", *path, F.when(F.col("alike") & F.col("several"), F.lit("{~}")).otherwise(F.col("last")).alias("label"))
    merged = steps.select("host", "shape", *path).join(scratch.table(nodes, "labels"), ["host", *path]).groupBy("host", "shape").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("level", "label"))), lambda x: x["label"]), "/").alias("template")  # a path's levels
    )

    leaves = tree.join(merged, ["host", "shape"]).withColumn("own", F.array_join("labels", "/"))
    everywhere = tree.groupBy(F.array_join("labels", "/").alias("own")).agg(F.sum("n_block").alias("t_block"), F.sum("n_label").alias("t_label"))
    leaves = leaves.join(everywhere, "own").withColumn("weighted", F.col("n") * wider)
    leaves = scratch.table(leaves.select("host", "shape", "template", "n", "n_block", "n_label", "weighted"), "leaves")
    verdicts = leaves.groupBy("host", "template").agg(((F.sum("n_block") + k * F.sum("weighted") / F.sum("n")) / (F.sum("n_label") + k)).alias("purity"))
    # A hot host may hold a third of all pages: this is a plain sort-merge join, whose large partitions Spark splits.
    of_shape = leaves.select("host", "shape", F.concat(F.lit("/"), "template").alias("template"), F.col("template").alias("_t")).join(verdicts.withColumnRenamed("template", "_t"), ["host", "_t"]).drop("_t")
    method = F.when(F.col("purity") >= block_at, "block").otherwise("allow")
    return judged.join(of_shape, ["host", "shape"], "left").select(
        "page_id", "host", "path", "rule", F.coalesce("says", method).alias("verdict"), "template", "purity"
    )


def _templates(shapes: DataFrame, scratch: Scratch, min_children: int, max_rows_per_child: float) -> DataFrame:
    """host, shape, n, n_block, n_label and labels: the shape's segments, some of them wildcards. One round for each level that two rows share."""
    tree = shapes.withColumns({"seg": F.split("shape", "/"), "labels": F.array().cast("array<string>")})
    out, level = None, 0
    while True:
        level += 1
        here, parent = F.get("seg", F.lit(level - 1)), F.array_join("labels", "/")
        tree = tree.withColumns({"parent": parent, "kid": here})
        kids = tree.groupBy("host", "parent", "kid").agg(F.sum("n").alias("n"))
        wide = kids.groupBy("host", "parent").agg(((F.count(F.lit(1)) > min_children) & (F.sum("n") <= F.count(F.lit(1)) * F.lit(max_rows_per_child))).alias("wide"))
        label = F.when(F.col("wide") & ~F.col("kid").startswith("{"), F.lit("{*}")).otherwise(F.col("kid"))
        tree = scratch.table(tree.join(wide, ["host", "parent"]).withColumn("kid", label).drop("wide"), f"level-{level}")
        size = tree.groupBy("host", "parent", "kid").agg(F.sum("n").alias("rows"))
        tree = tree.join(size, ["host", "parent", "kid"]).withColumn("labels", F.concat("labels", F.array("kid")))
        ends, alone = F.size("seg") == level, F.col("rows") < 2
        rest = F.slice("seg", F.lit(level + 1), F.lit(TAIL))
        longer = F.when(F.size("seg") > level + TAIL, F.array(F.lit("{**}"))).otherwise(F.array().cast("array<string>"))
        tail = F.when(ends, F.col("labels")).otherwise(F.concat("labels", rest, longer))
        done = tree.filter(ends | alone).withColumn("labels", tail).select("host", "shape", "n", "n_block", "n_label", "labels")
        out = done if out is None else out.unionByName(done)
        tree = scratch.table(tree.filter(~(ends | alone)).select("host", "shape", "n", "n_block", "n_label", "seg", "labels"), f"below-{level}")
        if tree.isEmpty():
            return scratch.table(out, "tree")


def oracle(rules: Sequence[tuple[str, str]] = RULES) -> str:
    """The same judgement as SQL for another engine, over the view pages."""
    order = sorted(rules, key=lambda r: (len(r[0]), [-ord(c) for c in r[0]]), reverse=True)

    def fits(text: str) -> str:
        name, _, tail = text.partition("/")
        return f"(host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '{'/' + tail if '/' in text else ''}')"

    rule = "CASE " + " ".join(f"WHEN {fits(text)} THEN '{text}'" for text, _ in order) + " END"
    says = "CASE rule " + " ".join(f"WHEN '{text}' THEN '{verdict}'" for text, verdict in order) + " END"
    shape = "CASE " + " ".join(f"WHEN regexp_matches(s, '{pattern}') THEN '{name}'" for pattern, name in SHAPES) + " ELSE s END"
    levels = []
    for k in range(1, ORACLE_LEVELS + 1):
        levels.append(f"""
k{k} AS MATERIALIZED (SELECT host, labels[:{k - 1}] AS parent, count(*) > {MIN_CHILDREN} AND sum(n) <= count(*) * {MAX_ROWS_PER_CHILD} AS wide FROM (SELECT host, labels, seg[{k}] AS kid, sum(n) AS n FROM t{k - 1} WHERE NOT done GROUP BY ALL) GROUP BY ALL),
w{k} AS MATERIALIZED (SELECT t.*, CASE WHEN wide AND NOT starts_with(seg[{k}], '{{') THEN '{{*}}' ELSE seg[{k}] END AS kid FROM t{k - 1} t LEFT JOIN k{k} ON t.host = k{k}.host AND t.labels = parent),
t{k} AS MATERIALIZED (SELECT host, shape, n, n_block, n_label, seg, done OR len(seg) = {k} OR r < 2 AS done,
  CASE WHEN done THEN labels WHEN len(seg) > {k} AND r < 2 THEN list_concat(list_concat(labels, [kid]), list_concat(seg[{k} + 1:{k} + {TAIL}], CASE WHEN len(seg) > {k} + {TAIL} THEN ['{{**}}'] ELSE [] END)) ELSE list_concat(labels, [kid]) END AS labels
  FROM (SELECT *, sum(n) OVER (PARTITION BY host, labels, kid, done) AS r FROM w{k}))""")
    near = lambda x, mean, count: f"abs({x} - {mean}) <= {Z_SIMILAR} * sqrt(greatest({mean} * (1 - {mean}), 0) / ({count})) + {MARGIN}"
    wider = f"(t_block + {PRIOR} * base) / (t_label + {PRIOR})"
    return f"""
WITH parsed AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
ruled AS (SELECT *, {rule} AS rule FROM parsed),
judged AS MATERIALIZED (SELECT *, {says} AS says, string_split(regexp_replace(path, '^/', ''), '/') AS segs FROM ruled),
shaped AS MATERIALIZED (SELECT *, array_to_string(list_transform(segs, lambda s: {shape}), '/') AS shape FROM judged),
t0 AS MATERIALIZED (SELECT host, shape, count(*) AS n, count(*) FILTER (WHERE says = 'block') AS n_block, count(says) AS n_label, string_split(shape, '/') AS seg, false AS done, []::VARCHAR[] AS labels FROM shaped GROUP BY host, shape),{",".join(levels)},
tree AS MATERIALIZED (SELECT * FROM t{ORACLE_LEVELS}),
overall AS MATERIALIZED (SELECT coalesce(sum(n_block) / nullif(sum(n_label), 0), 0) AS base FROM tree),
steps AS MATERIALIZED (SELECT host, shape, n, n_block, n_label, level, labels[:level - 1] AS parent, labels[level] AS last, CASE WHEN len(labels) > level THEN n ELSE 0 END AS deep FROM (SELECT *, unnest(range(1, len(labels) + 1)) AS level FROM tree)),
nodes AS MATERIALIZED (SELECT host, level, parent, last, sum(n) AS n, sum(n_block) AS n_block, sum(n_label) AS n_label, sum(deep) AS deep FROM steps GROUP BY ALL),
wide AS (SELECT level, parent, last, sum(n_block) AS t_block, sum(n_label) AS t_label FROM nodes GROUP BY ALL),
pure AS MATERIALIZED (SELECT nodes.*, (n_block + {PRIOR} * ({wider})) / (n_label + {PRIOR}) AS pure FROM nodes JOIN wide USING (level, parent, last), overall),
up AS (SELECT host, level, parent, sum(n * pure) / sum(n) AS p, sum(deep) / sum(n) AS q FROM pure GROUP BY ALL),
alike AS MATERIALIZED (SELECT pure.*, {near("pure", "p", f"n_label + {PRIOR}")} AND {near("deep / n", "q", "n")} AS alike FROM pure JOIN up USING (host, level, parent)),
several AS (SELECT host, level, parent, count(*) FILTER (WHERE alike) > 1 AS several FROM alike GROUP BY ALL),
labelled AS MATERIALIZED (SELECT host, level, parent, last, CASE WHEN alike AND several THEN '{{~}}' ELSE last END AS label FROM alike JOIN several USING (host, level, parent)),
merged AS MATERIALIZED (SELECT host, shape, list(label ORDER BY level) AS template FROM steps JOIN labelled USING (host, level, parent, last) GROUP BY ALL),
everywhere AS (SELECT labels, sum(n_block) AS t_block, sum(n_label) AS t_label FROM tree GROUP BY ALL),
leaves AS MATERIALIZED (SELECT tree.host, tree.shape, template, n, n_block, n_label, n * ({wider}) AS weighted FROM tree JOIN merged USING (host, shape) JOIN everywhere USING (labels), overall),
verdicts AS (SELECT host, template, (sum(n_block) + {PRIOR} * sum(weighted) / sum(n)) / (sum(n_label) + {PRIOR}) AS purity FROM leaves GROUP BY ALL)
SELECT page_id, s.host, path, rule, coalesce(says, CASE WHEN purity >= {BLOCK_AT} THEN 'block' ELSE 'allow' END) AS verdict
FROM shaped s LEFT JOIN leaves l ON l.host = s.host AND l.shape = s.shape LEFT JOIN verdicts v ON v.host = l.host AND v.template = l.template"""
