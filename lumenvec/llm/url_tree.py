"""URL verdicts: rules by host and path, then path templates judged by smoothed labelled purity.

Each host has a tree of path segments. A segment is variable, and becomes the wildcard *, if it is a
number, hexadecimal, long or holds three digits in a row. Children that are rare among many siblings (fewer
than MIN_SHARE of the node's pages, at a node with over MAX_CHILDREN distinct children) are pooled, those of
each kind of labels (none, mostly blocked, mostly allowed) for themselves: a rare child joins if it has under
FEW pages or if it is like its kind's other rare children. One kind's pool is the wildcard, another's takes
the name of its largest child. Sibling branches are then merged: the other children of a node that
are of one kind and not rare (at most max(MAX_CHILDREN, 1 / MIN_SHARE) of them) are taken from the largest one down, and
each joins the largest one before it that it is like and that joined no other, or stands for itself. A rare child
that is in no pool joins likewise, or keeps its name.

Two branches are alike on evidence only: each has FEW pages at least, both have FEW labelled pages at least
or none at all, and two-sample tests at the MERGE_Z level find no difference in the shares of pages that end
there, that go on with a wildcard, and that are blocked. Smaller branches keep their names, and their purity
is smoothed instead.

Levels are named one after the other, down to the deepest place where paths of a host still share a branch;
segments that all paths of a node share are passed in one step, so there are as many rounds as branchings below each
other, not as segments. A path that is alone at its node keeps the rest of its names. A segment that is literally *
is the wildcard. A page's template is its host and the path so
named. Pages whose verdict a rule gives are the labels; a template's share of blocked pages is smoothed
towards its host's, and the host's towards the whole; above REJECT, the template is blocked.

All counts are partial sums per node, so a host with any share of the pages is one row a task.

Host: after the first '://' up to '/', '?', '#' or the end, A-Z lower-cased; path: from there up to '?',
'#' or the end. Defined cases: null urls and urls without '://' have an empty host and path; empty hosts
are one host like others; without any label every verdict of the method is allow; repeated pages are rows
of their own and count as often; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged, table

#: Fixed values of the task: (verdict, host, path).
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
MAX_CHILDREN = 20
MIN_SHARE = 0.02
#: Pages, or labelled pages, below which a two-sample test has no power.
FEW = 10
#: Squared normal deviate at the one per cent level.
MERGE_Z = 6.63
#: Pages that a parent's share counts for.
PRIOR = 5.0
REJECT = 0.5
VARIABLE = r"^[0-9]+$|^[0-9a-f]{8,}$|[0-9]{3,}|^.{33,}$"


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, host, path."""
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr("substring(coalesce(cast(url as string), ''), instr(coalesce(cast(url as string), ''), '://') + 3)")).otherwise(F.lit(""))
    raw = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    lower = F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return pages.select(F.col("page_id").cast("long").alias("page_id"), lower.alias("host"), path.alias("path"))


def rule_of(rules: tuple[tuple[str, str, str], ...] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits host and path, null where none does. Rules of one
    length are tried in the order of their names."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, host, path in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[1] + r[2])):  # a longer one stands outside
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        name, verdict = F.when(fits, host + path).otherwise(name), F.when(fits, kind).otherwise(verdict)
    return name, verdict


def segments(path: Column) -> Column:
    """Non-empty segments; a trailing slash adds none."""
    return F.filter(F.split(path, "/"), lambda s: s != "")


def templates(urls: DataFrame) -> DataFrame:
    """urls (host, path, _rule_verdict and more) with template, the generalised path. Distinct shapes of
    paths are counted once; level by level, each node's children decide their names."""
    general = F.transform(segments(F.col("path")), lambda s: F.when(s.rlike(VARIABLE), F.lit("*")).otherwise(s))
    keyed = urls.withColumn("_raw", F.concat_ws("/", general))
    shapes = staged(keyed.groupBy("host", "_raw").agg(F.count(F.lit(1)).alias("n"), *_label_counts()), "shapes")
    tree = shapes.withColumns({"parts": F.filter(F.split("_raw", "/"), lambda s: s != ""), "prefix": F.lit(""), "at": F.lit(0)})
    named = []
    while True:
        ahead = F.slice("parts", F.col("at") + 1, F.greatest(F.size("parts") - F.col("at"), F.lit(0)))
        node = tree.groupBy("host", "prefix").agg(F.count(F.lit(1)).alias("shapes"), F.max(F.size("parts") - F.col("at")).alias("left"), F.min(ahead).alias("first"), F.max(ahead).alias("last"))
        node = node.select("host", "prefix", "shapes", "left", _shared("first", "last").alias("run"))
        # A table of its own: the shapes of a host with a large share of all can be split in the join.
        tree = tree.join(staged(node, "shares"), ["host", "prefix"])
        over = (F.col("shapes") == 1) | (F.col("left") <= F.col("run"))
        tree = staged(tree.withColumn("template", F.when(over, _joined("prefix", ahead))).drop("shapes", "left"), "tree")
        named.append(tree.where("template is not null").select("host", "_raw", "template"))
        tree = tree.where("template is null")
        if not tree.limit(1).count():
            break
        passed = _joined("prefix", F.slice("parts", F.col("at") + 1, F.col("run")))
        tree = _one_level(tree.select("host", "_raw", "n", "labelled", "blocked", "parts", passed.alias("prefix"), (F.col("at") + F.col("run")).alias("at")))
    every = named[0]
    for one in named[1:]:
        every = every.union(one)
    # A table of its own: the pages of a very common shape can be split in the join.
    every = staged(every, "templates").select("host", "_raw", F.concat(F.lit("/"), F.col("template")).alias("template"))
    return keyed.join(every, ["host", "_raw"]).drop("_raw")


def _joined(prefix: str, more: Column) -> Column:
    """The path of a prefix, which may be empty, and more segments."""
    return F.concat_ws("/", F.when(F.col(prefix) != "", F.col(prefix)), F.when(F.size(more) > 0, F.concat_ws("/", more)))


def _shared(first: str, last: str) -> Column:
    """How many segments the least and the greatest of some paths, and so all between, begin with."""
    differ = F.array_position(F.zip_with(first, last, lambda a, b: F.coalesce(a == b, F.lit(False))), False)
    return F.when(differ > 0, differ - 1).otherwise(F.size(first)).cast("int")


def _one_level(tree: DataFrame) -> DataFrame:
    """tree with the prefix of each shape one segment longer, by the name that its node gives to it."""
    after = F.coalesce(F.get("parts", F.col("at") + 1), F.lit(""))
    tree = tree.withColumn("child", F.coalesce(F.get("parts", F.col("at")), F.lit("")))
    shares = [F.sum(F.when(after == end, F.col("n")).otherwise(0)).alias(name) for end, name in (("*", "wild"), ("", "leaf"))]
    node = tree.groupBy("host", "prefix", "child").agg(F.sum("n").alias("pages"), *shares, F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked"))
    node = node.withColumn("kind", F.when(F.col("labelled") == 0, 0).when(2 * F.col("blocked") > F.col("labelled"), 1).otherwise(2))
    node = staged(node, "nodes")
    free = ~F.col("child").isin("", "*")
    total = node.groupBy("host", "prefix").agg(F.sum("pages").alias("all"), F.sum(free.cast("int")).alias("children"))
    rare = (F.col("children") > MAX_CHILDREN) & (F.col("pages") < MIN_SHARE * F.col("all"))
    sized = node.join(total, ["host", "prefix"]).withColumn("rare", rare)
    # At most max(MAX_CHILDREN, 1 / MIN_SHARE) children of a node are free and not rare.
    often = sized.where(free & ~F.col("rare")).groupBy("host", "prefix", "kind").agg(F.sort_array(F.collect_list(F.struct(*BRANCH)), asc=False).alias("often"))
    none = F.slice("often", 1, 0)
    heads = F.aggregate("often", none, lambda held, x: F.when(F.exists(held, lambda h: _alike(x, h)), held).otherwise(F.concat(held, F.array(x))))
    named = sized.join(often.select("host", "prefix", "kind", heads.alias("heads")), ["host", "prefix", "kind"], "left")
    named = _pooled(named.withColumn("near", F.coalesce(free & F.col("rare"), F.lit(False)) | (F.col("child") == "*")))
    own = F.struct(*BRANCH)
    joins = F.get(F.filter("heads", lambda h: _alike(own, h)), F.lit(0))["child"]
    name = F.when(~free, F.col("child")).when(F.col("pool").isNotNull(), F.col("pool")).otherwise(F.coalesce(joins, F.col("child")))
    tree = tree.join(staged(named.select("host", "prefix", "child", name.alias("as")), "names"), ["host", "prefix", "child"])
    prefix = F.when(F.col("as") == "", F.col("prefix")).otherwise(F.concat_ws("/", F.when(F.col("prefix") != "", F.col("prefix")), F.col("as")))
    return tree.select("host", "_raw", "n", "labelled", "blocked", "parts", prefix.alias("prefix"), (F.col("at") + (F.col("as") != "").cast("int")).alias("at"))


#: What a branch is compared by, the pages first.
BRANCH = ("pages", "child", "wild", "leaf", "labelled", "blocked")


def _label_counts() -> list[Column]:
    return [F.count("_rule_verdict").alias("labelled"), F.sum(F.when(F.col("_rule_verdict") == "block", 1).otherwise(0)).alias("blocked")]


def _pooled(nodes: DataFrame) -> DataFrame:
    """nodes with pool, the common name of a node's rare children (near) of one kind that cannot be told apart;
    null for others. The kind of the node's own *, or else the one with most pages, is named *; the pool of
    another kind takes the name of its largest member, so that labels never reach branches without them."""
    at, sums = ["host", "prefix", "kind"], ["pages", "wild", "leaf", "labelled", "blocked"]
    whole = nodes.where("near").groupBy(*at).agg(F.struct(*(F.sum(c).alias(c) for c in sums)).alias("whole"))
    rest = F.struct(*((F.col(f"whole.{c}") - F.col(c)).alias(c) for c in sums))
    told = nodes.join(whole, at, "left").withColumn("rest", rest)
    told = told.withColumn("near", F.col("near") & ((F.col("child") == "*") | (F.col("pages") < FEW) | _alike(F.struct(*BRANCH), F.col("rest")))).drop("whole", "rest")
    pools = told.where("near").groupBy(*at).agg(F.max(F.struct("pages", "child")).alias("head"), F.max((F.col("child") == "*").cast("int")).alias("star"), F.sum("pages").alias("size"))
    first = pools.groupBy("host", "prefix").agg(F.max(F.struct("star", "size", "kind"))["kind"].alias("first"))
    names = pools.join(first, ["host", "prefix"]).select(*at, F.when(F.col("kind") == F.col("first"), "*").otherwise(F.col("head.child")).alias("name"))
    return told.join(names, at, "left").withColumn("pool", F.when(F.col("near"), F.col("name"))).drop("near", "name")


def _alike(a: Column, b: Column) -> Column:
    """Whether there is evidence enough, and none of it tells one branch from the other."""
    def both(whole: str, least: int) -> Column:
        return (a[whole] >= least) & (b[whole] >= least)

    labels = (a["labelled"] + b["labelled"] == 0) | (both("labelled", FEW) & _no_difference("blocked", "labelled", a, b))
    return F.coalesce(both("pages", FEW) & _no_difference("wild", "pages", a, b) & _no_difference("leaf", "pages", a, b) & labels, F.lit(False))


def _no_difference(part: str, whole: str, a: Column, b: Column) -> Column:
    """Two-sample test of one branch's share against another's."""
    n, m = (F.nullif(x[whole].cast("double"), F.lit(0.0)) for x in (a, b))
    p, q = a[part] / n, b[part] / m
    both = (a[part] + b[part]) / (n + m)
    spread = both * (1 - both) * (1 / n + 1 / m)
    return (p - q) * (p - q) <= MERGE_Z * spread


def judged(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity (smoothed share of blocked pages), labelled."""
    name, verdict = rule_of(rules)
    urls = templates(parsed(pages).withColumns({"rule": name, "_rule_verdict": verdict}))
    by_template = staged(urls.groupBy("host", "template").agg(*_label_counts()), "purity")
    by_host = by_template.groupBy("host").agg(F.sum("labelled").alias("host_labelled"), F.sum("blocked").alias("host_blocked"))
    labelled, blocked = by_host.agg(F.sum("host_labelled"), F.sum("host_blocked")).first()
    prior = blocked / labelled if labelled else 0.0
    host_share = (F.col("host_blocked") + F.lit(PRIOR * prior)) / (F.col("host_labelled") + PRIOR)
    share = (F.col("blocked") + PRIOR * host_share) / (F.col("labelled") + PRIOR)
    rated = by_template.join(by_host, "host").select("host", "template", "labelled", share.alias("purity"))
    method = F.when(F.col("purity") > REJECT, "block").otherwise("allow")
    return urls.join(rated, ["host", "template"]).select("page_id", "host", "path", "rule", F.coalesce("_rule_verdict", method).alias("verdict"), "template", F.round("purity", 9).alias("purity"), "labelled")


def op10_template_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages"))
