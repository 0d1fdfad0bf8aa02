"""Operators on pages and conversations against SQL, brute force and planted cases."""

from __future__ import annotations

import hashlib
import io
import random
import re

import duckdb
import pytest

from lumenvec.llm import queries, quotes, scan, url_tree, warc
from lumenvec.llm.common import shared_dir

PAGES = [(1, "http://a.org/x", "p" * 120), (2, "http://a.org/y", "p" * 120), (0, None, "p" * 120), (3, "no scheme", "short"), (4, "x://h?q", "short"), (5, "http://b", None), (None, "http://c d\n", "p" * 120), (6, "http://e", ""), (7, "http://f", "\r\n\r\nWARC/1.1" * 20), (0, None, "p" * 120), (8, "http://g", "é" * 60)]


def test_op5_rows(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").selectExpr("*", "'x' as digest", "1 as refers_to")
    archives = warc.write_archives(pages, shared_dir(spark, "warc"), archive_bytes=200)
    assert archives.count() > 2
    got = warc.resolved(warc.read_archives(archives)).collect()
    assert len(got) == len(PAGES)
    digest = hashlib.sha256(b"p" * 120).hexdigest()
    same = [r for r in got if r.payload_digest == digest]
    assert sorted((str(r.page_id), r.record_type, r.refers_to) for r in same) == [("0", "response", None), ("0", "response", None), ("1", "revisit", 0), ("2", "revisit", 0), ("None", "revisit", 0)]
    assert all(r.payload_bytes == 120 for r in same)
    assert {r.page_id for r in got if r.record_type == "response"} == {0, 3, 4, 5, 6, 7, 8}
    assert warc.resolved(warc.read_archives(warc.write_archives(pages.limit(0), shared_dir(spark, "warc")))).count() == 0


def test_op5_one_id_with_two_payloads(spark):
    """Resolved for each payload; equal rows that revisit stay as many."""
    rows = [(1, "u", "p" * 120), (2, "u", "p" * 120), (2, "u", "q" * 120), (2, "u", "p" * 120), (3, "u", "q" * 120)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = warc.resolved(warc.read_archives(warc.write_archives(pages, shared_dir(spark, "warc")))).collect()
    of = {hashlib.sha256(c.encode() * 120).hexdigest(): c for c in "pq"}
    assert sorted((r.page_id, of[r.payload_digest], r.record_type, r.refers_to) for r in got) == [(1, "p", "response", None), (2, "p", "revisit", 1), (2, "p", "revisit", 1), (2, "q", "response", None), (3, "q", "revisit", 2)]


def test_op5_records_parse():
    date = "2020-02-02T02:02:02Z"
    data = warc.record("response", 3, "http://x/\n", "d", date, warc.HTTP + b"\r\n\r\nbody")
    fields, block = warc.parse(data)
    assert fields["warc-type"] == "response" and fields["warc-date"] == date and block.partition(b"\r\n\r\n")[2] == b"\r\n\r\nbody"
    both = warc.member(warc.warcinfo("a.warc.gz", date)) + warc.member(data) + warc.member(warc.record("revisit", 4, "u", "d", date, warc.HTTP))
    assert [warc.parse(m)[0]["warc-type"] for m in warc.members(io.BytesIO(both), 7)] == ["warcinfo", "response", "revisit"]
    with pytest.raises(ValueError):
        list(warc.members(io.BytesIO(both[:-4])))


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, sf, name):
    from oracle import spark_rows, sql_rows

    df = queries.QUERIES[name](spark, sf)
    assert spark_rows(df) == sql_rows(queries.ORACLE_SQL[name], sf, sorted(df.columns))


def base_verdict(url):
    if not url or "://" not in url:
        return "", "", None, None
    m = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1])
    host, path = "".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]
    fit = [(len(h + p), h + p, v) for v, h, p in url_tree.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *max(fit)[1:]) if fit else (host, path, None, None)


URLS = [None, "", "x", "http://", "http://EXAMPLE.org/es/1?x", "https://a.example.org/en/1", "https://a.example.org/en/2", "http://notexample.org/es/", "http://com/fr/", "http://x.com/de/y#z", "http://x.com?de", "a://b://c/d", "http://x.COM/de/", "http://É.org/a\nb"]


def test_op10_rules(spark):
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate([*URLS, URLS[4]])], "page_id long, url string, template string")
    got = {r.page_id: r for r in url_tree.judged(pages).collect()}
    assert len(got) == len(URLS) + 1
    for i, u in enumerate(URLS):
        host, path, rule, verdict = base_verdict(u)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
        assert got[i].verdict == verdict if rule else got[i].verdict in ("allow", "block")
    assert url_tree.judged(pages.limit(0)).count() == 0


def test_op10_purity(spark):
    rules = (("block", "bad.com", "/spam/1"), ("allow", "bad.com", "/news/1"))
    urls = [f"http://bad.com/{k}/{i}{j}" for k in ("spam", "news") for i in range(1, 4) for j in range(20)] + ["http://other.net/a"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    for r in url_tree.judged(pages, rules).collect():
        assert r.verdict == ("block" if "/spam/" in r.path else "allow")
        assert r.host == "other.net" or r.template.endswith("/*")


def test_op10_similar_branches_merge(spark):
    """Branches of one shape and label take the largest one's name; one that ends otherwise stays apart."""
    urls = [f"http://h.net/{k}/{i}" for k, n in (("en", 60), ("fr", 30), ("es", 25)) for i in range(n)] + [f"http://h.net/about/{i}x/y" for i in range(40)]
    got = {r.path.split("/")[1]: r.template for r in url_tree.judged(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()}
    assert got["fr"] == got["es"] == got["en"] == "/en/*" and got["about"].startswith("/about/")


def test_op10_deep_paths(spark):
    """Labels below any depth count; a path of its own may be very deep."""
    rules = (("block", "d.net", "/a/b/c/d/spam/"), ("allow", "d.net", "/a/b/c/d/news/"))
    urls = [f"http://d.net/a/b/c/d/{k}/x{i}" for k in ("spam", "news") for i in range(40)] + ["http://d.net/" + "e/" * 500, "http://d.net/" + "f/" * 8 + "1", "http://d.net/" + "f/" * 8 + "2"]
    got = url_tree.judged(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules).collect()
    for k in ("spam", "news"):
        assert {r.verdict for r in got if f"/{k}/" in r.path} == {"block" if k == "spam" else "allow"}
    assert not {r.template for r in got if "/spam/" in r.path} & {r.template for r in got if "/news/" in r.path}
    assert "/e" * 500 in {r.template for r in got} and "/f" * 8 + "/*" in {r.template for r in got}


def test_op10_no_merge_without_evidence(spark):
    """Three pages of a branch say nothing of their likeness to another's three."""
    rules = (("block", "s.net", "/spam/"), ("allow", "s.net", "/news/"))
    urls = [f"http://s.net/{k}/{i}" for k in ("spam", "news", "talk") for i in range(3)]
    got = url_tree.judged(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules).collect()
    assert {r.template for r in got} == {"/spam/*", "/news/*", "/talk/*"}


def tree_by_hand(rows, rules):
    """The same definition on dictionaries: {page_id: (template, labelled, purity)}."""

    def verdict(host, path):
        fit = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fit)[2] if fit else None

    def differ(a, b, part, whole):
        n, m = a[whole], b[whole]
        p, q, both = a[part] / n, b[part] / m, (a[part] + b[part]) / (n + m)
        return (p - q) ** 2 > url_tree.MERGE_Z * both * (1 - both) * (1 / n + 1 / m)

    def like(a, b):
        if min(a["pages"], b["pages"]) < url_tree.FEW or differ(a, b, "wild", "pages") or differ(a, b, "leaf", "pages"):
            return False
        if a["labelled"] + b["labelled"] == 0:
            return True
        return min(a["labelled"], b["labelled"]) >= url_tree.FEW and not differ(a, b, "blocked", "labelled")

    sums = ("pages", "wild", "leaf", "labelled", "blocked")
    shapes = {}
    for _, host, path in rows:
        parts = tuple("*" if re.search(url_tree.VARIABLE, s) else s for s in path.split("/") if s)
        v = verdict(host, path)
        c = shapes.setdefault((host, parts), [0, 0, 0])
        c[0], c[1], c[2] = c[0] + 1, c[1] + (v is not None), c[2] + (v == "block")
    prefix = {k: () for k in shapes}
    for level in range(max((len(p) for _, p in shapes), default=0)):
        nodes = {}
        for (host, parts), (n, labelled, blocked) in shapes.items():
            child = parts[level] if level < len(parts) else ""
            after = parts[level + 1] if level + 1 < len(parts) else ""
            node = nodes.setdefault((host, prefix[host, parts]), {}).setdefault(child, dict.fromkeys(sums, 0))
            for k, x in zip(sums, (n, n * (after == "*"), n * (after == ""), labelled, blocked), strict=True):
                node[k] += x
        names = {}
        for at, children in nodes.items():
            free = [c for c in children if c not in ("", "*")]
            kind = {c: 0 if not x["labelled"] else 1 if 2 * x["blocked"] > x["labelled"] else 2 for c, x in children.items()}
            every = sum(x["pages"] for x in children.values())
            near = {c for c in free if len(free) > url_tree.MAX_CHILDREN and children[c]["pages"] < url_tree.MIN_SHARE * every} | ({"*"} & set(children))
            whole = {k: {f: sum(children[c][f] for c in near if kind[c] == k) for f in sums} for k in range(3)}
            pool = {c for c in near if c == "*" or children[c]["pages"] < url_tree.FEW or like(children[c], {f: whole[kind[c]][f] - children[c][f] for f in sums})}
            pools = {k: [c for c in pool if kind[c] == k] for k in range(3) if any(kind[c] == k for c in pool)}
            first = max(pools, key=lambda k: ("*" in pools[k], sum(children[c]["pages"] for c in pools[k]), k), default=None)
            for c in children:
                top = max((o for o in free if kind[o] == kind[c]), key=lambda o: (children[o]["pages"], o), default=None)
                if c in ("", "*"):
                    names[at, c] = c
                elif c in pool:
                    names[at, c] = "*" if kind[c] == first else max(pools[kind[c]], key=lambda o: (children[o]["pages"], o))
                else:
                    names[at, c] = top if like(children[c], children[top]) else c
        for host, parts in shapes:
            child = parts[level] if level < len(parts) else ""
            name = names[(host, prefix[host, parts]), child]
            prefix[host, parts] += (name,) if name else ()
    by_template, by_host = {}, {}
    for (host, parts), (_, labelled, blocked) in shapes.items():
        for d, k in ((by_template, (host, prefix[host, parts])), (by_host, host)):
            x = d.setdefault(k, [0, 0])
            x[0], x[1] = x[0] + labelled, x[1] + blocked
    labelled, blocked = (sum(x[i] for x in by_host.values()) for i in (0, 1))
    share = lambda x, prior: (x[1] + url_tree.PRIOR * prior) / (x[0] + url_tree.PRIOR)
    out = {}
    for i, host, path in rows:
        parts = tuple("*" if re.search(url_tree.VARIABLE, s) else s for s in path.split("/") if s)
        x = by_template[host, prefix[host, parts]]
        out[i] = ("/" + "/".join(prefix[host, parts]), x[0], round(share(x, share(by_host[host], blocked / labelled if labelled else 0.0)), 6))
    return out


@pytest.mark.parametrize("given", [True, False])
def test_op10_against_a_tree_by_hand(spark, sf, given):
    rules = url_tree.RULES
    if given:
        pages = spark.read.parquet(sf.replace("0.001", "0.01") + "/pages.parquet").select("page_id", "url")
    else:  # many siblings of all kinds, small and large, under rules that reach deep
        r = random.Random(6)
        rules = (("block", "h.net", "/a/bad"), ("allow", "h.net", "/a/b"), ("block", "h.net", "/z"), ("allow", "g.net", "/"))
        words = [c + d for c in "abcdz" for d in "adkxz"]
        urls = [f"http://{r.choice(['h.net', 'h.net', 'g.net', 'k.net'])}/" + "/".join(r.choice([r.choice(words), r.choice(words[:4]), "a", str(r.randint(1, 20)), "bad"]) for _ in range(r.randint(0, 5))) for _ in range(3000)]
        pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = url_tree.judged(pages, rules).collect()
    want = tree_by_hand([(r.page_id, r.host, r.path) for r in got], rules)
    assert {r.page_id: (r.template, r.labelled, round(r.purity, 6)) for r in got} == want


def test_op10_rare_siblings_become_one(spark):
    urls = [f"http://h.net/{chr(97 + i // 26)}{chr(97 + i % 26)}/x" for i in range(200)] + ["http://h.net/keep/x"] * 100
    got = url_tree.judged(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"))
    assert {r.template for r in got.collect()} <= {"/*/x", "/keep/x"}


def test_op10_rare_siblings_keep_their_labels(spark):
    """A small blocked section does not block other small sections; a rare one with a structure of its own stays apart."""
    names = ["n" + chr(97 + i // 5) + chr(97 + i % 5) for i in range(28)]
    urls = [f"http://x.com/fr/{i}" for i in range(3000)] + [f"http://x.com/de/{i}" for i in range(30)] + [f"http://x.com/{k}/{i}" for k in names for i in range(30)] + ["http://x.com/own/a/b"] * 50
    got = url_tree.judged(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()
    assert {r.verdict for r in got if r.path.startswith("/de/")} == {"block"} and {r.verdict for r in got if not r.path.startswith("/de/")} == {"allow"}
    assert {(r.template, r.labelled) for r in got if r.path.split("/")[1] in names} == {("/*/*", 0)}
    assert {(r.template, r.labelled) for r in got if r.path.startswith("/de/")} == {("/de/*", 30)}
    assert {r.template for r in got if r.path.startswith("/own/")} == {"/own/a/b"}


def test_op10_rare_kinds_stay_apart_beside_a_wildcard(spark):
    """Rare children without labels do not join labelled numbers, nor the other way round."""
    names = [chr(97 + i // 5) + chr(97 + i % 5) for i in range(25)]
    rules = (("block", "h.net", "/1"), ("block", "h.net", "/a"), ("allow", "h.net", "/keep"))
    urls = [f"http://h.net/{i}/x" for i in range(100, 120)] * 5 + [f"http://h.net/{k}/x" for k in names] * 3 + ["http://h.net/keep/x"] * 5000
    got = url_tree.judged(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules).collect()
    assert all((r.verdict == "block") == (r.path[1] in "1a") for r in got)
    assert not {r.template for r in got if r.path[1] in "1a"} & {r.template for r in got if r.path[1] not in "1a"}


TALK = [
    (4, 0, "u", "A long line that\nis wrapped here\n\nand more"), (4, 1, "a", "> A long line\n> that is Wrapped here\n\nYes"),
    (1, 0, "u", "Hello there\nSecond line"), (1, 1, "a", "On Monday A wrote:\n> hello  There\nMy reply"), (1, 2, "u", ">> Hello there\n> My Reply\nmore"),
    (5, 0, "u", "One long line. It has three sentences! Is the last one quoted?"), (5, 1, "a", "On a day " + "x" * 300 + " wrote:\n\n> It has three\n> sentences!\n\nOn this I wrote:\nyes"), (5, 2, "u", "> Is the last one quoted?\n\nno"),
    (1, 3, "a", "> Second line\n> My reply\nbottom\n\n"), (2, 0, "u", None), (2, 1, "a", "> My reply\nx\n>\n> > "), (3, 0, None, ""), (3, 1, "a", ">"),
]


def test_op9_links(spark):
    df = spark.createDataFrame(TALK, "conv_id long, turn long, role string, text string").selectExpr("*", "'x' as own", "2 as depth")
    got = {(r.conv_id, r.turn): r for r in quotes.reply_ordered(df).collect()}
    one = lambda k: (got[k].body, got[k].n_quoted, got[k].max_level, got[k].n_linked, got[k].parent_turn, got[k].thread, got[k].depth)
    assert one((1, 1)) == ("My reply", 1, 1, 1, 0, 0, 1)
    assert one((1, 2)) == ("more", 2, 2, 2, 1, 0, 2)
    assert one((1, 3)) == ("bottom", 2, 1, 2, 1, 0, 2)
    assert one((4, 1)) == ("Yes", 2, 1, 1, 0, 0, 1)
    assert one((2, 1)) == ("x", 1, 1, 0, None, 1, 0)
    assert one((5, 1)) == ("On this I wrote:\nyes", 2, 1, 1, 0, 0, 1) and one((5, 2)) == ("no", 1, 1, 1, 0, 0, 1)
    assert [r.turn for r in quotes.in_order(quotes.reply_ordered(df)).collect() if r.conv_id == 1] == [0, 1, 2, 3]
    assert quotes.reply_ordered(df.limit(0)).count() == 0


def test_op9_sql_on_planted(spark):
    conversations = spark.createDataFrame(TALK, "conv_id long, turn long, role string, text string")
    frame = conversations.toPandas()
    con = duckdb.connect()
    con.register("conversations", frame)
    want = con.execute(quotes.OP9_SQL).df()
    from oracle import plain

    got = quotes.reply_ordered(conversations)
    columns = sorted(got.columns)
    assert sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=str) == sorted((tuple(plain(None if str(x) in ("nan", "<NA>") else x) for x in r) for r in want[columns].itertuples(index=False)), key=str)


REPLIES = [(8, 0, "a", "Yes, please."), (8, 1, "b", "Which one?"), (8, 2, "a", "Yes, please."), (8, 3, "b", "> Yes, please.\nThen so."), (8, 4, "a", "> Yes, please.\nYes, please."), (8, 5, "b", "> Then so.\n>> Yes, please.\nGood.")]


def test_op9_the_latest_holder_is_the_origin(spark, monkeypatch):
    """A short line that is said again and again, also where its group fills several ranges; a message's own line does not count."""
    monkeypatch.setattr(quotes, "ranged", lambda df, keys, name: scan.ranged(df, keys, name, rows=2))
    df = spark.createDataFrame([*REPLIES, *TALK], "conv_id long, turn long, role string, text string")
    got = {r.turn: (r.parent_turn, r.thread, r.depth, r.n_linked) for r in quotes.reply_ordered(df).where("conv_id = 8").collect()}
    assert got[3][0] == 2 and got[4][0] == 2 and got[5][0] == 3 and got[3][1:3] == (2, 1)
    con = duckdb.connect()
    con.register("conversations", df.toPandas())
    want = {r[0]: r[1:] for r in con.execute(f"select turn, parent_turn, thread, depth, n_linked from ({quotes.OP9_SQL}) where conv_id = 8").fetchall()}
    assert got == want


def test_op9_a_long_message(spark):
    """A message of a megabyte, quoted whole."""
    lines = [f"Line number {i} of a very long message says so." for i in range(22_000)]
    rows = [(1, 0, "a", "\n".join(lines)), (1, 1, "b", "\n".join(f"> {x}" for x in lines) + "\nI see.")]
    assert len(rows[0][3]) > 1_000_000
    got = {r.turn: r for r in quotes.reply_ordered(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert (got[1].parent_turn, got[1].n_quoted, got[1].body) == (0, 22_000, "I see.") and got[0].n_linked == 0


def test_op9_repeated_rows_and_nulls(spark):
    rows = [*TALK, TALK[1], (None, 1, "a", "> Hello there"), (1, None, "a", "> Hello there")]
    assert quotes.reply_ordered(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).count() == len(rows)


def rounds_of(monkeypatch):
    """How many levels are named, as they are."""
    done, staged = [], url_tree.staged
    monkeypatch.setattr(url_tree, "staged", lambda df, name, **more: (done.append(1) if name == "nodes" else None, staged(df, name, **more))[1])
    return done


def test_op10_all_similar_siblings_merge(spark):
    """Two branches that are like each other, and unlike the largest one, are one template."""
    urls = lambda s, n, bad: [(s, f"/{s}/{i % 7}{'abcdefg'[i % 7]}x/end", "block" if i % 100 < bad else "allow") for i in range(n)]
    rows = [*urls("aaa", 300, 95), *urls("bbb", 100, 60), *urls("ccc", 100, 60), *urls("ddd", 100, 5), *urls("eee", 5, 60)]
    df = spark.createDataFrame([("h", p, v) for _, p, v in rows], "host string, path string, _rule_verdict string")
    first = {(r.path.split("/")[1], r.template.split("/")[1]) for r in url_tree.templates(df).select("path", "template").distinct().collect()}
    assert first in ({("aaa", "aaa"), ("bbb", x), ("ccc", x), ("ddd", "ddd"), ("eee", "eee")} for x in ("bbb", "ccc"))


def test_op10_shared_segments_are_one_step(spark, monkeypatch):
    """300 shared segments take as many rounds as three, and every path keeps all of its own."""
    done, counts = rounds_of(monkeypatch), []
    for depth in (3, 300):
        shared = "/".join("abcdefghij"[i % 10] + "klmnopqrst"[i // 10 % 10] + "uvw"[i // 100] for i in range(depth))
        paths = [f"/{shared}/{x}" for x in ("a/one", "a/two", "b", "b/c/d")] + ["/" + shared, "/"]
        df = spark.createDataFrame([("h", p, None) for p in paths], "host string, path string, _rule_verdict string")
        done.clear()
        got = {r.path: r.template for r in url_tree.templates(df).collect()}
        counts.append(len(done))
        assert got == {p: p for p in paths}
    assert counts[0] == counts[1] <= 4
