"""Chat trees, wrapper induction and URL filters."""

import hashlib
import random

import pandas as pd
from pyspark.sql import functions as F

from spanloom.llm import chat, urls, wrapper

CONV = "conv_id bigint, turn bigint, role string, text string"


def conversations(seed=3):
    rng = random.Random(seed)
    texts = ["hello", "", None, "\\### Assistant: </turn> ok", "<turn>", "a#b\\h", "x" * 3000, "line\nline", "\\", "#<\\:"]
    rows = []
    for c in range(120):
        for t in range(rng.randrange(1, 6)):
            rows.append((c, t, rng.choice(["user", "assistant", "assistant", "sys:tem#", None]), rng.choice(texts[:3] if t < 2 else texts)))
    return rows + [(None, 1, "user", "n"), (None, 0, "assistant", "m"), (500, 1, "user", "tie"), (500, 1, "assistant", "tie"), (500, 1, "user", "tie"), (2**60 + 1, None, "user", "deep")]


def grouped(rows):
    """Turns by conversation; each row without a conversation is one of its own."""
    by = {}
    for i, (c, *rest) in enumerate(rows):
        by.setdefault(("alone", i) if c is None else c, []).append(rest)
    return by


def test_chat_round_trip(spark):
    rows = conversations()
    df = spark.createDataFrame(rows, CONV).withColumn("path", F.lit("clash")).withColumn("depth", F.lit("clash"))
    emission, leaves = chat.conversation_tree(df.repartition(5))
    read = chat.read_back(emission, leaves).collect()
    got, by = {r["conv_id"]: r for r in read if r["conv_id"] is not None}, grouped(rows)
    alone = [by.pop(c) for c in list(by) if isinstance(c, tuple)]
    digest = lambda t: hashlib.sha256(f"{t[0][1]}\n{t[0][2]}\n".encode()).hexdigest()
    assert len(alone) == 2 and sorted(map(digest, alone)) == sorted(r["turns_sha256"] for r in read if r["conv_id"] is None)
    assert set(got) == set(by) and len(read) == len(by) + 2
    for c, turns in by.items():
        turns.sort(key=lambda t: tuple((x is not None, x) for x in t))
        turns = [(r or "", x or "") for _, r, x in turns]
        loss = "".join(x for r, x in turns if r == "assistant")
        r = got[c]
        assert r["n_turns"] == len(turns)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r["formatted_chars"] == sum(len(chat.format_turn(*t)[0]) for t in turns)


def test_chat_tree_is_depth_first_and_shared(spark):
    rows = conversations(5)
    emission, _ = chat.conversation_tree(spark.createDataFrame(rows, CONV))
    nodes = sorted((r.asDict() for r in emission.collect()), key=lambda r: r["seq_start"])
    by = grouped(rows)
    distinct = set()
    for turns in by.values():
        turns.sort(key=lambda t: tuple((x is not None, x) for x in t))
        for i in range(len(turns)):
            distinct.add(tuple((r or "", x or "") for _, r, x in turns[:i + 1]))
    assert len(nodes) == len(distinct)
    at, stack = 0, []
    for n in nodes:
        assert n["seq_start"] == at and n["seq_end"] == at + len(n["segment"])
        at = n["seq_end"]
        del stack[n["depth"]:]
        merged = []
        for a, b in stack:
            merged = merged[:-1] + [(merged[-1][0], b)] if merged and merged[-1][1] == a else merged + [(a, b)]
        assert [(i["start"], i["stop"]) for i in n["intervals"]] == merged
        assert n["pos_start"] == sum(b - a for a, b in stack)
        stack.append((n["seq_start"], n["seq_end"]))
    empty, leaves = chat.conversation_tree(spark.createDataFrame([], CONV))
    assert empty.count() == 0 and chat.read_back(empty, leaves).count() == 0


def test_long_conversations_and_many_null_ids_have_small_keys(spark, monkeypatch):
    """100,000 turns in one conversation, two that leave it halfway, and 300,000 rows without an id."""
    monkeypatch.setattr(chat, "fits_broadcast", lambda df: False)
    keys, place = [], chat.place_chains

    def watched(turns):
        keys.append(turns.agg(F.max(F.length("key")).alias("n")).first()["n"])
        return place(turns)

    monkeypatch.setattr(chat, "place_chains", watched)
    long = [(1, t, "user" if t % 2 else "assistant", f"t{t}") for t in range(100_000)]
    rows = long + [(c, t, r, x) for c in (2, 3) for _, t, r, x in long[:50_000]] + [(2, 50_000, "user", "else"), (3, 50_000, "user", "other")]
    same = spark.range(300_000).selectExpr("cast(null as bigint) conv_id", "1L turn", "'user' role", "cast(id % 1000 as string) text")
    schema = spark.createDataFrame([], CONV).schema
    tree = spark.createDataFrame(pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]), schema).unionByName(same)
    emission, leaves = chat.conversation_tree(tree)
    assert emission.count() == 100_002 + 1000 and leaves.count() == 300_003
    deep = emission.where("depth >= 49999").agg(F.max(F.size("intervals")).alias("n")).first()["n"]
    assert deep <= 2
    got = {r["conv_id"]: r for r in chat.read_back(emission, leaves.where("conv_id is not null")).collect()}
    assert {c: r["n_turns"] for c, r in got.items()} == {1: 100_000, 2: 50_001, 3: 50_001}
    want = hashlib.sha256("".join(f"{r}\n{x}\n" for _, _, r, x in long).encode()).hexdigest()
    assert got[1]["turns_sha256"] == want
    assert keys == [40]


PAGE = ("<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{{}}</style><script>var t=\"</p>\";</script></head><body>"
        "<nav><ul><li><a href='/x'>{0}</a><li>two</ul></nav><!-- <p>no</p> --><div class=\"ad\">{1}</div><header>H {0}</header>{2}"
        "<aside>s</aside><form><p>mail</p></form><div class='cookie-notice'>n</div><section id=comments><p>c {0}</p></section>"
        "<footer>&copy; f</footer></body></html>")


def page(i, body):
    return PAGE.format(f"menu{i}", f"buy {i}", body)


def test_main_text(spark):
    rows, want = [], {}
    for i in range(30):
        rows.append((i, f"http://a.example.org/{i}", page(i, f"<article><h1>Title&nbsp;{i} &am</h1><p><b>One {i}.<br><p>Two\n  &lt;x&gt; &amp {i}</p><ul><li>l1<li>l2</ul>"
                                                             f"<div class='share'>share</div><article class='comment'>no</article></article>")))
        want[i] = f"Title {i} &am\nOne {i}.\nTwo <x> & {i}\nl1\nl2"
    for i in range(30, 50):  # no <article>: varying slots of the host's wrapper
        rows.append((i, f"http://b.example.org/{i}", page(i, f"<div id=wrap><div class=body><p>First {i} of a long and varying text</p><p>Second {i * 7} with more</p>"
                                                             "<div>Subscribe here now</div></div></div>")))
        want[i] = f"First {i} of a long and varying text\nSecond {i * 7} with more"
    rows += [(50, None, None), (51, "x", ""), (52, "x", "plain &amp; text"), (53, "http://c/", "<article>cut <b>of"), (None, "http://c/", "<div>" * 3000 + "deep"),
             (55, "http://c/", "<p a='" * 500), (56, "http://c/", "<article>" + "<p>w</p>" * 20_000), (50, None, None)]
    want |= {50: "", 51: "", 52: "plain & text", 53: "cut of", 56: "\n".join(["w"] * 20_000)}
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("host", F.lit("clash")).withColumn("wrapper", F.lit("clash"))
    out = wrapper.main_text(df.repartition(4)).collect()
    assert len(out) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in out)
    got = {r["page_id"]: r["text"] for r in out}
    for i, text in want.items():
        assert got[i] == text, i
    assert wrapper.main_text(df.limit(0)).count() == 0


def slow_matching(a, b):
    """Simple tree matching by its definition, without memory or short cuts."""
    if a.label != b.label:
        return 0
    table = [[0] * (len(b.kids) + 1) for _ in range(len(a.kids) + 1)]
    for i, x in enumerate(a.kids):
        for j, y in enumerate(b.kids):
            table[i + 1][j + 1] = max(table[i][j + 1], table[i + 1][j], table[i][j] + slow_matching(x, y))
    return 1 + table[-1][-1]


def random_tree(rng, depth=0):
    return wrapper.Part(rng.choice("pq"), rng.randrange(3)), [random_tree(rng, depth + 1) for _ in range(rng.randrange(4 if depth < 3 else 1))]


def planted(tree):
    part, kids = tree
    part.kids = [planted(k) for k in kids]
    return part


def test_tree_matching_equals_its_definition(monkeypatch):
    rng = random.Random(2)
    for trial in range(400):
        a, b = planted(random_tree(rng)).measure(), planted(random_tree(rng)).measure()
        b.label = a.label
        a.measure(), b.measure()
        assert wrapper.matching(a, b, {}) == slow_matching(a, b)
        pairs = list(wrapper.matched(a, b))
        assert len(pairs) == slow_matching(a, b) and all(x.label == y.label for x, y in pairs)
        if trial % 4 == 0:
            with monkeypatch.context() as m:
                m.setattr(wrapper, "TABLE", 0)
                assert len(list(wrapper.matched(a, b))) <= slow_matching(a, b)
        size = a.size + b.size - len(pairs)
        assert wrapper.merge(b, a).size == size


def test_long_lists_of_children_are_aligned_as_short_ones(monkeypatch):
    """The best alignment, not the next child of a label: 300 x 300 children are more than the table holds whole."""
    def children(labels):
        return wrapper.tree_of("\n".join(["0 ul", *(f"1 {x}" for x in labels)])).kids

    assert wrapper.aligned(children(["b"] + ["a"] * 299), children(["a"] * 299 + ["b"]), {}) == [(i + 1, i) for i in range(299)]
    rng = random.Random(9)
    for _ in range(20):
        trees = [wrapper.tree_of("\n".join(["0 ul"] + [x for _ in range(rng.randint(1, 40)) for x in rng.choice(["1 a", "1 b", "1 c", "1 a\n2 b", "1 a\n2 b\n2 c"]).split("\n")])) for _ in "xy"]
        whole = wrapper.aligned(*(t.kids for t in trees), {})
        with monkeypatch.context() as m:
            m.setattr(wrapper, "TABLE", 0)
            m.setattr(wrapper, "WEIGHTS", rng.choice([0, 1 << 24]))
            assert wrapper.aligned(*(t.kids for t in trees), {}) == whole


def test_a_wrapper_knows_constant_nodes_and_slots():
    pages = [f"<div><p>same</p>{'<ul><li>more</ul>' if i % 2 else ''}<p>text {i}</p><table><tr><td>cell</table></div>" for i in range(6)]
    root, _ = wrapper.loaded(wrapper.induced(pages))
    div = root.kids[0]
    assert [(k.label, k.support, k.text is None) for k in div.kids] == [("p", 6, False), ("ul", 3, False), ("p", 6, True), ("table", 6, False)]


def test_article_text_is_never_lost(spark):
    """Versions of one article, like titles, and names that only look like those of menus."""
    two = ["<article><h1>Pump</h1><p>First part.</p><ul><li>a<li>b</ul><p>Cost: 3 m.</p></article>", "<article><h1>Pump</h1><p>First part.</p><ul><li>a<li>b</ul><p>Cost: 4 m.</p></article>"]
    got = texts_of(spark, two + [two[0].replace("3 m", f"{i} m") for i in range(5, 9)])
    assert got[0] == "Pump\nFirst part.\na\nb\nCost: 3 m." and got[1].startswith("Pump\nFirst part.")
    weekly = [f"<body><nav>n</nav><div class=story><h1>Weekly report</h1><h2>Summary</h2><p>Numbers of week {i} are so and so</p></div></body>" for i in range(6)]
    assert all(t == f"Weekly report\nSummary\nNumbers of week {i} are so and so" for i, t in texts_of(spark, weekly).items())
    odd = "<article><h1>T</h1><section class=\"legal analysis\"><p>Law.</p></section><p id=search>Search it.</p><div class=\"side effects\">Pain.</div><header>Sub</header>"
    odd += "<div class=ad>Buy</div><div class='comment-list'><p>Nice!</p></div><span class=ad>x</span></article>"
    assert texts_of(spark, [odd]) == {0: "T\nLaw.\nSearch it.\nPain.\nSub"}


def test_the_wrapper_finds_content_without_articles(spark):
    pages = [f"<body><div class=lead>Welcome to our site, the best of all sites in the whole wide world</div><div class=a><div class=b><p>Body {i} one two</p><p>End {i}</p>"
             f"</div></div><div class=c>Read more of us here, every single day of the year</div></body>" for i in range(7)]
    assert all(t == f"Body {i} one two\nEnd {i}" for i, t in texts_of(spark, pages).items())
    assert "Welcome" in texts_of(spark, pages[:2])[0]  # two pages are too few to tell


def texts_of(spark, pages):
    df = spark.createDataFrame([(i, f"http://h.example.org/{i}", p) for i, p in enumerate(pages)], "page_id bigint, url string, html string")
    return {r["page_id"]: r["text"] for r in wrapper.main_text(df.repartition(3)).collect()}


def test_wrapper_decides_inside_articles_and_on_mixed_hosts(spark):
    promo = "<article class=teaser><p>Buy our yearly book</p></article>"
    bodies = [f"{promo}<article><h1>Title {i}</h1><p>Text {i} of it</p><div class=terms>Read the terms of use</div></article>" for i in range(8)]
    bodies += [f"{promo}<div class=story><p>Story {i} is told here</p><p>and ends {i}</p></div><div class=terms>Read the terms of use</div>" for i in range(8, 16)]
    got = texts_of(spark, [page(i, b) for i, b in enumerate(bodies)])
    assert all(got[i] == f"Title {i}\nText {i} of it" for i in range(8))
    assert all(got[i] == f"Story {i} is told here\nand ends {i}" for i in range(8, 16))
    # copies of one page tell nothing about its template
    assert texts_of(spark, ["<article><p>same</p></article>"] * 3) == dict.fromkeys(range(3), "same")


def test_wrappers_have_no_bound_on_children_or_depth(spark):
    many = "".join(f"<h2 class=k{chr(97 + k // 26)}{chr(97 + k % 26)}>Head</h2><p>Line</p>" for k in range(100))
    pages = [f"<body>{many}<table><tr><td>Constant cell</td></tr></table><section><p>Varying {i} text</p></section></body>" for i in range(6)]
    assert all(t == f"Varying {i} text" for i, t in texts_of(spark, pages).items())
    deep = "<div>" * 100
    pages = [f"<body>{deep}<p>Deep {i} text</p><ul><li>Deep template</ul></body>" for i in range(6)]
    assert all(t == f"Deep {i} text" for i, t in texts_of(spark, pages).items())


def test_numbered_ids_share_a_wrapper_node(spark):
    pages = [f"<body><div class=x><p>a {i}</p></div><div id=post-{i} class=post><h2>Post {i}</h2><div class=terms>Terms apply</div></div></body>" for i in range(6)]
    assert all("Terms" not in t and f"Post {i}" in t for i, t in texts_of(spark, pages).items())
    assert wrapper.parse("<div id=post-12 class='post h9'></div>").items[0].label == "div post"


def test_wrappers_are_learnt_from_all_pages_of_a_host(spark, monkeypatch):
    """A section of 12 among 200 pages has its own template; 3 pages of one story, the longest ones, do not make any."""
    bodies = [f"<body><div class=story><p>Story {i} is told here</p><p>and ends {i}</p></div></body>" for i in range(185)]
    bodies += [f"<body><div class=offer><p>Offer {i} of the shop</p><p>at a price of {i}</p><div class=terms>Shipping terms apply</div></div></body>" for i in range(185, 197)]
    long = "".join(f"<p>Line {k} of the long story</p>" for k in range(2, 9))
    bodies += [f"<body><div class=story><p>Version {i}</p>{long}</div></body>" for i in range(197, 200)]
    want = {i: f"Story {i} is told here\nand ends {i}" for i in range(185)} | {i: f"Offer {i} of the shop\nat a price of {i}" for i in range(185, 197)}
    want |= {i: "\n".join([f"Version {i}", *[f"Line {k} of the long story" for k in range(2, 9)]]) for i in range(197, 200)}
    assert texts_of(spark, bodies) == want
    monkeypatch.setattr(wrapper, "FAN", 2)  # more rounds, no other result
    assert texts_of(spark, bodies[::-1]) == {199 - i: t for i, t in want.items()}


def test_one_odd_page_of_many_does_not_hide_template():
    page_of = lambda i, end: f"<div class=x><p>Text {i}</p><div class=end>{end}</div></div>"
    end = lambda n, odd: wrapper.loaded(wrapper.induced([page_of(i, "Write to us" if i >= odd else f"other {i}") for i in range(n)]))[0].kids[0].kids[1]
    assert (end(40, 4).support, end(40, 4).text) == (40, wrapper._digest("Write to us"))
    assert end(40, 5).text is None and end(8, 1).text is None and end(8, 0).text is not None


def test_structures_keep_what_enough_pages_have():
    tree = wrapper.blocks_of(wrapper.parse("<body><div class=a><p>x<ul><li>y<li>z</ul></div><table><tr><td>t</table></body>"))
    text = wrapper.structure_of(tree)
    again = wrapper.tree_of(text)
    assert wrapper.structure_of(again) == text and again.shape == tree.shape
    assert [p.place for p in again.in_order()] == list(range(tree.size)) and len(set(wrapper.label_paths(text))) == tree.size - 1
    paths = wrapper.label_paths(text)
    lines = dict(zip([line.split(" ", 1)[1] for line in text.split("\n")], paths))
    kept = lambda *labels: [line.split(" ", 1)[1] for line in wrapper.pruned(text, wrapper.useful_paths(paths, [lines[x][0] for x in labels])).split("\n")]
    assert kept() == ["#root"]
    assert kept("td") == ["#root", "body", "div a", "table", "tr", "td"]
    assert kept("ul") == ["#root", "body", "div a", "p", "ul", "table"]


def test_url_parts_and_rules(spark):
    cases = {"https://M.Example.NET/en/1?x#y": ("m.example.net", "/en/1", "example.net/en/", "allow"), "http://a.net": ("a.net", "", None, None),
             "http://a.net/": ("a.net", "/", "net/", "block"), "HTTP://x.example.com/de/": ("x.example.com", "/de/", "example.com/de/", "block"),
             "http://notexample.com/de/": ("notexample.com", "/de/", None, None), "ftp://b.org/fr/://q": ("b.org", "/fr/://q", "org/fr/", "allow"),
             "http://q?://z/": ("q", "", None, None), "nothing": ("", "", None, None), "://net/x": ("net", "/x", "net/", "block"), "": ("", "", None, None), None: ("", "", None, None)}
    rows = [(i, u, "clash") for i, u in enumerate(cases)]
    out = {r["page_id"]: r for r in urls.judge_urls(spark.createDataFrame(rows, "page_id bigint, url string, host string")).collect()}
    for i, (host, path, rule, verdict) in enumerate(cases.values()):
        r = out[i]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule), r
        assert r["verdict"] == verdict if verdict else r["verdict"] in ("allow", "block")
    assert urls.judge_urls(spark.createDataFrame([], "page_id bigint, url string")).count() == 0


def test_url_model_tells_the_sides_apart(spark):
    rng = random.Random(1)
    word = lambda a: "".join(rng.choices(a, k=8))
    rows = [(i, f"http://{word('abc')}.net/{word('xyz')}") for i in range(400)] + [(i, f"http://{word('def')}.org/fr/{word('uvw')}") for i in range(400, 800)]
    rows += [(1000 + i, f"http://{word('abc')}.io/{word('xyz')}") for i in range(50)] + [(2000 + i, f"http://{word('def')}.io/{word('uvw')}") for i in range(50)]
    out = {r["page_id"]: r for r in urls.judge_urls(spark.createDataFrame(rows, "page_id bigint, url string")).collect()}
    assert sum(out[1000 + i]["verdict"] == "block" for i in range(50)) >= 48 and sum(out[2000 + i]["verdict"] == "allow" for i in range(50)) >= 48


def test_url_model_is_normalised_and_counts_all():
    import numpy as np
    logs = urls.log_probabilities(["^^^a", "^^ab", "^ab$"], np.array([3.0, 2, 5]))
    v = len(urls.ALPHABET)
    assert np.allclose(np.exp(logs).reshape(-1, v).sum(1), 1)
    one, two = "^^^ab$", "^^^zz0$"
    ratio = np.random.default_rng(0).normal(size=v ** 4).astype(np.float32)
    both = urls.llr_scores([one, two], ratio)
    assert np.allclose(both, [urls.llr_scores([x], ratio)[0] for x in (one, two)])
