"""URL rules, HTML extraction, chat formatting and vector search on small tables."""

from __future__ import annotations

import hashlib
import json
import math
import re

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyline.llm.chat_format import MAPPINGS, format_chat, format_records, format_turns, parse_turns, read_back, READ_BACK, turn_records, unescape
from tallyline.llm.common import materialize
from tallyline.llm.html_extract import _features, blocks, composite, extract, importance, noise, page_features, parse
from tallyline.llm.ngram_trie import EliasFano, Levels, Trie, STEP
from tallyline.llm.url_filter import CONTRACT_RULES, DEFAULT_PATTERNS, Rule, filter_urls
from tallyline.llm.vector_topk import top_k

URLS = [
    None, "", "no scheme.com/en/", "http://example.com/en/7", "https://WWW.Example.COM/en/742?x=/net/", "http://xexample.com/en/7", "http://a.com/en", "http://a.com/en/", "http://a.com/fr/en/", "http://example.net/de/8", "http://b.example.net/de/81#t",
    "http://example.net/de/9", "http://example.org/es/1", "http://example.org?/es/", "http://com/en/x", "ftp://x.y.com/en/://z", "http://casino.org/", "http://x.org/cgi-bin/q", "http://x.org/wp-login.php", "http://example.com:80/en/7", "http://ünï.com/en/é", "http://A.COM/EN/", "x://", "http://example.com/en/7\nq", "http://adserver.example.org/x",
]


def _plain(url: str | None, rules: list[tuple[str, str]]) -> tuple:
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = [(len(r), r, v) for r, v in rules if (host == r.partition("/")[0] or host.endswith("." + r.partition("/")[0])) and path.startswith("/" + r.partition("/")[2])]
    if fits:
        return host, path, *max(fits)[1:]
    bad = any(re.search(p.pattern, f"{host}\n{path}") for p in DEFAULT_PATTERNS)
    return host, path, None, "block" if bad else "allow"


def test_url_rules(spark):
    urls = spark.createDataFrame([(i, u, "h", "b") for i, u in enumerate([*URLS, *URLS[:5]])], "page_id long, url string, host string, best string")
    got = filter_urls(urls, CONTRACT_RULES + DEFAULT_PATTERNS).orderBy("page_id").collect()
    rules = [(r.name, r.verdict) for r in CONTRACT_RULES]
    assert [(r.host, r.path, r.rule, r.verdict) for r in got] == [_plain(u, rules) for u in [*URLS, *URLS[:5]]]
    assert filter_urls(urls.limit(0), CONTRACT_RULES).count() == 0
    anywhere = (Rule("any", "block", r"\d", (), 5),)
    assert [r.verdict for r in filter_urls(urls, anywhere).orderBy("page_id").collect()][3:5] == ["block", "block"]


def test_line_feeds_in_hosts_and_paths(spark, monkeypatch):
    urls = ["http://a\nb.com/en/x", "http://a.b\n.com/en/x", "http://b.net\n/de/x", "http://b.com/x\n/en/", "http://x\ncom/en/1", "http://\ncom/en/1", "http://e\n.example.com/en/7\n1"]
    expected = ["com/en/", "com/en/", None, None, None, None, "example.com/en/7"]
    rows = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    assert [r.rule for r in filter_urls(rows, CONTRACT_RULES).orderBy("page_id").collect()] == expected
    monkeypatch.setattr("tallyline.llm.url_filter.LITERAL_RULES", 3)
    assert [r.rule for r in filter_urls(rows, CONTRACT_RULES).orderBy("page_id").collect()] == expected


def test_more_rules_than_travel_in_the_plan(spark, monkeypatch):
    urls = spark.createDataFrame([(i, u, "h", "b", i) for i, u in enumerate([*URLS, *URLS[:5]])], "page_id long, url string, host string, best string, row int")
    rules = CONTRACT_RULES + DEFAULT_PATTERNS + (Rule("any", "block", r"\d\d", (), 5),)
    columns = ["page_id", "row", "host", "path", "rule", "verdict"]
    few = [tuple(r) for r in filter_urls(urls, rules).select(*columns).orderBy("page_id").collect()]
    monkeypatch.setattr("tallyline.llm.url_filter.LITERAL_RULES", 3)
    many = filter_urls(urls, rules)
    assert set(many.columns) == set(urls.columns) | {"path", "rule", "verdict"}
    assert [tuple(r) for r in many.select(*columns).orderBy("page_id").collect()] == few
    assert [tuple(r) for r in filter_urls(urls, rules[:-1]).select(*columns).orderBy("page_id").collect()][:5] == few[:5]


PAGE = '<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var a="<p>no</p>";</script></head><body><nav><ul><li><a href=x>Home {i}</a></ul></nav><div class="ad">Buy {i}</div><article><h1>T{i}</h1><p><b>One &amp; two&nbsp;{i}<br>three<p>Four\n\n five</p><div>Read our other stories</div><section class="comments"><p>me first</p></section></article><footer>&copy; x</footer>'


def test_html_extraction(spark):
    rows = [(i, f"http://h.example/{i}", PAGE.format(i=i), "k") for i in range(8)] + [(50, None, None, "k"), (51, "bad", "", None), (52, "http://h.example/0", PAGE.format(i=0), "k"), (53, "http://one.example/", "<p>Only <!-- x -->this &lt;b&gt;", "k"), (54, "http://one.example/", "<div>" * 3000 + "deep", "k")]
    got = {r.page_id: r for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()}
    assert len(got) == len(rows)
    # The block that all pages of the host repeat goes; the article's own paragraphs stay.
    assert got[3].text == "T3\nOne & two 3 three\nFour five" and got[52].text == got[0].text
    assert got[50].text == "" and got[51].text == "" and got[53].text == "Only this <b>" and got[54].text == "deep"
    assert all(r.n_chars == len(r.text) for r in got.values())
    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


NEUTRAL = '<body><div class="ka"><div class="kb"><p>Home<p>Shop<p>About us</div><div class="kc"><p>Story {i} begins<p>and goes on {i}<div class="ke">Good {i}<em>!</em></div></div><div class="kd">{rotating}<div>All rights reserved<p>Imprint</div></div></div>'


def _site(host: str, n: int, start: int) -> list[tuple]:
    return [(start + i, f"http://{host}/{i}", NEUTRAL.format(i=i, rotating="Seen by many" if i % 2 else "Seen by few")) for i in range(n)]


def test_the_style_tree_removes_what_no_name_gives_away(spark):
    rows = [*_site("many.example", 12, 0), *_site("few.example", 3, 100), *_site("MANY.example", 1, 0)]
    got = {(r.page_id, r.url): r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert len(got) == len(rows)
    for i in range(12):
        assert got[i, f"http://many.example/{i}"] == f"Story {i} begins\nand goes on {i}\nGood {i}!"
        # Names alone keep it all.
        assert blocks(parse(rows[i][2]), frozenset())[:3] == ["Home", "Shop", "About us"]
    # What three pages repeat is no evidence yet.
    assert "Home" in got[100, "http://few.example/0"] and "Imprint" in got[102, "http://few.example/2"]


def _tree(pages: list[str]) -> dict[int, float]:
    """Composite importance by path, of one host's tree built and walked in one place."""
    found = list({repr(f): f for f in (page_features(parse(p)) for p in pages)}.values())
    styles, texts, children, tops = {}, {}, {}, set()
    for page in found:
        for path, line, style, content in page:
            styles.setdefault(path, []).append(style)
            texts.setdefault(path, []).extend(content)
            children.setdefault(line[-2], set()).add(path) if len(line) > 1 else tops.add(path)

    def own(path):
        m = len(styles[path])
        if m == 1:
            return 1.0
        counts = lambda xs: [xs.count(x) for x in set(xs)]
        best = -sum(c / m * math.log(c / m) for c in counts(styles[path])) / math.log(m)
        if texts[path]:
            best = max(best, 1 - sum(c * math.log(c) for c in counts(texts[path])) / len(texts[path]) / math.log(m))
        return 1 - (1 - best) * (1 - 1 / m)

    out = {}

    def walk(path):
        if path not in children:
            out[path] = own(path)
        else:
            for c in children[path]:
                walk(c)
            fade, all_ = 0.9 ** len(set(styles[path])), sum(len(styles[c]) for c in children[path])
            out[path] = (1 - fade) * own(path) + fade * sum(len(styles[c]) / all_ * out[c] for c in children[path])

    for t in tops:
        walk(t)
    return out


def test_composite_importance_against_a_tree_in_one_place(spark):
    rng = np.random.default_rng(5)
    words = ["Home", "Shop", "News", "Once", "upon", "a time"]

    def branch(depth):
        if depth == 0 or rng.random() < 0.3:
            return " ".join(rng.choice(words, 2))
        return "".join(f'<{t} class="{"ab"[rng.integers(2)]}">{branch(depth - 1)}</{t}>' for t in rng.choice(["div", "p", "section", "span", "ul"], rng.integers(1, 4)))

    sites = {h: ['<ul class="q"><li>Home<li>Shop</ul>' + branch(4) if rng.random() < 0.7 else "<div><p>Home</p></div>" for _ in range(n)] for h, n in (("a", 25), ("b", 6), ("c", 1))}
    rows = [(h, p) for h, pages in sites.items() for p in pages]
    features = materialize(_features(spark.createDataFrame([*rows, *rows[:5]], "host string, html string")), "features")
    got = {(r.host, r.path): r for r in composite(importance(features)).collect()}
    low = {(r.host, r.path) for r in noise(features, 0.4).collect()}
    expected = {(h, path): x for h, pages in sites.items() for path, x in _tree(pages).items()}
    assert set(got) == set(expected) and len(got) > 50
    assert all(got[k].composite == pytest.approx(x) for k, x in expected.items())
    assert low == {k for k in got if all(expected[d] < 0.4 for d in got if d[0] == k[0] and k[1] in got[d].line)} and low


@pytest.mark.parametrize(
    ("html", "expected"),
    [
        ("<p>a<p>b<ul><li>x<li>y<ul><li>z</ul><li>w</ul>", ["a", "b", "x", "y", "z", "w"]),
        ("<table><tr><td>1<td>2<tr><td>3</table>", ["1", "2", "3"]),
        ("a<b>b</p>c</b>d", ["abcd"]),
        ("<body><header>H</header><main><h2>T</h2>x <i>y</i></main><aside>A", ["T", "x y"]),
        ("<p hidden>h<p>s<span class='cookie-notice'>c</span>t<script>x", ["st"]),
        ("<textarea>&lt;p&gt;</textarea><p>&#x41;&#66;&euro;", ["AB€"]),
        ("text < 5 and <3", ["text < 5 and <3"]),
        ('<div role="navigation">n</div><div id="main-menu">m</div><div>k</div>', ["k"]),
    ],
)
def test_blocks(html, expected):
    assert blocks(parse(html), frozenset()) == expected


texts = st.text(alphabet=st.sampled_from(list("ab<>/\\\n:#turnassistant é\U0001f600 ")), max_size=40)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system"]), texts), texts), max_size=6))
def test_turns_round_trip(turns):
    formatted, spans = format_turns(turns)
    assert parse_turns(formatted) == turns
    lost = [unescape(formatted[a:b]) for a, b in zip(spans[::2], spans[1::2])]
    assert lost == [t for r, t in turns if r == "assistant"]
    # Without the escapes' second characters, markers stand where turns end and nowhere else.
    assert re.sub(r"\\.", "", formatted, flags=re.S).count("</turn>") == len(turns)


def test_layouts_and_bad_records(spark):
    records = {
        "messages": {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": None}]},
        "conversations": {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}], "id": 3},
        "instruction": {"instruction": "do", "input": "this", "output": "done"},
        "system prompt": {"system": "s", "prompt": "p", "response": "r"},
        "prompt completion": {"prompt": "p", "completion": "c", "extra": {"deep": [1]}},
        "question answer": {"question": "q", "answer": 5},
        "nested": {"data": {"prompt": "p", "response": "r"}},
    }
    rows = [(k, json.dumps(v), 1) for k, v in records.items()] + [("bad", "{", 1), ("null", None, 1), ("unknown", '{"x": 1}', 1), ("list", "[1]", 1), ("number", "7", 1)]
    got = {r["name"]: r for r in format_chat(spark.createDataFrame(rows, "name string, record string, formatted int")).collect()}
    assert {k: got[k].layout for k in records} == {k: k for k in records}
    assert parse_turns(got["instruction"].formatted) == [("user", "do\n\nthis"), ("assistant", "done")]
    assert parse_turns(got["conversations"].formatted) == [("user", "q"), ("assistant", "a")]
    assert all(got[k].formatted is None and got[k].layout is None for k in ("bad", "null", "unknown", "list", "number"))
    assert got["messages"].fingerprint != got["conversations"].fingerprint and len({m.name for m in MAPPINGS}) == len(MAPPINGS)


json_values = st.recursive(
    st.none() | st.booleans() | st.integers() | st.floats() | st.text(max_size=4),
    lambda inner: st.lists(inner, max_size=3) | st.dictionaries(st.sampled_from(["messages", "turns", "conversations", "role", "content", "text", "from", "value", "prompt", "response", "data", "a.b"]), inner, max_size=4),
    max_leaves=8,
)


@settings(max_examples=200, deadline=None)
@given(st.lists(json_values, max_size=6), st.randoms(use_true_random=False))
def test_any_record_in_any_order(values, rng):
    records = [json.dumps(v) for v in values] + ['{"messages": []}', '{"messages": 5}', '{"messages": "hey"}', '{"messages": ["a"]}', '{"messages": {"role": "user"}}', "[" * 100_000, '{"prompt": "\\ud800", "response": "\\ud83d\\ude00"}']
    alone = {r: format_records(pd.Series([r])).iloc[0].tolist() for r in records}
    rng.shuffle(records)
    together = format_records(pd.Series(records))
    assert [x.tolist() for _, x in together.iterrows()] == [alone[r] for r in records]
    assert alone['{"messages": []}'][0] == "" and alone["[" * 100_000] == [None] * 4
    assert all(alone[r][0] is None for r in ('{"messages": 5}', '{"messages": "hey"}', '{"messages": ["a"]}', '{"messages": {"role": "user"}}'))
    assert parse_turns(alone[[r for r in alone if "ud800" in r][0]][0]) == [("user", "\ufffd"), ("assistant", "\U0001f600")]
    for text in together["formatted"].dropna():
        parse_turns(text)


def test_conversations_take_several_layouts(spark):
    roles = [["user", "assistant"], ["system", "user", "assistant"], ["user", "assistant", "user"], ["user"], ["assistant", "human"], ["gpt", "user"], ["system", "system"]]
    rows = [(c, t, r, f"{c}-{t} <") for c in range(40) for t, r in enumerate(roles[c % len(roles)])]
    got = format_chat(turn_records(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()
    assert {r.layout for r in got} == {"prompt response", "system prompt", "messages", "conversations", "turns"}
    for r in got:
        assert parse_turns(r.formatted) == [(role, text) for c, _, role, text in rows if c == r.conv_id]


def test_turn_tables(spark):
    rows = [(1, 1, "assistant", "</turn> \\<turn:user>"), (1, 0, "user", None), (1, 1, "assistant", "</turn> \\<turn:user>"), (1, None, None, "last"), (2, 0, "assistant", ""), (None, 0, "user", "n"), (3, 5, "assistant", "x" * 100000)]
    done = format_chat(turn_records(spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, record string")))
    got = {r.conv_id: r for r in done.withColumn("b", F.pandas_udf(read_back, READ_BACK)("formatted", "loss_spans")).select("conv_id", "formatted", "b.*").collect()}
    expected = [("user", ""), ("assistant", rows[0][3]), ("assistant", rows[0][3]), ("", "last")]
    assert parse_turns(got[1].formatted) == expected
    assert got[1].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in expected).encode()).hexdigest()
    assert got[1].loss_chars == 2 * len(rows[0][3]) and got[2].loss_chars == 0 and got[3].loss_chars == 100000 and set(got) == {1, 2, 3, None}
    assert turn_records(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def _best(rows: list[tuple], k: int) -> list[tuple]:
    fine = [(i, r[0], [math.floor(256 * float(np.float32(x))) for x in r[1]]) for i, r in enumerate(rows) if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    out = []
    for i, a, v in fine:
        if a is not None and a % 5 == 0:
            scores = sorted((-sum(x * y for x, y in zip(v, w)), b is None, b or 0) for j, b, w in fine if j != i and len(w) == len(v))
            out += [(a, n + 1, None if none else b, -s) for n, (s, none, b) in enumerate(scores[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("size", [7, 64])
def test_vector_search(spark, monkeypatch, size):
    monkeypatch.setattr("tallyline.llm.vector_topk.INDEX_BLOCK", size)
    monkeypatch.setattr("tallyline.llm.vector_topk.QUERY_BLOCK", 4)
    monkeypatch.setattr("tallyline.llm.vector_topk.QUERIES_OF_COPY", 3)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(4, 6))
    rows = [(i, [float(x) for x in centres[i % 4] * (1 + i % 3) + rng.normal(scale=0.05, size=6)]) for i in range(150)]
    rows += [(200, rows[0][1]), (205, rows[0][1]), (5, rows[0][1]), (5, rows[5][1]), (None, rows[0][1]), (210, None), (215, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (220, [float("nan")] * 6), (225, [float("inf")] * 6), (230, [1.0, 2.0]), (235, [0.0, -1.0]), (240, []), (245, [9.0])]
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, v string, block int").repartition(4)
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in top_k(table, F.col("vec_id") % 5 == 0).collect()]
    assert sorted(got, key=str) == _best(rows, 5)
    assert top_k(table.limit(0), F.lit(True)).count() == 0
    wide = [(i, [float(x) * 1e4 for x in v], "x", 1) for i, v in rows[:60]]
    assert sorted([(r.query_id, r["rank"], r.vec_id, r.score) for r in top_k(spark.createDataFrame(wide, table.schema), F.col("vec_id") % 5 == 0).collect()], key=str) == _best(wide, 5)


def test_elias_fano_and_trie():
    rng = np.random.default_rng(1)
    for n, top in ((0, 10), (1, 1), (300, 400), (2000, 2**63), (1000, 20)):
        v = np.sort(rng.integers(0, top, n, dtype=np.uint64))
        e = EliasFano(v, Levels())
        asked = np.concatenate([v, rng.integers(0, top, 500, dtype=np.uint64)])
        found = e.find(asked)
        assert all((x in set(v.tolist())) == (p >= 0) and (p < 0 or v[p] == x) for x, p in zip(asked.tolist(), found.tolist()))
        assert not n or (e.get(np.arange(n)) == v).all()
    context = np.sort(rng.integers(0, 50, 400, dtype=np.uint64))
    pairs = np.unique(np.stack([context, rng.integers(0, 99, 400, dtype=np.uint64)], 1), axis=0)
    count = rng.integers(1, 9, len(pairs))
    total = np.array([count[pairs[:, 0] == c].sum() for c in pairs[:, 0]])
    kinds = np.array([(pairs[:, 0] == c).sum() for c in pairs[:, 0]])
    triples = np.unique(np.stack([rng.integers(0, len(pairs), 900), rng.integers(0, 6, 900) * 1_000_003 % (1 << 32)], 1), axis=0)
    many = rng.integers(1, 5, len(triples))
    trie = Trie(pairs[:, 0], pairs[:, 1], count, total, kinds, 0.5, (triples[:, 0], triples[:, 1].astype(np.uint64), many))
    value, place, left = trie.lookup(np.append(pairs[:, 0], [7, 999]).astype(np.uint64), np.append(pairs[:, 1], [500, 1]).astype(np.uint64))
    assert (place[:-2] == np.arange(len(pairs))).all() and (place[-2:] == -1).all() and left[-1] == 0
    assert np.allclose(value[:-2], np.log10((count - 0.5) / total), atol=STEP)
    for c in np.unique(pairs[:, 0]):
        mine = np.flatnonzero(pairs[:, 0] == c)
        assert (10 ** value[mine]).sum() + 10 ** left[mine[0]] <= 1 + 1e-9
    own = [(pairs[p, 0], b) for p, b in triples]
    sums, sorts = {k: sum(m for o, m in zip(own, many) if o == k) for k in set(own)}, {k: own.count(k) for k in set(own)}
    asked = [*((p, b) for p, b in triples), *((p, b * 1_000_003 % (1 << 32)) for p in range(0, len(pairs), 7) for b in range(8)), (-1, triples[0, 1])]
    contexts = np.array([pairs[p, 0] for p, _ in asked[:-1]] + [pairs[triples[0, 0], 0]])
    value, seen, left = trie.lookup_longer(np.array([b for _, b in asked]), contexts.astype(np.uint64), np.array([p for p, _ in asked]))
    known = {tuple(t): m for t, m in zip(triples.tolist(), many)}
    for (p, b), c, x, s, y in zip(asked, contexts, value, seen, left):
        assert s == ((p, b) in known)
        assert not s or x == pytest.approx(math.log10((known[p, b] - 0.5) / sums[c, b]), abs=STEP)
        assert y == (pytest.approx(math.log10(min(1, 0.5 * sorts[c, b] / sums[c, b])), abs=STEP) if (c, b) in sums else 0)


@pytest.mark.parametrize(
    ("html", "expected"),
    [
        ('<div class="content has-sidebar"><article>A</article></div>', ["A"]),
        ('<div class="page with-header"><main>A</main></div>', ["A"]),
        ('<div class="no-comments"><p>A</div><div class="search-results">B</div>', ["A", "B"]),
        ('<article class="post no-comments">A', ["A"]),
        ('<form id="aspnetForm"><div class="nav">n</div><article>A</article><input></form>', ["A"]),
        ('<form id="aspnetForm"><nav>n</nav><div>A</div></form>', ["A"]),
        ('<div class="sidebar">s<div itemprop="articleBody">A</div></div>', ["A"]),
        ('<div class="search"><div role="main">A</div></div>', ["A"]),
        ('<article>A<div class="comments"><article>c</article></div></article><div class="related"><article>r</article></div>', ["A"]),
        ('<div class="comments"><article>A</article></div>', ["A"]),
        ('<div class="comments-area">c</div><div id="sidebar-2">s</div><div class="menu--open">m</div><form>f</form>A', ["A"]),
    ],
)
def test_wrappers_of_an_article_stay(html, expected):
    assert blocks(parse(html), frozenset()) == expected


@pytest.mark.parametrize("depth", [10, 299, 300, 301, 400, 20000])
def test_deep_elements_with_end_tags(depth):
    inside = lambda tag: f"<{tag}>" * depth + "{}" + f"</{tag}>" * depth
    page = "<div id=page><article>" + inside("div").format("text") + "<p>rest</p></article></div>after"
    assert blocks(parse(page), frozenset()) == ["text", "rest"]
    assert blocks(parse(inside("div").format("<p>a</p>b<aside>no</aside><nav>no</nav>") + "c"), frozenset()) == ["a", "b", "c"]
    assert blocks(parse(inside("b").format("a<br>b") + "</i>c"), frozenset()) == ["a bc"]
    assert len(page_features(parse(page))) == min(depth, 298) + 3  # the outer div, the article and its p
