"""The corpus operators against brute force, round trips and held-out labels, with nulls, ties, repeats and clashing columns."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tests.oracle import connect, same

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}


ODD = [(1, None, None, None, None), (2, "", "en", "", 0), (3, " \n\t", None, "a", 3), (4, "word", "en", None, 4), (4, "word", "en", None, 4), (None, "no id here at all, a long line", "en", "b", 3), (7, "long " * 30_000, "en", "b", 150_000)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


# -- 1 --


def test_myers_is_edit_distance():
    from typeloom.llm.decontaminate import myers

    def dp(p, t):
        row = [0] * (len(t) + 1)
        for i, a in enumerate(p, 1):
            new = [i]
            for j, b in enumerate(t, 1):
                new.append(min(row[j - 1] + (a != b), row[j] + 1, new[j - 1] + 1))
            row = new
        return min(row), row.index(min(row))

    rng = random.Random(1)
    for _ in range(300):
        p, t = ("".join(rng.choice("abc") for _ in range(rng.randint(lo, 14))) for lo in (1, 0))
        assert myers(p, t) == dp(p, t)


def test_decontaminate(spark, docs, odd, none, sf, texts):
    from typeloom.llm.decontaminate import find_items, normalise

    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    found = {(r["doc_id"], r["item_id"]) for r in find_items(docs, items).collect()}
    exact = {(d, i["item_id"]) for i in items.collect() for d, t in texts.items() if normalise(i["text"]) in normalise(t)}
    assert exact and exact <= found
    edited = spark.createDataFrame([(1, "xx THE Quick!! brown fux jumps over the lazy dog and runs away yy"), (2, "nothing here"), (3, None)], "doc_id long, text string")
    test = spark.createDataFrame([(9, "the quick brown fox jumps over the lazy dog and runs away"), (8, None), (7, "..")], "item_id long, text string")
    assert [(r["doc_id"], r["item_id"], r["distance"]) for r in find_items(edited, test).collect()] == [(1, 9, 1)]
    assert find_items(odd, test).count() == 0 and find_items(none, test).count() == 0 and find_items(odd, test.limit(0)).count() == 0


def test_edit_matches_by_brute_force(spark, monkeypatch):
    """Every item against every document by the plain edit-distance table, with one block of items and with many."""
    from typeloom.llm import decontaminate as d

    rng = random.Random(4)
    words = ["".join(rng.choice("abcdef") for _ in range(rng.randint(2, 7))) for _ in range(60)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(2, 12)))) for i in range(12)] + [(12, None), (13, ""), (3, "repeated id with a text of its own")]
    docs = []
    for i in range(40):
        body = [rng.choice(words) for _ in range(30)]
        if i % 2:
            t = list(rng.choice(items[:12])[1])
            for _ in range(rng.randint(0, 6)):
                at = rng.randrange(len(t))
                t[at : at + rng.randint(0, 1)] = rng.choice(["", "x", "yz"])
            body[10:10] = ["".join(t)]
        docs.append((i, " ".join(body)))

    def least(p, t):
        row = [0] * (len(t) + 1)
        for i, a in enumerate(p, 1):
            new = [i]
            for j, b in enumerate(t, 1):
                new.append(min(row[j - 1] + (a != b), row[j] + 1, new[j - 1] + 1))
            row = new
        return min(row)

    want = {}
    for i, text in docs:
        for item, t in items:
            p = d.normalise(t)
            if p and (n := least(p, d.normalise(text))) <= int(d.MAX_ERROR * len(p)):
                want.setdefault((i, item), []).append(n)
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for chars in (d.BLOCK_CHARS, 100):
        monkeypatch.setattr(d, "BLOCK_CHARS", chars)
        got = {}
        for r in d.find_items(*frames).collect():
            got.setdefault((r["doc_id"], r["item_id"]), []).append(r["distance"])
        assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
        assert {r["doc_id"] for r in d.drop_leaks(*frames).collect()} == {i for i, _ in docs} - {i for i, _ in want}


# -- 2 --


def test_html(spark):
    from typeloom.llm.html_extract import extract, main_text

    page = '<html><head><title>x</title><script>var a="</p>";</script></head><body><header>Top</header><nav><a href="/">Home</a></nav><div class="ad">Buy</div><article><h1>T &amp; t</h1><p>One  long\nparagraph of text here.<br><p>Two <b>bold<p>Three</article><div id="comments"><p>Nice post, I liked it very much indeed.</p></div><footer>&copy; me</footer></body></html>'
    assert main_text(page) == "T & t\nOne long paragraph of text here.\nTwo bold\nThree"
    assert [main_text(x) for x in (None, "", "<p>", "just text", "<div>a<div>b", "<!-- never closed", "<script>x")] == ["", "", "", "just text", "a\nb", "", ""]
    df = spark.createDataFrame([(1, None, None, "x"), (1, "u", page, "y"), (2, "u", "<p>" + "w " * 200_000, "z")], "page_id long, url string, html string, text string")
    assert [(r["page_id"], r["n_chars"]) for r in extract(df).collect()] == [(1, 0), (1, len(main_text(page))), (2, 399_999)]
    assert extract(df.limit(0)).count() == 0


def test_html_names_and_malformed_pages():
    import time

    from typeloom.llm.html_extract import main_text

    def page(inner, after=""):
        return f'<body><nav><a href="/">Home</a></nav><article>{inner}</article>{after}<footer>f</footer></body>'

    assert main_text(page('<h1 class="post-header">Title</h1><p>The text.</p>')) == "Title\nThe text."
    assert main_text(page('<div class="content legal"><p>Text of a law.</p></div>')) == "Text of a law."
    assert main_text(page('<p class="notice-of-motion">The motion.</p><p>Other.</p>')) == "The motion.\nOther."
    assert main_text(page('<h1>T</h1><p>Body text</p><div class="ad">Buy</div><div class="share-buttons">share</div>', '<section class="reader-comments"><p>nice post, so much more text than the article has</p></section>')) == "T\nBody text"
    assert main_text('<body><div class="notice"><h1>A page</h1><p>whose only text is in a notice.</p></div></body>') == "A page\nwhose only text is in a notice."
    assert main_text('<body><div id="x"><p>First paragraph, with some length.</p><p>Second one, with some length.</p></div><ul><li><a href="a">link</a></li><li><a href="b">more</a></li></ul></body>') == "First paragraph, with some length.\nSecond one, with some length."
    bad = ["<p>x " + '<a title="' * 50_000, "<b>" * 100_000 + "<hr>" * 100_000, "<div>" * 100_000 + "x", "<" * 1_000_000, "<!x" * 300_000, "<div class=ad>" * 30_000 + "x", "<script>" + "</script" * 100_000, "<ul><li>" * 50_000, "<b>" * 100_000 + "</i>" * 100_000]
    for text in bad:
        begin = time.process_time()
        main_text(text)
        assert time.process_time() - begin < 15  # a quadratic scan of these takes minutes


def _prose(n, word):
    return " ".join(f"{word}{i} stands in a sentence that goes on for a while," for i in range(n))


_ARTICLE = f"<h1>Title here</h1><p>{_prose(8, 'first')}</p><p>{_prose(7, 'more')}</p><p>Short one.</p><p>{_prose(9, 'last')}</p>"
_LINES = ["Title here", _prose(8, "first"), _prose(7, "more"), "Short one.", _prose(9, "last")]
_READERS = '<div id="comments">' + "".join(f'<div class="comment"><p>I think that {_prose(4, "reader")}</p></div>' for _ in range(30)) + "</div>"
_TEMPLATES = {
    "one form around the page": (f'<form id="aspnetForm"><nav><a href=x>Home</a></nav><div class="x"><div class="y">{_ARTICLE}</div></div><input name=q><footer>f</footer></form>', []),
    "a layout class on the page": (f'<div class="page sidebar-right">{_ARTICLE}</div><div class="box"><p>Some unrelated box, brief.</p></div>', []),
    "prose with such names in an article": (f'<article>{_ARTICLE}<section class="social"><p>{_prose(6, "social")}</p></section><p class="comment">{_prose(6, "note")}</p></article>', [_prose(6, "social"), _prose(6, "note")]),
    "comments longer than the article": (f'<div class="wrap"><div class="inner">{_ARTICLE}</div>{_READERS}</div>', []),
    "comments in the article": (f"<article>{_ARTICLE}{_READERS}</article>", []),
    "a share bar": (f'<article>{_ARTICLE}<div class="share"><a href=1>Send</a><a href=2>Like</a></div></article>', []),
    "a form in the article": (f"<article>{_ARTICLE}<form><p>Subscribe to our letters now</p><input><button>Go</button></form></article>", []),
    "a sidebar of prose": (f'<main><div class="c">{_ARTICLE}</div><div class="sidebar"><p>{_prose(3, "side")}</p></div></main>', []),
    "an advert before": (f'<nav><a href=x>Home</a></nav><div class="ad">Buy this now.</div><div id="main">{_ARTICLE}</div><div class="footer">(c) me</div>', []),
    "a layout table": (f"<table><tr><td><a href=1>a</a><a href=2>b</a></td><td>{_ARTICLE}</td></tr></table>", []),
    "a notice of cookies": (f'<div class="cookie-notice"><p>We use cookies to make this better and ask for your consent here.</p></div><div>{_ARTICLE}</div>', []),
    "a name that says what there is": (f'<div class="has-sidebar"><div>{_ARTICLE}</div></div>', []),
    "nested divisions": (f"<div><div><div>{_ARTICLE}</div><div><a href=1>x y z</a> <a href=2>more links</a></div></div></div>", []),
    "roles": (f'<div role="banner">Site name</div><div role="main">{_ARTICLE}</div><div role="contentinfo">Contact us</div>', []),
}


@pytest.mark.parametrize("name", _TEMPLATES)
def test_html_templates(name):
    from typeloom.llm.html_extract import main_text

    body, more = _TEMPLATES[name]
    assert main_text(f"<html><head><title>t</title></head><body>{body}</body></html>").split("\n") == _LINES + more


def test_pages_by_plain_extraction(spark, sf):
    """Whole op2 against the article cut out with regular expressions, which the test pages' one template allows."""
    import html
    import re

    from typeloom.llm.html_extract import op2_html_extract

    def plain(page):
        found = re.search(r"<article>(.*?)</article>", page or "", re.S)
        blocks = re.split(r"</?(?:p|h1)>", found[1]) if found else []
        lines = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", b.replace("<br>", " "))).split()) for b in blocks]
        return "\n".join(x for x in lines if x)

    want = {r["page_id"]: (r["url"], plain(r["html"])) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = op2_html_extract(spark, sf).collect()
    assert len(rows) == len(want) and all((r["url"], r["text"]) == want[r["page_id"]] and r["n_chars"] == len(r["text"]) for r in rows)


# -- 3 --


def test_media(spark, odd, none):
    from typeloom.llm import media as m

    made = odd.select("doc_id", "text", m.payload(F.col("text")).alias("p")).select("doc_id", "text", "p", m.write_pgm(F.col("p")).alias("media")).collect()
    for r in made:
        raw = (r["text"] or "").encode()
        want = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        assert bytes(r["p"]) == want == m.read_pgm(bytes(r["media"]))
        assert m.features_of(bytes(r["media"]))[:3] == (len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-64:]))
    with pytest.raises(ValueError):
        m.read_pgm(b"P5\n64 2\n255\n" + bytes(64))
    page = spark.createDataFrame([(1, 'A<p>b &lt; c</p><figure><img src="media:d1"><figcaption>cap <i>x</i></figcaption></figure>tail<img src="media:gone">'), (2, None)], "doc_id long, html string")
    stored = spark.createDataFrame([("d1", 7)], "digest string, size long")
    got = m.resolve(m.sequences(page), stored).orderBy("position").collect()
    assert [(r["kind"], r["text"], r["digest"], r["caption"], r["size"]) for r in got] == [("text", "A", None, None, None), ("text", "b < c", None, None, None), ("media", None, "d1", "cap x", 7), ("text", "tail", None, None, None), ("media", None, "gone", None, None)]


def test_media_query(spark, sf, texts):
    from typeloom.llm.media import op3_media

    rows = op3_media(spark, sf).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        raw = (texts[r["doc_id"]] or "").encode()
        data = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        stored = b"P5\n64 %d\n255\n" % (len(data) // 64) + data
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())
        means = [sum(data[i * len(data) // 64 : (i + 1) * len(data) // 64]) * 64 / len(data) for i in range(64)]
        mean, bits = sum(data) / len(data), "".join("1" if x > sum(means) / 64 else "0" for x in means)
        first, _, last = r["feature"].split(":")
        assert abs(float(first) - mean) < 1e-3 and bin(int(last, 16) ^ int(bits, 2)).count("1") <= 1
        lines = [" ".join(x.split()) for x in (texts[r["doc_id"]] or "").split("\n")]
        assert r["n_texts"] == sum(bool(x) for x in lines) and r["position"] == int(bool(lines[0])) and r["tail_position"] == r["n_texts"] + 1


def test_media_repeats(spark, tmp_path):
    """Null ids, nulls, repeated rows and markup in texts."""
    from typeloom.llm.media import op3_media

    rows = [(None, "a <b> & c\n\nd"), (1, None), (1, None), (2, "x" * 64), (3, "x" * 64), (4, "y\x00")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    out = op3_media(spark, str(tmp_path)).collect()
    key = lambda x: str(x)
    assert sorted((r["doc_id"], r["n_bytes"], r["n_texts"]) for r in out if r["doc_id"]) == [(1, 0, 0), (1, 0, 0), (2, 64, 1), (3, 64, 1), (4, 2, 1)]
    assert sorted([(r["doc_id"], r["payload_bytes"]) for r in out], key=key) == sorted([(i, max(64, -(-len((t or "").encode()) // 64) * 64)) for i, t in rows], key=key)


# -- 4 --


def test_urls(spark, sf):
    from typeloom.llm.url_filter import RULES, judge, op4_url_filter

    def brute(url):
        if not url or "://" not in url:
            return "", "", None
        rest = url.split("://", 1)[1]
        cut = min([rest.find(ch) for ch in "/?#" if ch in rest], default=len(rest))
        host = "".join(ch.lower() if "A" <= ch <= "Z" else ch for ch in rest[:cut])
        path = rest[cut:]
        path = path[: min([path.find(ch) for ch in "?#" if ch in path], default=len(path))]
        fits = [(h + p) for _, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return host, path, max(fits, key=len, default=None)

    verdicts = {h + p: v for v, h, p in RULES}
    urls = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = op4_url_filter(spark, sf).collect()
    assert len(rows) == len(urls)
    for r in rows:
        assert (r["host"], r["path"], r["rule"]) == brute(urls[r["page_id"]])
        assert r["verdict"] == verdicts.get(r["rule"], r["verdict"]) and r["verdict"] in ("allow", "block")
    edge = [None, "", "nourl", "http://WWW.Example.COM/en/x?y", "http://example.com", "https://a.net/es/", "http://xcom/", "x://", "http://a.org/?q=://b.com/"]
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(edge)] * 2, "page_id long, url string, host string")
    for r in judge(df).collect():
        assert (r["host"], r["path"], r["rule"]) == brute(edge[r["page_id"]])
    assert judge(df.limit(0)).count() == 0


def test_mined_rules_match_by_brute_force(spark):
    from typeloom.llm.url_filter import match

    rng = random.Random(3)
    rules = [(i, sorted(rng.sample("abcdef", rng.randint(1, 3))), rng.choice(["allow", "block"]), rng.random(), rng.random()) for i in range(12)]
    sets = [(sorted(rng.sample("abcdef", rng.randint(0, 5)))) for _ in range(40)]
    got = {r["key"]: (r["verdict"], r["confidence"]) for r in match(spark.createDataFrame([(i, s) for i, s in enumerate(sets)], "key long, items array<string>"), spark.createDataFrame(rules, "rule_id long, items array<string>, verdict string, confidence double, support double")).collect()}
    for i, s in enumerate(sets):
        fit = [r for r in rules if set(r[1]) <= set(s)]
        assert got.get(i) == (max(((r[3], r[2]) for r in fit))[::-1] if fit else None)


def test_mined_rules_hold_on_hosts_kept_back(spark):
    """Confirmation by brute force; and that a token of one labelled site judges no other page, while one that many sites share does."""
    from typeloom.llm.url_filter import confirmed, judge

    rng = random.Random(8)
    rules = [(i, sorted(rng.sample("abcd", rng.randint(1, 2))), rng.choice(["allow", "block"]), 1.0, 0.1) for i in range(8)]
    held = [(f"h{rng.randrange(4)}", sorted(rng.sample("abcd", rng.randint(0, 4))), rng.choice(["allow", "block", "block"])) for _ in range(80)]
    got = {r["rule_id"]: (r["held_rows"], r["precision"]) for r in confirmed(spark.createDataFrame(rules, "rule_id long, items array<string>, verdict string, confidence double, support double"), spark.createDataFrame(held, "host string, items array<string>, verdict string"), 0.6, 10, 3).collect()}
    want = {}
    for i, items, v, *_ in rules:
        hit = [(h, y) for h, x, y in held if set(items) <= set(x)]
        if len(hit) >= 10 and len({h for h, _ in hit}) >= 3 and sum(y == v for _, y in hit) / len(hit) >= 0.6:
            want[i] = (len(hit), sum(y == v for _, y in hit) / len(hit))
    assert got == want and got
    urls = [f"http://site{i}.net/es/casino/{n}" for i in range(40) for n in range(5)] + [f"http://s{i}.com/a/news/{n}" for i in range(40) for n in range(5)]
    urls += [f"http://lonely-{w}.net/fr/{n}" for w in ("one", "two") for n in range(40)]
    asked = ["http://x.org/casino/", "http://x.org/news/", "http://lonely-one.org/q/"]
    out = {r["page_id"]: (r["verdict"], r["matched"]) for r in judge(spark.createDataFrame(list(enumerate(asked + urls)), "page_id long, url string")).where("page_id < 3").collect()}
    assert out == {0: ("block", ["p=casino"]), 1: ("allow", ["p=news"]), 2: ("allow", None)}


def test_mining_by_brute_force(spark):
    """Supports, confidences and pruning of mined rules against all subsets of all token sets."""
    from itertools import combinations

    from typeloom.llm.url_filter import mine

    rng = random.Random(9)
    rows = [(sorted({t for t in "abcde" if rng.random() < 0.5}), "block") for _ in range(60)]
    rows = [(items, "block" if {"a", "b"} <= set(items) or rng.random() < 0.1 else "allow") for items, _ in rows]
    support, confidence, lift = 0.05, 0.7, 1.05
    count = lambda items, v=None: sum(set(items) <= set(x) and v in (None, y) for x, y in rows)
    found = {}
    for k in range(1, 6):
        for items in combinations("abcde", k):
            for v in ("allow", "block"):
                n = count(items, v)
                if n >= support * len(rows) and n / count(items) >= confidence and n / count(items) / (count((), v) / len(rows)) >= lift:
                    found[items, v] = (n / count(items), n / len(rows))
    kept = {(i, v): c for (i, v), c in found.items() if not any(v == w and set(j) < set(i) and found[j, w][0] >= c[0] for j, w in found)}
    got = {(tuple(r["items"]), r["verdict"]): (r["confidence"], r["support"]) for r in mine(spark.createDataFrame(rows, "items array<string>, verdict string"), support, confidence, lift).collect()}
    assert kept and set(got) == set(kept) and all(abs(got[k][0] - kept[k][0]) < 1e-9 and abs(got[k][1] - kept[k][1]) < 1e-9 for k in kept)


# -- 5 --


def brute_targets(sizes, weights=(5, 2, 1), cap=3):
    names = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        left = total - sum(fixed.values())
        over = [s for s in free if left * w[s] / max(1, sum(w[x] for x in free)) > cap * sizes[s]]
        if not over:
            return fixed | {s: left * w[s] / max(1, sum(w[x] for x in free)) for s in free}
        fixed |= {s: float(cap * sizes[s]) for s in over}


def test_mixing(spark, docs, odd, none):
    from typeloom.llm.mixing import mix

    for frame in (docs, odd):
        rows = mix(frame).collect()
        again = mix(frame.repartition(3)).collect()
        assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, again), key=str)
        source = {r["doc_id"]: r["source"] for r in frame.collect()}
        sizes, taken = {}, {}
        for r in frame.collect():
            sizes[r["source"]] = sizes.get(r["source"], 0) + len((r["text"] or "").encode().split())
        want = brute_targets(sizes)
        for r in rows:
            assert 0 <= r["taken"] <= 3 * r["size"] and r["source_size"] == sizes[source[r["doc_id"]]]
            assert abs(r["target"] - want[source[r["doc_id"]]]) < 1e-6
            taken[source[r["doc_id"]]] = taken.get(source[r["doc_id"]], 0) + r["taken"]
        assert len(rows) == frame.count() and all(abs(taken[s] - want[s]) <= 0.1 * want[s] + 64 for s in taken)
    other = sorted(map(tuple, mix(docs, seed=99).collect()))
    assert other != sorted(map(tuple, mix(docs).collect()))  # the draw reaches the result
    assert mix(none).count() == 0


def test_mixing_repeated_rows(spark):
    from typeloom.llm.mixing import mix

    rows = [(1, "w " * 100, "a")] * 300 + [(i, "v " * 50, None) for i in range(100)] + [(5, None, "c")]
    out = mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert len(out) == 401 and sum(r["size"] == 100 for r in out) == 300 and all(0 <= r["taken"] <= 3 * r["size"] for r in out)
    assert abs(sum(r["taken"] for r in out) - 35_000) < 500


def test_slots_are_permutations(spark):
    from typeloom.llm.mixing import permuted, slots, targets

    for n in (1, 2, 7, 64, 1000):
        assert sorted(r[0] for r in spark.range(n).select(permuted(F.col("id"), F.lit(n).cast("long"), F.lit(3))).collect()) == list(range(n))
    sizes = spark.createDataFrame([("a", 100_000), ("b", 7000), ("c", 500_000), (None, 3)], "source string, size long")
    per = targets(sizes)
    want = {r["sid"]: (r["target"], -(-r["source_size"] // 64), r["source_size"]) for r in per.collect()}
    made = {}
    for seed in (1, 2):
        rows = slots(per, block_words=64, seed=seed).collect()
        by, shards = {}, {}
        for r in rows:
            by.setdefault(r["sid"], []).append((r["slot"], r["block"]))
            shards[r["shard"]] = shards.get(r["shard"], 0) + 1
        for sid, got in by.items():
            got.sort()
            t, b, size = want[sid]
            assert [i for i, _ in got] == list(range(len(got))) and abs(len(got) - t * b / size) <= 0.05 * t * b / size + 2
            for e in range(0, len(got), b):  # each whole pass takes every block once
                blocks = [x for _, x in got[e : e + b]]
                assert len(set(blocks)) == len(blocks) and (len(blocks) < b or set(blocks) == set(range(b)))
            uses = [sum(x == k for _, x in got) for k in range(b)]
            assert max(uses) <= 3
        assert all(n <= 1024 for n in shards.values())
        made[seed] = {s: len(x) for s, x in by.items()}
    assert made[1] != made[2]


# -- 6 --


def test_line_dedup(spark, sf, odd, none):
    from typeloom.llm.line_dedup import SQL, line_dedup, op6_line_dedup

    same(op6_line_dedup(spark, sf).toPandas(), connect(sf).sql(SQL).df())
    df = spark.createDataFrame([(2, "A shared line here\nown\n\nA shared line here", "x"), (5, "  a SHARED line HERE \nÉ shared lInes\nshort", "y"), (5, "short\nother text of the same id", "z"), (None, "a shared line here", "n"), (9, None, "e")], "doc_id long, text string, n_lines string")
    out = {(r["doc_id"], r["text"]): (r["n_lines"], r["n_dropped"]) for r in line_dedup(df).collect()}
    assert out == {(2, "A shared line here\nown\n\nA shared line here"): (4, 0), (5, "É shared lInes\nshort"): (3, 1), (5, "short\nother text of the same id"): (2, 0), (None, "a shared line here"): (1, 0), (9, ""): (1, 0)}
    three = spark.createDataFrame([(i, "one shared line") for i in (1, 2, 3)] + [(1, "twice shared line"), (2, "twice shared line")], "doc_id long, text string")
    assert sorted(r["text"] for r in line_dedup(three, min_docs=3).collect()) == ["", "", "one shared line", "twice shared line", "twice shared line"]
    assert line_dedup(odd).count() == len(ODD) and line_dedup(none).count() == 0


# -- 7 --


def brute_components(texts):
    sets, parent = {}, {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[i], parent[i] = ({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()), i

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


def near_texts(n=60, seed=5):
    """Chains and groups of near copies around the threshold, exact copies, short and empty texts."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    bases = [[rng.choice(words) for _ in range(rng.randint(40, 160))] for _ in range(6)]
    out = {100: None, 101: "", 102: "one two", 103: "ONE  two", 104: "one two three"}
    for i in range(n):
        t = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            t[rng.randrange(len(t))] = rng.choice(words)
        if rng.random() < 0.3:
            t = t[: -rng.randint(1, 12)]
        out[i] = " ".join(t)
    return out


@pytest.mark.parametrize("chunk", [3, 256])
def test_jaccard_components_match_brute_force(spark, monkeypatch, chunk):
    from typeloom.llm import jaccard_join as j

    monkeypatch.setattr(j, "CHUNK", chunk)
    texts = near_texts()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in j.jaccard_components(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)).collect()}
    assert got == brute_components(texts)


def test_jaccard_edges(spark, odd, none):
    from typeloom.llm.jaccard_join import drop_near_copies, jaccard_components

    rows = jaccard_components(odd).collect()
    assert len(rows) == len(ODD) and all(r["component_id"] == r["doc_id"] for r in rows)
    assert jaccard_components(none).count() == 0
    kept = drop_near_copies(odd)
    assert kept.columns == odd.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "2", "3", "4", "7", "None"]


def test_jaccard_null_id_hides_no_set(spark):
    from typeloom.llm.jaccard_join import jaccard_components

    words = [f"w{i}" for i in range(60)]
    near = " ".join([*words[:-1], "other"])
    rows = [(None, " ".join(words)), (5, " ".join(words)), (3, near)]
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {None: None, 5: 3, 3: 3}


def test_near_copies_go_by_text_not_by_id(spark):
    from typeloom.llm.jaccard_join import drop_near_copies

    text = lambda name: " ".join(f"{name}{i}" for i in range(60))
    near = lambda name, end: f"{text(name)} {end}"
    rows = [(3, text("t"))] + [r for i in range(10, 18) for r in ((i, text(f"c{i}x")), (i, near("t", f"end{i}")))]
    kept = [rows[0], *rows[1::2]]
    other = [(50, text("p")), (50, text("q")), (60, text("r")), (None, text("t")), (80, None), (80, text("u"))]  # other texts of one id stay
    copies = [(60, text("r")), (70, text("q"))]
    got = drop_near_copies(spark.createDataFrame(rows + other + copies, "doc_id long, text string")).collect()
    assert sorted(map(str, got)) == sorted(str(r) for r in spark.createDataFrame(kept + other, "doc_id long, text string").collect())
    versions = drop_near_copies(spark.createDataFrame([(90, text("v")), (90, near("v", "end"))], "doc_id long, text string")).collect()
    assert len(versions) == 1  # near copies of each other under one id


def test_components(spark):
    from typeloom.llm.components import components

    rng = random.Random(2)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 120)] + [(5, 5), (None, 3)]
    parent = {x: x for e in edges for x in e if None not in e}

    def root(x):
        return x if parent[x] == x else root(parent[x])

    for a, b in edges:
        if a is not None:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    assert {r["node"]: r["comp"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()} == {x: root(x) for x in parent}


# -- 8 --


def test_grammar():
    """Each mark alone, and that plain insults count for nothing however many there are."""
    from typeloom.llm.toxicity import MARKS, Scorer

    s = Scorer({"idiot": 3.0, "fool": 1.0, "wort*": 2.0})
    e = 2.718281828459045
    marks = lambda t: {m: n for m, v in zip(MARKS, s.features(t), strict=False) if (n := round(e**v - 1))}
    weights = lambda t: [round(e**v - 1) for v in s.features(t)[len(MARKS) :]]
    plain = "some idiot spoke. one fool more. see wortig here"
    assert marks(plain) == {} and s.features(plain) == s.features("word") == s.features(None)
    assert marks("you see some idiot there") == {"A": 1} and marks("some idiot sees you there") == {"A": 1}
    assert marks("idiot, go") == marks("go now idiot") == marks("well, idiot, go") == marks("idiot") == {"V": 1}
    assert marks("he is some idiot there") == {"B": 1} and marks("he is by all means some idiot there") == {"A": 1}
    assert marks("see that idiot there") == {"M": 1} and marks("see that. old idiot there") == {}
    assert marks("big idiot old fool ran") == {"S": 1} and weights("big idiot old fool ran") == [4, 0, 0]
    assert marks("this is not an idiot") == {"n": 1} and weights("this is not an idiot") == [0, 3, 0]
    assert marks("it said the idiot ran") == {"q": 1} and weights("it said the idiot ran") == [0, 0, 3]
    assert marks("i will kill you") == {"X": 1} and marks("kill the process") == {}
    assert marks("wortig, go. worter go") == {"V": 2} and weights("wortig, go. some fool spoke") == [2, 0, 0]
    assert marks("the idiot is that fool there. you fool go") == {"M": 1, "B": 1, "A": 1}


def test_toxicity_on_held_out_labels(spark):
    """The held-out third of a larger table: ranking and the threshold's errors."""
    from typeloom.llm.toxicity import op8_toxicity

    d = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{d}/labels.parquet").collect() if r["toxic"] is not None}
    rows = [(r["score"], labels[r["doc_id"]], r["predicted"]) for r in op8_toxicity(spark, d).collect() if r["held_out"] and r["doc_id"] in labels]
    good, bad = [s for s, y, _ in rows if not y], [s for s, y, _ in rows if y]
    auc = sum((b > g) + (b == g) / 2 for b in bad for g in good) / (len(good) * len(bad))
    assert auc >= 0.85 and sum(p for _, y, p in rows if not y) <= 0.03 * len(good) and sum(p for _, y, p in rows if y) >= 0.6 * len(bad)


def test_toxicity(spark, sf, docs, odd, none):
    from typeloom.llm.toxicity import drop_toxic, op8_toxicity, score

    rows = op8_toxicity(spark, sf).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows)
    many = [(i, f"plain words here number {i % 7}. and {'you idiot' if i % 4 == 0 else 'some more'} there", int(i % 4 == 0)) for i in range(200)]
    train = spark.createDataFrame([(i, t) for i, t, _ in many], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in many] + [(None, 1), (1, None)], "doc_id long, toxic int")
    got = {r["doc_id"]: r["score"] for r in score(train, train, labels).collect()}
    assert all((got[i] >= 0.7) == bool(y) for i, _, y in many)
    assert len(score(odd, train, labels).collect()) == len(ODD) and score(none, train, labels).count() == 0
    assert all(r["score"] == 0 for r in score(odd, train, labels.limit(0)).collect())
    kept = drop_toxic(train.withColumn("score", F.lit("clash")), labels)
    assert kept.columns == ["doc_id", "text", "score"] and kept.count() == 150


# -- 9 --


def test_languages(spark, sf, docs, odd, none):
    from typeloom.llm.lang_id import identify, op9_lang_id

    lang = {r["doc_id"]: r["lang"] for r in docs.collect()}
    rows = op9_lang_id(spark, sf).collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == len(lang) and held and sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.95 * len(held)
    out = identify(odd.select("doc_id", "text"), docs.select("doc_id", "lang", "text")).collect()
    assert len(out) == len(ODD) and all(0 <= r["score"] <= 1 for r in out)
    assert all((r["lang_pred"] == "und") == (r["doc_id"] in (1, 2, 3)) for r in out)
    assert identify(none, docs.limit(0)).count() == 0
    assert {r["lang_pred"] for r in identify(odd, docs.limit(0).select("doc_id", "lang", "text")).collect()} == {"und"}


def test_foreign_texts_are_rejected(spark, docs):
    from typeloom.llm.lang_id import identify

    train = docs.select("doc_id", "lang", "text")
    foreign = spark.createDataFrame([(1, "zxq vvk qqj wxz " * 40), (2, "\u043f\u0440\u0438\u0432\u0435\u0442 \u043c\u0438\u0440 " * 40)], "doc_id long, text string")
    assert all(r["rejected"] for r in identify(foreign, train).collect())
    own = identify(docs.where("length(text) > 200").select("doc_id", "text"), train).collect()
    assert sum(r["rejected"] for r in own) <= 0.1 * len(own)


def test_models_count_all_rows_and_bounds_come_from_a_whole_fold(spark, monkeypatch):
    """A language whose only row lies in the fold is learned; all rows of the fold are scored for the bounds, by models without them."""
    from typeloom.llm import lang_id as li

    ids = spark.range(200).select("id", ((F.pmod(F.xxhash64("id"), F.lit(li.FOLDS)) == 0)).alias("fold")).collect()
    inside, outside = [r["id"] for r in ids if r["fold"]], [r["id"] for r in ids if not r["fold"]]
    rows = [(i, "aa", "some words of the first tongue") for i in (*inside[1:], *outside)] + [(inside[0], "zz", "zvox qvarn zvix qvol")]
    seen, real = [], li._scored
    monkeypatch.setattr(li, "_scored", lambda r, rounds: seen.append((r.count(), {m[0] for x in rounds for m in x.value})) or real(r, rounds))
    out = li.identify(spark.createDataFrame([(1, "zvox qvarn zvix")], "doc_id long, text string"), spark.createDataFrame(rows, "doc_id long, lang string, text string"))
    assert out.first()["lang_pred"] == "zz" and seen == [(len(inside), {"aa"}), (1, {"aa", "zz"})]


@pytest.mark.parametrize("size", [1, 3, 50])
def test_slices_change_nothing(spark, monkeypatch, size):
    """Grams across the borders of slices are counted and scored once, whatever the slices' size."""
    from typeloom.llm import lang_id as li

    rng = random.Random(size)
    rows = [(i, rng.choice("xy"), "".join(rng.choice("abcé .\n1") for _ in range(rng.randrange(150)))) for i in range(60)] + [(90, "x", ""), (91, "y", " . "), (92, "x", "a"), (93, None, "bc")]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    counted = lambda: {(r["lang"], r["gram"]): r["n"] for r in li.count_grams(docs).collect()}
    told = lambda: {r["doc_id"]: (r["lang_pred"], round(r["score"], 9), round(r["cross_entropy"], 9)) for r in li.identify(docs, docs).collect()}
    whole, answers = counted(), told()
    monkeypatch.setattr(li, "SLICE", size)
    assert counted() == whole and told() == answers


def test_kneser_ney_by_brute_force(spark, monkeypatch):
    """Probabilities of every character after every context against a direct recursion over dictionaries."""
    import numpy as np

    from typeloom.llm import lang_id as m

    texts = ["abracadabra cadabra abra bar car", "a bard barred a car", "caba"]
    counts = {}
    for t in texts:
        padded = " " + t + " "
        for i in range(len(padded) - 3):
            counts[padded[i : i + 4]] = counts.get(padded[i : i + 4], 0) + 1
    c = {4: counts}
    for k in (3, 2, 1):
        c[k] = {}
        for g in c[k + 1]:
            c[k][g[1:]] = c[k].get(g[1:], 0) + 1

    def prob(gram):
        k, ctx = len(gram), gram[:-1]
        if k == 0:
            return 1 / (len(c[1]) + 50)
        rows = {g: n for g, n in c[k].items() if g[:-1] == ctx}
        if not rows:
            return prob(gram[1:])
        total = sum(rows.values())
        return (max(rows.get(gram, 0) - 0.75, 0) + 0.75 * len(rows) * prob(gram[1:])) / total

    df = spark.createDataFrame([("xx", t) for t in texts] + [("yy", "other words of another tongue")], "lang string, text string")
    ((_, tables), _), = m.train(df)

    def scored(gram):
        chars = [np.array([ord(x)], np.uint64) for x in gram]
        logp = tables[(0, "b")] - np.log(len(c[1]) + 50.0)
        for k in range(1, 5):
            v, there = m._look(tables.get((k, "p")), m._hash(chars[4 - k :]))
            if k > 1:
                b, known = m._look(tables.get((k - 1, "b")), m._hash(chars[4 - k : 3]))
                logp = logp + (b[0] if known[0] else 0.0)
            logp = v[0] if there[0] else logp
        return np.exp(logp)

    seen = sorted(c[1])
    for context in ("abr", "a b", "zab", "zzz"):
        for ch in seen:
            assert abs(scored(context + ch) - prob(context + ch)) < 1e-9
        assert sum(prob(context + ch) for ch in seen) <= 1
    monkeypatch.setattr(m, "ROUND_GRAMS", 1)  # a round a language, same answers
    rounds = m.train(df)
    assert [[x[0] for x in r] for r in rounds] == [["xx"], ["yy"]]
    ask = spark.createDataFrame([(1, "abra car"), (2, "another tongue"), (3, None)], "key long, text string")
    many = {r["key"]: r for r in m._scored(ask, [spark.sparkContext.broadcast(r) for r in rounds]).collect()}
    one = {r["key"]: r for r in m._scored(ask, [spark.sparkContext.broadcast([x for r in rounds for x in r])]).collect()}
    assert {k: r["lang_pred"] for k, r in many.items()} == {1: "xx", 2: "yy", 3: "und"}
    assert all(abs(many[k]["score"] - one[k]["score"]) < 1e-9 and many[k]["lang_pred"] == one[k]["lang_pred"] for k in one)


# -- 10 --


def test_chats(spark, sf):
    from typeloom.llm.chat_format import SQL, format_chats, op10_chat_format, parse_chats, under_mask

    same(op10_chat_format(spark, sf).toPandas(), connect(sf).sql(SQL).df())
    turns = [(1, 0, "user", "a <s>[INST] <\\s> <<\\\\/s>[NEXT]x"), (1, 1, "user", ""), (1, 2, "assistant", "</s>[/INST]"), (1, 2, "assistant", None), (1, None, "[INST]</s>", "odd role"), (None, 1, None, "no conversation"), (2, 1, "assistant", "w" * 200_000)]
    df = spark.createDataFrame(turns * 2, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    parsed = parse_chats(format_chats(df))
    out = parsed.withColumn("loss", under_mask(F.col("turns"), F.col("loss_mask"))).collect()
    want = {}
    for c, t, r, x in turns * 2:
        want.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    assert {r["conv_id"]: [(t["role"], t["text"]) for t in r["turns"]] for r in out} == {c: [v[2:] for v in sorted(w)] for c, w in want.items()}
    for r in out:
        assert len(r["turns"]) == len(r["loss_mask"])
        assert r["loss"] == "".join(t["text"] for t in r["turns"] if t["role"] == "assistant")
        merged = [t["role"] for k, t in enumerate(r["turns"]) if k == 0 or t["role"] != r["turns"][k - 1]["role"]]
        assert r["formatted"].count("<s>[INST]") == r["formatted"].count("</s>") == len(merged)
    many = spark.range(30_000).select(F.lit(7).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 3 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"))
    (long,) = parse_chats(format_chats(many)).collect()
    assert [t["text"] for t in long["turns"]] == [f"t{i}" for i in range(30_000)] and long["formatted"].count("[NEXT]") == 10_000
    assert format_chats(df.limit(0)).count() == 0


# -- all --


def test_pipeline(spark, sf, docs):
    import corpus_pipeline as p
    from typeloom.llm.common import written
    from typeloom.llm.decontaminate import find_items
    from typeloom.llm.jaccard_join import jaccard_components

    at, names = docs.withColumn("marks", F.lit("clash")), [n for n, _ in p.STAGES]
    for name, stage in p.STAGES:
        before, at = at, written(stage(spark, at, sf), "test")
        if name != names[-1]:
            assert at.columns == before.columns
        ids = {r["doc_id"] for r in at.select("doc_id").collect()}
        if name == "line dedup":
            assert ids == {r["doc_id"] for r in before.collect()}
        if name == "n-gram Jaccard join":
            assert ids == {r["component_id"] for r in jaccard_components(before).collect()}
        if name == "benchmark decontamination":
            assert ids == {r["doc_id"] for r in before.collect()} - {r["doc_id"] for r in find_items(before, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
    assert at.columns == ["doc_id", "size", "source_size", "target", "taken"]


def test_registry():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert "pipeline" in names and {n.split("_")[0] for n in names if n.startswith("op")} >= {f"op{i}" for i in range(1, 11)}
