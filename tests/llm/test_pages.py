import gzip
import io

import pytest

from logweave.llm import html_extract, url_filter, warc
from logweave.llm.html_pages import labelled_pages
from logweave.session import scratch_path

PAGE = """<html><head><title>T</title><script>x='<p>'</script></head><body><header class=top><h1>Site</h1></header>
<nav><a href=x>A</a> <a href=y>B</a></nav><div class=cookie-notice>We use cookies.</div><main><article>
<h1>Title &amp; more</h1><p>First <b>bold</b>ed para,\n with   blanks.<p>Second paragraph &eacute;&#33; of it, long enough.
<div class=advert>Buy now!</div><ul><li>one item<li>two item</ul><form><label>Mail</label><input></form></article>
<aside class=sidebar><p>Related stories are here.</p></aside><section id=comments><h3>Comments</h3>
<div class=comment><p>I love this, thanks for writing it!</p></div></section></main><footer>(c) Someone</footer>"""


LONG = "<article><p>" + "x" * 3_000_000


@pytest.fixture(scope="module")
def pages(spark):
    rows = [
        (1, "http://A.example.com/en/x?y#z", PAGE, 1), (2, "https://www.example.com/en/", "", 1), (3, None, None, 1),
        (4, "no scheme", PAGE, 1), (5, "http://b.net/fr/1", "<p>tie" * 3, 1), (6, "http://b.net/fr/1", "<p>tie" * 3, 1),
        (6, "http://b.net/fr/1", "<p>tie" * 3, 1), (None, "http://c.org", PAGE, 1), (7, "http://d.net/es", LONG, 1),
        (8, "ftp://net/es/?q", "ü" * 60, 1), (9, "http://x.com\nHost: evil/%41", "ü" * 60, 1), (10, "http://notnet/es/", "ü" * 49, 1),
    ]
    return spark.createDataFrame(rows, "page_id long, url string, html string, rule int")


def test_extract(pages):
    found = {(r.page_id, r.url): r for r in html_extract.extract_pages(pages).collect()}
    text = "Title & more First bolded para, with blanks. Second paragraph é! of it, long enough. one item two item"
    assert found[1, "http://A.example.com/en/x?y#z"].text == text
    assert found[None, "http://c.org"].n_chars == len(text)
    assert found[3, None].text == "" and found[3, None].n_chars == 0
    assert len(found[7, "http://d.net/es"].text) == 3_000_000
    assert html_extract.extract_pages(pages.limit(0)).count() == 0


def test_messages_equal_enumeration():
    import itertools
    import math

    parent, own = [-1, 0, 0, 1, 1], [0.3, -1.0, 0.7, 2.0, -0.4]
    pair = [(0, 0, 0, 0), (0.5, -0.2, 0.1, 1.0), (0.0, 0.4, -1.0, 0.2), (1.0, 0.0, 0.0, 0.5), (0.2, 0.3, -0.3, 0.9)]
    weights = {}
    for states in itertools.product((0, 1), repeat=5):
        score = sum(o * s for o, s in zip(own, states))
        score += sum(pair[n][2 * states[parent[n]] + states[n]] for n in range(1, 5))
        weights[states] = math.exp(score)
    total = sum(weights.values())
    found, edges = html_extract.messages(parent, own, pair)
    for n in range(5):
        assert found[n] == pytest.approx(sum(w for s, w in weights.items() if s[n]) / total)
    for n in range(1, 5):
        for state in range(4):
            exact = sum(w for s, w in weights.items() if 2 * s[parent[n]] + s[n] == state) / total
            assert edges[n][state] == pytest.approx(exact)


def test_model_on_pages_it_has_not_seen():
    model, wrong, count = html_extract.trained(), 0, 0
    for html in labelled_pages(100, seed=77):
        tree = html_extract.Tree(html_extract.Page(html))
        kept, _ = model.marginals(tree)
        wrong += sum((k >= 0.5) != bool(m) for k, m in zip(kept, tree.marks))
        count += len(kept)
    assert wrong < 0.03 * count


def test_warc_round_trip(pages):
    found = {}
    for r in warc.round_trip(pages).collect():
        found.setdefault(r.page_id, []).append((r.payload_bytes, r.record_type, r.refers_to))
    assert found[1] == [(len(PAGE.encode()), "response", None)]
    assert found[4] == [(len(PAGE.encode()), "revisit", 1)] and found[None] == [(len(PAGE.encode()), "response", None)]
    assert found[3] == [(0, "response", None)] and found[7] == [(len(LONG), "response", None)]
    assert found[6] == [(18, "response", None)] * 2 and found[9] == [(120, "revisit", 8)]
    assert found[10] == [(98, "response", None)]
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_warc_chunks_and_urls(spark, pages):
    folder = scratch_path(spark, "warc-test")
    rows = warc.read_archives(warc.write_archives(pages, folder), folder).collect()
    parts = sorted((r.chunk, r.bytes) for r in rows if r.page_id == 7)
    assert len(parts) >= 3_000_000 // warc.CHUNK_BYTES and b"".join(p for _, p in parts) == LONG.encode()
    assert {r.url for r in rows if r.page_id == 9} == {"http://x.com\nHost: evil/%41"}
    assert max(len(r.bytes) for r in rows) <= warc.CHUNK_BYTES


def test_warc_digest_is_checked():
    out = io.BytesIO()
    warc.Writer(out).page(1, "http://a", memoryview(b"payload"), "0" * 64, None)
    with pytest.raises(ValueError):
        list(warc.read_chunks(io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(out.getvalue())))))


def plain_rule(url):
    if not url or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    at = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, rest = rest[:at], rest[at:]
    path = rest[: min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits, key=lambda f: len(f[0]), default=None)


def test_url_rules(spark, pages):
    none = spark.createDataFrame([], "tokens array<string>, label string, confidence double, support double, rule_id long, key string")
    found = sorted((str(r.page_id), r.host, r.path, str(r.rule), r.verdict) for r in url_filter.judge_urls(pages, none).collect())
    expected = []
    for r in pages.collect():
        host, path, rule = plain_rule(r.url)
        expected.append((str(r.page_id), host, path, str(rule and rule[0]), rule[1] if rule else "allow"))
    assert found == sorted(expected)


def test_mined_rules(spark):
    rows = [(n, f"http://{'casino' if n % 4 == 0 else 'news'}{n}-x.site.org/{'play' if n % 4 == 0 else 'read'}/{n}") for n in range(400)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(n, int(n % 4 != 0), 0) for n in range(200)], "doc_id long, quality int, toxic int")
    assert url_filter.labelled_urls(pages, labels).count() == 200
    labelled = url_filter.labelled_urls(pages, labels)
    mined = url_filter.mine_rules(labelled)
    rules = mined.collect()
    assert rules and all(r.confidence >= url_filter.CONFIDENCE and r.key in r.tokens for r in rules)
    # No pruned rule is covered by a shorter one of at least its confidence.
    for a in rules:
        assert not any(set(b.tokens) < set(a.tokens) and b.label == a.label and b.confidence >= a.confidence for b in rules)
    found = {r.page_id: r.verdict for r in url_filter.judge_urls(pages, mined).collect()}
    assert found == {n: "block" if n % 4 == 0 else "allow" for n in range(400)}
    assert url_filter.mine_rules(labelled.limit(0)).count() == 0
    # Matching through the index equals trying every rule on every URL.
    tokens = {r.page_id: set(r.tokens) for r in pages.select("page_id", url_filter.tokens_of(
        url_filter.F.col("url"), url_filter.host_of(url_filter.F.col("url")), url_filter.path_of(url_filter.F.col("url"))).alias("tokens")).collect()}
    for page, own in tokens.items():
        hits = [(r.confidence, r.support, r.rule_id, r.label) for r in rules if set(r.tokens) <= own]
        assert found[page] == (max(hits)[3] if hits else "allow")


def test_urls_that_share_long_paths(spark):
    """Twelve common path parts: combinations of them are not enumerated."""
    shared = "/".join(f"part{chr(97 + n)}" for n in range(12))
    rows = [(n, f"http://site{n}.org/{shared}/{'bad' if n % 2 else 'fine'}/{n}") for n in range(200)]
    rows += [(n, f"http://other.org/{n}") for n in range(200, 400)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(n, int(not (n < 200 and n % 2)), 0) for n in range(400)], "doc_id long, quality int, toxic int")
    mined = url_filter.mine_rules(url_filter.labelled_urls(pages, labels))
    rules = mined.collect()
    assert max(len(r.tokens) for r in rules) <= url_filter.RULE_TOKENS
    assert any(r.tokens == ["p:bad"] and r.label == "block" for r in rules)
    found = {r.page_id: r.verdict for r in url_filter.judge_urls(pages, mined).collect()}
    assert all(found[n] == ("block" if n < 200 and n % 2 else "allow") for n in range(400))


def test_the_query_blocks_by_mined_rules(spark):
    """Labels of the documents that the pages carry reach the verdicts of pages without labels."""
    from logweave.llm.queries import QUERIES

    folder = scratch_path(spark, "url-query")
    rows = [(1000 + n, f"http://www.{'pills' if n % 3 == 0 else 'daily'}.org/{'buy' if n % 3 == 0 else 'news'}/x/{n}?ref=1", "") for n in range(300)]
    rows += [(5, None, None), (6, "http://example.com/en/pills/buy", ""), (7, "http://pills.org/" + "buy/" * 20_000, ""), (None, "http://pills.org/buy/x/900", "")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    labels = [(n, int(n % 3 != 0), 0) for n in range(150)] + [(None, 0, 1), (150, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    found = {r.page_id: (r.rule, r.verdict) for r in QUERIES["op3_url_filter"](spark, folder).collect()}
    assert all(found[1000 + n] == (None, "block" if n % 3 == 0 else "allow") for n in range(300))
    assert found[5] == (None, "allow") and found[6] == ("example.com/en/", "block")
    assert found[7] == found[None] == (None, "block")


def test_no_pages_and_no_labels(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    mined = url_filter.mine_rules(url_filter.labelled_urls(none, labels))
    assert mined.count() == 0 and url_filter.judge_urls(none, mined).count() == 0


def plain_reading(html):
    """The given pages keep their text in one article of headings and paragraphs."""
    import html as entities
    import re

    inside = re.search(r"<article[^>]*>(.*?)</article>", html or "", re.S)
    text = re.sub(r"<(script|style).*?</\1>|<!--.*?-->", "", inside.group(1) if inside else "", flags=re.S)
    text = re.sub(r"</?(h[1-6]|p|br|ul|ol|li|div|blockquote)\b[^>]*>", " ", text)
    return " ".join(entities.unescape(re.sub(r"<[^>]+>", "", text)).split())


def test_given_pages_against_a_plain_reading(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    expected = {r.page_id: plain_reading(r.html) for r in pages.collect()}
    found = {r.page_id: r.text for r in html_extract.extract_pages(pages).collect()}
    assert {n for n in expected if found[n] != expected[n]} == set()
