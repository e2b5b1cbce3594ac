import time

import pytest

from logweave.llm.html_extract import Page, extract_pages, trained

TEXT = "This is the first sentence of the story, and it goes on for a while. " * 6


def seen(html):
    return " ".join("".join(data for _, _, data, _ in Page(html).runs).split())


@pytest.mark.parametrize("mark", ["<![x[b]]>", "<![ x ]>", "<![>", "<![x]>", "<![1[b]]>"])
def test_unknown_marked_sections(mark):
    assert seen(f"<p>before{mark}after</p>") == "beforeafter"


def test_known_marked_sections():
    assert seen("<p>a<![CDATA[b]]>c<![if !IE]>d<![endif]>e</p>") == "acde"


@pytest.mark.parametrize("start", ["<p>", "<div><p>", "<img src=x>", "<br>", "<article>", ""])
def test_head_without_end(start):
    html = f"<html><head><meta charset=utf-8><title>no</title><style>p{{}}</style>\n<script>var no</script>\n{start}the text"
    assert seen(html) == "the text"


@pytest.mark.parametrize("head", ["<noscript><img src=x>no</noscript>", "<template><p>no</p></template>", "<title><b>no</b></title>"])
def test_what_is_open_in_a_head_stays_unseen(head):
    assert seen(f"<head>{head}<p>the text") == "the text"
    assert seen(f"<head>{head}</head><body><p>the text") == "the text"


@pytest.mark.parametrize("part", ["<b>", "<div>", "<p><b>", "<ul><li>x", "<a href=x>", "<!--", "<a", "<![CDATA[", "<?", '<a x="', "</", "&#"])
def test_time_is_linear_in_repeated_openings(part):
    """A hundred thousand of them; quadratic time would be minutes."""
    start = time.process_time()
    trained().extract(f"<p>{TEXT}</p>" + part * 100_000 + "end")
    assert time.process_time() - start < 20


def test_what_never_ends():
    assert seen("<p>before<!--never ended <p>more") == "before"
    assert seen("<p>before<a href='x") == "before"
    assert seen("<p>before <![CDATA[ never <b>ended</b>") == "before ended"
    assert seen("<p>a <![if x> b <b>c") == "a b c"
    assert seen("1 < 2 and 3 <") == "1 < 2 and 3 <"


def test_odd_pages_in_a_table(spark):
    rows = [
        (1, "u", f"<html><body><article><p>{TEXT}</p><![x[b]]><p>{TEXT}</p></article></body></html>"),
        (2, "u", f"<html><head><title>no</title><article><p>{TEXT}</p><p>{TEXT}</p></article></html>"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert all(r.text.count("first sentence") == 12 for r in extract_pages(pages).collect())
