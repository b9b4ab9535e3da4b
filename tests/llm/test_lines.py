"""Operator 4 against a plain Python version, on awkward small tables."""

import re
import time
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from codeeval.llm import lines

PAGES = "page_id long, url string, html string, host string, lines array<string>, common string, n_lines int"
TAGS = ("p div br hr li ul ol dl dt dd h1 h2 h3 h4 h5 h6 table thead tbody tr td th article section header footer nav main aside "
        "title head body html blockquote pre form figure figcaption option select").split()


def page_lines(html):
    html = html or ""
    for name in ("script", "style"):
        html = re.sub(rf"(?is)<{name}[^<>]*>.*?</{name}[^<>]*>", "\n", html)
    html = re.sub(r"(?s)<!--.*?-->", "", html)
    html = re.sub(r"(?i)</?(?:" + "|".join(TAGS) + r")(?:[\t\n\f\r /][^<>]*)?>", "\n", html)
    html = re.sub(r"<[^<>]*>", "", html)
    for name, c in (("nbsp", " "), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "'"), ("amp", "&")):
        html = html.replace(f"&{name};", c)
    html = re.sub(r" ?\n ?", "\n", re.sub(r"[\t\f\r ]+", " ", html))
    return [x for x in html.strip(" ").split("\n") if x]


def host_of(url):
    m = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", url or "")
    return m[1].lower() if m else None


def brute(rows, ratio=0.1, least=3):
    held, total = defaultdict(Counter), Counter()
    for _, url, html in rows:
        if h := host_of(url):
            total[h] += 1
            held[h].update(set(page_lines(html)))
    out = Counter()
    for i, url, html in rows:
        h, ls = host_of(url), page_lines(html)
        kept = [x for x in ls if h is None or not (held[h][x] >= least and held[h][x] > ratio * total[h])]
        out[i, h, len(ls), len(ls) - len(kept), "\n".join(kept)] += 1
    return out


def found(spark, rows, **more):
    df = spark.createDataFrame([(*r, "clash", ["x"], "y", 3) for r in rows], PAGES).repartition(3)
    return Counter(map(tuple, lines.drop_boilerplate(df, **more).collect()))


def test_boilerplate_of_sites(spark):
    rows = [(i, f"https://Hot.example/{i}", f"<nav>menu</nav><p>own {i}</p><div>often {i % 9}</div><p>end</p>") for i in range(60)]
    rows += [(100 + i, f"http://user@small.example:80/x?{i}", f"<p>menu</p><p>page {i}</p>") for i in range(2)]   # below MIN_PAGES
    rows += [(200 + i, None if i % 2 else "no host", "<p>menu</p><p>menu</p>") for i in range(4)]
    rows += [(300, "http://twice.example", "<p>a</p>")] * 3 + [(301, "http://twice.example", "<p>a</p><p>a</p><p>b</p>")]
    assert found(spark, rows) == brute(rows)
    assert found(spark, rows, ratio=0.5, min_pages=1) == brute(rows, 0.5, 1)


def test_a_ratio_is_exceeded_not_met(spark):
    rows = [(i, "http://h.example", f"<p>tie</p><p>{i}</p>" if i < 4 else f"<p>{i}</p>") for i in range(40)]
    assert found(spark, rows) == brute(rows) and sum(r[3] for r in found(spark, rows)) == 0      # 4 of 40 is a tenth


def test_nulls_empty_pages_and_tables(spark):
    rows = [(None, "http://h.example", None), (1, "http://h.example", ""), (1, "http://h.example", " \n<p></p>"), (None, None, None),
            (2, "http://h.example", "<br>a<br/>a &amp;lt; b")]
    assert found(spark, rows) == brute(rows)
    assert found(spark, []) == Counter()


@pytest.mark.parametrize("html", (
    "a<script>x</script>b<script>c", "<SCRIPT type='x'>\ny</Script >z", "a<!-- b -->c<!-- d", "<!--><p>a</p>-->b", "<!-->", "a-->b<!--c",
    "</script>a<script>b</script>c</script>d", "<style>p{}</style><style>q", "<script><!-- </script> --> a", "<p>a<scr<script>b</script>ipt>c",
    "a < b > c <p >d</p\n>e<pp>f</pp><h7>g</h7>", "x y\tz\r\n w\f"))
def test_elements_and_tags(spark, html):
    df = spark.createDataFrame([(html,)], "h string").select(lines.lines_of(F.col("h")).alias("l"))
    assert df.first().l == page_lines(html)


@pytest.mark.parametrize("begin", ("<script>", "<style>", "<!--", "<script", "</script>", "<!-- <script> <style>", "-->", "<"))
def test_many_unclosed_tags_take_linear_time(spark, begin):
    df = spark.createDataFrame([("<p>a</p>" + begin * 8000 + "<p>b</p>",)], "h string").select(lines.lines_of(F.col("h")).alias("l"))
    df.collect()                                                        # compiled
    t = time.time()
    assert df.first().l[0] == "a"
    assert time.time() - t < 3
