"""Operator 4: boilerplate lines by their frequency within a site.

A page's lines are the texts between block elements (and line breaks), without
scripts, styles, comments and other tags, white space collapsed, empty ones
left out.  Within a host, the pages that hold a line are divided by all pages
of the host; a line whose ratio exceeds ``RATIO`` and that at least
``MIN_PAGES`` pages hold is boilerplate and is dropped from all of them.

A line counts once a page before anything is shuffled, and counts are summed
by (host, line hash) before the shuffle, so a line of a hot host moves as one
row a task.  What is joined back is one array per host; by the ratio it holds
at most 1 / RATIO times the lines of an average page.  DataFrame functions only.

A null or empty page has no lines; a url without a host belongs to no site, and
such a page keeps all its lines.  Every row is a page, also when it repeats a
page_id.  Lines are compared by a 64-bit hash within their host.  Other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import saved

RATIO, MIN_PAGES = 0.1, 3
BLOCKS = ("p|div|br|hr|li|ul|ol|dl|dt|dd|h[1-6]|table|thead|tbody|tr|td|th|article|section|header|footer|nav|main|"
          "aside|title|head|body|html|blockquote|pre|form|figure|figcaption|option|select")
#: Elements that go with their content: begin, end, and what stays.
ELEMENTS = ((r"<script[^<>]*>", r"</script[^<>]*>", "\n"), (r"<style[^<>]*>", r"</style[^<>]*>", "\n"), ("<!--", "-->", ""))
#: Then, in this order: what is replaced, and by what.
STEPS = (
    (r"(?i)</?(?:" + BLOCKS + r")(?:[\t\n\f\r /][^<>]*)?>", "\n"), (r"<[^<>]*>", ""),
    (r"&nbsp;", " "), (r"&lt;", "<"), (r"&gt;", ">"), (r"&quot;", '"'), (r"&#39;", "'"), (r"&amp;", "&"),
    (r"[\t\f\r ]+", " "), (r" ?\n ?", "\n"),
)
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is evaluated once, however often it is named there."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _without(html: Column, begin: str, end: str, to: str) -> Column:
    """``html`` with ``to`` for everything from a ``begin`` to the next ``end``.  Only the text
    up to the last ``end`` is searched: there every ``begin`` finds one, so none is looked
    for in vain to the end of the text, and the time is linear."""
    def rest(h: Column, head: Column) -> Column:
        return F.concat(F.regexp_replace(head, F.lit(f"(?is){begin}.*?{end}"), F.lit(to)), F.substr(h, F.length(head) + 1))

    return _once(html, lambda h: _once(F.regexp_extract(h, f"(?is)^.*{end}", 0), lambda head: rest(h, head)))


def lines_of(html: Column) -> Column:
    for element in ELEMENTS:
        html = _without(html, *element)
    for pattern, to in STEPS:
        html = F.regexp_replace(html, F.lit(pattern), F.lit(to))
    return F.filter(F.split(F.trim(html), "\n", -1), lambda x: x != "")


def drop_boilerplate(pages: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """``page_id, host, n_lines, n_removed, text`` (the kept lines, one a row)
    of every row of ``pages(page_id, url, html)``."""
    split = pages.select(F.col("page_id").cast("long").alias("page_id"),
                         F.lower(F.nullif(F.regexp_extract(F.col("url").cast("string"), HOST, 1), F.lit(""))).alias("host"),
                         lines_of(F.coalesce(F.col("html").cast("string"), F.lit(""))).alias("lines"))
    split = split.withColumn("hashes", F.transform("lines", lambda x: F.xxhash64(x)))
    split = saved(split, "lines")
    sited = split.where("host IS NOT NULL")
    total = sited.groupBy("host").agg(F.count("*").alias("pages"))
    held = (sited.select("host", F.explode(F.array_distinct("hashes")).alias("hash"))
            .groupBy("host", "hash").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages))
    common = saved(held.join(total, "host").where(F.col("n") > ratio * F.col("pages"))
                   .groupBy("host").agg(F.collect_list("hash").alias("common")), "boilerplate")
    joined = split.join(common, "host", "left")
    keep = F.filter(F.transform("lines", lambda x, i: F.when(
        ~F.coalesce(F.array_contains("common", F.element_at("hashes", i + 1)), F.lit(False)), x)), lambda x: x.isNotNull())
    return (joined.withColumn("kept", keep)
            .select("page_id", "host", F.size("lines").cast("long").alias("n_lines"),
                    (F.size("lines") - F.size("kept")).cast("long").alias("n_removed"),
                    F.array_join("kept", "\n").alias("text")))
