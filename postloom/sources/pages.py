"""Pages to posts: a job over a table of HTML pages."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom.functions.dates import relative_date
from postloom.functions.text import combined_text, split_hashtags
from postloom.operators.joins import fill_by_key

# Where the fields of a post stand in a page.
TITLE_CLASS = PREVIEW_CLASS = "pointer-events-none"
POSTER_CLASS = "h-full items-center text-xs"
COUNT_LABELS = {"num_likes": "Like this", "num_comments": "Comment on this", "num_views": "Views"}
VOID_TAGS = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class _Fields(HTMLParser):
    """Collects the fields of every article of one page, in page order."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[list] = []  # [tag, kind, text parts, whether a child was seen]
        self.posts: list[dict] = []
        self.inside: list[dict] = []  # open articles
        self.pending: list[dict] = []

    def _keep(self, field, value):
        """The first value of a field belongs to the innermost open article."""
        if self.inside:
            self.inside[-1].setdefault(field, value)

    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        cls, kind = attrs.get("class") or "", None
        parents = [entry[0] for entry in self.open[-2:]]
        self._seal()
        if tag == "article":
            self.posts.append({})
            self.inside.append(self.posts[-1])
        if tag == "a" and parents == ["article", "div"] and attrs.get("href") is not None:
            self._keep("link", attrs["href"])
        elif tag == "h2" and TITLE_CLASS in cls:
            kind = "title"
        elif tag == "p" and PREVIEW_CLASS in cls:
            kind = "preview"
        elif tag == "div" and POSTER_CLASS in cls:
            kind = "poster"
        elif tag == "button" and "disabled" not in attrs:
            label = attrs.get("aria-label") or ""
            for name, words in COUNT_LABELS.items():
                if words in label and self.pending and self.pending[-1].get(name) is None:
                    self.pending[-1][name] = attrs.get("data-count")
            if COUNT_LABELS["num_likes"] in label and self.pending:
                self.pending[-1]["_liked"] = True
        if tag == "div":
            self.pending.append({})
        if tag not in VOID_TAGS:
            self.open.append([tag, kind, [], False])

    def _seal(self):
        """Only the text before the first child counts for titles and previews."""
        if self.open:
            self.open[-1][3] = True

    def handle_comment(self, data):
        self._seal()

    def handle_data(self, data):
        for _, kind, parts, _ in self.open:
            if kind == "poster":
                parts.append(data)
        if self.open and self.open[-1][1] in ("title", "preview") and not self.open[-1][3]:
            self.open[-1][2].append(data)

    def handle_endtag(self, tag):
        if not any(entry[0] == tag for entry in self.open):
            return
        while True:
            name, kind, parts, _ = self.open.pop()
            if kind == "title":
                self._keep("title", "".join(parts))
            elif kind == "preview":
                self._keep("preview", "".join(parts))
            elif kind == "poster":
                self._keep("poster", parts)
            if name == "div":
                found = self.pending.pop()
                if found.pop("_liked", False):
                    self._keep("counts", found)
            if name == "article":
                self.inside.pop()
            if name == tag:
                return


POST_FIELDS = (
    "position int, link string, title string, post_preview string, user_firm string, user_name string, "
    "date_text string, likes_text string, comments_text string, views_text string, parts_missing int"
)


def _page_rows(html: str) -> list[tuple]:
    page = _Fields()
    page.feed(html or "")
    page.close()
    rows = []
    for i, post in enumerate(p for p in page.posts if "link" in p):
        firm, user, date = (post.get("poster", []) + [None] * 3)[:3]
        counts = post.get("counts", {})
        missing = sum(part not in post for part in ("title", "preview", "poster", "counts"))
        rows.append(
            (i, post["link"], post.get("title"), post.get("preview"), firm, user, date, *[counts.get(name) for name in COUNT_LABELS], missing)
        )
    return rows


def extract_posts(pages: DataFrame, base_url: str, scrape_date: str, key: str = "page_id", html: str = "html") -> DataFrame:
    """One row per post of every page; a missing count is 0, another missing part null.

    A post is an article with a link, and its parts are those inside the article;
    ``parts_missing`` tells how many of title, preview, poster and counts it
    lacks. Nested markup needs a parser, which runs on Arrow batches and sees the
    articles only; everything after it, links, counts and dates, is columns.
    """
    columns = [f.split()[0] for f in POST_FIELDS.split(", ")]

    def run(batches: Iterator):
        import pandas as pd

        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.iloc[at : at + 256]
                rows = [(k, *r) for k, h in zip(part[key], part[html]) for r in _page_rows(h)]
                yield pd.DataFrame(rows, columns=[key, *columns])

    # from the first article to the end of the last one
    cut = F.regexp_extract(F.col(html), r"(?is)<article\b.*</article\s*>", 0).alias(html)
    raw = pages.select(key, cut).mapInPandas(run, f"{key} {dict(pages.dtypes)[key]}, {POST_FIELDS}")

    def count(c: str) -> Column:
        return F.coalesce(F.col(c).try_cast("int"), F.lit(0))

    return raw.select(
        key,
        "position",
        post_link(F.col("link"), base_url).alias("post_id"),
        "user_name",
        "user_firm",
        relative_date(F.col("date_text")).alias("date"),
        F.lit(scrape_date).cast("date").alias("scrape_date"),
        count("likes_text").alias("num_likes"),
        count("comments_text").alias("num_comments"),
        count("views_text").alias("num_views"),
        "title",
        "post_preview",
        "parts_missing",
    )


def post_link(link: Column, base_url: str, prefix: str = "/post/") -> Column:
    """A post's identity: its link without the site and the path prefix."""
    return F.replace(F.replace(link, F.lit(base_url), F.lit("")), F.lit(prefix), F.lit(""))


def page_outline(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """Title, heading, link and paragraph counts of any page, by patterns alone."""
    h = F.col(html)
    return pages.select(
        key,
        F.regexp_extract(h, r"(?s)<title>(.*?)</title>", 1).alias("title"),
        F.regexp_extract(h, r"(?s)<h1>(.*?)</h1>", 1).alias("heading"),
        F.size(F.regexp_extract_all(h, F.lit(r'<a href="([^"]*)"'), F.lit(1))).alias("n_links"),
        F.regexp_count(h, F.lit(r"<p>")).alias("n_paragraphs"),
    )


def page_links(pages: DataFrame, key: str = "page_id", html: str = "html", base_url: str = "") -> DataFrame:
    """One row per link of a page, in page order, without the site prefix."""
    links = F.regexp_extract_all(F.col(html), F.lit(r'<a href="([^"]*)"'), F.lit(1))
    return pages.select(key, F.posexplode(links).alias("position", "link")).withColumn(
        "link", post_link(F.col("link"), base_url) if base_url else F.col("link")
    )


def attach_text(posts: DataFrame, fulltext: DataFrame, key: str = "post_id") -> DataFrame:
    """Posts with full text, hashtags and combined text.

    A missing full text is filled with the preview of the same post.
    """
    filled = fill_by_key(fulltext, posts, key, "full_text", "post_preview")
    parts = filled.select(key, split_hashtags(F.col("full_text")).alias("s"))
    cut = parts.select(key, F.col("s.content").alias("text"), F.col("s.hashtags").alias("hashtags"))
    return posts.join(cut, key, "inner").withColumn("combined", combined_text(F.col("title"), F.col("text")))
