"""Datasets read from page snapshots ``(page_id, url, html)``."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import BODY_NOISE_MARKERS, BODY_STOP_MARKERS
from ..functions import text as t
from ..functions import urls as u
from ..functions import values as v
from . import html as h


@dataclass(frozen=True)
class PageLayout:
    """Selectors of one kind of site."""

    card: str = "article"
    title: str = "h2 a, h3 a, h1"
    link: str = "a"
    date: str = ".date, time"
    image: str = "img"
    category: str = ".category"
    body: str = ""
    # default places of an article body, then anything in an article
    default_body: str = (
        "article [itemprop='articleBody'], article .entry-content, article .post-content, "
        "article .article-content, article .nota-contenido, article .news-detail, "
        "article .single-content, article .content, main [itemprop='articleBody'], "
        "main .entry-content, main .post-content, main .article-content, main .nota-contenido, "
        "main .news-detail, main .single-content, main .content, article p, main p"
    )
    exclude: str = (
        "script, style, noscript, iframe, form, nav, header, footer, aside, .ad, .ads, "
        ".advertisement, .publicidad, .banner, .share, .social, .related, .relacionadas, "
        ".tags, .tag, .newsletter, .comments"
    )


#: Pages whose parsed form is in a worker's memory at a time.
PARSED_AT_ONCE = 64

_CARD = "struct<title:string,href:string,date:string,image:string,category:string>"
_PAGE = (
    "page_id bigint, url string, title string, metas array<struct<name:string,content:string>>, "
    "times array<string>, ld_dates array<string>, ld_body string, links array<struct<href:string,text:string>>, "
    f"cards array<{_CARD}>, lines array<string>, anchor int, body array<string>, default_body array<string>"
)


def read_pages(pages: DataFrame, layout: PageLayout = PageLayout()) -> DataFrame:
    """Every page once through the parser: the raw material of all page datasets."""

    def first(node, selector):
        hits = h.select(node, selector) if selector else []
        return hits[0] if hits else None

    def image_of(node):
        if node is None:
            return None
        if node.tag == "meta":
            return node.attrs.get("content")
        for attr in ("data-srcset", "srcset"):
            if node.attrs.get(attr):
                return node.attrs[attr].split(",")[0].split()[0]
        return node.attrs.get("data-src") or node.attrs.get("data-lazy-src") or node.attrs.get("src")

    def card_row(node):
        title, link = first(node, layout.title), first(node, layout.link)
        date, category = first(node, layout.date), first(node, layout.category)
        href = (link.attrs.get("href") if link is not None else "") or (title.attrs.get("href", "") if title is not None else "")
        return {
            "title": title.text() if title is not None else None, "href": href,
            "date": (date.attrs.get("datetime") or date.text()) if date is not None else None,
            "image": image_of(first(node, layout.image)), "category": category.text() if category is not None else None}

    def paragraphs(nodes, hidden):
        out = []
        for node in nodes:
            parts = [n for n in node.walk() if n.tag in ("p", "li", "blockquote") and n is not node] or [node]
            out += [p.text(hidden) for p in parts]
        return out

    def page_row(page_id, url, markup):
        root = h.parse(markup)
        excluded = {id(n) for n in h.select(root, layout.exclude)}

        def hidden(node):
            return id(node) in excluded

        title = first(root, "h1") or first(root, "title")
        title = title.text() if title is not None else ""
        lines = [x for x in (h.clean(s) for s in root.strings(lambda n: hidden(n) or n.tag == "title")) if x]
        objects = h.json_ld(root)
        kinds = {"NewsArticle", "Article", "ReportageNewsArticle"}

        def is_article(o):
            kind = o.get("@type")
            return bool(kinds & set(kind if isinstance(kind, list) else [kind]))

        return {
            "page_id": page_id, "url": url, "title": title,
            "metas": [{"name": (m.attrs.get("property") or m.attrs.get("name") or "").lower(), "content": h.clean(m.attrs.get("content", ""))}
                      for m in h.select(root, "meta")],
            "times": [n.attrs["datetime"] for n in h.select(root, "time[datetime]")],
            "ld_dates": [str(o[k]) for o in objects for k in ("datePublished", "dateCreated", "dateModified") if o.get(k)],
            "ld_body": h.clean("\n\n".join(str(o["articleBody"]) for o in objects if is_article(o) and o.get("articleBody"))),
            "links": [{"href": a.attrs["href"], "text": a.text()} for a in h.select(root, "a[href]")],
            "cards": [card_row(n) for n in h.select(root, layout.card)],
            "lines": lines, "anchor": h.anchor(lines, title),
            "body": paragraphs(h.select(root, layout.body), hidden) if layout.body else [],
            "default_body": paragraphs(h.select(root, layout.default_body), hidden),
        }

    def parse_batch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # a parsed page is many times its markup, so few are held at once
        for pdf in batches:
            for at in range(0, len(pdf), PARSED_AT_ONCE):
                part = pdf.iloc[at:at + PARSED_AT_ONCE]
                yield pd.DataFrame([page_row(*r) for r in zip(part["page_id"], part["url"], part["html"])])

    return pages.select("page_id", "url", "html").mapInPandas(parse_batch, _PAGE)


def page_articles(parsed: DataFrame) -> DataFrame:
    """Article cards of listing pages: title of ten characters or more and a link."""
    cards = parsed.select("page_id", F.col("url").alias("page_url"), F.posexplode("cards").alias("card_no", "c"))
    url = u.absolute_url(F.col("c.href"), F.col("page_url"))
    listed = F.coalesce(v.parse_date_text(F.col("c.date")), u.date_from_url(url))
    return cards.where((F.length("c.title") >= 10) & (F.length("c.href") > 0)).select(
        "page_id", "card_no", F.col("c.title").alias("title"), url.alias("url"), listed.alias("published_at"),
        listed.isNotNull().alias("published_at_from_listing"),
        u.article_image(u.absolute_url(F.nullif("c.image", F.lit("")), F.col("page_url"))).alias("image"),
        F.col("c.category").alias("source_category_raw"), u.url_hash(url).alias("url_hash"))


def page_links(parsed: DataFrame, min_text: int = 20) -> DataFrame:
    """Links of pages without article cards that look like articles, once per page and URL."""
    found = parsed.where(F.size(F.filter("cards", lambda c: (F.length(c["title"]) >= 10) & (F.length(c["href"]) > 0))) == 0).select(
        "page_id", F.col("url").alias("page_url"), F.posexplode("links").alias("link_no", "l"))
    url = u.absolute_url(F.col("l.href"), F.col("page_url"))
    rows = found.where(F.length("l.text") >= min_text).select("page_id", "page_url", "link_no", F.col("l.text").alias("title"), url.alias("url"))
    rows = rows.where(u.looks_like_article(F.col("url"), F.col("page_url")))
    return rows.groupBy("page_id", "url").agg(F.min_by("title", "link_no").alias("title")).withColumn("url_hash", u.url_hash(F.col("url")))


def _any_marker(line: Column, markers: Sequence[str]) -> Column:
    hit = F.lit(False)
    for marker in markers:
        hit = hit | line.contains(marker)
    return hit


def body_lines(lines: Column, min_chars: int = 35) -> Column:
    """Lines of an article body: up to a stop marker, without noise, short and repeated lines.

    A teaser line also takes the line after it along. One fold per document.
    """
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(False).alias("skip"), F.lit(False).alias("done"))

    def step(acc: Column, line: Column) -> Column:
        low = F.lower(F.trim(line))
        teaser = low.contains("te puede interesar")
        stop = _any_marker(low, BODY_STOP_MARKERS)
        noise = _any_marker(low, BODY_NOISE_MARKERS) | (F.length(line) < min_chars)
        live = ~acc["done"] & ~acc["skip"]
        take = live & ~teaser & ~stop & ~noise
        return F.struct(
            F.when(take, F.concat(acc["kept"], F.array(line))).otherwise(acc["kept"]).alias("kept"),
            (live & teaser).alias("skip"),
            (acc["done"] | (live & ~teaser & stop)).alias("done"))

    return F.array_distinct(F.aggregate(F.filter(lines, lambda x: F.length(x) > 0), start, step)["kept"])


def clean_text_lines(df: DataFrame, text: str = "text") -> DataFrame:
    """Boiler-plate removal on a table of plain texts."""
    lines = F.transform(F.split(text, "\n"), t.squeeze)
    return df.withColumn("body_lines", body_lines(lines)).withColumn("body", F.array_join("body_lines", "\n\n"))


def page_body(parsed: DataFrame, min_words: int = 25) -> DataFrame:
    """Body text per page by ordered candidates.

    JSON-LD body, lines after the title (after the first long line, if no line shows it), the site's own selector,
    the default selector;
    the first with ``min_words`` words wins, else the longest of the last candidates.
    """
    anchored = F.when(F.col("anchor") >= 0, F.expr("slice(lines, anchor + 2, size(lines))")).otherwise(F.array().cast("array<string>"))
    first_long = F.array_position(F.transform("lines", lambda x: (F.length(x) >= 45) & ~_any_marker(F.lower(F.trim(x)), BODY_NOISE_MARKERS)), True)
    loose = F.when(first_long > 0, F.slice("lines", (first_long + 1).cast("int"), F.size("lines"))).otherwise(F.array().cast("array<string>"))

    def joined(lines: Column) -> Column:
        return F.array_join(lines, "\n\n")

    def distinct_paragraphs(name: str) -> Column:
        long = F.filter(name, lambda x: F.length(x) >= 30)
        lowered = F.transform(long, F.lower)
        return joined(F.filter(long, lambda x, i: F.array_position(lowered, F.lower(x)) == i + 1))

    kinds = (
        ("json_ld", F.col("ld_body")), ("title_anchor", joined(body_lines(F.when(F.col("anchor") >= 0, anchored).otherwise(loose)))),
        ("site_selector", distinct_paragraphs("body")), ("default_selector", distinct_paragraphs("default_body")),
        ("first_long_line", joined(body_lines(loose))))
    candidates = F.array(*[
        F.struct(F.lit(name).alias("method"), text.alias("text"), t.word_count(text).alias("words")) for name, text in kinds])
    base = parsed.select("page_id", "url", "title", candidates.alias("c"))
    accepted = F.get(F.filter("c", lambda x: ((x["method"] == "json_ld") & (x["words"] > 0)) | ((x["method"] != "first_long_line") & (x["words"] >= min_words))), F.lit(0))
    fallback, last = F.element_at("c", 4), F.element_at("c", 5)
    chosen = F.when(accepted.isNotNull(), accepted).when(last["words"] > fallback["words"], last).otherwise(fallback)
    return base.select("page_id", "url", "title", chosen["method"].alias("method"), chosen["text"].alias("body"), chosen["words"].alias("words"))


def page_meta(parsed: DataFrame) -> DataFrame:
    """Description and publication date of pages by priority."""

    def meta(name: str) -> Column:
        return F.nullif(F.get(F.filter("metas", lambda m: m["name"] == name), F.lit(0))["content"], F.lit(""))

    dates = F.concat(F.array(meta("article:published_time"), meta("og:published_time")), F.slice("times", 1, 1), "ld_dates")
    parsed_dates = F.array_compact(F.transform(dates, lambda d: v.parse_date_text(d)))
    return parsed.select(
        "page_id", "url", "title",
        F.coalesce(meta("og:description"), meta("description"), meta("twitter:description"), F.lit("")).alias("description"),
        F.get(parsed_dates, F.lit(0)).alias("published_at"))


def page_title_columns(pages: DataFrame) -> DataFrame:
    """Title, language and first heading by pattern only: no Python worker."""

    def inner(pattern: str) -> Column:
        return t.squeeze(F.regexp_replace(F.regexp_extract("html", pattern, 1), "<[^>]*>", " "))

    return pages.select(
        "page_id", u.host(F.col("url")).alias("host"), inner(r"(?is)<title[^>]*>(.*?)</title>").alias("title"),
        F.regexp_extract("html", r'(?is)<html[^>]*lang="([^"]*)"', 1).alias("lang"),
        inner(r"(?is)<h1[^>]*>(.*?)</h1>").alias("h1"), F.length("html").alias("html_chars"))


_INDICATOR = "page_id bigint, card_no int, group_name string, subtitle string, asof string, asof_attr string, label string, value_text string"


def indicator_cards(pages: DataFrame, card: str = ".bcb-kpi2, .indicator-card") -> DataFrame:
    """Indicator cards of pages to typed rows: label, value, unit, currency, asset, side, code."""

    def text_of(node, selector):
        hits = h.select(node, selector)
        return hits[0].text() if hits else ""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["page_id", "card_no", "group_name", "subtitle", "asof", "asof_attr", "label", "value_text"]
        for pdf in batches:
            out = []
            for page_id, markup in zip(pdf["page_id"], pdf["html"]):
                for no, node in enumerate(h.select(h.parse(markup), card)):
                    stamp = h.select(node, ".bcb-kpi2-asof time[datetime]")
                    head = (page_id, no, text_of(node, ".bcb-kpi2-name"), text_of(node, ".bcb-kpi2-sub"), text_of(node, ".bcb-kpi2-asof"),
                            stamp[0].attrs["datetime"] if stamp else "")
                    rows = [(text_of(r, ".bcb-lbl"), text_of(r, ".bcb-val")) for r in h.select(node, ".bcb-row")]
                    if not rows:
                        rows = list(zip([x.text() for x in h.select(node, ".bcb-lbl")], [x.text() for x in h.select(node, ".bcb-val")]))
                    out += [(*head, label, value) for label, value in rows]
            yield pd.DataFrame(out, columns=names)

    raw = pages.select("page_id", "html").mapInPandas(read, _INDICATOR)
    value = v.parse_decimal(F.col("value_text"))
    text = F.lower(t.strip_accents(F.concat_ws(" ", "group_name", "subtitle", "label")))
    percent = text.contains("%") | text.contains("tasa") | text.contains("inflacion")
    unit = F.when(percent, "%").when(text.contains("ufv"), "BOB").when(text.contains("oro"), "USD / O.T.F.").when(text.contains("dolar"), "BOB per USD")
    currency = F.when(percent, None).when(text.contains("dolar"), "BOB").when(text.contains("oro"), "USD").when(text.contains("ufv"), "BOB")
    asset = F.when(percent, None).when(text.contains("dolar"), "USD").when(text.contains("oro"), "GOLD").when(text.contains("ufv"), "UFV")
    label = F.lower(F.trim("label"))
    observed = F.coalesce(F.left("asof_attr", F.lit(10)).try_cast("date"), v.parse_spanish_date(F.col("asof")))
    return raw.where((F.length("group_name") > 0) & (F.length("label") > 0)).withColumn("value", value).where("value IS NOT NULL").select(
        "page_id", "card_no", t.slugify(F.concat_ws(" ", F.lit("bcb"), "group_name", "label")).alias("indicator_code"),
        F.col("label").alias("indicator_name"), F.col("group_name").alias("indicator_group"), "value", unit.alias("unit"),
        currency.alias("currency"), asset.alias("asset"),
        F.when(label == "compra", "buy").when(label == "venta", "sell").alias("side"), observed.alias("observed_at"))
