"""Fields of product pages. Flat tags by expressions; nested ones by a parser in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
PAGES = 4096  # that a task parses, about, in a few seconds
DETAILS = "name string, number string, images array<string>, datasheet_url string, specifications map<string, map<string, string>>"


def without_scripts(html: Column) -> Column:
    return F.regexp_replace(html, r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->", "")


def first_heading(html: Column, level: int = 1) -> Column:
    return F.trim(F.nullif(F.regexp_extract(without_scripts(html), rf"(?is)<h{level}[^>]*>(.*?)</h{level}>", 1), F.lit("")))


def basic_references(text: Column) -> Column:
    """The three references that any writer of HTML must use, decoded; all others stay as written."""
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(sign))
    return text


def links(html: Column) -> Column:
    """Every href of an anchor, in order."""
    return F.regexp_extract_all(html, F.lit(r'<a[^>]*href="([^"]*)"'), F.lit(1))


def distinct_links(html: Column, own_url: Column) -> Column:
    """Links once each in the order of first sight; the page itself if it has none."""
    found = F.array_distinct(links(html))
    return F.when(F.size(found) > 0, found).otherwise(F.array(own_url))


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """rows, of which pages are made, over as many tasks as parsing needs: a small file has rows for minutes of it."""
    return rows.repartition(max(1, -(-rows.count() // PAGES)), key)


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict):
        self.tag, self.attrs, self.children = tag, attrs, []

    def all(self, tag: str, cls: str | None = None, **attrs) -> Iterator[Node]:
        """Nodes below, in document order; attrs: values, or True for any."""
        names = {k.replace("_", "-"): v for k, v in attrs.items()}
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            node = stack.pop()
            stack += [c for c in reversed(node.children) if isinstance(c, Node)]
            if node.tag == tag and (cls is None or cls in (node.attrs.get("class") or "").split()) and all(k in node.attrs and v in (True, node.attrs[k]) for k, v in names.items()):
                yield node

    def first(self, tag: str, cls: str | None = None, **attrs) -> Node | None:
        return next(self.all(tag, cls, **attrs), None)

    def text(self) -> str:
        """Text pieces stripped and joined."""
        out, stack = [], list(reversed(self.children))
        while stack:
            x = stack.pop()
            if isinstance(x, Node):
                stack += reversed(x.children)
            else:
                out.append(x.strip())
        return "".join(out)


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("", {})
        self.open = [self.root]

    def updatepos(self, i, j):
        """Lines and columns, which HTMLParser counts for each tag, are used nowhere."""
        return j

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.open[-1].children.append(Node(tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        self.open[-1].children.append(data)


def parse(html: str | None, decode: bool = True) -> Node:
    """decode: character references become characters, as in a browser; else texts and attributes stay as written."""
    tree = _Tree()
    tree.feed((html or "") if decode else (html or "").replace("&", "&amp;"))
    tree.close()
    return tree.root


def _https(url: str | None) -> str | None:
    return ("https:" + url if url.startswith("//") else url) if url else None


def table_page(page: Node) -> dict:
    """Pages with a titled heading, a main carousel and captioned specification tables."""
    heading = page.first("h1", "title-attention") or page.first("h1")
    carousel = page.first("div", "product-img-carousel--main")
    sheet = next((a.attrs["href"] for a in page.all("a") if a.attrs.get("href") and "datasheet" in a.text().lower() and "pdf" in a.text().lower()), None)
    specs: dict[str, dict[str, str]] = {}
    for table in page.all("table", "ac-table"):
        caption, body = table.first("caption", "ac-table__caption"), table.first("tbody", "ac-table__body")
        rows = [list(r.all("td", "ac-table__cell")) for r in body.all("tr", "ac-table__row")] if body else []
        pairs = {cells[0].text(): cells[1].text() for cells in rows if len(cells) >= 2}
        if pairs:
            specs[caption.text() if caption else "Unknown"] = pairs
    return {"name": heading.text() if heading else None, "number": None, "images": [i.attrs["src"] for i in carousel.all("img") if i.attrs.get("src")] if carousel else [], "datasheet_url": sheet, "specifications": specs}


def accordion_page(page: Node) -> dict:
    """Pages with a meta title, a wrapper's data attributes, a slide carousel and accordions joined by data-target."""
    meta = next((m.attrs.get("content") for m in page.all("meta", name="page-title")), None) or None
    wrapper = page.first("div", "product_description-wrapper")
    name = wrapper.attrs.get("data-product-name", meta) if wrapper else meta
    carousel = page.first("div", id="productCarouselComp") or page.first("div", "product-carousel-wrap")
    images: list = []
    if carousel:
        images = list(filter(None, (_https(s.attrs.get("data-original")) for s in carousel.all("div", "swiper-slide"))))
        images = images or list(filter(None, (_https(i.attrs.get("src") or i.attrs.get("data-src")) for i in carousel.all("img"))))
    marked = page.first("a", "product_data_sheet")
    sheet = _https(marked.attrs.get("href")) if marked else None
    sheet = sheet or next((_https(a.attrs["href"]) for a in page.all("a", href=True) if ".pdf" in a.attrs["href"].lower() and "datasheet" in a.text().lower()), None)
    specs: dict[str, dict[str, str]] = {}
    box = page.first("div", "tech-specs-accordion-container")
    for header in box.all("li", "tech-specs-items-title__name") if box else ():
        link = header.first("a", data_target=True)
        listed = box.first("ul", "tech-specs-items-description", data_target=link.attrs["data-target"]) if link else None
        pairs = {}
        for item in listed.all("li", "tech-specs-items-description-list") if listed else ():
            title, value = item.first("span", "tech-specs-items-description__title"), item.first("span", "tech-specs-items-description__title-details")
            if title and value and title.text() and value.text():
                pairs[title.text()] = value.text()
        if pairs:
            specs[link.text()] = pairs
    return {"name": name, "number": wrapper.attrs.get("data-product-number") if wrapper else None, "images": images, "datasheet_url": sheet, "specifications": specs}


def series_cards(page: Node) -> list[tuple[str, str, str | None]]:
    """(name, href, node id) of the cards below the heading of products, else of all cards."""
    within, seen, inside = None, False, False
    stack = [c for c in reversed(page.children) if isinstance(c, Node)]
    while stack and within is None:
        node = stack.pop()
        stack += [c for c in reversed(node.children) if isinstance(c, Node)]
        inside = inside or node.tag == "h3" and "Products within" in node.text()
        if inside and node.tag == "div" and "nav-card__coll" in (node.attrs.get("class") or "").split():
            within = node
        seen = seen or inside
    cards = (within or page).all("a", "nav-card") if within or not seen else ()
    out = []
    for card in cards:
        title = card.first("h4")
        if card.attrs.get("href") and title and title.text():
            out.append((title.text(), card.attrs["href"], card.attrs.get("data-history-node-id")))
    return out


def all_cards(page: Node) -> list[tuple[str, str, str | None]]:
    """(name, href, node id) of every card of a page of categories."""
    cards = [(card.first("h4"), card) for card in page.all("a", "nav-card")]
    return [(title.text(), card.attrs["href"], card.attrs.get("data-history-node-id")) for title, card in cards if card.attrs.get("href") and title and title.text()]


def listing(pages: DataFrame, cards: Callable[[Node], list] = series_cards, alone: bool = False) -> DataFrame:
    """url, pos (from 0), name, href, node_id: a row for each card of pages (url, html); all_cards() for pages of
    categories, series_cards() for those that also show collections. Pages without cards give no rows, or with alone
    one row with the page itself as href."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            each = ((url, cards(parse(html))) for url, html in zip(pdf["url"], pdf["html"]))
            rows = [(url, pos, *card) for url, found in each for pos, card in enumerate(found or ([(None, url, None)] if alone else []))]
            yield pd.DataFrame(rows, columns=["url", "pos", "name", "href", "node_id"])

    return pages.select("url", "html").mapInPandas(run, "url string, pos int, name string, href string, node_id string")


def product_links(pages: DataFrame) -> DataFrame:
    """url, pos, href of the products that pages of series list; a page that lists none is a product itself."""
    return listing(pages, alone=True).select("url", "pos", "href")


# Categories that are not read from a page: name, value or path, kind.
STATIC_CATEGORIES = [
    ("IP - Network Cameras", "Network Cameras", "IP"),
    ("IP - PTZ Cameras", "PTZ Cameras", "IP"),
    ("IP - Explosion-Proof Series", "Explosion-Proof and Anti-Corrosion Series", "IP"),
    ("ITS - Traffic Cameras", "its", "ITS"),
    ("Thermal - All Products", "thermal", "THERMAL"),
]


def static_categories(spark: SparkSession, urls: dict[str, str]) -> DataFrame:
    """name, href, node_id and how to fetch: the url to open, and the filter to set there. urls: one for each of IP,
    ITS and THERMAL. Of the IP kind, href is the filter on the common page; of the others, the page itself."""
    rows = [(name, value if kind == "IP" else urls[kind], kind, urls[kind], value if kind == "IP" else None) for name, value, kind in STATIC_CATEGORIES]
    return spark.createDataFrame(rows, "name string, href string, node_id string, url string, filter string")


def extract(pages: DataFrame, site: Callable[[Node], dict] = table_page, unknown: str = "Unknown Product", decode: bool = True) -> DataFrame:
    """pages (url, html) to url, the details and error; a page that fails has its error and no details. decode: as in
    parse()."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for url, html in zip(pdf["url"], pdf["html"]):
                try:
                    got = site(parse(html, decode))
                    rows.append({"url": url, **got, "name": got["name"] or unknown, "error": None})
                except Exception as e:  # noqa: BLE001  one bad page must not end the job
                    rows.append({"url": url, "name": None, "number": None, "images": None, "datasheet_url": None, "specifications": None, "error": str(e)})
            yield pd.DataFrame(rows, columns=["url", "name", "number", "images", "datasheet_url", "specifications", "error"])

    return pages.select("url", "html").mapInPandas(run, f"url string, {DETAILS}, error string")


def routed(products: DataFrame, kind: str, subcategory: str, categories: DataFrame) -> DataFrame:
    """products with name, url and filter of the static category by which each is fetched: of its kind, and of its
    subcategory where the category has a filter; null where no category has it. categories: static_categories()."""
    mine = F.broadcast(categories.select("name", "node_id", "url", "filter"))  # a few fixed rows
    fits = (F.col(kind) == F.col("node_id")) & (F.col("filter").isNull() | (F.col(subcategory) == F.col("filter")))
    return products.join(mine, fits, "left").drop("node_id")
