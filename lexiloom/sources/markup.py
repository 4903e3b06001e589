"""Articles from XML and pages from HTML: text with block boundaries, licences, metadata."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urlsplit
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Elements that part words, body elements that are no prose, versions of the open licence, terms that restrict it.
BLOCKS = {"abstract", "sec", "title", "p", "list", "list-item", "disp-quote", "license-p"}
NO_PROSE = {"fig", "table-wrap", "supplementary-material", "ref-list"}
LICENSE_PATH = r"/licenses/by/(2\.0|2\.5|3\.0|4\.0)/?"
LICENSE_HOSTS = {"creativecommons.org", "www.creativecommons.org"}
RESTRICTED = r"non.?commercial|no.?derivatives|by-nc|by-nd|by-sa"
HTML_BLOCKS = {"p", "div", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "tr", "td", "th", "table", "br", "article", "section", "header", "footer", "nav", "title", "blockquote", "pre"}
HTML_SKIPPED = {"script", "style", "noscript", "template"}

ARTICLE = "title string, text string, authors array<string>, doi string, license_id string, license_url string, license_evidence string, attribution string, scope string, problem string"


def local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1] if isinstance(tag, str) else ""


def prose(node: ElementTree.Element | None) -> str:
    """Text of an element in document order; block elements part words, inline ones do not."""
    if node is None:
        return ""
    out: list[str] = []
    stack: list[tuple[str, object]] = [("open", node)]
    while stack:
        what, x = stack.pop()
        if what == "text":
            out.append(x)
            continue
        out.append(x.text or "")
        for child in reversed(list(x)):
            space = " " if local(child.tag) in BLOCKS else ""
            stack.append(("text", space + (child.tail or "")))
            stack.append(("open", child))
            stack.append(("text", space))
    return " ".join("".join(out).split())


def paragraphs(body: ElementTree.Element | None) -> list[str]:
    """Outermost paragraphs of a body outside figures, tables, supplements and references."""
    found: list[str] = []
    stack = [body] if body is not None else []
    while stack:
        node = stack.pop()
        if local(node.tag) in NO_PROSE:
            continue
        if local(node.tag) == "p":
            found.append(prose(node))
        else:
            stack.extend(reversed(list(node)))
    return [x for x in found if x]


def open_license(root: ElementTree.Element) -> tuple[str, str, str]:
    """(id, url, evidence) if exactly one open licence is named and no other term restricts it; else ValueError."""
    nodes = root.findall("./front/article-meta/permissions/license")
    named = {}
    for node in nodes:
        for url in [*node.attrib.values(), *(v for child in node.iter() for v in child.attrib.values())]:
            parts = urlsplit(url)
            version = re.fullmatch(LICENSE_PATH, parts.path)
            if version and parts.scheme in ("http", "https") and parts.hostname in LICENSE_HOSTS and not (parts.username or parts.query or parts.fragment):
                named.setdefault("CC-BY-" + version.group(1), (url, prose(node)))
    if len(named) != 1:
        raise ValueError("unknown_or_ambiguous_license")
    if any(re.search(RESTRICTED, ElementTree.tostring(node, encoding="unicode"), re.I) for node in nodes):
        raise ValueError("conflicting_license")
    name, (url, evidence) = named.popitem()
    return name, url, evidence


def read_article(raw: str, full_text: bool, all_contributors: bool) -> dict:
    root = ElementTree.fromstring(raw)
    name, url, evidence = open_license(root)
    meta = root.find("./front/article-meta")
    title = prose(meta.find("./title-group/article-title"))
    abstract = [x for x in map(prose, meta.findall("./abstract")) if x]
    parts = abstract + (paragraphs(root.find("./body")) if full_text else [])
    if not title or not parts:
        raise ValueError("missing_title_or_requested_text")
    people = [c for c in meta.findall("./contrib-group/contrib") if all_contributors or c.get("contrib-type", "author") == "author"]
    names = [n for c in people for n in c.findall("name")]
    authors = [" ".join(x for x in (prose(n.find("given-names")), prose(n.find("surname"))) if x) for n in names]
    doi = next((prose(n) for n in meta.findall("./article-id") if n.get("pub-id-type") == "doi"), "")
    scope = "abstract_only" if not full_text else "abstract_and_body" if abstract else "body"
    by = "; ".join(authors) or "Authors recorded at source"
    return {"title": title, "text": "\n\n".join(parts), "authors": authors, "doi": doi, "license_id": name, "license_url": url, "license_evidence": evidence, "attribution": f"{by}. {title}. {name}.", "scope": scope, "problem": None}


def articles(raw: DataFrame, id_col: str, xml_col: str, full_text: bool = False, all_contributors: bool = False) -> DataFrame:
    """id and the article's columns; a rejected one has only its problem.

    Authors are contributors of that type; ``all_contributors`` counts editors too.
    """
    kind = raw.schema[id_col].dataType.simpleString()
    empty = {k.split()[0]: None for k in ARTICLE.split(", ")}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, xml in zip(batch[id_col], batch[xml_col], strict=True):
                try:
                    rows.append({id_col: key, **read_article(xml or "", full_text, all_contributors)})
                except ElementTree.ParseError:
                    rows.append({id_col: key, **empty, "problem": "malformed_xml"})
                except ValueError as wrong:
                    rows.append({id_col: key, **empty, "problem": str(wrong)})
            yield pd.DataFrame(rows, columns=[id_col, *empty])

    return raw.select(id_col, xml_col).mapInPandas(run, f"{id_col} {kind}, {ARTICLE}")


class _Page(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.skipped = 0

    def handle_starttag(self, tag, attrs):
        if tag in HTML_SKIPPED:
            self.skipped += 1
        if tag in HTML_BLOCKS:
            self.out.append(" ")

    def handle_endtag(self, tag):
        if tag in HTML_SKIPPED and self.skipped:
            self.skipped -= 1
        if tag in HTML_BLOCKS:
            self.out.append(" ")

    def handle_data(self, data):
        if not self.skipped:
            self.out.append(data)


@F.pandas_udf(StringType())
def html_text(pages: pd.Series) -> pd.Series:
    """Text of HTML with block boundaries as spaces, without scripts and styles."""

    def one(page):
        if page is None:
            return None
        parser = _Page()
        parser.feed(page)
        parser.close()
        return " ".join("".join(parser.out).split())

    return pages.map(one)


def license_links(pages: DataFrame, id_col: str, url_col: str) -> DataFrame:
    """id, license_id of URLs that name exactly one version of the open licence, by column functions."""
    host = F.lower(F.try_parse_url(F.col(url_col), F.lit("HOST")))
    version = F.regexp_extract(F.try_parse_url(F.col(url_col), F.lit("PATH")), f"^{LICENSE_PATH}$", 1)
    named = pages.where(host.isin(list(LICENSE_HOSTS)) & (version != "")).select(F.col(id_col).alias("id"), F.concat(F.lit("CC-BY-"), version).alias("license_id"))
    return named.groupBy("id").agg(F.countDistinct("license_id").alias("n"), F.min("license_id").alias("license_id")).where("n = 1").drop("n")
