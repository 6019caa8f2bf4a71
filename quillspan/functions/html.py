"""HTML parsing for stored pages: links, metadata and question-answer pages, with the standard library."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .batches import bounded

_VOID = {"br", "img", "meta", "link", "input", "hr", "source", "area", "base", "col", "embed", "track", "wbr"}
_SKIP = {"script", "style", "noscript", "template"}
#: Fixed pattern: paragraphs with contact details or closing phrases are no answer text.
CONTACT = re.compile(r"hotline|https?://|www\.|[\w.+-]+@[\w-]+\.\w+|(?:\+?84|0)[\d .-]{8,}\d", re.I)
YEAR = re.compile(r"(?<!\d)(20\d{2})(?!\d)")


class Page(HTMLParser):
    """title, lang, metas, links (href, text, class, nearest heading), headings and paragraphs of a page."""

    def __init__(self, html: str, url: str = ""):
        super().__init__(convert_charrefs=True)
        self.url, self.title, self.lang = url, "", ""
        self.metas: list[tuple[str, str]] = []
        self.links: list[dict] = []
        self.headings: list[tuple[int, str]] = []
        self.paragraphs: list[tuple[str, str]] = []
        self._open: list[tuple[str, str]] = []
        self._buffers: list[tuple[str, dict, list[str]]] = []
        self.text: list[str] = []
        self._skip = 0
        self.feed(html)
        self.close()
        while self._buffers:
            self._close_buffer(self._buffers[-1][0])

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag in _SKIP:
            self._skip += 1
        if tag == "html":
            self.lang = a.get("lang", "")
        if tag == "meta" and (name := a.get("name") or a.get("property")):
            self.metas.append((name.lower(), a.get("content", "")))
        if tag == "link" and a.get("rel") == "next":
            self.links.append({"href": urljoin(self.url, a.get("href", "")), "text": "", "class": "next", "heading": self._heading()})
        if tag in ("a", "title", "p", "li") or re.fullmatch("h[1-6]", tag):
            if tag in ("p", "li"):
                self._close_buffer(tag)
            self._buffers.append((tag, a, []))
        if tag not in _VOID:
            self._open.append((tag, a.get("class", "")))

    def _heading(self) -> str:
        return self.headings[-1][1] if self.headings else ""

    def handle_data(self, data):
        if self._skip:
            return
        self.text.append(data)
        for _, _, parts in self._buffers:
            parts.append(data)

    def _close_buffer(self, tag: str) -> None:
        for k in range(len(self._buffers) - 1, -1, -1):
            if self._buffers[k][0] == tag:
                _, a, parts = self._buffers.pop(k)
                body = " ".join("".join(parts).split())
                if tag == "a" and a.get("href"):
                    self.links.append({"href": urljoin(self.url, a["href"]), "text": body, "class": a.get("class", ""), "heading": self._heading()})
                elif tag == "title":
                    self.title = self.title or body
                elif tag in ("p", "li") and body:
                    self.paragraphs.append((next((c for _, c in reversed(self._open) if c), ""), body))
                elif tag.startswith("h") and body:
                    self.headings.append((int(tag[1]), body))
                return

    def handle_endtag(self, tag):
        if tag in _SKIP:
            self._skip = max(0, self._skip - 1)
        self._close_buffer(tag)
        for k in range(len(self._open) - 1, -1, -1):
            if self._open[k][0] == tag:
                del self._open[k:]
                break

    def meta(self, *names: str) -> list[str]:
        """Contents of the first of the names that the page has."""
        for name in names:
            found = [c.strip() for n, c in self.metas if n == name and c.strip()]
            if found:
                return found
        return []


def metadata(page: Page) -> dict:
    """Title, authors, abstract, PDF address, language and year, each from the first source that has it."""
    title = page.meta("citation_title", "dc.title", "og:title") or [t for _, t in page.headings[:1]] or [page.title]
    pdf = page.meta("citation_pdf_url") or [x["href"] for x in page.links if x["href"].lower().endswith(".pdf") or "/download/" in x["href"]]
    dates = page.meta("citation_publication_date", "citation_date", "article:published_time", "dc.date")
    year = YEAR.search(" ".join(dates)) or YEAR.search(" ".join(page.text))
    return {
        "title": title[0] if title else "",
        "authors": page.meta("citation_author", "dc.creator.personalname", "dc.creator", "author"),
        "abstract": " ".join(page.meta("citation_abstract", "dc.description", "description", "og:description")[:1]),
        "pdf_url": re.sub(r"/article/view/(\d+)/(\d+)$", r"/article/download/\1/\2", pdf[0]) if pdf else None,
        "html_lang": page.lang.lower(),
        "year": int(year[1]) if year else None,
    }


def article_links(page: Page) -> list[str]:
    """Addresses .../article/view/N on the page's host, without galley suffixes, once each."""
    found = {}
    for x in page.links:
        parts = urlsplit(x["href"])
        m = re.fullmatch(r"(.*/article/view/\d+)(?:/\d+)?/?", parts.path)
        if m and parts.netloc == urlsplit(page.url).netloc:
            found[f"{parts.scheme}://{parts.netloc}{m[1]}"] = None
    return list(found)


def next_links(page: Page) -> list[str]:
    """Pagination links on the page's host: numbered, with a page query, or marked as next."""
    found = {}
    for x in page.links:
        parts = urlsplit(x["href"])
        numbered = re.fullmatch(r"\d{1,4}", x["text"]) or re.search(r"(?:^|&)(?:page|p|.*Page)=\d+", parts.query) or re.search(r"/page/\d+|/archive/\d+", parts.path)
        if parts.netloc == urlsplit(page.url).netloc and (numbered or x["class"] == "next" or x["text"].lower() in ("next", ">", "»")):
            found[parts._replace(fragment="").geturl()] = None
    return list(found)


def issue_links(page: Page) -> list[dict]:
    """Issue addresses with the year of their label, else of the heading above them."""
    out = {}
    for x in page.links:
        if "/issue/view/" in x["href"]:
            year = YEAR.search(x["text"]) or YEAR.search(x["heading"])
            out.setdefault(x["href"].split("#")[0], {"url": x["href"].split("#")[0], "year": int(year[1]) if year else None})
    return list(out.values())


def question_answer(page: Page) -> dict:
    """Question from the main heading or first paragraph, answer from the rest without contact paragraphs."""
    body = [t for _, t in page.paragraphs if not CONTACT.search(t)]
    question = next((t for level, t in page.headings if level == 1), None)
    rest = body if question else body[1:]
    return {"question": question or (body[0] if body else ""), "answer": "\n".join(rest)}


_LINK = pa.struct([("href", pa.string()), ("text", pa.string()), ("class", pa.string()), ("heading", pa.string())])
_META = pa.struct([("title", pa.string()), ("authors", pa.list_(pa.string())), ("abstract", pa.string()), ("pdf_url", pa.string()), ("html_lang", pa.string()), ("year", pa.int32())])
KINDS = {
    "links": ("array<struct<href:string,text:string,class:string,heading:string>>", pa.list_(_LINK), lambda p: p.links),
    "metadata": ("struct<title:string,authors:array<string>,abstract:string,pdf_url:string,html_lang:string,year:int>", _META, metadata),
    "article_links": ("array<string>", pa.list_(pa.string()), article_links),
    "next_links": ("array<string>", pa.list_(pa.string()), next_links),
    "issue_links": ("array<struct<url:string,year:int>>", pa.list_(pa.struct([("url", pa.string()), ("year", pa.int32())])), issue_links),
    "question_answer": ("struct<question:string,answer:string>", pa.struct([("question", pa.string()), ("answer", pa.string())]), question_answer),
    "text": ("string", pa.string(), lambda p: " ".join("".join(p.text).split())),
}


def parse(html: Column, url: Column, kind: str) -> Column:
    """One of KINDS from a page; null HTML is an empty page."""
    ddl, arrow, function = KINDS[kind]

    @F.arrow_udf(ddl)
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for pages, urls in bounded(batches):
            yield pa.array([function(Page(h or "", u or "")) for h, u in zip(pages.to_pylist(), urls.to_pylist(), strict=True)], arrow)

    return run(html, url)
