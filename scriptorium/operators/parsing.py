"""Titles, abstracts and sections from TEI documents and from raw HTML.

TEI has mixed content, which the XPath functions of SQL cannot flatten, so one
Python function parses each document once into a struct.  Raw HTML is not well
formed; it is cut with regular expressions inside the JVM.
"""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.plugins import in_parts
from ..schemas import SECTION
from .chunking import NO_HEADING, NO_TITLE

#: Fixed value: the TEI namespace.
TEI = "{http://www.tei-c.org/ns/1.0}"
PARSED = f"struct<title:string,abstract:string,sections:array<{SECTION}>,error:string>"


def _flat(node: ET.Element) -> str:
    return "".join(node.itertext()).strip()


def parse_tei(xml: str, min_text_len: int = 10) -> dict:
    """Title (text before its first child), abstract, and every ``div`` of the
    body in document order with its direct paragraphs; short ones are left out."""
    root = ET.fromstring(xml)
    title = root.find(f".//{TEI}titleStmt/{TEI}title")
    abstract = [t for p in root.iterfind(f".//{TEI}profileDesc/{TEI}abstract//{TEI}p") if (t := _flat(p))]
    sections = []
    body = root.find(f".//{TEI}body")
    for div in body.iter(f"{TEI}div") if body is not None else ():
        head = div.find(f"{TEI}head")
        text = "\n".join(t for p in div.findall(f"{TEI}p") if (t := _flat(p)))
        if len(text) >= min_text_len:
            name = (head.text or "").strip() if head is not None else ""
            sections.append({"head": name or NO_HEADING, "n": head.get("n", "") if head is not None else "", "text": text})
    return {"title": title.text.strip() if title is not None and title.text else NO_TITLE, "abstract": " ".join(abstract), "sections": sections, "error": None}


def tei_struct(min_text_len: int = 10):
    """Column function: one parse of each document; errors stay as data."""

    @F.pandas_udf(PARSED)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for xml in batches:
            for some in in_parts(xml.tolist()):
                rows = []
                for text in some:
                    try:
                        rows.append(parse_tei(text, min_text_len))
                    except ET.ParseError as e:
                        rows.append({"title": None, "abstract": None, "sections": [], "error": str(e)[:200]})
                yield pd.DataFrame(rows, columns=["title", "abstract", "sections", "error"])

    return run.asNondeterministic()  # never evaluated once more for each field


def parsed_papers(papers: DataFrame, min_text_len: int = 10) -> DataFrame:
    return papers.withColumn("p", tei_struct(min_text_len)("tei")).select("arxiv_id", F.length("tei").alias("xml_size"), "p.*")


def section_rows(parsed: DataFrame) -> DataFrame:
    return parsed.select("arxiv_id", F.posexplode("sections").alias("sec_idx", "s")).select("arxiv_id", "sec_idx", "s.head", "s.n", "s.text")


def smoke_report(parsed: DataFrame) -> DataFrame:
    """Sizes of what was parsed, and of each section."""
    sections = F.transform("sections", lambda s: F.struct(s["n"].alias("n"), s["head"].alias("head"), F.length(s["text"]).alias("text_len")))
    return parsed.select("arxiv_id", "title", F.length("abstract").alias("abstract_len"), F.size("sections").alias("num_sections"), sections.alias("sections"), "error")


def manifest_entry(parsed: DataFrame) -> DataFrame:
    """Status row of each paper: ``ok`` with sizes, or the error cut at 200."""
    ok = F.col("error").isNull()
    status = F.when(ok, "ok").otherwise("failed")
    return parsed.select("arxiv_id", status.alias("grobid"), F.left("title", F.lit(200)).alias("title"), F.when(ok, F.size("sections")).alias("num_sections"), F.when(ok, F.col("xml_size")).alias("xml_size"), F.left("error", F.lit(200)).alias("error"))


def untag(html: Column) -> Column:
    return F.trim(F.regexp_replace(html, "<[^>]*>", ""))


def page_fields(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``title, h1, paragraphs, n_links`` of raw pages.

    The article is cut out first: scripts and style sheets may hold text that
    looks like the end of a paragraph.
    """
    article = F.regexp_extract(html_col, r"(?s)<article>(.*?)</article>", 1)
    paragraphs = F.filter(F.transform(F.regexp_extract_all(article, F.lit(r"(?s)<p>(.*?)</p>"), F.lit(1)), untag), lambda p: p != "")
    return pages.select(
        id_col,
        F.regexp_extract(html_col, r"(?s)<title>(.*?)</title>", 1).alias("title"),
        F.regexp_extract(html_col, r"(?s)<h1>(.*?)</h1>", 1).alias("h1"),
        paragraphs.alias("paragraphs"),
        F.regexp_count(html_col, F.lit('href="')).cast("long").alias("n_links"),
    )
