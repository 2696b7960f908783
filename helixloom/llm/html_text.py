"""Main text of web pages by host consensus.

Each page's containers are scored by the text they hold outside menus, adverts and the like; the page votes for the generalised
tag-class path of its best one. Votes are summed per host in Spark, and every page is extracted again with its host's winning
path. A page without that path falls back on its own best container.
"""

from __future__ import annotations

import html as entities
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..session import cut_lineage
from .urls import host_and_path

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "textarea", "title", "noscript", "iframe", "template", "svg")}
VOID = set("area base br col embed hr img input link meta source track wbr".split())
CONTAINERS = set("html body div section article main td center blockquote".split())
BLOCKS = CONTAINERS | set("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tbody thead tfoot tr th caption pre hr address figure figcaption details summary fieldset nav header footer aside form head".split())
SKIPPED = set("nav footer aside form head select button menu dialog object audio video canvas".split())
# what a start tag ends if it is open: it and what is open inside it
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
# name parts of boilerplate in class, id and role
BOILERPLATE = set("""ad ads adbox advert adverts advertisement advertising banner sponsor sponsored promo promotion menu nav navbar navigation breadcrumb breadcrumbs
sidebar aside footer masthead topbar cookie cookies consent gdpr notice alert popup modal overlay subscribe subscription newsletter signup login comment comments
disqus reply replies share sharing social related recommended recommendations widget toolbar pagination pager tags copyright disclaimer complementary contentinfo search form""".split())
WORD = re.compile(r"[a-z]+|\d+")


def _attributes(text: str) -> dict[str, str]:
    return {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(text)} if "=" in text else {}


def _step(tag: str, attributes: dict[str, str]) -> str:
    """Tag and classes with their numbers generalised."""
    names = sorted({re.sub(r"\d+", "#", c) for c in attributes.get("class", "").lower().split()})
    return ".".join([tag, *names])


def _is_boilerplate(tag: str, attributes: dict[str, str], in_article: bool) -> bool:
    if tag in SKIPPED or tag == "header" and not in_article:
        return True
    if "hidden" in attributes or tag in ("html", "body", "article", "main"):
        return False
    names = " ".join(attributes.get(a, "") for a in ("class", "id", "role"))
    return any(w in BOILERPLATE for w in WORD.findall(names.lower())) if names.strip() else False


class Page:
    """Blocks of text in page order with the container they are in; boilerplate is left out."""

    def __init__(self, source: str | None):
        self.paths, self.parents = ["html"], [-1]  # of the containers
        self.blocks: list[tuple[int, str, int]] = []  # container, text, characters inside links
        self._parse(source or "")

    def _parse(self, s: str) -> None:
        stack = [("html", 0, False, False)]  # tag, container, skipped, inside an article
        words: list[str] = []
        link = 0
        at, n = 0, len(s)

        def flush():
            nonlocal link
            if words:
                text = " ".join("".join(words).split())
                if text:
                    self.blocks.append((stack[-1][1], text, min(link, len(text))))
                words.clear()
            link = 0

        def say(text):
            nonlocal link
            if text and not stack[-1][2]:
                text = entities.unescape(text)
                words.append(text)
                if any(e[0] == "a" for e in stack[-4:]):
                    link += len(text)

        while at < n:
            m = TAG.search(s, at)
            if m is None:
                rest = s[at:]
                say(re.sub(r"<[a-zA-Z/!][^>]*\Z", "", rest))  # a tag that the page's end has cut
                break
            say(s[at:m.start()])
            at = m.end()
            if m[2] is None:
                continue
            tag = m[2].lower()
            if m[1]:  # end tag
                if tag in BLOCKS:
                    flush()
                elif tag == "br":
                    words.append(" ")
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == tag:
                        del stack[k:]
                        break
                    if stack[k][0] in CONTAINERS and tag not in CONTAINERS and tag not in SKIPPED and tag != "header":
                        break
                continue
            if tag in RAW:
                end = RAW[tag].search(s, at)
                at = end.end() if end else n
                continue
            if tag == "br":
                words.append(" ")
                continue
            if tag in VOID:
                if tag == "hr":
                    flush()
                continue
            if tag in BLOCKS:
                flush()
                ends = ENDS.get(tag, set()) | {"p"}
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] in ends:
                        del stack[k:]
                        break
                    if stack[k][0] in CONTAINERS or stack[k][0] in ("ul", "ol", "table", "dl"):
                        break
            if tag == "body" or tag == "html":
                if tag == "body" and all(e[0] != "body" for e in stack):
                    del stack[1:]  # a head left open
                else:
                    continue
            attributes = _attributes(m[3])
            _, box, skipped, inside = stack[-1]
            skipped = skipped or _is_boilerplate(tag, attributes, inside)
            if tag in CONTAINERS and not skipped:
                self.paths.append(f"{self.paths[box]}/{_step(tag, attributes)}")
                self.parents.append(box)
                box = len(self.paths) - 1
            if not m[3].endswith("/") or tag in BLOCKS:
                stack.append((tag, box, skipped, inside or tag in ("article", "main")))
        flush()

    def scores(self) -> list[int]:
        """Text outside links that each container holds, inner containers included."""
        score = [0] * len(self.paths)
        for box, text, link in self.blocks:
            score[box] += len(text) - link
        for box in range(len(score) - 1, 0, -1):
            score[self.parents[box]] += score[box]
        return score

    def best(self) -> str | None:
        """Path of the best container: the article, else the main element, that holds a quarter of the text or more, else the innermost
        container that keeps nine tenths of it. None without text."""
        score = self.scores()
        if not score[0]:
            return None
        for tag in ("article", "main"):
            named = [b for b, p in enumerate(self.paths) if p.rpartition("/")[2].split(".")[0] == tag and 4 * score[b] >= score[0]]
            if named:
                return self.paths[max(named, key=lambda b: (score[b], -b))]
        box = 0
        while True:
            inner = [b for b, p in enumerate(self.parents) if p == box and 10 * score[b] >= 9 * score[box]]
            if not inner:
                return self.paths[box]
            box = inner[0]

    def text(self, path: str | None) -> str:
        """Blocks inside the containers at ``path``, in page order; at the page's own best path if it has none there."""
        chosen = {b for b, p in enumerate(self.paths) if p == path}
        if not chosen:
            own = self.best()
            chosen = {b for b, p in enumerate(self.paths) if p == own}
        for b, p in enumerate(self.parents):
            if p in chosen:
                chosen.add(b)
        return "\n".join(text for box, text, _ in self.blocks if box in chosen)


@F.pandas_udf(StringType())
def best_path_udf(pages: pd.Series) -> pd.Series:
    return pages.map(lambda s: Page(s).best())


@F.pandas_udf(StringType())
def text_udf(pages: pd.Series, paths: pd.Series) -> pd.Series:
    return pd.Series([Page(s).text(p) for s, p in zip(pages, paths)], dtype=object)


def host_paths(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(_host, path, votes): each host's winning path; ties go to the longer path, then in text order. Pages without text don't vote; all urls
    without a host vote together."""
    votes = pages.select(host_and_path(F.col(f"`{url}`"))[0].alias("_host"), best_path_udf(F.col(f"`{html}`")).alias("path")).where("path IS NOT NULL")
    votes = votes.groupBy("_host", "path").agg(F.count("*").alias("votes"))
    best = votes.groupBy("_host").agg(F.max(F.struct("votes", F.length("path").alias("n"), "path")).alias("b"))
    return cut_lineage(best.select("_host", "b.path", "b.votes"))


def extract(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text, path), one row for each input row: blocks joined by a newline, white space inside a block made one space.

    Null and empty pages have an empty text. Broken markup is read as far as it goes. A host with a third of all pages is summed
    before the shuffle; the winners are joined back to rows whose hot hosts adaptive execution may split.
    """
    rows = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url}`").alias("url"), F.col(f"`{html}`").alias("_html"))
    won = host_paths(rows, "url", "_html").select("_host", "path")
    joined = rows.withColumn("_host", host_and_path(F.col("url"))[0]).join(won, "_host", "left")
    return joined.select("page_id", "url", text_udf("_html", "path").alias("text"), "path")
