"""Selector rules of news sites, matched in one tag scan per page: plain Python used inside one Pandas UDF."""

from __future__ import annotations

import sys
from collections.abc import Iterable
from html.parser import HTMLParser
from typing import NamedTuple
from urllib.parse import urlsplit

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

_VOID = {"br", "img", "meta", "link", "input", "hr", "source", "wbr", "area", "base", "col", "embed", "track"}
_UNREAD = {"script", "style"}


class Rule(NamedTuple):
    """Where a field of a site is found; of several rules of a field the first that finds text wins.

    site: host or a domain above it, "" for all; tag: "" for any; name and value: an attribute that must be
    so; take: "text" or the attribute whose value is the answer; inside: an ancestor's tag or .class;
    at_least: shortest text that counts.
    """

    site: str
    field: str
    tag: str
    css: str = ""
    name: str = ""
    value: str = ""
    take: str = "text"
    inside: str = ""
    at_least: int = 1


class _Scan(HTMLParser):
    def __init__(self, rules: list[Rule]):
        super().__init__(convert_charrefs=True)
        self.rules, self.found = rules, [[] for _ in rules]
        self.stack: list[tuple[str, set[str]]] = []
        self.taking: list[tuple[int, int, list[str]]] = []  # depth, rule, pieces of text

    def _within(self, where: str) -> bool:
        return any(where[1:] in css if where[0] == "." else where == tag for tag, css in self.stack)

    def _keep(self, n: int, text: str) -> None:
        text = " ".join(text.split())
        if len(text) >= self.rules[n].at_least:
            self.found[n].append(text)

    def _shut(self, depth: int) -> None:
        """Everything at or below a depth is closed."""
        del self.stack[depth:]
        while self.taking and self.taking[-1][0] >= depth:
            _, n, pieces = self.taking.pop()
            self._keep(n, "".join(pieces))

    def handle_starttag(self, tag, attrs):
        attrs = {k: v or "" for k, v in attrs}
        css = set(attrs.get("class", "").split())
        if tag == "p" and (opened := [i for i, (t, _) in enumerate(self.stack) if t == "p"]):
            self._shut(opened[0])  # a paragraph cannot hold another
        if tag == "br":
            self.handle_data(" ")
        hits = [
            n for n, r in enumerate(self.rules)
            if r.tag in ("", tag) and (not r.css or r.css in css) and (not r.name or attrs.get(r.name) == r.value) and (not r.inside or self._within(r.inside))
        ]
        for n in hits:
            if self.rules[n].take != "text":
                self._keep(n, attrs.get(self.rules[n].take, ""))
        if tag not in _VOID:
            self.taking += [(len(self.stack), n, []) for n in hits if self.rules[n].take == "text"]
            self.stack.append((tag, css))

    def handle_endtag(self, tag):
        opened = [i for i, (t, _) in enumerate(self.stack) if t == tag]
        if opened:
            self._shut(opened[-1])

    def handle_data(self, data):
        if self.taking and not (self.stack and self.stack[-1][0] in _UNREAD):
            for _, _, pieces in self.taking:
                pieces.append(data)


FIELDS = ("titulo", "autor", "fecha", "subtitulo", "cuerpo")


def rules_for(url: str | None, rules: Iterable[Rule]) -> list[Rule]:
    """The rules of a page's site and those of all sites."""
    try:
        host = (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        host = ""
    return [r for r in rules if not r.site or host == r.site or host.endswith("." + r.site)]


def shortest_paragraph(url: str | None, rules: Iterable[Rule]) -> int:
    """Of the paragraphs that the body rules of the page's own site take; 0 without such rules."""
    return min((r.at_least for r in rules_for(url, rules) if r.site and r.field == "cuerpo"), default=0)


def scan_site(html: str | None, url: str | None, rules: Iterable[Rule]) -> dict:
    """The fields of one page; cuerpo is a list of paragraphs, the others are one text or None."""
    mine = rules_for(url, rules)
    scan = _Scan(mine)
    scan.feed(html or "")
    scan.close()
    scan._shut(0)
    out: dict = dict.fromkeys(FIELDS)
    for rule, texts in zip(mine, scan.found, strict=True):
        if texts and not out[rule.field]:
            out[rule.field] = texts if rule.field == "cuerpo" else texts[0]
    return out


def site_fields(html: Column, url: Column, rules: list[Rule]) -> Column:
    """A struct of the fields that the rules find, and minimo, the shortest paragraph that the site's own take."""

    @F.pandas_udf("titulo string, autor string, fecha string, subtitulo string, cuerpo array<string>, minimo int")
    def scan(pages: pd.Series, links: pd.Series) -> pd.DataFrame:
        found = pd.DataFrame([scan_site(p, u, rules) for p, u in zip(pages, links, strict=True)], columns=list(FIELDS))
        return found.assign(minimo=[shortest_paragraph(u, rules) for u in links])

    return scan(html, url)


# ship this module inside the closure: executors need no installed package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
