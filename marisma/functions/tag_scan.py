"""Tag scanner for paragraph blocks: plain Python used inside one Arrow iterator."""

from __future__ import annotations

from html.parser import HTMLParser

from pyspark import cloudpickle

_VOID = {"br", "img", "meta", "link", "input", "hr", "source", "wbr", "area", "base", "col", "embed", "track"}


class _Scanner(HTMLParser):
    def __init__(self, tags, class_parts, drop):
        super().__init__(convert_charrefs=True)
        self.tags, self.class_parts, self.drop = set(tags), class_parts, drop
        self.stack, self.dropped = [], 0
        self.n_blocks, self.n_paragraphs = 0, 0
        self.open_p, self.rows = None, []

    def _is_block(self, tag, attrs):
        names = attrs.get("class") or ""
        by_class = tag in ("div", "section") and any(part in names for part in self.class_parts)
        by_prop = tag in ("div", "section") and attrs.get("itemprop") == "articleBody"
        return tag in self.tags or by_class or by_prop

    def _close_p(self):
        if self.open_p is not None:
            words = " ".join("".join(self.open_p).split())
            if words:
                self.n_paragraphs += 1
                blocks = [(b, c) for _, b, c in self.stack if b] or [(0, "")]
                self.rows += [(b, c, self.n_paragraphs, words) for b, c in blocks]
            self.open_p = None

    def handle_starttag(self, tag, attrs):
        if tag in _VOID:
            if self.open_p is not None:
                self.open_p.append(" ")
            return
        attrs = dict(attrs)
        if tag == "p":
            self._close_p()
            self.open_p = []
            return
        block = 0
        if self._is_block(tag, attrs):
            self.n_blocks += 1
            block = self.n_blocks
        self.stack.append((tag, block, attrs.get("class") or ""))
        self.dropped += tag in self.drop

    def handle_endtag(self, tag):
        if tag == "p":
            self._close_p()
            return
        if any(t == tag for t, _, _ in self.stack):
            if any(b for t, b, _ in self.stack if t == tag) or tag in ("div", "section", "body", "html"):
                self._close_p()
            while self.stack:
                top, _, _ = self.stack.pop()
                self.dropped -= top in self.drop
                if top == tag:
                    break

    def handle_data(self, data):
        if self.open_p is not None and not self.dropped:
            self.open_p.append(data)


def scan_paragraphs(html, tags, class_parts, drop):
    """Rows (block, classes of the block, order, text) of every paragraph inside a block."""
    scanner = _Scanner(tags, class_parts, drop)
    scanner.feed(html)
    scanner.close()
    scanner._close_p()
    rows = scanner.rows
    return [r for r in rows if r[0]] or rows


import sys  # noqa: E402

# ship this module inside the closure: executors need no installed package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
