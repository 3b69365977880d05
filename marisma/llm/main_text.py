"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the page.

A page becomes a sequence of leaf blocks: stretches of text between tags that break the flow, each
with its open ancestors.  Inline tags and <br> do not break; scripts, styles and the like hold no
text.  A block's features are the tags and the class and id words of its ancestors, its own tag,
and properties of its text.  Two labels, text and rest; neighbouring labels have weights of their
own; Viterbi finds the best sequence and the blocks labelled as text are the result.

Training pages are written and labelled by `labelled_pages`, a generator of page layouts.  The
weights are fitted by gradient ascent on the conditional likelihood (`fit_field`), on all
sequences at once.

Defined cases: null html counts as empty and gives an empty text; tag soup, unclosed or stray tags
and truncated pages are read as far as they go; a head without its end stops at the first text or tag
that cannot stand in it; a page without any block labelled as text gives an
empty string; repeated rows and null ids are kept; columns of other names are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Container, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template iframe object svg math textarea title head select canvas audio video map".split())
RAW = frozenset("script style textarea title iframe noscript".split())
# what may stand in a head; any other tag, or text, ends one that is still open
HEAD = frozenset("title meta link base script style noscript noframes template".split())
# an opening tag of the first kind ends an open element of the second
CLOSES = {
    **dict.fromkeys("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split(), ("p",)),
    "li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "option": ("option",), "body": ("head",),
}
# a closing end looks no further than this for its start
FENCES = frozenset("ul ol table td th div section article aside main nav header footer form body html blockquote".split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"'=]|=\s*(?:\"[^\"]*\"|'[^']*')|[=\"'])*)(?:>|\Z)", re.S)
_NAMES = re.compile(r"""(?:^|\s)(class|id|role|aria-label|hidden|style)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_WORD = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")


HOMES = ("article", "main")


@dataclass
class Block:
    """text, features of its ancestors, and how many of its characters are links."""

    text: str
    above: list[str]
    linked: int


class Ancestors:
    """Open tags and the words of their names, counted as they open and close, so that features cost the same at any depth.

    With `known`, features that are not in it are not counted.
    """

    def __init__(self, known: Container[str] | None):
        self.known = known
        self.outer: list[str] = []
        self.tags: Counter[str] = Counter()
        self.words: Counter[str] = Counter()
        self.homes: list[Counter[str]] = []  # tags below each open article or main
        self.made: list[str] | None = None

    def _of_use(self, feature: str) -> bool:
        return self.known is None or feature in self.known

    @staticmethod
    def _less(counts: Counter[str], key: str) -> None:
        counts[key] -= 1
        if counts[key] <= 0:
            del counts[key]

    def push(self, tag: str, names: tuple[str, ...]) -> None:
        self.made = None
        for w in names:
            if self._of_use(f"name {w}"):
                self.words[w] += 1
        if tag not in INLINE:
            self.outer.append(tag)
            if self._of_use(f"in {tag}"):
                self.tags[tag] += 1
                if self.homes:
                    self.homes[-1][tag] += 1
            if tag in HOMES:
                self.homes.append(Counter())

    def pop(self, tag: str, names: tuple[str, ...]) -> None:
        self.made = None
        for w in names:
            if w in self.words:
                self._less(self.words, w)
        if tag not in INLINE:
            self.outer.pop()
            if tag in HOMES:
                self.homes.pop()
            if tag in self.tags:
                self._less(self.tags, tag)
                if self.homes:
                    self._less(self.homes[-1], tag)

    def features(self) -> list[str]:
        if self.made is None:
            own = self.outer[-1] if self.outer else "-"
            self.made = [
                "bias", *(f"in {t}" for t in self.tags), *(f"name {w}" for w in self.words), f"own {own}", f"up {' '.join(self.outer[-2:])}",
                "home" if self.homes else "away", *(f"home {t}" for t in (self.homes[-1] if self.homes else ())),
            ]
        return self.made


def _names(attrs: str) -> tuple[str, ...]:
    if "=" not in attrs and "hidden" not in attrs:
        return ()
    found = []
    for key, a, b, c in _NAMES.findall(attrs):
        key, value = key.lower(), (a or b or c).lower()
        if key == "hidden" or key == "style" and "none" in value and "display" in value:
            found.append("hidden")
        elif key != "style":
            found += _WORD.findall(value)
    return tuple(dict.fromkeys(found))


def leaf_blocks(page: str, known: Container[str] | None = None) -> list[Block]:
    """Blocks in page order; known: the features of ancestors that matter, all by default."""
    blocks: list[Block] = []
    around = Ancestors(known)
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    opened: Counter[str] = Counter()
    silent = links = linked = 0
    at = 0

    def flush():
        nonlocal linked
        if parts:
            text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                blocks.append(Block(text, around.features(), linked))
            parts.clear()
        linked = 0

    def drop(to: int):
        nonlocal silent, links
        while len(stack) > to:
            name, names = stack.pop()
            around.pop(name, names)
            opened[name] -= 1
            silent -= name in SILENT
            links -= name == "a"

    def end_head():
        while stack and stack[-1][0] == "head":
            drop(len(stack) - 1)

    size = len(page)
    while at < size:
        m = _TAG.search(page, at)
        text = page[at : m.start()] if m else page[at:]
        if silent and text and not text.isspace():
            end_head()
        if text and not silent:
            parts.append(text)
            if links:
                linked += len(text)
        if m is None:
            break
        at = m.end()
        name = m["name"]
        if name is None:
            if m["cdata"] and not silent:
                parts.append(m["cdata"])
            continue
        name = name.lower()
        if m["end"]:
            if name in INLINE:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == name:
                        drop(k)
                        break
                    if stack[k][0] not in INLINE:
                        break
                continue
            flush()
            for k in range(len(stack) - 1, -1, -1) if opened[name] else ():
                if stack[k][0] == name:
                    drop(k)
                    break
                if stack[k][0] in FENCES and name not in FENCES:
                    break
            continue
        if silent and stack[-1][0] == "head":
            if name in ("html", "head"):
                continue
            if name not in HEAD:
                end_head()
        if name == "br":
            parts.append(" ")
            continue
        if name not in INLINE:
            flush()
            ends = CLOSES.get(name, ())
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in ends:
                    drop(k)
                    break
                if stack[k][0] in FENCES and stack[k][0] not in ends:
                    break
        if name in RAW:
            # no tags inside: read on to its own end
            close = re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
            at = close.end() if close else size
            continue
        attrs = m["attrs"]
        if name in VOID or attrs.endswith("/") and name in ("svg", "math"):
            continue
        stack.append((name, _names(attrs) if attrs else ()))
        around.push(*stack[-1])
        opened[name] += 1
        silent += name in SILENT
        links += name == "a"
    flush()
    return blocks


def block_features(blocks: list[Block]) -> list[list[str]]:
    made = []
    for n, b in enumerate(blocks):
        text, size = b.text, len(b.text)
        share = b.linked / size
        made.append([
            *b.above,
            f"size {min(7, size.bit_length() // 2)}", f"link {0 if share == 0 else 1 if share < 0.5 else 2}",
            f"stop {text[-1] in '.!?…:;\"”»'}", "sign" if text[0] in "©" or "©" in text else "plain",
            "first" if n == 0 else "last" if n == len(blocks) - 1 else "mid",
        ])
    return made


class Field:
    """Weights of one score per feature (text against rest) and of neighbouring labels."""

    def __init__(self, names: dict[str, int], weights: np.ndarray, steps: np.ndarray):
        self.names, self.weights, self.steps = names, weights, steps

    def score(self, features: list[list[str]]) -> list[float]:
        get, w = self.names.get, self.weights
        return [sum(w[i] for f in row if (i := get(f)) is not None) for row in features]

    def decode(self, scores: list[float]) -> list[int]:
        """Viterbi over two labels: 0 rest, 1 text."""
        if not scores:
            return []
        (a, b), (c, d) = self.steps.tolist()
        rest, text, back = 0.0, scores[0], []
        for s in scores[1:]:
            from_rest, from_text = (rest + a, text + c), (rest + b, text + d)
            back.append((int(from_rest[1] > from_rest[0]), int(from_text[1] > from_text[0])))
            rest, text = max(from_rest), max(from_text) + s
        label = int(text > rest)
        labels = [label]
        for step in reversed(back):
            label = step[label]
            labels.append(label)
        return labels[::-1]


def fit_field(pages: list[tuple[list[list[str]], list[int]]], steps: int = 200, decay: float = 0.001, rate: float = 0.25) -> Field:
    """Maximum conditional likelihood, all sequences padded to one length; forward and backward sums in log space."""
    names: dict[str, int] = {}
    for features, _ in pages:
        for row in features:
            for f in row:
                names.setdefault(f, len(names))
    long = max(len(y) for _, y in pages)
    mask = np.zeros((len(pages), long), bool)
    gold = np.zeros((len(pages), long), np.int64)
    where, which = [], []
    for p, (features, y) in enumerate(pages):
        mask[p, : len(y)] = True
        gold[p, : len(y)] = y
        for t, row in enumerate(features):
            where += [p * long + t] * len(row)
            which += [names[f] for f in row]
    where, which = np.array(where), np.array(which)
    w, trans = np.zeros(len(names)), np.zeros((2, 2))
    first, second = [np.zeros_like(w), np.zeros_like(trans)], [np.zeros_like(w), np.zeros_like(trans)]
    both = mask[:, 1:]
    told = np.zeros((2, 2))
    np.add.at(told, (gold[:, :-1][both], gold[:, 1:][both]), 1)
    for n in range(1, steps + 1):
        s = np.zeros((len(pages), long, 2))
        s[:, :, 1] = np.bincount(where, w[which], len(pages) * long).reshape(len(pages), long)
        fore, aft = np.zeros_like(s), np.zeros_like(s)
        fore[:, 0] = s[:, 0]
        for t in range(1, long):
            step = np.logaddexp.reduce(fore[:, t - 1, :, None] + trans, axis=1) + s[:, t]
            fore[:, t] = np.where(mask[:, t, None], step, fore[:, t - 1])
        for t in range(long - 2, -1, -1):
            step = np.logaddexp.reduce(trans + (s[:, t + 1] + aft[:, t + 1])[:, None, :], axis=2)
            aft[:, t] = np.where(mask[:, t + 1, None], step, 0.0)
        total = np.logaddexp.reduce(fore[:, -1], axis=1)
        chance = np.exp(fore + aft - total[:, None, None])[:, :, 1]
        off = np.where(mask, gold - chance, 0.0).ravel()
        grad = [np.bincount(which, off[where], len(names)), told.copy()]
        for t in range(1, long):
            pair = np.exp(fore[:, t - 1, :, None] + trans + (s[:, t] + aft[:, t])[:, None, :] - total[:, None, None])
            grad[1] -= pair[mask[:, t]].sum(axis=0)
        for k, value in enumerate((w, trans)):
            g = grad[k] / len(pages) - decay / 10 * value
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            value += rate * (first[k] / (1 - 0.9**n)) / (np.sqrt(second[k] / (1 - 0.999**n)) + 1e-8)
    return Field(names, w, trans)


# ---------------------------------------------------------------- labelled pages

#: words by which sites mark the parts that are not the article
MARKS = {
    "menu": "nav menu navbar navigation breadcrumb breadcrumbs toc pagination pager tabs",
    "top": "header masthead topbar top branding logo site",
    "foot": "footer foot bottom copyright legal colophon imprint",
    "side": "sidebar side aside widget rail related recommended popular trending more teaser",
    "notice": "cookie cookies notice consent gdpr banner alert popup modal overlay paywall message",
    "advert": "ad ad ads ads advert adverts advertisement advertising sponsor sponsored promo promotion adsense",
    "comment": "comment comments discussion reply replies respond disqus responses reader reactions",
    "form": "form search login newsletter subscribe signup contact",
    "share": "share sharing social buttons follow tools",
}
HOLDERS = "content article post entry story main body text page news blog".split()


def labelled_pages(count: int = 800, seed: int = 7) -> Iterator[tuple[str, list[int]]]:
    """Pages of random layout with the label of each leaf block, in page order."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    maybe = lambda p: rng.random() < p
    letters = "aeiounrtlsdmkpbg"

    def words(a, b):
        return " ".join("".join(pick(letters) for _ in range(int(rng.integers(1, 9)))) for _ in range(int(rng.integers(a, b))))

    def sentence(a, b):
        return words(a, b).capitalize() + pick([".", ".", ".", "", "!", "?"])

    for _ in range(count):
        out: list[str] = []
        labels: list[int] = []

        def block(text, label, tag, out=out, labels=labels):
            out.append(f"<{tag}>{text}</{tag}>" if tag else text)
            labels.append(label)

        def named(tag, kind):
            mark = pick(MARKS[kind].split())
            shape = pick(["{}", "{}-box", "site-{}", "{} wide", "block {}", "{}s", "main-{}", "x-{}-1"]).format(mark)
            return f'<{tag} {pick(["class", "class", "id"])}="{shape}">'

        def part(kind, out=out):
            """A part that is not the article, in one of its usual forms."""
            own = {"menu": "nav", "top": "header", "foot": "footer", "side": "aside", "form": "form"}.get(kind)
            tag = own if own and maybe(0.6) else pick(["div", "section", "aside"] if kind in ("notice", "advert", "comment", "side") else ["div", "ul"][:1])
            out.append(f"<{tag}>" if own == tag and maybe(0.6) else named(tag, kind))
            listed = tag != "ul" and maybe({"menu": 0.7, "side": 0.4, "foot": 0.3, "share": 0.3, "top": 0.2, "comment": 0.3}.get(kind, 0.0))
            if listed:
                out.append("<ul>")
            for _ in range(int(rng.integers(1, 7))):
                if listed:
                    text = sentence(3, 40) if kind == "comment" else words(1, 5)
                    block(f'<a href="/{words(1, 2)}">{text}</a>' if kind != "comment" and maybe(0.9) else text, 0, "li")
                elif kind == "menu" or kind in ("side", "foot", "top", "share") and maybe(0.5):
                    block(f'<a href="/{words(1, 2)}">{words(1, 5)}</a>', 0, pick(["li", "li", "p", "div"]))
                elif kind == "comment":
                    block(sentence(3, 40), 0, pick(["p", "p", "div", "li", "blockquote"]))
                elif kind == "form":
                    block(words(1, 5) + '<input type="text">', 0, pick(["p", "div", "label", "li"]) if maybe(0.9) else "p")
                elif kind == "top":
                    block(words(1, 8), 0, pick(["p", "div", "h1", "h2"]))
                else:
                    block(sentence(2, 30), 0, pick(["p", "div", "h3", "li", ""][: 4 if labels and not out[-1].endswith(">") else 5]))
                    if not out[-1].startswith("<"):
                        break
            out.append("</ul>" * listed + f"</{tag}>")

        out.append("<html><head><title>" + words(2, 6) + "</title><script>var x='<p>no</p>';</script></head><body>")
        # some pages hold little else than the article, and some end with it
        spare, ends = maybe(0.2), maybe(0.35)
        grid = maybe(0.18)
        if grid:  # laid out as a table: a cell for the menu, one for the article, one for the foot
            out.append("<table><tr><td>")
            link = lambda: f'<a href="/{words(1, 2)}">{words(1, 4)}</a>'
            if maybe(0.4):
                block(" ".join(link() for _ in range(int(rng.integers(1, 5)))), 0, "")
            else:
                tag = pick(["p", "div", "li"])
                for _ in range(int(rng.integers(1, 5))):
                    block(link(), 0, tag)
            out.append("</td><td>")
        for kind in () if grid else ("notice", "top", "menu", "advert", "form", "share"):
            if maybe(0.1 if spare else 0.55):
                part(kind)
        wrap = maybe(0.3)
        if wrap:
            out.append(pick(["<div>", '<div class="wrapper">', '<div id="page">', "<main>"]))
        if maybe(0.25) and not grid and not spare:
            part("side")
        home = pick(["article", "article", "article", "article", "main", "div", "section", "bare", "plain"] if not grid else ["bare", "bare", "plain", "div", "article"])
        inner = ""
        if home == "bare":  # nothing around the text
            home = ""
        elif home == "plain":
            home = "div"
            out.append("<div>")
        else:
            inner = "<div>" * int(rng.integers(1, 4)) if maybe(0.3) else pick(["", "", "", '<div class="body">', '<section class="text">', "<section>"])
        late = bool(inner) and maybe(0.5)  # the title stands before the inner wrapper
        if home and out[-1] != "<div>":
            out.append(f"<{home}>" if home in ("article", "main") and maybe(0.7) else f'<{home} {pick(["class", "id"])}="{pick(HOLDERS)}{pick(["", "-body", "-content", " full"])}">')
        out.append("" if late else inner)
        titled = maybe(0.85 if home else 0.5)
        if titled:
            block(sentence(2, 12), 1, pick(["h1", "h1", "h2"]))
        out.append(inner if late else "")
        if maybe(0.2) and not spare:
            part(pick(["share", "advert"]))
        for _ in range(int(rng.integers(0 if titled and home else 2, 12 if maybe(0.7) else 4))):
            form = rng.random() * 1.06
            if form < 0.6:
                opens, closes = pick([("", ""), ("", ""), ("<b>", "</b>"), ("<b>", ""), ('<span class="lead">', "</span>"), ('<a href="/x">', "</a>")])
                text = sentence(1, 60)
                cut = len(text) // 2
                block(text[:cut] + opens + text[cut:] + closes + pick(["", "", "<br>"]), 1, pick(["p", "p", "p", "div"]))
            elif form < 0.67:
                block(sentence(1, 9), 1, pick(["h2", "h3", "h4"]))
            elif form < 0.74:
                list_tag = pick(["ul", "ol"])
                out.append(f"<{list_tag}>")
                for _ in range(int(rng.integers(1, 5))):
                    block(sentence(1, 14), 1, "li")
                out.append(f"</{list_tag}>")
            elif form < 0.79:
                out.append("<blockquote>")
                block(sentence(4, 30), 1, pick(["p", ""]))
                out.append("</blockquote>")
            elif form < 0.82:
                out.append("<table><tr>")
                for _ in range(int(rng.integers(1, 4))):
                    block(words(1, 5), 1, pick(["td", "th"]))
                out.append("</tr></table>")
            elif form < 0.84:
                block(words(3, 20), 1, "pre")
            elif not spare and home:
                part(pick(["advert", "advert", "share", "form", "side", "notice"]))
        if maybe(0.25) and not ends:
            part(pick(["comment", "share", "advert", "form"]))
        out.append("</section>" if "section" in inner else "</div>" * inner.count("<div"))
        out.append(f"</{home}>" if home else "")
        for kind in () if ends or grid else ("comment", "side", "share", "form", "advert", "menu", "notice"):
            if maybe(0.1 if spare else 0.35):
                part(kind)
        if wrap:
            out.append("</div>")
        if grid:
            out.append("</td></tr>")
            if not ends:
                out.append("<tr><td>")
                block(pick(["© ", "Copyright ", ""]) + words(2, 8) + pick([". " + words(2, 5) + ".", "", "."]), 0, pick(["p", "div", ""]))
                out.append("</td></tr>")
            out.append("</table>")
        elif maybe(0.8) and not ends:
            part("foot")
        page = "".join(out)
        yield (page if maybe(0.9) else page.replace("</body>", "")), labels


def training_set(count: int = 800, seed: int = 7) -> list[tuple[list[list[str]], list[int]]]:
    made = []
    for page, labels in labelled_pages(count, seed):
        blocks = leaf_blocks(page)
        if len(blocks) == len(labels) and labels:
            made.append((block_features(blocks), labels))
    return made


def text_of(page: str, field: Field) -> str:
    blocks = leaf_blocks(page, field.names)
    labels = field.decode(field.score(block_features(blocks)))
    return "\n".join(b.text for b, y in zip(blocks, labels, strict=True) if y)


def main_texts(pages: DataFrame, field: Field | None = None) -> DataFrame:
    """page_id, url, text, n_chars; pages: page_id, url, html."""
    shared = pages.sparkSession.sparkContext.broadcast(field or fit_field(training_set()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [text_of(h or "", field) for h in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    names=["page_id", "url", "text", "n_chars"],
                )

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(
        run, "page_id long, url string, text string, n_chars long"
    )
