"""Byte-pair encoding and decoding with forced boundaries.

No merge can cross a pair of bytes that stands in no token of the vocabulary, for the merged
symbol would have to be such a token.  So a text may be cut at those pairs, each fragment encoded
alone, and the ids joined.  Two kinds of cut are used, both read off the vocabulary file:

* white space is in no token: a text is cut there first, and fragments repeat so often that most
  are met already encoded;
* inside a pre-token, at every byte pair that no token holds; the pair that closes a word counts by
  itself, since the last symbol carries the word's end.

The normaliser, the pre-tokeniser and the merging of fragments are those of the tokenizer file.

Defined cases: null text counts as empty and has no ids; special tokens in a text become their ids,
as in the library; other columns are ignored; an empty table gives no rows.  A long text is one row of
work; only its ids are held at once, and a fragment without a forced cut costs n log n in its symbols.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


def ascii_words(spec: dict) -> re.Pattern | None:
    """The file's split rule as it reads lower-case ASCII; none where the file splits or folds in another way."""
    pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer") or {}
    splits = [p for p in pre.get("pretokenizers", [pre]) if p.get("type") == "Split"]
    folds = any(n.get("type") == "Lowercase" for n in norm.get("normalizers", [norm]))
    if len(splits) != 1 or not folds or not splits[0]["invert"] or "Regex" not in splits[0]["pattern"]:
        return None
    rule = splits[0]["pattern"]["Regex"]
    for group, signs in ((r"\p{L}", "a-z"), (r"\p{N}", "0-9"), (r"\s", r" \t-\r")):
        rule = rule.replace(group, signs)
    return None if r"\p" in rule else re.compile(rule)


class Encoder:
    """One tokenizer file; fragments met before are kept, up to `kept` of them or `kept_bytes`, and a quarter as many of their pieces."""

    def __init__(self, path: str, kept: int = 250_000, kept_bytes: int = 96 << 20):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        library = Tokenizer.from_file(path)
        self.normalise = library.normalizer.normalize_str
        self.pretokens = library.pre_tokenizer.pre_tokenize_str
        self.whole = library.model.tokenize
        self.suffix = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_at = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.text_of = [b""] * (max(*self.vocab.values(), *self.special.values()) + 1)
        for token, i in chain(self.vocab.items(), self.special.items()):
            self.text_of[i] = token.encode()
        self.decimal_of = [str(i).encode() for i in range(len(self.text_of))]
        self.ascii_words = ascii_words(spec)
        self.symbol = byte_symbols()
        self.shown = dict(enumerate(self.symbol[:128]))
        self.inner, self.closing = self.joined_pairs()
        self.stop = {c: next(x for x in self.symbol if c + x not in self.closing and x + self.suffix in self.vocab) for c in self.symbol}
        self.kept, self.kept_bytes, self.held = kept, kept_bytes, 0
        self.known, self.pieces = {}, {}

    def joined_pairs(self) -> tuple[set[str], set[str]]:
        """Neighbouring symbols that some token holds: inside a word, and at its end."""
        inner, closing = set(), set()
        for token in self.vocab:
            ends = bool(self.suffix) and token.endswith(self.suffix)
            body = token[: -len(self.suffix)] if ends else token
            pairs = [body[i : i + 2] for i in range(len(body) - 1)]
            if ends and pairs:
                closing.add(pairs.pop())
            inner.update(pairs)
        return inner, closing if self.suffix else inner

    def cut(self, word: str) -> list[tuple[str, bool]]:
        """(fragment, whether it ends the word) between forced boundaries."""
        out, start = [], 0
        last = len(word) - 2
        inner = self.inner
        for i, pair in enumerate(map(str.__add__, word, word[1:])):
            if pair not in inner if i < last else pair not in self.closing:
                out.append((word[start : i + 1], False))
                start = i + 1
        out.append((word[start:], True))
        return out

    def merge(self, piece: tuple[str, bool]) -> list[int]:
        """Ids of a fragment by the file's own model, n log n in its symbols.

        The model closes what it is given as a word.  A fragment that ends none gets one more symbol, of which no
        token holds the pair with the fragment's last: it stays apart, takes the word's end, and goes.
        """
        if piece[1]:
            return [t.id for t in self.whole(piece[0])]
        found = self.pieces.get(piece[0])
        if found is None:
            found = [t.id for t in self.whole(piece[0] + self.stop[piece[0][-1]])][:-1]
            if len(piece[0]) <= 256:
                if len(self.pieces) >= self.kept // 4:
                    self.pieces.clear()
                self.pieces[piece[0]] = found
        return found

    def fragment(self, raw: bytes) -> tuple[int, ...]:
        """Ids of a stretch without ASCII white space."""
        text, ids = raw.decode(), []
        parts = self.special_at.split(text) if "<|" in text else [text]
        for part in parts:
            if part in self.special:
                ids.append(self.special[part])
                continue
            if self.ascii_words and part.isascii():
                words = self.ascii_words.findall(part.lower())
                if not part.isprintable():
                    words = [w.translate(self.shown) for w in words]
            else:
                words = [w for w, _ in self.pretokens(self.normalise(part))]
            for word in words:
                for piece in self.cut(word):
                    ids += self.merge(piece)
        return tuple(ids)

    def encode(self, text: bytes) -> list[int]:
        known = self.known
        words = text.split()  # at ASCII white space
        for w in set(words).difference(known):
            ids = self.fragment(w)
            self.held += len(w) + 36 * len(ids)
            if len(known) >= self.kept or self.held > self.kept_bytes:
                known, self.held = {}, len(w) + 36 * len(ids)
                self.known = known
            known[w] = ids
        try:
            return list(chain.from_iterable(map(known.__getitem__, words)))
        except KeyError:  # the table was emptied on the way
            return [i for w in words for i in (known.get(w) or self.fragment(w))]

    def decode(self, ids: list[int]) -> bytes:
        """As the library does for a file without a decoder: the tokens, with a blank between."""
        return b" ".join(map(self.text_of.__getitem__, ids))

    def read(self, ids: list[int]) -> str:
        """The normalised text: bytes put together again, a blank after each word."""
        back = {s: b for b, s in enumerate(self.symbol)}
        out = bytearray()
        for i in ids:
            token = self.text_of[i].decode()
            if i in self.special.values():
                out += self.text_of[i]
                continue
            ends = bool(self.suffix) and token.endswith(self.suffix)
            out += bytes(back[c] for c in (token[: -len(self.suffix)] if ends else token)) + b" " * ends
        return out.decode("utf-8", "replace").strip()


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per worker process and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


_TYPES = {"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}


def map_ids(docs: DataFrame, path: str, fields: str, make: Callable[[Encoder, list[int]], tuple], rows: int = 256) -> DataFrame:
    """docs (text and any others named in fields' place) with columns made of each text's ids."""
    names, types = zip(*(f.split() for f in fields.split(",")), strict=True)
    kept = [f for f in docs.schema.fields if f.name not in ("text", *names)]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                made = [make(enc, enc.encode((t or "").encode())) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(f.name) for f in kept), *(pa.array(c, _TYPES[t]) for c, t in zip(zip(*made, strict=True), types, strict=True))], names=[*(f.name for f in kept), *names]
                )

    return docs.select(*[f"`{f.name}`" for f in kept], F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def encode_texts(docs: DataFrame, path: str) -> DataFrame:
    """docs without text, with ids."""
    return map_ids(docs, path, "ids array<int>", lambda enc, ids: (ids,))


def decode_ids(rows: DataFrame, path: str) -> DataFrame:
    """rows with ids, to which `decoded` (the tokens) and `plain` (the normalised text) are added."""
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields), "decoded string, plain string"])

    def run(batches):
        enc = encoder(path)
        for batch in batches:
            ids = [x or [] for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([enc.decode(x).decode() for x in ids], pa.string()), pa.array([enc.read(x) for x in ids], pa.string())],
                names=[*batch.schema.names, "decoded", "plain"],
            )

    return rows.mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""

    def digest(enc: Encoder, ids: list[int]) -> tuple[int, str, str]:
        return (
            len(ids), hashlib.sha256(b" ".join(map(enc.decimal_of.__getitem__, ids))).hexdigest(),
            hashlib.sha256(enc.decode(ids)).hexdigest(),
        )

    return map_ids(docs.select("doc_id", "text"), path, "n_tokens long, ids_sha256 string, decoded_sha256 string", digest)
