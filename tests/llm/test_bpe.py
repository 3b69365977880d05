from __future__ import annotations

import hashlib
import json
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from marisma.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def texts():
    rng = random.Random(5)
    signs = "abcdeXYZ'stredvml0123456789 \t\n\x0b\x0c\r\x1c\x85\xa0.,!?%&<|>éÉßİΣσς́ñ中文한ﬁ½Ⅷ​😀👩‍👩‍👧́  "
    made = ["".join(rng.choice(signs) for _ in range(rng.randrange(0, 60))) for _ in range(600)]
    return made + [
        "", " ", "don't we'll I'M they've it's o'er", "<|startoftext|>hello<|endoftext|>", "a<|endoftext|>b <|EndOfText|> <|startoftext", "!'s 's!'s ''s",
        "Internationalization antidisestablishmentarianism", "ΑΣ ΟΔΟΣ", "é é ẹ́", "x" * 3000, "the&&&  in%%%", "￾￿\x00\x01", "ſt ﬀ", "1234 5a6 ²³",
    ]


def test_ids_and_decoding_equal_the_library(library):
    enc = bpe.Encoder(PATH)
    for t in texts():
        want = library.encode(t, add_special_tokens=False).ids
        got = enc.encode(t.encode())
        assert got == want, t
        assert enc.decode(got).decode() == library.decode(want, skip_special_tokens=False), t


def test_a_small_table_of_known_fragments_changes_nothing(library):
    enc = bpe.Encoder(PATH, kept=3)
    for t in texts()[:80]:
        assert enc.encode(t.encode()) == library.encode(t, add_special_tokens=False).ids


def test_a_long_fragment_without_a_cut_equals_the_library(library):
    """The fragment ends before a forced cut, so it is merged here: a million symbols, in n log n."""
    enc = bpe.Encoder(PATH)
    rng = random.Random(3)
    tokens = [t for t in enc.vocab if t.isascii() and t.isalpha() and len(t) > 3]
    for body in ("ab" * 500_000, "a" * 50_001, "".join(rng.choice(tokens) for _ in range(2_000)), "".join(rng.choice("aeinrst") for _ in range(20_000))):
        text = body + "qzx"
        assert any(len(piece) > 10 and not ends for piece, ends in enc.cut(text))
        assert enc.encode(text.encode()) == library.encode(text, add_special_tokens=False).ids


def test_a_small_store_of_bytes_changes_nothing(library):
    enc = bpe.Encoder(PATH, kept_bytes=200)
    for t in texts()[:80]:
        assert enc.encode(t.encode()) == library.encode(t, add_special_tokens=False).ids
        assert sum(map(len, enc.known)) < 400


def test_a_file_with_another_split_rule_goes_by_the_library(tmp_path):
    spec = json.load(open(PATH, encoding="utf-8"))
    spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] = r"\p{Lu}+|\p{L}+|\p{N}+|[^\s\p{L}\p{N}]+"
    other = tmp_path / "other.json"
    other.write_text(json.dumps(spec), encoding="utf-8")
    enc, library = bpe.Encoder(str(other)), Tokenizer.from_file(str(other))
    assert enc.ascii_words is None
    for t in ("It's 1234 o'clock", "don't", "a1b22"):
        assert enc.encode(t.encode()) == library.encode(t, add_special_tokens=False).ids


def test_no_token_holds_a_forced_boundary():
    enc = bpe.Encoder(PATH)
    for token in enc.vocab:
        ends = token.endswith(enc.suffix)
        body = token[: -len(enc.suffix)] if ends else token
        if ends and body:
            assert enc.cut(body) == [(body, True)]
    assert any(len(enc.cut(w)) > 1 for w in ("zqxj", "qqqq", "xzzv"))


def test_reading_ids_gives_the_normalised_text():
    enc = bpe.Encoder(PATH)
    assert enc.read(enc.encode("Hello,  Wörld! 中".encode())) == "hello , wörld ! 中"


def test_rows(spark, library):
    rows = [(1, "Hello there", "x"), (None, None, None), (3, "", "y"), (3, "", "y"), (4, "very long " * 30_000, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids_sha256 string")
    got = sorted((tuple(r) for r in bpe.round_trip(df, PATH).collect()), key=str)
    want = []
    for i, t, _ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert got == sorted(want, key=str)
    both = bpe.decode_ids(bpe.encode_texts(df.select("doc_id", "text"), PATH), PATH).filter("doc_id = 1").first()
    assert both.plain == "hello there" and both.decoded == "hello</w> there</w>"
    assert bpe.round_trip(df.limit(0), PATH).collect() == []
