from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tests.llm.data import ROWS, documents, empty
from tokenizers import Tokenizer

from trendloom.llm import bpe, packing

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
ODD = [
    "", "  ", "Été <|endoftext|> won't  \x1c foo\x1d\x1ebar", "'s't're's", "a'b ''s '' 'll", "ΣΑΣ ΑΣ. İstanbul", "é ́x",
    "<|startoftext|><|endoftext|>x<|endoftext", "퟿￿ ٣ 12 a1b2", "日本語テキスト", "\x85\xa0x　y​z", "à" * 50, "ǅ ß ẞ ﬁ",
    "x_y__z", "I'LL 'S don't", "½²③",
]
POOL = ["a", "b", "th", "e", "in", "'", "s", "ö", " ", "<|endoftext|>", "1", "!", "é", "́", "ll"]


def ids_of(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


def agrees(text, words=None):
    ids = ids_of(text)
    packed = bpe.encoded(text, PATH, words)
    assert np.frombuffer(packed, "<u4").tolist() == ids
    decoder = bpe.Decoder(PATH)
    decoded = b"".join(decoder.feed(packed[i : i + 40]) for i in range(0, len(packed), 40))
    assert decoded.decode() == LIBRARY.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(text):
    agrees(text)
    agrees(text, packing.LibraryWordIds(PATH))


def test_random_texts():
    rng = random.Random(1)
    for _ in range(1500):
        agrees("".join(rng.choice(POOL) for _ in range(rng.randint(0, 60))))


def test_small_chunks_and_long_pieces(monkeypatch):
    monkeypatch.setattr(bpe, "CHUNK", 64)
    rng = random.Random(2)
    for pool in (POOL, ["a", "b", "th", "e", "in", "er", "an"], ["!", "'", "-", "*"], ["a", "'", "s"], ["a", " "]):
        for _ in range(12):
            agrees("".join(rng.choice(pool) for _ in range(rng.randint(500, 12_000))))


def test_contractions_across_chunks(monkeypatch):
    monkeypatch.setattr(bpe, "CHUNK", 64)
    rng = random.Random(4)
    for pool in ("'revl", "'rev", "'l!\u3000r"):
        for _ in range(20):
            agrees("".join(rng.choice(pool) for _ in range(rng.randint(500, 6000))))


def test_held_text_is_bounded():
    encoder = bpe.Encoder(PATH)
    sizes = []
    for _ in range(12):
        encoder.feed("thing" * (bpe.CHUNK // 5))
        sizes.append(len(encoder.held) + (len(encoder.piece.open) if encoder.piece else 0))
    assert max(sizes) < 4 * bpe.CHUNK + 4 * encoder.model.lookahead


@pytest.mark.parametrize("word", ["漢字仮名", "각한글", "カ\u3099キ\u3099", "при"])
def test_held_text_is_bounded_without_ascii(word):
    encoder = bpe.Encoder(PATH)
    sizes = []
    for _ in range(10):
        encoder.feed(word * (bpe.CHUNK // len(word)))
        sizes.append(len(encoder.held) + (len(encoder.piece.open) if encoder.piece else 0))
    assert max(sizes) < 6 * bpe.CHUNK + 4 * encoder.model.lookahead


def test_cuts_where_nothing_is_joined(monkeypatch):
    monkeypatch.setattr(bpe, "CHUNK", 64)
    rng = random.Random(6)
    for pool in ("漢字、仮名。", "각\u1100\u1161\u11a8한", "カ\u3099ハ\u309aは", "e\u0301\u0323é\u0344ồ", "\u0f71\u0f73\u0f40\u09c7\u09be\u09d7", "ΣσА\u0306İ"):
        for _ in range(15):
            agrees("".join(rng.choice(pool) for _ in range(rng.randint(300, 3000))))


def test_merges_long_like_short():
    model = bpe.merges(PATH)
    rng = random.Random(3)
    for _ in range(200):
        symbols = [model.inner[rng.choice(b"aeinrsth")] for _ in range(rng.randint(1, 40))]
        assert model.merged(list(symbols)) == model._merged_long(list(symbols))


def test_text_decoder_gives_the_normalized_text():
    text = "Déjà vu, 日本語 won't"
    ids = ids_of(text)
    decoder = bpe.TextDecoder(PATH)
    out = "".join(decoder.feed(ids[i : i + 1]) for i in range(len(ids))) + decoder.feed([], final=True)
    assert out.replace(" ", "") == text.lower().replace(" ", "")


def test_round_trips(spark):
    got = sorted((tuple(r) for r in bpe.round_trips(documents(spark), PATH).collect()), key=repr)
    want = []
    for doc_id, text, *_ in ROWS:
        ids = ids_of(text or "")
        packed = np.array(ids, "<u4").tobytes()
        decoded = LIBRARY.decode(ids, skip_special_tokens=False).encode()
        want.append((doc_id, len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(decoded).hexdigest()))
    assert got == sorted(want, key=repr)
    assert bpe.round_trips(empty(spark), PATH).count() == 0
    assert bpe.tokens(documents(spark), PATH).where("doc_id = 4").first()["ids"] == b""


def test_words_met_again_are_kept(monkeypatch):
    monkeypatch.setattr(bpe, "CACHED_WORDS", 3)
    monkeypatch.setattr(bpe, "LATEST_WORDS", 2)
    words, plain = bpe.WordIds(bpe.merges(PATH)), bpe.WordIds(bpe.merges(PATH))
    for k in (1, 2, 2, 3, 1, 4, 4, 4, 5, 5, 6, 7, 7, 8, 9, 9, 2, 1):
        assert words[f"word{k}'re-{k}"] == plain.piece(f"word") + b"".join(plain.piece(p) for p in (f"{k}", "'re", "-", f"{k}"))
        assert len(words) <= 3 and len(words.latest) + len(words.before) <= 4
