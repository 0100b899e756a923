"""Byte-pair encoding as a streaming transducer with bounded lookahead, and its decoder.

Text arrives in chunks of any size. What follows a boundary between two tokens can move it only
through a chain of overlapping merges of ever higher priority; the longest such chain in the merge
list bounds how far one has to look ahead (`Merges.lookahead`). Tokens with so many symbols behind
them are final and leave at once, so that the memory in use depends on the merge list, not on the
text. White space always ends a piece; words seen before come from a bounded cache.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import struct
import unicodedata
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from trendloom.llm.common import ids_of, map_arrow

#: Characters of a text that are taken at a time.
CHUNK = 1 << 16
#: Words kept with their ids by a worker.
CACHED_WORDS, LATEST_WORDS = 200_000, 50_000
#: Symbols from which a piece is encoded as a stream.
LONG_PIECE = 512
_SPACES = "\t\n\v\f\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SPACE_RUN = regex.compile(f"[{_SPACES}]+")
_PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+".replace(r"\s", _SPACES))
_ID, _NONE = (1 << 32) - 1, 1 << 60
_ODD_SPACE = regex.compile("[\x1c-\x1f]")
_LETTERS = regex.compile(r"\p{L}+")
_OTHERS = regex.compile(r"[^\s\p{L}\p{N}]+".replace(r"\s", _SPACES))


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, free = [""] * 256, 256
    for b in range(256):
        out[b] = chr(b) if b in shown else chr(free)
        free += b not in shown
    return out


class Merges:
    """A vocabulary and merge list with an end-of-word suffix, as read from a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix: str = model["end_of_word_suffix"]
        self.vocab: dict[str, int] = model["vocab"]
        self.special: dict[str, int] = {x["content"]: x["id"] for x in spec["added_tokens"]}
        chars = byte_characters()
        self.inner = [self.vocab[c] for c in chars]
        self.final = [self.vocab[c + self.suffix] for c in chars]
        #: left id and right id in one number -> rank and merged id in one number
        self.pairs: dict[int, int] = {}
        for rank, (a, b) in enumerate(map(tuple, model["merges"])):
            self.pairs.setdefault(self.vocab[a] << 32 | self.vocab[b], rank << 32 | self.vocab[a + b])
        self.lookahead = self._sufficient_lookahead([tuple(m) for m in model["merges"]])

    def _sufficient_lookahead(self, merges: list[tuple[str, str]]) -> int:
        """Symbols behind a boundary after which nothing that follows can move it.

        A merge is undone only by one of higher priority that overlaps it and reaches further
        right. reach[s]: how far merges so far can reach behind a symbol string s, which is the
        start of what they make; a merge reaches as far as the best of its own ends s.
        """
        reach: dict[str, int] = {}
        most = 0
        for a, b in merges:
            whole = a + b
            if whole.endswith(self.suffix):  # the last symbol with its suffix is one symbol
                symbols = whole[: -len(self.suffix)]
                symbols = symbols[:-1] + chr(0x10000 + ord(symbols[-1]))
            else:
                symbols = whole
            n = len(symbols)
            own = max((reach.get(symbols[i:], 0) for i in range(n)), default=0)
            most = max(most, own + n)
            for i in range(1, n):
                s, far = symbols[:i], own + n - i
                if reach.get(s, 0) < far:
                    reach[s] = far
        return most

    def merged(self, ids: list[int]) -> list[int]:
        """Apply the merges to symbols, the best rank first and the leftmost of equals."""
        if len(ids) > 40:
            return self._merged_long(ids)
        get = self.pairs.get
        found = [get(a << 32 | b, _NONE) for a, b in zip(ids, ids[1:])]
        while found:
            best = min(found)
            if best == _NONE:
                break
            i, made = found.index(best), best & _ID
            ids[i : i + 2] = (made,)
            del found[i]
            if i < len(found):
                found[i] = get(made << 32 | ids[i + 1], _NONE)
            if i:
                found[i - 1] = get(ids[i - 1] << 32 | made, _NONE)
        return ids

    def _merged_long(self, ids: list[int]) -> list[int]:
        pairs, n = self.pairs, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(p >> 32, i, p & _ID, ids[i], ids[i + 1]) for i in range(n - 1) if (p := pairs.get(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        ids = [*ids, -1]
        while heap:
            _, i, made, left, right = heapq.heappop(heap)
            j = after[i] if ids[i] == left else n
            if j >= n or ids[j] != right:
                continue
            ids[i], ids[j] = made, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if (p := pairs.get(made << 32 | ids[after[i]])) is not None:
                    heapq.heappush(heap, (p >> 32, i, p & _ID, made, ids[after[i]]))
            if (k := before[i]) >= 0 and (p := pairs.get(ids[k] << 32 | made)) is not None:
                heapq.heappush(heap, (p >> 32, k, p & _ID, ids[k], made))
        return [x for x in ids if x >= 0]

    @property
    def texts(self) -> list[str]:
        """The text of every id."""
        out = [""] * (1 + max(*self.vocab.values(), *self.special.values()))
        for text, i in [*self.vocab.items(), *self.special.items()]:
            out[i] = text
        return out


@cache
def merges(path: str) -> Merges:
    """The merge list of a file, read once by a worker."""
    return Merges(path)


class PieceStream:
    """Encodes one piece that arrives in parts; holds back what may still change."""

    def __init__(self, model: Merges):
        self.model, self.open = model, b""

    def feed(self, part: bytes) -> list[int]:
        self.open += part
        out: list[int] = []
        hold = self.model.lookahead + 1
        if len(self.open) < 2 * hold + CHUNK:
            return out
        ids = self.model.merged([self.model.inner[b] for b in self.open])
        done, k = 0, 0
        sizes = _sizes(self.model)
        while done + sizes[ids[k]] <= len(self.open) - hold:
            done += sizes[ids[k]]
            k += 1
        self.open = self.open[done:]
        return ids[:k]

    def finish(self) -> list[int]:
        rest, self.open = self.open, b""
        if not rest:
            return []
        return self.model.merged([*(self.model.inner[b] for b in rest[:-1]), self.model.final[rest[-1]]])


@cache
def _sizes_of(path_id: int, model: Merges) -> list[int]:
    return [len(t.removesuffix(model.suffix)) for t in model.texts]


def _sizes(model: Merges) -> list[int]:
    return _sizes_of(id(model), model)


class WordIds(dict):
    """Words without white space, each with its packed ids.

    A word is kept for long when it is met again while it is among the latest ones, so words seen
    once don't displace others. Both stores are emptied when full, the latest words by halves.
    """

    def __init__(self, model: Merges):
        self.model = model
        self.latest: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        out = self.latest.get(word)
        if out is None:
            out = self.before.get(word)
        if out is not None:
            if len(self) >= CACHED_WORDS:
                self.clear()
            self[word] = out
            return out
        found = [word] if word.isascii() and word.isalpha() else _PIECE.findall(word)
        out = self.piece(word) if found == [word] else b"".join(map(self.__getitem__, found))
        if len(word) <= 64:
            if len(self.latest) >= LATEST_WORDS:
                self.latest, self.before = {}, self.latest
            self.latest[word] = out
        return out

    def piece(self, text: str) -> bytes:
        raw = text.encode("utf-8", "surrogatepass")
        if len(raw) >= LONG_PIECE:
            stream = PieceStream(self.model)
            ids = stream.feed(raw) + stream.finish()
        else:
            inner = self.model.inner
            ids = self.model.merged([*map(inner.__getitem__, raw[:-1]), self.model.final[raw[-1]]])
        return struct.pack(f"<{len(ids)}I", *ids)


@cache
def _word_ids(path: str) -> WordIds:
    return WordIds(merges(path))


@cache
def _second_halves() -> frozenset[str]:
    """Characters that a composition joins to the one before: the second parts of canonical pairs, and Hangul vowels and finals."""
    pairs = (unicodedata.decomposition(chr(c)).split() for c in range(0x110000))
    seconds = {chr(int(p[1], 16)) for p in pairs if len(p) == 2 and not p[0].startswith("<")}
    return frozenset(seconds | {chr(c) for c in (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))})


def starts_anew(char: str) -> bool:
    """Whether text may be normalized apart before this character."""
    if char.isascii():
        return True
    first = unicodedata.normalize("NFD", char)[0]
    return not unicodedata.combining(first) and first not in _second_halves()


class Encoder:
    """The transducer: feed(chunk) and finish() give packed little-endian 32-bit ids.

    Ids leave as soon as no later text can change them. Held back are: an unfinished word, an
    unfinished special token, and of a very long piece the lookahead of the merge list.
    """

    def __init__(self, path: str, words: WordIds | None = None):
        self.words = _word_ids(path) if words is None else words
        self.model = self.words.model
        self.held = ""
        self.piece: PieceStream | None = None
        self.kind = _LETTERS
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.model.special, key=len, reverse=True))) or r"(?!)")
        self.longest = max(map(len, self.model.special), default=1)

    def feed(self, chunk: str) -> bytes:
        text = self.held + chunk
        cut = self._white_cut(text)
        if cut:
            self.held = text[cut:]
            return self._whole(text[:cut])
        if len(text) < 2 * CHUNK:
            self.held = text
            return b""
        cut = self._plain_cut(text)  # no white space for long: go on inside the word
        self.held = text[cut:]
        return self._parts(text[:cut], more=True)

    def finish(self) -> bytes:
        text, self.held = self.held, ""
        return self._whole(text)

    def _white_cut(self, text: str) -> int:
        """The place of the last white space; a piece, a special token or a mark never crosses it."""
        return max((text.rfind(c) for c in " \n\t"), default=-1) + 1 and max(text.rfind(c) for c in " \n\t")

    def _plain_cut(self, text: str) -> int:
        """A place near the end, before a character that normalization cannot join to what stands before it.

        Only a run of marks as long as a chunk has no such place; it stays together, as all of its
        marks have to be put in order.
        """
        for i in range(len(text) - self.longest, max(len(text) - CHUNK, 1), -1):
            if starts_anew(text[i]) and not any(
                m.start() < i < m.end() for m in self.special.finditer(text, max(0, i - self.longest), i + self.longest)
            ):
                return i
        return 0

    def _whole(self, text: str) -> bytes:
        """Text after which white space or the end follows."""
        if self.piece is not None:
            return self._parts(text, more=False)
        if "<|" in text and self.special.search(text):
            out, at = [], 0
            for m in self.special.finditer(text):
                out += [self._plain(text[at : m.start()]), struct.pack("<I", self.model.special[m.group()])]
                at = m.end()
            return b"".join([*out, self._plain(text[at:])])
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        text = normalized(text)
        found = _SPACE_RUN.split(text) if _ODD_SPACE.search(text) else text.split()
        return b"".join(map(self.words.__getitem__, found))

    def _parts(self, text: str, more: bool) -> bytes:
        """Text that may begin inside an open piece and, with more to come, end inside one."""
        out: list[bytes] = []
        spans = [(m.start(), m.end()) for m in self.special.finditer(text)]
        for k, (a, b) in enumerate([*spans, (len(text), len(text))]):
            begin = spans[k - 1][1] if k else 0
            last = k == len(spans)
            out.append(self._run(normalized(text[begin:a]), more and last))
            if not last:
                out.append(struct.pack("<I", self.model.special[text[a:b]]))
        return b"".join(out)

    def _run(self, text: str, more: bool) -> bytes:
        out: list[int] = []
        at = 0
        if self.piece is not None:
            m = self.kind.match(text)
            at = m.end() if m else 0
            out += self.piece.feed(text[:at].encode("utf-8", "surrogatepass"))
            if at < len(text) or not more:
                out += self.piece.finish()
                self.piece = None
        head = struct.pack(f"<{len(out)}I", *out)
        found = list(_PIECE.finditer(text, at))
        if more and found and found[-1].end() == len(text):
            tail = found[-1].group()
            rest = tail
            if not (_LETTERS.fullmatch(tail) or _OTHERS.fullmatch(tail)):
                return head + b"".join(self.words.piece(m.group()) for m in found)
            if tail in ("r", "v", "l") and len(found) > 1 and found[-2].group() == "'" and found[-2].end() == found[-1].start():
                self.held = "'" + tail + self.held  # 're, 've or 'll, if the other letter follows
                return head + b"".join(self.words.piece(m.group()) for m in found[:-2])
            head += b"".join(self.words.piece(m.group()) for m in found[:-1])
            if rest == "'":  # what follows decides whether a contraction begins here
                self.held = rest + self.held
                return head
            self.kind = _LETTERS if _LETTERS.fullmatch(rest) else _OTHERS
            self.piece = PieceStream(self.model)
            more_ids = self.piece.feed(rest.encode("utf-8", "surrogatepass"))
            return head + struct.pack(f"<{len(more_ids)}I", *more_ids)
        return head + b"".join(self.words.piece(m.group()) for m in found)


def normalized(text: str) -> str:
    """NFC, then lower case letter by letter."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
        if "Σ" in text:  # lower() would look at the neighbours of this letter
            text = text.replace("Σ", "σ")
    return text.lower()


def encoded_parts(text: str | None, path: str, words: WordIds | None = None) -> Iterator[bytes]:
    """The packed ids of a text, part by part; words: where the ids of words come from."""
    encoder = Encoder(path, words)
    text = text or ""
    if len(text) > CHUNK:
        for at in range(0, len(text), CHUNK):
            yield encoder.feed(text[at : at + CHUNK])
        yield encoder.finish()
    else:
        yield encoder._whole(text)


def encoded(text: str | None, path: str, words: WordIds | None = None) -> bytes:
    """All packed ids of a text."""
    return b"".join(encoded_parts(text, path, words))


class Decoder:
    """Ids to text, block by block; the only state is whether a token came before."""

    def __init__(self, path: str):
        self.texts = _token_bytes(path)
        self.begun = False

    def feed(self, packed: bytes) -> bytes:
        """UTF-8 text of further ids: token texts with one space between them."""
        ids = np.frombuffer(packed, "<u4").tolist()
        if not ids:
            return b""
        text = b" ".join(map(self.texts.__getitem__, ids))
        if self.begun:
            text = b" " + text
        self.begun = True
        return text


class TextDecoder:
    """Ids to the text that was encoded (normalized, one space after each piece).

    Byte-level characters become bytes again; an incremental UTF-8 decoder holds back the bytes
    of an unfinished character, so that blocks of ids may end anywhere.
    """

    def __init__(self, path: str):
        import codecs

        model = merges(path)
        back = {c: b for b, c in enumerate(byte_characters())}
        self.raw = [
            t.encode() if t in model.special else bytes(back[c] for c in t.removesuffix(model.suffix)) + b" " * t.endswith(model.suffix)
            for t in model.texts
        ]
        self.utf8 = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int], final: bool = False) -> str:
        return self.utf8.decode(b"".join(self.raw[i] for i in ids), final)


@cache
def _token_bytes(path: str) -> list[bytes]:
    return [t.encode() for t in merges(path).texts]


#: Ids that are decoded at a time.
DECODED_BYTES = 1 << 20


def round_trips(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode every text; one row of digests for each input row.

    doc_id, n_tokens, ids_sha256 (of little-endian 32-bit ids), decoded_sha256 (of the decoded
    UTF-8 text). Null and empty texts have no tokens and an empty decoded text. Rows are
    independent of each other: repeated rows give repeated results, a null id stays null, and
    an empty table gives an empty one. No rows are shuffled.
    """

    def digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, ids_hex, text_hex = [], [], []
            for text in batch.column(1):
                ids, decoded = hashlib.sha256(), hashlib.sha256()
                decoder, n = Decoder(path), 0
                for part in encoded_parts(text.as_py(), path):
                    ids.update(part)
                    n += len(part) // 4
                    for at in range(0, len(part), DECODED_BYTES):
                        decoded.update(decoder.feed(part[at : at + DECODED_BYTES]))
                counts.append(n)
                ids_hex.append(ids.hexdigest())
                text_hex.append(decoded.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(counts, pa.int64()), pa.array(ids_hex, pa.string()), pa.array(text_hex, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return map_arrow(
        ids_of(docs, id_col, text_col), digests, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )


def tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the packed ids (binary, little-endian 32-bit) of every text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [encoded(t.as_py(), path) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return map_arrow(ids_of(docs, id_col, text_col), run, "doc_id long, ids binary")
