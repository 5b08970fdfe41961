"""Byte-pair encoding without merging: one pass over each word, one token kept per prefix.

Every prefix of a word has one encoding, so it is enough to store the last token of it. That token
is among those that end there (found by an automaton over the vocabulary), and it is the one that
stays apart from the last token of what precedes it: encoding both joined gives just these two.
Back-pointers then spell out the ids. No merge loop runs, and a word takes linear time.

The settings file of a public tokenizer of the word-end kind is a parameter; it holds the
vocabulary and the order of its merges. Lower case and NFC come first, white space is dropped.
"""

from __future__ import annotations

import json
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from hashlib import sha256

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from markspark.llm.common import kept_by_worker
from markspark.llm.wordhash import words_of

CACHED = 400_000
"""Entries in each of the two generations of a worker's caches."""
BATCH_CHARS = 4 << 20
"""Texts are taken together up to this size."""
LONG_CHUNK = 100
"""Longer chunks and words are not kept in a cache."""
NEVER = 1 << 62

def byte_symbols() -> dict[str, int]:
    """The printable character that byte-level vocabularies write for each byte."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class Recent(dict):
    """A cache in two generations: when the young one is full, the old one goes."""

    def __init__(self, make, most: int) -> None:
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key: str) -> bytes:
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
        if len(key) <= LONG_CHUNK:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[key] = found
        return found


class Encoder:
    """Encodes texts to ids, and ids back to the tokenizer's joined tokens.

    A generation of its caches holds `cached` entries: fewer take less memory and more time.
    """

    def __init__(self, path: str, cached: int | None = None) -> None:
        cached = CACHED if cached is None else cached
        with open(path, encoding="utf-8") as f:
            settings = json.load(f)
        model = settings["model"]
        self.end = model["end_of_word_suffix"]
        self.specials = {t["content"]: t["id"] for t in settings["added_tokens"]}
        vocabulary: dict[str, int] = model["vocab"]
        size = max([*vocabulary.values(), *self.specials.values()]) + 1
        if size > 1 << 16:
            raise ValueError("ids are kept in two bytes")
        self.texts = [""] * size
        for token, i in [*vocabulary.items(), *self.specials.items()]:
            self.texts[i] = token
        self.numbers = [str(i) for i in range(size)]
        self.merges: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            made = vocabulary[left + right]
            key = (vocabulary[left], vocabulary[right])
            self.merges.setdefault(key, rank)
            self.parts.setdefault(made, (*key, rank))
        self._right: dict[int, list[tuple[int, int]]] = {}
        self._left: dict[int, list[tuple[int, int]]] = {}
        self._apart: dict[int, bool] = {}

        # tokens as bytes; one symbol beyond all bytes stands for the end of a word
        symbols = byte_symbols()
        self.stop = chr(256)
        self.matches = ahocorasick.Automaton()
        for token, i in vocabulary.items():
            ended = token.endswith(self.end) and token != self.end
            body = token[: -len(self.end)] if ended else token
            spelled = "".join(chr(symbols[c]) for c in body) + (self.stop if ended else "")
            if i not in self.parts or self.apart(*self.parts[i][:2], made=self.parts[i][2]):
                self.matches.add_word(spelled, (len(spelled), i))
        self.matches.make_automaton()
        # fixed values: how the tokenizer splits; the classes agree in these scripts
        self.words = regex.compile(
            "'s|'t|'re|'ve|'m|'ll|'d|\\p{L}+|\\p{N}|[^\\s\\p{L}\\p{N}]+"
        )
        self.plain = regex.compile("[\x20-\u024f]*")
        self.symbols = symbols
        self.library = Tokenizer.from_file(path)
        self.special = regex.compile("(" + "|".join(map(regex.escape, self.specials)) + ")")
        self.of_word = Recent(lambda w: array("H", self.encode_word(w)).tobytes(), cached)
        self.of_chunk = Recent(self._chunk, cached)

    def _spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """Tokens along one edge, innermost first, each with the rank at which it was merged on."""
        known = self._right if side else self._left
        if token not in known:
            spine, ends = [], NEVER
            while True:
                spine.append((token, ends))
                if token not in self.parts:
                    break
                *pair, ends = self.parts[token]
                token = pair[side]
            spine.reverse()
            known[spine[-1][0]] = spine
            return spine
        return known[token]

    def apart(self, a: int, b: int, made: int = NEVER) -> bool:
        """No merge crosses the border of `a` and `b` before rank `made`.

        Both sides grow as their own merges happen. Of two neighbours that exist at the same
        time, a merge takes place if its rank comes before either is merged on to its other
        side; of equal ranks, the left one comes first.
        """
        if made == NEVER:
            key = a << 16 | b
            known = self._apart.get(key)
            if known is not None:
                return known
        left, right = self._spine(a, 1), self._spine(b, 0)
        i = j = 0
        while True:
            x, x_ends = left[i]
            y, y_ends = right[j]
            rank = self.merges.get((x, y), NEVER)
            if rank < min(x_ends, made) and rank <= y_ends:
                answer = False
                break
            if x_ends == y_ends == NEVER:
                answer = True
                break
            if x_ends <= y_ends:
                i += 1
            else:
                j += 1
        if made == NEVER:
            if len(self._apart) > 2_000_000:
                self._apart.clear()
            self._apart[key] = answer
        return answer

    def encode_word(self, word: str) -> list[int]:
        """Ids of one word, given as one character for each of its bytes."""
        spelled = word + self.stop
        last = [0] * (len(spelled) + 1)
        size = [0] * (len(spelled) + 1)
        apart, known = self.apart, self._apart
        for end, (length, token) in self.matches.iter(spelled):
            at = end + 1
            if size[at]:
                continue
            start = at - length
            if start == 0:
                size[at], last[at] = length, token
            elif size[start]:
                before = last[start]
                ok = known.get(before << 16 | token)
                if ok is None:
                    ok = apart(before, token)
                if ok:
                    size[at], last[at] = length, token
        ids, at = [], len(spelled)
        while at:
            ids.append(last[at])
            at -= size[at]
        ids.reverse()
        return ids

    def split(self, chunk: str) -> list[str]:
        """The words of a chunk without white space, one character per byte.

        Scripts whose letter classes depend on the Unicode version are split by the library.
        """
        if chunk.isascii() and chunk.isprintable():
            chunk = chunk.lower()
            if chunk.isalpha():
                return [chunk]
            return self.words.findall(chunk)
        if self.plain.fullmatch(chunk):
            chunk = unicodedata.normalize("NFC", chunk).lower()
            words = [chunk] if chunk.isalpha() else self.words.findall(chunk)
            return [w.encode().decode("latin-1") for w in words]
        chunk = self.library.normalizer.normalize_str(chunk)
        pieces = self.library.pre_tokenizer.pre_tokenize_str(chunk)
        return ["".join(chr(self.symbols[c]) for c in word) for word, _ in pieces]

    def _chunk(self, chunk: str) -> bytes:
        return b"".join(map(self.of_word.__getitem__, self.split(chunk)))

    def _plain_text(self, text: str) -> bytes:
        # no word and no composition reaches over white space
        for other in "\x1c\x1d\x1e\x1f":  # white space to str.split alone
            if other in text:
                return self._chunk(text)
        return b"".join(map(self.of_chunk.__getitem__, text.split()))

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a whole text; null is the empty text."""
        if not text:
            return np.empty(0, np.uint16)
        if "<|" not in text:
            return np.frombuffer(self._plain_text(text), np.uint16)
        out = []
        for piece in self.special.split(text):
            if piece in self.specials:
                out.append(np.array([self.specials[piece]], np.uint16).tobytes())
            else:
                out.append(self._plain_text(piece))
        return np.frombuffer(b"".join(out), np.uint16)

    def encode_all(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        """Ids of many texts. Equal words of a batch are looked up once."""
        batch: list[str] = []
        size = 0
        for text in texts:
            batch.append(text or "")
            size += len(batch[-1])
            if size > BATCH_CHARS:
                yield from self._batch(batch)
                batch, size = [], 0
        yield from self._batch(batch)

    def _batch(self, texts: list[str]) -> Iterator[np.ndarray]:
        odd = {i for i, t in enumerate(texts) if "<|" in t}
        found = words_of([b"" if i in odd else t.encode() for i, t in enumerate(texts)], False)
        codes, numbers = pd.factorize(found.numbers)
        first = np.empty(len(numbers), np.int64)
        first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
        buffer, known = found.buffer, self.of_chunk
        packed = [
            known[buffer[a:b].decode()]
            for a, b in zip(found.starts[first].tolist(), found.ends[first].tolist())
        ]
        ids = np.frombuffer(b"".join(packed), np.uint16)
        lengths = np.fromiter(map(len, packed), np.int64, len(packed)) // 2
        begins = np.cumsum(lengths) - lengths
        sizes = lengths[codes]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        places = np.arange(total) + np.repeat(begins[codes] - (ends - sizes), sizes)
        ids = ids[places]
        limits = np.concatenate([[0], ends])[found.firsts].tolist()
        for i, text in enumerate(texts):
            yield self.encode(text) if i in odd else ids[limits[i] : limits[i + 1]]

    def decode(self, ids: np.ndarray) -> str:
        """The tokens joined by spaces, as a tokenizer without a decoder gives them."""
        return " ".join(map(self.texts.__getitem__, ids.tolist()))

    def spell(self, ids: np.ndarray) -> str:
        """The ids in decimals, joined by spaces."""
        return " ".join(map(self.numbers.__getitem__, ids.tolist()))


@lru_cache(maxsize=2)
def encoder(path: str, cached: int | None = None) -> Encoder:
    """One encoder per worker process, file and size of its caches."""
    return Encoder(path, cached)


kept_by_worker(encoder.cache_clear)


def encode(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """`id_col, ids` (array of int) for each row.

    A null or empty text, or one of white space alone, has no ids. Special tokens written in a
    text are taken as such. Rows that repeat give equal rows, null ids stay null, other columns
    are ignored. The tokenizer's file must lie at the same path on every machine.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(tokenizer)
        for batch in batches:
            rows = [x.astype(np.int32) for x in known.encode_all(batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(rows)], ["id", "ids"])

    source = docs.select(id_col, text_col)
    kind = source.schema[0].dataType.simpleString()
    out = source.mapInArrow(run, f"id {kind}, ids ARRAY<INT>")
    return out.withColumnRenamed("id", id_col)


def decode(
    encoded: DataFrame, tokenizer: str, id_col: str = "doc_id", ids_col: str = "ids"
) -> DataFrame:
    """`id_col, text`: the tokens of each row's ids joined by spaces; null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(tokenizer)
        for batch in batches:
            texts = [known.decode(np.array(x.as_py() or [], np.int64)) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.string())], ["id", "text"]
            )

    source = encoded.select(id_col, ids_col)
    kind = source.schema[0].dataType.simpleString()
    out = source.mapInArrow(run, f"id {kind}, text STRING")
    return out.withColumnRenamed("id", id_col)


def encoded_digests(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """`id_col, n_tokens, ids_sha256, decoded_sha256`: encodes, decodes what came out, and keeps
    digests of the ids (decimals joined by a space) and of the decoded text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(tokenizer)
        for batch in batches:
            rows = []
            for ids in known.encode_all(batch.column(1).to_pylist()):
                spelled, decoded = known.spell(ids).encode(), known.decode(ids).encode()
                rows.append((len(ids), sha256(spelled).hexdigest(), sha256(decoded).hexdigest()))
            n, ids_sha, text_sha = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(n, pa.int64()),
                    pa.array(ids_sha, pa.string()),
                    pa.array(text_sha, pa.string()),
                ],
                ["id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    source = docs.select(id_col, text_col)
    kind = source.schema[0].dataType.simpleString()
    schema = f"id {kind}, n_tokens LONG, ids_sha256 STRING, decoded_sha256 STRING"
    return source.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    offsets = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(r) for r in rows], out=offsets[1:])
    return pa.ListArray.from_arrays(offsets, np.concatenate([*rows, np.empty(0, np.int32)]))
