"""Byte-pair encoding with a given vocabulary, and its decoding.

A short piece takes the least of its neighbours' merges each time. A long one's symbols are a doubly linked list; a priority queue
holds the merges of neighbours by rank, and an entry whose symbols have changed since is skipped. Each distinct piece is encoded once per worker while its
memo lasts. Decoding concatenates vocabulary strings, with the separator the vocabulary file asks for.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F

from pairscope.llm.common import workers_import

#: Words and pieces a worker remembers, about 100 MB each; then a memo starts anew.
MEMO = 400_000
#: Symbols up to which scanning all merges is faster than a queue; a merge behind all others.
_SHORT, _NONE = 48, 1 << 100
#: White space as the vocabulary file's regular expressions know it.
_WHITE = r"\t-\r\x20\x85\xa0  -     　"
# fixed values: letters and digits that Unicode 16 added, which the file's splitter knows and Python's tables (15.1) don't
_ADDED = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D40, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
    (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3),
    (0x116D0, 0x116E3), (0x11BC0, 0x11BE0), (0x11BF0, 0x11BF9), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16130, 0x16139), (0x16D40, 0x16D6C),
    (0x16D70, 0x16D79), (0x18CFF, 0x18CFF), (0x1CCF0, 0x1CCF9), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5FA))
# fixed values: lower case of capital letters that Unicode 16 and 17 added
_LOWER = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B} | {
    o: o + 32 for o in range(0x10D50, 0x10D66)} | {o: o + 27 for o in range(0x16EA0, 0x16EB9)}
#: What str.split() takes for white space beyond that.
_SEPARATORS = "\x1c\x1d\x1e\x1f"


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself where printable, else the next one from U+0100."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


def splitter() -> Callable[[str], list[str]]:
    """The published splitting pattern, with white space and the Unicode version of letters written out."""
    spare = {o for a, b in _ADDED for o in range(a, b + 1)}
    unknown = "".join(chr(o) for o in range(0x110000) if unicodedata.category(chr(o)) == "Cn" and o not in spare)
    later, last = "", -1
    for o in map(ord, regex.findall(r"[\p{L}\p{N}]", unknown)):
        # a range a-b, its end moved on while code points follow each other
        later = f"{later[:-1]}{chr(o)}" if o == last + 1 else f"{later}{chr(o)}-{chr(o)}"
        last = o
    plain = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{_WHITE}\p{{L}}\p{{N}}]+").findall
    if not later:
        return plain
    first = later[0]
    letter, digit = rf"[\p{{L}}--[{later}]]", rf"[\p{{N}}--[{later}]]"
    other = rf"[[^{_WHITE}\p{{L}}\p{{N}}]||[{later}]]"
    exact = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|{letter}+|{digit}|{other}+", regex.V1).findall
    # the set difference is slow; no text below the first such letter needs it
    return lambda text: plain(text) if text.isascii() or max(text) < first else exact(text)


class Bpe:
    """A word-level vocabulary file: normaliser NFC, white space to space, lower case; letters, single digits and other runs."""

    def __init__(self, definition: str):
        d = json.loads(definition)
        model = d["model"]
        self._check(d, model)
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in d["added_tokens"]}
        self.strings = {i: t for t, i in [*self.vocab.items(), *self.special.items()]}
        self.numbers = {i: str(i) for i in self.strings}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        v = self.vocab
        # pair of ids -> rank and merged id, each packed into one number
        self.merges = {v[a] << 20 | v[b]: rank << 60 | v[a + b] for rank, (a, b) in enumerate(pairs)}
        letters = byte_letters()
        self.inner = [v[x] for x in letters]
        self.last = [v[x + self.suffix] for x in letters]
        self.pieces = splitter()
        by_length = sorted(self.special, key=len, reverse=True)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, by_length)) + ")") if by_length else None
        self.joint = " " if d["decoder"] is None else ""
        self.known_pieces: dict[str, list[int]] = {}
        self.known_words: dict[str, tuple[str, str] | None] = {}

    @staticmethod
    def _check(d: dict, model: dict) -> None:
        kinds = [n["type"] for n in (d["normalizer"] or {}).get("normalizers", [])]
        split = [p["type"] for p in (d["pre_tokenizer"] or {}).get("pretokenizers", [])]
        if model["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase"] or split != ["Split", "ByteLevel"] or d["decoder"] is not None:
            raise ValueError("not a word-level BPE file of the supported form")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in d["added_tokens"]):
            raise ValueError("special tokens with stripping or normalisation are not supported")

    def merge(self, symbols: list[int]) -> list[int]:
        """Merge by rank, leftmost first among equals, until no merge applies."""
        if len(symbols) <= _SHORT:
            return self._merge_short(symbols)
        n, get, pop, push = len(symbols), self.merges.get, heapq.heappop, heapq.heappush
        after, before, queue = list(range(1, n + 1)), list(range(-1, n - 1)), []
        for i, (a, b) in enumerate(zip(symbols, symbols[1:])):
            if m := get(a << 20 | b):
                queue.append(m + (i << 20))
        heapq.heapify(queue)
        symbols.append(-1)
        while queue:
            entry = pop(queue)
            i = entry >> 20 & 0xFFFFFFFFFF
            j, left = after[i], symbols[i]
            if left < 0 or get(left << 20 | symbols[j]) != entry - (i << 20):
                continue  # stale: one of the two has been merged meanwhile
            new = entry & 0xFFFFF
            symbols[i], symbols[j] = new, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if m := get(new << 20 | symbols[k]):
                    push(queue, m + (i << 20))
            h = before[i]
            if h >= 0 and (m := get(symbols[h] << 20 | new)):
                push(queue, m + (h << 20))
        return [s for s in symbols if s >= 0]

    def _merge_short(self, symbols: list[int]) -> list[int]:
        get = self.merges.get
        ranks = [get(a << 20 | b, _NONE) for a, b in zip(symbols, symbols[1:])]
        while ranks and (least := min(ranks)) != _NONE:
            i = ranks.index(least)
            symbols[i] = new = least & 0xFFFFF
            del symbols[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get(symbols[i - 1] << 20 | new, _NONE)
            if i < len(ranks):
                ranks[i] = get(new << 20 | symbols[i + 1], _NONE)
        return symbols

    def piece(self, text: str) -> list[int]:
        if (ids := self.known_pieces.get(text)) is None:
            data = text.encode()
            ids = self.merge([*[self.inner[b] for b in data[:-1]], self.last[data[-1]]])
            if len(self.known_pieces) >= MEMO:
                self.known_pieces.clear()
            if len(text) <= 64:
                self.known_pieces[text] = ids
        return ids

    def rendered(self, part: str) -> list[tuple[str, str] | None]:
        """For each word of a normalised text: its ids joined by spaces, its strings joined for decoding; None without ids."""
        # a piece never holds white space, so words are encoded apart
        found = [part] if any(c in part for c in _SEPARATORS) else part.split()
        known = self.known_words
        if len(known) >= MEMO:
            known.clear()
        new = {}
        for word in set(found).difference(known):
            if word.isascii():
                # letters alone are one piece
                ids = self.piece(word) if word.isalpha() else [i for piece in self.pieces(word) for i in self.piece(piece)]
            else:
                ids = [i for piece in self.pieces(word.translate(_LOWER)) for i in self.piece(piece)]
            (known if len(word) <= 64 else new)[word] = (" ".join(map(self.numbers.__getitem__, ids)), self.decode(ids)) if ids else None
        return [known[w] if w in known else new[w] for w in found] if new else list(map(known.__getitem__, found))

    def parts(self, text: str) -> list[str]:
        """Ordinary text and special tokens in turn."""
        return self.specials.split(text) if any(t in text for t in self.special) else [text]

    def split(self, text: str) -> Iterator[tuple[bool, str]]:
        """(is a special token, part), in order; other parts are pieces of the normalised text."""
        parts = self.parts(text)
        for k, part in enumerate(parts):
            if k % 2:
                yield True, part
            else:
                for piece in self.pieces(normalise(part).translate(_LOWER)):
                    yield False, piece

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        for special, part in self.split(text or ""):
            out += [self.special[part]] if special else self.piece(part)
        return out

    def decode(self, ids: list[int]) -> str:
        return self.joint.join(map(self.strings.__getitem__, ids))

    def digest(self, text: str | None) -> tuple[int, str, str]:
        """n_tokens, sha256 of the ids, sha256 of the decoded text."""
        parts = self.parts(text or "")
        found: list[tuple[str, str]] = []
        for k, part in enumerate(parts):
            found += [(str(self.special[part]), part)] if k % 2 else filter(None, self.rendered(normalise(part)))
        ids = " ".join([f[0] for f in found])
        decoded = self.joint.join([f[1] for f in found])
        return ids.count(" ") + 1 if ids else 0, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


def normalise(text: str) -> str:
    """NFC, then lower case letter by letter: no letter's form depends on its neighbours. ``_LOWER`` completes it."""
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


def _loader(spark: SparkSession, path: str) -> Callable[[], Bpe]:
    """The vocabulary file is read once by the driver and sent to the executors; a worker parses it once."""
    workers_import(spark)
    with open(path, encoding="utf-8") as f:
        text = f.read()
    sent, key = spark.sparkContext.broadcast(text), hashlib.sha256(text.encode()).hexdigest()

    def load() -> Bpe:
        if (found := _LOADED.get(key)) is None:
            _LOADED.clear()
            found = _LOADED[key] = Bpe(sent.value)
        return found

    return load


_LOADED: dict = {}


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns <id_col>, ids (array of int), one row per input row. A null text encodes to no ids."""
    thin, load = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), _loader(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load()
        for batch in batches:
            ids = pa.array([bpe.encode(t.as_py()) for t in batch.column(1)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["id", "ids"])

    return thin.mapInArrow(run, f"id {_type(thin)}, ids array<int>").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Columns <id_col>, text from arrays of ids; null arrays decode to the empty text. An unknown id is an error."""
    thin, load = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")), _loader(encoded.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load()
        for batch in batches:
            texts = pa.array([bpe.decode(t.as_py() or []) for t in batch.column(1)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), texts], names=["id", "text"])

    return thin.mapInArrow(run, f"id {_type(thin)}, text string").withColumnRenamed("id", id_col)


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns <id_col>, n_tokens, ids_sha256, decoded_sha256 without moving the ids: one row per input row.

    Null and empty texts have no tokens and the digests of the empty text. Repeated rows are repeated; an empty table
    gives no rows.
    """
    thin, load = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), _loader(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load()
        for batch in batches:
            found = [bpe.digest(t.as_py()) for t in batch.column(1)]
            n, ids, decoded = ([f[k] for f in found] for k in range(3))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())],
                names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return thin.mapInArrow(run, f"id {_type(thin)}, n_tokens bigint, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)


def _type(thin: DataFrame) -> str:
    return thin.schema["id"].dataType.simpleString()
