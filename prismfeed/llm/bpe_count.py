"""Token counts by heap-and-linked-list byte-pair merging.

Each pretoken becomes a linked list of byte symbols; a heap yields the adjacent
pair of lowest rank, the leftmost first. Every merge takes one symbol away, so
the count is the initial symbols minus the merges and no identifier is emitted.
Counts of blank-delimited stretches are remembered per Python worker, within a
bound, as natural text repeats them.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Stretches remembered per Python worker, and the longest one remembered.
CACHE_ENTRIES, CACHE_CHARS = 1_000_000, 64
# The vocabulary's blanks (Unicode White_Space) and its pretoken pattern.
_BLANKS = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_PRETOKEN = rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{_BLANKS}\p{{L}}\p{{N}}]+"


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies: itself, or the next free one from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class MergeCounter:
    """Counts the tokens of texts under a word-level byte-pair vocabulary (tokenizers JSON)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        kinds = [x["type"] for x in spec["normalizer"]["normalizers"]]
        if model["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase"]:
            raise ValueError("only lower-casing word-level BPE vocabularies are known here")
        self.end = model["end_of_word_suffix"] or ""
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.rank = {(a, b): i for i, (a, b) in enumerate(pairs)}
        special = sorted((x["content"] for x in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.pretoken = regex.compile(_PRETOKEN)
        self.blanks = re.compile(f"[{_BLANKS}]+")
        self.letters = byte_letters()
        self.cache: dict[str, int] = {}

    def merged(self, symbols: list[str]) -> int:
        """The symbols left of a word when no pair can be merged any more."""
        n = left = len(symbols)
        rank, following, preceding = self.rank, [*range(1, n + 1)], [*range(-1, n - 1)]
        heap = [(r, i) for i in range(n - 1) if (r := rank.get((symbols[i], symbols[i + 1]))) is not None]
        heapify(heap)
        while heap:
            r, i = heappop(heap)
            j = following[i]
            if j >= n or not symbols[i] or rank.get((symbols[i], symbols[j])) != r:
                continue
            symbols[i] += symbols[j]
            symbols[j] = ""
            left -= 1
            after = following[i] = following[j]
            following[j] = n
            if after < n:
                preceding[after] = i
                if (r := rank.get((symbols[i], symbols[after]))) is not None:
                    heappush(heap, (r, i))
            before = preceding[i]
            if before >= 0 and (r := rank.get((symbols[before], symbols[i]))) is not None:
                heappush(heap, (r, before))
        return left

    def stretch(self, text: str) -> int:
        """The tokens of a stretch without blanks."""
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        total = 0
        for word in self.pretoken.findall(text):
            symbols = [self.letters[b] for b in word.encode()]
            symbols[-1] += self.end
            total += self.merged(symbols)
        return total

    def plain(self, text: str) -> int:
        odd = any(c in text for c in "\x1c\x1d\x1e\x1f")  # blanks for str.split only
        parts = self.blanks.split(text) if odd else text.split()
        found = [*map(self.cache.get, parts)]
        if None in found:
            return sum(self.remembered(p) if n is None else n for p, n in zip(parts, found, strict=True))
        return sum(found)

    def remembered(self, part: str) -> int:
        n = self.cache.get(part)
        if n is None:
            n = self.stretch(part)
            if len(part) <= CACHE_CHARS and len(self.cache) < CACHE_ENTRIES:
                self.cache[part] = n
        return n

    def count(self, text: str) -> int:
        if self.special is None or not self.special.search(text):
            return self.plain(text)
        return sum(map(self.plain, self.special.split(text))) + len(self.special.findall(text))


_COUNTERS: dict[str, MergeCounter] = {}


def counter(path: str) -> MergeCounter:
    """One counter per Python worker and vocabulary."""
    if path not in _COUNTERS:
        _COUNTERS[path] = MergeCounter(path)
    return _COUNTERS[path]


def token_counts(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, n_bytes, n_tokens) for every row of df; narrow, with no shuffle.

    A null text counts as empty (0 bytes, 0 tokens); a very long one is counted
    whole; rows of repeated or null ids are counted each; an empty table gives an
    empty result; other columns are not read.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(vocabulary).count
        for b in batches:
            tokens = [count(t.as_py() or "") for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(tokens, pa.int64())], names=["id", "n_bytes", "n_tokens"])

    size = F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long")
    out = df.select(F.col(id_col), F.col(text_col), size.alias("_size")).mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long")
    return out.withColumnRenamed("id", id_col)
