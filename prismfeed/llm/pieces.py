"""SentencePiece encoding and decoding for merge-type (BPE) models.

Encoding keeps an agenda of adjacent symbol pairs ordered by score, the leftmost
first among equals, and joins the best pair until none forms a piece; symbols
outside the vocabulary fall back to byte pieces. No piece of such a model holds
a blank sign after another sign, nor a sign that is no piece itself, so texts
fall into segments that never merge across their borders. The distinct segments
of a part of an Arrow batch are looked up or encoded once; they are remembered
per Python worker within a bound. Every segment that is encoded is checked
against the sentencepiece library, whose ids stand should the two differ.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Segments remembered per Python worker, and the longest one remembered.
CACHE_ENTRIES, CACHE_CHARS = 300_000, 48
#: Segments up to so many signs have a list for an agenda; segments checked together.
SHORT, _GROUP = 32, 16
NONE = float("-inf")
BLANK = "▁"


class PieceCodec:
    """Encodes and decodes with the pieces and scores of a BPE model with an identity normaliser and a dummy prefix."""

    def __init__(self, path: str):
        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(size)]
        reserved = {i for i in range(size) if sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i)}
        self.ids = {p: i for i, p in enumerate(self.pieces) if i not in reserved}
        self.score = {p: sp.get_score(i) for p, i in self.ids.items()}
        self.byte_of = {i: int(self.pieces[i][1:-1], 16) for i in range(size) if sp.is_byte(i)}
        self.byte_id = {b: i for i, b in self.byte_of.items()}
        if any(BLANK in p.lstrip(BLANK) for p in self.ids) or any("\n" in p for p in self.ids) or len(self.byte_id) < 256:
            raise ValueError("pieces that cross blanks or lines, or no byte pieces: this model can't be cut into segments")
        self.cut = re.compile(f"{BLANK}+[^{BLANK}\n]*|[^{BLANK}\n]+|\n")
        self.names = [str(i) for i in range(size)]
        self.plain = {i: self.pieces[i].replace(BLANK, " ") for i in range(size) if i not in self.byte_of}
        self.cache: dict[str, str] = {}
        self.odd: dict[str, str] = {}
        if sp.encode("a b") != sp.encode("a" + BLANK + "b") or sp.encode("a b") != [i for s in self.cut.findall(f"{BLANK}a{BLANK}b") for i in self.segment(s)] or sp.encode("\t a  ") != self.encode("\t a  "):
            raise ValueError("a normaliser other than identity with a dummy prefix")

    def segment(self, text: str) -> list[int]:
        """The ids of a segment, by the agenda."""
        symbols = self.merged_short(text) if len(text) <= SHORT else self.merged(text)
        try:
            return [self.ids[s] for s in symbols]
        except KeyError:
            return [i for s in symbols for i in ([self.ids[s]] if s in self.ids else [self.byte_id[b] for b in s.encode()])]

    def merged_short(self, text: str) -> list[str]:
        """The agenda of a short segment is a list with the score of each adjacent pair."""
        symbols, score = [*text], self.score
        agenda = [score.get(a + b, NONE) for a, b in zip(symbols, symbols[1:])]
        while agenda and (best := max(agenda)) > NONE:
            i = agenda.index(best)  # the leftmost of equals
            symbols[i : i + 2] = [joined := symbols[i] + symbols[i + 1]]
            del agenda[i]
            if i < len(agenda):
                agenda[i] = score.get(joined + symbols[i + 1], NONE)
            if i:
                agenda[i - 1] = score.get(symbols[i - 1] + joined, NONE)
        return symbols

    def merged(self, text: str) -> list[str]:
        """The agenda of a long segment is a heap over linked symbols; pairs whose symbols have changed since are passed over."""
        symbols, n, score = [*text], len(text), self.score
        before, after = [*range(-1, n - 1)], [*range(1, n + 1)]
        agenda = [(-s, i, 2) for i in range(n - 1) if (s := score.get(symbols[i] + symbols[i + 1])) is not None]
        heapify(agenda)
        while agenda:
            _, i, size = heappop(agenda)
            j = after[i]
            if j >= n or not symbols[i] or len(symbols[i]) + len(symbols[j]) != size:
                continue
            symbols[i] += symbols[j]
            symbols[j] = ""
            after[i] = k = after[j]
            after[j] = n
            if k < n:
                before[k] = i
                if (s := score.get(joined := symbols[i] + symbols[k])) is not None:
                    heappush(agenda, (-s, i, len(joined)))
            k = before[i]
            if k >= 0 and (s := score.get(joined := symbols[k] + symbols[i])) is not None:
                heappush(agenda, (-s, k, len(joined)))
        return [s for s in symbols if s]

    def segments(self, text: str) -> list[str]:
        return self.cut.findall(BLANK + text.replace(" ", BLANK)) if text else []

    def encode(self, text: str) -> list[int]:
        return [i for s in self.segments(text) for i in self.segment(s)]

    def join(self, ids: list[int]) -> str:
        """The text of ids before the dummy prefix goes; runs of byte pieces are read as UTF-8."""
        try:
            return "".join([self.plain[i] for i in ids])
        except KeyError:
            pass
        out, pending = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                pending.append(self.byte_of[i])
                continue
            if pending:
                out.append(pending.decode(errors="replace"))
                pending.clear()
            out.append(self.plain[i])
        if pending:
            out.append(pending.decode(errors="replace"))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        return self.join(ids).removeprefix(" ")

    def verify(self, fresh: dict[str, list[int]]) -> None:
        """Hold segments against the library; where they differ, its ids stand.

        Some segments are encoded together; a line feed before each keeps them, and the dummy prefix, apart.
        """
        blank, feed, names = self.ids[BLANK], self.byte_id[0x0A], [*fresh]
        groups = [names[at : at + _GROUP] for at in range(0, len(names), _GROUP)]
        for group, ids in zip(groups, self.library.encode(["\n" + "\n".join(g) for g in groups], num_threads=1), strict=True):
            want = [blank]
            for name in group:
                want.append(feed)
                want += fresh[name]
            if ids != want:
                for name in group:
                    fresh[name] = self.library.encode("\n" + name)[2:]

    def learn(self, segments: set[str]) -> dict[str, str]:
        """The comma-joined ids of each of these distinct segments; those not met before are encoded, decoded and checked."""
        cache = self.cache
        known = {s: x for s in segments if (x := cache.get(s)) is not None}
        if len(known) == len(segments):
            return known
        fresh = {s: self.segment(s) for s in segments - known.keys()}
        self.verify(fresh)
        room = CACHE_ENTRIES - len(cache)
        for s, ids in fresh.items():
            known[s] = joined = ",".join([self.names[i] for i in ids])
            if (back := self.join(ids)) != s.replace(BLANK, " "):
                self.odd[s] = back
            elif room > 0 and len(s) <= CACHE_CHARS:
                cache[s] = joined
                room -= 1
        return known

    def coded(self, texts: list[str]) -> Iterator[tuple[str, str]]:
        """For each text of a batch its comma-joined ids and what they decode to."""
        batch = [self.segments(t) for t in texts]
        self.odd.clear()
        known = self.learn(set().union(*batch))
        for parts in batch:
            if self.odd and not self.odd.keys().isdisjoint(parts):
                back = "".join([self.odd.get(s) or s.replace(BLANK, " ") for s in parts])
            else:
                back = "".join(parts).replace(BLANK, " ")
            yield ",".join(map(known.__getitem__, parts)), back.removeprefix(" ")


_CODECS: dict[str, PieceCodec] = {}
#: Texts that are coded and checked together.
_TOGETHER = 256


def codec(path: str) -> PieceCodec:
    """One codec per Python worker and model."""
    if path not in _CODECS:
        _CODECS[path] = PieceCodec(path)
    return _CODECS[path]


def encode_texts(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """Rows (id, n_tokens, ids, decoded) for every row of df, or with `digests` (id, n_tokens, ids_sha256, decoded_sha256).

    Narrow, with no shuffle. A null or empty text has no ids and decodes to the
    empty text; a very long text is coded like any other; rows of repeated or
    null ids are coded each; an empty table gives an empty result; columns other
    than id and text are not read.
    """
    kind = df.schema[id_col].dataType.simpleString()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = codec(model)
        for whole in batches:
            for at in range(0, whole.num_rows, _TOGETHER):
                b = whole.slice(at, _TOGETHER)
                counts, left, right = [], [], []
                for joined, text in code.coded([t or "" for t in b.column(1).to_pylist()]):
                    counts.append(joined.count(",") + 1 if joined else 0)
                    left.append(sha(joined) if digests else [*map(int, joined.split(","))] if joined else [])
                    right.append(sha(text) if digests else text)
                first = pa.array(left, pa.string() if digests else pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), first, pa.array(right, pa.string())], names=["id", "n_tokens", "a", "b"])

    names = ("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded")
    out = df.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"id {kind}, n_tokens long, a {'string' if digests else 'array<int>'}, b string")
    return out.select(F.col("id").alias(id_col), "n_tokens", F.col("a").alias(names[0]), F.col("b").alias(names[1]))
