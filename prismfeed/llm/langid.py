"""Language identification by segmentation-marginalised unigrams.

Pieces of a fixed public vocabulary have a probability per language. A word's
probability is the sum over all its segmentations into pieces, by the forward
algorithm; a text's is the product over its words. The probabilities come from
expectation-maximisation over word counts of a bounded sample of labelled rows.
Arcs (piece occurrences) of many words are laid out in arrays, so the forward
and backward passes run over positions, not words.
"""

from __future__ import annotations

import hashlib
import re
import sys
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from prismfeed.llm._tables import map_rows

#: Bound of the labelled sample: rows per language. All words of it are fitted.
TRAIN_ROWS = 500
#: Words whose arcs are laid out together in fitting.
FIT_WORDS = 4096
#: Longer letter runs are scored in stretches of so many letters.
WORD_CHARS = 32
#: Words remembered per Python worker.
CACHE_WORDS = 300_000
UNDETERMINED = "und"
_RUN = re.compile(rf"[^\W\d_]{{1,{WORD_CHARS}}}")
#: Signs that count as word characters to `re` without being letters (category L): numbers of all scripts, such as ½ and Ⅷ.
_NUMBER = re.compile("[" + "".join(c for c in map(chr, range(sys.maxunicode + 1)) if c.isalnum() and not c.isalpha()) + "]")
_UNKNOWN = 1e-7


def words_of(text: str) -> list[str]:
    """Lower-cased letter runs, long ones in stretches."""
    text = text.lower()
    found = _RUN.findall(text)
    return found if all(map(str.isalpha, found)) else _RUN.findall(_NUMBER.sub(" ", text))


class Lattice:
    """Piece arcs of words under a vocabulary. Piece 0 stands for any letter outside it."""

    def __init__(self, path: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
        self.piece = {p: i for i, p in enumerate(names, 1)}
        self.size = len(names) + 1
        self.longest = max(map(len, names))
        self.prefixes = {p[:n] for p in names for n in range(1, len(p) + 1)}

    def arcs(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Word, begin, end and piece of each arc, and the length of each word, led by the blank sign."""
        w, b, e, p, lengths = [], [], [], [], []
        piece, prefixes = self.piece, self.prefixes
        for k, word in enumerate(words):
            s = "▁" + word
            n = len(s)
            lengths.append(n)
            for i in range(n):
                known = False
                for j in range(i + 1, min(n, i + self.longest) + 1):
                    part = s[i:j]
                    if part not in prefixes:
                        break
                    if (x := piece.get(part)) is not None:
                        w.append(k)
                        b.append(i)
                        e.append(j)
                        p.append(x)
                        known = known or j == i + 1
                if not known:
                    w.append(k)
                    b.append(i)
                    e.append(i + 1)
                    p.append(0)
        return tuple(np.array(x, np.int64) for x in (w, b, e, p, lengths))

    @staticmethod
    def forward(arcs, prob: np.ndarray) -> np.ndarray:
        """alpha[word, position, language]: the probability of all ways to reach a position. prob: by arc and language."""
        w, b, e, _, lengths = arcs
        alpha = np.zeros((len(lengths), int(lengths.max()) + 1, prob.shape[1]))
        alpha[:, 0] = 1
        order = np.argsort(e, kind="stable")
        ends = np.searchsorted(e[order], np.arange(1, alpha.shape[1] + 1))
        for pos in range(1, alpha.shape[1]):
            at = order[ends[pos - 1] : ends[pos]]
            if len(at):
                step = alpha[w[at], b[at]] * prob[at]
                for lang in range(prob.shape[1]):
                    alpha[:, pos, lang] = np.bincount(w[at], step[:, lang], len(lengths))
        return alpha

    def fit(self, words: list[str], counts: np.ndarray, rounds: int = 3, pull: float = 50.0) -> np.ndarray:
        """Piece probabilities by language, (pieces, languages), by EM from counts (words, languages); languages are pulled to their mixture."""
        n_lang = counts.shape[1]
        prob = np.full((self.size, n_lang), 1.0 / self.size)
        if not len(words):
            return prob
        # kept in few bytes an arc: words of a part and letters of a word fit in 16 bits, pieces in 32
        packed = lambda arcs: [x.astype(t) for x, t in zip(arcs, (np.int16, np.int16, np.int16, np.int32, np.int16), strict=True)]
        parts = [(packed(self.arcs(words[at : at + FIT_WORDS])), counts[at : at + FIT_WORDS]) for at in range(0, len(words), FIT_WORDS)]
        for _ in range(rounds):
            prob[0] = _UNKNOWN
            expected = np.zeros((self.size, n_lang))
            for held, n in parts:
                arcs = w, b, e, p, lengths = tuple(x.astype(np.int64) for x in held)
                by_arc = prob[p]
                alpha = self.forward(arcs, by_arc)
                back = lengths[w]
                mirrored = (w, back - e, back - b, p, lengths)
                beta = self.forward(mirrored, by_arc)  # beta[word, letters left]
                total = alpha[np.arange(len(lengths)), lengths]
                share = alpha[w, b] * by_arc * beta[w, back - e] / np.maximum(total[w], 1e-300) * n[w]
                expected += np.stack([np.bincount(p, share[:, k], self.size) for k in range(n_lang)], axis=1)
            mixture = expected.sum(axis=1, keepdims=True) + 0.01
            mixture /= mixture.sum()
            prob = (expected + pull * mixture) / (expected.sum(axis=0, keepdims=True) + pull)
        prob[0] = _UNKNOWN
        return prob


class Scorer:
    """Log-probabilities of words by language, remembered within a bound."""

    def __init__(self, path: str, prob: np.ndarray):
        self.lattice, self.prob = Lattice(path), prob
        self.rows = np.zeros((1024, prob.shape[1]))
        self.place: dict[str, int] = {}

    def fill(self, fresh: list[str]) -> np.ndarray:
        out = np.zeros((len(fresh), self.prob.shape[1]))
        for at in range(0, len(fresh), 4096):
            arcs = self.lattice.arcs(fresh[at : at + 4096])
            alpha = self.lattice.forward(arcs, self.prob[arcs[3]])
            out[at : at + 4096] = np.log(np.maximum(alpha[np.arange(len(arcs[4])), arcs[4]], 1e-300))
        return out

    def texts(self, texts: list[str]) -> list[np.ndarray | None]:
        """Summed log-probabilities of each text, None without a word."""
        split = [words_of(t) for t in texts]
        place = self.place
        fresh = [*dict.fromkeys(x for ws in split for x in ws if x not in place)]
        scores = self.fill(fresh)
        keep = fresh[: max(0, CACHE_WORDS - len(place))]
        n = len(place)
        if keep:
            if n + len(keep) > len(self.rows):
                grown = np.zeros((2 * (n + len(keep)), self.rows.shape[1]))
                grown[:n] = self.rows[:n]
                self.rows = grown
            self.rows[n : n + len(keep)] = scores[: len(keep)]
            place.update(zip(keep, range(n, n + len(keep)), strict=True))
        rest = {x: scores[i] for i, x in enumerate(fresh[len(keep) :], len(keep))}
        out: list[np.ndarray | None] = []
        for ws in split:
            if not ws:
                out.append(None)
                continue
            at = [place.get(x, -1) for x in ws]
            spot = np.array(at)
            total = self.rows[spot[spot >= 0]].sum(axis=0)
            if rest and -1 in at:
                total = total + sum(rest[x] for x, i in zip(ws, at, strict=True) if i < 0)
            out.append(total)
        return out


_SCORERS: dict[tuple, Scorer] = {}
_TOGETHER = 256


def train(labelled: DataFrame, vocabulary: str, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id") -> tuple[list[str], np.ndarray]:
    """Languages, sorted, and their piece probabilities, from at most about TRAIN_ROWS rows of each and all their words.

    Rows are picked by a hash of id and text, so one id or one text, null or
    often repeated, is no sample of its own; rows alike in both are read once and
    count each. Rows without text or language teach nothing, nor do texts without
    a letter; a very long text is read whole; without any row there is no
    language. The table of pieces and languages grows with the different values
    of the language column.
    """
    rows = labelled.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = {r[0]: r[1] for r in rows.groupBy(lang_col).count().collect()}
    langs = sorted(sizes)
    lattice = Lattice(vocabulary)
    if not langs:
        return [], np.full((lattice.size, 0), 1.0)
    share = F.coalesce(*[F.when(F.col(lang_col) == k, F.lit(min(1.0, TRAIN_ROWS / n))) for k, n in sizes.items()])
    unit = F.xxhash64(id_col, text_col)
    picked = rows.filter(F.pmod(unit, F.lit(1 << 30)) < share * (1 << 30)).groupBy(F.col(lang_col), unit.alias("unit")).agg(F.first(text_col).alias("text"), F.count("*").alias("n")).select(lang_col, "text", "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for b in batches:
            for lang, text, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for x in words_of(text):
                    found[lang, x] += n
        yield pa.RecordBatch.from_pydict({"l": [k[0] for k in found], "w": [k[1] for k in found], "n": [*found.values()]}, pa.schema([("l", pa.string()), ("w", pa.string()), ("n", pa.int64())]))

    counted = picked.mapInArrow(run, "l string, w string, n long").groupBy("l", "w").agg(F.sum("n").alias("n"))
    found = counted.toArrow()  # words of the sample: bounded by rows, not by the corpus; no object of the driver's for each
    words = pc.unique(found.column("w")).sort()
    counts = np.zeros((len(words), len(langs)))
    counts[pc.index_in(found.column("w"), words).to_numpy(), pc.index_in(found.column("l"), pa.array(langs, pa.string())).to_numpy()] = found.column("n").to_numpy()
    words = words.to_pylist()
    del found
    return langs, lattice.fit(words, counts)


def identify(df: DataFrame, model: tuple[list[str], np.ndarray], vocabulary: str, text_col: str = "text", lang_name: str = "lang_pred", score_name: str = "score") -> DataFrame:
    """df with lang_pred and score (the posterior of the language under equal priors), from its text alone.

    Narrow, with no shuffle. `und` with score 0 where the text is null or has no
    letter, or nothing was learned; ties go to the first language by name; a very
    long text is judged by all its words; rows of repeated or null ids are judged
    each; an empty table gives an empty result; other columns stay as they are.
    Columns of df that bear the names of the new ones need other names for these.
    """
    if {lang_name.casefold(), score_name.casefold()} & {c.casefold() for c in df.columns}:
        raise ValueError(f"df has a column {lang_name} or {score_name}: name the new ones otherwise")
    langs, prob = model
    held = df.sparkSession.sparkContext.broadcast(prob)
    at, key = df.columns.index(text_col), (vocabulary, prob.shape, hashlib.sha256(np.ascontiguousarray(prob).tobytes()).digest())
    names = [f"c{i}" for i in range(len(df.columns) + 2)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _SCORERS:
            _SCORERS.clear()
            _SCORERS[key] = Scorer(vocabulary, held.value)
        scorer = _SCORERS[key]
        for whole in batches:
            for lo in range(0, whole.num_rows, _TOGETHER):
                b = whole.slice(lo, _TOGETHER)
                pred, score = [], []
                for total in scorer.texts([t or "" for t in b.column(at).to_pylist()]):
                    if total is None or not langs:
                        pred.append(UNDETERMINED)
                        score.append(0.0)
                    else:
                        k = int(np.argmax(total))
                        pred.append(langs[k])
                        score.append(float(1 / np.exp(total - total[k]).sum()))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=names)

    out = StructType([*df.schema.fields, StructField(lang_name, StringType()), StructField(score_name, DoubleType())])
    return map_rows(df, run, out)
