"""Turkish-aware text features as column expressions."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters that fold to ASCII, stop words, suffixes with the stem letters they must leave.
FOLD_FROM, FOLD_TO = "şŞıİIüÜöÖçÇğĞâÂîÎûÛ", "ssiiiuuooccggaaiiuu"
STOP_WORDS = (
    "ve", "ile", "bir", "bu", "da", "de", "ki", "mi", "mı", "mu", "mü", "o", "ne", "için", "icin", "ama", "fakat", "ancak", "ya", "ya da", "ise", "gibi", "kadar", "daha", "çok", "cok", "az", "en", "her",
    "hiç", "hic", "bazı", "bazi", "olan", "olarak", "var", "yok", "oldu", "olduğu", "oldugu", "olması", "olmasi", "değil", "degil", "şu", "su", "ben", "sen", "biz", "siz", "onlar", "şey", "sey", "yine",
    "te", "ta", "son", "dakika", "haber", "haberler",
)
SUFFIXES = (
    ("lerden", 3), ("lardan", 3), ("lerde", 3), ("larda", 3), ("lerin", 3), ("larin", 3), ("leri", 3), ("lari", 3), ("lere", 3), ("lara", 3), ("ler", 3), ("lar", 3), ("dan", 3), ("den", 3), ("tan", 3),
    ("ten", 3), ("nin", 3), ("nun", 3), ("nda", 3), ("nde", 3), ("da", 4), ("de", 4), ("ta", 4), ("te", 4),
)
SHINGLE, SLOTS, PRIME = 4, 64, 2147483647
EMPTY_SLOT = 0xFFFFFFFF

# Entity words, words that are none, English phrases with their entities, and the signs that part words.
#: Entity words: parties, institutions, cities, countries, people, sports, religion, finance, minorities, English bridges and their targets.
ENTITY_WORDS = (
    "akp", "chp", "mhp", "iyi", "deva", "gelecek", "saadet", "tip", "dem", "hdp", "ysp", "yrp", "bbp", "vatan",
    "tbmm", "meclis", "cumhurbaskanligi", "basbakanlik", "disisleri", "icisleri", "adalet", "meb", "saglik", "tcmb", "bddk", "spk", "tuik", "tusiad", "afad", "tsk", "emniyet", "jandarma", "myk", "ysk",
    "danistay", "anayasamahkemesi", "yargitay", "sayistay",
    "istanbul", "ankara", "izmir", "bursa", "adana", "gaziantep", "konya", "antalya", "diyarbakir", "sanliurfa", "kayseri", "mersin", "samsun", "trabzon",
    "abd", "rusya", "ukrayna", "suriye", "iran", "israil", "filistin", "yunanistan", "almanya", "fransa", "ingiltere", "cin", "avrupa", "nato", "bm", "ab", "ohal",
    "erdogan", "kilicdaroglu", "ozel", "imamoglu", "yavas", "bahceli", "davutoglu", "babacan", "karamollaoglu", "akgun", "simsek", "sonmez", "fidan", "yilmaz", "ala", "guler",
    "galatasaray", "fenerbahce", "besiktas", "trabzonspor", "tff", "spor", "futbol",
    "diyanet", "imam", "cami", "cuma", "namaz", "ramazan", "oruc", "kuran",
    "bist", "borsa", "dolar", "euro", "enflasyon", "faiz", "kur", "altin",
    "ermeni", "rum", "gregoryen", "patrik", "hrant", "dink",
    "turkey", "turkish", "parliament", "minister", "president", "election", "trump", "putin", "biden",
    "turkiye", "bakan", "cumhurbaskan", "secim", "ekonomi", "muhalefet",
)
ENTITY_STOP_WORDS = (
    "ile", "icin", "gibi", "kadar", "daha", "cok", "her", "hem", "bir", "iki", "uc", "bin", "son", "dun", "bugun", "yarin", "simdi", "sonra", "once", "var", "yok", "oldu", "dedi", "diye", "ama", "fakat",
    "ancak", "veya", "den", "dan", "nin", "nun", "haber", "canli", "flas", "acil",
)
ENTITY_BRIDGE = {
    "turkey": "turkiye", "istanbul": "istanbul", "ankara": "ankara", "erdogan": "erdogan", "parliament": "meclis", "minister": "bakan", "president": "cumhurbaskan", "election": "secim",
    "economy": "ekonomi", "central bank": "tcmb", "opposition": "muhalefet",
}
#: Blanks of a pattern's character class, those beyond ASCII among them.
BLANKS = "\\s\\x0b\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
_BREAKS = BLANKS + r".,;:!?()\[\]{}\"'`’‘“”«»\-–—/\\|…"
ENTITY_BREAKS = f"[{_BREAKS}]+"


_NO_ENTITY_LETTER = f"[^a-z0-9{_BREAKS}]"
_LISTED = tuple(w for w in dict.fromkeys(ENTITY_WORDS) if len(w) >= 3 and w not in ENTITY_STOP_WORDS)
_GAP = f"[{BLANKS}]+"


def fold(text: Column) -> Column:
    """ASCII letters for Turkish ones, then lower case; folding comes first, as lower('İ') has two characters."""
    return F.lower(F.translate(text, FOLD_FROM, FOLD_TO))


_PAIRS = tuple((a, b) for a, b in zip(FOLD_FROM, FOLD_TO, strict=True) if not a.isascii())
_STOPS = frozenset(w for w in STOP_WORDS if w.isascii())
_WORD = re.compile("[a-z0-9]+")


def folded(text: str) -> str:
    """As fold, for a string."""
    if not text.isascii():
        for a, b in _PAIRS:
            text = text.replace(a, b)
    return text.lower()


@F.pandas_udf(T.StringType())
def normalize_turkish(text: pd.Series) -> pd.Series:
    """Folded words, joined by blanks, without stop words and single letters; whatever is not a-z or 0-9 separates them."""
    kept = lambda t: " ".join([w for w in _WORD.findall(folded(t)) if w not in _STOPS and (len(w) > 1 or w.isdigit())])
    return pd.Series(["" if t is None else kept(t) for t in text], dtype=object)


def stem_turkish(token: Column) -> Column:
    """The token without its first listed suffix that leaves a long enough stem; short and numeric tokens stay."""
    out = F.when((F.length(token) <= 4) | token.rlike("^[0-9]+$"), token)
    for suffix, stem in SUFFIXES:
        out = out.when(token.endswith(suffix) & (F.length(token) >= stem + len(suffix)), F.left(token, F.length(token) - len(suffix)))
    return out.otherwise(token)


def stem(token: str) -> str:
    """As stem_turkish, for a string of a-z and 0-9."""
    if len(token) > 4 and not token.isdigit():
        for suffix, least in SUFFIXES:
            if token.endswith(suffix) and len(token) >= least + len(suffix):
                return token[: -len(suffix)]
    return token


def joined_text(title: Column, description: Column) -> Column:
    return F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(description, F.lit("")))


def shingle_set(normalized: Column, n: int = SHINGLE) -> Column:
    """Distinct character n-grams of a normalised text; a shorter one is its own only shingle, an empty one has none."""
    every = F.regexp_extract_all(normalized, F.lit(f"(?=([\\s\\S]{{{n}}}))"), F.lit(1))  # one look-ahead at each position: linear in the text
    return F.when(normalized == "", F.array().cast("array<string>")).when(F.length(normalized) < n, F.array(normalized)).otherwise(F.array_distinct(every))


def _sorted_shingles(normalized: str, n: int = SHINGLE) -> tuple[int, bytes]:
    """How many distinct n-grams a text has, and all of them in order, joined by |."""
    if len(normalized) < n or not normalized.isascii():
        every = sorted({normalized[i : i + n] for i in range(max(1, len(normalized) - n + 1))} - {""})
        return len(every), "|".join(every).encode()
    codes = shingle_codes(normalized, n)
    out = np.full((len(codes), n + 1), ord("|"), np.uint8)
    for i in range(n):
        out[:, i] = codes >> (8 * (n - 1 - i)) & 0xFF
    return len(codes), out.tobytes()[:-1]


@F.pandas_udf(T.StructType([T.StructField("n", T.LongType()), T.StructField("digest", T.StringType())]))
def shingle_digest(normalized: pd.Series) -> pd.DataFrame:
    """The number of a text's distinct shingles and the SHA-1 of the sorted ones, joined by |; no text stays null."""
    made = [None if t is None else _sorted_shingles(t) for t in normalized]
    return pd.DataFrame({"n": pd.array([None if m is None else m[0] for m in made], "Int64"), "digest": pd.Series([None if m is None else hashlib.sha1(m[1]).hexdigest() for m in made], dtype=object)})


@F.pandas_udf(T.StringType())
def strict_fingerprint(normalized: pd.Series) -> pd.Series:
    """SHA-1 of the sorted shingles, null for an empty text."""
    return pd.Series([hashlib.sha1(_sorted_shingles(t)[1]).hexdigest() if t else None for t in normalized], dtype=object)


def base_hash32(text: Column) -> Column:
    """The first four bytes of SHA-256 as an unsigned number."""
    return F.conv(F.left(F.sha2(text.cast("binary"), 256), F.lit(8)), 16, 10).cast("long")


def _hash32(s: str) -> int:
    return int.from_bytes(hashlib.sha256(s.encode()).digest()[:4], "big")


def minhash_coefficients(slots: int = SLOTS) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers and offsets of the slots, as doubles: the products round, and parity needs that rounding."""
    a = np.array([_hash32(f"a:{i}") % (PRIME - 1) + 1 for i in range(slots)], np.float64)
    b = np.array([_hash32(f"b:{i}") % PRIME for i in range(slots)], np.float64)
    return a, b


def shingle_codes(normalized: str, n: int = SHINGLE) -> np.ndarray:
    """The distinct n-grams (n up to 8) of an ASCII text as numbers of their bytes."""
    raw = np.frombuffer(normalized.encode("ascii"), np.uint8).astype(np.uint32 if n <= 4 else np.uint64)
    size = len(raw) - n + 1
    codes = raw[:size] << (8 * (n - 1))
    for i in range(1, n):
        codes |= raw[i : i + size] << (8 * (n - 1 - i))
    return np.unique(codes)


#: Places of a normalised text's signs (blank, digits, letters, in order of their bytes); others have none.
_SIGNS = b" 0123456789abcdefghijklmnopqrstuvwxyz"
_PLACE = np.full(256, -1, np.int32)
_PLACE[np.frombuffer(_SIGNS, np.uint8)] = np.arange(len(_SIGNS))


class _Hashes:
    """Base hashes of shingles: those of normalised signs in a table of all that there can be, filled as they come."""

    def __init__(self):
        self.table, self.known = np.zeros(len(_SIGNS) ** SHINGLE, np.float64), np.zeros(len(_SIGNS) ** SHINGLE, bool)

    def of(self, text: str) -> np.ndarray:
        if len(text) < SHINGLE:
            return np.array([_hash32(text)], np.float64)
        at = _PLACE[np.frombuffer(text.encode("utf-8"), np.uint8)]
        if at.min() < 0:
            return np.array([_hash32(s) for s in {text[i : i + SHINGLE] for i in range(len(text) - SHINGLE + 1)}], np.float64)
        size = len(at) - SHINGLE + 1
        code = at[:size].copy()
        for i in range(1, SHINGLE):
            code *= len(_SIGNS)
            code += at[i : i + size]
        code = np.unique(code)
        new = code[~self.known[code]]
        if len(new):
            signs, rest = np.empty((len(new), SHINGLE), np.uint8), new.copy()
            for i in reversed(range(SHINGLE)):
                signs[:, i] = np.frombuffer(_SIGNS, np.uint8)[rest % len(_SIGNS)]
                rest //= len(_SIGNS)
            self.table[new] = [int.from_bytes(hashlib.sha256(s.tobytes()).digest()[:4], "big") for s in signs]
            self.known[new] = True
        return self.table[code]


@F.pandas_udf(T.ArrayType(T.LongType()))
def minhash(normalized: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The minimum of each slot over the base hashes of a normalised text's shingles; all slots empty for an empty text, null for null."""
    a, b = minhash_coefficients()
    a, b, hashes, prime = a[:, None], b[:, None], _Hashes(), np.uint64(PRIME)

    def signature(text: str | None) -> np.ndarray | None:
        if text is None:
            return None
        if not text:
            return np.full(SLOTS, EMPTY_SLOT)
        x = np.fmod(hashes.of(text), PRIME)
        least = np.full(SLOTS, PRIME, np.uint64)
        for lo in range(0, len(x), 512):
            y = (x[None, lo : lo + 512] * a + b).astype(np.uint64)  # whole numbers below 2**62
            y = (y & prime) + (y >> np.uint64(31))  # the prime is 2**31 - 1: the same remainder, below twice the prime
            least = np.minimum(least, np.minimum(y, y - prime).min(axis=1))
        return least.astype(np.int64)

    for column in normalized:
        yield pd.Series([signature(t) for t in column], dtype=object)


def signature_jaccard(a: Column, b: Column) -> Column:
    """The share of equal slots, 0 for a missing or empty signature."""
    size = F.least(F.size(a), F.size(b))
    same = F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce((x == y).cast("int"), F.lit(0))), F.lit(0), lambda s, x: s + x)
    return F.when(a.isNull() | b.isNull() | (size <= 0), 0.0).otherwise(same / size)


def normalize_token(raw: Column) -> Column:
    """A folded token of a-z and 0-9, null if shorter than three or a stop word."""
    bare = F.regexp_replace(fold(raw), "[^a-z0-9]", "")
    return F.when((F.length(bare) >= 3) & ~bare.isin(*ENTITY_STOP_WORDS), bare)


_BETWEEN, _STRANGE, _KNOWN_WORDS = re.compile(ENTITY_BREAKS, re.ASCII), re.compile(_NO_ENTITY_LETTER, re.ASCII), frozenset(_LISTED)
_YEAR = re.compile("(?:19[5-9]|20[0-9])[0-9](?![A-Za-z0-9_])(?<![A-Za-z0-9_].{4})", re.ASCII | re.DOTALL)
_PERCENT = re.compile(f"(?<![A-Za-z0-9_])([0-9]{{1,3}})[{BLANKS}]*%", re.ASCII)
_WORDED = re.compile(f"(?:y[üÜ]zde|yuzde)[{BLANKS}]*([0-9]{{1,3}})(?![A-Za-z0-9_])", re.ASCII | re.IGNORECASE)
_PHRASE = re.compile(rf"(?<![A-Za-z0-9])({'|'.join(ENTITY_BRIDGE).replace(' ', _GAP)})(?![A-Za-z0-9])", re.ASCII | re.IGNORECASE)
_GAPS, _STARTS = re.compile(_GAP, re.ASCII), tuple(k.partition(" ")[0] for k in ENTITY_BRIDGE)


def entities_of(text: str) -> list[str]:
    """As extract_entities, for a string; patterns run over texts that hold what they begin with."""
    low, out = text.lower(), set()
    for w in {*_BETWEEN.split(folded(text))}:
        bare = w if w.isascii() and w.isalnum() else _STRANGE.sub("", w)
        if bare in _KNOWN_WORDS:
            out.add(bare)
    out.update(_YEAR.findall(text))
    shares = _PERCENT.findall(text) if "%" in text else []
    if "zde" in low:
        shares += _WORDED.findall(text)
    out.update("pct" + n for n in shares)
    if any(k in low for k in _STARTS):
        out.update(ENTITY_BRIDGE[_GAPS.sub(" ", p).lower()] for p in _PHRASE.findall(text))
    return sorted(out)


@F.pandas_udf(T.ArrayType(T.StringType()))
def extract_entities(text: pd.Series) -> pd.Series:
    """Distinct entities, sorted: listed words, years 1950-2099, percentages and bridged English phrases."""
    return pd.Series([[] if t is None else entities_of(t) for t in text], dtype=object)
