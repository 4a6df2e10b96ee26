"""p10: abusive, hateful or sexual content by a linear classifier of character n-grams.

Features are the character n-grams (1 to 6) of a segment, hashed into a table, each scaled by its naive
Bayes log-count ratio between harmful and harmless training texts; a logistic regression is trained over
them. The training texts are review_labels (the majority of the reviewers), labelled texts made from
frames and common words (abuse_seed), and a bounded sample of plain sentences as harmless ones. The bias
is calibrated on texts held out of a first training.

Before that, disguises are undone: characters without width, look-alike letters, letters set apart,
stretched letters, and signs or digits put in the place of letters. Segments are clauses, short
sentences, and windows of long clauses; a document's score is that of its most harmful segment, so length
doesn't dilute it. All characters of a text are scored.

The work is by batch: the texts of a batch are one string, words are cleaned once each, and n-grams are
hashed, looked up and summed over segments by numpy.
"""

from __future__ import annotations

import functools
import math
import re
import unicodedata
from collections import Counter

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm import abuse_seed, langid
from loomtext.session import batch_rows, spread, table

#: Bounds of the training data: rows of review_labels (in the order of a hash), and plain clauses per language.
LABEL_ROWS = 50_000
PLAIN_CLAUSES = 600
#: The most frequent words of the plain clauses, which stand alone, too, and texts of random letters.
SINGLE_WORDS = 3000
RANDOM_TEXTS = 300
THRESHOLD = 0.5

#: Words of a window, and signs of a window in scripts without blanks.
WINDOW, SIGNS = 8, 16
#: Length up to which a sentence of several clauses is scored as a whole, too.
SHORT_SENTENCE = 60
#: Added to the number of n-grams of a segment, so that few of them decide little.
DAMPING = 12.0
#: n-grams, and the bits of their hash.
ORDERS = (1, 2, 3, 4, 5, 6)
BITS = 21
#: Characters handled at once, and words remembered by a worker.
BLOCK = 1 << 20
REMEMBERED = 1 << 18

_LOOKALIKE = dict(zip("аеорсухіјѕԁһкмтвнг", "aeopcyxijsdhkmtbhr"))
_TO_LATIN = str.maketrans({k: v for k, v in _LOOKALIKE.items() if k not in "кмтвнг"} | {"ο": "o", "α": "a", "ε": "e", "ι": "i", "ν": "v", "ρ": "p", "τ": "t", "υ": "u", "κ": "k"})
_TO_CYRILLIC = str.maketrans("aeopcyxkmt", "аеорсухкмт")
_LEET = str.maketrans("013457@$!|€", "oieastasiie")
_SIGNS_AS_LETTERS = str.maketrans("@$!|€", "asiie")
_CJK = langid._CJK
_HAN_KANA = regex.compile(r"[぀-ヿ㐀-鿿]")

_CODED = regex.compile(r"\\u([0-9a-fA-F]{4})")
_SENTENCE = re.compile(r"[\n\r。！？←-⯿\U0001f000-\U0001faff]+|(?<=[.!?])[ \t]+")
_CLAUSE = re.compile(r"[；，、…“”«»「」()（）\[\]{}<>=]+|(?<=[;:,]) +|(?<=[a-zß-ÿа-яё])[.!?](?=[A-ZÀ-ÞА-ЯЁ])")
_FORMAT = regex.compile(r"[\p{Cf}\p{Mn}͏ᅟᅠ]+")
_APART = re.compile(r"\b(?:[^\W\d_])([-_.·*~|/\\+ ])[^\W\d_](?:\1[^\W\d_]){2,}(?!\w)")
_NO_LETTER = regex.compile(r"[^\p{L}]+")
_JOINT = regex.compile(r"[_·*](?<=\p{L}{2}[_·*])(?=\p{L}{2})")
_SET_APART = regex.compile(r"[^\p{L}\p{N}\s\0]+(?<=[぀-鿿가-힯][^\p{L}\p{N}\s\0]+)(?=[぀-鿿가-힯])")
_LATIN, _CYRILLIC, _GREEK = regex.compile(r"\p{Latin}"), regex.compile(r"\p{Cyrillic}"), regex.compile(r"\p{Greek}")
_OWN_CYRILLIC = regex.compile(r"[бвгджзилпфцчшщъыьэюя]")
_MASK = regex.compile(r"(?<=\p{L})[^\s\p{L}]+(?=\p{L})|(?<=\p{L}{2})[*#@$%_0-9]+(?!\S)|(?<!\S)[*#@$%_0-9]+(?=\p{L}{2})")
_NO_MARKS = regex.compile(r"[가-힯぀-ヿ]")
_DOUBLE = regex.compile(r"([^\P{L}x])\1+")
_JUNK = regex.compile(r"[^\p{L}']+")
_BLANKS = re.compile(r"  +")
_WORD_MARKS = ".,;:!?'\"()[]{}<>«»“”…`"


class Vocabulary:
    """Words by length and by the letter at each place, those of harmful texts first."""

    def __init__(self, words: list[str]):
        self.words = words
        self.rank = {w: i for i, w in enumerate(words)}
        self.at: dict[tuple[int, int, str], set[str]] = {}
        for w in words:
            for i, c in enumerate(w):
                self.at.setdefault((len(w), i, c), set()).add(w)

    def fitting(self, masked: str) -> str | None:
        """The first word that has every letter of a masked one in its place. Masks are put to hide a
        word, so a word of a harmful text comes before others; the classifier still judges the whole."""
        n = len(masked)
        sets = sorted((self.at.get((n, i, c), _NONE) for i, c in enumerate(masked) if c.isalpha()), key=len)
        hits = set.intersection(*sets) if sets and sets[0] else None
        return min(hits, key=self.rank.__getitem__) if hits else None


_NONE: set[str] = set()


def _unmask(core: str, vocabulary: Vocabulary) -> str:
    """A masked word as the word meant. Digits and signs that look like letters are read as such; else
    signs and digits stand for one letter each of a known word; else they part the word."""
    for t in (core.translate(_LEET), core.translate(_SIGNS_AS_LETTERS)):
        if t in vocabulary.rank:
            return t
    letters = sum(c.isalpha() for c in core)
    if letters >= 2 and letters >= 0.4 * len(core):
        hit = vocabulary.fitting(core)
        if hit:
            return hit
    t = core.translate(_LEET)
    return t if t.isalpha() else core


def cleaned(w: str, vocabulary: Vocabulary) -> str:
    """One lower-case word without look-alikes, masks, accents and stretched letters."""
    if not (w.isalpha() and w.isascii()):
        latin, cyrillic = len(_LATIN.findall(w)), len(_CYRILLIC.findall(w))
        if latin and cyrillic:
            w = w.translate(_TO_LATIN if latin >= cyrillic or not _OWN_CYRILLIC.search(w) else _TO_CYRILLIC)
        elif latin and _GREEK.search(w):
            w = w.translate(_TO_LATIN)
        core = w.strip(_WORD_MARKS)
        if not core.isalpha():
            whole = w.strip(".,;:?'\"()[]{}<>«»“”…`")
            if (latin or cyrillic) and _MASK.search(whole):
                core = _unmask(whole, vocabulary)
            w = core
        if not w.isascii() and not _NO_MARKS.search(w):
            w = "".join([c for c in unicodedata.normalize("NFD", w) if not unicodedata.combining(c)])
    return _JUNK.sub(" ", _DOUBLE.sub(r"\1", w)).strip(" '")


class Words(dict):
    """Cleaned words, remembered by a worker."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__((m, m) for m in "\0\n\t")
        self.vocabulary = vocabulary

    def __missing__(self, w: str) -> str:
        out = cleaned(w, self.vocabulary)
        if len(w) <= 40:
            if len(self) >= REMEMBERED:
                self.clear()
                self.update((m, m) for m in "\0\n\t")
            self[w] = out
        return out


def flat(texts: list[str], words: Words) -> str:
    """Cleaned texts as one string: words parted by blanks, "\\t" between clauses, "\\n" between sentences,
    "\\0" at the start of the string and the end of each text."""
    t = "\0".join([x.replace("\0", " ") for x in texts])
    if "\\u" in t:
        t = _CODED.sub(lambda m: chr(int(m.group(1), 16)), t).encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    t = _SENTENCE.sub("\n", t)
    t = _CLAUSE.sub("\t", t.replace("\t", " "))
    if not t.isascii():
        t = _FORMAT.sub("", unicodedata.normalize("NFKC", t)).lower()
    else:
        t = t.lower()
    t = _APART.sub(lambda m: _NO_LETTER.sub("", m.group()), t)
    t = _JOINT.sub(" ", t)
    if not t.isascii():
        t = _SET_APART.sub("", t)
    t = t.replace("\0", " \0 ").replace("\n", " \n ").replace("\t", " \t ").replace("\r", " ")
    t = " ".join(map(words.__getitem__, t.split(" ")))
    t = _BLANKS.sub(" ", t)
    for m in "\0\n\t":
        t = t.replace(f" {m}", m).replace(f"{m} ", m)
    return "\0" + t.strip(" ") + "\0"


def hashes(cp: np.ndarray):
    """For each order n: the places in the table of the n-grams that start at each character."""
    h = np.zeros(len(cp), dtype=np.uint32)
    for n in ORDERS:
        if len(cp) < n:
            return
        h = h[: len(cp) - n + 1] * np.uint32(0x01000193) ^ cp[n - 1 :]
        mixed = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D) + np.uint32(0x9E3779B1 * n & 0xFFFFFFFF)
        yield n, (mixed ^ (mixed >> np.uint32(13))) & np.uint32((1 << BITS) - 1)


def no_blanks(cp: np.ndarray) -> np.ndarray:
    """Signs that are words of their own: Han, kana, Hangul. Only these count as 1-grams."""
    return (cp >= 0x3040) & (cp <= 0x9FFF) | (cp >= 0xAC00) & (cp <= 0xD7AF)


def points(s: str) -> np.ndarray:
    return np.frombuffer(s.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _ranges(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, place) of first[i], first[i]+1, ... count[i] places for each i."""
    owner = np.repeat(np.arange(len(count)), count)
    return owner, first[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)


def segments(cp: np.ndarray, cjk: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) places, both inclusive and both a mark or blank, of the segments to score."""
    mark = (cp == 0) | (cp == 9) | (cp == 10)
    at = np.flatnonzero(mark)
    p, q = at[:-1], at[1:]
    keep = q - p > 1
    p, q = p[keep], q[keep]
    edges = np.flatnonzero(mark | (cp == 32))
    a, b = np.searchsorted(edges, p), np.searchsorted(edges, q)
    n_words = b - a
    long = n_words > WINDOW + 2
    out = [(p[~long], q[~long])]
    if long.any():
        n = n_words[long]
        owner, k = _ranges(np.zeros(len(n), dtype=np.int64), (n - WINDOW // 2 + WINDOW // 2 - 1) // (WINDOW // 2))
        first = a[long][owner] + k * (WINDOW // 2)
        out.append((edges[first], edges[np.minimum(first + WINDOW, b[long][owner])]))
    # long runs in scripts without blanks
    signs = np.concatenate(([0], np.cumsum(cjk)))
    wide = ~long & (q - p > SIGNS + SIGNS // 2) & (signs[q] - signs[p] > (q - p) // 2)
    if wide.any():
        n = q[wide] - p[wide]
        owner, k = _ranges(np.zeros(len(n), dtype=np.int64), (n - SIGNS // 2 + SIGNS // 2 - 1) // (SIGNS // 2))
        first = p[wide][owner] + k * (SIGNS // 2)
        out.append((first, np.minimum(first + SIGNS + 1, q[wide][owner])))
    # words of mixed scripts, as blanks part sentences where words have none
    inner = b - a > 1
    some = inner & (signs[q] - signs[p] >= 4)
    if some.any():
        owner, k = _ranges(a[some], (b - a)[some])
        x, y = edges[k], edges[k + 1]
        own = signs[y] - signs[x + 1] >= 4
        out.append((x[own], y[own]))
    # short sentences of several clauses
    ends = np.flatnonzero((cp == 0) | (cp == 10))
    inner_clauses = np.concatenate(([0], np.cumsum(cp == 9)))
    x, y = ends[:-1], ends[1:]
    own = (y - x <= SHORT_SENTENCE) & (inner_clauses[y] - inner_clauses[x] > 0)
    out.append((x[own], y[own]))
    return np.concatenate([s for s, _ in out]), np.concatenate([e for _, e in out])


class Classifier:
    """Weights of hashed n-grams, from train()."""

    def __init__(self, places: np.ndarray, weights: np.ndarray, bias: float, vocabulary: list[str]):
        self.places, self.weights, self.bias = places, weights, bias
        self.table = np.zeros(1 << BITS, dtype=np.float32)
        self.table[places] = weights
        self.vocabulary = Vocabulary(vocabulary)
        self.words = Words(self.vocabulary)

    def parts(self) -> tuple:
        return self.places, self.weights, self.bias, self.vocabulary.words

    def _logits(self, cp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, log odds) of the segments."""
        cjk = no_blanks(cp)
        start, end = segments(cp, cjk)
        letters = np.concatenate(([0], np.cumsum((cp > 32))))
        signs = np.concatenate(([0], np.cumsum(cjk)))
        full = (letters[end + 1] - letters[start] >= 3) | (signs[end + 1] - signs[start] > 0)
        start, end = start[full], end[full]
        blank = np.where((cp == 0) | (cp == 9) | (cp == 10), np.uint32(32), cp)
        size = end - start + 1
        total, count = np.zeros(len(start)), np.zeros(len(start))
        for n, at in hashes(blank):
            w = self.table[at]
            if n == 1:
                w = np.where(cjk, w, np.float32(0))
                count += signs[end + 1] - signs[start]
                inside = size
            else:
                inside = np.maximum(size - n + 1, 0)
                count += inside
            sums = np.concatenate(([0.0], np.cumsum(w, dtype=np.float64)))
            low = np.minimum(start, len(w))  # segments shorter than n at the end have no n-gram
            total += sums[low + inside] - sums[low]
        return start, self.bias + total / np.sqrt(count + DAMPING)

    def scores(self, texts: list[str | None]) -> list[float]:
        """0 to 1 for each text; 0 for null, empty and wordless texts."""
        out = np.full(len(texts), -np.inf)
        todo, size = [], 0
        for i, t in enumerate(texts):
            if t:
                todo.append(i)
                size += len(t)
            if todo and (size >= BLOCK or i == len(texts) - 1):
                self._score(todo, texts, out)
                todo, size = [], 0
        if todo:
            self._score(todo, texts, out)
        return [0.0 if z == -np.inf else 1.0 / (1.0 + math.exp(-max(-40.0, min(40.0, z)))) for z in out.tolist()]

    def _score(self, todo: list[int], texts: list, out: np.ndarray) -> None:
        cp = points(flat([texts[i] for i in todo], self.words))
        text_of = np.concatenate(([0], np.cumsum(cp == 0)))  # before place p: texts begun
        cuts = [0]
        if len(cp) > 2 * BLOCK:  # very long texts: blocks that end at a sentence
            ends = np.flatnonzero((cp == 0) | (cp == 10))
            while len(cp) - cuts[-1] > 2 * BLOCK and (k := int(np.searchsorted(ends, cuts[-1] + BLOCK))) < len(ends) - 1:
                cuts.append(int(ends[k]))
        for a, b in zip(cuts, [*cuts[1:], len(cp) - 1]):
            start, z = self._logits(cp[a : b + 1])
            np.maximum.at(out, np.asarray(todo)[text_of[start + a + 1] - 1], z)

    def score(self, text: str | None) -> float:
        return self.scores([text])[0]


def words_of(texts: list[str]) -> list[str]:
    c = Counter(w for t in texts for w in regex.findall(r"\p{L}{2,}", unicodedata.normalize("NFKC", t).lower()))
    return [w for w, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))]


def _features(texts: list[str], words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(row, place in the table) of every n-gram of every text, each text as one segment."""
    cp = points(flat(texts, words))
    row = np.cumsum(cp == 0) - 1
    # a mark of its own before and after every text, so that no n-gram spans two
    ends = cp == 0
    blank = np.where(ends | (cp == 9) | (cp == 10), np.uint32(32), cp)
    rows, places = [], []
    for n, at in hashes(blank):
        k = np.arange(len(at))
        last = row[k + n - 1] - ends[k + n - 1]  # the end mark of a text belongs to it, too
        good = (row[k] == last) if n > 1 else no_blanks(cp)
        rows.append(row[k][good])
        places.append(at[good])
    return np.concatenate(rows), np.concatenate(places)


#: Weight of a harmless text chosen for its words (review_labels, abuse_seed) against a plain one.
CHOSEN = 4.0
#: Weight of the harmful class when the bias is calibrated: the texts of training are far more often harmful than
#: those of a corpus.
PREVALENCE = 0.3


def _fit(row, place, y, weight, rounds, smoothing, ridge, bias):
    """(places, weights) of a naive Bayes scaled logistic regression by accelerated gradient descent."""
    order = np.lexsort((place, row))
    row, place = row[order], place[order]
    used, col = np.unique(place, return_inverse=True)
    lens = np.bincount(row, minlength=len(y))
    pos = np.bincount(col, weights=y[row], minlength=len(used)) + smoothing
    neg = np.bincount(col, weights=1 - y[row], minlength=len(used)) + smoothing
    ratio = np.log(pos / pos.sum()) - np.log(neg / neg.sum())
    x = (ratio[col] / np.sqrt(lens + DAMPING)[row]).astype(np.float32)
    begin = np.concatenate(([0], np.cumsum(lens)[:-1]))
    none = lens == 0
    begin = np.minimum(begin, max(0, len(x) - 1))
    w, v = np.zeros(len(used), dtype=np.float32), np.zeros(len(used), dtype=np.float32)
    for _ in range(rounds):
        z = np.where(none, 0.0, np.add.reduceat(x * w[col], begin)) + bias
        e = ((1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) * weight).astype(np.float32)
        g = np.bincount(col, weights=x * e[row], minlength=len(used)).astype(np.float32) + np.float32(ridge / len(used)) * w
        v = np.float32(0.9) * v - np.float32(10.0) * g
        w = w + v
    return used, (ratio * w).astype(np.float32)


def train(harmful: list[str], harmless: list[str], plain: list[str], rounds: int = 250, smoothing: float = 0.5, ridge: float = 0.02) -> Classifier:
    """Deterministic. Texts are taken once each; a text that is both harmful and harmless is harmless."""
    words = list(dict.fromkeys(words_of(harmful) + words_of(harmless + plain)))
    seed = Words(Vocabulary(words))
    good, rest = dict.fromkeys(harmless), dict.fromkeys(plain)
    texts = [(t, 1) for t in dict.fromkeys(harmful) if t not in good] + [(t, 0) for t in good] + [(t, -1) for t in rest if t not in good]
    if not any(k == 1 for _, k in texts) or all(k == 1 for _, k in texts):
        return Classifier(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.float32), -4.0, words)
    row, place = _features([t for t, _ in texts], seed)
    kind = np.array([k for _, k in texts])
    y = (kind == 1).astype(float)
    weight = np.where(y == 1, 1.0, np.where(kind == 0, CHOSEN, 1.0))
    weight = np.where(y == 1, 0.5 / weight[y == 1].sum(), 0.5 * weight / weight[y == 0].sum())
    held = np.arange(len(y)) % 5 == 0
    bias = 0.0
    if len(y) >= 50 and 0 < y[held].sum() < held.sum():
        mine = ~held[row]
        places, w = _fit(row[mine], place[mine], y, np.where(held, 0.0, weight), rounds, smoothing, ridge, bias)
        dense = np.zeros(1 << BITS)
        dense[places] = w
        n = np.bincount(row, minlength=len(y))
        z = np.bincount(row, weights=dense[place], minlength=len(y)) / np.sqrt(n + DAMPING)
        bias = calibrated(z[held], y[held], weight[held])
    places, w = _fit(row, place, y, weight, rounds, smoothing, ridge, 0.0)
    large = np.abs(w) > 1e-4
    return Classifier(places[large].astype(np.int64), w[large], bias, words)


def calibrated(z: np.ndarray, y: np.ndarray, weight: np.ndarray, prevalence: float = PREVALENCE) -> float:
    """The bias with the least log loss on held-out log odds, where harmful texts together weigh prevalence and
    harmless ones the rest. The loss is convex in the bias, so its slope is bisected."""
    share = np.where(y == 1, prevalence * weight / weight[y == 1].sum(), (1 - prevalence) * weight / weight[y == 0].sum())
    low, high = -12.0, 12.0
    for _ in range(60):
        bias = (low + high) / 2
        slope = float(((1 / (1 + np.exp(-np.clip(z + bias, -40, 40))) - y) * share).sum())
        low, high = (bias, high) if slope < 0 else (low, bias)
    return (low + high) / 2


def training_texts(spark: SparkSession, sf_dir: str, rows: int = LABEL_ROWS, plain: int = PLAIN_CLAUSES) -> tuple[list[str], list[str], list[str]]:
    """(harmful, harmless, plain). Null labels and texts don't count; reviewers who disagree are
    decided by the majority, ties as harmless. Of more than rows labelled rows the first in the order of a
    hash of the text are taken."""
    got = table(spark, sf_dir, "review_labels").where(F.col("text").isNotNull() & F.col("label").isNotNull()).select("text", F.lower(F.trim("label")).alias("label"))
    got = got.orderBy(F.xxhash64("text"), "text", "label").limit(rows).collect()
    votes: dict[str, int] = {}
    for r in got:
        votes[r["text"]] = votes.get(r["text"], 0) + (1 if r["label"] in ("abusive", "hateful", "sexual") else -1)
    harmful = [t for t, v in sorted(votes.items()) if v > 0]
    harmless = [t for t, v in sorted(votes.items()) if v <= 0]
    more: list[str] = []
    count = dict.fromkeys(langid.LANGS, 0)
    for k, text in langid.sampled(spark, sf_dir):
        if count[k] < plain:
            new = [c for s in _SENTENCE.split(text) for c in _CLAUSE.split(s) if c.strip()]
            count[k] += len(new)
            more += new
    more += words_of(more)[:SINGLE_WORDS] + random_words(RANDOM_TEXTS)
    return harmful + abuse_seed.texts(abuse_seed.HARMFUL), harmless + abuse_seed.texts(abuse_seed.HARMLESS), more


def random_words(n: int, seed: int = 10) -> list[str]:
    """Texts of random letters, as keys and encoded data are."""
    rng = np.random.default_rng(seed)
    return ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz  "), size=int(k))) for k in rng.integers(6, 60, n)]


@functools.lru_cache(maxsize=2)
def _trained(harmful: tuple, harmless: tuple, plain: tuple) -> Classifier:
    return train(list(harmful), list(harmless), list(plain))


def classifier(spark: SparkSession, sf_dir: str) -> Classifier:
    """The classifier of a folder's labels; the same training texts are trained on once."""
    return _trained(*map(tuple, training_texts(spark, sf_dir)))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, source, score) of every document."""
    batch_rows(spark, 2000)
    c = classifier(spark, sf_dir)
    kept = spark.sparkContext.broadcast(c.parts())  # bounded by the training texts: a few MB

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        return pd.Series(_loaded(kept).scores(list(text)), dtype=float)

    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return docs.select("doc_id", "source", score("text").alias("score"))


_LOADED: dict[tuple, Classifier] = {}


def _loaded(kept) -> Classifier:
    """The classifier of a broadcast, one per worker, by the content of its weights."""
    places, weights, bias, words = kept.value
    key = (hash(places.tobytes()), hash(weights.tobytes()), bias, len(words))
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Classifier(*kept.value)
    return _LOADED[key]


def p10_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(spark, sf_dir).select("doc_id", F.round("score", 4).alias("score"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id) of documents to review."""
    return scores(spark, sf_dir).where(F.col("score") >= THRESHOLD).select("doc_id").distinct()


def p10_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, n_docs, n_flagged, rate); documents without source are a source of their own."""
    flag = (F.col("score") >= THRESHOLD).cast("long")
    return scores(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n_docs"), F.sum(flag).alias("n_flagged"), F.round(F.avg(flag.cast("double")), 6).alias("rate"))
