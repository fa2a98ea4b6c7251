"""Toxicity by a support vector machine on a subsequence string kernel with Nystroem landmarks.

A text is read in units: its words, long words in overlapping windows, single letters in a row joined. The kernel of
two units counts the subsequences of ORDER characters that they share, each weighted by DECAY for every character that
its occurrence spans, so that gaps and inserted characters lower it and do not end it; spans over REACH count nothing.
Units are mapped to their kernels with landmarks, whitened by the landmarks' own kernel matrix, and separated by an
L2 support vector machine. Characters are taken in compatibility form, without marks that compose with nothing and without invisible ones; letters
that look like Latin ones are read as such in words of none but both. Letters of all scripts bear weight: those that are no
a-z, accented or not, are hashed into FOREIGN classes. Scripts without blanks are read in pairs of characters, or in fours
of letters, and an ideograph or kana is two symbols. Only documents are labelled: a toxic document's witness is the unit that the machine, so
far, holds most toxic; every unit of the others is a negative.

The trained function is linear in the subsequences' weights, so that landmarks, whitening and machine fold into one
table of weights by subsequence; scoring a unit adds up its own.
"""

from __future__ import annotations

import functools
import itertools
import re
import unicodedata
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import labelled_sample, map_texts, once_a_worker, remainder

ORDER, DECAY, REACH = 4, 0.7, 7
#: Classes of characters: 26 letters, a word's beginning, the letters that often bear an accent, what is no letter, other letters by hash.
BEGIN, ACCENTED, OTHER, FOREIGN = 26, "aceinouy", 35, 16
CLASSES = OTHER + 1 + FOREIGN
#: Characters of a window and the step between windows of a long word.
WINDOW, STEP = 14, 7
#: Training texts of either label at most; landmarks; rounds of choosing witnesses.
SAMPLE, LANDMARKS, ROUNDS = 1000, 96, 3
#: The share of the hard negatives in the weight of all negatives.
HARD = 0.5
#: A unit of at least this score counts as toxic evidence.
EVIDENCE = 0.25
#: Signs that are taken out of words.
SIGNS = ".,;:!?*-_|\"'()#%&"
REMEMBERED = 500_000
SPACED = re.compile(r"(?<!\w)(?:\w[ .\-_*]{1,2}){3,}\w(?!\w)")
#: Fixed table of signs that stand for letters.
LOOKALIKES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
#: Letters that look like Latin ones, in lower case.
LETTERS = str.maketrans("аеорсухіјѕԁһԛԝкмтвнѵ" + "αονικρτυχεηωγβμ" + "ɑɡı", "aeopcyxijsdhqwkmtbhv" + "aovikptuxenwybm" + "agi")
#: Marks that are left when letters are composed, and invisible signs.
FOLD = re.compile("[\u0300-\u036f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\ufe00-\ufe0f\ufe20-\ufe2f\u00ad\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufeff]")
#: Runs of scripts without blanks: ideographs and kana; letters of Thai, Lao, Burmese and Khmer.
PAIRS = re.compile("[\u3005-\u3007\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]+")
FOURS = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff]+")
#: The first of FOREIGN private characters that stand for a class each.
SYMBOL = 0xE000


def _hash(c: str) -> int:
    return (ord(c) * 0x9E3779B97F4A7C15 % 2**64) >> 32


@functools.lru_cache(maxsize=1 << 17)
def _class(c: str) -> int:
    if SYMBOL <= ord(c) < SYMBOL + FOREIGN:
        return OTHER + 1 + ord(c) - SYMBOL
    plain = unicodedata.normalize("NFKD", LOOKALIKES.get(c, c)).lower()
    if not "a" <= plain[:1] <= "z":
        base = plain[0] if all(map(unicodedata.combining, plain[1:])) else c
        return OTHER + 1 + _hash(base) % FOREIGN if unicodedata.category(c)[0] in "LM" else OTHER
    return BEGIN + 1 + ACCENTED.index(plain[0]) if len(plain) > 1 and plain[0] in ACCENTED else ord(plain[0]) - 97


CLASS = np.array([_class(chr(i)) for i in range(0x250)] + [OTHER], np.int32)


def symbols(text: str) -> str:
    """Two private characters for each of text."""
    return "".join(chr(SYMBOL + _hash(c) % FOREIGN) + chr(SYMBOL + _hash(c) // FOREIGN % FOREIGN) for c in text)


def words_of(plain: str) -> list[str]:
    """The words of a text in lower case; those that look Latin as Latin ones, and as they are if no letter is."""
    if plain.isascii():
        return plain.split()
    out = []
    for m in PAIRS.finditer(plain):
        out += [symbols(m[0][i : i + 2]) for i in range(max(1, len(m[0]) - 1))]
    for m in FOURS.finditer(plain):
        out += [m[0][i : i + 4] for i in range(max(1, len(m[0]) - 3))]
    for w in FOURS.sub(" ", PAIRS.sub(" ", plain)).split():
        if not w.isascii() and (latin := w.translate(LETTERS)) != w and all(c < "\u0250" for c in latin if c.isalpha()):
            out.append(latin)
            if any("a" <= c <= "z" for c in w):
                continue
        out.append(w)
    return out


def units(text: str) -> list[str]:
    """The units of a text: words, and runs of spaced-out letters joined."""
    whole = text.lower() if text.isascii() else FOLD.sub("", unicodedata.normalize("NFKC", text).lower())
    plain = whole
    for c in SIGNS:
        plain = plain.replace(c, "")
    out = words_of(plain)
    if SPACED.search(whole):
        for m in SPACED.finditer(whole):
            out += words_of("".join(c for c in m[0] if c.isalnum()))
    return out


def windows(unit: str) -> list[str]:
    """The unit with a mark of its beginning, in windows that overlap if it is long."""
    marked = "\x00" + unit
    return [marked] if len(marked) <= WINDOW + 1 else [marked[s : s + WINDOW + 1] for s in range(0, len(marked) - STEP, STEP)]


@functools.lru_cache(maxsize=64)
def subsequences(length: int) -> tuple[np.ndarray, np.ndarray]:
    """[subsequence, ORDER] positions and weights of all subsequences of a unit of that length that span at most REACH."""
    lists = [(i,) for i in range(length)]
    for _ in range(ORDER - 1):
        lists = [(*x, j) for x in lists for j in range(x[-1] + 1, min(length, x[0] + REACH))]
    at = np.array(lists, np.int64).reshape(-1, ORDER)
    weight = DECAY ** (at[:, -1] - at[:, 0] + 1 - ORDER) if len(at) else np.zeros(0)
    return at, weight / max(1e-9, float(np.sqrt((weight**2).sum())))


def classes(words: list[str]) -> np.ndarray:
    """[unit, character] classes of units of one length, whose first character is the mark or not."""
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), -1)
    out = CLASS[np.minimum(codes, len(CLASS) - 1)]
    far = codes >= len(CLASS) - 1
    if far.any():
        distinct, at = np.unique(codes[far], return_inverse=True)
        out[far] = np.array([_class(chr(c)) for c in distinct.tolist()], np.int32)[at]
    out[codes == 0] = BEGIN
    return out


def codes_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """[unit, subsequence] numbers, and the subsequences' normed weights."""
    at, weight = subsequences(len(words[0]))
    c = classes(words)
    number = c[:, at[:, 0]]
    for k in range(1, ORDER):
        number = number * np.int32(CLASSES) + c[:, at[:, k]]
    return number, weight


def lettered(number: np.ndarray) -> np.ndarray:
    """Which subsequences hold no character of the class OTHER."""
    ok = np.ones(number.shape, bool)
    for k in range(ORDER):
        ok &= number // CLASSES**k % CLASSES != OTHER
    return ok


def by_length(words: list[str]) -> dict[int, list[int]]:
    groups: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        groups.setdefault(len(w), []).append(i)
    return groups


class Kernel:
    """Kernels with fixed landmarks: a table of the landmarks' subsequences by their numbers."""

    def __init__(self, landmarks: list[str]):
        parts = [codes_of([z]) for z in landmarks]
        self.numbers = np.unique(np.concatenate([n[0][lettered(n[0])] for n, _ in parts]))
        self.column = np.full(CLASSES**ORDER, -1, np.int32)
        self.column[self.numbers] = np.arange(len(self.numbers))
        self.table = np.zeros((len(self.numbers), len(landmarks)), np.float32)
        for j, (n, w) in enumerate(parts):
            ok = lettered(n[0])
            np.add.at(self.table[:, j], self.column[n[0][ok]], w[ok])
        self.table /= np.maximum(1e-9, np.sqrt((self.table**2).sum(axis=0)))

    def of(self, words: list[str]) -> np.ndarray:
        """[unit, landmark] kernels."""
        out = np.zeros((len(words), self.table.shape[1]), np.float32)
        for members in by_length(words).values():
            for s in range(0, len(members), 512):
                part = members[s : s + 512]
                number, weight = codes_of([words[i] for i in part])
                column = self.column[number]
                row, sub = np.nonzero(column >= 0)
                dense = np.bincount(row * len(self.numbers) + column[row, sub], weight[sub], len(part) * len(self.numbers)).astype(np.float32)
                out[part] = dense.reshape(len(part), -1) @ self.table
        return out


def separate(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3, steps: int = 25) -> np.ndarray:
    """Weights, the last a constant, of the L2 support vector machine, by Newton steps on the rows inside the margin."""
    w, last, total = np.zeros(x.shape[1] + 1), None, weight.sum()
    parts = [slice(s, s + 8192) for s in range(0, len(x), 8192)]  # in double precision only a part at once
    with_one = lambda part: np.concatenate([x[part], np.ones((len(x[part]), 1))], axis=1).astype(np.float64)
    for _ in range(steps):
        inside = np.concatenate([y[p] * (with_one(p) @ w) < 1 for p in parts])
        if last is not None and (inside == last).all():
            break
        left, right = ridge * np.eye(len(w)), np.zeros(len(w))
        for p in parts:
            z = with_one(p)[inside[p]]
            a = z * weight[p][inside[p], None] / total
            left += a.T @ z
            right += a.T @ y[p][inside[p]]
        w, last = np.linalg.solve(left, right), inside
    return w


class Model:
    """weights by subsequence, a constant, and the calibration of a text's evidence."""

    def __init__(self, weights: np.ndarray, constant: float, calibration: np.ndarray):
        self.weights, self.constant, self.calibration = weights, constant, calibration

    def __getstate__(self) -> tuple:
        at = np.flatnonzero(self.weights)
        return at.astype(np.int32), self.weights[at], self.constant, self.calibration

    def __setstate__(self, state: tuple) -> None:
        at, weights, self.constant, self.calibration = state
        self.weights = np.zeros(CLASSES**ORDER, np.float32)
        self.weights[at] = weights

    def window_scores(self, texts: list[str]) -> np.ndarray:
        """The decision function of each window; -1 for those that are too short to hold a subsequence."""
        out = np.full(len(texts), -1.0)
        for length, members in by_length(texts).items():
            if length < ORDER:
                continue
            step = max(1, (1 << 20) // len(subsequences(length)[0]))
            for s in range(0, len(members), step):
                part = members[s : s + step]
                number, weight = codes_of([texts[i] for i in part])
                out[part] = self.weights[number] @ weight.astype(np.float32) + self.constant
        return out

    def unit_scores(self, words: list[str]) -> np.ndarray:
        """The highest score of each unit's windows, -1 at least."""
        out, pieces = np.full(len(words), -1.0), [(i, w) for i, u in enumerate(words) for w in windows(u)]
        np.maximum.at(out, np.array([i for i, _ in pieces], np.int64), self.window_scores([w for _, w in pieces]))
        return out

    def best_window(self, unit: str) -> str:
        every = windows(unit)
        return every[int(self.window_scores(every).argmax())]

    def probability(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(np.concatenate([evidence, np.ones((len(evidence), 1))], axis=1) @ self.calibration, -30, 30)))


class Scorer:
    """A model and the units met so far."""

    def __init__(self, model: Model):
        self.model, self.known = model, {}

    def learn(self, distinct: set[str]) -> None:
        if len(self.known) + len(distinct) > REMEMBERED:
            self.known = {}
        new = sorted(distinct.difference(self.known))
        for s in range(0, len(new), 50_000):
            self.known.update(zip(new[s : s + 50_000], self.model.unit_scores(new[s : s + 50_000]).tolist(), strict=True))

    def evidence(self, texts: list[str]) -> np.ndarray:
        """[text, 2]: the highest score of a unit, and how many (3 at most) are toxic."""
        found = [units(t) for t in texts]
        self.learn(set().union(*found))
        out, get = np.empty((len(texts), 2)), self.known.__getitem__
        for i, f in enumerate(found):
            scores = list(map(get, f))
            top = max(scores, default=-1.0)
            out[i] = top, min(3, sum(s > EVIDENCE for s in scores)) if top > EVIDENCE else 0
        return out


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 30) -> np.ndarray:
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x / len(x) + ridge * np.eye(len(w))
        w -= np.linalg.solve(h, x.T @ (p - y) / len(x) + ridge * w)
    return w


def fit(rows: list[tuple[str, int]]) -> Model | None:
    """A model from labelled texts; None if a label has none."""
    rows = sorted(rows)
    y = np.array([r[1] for r in rows])
    if not len(y) or y.min() == y.max():
        return None
    sets = [sorted(set(units(t))) for t, _ in rows]
    seen: dict[str, list[int]] = {}
    for s, label in zip(sets, y, strict=True):
        for u in s:
            seen.setdefault(u, [0, 0])[label] += 1
    n = [max(1, int((y == k).sum())) for k in (0, 1)]
    odds = {u: np.log((c[1] + 0.1) / (n[1] + 0.2)) - np.log((c[0] + 0.1) / (n[0] + 0.2)) for u, c in seen.items() if len(u) >= ORDER - 1}
    lean = sorted((u for u in odds if odds[u] > 1.5 and seen[u][1] >= min(3, n[1])), key=lambda u: (-seen[u][1] * odds[u], u))
    lean = lean or sorted(odds, key=lambda u: (-odds[u], u))[:8]
    clean = sorted((u for u, c in seen.items() if not c[1] or odds.get(u, 0) < 0), key=lambda u: hash64(u))
    usable = lambda some: (w for u in some for w in windows(u) if len(w) >= ORDER and lettered(codes_of([w])[0]).any())
    toxic_part, clean_part = (list(itertools.islice(dict.fromkeys(usable(some)), n)) for some, n in ((lean, LANDMARKS * 3 // 4), (clean, LANDMARKS // 4)))
    landmarks = list(dict.fromkeys(toxic_part + clean_part))
    if not landmarks:
        return None
    kernel = Kernel(landmarks)
    own = kernel.table.T @ kernel.table
    value, vector = np.linalg.eigh(own.astype(np.float64))
    value = np.maximum(value, 1e-3)
    whiten = vector @ np.diag(value**-0.5) @ vector.T

    def model(w: np.ndarray, calibration: np.ndarray) -> Model:
        weights = np.zeros(CLASSES**ORDER, np.float32)
        weights[kernel.numbers] = kernel.table @ (whiten @ w[:-1])
        return Model(weights, float(w[-1]), calibration)

    negative = [w for u in clean for w in windows(u) if len(w) >= ORDER]
    narrow = whiten.astype(np.float32)
    below = kernel.of(negative) @ narrow
    positive = [w for u in lean[:LANDMARKS] for w in windows(u) if len(w) >= ORDER]  # the first guess; later rounds look at all toxic texts
    now, hard = None, np.zeros((0, below.shape[1]), np.float32)
    for _ in range(ROUNDS):
        x = np.concatenate([kernel.of(positive) @ narrow, below, hard])
        labels = np.concatenate([np.ones(len(positive)), -np.ones(len(below) + len(hard))])
        share = HARD if len(hard) else 0.0
        weight = np.concatenate([np.full(len(z), part / max(1, len(z))) for z, part in ((positive, 0.5), (below, 0.5 * (1 - share)), (hard, 0.5 * share))])
        now = model(separate(x, labels, weight), np.array([4.0, 0.0, 0.0]))
        scorer = Scorer(now)
        scorer.learn(set(clean).union(*(s for s, label in zip(sets, y, strict=True) if label)))
        score = scorer.known
        best = [max(s, key=lambda u: (score[u], u)) for s, label in zip(sets, y, strict=True) if label and s]
        witness = sorted({u for u in best if score[u] > -0.5 and (seen[u][0] == 0 or odds.get(u, 0) > 1.5)})
        positive = [w for w in (now.best_window(u) for u in witness) if len(w) >= ORDER] or positive
        worst = [u for u in clean if score[u] > -0.8]  # counted once more, as negatives that are hard to tell
        hard = kernel.of([w for u in worst for w in windows(u) if len(w) >= ORDER]) @ narrow if worst else hard
    now.calibration = logistic(Scorer(now).evidence([t for t, _ in rows]), y)
    return now


def hash64(u: str) -> int:
    h = 1469598103934665603
    for b in u.encode("utf-8", "surrogatepass"):
        h = (h ^ b) * 1099511628211 % (1 << 64)
    return h


def score_toxicity(documents: DataFrame, labels: DataFrame, folds: int = 5, left_out: int = 0, most: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted: a row for each row of documents, from its whole text.

    Fitted on the driver to at most `most` texts of either label whose crc32 of the id mod `folds` is not left_out;
    held_out marks the others, and rows without an id. Null and empty texts have the score of no evidence. Without
    labelled texts of both kinds all scores are 0.
    """
    model = fit(labelled_sample(documents, labels, "toxic", folds, left_out, most))
    shared, token = documents.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t or "" for t in batch.column(1).to_pylist()]
        if shared.value is None:
            p = np.zeros(len(texts))
        else:
            p = shared.value.probability(once_a_worker(token, lambda: Scorer(shared.value)).evidence(texts))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(p, pa.float64())], ["doc_id", "score"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    scored = map_texts(documents.select("doc_id", "text"), "text", fn, f"doc_id {kind}, score double")
    held_out = F.coalesce(remainder(F.col("doc_id"), folds) == left_out, F.lit(True))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
