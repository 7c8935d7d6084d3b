"""Toxicity with a gapped-subsequence kernel, a support vector machine and Nyström landmarks.

Kernel: two character sequences are alike by their common subsequences of
three characters that lie within ``SPAN`` + 1 places, each weighted by
``DECAY`` to the places it spans, and normalised; an insult with a character
inserted, doubled, replaced by a look-alike or set apart by dots or blanks
still shares most of them.

Training, on a bounded sample of labelled documents: the words whose number of
contexts tells toxic documents from clean ones are the positive sentences'
witnesses, all others negative examples; landmarks are drawn from both, the
Nyström map turns the kernel into features, and a linear machine with squared
hinge loss is fitted by Newton steps. A document's margin is that of its
highest word; a logistic curve fitted on the sample turns it into a score.

Scoring: the machine is a weight per 3-character subsequence, so each text is
read once, in vectorised sums over its characters, and no kernel matrix is
formed.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import exp, lgamma
from math import log as log_
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coffer.llm.common import saved, shuffle_partitions

SPAN = 5
DECAY = 0.8
CLASSES = 32
EDGE = 31  # word edges, punctuation and characters that are no letters
#: Fixed look-alikes.
LOOKS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
#: Fixed: base letters of accented Latin-1 letters.
ACCENTS = {"áàâäãå": "a", "éèêë": "e", "íìîï": "i", "óòôöõ": "o", "úùûü": "u", "ç": "c", "ñ": "n", "ý": "y"}
_GROUP = 1 << 19


def _table() -> np.ndarray:
    """Class of each code point below 0x250; CLASSES marks white space."""
    out = np.full(0x250, EDGE, "u1")
    for c in range(0x250):
        low = chr(c).lower()
        if "a" <= low <= "z" and len(low) == 1:
            out[c] = ord(low) - 97
        elif chr(c).isspace():
            out[c] = CLASSES
        elif chr(c).isalpha():
            out[c] = 26 + c % 5
    for c, as_ in LOOKS.items():
        out[ord(c)] = ord(as_) - 97
    for letters, as_ in ACCENTS.items():
        for c in letters + letters.upper():
            out[ord(c)] = ord(as_) - 97
    return out


_CLASS = _table()


def classes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "u4")
    out = _CLASS[np.minimum(points, 0x24F)]
    far = points >= 0x250
    if far.any():
        letters = 26 + points[far] % 5
        out[far] = np.where(np.isin(points[far], (0x2000, 0x2003, 0x2009, 0x3000, 0x2028, 0x2029)), CLASSES, letters)
    return out


def _norms(lengths: np.ndarray) -> np.ndarray:
    """Root of the sum of squared weights of all subsequences of a word of each length."""
    total = np.zeros(len(lengths))
    for d in range(2, SPAN + 1):
        total += np.maximum(lengths - d, 0) * (d - 1) * DECAY ** (2 * d)
    return np.sqrt(total)


def _runs(cls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of what white space parts."""
    edges = np.flatnonzero(np.diff(np.concatenate(([False], cls != CLASSES, [False])).view("i1")))
    return edges[::2], edges[1::2]


def subsequences(cls: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """For each pair of gaps: places, codes and weight of the words' subsequences."""
    end_at = np.zeros(len(cls) + 1, "i8")
    n = ends - starts
    first = np.repeat(starts - np.concatenate(([0], np.cumsum(n)))[:-1], n) + np.arange(int(n.sum()))
    end_at[first] = np.repeat(ends, n)
    c = cls.astype("i4")
    for d2 in range(2, SPAN + 1):
        at = first[end_at[first] > first + d2]
        for d1 in range(1, d2):
            yield at, (c[at] * CLASSES + c[at + d1]) * CLASSES + c[at + d2], DECAY**d2


def _split(texts: list[str]):
    """Joined classes, the words' starts and ends (one edge on either side), and each word's text.

    Characters that are neither letters nor look-alikes are left out, so dots
    or hyphens inside a word are no obstacle; nor are blanks between single
    letters.
    """
    parts = []
    for t in texts:
        c = classes(t)
        parts += [_PAD, c[c != EDGE], _PAD]
    cls = np.concatenate(parts)
    bounds = np.cumsum([len(parts[k]) + 2 for k in range(1, len(parts), 3)])
    starts, ends = _runs(cls)
    # blanks between single letters do not part them
    lone = ends - starts == 1
    blank = ends[:-1][lone[:-1] & lone[1:] & (starts[1:] - ends[:-1] == 1)]
    if len(blank):
        cls = np.delete(cls, blank)
        bounds = bounds - np.searchsorted(blank, bounds)
        starts, ends = _runs(cls)
    doc = np.searchsorted(bounds, starts, "right")
    return np.where(cls == CLASSES, EDGE, cls), starts - 1, ends + 1, doc


def _margins(cls: np.ndarray, starts: np.ndarray, ends: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The margin of each word, before the intercept."""
    sums = np.zeros(len(starts))
    for half in (0, 1):  # neighbouring words share their edge: even and odd ones apart
        s, e = starts[half::2], ends[half::2]
        if not len(s):
            continue
        total = np.zeros(len(cls) + 1)
        for at, code, weight in subsequences(cls, s, e):
            total[at] += weight * weights[code]
        sums[half::2] = np.add.reduceat(total, np.column_stack((s, e)).ravel())[::2]
    return sums / np.maximum(_norms(ends - starts), 1e-9)


def best_words(texts: list[str], weights: np.ndarray) -> tuple[np.ndarray, list[str]]:
    """Each text's highest word margin and that word; texts without words have -1 and ''."""
    margins, words = np.full(len(texts), -1.0), [""] * len(texts)
    at = 0
    while at < len(texts):
        stop, size = at, 0
        while stop < len(texts) and (stop == at or size < _GROUP):
            size += len(texts[stop])
            stop += 1
        cls, starts, ends, doc = _split(texts[at:stop])
        if len(starts):
            m = _margins(cls, starts, ends, weights)
            order = np.lexsort((m, doc))
            last = order[np.flatnonzero(np.diff(np.append(doc[order], -1)))]
            margins[at + doc[last]] = m[last]
            for k in last:
                words[at + doc[k]] = _name(cls[starts[k] + 1 : ends[k] - 1])
        at = stop
    return margins, words


def _name(cls: np.ndarray) -> str:
    return (cls + 97).astype("u1").tobytes().decode("latin-1")


def _classes_of(name: str) -> np.ndarray:
    return np.concatenate((_EDGE, np.frombuffer(name.encode("latin-1"), "u1") - 97, _EDGE))


_PAD, _EDGE = np.array([CLASSES], "u1"), np.array([EDGE], "u1")


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # by subsequence code
    slope: float
    intercept: float

    def score(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.intercept, -30, 30)))


def _features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse normalised subsequence features of words, given as class names: row, code, value."""
    rows, codes, values = [], [], []
    for k, w in enumerate(words):
        cls = _classes_of(w)
        norm = _norms(np.array([len(cls)]))[0]
        for at, code, weight in subsequences(cls, np.array([0]), np.array([len(cls)])):
            rows.append(np.full(len(at), k))
            codes.append(code)
            values.append(np.full(len(at), weight / norm))
    return np.concatenate(rows), np.concatenate(codes), np.concatenate(values)


def _kernel(words: list[str], landmarks: np.ndarray) -> np.ndarray:
    """Kernel values of words against dense landmark features, in blocks of words."""
    out = np.zeros((len(words), landmarks.shape[1]))
    for at in range(0, len(words), 500):
        r, c, v = _features(words[at : at + 500])
        order = np.argsort(r, kind="stable")
        r, c, v = r[order], c[order], v[order]
        first = np.flatnonzero(np.concatenate(([True], np.diff(r) != 0)))
        out[at + r[first]] = np.add.reduceat(v[:, None] * landmarks[c], first, axis=0)
    return out


def fit_words(positive: list[str], weight: np.ndarray, negative: list[str], landmarks: list[str], cost: float = 10.0) -> np.ndarray:
    """Subsequence weights of a squared-hinge machine on Nyström features."""
    dense = np.zeros((CLASSES**3, len(landmarks)), "f8")
    r, c, v = _features(landmarks)
    np.add.at(dense, (c, r), v)
    values, vectors = np.linalg.eigh(dense.T @ dense)
    keep = values > 1e-6 * values.max()
    nystroem = vectors[:, keep] / np.sqrt(values[keep])
    x = _kernel(positive + negative, dense) @ nystroem
    x = np.column_stack((x, np.ones(len(x))))
    y = np.concatenate((np.ones(len(positive)), -np.ones(len(negative))))
    # both classes weigh the same
    w = np.concatenate((weight / weight.sum(), np.full(len(negative), 1 / max(1, len(negative))))) * len(y) / 2
    beta = np.zeros(x.shape[1])
    reg = np.eye(len(beta))
    reg[-1, -1] = 1e-3
    for _ in range(30):
        active = y * (x @ beta) < 1
        a = x[active] * w[active][:, None]
        new = np.linalg.solve(reg + cost * (a.T @ x[active]), cost * (a.T @ y[active]))
        if np.allclose(new, beta, atol=1e-7):
            break
        beta = new
    return dense @ (nystroem @ beta[:-1])


#: Letters of a training example: longer words give several.
MAX_WORD = 40


def _tokens(batches):
    """(word, context, toxic) once per document; longer words in stretches of ``MAX_WORD``
    letters, the context a hash of the words on either side."""
    for b in batches:
        words, contexts, toxic = [], [], []
        for text, label in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
            cls, starts, ends, _ = _split([text or ""])
            name = _name(cls)
            seq = [name[s + 1 : e - 1] for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
            found = {
                (w[k : k + MAX_WORD], crc32(f"{x} {y}".encode()))
                for x, w, y in zip(["", *seq], seq, [*seq[1:], ""], strict=False)
                for k in range(0, len(w), MAX_WORD)
            }
            words += [w for w, _ in found]
            contexts += [c for _, c in found]
            toxic += [label] * len(found)
        yield pa.RecordBatch.from_arrays(
            [pa.array(words, pa.string()), pa.array(contexts, pa.int64()), pa.array(toxic, pa.int64())], ["word", "context", "toxic"]
        )


def _told(table: list, share: float, false: float = 0.1) -> list[tuple[int, int]]:
    """(contexts, toxic ones) counts that mark a word as toxic.

    ``table`` has (contexts, toxic, words). At least half of a word's
    contexts must be toxic; were words indifferent, the toxic count would be
    binomial, and among words of like frequency at most a tenth of those kept
    are such by chance (Benjamini and Hochberg's step-up rule).
    """
    bins: dict[int, list] = {}
    for n, p, count in table:
        tail = sum(
            exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * log_(share) + (n - k) * log_(1 - share))
            for k in range(p, min(n, p + 60) + 1)
        ) if 2 * p >= n else 1.0
        bins.setdefault(n.bit_length(), []).append((tail, n, p, count))
    out = []
    for rows in bins.values():
        rows.sort()
        words, seen, last = sum(r[3] for r in rows), 0, -1
        for k, (tail, _, _, count) in enumerate(rows):
            seen += count
            if tail * words <= false * seen:
                last = k
        out += [(n, p) for tail, n, p, _ in rows[: last + 1] if 2 * p >= n and p >= 2]
    return out


def fit(
    docs: DataFrame,
    labels: DataFrame,
    max_rows: int = 12_000,
    max_positive: int = 2_000,
    max_negative: int = 8_000,
    n_landmarks: int = 256,
    rounds: int = 4,
) -> Model:
    """Fits the model on at most ``max_rows`` labelled documents that are not held out.

    The sample is the documents with the smallest hashed doc_ids, a row of each
    (that with the smallest hashed text). After the
    first fit, the highest words of clean documents join the negative
    examples (``rounds`` times). What the driver gets is bounded by the
    parameters: words and, for the calibration, a number and a word per
    sampled document. Without labels of both kinds every score is 0.
    """
    free = labels.filter(F.col("toxic").isin(0, 1)).filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)
    free = free.groupBy("doc_id").agg(F.max("toxic").cast("long").alias("toxic"))
    chosen = free.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    # of rows that share a doc_id one is taken, so the sample is bounded whatever is repeated
    one = F.min_by("text", F.xxhash64("text"))
    texts = rows.groupBy("doc_id").agg(one.alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic")
    sample = saved(texts.repartition(shuffle_partitions(docs.sparkSession)), "toxicity-sample")
    n = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    none = Model(np.zeros(CLASSES**3, "f4"), 0.0, -30.0)
    if not n.get(1) or not n.get(0):
        return none
    seen = saved(
        sample.mapInArrow(_tokens, "word string, context long, toxic long")
        .groupBy("word", "context")  # copies of a document share its contexts and count once
        .agg(F.max("toxic").alias("toxic"))
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("p")),
        "toxicity-words",
    )
    # a row per pair of counts; words are Zipfian, so most share few pairs
    table = [tuple(r) for r in seen.groupBy("n", "p").agg(F.count(F.lit(1)).alias("words")).collect()]
    toxic = sum(p * c for _, p, c in table)
    told = _told(table, toxic / max(1, sum(m * c for m, _, c in table)))
    if not told:
        return none
    pairs = docs.sparkSession.createDataFrame(told, "n long, p long")
    marks = seen.join(F.broadcast(pairs), ["n", "p"]).orderBy(F.desc("p"), "n", "word").limit(max_positive).collect()
    other = seen.filter(F.col("p") * 4 < F.col("n"))
    common = other.orderBy(F.desc("n"), "word").limit(max_negative // 4).collect()
    rest = other.orderBy(F.xxhash64("word"), "word").limit(max_negative).collect()
    positive = [r["word"] for r in marks]
    negative = list(dict.fromkeys(r["word"] for r in [*common, *rest]))[:max_negative]
    landmarks = positive[: n_landmarks * 3 // 4] + negative[: n_landmarks // 4]
    taken = {*positive, *negative}
    for k in range(rounds):
        weights = fit_words(positive, np.sqrt([r["p"] for r in marks]), negative, landmarks).astype("f4")
        found = sample.mapInArrow(_measure(weights), "margin double, word string, toxic long").collect()  # max_rows at most
        if k < rounds - 1:
            hard = sorted({r["word"] for r in found if not r["toxic"] and r["margin"] > -0.5} - taken)
            negative += hard
            taken.update(hard)
    slope, intercept = _logistic(np.array([r["margin"] for r in found]), np.array([r["toxic"] for r in found], "f8"))
    return Model(weights, slope, intercept)


def _measure(weights: np.ndarray):
    def run(batches):
        for b in batches:
            margins, words = best_words([t or "" for t in b.column("text").to_pylist()], weights)
            for k, w in enumerate(words):
                if w and len(w) > MAX_WORD:  # its highest stretch stands for it
                    parts = (w[i : i + MAX_WORD] for i in range(0, len(w), MAX_WORD))
                    words[k] = best_words([" ".join(parts)], weights)[1][0]
            yield pa.RecordBatch.from_arrays([pa.array(margins), pa.array(words), b.column("toxic")], ["margin", "word", "toxic"])

    return run


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (not negative) and intercept of a slightly regularised logistic curve."""
    a = np.column_stack((x, np.ones(len(x))))
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + np.diag([1e-3, 1e-3])
        step = np.linalg.solve(h, a.T @ (y - p) - 1e-3 * beta)
        beta = beta + step
        if np.abs(step).max() < 1e-8:
            break
    return max(0.0, float(beta[0])), float(beta[1])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted per input row; null and empty texts have no words.

    Repeated rows give repeated results; a null doc_id counts as not held
    out. Other columns are ignored.
    """
    weights = docs.sparkSession.sparkContext.broadcast(model.weights)  # 32**3 numbers
    slim = Model(np.empty(0), model.slope, model.intercept)

    def run(batches):
        for b in batches:
            got = slim.score(best_words([t or "" for t in b.column("text").to_pylist()], weights.value)[0])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(got)], ["doc_id", "held_out", "score"])

    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False)).alias("held_out")
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", "text", held).mapInArrow(run, f"doc_id {kind}, held_out boolean, score double")
    return out.select("*", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fits on the labelled rows that are not held out, then scores every row."""
    return score(docs, fit(docs, labels))
