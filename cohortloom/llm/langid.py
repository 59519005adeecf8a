"""Language identification in two levels.

The languages learned are first gathered into families by the likeness of their character
n-gram profiles. A text's family is chosen by one linear support vector machine per
family; inside the family one machine for each pair of languages votes. All machines read
hashed byte n-grams of the whole text, so a text is scored by sums of looked-up weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts_of
from .sampling import is_held_out, spread_sample

#: Documents of each language that the machines learn from, at most, and of all of them.
PER_LANGUAGE, IN_ALL = 400, 8000
#: Buckets of the hashed n-grams, and their lengths in bytes.
BUCKETS = 1 << 13
ORDERS = (1, 2, 3)
#: Characters of text hashed at a time.
SLICE = 1 << 16
#: Bytes of words: ASCII letters and all bytes of longer characters; the rest is a space.
_LETTERS = bytes(b if 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
#: Odd multipliers that mix the bytes of an n-gram.
_MIX = np.array([0x9E37, 0x85EB, 0xC2B3], dtype=np.uint32)
#: Language of a text that is null or has no letter.
UNKNOWN = "und"


def has_letter(text: str) -> bool:
    """True if any character is a letter."""
    return any(map(str.isalpha, text))


def hashed_ngrams(text: str) -> Iterator[np.ndarray]:
    """Buckets of the n-grams of the lower-cased text, a bounded slice at a time."""
    for i in range(0, max(1, len(text)), SLICE):
        data = b" " + text[i : i + SLICE].lower().encode("utf-8", "replace").translate(_LETTERS) + b" "
        codes = np.frombuffer(data, dtype=np.uint8).astype(np.uint32)
        word = codes != 32
        for n in ORDERS:
            if len(codes) < n:
                continue
            h = np.full(len(codes) - n + 1, n * 0x27D4, dtype=np.uint32)
            any_letter = np.zeros(len(h), dtype=bool)
            for k in range(n):
                h = (h ^ codes[k : k + len(h)]) * _MIX[k]
                h ^= h >> np.uint32(11)
                any_letter |= word[k : k + len(h)]
            yield (h & np.uint32(BUCKETS - 1))[any_letter]


def profile(text: str) -> np.ndarray:
    """Relative frequencies of the hashed n-grams, square-rooted to tame the frequent ones."""
    counts = np.zeros(BUCKETS)
    for buckets in hashed_ngrams(text):
        counts += np.bincount(buckets, minlength=BUCKETS)
    return np.sqrt(counts / max(counts.sum(), 1.0))


def train_svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, sweeps: int = 30) -> np.ndarray:
    """Weights of a linear support vector machine (labels 1 and -1) by dual coordinate descent.

    The bias is an additional constant feature, the last weight. Classes weigh alike.
    """
    w, alpha = np.zeros(x.shape[1] + 1), np.zeros(len(x))
    norm = np.einsum("ij,ij->i", x, x, dtype=np.float64) + 1
    top = np.where(y > 0, c * len(y) / (2 * max(1, (y > 0).sum())), c * len(y) / (2 * max(1, (y < 0).sum())))
    order = np.arange(len(x))
    shuffle = np.random.default_rng(7)
    for _ in range(sweeps):
        shuffle.shuffle(order)
        most = 0.0
        for i in order:
            gradient = y[i] * (w[:-1] @ x[i] + w[-1]) - 1
            new = min(max(alpha[i] - gradient / norm[i], 0.0), top[i])
            if new != alpha[i]:
                w[:-1] += (new - alpha[i]) * y[i] * x[i]
                w[-1] += (new - alpha[i]) * y[i]
                most = max(most, abs(new - alpha[i]))
                alpha[i] = new
        if most < 1e-3:
            break
    return w


@dataclass
class Machine:
    """A separating plane and the margin at which it is quite sure."""

    weights: np.ndarray
    scale: float

    def margin(self, x: np.ndarray) -> float:
        """Signed margin in units of the usual one."""
        return float(self.weights[:-1] @ x + self.weights[-1]) / self.scale


@dataclass
class Model:
    """Families of languages, a machine for each family and for each pair within one."""

    families: list[list[str]] = field(default_factory=list)
    family: list[Machine | None] = field(default_factory=list)
    pair: dict[tuple[str, str], Machine] = field(default_factory=dict)

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and a score from 0 to 1."""
        if not text or not self.families or not has_letter(text):
            return UNKNOWN, 0.0
        x = profile(text)
        margins = [m.margin(x) if m else 0.0 for m in self.family]
        best = int(np.argmax(margins))
        score = 1.0
        if len(margins) > 1:
            others = [m for i, m in enumerate(margins) if i != best]
            score = _sure((margins[best] - max(others)) / 2)
        votes = dict.fromkeys(self.families[best], 0)
        total = dict.fromkeys(self.families[best], 0.0)
        for a, b in combinations(self.families[best], 2):
            m = self.pair[a, b].margin(x)
            votes[a if m > 0 else b] += 1
            total[a] += m
            total[b] -= m
        lang = max(self.families[best], key=lambda k: (votes[k], total[k], k))
        if len(votes) > 1:
            score *= _sure(total[lang] / (len(votes) - 1))
        return lang, score


def _sure(margin: float) -> float:
    return float(1 / (1 + np.exp(-3 * max(-30.0, min(30.0, margin)))))


def _machine(x: np.ndarray, y: np.ndarray) -> Machine:
    w = train_svm(x, y)
    usual = float(np.median(np.abs(x @ w[:-1] + w[-1])))
    return Machine(w, max(usual, 1e-9))


def language_families(profiles: dict[str, np.ndarray], families: int | None = None) -> list[list[str]]:
    """Gather languages by the cosine of their mean profiles, nearest families first."""
    wanted = families or max(1, round(np.sqrt(len(profiles))))
    groups = [[k] for k in sorted(profiles)]
    unit = {k: v / max(np.linalg.norm(v), 1e-12) for k, v in profiles.items()}
    while len(groups) > wanted:
        near = max(combinations(range(len(groups)), 2), key=lambda ij: np.mean([unit[a] @ unit[b] for a in groups[ij[0]] for b in groups[ij[1]]]))
        groups[near[0]] = sorted(groups[near[0]] + groups[near[1]])
        del groups[near[1]]
    return groups


def fit(texts: list[str], langs: list[str], families: int | None = None) -> Model:
    """Learn families and machines from texts and their languages."""
    rows = sorted((lang, t) for lang, t in zip(langs, texts) if t and has_letter(t))
    if not rows:
        return Model()
    lang_of = np.array([r[0] for r in rows])
    x = np.stack([profile(r[1]).astype(np.float32) for r in rows])
    groups = language_families({k: x[lang_of == k].mean(axis=0) for k in sorted(set(langs) & set(lang_of.tolist()))}, families)
    model = Model(groups)
    for group in groups:
        inside = np.isin(lang_of, group)
        model.family.append(None if inside.all() else _machine(x, np.where(inside, 1.0, -1.0)))
        for a, b in combinations(group, 2):
            two = np.isin(lang_of, (a, b))
            model.pair[a, b] = _machine(x[two], np.where(lang_of[two] == a, 1.0, -1.0))
    return model


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, families: int | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model of the training rows of ``docs``: a sample of ``per_language`` rows each.

    Where there are many languages each has a smaller share of IN_ALL rows, 20 at least, so
    the driver's matrix of profiles stays small. Rows of the held-out fold and rows without
    a language are never learned from.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~is_held_out())
    languages = own.select("lang").distinct().count()
    per_language = max(1, min(per_language, max(20, IN_ALL // max(languages, 1))))
    chosen = spread_sample(own.select("doc_id", "lang"), "lang", per_language).select("doc_id")
    # At most per_language rows a language: a bounded table of identifiers.
    # Of rows that share an id the smallest counts, so the sample is the same every time.
    rows = own.join(F.broadcast(chosen), "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct("lang", "text")).alias("r")).select("r.text", "r.lang").collect()
    return fit([r.text or "" for r in rows], [r.lang for r in rows], families)


def predict_languages(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, held_out, lang_pred, score), one per row of ``docs``; no shuffle.

    lang_pred is ``und`` with score 0 where the text is null or has no letter, or where
    nothing was learned. Only the text is read for a prediction, as a whole. Repeated rows
    stay; a null doc_id counts as not held out; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.predict(t) for t in texts_of(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(2), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), is_held_out(id_col).alias("held_out"))
    return own.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
