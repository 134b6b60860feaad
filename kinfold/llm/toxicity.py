"""Toxicity by a support vector machine on a gapped subsequence string kernel.

A text is seen as sentences, a sentence by its most suspicious window: a word,
or up to ``WIDEST`` neighbouring words with the white space between them left
out, so that an insult in parts reads like a whole one. The kernel of two
windows counts the character triples they share in order, each weighted by
``DECAY`` per character in its gaps, up to a span; a window with inserted or
missing characters keeps most of its triples. The kernel is approximated on
Nyström landmarks (windows of labelled sentences), and the machine is trained
on those features.

The machine is linear in them, and they are linear in the triples, so training
ends in one weight per triple. A task scores each different word once, in
blocks, and keeps the scores of recent words; neighbouring words are scored by
running sums over the text. A text's score is a calibrated function of its two
most suspicious windows that do not overlap, over the whole text, without a
shuffle.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.llm.common import (
    fit_logistic,
    in_training,
    label_share,
    labelled_sample,
    logistic,
    new_name,
    ship,
    table,
    text_of,
)

PER_CLASS = 1500  # texts of each class learned from, at most
SAMPLE_CHARS = 20_000  # longest text learned from
LANDMARKS = 160
SPAN = 6  # characters from the first to the last of a triple, at most
DECAY = 0.6
SYMBOLS = 64  # letters told apart; the first two are "other" and the start of a word
LONGEST = 32  # characters of a word that are compared at once
STEP = 24  # longer words are compared in overlapping windows
WIDEST = 3  # neighbouring words seen as one window, at most
EXCESS = 3.5  # standard deviations from which on a word is suspect at first
PAIR_EXCESS = 4.5  # the same for two neighbouring words, of which there are many more
CLEAN_SHARE = 0.995  # of clean texts have no window of several words above the floor
JOINED = 4000  # windows of several clean words learned from at first
KEPT = 300_000  # word scores kept by a task
CHUNK = 20_000  # words whose windows are scored at once
THRESHOLD = 0.5
_SPELLED = re.compile(r"(?<!\S)\S(?:\s++\S){2,}(?!\S)")
_EDGES = ".,;:!?\"'()[]{}<>"
_GAPS = [(j, k) for j in range(1, SPAN) for k in range(j + 1, SPAN)]


def _spelled(text: str, words: list[str]) -> list[str]:
    return ["".join(s.split()) for s in _SPELLED.findall(text)] if len(words) > 2 else []


def words_of(text: str) -> list[str]:
    """Words in lower case; letters spelled one by one are a word as well."""
    text = text.lower()
    words = text.split()
    return words + _spelled(text, words)


def sentences_of(text: str) -> list[str]:
    return [s for s in re.split(r"[.!?\n]+", text) if s.strip()]


@dataclass(frozen=True)
class Machines:
    """Weights of the triples of words, and of neighbouring words."""

    triples: np.ndarray
    bias: float
    join_triples: np.ndarray
    join_bias: float
    floor: float  # value up to which neighbouring words are as those of clean texts


@dataclass(frozen=True)
class ToxicityModel:
    """The machines over an alphabet, and the calibration; without weights a constant."""

    alphabet: str
    machines: Machines | None
    weights: tuple[float, ...]
    constant: float = 0.5


class Kernel:
    """Triples of words over an alphabet."""

    def __init__(self, alphabet: str):
        self.alphabet = alphabet
        self.code = {c: i + 2 for i, c in enumerate(alphabet)}
        self.table = np.zeros(0x110000, np.int32)
        self.table[[ord(c) for c in alphabet]] = np.arange(2, len(alphabet) + 2)

    def _encoded(self, windows: list[str]) -> np.ndarray:
        """Codes of the start and the characters, -1 behind the end."""
        out = np.full((len(windows), LONGEST + 1 + SPAN), -1, np.int32)
        out[:, 0] = 1
        for i, w in enumerate(windows):
            out[i, 1 : len(w) + 1] = [self.code.get(c, 0) for c in w]
        return out

    def triples(self, windows: list[str]) -> Iterator[tuple[np.ndarray, float]]:
        """For each pair of gaps the triples at all places, -1 for none, and their weight."""
        codes = self._encoded(windows)
        longest = max(map(len, windows), default=0) + 1
        first = codes[:, :longest]
        for j, k in _GAPS:
            second, third = codes[:, j : j + longest], codes[:, k : k + longest]
            found = (first * SYMBOLS + second) * SYMBOLS + third
            yield np.where((third >= 0) & (first >= 0), found, -1), DECAY ** (k - 2)

    def rows(self, windows: list[str], known: np.ndarray) -> np.ndarray:
        """Weighted counts of the ``known`` triples, a row per window."""
        place = np.full(SYMBOLS**3 + 1, len(known), np.int64)
        place[known] = np.arange(len(known))
        place[-1] = len(known)
        out = np.zeros((len(windows), len(known) + 1), np.float32)
        at = np.arange(len(windows))
        for found, weight in self.triples(windows):
            for column in found.T:
                out[at, place[column]] += np.float32(weight)
        return out[:, :-1]

    def sums(self, windows: list[str], weights: np.ndarray) -> np.ndarray:
        """The sum of the weights of each window's triples; ``weights`` ends with the weight of none."""
        total = np.zeros(len(windows), np.float32)
        for found, weight in self.triples(windows):
            total += np.float32(weight) * weights[found].sum(axis=1)
        return total


def _windows(word: str) -> list[str]:
    """The word, and its letters alone if it has other characters, in windows if they are long."""
    bare = word.strip(_EDGES)
    forms = [bare]
    if not bare.isalpha() and len(letters := "".join(filter(str.isalpha, bare))) > 2:
        forms.append(letters)
    return [
        form[i : i + LONGEST]
        for form in forms
        for i in range(0, 1 if len(form) <= LONGEST else len(form) - LONGEST + STEP, STEP)
    ]


def score_words(kernel: Kernel, weights: np.ndarray, bias: float, words: list[str]) -> np.ndarray:
    """The machine's value of each word: of its most suspicious window."""
    cut = [_windows(w) for w in words]
    owner = np.repeat(np.arange(len(words)), [len(c) for c in cut])
    flat = list(itertools.chain.from_iterable(cut))
    out = np.full(len(words), -np.inf, np.float32)
    # Words of like length share a block, which is as wide as its longest.
    order = np.argsort(np.fromiter(map(len, flat), np.int64, len(flat)), kind="stable")
    for i in range(0, len(flat), 2048):
        block = order[i : i + 2048]
        np.maximum.at(out, owner[block], kernel.sums([flat[b] for b in block], weights) + bias)
    return out


def _form(word: str) -> str:
    """What a word is among its neighbours: its letters and digits; nothing if it is too long for a window."""
    form = word.strip(_EDGES)
    if not form.isalnum():
        form = "".join(filter(str.isalnum, form))
    return form if len(form) <= LONGEST else ""


def _reach(words: list[str]) -> np.ndarray:
    """For each word the number of the sentence it is in; a word too long for a window is one of its own."""
    ends = np.fromiter((w[-1] in ".!?" for w in words), bool, len(words))
    long = np.fromiter((len(w) > 2 * LONGEST for w in words), bool, len(words))
    starts = long.copy()
    starts[1:] |= ends[:-1] | long[:-1]
    return np.cumsum(starts)


def score_joins(kernel: Kernel, weights: np.ndarray, bias: float, words: list[str], part: np.ndarray) -> np.ndarray:
    """The machine's value of 2 to ``WIDEST`` neighbouring words, a row per number of words.

    A column stands for the first word; words of different ``part`` are no
    neighbours. Triples are summed up to each character, by their length, so
    that a window's sum is a difference.
    """
    n = len(words)
    out = np.full((WIDEST - 1, n), -np.inf, np.float32)
    for at in range(0, n, CHUNK):
        some = [_form(w) for w in words[at : at + CHUNK + WIDEST - 1]]
        codes = kernel.table[np.frombuffer("".join(some).encode("utf-32-le", "surrogatepass"), np.uint32)]
        size = len(codes)
        codes = np.concatenate([codes, np.zeros(SPAN, np.int32)])
        length = np.fromiter(map(len, some), np.int64, len(some))
        end = np.cumsum(length)
        start = end - length
        inner, first = {}, {}
        for k in range(2, SPAN):
            triple, opening = np.zeros(size, np.float32), np.zeros(len(some), np.float32)
            for j in range(1, k):
                triple += weights[(codes[:size] * SYMBOLS + codes[j : j + size]) * SYMBOLS + codes[k : k + size]]
                opening += weights[(SYMBOLS + codes[start + j - 1]) * SYMBOLS + codes[start + k - 1]]
            inner[k] = np.concatenate([[0.0], np.cumsum(triple, dtype=np.float64)]) * DECAY ** (k - 2)
            first[k] = opening * DECAY ** (k - 2)
        near = part[at : at + len(some)]
        for wide in range(2, WIDEST + 1):
            last = min(CHUNK, len(some) - wide + 1)
            if last <= 0:
                continue
            s, e = start[:last], end[wide - 1 : wide - 1 + last]
            value = np.full(last, bias)
            for k in range(2, SPAN):
                value += inner[k][np.maximum(s, e - k)] - inner[k][s] + np.where(e - s >= k, first[k][:last], 0)
            fits = (near[:last] == near[wide - 1 : wide - 1 + last]) & (e - s > 2) & (e - s <= LONGEST)
            fits &= (length[:last] > 0) & (length[wide - 1 : wide - 1 + last] > 0)
            out[wide - 2, at : at + last] = np.where(fits, value, -np.inf)
    return out


def _joined(words: list[str], i: int, wide: int) -> str:
    return "".join(map(_form, words[i : i + wide]))


def _gapped(word: str, turn: int) -> str:
    """A variant with inserted characters, as insults are disguised."""
    mark = ".*-_ "[turn % 5].strip() or "x"
    if turn % 3 == 0:
        return mark.join(word)
    at = 1 + turn % max(1, len(word) - 1)
    return word[:at] + mark + word[at:]


def _machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float = 10.0, steps: int = 30) -> np.ndarray:
    """Primal squared-hinge support vector machine by Newton steps; the bias comes last."""
    x = np.c_[x, np.ones(len(x))]
    keep = np.ones(x.shape[1])
    keep[-1] = 1e-4
    w = np.zeros(x.shape[1])

    def loss(w: np.ndarray) -> float:
        miss = np.maximum(0, 1 - y * (x @ w))
        return float((keep * w * w).sum() / 2 + cost * (weight * miss * miss).sum())

    now = loss(w)
    for _ in range(steps):
        miss = np.maximum(0, 1 - y * (x @ w))
        active = miss > 0
        slope = keep * w - 2 * cost * x.T @ (weight * y * miss)
        curve = np.diag(keep) + 2 * cost * (x[active] * weight[active, None]).T @ x[active]
        step, rate = np.linalg.solve(curve, slope), 1.0
        while rate > 1e-4 and loss(w - rate * step) > now:
            rate /= 2
        w = w - rate * step
        before, now = now, loss(w)
        if before - now < 1e-6 * max(1.0, before):
            break
    return w


def _hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))


def _seen(texts: list[str]) -> Counter:
    """In how many different neighbourhoods each word stands; copied passages count once."""
    found = set()
    for text in texts:
        words = [w.strip(_EDGES) for w in words_of(text)]
        found.update(zip(["", *words], words, [*words[1:], ""]))
    return Counter(w for _, w, _ in found)


def _pairs(text: str) -> Iterator[tuple[str, str, str, str]]:
    """Each two neighbouring words of a sentence, between their neighbours in the text."""
    words = text.lower().split()
    part, forms = _reach(words), ["", *map(_form, words), ""]
    for i in range(len(words) - 1):
        if part[i] == part[i + 1] and forms[i + 1] and forms[i + 2]:
            yield forms[i], forms[i + 1], forms[i + 2], forms[i + 3]


def _seen_pairs(texts: list[str], strong: dict[str, float], only: Counter | None = None) -> Counter:
    """In how many different neighbourhoods two words stand together, of which none is suspect by itself."""
    counts: Counter = Counter()
    found: set[int] = set()
    for text in texts:
        for before, a, b, after in _pairs(text):
            if a in strong or b in strong or len(a) + len(b) > LONGEST or (only is not None and a + b not in only):
                continue
            if (key := _hash(f"{before} {a} {b} {after}")) not in found:
                found.add(key)
                counts[a + b] += 1
    return counts


def _clean_joins(clean: list[str]) -> list[str]:
    """Windows of several words of clean texts, in the order of a hash."""
    found: set[str] = set()
    for text in clean:
        words = text.lower().split()
        part = _reach(words)
        for wide in range(2, WIDEST + 1):
            found.update(_joined(words, i, wide) for i in range(len(words) - wide + 1) if part[i] == part[i + wide - 1])
        if len(found) > 25 * JOINED:
            break
    return sorted((w for w in found if 2 < len(w) <= LONGEST), key=_hash)[:JOINED]


def _wrong_joins(clean: list[str], kernel: Kernel, triples: np.ndarray, bias: float, most: int) -> list[str]:
    """The windows of several words of clean texts that the machine suspects most."""
    worst: dict[str, float] = {}
    for text in clean:
        words = text.lower().split()
        values = score_joins(kernel, triples, bias, words, _reach(words))
        for wide, i in np.argwhere(values > -0.5):
            worst[_joined(words, i, wide + 2)] = float(values[wide, i])
        if len(worst) > 20 * most:
            worst = dict(sorted(worst.items(), key=lambda x: (-x[1], x[0]))[:most])
    return [w for w, _ in sorted(worst.items(), key=lambda x: (-x[1], x[0]))[:most]]


def _floor(clean: list[str], kernel: Kernel, m: Machines) -> float:
    """What the highest value of neighbouring words does not exceed in nearly all clean texts."""
    highest = []
    for text in clean:
        words = text.lower().split()
        joins = score_joins(kernel, m.join_triples, m.join_bias, words, _reach(words))
        joins = _own_joins(score_words(kernel, m.triples, m.bias, words), joins)
        highest.append(max(0.0, float(joins.max(initial=0.0))))
    return float(np.quantile(highest, CLEAN_SHARE))


def _suspects(toxic: list[str], per_word: dict[str, float]) -> Counter:
    """The most suspicious word or pair of each sentence of toxic texts, where it is suspicious at all."""
    found: Counter = Counter()
    for text in toxic:
        ranked = [
            max(((per_word.get(w.strip(_EDGES), 0.0), w) for w in [*words_of(s), *(a + b for _, a, b, _ in _pairs(s))]), default=(0.0, ""))
            for s in sentences_of(text)
        ]
        found.update(w.strip(_EDGES) for value, w in ranked if value > 0 and len(w.strip(_EDGES)) > 2)
    return found


def _fit(kernel: Kernel, positives: list[str], negatives: list[str]) -> tuple[np.ndarray, float]:
    """Weights of the triples and the bias of a machine on the landmarks of both."""
    some = sorted(negatives, key=_hash)
    landmarks = list(dict.fromkeys(positives[: LANDMARKS // 2] + some[: LANDMARKS // 2]))
    known = np.unique(np.concatenate([f.ravel() for f, _ in kernel.triples(landmarks)]))
    known = known[known >= 0]
    base = kernel.rows(landmarks, known)
    values, vectors = np.linalg.eigh((base @ base.T).astype(np.float64))
    useful = values > values.max() * 1e-6
    root = vectors[:, useful] / np.sqrt(values[useful])
    chosen = positives + [_gapped(w, i) for i, w in enumerate(positives)]
    against = negatives + [_gapped(w, i) for i, w in enumerate(some[: len(positives) * 2])]
    chosen, against = [w[:LONGEST] for w in chosen], [w[:LONGEST] for w in against]
    x = np.concatenate(
        [
            (kernel.rows(words[i : i + 1000], known) @ base.T).astype(np.float64) @ root
            for words in (chosen, against)
            for i in range(0, len(words), 1000)
        ]
    )
    y = np.repeat([1.0, -1.0], [len(chosen), len(against)])
    weight = np.repeat([0.5 / len(chosen), 0.5 / len(against)], [len(chosen), len(against)])
    w = _machine(x, y, weight * 2000)
    triples = np.zeros(SYMBOLS**3 + 1, np.float32)
    triples[known] = base.T @ (root @ w[:-1])
    return triples, float(w[-1])


def train_toxicity(toxic: list[str], clean: list[str], share: float) -> ToxicityModel:
    """Learn from whole labelled texts; ``share`` of all texts are toxic.

    Which sentences of a toxic text are the toxic ones is not labelled. At
    first a word is suspect by the share of labelled texts that have it; then
    the machine names the suspects, and it is trained anew, with the clean
    words it found suspect.
    """
    if len(toxic) < 4 or len(clean) < 4:
        return ToxicityModel("", None, (), share)
    learn, held = (toxic[::2], clean[::2]), (toxic[1::2], clean[1::2])
    seen = [_seen(texts) for texts in learn]
    letters = Counter(c for counts in seen for w, n in counts.items() for c in w[:LONGEST])
    alphabet = "".join(c for c, _ in sorted(letters.items(), key=lambda x: (-x[1], x[0]))[: SYMBOLS - 2])
    kernel = Kernel(alphabet)
    n_toxic, n_clean = (max(1, sum(counts.values())) for counts in seen)
    # How many standard deviations a word is more frequent in toxic texts than in clean ones.
    ratio = n_clean / n_toxic
    excess = {
        w: (n * ratio - seen[1][w]) / float(np.sqrt((n + seen[1][w] + 1) * ratio)) for w, n in seen[0].items()
    }
    strong = {w: z - EXCESS for w, z in excess.items() if len(w) > 2 and seen[0][w] * ratio > 4 * seen[1][w]}
    # The same for two neighbouring words, so that insults of words that are each ordinary are found.
    pairs = Counter({w: n for w, n in _seen_pairs(learn[0], strong).items() if n > 2})
    clean_pairs = _seen_pairs(learn[1], strong, pairs)
    for w, n in pairs.items():
        z = (n * ratio - clean_pairs[w]) / float(np.sqrt((n + clean_pairs[w] + 1) * ratio))
        if z > PAIR_EXCESS and n * ratio > 4 * clean_pairs[w] and w not in seen[1]:
            strong.setdefault(w, z - EXCESS)
    suspects = _suspects(learn[0], strong)
    ordinary = [w for w in sorted(seen[1], key=lambda w: (-seen[1][w], w)) if 2 < len(w) <= LONGEST]
    negatives = ordinary[:3000] + sorted(ordinary[3000:], key=_hash)[:5000]
    model = None
    for turn in range(3):
        positives = [w[:LONGEST] for w, _ in suspects.most_common(1500)]
        if not positives:
            return ToxicityModel("", None, (), share)
        model = _fit(kernel, positives, negatives)
        # The machine's own suspects, and the clean words it suspects.
        everything = sorted(set(seen[0]) | set(seen[1]))
        value = dict(zip(everything, score_words(kernel, *model, everything).tolist(), strict=True))
        wrong = sorted((w for w in seen[1] if 2 < len(w) <= LONGEST and value[w] > -0.5), key=lambda w: (-value[w], w))
        negatives = list(dict.fromkeys(negatives + wrong[:3000]))
        per_word = {w: value[w] - 0.25 for w in seen[0] if len(w) > 2 and seen[0][w] > 1 and seen[1][w] == 0}
        suspects = _suspects(learn[0], per_word | {w: 10.0 for w, z in strong.items() if z > 0}) or suspects
    # Neighbouring words have a machine of their own, which knows them from clean texts as well.
    negatives = list(dict.fromkeys([*negatives, *(w for w in _clean_joins(learn[1]) if w not in strong)]))
    joins = _fit(kernel, positives, negatives)
    for _ in range(2):
        negatives = list(dict.fromkeys(negatives + [w for w in _wrong_joins(learn[1], kernel, *joins, 3000) if w not in strong]))
        joins = _fit(kernel, positives, negatives)
    machines = Machines(*model, *joins, 0.0)
    machines = replace(machines, floor=_floor(held[1], kernel, machines))
    x = np.concatenate([text_features(texts, kernel, machines, {}) for texts in held])
    y = np.repeat([1.0, 0.0], [len(h) for h in held])
    prior = min(max(share, 0.01), 0.99)
    weight = np.where(y == 1, prior / len(held[0]), (1 - prior) / len(held[1])) * len(y)
    weights = fit_logistic(x, y, weight, ridge=1e-2)
    return ToxicityModel(alphabet, machines, tuple(weights), share)


def _own_joins(single: np.ndarray, joins: np.ndarray) -> np.ndarray:
    """``joins`` without windows of which a word is suspect by itself."""
    joins = joins.copy()
    for at in np.flatnonzero(single >= 1):
        for wide in range(2, WIDEST + 1):
            joins[wide - 2, max(0, at - wide + 1) : at + 1] = -np.inf
    return joins


def _top(single: np.ndarray, joins: np.ndarray, spelled: list[float], floor: float) -> tuple[float, float]:
    """The two highest values of windows that do not overlap, cut to a range in which they matter."""
    best = [-2.0, -2.0, *spelled]
    if len(single):
        joins = np.where(joins > floor, _own_joins(single, joins), -np.inf)
        values = np.vstack([single, joins])
        for _ in range(2):
            wide, i = divmod(int(values.argmax()), len(single))
            best.append(float(values[wide, i]))
            for w in range(WIDEST):
                values[w, max(0, i - w) : i + wide + 1] = -np.inf
    first, second = sorted(best)[:-3:-1]
    return float(np.clip(first, -2, 2)), float(np.clip(second, -2, 2))


def text_features(texts: list[str], kernel: Kernel, m: Machines, kept: dict[str, float]) -> np.ndarray:
    """The values of the two most suspicious windows of each text; ``kept`` holds scores of words."""
    found = []
    for at in range(0, len(texts), 64):
        lower = [t.lower() for t in texts[at : at + 64]]
        words = [t.split() for t in lower]
        spelled = [_spelled(t, w) for t, w in zip(lower, words, strict=True)]
        every = set(itertools.chain.from_iterable(words + spelled))
        new = every.difference(kept)
        if len(kept) + len(new) > KEPT:
            kept.clear()
            new = every
        new = list(new)
        kept.update(zip(new, score_words(kernel, m.triples, m.bias, new).tolist(), strict=True))
        flat = list(itertools.chain.from_iterable(words))
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        part = _reach(flat) + np.repeat(np.arange(len(words)), sizes)
        joins = score_joins(kernel, m.join_triples, m.join_bias, flat, part)
        single = np.fromiter(map(kept.__getitem__, flat), np.float32, len(flat))
        for end, size, extra in zip(np.cumsum(sizes), sizes, spelled, strict=True):
            own = slice(end - size, end)
            found.append(_top(single[own], joins[:, own], [kept[w] for w in extra], m.floor))
    return np.array(found).reshape(-1, 2)


def toxicity_score(model: ToxicityModel, text: Column) -> Column:
    """The probability that a text is toxic."""
    if not model.weights:
        return F.lit(float(model.constant))

    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        kernel, kept = Kernel(model.alphabet), {}
        weights = np.array(model.weights)
        for texts in batches:
            x = text_features(texts.tolist(), kernel, model.machines, kept)
            yield pd.Series(logistic((x * weights[:-1]).sum(axis=1) + weights[-1]), dtype="float64")

    return F.pandas_udf(scored, "double")(text)


def toxicity_model(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """Learn from the training folds of ``labels(doc_id, toxic)``."""
    sample = labelled_sample(docs, labels, "toxic", PER_CLASS, SAMPLE_CHARS)
    return train_toxicity(sample[1], sample[0], label_share(labels, "toxic"))


def with_toxicity(docs: DataFrame, model: ToxicityModel, name: str = "score") -> DataFrame:
    """``docs`` with the score of each whole text.

    A null text is scored as the empty one, which has no suspicious word; equal
    texts get equal scores; an empty table stays empty. Without labels of both
    classes every score is the share of toxic labels. A column that is named
    like the result is an error.
    """
    new_name(docs, name)
    ship(docs.sparkSession)
    return docs.withColumn(name, toxicity_score(model, text_of()))


def op5_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity_model(docs, table(spark, sf_dir, "labels"))
    return with_toxicity(docs, model).select(
        "doc_id",
        (~in_training(F.col("doc_id"))).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
