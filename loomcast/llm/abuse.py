"""Scores for abusive, hateful or sexually explicit language (problem 8).

A convolutional text classifier trained in numpy on a bounded sample of the labelled documents: hashed word embeddings,
several filter widths, max pooling over a statement, one output a class. Documents are judged by their worst statement.
Labels name documents, not statements, so training alternates between choosing the statements that explain a label and
fitting the network. Thresholds are calibrated by language on labelled documents kept out of the fit.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomcast.llm.letters import PLAIN, unmark

CLASSES = ("abusive", "hateful", "sexual")
#: Labelled documents that a model is fitted and calibrated on at most (a sample by hash of the id).
TRAIN_DOCUMENTS = 6000
BUCKETS, WIDTH, FILTERS, SPANS = 1 << 14, 16, 24, (1, 2, 3)
#: Steps of a fit at least: few labels are gone over more often.
LEAST_STEPS = 300
#: Words in a statement at most; longer ones go on in the next, sharing OVERLAP words (scoring also has parts between, _starts).
LONGEST, OVERLAP = 40, 4
#: Bounds before a statement: as many as keep every window within it.
BOUNDS = max(SPANS) - 1
#: Harmless copies of each offence's frame in a round, their weight, the evidence (log-odds) that a statement's strongest word
#: must have, and the share of it from which a word is exchanged.
FRAMES, FRAME_WEIGHT, FRAME_EVIDENCE, FRAME_SHARE = 1, 1.0, 2.0, 0.6
#: How strongly a language's offset is drawn towards the shared one: as by so many doubtful cases.
OFFSET_PULL = 2.0
#: One in so many labelled texts is kept out of the fit, for the calibration.
HELD_OUT = 5
#: Share of labels taken to be wrong in the calibration.
DOUBT = 0.03

# Digits and signs written for letters.
LEET = str.maketrans("013457@$", "oieastas")
_STRETCH = re.compile(r"([a-z])\1{2,}")
_END = re.compile(r"[.!?…:|][\"'»”’)\]]*$")
_VOWELS = str.maketrans("", "", "aeiouy")
_HAS_LETTER = re.compile(r"[a-z]")
#: Letters and then a number: a user's name, of which there are too many to tell apart.
_USER = re.compile(r"[a-z]{3,}[0-9]{1,3}")


# --- words --------------------------------------------------------------------


def plain_word(token: str) -> str:
    """Lower-case letters of a token: accents, look-alikes, signs and stretched letters resolved; numbers become ``0``."""
    token = token.strip("!?.,;:…\"'()[]«»“”")
    if any(c in "@$" for c in token):
        token = token.translate(LEET)
    word = token.translate(PLAIN)
    if not _HAS_LETTER.search(word):
        return "0" if word else ""
    return "user0" if _USER.fullmatch(word) else _STRETCH.sub(r"\1", word.translate(LEET))


def skeleton(word: str) -> str:
    """Consonants in order; vowels masked, lost, added or exchanged leave it unchanged."""
    return word.translate(_VOWELS) or word[:1]


def _bucket(text: str, seed: int) -> int:
    return 2 + xxhash.xxh32_intdigest(text, seed) % (BUCKETS - 2)  # 0: statement bound, 1: unknown


@lru_cache(maxsize=400_000)
def _token(token: str) -> tuple[str, bool]:
    return plain_word(token), bool(_END.search(token))


def statements(text: str, between: bool = False) -> list[list[str]]:
    """Statements of a text as plain words: cut at line ends and closing punctuation; letters set apart are joined. ``between``: see _starts."""
    out: list[list[str]] = []
    for line in unmark(text).split("\n"):
        words: list[str] = []
        single = ""
        for token in line.split():
            word, end = _token(token)
            if len(word) == 1 and (len(token) == 1 or single):
                single += word
                if not end:
                    continue
            if single:
                words.append(_STRETCH.sub(r"\1", single))
                single = ""
                if len(word) == 1:
                    word = ""
            if word:
                words.append(word)
            if end and words:
                _close(words, out, between)
                words = []
        if single:
            words.append(single)
        if words:
            _close(words, out, between)
    return out


def _starts(n: int, between: bool = False) -> range:
    """Where the parts of a statement of n words begin; those ``between`` leave any LONGEST / 2 words whole in one part."""
    step = LONGEST - OVERLAP
    last = -(-max(n - LONGEST, 0) // step) * step
    return range(0, last + 1, step // 2 if between else step)


def _close(words: list[str], out: list[list[str]], between: bool = False) -> None:
    out.extend(words[s : s + LONGEST] for s in _starts(len(words), between))


# --- network --------------------------------------------------------------------


@dataclass
class Model:
    """Two hashed embeddings (word, skeleton), filters by width, output layer; ``known``: buckets met in training."""

    word: np.ndarray
    skel: np.ndarray
    filters: list[np.ndarray]
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray
    known: np.ndarray
    known_skel: np.ndarray
    vocabulary: frozenset = frozenset()
    thresholds: dict[str, float] = field(default_factory=dict)
    cases: dict[str, tuple[int, int]] = field(default_factory=dict)

    def ids(self, word: str) -> tuple[int, int]:
        a, b = _bucket(word, 1), _bucket(skeleton(word), 2)
        return (a if self.known[a] else 1), (b if self.known_skel[b] else 1)


def _new_model(rng: np.random.Generator) -> Model:
    emb = lambda: rng.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32)
    fil = [rng.normal(0, (2 / (s * WIDTH)) ** 0.5, (s * WIDTH, FILTERS)).astype(np.float32) for s in SPANS]
    n = FILTERS * len(SPANS)
    return Model(emb(), emb(), fil, [np.zeros(FILTERS, np.float32) for _ in SPANS], rng.normal(0, 0.1, (n, len(CLASSES))).astype(np.float32), np.full(len(CLASSES), -2, np.float32), np.zeros(BUCKETS, bool), np.zeros(BUCKETS, bool))


def _pooled(m: Model, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """x (batch, length, width): pooled features, the windows, and where each maximum lies."""
    parts, windows, where = [], [], []
    for s, f, b in zip(SPANS, m.filters, m.bias):
        v = np.lib.stride_tricks.sliding_window_view(x, s, axis=1).transpose(0, 1, 3, 2).reshape(len(x), x.shape[1] - s + 1, s * WIDTH)
        a = v @ f
        at = a.argmax(1)
        parts.append(np.maximum(np.take_along_axis(a, at[:, None], 1)[:, 0] + b, 0))
        windows.append(v), where.append(at)
    return np.concatenate(parts, 1), windows, where


def _fit(m: Model, a: np.ndarray, b: np.ndarray, y: np.ndarray, weight: np.ndarray, rng: np.random.Generator, epochs: int, batch: int = 128, rate: float = 3e-3) -> None:
    """Adam on weighted logistic loss; words are dropped to their skeleton or to unknown at random."""
    params = [m.word, m.skel, *m.filters, *m.bias, m.out, m.out_bias]
    first, second, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    k = len(SPANS)
    for _ in range(epochs):
        order = rng.permutation(len(a))
        for s in range(0, len(order), batch):
            pick = order[s : s + batch]
            aa, bb, yy, ww = a[pick], b[pick], y[pick], weight[pick]
            length = BOUNDS + max(SPANS) + int((aa > 0).sum(1).max())
            aa, bb = aa[:, :length].copy(), bb[:, :length].copy()
            real = aa > 0
            draw = rng.random(aa.shape)
            aa[(draw < 0.3) & real] = 1
            bb[(draw < 0.06) & real] = 1
            x = m.word[aa] + m.skel[bb]
            h, windows, where = _pooled(m, x)
            keep = (rng.random(h.shape) < 0.7).astype(np.float32) / 0.7
            p = 1 / (1 + np.exp(-np.clip(h * keep @ m.out + m.out_bias, -30, 30)))
            g = ((p - yy) * ww[:, None] / len(pick)).astype(np.float32)
            grads: list = [None] * len(params)
            grads[-2], grads[-1] = (h * keep).T @ g, g.sum(0)
            gh = (g @ m.out.T) * keep * (h > 0)
            gx = np.zeros_like(x)
            rows = np.arange(len(pick))
            for n, span in enumerate(SPANS):
                gf = gh[:, n * FILTERS : (n + 1) * FILTERS]
                hit = windows[n][rows[:, None], where[n]]  # batch, filters, span * width
                grads[2 + n] = np.einsum("bfd,bf->df", hit, gf, optimize=True)
                grads[2 + k + n] = gf.sum(0)
                back = (gf[:, :, None] * m.filters[n].T[None]).reshape(len(pick), FILTERS, span, WIDTH)
                for o in range(span):
                    np.add.at(gx, (rows[:, None], where[n] + o), back[:, :, o])
            t += 1
            used_a, inv_a = np.unique(aa, return_inverse=True)
            used_b, inv_b = np.unique(bb, return_inverse=True)
            flat = gx.reshape(-1, WIDTH)
            for q, used, inv in ((0, used_a, inv_a), (1, used_b, inv_b)):
                ge = np.zeros((len(used), WIDTH), np.float32)
                np.add.at(ge, inv.ravel(), flat)
                ge[used == 0] = 0
                _adam(params[q], first[q], second[q], ge, t, rate, used)
            for q in range(2, len(params)):
                _adam(params[q], first[q], second[q], grads[q], t, rate, slice(None))
    m.word[0] = m.skel[0] = 0


def _adam(p: np.ndarray, m1: np.ndarray, m2: np.ndarray, g: np.ndarray, t: int, rate: float, at) -> None:  # noqa: ANN001
    m1[at] = 0.9 * m1[at] + 0.1 * g
    m2[at] = 0.999 * m2[at] + 0.001 * g * g
    p[at] -= rate * (m1[at] / (1 - 0.9**t)) / (np.sqrt(m2[at] / (1 - 0.999**t)) + 1e-7)


def _arrays(m: Model, parts: Sequence[Sequence[str]]) -> tuple[np.ndarray, np.ndarray]:
    a, b = (np.zeros((len(parts), BOUNDS + LONGEST + max(SPANS)), np.int32) for _ in range(2))
    for k, words in enumerate(parts):
        ids = [m.ids(w) for w in words]
        at = slice(BOUNDS, BOUNDS + len(ids))
        a[k, at], b[k, at] = [i for i, _ in ids], [j for _, j in ids]
    return a, b


def _statement_scores(m: Model, parts: Sequence[Sequence[str]], batch: int = 512) -> np.ndarray:
    out = np.zeros((len(parts), len(CLASSES)), np.float32)
    order = np.argsort([len(p) for p in parts], kind="stable")
    for s in range(0, len(parts), batch):
        pick = order[s : s + batch]
        a, b = _arrays(m, [parts[k] for k in pick])
        length = BOUNDS + max(SPANS) + int((a > 0).sum(1).max())
        h, _, _ = _pooled(m, m.word[a[:, :length]] + m.skel[b[:, :length]])
        out[pick] = 1 / (1 + np.exp(-np.clip(h @ m.out + m.out_bias, -30, 30)))
    return out


# --- training -------------------------------------------------------------------


def train(texts: Sequence[str], labels: Sequence[str], langs: Sequence[str], *, seed: int = 5, rounds: int = 4, epochs: int = 4) -> Model:
    """Fit on documents with one label each (``none`` or a class) and calibrate on one in HELD_OUT of them.

    A statement's first score is the evidence of its words: their log-odds between documents of a class and clean ones.
    With no labels at all, or none of a class, that class is never predicted.
    """
    rng = np.random.default_rng(seed)
    docs = [statements(t) for t in texts]
    target = np.array([CLASSES.index(x) if x in CLASSES else -1 for x in labels], np.int64)
    held = np.array([xxhash.xxh32_intdigest(t, 9) % HELD_OUT == 0 for t in texts], bool)  # copies of a text stay on one side
    m = _new_model(rng)
    fit = [k for k in range(len(docs)) if not held[k]]
    if not any(target[k] >= 0 for k in fit):
        m.thresholds = {"": 2.0}
        return m
    m.vocabulary = _mark_known(m, [docs[k] for k in fit])
    usual, suspect = _common(docs, fit, target)
    clean = [list(s) for s in {tuple(s): None for k in fit if target[k] < 0 for s in docs[k]} if s not in suspect]
    odds = _evidence(docs, fit, target)
    first = _first_choice(docs, fit, target, odds)
    chosen = [x for own in first.values() for x in own]
    for r in range(rounds):
        often: dict[tuple, int] = {}
        for s, c in chosen:
            if tuple(s) not in usual:
                often[tuple(s), c] = often.get((tuple(s), c), 0) + 1
        pos = [*often]
        if not pos:
            break
        # all statements met in clean documents that look like offences, and a draw of the rest
        if r and len(clean):
            likely = np.argsort(-_statement_scores(m, clean).max(1), kind="stable")[: max(3000, 3 * len(pos))]
        else:
            likely = np.empty(0, np.int64)
        draw = rng.permutation(len(clean))[: max(12000, 12 * len(pos))]
        neg = [clean[k] for k in np.unique(np.concatenate([likely, draw]).astype(np.int64))]
        frames = [f for _ in range(FRAMES) for f in _frames(pos, odds, clean, rng)]
        neg += frames
        a, b = _arrays(m, [s for s, _ in pos] + neg)
        y = np.zeros((len(a), len(CLASSES)), np.float32)
        y[np.arange(len(pos)), [c for _, c in pos]] = 1
        weight = np.ones(len(a), np.float32)
        # a statement met in the same words many times counts for more, up to a bound
        weight[: len(pos)] = min(4.0, max(1.0, 0.1 * len(neg) / max(1, len(pos)))) * np.minimum(8, [*often.values()])
        weight[len(a) - len(frames) :] = FRAME_WEIGHT
        _fit(m, a, b, y, weight, rng, max(epochs, -(-LEAST_STEPS * 128 // len(a))))
        chosen = _next_choice(m, docs, fit, target, first, doubt=r > 0)
    _calibrate(m, docs, target, held, langs)
    return m


def _mark_known(m: Model, docs: Sequence[Sequence[Sequence[str]]]) -> frozenset:
    """Words of two documents at least are known, others (names above all) are not told apart."""
    seen: dict[str, int] = {}
    for d in docs:
        for w in {w for s in d for w in s}:
            seen[w] = seen.get(w, 0) + 1
    words = frozenset(w for w, n in seen.items() if n > 1)
    for w in words:
        m.known[_bucket(w, 1)] = True
        m.known_skel[_bucket(skeleton(w), 2)] = True
    return words


def _common(docs: Sequence, fit: Sequence[int], target: np.ndarray) -> tuple[set, set]:
    """Statements met in clean documents: those about as usual there (never an offence), and those far more usual in the others (labels can be wrong)."""
    count: list[dict] = [{}, {}]
    n = [1, 1]
    for k in fit:
        n[int(target[k] >= 0)] += 1
        for s in {tuple(s) for s in docs[k]}:
            count[int(target[k] >= 0)][s] = count[int(target[k] >= 0)].get(s, 0) + 1
    usual, suspect = set(), set()
    for s, clean in count[0].items():
        other = count[1].get(s, 0)
        (suspect if other > 1 and other / n[1] > 3 * clean / n[0] else usual).add(s)
    return usual, suspect


def _evidence(docs: Sequence, fit: Sequence[int], target: np.ndarray) -> list[dict]:
    """For each class the log-odds of words and word pairs, by documents."""
    clean: dict = {}
    own: list[dict] = [{} for _ in CLASSES]
    n = np.zeros(len(CLASSES) + 1)
    for k in fit:
        terms = {t for s in docs[k] for t in _terms(s)}
        n[target[k]] += 1
        to = clean if target[k] < 0 else own[target[k]]
        for t in terms:
            to[t] = to.get(t, 0) + 1
    # pairs are so many that two of a kind may meet by chance
    return [{t: np.log(v / (n[c] + 1)) - np.log((clean.get(t, 0) + 1) / (n[-1] + 1)) for t, v in o.items() if v > (3 if isinstance(t, tuple) else 1)} for c, o in enumerate(own)]


def _terms(words: Sequence[str]) -> list:
    bones = [skeleton(w) for w in words]
    return [*words, *zip(bones, bones[1:])]


def _frames(pos: Sequence[tuple], odds: list[dict], clean: Sequence[Sequence[str]], rng: np.random.Generator) -> list[list[str]]:
    """Harmless statements in the frames of offences: their telling words exchanged for words of clean ones.

    Telling are the words whose evidence comes near the statement's strongest. Frames such as "I hope you all" occur in the
    labelled offences alone, and would else be taken for the offence.
    """
    out = []
    for s, c in pos:
        own = np.array([odds[c].get(w, 0.0) for w in s])
        if own.max() > FRAME_EVIDENCE and clean:
            telling = own >= FRAME_SHARE * own.max()
            out.append([_draw(clean, rng) if x else w for w, x in zip(s, telling)])
    return out


def _draw(clean: Sequence[Sequence[str]], rng: np.random.Generator) -> str:
    s = clean[rng.integers(len(clean))]
    return s[rng.integers(len(s))]


def _first_choice(docs: Sequence, fit: Sequence[int], target: np.ndarray, odds: list[dict]) -> dict[int, list[tuple]]:
    """By document, the statements of most evidence for its label."""
    out = {}
    for k in fit:
        if (c := int(target[k])) >= 0 and docs[k]:
            score = np.array([sum(sorted((odds[c].get(t, 0.0) for t in _terms(s)), reverse=True)[:4]) for s in docs[k]])
            out[k] = [(docs[k][i], c) for i in np.flatnonzero((score >= 0.8 * score.max()) & (score > 7))]
    return out


def _next_choice(m: Model, docs: Sequence, fit: Sequence[int], target: np.ndarray, first: dict[int, list[tuple]], doubt: bool) -> list[tuple]:
    """Statements scored as offences in documents so labelled, those of other labels as theirs; where there are none, the
    statements of most evidence unless they look quite clean by now, as in documents labelled by mistake. Without ``doubt`` the statements of most evidence all stay."""
    out = []
    for k in fit:
        if int(target[k]) >= 0 and docs[k]:
            p = _statement_scores(m, docs[k])
            out += [(docs[k][i], int(p[i].argmax())) for i in np.flatnonzero(p.max(1) > 0.5)]
            if not doubt:
                out += first[k]
            elif p.max() <= 0.5 and first[k]:
                again = _statement_scores(m, [s for s, _ in first[k]])
                out += [x for x, q in zip(first[k], again) if q[x[1]] > 0.02]
    return out


def _logit(p: np.ndarray) -> np.ndarray:
    """Bounded, as scores near 0 and 1 differ in nothing but training time."""
    q = np.clip(p.astype(float), 2.5e-3, 1 - 2.5e-3)
    return np.log(q / (1 - q))


def _calibrate(m: Model, docs: Sequence, target: np.ndarray, held: np.ndarray, langs: Sequence[str]) -> None:
    """Threshold of each language from a logistic regression of held-out labels on the logit of the score.

    The slope is shared; a language's offset is drawn towards the shared one, the more the fewer cases it has. The threshold
    is where the calibrated probability is one half. ``cases``: held-out documents and offending ones by language.
    """
    rows = np.flatnonzero(held)
    z = _logit(np.array([_statement_scores(m, docs[k]).max() if docs[k] else 0.0 for k in rows]))
    truth, lang = target[rows] >= 0, np.array([langs[k] for k in rows], object)
    names = sorted({x for x in lang.tolist() if x and truth[lang == x].any()})
    m.cases = {x: (int((lang == x).sum()), int(truth[lang == x].sum())) for x in sorted(set(lang.tolist()))}
    if not truth.any() or truth.all():
        m.thresholds = {"": 0.5}
        return
    x = np.column_stack([z, np.ones(len(z)), *[(lang == n).astype(float) for n in names]])
    # drawn towards slope 1 and offset 0
    pull = np.array([OFFSET_PULL / 10, OFFSET_PULL / 10, *[OFFSET_PULL] * len(names)])
    start = np.array([1.0, 0.0, *[0.0] * len(names)])
    # some labels are wrong, so none is taken as certain
    y = np.where(truth, 1 - DOUBT, DOUBT)
    cost = lambda w: float(np.logaddexp(0, x @ w).sum() - y @ (x @ w) + 0.5 * pull @ (w - start) ** 2)
    w, now = start.copy(), cost(start)
    for _ in range(100):
        p = 1 / (1 + np.exp(-(x @ w)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(pull), x.T @ (y - p) - pull * (w - start))
        while (lower := cost(w + step)) > now and np.abs(step).max() > 1e-9:
            step /= 2
        if now - lower < 1e-10:
            break
        w, now = w + step, lower
    slope = max(w[0], 0.05)
    at = lambda offset: float(1 / (1 + np.exp(np.clip(offset / slope, -12, 12))))
    m.thresholds = {"": at(w[1])} | {n: at(w[1] + w[2 + k]) for k, n in enumerate(names)}


# --- scoring --------------------------------------------------------------------


class _Tokens(dict):
    """Number of a token as written; its buckets and kind are looked up once a worker."""

    LIMIT = 1_000_000

    def __init__(self, model: Model) -> None:
        super().__init__()
        self.model = model
        self.kind = np.zeros(1024, np.int8)  # 1: no letters, 2: ends a statement, 4: a single letter
        self.a, self.b = np.zeros(1024, np.int32), np.zeros(1024, np.int32)
        self["\x00"] = 0  # line end: the statement bound
        self.kind[0] = 2

    def __missing__(self, token: str) -> int:
        n = len(self)
        if n == len(self.a):
            self.kind, self.a, self.b = (np.concatenate([x, np.zeros_like(x)]) for x in (self.kind, self.a, self.b))
        word = plain_word(token)
        self.kind[n] = (not word) + 2 * bool(_END.search(token)) + 4 * (len(word) == 1 and len(token) == 1)
        self.a[n], self.b[n] = self.model.ids(word) if word else (0, 0)
        self[token] = n
        return n


def _bounded(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every single bound made BOUNDS of them; one at the end begins no statement and goes."""
    if a[-1] == 0:
        a, b = a[:-1], b[:-1]
    n = np.where(a == 0, BOUNDS, 1)
    return np.repeat(a, n), np.repeat(b, n)


class Scorer:
    """Scores texts: tokens become numbers, statements are cut in numpy, the network runs over many texts in one sequence."""

    def __init__(self, model: Model) -> None:
        self.m = model
        self.tokens = _Tokens(model)

    def _spread_words(self, words: Sequence[str]) -> list[tuple[int, int]]:
        """Buckets of a statement's words; an unknown long word, as letters set apart give, is cut into known ones if it can be."""
        out = []
        for w in words:
            ids = self.m.ids(w)
            parts = self._parts(w) if ids[0] == 1 and len(w) > 7 else []
            out += [self.m.ids(p) for p in parts] or [ids]
        return out

    def _parts(self, word: str) -> list[str]:
        out, k = [], 0
        while k < len(word):
            n = next((n for n in range(min(20, len(word) - k), 2, -1) if word[k : k + n] in self.m.vocabulary), 0)
            if not n:
                return []
            out.append(word[k : k + n])
            k += n
        return out

    def _sequence(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of all words in order, 0 before each statement; those over LONGEST words are cut into parts, as in the fit and between these."""
        text = unmark(text)
        ids = np.array([*map(self.tokens.__getitem__, text.replace("\x00", " ").replace("\n", " \x00 ").split())], np.int64)
        kind = self.tokens.kind[ids]
        single = (kind & 4) > 0
        if (single[:-2] & single[1:-1] & single[2:]).any():  # letters set apart
            seq = [x for s in statements(text, between=True) for x in [(0, 0), *self._spread_words(s)]] or [(0, 0)]
            return _bounded(*np.array(seq, np.int32).T)
        a, b = self.tokens.a[ids], self.tokens.b[ids]
        bound = np.flatnonzero((kind & 2) > 0) + 1
        keep = (kind & 1) == 0
        keep[ids == 0] = False
        a, b = np.insert(a, bound, 0), np.insert(b, bound, 0)
        keep = np.insert(keep, bound, True)
        a, b = np.append(0, a[keep]), np.append(0, b[keep])
        zero = np.flatnonzero(a == 0)
        n = np.diff(np.append(zero, len(a))) - 1
        if len(n) and n.max() > LONGEST:
            parts = [np.append(z, np.arange(z + 1 + s, z + 1 + min(k, s + LONGEST))) for z, k in zip(zero.tolist(), n.tolist()) for s in _starts(k, between=True)]
            pick = np.concatenate(parts)
            a, b = a[pick], b[pick]
        double = np.append(False, (a[1:] == 0) & (a[:-1] == 0))
        return _bounded(a[~double], b[~double])

    def scores(self, texts: Sequence[str | None], words_at_once: int = 40_000) -> np.ndarray:
        out = np.zeros((len(texts), len(CLASSES)), np.float32)
        parts, owner, held = [], [], 0
        for k, t in enumerate(texts):
            if t:
                if len(self.tokens) > self.tokens.LIMIT:
                    self.tokens = _Tokens(self.m)
                parts.append(self._sequence(t)), owner.append(k)
                held += len(parts[-1][0])
                if held > words_at_once:
                    self._run(parts, owner, out)
                    parts, owner, held = [], [], 0
        if parts:
            self._run(parts, owner, out)
        return out

    def _run(self, parts: list, owner: list, out: np.ndarray) -> None:
        m, pad = self.m, np.zeros(max(SPANS), np.int32)
        a, b = np.concatenate([*(p for p, _ in parts), pad]), np.concatenate([*(p for _, p in parts), pad])
        n = len(a) - len(pad)
        starts = np.flatnonzero(a[:n] == 0)[::BOUNDS]
        text = np.repeat(np.array(owner), [len(p) for p, _ in parts])[starts]
        x = m.word[a] + m.skel[b]
        pooled = []
        for s, f, bias in zip(SPANS, m.filters, m.bias):
            act = x[:n] @ f[:WIDTH]
            for o in range(1, s):
                act += x[o : n + o] @ f[o * WIDTH : (o + 1) * WIDTH]
            # 0: the window of bounds alone, which every statement of the fit has
            pooled.append(np.maximum(np.maximum(np.maximum.reduceat(act, starts, axis=0), 0) + bias, 0))
        p = 1 / (1 + np.exp(-np.clip(np.concatenate(pooled, 1) @ m.out + m.out_bias, -30, 30)))
        np.maximum.at(out, text, p.astype(np.float32))


def language(c: Column) -> Column:
    """Two-letter code of a language however it is spelt; null or blank is ''."""
    code = F.lower(F.btrim(F.coalesce(c, F.lit(""))))
    long = F.create_map(*[F.lit(x) for p in (("eng", "en"), ("deu", "de"), ("ger", "de"), ("fra", "fr"), ("fre", "fr"), ("spa", "es")) for x in p])
    return F.coalesce(long[code], F.substring(code, 1, 2))


#: Models fitted in this session by the content of their sample, so that the queries share one fit; the last few are kept.
_FITTED: dict[str, Model] = {}


def _fitted(texts: list[str], labels: list[str], langs: list[str]) -> Model:
    key = hashlib.sha256(repr((texts, labels, langs)).encode("utf-8", "surrogatepass")).hexdigest()
    if key not in _FITTED:
        while len(_FITTED) >= 2:
            _FITTED.pop(next(iter(_FITTED)))
        _FITTED[key] = train(texts, labels, langs)
    return _FITTED[key]


def fit_model(documents: DataFrame, labels: DataFrame, *, sample: int = TRAIN_DOCUMENTS) -> Model:
    """Model of at most ``sample`` labelled documents, chosen by a hash of the id. Judgements that disagree, unknown and null labels are left out."""
    label = F.lower(F.btrim("label"))
    known = labels.where(F.col("doc_id").isNotNull() & label.isin("none", *CLASSES)).groupBy("doc_id").agg(F.min(label).alias("lab"), F.max(label).alias("other"))
    chosen = known.where("lab = other").orderBy(F.xxhash64("doc_id")).limit(sample).select("doc_id", "lab")
    ids = documents.sparkSession.createDataFrame(chosen.toPandas(), "doc_id bigint, lab string")
    rows = documents.where("text is not null").join(F.broadcast(ids), "doc_id").select("doc_id", "text", "lab", language(F.col("lang")).alias("lang")).toPandas()
    rows = rows.drop_duplicates("doc_id").sort_values("doc_id")
    return _fitted(rows["text"].tolist(), rows["lab"].tolist(), rows["lang"].tolist())


def score_documents(documents: DataFrame, model: Model) -> DataFrame:
    """``doc_id, source, lang, abusive, hateful, sexual, score, flagged`` for every row, whole texts.

    A class's score is that of the document's worst statement; ``score`` is the greatest of them, ``flagged`` whether it
    reaches the language's threshold. Null and empty texts score 0. Rows keep their partition; nothing is shuffled.
    """
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(sent.value)
        for texts in batches:
            yield pd.DataFrame(scorer.scores(texts.tolist()), columns=list(CLASSES))

    udf = F.pandas_udf(score, ", ".join(f"{c} float" for c in CLASSES))
    rows = documents.select("doc_id", "source", language(F.col("lang")).alias("lang"), udf("text").alias("s")).select("doc_id", "source", "lang", *[F.col(f"s.{c}").cast("double").alias(c) for c in CLASSES])
    general = model.thresholds.get("", 0.5)
    limit = F.lit(general)
    for name, t in sorted(model.thresholds.items()):
        limit = F.when(F.col("lang") == name, F.lit(t)).otherwise(limit) if name else limit
    return rows.withColumn("score", F.greatest(*CLASSES)).withColumn("flagged", F.col("score") >= limit)


def source_rates(scored: DataFrame) -> DataFrame:
    """``source, documents, flagged, rate, mean_score``; a null source is a group of its own. Counts are reduced before the shuffle."""
    return scored.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.count_if("flagged").alias("flagged"), F.avg(F.col("flagged").cast("double")).alias("rate"), F.avg("score").alias("mean_score"))
