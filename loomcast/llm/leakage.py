"""Evaluation passages that occur, wholly or partly, in training texts (problem 7).

Q-gram lemma filtering: texts and passages are reduced to letters; q-grams shared with a passage are counted in overlapping
bands of diagonals; bands whose count meets the bound that the permitted edits leave are counted again by shorter q-grams,
whose bound is sharper; what is left is verified by banded alignment of the letters, judged by words, and where that finds no
stretch, by an alignment of the words themselves.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomcast.llm.letters import PLAIN, UNSPACED, letters, unmark
from loomcast.session import materialise

Q = 8
#: Letters of the q-grams of the second count.
FINE = 4
#: Width of a band of diagonals; the next begins half a width further, so any drift of half a width lies within one.
BAND = 48
#: Diagonals aligned on either side of a band.
MARGIN = 8
#: Letters aligned before the first and after the last shared q-gram.
REACH = 96
#: Cells of the alignments held at once (a byte each).
STEPS = 1 << 26
#: Regions counted by short q-grams, or aligned by words, at once.
REGIONS = 512
#: Passage words aligned at once by words, half of them shared with the next piece, and text words beside them.
PIECE, BESIDE = 48, 80
#: Words left out or added at one place, and edits of a piece, that an alignment of words follows.
LEAP, EDITS = 2, 6
#: Letters of passages held by one pass over the texts; more passages are searched in blocks, a pass for each.
BLOCK_LETTERS = 2_000_000


@dataclass(frozen=True)
class Stretch:
    """What counts as a leak: so many words, and one edit (word replaced, left out or added) in every ``per_edit`` words.

    ``misspelt``: letters that may differ in spelling, beside the edits, before a stretch may escape the counts of q-grams.
    """

    words: int = 12
    per_edit: int = 6
    misspelt: int = 1


_CODE = np.zeros(256, np.uint8)
_CODE[np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0123456789", np.uint8)] = np.arange(1, 37)


def encode(text: str) -> np.ndarray:
    """Codes 1..36 of a text of letters and digits."""
    return _CODE[np.frombuffer(text.encode("ascii"), np.uint8)]


def qgrams(codes: np.ndarray) -> np.ndarray:
    """The q-gram at each position as 48 bits (q = 8), by doubling; those across a gap (code 0) differ from all others."""
    if len(codes) < Q:
        return np.empty(0, np.uint64)
    one = codes.astype(np.uint64)
    two = (one[:-1] << np.uint64(6)) | one[1:]
    four = (two[:-2] << np.uint64(12)) | two[2:]
    return (four[:-4] << np.uint64(24)) | four[4:]


def short_grams(codes: np.ndarray) -> np.ndarray:
    """The q-gram of FINE letters at each position as 24 bits; the last ones, cut off, hold zeros."""
    wide = np.append(codes, np.zeros(FINE - 1, np.uint8)).astype(np.uint32)
    two = (wide[:-1] << np.uint32(6)) | wide[1:]
    return (two[:-2] << np.uint32(12)) | two[2:]


_MIX, _BITS = np.uint64(0x9E3779B97F4A7C15), np.uint64(44)


class Index:
    """Q-grams of passages with their places, word bounds, and the least counts that a leaked stretch leaves."""

    def __init__(self, passages: Sequence[str], stretch: Stretch) -> None:
        self.codes, self.words, least, span, end, need, keys, who, at = [], [], [], [], [], [], [], [], []
        for k, passage in enumerate(passages):
            words = passage_words(passage)
            lengths = np.array([len(w) for w in words], np.int64)
            ends = np.cumsum(lengths)
            plain = encode("".join(words))
            self.codes.append(plain)
            self.words.append(np.column_stack([ends - lengths, ends]))
            least.append(int(self._least(lengths, stretch, Q).min(initial=20)) if len(words) >= stretch.words else 1 << 30)
            stop, bound = np.zeros(len(plain), np.int32), np.full(len(plain), 1 << 30, np.int32)
            runs = self._least(lengths, stretch, FINE)
            begin = (ends - lengths)[: len(runs)]
            span.append(int((ends[stretch.words - 1 :] - begin).max(initial=0)))
            stop[begin], bound[begin] = ends[stretch.words - 1 :], runs
            end.append(stop), need.append(bound)
            grams = qgrams(plain)
            keys.append(grams), who.append(np.full(len(grams), k)), at.append(np.arange(len(grams)))
            dropped = encode("".join(c for c in unmark(passage) if c.isascii()).translate(PLAIN))
            if len(dropped) < len(plain) and len(dropped):  # accented letters lost: their q-grams at the nearest place of the full passage
                place = np.flatnonzero([c.isascii() for c in _letters_kept(passage)])[: len(dropped)]
                grams = qgrams(dropped)
                keys.append(grams), who.append(np.full(len(grams), k)), at.append(place[: len(grams)])
        keys, who, at = (np.concatenate([*x, np.empty(0, x[0].dtype if x else np.int64)]) for x in (keys or [np.empty(0, np.uint64)], who or [np.empty(0, np.int64)], at or [np.empty(0, np.int64)]))
        order = np.argsort(keys, kind="stable")
        self.keys, first = np.unique(keys[order], return_index=True)
        self.first = np.append(first, len(keys))
        self.who, self.at = who[order], at[order]
        self.map = np.zeros(1 << 20, bool)
        self.map[(self.keys * _MIX) >> _BITS] = True
        # q-grams that a stretch keeps at least, and letters of the longest run of the words asked for
        self.least, self.span = np.array(least, np.int64), np.array(span, np.int64)
        self.size = np.array([len(c) for c in self.codes], np.int64)
        self.longest = int(self.size.max(initial=0))
        self.start = np.cumsum(self.size) - self.size
        self.short = np.concatenate([*map(short_grams, self.codes), np.zeros(1, np.uint32)])
        # by letter: where a run of the words asked for that begins here ends, and the short q-grams that it must keep
        self.end, self.need = np.concatenate([*end, np.zeros(1, np.int32)]), np.concatenate([*need, np.full(1, 1 << 30, np.int32)])

    @staticmethod
    def _least(lengths: np.ndarray, stretch: Stretch, q: int) -> np.ndarray:
        """Lemma: L letters hold L - q + 1 q-grams, an edited word of m letters spoils at most m + q - 1 of them and a letter q.

        For each run of the words asked for, its q-grams less those of the permitted edits on its longest words and of the
        misspelt letters. Where edits can spoil all, the bound is 1, and a stretch that keeps none isn't found.
        """
        n = stretch.words
        if len(lengths) < n:
            return np.empty(0, np.int64)
        runs = np.lib.stride_tricks.sliding_window_view(lengths, n)
        edits = n // stretch.per_edit
        return np.maximum(1, runs.sum(1) - q + 1 - (np.sort(runs, axis=1)[:, n - edits :] + q - 1).sum(1) - stretch.misspelt * q)

    def pairs(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in codes, entry) of every shared q-gram."""
        grams = qgrams(codes)
        place = np.flatnonzero(self.map[(grams * _MIX) >> _BITS]) if len(self.keys) else np.empty(0, np.int64)
        key = np.searchsorted(self.keys, grams[place])
        hit = self.keys[np.minimum(key, len(self.keys) - 1)] == grams[place] if len(place) else np.empty(0, bool)
        place, key = place[hit], key[hit]
        n = self.first[key + 1] - self.first[key]
        place, entry = np.repeat(place, n), np.repeat(self.first[key], n)
        entry += np.arange(len(entry)) - np.repeat(np.cumsum(n) - n, n)
        return place, entry


def passage_words(passage: str) -> list[str]:
    """The words of a passage reduced to letters; scripts without spaces are cut into words of equal length."""
    return [w for w in (x.translate(PLAIN) for x in re.split(r"[^\w’'&;-]+", UNSPACED.sub(r"\g<0> ", unmark(passage)))) if w]


def _letters_kept(passage: str) -> str:
    """The source character of every letter of the reduced passage."""
    return "".join(c * len(c.translate(PLAIN)) for c in unmark(passage))


# --- search -------------------------------------------------------------------


def search(texts: Sequence[str | None], index: Index, stretch: Stretch) -> list[tuple[int, int, int]]:
    """(text, passage, words of the longest stretch) of every leak among ``texts``."""
    codes = [encode(letters(t)) if t else np.empty(0, np.uint8) for t in texts]
    size = np.array([len(c) for c in codes], np.int64)
    gap = np.zeros(1, np.uint8)
    flat = np.concatenate([x for c in codes for x in (c, gap)] or [gap])
    start = np.cumsum(size + 1) - size - 1
    place, entry = index.pairs(flat)
    if not len(place):
        return []
    who, at = index.who[entry], index.at[entry]
    text = np.searchsorted(start, place, "right") - 1
    half = BAND // 2
    bands = (size + index.longest) // half + 3
    base = np.cumsum(bands) - bands
    band = (place - start[text] - at + index.longest) // half + 1
    n = len(index.codes)
    key = np.concatenate([(base[text] + band) * n + who, (base[text] + band - 1) * n + who])
    # a hashed count first: most bands hold too few to be worth sorting
    bucket = ((key.astype(np.uint64) * _MIX) >> _BITS).astype(np.int64)
    keep = np.bincount(bucket, minlength=1 << 20)[bucket] >= np.concatenate([index.least[who]] * 2)
    bits = index.longest.bit_length()
    both = np.sort((key[keep] << bits) | np.concatenate([at, at])[keep])
    both = both[np.append(True, both[1:] != both[:-1])] if len(both) else both
    key, at = both >> bits, both & ((1 << bits) - 1)
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.empty(0, np.int64)
    count = np.diff(np.append(first, len(key)))
    lo, hi = at[first], at[np.append(first[1:], len(key)) - 1] if len(first) else first
    band_key = key[first]
    who = band_key % n
    # as many within the letters of a stretch
    last = np.arange(len(key)) + index.least[key % n] - 1
    full = last < len(key)
    last = np.where(full, last, 0)
    full &= (key[last] == key) & (at[last] - at <= index.span[key % n] - Q)
    ok = np.logical_or.reduceat(full, first) if len(first) else np.empty(0, bool)
    who, count, lo, hi, spot = who[ok], count[ok], lo[ok], hi[ok], band_key[ok] // n
    text = np.searchsorted(base, spot, "right") - 1
    diagonal = (spot - base[text] - 1) * half - index.longest
    ok = _dense(short_grams(flat), start[text], size[text], index, who, diagonal, lo, hi)
    who, text, count, lo, hi, diagonal = (x[ok] for x in (who, text, count, lo, hi, diagonal))
    # the fullest band of a text and passage first; its others only while no leak is found
    order = np.lexsort((-count, who, text))
    pair = text[order] * n + who[order]
    rank = np.arange(len(pair)) - np.searchsorted(pair, pair)
    found: dict[tuple[int, int], int] = {}
    parts: dict[int, list[np.ndarray]] = {}
    for r in range(int(rank.max()) + 1 if len(rank) else 0):
        todo = [k for k in order[rank == r] if (int(text[k]), int(who[k])) not in found]
        todo.sort(key=lambda k: hi[k] - lo[k])
        missed = []
        while todo:
            # the last region is the longest; a batch's steps are bounded
            most = int(hi[todo[-1]] - lo[todo[-1]]) + Q + 2 * REACH
            size = max(1, min(256, STEPS // (most * (BAND + 2 * MARGIN))))
            todo, part = todo[:-size], todo[-size:]
            for k, words in zip(part, _verify([(codes[text[k]], index.codes[who[k]], index.words[who[k]], int(diagonal[k]), int(lo[k]), int(hi[k])) for k in part], stretch)):
                if words >= stretch.words:
                    found[int(text[k]), int(who[k])] = words
                else:
                    missed.append(k)
        pieces = []
        for k in missed:
            t, p = int(text[k]), int(who[k])
            if t not in parts:
                parts[t] = [encode(w) for w in passage_words(texts[t])]
            pieces += [(t, p, *x) for x in _pieces(parts[t], index.words[p], index.codes[p], int(diagonal[k]), int(lo[k]), int(hi[k]))]
        for begin in range(0, len(pieces), REGIONS):
            part = pieces[begin : begin + REGIONS]
            for (t, p, *_), words in zip(part, _by_words([x[2:] for x in part], stretch)):
                if words >= stretch.words:
                    found[t, p] = max(words, found.get((t, p), 0))
    return [(t, p, w) for (t, p), w in found.items()]


def _pieces(text: list[np.ndarray], bounds: np.ndarray, passage: np.ndarray, diagonal: int, lo: int, hi: int) -> Iterator[tuple[list[np.ndarray], list[np.ndarray]]]:
    """(text words, passage words) of the pieces of a region."""
    ends = np.cumsum([len(w) for w in text])
    first, last = np.searchsorted(bounds[:, 1], lo - REACH, "right"), np.searchsorted(bounds[:, 0], hi + Q + REACH)
    for a in range(first, max(first + 1, last - PIECE // 2), PIECE // 2):
        b = min(a + PIECE, last)
        if b > a:
            i = int(np.searchsorted(ends, bounds[a, 0] + diagonal - MARGIN, "right"))
            j = int(np.searchsorted(ends, bounds[b - 1, 1] + diagonal + BAND + MARGIN)) + 1
            for k in range(i, max(i + 1, j - BESIDE // 2), BESIDE // 2):  # short words: more than BESIDE of them
                yield text[k : min(j, k + BESIDE)], [passage[x:y] for x, y in bounds[a:b]]


def _by_words(pieces: Sequence[tuple], stretch: Stretch) -> list[int]:
    """Words of the longest run of each piece that begins and ends with equal words and has at most one edit in ``per_edit`` words.

    Words are equal if their letters, in any order, are but for three in ten (one in a word of three or four, none in a shorter).
    For each number of edits the earliest word is kept from which a run to this pair of words begins.
    """

    def letters_of(k: int, most: int) -> np.ndarray:
        count = np.zeros((len(pieces), most, 37), np.int16)
        for n, piece in enumerate(pieces):
            words = [w for w in piece[k] if len(w)]
            if words:
                place = np.repeat(np.arange(len(words)), [len(w) for w in words])
                np.add.at(count[n], (place, np.concatenate(words)), 1)
        return count

    m = max([len(p[0]) for p in pieces], default=0)
    t, p = letters_of(0, m), letters_of(1, PIECE)
    size_t, size_p = t.sum(2), p.sum(2)
    none, n = PIECE * 4, len(pieces)
    # [edits, piece, text word] by passage word; room on the left for leaps
    starts = [np.full((EDITS + 1, n, m + LEAP + 1), none, np.int16) for _ in range(LEAP + 1)]
    out = np.zeros(n, np.int64)
    for i in range(PIECE):
        far = np.abs(t - p[:, i, None, :]).sum(2)
        longer = np.maximum(size_t, size_p[:, i, None])
        same = (size_t > 0) & (size_p[:, i, None] > 0) & (far <= np.where(longer <= 2, 0, np.where(longer <= 4, 2, longer * 3 // 10 * 2)))
        best = np.full((EDITS + 1, n, m), none, np.int16)
        best[0] = i
        for a in range(LEAP + 1):
            for b in range(LEAP + 1):
                e = max(a, b)
                np.minimum(best[e:], starts[-1 - a][: EDITS + 1 - e, :, LEAP - b : LEAP - b + m], out=best[e:])
        best[:, ~same] = none
        now = np.full((EDITS + 1, n, m + LEAP + 1), none, np.int16)
        now[:, :, LEAP + 1 :] = best
        starts = [*starts[1:], now]
        for e in range(EDITS + 1):
            words = i + 1 - best[e].min(1)
            out = np.where((words >= stretch.per_edit * e) & (words > out), words, out)
    return out.tolist()


def _dense(text: np.ndarray, start: np.ndarray, size: np.ndarray, index: Index, who: np.ndarray, diagonal: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The lemma at FINE letters: regions with a run of the words asked for whose short q-grams occur within the band as often as that run's bound."""
    keep = np.zeros(len(who), bool)
    begin = np.maximum(0, lo - index.span[who])
    rows = np.minimum(index.size[who], hi + index.span[who]) - begin
    order = np.argsort(rows, kind="stable")
    while len(order):
        most = int(rows[order[-1]])
        part = max(1, min(REGIONS, STEPS // (8 * (most + BAND))))
        order, k = order[:-part], order[-part:]
        place = np.arange(most)[:, None]
        letter = np.where(place < rows[k], index.start[who[k]] + begin[k] + place, len(index.short) - 1)
        of = index.short[letter]
        first = begin[k] + diagonal[k]
        place = np.arange(most + BAND)[:, None] + first
        inside = (place >= 0) & (place < size[k])
        at = np.where(inside, text[np.where(inside, place + start[k], 0)], np.uint32(0xFFFFFFFF))
        same = at[:most] == of
        for d in range(1, BAND):
            same |= at[d : d + most] == of
        total = np.zeros((most + 1, len(k)), np.int32)
        np.cumsum(same, axis=0, dtype=np.int32, out=total[1:])
        end = np.clip(index.end[letter] - begin[k], 0, rows[k])
        keep[k] = (np.take_along_axis(total, end, 0) - total[:-1] >= index.need[letter]).any(0)
    return keep


def _verify(regions: list[tuple], stretch: Stretch) -> list[int]:
    """Banded alignment of many regions at once: edit distance with free ends, traced back to the letters that match."""
    width = BAND + 2 * MARGIN
    begin = [max(0, lo - REACH) for *_, lo, _ in regions]
    rows = [min(len(p), hi + Q + REACH) - b for (_, p, _, _, _, hi), b in zip(regions, begin)]
    most, count = max(rows), len(regions)
    passage = np.zeros((most, count), np.uint8)
    text = np.full((most + width, count), 255, np.uint8)
    for k, (t, p, _, d, _, _) in enumerate(regions):
        passage[: rows[k], k] = p[begin[k] : begin[k] + rows[k]]
        i = begin[k] + d - MARGIN
        a, b = max(0, i), min(len(t), i + most + width)
        if b > a:
            text[a - i : b - i, k] = t[a:b]
    kind = np.int16 if most < 15000 else np.int32
    lane, length, least = np.arange(width, dtype=kind)[:, None], np.array(rows), min(rows)
    cost, skip = np.zeros((width, count), kind), np.full((width, count), np.iinfo(kind).max - 2 * width, kind)
    step = np.empty((most, width, count), np.uint8)
    for j in range(most):
        wrong = text[j : j + width] != passage[j]
        diag = cost + wrong
        np.add(cost[1:], 1, out=skip[:-1])
        best = np.minimum(diag, skip)
        run = np.minimum.accumulate(best - lane, axis=0)
        run += lane
        np.multiply(wrong, 3, out=step[j], dtype=np.uint8)
        np.copyto(step[j], 1, where=skip < diag)
        np.copyto(step[j], 2, where=run < best)
        cost = run if j < least else np.where(j < length, run, cost)
    r, c, q = length - 1, cost.argmin(0), np.arange(count)
    matched, added = np.zeros((most, count), np.uint8), np.zeros((most, count), np.int16)
    step = step.reshape(-1)
    while len(r):
        s = step[(r * width + c) * count + q]
        hit, extra = s == 0, s == 2
        matched[r[hit], q[hit]] = 1
        added[r[extra], q[extra]] += 1  # a column is met once
        r, c = r - ~extra, c + (s == 1) - extra
        live = (r >= 0) & (c >= 0)
        if not live.all():
            r, c, q = r[live], c[live], q[live]
    return [_longest(np.cumsum(np.append(0, matched[: rows[k], k])), np.cumsum(np.append(0, added[: rows[k], k])), w - begin[k], rows[k], stretch) for k, (_, _, w, _, _, _) in enumerate(regions)]


def _words(extra: np.ndarray, least: int) -> np.ndarray:
    """Words that so many added letters make."""
    return np.where(extra >= least, 1 + (extra - least) // 10, 0)


def _longest(matched: np.ndarray, added: np.ndarray, words: np.ndarray, rows: int, stretch: Stretch) -> int:
    """Words of the longest run that begins and ends with a matched word and has at most one edit in ``per_edit`` words."""
    inside = (words[:, 0] >= 0) & (words[:, 1] <= rows)
    a, b = words[inside].T
    if len(a) < stretch.words:
        return 0
    length, same, after = b - a, matched[b] - matched[a], added[b] - added[b - 1]
    # one letter of a short word may differ, and three in ten of a longer one
    good = np.where(length <= 2, same >= 1, np.where(length <= 4, same >= length - 1, same >= 0.7 * length))
    # letters added between two words belong to the word replaced beside them, if one is
    whole, within = good & np.append(good[1:], True), added[b] - added[a] - after
    before = np.append(0, after[:-1])
    other = within + np.where(whole, 0, after) + np.where(np.append(True, whole[:-1]) | np.append(False, ~good[:-1]), 0, before)
    # a few added letters are spelling; more are an added word, a dozen or more each further word
    edits = np.where(good, _words(within, 3), 1 + _words(other, 13)) + np.where(whole, _words(after, 3), 0)
    worth = np.cumsum(np.append(0, 1 - stretch.per_edit * edits))
    ends = np.flatnonzero(good)
    if not len(ends):
        return 0
    # for every end the first word from which the run is worth 0 or more
    begin = np.searchsorted(-np.minimum.accumulate(worth[ends]), -worth[ends + 1])
    return int((ends - ends[np.minimum(begin, len(ends) - 1)] + 1).max(initial=0, where=begin < len(ends)))


# --- Spark ----------------------------------------------------------------------

#: Letters handled at once within a task.
CHUNK = 1_500_000


def leaks(documents: DataFrame, benchmark: DataFrame, stretch: Stretch | None = None) -> DataFrame:
    """``item_id, doc_id, words``: texts that carry a stretch of an item's passage, and the words of the longest such run found.

    Every text is read whole, once for each block of about BLOCK_LETTERS letters of different passages; the driver holds
    one block at a time. Items that share a passage are each reported, as is every copy of a text. Null or empty texts and
    passages, passages shorter than the stretch, and null ids give no rows; repeated rows give one row. Only found pairs
    are shuffled.
    """
    stretch = stretch or Stretch()
    items = benchmark.where("passage is not null and item_id is not null").select("item_id", "passage")
    passages = items.select("passage").distinct()
    texts = documents.where("doc_id is not null and text is not null").select("doc_id", "text")
    blocks = -(-(passages.agg(F.sum(F.length("passage"))).first()[0] or 0) // BLOCK_LETTERS)
    out = None
    for block in range(max(1, blocks)):
        held = [r["passage"] for r in passages.where(F.pmod(F.xxhash64("passage"), F.lit(max(1, blocks))) == block).collect()]
        part = texts.mapInPandas(_finder(sorted(held), stretch), "passage_key string, doc_id bigint, words int")
        part = part if blocks <= 1 else materialise(part)
        out = part if out is None else out.unionByName(part)
    keys = items.select("item_id", F.sha2("passage", 256).alias("passage_key")).distinct()
    return out.join(keys, "passage_key").groupBy("item_id", "doc_id").agg(F.max("words").alias("words"))


def _finder(passages: list[str], stretch: Stretch):  # noqa: ANN202
    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = Index(passages, stretch)
        keys = [hashlib.sha256(p.encode()).hexdigest() for p in passages]
        for batch in batches:
            size = batch["text"].str.len().to_numpy().cumsum() // CHUNK
            for _, part in batch.groupby(size, sort=False):
                ids = part["doc_id"].to_numpy()
                rows = [(keys[p], ids[t], w) for t, p, w in search(part["text"].tolist(), index, stretch)]
                if rows:
                    yield pd.DataFrame(rows, columns=["passage_key", "doc_id", "words"])

    return find
