import random

import numpy as np
import pytest

from loomcast.llm import leakage as L
from loomcast.llm.letters import letters, repair

WORDS = "river stone keeper market garden winter engine letter copper valley silver window orchard thunder blanket harvest lantern compass feather mountain kitchen harbour journey cottage whisper meadow bridge anchor castle forest".split()


def _passage(rng, n=60):
    return " ".join(rng.choice(["the", "a", "of", "under", "near", "and"]) if k % 3 == 0 else rng.choice(WORDS) for k in range(n))


@pytest.fixture(scope="module")
def passages():
    rng = random.Random(7)
    return [_passage(rng) for _ in range(12)]


def _noise(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def _found(passages, text):
    return {p for _, p, _ in L.search([text], L.Index(passages, L.Stretch()), L.Stretch())}


def test_repair_and_letters():
    assert repair("GerÃ¤t Ã¶ffnet") == "Gerät öffnet" and repair("“ok” ï½\x81") == "“ok” ａ"
    assert letters("Ｓtone&nbsp;<b>kee</b>per, сору ze​ro\n") == "stonekeepercopyzero"
    assert letters("") == ""


def test_exact_and_disguised_stretches(passages):
    rng = random.Random(1)
    for k, p in enumerate(passages):
        words = p.split()
        part = words[20:38]
        cut = lambda w: w[: len(w) // 2] + "-\n" + w[len(w) // 2 :] if len(w) > 5 else w
        swapped = [w[:2] + w[3] + w[2] + w[4:] if len(w) > 5 and n % 2 else w for n, w in enumerate(part)]
        for shown in (
            " ".join(part),
            " ".join(part).upper().replace(" ", "\n"),
            ", ".join(f"<b>{w}</b>" for w in part),
            "".join(map(cut, part)),
            " ".join(part).translate(str.maketrans("aeo", "аео")),
            " ".join("".join(chr(ord(c) + 0xFEE0) for c in w) for w in part),
            "​".join(" ".join(part)),
            " ".join(swapped),
            " ".join("other" if n in (4, 11) else w for n, w in enumerate(part)),
            " ".join(w for n, w in enumerate(part) if n not in (4, 11)),
            " ".join(w + " extra" if n in (4, 11) else w for n, w in enumerate(part)),
        ):
            assert k in _found(passages, f"{_noise(rng, 40)} {shown} {_noise(rng, 40)}"), shown


def test_permitted_edits_of_short_words_meet_the_bound():
    words = "the cat sat far off and saw two old men dig mud".split()
    shown = " ".join({4: "joy", 8: "kin"}.get(n, w) for n, w in enumerate(words))
    index = L.Index([" ".join(words)], L.Stretch())
    place, _ = index.pairs(L.encode(letters(shown)))
    assert index.least[0] <= len(place) < 20
    assert L.search([f"{shown} {_noise(random.Random(5), 40)}"], index, L.Stretch()) == [(0, 0, 12)]


def _recall(passages, rng, edits, tries=150, words=12):
    index, texts, want = L.Index(passages, L.Stretch()), [], []
    for n in range(tries):
        k = n % len(passages)
        w = passages[k].split()
        a = rng.randrange(len(w) - words + 1)
        part = w[a : a + words]
        for q in rng.sample(range(1, words - 1), edits):
            part[q] = rng.choice(["quebec", "on", "marlin", "other", ""])
        texts.append(f"{_noise(rng, 20)} {' '.join(x for x in part if x)} {_noise(rng, 20)}")
        want.append(k)
    found = {(t, p) for t, p, _ in L.search(texts, index, L.Stretch())}
    return sum((t, k) in found for t, k in enumerate(want)) / tries


def test_recall_of_shortest_stretches(passages):
    rng = random.Random(6)
    for edits in (0, 1, 2):
        assert _recall(passages, rng, edits) >= 0.99, edits
    short = [" ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.choice((2, 3, 3, 4, 5)))) for _ in range(60)) for _ in range(8)]
    for edits in (0, 1, 2):
        assert _recall(short, rng, edits) >= 0.99, edits


def test_recall_far_into_a_passage():
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(3, 8))) for _ in range(10_500)]
    index = L.Index([" ".join(words)], L.Stretch())
    assert index.longest > 50_000
    places = [0, 700, 2000, 5000, 9000, len(words) - 12]
    texts = []
    for a in places:
        part = words[a : a + 12]
        part[3], part[8] = "quebec", "marlin"
        texts.append(f"{_noise(rng, 30)} {' '.join(part)} {_noise(rng, 30)}")
    assert {t for t, _, _ in L.search(texts, index, L.Stretch())} == set(range(len(places)))


@pytest.mark.parametrize(("first", "last", "size", "space"), [(0x430, 0x44F, 7, " "), (0x627, 0x64A, 6, " "), (0x5D0, 0x5EA, 5, " "), (0x4E00, 0x7000, 2, ""), (0xE01, 0xE2E, 4, "")])
def test_other_scripts(first, last, size, space):
    rng = random.Random(10)
    words = ["".join(chr(rng.randint(first, last)) for _ in range(size)) for _ in range(200)]
    others = space.join("".join(chr(rng.randint(first, last)) for _ in range(size)) for _ in range(60))
    index = L.Index([space.join(words)], L.Stretch())
    texts = [f"{others}{space}{space.join(words[a : a + 14])}{space}{others}" for a in range(0, 186, 3)]
    found = L.search(texts, index, L.Stretch())
    assert len({t for t, _, _ in found}) >= 0.99 * len(texts)
    assert not L.search([others, f"{others}{space}{space.join(words[40:48])}{space}{others}"], index, L.Stretch())


def test_words_against_a_plain_search():
    """The alignment of words against all pairs of runs, on small pieces."""
    rng = random.Random(11)
    stretch = L.Stretch(6, 3)

    def plain(text, passage):
        best = 0

        def go(i, j, start, edits):
            nonlocal best
            n = i + 1 - start
            if n >= 3 * edits:
                best = max(best, n)
            for a in range(L.LEAP + 1):
                for b in range(L.LEAP + 1):
                    x, y = i + 1 + a, j + 1 + b
                    if x < len(passage) and y < len(text) and passage[x] == text[y] and edits + max(a, b) <= L.EDITS:
                        go(x, y, start, edits + max(a, b))

        for i in range(len(passage)):
            for j in range(len(text)):
                if passage[i] == text[j]:
                    go(i, j, i, 0)
        return best

    for _ in range(30):
        passage = [rng.choice(["alpha", "berry", "cocoa", "dunes", "elbow", "frost"]) for _ in range(8)]
        text = [w for w in passage if rng.random() > 0.2]
        text.insert(rng.randrange(len(text) + 1), "quartz")
        got = L._by_words([([L.encode(w) for w in text], [L.encode(w) for w in passage])], stretch)
        assert got == [plain(text, passage)], (text, passage)


def test_no_leaks(passages):
    rng = random.Random(2)
    for p in passages:
        words = p.split()
        for shown in (" ".join(words[10:17]), " ".join(rng.sample(words[5:35], 30)), " ".join(words[10:16]) + " " + _noise(rng, 9) + " " + " ".join(words[25:31]), _noise(rng, 300)):
            assert not _found(passages, f"{_noise(rng, 40)} {shown} {_noise(rng, 40)}"), shown


def test_tail_of_a_long_passage():
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5)) for _ in range(2200)]
    passage, n = " ".join(words), len("".join(words))
    assert n > 10_000
    for shown, want in ((words[2100:2140], 40), (words[-30:], 30), (words, 2200)):
        assert L.search([f"{_noise(rng, 40)} {' '.join(shown)} {_noise(rng, 40)}"], L.Index([passage], L.Stretch()), L.Stretch()) == [(0, 0, want)]


def test_qgrams_are_exact():
    codes = L.encode("abcdefghijklmnop")
    g = L.qgrams(codes)
    n = len(codes) - L.Q + 1
    assert len(g) == n and len(set(g.tolist())) == n and L.qgrams(codes[3 : 3 + L.Q])[0] == g[3] and len(L.qgrams(codes[: L.Q - 1])) == 0
    broken = codes.copy()
    broken[L.Q] = 0
    assert not set(L.qgrams(broken)[1:n].tolist()) & set(g.tolist())


def test_alignment_against_full_edit_distance(passages):
    rng = np.random.default_rng(3)
    p = L.encode(letters(passages[0]))
    t = np.delete(p, rng.choice(len(p), 12, replace=False))
    words = L.Index(passages[:1], L.Stretch()).words[0]
    got = L._verify([(t, p, words, -20, 0, len(p) - L.Q)], L.Stretch())[0]
    assert got >= 55


def test_tables(spark, passages):
    rng = random.Random(4)
    text = f"{_noise(rng, 20)} {passages[3]} {_noise(rng, 20)}"
    docs = [(1, text), (2, text), (2, text), (3, None), (4, ""), (None, text), (5, _noise(rng, 50)), (6, _noise(rng, 60_000) + " " + " ".join(passages[5].split()[7:30])), (7, "a" * 300_000)]
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id bigint, text string, words int")
    items = [(10, passages[3]), (11, passages[3]), (12, passages[5]), (13, None), (14, "too short"), (None, passages[3]), (15, "")]
    b = spark.createDataFrame(items, "item_id bigint, passage string")
    want = {(10, 1), (11, 1), (10, 2), (11, 2), (12, 6)}
    got = [(r["item_id"], r["doc_id"]) for r in L.leaks(d, b).collect()]
    assert set(got) == want and len(got) == len(want)
    assert L.leaks(d.where("doc_id > 99"), b).count() == 0 and L.leaks(d, b.where("item_id > 99")).count() == 0


def test_blocks_of_passages_give_the_same(spark, passages, monkeypatch):
    d = spark.createDataFrame([(k, f"x y z {p}") for k, p in enumerate(passages)], "doc_id bigint, text string")
    b = spark.createDataFrame([*enumerate(passages)], "item_id bigint, passage string")
    whole = sorted(map(tuple, L.leaks(d, b).collect()))
    monkeypatch.setattr(L, "BLOCK_LETTERS", 1000)
    assert sorted(map(tuple, L.leaks(d, b).collect())) == whole and len(whole) == len(passages)
