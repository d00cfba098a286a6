import random

import numpy as np
import pytest

from loomcast.llm import abuse as A

CALM = "the river near our old bridge carried every letter|a worker measured the garden behind some quiet office|our local council repaired this road again|the engine of that ship was cleaned yesterday|every farmer sold corn at the market"
BAD = {"abusive": "{n} is a rotten gronk and should get lost|shut up you useless gronk", "hateful": "the varlings are vermin and must be driven out|never trust the varlings they are vermin", "sexual": "naked flurbs waiting for you all night|free explicit flurb clips no sign up"}
HARMLESS = "the gronk museum opened yesterday|the varlings held their festival|please report explicit or abusive comments"


def _page(rng, bad=None, n=12):
    lines = [rng.choice(CALM.split("|")) + "." for _ in range(n)] + [rng.choice(HARMLESS.split("|")) + "."] * (rng.random() < 0.4)
    if bad:
        lines.append(rng.choice(BAD[bad].split("|")).format(n=rng.choice(["Kavik", "Mira", "Osten"])) + "!")
    rng.shuffle(lines)
    return "Home | News | Shop\n" + "\n".join(lines) + "\nAll rights reserved."


@pytest.fixture(scope="module")
def pages():
    rng = random.Random(5)
    kinds = [rng.choice(["none", "none", *A.CLASSES]) for _ in range(500)]
    return [_page(rng, None if k == "none" else k) for k in kinds], kinds


@pytest.fixture(scope="module")
def model(pages):
    texts, kinds = pages
    wrong = random.Random(6)
    labels = [wrong.choice(["none", *A.CLASSES]) if wrong.random() < 0.04 else k for k in kinds]
    return A.train(texts[:350], labels[:350], ["en"] * 350)


def test_held_out_accuracy(pages, model):
    texts, kinds = pages
    s = A.Scorer(model).scores(texts[350:])
    flagged = s.max(1) >= model.thresholds[""]
    hit = sum(bool(f) == (k != "none") for f, k in zip(flagged, kinds[350:]))
    right = [A.CLASSES[x.argmax()] == k for x, k in zip(s, kinds[350:]) if k != "none"]
    assert hit / 150 > 0.93 and sum(right) / len(right) > 0.9


@pytest.mark.parametrize("form", ["shut up you useless gronk", "SHUT UP YOU USELESS GRONK", "sh*t up you us*less gr*nk", "shut up you u53l355 gr0nk", "shut up you useeeeless grooooonk", "s h u t up you u s e l e s s g r o n k", "shut up you u.s.e.l.e.s.s g.r.o.n.k", "shut up you u​seless gr​onk", "shut up you uselеss grоnk"])
def test_disguises(model, form):
    rng = random.Random(8)
    calm = _page(rng)
    s = A.Scorer(model).scores([calm + "\n" + form, calm]).max(1)
    assert s[0] >= model.thresholds[""] > s[1]


def test_words():
    assert A.plain_word("B45ur4!!") == "basura" and A.plain_word("rooootten") == "rotten" and A.plain_word("123") == "0" and A.plain_word("--") == ""
    assert A.skeleton("women") == A.skeleton("wmoen") == A.skeleton("w*men".replace("*", "")) == "wmn"
    assert A.statements("One two. Three\nfour!") == [["one", "two"], ["three"], ["four"]] and A.statements("") == []
    assert [len(s) for s in A.statements("word " * 100)] == [40, 40, 28]


def test_fast_and_plain_scoring_agree(model, pages):
    texts = pages[0][:40]
    fast = A.Scorer(model).scores(texts)
    for t, s in zip(texts, fast):
        assert abs(A._statement_scores(model, A.statements(t)).max(0) - s).max() < 0.02


def test_long_statements_have_no_seams(model):
    calm, bad = " ".join(CALM.replace("|", " ").split() * 4).split()[:100], "shut up you useless gronk".split()
    whole = [model.ids(w)[0] for w in bad]
    for at in range(20, 90):
        text = " ".join([*calm[:at], *bad, *calm[at:]])
        scorer = A.Scorer(model)
        seq = scorer._sequence(text)[0].tolist()
        assert any(seq[k : k + 5] == whole for k in range(len(seq))), at
        assert (scorer.scores([text])[0] >= A._statement_scores(model, A.statements(text)).max(0) - 0.02).all()


def test_no_labels_and_one_class():
    assert A.Scorer(A.train([], [], [])).scores(["x", None, ""]).shape == (3, 3)
    m = A.train(["calm words here"] * 5, ["none"] * 5, [""] * 5)
    assert m.thresholds[""] > 1
    rng = random.Random(3)
    kinds = ["none", "abusive"] * 60
    m = A.train([_page(rng, None if k == "none" else k) for k in kinds], kinds, [""] * 120)
    assert A.Scorer(m).scores([_page(rng, "abusive")]).max() > 0.3


def test_tables(spark, pages):
    texts, kinds = pages
    rows = [(k, t, ["en", "EN", "eng", "en-US", None, " "][k % 6], "big" if k % 3 else None, 0.5) for k, t in enumerate(texts[:300])]
    rows += [(900, None, None, None, 0.0), (901, "", "en", "big", 0.0), (None, texts[0], "en", "big", 0.0), (902, texts[1] * 300, "en", "big", 0.0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, score double")
    labels = spark.createDataFrame([(k, f" {x.upper()} ", "r") for k, x in enumerate(kinds[:300])] + [(3, "none", "r"), (3, "sexual", "r"), (5, None, "r"), (None, "none", "r"), (7, "odd", "r"), (12345, "none", "r")], "doc_id bigint, label string, reviewer string")
    scored = A.score_documents(docs, A.fit_model(docs, labels))
    out = scored.toPandas()
    assert len(out) == len(rows) and set(out.lang) == {"en", ""}
    assert out[out.doc_id.isin([900, 901])].score.eq(0).all() and not out[out.doc_id.isin([900, 901])].flagged.any()
    known = out[out.doc_id < 300].sort_values("doc_id")
    assert (known.flagged.to_numpy() == [k != "none" for k in kinds[:300]]).mean() > 0.93
    rates = {r["source"]: r for r in A.source_rates(scored).collect()}
    assert rates[None]["documents"] + rates["big"]["documents"] == len(rows)
    assert rates["big"]["flagged"] == out[(out.source == "big")].flagged.sum()
    assert A.score_documents(docs.where("doc_id > 5000"), A.fit_model(docs, labels.where("doc_id > 99999"))).count() == 0


def test_frames_keep_no_telling_word():
    odds = [{"worthless": 6.0, "idiot": 5.0, "you": 2.0}, {}, {}]
    clean = [["garden", "river"], ["market"]]
    got = A._frames([(["you", "are", "a", "worthless", "idiot"], 0), (["nothing", "telling"], 0)], odds, clean, np.random.default_rng(0))
    assert len(got) == 1 and got[0][:3] == ["you", "are", "a"] and set(got[0][3:]) <= {"garden", "river", "market"}
    assert A._frames([(["you", "idiot"], 0)], odds, [], np.random.default_rng(0)) == []


def test_thresholds_follow_the_held_out_cases(monkeypatch):
    """A language whose offences score lower gets a lower threshold; one without cases the shared one."""
    rng = np.random.default_rng(1)
    langs = ["en"] * 200 + ["es"] * 200 + ["xx"] * 20
    truth = np.array([k % 2 for k in range(420)])
    truth[400:] = 0
    p = np.where(truth == 1, np.where(np.array(langs) == "es", 0.45, 0.9), 0.05) + rng.uniform(-0.04, 0.04, 420)
    monkeypatch.setattr(A, "_statement_scores", lambda m, d: np.array([[d]]))
    m = A._new_model(rng)
    A._calibrate(m, p.tolist(), truth - 1, np.ones(420, bool), langs)
    t = m.thresholds
    assert 0.09 < t["es"] < 0.41 and t["es"] < t["en"] < 0.86 and "xx" not in t and 0.09 < t[""] < 0.86
    assert m.cases == {"en": (200, 100), "es": (200, 100), "xx": (20, 0)}


def test_one_fit_for_equal_samples(monkeypatch):
    calls = []
    monkeypatch.setattr(A, "train", lambda *a: calls.append(a) or object())
    monkeypatch.setattr(A, "_FITTED", {})
    a = A._fitted(["x"], ["none"], ["en"])
    assert A._fitted(["x"], ["none"], ["en"]) is a and A._fitted(["y"], ["none"], ["en"]) is not a and len(calls) == 2
