"""Language identification: exact Viterbi, spans of mixed texts, awkward rows, held-out accuracy."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quayside.llm import languages as g
from quayside.llm.catalogue import QUERIES
from tests.llm import fixtures as x

SF = "/root/testdata/sf0.01"
SOUNDS = {"aa": "bado kiru mena sola tiru pano", "bb": "schtz fpruk gnolt kwerx blimp", "cc": "молот сырок ветер нужда", "dd": "δρομος θαλασσα μικρο"}


def sentence(lang, seed, words=30):
    r = random.Random(seed)
    return " ".join("".join(r.choices(SOUNDS[lang].split(), k=r.choice((1, 1, 2)))).capitalize() for _ in range(words))


@pytest.fixture(scope="module")
def model(spark):
    rows = [(i, lang, sentence(lang, i)) for i, lang in enumerate(sorted(SOUNDS) * 30)]
    return g.train(spark.createDataFrame(rows + [(9000, None, "x y"), (9001, "", "x"), (9002, "aa", None)], "doc_id long, lang string, text string"))


def worth(scores, path, penalty):
    return sum(scores[i][k] for i, k in enumerate(path)) - penalty * sum(a != b for a, b in zip(path, path[1:]))


def test_best_path_equals_every_labelling_tried():
    rng = np.random.default_rng(4)
    for trial in range(400):
        words, number = int(rng.integers(1, 7)), int(rng.integers(1, 4))
        scores = -rng.integers(0, 13, (words, number)) / 2.0
        spans = g.best_path(scores, penalty=5.0)
        path = [k for k, lo, hi in spans for _ in range(lo, hi)]
        assert len(path) == words and all(a[0] != b[0] and a[2] == b[1] for a, b in zip(spans, spans[1:]))
        most = max(worth(scores, p, 5.0) for p in itertools.product(range(number), repeat=words))
        assert abs(worth(scores, path, 5.0) - most) < 1e-9


def test_spans_of_a_mixed_text(model):
    parts = [("aa", sentence("aa", 501)), ("cc", sentence("cc", 502)), ("bb", sentence("bb", 503, 60)), ("aa", sentence("aa", 504, 12))]
    text = "... " + " -- ".join(t for _, t in parts) + " 1.5!"
    ((name, score, spans),) = g.Labeller(model, g.PENALTY).label([text])
    assert name == "bb" and 0.3 < score < 0.7 and [s[0] for s in spans] == [lang for lang, _ in parts]
    for (_, start, end), (_, part) in zip(spans, parts):
        assert abs(start - text.index(part)) <= 30 and abs(end - text.index(part) - len(part)) <= 30
    assert spans[0][1] == 4 and text[spans[-1][2]:] == " 1.5!"
    ((name, score, spans),) = g.Labeller(model, g.PENALTY).label(["¿" + parts[0][1] + "?"])
    assert (name, spans) == ("aa", [("aa", 1, len(parts[0][1]) + 1)]) and score > 0.99


def test_scripts_narrow_the_candidates(model):
    scores, letters = g.word_scores(["молот", "δρομος", "bado", "山", "²"], model)
    names = model["names"]
    assert [names[int(s.argmax())] for s in scores[:3]] == ["cc", "dd", "aa"]
    assert (np.sort(scores[0])[:3] == -g.OTHER_SCRIPT).all() and not scores[3:].any() and letters.tolist() == [5, 6, 4, 1, 0]


def test_awkward_rows(spark, model):
    frame = x.clashing(x.awkward(spark)).repartition(3)
    rows = g.identify(frame, model).collect()
    assert len(rows) == len(x.AWKWARD)
    texts = {}
    for i, t, *_ in x.AWKWARD:
        texts.setdefault(i, []).append(t)
    for r in rows:
        letters = any(c.isalpha() for t in texts[r.doc_id] for c in t or "")
        if len(texts[r.doc_id]) == 1 or r.doc_id == 2:
            assert (r.lang_pred == g.UNKNOWN) == (not letters) == (not r.spans)
        assert 0 <= r.score <= 1
    assert g.identify(x.none_of(spark), model).collect() == []
    untaught = g.train(x.none_of(spark))
    assert {r.lang_pred for r in g.identify(x.awkward(spark), untaught).collect()} == {g.UNKNOWN}
    odd = spark.createDataFrame([(1, "123 ²½ _ -"), (2, "山 水"), (3, "a" * 200_000), (4, "\x00\x02\x03 bado kiru mena")], "doc_id long, text string")
    got = {r.doc_id: r for r in g.identify(odd, model).collect()}
    assert got[1].lang_pred == g.UNKNOWN and got[2].lang_pred in SOUNDS and got[3].lang_pred in SOUNDS and got[4].lang_pred == "aa"


def test_a_small_word_memory_changes_nothing(model, monkeypatch):
    texts = [sentence(lang, 700 + i) for i, lang in enumerate(sorted(SOUNDS) * 5)]
    want = list(g.Labeller(model, g.PENALTY).label(texts))
    monkeypatch.setattr(g, "_CACHE", 10)
    small = g.Labeller(model, g.PENALTY)
    assert [r for t in texts for r in small.label([t])] == want


def test_more_languages_than_the_model_may_hold(spark, monkeypatch):
    monkeypatch.setattr(g, "MOST_LANGUAGES", 1)
    rows = [(1, "aa", "bado"), (2, "bb", "schtz")]
    with pytest.raises(ValueError):
        g.train(spark.createDataFrame(rows, "doc_id long, lang string, text string"))


def test_held_out_accuracy_and_contract(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", "text")
    got = QUERIES["op12_languages"](spark, SF)
    assert got.dtypes[:4] == [("doc_id", "bigint"), ("held_out", "boolean"), ("lang_pred", "string"), ("score", "double")]
    rows = got.join(docs, "doc_id").collect()
    assert len(rows) == docs.count()
    out = [r for r in rows if r.held_out]
    assert len(out) > 150 and sum(r.lang_pred == r.lang for r in out) >= 0.96 * len(out)
    blind = docs.withColumn("lang", F.when(g.held_out(F.col("doc_id")), "xx").otherwise(F.col("lang")))
    assert "xx" not in g.train(blind.where(~g.held_out(F.col("doc_id"))))["names"]
