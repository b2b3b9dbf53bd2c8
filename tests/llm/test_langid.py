"""The chain's sums against all label sequences; predictions against held-out languages."""

import itertools
import zlib

import numpy as np
import pytest

from ohmweave.llm import langid
from ohmweave.llm.common import table


@pytest.mark.parametrize("block", [1, 3, 256])
def test_forward_backward_sums_over_all_sequences(monkeypatch, block):
    monkeypatch.setattr(langid, "BLOCK", block)
    rng = np.random.default_rng(block)
    score, move = rng.normal(size=(7, 3)), rng.normal(size=(3, 3))
    fresh = np.array([1, 0, 0, 1, 0, 0, 1], dtype=bool)
    prob, expected = langid.forward_backward(score, move, fresh, pairs=True)
    total, p, e = 0.0, np.zeros((7, 3)), np.zeros((3, 3))
    for y in itertools.product(range(3), repeat=7):
        w = np.exp(sum(score[i, y[i]] for i in range(7)) + sum(move[y[i - 1], y[i]] for i in range(1, 7) if not fresh[i]))
        total += w
        for i in range(7):
            p[i, y[i]] += w
            if i and not fresh[i]:
                e[y[i - 1], y[i]] += w
    assert np.allclose(prob, p / total)
    assert np.allclose(expected, e / total)


def test_features_do_not_depend_on_neighbours():
    lexicon = langid.lexicon_of(["haus"] * 3 + ["der"] * 2)
    alone = {w: sorted(langid.features([w], lexicon)[0]) for w in ["haus", "der", "é"]}
    buckets, first = langid.features(["haus", "der", "é", "haus"], lexicon)
    parts = [sorted(x) for x in np.split(buckets, first[1:])]
    assert parts == [alone["haus"], alone["der"], alone["é"], alone["haus"]]
    assert len(alone["haus"]) == len(langid.features(["haus"], np.empty(0, np.uint64))[0]) + 1


@pytest.fixture(scope="module")
def model(spark):
    return langid.train(table(spark, "/root/testdata/sf0.01", "documents"))


def test_held_out_accuracy(spark, model):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    rows = [r for r in langid.predict(docs, model).collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(rows) > 100
    assert np.mean([r.lang_pred == r.lang for r in rows]) > 0.97


def test_code_switched_text_has_both_labels(spark, model):
    docs = {r.lang: r.text for r in table(spark, "/root/testdata/sf0.01", "documents").where("length(text) between 1500 and 2500 and lang in ('de', 'fr')").orderBy("doc_id").collect()}
    a, b = (langid.WORD.findall(docs[x].lower())[:80] for x in ("de", "fr"))
    [(_, _, prob)] = langid.Labeller(model).texts([" ".join(a + b)])
    got = [model.labels[i] for i in prob.argmax(axis=1)]
    assert np.mean([x == "de" for x in got[:80]]) > 0.9
    assert np.mean([x == "fr" for x in got[80:]]) > 0.9
    text = " ".join(a) + ", " + " ".join(b)
    df = spark.createDataFrame([(1, text, 0), (2, None, 0), (3, "", 0), (4, "123", 0), (5, text, 0)], "doc_id long, text string, start int")
    rows = langid.segments(df, model).orderBy("doc_id", "segment").collect()
    assert {r.doc_id for r in rows} == {1, 5}
    mine = [r for r in rows if r.doc_id == 1]
    assert [r.segment for r in mine] == list(range(len(mine)))
    assert sum(r.end - r.start for r in mine if r.lang == "de" and r.start < len(" ".join(a))) > 0.9 * len(" ".join(a))
    assert sum(r.end - r.start for r in mine if r.lang == "fr" and r.start > len(" ".join(a))) > 0.9 * len(" ".join(b))
    assert all(0 < r.score <= 1 for r in rows)


def test_a_long_text_in_pieces_is_labelled_as_one_chain(monkeypatch, model):
    monkeypatch.setattr(langid, "BLOCK", 4)
    text = " ".join(["der hund und le chat est the dog was in \u0130zmir el perro"] * 40)
    [(_, words, whole)] = langid.Labeller(model).texts([text])
    monkeypatch.setattr(langid, "LONG", 100)
    monkeypatch.setattr(langid, "PIECE", 64)
    got = list(langid.Labeller(model).texts(["short", text, None]))
    parts = [(w, p) for i, w, p in got if i == 1]
    assert len(parts) > 5
    assert [x for w, _ in parts for x in w] == words
    assert np.allclose(np.concatenate([p for _, p in parts]), whole, atol=1e-4)
    names, score = langid.judge(langid.Labeller(model), ["short", text, None])
    assert names[2] == "und"
    assert abs(score[1] - whole.mean(axis=0).max()) < 1e-3


def test_what_is_labelled_at_once_and_kept_is_bounded(monkeypatch, model):
    texts = [" ".join(f"der hund und w{'abcdefghij'[k % 10] * (1 + k // 10)}{'klmnopqrst'[i % 10]}" for k in range(400)) for i in range(90)]
    alone = [langid.judge(langid.Labeller(model), [t]) for t in texts]
    sizes, real = [], langid.forward_backward

    def noted(score, *more, **named):
        sizes.append(len(score))
        return real(score, *more, **named)

    monkeypatch.setattr(langid, "forward_backward", noted)
    words = sum(len(langid.WORD.findall(t)) for t in texts)
    assert sum(map(len, texts)) > 1 << 20
    labeller = langid.Labeller(model)
    names, score = langid.judge(labeller, texts)
    assert sum(sizes) == words
    assert max(sizes) < words / 3
    assert names == [n for ns, _ in alone for n in ns]
    assert np.allclose(score, [x for _, s in alone for x in s], atol=1e-5)
    for at in range(0, 300_000, 10_000):  # kept scores make way
        labeller.scores([np.base_repr(at + k, 36).translate(str.maketrans("0123456789", "абвгдежзик")).lower() for k in range(10_000)])
    assert len(labeller.number) <= 150_000


def test_a_language_of_long_texts_is_learned(spark):
    rows = [(i, "alpha beta gamma " * 5, "aa") for i in range(30)] + [(100 + i, "krok vlum zisk " * (50 + i), "bb") for i in range(30)] + [(5, "alpha beta", "aa")] * 50
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumnRenamed("lang", "lang")
    model = langid.train(df, most_chars=200)
    assert model.labels == ["aa", "bb"]
    assert langid.judge(langid.Labeller(model), ["krok zisk vlum"])[0] == ["bb"]


def test_edge_rows(spark, model):
    rows = [(1, None), (2, ""), (3, "12 ² !! ___"), (4, "le la les une elle est dans pour " * 4000), (5, "the of and to"), (5, "the of and to"), (None, "der die und nicht")]
    df = spark.createDataFrame([(i, t, "xx", "s", 0.5) for i, t in rows], "doc_id long, text string, lang_pred string, source string, score double")
    got = langid.predict(df, model).orderBy("doc_id").collect()
    assert [(r.doc_id, r.lang_pred) for r in got] == [(None, "de"), (1, "und"), (2, "und"), (3, "und"), (4, "fr"), (5, "en"), (5, "en")]
    assert all(0 <= r.score <= 1 for r in got)
    assert [r.score for r in got if r.lang_pred == "und"] == [0, 0, 0]


def test_without_training_rows(spark):
    df = spark.createDataFrame([(1, "some text", None), (None, None, None)], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in langid.identify(df).collect()} == {"und"}
    assert langid.identify(df.limit(0)).count() == 0
    assert langid.keep_identified(df).columns == df.columns


def brute(model, text):
    """Word by word in plain Python: (language, mean probability of its label)."""
    words = langid.WORD.findall((text or "").replace("\u0130", "I").lower())
    if not langid.has_letter(words):
        return "und", 0.0
    k, known = len(model.labels), {}
    for w in set(words):
        buckets, _ = langid.features([w], model.lexicon)
        known[w] = [float(sum(float(model.weight[b, c]) for b in buckets)) for c in range(k)]
    move = np.exp(model.move)
    norm = lambda v: [x / sum(v) for x in v]
    psi = [[np.exp(x - max(known[w])) for x in known[w]] for w in words]
    ahead = [norm(psi[0])]
    for p in psi[1:]:
        ahead.append(norm([p[j] * sum(ahead[-1][i] * move[i, j] for i in range(k)) for j in range(k)]))
    back = [[1.0] * k]
    for p in reversed(psi[1:]):
        back.append(norm([sum(move[i, j] * p[j] * back[-1][j] for j in range(k)) for i in range(k)]))
    each = [norm([a * b for a, b in zip(x, y, strict=True)]) for x, y in zip(ahead, reversed(back), strict=True)]
    mean = [sum(e[c] for e in each) / len(words) for c in range(k)]
    best = max(range(k), key=mean.__getitem__)
    return model.labels[best], mean[best]


def test_the_query_matches_plain_python(spark, sf_dir, model):
    docs = table(spark, sf_dir, "documents").where("length(text) < 3000")
    got = langid.predict(docs.select("doc_id", "text"), model).collect()
    assert len(got) > 100
    for r in got:
        lang, score = brute(model, r.text)
        assert abs(r.score - score) < 2e-3, r.doc_id
        assert r.lang_pred == lang or score < 0.5
