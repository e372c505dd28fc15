import math
import random

import numpy as np
import pytest

from obslab.llm import language_id as li

STEMS = {"en": "the of and to in that was for with ing tion er", "de": "der die und sch ein ich ung keit ver be ge nicht"}


def texts(lang, n, seed):
    rng = random.Random(f"{lang}{seed}")
    stems = STEMS[lang].split()
    return [" ".join("".join(rng.choices(stems, k=rng.randint(1, 3))) for _ in range(rng.randint(8, 40))) for _ in range(n)]


def table(make, n=60, seed=0):
    rows = [(t, lang) for lang in STEMS for t in texts(lang, n, seed)]
    return make(*((i, t, lang, "", 0) for i, (t, lang) in enumerate(rows)))


def test_held_out_accuracy(make):
    model = li.learn(table(make))
    test = table(make, seed=9)
    found = {r.doc_id: r for r in li.predict(test, model).collect()}
    assert model.names == ["de", "en"]
    right = [found[r.doc_id].lang_pred == r.lang for r in test.collect()]
    assert np.mean(right) > 0.97 and all(0 <= r.score <= 1 for r in found.values())


def all_segmentations(word, p):
    if not word:
        return 1.0
    total = p.get(word[0], li.RARE) * all_segmentations(word[1:], p)
    return total + sum(p[word[:n]] * all_segmentations(word[n:], p) for n in range(2, len(word) + 1) if word[:n] in p)


@pytest.mark.parametrize("word", ["the", "in", "überall", "x", "日本", "thethethethe"])
def test_forward_sums_all_segmentations(word):
    import sentencepiece

    path = li.public_tokenizers.path(li.VOCABULARY)
    pieces = sentencepiece.SentencePieceProcessor(model_file=path)
    hashes, numbers, _ = li.pieces(path)
    rng = np.random.default_rng(3)
    table = np.r_[rng.dirichlet(np.ones(len(hashes)), 2).T, np.zeros((1, 2))]
    place = {int(h): int(n) for h, n in zip(hashes, numbers)}
    texts_ = {pieces.id_to_piece(i) for i in range(pieces.get_piece_size())}
    marked = li.START + word
    subs = {marked[a:b] for a in range(len(marked)) for b in range(a + 1, len(marked) + 1)}
    p = {s: table[place[li.text_hash(s)]] for s in subs if s in texts_ and li.text_hash(s) in place}
    for k in range(2):
        want = math.log(all_segmentations(marked, {s: x[k] for s, x in p.items()}))
        assert li.word_scores(path, table, [word])[0, k] == pytest.approx(want)


def test_long_words_do_not_underflow():
    path = li.public_tokenizers.path(li.VOCABULARY)
    n = len(li.pieces(path)[0])
    table = np.r_[np.full((n, 2), 1 / n), np.zeros((1, 2))]
    one, many = li.word_scores(path, table, ["qz" * 50, "qz" * 5000])
    assert np.isfinite(many).all() and (many < 50 * one).all()


def test_learning_raises_the_likelihood():
    path, words = li.public_tokenizers.path(li.VOCABULARY), "the then there in inner that".split()
    weights = np.ones(len(words))
    n = len(li.pieces(path)[0])
    flat = np.r_[np.full((n, 1), 1 / n), np.zeros((1, 1))]
    assert li.word_scores(path, li.learn_table(path, [(words, weights)]), words).sum() > li.word_scores(path, flat, words).sum() + 10


def test_odd_texts_empty_tables_and_clashing_columns(odd, none, clashing):
    model = li.learn(odd)
    rows = li.predict(odd, model).collect()
    assert len(rows) == odd.count()
    by_key = {r.doc_id: r for r in rows}
    assert all(by_key[i].lang_pred == "und" and by_key[i].score == 0 for i in (1000, 1001, 1002))
    assert li.predict(none, model).collect() == []
    assert {r.lang_pred for r in li.predict(odd, li.learn(none)).collect()} == {"und"}
    assert li.predict(clashing, li.learn(clashing)).count() == odd.count()


def test_sample_is_bounded(make):
    few = li.learn(table(make, 200), rows=10, words=15)
    assert few.names == ["de", "en"]


def test_words_without_blanks_are_learnt(make):
    """Two languages that write a clause as one word are told apart."""
    run = lambda lang, seed: [(t.replace(" ", ""), lang) for t in texts(lang, 60, seed)]
    rows = lambda seed: make(*((i, t, lang, "", 0) for i, (t, lang) in enumerate(run("en", seed) + run("de", seed))))
    test = rows(9)
    found = {r.doc_id: r.lang_pred for r in li.predict(test, li.learn(rows(0))).collect()}
    assert np.mean([found[r.doc_id] == r.lang for r in test.collect()]) > 0.95
