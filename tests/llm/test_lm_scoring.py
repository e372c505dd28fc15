import math
import pathlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from obslab.llm import lm_scoring as lm
from obslab.llm.common import remainder
from obslab.llm.shared_arrays import local_path
from obslab.llm.word_batches import slices, words_of_batch


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + ["\n"]


class Plain:
    """The same model in plain Python."""

    def __init__(self, texts):
        streams = [tokens(t) for t in texts]
        self.count = Counter(w for s in streams for w in s)
        self.pairs = Counter(p for s in streams for p in zip(["<s>", *s], s))
        self.after, self.follows = defaultdict(list), Counter(b for _, b in self.pairs)
        for (a, _), n in self.pairs.items():
            self.after[a].append(n)
        self.d2, self.d1 = (lm.discounts([list(c.values()).count(k) for k in (1, 2, 3, 4)]) for c in (self.pairs, self.follows))

    def probability(self, a, b):
        v = len(self.count)
        p = 1 / (v + 1)
        if self.pairs:
            left = sum(self.d1[min(n, 3)] for n in self.follows.values()) / len(self.pairs)
            p = (self.follows[b] - self.d1[min(self.follows[b], 3)]) / len(self.pairs) + left * p
        if a in self.after:
            total, c = sum(self.after[a]), self.pairs.get((a, b), 0)
            p = (c - self.d2[min(c, 3)]) / total + sum(self.d2[min(n, 3)] for n in self.after[a]) / total * p
        return p

    def scores(self, text):
        s, n, v = tokens(text), sum(self.count.values()), len(self.count)
        base = sum(math.log10((self.count[w] + 1) / (n + v + 1)) for w in s)
        return len(s), sum(self.count[w] > 0 for w in s), n, base, sum(math.log10(self.probability(a, b)) for a, b in zip(["<s>", *s], s))


def check(rows, source, training):
    model = Plain([t for _, t, *_ in training])
    got = sorted((r.doc_id or 0, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in rows)
    want = sorted((i or 0, *model.scores(t)) for i, t, *_ in source)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:4] == w[:4] and g[4:] == pytest.approx(w[4:], rel=1e-9)


def held(df):
    return {r.doc_id for r in df.where(remainder("doc_id", 7) == 2).collect()}


def test_scores_equal_plain_python(odd, odd_rows):
    out = held(odd)
    assert out
    check(lm.train_and_score(odd, remainder("doc_id", 7) == 2).collect(), odd_rows, [r for r in odd_rows if r[0] not in out])


def test_counts_beyond_16_bits(make):
    source = [(1, "a b " * 40_000 + "c", "", "", 0), (2, "a b " * 40_000 + "b a a", "", "", 0), (3, "a c b", "", "", 0)]
    check(lm.train_and_score(make(*source), F.lit(False)).collect(), source, source)


def test_probabilities_sum_to_one():
    model = Plain(["a b c a b", "b c d", "a a a b"])
    for context in ("a", "b", "<s>", "never seen"):
        assert sum(model.probability(context, w) for w in [*model.count, "unknown word"]) == pytest.approx(1)


def test_the_model_beats_the_base(make):
    table = make(*((i, " ".join(f"w{(i * 7 + k) % 300}" for k in range(60 + i)), "", "", 0) for i in range(120)))
    r = lm.train_and_score(table, remainder("doc_id", 7) == 2).where(remainder("doc_id", 7) == 2).agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert r.s > r.b


def test_no_training_rows_empty_table_and_clashing_columns(odd, none, clashing, odd_rows):
    check(lm.train_and_score(odd, F.lit(True)).collect(), odd_rows, [])
    assert lm.train_and_score(none, F.lit(False)).collect() == []
    check(lm.train_and_score(clashing, F.lit(False)).collect(), odd_rows, odd_rows)


class PlainTrigrams(Plain):
    """Order 3 in plain Python: trigrams counted, pairs by the number of their first words."""

    def __init__(self, texts):
        super().__init__(texts)
        streams = [tokens(t) for t in texts]
        self.triples = Counter(p for s in streams for p in zip(["<s>", "<s>", *s], ["<s>", *s], s))
        self.pairs = Counter(p[1:] for p in self.triples)
        self.after, self.after_two = defaultdict(list), defaultdict(list)
        for (a, _), n in self.pairs.items():
            self.after[a].append(n)
        for (a, b, _), n in self.triples.items():
            self.after_two[a, b].append(n)
        self.d2, self.d3 = (lm.discounts([list(c.values()).count(k) for k in (1, 2, 3, 4)]) for c in (self.pairs, self.triples))

    def third(self, a, b, c):
        p = self.probability(b, c)
        if (a, b) in self.after_two:
            total, n = sum(self.after_two[a, b]), self.triples.get((a, b, c), 0)
            p = (n - self.d3[min(n, 3)]) / total + sum(self.d3[min(n, 3)] for n in self.after_two[a, b]) / total * p
        return p

    def scores(self, text):
        s = tokens(text)
        return *super().scores(text)[:4], sum(math.log10(self.third(*p)) for p in zip(["<s>", "<s>", *s], ["<s>", *s], s))


def check_trigrams(rows, source, training):
    model = PlainTrigrams([t for _, t, *_ in training])
    got = sorted((r.doc_id or 0, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in rows)
    want = sorted((i or 0, *model.scores(t)) for i, t, *_ in source)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:4] == w[:4] and g[4:] == pytest.approx(w[4:], rel=1e-9)


def test_trigram_scores_equal_plain_python(odd, none, odd_rows, monkeypatch):
    out = held(odd)
    check_trigrams(lm.train_and_score(odd, remainder("doc_id", 7) == 2, order=3).collect(), odd_rows, [r for r in odd_rows if r[0] not in out])
    check_trigrams(lm.train_and_score(odd, F.lit(True), order=3).collect(), odd_rows, [])
    assert lm.train_and_score(none, F.lit(False), order=3).collect() == []
    model = PlainTrigrams(["a b c a b", "b c d", "a a a b"])
    for context in (("a", "b"), ("<s>", "<s>"), ("<s>", "a"), ("never", "a"), ("never", "seen")):
        assert sum(model.third(*context, w) for w in [*model.count, "unknown word"]) == pytest.approx(1)
    with pytest.raises(ValueError, match="order"):
        lm.train(none, order=4)


def test_trigram_counts_beyond_16_bits(make):
    source = [(1, "a b " * 80_000 + "c", "", "", 0), (2, "a b " * 40_000 + "b a a", "", "", 0), (3, "a c b", "", "", 0)]
    check_trigrams(lm.train_and_score(make(*source), F.lit(False), order=3).collect(), source, source)


def test_a_trigram_model_takes_few_bytes(make):
    """Files of the model: a rare trigram and its pair took about 54 bytes beside 44 for a word."""
    rng = random.Random(3)
    table = make(*((i, " ".join(f"w{rng.randrange(3000)}" for _ in range(400)), "", "", 0) for i in range(200)))
    model = lm.train(table, order=3)
    size = sum(f.stat().st_size for f in pathlib.Path(local_path(model.path)).iterdir())
    trigrams = sum(m[0] for m in model.trigrams)
    assert trigrams > 60_000 and size < 26 * trigrams + 40 * model.vocabulary


def test_packed_cells_and_mixed_contexts_come_back():
    rng = np.random.default_rng(4)
    values = np.sort(rng.integers(0, 2**64, 1000, dtype=np.uint64))
    assert (lm.joined([lm.packed(values, True), lm.packed(values[:3], True)], "<u8", True) == np.r_[values, values[:3]]).all()
    assert (lm.joined([lm.packed(values.astype("<u4"))], "<u4") == values.astype("<u4")).all() and len(lm.joined([], "<u4")) == 0
    for n, bits in ((1, 4), (1, 9), (900, 4), (2**31, 12)):
        model = lm.Model("", bits, [n])
        first, second = (rng.integers(0, n + 2, 500, dtype=np.uint64) for _ in range(2))
        mixed = lm.mixed_contexts(model, first << np.uint64(32) | second)
        assert (lm.second_words(model, mixed) == second).all() and lm.trigram_shards(model, mixed).max() < 1 << bits
        own = np.unique(mixed[lm.trigram_shards(model, mixed) == 0])
        starts, rest = lm.step_arrays(model, own)
        at, hit = lm.find_contexts(model, starts, rest, own)
        assert hit.all() and (at == np.arange(len(own))).all()


def test_long_and_short_runs_of_trigrams(make):
    """Contexts with one, few and many words after them, seen once, often and more often than a byte counts."""
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abcdefgh") + str(int(rng.paretovariate(0.6)) % 40) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    texts += ["x y " * 300 + "z"] + [f"x y n{i}" for i in range(40)]
    source = [(i, t, "", "", 0) for i, t in enumerate(texts)]
    table = make(*source)
    out = held(table)
    check_trigrams(lm.train_and_score(table, remainder("doc_id", 7) == 2, order=3).collect(), source, [r for r in source if r[0] not in out])


def test_the_query_scores_by_two_words_before(make, monkeypatch):
    from obslab.llm import catalog

    source = [(i, f"x{i % 2} y z{i % 2}", "", "", 0) for i in range(40)] + [(100, "x0 y z1", "", "", 0)]
    monkeypatch.setattr(catalog, "documents", lambda *a: make(*source))
    rows = {r.doc_id: r.score for r in catalog.op9_kneser_ney(make(*source).sparkSession, "").collect()}
    assert rows[0] > rows[100] + 0.5


def test_words_of_slices_are_those_of_the_texts():
    texts = [f"Ñandú {i} Wörter É{i % 9}" for i in range(200)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    found = [words_of_batch(part.column(0), lower=True) for part in slices(batch, 0, 500)]
    assert len(found) > 5 and [f.distinct[c].as_py() for f in found for c in f.codes] == [w for t in texts for w in tokens(t)[:-1]]
