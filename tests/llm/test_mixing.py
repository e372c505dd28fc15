from collections import Counter

import pytest
from llm_rows import words_of

from obslab.llm import mixing
from obslab.llm.common import stored


def taken(df):
    return mixing.taken_words(mixing.mix(stored(mixing.sized_documents(df), "mixing"))).collect()


def plain_targets(sizes):
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        left = total - sum(fixed.values())
        free = {s: left * weight[s] / sum(w for t, w in weight.items() if t not in fixed) for s in sizes if s not in fixed}
        over = [s for s, x in free.items() if x > 3 * sizes[s]]
        if not over:
            return fixed | free
        fixed |= {s: 3.0 * sizes[s] for s in over}


def check(rows, source):
    sizes, got = Counter(), Counter()
    for _, text, _, s, _ in source:
        sizes[s] += len(words_of(text))
    want = plain_targets(sizes)
    assert len(rows) == len(source)
    assert sorted((r.doc_id or 0, r.size) for r in rows) == sorted((i or 0, len(words_of(t))) for i, t, *_ in source)
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and 0 <= r.taken <= 3 * r.size
        got[r.source] += r.taken
    for s in sizes:
        assert abs(got[s] - want[s]) <= max(5, 0.02 * want[s])


def test_targets_are_met(odd, odd_rows):
    check(taken(odd), odd_rows)


def test_small_sources_stop_at_three_times_their_size(make):
    source = [(i, "a b c d e " * 50, "", "big", 0) for i in range(40)] + [(100, "a b c", "", "small", 0), (101, "a " * 30, "", None, 0)]
    check(taken(make(*source)), source)


def test_many_window_parts_and_reruns_agree(make, monkeypatch):
    monkeypatch.setattr(mixing, "WINDOW_ROWS", 4)
    source = [(i, "w " * (i % 17), "", f"s{i % 4}", 0) for i in range(120)]
    first = taken(make(*source))
    check(first, source)
    again = taken(make(*source[::-1]).repartition(5))
    assert {r.doc_id: r.taken for r in first} == {r.doc_id: r.taken for r in again}


def test_schedule_keeps_every_stretch_near_the_weights(shipped):
    shares = [mixing.Share("a", 600, 100.0), mixing.Share("b", 600, 300.0), mixing.Share(None, 600, 200.0)]
    rows = mixing.schedule(shipped, shares, 1).orderBy("slot").collect()
    assert [r.slot for r in rows] == list(range(600))
    for n in (30, 100, 333, 600):
        count = Counter(r.source_no for r in rows[:n])
        assert all(abs(count[i] - n * s.target / 600) < 4 for i, s in enumerate(shares))
    for i in range(3):
        assert [r.turn for r in rows if r.source_no == i] == list(range(sum(r.source_no == i for r in rows)))


def test_empty_table_texts_without_words_and_clashing_columns(none, clashing, make, odd_rows):
    assert taken(none) == []
    assert [r.taken for r in taken(make((1, None, "", "a", 0), (2, " ", "", None, 0)))] == [0, 0]
    check(taken(clashing), odd_rows)
