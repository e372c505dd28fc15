import re
from collections import Counter

from llm_rows import words_of

from obslab.llm.quality_rules import LineRules, quality_rules

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def plain(text):
    text = text or ""
    words = words_of(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if words_of(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def judged(df, **more):
    return quality_rules(df, **more).select("text", "quality.*").collect()


def test_base_counts_equal_plain_python(odd):
    rows = judged(odd)
    assert len(rows) == odd.count()
    for r in rows:
        assert tuple(r[c] for c in BASE) == plain(r.text)
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_lines_fail_by_rule(make):
    good = "\n".join(" ".join(f"word{i}x{k}" for k in range(12)) + "." for i in range(8))
    bad = ["home | news | sport | shop | more | login", "We use cookies to make this page work well for all.", "word### more*** again$$$ and&&& so%%% on### it*** goes$$$"]
    rows = {r.doc_id: r for r in quality_rules(make((1, good, "", "", 0), (2, "\n".join([good, *bad]), "", "", 0), (3, "\n".join(bad * 9), "", "", 0))).collect()}
    assert rows[1].quality.faults == [] and rows[1].quality.kept and rows[1].quality.clean_text == good
    assert rows[2].quality.faults == ["navigation", "boilerplate", "punctuation"] and rows[2].quality.clean_text == good
    assert rows[2].quality.kept and not rows[3].quality.kept and rows[3].quality.lost == 1


def test_limits_are_parameters(make):
    text = " ".join(f"w{i}" for i in range(20)) + "."
    assert not judged(make((1, text, "", "", 0)))[0].kept
    assert judged(make((1, text, "", "", 0)), rules=LineRules(least_words=5))[0].kept


def test_empty_table_and_clashing_columns(none, clashing):
    assert judged(none) == []
    out = quality_rules(clashing)
    assert out.columns == clashing.columns and out.count() == clashing.count()


def test_windows_line_ends_change_nothing(make):
    text = "\n".join(" ".join(f"word{i}x{k}" for k in range(12)) + "." for i in range(8))
    rows = judged(make((1, text, "", "", 0), (2, text.replace("\n", "\t\r\n") + " \r", "", "", 0)))
    assert [r.faults for r in rows] == [[], []] and all(r.kept for r in rows)


def test_a_phrase_does_not_fail_a_long_line(make):
    line = " ".join(f"Sentence {i} has words number {i} of its own." for i in range(30))
    rows = judged(make((1, line + " To read more about it, ask.", "", "", 0), (2, "Read more. Click here!", "", "", 0)))
    assert {r.text: r.faults for r in rows} == {line + " To read more about it, ask.": [], "Read more. Click here!": ["boilerplate"]}


def test_sentence_marks_of_other_scripts(make):
    words = " ".join(f"w{i}" for i in range(10))
    good, bad = "।۔؟。」)”“»", "#*•a|"
    rows = judged(make(*((i, words + c, "", "", 0) for i, c in enumerate(good + bad))))
    assert {r.text[-1] for r in rows if not r.faults} == set(good)
