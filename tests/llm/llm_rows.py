"""Rows for the tests of the training-data operators."""

import random
import re

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Extra columns whose names clash with those that operators use inside.
CLASHES = (
    "quality", "key", "text_key", "set_key", "size", "target", "words", "spans", "rules", "_key", "_text", "_cell", "_guest",
    "row_no", "turn", "slot", "pretokens", "block", "fingerprint", "sketch", "class_id", "n_links", "held_out", "score", "url", "copies",
)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def make_text(random_, n, vocabulary=400):
    """Sentences of pronounceable words, lines now and then."""
    out = []
    for i in range(n):
        r = random.Random(random_.randrange(vocabulary))
        word = "".join(r.choice("bdfglmnprst") + r.choice("aeiou") for _ in range(r.randint(1, 4)))
        out.append(word + (".\n" if i % 40 == 39 else "." if i % 11 == 10 else ""))
    return " ".join(out).replace("\n ", "\n").rstrip() + "."


def plain_rows(n=60, seed=1):
    rng = random.Random(seed)
    return [(i, make_text(rng, rng.randint(55, 300), 3000), ("en", "de")[i % 2], f"s{i % 3}", 0) for i in range(n)]


ODD = [
    (1000, None, "en", "s0", 0), (1001, "", None, None, 0), (1002, " \t\r\n ", "de", "", 1), (1003, "word", "en", "s1", 4),
    (1004, "a b c d", None, "s1", 7), (1005, "\x1cleft\x1f right here there  ", "en", None, 3),
    (1006, "x<|endoftext|>y <|endoftext|> <|endoftext|>", "en", "s2", 9), (1007, "日本語 のテキスト。 Ünḯcode 😀 ÀÉ", "de", "s2", 9),
    (1008, make_text(random.Random(7), 20000), "en", "s0", 9), (1008, make_text(random.Random(7), 20000), "en", "s0", 9),
    (None, "no key at all here", "en", "s0", 2), (None, "no key at all here", "en", "s0", 2), (1009, "y" * 5000, None, "s1", 5000),
    (1003, "other text under a key used twice", "en", "s1", 4), (1010, "same same same\nsame same same\n\nsame", "en", "s1", 5),
]
