import hashlib
import random
import re

import pytest

from obslab.llm import secret_scan as ss

KINDS = ("assign", "access", "hex")
PATTERNS = (
    (r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6), (r"AKIA[A-Z0-9]+", 0, 20), (r"[0-9a-f]+", 0, 24),
)


def base_spans(text):
    out = []
    for k, (pattern, group, least) in enumerate(PATTERNS):
        out += [(m.start(), k, m.end()) for m in re.finditer(pattern, text or "", re.A) if len(m[group]) >= least]
    return [(KINDS[k], s, e) for s, k, e in sorted(out)]


def digest(spans):
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()


def secrets(n, seed=4):
    rng, rows = random.Random(seed), []
    for i in range(n):
        parts = [rng.choice([
            "plain words here", "ToKen = \"abc\"", f"api_key: {rng.randrange(16**8):x}zz", f"APIKEY='{rng.randrange(16**12):012x}'", "AKIA" + "Z9" * rng.randint(5, 12),
            f"{rng.randrange(16**30):030x}", "passwd=", "Password : hunter2hunter", "ſecret=abcdefgh", "toKen=abcdefgh", "ghp_" + "a1" * 20, "é" * 5,
            "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0In0.abc-_1", "https://user:pw@host/x", "-----BEGIN RSA PRIVATE KEY-----",
        ]) for _ in range(rng.randint(0, 12))]
        rows.append((i, rng.choice([" ", "", "\n"]).join(parts), "en", "s", 0))
    return rows


def test_base_spans_equal_plain_python(make, odd, odd_rows):
    source = secrets(200)
    rows = {r.doc_id: r for r in ss.report(make(*source).repartition(3)).collect()}
    for i, text, *_ in source:
        spans, r = base_spans(text), rows[i]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == kind for k, *_ in spans) for kind in KINDS)
        assert r.base_sha256 == digest(spans)
        for part in filter(None, r.spans.split(",")):
            kind, start, end = part.split(":")
            rule = next(x for x in ss.RULES if x.kind == kind)
            assert rule.compiled().fullmatch(text[int(start) : int(end)])
        assert [p for p in r.spans.split(",") if p.split(":")[0] in KINDS] == [f"{k}:{s}:{e}" for k, s, e in spans]
    assert sorted(r.base_sha256 for r in ss.report(odd).collect()) == sorted(digest(base_spans(t)) for _, t, *_ in odd_rows)


@pytest.mark.parametrize("rule", ss.RULES, ids=lambda r: r.kind)
def test_no_match_escapes_its_trigram_query(rule):
    query = ss.trigram_query(rule.pattern)

    def holds(q, text):
        return True if q is True else q in text if isinstance(q, str) else (all if q[0] is ss.and_ else any)(holds(p, text) for p in q[1])

    for _, text, *_ in secrets(300, 9):
        if rule.compiled().search(text):
            assert holds(query, text.lower())
    assert (query is True) == (rule.kind == "hex")


def test_queries_of_small_expressions():
    assert ss.trigram_query("abcd") == (ss.and_, ("abc", "bcd"))
    assert ss.trigram_query("abc.*xyz") == (ss.and_, ("abc", "xyz"))
    assert ss.trigram_query("abc|xyz") == (ss.or_, ("abc", "xyz"))
    assert ss.trigram_query("(abc)?x") is True and ss.trigram_query("ab+") is True and ss.trigram_query("a[bc]d") == (ss.or_, ("abd", "acd"))
    assert ss.trigram_query("[a-z]+") is True and ss.trigram_query("(?:foo|ba)r+") is True


def test_redaction(make):
    rows = ss.scan(make((1, "é token=abcdefgh end AKIA" + "A" * 20, "", "", 0), (2, "x token=" + "a1" * 15 + " y", "", "", 0), (3, None, "", "", 0)))
    out = {r.doc_id: r.out for r in rows.select("doc_id", ss.redacted(rows["_text"], rows["spans"], "*").alias("out")).collect()}
    assert out == {1: "é * end *", 2: "x * y", 3: ""}


def test_empty_table_and_clashing_columns(none, clashing, make):
    assert ss.report(none).collect() == []
    assert ss.report(clashing).count() == clashing.count()
    free = tuple(r for r in ss.RULES if r.kind == "hex")
    assert ss.report(make((1, "a" * 30, "", "", 0)), free).first().spans == "hex:0:30"
