"""Secret scan with a trigram index.

Each rule's regular expression gives a Boolean query over trigrams that every match must hold (lower case; after R. Cox,
Regular expression matching with a trigram index). The index has a posting (trigram, document) for each trigram that some
query names. Postings are intersected by document; what a rule's query admits is verified with the expression itself. Rules
whose query admits everything (no mandatory trigram) scan all documents.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import product
from operator import and_, or_

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obslab.llm.common import text_of

#: Literal strings that a part of an expression is spelled out to at most; beyond, its trigrams so far are kept.
SPELLED = 64


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` are kept if the group ``judged`` has ``least`` characters. ``base`` rules are counted."""

    kind: str
    pattern: str
    least: int = 0
    judged: int = 0
    base: bool = False

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII)


# The base rules of the contract, then public formats of well-known tokens.
RULES = (
    Rule("assign", r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 6, 2, True),
    Rule("access", r"AKIA[A-Z0-9]+", 20, 0, True),
    Rule("hex", r"[0-9a-f]+", 24, 0, True),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("url_login", r"[a-z][a-z0-9+.-]*://[^\s/:@]+:[^\s/@]+@[^\s/]+"),
)

# A query is True, a trigram, or (and_ or or_, queries).


def all_of(queries: list) -> object:
    parts = list(dict.fromkeys(q for q in queries if q is not True))
    return True if not parts else parts[0] if len(parts) == 1 else (and_, tuple(parts))


def any_of(queries: list) -> object:
    parts = list(dict.fromkeys(queries))
    return True if True in parts or not parts else parts[0] if len(parts) == 1 else (or_, tuple(parts))


def spelled(texts: set[str]) -> object:
    """Query of a text that holds one of ``texts``."""
    return any_of([all_of([t[i : i + 3] for i in range(len(t) - 2)]) for t in sorted(texts)])


def trigram_query(pattern: str) -> object:
    """Trigrams, lower case, that a text must hold for the expression to match in it; True if there are none."""
    from re import _constants as op
    from re import _parser

    def folded(code: int) -> str:
        return chr(code).lower()

    def of_set(items) -> set[str] | None:
        out = set()
        for kind, value in items:
            if kind is op.LITERAL:
                out.add(folded(value))
            elif kind is op.RANGE and value[1] - value[0] < 4:
                out |= {folded(c) for c in range(value[0], value[1] + 1)}
            else:
                return None
        return out if len(out) <= 6 else None

    def of_item(kind, value) -> tuple[set[str] | None, object]:
        """All texts that the item can be, if they are few; else what it must hold."""
        if kind is op.LITERAL:
            return {folded(value)}, True
        if kind is op.IN:
            return of_set(value), True
        if kind is op.SUBPATTERN:
            return of_sequence(value[-1])
        if kind is op.BRANCH:
            parts = [of_sequence(p) for p in value[1]]
            if all(texts is not None for texts, _ in parts):
                return set().union(*(texts for texts, _ in parts)), True
            return None, any_of([spelled(texts) if texts is not None else q for texts, q in parts])
        if kind in (op.MAX_REPEAT, op.MIN_REPEAT):
            low, high, inner = value
            texts, query = of_sequence(inner)
            if texts is not None and (low, high) == (0, 1):
                return texts | {""}, True
            if texts is not None and low == high == 1:
                return texts, True
            if low == 0:
                return None, True
            return None, query if texts is None else spelled({"".join(t) for t in product(sorted(texts), repeat=min(low, 3))} if len(texts) <= 4 else texts)
        if kind is op.AT:
            return {""}, True
        return None, True

    def of_sequence(items) -> tuple[set[str] | None, object]:
        texts, queries, whole = {""}, [], True
        for kind, value in items:
            more, query = of_item(kind, value)
            if more is None or len(texts) * len(more) > SPELLED:
                queries += [spelled(texts), query]
                texts, whole = (more if more is not None else {""}), False
            else:
                texts = {a + b for a in texts for b in more}
        return (texts, True) if whole else (None, all_of([*queries, spelled(texts)]))

    texts, query = of_sequence(_parser.parse(pattern))
    return spelled(texts) if texts is not None else query


def trigrams_of(query: object) -> set[str]:
    return set() if query is True else {query} if isinstance(query, str) else set().union(*map(trigrams_of, query[1]))


def postings(df: DataFrame, trigrams: list[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """The index: (trigram, key) for each of the trigrams and each row whose text holds it, in either case."""
    folded = df.select(key, F.lower(text_of(text)).alias("_low"))
    held = F.filter(F.array(*map(F.lit, trigrams)), lambda t: F.contains(F.col("_low"), t))
    return folded.select(F.explode(held).alias("trigram"), key)


def candidates(index: DataFrame, rules: tuple[Rule, ...], key: str = "doc_id") -> DataFrame:
    """(key, rules): the numbers of the rules whose trigram query the row's postings meet, for rows that meet any."""
    queries = {i: q for i, r in enumerate(rules) if (q := trigram_query(r.pattern)) is not True}
    names = sorted(set().union(*map(trigrams_of, queries.values()))) if queries else []
    bit = {t: i for i, t in enumerate(names)}
    words = -(-len(names) // 63)

    def met(query: object) -> Column:
        if isinstance(query, str):
            return F.col(f"_m{bit[query] // 63}").bitwiseAND(F.lit(1 << bit[query] % 63)) != 0
        return reduce(query[0], map(met, query[1]))

    number = F.element_at(F.create_map(*(x for t in names for x in (F.lit(t), F.lit(bit[t])))), F.col("trigram"))
    numbered = index.select(key, number.alias("_bit"))
    masks = [F.expr(f"bit_or(if(_bit div 63 = {w}, shiftleft(1L, _bit % 63), 0L))").alias(f"_m{w}") for w in range(words)]
    admitted = F.array_compact(F.array(*(F.when(met(q), F.lit(i)) for i, q in queries.items())))
    return numbered.groupBy(key).agg(*masks).select(F.col(key).alias("_key"), admitted.alias("rules")).where(F.size("rules") > 0)


def spans_of(rule: Rule, pattern: re.Pattern, text: str) -> list[tuple[int, int]]:
    return [m.span() for m in pattern.finditer(text) if m.end(rule.judged) - m.start(rule.judged) >= rule.least]


def verify(rules: tuple[Rule, ...], kind: pa.DataType, key: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    patterns = [r.compiled() for r in rules]
    free = [i for i, r in enumerate(rules) if trigram_query(r.pattern) is True]
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            todo: list[list[int]] = [list(x or ()) for x in batch.column(2).to_pylist()]
            for i in free:  # Arrow's scan of every text, with the rule's length where the whole match is judged
                own = rules[i]
                least = re.sub(r"\+$", f"{{{own.least},}}", own.pattern) if own.least and not own.judged else own.pattern
                for row in pc.indices_nonzero(pc.fill_null(pc.match_substring_regex(texts, least), False)).to_pylist():
                    todo[row].append(i)
            found = []
            for row, which in enumerate(todo):
                text = texts[row].as_py() if which else ""
                spans = [(s, i, e) for i in which for s, e in spans_of(rules[i], patterns[i], text)]
                found.append([{"kind": rules[i].kind, "start": s, "end": e} for s, i, e in sorted(spans)])
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(kind), texts.cast(pa.string()), pa.array(found, span)], names=[key, "_text", "spans"])

    return run


def scan(df: DataFrame, rules: tuple[Rule, ...] = RULES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, _text, spans) of every row: spans of all rules by start, then rule; code points, end exclusive.

    A rule's spans are leftmost and do not overlap; those of different rules may. Null text counts as empty. Rows that
    repeat a key are each verified for what any of them admits.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    names = sorted(set().union(*(trigrams_of(trigram_query(r.pattern)) for r in rules)))
    field = df.schema[key].dataType
    texts = df.select(key, text_of(text).alias("_text"))
    if names:
        found = candidates(postings(df, names, key, text), rules, key).hint("shuffle_hash")
        texts = texts.join(found, texts[key].eqNullSafe(found["_key"]), "left").select(key, "_text", "rules")
    else:
        texts = texts.withColumn("rules", F.array().cast("array<int>"))
    run = verify(rules, to_arrow_type(field), key)
    return texts.mapInArrow(run, f"`{key}` {field.simpleString()}, _text string, spans array<struct<kind:string,start:bigint,end:bigint>>")


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")


def report(df: DataFrame, rules: tuple[Rule, ...] = RULES, key: str = "doc_id") -> DataFrame:
    """(key, n_<kind> of the base rules, base_sha256, spans) of every row."""
    base = [r.kind for r in rules if r.base]
    found = scan(df, rules, key).drop("_text")
    kinds = F.transform("spans", lambda s: s.kind)
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("bigint").alias(f"n_{k}") for k in base]
    own = F.filter("spans", lambda s: s.kind.isin(base))
    return found.select(key, *counts, F.sha2(joined(own), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def redacted(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """``text`` with ``mark`` in place of each span; spans that overlap make one."""

    def add(done: Column, s: Column) -> Column:
        fresh = s.start >= done.at
        more = F.concat(done.out, F.substring(text, (done.at + 1).cast("int"), (s.start - done.at).cast("int")), F.lit(mark))
        return F.struct(F.greatest(done.at, s.end).alias("at"), F.when(fresh, more).otherwise(done.out).alias("out"))

    def close(done: Column) -> Column:
        return F.concat(done.out, F.substring(text, (done.at + 1).cast("int"), F.length(text)))

    begin = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))
    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(spans, begin, add, close))
