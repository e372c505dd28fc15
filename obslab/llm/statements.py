"""SQL (DuckDB) that states the same rows as those numbered queries that SQL can express."""

from __future__ import annotations

from obslab.llm.collocations import COVERED, LEAST, MOST_WORDS, SCALE, TOP
from obslab.llm.decontamination import WINDOW
from obslab.llm.mixing import GOLDEN, MOST_PASSES
from obslab.llm.near_join import SHINGLE, THRESHOLD
from obslab.llm.prefix_trie import HEADS, MODULUS
from obslab.llm.quality_rules import BLANKS, ENDINGS, MARKS, PHRASES, SEPARATORS, SYMBOLS, UNFINISHED, LineRules

_WORD = r"[^\x20\x09-\x0D]+"
_RULES = LineRules()


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _count(column: str, pattern: str) -> str:
    return f"len(regexp_extract_all({column}, {_text(pattern)}))"


_PHRASES = " + ".join(f"(length(lower(line)) - length(replace(lower(line), {_text(p)}, ''))) // {len(p)}" for p in PHRASES)
_BLANKS = " || ".join(f"chr({ord(c)})" for c in BLANKS)

OP1 = f"""
    WITH d AS (
      SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents
    ), windows AS (
      SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS k FROM d, unnest(range(1, len(w) - 1)) AS u(i)
    ), repeated AS (
      SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1
    ), covered AS (
      SELECT doc_id, count(DISTINCT i + j) AS n FROM repeated, (VALUES (0), (1), (2)) AS v(j) GROUP BY doc_id
    ), lines AS (
      SELECT doc_id, line, {_count('line', _WORD)} AS n
      FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '{_WORD}')
    ), judged AS (
      SELECT doc_id, line, phrases > 0 AND phrases * {_RULES.words_per_phrase} >= n OR {_count('line', SEPARATORS)} > {_RULES.separators_per_word} * n
             OR {_count('line', MARKS)} > {_RULES.marks_per_word} * n
             OR n >= {_RULES.ending_from_words} AND (NOT regexp_matches(last, {_text(ENDINGS)}) OR regexp_matches(last, {_text(UNFINISHED)})) AS failed
      FROM (SELECT *, {_PHRASES} AS phrases, right(rtrim(line, {_BLANKS}), 1) AS last FROM lines)
    ), lost AS (
      SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines,
             coalesce(sum(length(line)) FILTER (WHERE failed), 0)::DOUBLE / sum(length(line)) AS lost
      FROM judged GROUP BY doc_id
    ), counted AS (
      SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
             {_count('t', SYMBOLS.rstrip('+'))}::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
             coalesce(n, 0)::BIGINT AS n_repeat_words, coalesce(lost, 0) AS lost
      FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN lost USING (doc_id)
    )
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
           NOT base_failed AND lost <= {_RULES.most_lost} AS kept
    FROM (SELECT *, n_words < {_RULES.least_words} OR 100 * n_repeat_words > {_RULES.most_repeat_percent} * n_words AS base_failed
          FROM counted)
"""

_RUN = " || ' ' || ".join(f"w[i + {k}]" for k in range(SHINGLE))

OP3 = f"""
    WITH RECURSIVE texts AS (
      SELECT text, min(doc_id) AS node, regexp_extract_all(text, '{_WORD}') AS w FROM documents WHERE text IS NOT NULL GROUP BY text
    ), shingles AS (
      SELECT DISTINCT node, {_RUN} AS s FROM texts, unnest(range(1, len(w) - {SHINGLE - 2})) AS u(i) WHERE len(w) >= {SHINGLE}
      UNION ALL SELECT node, array_to_string(w, ' ') FROM texts WHERE len(w) BETWEEN 1 AND {SHINGLE - 1}
    ), sizes AS (
      SELECT node, count(*) AS n FROM shingles GROUP BY node
    ), common AS (
      SELECT a.node AS a, b.node AS b, count(*) AS k FROM shingles a JOIN shingles b USING (s) WHERE a.node < b.node GROUP BY ALL
    ), links AS (
      SELECT a, b FROM common JOIN sizes x ON x.node = a JOIN sizes y ON y.node = b WHERE k::DOUBLE / (x.n + y.n - k) >= {THRESHOLD}
    ), both_ways AS (
      SELECT a, b FROM links UNION ALL SELECT b, a FROM links
    ), reached(node, root) AS (
      SELECT node, node FROM texts UNION SELECT b, root FROM reached JOIN both_ways ON a = reached.node
    ), classes AS (
      SELECT node, min(root) AS class_id FROM reached GROUP BY node
    ), degrees AS (
      SELECT a AS node, count(*) AS n FROM both_ways GROUP BY a
    )
    SELECT doc_id, coalesce(class_id, doc_id) AS class_id, coalesce(n, 0)::BIGINT AS n_links
    FROM documents LEFT JOIN texts USING (text) LEFT JOIN classes USING (node) LEFT JOIN degrees USING (node)
"""

# The sources whose targets stop are those with the least size for their weight; the first k of them do if the share of the
# next one, when the k are out, is no more than its limit.
OP6 = f"""
    WITH docs AS (
      SELECT doc_id, source, {_count("coalesce(text, '')", _WORD)}::BIGINT AS size FROM documents
    ), sources AS (
      SELECT source, sum(size)::BIGINT AS s FROM docs GROUP BY source
    ), weighted AS (
      SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS no FROM sources
    ), ranked AS (
      SELECT *, (no % 3 + 1)::DOUBLE AS w, sum(s) OVER ()::DOUBLE AS total,
             row_number() OVER (ORDER BY s / (no % 3 + 1), no) AS r FROM weighted
    ), sums AS (
      SELECT *, total - coalesce(sum({MOST_PASSES} * s) OVER (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS rest,
             sum(w) OVER (ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight FROM ranked
    ), level AS (
      SELECT r, rest, weight FROM sums WHERE rest * w / weight <= {MOST_PASSES} * s ORDER BY r LIMIT 1
    ), targets AS (
      SELECT no, source, s, CASE WHEN sums.r < level.r THEN ({MOST_PASSES} * s)::DOUBLE ELSE level.rest * w / level.weight END AS target
      FROM sums, level
    ), shares AS (
      SELECT *, sum(target) OVER (ORDER BY no) / sum(target) OVER () AS upto, sum(target) OVER () AS whole,
             greatest(1, least(4096, floor((min(target) FILTER (WHERE target >= 1) OVER ()) / 1024)))::BIGINT AS block FROM targets
    ), slots AS (
      SELECT x.n, u - floor(u) AS point FROM (SELECT n, (n + 0.5::DOUBLE) * {GOLDEN!r}::DOUBLE AS u
        FROM (SELECT unnest(range(ceil(round(any_value(whole), 6) / any_value(block))::BIGINT)) AS n FROM shares)) x
    ), dealt AS (
      SELECT (SELECT count(*) FROM shares WHERE upto <= point AND no < (SELECT max(no) FROM shares)) AS no, count(*) AS turns FROM slots GROUP BY 1
    ), ends AS (
      SELECT shares.*, least(coalesce(turns, 0) * block, round(target)::BIGINT) AS stop FROM shares LEFT JOIN dealt USING (no)
    ), placed AS (
      SELECT docs.*, s, target, stop, coalesce(sum(size) OVER (
               PARTITION BY no ORDER BY md5('mix:' || coalesce(doc_id::VARCHAR, '')), size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a
      FROM docs JOIN ends ON docs.source IS NOT DISTINCT FROM ends.source
    )
    SELECT doc_id, size, s AS source_size, target,
           (greatest(0, least(a + size, stop) - a) + greatest(0, least(s + a + size, stop) - s - a)
            + greatest(0, least(2 * s + a + size, stop) - 2 * s - a))::BIGINT AS taken
    FROM placed
"""

# The checksum of a number's decimal digits, byte by byte and bit by bit.
_BITS = "list_reduce([xor(c, b)] || [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384::UBIGINT * (x & 1)))"
_CRC = f"xor(list_reduce([4294967295::UBIGINT] || list_transform(string_split(conv_id::VARCHAR, ''), lambda d: ascii(d)::UBIGINT), lambda c, b: {_BITS}), 4294967295::UBIGINT)"

OP11 = f"""
    WITH own AS (
      SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS turns
      FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
    ), checked AS (
      SELECT *, ({_CRC} % {HEADS})::BIGINT AS h, conv_id - conv_id % {MODULUS} AS base FROM own
    ), whole AS (
      SELECT c.conv_id, list_concat(coalesce(b.turns, [])[:c.h], c.turns[c.h + 1:]) AS path
      FROM checked c LEFT JOIN own b ON b.conv_id = c.base
    ), prefixes AS (
      SELECT conv_id, d, path[:d] AS node, d = len(path) AS ends FROM whole, unnest(range(len(path) + 1)) AS u(d)
    ), nodes AS (
      SELECT node, d, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '') AS ids
      FROM prefixes GROUP BY node, d
    ), kids AS (
      SELECT node[:d - 1] AS node, d - 1 AS d, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1, 2
    ), linked AS (
      SELECT nodes.*, coalesce(n_children, 0) AS n_children, CASE WHEN d > 0 THEN (n_convs - 1) * strlen(node[d].text) ELSE 0 END AS gain
      FROM nodes LEFT JOIN kids USING (node, d)
    ), subtrees AS (
      SELECT node[:u.up] AS node, u.up AS d, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(gain)::BIGINT AS saved_tokens
      FROM linked, unnest(range(d + 1)) AS u(up) GROUP BY 1, 2
    )
    SELECT l.conv_id, l.d AS depth, p.conv_id AS parent_conv_id, l.n_convs, l.n_children, n_leaves, saved_tokens, sha256(l.ids) AS ends_sha256
    FROM linked l JOIN subtrees USING (node, d) LEFT JOIN nodes p ON p.d = l.d - 1 AND p.node = l.node[:l.d - 1]
"""

_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP12 = f"""
    WITH pieces AS (
      SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWERED}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents
    ), worded AS (
      SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces
    ), totals AS (
      SELECT lang, sum(len(w))::BIGINT AS n FROM worded GROUP BY lang
    ), f AS (
      SELECT lang, w[i + 1:i + size] AS p, count(*) AS a
      FROM worded, range(1, {MOST_WORDS + 1}) AS s(size), unnest(range(len(w) - size + 1)) AS u(i) GROUP BY ALL HAVING count(*) >= {LEAST}
    ), cuts AS (
      SELECT x.lang, x.p, x.a, k, l.a AS l, r.a AS r, (({SCALE}::HUGEINT * x.a) // (l.a + r.a)::HUGEINT)::BIGINT AS score
      FROM f x, unnest(range(1, len(x.p))) AS u(k) JOIN f l ON l.lang = x.lang AND l.p = x.p[:k] JOIN f r ON r.lang = x.lang AND r.p = x.p[k + 1:]
    ), best AS (
      SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1
    ), longest AS (
      SELECT lang, p[i + 1:i + size] AS p, max(a) AS longer
      FROM f, range(2, {MOST_WORDS}) AS s(size), unnest(range(len(p) - size + 1)) AS u(i) WHERE size < len(p) GROUP BY ALL
    ), ranked AS (
      SELECT b.*, array_to_string(b.p, ' ') AS phrase FROM best b LEFT JOIN longest g ON g.lang = b.lang AND g.p = b.p
      WHERE longer IS NULL OR 100::HUGEINT * longer < {COVERED}::HUGEINT * b.a
    )
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
    FROM ranked JOIN totals USING (lang) QUALIFY rank <= {TOP}
"""

_PLAIN = f"regexp_extract_all({_LOWERED}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP13 = f"""
    WITH d AS (
      SELECT doc_id, row_number() OVER () AS row, {_PLAIN} AS w FROM documents
    ), i AS (
      SELECT coalesce(item_id::VARCHAR, '') AS item, {_PLAIN} AS w FROM benchmark
    ), item_windows AS (
      SELECT DISTINCT item, least(len(w), {WINDOW}) AS n, array_to_string(w[s + 1:s + {WINDOW}], ' ') AS win
      FROM i, unnest(range(greatest(len(w) - {WINDOW}, 0) + 1)) AS u(s) WHERE len(w) > 0
    ), sizes AS (
      SELECT DISTINCT n FROM item_windows
    ), windows AS (
      SELECT row, s, n, array_to_string(w[s + 1:s + n], ' ') AS win FROM d, sizes, unnest(range(len(w) - n + 1)) AS u(s)
    ), met AS (
      SELECT row, s, n, item FROM windows JOIN item_windows USING (n, win)
    ), hit AS (
      SELECT row, count(DISTINCT s + j) AS n_hit FROM met, unnest(range(n)) AS v(j) GROUP BY row
    ), named AS (
      SELECT row, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT row, item FROM met) GROUP BY row
    )
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
           sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
    FROM d LEFT JOIN hit USING (row) LEFT JOIN named USING (row)
"""

SQL = {
    "op1_quality_rules": OP1, "op3_chosen_path_join": OP3, "op6_mixing": OP6, "op11_prefix_trie": OP11, "op12_collocations": OP12,
    "op13_decontamination": OP13,
}
