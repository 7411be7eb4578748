"""DuckDB SQL of queries whose results can be told in SQL without their methods."""

from __future__ import annotations

from tally.llm.licenses import TEMPLATES

#: Common table expression: the CRC-32 of each byte, before the last complement.
_CRC = """
bits AS (  -- CRC-32 of one byte, for each byte
    SELECT list(c ORDER BY b) AS crc_of FROM (
        SELECT b, list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c
        FROM (SELECT unnest(range(256)) AS b)))"""


def _crc32(value: str) -> str:
    """CRC-32 of a text's UTF-8 bytes; needs ``_CRC`` among the tables."""
    octets = f"list_transform(range(octet_length(encode({value}))), lambda k: ('0x' || substr(hex(encode({value})), 2 * k + 1, 2))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {octets}), lambda c, o: xor(c // 256, crc_of[1 + xor(c, o) % 256])), 4294967295::BIGINT)"


_TEMPLATES = ", ".join("('{}', '{}')".format(a, b.replace("'", "''")) for a, b in TEMPLATES)
_LETTERS = "[0-9a-z\\x{80}-\\x{10FFFF}]+"

#: op4: windows by the template shingles they hold (all templates have five words and more).
LICENSES = f"""
WITH templates AS (
    SELECT row_number() OVER () AS t, license, regexp_extract_all(lower(template), '{_LETTERS}') AS w FROM (VALUES {_TEMPLATES}) v(license, template)),
wanted AS (
    SELECT t, license, len(w) AS size, greatest(1, len(w) // 4) AS step, array_to_string(list_slice(w, i, i + 4), ' ') AS g
    FROM (SELECT *, unnest(range(1, len(w) - 3)) AS i FROM templates)),
shares AS (SELECT t, count(DISTINCT g) AS n FROM wanted GROUP BY t),
texts AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(lower(text), '{_LETTERS}') AS w FROM documents WHERE text IS NOT NULL),
words AS (SELECT rid, doc_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM texts),
fives AS (
    SELECT rid, doc_id, i, word || ' ' || lead(word, 1) OVER p || ' ' || lead(word, 2) OVER p || ' ' || lead(word, 3) OVER p || ' ' || lead(word, 4) OVER p AS g
    FROM words WINDOW p AS (PARTITION BY rid ORDER BY i)),
hits AS (SELECT DISTINCT rid, doc_id, i, t, license, size, step, g FROM fives JOIN wanted USING (g)),
held AS (  -- window k starts at word k * step and has size + step words
    SELECT *, unnest(range(greatest(0, ceil((i + 5 - size - step) / step))::BIGINT, i // step + 1)) AS k FROM hits),
windows AS (SELECT rid, doc_id, t, license, k, count(DISTINCT g) AS n, min(i) AS word_start FROM held GROUP BY ALL),
found AS (SELECT doc_id, license, windows.n / shares.n AS containment, word_start FROM windows JOIN shares USING (t))
SELECT doc_id, license, max(containment) AS containment, arg_max(word_start, (containment, -word_start)) AS word_start
FROM found WHERE containment >= 0.8 GROUP BY doc_id, license
"""

#: op5: the three count tables joined to the n-grams that end at each word.
BACKOFF = """
WITH texts AS (
    SELECT row_number() OVER () AS rid, doc_id,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
words AS (SELECT rid, unnest(w) AS word, unnest(range(len(w))) AS i FROM texts),
grams AS (
    SELECT rid, word, lag(word) OVER t AS before, lag(word) OVER t || ' ' || word AS two, lag(word, 2) OVER t || ' ' || lag(word) OVER t AS before_two,
           lag(word, 2) OVER t || ' ' || lag(word) OVER t || ' ' || word AS three
    FROM words WINDOW t AS (PARTITION BY rid ORDER BY i)),
ones AS (SELECT word, count(*) AS n FROM grams GROUP BY word),
twos AS (SELECT two, count(*) AS n FROM grams WHERE two IS NOT NULL GROUP BY two),
threes AS (SELECT three, count(*) AS n FROM grams WHERE three IS NOT NULL GROUP BY three),
total AS (SELECT count(*) AS n FROM words),
scored AS (
    SELECT rid, CASE
        WHEN c.n >= 2 THEN log10(c.n / c_of.n)
        WHEN b.n >= 2 THEN log10(b.n / b_of.n) + CASE WHEN c.n IS NULL THEN 0 ELSE log10(0.4::DOUBLE) END
        ELSE log10(a.n / total.n) + CASE WHEN b.n IS NULL THEN 0 WHEN c.n IS NULL THEN log10(0.4::DOUBLE) ELSE 2 * log10(0.4::DOUBLE) END END AS s
    FROM grams g JOIN ones a ON g.word = a.word LEFT JOIN ones b_of ON g.before = b_of.word
    LEFT JOIN twos b ON g.two = b.two LEFT JOIN twos c_of ON g.before_two = c_of.two LEFT JOIN threes c ON g.three = c.three, total),
sums AS (SELECT rid, fsum(s) AS score FROM scored GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, round(coalesce(score, 0), 6) AS log10_score, round(score / len(w), 6) AS log10_per_word
FROM texts LEFT JOIN sums USING (rid)
"""

#: op8: every string of 200 bytes as two hex digits a byte, those found twice, and what they cover.
SUFFIX_DEDUP = """
WITH texts AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
parts AS (  -- 200 starts each, so that no string is looked up far into a text
    SELECT rid, k, substr(x, 400 * k + 1, 798) AS part FROM (SELECT rid, x, unnest(range((length(x) // 2) // 200)) AS k FROM texts)),
starts AS (
    SELECT rid, 200 * k + j AS i, md5(substr(part, 2 * j + 1, 400)) AS s
    FROM (SELECT rid, k, part, unnest(range(length(part) // 2 - 199)) AS j FROM parts)),
again AS (SELECT rid, i FROM starts SEMI JOIN (SELECT s FROM starts GROUP BY s HAVING count(*) > 1) USING (s)),
marked AS (SELECT rid, i, CASE WHEN i - lag(i) OVER t <= 200 THEN 0 ELSE 1 END AS new FROM again WINDOW t AS (PARTITION BY rid ORDER BY i)),
spans AS (
    SELECT rid, span, min(i) AS lo, max(i) + 200 AS hi FROM (SELECT rid, i, sum(new) OVER (PARTITION BY rid ORDER BY i) AS span FROM marked)
    GROUP BY rid, span),
pieces AS (  -- what is left before each span
    SELECT rid, lo, hi, coalesce(lag(hi) OVER (PARTITION BY rid ORDER BY lo), 0) AS since FROM spans),
cut AS (
    SELECT rid, count(*) AS n_spans, sum(hi - lo)::BIGINT AS n_removed, max(hi) AS last,
           string_agg(substr(x, 2 * since + 1, 2 * (lo - since)), '' ORDER BY lo) AS before
    FROM pieces JOIN texts USING (rid) GROUP BY rid)
SELECT doc_id, length(x) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(before, '') || substr(x, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM texts LEFT JOIN cut USING (rid)
"""

#: op12: equal words at a distance, in stretches of six and more.
RUNS = f"""
WITH {_CRC},
texts AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
hashed AS (SELECT rid, doc_id, w, len(w) AS n, CASE WHEN doc_id IS NOT NULL THEN {_crc32('doc_id::VARCHAR')} END AS h FROM texts, bits),
changed AS (
    SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN (h // 10) % n END AS a,
           CASE WHEN h % 10 = 0 AND n > 0 THEN 1 + (n - (h // 10) % n) // (3 + (h // 10) % 8) END AS p FROM hashed),
placed AS (SELECT rid, a, p, unnest(w) AS word, unnest(range(n)) AS i FROM changed),
docs AS (
    SELECT x.rid, x.i, y.word FROM placed x JOIN placed y ON x.rid = y.rid AND y.i = CASE WHEN x.a IS NULL OR x.i < x.a THEN x.i ELSE x.a + (x.i - x.a) % x.p END),
six AS (  -- a run of period q has at least six words that are found again q words on
    SELECT * FROM (
        SELECT rid, i, word || ' ' || lead(word, 1) OVER t || ' ' || lead(word, 2) OVER t || ' ' || lead(word, 3) OVER t || ' '
                       || lead(word, 4) OVER t || ' ' || lead(word, 5) OVER t AS g
        FROM docs WINDOW t AS (PARTITION BY rid ORDER BY i)) WHERE g IS NOT NULL),
pairs AS (SELECT a.rid, a.i, b.i - a.i AS q FROM six a JOIN six b ON a.rid = b.rid AND a.g = b.g AND a.i < b.i),
stretches AS (
    SELECT rid, q, min(i) AS start, max(i) - min(i) + 6 + q AS length FROM (
        SELECT *, i - row_number() OVER (PARTITION BY rid, q ORDER BY i) AS s FROM pairs)
    GROUP BY rid, q, s HAVING max(i) - min(i) + 6 + q >= greatest(12, 2 * q)),
runs AS (  -- of the periods of one stretch the smallest
    SELECT rid, start, length, q AS period FROM stretches x WHERE NOT EXISTS (
        FROM stretches y WHERE y.rid = x.rid AND y.q < x.q AND y.start <= x.start AND y.start + y.length >= x.start + x.length)),
lists AS (
    SELECT rid, count(*) AS n_runs, arg_max({{'s': start, 'l': length, 'p': period}}, (length, -start, -period)) AS top,
           string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM runs GROUP BY rid),
gone AS (SELECT DISTINCT rid, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (
    SELECT k.rid, string_agg(word, ' ' ORDER BY k.i) AS collapsed
    FROM docs k ANTI JOIN gone USING (rid, i) GROUP BY k.rid)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, top.s AS start, top.l AS length, top.p AS period, 1000 * top.l // top.p AS exponent_milli,
       sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(collapsed, '')) AS collapsed_sha256
FROM texts LEFT JOIN lists USING (rid) LEFT JOIN kept USING (rid)
"""

#: op13: words that agree without one code point.
SPELLING = f"""
WITH RECURSIVE {_CRC},
found AS (
    SELECT coalesce(doc_id::VARCHAR, '') || ':' || run AS named, run, count(*) AS times FROM (
        SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                 '[a-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents)
    WHERE length(run) >= 7 GROUP BY ALL),
hashed AS (SELECT run, times, {_crc32('named')} AS h FROM found, bits),
words AS (
    SELECT word, sum(times)::BIGINT AS n FROM (
        SELECT times, CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed)
    WHERE length(word) >= 7 GROUP BY word HAVING sum(times) >= 2),
cut AS (  -- every word without one of its code points
    SELECT word, n, pos, substr(word, 1, pos - 1) || substr(word, pos + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS pos FROM words)),
near AS (
    SELECT a.word, b.word AS other, b.n AS other_n FROM cut a JOIN cut b ON a.rest = b.rest AND a.pos = b.pos AND a.word <> b.word
    UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
    UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word),
best AS (
    SELECT word, count(*) AS n_near, arg_min(other, (-other_n, other)) AS other, max(other_n) AS other_n FROM near GROUP BY word),
forms AS (
    SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 10 * n THEN other END AS form, CASE WHEN other_n >= 10 * n THEN other_n END AS form_n
    FROM words w LEFT JOIN best b ON w.word = b.word),
path AS (
    SELECT word, word AS pos FROM forms UNION ALL SELECT p.word, f.form FROM path p JOIN forms f ON p.pos = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.form, p.pos AS root, f.n, f.n_near, f.form_n
FROM forms f JOIN path p ON f.word = p.word JOIN forms l ON p.pos = l.word WHERE l.form IS NULL
"""
