"""Quality rules: a threshold table compiled into one native projection.

Every measure is a built-in expression over one row (no Python, no shuffle);
``RULES`` names a measure, its smallest and its largest allowed value, and
``compile_rules`` turns the table into one boolean column.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tally.llm.common import bind, read

SPACE = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "[#*$%&|<>]"
WINDOW = 8

#: Frequent function words of the languages served, lower case (fixed values).
STOP_WORDS = (
    "the of and to in is it that was for on are as with be by this from at or an a "
    "der die und das den von zu mit ist ein eine auf für im nicht des auch es "
    "le la les de et un une des du en est pour que dans sur par au il elle qui ne pas "
    "el los las y del que un una por con para se no al es su lo en"
)


@dataclass(frozen=True)
class Rule:
    """A document is rejected if ``measure`` lies below ``least`` or above ``most``."""

    measure: str
    least: float | None = None
    most: float | None = None


#: Default thresholds; null measures (no words) break no rule, the base rule rejects those texts.
RULES = (
    Rule("n_words", least=20),
    Rule("mean_word_chars", least=2, most=16),
    Rule("symbols_per_word", most=0.1),
    Rule("stop_word_share", least=0.02),
    Rule("dup_line_share", most=0.5),
    Rule("same_word_share", most=0.3),
)


def _repeat_words(words: Column, window: int) -> Column:
    """Words inside ``window``-word runs that occur at least twice in the text.

    Runs are compared by 64-bit hash within one text.
    """
    runs = F.transform(F.sequence(F.lit(1), F.size(words) - (window - 1)), lambda i: F.xxhash64(F.slice(words, i, window)))

    def covered(h):
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        again = bind(placed, lambda s: F.filter(s, lambda x, k: (
            (F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False))) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)))))
        starts = F.sort_array(F.transform(again, lambda x: x["p"]))
        zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-window).alias("last"))
        return F.aggregate(starts, zero, lambda a, p: F.struct(
            (a["n"] + F.least(F.lit(window), p - a["last"])).alias("n"), p.alias("last")), lambda a: a["n"])

    # most texts have no repeated run: one hash set settles those
    seen = bind(runs, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0).cast("long")))
    return F.when(F.size(words) > window, seen).otherwise(F.lit(0).cast("long"))


def measures(docs: DataFrame, stop_words: str = STOP_WORDS, window: int = WINDOW) -> DataFrame:
    """``docs`` with the measures of its ``text`` in a struct column ``measures``.

    A null text counts as empty, a text of any length is measured whole.  All
    other columns pass through; a column of theirs called ``measures`` is replaced.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = F.array_remove(F.split(text, SPACE), "")
    stops = sorted({v for w in stop_words.split() for v in (w, w.capitalize())})
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.regexp_replace(x, SPACE, "")) > 0)

    def of(w: Column, ln: Column) -> Column:
        n, n_lines = F.size(w).cast("long"), F.size(ln).cast("long")
        chars = F.length(F.array_join(w, "")).cast("long")
        symbols = F.regexp_count(text, F.lit(SYMBOLS)).cast("long")
        dup = n_lines - F.size(F.array_distinct(ln))
        stop = F.size(F.filter(w, lambda x: x.isin(stops))).cast("long")
        pairs = F.size(F.filter(w, lambda x, i: F.coalesce(F.get(w, i - 1) == x, F.lit(False)))).cast("long")
        per_word = F.when(n > 0, n)
        return F.struct(
            n.alias("n_words"), chars.alias("word_chars"), symbols.alias("n_symbols"), dup.alias("n_dup_lines"),
            _repeat_words(w, window).alias("n_repeat_words"), n_lines.alias("n_lines"), stop.alias("n_stop_words"),
            (chars / per_word).alias("mean_word_chars"), (symbols / per_word).alias("symbols_per_word"),
            (stop / per_word).alias("stop_word_share"), (dup / F.when(n_lines > 0, n_lines)).alias("dup_line_share"),
            (pairs / per_word).alias("same_word_share"))

    # words and lines are bound in lambdas, so each is split once a row
    got = bind(words, lambda w: bind(lines, lambda ln: of(w, ln)))
    return docs.withColumn("measures", got)


def compile_rules(rules: tuple[Rule, ...] = RULES, of: str = "measures") -> Column:
    """One boolean column: no rule of the table is broken."""
    ok = F.lit(True)
    for r in rules:
        m = F.col(f"{of}.{r.measure}")
        if r.least is not None:
            ok = ok & F.coalesce(m >= r.least, F.lit(True))
        if r.most is not None:
            ok = ok & F.coalesce(m <= r.most, F.lit(True))
    return ok


def base_failed(of: str = "measures") -> Column:
    n, again = F.col(f"{of}.n_words"), F.col(f"{of}.n_repeat_words")
    return (n < 20) | (100 * again > 30 * n)


def quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` plus ``measures``, ``base_failed`` and ``kept`` (those names of its own are replaced).

    One row out per row in, whatever its ids; an empty table gives an empty
    result; null and empty texts have zero words and are rejected by the base rule.
    """
    return (measures(docs).withColumn("base_failed", base_failed())
            .withColumn("kept", ~F.col("base_failed") & compile_rules(rules)))


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` that pass, with its own columns only, whatever their names.

    Null and empty texts don't pass, ids may be null or repeat, repeated rows pass or
    fail alike, very long texts are measured whole, an empty table stays empty.
    """
    marked = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text"))
    return quality(marked, rules).where("kept").select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    got = quality(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc_id", "measures.n_words", "measures.word_chars", "measures.n_symbols", "measures.n_dup_lines",
                      "measures.n_repeat_words", "base_failed", "kept")


_STOPS = ", ".join(f"'{v}'" for v in sorted({v for w in STOP_WORDS.split() for v in (w, w.capitalize())}))

#: DuckDB SQL for ``query``.
SQL = f"""
WITH t AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT rid, doc_id, text,
         regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM t
), p AS (
  SELECT rid, unnest(range(1, len(words) - 6)) AS i, words FROM w WHERE len(words) >= 8
), g AS (
  SELECT rid, i, count(*) OVER (PARTITION BY rid, list_slice(words, i, i + 7)) AS n FROM p
), d AS (
  SELECT rid, i, lag(i) OVER (PARTITION BY rid ORDER BY i) AS last FROM g WHERE n > 1
), r AS (
  SELECT rid, sum(least(8, coalesce(i - last, 8))) AS n_repeat_words FROM d GROUP BY rid
), m AS (
  SELECT w.rid, doc_id, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
         len(lines) AS n_lines,
         len(list_filter(words, lambda x: x IN ({_STOPS}))) AS n_stop,
         len(list_filter(range(2, len(words) + 1), lambda i: words[i] = words[i - 1])) AS n_pairs
  FROM w LEFT JOIN r ON w.rid = r.rid
), b AS (
  SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed
       AND word_chars / n_words >= 2 AND word_chars / n_words <= 16
       AND n_symbols / n_words <= 0.1
       AND n_stop / n_words >= 0.02
       AND n_dup_lines / n_lines <= 0.5
       AND n_pairs / n_words <= 0.3 AS kept
FROM b
"""
