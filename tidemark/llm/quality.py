"""Quality rules as a bitmask ledger: each rule is evaluated once, policies read the bits.

``ledger`` leaves one row per input row: the measurements and ``failure_bits``, in which bit k
is set when rule k fails.  ``apply_policy`` keeps the rows that fail none of the rules of a
version's mask; ``ablations`` tells, from the counts per bit pattern alone, what each version
loses by each of its rules.  Nothing is shuffled by ``ledger`` and ``apply_policy``;
``ablations`` aggregates at most 2**len(RULES) patterns on the map side first.

Defined cases: a null or empty text has no words and fails ``few_words``; repeated rows give
repeated rows; an empty table gives an empty ledger; columns of the input other than ``text``
are carried by name and do not clash, as measurements live in one struct until selected.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.text import SPACE_CLASS, WORD, where_made

SYMBOLS = "[#*$%&|<>]"
WINDOW_WORDS = 3

MEASURES = ("n_words", "word_chars", "n_symbols", "n_upper", "n_lines", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """``fails`` is an SQL condition over the measurements, in whole numbers."""

    name: str
    fails: str


#: In bit order; a rule is only ever appended, so that stored bits keep their meaning.
RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", "100 * n_symbols > 15 * n_words"),
    Rule("upper_case", "100 * n_upper > 20 * word_chars"),
    Rule("repeated_lines", "100 * n_dup_lines > 50 * n_lines"),
    Rule("word_length", "word_chars < 2 * n_words OR word_chars > 25 * n_words"),
)

#: Version to the names of the rules that reject.
POLICIES = {
    "base": ("few_words", "repeated_words"),
    "v1": ("few_words", "repeated_words", "symbols", "upper_case"),
    "v2": tuple(r.name for r in RULES),
}
CURRENT = "v2"


def mask(version: str) -> int:
    """The bits of the rules of a policy version."""
    return sum(1 << k for k, r in enumerate(RULES) if r.name in POLICIES[version])


def _repeat_words(hashes: Column) -> Column:
    """Words covered by windows whose hash stands twice or more in ``hashes``."""
    numbered = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))

    def twice(sorted_pairs: Column) -> Column:
        return F.filter(
            sorted_pairs,
            lambda p, i: (F.get(sorted_pairs, i - 1)["h"] == p["h"]) | (F.get(sorted_pairs, i + 1)["h"] == p["h"]),
        )

    found = F.transform(F.array(F.array_sort(numbered)), twice)[0]
    places = F.array_sort(F.transform(found, lambda p: p["i"]))
    start = F.struct(F.lit(-WINDOW_WORDS).alias("at"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate(
        places,
        start,
        lambda acc, p: F.struct(p.alias("at"), (acc["n"] + F.least(F.lit(WINDOW_WORDS), p - acc["at"])).alias("n")),
        lambda acc: acc["n"],
    )
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(covered)


def _window_hashes(words: Column) -> Column:
    hashed = F.transform(words, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))
    return F.slice(hashed, F.lit(1), F.greatest(F.size(words) - (WINDOW_WORDS - 1), F.lit(0)))


def measured(docs: DataFrame, into: str = "measures") -> DataFrame:
    """``docs`` with one more column, the struct ``into`` of all measurements."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # Each step is a projection of its own: its arrays are read many times and must be made once.
    step = docs.withColumn(
        into,
        F.struct(
            F.filter(F.split(text, f"[{SPACE_CLASS}]+"), lambda w: w != "").alias("words"),
            F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE_CLASS}]")).alias("lines"),
            F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
            F.regexp_count(text, F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
            F.char_length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        ),
    )
    m = F.col(into)
    step = step.withColumn(into, F.struct(m["words"].alias("words"), m["lines"].alias("lines"),
                                          m["n_symbols"].alias("n_symbols"), m["n_upper"].alias("n_upper"),
                                          m["word_chars"].alias("word_chars"),
                                          _window_hashes(m["words"]).alias("windows")))
    size = lambda c: F.size(c).cast("long")
    values = {
        "n_words": size(m["words"]),
        "word_chars": m["word_chars"],
        "n_symbols": m["n_symbols"],
        "n_upper": m["n_upper"],
        "n_lines": size(m["lines"]),
        "n_dup_lines": size(m["lines"]) - size(F.array_distinct(m["lines"])),
        "n_repeat_words": _repeat_words(m["windows"]),
    }
    return step.withColumn(into, F.struct(*[values[k].alias(k) for k in MEASURES]))


def ledger(docs: DataFrame, into: str = "ledger") -> DataFrame:
    """``docs`` with the struct ``into``: all measurements and ``failure_bits``."""
    df = measured(docs, into)
    m = F.col(into)
    bits = F.lit(0).cast("long")
    for k, rule in enumerate(RULES):
        bits = bits.bitwiseOR(F.when(_condition(rule, into), F.lit(1 << k)).otherwise(F.lit(0)).cast("long"))
    return df.withColumn(into, F.struct(*[m[k].alias(k) for k in MEASURES], bits.alias("failure_bits")))


def _condition(rule: Rule, struct: str) -> Column:
    statement = " ".join(f"`{struct}`.`{t}`" if t in MEASURES else t for t in rule.fails.split())
    return F.expr(statement)


def passes(bits: Column, version: str = CURRENT) -> Column:
    return bits.bitwiseAND(F.lit(mask(version)).cast("long")) == 0


def apply_policy(docs: DataFrame, version: str = CURRENT) -> DataFrame:
    """The rows of ``docs`` that a policy keeps, with the columns of ``docs``."""
    name = "__ledger"
    while name in docs.columns:
        name += "_"
    kept = where_made(ledger(docs, name), passes(F.col(name)["failure_bits"], version))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def ablations(entries: DataFrame, bits: str = "failure_bits") -> DataFrame:
    """Per version and rule: rows that fail it, rows that only it rejects, and rows kept without it."""
    patterns = entries.groupBy(F.col(bits).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    parts = F.array(*[
        F.struct(F.lit(v).alias("version"), F.lit(r.name).alias("rule"),
                 F.lit(1 << k).cast("long").alias("bit"), F.lit(mask(v)).cast("long").alias("mask"))
        for v, names in POLICIES.items() for k, r in enumerate(RULES) if r.name in names
    ])
    each = patterns.select("bits", "n", F.explode(parts).alias("p")).select("bits", "n", "p.*")
    hit = F.col("bits").bitwiseAND(F.col("bit")) != 0
    rest = F.col("bits").bitwiseAND(F.col("mask")).bitwiseAND(F.bitwise_not(F.col("bit")))
    total = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0)).cast("long")
    return each.groupBy("version", "rule").agg(
        total(hit).alias("n_failed"),
        total(hit & (rest == 0)).alias("n_sole"),
        total(rest == 0).alias("n_kept_without"),
    )


# --- the query -------------------------------------------------------------------------------


def quality_rules(spark, sf_dir: str) -> DataFrame:
    from tidemark.llm.text import doc_rows, documents

    rows = ledger(doc_rows(documents(spark, sf_dir)))
    bits = F.col("ledger")["failure_bits"]
    return rows.select(
        "doc_id",
        *[F.col("ledger")[k].alias(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        (~passes(bits, "base")).alias("base_failed"),
        passes(bits).alias("kept"),
        F.col("ledger")["n_upper"].alias("n_upper"),
        F.col("ledger")["n_lines"].alias("n_lines"),
        bits.alias("failure_bits"),
    )


_BITS = " + ".join(f"CASE WHEN {r.fails} THEN {1 << k} ELSE 0 END" for k, r in enumerate(RULES))

SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, regexp_extract_all(text, '{WORD}') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS lines FROM d),
win AS (SELECT rid, i, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c
        FROM w, unnest(generate_series(1, len(words) - 2)) AS t(i)),
again AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM win) WHERE n > 1),
rep AS (SELECT rid, count(DISTINCT i + k) AS n FROM again, (VALUES (0), (1), (2)) AS s(k) GROUP BY rid),
m AS (SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words,
             CAST(length(regexp_replace(text, '[{SPACE_CLASS}]', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(text) - length(regexp_replace(text, '{SYMBOLS}', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(length(text) - length(regexp_replace(text, '\\p{{Lu}}', '', 'g')) AS BIGINT) AS n_upper,
             CAST(len(lines) AS BIGINT) AS n_lines,
             CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
      FROM d JOIN w USING (rid) LEFT JOIN rep USING (rid)),
b AS (SELECT *, CAST({_BITS} AS BIGINT) AS failure_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (failure_bits & {mask("base")}) <> 0 AS base_failed, (failure_bits & {mask(CURRENT)}) = 0 AS kept,
       n_upper, n_lines, failure_bits
FROM b
"""
