"""Personal data: patterns with exact offsets, and terms that disclose what the patterns protect.

All of it is DataFrame and SQL functions.  A pattern's places come from splitting a text by it:
the lengths of the gaps and of the matches add up to offsets in code points.

Protected entities are the matched values.  A line that holds one is its context.  For a term t
and an entity e, with counts of documents over the whole corpus,
PMI(t; e) = ln(n(t, e) N / (n(t) n(e))) says how much t tells about e, and IC(e) = ln(N / n(e))
how much there is to tell.  Where PMI reaches ``share`` of IC and at least ``support`` different
lines hold both, t discloses e: in the contexts of e it is reported as kind ``term``, and
``sanitise`` replaces it.  Only entities of at least ``support`` different lines can have such
terms, so that the corpus-wide counts n(t) are taken for few terms; these are broadcast when
there are at most ``broadcast_terms`` of them and joined by a shuffle otherwise.

Defined cases: a null text is empty and has no spans; equal rows give equal rows; an empty table
gives no rows; rows of one id with different texts are kept apart by a hash of the text; extra
columns are ignored.  Very many matches in one text are added up in chunks.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.text import doc_rows, documents, where_made
from tidemark.session import cut_lineage

# The base kinds in the order of listing, and their patterns.  Repetitions are
# possessive where nothing that follows could take a character back, and a run is tried from its
# first character or from the end of the match before, as a later start finds nothing else; the
# matches are the same, and the matcher needs no stack and one pass for long runs.
KINDS = ("email", "ip", "card", "phone", "term")
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be tried at all.
_HINTS: dict[str, Callable[[Column], Column]] = {
    "email": lambda t: t.contains("@"),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9][\x20-]?[0-9]"),
    "phone": lambda t: t.contains("+"),
}


@dataclass(frozen=True)
class PiiParams:
    support: int = 3
    share: float = 0.9
    broadcast_terms: int = 20_000


DEFAULT = PiiParams()
CHUNK = 256

#: Terms are runs of letters and digits of any length.
NOT_TERM = r"[^\p{L}\p{N}]+"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once."""
    return F.transform(F.array(value), use)[0]


def _running(parts: Column) -> Column:
    """Parts (g: gap, l: length, v) as (s, e, v): a fold over each chunk, then one over the chunks."""
    place = "struct<s:int,e:int,v:string>"
    empty = F.from_json(F.lit("[]"), f"array<{place}>")

    def inside(chunk: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), empty.alias("out"))
        return F.aggregate(
            chunk,
            start,
            lambda acc, z: F.struct(
                (acc["at"] + z["g"] + z["l"]).alias("at"),
                F.concat(acc["out"], F.array(F.struct(
                    (acc["at"] + z["g"]).alias("s"), (acc["at"] + z["g"] + z["l"]).alias("e"), z["v"].alias("v")
                ))).alias("out"),
            ),
        )

    def shifted(chunks: Column) -> Column:
        ends = F.aggregate(
            chunks,
            F.array(F.lit(0)),
            lambda acc, c: F.concat(acc, F.array(F.element_at(acc, -1) + c["at"])),
        )
        return bound(ends, lambda from_: F.flatten(F.transform(
            chunks,
            lambda c, i: F.transform(c["out"], lambda z: F.struct(
                (z["s"] + F.get(from_, i)).alias("s"), (z["e"] + F.get(from_, i)).alias("e"), z["v"].alias("v")
            )),
        )))

    cut = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / CHUNK).cast("int")),
        lambda c: inside(F.slice(parts, c * CHUNK + 1, F.lit(CHUNK))),
    )
    return F.when(F.size(parts) > 0, bound(cut, shifted)).otherwise(empty)


def matches(text: Column, pattern: Column) -> Column:
    """All leftmost matches as array of (s, e, v): code points, end exclusive, and the match."""

    def measured(found: Column) -> Column:
        gaps = F.split(text, pattern, -1)
        return bound(gaps, lambda g: F.transform(found, lambda m, i: F.struct(
            F.char_length(F.get(g, i)).alias("g"), F.char_length(m).alias("l"), m.alias("v")
        )))

    return bound(bound(F.regexp_extract_all(text, pattern, F.lit(0)), measured), _running)


def _luhn(digits: Column) -> Column:
    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, F.char_length(digits) + 1 - i, F.lit(1)).cast("int")
        twice = d * 2
        return acc + F.when(i % 2 == 1, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.sequence(F.lit(1), F.char_length(digits)), F.lit(0), add) % 10 == 0


def _holds(kind: str, m: Column) -> Column:
    """Whether a match counts."""
    if kind == "ip":
        def small(part: Column) -> Column:
            bare = F.ltrim(part, F.lit("0"))
            return (F.char_length(bare) < 4) & (F.coalesce(bare.try_cast("int"), F.lit(0)) <= 255)

        return F.forall(F.split(m, r"\."), small)
    if kind == "card":
        digits = F.regexp_replace(m, r"[\x20-]", "")
        return F.when(F.char_length(digits).between(14, 19), bound(digits, _luhn)).otherwise(False)
    if kind == "phone":
        return F.char_length(F.regexp_replace(m, "[^0-9]", "")).between(10, 15)
    return F.lit(True)


_SPAN = "array<struct<s:int,kind:int,e:int,v:string>>"


def _of_kind(text: Column, kind: str) -> Column:
    number = KINDS.index(kind)
    found = F.transform(
        F.filter(matches(text, F.lit(PATTERNS[kind])), lambda z: _holds(kind, z["v"])),
        lambda z: F.struct(z["s"].alias("s"), F.lit(number).alias("kind"), z["e"].alias("e"), z["v"].alias("v")),
    )
    return F.when(_HINTS[kind](text), found).otherwise(F.from_json(F.lit("[]"), _SPAN))


def base_spans(text: Column) -> Column:
    """Array of (s, kind, e, v) of all base kinds, by start, then kind."""
    return F.array_sort(F.concat(*[_of_kind(text, k) for k in KINDS[:4]]))


def joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda z: F.concat_ws(":", F.get(names, z["kind"]), z["s"], z["e"])), ",")


def _keyed(docs: DataFrame) -> DataFrame:
    rows = doc_rows(docs).withColumn("text", F.coalesce("text", F.lit("")))
    return rows.withColumn("text_hash", F.xxhash64("text")).withColumn("spans", base_spans(F.col("text")))


def contexts(keyed: DataFrame, p: PiiParams = DEFAULT) -> DataFrame:
    """One row per line with spans: its place in the text, the line, its values and its terms."""
    rows = where_made(keyed, F.size("spans") > 0)
    starts = F.concat(F.array(F.lit(0)), F.transform(matches(F.col("text"), F.lit("\n")), lambda z: z["e"]))
    lines = rows.withColumn("starts", starts).withColumn("lines", F.split("text", "\n", -1))
    each = lines.select("doc_id", "text_hash", "spans", "starts", F.posexplode("lines").alias("i", "line"))
    each = each.withColumn("at", F.get("starts", F.col("i")))
    here = F.filter("spans", lambda z: (z["s"] >= F.col("at")) & (z["s"] < F.col("at") + F.char_length("line")))
    each = where_made(each.withColumn("here", here), F.size("here") > 0)
    values = F.array_distinct(F.transform("here", lambda z: F.concat_ws(":", z["kind"], z["v"])))
    words = F.filter(F.split(F.lower("line"), NOT_TERM), lambda t: t != "")
    each = each.select("doc_id", "text_hash", "at", "line", "here", values.alias("values"), F.array_distinct(words).alias("terms"))
    own = lambda t: F.exists("values", lambda v: F.contains(F.lower(v), t))
    return each.withColumn("terms", F.filter("terms", lambda t: ~own(t))).withColumn("line_hash", F.xxhash64("line"))


def disclosing_terms(docs: DataFrame, found: DataFrame, p: PiiParams = DEFAULT) -> DataFrame | None:
    """entity, term, pmi, ic of the terms over the threshold; None when no entity has the support."""
    seen = found.select("doc_id", "text_hash", "line_hash", "terms", F.explode("values").alias("entity"))
    spread = seen.groupBy("entity").agg(
        F.countDistinct("line_hash").alias("lines"), F.countDistinct("doc_id", "text_hash").alias("n_e")
    ).where(F.col("lines") >= p.support)
    pairs = seen.join(spread.select("entity", "n_e"), "entity")
    pairs = pairs.select("entity", "n_e", "doc_id", "text_hash", "line_hash", F.explode("terms").alias("term"))
    pairs = pairs.groupBy("entity", "n_e", "term").agg(
        F.countDistinct("line_hash").alias("lines"), F.countDistinct("doc_id", "text_hash").alias("n_te")
    ).where(F.col("lines") >= p.support)
    # PMI cannot reach its bar for a term of more than n(t, e) (N / n(e)) ** (1 - share) documents;
    # a count over the contexts alone already rules the frequent words out.
    total = float(docs.count())
    around = found.select("doc_id", "text_hash", F.explode("terms").alias("term")).groupBy("term").agg(
        F.countDistinct("doc_id", "text_hash").alias("n_around")
    )
    most = F.col("n_te") * F.pow(F.lit(total) / F.col("n_e"), F.lit(1 - p.share))
    pairs = pairs.join(around, "term").where(F.col("n_around") <= most)
    pairs = cut_lineage(pairs.select("entity", "n_e", "term", "n_te"))
    terms = pairs.select("term").distinct()
    n_terms = terms.count()
    if not n_terms:
        return None
    words = doc_rows(docs).select(F.explode(F.array_distinct(F.split(F.lower("text"), NOT_TERM))).alias("term"))
    counts = words.join(F.broadcast(terms) if n_terms <= p.broadcast_terms else terms, "term").groupBy("term").agg(
        F.count(F.lit(1)).alias("n_t")
    )
    pmi = F.log(F.col("n_te") * F.lit(total) / (F.col("n_t") * F.col("n_e")))
    told = pairs.join(counts, "term").select("entity", "term", pmi.alias("pmi"), F.log(F.lit(total) / F.col("n_e")).alias("ic"))
    return told.where((F.col("ic") > 0) & (F.col("pmi") >= p.share * F.col("ic")))


def term_spans(found: DataFrame, told: DataFrame) -> DataFrame:
    """doc_id, text_hash, more: the spans of disclosing terms in the contexts of their entities."""
    lines = found.select("doc_id", "text_hash", "at", "line", "here", "terms", F.explode("values").alias("entity"))
    asked = lines.select("doc_id", "text_hash", "at", "entity", F.explode("terms").alias("term")).join(told.select("entity", "term"), ["entity", "term"])
    per_line = asked.groupBy("doc_id", "text_hash", "at").agg(F.sort_array(F.collect_set("term")).alias("told"))
    rows = found.select("doc_id", "text_hash", "at", "line", "here").distinct().join(per_line, ["doc_id", "text_hash", "at"])
    rows = rows.withColumn("pattern", F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}])(?:"), F.array_join("told", "|"), F.lit(r")(?![\p{L}\p{N}])")))
    rows = rows.withColumn("spots", matches(F.col("line"), F.col("pattern")))
    free = lambda z: ~F.exists("here", lambda h: (h["s"] < F.col("at") + z["e"]) & (h["e"] > F.col("at") + z["s"]))
    spot = F.transform(F.filter("spots", free), lambda z: F.struct(
        (F.col("at") + z["s"]).alias("s"), F.lit(4).alias("kind"), (F.col("at") + z["e"]).alias("e"), z["v"].alias("v")
    ))
    return rows.select("doc_id", "text_hash", spot.alias("spot")).groupBy("doc_id", "text_hash").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("spot")))).alias("more")
    )


def find_pii(docs: DataFrame, p: PiiParams = DEFAULT) -> DataFrame:
    """doc_id, text_hash, spans (base), all_spans (with terms) for every row of ``docs``."""
    keyed = _keyed(docs)
    found = cut_lineage(contexts(keyed, p))
    told = disclosing_terms(docs, found, p)
    base = keyed.select("doc_id", "text_hash", "spans")
    if told is None:
        return base.withColumn("all_spans", F.col("spans"))
    more = term_spans(found, told).withColumnsRenamed({"doc_id": "__doc", "text_hash": "__hash"})
    both = base.join(more, F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.col("text_hash") == F.col("__hash")), "left")
    added = F.when(F.col("more").isNull(), F.col("spans")).otherwise(F.array_sort(F.concat("spans", F.coalesce("more", "spans"))))
    return both.select("doc_id", "text_hash", "spans", added.alias("all_spans"))


def sanitise(text: Column, spans: Column) -> Column:
    """``text`` with base spans replaced by their kind and terms by ``[TERM]``; of overlapping spans the first counts."""
    marks = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, z: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, z["s"] - acc["at"])
        return F.when(z["s"] < acc["at"], acc).otherwise(
            F.struct(z["e"].alias("at"), F.concat(acc["out"], gap, F.get(marks, z["kind"])).alias("out"))
        )

    end = lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.char_length(text)))
    return F.aggregate(spans, start, step, end)


# --- the query -------------------------------------------------------------------------------


def personal_data(spark, sf_dir: str) -> DataFrame:
    found = find_pii(documents(spark, sf_dir))
    count = lambda k, c: F.size(F.filter(c, lambda z: z["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        *[count(i, "spans").alias(f"n_{k}") for i, k in enumerate(KINDS[:4])],
        F.sha2(joined(F.col("spans")), 256).alias("base_sha256"),
        joined(F.col("all_spans")).alias("spans"),
        count(4, "all_spans").alias("n_term"),
    )
