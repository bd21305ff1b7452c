"""Text parsing and cleanup as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: words that mark a line as chatter rather than screen text
CHATTER = ("okay", "need", "figure", "fix", "text", "user", "mentioned", "so", "alright", "step")
ANCHOR_PLACEHOLDERS = ("first four words exactly", "last four words exactly")

TRANSCRIPT_PATTERN = r"\[([\d.]+)s - ([\d.]+)s\]"
TIME_PATTERN = r"\[([\d.]+)s\]"
SPACE = r"[ \t\n\r\f\x0B]"


def strip(text: Column) -> Column:
    """Remove blanks of every kind at both ends."""
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+$", "")


def clean_screen_text(text: Column) -> Column:
    """Of several lines the first non-blank one without chatter, else empty; blanks collapsed."""
    low_ok = lambda line: ~_contains_any(F.lower(line), CHATTER)
    lines = F.filter(F.split(text, "\n"), lambda line: (strip(line) != "") & low_ok(line))
    chosen = F.when(F.contains(text, F.lit("\n")), F.coalesce(F.get(lines, F.lit(0)), F.lit(""))).otherwise(text)
    return strip(F.regexp_replace(chosen, rf"{SPACE}+", " "))


def _contains_any(text: Column, words: Sequence[str]) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | F.contains(text, F.lit(w))
    return found


def word_count(text: Column) -> Column:
    t = strip(text)
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, rf"{SPACE}+")))


def title_slug(title: Column, fallback: Column) -> Column:
    """Lower case, spaces to underscores, letters / digits / underscores only, 50 characters."""
    base = F.regexp_replace(strip(F.lower(title)), " ", "_")
    safe = F.substring(F.regexp_replace(base, r"[^\p{L}\p{N}_]", ""), 1, 50)
    return F.coalesce(F.nullif(safe, F.lit("")), fallback)


def clip_file_name(number: Column, title: Column) -> Column:
    n = number.cast("string")
    return F.concat(n, F.lit("_"), title_slug(title, F.concat(F.lit("clip_"), n)), F.lit(".mp4"))


def transcript_line(start: Column, end: Column, loud: Column, pace: Column, text: Column) -> Column:
    return F.concat(
        F.lit("["), F.format_string("%.1f", start), F.lit("s - "), F.format_string("%.1f", end),
        F.lit("s] (Vol: "), loud, F.lit(", Pace: "), pace, F.lit(") "), strip(text),
    )


def parse_transcript_line(line: Column) -> Column:
    """Start, end, loudness, pace and text of a transcript line; -1 times where none parse."""

    def time(group: int) -> Column:
        return F.coalesce(F.regexp_extract(line, TRANSCRIPT_PATTERN, group).try_cast("double"), F.lit(-1.0))

    def part(pattern: str) -> Column:
        return F.nullif(F.regexp_extract(line, pattern, 1), F.lit(""))

    return F.struct(
        time(1).alias("start"),
        time(2).alias("end"),
        part(r"Vol: (\w+)").alias("loudness"),
        part(r"Pace: (\w+)").alias("pace"),
        F.regexp_replace(line, r"^\[[^\]]*\] \([^)]*\) ", "").alias("text"),
    )


def parse_timed_line(line: Column) -> Column:
    """Time and remaining text of ``[t s] text``; -1 where no time parses."""
    return F.struct(
        F.coalesce(F.regexp_extract(line, TIME_PATTERN, 1).try_cast("double"), F.lit(-1.0)).alias("t"),
        F.regexp_replace(line, r"^\[[\d.]+s\] ", "").alias("text"),
    )


def anchor_key(text: Column) -> Column:
    """Lower case, without the time prefix and without punctuation."""
    bare = F.regexp_replace(text, r"\[.*?\] \(.*?\) ", "")
    return F.regexp_replace(strip(F.lower(bare)), r"[^\p{L}\p{N}_\s]", "")


def has_anchor(text: Column) -> Column:
    return F.coalesce((text != "") & ~text.isin(*ANCHOR_PLACEHOLDERS), F.lit(False))


def reply_array(reply: Column) -> Column:
    """The JSON array of a model reply: without thinking and code fences, first ``[`` to last ``]``."""
    bare = F.regexp_replace(reply, r"(?s)<think>.*?</think>", "")
    bare = F.regexp_replace(bare, r"(?s)^.*</think>", "")
    bare = F.regexp_replace(bare, r"(?i)```json|```", "")
    return F.nullif(F.regexp_extract(bare, r"(?s)(\[.*\])", 1), F.lit(""))


def reply_number(reply: Column) -> Column:
    """First number of a reply."""
    return F.regexp_extract(reply, r"(\d+\.?\d*)", 1).try_cast("double")


def reply_candidate(reply: Column) -> Column:
    """Number after ``CANDIDATE:``; without one the first number, unless the reply says NONE."""
    tagged = F.regexp_extract(reply, r"(?i)CANDIDATE:\s*(\d+\.?\d*)", 1).try_cast("double")
    says_none = F.contains(F.upper(reply), F.lit("NONE"))
    return F.coalesce(tagged, F.when(~says_none, reply_number(reply)))


def reply_description(reply: Column) -> Column:
    found = F.regexp_extract(reply, r"(?is)DESCRIPTION:\s*(.+?)(?=CANDIDATE:|$)", 1)
    return F.substring(F.when(found != "", strip(found)).otherwise(reply), 1, 150)


def yes_no(answer: Column) -> Column:
    up = F.upper(F.coalesce(answer, F.lit("")))
    return F.when(F.contains(up, F.lit("YES")), "YES").when(F.contains(up, F.lit("NO")), "NO").otherwise("UNEXPECTED")


def natural_key(name: Column) -> Column:
    """Sort key with numbers compared by value: digit runs behind their length, the rest in lower case."""
    runs = F.regexp_extract_all(name, F.lit(r"(\d+|\D+)"), F.lit(1))

    def ranked(run: Column) -> Column:
        bare = F.regexp_replace(run, "^0+(?=.)", "")
        return F.when(run.rlike(r"^\d"), F.concat(F.lpad(F.length(bare).cast("string"), 10, "0"), bare)).otherwise(F.lower(run))

    padded = F.transform(runs, ranked)
    return F.array_join(padded, "")


def frame_name(session: Column, tag: Column, frame: Column) -> Column:
    safe = F.regexp_replace(strip(F.coalesce(tag, F.lit(""))), r"[^\p{L}\p{N}_-]", "")
    number = frame.cast("string")
    six = F.when(F.length(number) < 6, F.lpad(number, 6, "0")).otherwise(number)
    return F.when(safe != "", F.concat(session, F.lit("_"), safe, F.lit("_f"), six)).otherwise(
        F.concat(session, F.lit("_f"), six)
    )


def enrichment_tags(**present: Column) -> Column:
    """`` [crop+subs]`` from which enrichments are present; empty when none is."""
    names = F.concat_ws("+", *[F.when(c, F.lit(n)) for n, c in present.items()])
    return F.when(names == "", F.lit("")).otherwise(F.concat(F.lit(" ["), names, F.lit("]")))


def pattern_tags(text: Column, pattern: str = r"\$?\d+") -> Column:
    return F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
