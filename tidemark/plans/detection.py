"""Frame sampling, pruning and validation of detector output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.similarity import edit_ratio, fuzzy_ratio
from tidemark.functions.spatial import sampled_frames
from tidemark.functions.text import SPACE, strip

KEY = "source_id"


def window_frames(windows: DataFrame, *, fps: float, interval_s: float, total_frames: int | Column, key: str = KEY) -> DataFrame:
    """Distinct sampled frames of a source's scan windows; ``total_frames`` may be a column of them."""
    total = total_frames if isinstance(total_frames, Column) else F.lit(total_frames)
    frames = sampled_frames(F.col("start"), F.col("end"), F.lit(fps), F.lit(interval_s), total)
    return windows.select(key, F.explode(frames).alias("frame")).distinct()


def prune_frames(
    frames: DataFrame, windows: DataFrame, *, frame: str = "frame", fps: float = 30.0, interval_s: float = 1.0, key: str = KEY
) -> DataFrame:
    """Rows of a frame table whose frame is sampled in a scan window of its source: a semi join.

    A source without windows keeps all its rows, as a scan without pruning does.
    """
    wanted = window_frames(windows, fps=fps, interval_s=interval_s, total_frames=F.lit(1 << 62), key=key).withColumnRenamed("frame", frame)
    inside = frames.join(wanted, [key, frame], "left_semi")
    return inside.unionByName(frames.join(windows.select(key).distinct(), key, "left_anti"))


# fixed values: words that confirm a label's screen text, with their weights
KEYWORDS = {
    "Victory": {"you are the champion": 3.0, "champion": 2.0, "victory": 2.0, "win": 1.0},
    "ELIMINATED Text": {"squad": 3.0, "eliminated": 2.0, "wipe": 2.5, "match summary": 1.0, "game over": 1.0},
    "Combat Feed / Kill Feed Updates": {
        "you are the champion": 5.0, "squad eliminated": 4.0, "champion eliminated": 3.0,
        "eliminated": 2.0, "knocked down": 2.0, "assist": 1.5,
    },
}
# fixed values: labels whose text is a number, and labels without text
NUMBER_LABELS = ("Floating Damage Numbers", "loating Damage Numbers")
EXEMPT_LABELS = ("Directional Damage Indicators", "loating Damage Numbers", "Floating Damage Numbers")


def keyword_table(spark, keywords=None) -> DataFrame:
    """Rule table of (label, keyword, weight); its size is that of the rules."""
    rows = [(lb, k, float(w)) for lb, ks in (keywords or KEYWORDS).items() for k, w in ks.items()]
    return spark.createDataFrame(rows, "label STRING, keyword STRING, weight DOUBLE")


def exact_text_score(events: DataFrame, keywords: DataFrame, *, ident: str = "event_id") -> DataFrame:
    """Total weight of the keywords a text contains; number labels need any digit."""
    low = F.lower("text")
    hits = events.where(F.trim(F.coalesce("text", F.lit(""))) != "").join(F.broadcast(keywords), "label")
    found = hits.where(F.contains(low, F.col("keyword"))).groupBy(ident).agg(F.sum("weight").alias("score"))
    numbers = events.where(F.col("label").isin(*NUMBER_LABELS) & F.col("text").rlike(r"\d")).select(
        ident, F.lit(1.0).alias("score")
    )
    return found.unionByName(numbers)


def validate_text(events: DataFrame, keywords: DataFrame, *, ident: str = "event_id",
                  word_ratio: float = 0.8, phrase_ratio: float = 0.6, fuzzy: bool = True) -> DataFrame:
    """Score of each text against its label's keywords: exact hits, then near misses.

    Exact hits are found by plain ``contains``.  Only keywords that missed are compared
    fuzzily - word by word for one-word keywords (the first word close enough counts), whole
    text for phrases - and pairs too different in length to reach the ratio are cut first.
    With ``fuzzy=False`` the edit ratio stands for the fuzzy one, and all runs in the JVM; a pair must
    then also share a piece: of ``k + 1`` pieces of a keyword one stays whole under ``k`` edits.
    """
    low = F.lower("text")
    texts = events.where(
        (F.trim(F.coalesce("text", F.lit(""))) != "") & ~F.col("label").isin(*NUMBER_LABELS)
    ).select(ident, "label", low.alias("__low"))
    pairs = texts.join(F.broadcast(keywords), "label")
    exact = pairs.where(F.contains("__low", F.col("keyword"))).select(ident, F.col("weight").alias("score"))
    missed = pairs.where(~F.contains(F.col("__low"), F.col("keyword")))
    one_word = ~F.contains(F.col("keyword"), F.lit(" "))
    words = missed.where(one_word).select(
        ident, "keyword", "weight", F.posexplode(F.split(strip(F.col("__low")), rf"{SPACE}+")).alias("pos", "word")
    )

    measure = fuzzy_ratio if fuzzy else edit_ratio

    def could_reach(a, b, ratio: float):
        short, long = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
        if fuzzy:
            return 2 * short > ratio * (short + long)
        # fewer than (1 - ratio) * long edits leave one of so many pieces of the keyword in the text
        edits = F.ceil((1 - ratio) * long) - 1
        size = F.greatest(F.lit(1), F.floor(F.length(a) / (edits + 1))).cast("int")
        pieces = F.transform(F.sequence(F.lit(0), F.greatest(edits, F.lit(0)).cast("int")), lambda i: F.substring(a, i * size + 1, size))
        return (short > ratio * long) & (edits >= 0) & F.exists(pieces, lambda x: (F.length(x) < size) | F.contains(b, x))

    near = words.where(could_reach(F.col("keyword"), F.col("word"), word_ratio)).withColumn(
        "r", measure(F.col("keyword"), F.col("word"))
    ).where(F.col("r") > word_ratio)
    near = near.groupBy(ident, "keyword").agg(
        (F.min_by("r", "pos") * F.first("weight")).alias("score")
    ).select(ident, "score")
    phrase = missed.where(~one_word & could_reach(F.col("keyword"), F.col("__low"), phrase_ratio)).withColumn(
        "r", measure(F.col("keyword"), F.col("__low"))
    ).where(F.col("r") > phrase_ratio).select(ident, (F.col("r") * F.col("weight")).alias("score"))
    numbers = events.where(F.col("label").isin(*NUMBER_LABELS) & F.col("text").rlike(r"\d")).select(
        ident, F.lit(1.0).alias("score")
    )
    every = exact.unionByName(near).unionByName(phrase).unionByName(numbers)
    return every.groupBy(ident).agg(F.sum("score").alias("score")).where(F.col("score") > 0)


def keep_readable(events: DataFrame, valid: DataFrame, *, bypass: float = 0.85, ident: str = "event_id") -> DataFrame:
    """Keep exempt labels, valid texts and confident detections; fill placeholder texts."""
    joined = events.join(valid.select(ident, F.lit(True).alias("__valid")), ident, "left")
    exempt = F.col("label").isin(*EXEMPT_LABELS)
    blank = F.trim(F.coalesce("text", F.lit(""))) == ""
    sure = F.coalesce(F.col("confidence") >= bypass, F.lit(False))
    keep = exempt | sure | (~blank & F.coalesce("__valid", F.lit(False)))
    text = F.when(exempt, "[Visual Indicator]").when(blank, "[Unreadable text]").otherwise(F.col("text"))
    return joined.where(keep).withColumn("text", text).drop("__valid")


def allowed(events: DataFrame, *, labels=(), min_confidence: float = 0.5) -> DataFrame:
    """Label allow-list (empty allows all) and minimum confidence."""
    out = events.where(F.col("confidence") >= min_confidence)
    return out.where(F.col("label").isin(*labels)) if labels else out
