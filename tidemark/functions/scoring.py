"""Event intensity and clip scores as column expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: rules for combat and scoring
COMBAT_WORDS = (
    "kill", "eliminated", "knocked", "down", "assist",
    "damage", "+100", "+50", "+150", "+75", "+25",
    "squad", "wipe", "elimination",
)
COMBAT_LABEL_SET = ("Floating Damage Numbers", "loating Damage Numbers", "audio_combat_spike")
BACKGROUND_LABELS = ("Combat Feed / Kill Feed Updates", "POV Player", "Teammate")
LABEL_ALIASES = {"loating Damage Numbers": "Floating Damage Numbers"}
DEFAULT_WEIGHTS = {
    "base_score": 1.0,
    "combat_bonus": 2.0,
    "high_confidence_bonus": 0.5,
    "squad_wipe_bonus": 1.5,
    "high_damage_bonus": 1.0,
    "elimination_bonus": 1.0,
    "label_bonuses": {
        "Victory": 5.0,
        "ELIMINATED Text": 4.0,
        "Floating Damage Numbers": 2.0,
        "Directional Damage Indicators": 1.5,
    },
}
SPIKE_BONUS = 2.0
DAMAGE_SHARE = 0.1


def canonical_label(label: Column) -> Column:
    """Map misspelt labels to the right one."""
    out = label
    for wrong, right in LABEL_ALIASES.items():
        out = F.when(label == wrong, F.lit(right)).otherwise(out)
    return out


def _has_any(text: Column, words) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | F.contains(text, F.lit(w))
    return found


def is_combat(label: Column, text: Column) -> Column:
    """Combat by label, or by a keyword in the text; nulls count as no."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.coalesce(label.isin(*COMBAT_LABEL_SET), F.lit(False)) | _has_any(low, COMBAT_WORDS)


def damage_bonus(text: Column) -> Column:
    """A tenth of the first ``+number`` in the text, else 0."""
    number = F.regexp_extract(F.coalesce(text, F.lit("")), r"\+(\d+)", 1).try_cast("double")
    return F.coalesce(number * DAMAGE_SHARE, F.lit(0.0))


def label_bonus(label: Column, bonuses: Mapping[str, float]) -> Column:
    """Bonus from a small rule map held in the expression; unknown labels get 0."""
    if not bonuses:
        return F.lit(0.0)
    pairs = [F.lit(x) for kv in bonuses.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), canonical_label(label)), F.lit(0.0))


def intensity(
    label: Column, confidence: Column, text: Column, weights: Mapping | None = None,
    bonus: Column | None = None,
) -> Column:
    """Score of one event; background labels score 0.

    ``bonus`` may come from a joined dimension table instead of the weights' own map.
    """
    w = {**DEFAULT_WEIGHTS, **(weights or {})}
    t = F.coalesce(text, F.lit(""))
    low = F.lower(t)
    extra = bonus if bonus is not None else label_bonus(label, w.get("label_bonuses") or {})
    score = (
        F.lit(float(w["base_score"]))
        + extra
        + F.when(is_combat(label, text), float(w["combat_bonus"])).otherwise(0.0)
        + F.when(label == "audio_combat_spike", SPIKE_BONUS).otherwise(0.0)
        + damage_bonus(text)
        + F.when(F.coalesce(confidence, F.lit(0.0)) > 0.8, float(w["high_confidence_bonus"])).otherwise(0.0)
        + F.when(_has_any(low, ("squad", "wipe")), float(w["squad_wipe_bonus"])).otherwise(0.0)
        + F.when(_has_any(low, ("eliminated", "elimination")), float(w["elimination_bonus"])).otherwise(0.0)
    )
    return F.when(F.coalesce(label.isin(*BACKGROUND_LABELS), F.lit(False)), F.lit(0.0)).otherwise(score)


def pace(words: Column, duration: Column) -> Column:
    rate = F.when(duration > 0, words / duration).otherwise(F.lit(0.0))
    return F.when(rate > 3.5, "Fast").when(rate < 1.5, "Slow").otherwise("Normal")


def loudness(rms: Column) -> Column:
    return F.when(rms > 0.15, "Loud").when(rms < 0.03, "Quiet").otherwise("Normal")


def narrative_score(hook: Column, payoff: Column, retention: Column) -> Column:
    """Mean of three metrics, each 50 where missing."""
    d = F.lit(50.0)
    return (F.coalesce(hook, d) + F.coalesce(payoff, d) + F.coalesce(retention, d)) / 3.0


def hybrid_score(narrative: Column, duration: Column, screens: Column, lines: Column, loud: Column, fast: Column) -> Column:
    """0.70 narrative + 0.15 visual + 0.15 audio, both capped at 100."""
    visual = F.least(screens / F.greatest(duration / 4.0, F.lit(1.0)) * 100, F.lit(100.0))
    audio = F.least((loud + fast * 1.5) / F.greatest(lines, F.lit(1)) * 100, F.lit(100.0))
    mixed = F.round(narrative * 0.70 + visual * 0.15 + audio * 0.15, 2)
    return F.when(duration <= 0, narrative).otherwise(mixed)


def clamp_padding(pad: Column, default: float) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.coalesce(pad, F.lit(default)), F.lit(5.0)))


def padded_span(start: Column, end: Column, pad_start: Column, pad_end: Column, length: Column) -> tuple[Column, Column]:
    return (
        F.greatest(F.lit(0.0), start - clamp_padding(pad_start, 0.3)),
        F.least(length, end + clamp_padding(pad_end, 1.5)),
    )


def repaired_end(start: Column, end: Column) -> Column:
    """A clip shorter than 5 s is stretched to 15 s."""
    return F.when(end - start < 5.0, start + 15.0).otherwise(end)


def duration_status(duration: Column, low: float, high: float) -> Column:
    """``accepted`` inside the closed band, else why not."""
    return (
        F.when(duration.isNull(), "bad_timestamps")
        .when(duration < low, "too_short")
        .when(duration > high, "too_long")
        .otherwise("accepted")
    )
