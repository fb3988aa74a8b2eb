"""Confidence of an answer from retrieval, tool and evidence figures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codelathe.functions.text import any_in

# Fixed values.
WEIGHTS = {"vector": 0.40, "tool": 0.30, "evidence": 0.20, "clarity": 0.10}
BANDS = ((0.90, "Very High"), (0.75, "High"), (0.50, "Medium"), (0.25, "Low"))
QUESTION_WORDS = ("how", "what", "why", "where", "when", "which")
CODE_WORDS = ("code", "function", "class", "method", "error")


def clamp(x: Column) -> Column:
    """In [0, 1]; null stays null, as the bounds' functions skip nulls."""
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def components(vector: Column, tools: Column, tools_ok: Column, items: Column, relevant: Column, quality: Column, clarity: Column) -> dict[str, Column]:
    """The four parts; no tools count 0.5, no evidence 0.3."""
    return {
        "vector": clamp(vector.cast("double")),
        "tool": F.when(tools > 0, tools_ok / F.nullif(tools, F.lit(0))).otherwise(0.5),
        "evidence": F.when(items > 0, 0.6 * relevant / F.nullif(items, F.lit(0)) + 0.4 * quality).otherwise(0.3),
        "clarity": clamp(clarity.cast("double")),
    }


def score(parts: dict[str, Column]) -> Column:
    """The weighted sum in [0, 1]; 0.1 if a part is null."""
    return F.coalesce(clamp(sum((parts[k] * w for k, w in WEIGHTS.items()), F.lit(0.0))), F.lit(0.1))


def rating(value: Column) -> Column:
    out = F.when(value >= BANDS[0][0], BANDS[0][1])
    for least, name in BANDS[1:]:
        out = out.when(value >= least, name)
    return out.otherwise("Very Low")


def explanation(parts: dict[str, Column]) -> Column:
    """Each part's contribution and its rounded share of the score."""
    total = score(parts)
    return F.struct(*(F.struct((parts[k] * w).alias("contribution"), F.round(100 * parts[k] * w / F.nullif(total, F.lit(0.0))).cast("int").alias("percent")).alias(k) for k, w in WEIGHTS.items()))


def key_factors(parts: dict[str, Column], high: float = 0.75, low: float = 0.4) -> Column:
    return F.array_compact(F.array(*(F.when(c >= high, F.lit(f"strong {k}")).when(c < low, F.lit(f"weak {k}")) for k, c in parts.items())))


def clarity(text: Column) -> Column:
    """How clear a query is, from its length and words; 0.1 if blank."""
    words = F.when(any_in(text, QUESTION_WORDS), 0.2).otherwise(0.0) + F.when(any_in(text, CODE_WORDS), 0.3).otherwise(0.0)
    value = 0.4 * F.least(F.lit(1.0), F.length(text) / 50.0) + 0.6 * words
    return F.when(F.length(F.trim(F.coalesce(text, F.lit("")))) == 0, 0.1).otherwise(F.greatest(F.lit(0.1), F.least(F.lit(1.0), value)))
