"""Numeric, temporal and label expressions used by triage, routing and review."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from deskstream.schemas import (
    CLOSED_STATUSES,
    DEFAULTS,
    PRODUCTS,
    TIER_ORDINAL,
    TIERS,
    TRIAGE_PRIORITY,
)


def _lookup(key: Column, table: dict[str, int], default: int) -> Column:
    pairs = [F.lit(item) for entry in table.items() for item in entry]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit(default))


def is_open(status: Column) -> Column:
    return ~status.isin(CLOSED_STATUSES)


def triage_priority(tier: Column) -> Column:
    return _lookup(tier, TRIAGE_PRIORITY, 0)


def draft_priority(risk: Column, tier: Column, incident: Column) -> Column:
    """Risk in percent plus a tier bonus plus 30 for an incident; served highest first."""
    return (
        F.floor(F.coalesce(risk.cast("double"), F.lit(0.0)) * 100 + F.lit(0.5)).cast("int")
        + _lookup(tier, TRIAGE_PRIORITY, 0)
        + F.when(F.coalesce(incident, F.lit(False)), F.lit(30)).otherwise(F.lit(0))
    )


def route_queue(risk: Column, threshold: float = DEFAULTS.senior_threshold) -> Column:
    return F.when(risk >= F.lit(threshold), F.lit("SENIOR")).otherwise(F.lit("STANDARD"))


def time_features(at: Column) -> Column:
    """Hour, weekday (Monday 0) and whether the time lies outside business hours, UTC."""
    hour, weekday = F.hour(at), F.weekday(at)
    return F.struct(
        hour.alias("hour"),
        weekday.alias("weekday"),
        ((hour < 9) | (hour >= 18) | (weekday >= 5)).alias("off_hours"),
    )


def time_split(at: Column, start: Column, train_end: int = 63, val_end: int = 72) -> Column:
    """train / val / test by whole days since ``start``."""
    day = F.floor((F.unix_micros(at) - F.unix_micros(start)) / F.lit(86_400_000_000))
    return F.when(day < train_end, F.lit("train")).when(day < val_end, F.lit("val")).otherwise(F.lit("test"))


def sla_state(due: Column, status: Column, breached: Column, as_of: Column) -> Column:
    """Countdown text and tone of a service-level deadline."""
    micros = F.unix_micros(due) - F.unix_micros(as_of)
    minutes = F.floor(F.abs(micros) / F.lit(60_000_000))
    whole = lambda value: F.floor(value).cast("string")
    text = (
        F.when(minutes >= 1440, F.concat(whole(minutes / 1440), F.lit("d "), whole((minutes % 1440) / 60), F.lit("h")))
        .when(minutes >= 60, F.concat(whole(minutes / 60), F.lit("h "), whole(minutes % 60), F.lit("m")))
        .otherwise(F.concat(whole(minutes), F.lit("m")))
    )
    late = (micros < 0) | F.coalesce(breached, F.lit(False))
    done = status.isin(CLOSED_STATUSES)
    label = (
        F.when(done, F.lit("done"))
        .when(due.isNull(), F.lit("—"))
        .when(late, F.concat(F.lit("overdue "), text))
        .otherwise(F.concat(F.lit("in "), text))
    )
    tone = (
        F.when(done | due.isNull(), F.lit("muted"))
        .when(late, F.lit("bad"))
        .when(micros < 15 * 60_000_000, F.lit("warn"))
        .otherwise(F.lit("good"))
    )
    return F.struct(label.alias("label"), tone.alias("tone"))


def argmax_label(probabilities: Column, classes: list[str]) -> Column:
    """Most likely class of an array aligned with ``classes``; ties go to the first."""
    best = F.array_max(probabilities)
    position = F.array_position(probabilities, best)
    names = F.array(*[F.lit(name) for name in classes])
    return F.struct(F.try_element_at(names, position.cast("int")).alias("label"), best.alias("confidence"))


def urgent_reweight(probabilities: Column, weight: float | Column, position: int = 3) -> Column:
    """Multiply one class probability by ``weight`` and renormalise."""
    factor = weight if isinstance(weight, Column) else F.lit(float(weight))
    scaled = F.transform(probabilities, lambda p, i: F.when(i == position, p * factor).otherwise(p))
    total = F.aggregate(scaled, F.lit(0.0), lambda acc, p: acc + p)
    return F.transform(scaled, lambda p: p / total)


def cascade_flag(confidence: Column, tau: float | Column = DEFAULTS.cascade_threshold) -> Column:
    return confidence < (tau if isinstance(tau, Column) else F.lit(float(tau)))


def cascade_merge(agent: Column, llm: Column, model: Column) -> Column:
    """A person's label beats the language model's, which beats the classifier's."""
    return F.struct(
        F.coalesce(agent, llm, model).alias("label"),
        F.when(agent.isNotNull(), F.lit("AGENT"))
        .when(llm.isNotNull(), F.lit("LLM"))
        .when(model.isNotNull(), F.lit("MODEL"))
        .alias("source"),
    )


def logit(p: Column, floor: float = 1e-6) -> Column:
    clipped = F.least(F.greatest(p, F.lit(floor)), F.lit(1 - floor))
    return F.log(clipped / (1 - clipped))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def logit_platt(p: Column, slope: float, intercept: float) -> Column:
    return sigmoid(F.lit(float(slope)) * logit(p) + F.lit(float(intercept)))


def model_tag_split(tag: Column) -> Column:
    """``name@version``; the version defaults to 1."""
    parts = F.split(tag, "@", 2)
    return F.struct(
        F.get(parts, F.lit(0)).alias("name"),
        F.coalesce(F.get(parts, F.lit(1)), F.lit("1")).alias("version"),
    )


def grounding_level(
    sources: Column, strong: float = DEFAULTS.grounding_strong, weak: float = DEFAULTS.grounding_weak
) -> Column:
    """How well the best source supports a draft; ``sources`` is array<struct<.., score>>."""
    best = F.array_max(F.transform(sources, lambda s: s["score"].cast("double")))
    return F.when(best >= strong, F.lit("STRONG")).when(best >= weak, F.lit("WEAK")).otherwise(F.lit("NONE"))


def llm_cost(
    tokens_in: Column, tokens_out: Column, price_in: float = DEFAULTS.price_in, price_out: float = DEFAULTS.price_out
) -> Column:
    """Token counts times the price per million."""
    return (tokens_in * F.lit(price_in) + tokens_out * F.lit(price_out)) / F.lit(1e6)


def one_hot_tier(tier: Column) -> Column:
    return F.array(*[(tier == name).cast("double") for name in TIERS])


def tier_ordinal(tier: Column) -> Column:
    return _lookup(tier, TIER_ORDINAL, 0)


def product_index(product: Column) -> Column:
    return _lookup(product, {name: i for i, name in enumerate(PRODUCTS)}, 0)


# Additive log-odds of an escalation.
ESCALATION_BASE = -4.0
ESCALATION_TIER = {"FREE": 0.0, "PRO": 0.5, "ENTERPRISE": 1.2}
ESCALATION_HIGH, ESCALATION_URGENT = 0.9, 0.7
ESCALATION_TONE = 0.9
ESCALATION_DEADLINE = 0.8
ESCALATION_INCIDENT = 0.9
ESCALATION_OFF_HOURS = 0.4
ESCALATION_PRIOR, ESCALATION_PRIOR_CAP = 0.25, 5
ESCALATION_PRIVACY = 0.5


def escalation_logit(
    tier: Column,
    priority: Column,
    negativity: Column,
    has_deadline: Column,
    incident: Column,
    off_hours: Column,
    prior_tickets: Column,
    category: Column,
) -> Column:
    """Closed-form log-odds of an escalation, without noise."""
    flag = lambda condition: F.when(condition, F.lit(1.0)).otherwise(F.lit(0.0))
    terms = [
        F.lit(ESCALATION_BASE),
        reduce(lambda acc, kv: acc + flag(tier == kv[0]) * kv[1], ESCALATION_TIER.items(), F.lit(0.0)),
        flag(priority.isin("HIGH", "URGENT")) * ESCALATION_HIGH,
        flag(priority == "URGENT") * ESCALATION_URGENT,
        F.coalesce(negativity, F.lit(0.0)) * ESCALATION_TONE,
        flag(has_deadline) * ESCALATION_DEADLINE,
        flag(incident) * ESCALATION_INCIDENT,
        flag(off_hours) * ESCALATION_OFF_HOURS,
        F.least(prior_tickets, F.lit(ESCALATION_PRIOR_CAP)) * ESCALATION_PRIOR,
        flag(category == "DATA_PRIVACY") * ESCALATION_PRIVACY,
    ]
    return reduce(lambda a, b: a + b, terms)


def cosine(a: Column, b: Column) -> Column:
    """Dot product of two unit vectors, in double."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def vector_parse(text: Column) -> Column:
    """``[0.1,0.2]`` as array<float>."""
    return F.from_json(text, "array<float>")


def vector_format(vector: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(vector, lambda x: x.cast("string")), ","), F.lit("]"))


def top_factors(contributions: Column, k: int = 3, digits: int | None = None) -> Column:
    """The ``k`` largest contributions by absolute value, embedding components merged.

    ``contributions`` is array<struct<feature, value>>. Merged values that agree to ``digits`` places rank
    equally, by name; the values themselves are not rounded.
    """
    size = (lambda c: F.abs(c["value"])) if digits is None else (lambda c: F.round(F.abs(c["value"]), digits))
    is_embedding = lambda c: F.startswith(c["feature"], F.lit("emb_pc"))
    total = F.aggregate(F.filter(contributions, is_embedding), F.lit(0.0), lambda acc, c: acc + c["value"])
    merged = F.struct(F.lit("text_embedding").alias("feature"), total.alias("value"))
    others = F.filter(contributions, lambda c: ~is_embedding(c))
    every = F.when(F.exists(contributions, is_embedding), F.array_append(others, merged)).otherwise(others)
    ranked = F.array_sort(
        F.transform(
            every,
            lambda c: F.struct((-size(c)).alias("key"), c["feature"].alias("feature"), c["value"].alias("value")),
        )
    )
    return F.transform(
        F.slice(ranked, 1, k), lambda c: F.struct(c["feature"].alias("feature"), c["value"].alias("contribution"))
    )
