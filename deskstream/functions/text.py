"""Text expressions: urgency signals, redaction, tokens, citations, prompts.

Every function maps Columns to Columns and stays inside the JVM.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from deskstream.schemas import CATEGORIES, PRIORITIES

# ---------------------------------------------------------------------------
# Patterns and word lists that decide results.
# ---------------------------------------------------------------------------
DEADLINE_PATTERN = (
    r"\b(asap|immediately|right now|urgent(ly)?|deadline|by (eod|end of (the )?(day|week))|"
    r"(by|before|until|due|within)\s+((the|my|our|your)\s+)?(\d{1,2}(:\d{2})?\s?(am|pm)|today|tonight|tomorrow|monday|tuesday|wednesday|"
    r"thursday|friday|noon|midnight|the weekend|\d+\s+(hours?|minutes?))|"
    r"(demo|audit|payroll|launch|presentation|board meeting|renewal|go-live|release)\b.{0,30}\b(today|tonight|tomorrow|friday|monday|\d{1,2}\s?(am|pm)))"
)
OUTAGE_PATTERN = (
    r"\b(outage|is down|are down|went down|not loading for (everyone|all)|all (of )?(our )?users|everyone|entire (team|company|org)|"
    r"whole (team|company|office)|nobody|no one can|production|prod\b|multiple users|company-wide|"
    r"since (the|your) (update|release|deploy)|after (the|your) (update|release|upgrade))"
)
ERROR_CODE_PATTERN = r"\b(?:[A-Z]{2,}[A-Z0-9]*(?:-[A-Z0-9.]+)+|[45]\d\d)\b"
BLOCKED_PATTERN = (
    r"\b(can'?t|cannot|unable to|blocked|locked out|stuck|not working|broken|fails?|failing|crash(es|ed|ing)?)\b"
)
LEGAL_PATTERN = r"\b(gdpr|breach|compromised|unauthori[sz]ed|hacked|leak(ed)?|lawyer|legal|lawsuit|chargeback)\b"
CHURN_PATTERN = (
    r"\b(cancel(l?ing)?( our)? (subscription|contract|account|plan)|switch(ing)? to (a )?(competitor|another)|refund)\b"
)
EMAIL_PATTERN = r"[\w.+-]+@[\w-]+\.[\w.-]+"
CARD_PATTERN = r"\b(?:\d[ -]?){13,19}\b"
PHONE_PATTERN = r"(?<!\w)(?:\+?\d{1,3}[ .-]?)?(?:\(\d{2,4}\)|\d{2,4})[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\w)"
SECRET_PATTERN = r"\b(?:sk|pk|api|key|tok|ghp|AIza)[-_A-Za-z0-9]{16,}\b"
IBAN_PATTERN = r"\b[A-Z]{2}\d{2}[A-Z0-9]{11,30}\b"
LABEL_LEAK_PATTERN = r"(LOGIN_ACCESS|FEATURE_REQUEST|ACCOUNT_MANAGEMENT|DATA_PRIVACY|(?:category|priority)\s*:|RC-\d+|INC-\d+)"
REFUSAL_PATTERN = r"(as an ai|as a language model|i(?:'m| am) sorry, but i (?:can(?:'|no)t|cannot) (?:assist|help|fulfil))"
QUERY_STOP_WORDS = [
    "the", "and", "for", "that", "with", "this", "have", "our", "you", "your", "are",
    "was", "not", "but", "can", "all", "any", "get", "getting", "please", "help", "need", "when", "from", "since", "been", "would",
    "could", "there", "they", "their", "what", "just", "still", "into", "about", "after", "before", "some", "has", "had", "how",
]
RULE_KEYWORDS = [
    ("BILLING", ["invoice", "charge", "refund", "billing", "payment", "vat", "plan"]),
    ("LOGIN_ACCESS", ["log in", "login", "sign in", "password", "sso", "403", "401", "mfa", "locked"]),
    ("PERFORMANCE", ["slow", "timeout", "latency", "sync is", "loading"]),
    ("INTEGRATION", ["api", "webhook", "slack", "jira", "zapier", "token"]),
    ("DATA_PRIVACY", ["gdpr", "export my data", "breach", "audit log", "retention"]),
    ("ACCOUNT_MANAGEMENT", ["seat", "role", "permission", "owner", "workspace"]),
    ("FEATURE_REQUEST", ["would be great", "feature", "please add", "support for"]),
]
URGENT_KEYWORDS = ["asap", "outage", "everyone", "down"]
FACTOR_LABELS = [
    ("tier", "Customer tier"),
    ("prior_tickets_7d", "Recent tickets from customer"),
    ("similar_recent", "Similar reports right now"),
    ("off_hours", "Outside business hours"),
    ("hour", "Time of day"),
    ("weekday", "Day of week"),
    ("text_embedding", "Ticket wording"),
    ("p_pri_URGENT", "Predicted urgent"),
    ("p_pri_HIGH", "Predicted high priority"),
    ("p_pri_MEDIUM", "Predicted medium priority"),
    ("p_pri_LOW", "Predicted low priority"),
    ("sig_deadline", "Deadline language"),
    ("sig_outage", "Outage language"),
    ("sig_legal", "Legal / breach language"),
    ("sig_churn", "Cancellation language"),
    ("sig_blocked", "Blocked / failing language"),
    ("vader_neg", "Negative sentiment"),
    ("exclaim", "Exclamation marks"),
    ("caps_ratio", "Shouting (caps)"),
]
TEMPLATE_GREETING = "Hi, thanks for reaching out and sorry for the trouble. "
TEMPLATE_CLOSING = "Let us know if that does not resolve it."
TEMPLATE_ASK = "We are investigating; could you share when this started and any error message you see?"
TEMPLATE_QUESTIONS = ["When did this start?", "Any error message?"]
TEMPLATE_WHY = "closest resolved ticket"
# ---------------------------------------------------------------------------

SIGNAL_PATTERNS = [
    ("deadline", DEADLINE_PATTERN, True),
    ("outage", OUTAGE_PATTERN, True),
    ("error_code", ERROR_CODE_PATTERN, False),
    ("blocked", BLOCKED_PATTERN, True),
    ("legal", LEGAL_PATTERN, True),
    ("churn", CHURN_PATTERN, True),
]
REDACTIONS = [
    ("EMAIL", EMAIL_PATTERN),
    ("CARD", CARD_PATTERN),
    ("PHONE", PHONE_PATTERN),
    ("SECRET", SECRET_PATTERN),
    ("IBAN", IBAN_PATTERN),
]
_WORD = r"\S+"


def java_regex(pattern: str, ignore_case: bool = False) -> str:
    """The pattern with Unicode word characters, as a Java regex."""
    return ("(?iU)" if ignore_case else "(?U)") + pattern


def strip_controls(text: Column) -> Column:
    """Trim every character up to and including U+0020 from both ends."""
    return F.regexp_replace(text, r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(java_regex(_WORD)))


def ticket_text(subject: Column, body: Column, resolution: Column | None = None, style: str = "model") -> Column:
    """The text of a ticket: for ``model`` input, for ``search`` or for ``near_dup`` comparison."""
    if style == "model":
        return F.concat(subject, F.lit("\n"), body)
    if style == "search":
        return F.concat_ws(" ", subject, body, resolution if resolution is not None else F.lit(None))
    if style == "near_dup":
        return F.concat(subject, F.lit(". "), body)
    raise ValueError(f"unknown style {style!r}")


def urgency_signals(text: Column) -> Column:
    """Six booleans; all but the error code ignore case."""
    return F.struct(
        *[F.rlike(text, F.lit(java_regex(pattern, fold))).alias(name) for name, pattern, fold in SIGNAL_PATTERNS]
    )


def signal_list(text: Column) -> Column:
    """Names of the signals that fired, the deadline with its first match."""
    shown = []
    for name, pattern, fold in SIGNAL_PATTERNS:
        regex = java_regex(pattern, fold)
        label: Column = F.lit(name)
        if name == "deadline":
            match = F.regexp_extract(text, regex, 0)
            label = F.concat(F.lit("deadline:"), F.substring(strip_controls(match), 1, 30))
        shown.append(F.when(F.rlike(text, F.lit(regex)), label))
    return F.array_compact(F.array(*shown))


def text_stats(text: Column) -> Column:
    letters = F.regexp_count(text, F.lit(r"\p{L}"))
    upper = F.regexp_count(text, F.lit(r"\p{Lu}"))
    return F.struct(
        F.least(F.regexp_count(text, F.lit("!")), F.lit(5)).cast("double").alias("exclaim"),
        (upper / F.greatest(letters, F.lit(1))).alias("caps_ratio"),
        F.least(F.regexp_count(text, F.lit(r"\?")), F.lit(5)).cast("double").alias("questions"),
        (F.least(F.greatest(word_count(text), F.lit(1)), F.lit(300)) / F.lit(300.0)).alias("n_words"),
    )


def pii_redact(text: Column) -> Column:
    """Replace personal data with a tag, in a fixed order, counting replacements before each step."""
    current, total = text, F.lit(0)
    for label, pattern in REDACTIONS:
        regex = java_regex(pattern)
        total = total + F.regexp_count(current, F.lit(regex))
        current = F.regexp_replace(current, regex, f"[{label}]")
    return F.struct(current.alias("text"), total.alias("n"))


def mask_error_codes(text: Column) -> Column:
    return F.regexp_replace(text, java_regex(ERROR_CODE_PATTERN), "<CODE>")


def tokens(text: Column, min_len: int = 1) -> Column:
    """Lower-case alphanumeric tokens in order, repeats kept."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]{%d,}" % min_len), F.lit(0))


def tokenize_query(text: Column, n: int = 14) -> Column:
    """First ``n`` distinct tokens of three or more characters that are not stop words."""
    stop = F.array(*[F.lit(word) for word in QUERY_STOP_WORDS])
    kept = F.filter(tokens(text, 3), lambda token: ~F.array_contains(stop, token))
    return F.slice(F.array_distinct(kept), 1, n)


def citations_split(reply: Column) -> Column:
    """Alternating text and citation parts, in order, as array<struct<kind, value>>."""
    parts = F.regexp_extract_all(reply, F.lit(r"\[T-\d+\]|(?s:(?:(?!\[T-\d+\]).)+)"), F.lit(0))
    is_tag = lambda part: F.rlike(part, F.lit(r"^\[T-\d+\]$"))
    return F.transform(
        parts,
        lambda part: F.struct(
            F.when(is_tag(part), F.lit("cite")).otherwise(F.lit("text")).alias("kind"),
            F.when(is_tag(part), F.regexp_extract(part, r"\d+", 0)).otherwise(part).alias("value"),
        ),
    )


def citations_normalise(reply: Column) -> Column:
    """``[T-1, T-2]`` becomes ``[T-1][T-2]``; other brackets stay as they are."""
    grouped = r"\[T-\d+(?:\s*[,;]\s*T-\d+)+\]"
    pieces = F.regexp_extract_all(reply, F.lit(rf"{grouped}|(?s:(?:(?!{grouped}).)+)"), F.lit(0))
    fixed = F.transform(
        pieces,
        lambda piece: F.when(
            F.rlike(piece, F.lit(rf"^{grouped}$")), F.regexp_replace(piece, r"\s*[,;]\s*", "][")
        ).otherwise(piece),
    )
    return F.array_join(fixed, "")


def cited_ids(reply: Column) -> Column:
    return F.transform(F.regexp_extract_all(reply, F.lit(r"\[T-(\d+)\]"), F.lit(1)), lambda tag: tag.cast("bigint"))


def invalid_citations(found: Column, valid: Column) -> Column:
    """Cited ids nobody provided, each once."""
    return F.array_except(found, valid)


def _tag(ticket_id: Column) -> Column:
    return F.concat(F.lit("[T-"), ticket_id.cast("string"), F.lit("]"))


def citations_validate(
    reply: Column, citations: Column, valid: Column, confidence: Column, grounding: Column
) -> Column:
    """Remove invented citations from a draft and downgrade it when there were any.

    ``citations`` is array<struct<ticketId, why>>, ``valid`` the ids that were offered.
    """
    kept = F.filter(citations, lambda c: F.array_contains(valid, c["ticketId"]))
    kept = F.transform(
        kept, lambda c: F.struct(c["ticketId"].alias("ticketId"), F.substring(c["why"], 1, 200).alias("why"))
    )
    normal = citations_normalise(F.regexp_replace(reply, r"^\s+|\s+$", ""))
    bad = F.array_distinct(invalid_citations(cited_ids(normal), valid))
    cleaned = F.aggregate(bad, normal, lambda text, ticket_id: F.replace(text, _tag(ticket_id), F.lit("")))
    missing = F.filter(kept, lambda c: ~F.contains(cleaned, _tag(c["ticketId"])))
    suffix = F.array_join(F.transform(missing, lambda c: _tag(c["ticketId"])), "")
    full = F.when(
        F.size(missing) > 0, F.concat(F.regexp_replace(cleaned, r"\s+$", ""), F.lit(" "), suffix)
    ).otherwise(cleaned)
    stripped = F.size(citations) - F.size(kept) + F.size(bad)
    clipped = F.least(F.greatest(confidence, F.lit(0.0)), F.lit(1.0))
    return F.struct(
        F.substring(full, 1, 4000).alias("reply"),
        kept.alias("citations"),
        stripped.alias("stripped"),
        F.when(stripped > 0, F.least(clipped, F.lit(0.5))).otherwise(clipped).alias("confidence"),
        F.when((stripped > 0) & (grounding == "STRONG"), F.lit("WEAK")).otherwise(grounding).alias("grounding"),
        (F.length(full) < 20).alias("rejected"),
    )


def rule_classify(text: Column) -> Column:
    """Keyword rules, first hit wins; BUG otherwise."""
    folded = F.lower(text)
    contains_any = lambda words: reduce(lambda a, b: a | b, [F.contains(folded, F.lit(w)) for w in words])
    category = F.coalesce(*[F.when(contains_any(words), F.lit(name)) for name, words in RULE_KEYWORDS], F.lit("BUG"))
    priority = F.when(contains_any(URGENT_KEYWORDS), F.lit("URGENT")).otherwise(F.lit("MEDIUM"))
    return F.struct(category.alias("category"), priority.alias("priority"))


def template_draft(sources: Column) -> Column:
    """A grounded template from the first source, or two fixed questions without one.

    ``sources`` is array<struct<id, subject, problem, resolution>>.
    """
    first = F.try_element_at(sources, F.lit(1))
    has_source = F.size(sources) > 0
    empty = F.array().cast("array<struct<ticketId: bigint, why: string>>")
    grounded = F.concat(
        F.lit(TEMPLATE_GREETING),
        strip_controls(first["resolution"]),
        F.lit(" "),
        _tag(first["id"]),
        F.lit(" " + TEMPLATE_CLOSING),
    )
    return F.struct(
        F.when(has_source, grounded).otherwise(F.lit(TEMPLATE_GREETING + TEMPLATE_ASK)).alias("reply"),
        F.when(
            has_source, F.array(F.struct(first["id"].alias("ticketId"), F.lit(TEMPLATE_WHY).alias("why")))
        )
        .otherwise(empty)
        .alias("citations"),
        F.when(has_source, F.lit(0.7)).otherwise(F.lit(0.2)).alias("confidence"),
        F.when(has_source, F.array().cast("array<string>"))
        .otherwise(F.array(*[F.lit(q) for q in TEMPLATE_QUESTIONS]))
        .alias("needs_info"),
    )


def output_guard(category: Column, priority: Column, confidence: Column) -> Column:
    """Replace labels outside their domain and clip the confidence."""
    return F.struct(
        F.when(category.isin(CATEGORIES), category).otherwise(F.lit("BUG")).alias("category"),
        F.when(priority.isin(PRIORITIES), priority).otherwise(F.lit("MEDIUM")).alias("priority"),
        F.least(F.greatest(confidence, F.lit(0.0)), F.lit(1.0)).alias("confidence"),
    )


def judge_guard(score: Column) -> Column:
    """Review scores live in 1..5."""
    return F.least(F.greatest(score, F.lit(1)), F.lit(5))


def truncate(text: Column, n: int) -> Column:
    """First ``n`` characters; shorter text and NULL unchanged."""
    return F.substring(text, 1, n)


def edit_distance(before: Column, after: Column) -> Column:
    return F.levenshtein(F.coalesce(before, F.lit("")), F.coalesce(after, F.lit("")))


def edit_ratio(before: Column, after: Column) -> Column:
    longest = F.greatest(F.length(F.coalesce(before, F.lit(""))), F.length(F.coalesce(after, F.lit(""))))
    return F.when(longest == 0, F.lit(0.0)).otherwise(edit_distance(before, after) / longest)


def cache_key(version: Column, temperature: Column, prompt: Column) -> Column:
    return F.sha2(F.concat_ws("|", version, temperature, prompt), 256)


def factor_label(feature: Column) -> Column:
    """Readable name of a feature that has no entry in the label table."""
    return F.regexp_replace(F.regexp_replace(feature, "^p_cat_", "Category: "), "_", " ")
