"""Scalar functions over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deskstream.functions import scoring, text
from deskstream.operators import projection
from deskstream.plans.bindings import NOW, bind, quoted
from deskstream.plans.registry import query
from deskstream.schemas import CATEGORIES, PRIORITIES
from deskstream.sources.bind import Inputs

FULL = "subject || chr(10) || body"
LEAD = r"(^|[^\p{L}\p{N}_])"


def _re2(pattern: str, fold: bool = True) -> str:
    """The fixed pattern as RE2 with Unicode-aware leading word boundary."""
    body = pattern[2:] if pattern.startswith(r"\b") else pattern
    return quoted(("(?i)" if fold else "") + LEAD + body)


def _signal_sql(name: str, pattern: str, fold: bool) -> str:
    return f"regexp_matches({FULL}, {_re2(pattern, fold)}) AS {name}"


@query(
    "urgency_signals",
    bind("notes") + " SELECT id, " + ", ".join(_signal_sql(n, p, f) for n, p, f in text.SIGNAL_PATTERNS) + " FROM notes",
)
def _signals(i: Inputs) -> DataFrame:
    signals = text.urgency_signals(text.ticket_text(F.col("subject"), F.col("body"))).alias("s")
    return i.notes.select("id", signals).select("id", "s.*")


@query(
    "signal_list",
    bind("notes")
    + " , s AS (SELECT id, "
    + ", ".join(_signal_sql(n, p, f) for n, p, f in text.SIGNAL_PATTERNS)
    + f", regexp_extract({FULL}, {_re2(text.DEADLINE_PATTERN)}, 2) AS hit FROM notes)"
    + " SELECT id, list_filter(["
    + ", ".join(
        f"CASE WHEN {n} THEN " + ("'deadline:' || left(trim(hit), 30)" if n == "deadline" else f"'{n}'") + " END"
        for n, _, _ in text.SIGNAL_PATTERNS
    )
    + "], lambda x: x IS NOT NULL) AS signals FROM s",
    arr="signals",
)
def _signal_list(i: Inputs) -> DataFrame:
    return i.notes.select("id", text.signal_list(text.ticket_text(F.col("subject"), F.col("body"))).alias("signals"))


@query(
    "text_stats",
    bind("notes")
    + f""" SELECT id, least(len({FULL}) - len(replace({FULL}, '!', '')), 5) AS exclaim,
  len(regexp_extract_all({FULL}, '\\p{{Lu}}')) / greatest(len(regexp_extract_all({FULL}, '\\p{{L}}')), 1) AS caps_ratio,
  least(len({FULL}) - len(replace({FULL}, '?', '')), 5) AS questions,
  least(greatest(len(regexp_extract_all({FULL}, '[^\\s]+')), 1), 300) / 300.0::DOUBLE AS n_words FROM notes""",
    num="exclaim caps_ratio questions n_words",
)
def _stats(i: Inputs) -> DataFrame:
    stats = text.text_stats(text.ticket_text(F.col("subject"), F.col("body"))).alias("s")
    return i.notes.select("id", stats).select("id", "s.*")


@query("pii_redact")
def _redact(i: Inputs) -> DataFrame:
    redacted = text.pii_redact(F.col("body")).alias("r")
    return i.notes.select("id", redacted).select("id", "r.n", F.md5("r.text").alias("text_hash"))


@query(
    "mask_error_codes",
    bind("notes")
    + r""" SELECT id, md5(regexp_replace(body, '(^|[^\p{L}\p{N}_])(?:[A-Z]{2,}[A-Z0-9]*(?:-[A-Z0-9.]+)+|[45]\d\d)\b', '\1<CODE>', 'g')) AS text_hash,
  regexp_matches(body, '(^|[^\p{L}\p{N}_])(?:[A-Z]{2,}[A-Z0-9]*(?:-[A-Z0-9.]+)+|[45]\d\d)\b') AS masked FROM notes""",
)
def _mask(i: Inputs) -> DataFrame:
    masked = text.mask_error_codes(F.col("body"))
    return i.notes.select("id", F.md5(masked).alias("text_hash"), (masked != F.col("body")).alias("masked"))


_STOP = ", ".join(f"'{w}'" for w in text.QUERY_STOP_WORDS)


@query(
    "tokenize_query",
    bind("notes")
    + f""", t AS (SELECT id, unnest(regexp_extract_all(lower(subject || ' ' || body), '[a-z0-9]{{3,}}')) AS tok,
    generate_subscripts(regexp_extract_all(lower(subject || ' ' || body), '[a-z0-9]{{3,}}'), 1) AS pos FROM notes),
u AS (SELECT id, tok, min(pos) AS pos FROM t WHERE tok NOT IN ({_STOP}) GROUP BY 1, 2),
r AS (SELECT id, tok, row_number() OVER (PARTITION BY id ORDER BY pos) AS k FROM u)
SELECT n.id, coalesce(string_agg(r.tok, '|' ORDER BY r.k), '') AS tokens FROM notes n LEFT JOIN r ON r.id = n.id AND r.k <= 14 GROUP BY 1""",
)
def _tokenize(i: Inputs) -> DataFrame:
    return i.notes.select("id", text.tokenize_query(F.concat_ws(" ", "subject", "body")).alias("tokens"))


_REPLY = "concat('See [T-', id, '] and [T-', id % 7, ', T-', id + 1, ']. ', body)"


def _reply() -> F.Column:
    return F.expr("concat('See [T-', id, '] and [T-', id % 7, ', T-', id + 1, ']. ', body)")


@query(
    "citations_explode",
    bind("notes")
    + f", r AS (SELECT id, regexp_extract_all({_REPLY}, '\\[T-(\\d+)\\]', 1) AS ids FROM notes) SELECT id, CAST(unnest(ids) AS BIGINT) AS cited FROM r",
)
def _explode(i: Inputs) -> DataFrame:
    return i.notes.select("id", F.explode(text.citations_split(_reply())).alias("p")).where("p.kind = 'cite'").select(
        "id", F.col("p.value").cast("bigint").alias("cited")
    )


@query(
    "citations_normalise",
    bind("notes") + " SELECT id, md5(concat('See [T-', id, '] and [T-', id % 7, '][T-', id + 1, ']. ', body)) AS reply_hash FROM notes",
)
def _normalise(i: Inputs) -> DataFrame:
    return i.notes.select("id", F.md5(text.citations_normalise(_reply())).alias("reply_hash"))


@query(
    "citations_validate",
    bind("notes")
    + """ SELECT id, 0.5 AS confidence, 'WEAK' AS grounding, CAST(1 + CAST(id % 7 <> id AS INT) AS INT) AS stripped,
  md5(left(concat('See [T-', id, '] and ', CASE WHEN id % 7 = id THEN concat('[T-', id, ']') ELSE '' END, '. ', rtrim(body, chr(32) || chr(10) || chr(9) || chr(13))), 4000)) AS reply_hash FROM notes""",
    num="confidence",
)
def _validate(i: Inputs) -> DataFrame:
    """One real and one invented citation; the tag of the next id is invented as well."""
    citations = F.array(F.struct(F.col("id").alias("ticketId"), F.lit("same").alias("why")))
    out = text.citations_validate(_reply(), citations, F.array(F.col("id")), F.lit(0.9), F.lit("STRONG")).alias("v")
    return i.notes.select("id", out).select(
        "id", "v.confidence", "v.grounding", "v.stripped", F.md5("v.reply").alias("reply_hash")
    )


@query(
    "invalid_citations",
    bind("drafts")
    + """ SELECT id, CASE WHEN source_ids IS NULL THEN NULL WHEN source_ids[2] = source_ids[1] THEN '' ELSE CAST(source_ids[2] AS VARCHAR) END AS invalid FROM drafts""",
)
def _invalid(i: Inputs) -> DataFrame:
    parsed = projection.json_fields(i.drafts)
    ids = lambda c, f: F.transform(c, lambda s: s[f])
    return parsed.select(
        "id", text.invalid_citations(ids("sources", "id"), ids("citations", "ticketId")).alias("invalid")
    )


@query(
    "grounding_level",
    bind("tickets")
    + """ SELECT id, CASE WHEN greatest(coalesce(escalation_risk, -1), category_conf) >= CAST(0.75 AS FLOAT) THEN 'STRONG'
  WHEN greatest(coalesce(escalation_risk, -1), category_conf) >= CAST(0.55 AS FLOAT) THEN 'WEAK' ELSE 'NONE' END AS grounding FROM tickets""",
)
def _grounding(i: Inputs) -> DataFrame:
    # scores are compared at the precision they are stored with
    entry = lambda c: F.struct(F.round(c.cast("double"), 6).alias("score"))
    sources = F.array(entry(F.coalesce("escalation_risk", F.lit(-1.0).cast("float"))), entry(F.col("category_conf")))
    return i.tickets.select("id", scoring.grounding_level(sources).alias("grounding"))


@query(
    "edit_distance",
    bind("replies") + " SELECT id, levenshtein(body, final_body) AS edit_distance FROM replies",
)
def _distance(i: Inputs) -> DataFrame:
    return i.replies.select("id", text.edit_distance(F.col("body"), F.col("final_body")).cast("bigint").alias("edit_distance"))


@query(
    "edit_ratio",
    bind("replies") + " SELECT id, levenshtein(body, final_body) / greatest(len(body), len(final_body)) AS edit_ratio FROM replies",
    num="edit_ratio",
)
def _ratio(i: Inputs) -> DataFrame:
    return i.replies.select("id", text.edit_ratio(F.col("body"), F.col("final_body")).alias("edit_ratio"))


@query("word_diff")
def _diff(i: Inputs) -> DataFrame:
    return i.replies.select("id", projection.word_diff(F.col("body"), F.col("final_body")).alias("d")).select("id", "d.*")


@query(
    "sla_state",
    bind("tickets")
    + f""", s AS (SELECT id, status, sla_due_at, sla_breached, epoch_us(sla_due_at) - epoch_us({NOW}) AS us FROM tickets),
m AS (SELECT *, abs(us) // 60000000 AS m FROM s),
x AS (SELECT *, CASE WHEN m >= 1440 THEN concat(m // 1440, 'd ', (m % 1440) // 60, 'h') WHEN m >= 60 THEN concat(m // 60, 'h ', m % 60, 'm') ELSE concat(m, 'm') END AS txt FROM m)
SELECT id, CASE WHEN status IN ('RESOLVED', 'CLOSED') THEN 'done' WHEN sla_due_at IS NULL THEN '—' WHEN us < 0 OR sla_breached THEN 'overdue ' || txt ELSE 'in ' || txt END AS label,
  CASE WHEN status IN ('RESOLVED', 'CLOSED') OR sla_due_at IS NULL THEN 'muted' WHEN us < 0 OR sla_breached THEN 'bad' WHEN us < 900000000 THEN 'warn' ELSE 'good' END AS tone FROM x""",
)
def _sla_state(i: Inputs) -> DataFrame:
    state = scoring.sla_state(F.col("sla_due_at"), F.col("status"), F.col("sla_breached"), i.as_of).alias("s")
    return i.tickets.select("id", state).select("id", "s.*")


@query(
    "time_features",
    bind("tickets")
    + """ SELECT id, CAST(hour(created_at) AS INT) AS hour, CAST(isodow(created_at) - 1 AS INT) AS weekday,
  hour(created_at) < 9 OR hour(created_at) >= 18 OR isodow(created_at) >= 6 AS off_hours FROM tickets""",
)
def _time(i: Inputs) -> DataFrame:
    return i.tickets.select("id", scoring.time_features(F.col("created_at")).alias("t")).select("id", "t.*")


@query(
    "time_split",
    bind("tickets")
    + """ SELECT id, CASE WHEN d < 20 THEN 'train' WHEN d < 24 THEN 'val' ELSE 'test' END AS split
FROM (SELECT id, (epoch_us(created_at) - epoch_us(TIMESTAMP '2024-01-01')) // 86400000000 AS d FROM tickets)""",
)
def _split(i: Inputs) -> DataFrame:
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    return i.tickets.select("id", scoring.time_split(F.col("created_at"), start, 20, 24).alias("split"))


_PROBS = [f"(1 + (id * {k + 3}) % 11) / 44.0::DOUBLE" for k in range(4)]


def _probs() -> F.Column:
    return F.array(*[F.expr(f"(1 + (id * {k + 3}) % 11) / 44.0D") for k in range(4)])


@query(
    "argmax_label",
    bind("tickets")
    + f""" SELECT id, (['LOW', 'MEDIUM', 'HIGH', 'URGENT'])[list_position(p, list_max(p))] AS label, list_max(p) AS confidence
FROM (SELECT id, [{', '.join(_PROBS)}] AS p FROM tickets)""",
    num="confidence",
)
def _argmax(i: Inputs) -> DataFrame:
    return i.tickets.select("id", scoring.argmax_label(_probs(), PRIORITIES).alias("a")).select("id", "a.*")


@query(
    "urgent_reweight",
    bind("tickets")
    + f""", p AS (SELECT id, {', '.join(f'{e} AS p{k}' for k, e in enumerate(_PROBS))} FROM tickets)
SELECT id, p0 / (p0 + p1 + p2 + p3 * 1.25) AS low, p3 * 1.25 / (p0 + p1 + p2 + p3 * 1.25) AS urgent FROM p""",
    num="low urgent",
)
def _reweight(i: Inputs) -> DataFrame:
    scaled = scoring.urgent_reweight(_probs(), 1.25).alias("p")
    return i.tickets.select("id", scaled).select("id", F.get("p", F.lit(0)).alias("low"), F.get("p", F.lit(3)).alias("urgent"))


@query("cascade_flag", bind("tickets") + " SELECT id, category_conf < CAST(0.8 AS FLOAT) AS needs_llm FROM tickets")
def _flag(i: Inputs) -> DataFrame:
    return i.tickets.select("id", scoring.cascade_flag(F.round(F.col("category_conf").cast("double"), 6)).alias("needs_llm"))


@query(
    "cascade_merge",
    bind("tickets")
    + """ SELECT id, CASE WHEN category_source = 'AGENT' AND category IS NOT NULL THEN category WHEN category_source = 'LLM' THEN 'BUG' ELSE category END AS label,
  CASE WHEN category_source = 'AGENT' AND category IS NOT NULL THEN 'AGENT' WHEN category_source = 'LLM' THEN 'LLM' WHEN category IS NOT NULL THEN 'MODEL' END AS source FROM tickets""",
)
def _merge(i: Inputs) -> DataFrame:
    agent = F.when(F.col("category_source") == "AGENT", F.col("category"))
    llm = F.when(F.col("category_source") == "LLM", F.lit("BUG"))
    return i.tickets.select("id", scoring.cascade_merge(agent, llm, F.col("category")).alias("m")).select("id", "m.*")


@query(
    "route_queue",
    bind("tickets") + " SELECT id, CASE WHEN CAST(escalation_risk AS DOUBLE) >= 0.4 THEN 'SENIOR' ELSE 'STANDARD' END AS queue FROM tickets",
)
def _route(i: Inputs) -> DataFrame:
    return i.tickets.select("id", scoring.route_queue(F.col("escalation_risk").cast("double")).alias("queue"))


@query(
    "logit_platt",
    bind("scored")
    + """ SELECT id, 1 / (1 + exp(-(1.2 * ln(c / (1 - c)) - 0.3))) AS calibrated FROM (SELECT id, least(greatest(p, 0.000001), 0.999999) AS c FROM scored)""",
    num="calibrated",
)
def _platt(i: Inputs) -> DataFrame:
    return i.scored.select("id", scoring.logit_platt(F.col("p"), 1.2, -0.3).alias("calibrated"))


@query(
    "model_tag_split",
    bind("predictions")
    + " SELECT id, model_name AS name, CASE WHEN task = 'PRIORITY' THEN '1' ELSE model_version END AS version FROM predictions",
)
def _tag(i: Inputs) -> DataFrame:
    tag = F.when(F.col("task") == "PRIORITY", F.col("model_name")).otherwise(F.concat_ws("@", "model_name", "model_version"))
    return i.predictions.select("id", scoring.model_tag_split(tag).alias("t")).select("id", "t.*")


@query(
    "vector_parse",
    "SELECT vec_id, len(embedding) AS dim, CAST(embedding[1] AS DOUBLE) AS first, CAST(embedding[64] AS DOUBLE) AS last FROM embeddings",
    num="first last",
)
def _vector(i: Inputs) -> DataFrame:
    """Through the text form and back."""
    back = scoring.vector_parse(scoring.vector_format(F.col("embedding"))).alias("v")
    return i.table("embeddings").select("vec_id", back).select(
        "vec_id", F.size("v").cast("bigint").alias("dim"), F.element_at("v", 1).alias("first"), F.element_at("v", -1).alias("last")
    )


@query("vector_format", "SELECT vec_id, len(embedding) - 1 AS commas FROM embeddings")
def _vector_format(i: Inputs) -> DataFrame:
    shown = scoring.vector_format(F.col("embedding"))
    return i.table("embeddings").select("vec_id", F.regexp_count(shown, F.lit(",")).cast("bigint").alias("commas"))


@query(
    "cosine",
    "SELECT a.vec_id, list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
    num="cosine",
)
def _cosine(i: Inputs) -> DataFrame:
    e = i.table("embeddings")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(nxt, "vec_id").select("vec_id", scoring.cosine(F.col("embedding"), F.col("other")).alias("cosine"))


@query(
    "json_fields",
    bind("drafts") + " SELECT id, source_ids[1] AS first_source, CASE WHEN source_ids IS NULL THEN NULL ELSE 2 END AS sources, source_ids[1] AS cited FROM drafts",
)
def _json(i: Inputs) -> DataFrame:
    parsed = projection.json_fields(i.drafts)
    return parsed.select(
        "id",
        F.col("sources")[0]["id"].alias("first_source"),
        F.when(F.col("sources").isNotNull(), F.size("sources")).alias("sources"),
        F.col("citations")[0]["ticketId"].alias("cited"),
    )


@query(
    "llm_cost",
    bind("drafts") + " SELECT id, (input_tokens * 0.10::DOUBLE + output_tokens * 0.40::DOUBLE) / 1e6 * 1000 AS cost_per_1k FROM drafts",
    num="cost_per_1k",
)
def _llm_cost(i: Inputs) -> DataFrame:
    cost = scoring.llm_cost(F.col("input_tokens"), F.col("output_tokens")) * 1000
    return i.drafts.select("id", cost.alias("cost_per_1k"))


@query(
    "cache_key",
    bind("notes") + " SELECT id, sha256(concat_ws('|', 'classify_v1', '0.0', body)) AS cache_key FROM notes",
)
def _cache_key(i: Inputs) -> DataFrame:
    return i.notes.select("id", text.cache_key(F.lit("classify_v1"), F.lit("0.0"), F.col("body")).alias("cache_key"))


@query(
    "uncached_requests",
    bind("notes")
    + """, k AS (SELECT id, sha256(concat_ws('|', 'v1', '0.0', lower(resolution))) AS cache_key FROM notes),
c AS (SELECT sha256(concat_ws('|', 'v1', '0.0', lower(text))) AS cache_key FROM benchmark WHERE length(text) > 500)
SELECT id, cache_key FROM k WHERE cache_key NOT IN (SELECT cache_key FROM c)""",
)
def _uncached(i: Inputs) -> DataFrame:
    key = lambda c: text.cache_key(F.lit("v1"), F.lit("0.0"), F.lower(c)).alias("cache_key")
    cache = i.table("benchmark").where(F.length("text") > 500).select(key("text"))
    return projection.uncached_requests(i.notes.select("id", key("resolution")), cache).select("id", "cache_key")


@query(
    "build_prompts",
    bind("notes")
    + f""" SELECT id, md5(concat_ws(chr(10), {quoted(projection.DRAFT_HEAD)},
  {quoted(projection.DRAFT_WITH_SOURCES)},
  CASE WHEN id % 4 = 0 THEN concat('NOTE: known incident, about ', id % 9, ' similar reports right now.') END,
  CASE WHEN id % 3 = 0 THEN 'Agent instruction: be brief' END, concat('Subject: ', subject), concat('Body: ', category), 'SOURCES:',
  concat('[T-', id, '] Subject: ', subject, chr(10), 'Problem: ', priority, chr(10), 'Resolution: ', resolution))) AS prompt_hash, 'draft_v1' AS prompt_version FROM notes""",
)
def _prompts(i: Inputs) -> DataFrame:
    source = F.struct("id", "subject", F.col("priority").alias("problem"), "resolution")
    built = projection.build_prompts(
        i.notes,
        "draft",
        F.col("subject"),
        F.col("category"),
        sources=F.array(source),
        incident=F.col("id") % 4 == 0,
        cluster_size=F.col("id") % 9,
        instruction=F.when(F.col("id") % 3 == 0, F.lit("be brief")),
    )
    return built.select("id", F.md5("prompt").alias("prompt_hash"), "prompt_version")


def _rule_sql(words: list[str], target: str) -> str:
    return "(" + " OR ".join(f"contains({target}, {quoted(w)})" for w in words) + ")"


@query(
    "rule_classify",
    bind("notes")
    + " SELECT id, CASE "
    + " ".join(f"WHEN {_rule_sql(words, 'lower(body)')} THEN '{name}'" for name, words in text.RULE_KEYWORDS)
    + f" ELSE 'BUG' END AS category, CASE WHEN {_rule_sql(text.URGENT_KEYWORDS, 'lower(body)')} THEN 'URGENT' ELSE 'MEDIUM' END AS priority FROM notes",
)
def _rules(i: Inputs) -> DataFrame:
    return i.notes.select("id", text.rule_classify(F.col("body")).alias("r")).select("id", "r.*")


@query(
    "template_draft",
    bind("notes")
    + f""" SELECT id, md5(CASE WHEN quality = 1 THEN concat({quoted(text.TEMPLATE_GREETING)}, trim(resolution, chr(32) || chr(10) || chr(9) || chr(13)), ' [T-', id, '] ', {quoted(text.TEMPLATE_CLOSING)})
  ELSE {quoted(text.TEMPLATE_GREETING + text.TEMPLATE_ASK)} END) AS reply_hash, CASE WHEN quality = 1 THEN 0.7 ELSE 0.2 END AS confidence FROM notes""",
    num="confidence",
)
def _template(i: Inputs) -> DataFrame:
    one = F.array(F.struct("id", "subject", F.col("body").alias("problem"), "resolution"))
    sources = F.when(F.col("quality") == 1, one).otherwise(F.slice(one, 1, 0))
    return i.notes.select("id", text.template_draft(sources).alias("d")).select(
        "id", F.md5("d.reply").alias("reply_hash"), "d.confidence"
    )


@query(
    "llm_output_guard",
    bind("predictions")
    + f""" SELECT id, CASE WHEN label IN ({', '.join(quoted(c) for c in CATEGORIES)}) THEN label ELSE 'BUG' END AS category,
  CASE WHEN label IN ('LOW', 'MEDIUM', 'HIGH', 'URGENT') THEN label ELSE 'MEDIUM' END AS priority,
  least(greatest(CAST(score AS DOUBLE) * 2 - 0.9, 0), 1) AS confidence FROM predictions""",
    num="confidence",
)
def _guard(i: Inputs) -> DataFrame:
    guarded = text.output_guard(F.col("label"), F.col("label"), F.col("score").cast("double") * 2 - 0.9).alias("g")
    return i.predictions.select("id", guarded).select("id", "g.*")


@query(
    "factor_labels",
    bind("tickets")
    + """, f AS (SELECT id, (['tier', 'p_cat_BUG', 'caps_ratio', 'n_words'])[CAST(id % 4 AS INT) + 1] AS feature FROM tickets)
SELECT id, feature, CASE feature WHEN 'tier' THEN 'Customer tier' WHEN 'p_cat_BUG' THEN 'Category: BUG' WHEN 'caps_ratio' THEN 'Shouting (caps)' ELSE 'n words' END AS label FROM f""",
)
def _factor_labels(i: Inputs) -> DataFrame:
    rows = i.tickets.selectExpr("id", "elt(cast(id % 4 as int) + 1, 'tier', 'p_cat_BUG', 'caps_ratio', 'n_words') AS feature")
    return projection.factor_labels(rows).select("id", "feature", "label")


@query(
    "one_hot_tier",
    bind("tickets")
    + """ SELECT id, CAST(customer_tier = 'FREE' AS INT) AS free, CAST(customer_tier = 'PRO' AS INT) AS pro, CAST(customer_tier = 'ENTERPRISE' AS INT) AS enterprise FROM tickets""",
)
def _one_hot(i: Inputs) -> DataFrame:
    hot = scoring.one_hot_tier(F.col("customer_tier")).alias("h")
    return i.tickets.select("id", hot).select(
        "id", *[F.get("h", F.lit(k)).cast("int").alias(n) for k, n in enumerate(["free", "pro", "enterprise"])]
    )


@query(
    "tier_ordinal",
    bind("uploads") + " SELECT id, CASE customer_tier WHEN 'PRO' THEN 1 WHEN 'ENTERPRISE' THEN 2 ELSE 0 END AS tier FROM uploads",
)
def _tier(i: Inputs) -> DataFrame:
    return i.uploads.select("id", scoring.tier_ordinal(F.col("customer_tier")).alias("tier"))


@query(
    "product_index",
    bind("uploads")
    + " SELECT id, CASE product WHEN 'mobile-app' THEN 1 WHEN 'api' THEN 2 WHEN 'desktop-sync' THEN 3 WHEN 'admin-console' THEN 4 ELSE 0 END AS product FROM uploads",
)
def _product(i: Inputs) -> DataFrame:
    return i.uploads.select("id", scoring.product_index(F.col("product")).alias("product"))


_WORDS = "len(regexp_extract_all({c}, '[^\\s\\x{{0B}}\\x{{1C}}-\\x{{1F}}\\x{{85}}\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]+'))"


@query(
    "quality_gate",
    bind("notes")
    + f""", q AS (SELECT {_WORDS.format(c='body')} < 5 AS too_short, {_WORDS.format(c='body')} > 300 AS too_long, length(subject) < 3 AS empty_subject,
  {_WORDS.format(c='resolution')} < 8 AS short_resolution, regexp_matches(subject || ' ' || body, {quoted(text.LABEL_LEAK_PATTERN)}) AS label_leak,
  regexp_matches(subject || ' ' || body || ' ' || resolution, {quoted('(?i)' + text.REFUSAL_PATTERN)}) AS refusal FROM notes)
SELECT count(*) AS "rows", count(*) FILTER (WHERE NOT (too_short OR too_long OR empty_subject OR short_resolution OR label_leak OR refusal)) AS kept,
  {', '.join(f'count(*) FILTER (WHERE {n}) AS {n}' for n in ('too_short', 'too_long', 'empty_subject', 'short_resolution', 'label_leak', 'refusal'))} FROM q""",
)
def _gate(i: Inputs) -> DataFrame:
    return projection.quality_gate(i.notes)[1]


@query(
    "escalation_logit",
    bind("tickets")
    + """ SELECT id, -4.0 + CASE customer_tier WHEN 'PRO' THEN 0.5 WHEN 'ENTERPRISE' THEN 1.2 ELSE 0 END + CASE WHEN priority IN ('HIGH', 'URGENT') THEN 0.9 ELSE 0 END
  + CASE WHEN priority = 'URGENT' THEN 0.7 ELSE 0 END + 0.9 * coalesce(CAST(escalation_risk AS DOUBLE), 0) + CASE WHEN id % 5 = 0 THEN 0.8 ELSE 0 END
  + CASE WHEN cluster_id IS NOT NULL THEN 0.9 ELSE 0 END + CASE WHEN hour(created_at) < 9 OR hour(created_at) >= 18 OR isodow(created_at) >= 6 THEN 0.4 ELSE 0 END
  + 0.25 * least(version, 5) + CASE WHEN category = 'DATA_PRIVACY' THEN 0.5 ELSE 0 END AS logit FROM tickets""",
    num="logit",
)
def _logit(i: Inputs) -> DataFrame:
    value = scoring.escalation_logit(
        F.col("customer_tier"),
        F.col("priority"),
        F.col("escalation_risk").cast("double"),
        F.col("id") % 5 == 0,
        F.col("cluster_id").isNotNull(),
        scoring.time_features(F.col("created_at"))["off_hours"],
        F.col("version"),
        F.col("category"),
    )
    return i.tickets.select("id", value.alias("logit"))


@query(
    "draft_priority",
    bind("tickets", "clusters")
    + """ SELECT t.id, CAST(floor(coalesce(CAST(t.escalation_risk AS DOUBLE), 0) * 100 + 0.5) AS INT) + CASE t.customer_tier WHEN 'ENTERPRISE' THEN 20 WHEN 'PRO' THEN 10 ELSE 0 END
  + CASE WHEN coalesce(c.is_incident, false) THEN 30 ELSE 0 END AS priority FROM tickets t LEFT JOIN clusters c ON c.id = t.cluster_id""",
)
def _draft_priority(i: Inputs) -> DataFrame:
    joined = projection.tickets_with_cluster(i.tickets, i.clusters)
    return joined.select(
        "id", scoring.draft_priority(F.col("escalation_risk"), F.col("customer_tier"), F.col("is_incident")).alias("priority")
    )


@query(
    "ticket_text",
    bind("notes")
    + """ SELECT id, md5(subject || chr(10) || body) AS model_text, md5(subject || ' ' || body || ' ' || resolution) AS search_text, md5(subject || '. ' || body) AS near_dup_text FROM notes""",
)
def _ticket_text(i: Inputs) -> DataFrame:
    s, b, r = F.col("subject"), F.col("body"), F.col("resolution")
    return i.notes.select("id", *[F.md5(text.ticket_text(s, b, r, style)).alias(f"{style}_text") for style in ("model", "search", "near_dup")])


@query(
    "truncate_fields",
    bind("notes") + " SELECT id, md5(left(body, 500)) AS problem_hash, length(left(resolution, 1200)) AS resolution_length FROM notes",
)
def _truncate(i: Inputs) -> DataFrame:
    cut = projection.truncate_fields(i.notes, {"body": 500, "resolution": 1200})
    return cut.select("id", F.md5("body").alias("problem_hash"), F.length("resolution").cast("bigint").alias("resolution_length"))


@query(
    "sentiment_lexicon",
    bind("notes")
    + """, lex AS (SELECT * FROM (VALUES ('wrong', -2.0), ('slow', -1.5), ('breach', -2.5), ('great', 3.0), ('thanks', 2.0), ('please', 1.0)) AS v(term, valence)),
t AS (SELECT id, unnest(regexp_extract_all(lower(body), '[a-z0-9]+')) AS term FROM notes),
s AS (SELECT id, coalesce(sum(valence), 0) AS s, count(*) FILTER (WHERE valence < 0) / count(*) AS neg FROM t LEFT JOIN lex USING (term) GROUP BY 1)
SELECT id, neg, s / sqrt(s * s + 15) AS compound FROM s""",
    num="neg compound",
)
def _sentiment(i: Inputs) -> DataFrame:
    tokens = i.notes.select("id", text.tokens(F.col("body")).alias("tokens"))
    return projection.sentiment_lexicon(tokens, F.broadcast(i.lexicon))  # six rows
