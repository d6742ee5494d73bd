"""Mixing sources to target weights by hierarchical budgeting.

The token budget flows down a tree (domain, language, source). At every node it is shared by the
children's weights, but no child gets more than its tokens times ``max_epochs``; what a child cannot
take goes to its siblings by their weights, and only what a whole family cannot take goes back to the
parent's siblings (the parent's own limit is the sum of its leaves'). A leaf's share is a number of whole
epochs and a prefix of one more: its documents stand in the order of a hash of seed, epoch and id, and
those go whose tokens fit the rest.

The tree holds one row per leaf and is pre-aggregated; documents meet it in one join. No leaf is ever
sorted as a whole: its hash range is cut into buckets, as many as the square root of its documents; sums per
bucket locate the one in which the prefix ends, and only that bucket is put in order.

Defined results: missing values of the tree's columns form the node ``(none)``. Leaves without tokens
get no budget and their documents go. Shares are whole numbers rounded down. Documents with one hash
(repeated ids) are taken or left together; a missing id hashes as one. Null and empty texts have no
tokens. Helper columns avoid the names of the documents' columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deskstream.llm import common as c

NONE = "(none)"
WORDS = "[^\\x20\\x09-\\x0D]+"
BIG = "decimal(38,0)"


def tokens(text: str = "text") -> Column:
    """White-space separated words, counted natively."""
    return F.coalesce(F.regexp_count(F.col(f"`{text}`"), F.lit(WORDS)), F.lit(0)).cast("bigint")


def weight_of(column: Column, weights: dict[str, int]) -> Column:
    out = F.lit(weights.get("*", 1))
    for name, weight in weights.items():
        if name != "*":
            out = F.when(column == name, weight).otherwise(out)
    return out.cast("bigint")


def shares(children: DataFrame, family: list[str], order: list[str]) -> DataFrame:
    """``share`` of each child (columns cap, weight, budget): the budget by weight, limited by cap, shortages to siblings."""
    one = Window.partitionBy(*family)
    ranked = one.orderBy(F.col("cap") / F.col("weight"), *order)
    before = F.coalesce(F.sum("cap").over(ranked.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(ranked.rowsBetween(0, Window.unboundedFollowing))
    full = F.col("cap").cast(BIG) * rest.cast(BIG) <= (F.col("budget") - before).cast(BIG) * F.col("weight").cast(BIG)
    rows = children.withColumn("full", full)
    taken = F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(one)
    open_ = F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(one)
    rows = rows.withColumn("taken", taken).withColumn("open", open_)
    part = F.expr(f"(CAST(budget - taken AS {BIG}) * CAST(weight AS {BIG})) DIV CAST(open AS {BIG})")
    share = F.when(F.col("full"), F.col("cap")).otherwise(F.when(F.col("open") > 0, part).otherwise(0))
    return rows.withColumn("share", share.cast("bigint")).drop("full", "taken", "open")


def budget_tree(leaves: DataFrame, levels: list[str], weights: dict[str, dict[str, int]], budget: Column, max_epochs: int) -> DataFrame:
    """Leaves (levels, n, docs) with their share of the budget."""
    nodes = leaves.where("n > 0").withColumn("cap", F.col("n") * max_epochs)
    root = nodes.agg(F.sum("n").alias("total")).select(F.lit(0).alias("root"), budget.cast("bigint").alias("budget"))
    parents, path = root, ["root"]
    for depth, level in enumerate(levels):
        family, path = path, [*path, level]
        children = nodes.withColumn("root", F.lit(0)).groupBy(*path).agg(F.sum("cap").alias("cap"))
        children = children.withColumn("weight", weight_of(F.col(level), weights.get(level, {}))).join(parents, family)
        parents = shares(children, family, [level]).select(*path, F.col("share").alias("budget"))
    return leaves.join(parents.drop("root"), levels).select(*levels, "n", "docs", F.col("budget").alias("share"))


def epoch_key(seed: int, epoch: Column, id_: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col(f"`{id_}`").cast("string"), F.lit(NONE))).cast("binary"))


def _bucket(key: Column, buckets: Column) -> Column:
    return F.floor(F.conv(F.substring(key, 1, 8), 16, 10).cast("bigint") * buckets / F.lit(1 << 32)).cast("bigint")


def plan(docs: DataFrame, levels: list[str], weights: dict[str, dict[str, int]], share: float, max_epochs: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """Narrow rows (doc_id, levels, n_tokens), and per leaf the whole epochs and where the last prefix ends."""
    rows = c.saved(docs.select("doc_id", *levels, tokens().alias("n_tokens")), "tokens")
    leaves = c.saved(rows.groupBy(*levels).agg(F.sum("n_tokens").alias("n"), F.count("*").alias("docs")), "leaves")
    tree = budget_tree(leaves, levels, weights, F.floor(F.col("total") * share), max_epochs)
    whole = F.expr("share DIV n")
    tree = tree.select(*levels, "n", whole.alias("epochs"), (F.col("share") % F.col("n")).alias("rest"), F.ceil(F.sqrt("docs")).alias("buckets"))
    tree = c.saved(tree, "tree")
    keyed = rows.join(tree, levels).withColumn("key", epoch_key(seed, F.col("epochs") + 1, "doc_id"))
    keyed = keyed.select(*levels, "rest", "n_tokens", "key", _bucket(F.col("key"), F.col("buckets")).alias("bucket"))
    sums = keyed.groupBy(*levels, "rest", "bucket").agg(F.sum("n_tokens").alias("size"))
    ends = F.sum("size").over(Window.partitionBy(*levels).orderBy("bucket"))
    last = sums.withColumn("before", ends - F.col("size")).where("before <= rest AND rest < before + size").select(*levels, "bucket", "before")
    last = c.saved(last, "last")
    inside = keyed.join(last, [*levels, "bucket"])
    so_far = F.col("before") + F.sum("n_tokens").over(Window.partitionBy(*levels, "bucket").orderBy("key"))
    fits = inside.withColumn("so_far", so_far).where("so_far <= rest").groupBy(*levels).agg(F.max("key").alias("last_key"))
    ended = tree.join(last.select(*levels, F.col("bucket").alias("last_bucket")), levels).join(fits, levels, "left")
    return rows, c.saved(ended.select(*levels, "epochs", "buckets", "last_bucket", "last_key"), "plan")


def epochs_of(seed: int, id_: str = "doc_id") -> Column:
    """The epochs in which a document of a planned leaf is taken (null: none)."""
    key = epoch_key(seed, F.col("epochs") + 1, id_)
    bucket = _bucket(key, F.col("buckets"))
    more = (bucket < F.col("last_bucket")) | ((bucket == F.col("last_bucket")) & F.coalesce(key <= F.col("last_key"), F.lit(False)))
    times = F.col("epochs") + F.when(more, 1).otherwise(0)
    return F.when(times > 0, F.sequence(F.lit(1).cast("bigint"), times.cast("bigint")))


#: Production parameters of the query and the pipeline.
LEVELS = ["domain", "lang", "source"]
WEIGHTS = {"domain": {"domain0": 5, "domain1": 3, "domain2": 2}, "lang": {"en": 6, "de": 2, "fr": 2, "es": 1}}
SEED = 42


def domain(source: str = "source") -> Column:
    """A stand-in for a domain table: the source's number modulo 3."""
    number = F.try_mod(F.expr(f"try_cast(regexp_extract(`{source}`, '([0-9]+)$', 1) AS INT)"), F.lit(3))
    return F.concat(F.lit("domain"), F.coalesce(number.cast("string"), F.lit("?")))


def _leafed(docs: DataFrame) -> list[Column]:
    return [domain().alias("domain"), F.coalesce("lang", F.lit(NONE)).alias("lang"), F.coalesce("source", F.lit(NONE)).alias("source")]


def mixture(docs: DataFrame, share: float = 1.0, max_epochs: int = 3, seed: int = SEED) -> DataFrame:
    """(doc_id, domain, lang, source, n_tokens, epoch): one row per selected document and epoch."""
    narrow = docs.select("doc_id", "text", *_leafed(docs))
    rows, ended = plan(narrow, LEVELS, WEIGHTS, share, max_epochs, seed)
    taken = rows.join(ended, LEVELS).select("doc_id", *LEVELS, "n_tokens", F.explode(epochs_of(seed)).alias("epoch"))
    return taken


def mixed(docs: DataFrame, share: float = 1.0, max_epochs: int = 2, seed: int = SEED) -> DataFrame:
    """The documents themselves, once for each epoch that takes them, with their own columns only. Texts are not shuffled."""
    narrow = docs.select("doc_id", "text", *_leafed(docs))
    _, ended = plan(narrow, LEVELS, WEIGHTS, share, max_epochs, seed)
    names = c.unused(docs, *[f"_{x}" for x in LEVELS])
    hidden = c.unused(docs, *[f"_{x}" for x in ("epochs", "buckets", "last_bucket", "last_key")])
    leafed = docs.select("*", *[col.alias(name) for col, name in zip(_leafed(docs), names)])
    side = ended.select(*[F.col(x).alias(n) for x, n in zip([*LEVELS, "epochs", "buckets", "last_bucket", "last_key"], [*names, *hidden])])
    key = epoch_key(seed, F.col(hidden[0]) + 1, "doc_id")
    bucket = _bucket(key, F.col(hidden[1]))
    more = (bucket < F.col(hidden[2])) | ((bucket == F.col(hidden[2])) & F.coalesce(key <= F.col(hidden[3]), F.lit(False)))
    times = F.col(hidden[0]) + F.when(more, 1).otherwise(0)
    (epoch,) = c.unused(docs, "_epoch")
    met = leafed.join(side, names)
    taken = met.select(*[F.col(f"`{x}`") for x in docs.columns], F.explode(F.when(times > 0, F.sequence(F.lit(1).cast("bigint"), times.cast("bigint")))).alias(epoch))
    return taken.select(*[F.col(f"`{x}`") for x in docs.columns])


def oracle(table: str = "documents", share: float = 1.0, max_epochs: int = 3, seed: int = SEED) -> str:
    """The same selection in DuckDB SQL, with every leaf ordered as a whole."""
    names = {"domain": "root", "lang": "root, domain", "source": "root, domain, lang"}
    case = {
        level: "CASE " + " ".join(f"WHEN {level} = '{k}' THEN {w}" for k, w in WEIGHTS[level].items()) + " ELSE 1 END" if level in WEIGHTS else "1"
        for level in LEVELS
    }
    steps = []
    parent = "top"
    for level in LEVELS:
        family = names[level]
        steps.append(f"""
c_{level} AS (SELECT {family}, {level}, sum(cap) AS cap, {case[level]} AS weight FROM nodes GROUP BY {family}, {level}),
r_{level} AS (
    SELECT c.*, p.budget,
           coalesce(sum(cap) OVER (PARTITION BY {family} ORDER BY cap::DOUBLE / weight, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
           sum(weight) OVER (PARTITION BY {family} ORDER BY cap::DOUBLE / weight, {level} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS later
    FROM c_{level} AS c JOIN {parent} AS p USING ({family})
),
f_{level} AS (SELECT *, cap::HUGEINT * later <= (budget - before)::HUGEINT * weight AS is_full FROM r_{level}),
s_{level} AS (
    SELECT *, sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER (PARTITION BY {family}) AS taken,
           sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER (PARTITION BY {family}) AS open FROM f_{level}
),
b_{level} AS (
    SELECT {family}, {level}, CASE WHEN is_full THEN cap ELSE ((budget - taken)::HUGEINT * weight) // open END::BIGINT AS budget FROM s_{level}
)""")
        parent = f"b_{level}"
    return f"""
WITH d AS (
    SELECT doc_id, 'domain' || coalesce((try_cast(regexp_extract(source, '([0-9]+)$', 1) AS INT) % 3)::VARCHAR, '?') AS domain,
           coalesce(lang, '{NONE}') AS lang, coalesce(source, '{NONE}') AS source,
           coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS n_tokens
    FROM {table}
),
nodes AS (SELECT 0 AS root, domain, lang, source, sum(n_tokens)::BIGINT AS n, sum(n_tokens)::BIGINT * {max_epochs} AS cap FROM d GROUP BY domain, lang, source HAVING sum(n_tokens) > 0),
top AS (SELECT 0 AS root, floor(sum(n) * {share})::BIGINT AS budget FROM nodes),
{",".join(steps)},
plan AS (SELECT b.*, n, budget // n AS epochs, budget % n AS rest FROM b_source AS b JOIN nodes USING (root, domain, lang, source)),
k AS (
    SELECT d.*, epochs, rest, sum(n_tokens) OVER (
        PARTITION BY domain, lang, source ORDER BY md5('{seed}:' || (epochs + 1)::VARCHAR || ':' || coalesce(doc_id::VARCHAR, '{NONE}'))) AS so_far
    FROM d JOIN plan USING (domain, lang, source)
)
SELECT doc_id, domain, lang, source, n_tokens, unnest(range(1, (epochs + CASE WHEN so_far <= rest THEN 1 ELSE 0 END + 1)::BIGINT)) AS epoch FROM k
"""
