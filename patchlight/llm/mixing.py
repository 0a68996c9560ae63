"""Mixing sources to target weights: raking token mass to marginals, then sampling.

The table of cells (one row for each combination of categories, with its tokens)
is all that the raking works on; documents are read once to count tokens and once
to be sampled. Each sweep scales the mass of the cells to one marginal after the
other. A marginal sum is a grouped sum that is joined back, so cells stay spread
however many sources there are. The cells are written to the shared folder after
each marginal, so that every step is the same short plan, and only the largest gap
comes to the driver. Sweeps go on until the marginals settle; a gap that is left, or a budget that the
documents cannot fill, is reported.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchlight.llm.registry import ORACLES, query, table
from patchlight.llm.texts import WORD_PATTERN
from patchlight.session import written

HASH_DIGITS = 13


def uniform(key: Column, seed: int) -> Column:
    """A number in [0, 1) from the md5 of seed and key: the same in any engine, order or partition."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))).cast("binary"))
    return F.conv(F.substring(digest, 1, HASH_DIGITS), 16, 10).cast("long") / F.lit(float(16**HASH_DIGITS))


def cells_of(counted: DataFrame, dims: list[str]) -> DataFrame:
    """Tokens and documents of each combination of categories; null is a category like any other."""
    return counted.groupBy(*dims).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs")).where("tokens > 0")


#: Sweeps after which marginals that still move are reported, and the largest gap of settled ones.
MOST_SWEEPS, TOLERANCE = 500, 1e-9


def rake(cells: DataFrame, targets: dict[str, DataFrame], sweeps: int = MOST_SWEEPS, tolerance: float = TOLERANCE) -> DataFrame:
    """Iterative proportional fitting of ``tokens`` to the targets.

    ``targets[dim]`` has (dim, share): positive shares of each category, scaled to
    add up to one over the categories that occur. Cells of a category without a
    share get no mass. Adds ``mass`` (sum one over all cells unless no cell has
    all its shares). Stops when no marginal is off by more than the tolerance.
    Marginals that no table can meet (a pair of categories that never occurs
    together) never settle: once a sweep brings the gap down by less than a thousandth,
    or after ``sweeps`` sweeps, the last sweep's compromise stays and a warning tells the gap.
    """
    for dim, shares in targets.items():
        # The share of a category is used once per cell; cells without one leave.
        shares = shares.where("share > 0").select(F.col(dim).alias("category"), F.col("share").cast("double").alias(f"share_{dim}"))
        cells = cells.join(shares, cells[dim].eqNullSafe(F.col("category"))).drop("category")
    cells = written(cells.withColumn("mass", F.col("tokens").cast("double")), "cells")
    held = {dim: cells.groupBy(dim, f"share_{dim}").agg(F.lit(1)).agg(F.sum(f"share_{dim}")).first()[0] for dim in targets}
    before = float("inf")
    for _ in range(sweeps):
        for k, dim in enumerate(targets):
            sums = cells.groupBy(dim, f"share_{dim}").agg(F.sum("mass").alias("sum"))
            factor = F.col(f"share_{dim}") / F.lit(held[dim] or 1.0) / F.col("sum")
            sums = sums.select(F.col(dim).alias("category"), factor.alias("factor"))
            off = F.abs(F.col("factor") - 1)
            cells = cells.join(sums, cells[dim].eqNullSafe(sums["category"])).drop("category")
            cells = cells.withColumn("mass", F.col("mass") * F.col("factor")).withColumn("gap", F.greatest("gap", off) if k else off).drop("factor")
            cells = written(cells, "cells")
        worst = cells.agg(F.max("gap")).first()[0]
        cells = cells.drop("gap")
        if worst is None or worst <= tolerance:
            break
        # Rounding keeps the last digits moving; beyond it a gap that stays is one that no table meets.
        if worst > before * STALLED and (worst > 1e-6 or worst > before):
            if worst > 1e-6:
                warnings.warn(f"the targets are not met together: a marginal is off by {worst:.3g} of its share", stacklevel=2)
            break
        before = worst
    else:
        warnings.warn(f"raking has not settled in {sweeps} sweeps: a marginal is off by {worst:.3g} of its share", stacklevel=2)
    return cells.drop(*(f"share_{dim}" for dim in targets))


STALLED = 0.999
MOST_ROUNDS = 200


def probabilities(cells: DataFrame, budget: float | None = None, rounds: int = MOST_ROUNDS) -> DataFrame:
    """Adds ``probability`` of each cell: mass per token, scaled to the budget of tokens.

    Without a budget the scale is the largest at which no probability is over one,
    so the marginals are met in expectation. With one, cells at probability one
    give all they have and the others are scaled up for what is missing, until the scale
    settles. A budget that all cells with mass together cannot fill is reported.
    """
    rate = F.col("mass") / F.col("tokens")
    if budget is None:
        top = cells.agg(F.max(rate)).first()[0]
        return cells.withColumn("probability", F.least(F.lit(1.0), rate / F.lit(top or 1.0)))
    scale = float(budget)
    for _ in range(rounds):
        full = rate * scale >= 1
        sums = cells.agg(
            F.sum(F.when(full, F.col("tokens")).otherwise(0)).alias("full"), F.sum(F.when(full, 0.0).otherwise(F.col("mass"))).alias("free")
        ).first()
        if not sums["free"] or sums["full"] is None:
            if (sums["full"] or 0) < budget * (1 - 1e-9):
                warnings.warn(f"all documents of cells with mass hold {sums['full'] or 0} tokens of a budget of {budget:.0f}", stacklevel=2)
            break
        fitted = max(budget - sums["full"], 0.0) / sums["free"]
        if fitted <= scale * (1 + 1e-15):
            break
        scale = fitted
    else:
        warnings.warn(f"the scale of the draw has not settled in {rounds} rounds", stacklevel=2)
    return cells.withColumn("probability", F.least(F.lit(1.0), rate * scale))


def mixed(counted: DataFrame, targets: dict[str, DataFrame], seed: int, budget_share: float | None = None, **rake_options) -> DataFrame:
    """``counted`` with ``probability`` and ``sampled``.

    ``counted`` has doc_id, n_tokens and a column for each target; rows of one
    doc_id are drawn together, also those with a null one. Documents without
    tokens are in no cell that carries mass by them, and are drawn as the rest of
    their cell; in a cell without tokens or share the probability is zero.
    Columns named like the two new ones are replaced.
    """
    dims = list(targets)
    counted = counted.drop("probability", "sampled")
    cells = rake(cells_of(counted, dims), targets, **rake_options)
    budget = None
    if budget_share is not None:
        budget = budget_share * float(counted.agg(F.sum("n_tokens")).first()[0] or 0)
    placed = written(probabilities(cells, budget), "cells")
    keyed = placed.select(*(F.col(d).alias(f"cell_{d}") for d in dims), "probability")
    match = [counted[d].eqNullSafe(keyed[f"cell_{d}"]) for d in dims]
    out = counted.join(keyed, match, "left").drop(*(f"cell_{d}" for d in dims))
    out = out.withColumn("probability", F.coalesce("probability", F.lit(0.0)))
    return out.withColumn("sampled", uniform(F.col("doc_id"), seed) < F.col("probability"))


# Settings of the query. Sources are flattened to the power 0.7 of their tokens; the other two have fixed shares.
SEED = 17
BUDGET_SHARE = 0.5
SOURCE_POWER = 0.7
LANG_SHARES = [("de", 0.2), ("en", 0.4), ("es", 0.2), ("fr", 0.2)]
#: All other languages and rows without one together, dealt by their tokens.
OTHER_LANGS = 0.05
TOPIC_SHARES = [("contact", 0.1), ("legal", 0.05), ("prose", 0.7), ("table", 0.15)]
TOPIC_RULES = [("legal", r"(?i)licen[cs]e|copyright"), ("table", r" \| | \|\n|[#*$%&]{3}"), ("contact", r"[a-z0-9]@[a-z]|https?://")]
OTHER_TOPIC = "prose"


def topic(text: Column) -> Column:
    """The first rule that the whole text meets; a null text is prose."""
    out = F.lit(OTHER_TOPIC)
    for name, pattern in reversed(TOPIC_RULES):
        out = F.when(text.rlike(pattern), name).otherwise(out)
    return out


def counted_documents(docs: DataFrame) -> DataFrame:
    """doc_id, source, lang, topic and n_tokens of every row, written once: texts are read only here."""
    tokens = F.coalesce(F.regexp_count("text", F.lit(WORD_PATTERN)), F.lit(0)).cast("long")
    return written(docs.select("doc_id", "source", "lang", topic(F.col("text")).alias("topic"), tokens.alias("n_tokens")), "counted")


def default_targets(counted: DataFrame) -> dict[str, DataFrame]:
    """Shares of the sources by a power of their tokens, of languages and of topics; every language and null has one."""
    spark = counted.sparkSession
    sums = counted.groupBy("source").agg(F.sum("n_tokens").alias("tokens"))
    named = F.coalesce(F.col("lang").isin([lang for lang, _ in LANG_SHARES]), F.lit(False))
    others = written(counted.where(~named).groupBy("lang").agg(F.sum("n_tokens").alias("tokens")), "langs")
    whole = others.agg(F.sum("tokens")).first()[0] or 1
    others = others.select("lang", (F.col("tokens") * F.lit(OTHER_LANGS) / F.lit(whole)).alias("share"))
    return {
        "source": written(sums.select("source", F.pow(F.col("tokens").cast("double"), F.lit(SOURCE_POWER)).alias("share")), "shares"),
        "lang": spark.createDataFrame(LANG_SHARES, "lang string, share double").union(others),
        "topic": spark.createDataFrame(TOPIC_SHARES, "topic string, share double"),
    }


def mixed_documents(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, probability and draw of every row of ``docs``.

    A null text has no tokens and is prose; null sources and languages are categories.
    Repeated ids are drawn together, a null id like the word null; equal rows stay
    rows; other columns are ignored; an empty table gives an empty one.
    """
    counted = counted_documents(docs)
    return mixed(counted, default_targets(counted), seed, BUDGET_SHARE)


def sampled_documents(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The rows of ``docs`` that are drawn, with their columns as they are.

    Texts never move: the cell of a row is found again from its own columns and
    its probability comes from the small cell table. Nulls, repeats and empty tables
    are as in ``mixed_documents``; a row in a cell without tokens is not drawn.
    """
    counted = counted_documents(docs)
    targets = default_targets(counted)
    dims = list(targets)
    budget = BUDGET_SHARE * float(counted.agg(F.sum("n_tokens")).first()[0] or 0)
    placed = written(probabilities(rake(cells_of(counted, dims), targets), budget), "cells")
    keyed = placed.select(*(F.col(d).alias(f"_cell_{d}") for d in dims), F.col("probability").alias("_probability"))
    own = {"source": F.col("row.source"), "lang": F.col("row.lang"), "topic": topic(F.col("row.text"))}
    rows = docs.select(F.struct(*docs.columns).alias("row"))
    joined = rows.join(keyed, [own[d].eqNullSafe(F.col(f"_cell_{d}")) for d in dims])
    return joined.where(uniform(F.col("row.doc_id"), seed) < F.col("_probability")).select("row.*")


@query
def op1_mix_to_targets(spark, sf_dir):
    """Probability and draw of every document."""
    out = mixed_documents(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "source", "lang", "topic", "n_tokens", F.round("probability", 6).alias("probability"), "sampled")


#: Unrolled in SQL: sweeps and rounds that are enough for six digits on the given tables.
SQL_SWEEPS, SQL_ROUNDS = 80, 8


def _sql(sweeps: int = SQL_SWEEPS) -> str:
    rules = " ".join(f"WHEN regexp_matches(text, '{p.replace('(?i)', '')}'{', ' + repr('i') if '(?i)' in p else ''}) THEN '{n}'" for n, p in TOPIC_RULES)
    values = lambda rows: ", ".join(f"('{a}', {b})" for a, b in rows)
    steps = [
        f"""counted AS (SELECT doc_id, source, lang, CASE {rules} ELSE '{OTHER_TOPIC}' END AS topic,
  CAST(coalesce(len(regexp_extract_all(text, '{WORD_PATTERN}')), 0) AS BIGINT) AS n_tokens FROM documents)""",
        f"""named(lang, share) AS (VALUES {values(LANG_SHARES)}),
other AS (SELECT lang, sum(n_tokens) AS tokens FROM counted WHERE lang IS NULL OR lang NOT IN (SELECT lang FROM named) GROUP BY lang),
lang_shares AS (SELECT lang, CAST(share AS DOUBLE) AS share FROM named UNION ALL SELECT lang, {OTHER_LANGS} * tokens / sum(tokens) OVER () FROM other)""",
        f"topic_shares(topic, share) AS (VALUES {values(TOPIC_SHARES)})",
        f"source_shares AS (SELECT source, pow(sum(n_tokens), {SOURCE_POWER}) AS share FROM counted GROUP BY source)",
        """m0 AS (SELECT c.source, c.lang, c.topic, sum(n_tokens) AS tokens, CAST(sum(n_tokens) AS DOUBLE) AS mass, any_value(s.share) AS share_source,
  any_value(l.share) AS share_lang, any_value(t.share) AS share_topic FROM counted c JOIN source_shares s ON c.source IS NOT DISTINCT FROM s.source
  JOIN lang_shares l ON c.lang IS NOT DISTINCT FROM l.lang JOIN topic_shares t ON c.topic = t.topic WHERE s.share > 0 GROUP BY ALL HAVING sum(n_tokens) > 0)""",
    ]
    at = 0
    for _ in range(sweeps):
        for dim in ("source", "lang", "topic"):
            whole = f"(SELECT sum(s) FROM (SELECT any_value(share_{dim}) AS s FROM m{at} GROUP BY {dim}))"
            steps.append(
                f"m{at + 1} AS MATERIALIZED (SELECT * REPLACE (mass * share_{dim} / {whole} / sum(mass) OVER (PARTITION BY {dim}) AS mass) FROM m{at})"
            )
            at += 1
    steps.append(f"s0 AS (SELECT {BUDGET_SHARE} * (SELECT sum(n_tokens) FROM counted) AS budget, {BUDGET_SHARE} * (SELECT sum(n_tokens) FROM counted) AS scale)")
    for k in range(SQL_ROUNDS):
        full = "mass / tokens * scale >= 1"
        fitted = f"greatest(any_value(budget) - coalesce(sum(tokens) FILTER ({full}), 0), 0) / nullif(coalesce(sum(mass) FILTER (NOT ({full})), 0), 0)"
        steps.append(f"s{k + 1} AS MATERIALIZED (SELECT any_value(budget) AS budget, greatest(any_value(scale), coalesce({fitted}, 0)) AS scale FROM m{at}, s{k})")
    return f"""WITH {", ".join(steps)},
p AS (SELECT source, lang, topic, least(1.0, mass / tokens * (SELECT scale FROM s{SQL_ROUNDS})) AS probability FROM m{at}),
j AS (SELECT c.*, coalesce(p.probability, 0.0) AS p FROM counted c LEFT JOIN p
  ON c.source IS NOT DISTINCT FROM p.source AND c.lang IS NOT DISTINCT FROM p.lang AND c.topic = p.topic)
SELECT doc_id, source, lang, topic, n_tokens, round(p, 6) AS probability,
  CAST('0x' || substr(md5('{SEED}:' || doc_id), 1, {HASH_DIGITS}) AS BIGINT) / {float(16**HASH_DIGITS)!r} < p AS sampled FROM j"""


ORACLES["op1_mix_to_targets"] = _sql()
