"""Mixing sources to target weights (operator 9): iterative proportional fitting.

Documents are summed to cells of (source, language, topic). Raking scales the cells' token weights
to the target share of every source, language and topic in turn. A document's rate is its cell's
raked weight over the cell's tokens, times the token budget: whole copies, and one more with
the probability that is left, decided by a hash of the id.

Every value is raked for itself, however rare. The cells are a stored table, and every step of raking is a
sum per value and a join in Spark, so neither cells nor values reach the driver.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatweave.llm.common import release, store

MARGINS = ("source", "lang", "topic")
SWEEPS = 10
#: Exponent of observed shares: 1 keeps the mix, 0 makes all values of a margin equal.
TEMPER = 0.7
#: Tokens to sample as a share of the tokens there are.
BUDGET = 0.5
WORD = "[^\\\\x09-\\\\x0D\\\\x20]+"


def n_tokens(text: Column) -> Column:
    """Words and one end."""
    return F.regexp_count(text, F.lit(WORD.replace("\\\\", "\\"))).cast("long") + 1


def topic(text: Column, tokens: Column) -> Column:
    """A topic by form, for tables without one."""
    return (
        F.when(text.contains("|"), "table")
        .when(text.contains("!!") | text.contains("***"), "noise")
        .when(tokens <= 100, "note")
        .when(text.contains("@") | text.contains("://"), "contact")
        .otherwise("prose")
    )


def described(docs: DataFrame, *more: Column) -> DataFrame:
    """(doc_id, source, lang, topic, tokens) and ``more``; null source or language is the value "unknown"."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("source").cast("string"), F.lit("unknown")).alias("source"),
        F.coalesce(F.col("lang").cast("string"), F.lit("unknown")).alias("lang"),
        text.alias("text"),
        n_tokens(text).alias("tokens"),
        *more,
    ).withColumn("topic", topic(F.col("text"), F.col("tokens"))).drop("text")


def tempered_targets(cells: pd.DataFrame, margin: str, temper: float = TEMPER) -> dict[str, float]:
    """Shares of the values of a margin, flattened."""
    raised = cells.groupby(margin)["tokens"].sum() ** temper
    return (raised / raised.sum()).to_dict()


def rake(cells: pd.DataFrame, targets: dict[str, dict[str, float]], sweeps: int = SWEEPS) -> np.ndarray:
    """Weights of ``cells`` (source, lang, topic, tokens) raked to the targets of each margin in turn.

    The plain form of ``cell_rates``, for cells that fit one process. Cells whose value has no target get weight 0.
    """
    weight = cells["tokens"].to_numpy(float)
    coded = {m: pd.factorize(cells[m]) for m in MARGINS}
    for _ in range(sweeps):
        for m, (code, values) in coded.items():
            sums = np.bincount(code, weight, minlength=len(values))
            wanted = np.array([targets[m].get(v, 0.0) for v in values])
            weight = weight * np.divide(wanted, sums, out=np.zeros_like(wanted), where=sums > 0)[code]
    return weight


def chance(doc_id: Column) -> Column:
    """A number from 0 to 1 (exclusive) by the id."""
    head = F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 8)
    return F.conv(head, 16, 10).cast("double") / F.lit(4294967296.0)


def target_shares(cells: DataFrame, margin: str, targets: dict[str, dict[str, float]] | None) -> DataFrame:
    """(margin, target): the shares asked for, or the tempered ones of all values of ``cells``."""
    if targets and margin in targets:
        rows = [(v, float(share)) for v, share in targets[margin].items()]
        return cells.sparkSession.createDataFrame(rows, f"{margin} string, target double")
    raised = cells.groupBy(margin).agg(F.pow(F.sum("tokens").cast("double"), F.lit(TEMPER)).alias("raised"))
    return raised.join(raised.agg(F.sum("raised").alias("whole"))).select(margin, (F.col("raised") / F.col("whole")).alias("target"))


def cell_rates(
    facts: DataFrame, targets: dict[str, dict[str, float]] | None, budget: float, sweeps: int
) -> DataFrame:
    """(source, lang, topic, rate) of every cell of ``facts``, stored.

    Each step scales the weights to one margin: a sum per value, which Spark reduces before it shuffles, and a
    join with the cells. Steps are stored, as each reads the one before twice.
    """
    cells = store(facts.groupBy(*MARGINS).agg(F.sum("tokens").alias("tokens")))
    shares = {m: store(target_shares(cells, m, targets)) for m in MARGINS}
    whole = cells.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    weights = cells.withColumn("weight", F.col("tokens").cast("double"))
    for _ in range(sweeps):
        for m in MARGINS:
            sums = weights.groupBy(m).agg(F.sum("weight").alias("sum"))
            factor = F.when(F.col("sum") > 0, F.coalesce("target", F.lit(0.0)) / F.col("sum")).otherwise(0.0)
            factors = sums.join(shares[m], m, "left").select(m, factor.alias("factor"))
            scaled = weights.join(factors, m).select(*MARGINS, "tokens", (F.col("weight") * F.col("factor")).alias("weight"))
            before, weights = weights, store(scaled)
            release(before)
    for done in (cells, *shares.values()):
        release(done)
    rate = F.round(F.lit(budget * whole) * F.col("weight") / F.col("tokens"), 9)
    return weights.select(*MARGINS, rate.alias("rate"))


def decided(facts: DataFrame, rates: DataFrame) -> DataFrame:
    """``facts`` with the rate of their cell and the copies that each row gets."""
    left = F.col("rate") - F.floor("rate")
    return facts.join(rates, list(MARGINS)).withColumn("copies", F.floor("rate") + (chance(F.col("doc_id")) < left).cast("long"))


def mix(
    docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, budget: float = BUDGET, sweeps: int = SWEEPS
) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, source, lang): its cell, rate and copies.

    ``targets`` (margin: value: share) default, for each margin, to tempered shares of what is there;
    values that a given margin does not name get rate 0. ``rate`` is
    rounded to nine digits before the decision. Null text is empty (one token, its end); repeated
    rows get equal decisions; other columns are ignored; an empty table gives no rows.
    """
    facts = store(described(docs))
    placed = decided(facts, cell_rates(facts, targets, budget, sweeps))
    return placed.select("doc_id", *MARGINS, "tokens", "rate", "copies")


def copied(
    docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, budget: float = BUDGET, sweeps: int = SWEEPS
) -> DataFrame:
    """The rows of ``docs``, all columns, each as often as ``mix`` says. Nothing is joined on the id."""
    rates = cell_rates(described(docs), targets, budget, sweeps)
    placed = decided(described(docs, F.struct("*").alias("row")), rates)
    each = F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))
    return placed.where("copies > 0").select("row", each.alias("copy")).select("row.*")


def mix_sql(sweeps: int = SWEEPS, temper: float = TEMPER, budget: float = BUDGET) -> str:
    """DuckDB SQL for the rows of ``mix`` on ``documents``."""
    word = WORD.replace("\\\\", "\\")
    parts = [
        f"""texts AS (
          SELECT doc_id, coalesce(source, 'unknown') AS source, coalesce(lang, 'unknown') AS lang, coalesce(text, '') AS text,
                 CAST(len(regexp_extract_all(coalesce(text, ''), '{word}')) AS BIGINT) + 1 AS tokens
          FROM documents)""",
        """facts AS (
          SELECT doc_id, source, lang, tokens,
                 CASE WHEN contains(text, '|') THEN 'table' WHEN contains(text, '!!') OR contains(text, '***') THEN 'noise'
                      WHEN tokens <= 100 THEN 'note' WHEN contains(text, '@') OR contains(text, '://') THEN 'contact'
                      ELSE 'prose' END AS topic
          FROM texts)""",
        """w0 AS (
          SELECT source, lang, topic, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(tokens) AS DOUBLE) AS weight
          FROM facts GROUP BY ALL)""",
    ]
    for m in MARGINS:
        parts.append(
            f"""t_{m} AS (
              SELECT {m}, raised / sum(raised) OVER () AS target
              FROM (SELECT {m}, pow(CAST(sum(tokens) AS DOUBLE), {temper}) AS raised FROM w0 GROUP BY ALL))"""
        )
    k = 0
    for _ in range(sweeps):
        for m in MARGINS:
            parts.append(
                f"""w{k + 1} AS MATERIALIZED (
                  SELECT source, lang, topic, tokens, weight * (target / sum(weight) OVER (PARTITION BY {m})) AS weight
                  FROM w{k} JOIN t_{m} USING ({m}))"""
            )
            k += 1
    parts.append(
        f"""rates AS (
          SELECT source, lang, topic, round({budget} * (SELECT sum(tokens) FROM w0) * weight / tokens, 9) AS rate FROM w{k})"""
    )
    return f"""
    WITH {", ".join(parts)}
    SELECT doc_id, source, lang, topic, tokens, rate,
           CAST(floor(rate) AS BIGINT) + CASE
             WHEN CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS UBIGINT) / 4294967296.0 < rate - floor(rate)
             THEN 1 ELSE 0 END AS copies
    FROM facts JOIN rates USING (source, lang, topic)"""
