"""Operator 2: mixing sources to target weights by iterative proportional fitting, in DataFrame operations only.

Documents are summed to cells of (source, language, topic). A cell's weight is a product of three factors, one for each
value. Each round rakes the weights to the three target marginals in turn: the cells meet the factors of the two other
dimensions, a group-by (summed before it shuffles) gives a marginal's tokens without the own factor, and target over
that is the new factor. Cells are summed once and never rewritten; a step writes its factors, a row a value, to a table
in the shared folder; `largest_gap` tells how near the targets are. A document is then kept with its cell's
probability, by a number drawn from the hash of its id, so every rerun keeps the same ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

ROUNDS = 12
NONE = "<none>"  # stands for a null source, language or topic
TEMPER = {"source": 0.7, "lang": 0.5, "topic": 0.8}
DIGITS = 6
MADE = {"mix_topic", "mix_tokens", "mix_weight", "mix_probability", "mix_kept"}


def topic_of(text: Column) -> Column:
    """A coarse topic by form: the first rule that holds."""
    rules = (("empty", F.coalesce(F.trim(text), F.lit("")) == ""), ("table", F.contains(text, F.lit(" | "))), ("shout", F.contains(text, F.lit("!!"))), ("markup", F.contains(text, F.lit("###"))), ("short", F.length(text) < 600), ("long", F.length(text) >= 4000))
    out = F.when(rules[0][1], F.lit(rules[0][0]))
    for name, rule in rules[1:]:
        out = out.when(rule, F.lit(name))
    return out.otherwise(F.lit("prose"))


def words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def tempered(cells: DataFrame, column: str, power: float) -> DataFrame:
    """(value, target): shares of tokens raised to a power and scaled to sum to one."""
    sums = cells.groupBy(column).agg(F.sum("tokens").cast("double").alias("s")).where("s > 0")
    whole = sums.agg(F.sum(F.pow("s", F.lit(power))).alias("whole"))  # one row
    return sums.join(F.broadcast(whole)).select(F.col(column), (F.pow("s", F.lit(power)) / F.col("whole")).alias("target"))


def _weighed(cells: DataFrame, factors: dict[str, DataFrame]) -> tuple[DataFrame, Column]:
    """(cells beside the factors of some dimensions, the factors' product)."""
    weight = F.lit(1.0)
    for d, f in factors.items():
        cells = cells.join(f.select(d, F.col("factor").alias(f"of_{d}")), d, "left")
        weight = weight * F.coalesce(f"of_{d}", F.lit(1.0))
    return cells, weight


def calibrate(cells: DataFrame, targets: dict[str, DataFrame], rounds: int = ROUNDS) -> DataFrame:
    """cells (dimension columns, tokens) with weight: after `rounds` rounds of raking the weighted tokens follow the targets (column, target).

    Values without a target or without tokens keep a factor of 1.
    """
    dims = list(targets)
    cells = materialise(cells.select(*dims, "tokens"), "cells")
    whole = F.lit(float(cells.agg(F.sum("tokens")).first()[0] or 0))
    goals = {d: materialise(t.select(d, (F.col("target") * whole).alias("goal")), f"target-{d}") for d, t in targets.items()}
    factors: dict[str, DataFrame] = {}
    for _ in range(rounds):
        for d in dims:
            held, weight = _weighed(cells, {x: f for x, f in factors.items() if x != d})
            sums = held.groupBy(d).agg(F.sum(F.col("tokens") * weight).alias("sum")).where("sum > 0")
            factors[d] = materialise(sums.join(goals[d], d).select(d, (F.col("goal") / F.col("sum")).alias("factor")), "factors")
    held, weight = _weighed(cells, factors)
    return held.select(*dims, "tokens", weight.alias("weight"))


def largest_gap(cells: DataFrame, targets: dict[str, DataFrame]) -> DataFrame:
    """(dim, gap): how far the weighted shares of calibrated cells are from the targets of each dimension, at most."""
    whole = cells.agg(F.sum(F.col("weight") * F.col("tokens")).alias("whole"))  # one row
    out = None
    for d, t in targets.items():
        share = cells.groupBy(d).agg(F.sum(F.col("weight") * F.col("tokens")).alias("now")).join(F.broadcast(whole))
        part = share.join(t, d).agg(F.lit(d).alias("dim"), F.max(F.abs(F.col("now") / F.col("whole") - F.col("target"))).alias("gap"))
        out = part if out is None else out.unionByName(part)
    return out


def draw(doc_id: Column) -> Column:
    """A number in [0, 1) from the id alone (null: as the text '')."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def mix(docs: DataFrame, temper: dict[str, float] | None = None, targets: dict[str, DataFrame] | None = None, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topic: Column | None = None) -> DataFrame:
    """Per document: all columns of docs, and mix_topic, mix_tokens, mix_weight, mix_probability, mix_kept (which replace columns of these names).

    Targets per dimension (source, lang, topic) are given as (dimension, target) tables or made by tempering the
    present shares. weight is the cell's, relative to a mean of 1 over tokens; probability is weight over the
    largest weight, rounded to DIGITS digits, so that expected kept tokens follow the targets exactly; kept says
    whether the draw is below it. Null dimensions are a value of their own; null texts have no tokens; equal ids
    share a draw; no rows give no rows.
    """
    temper = temper or TEMPER
    names = [c for c in docs.columns if c not in MADE]
    text = F.col(text_col).cast("string")
    dims = {"source": F.coalesce(F.col(source_col).cast("string"), F.lit(NONE)), "lang": F.coalesce(F.col(lang_col).cast("string"), F.lit(NONE)), "topic": F.coalesce(topic_of(text) if topic is None else topic, F.lit(NONE))}
    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)], *[v.alias(d) for d, v in dims.items()], words_of(text).alias("tokens"), draw(F.col(id_col)).alias("draw"))
    cells = materialise(rows.groupBy(*dims).agg(F.sum("tokens").alias("tokens")), "cells")
    given = targets or {}
    goals = {d: given[d] if d in given else tempered(cells, d, temper[d]) for d in dims}
    fitted = calibrate(cells, goals, rounds)
    top = fitted.where("tokens > 0").agg(F.max("weight").alias("top"))  # one row
    chance = F.round(F.least(F.lit(1.0), F.col("weight") / F.coalesce("top", F.lit(1.0))), DIGITS)
    fitted = materialise(fitted.join(F.broadcast(top), how="left").select(*dims, F.round("weight", DIGITS).alias("weight"), chance.alias("probability")), "fitted")
    made = [F.col(x).alias(f"mix_{x}") for x in ("topic", "tokens", "weight", "probability")]
    return rows.join(fitted, list(dims)).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], *made, (F.col("draw") < F.col("probability")).alias("mix_kept"))


def mix_sql(rounds: int = ROUNDS, temper: dict[str, float] | None = None) -> str:
    """The same over the table `documents` in DuckDB SQL."""
    temper = temper or TEMPER
    ctes = [
        f"""rows AS (SELECT doc_id, coalesce(source, '{NONE}') AS source, coalesce(lang, '{NONE}') AS lang,
        CASE WHEN coalesce(trim(text), '') = '' THEN 'empty' WHEN contains(text, ' | ') THEN 'table' WHEN contains(text, '!!') THEN 'shout'
             WHEN contains(text, '###') THEN 'markup' WHEN length(text) < 600 THEN 'short' WHEN length(text) >= 4000 THEN 'long' ELSE 'prose' END AS topic,
        CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS tokens FROM documents)""",
        "c0 AS (SELECT source, lang, topic, CAST(sum(tokens) AS DOUBLE) AS tokens, 1.0::DOUBLE AS weight FROM rows GROUP BY ALL)",
        "whole AS (SELECT sum(tokens) AS whole FROM c0)",
    ]
    for d, power in temper.items():
        ctes.append(f"s_{d} AS (SELECT {d}, sum(tokens) AS s FROM c0 GROUP BY {d} HAVING sum(tokens) > 0)")
        ctes.append(f"t_{d} AS (SELECT {d}, pow(s, {power}) / sum(pow(s, {power})) OVER () AS target FROM s_{d})")
    k = 0
    for _ in range(rounds):
        for d in temper:
            ctes.append(f"m{k} AS MATERIALIZED (SELECT {d}, sum(weight * tokens) AS now FROM c{k} GROUP BY {d})")
            ctes.append(f"c{k + 1} AS MATERIALIZED (SELECT c.source, c.lang, c.topic, c.tokens, c.weight * coalesce(t.target * (SELECT whole FROM whole) / nullif(m.now, 0), 1.0) AS weight FROM c{k} c LEFT JOIN m{k} m USING ({d}) LEFT JOIN t_{d} t USING ({d}))")
            k += 1
    return (
        "WITH " + ",\n".join(ctes) + f""",
    top AS (SELECT max(weight) AS top FROM c{k} WHERE tokens > 0),
    f AS (SELECT source, lang, topic, round(weight, {DIGITS}) AS weight, round(least(1.0, weight / coalesce((SELECT top FROM top), 1.0)), {DIGITS}) AS probability FROM c{k})
    SELECT r.doc_id, r.source, r.lang, r.topic, r.tokens AS n_tokens, f.weight, f.probability,
        CAST(('0x' || substr(md5(coalesce(CAST(r.doc_id AS VARCHAR), '')), 1, 8)) AS UBIGINT) / 4294967296.0 < f.probability AS kept
    FROM rows r JOIN f USING (source, lang, topic)"""
    )
