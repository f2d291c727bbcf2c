"""Mixing sources to target weights by iterative proportional fitting.

Documents are counted in cells, one for each combination of source, language and
topic. The cells' token weights are raked: scaled so that the sums by source match
their targets, then those by language, then those by topic, and again. A document is
then sampled with the probability its cell needs to reach its weight.

Everything is DataFrame functions; the cell table is an aggregate and small, and the
documents are never shuffled: a cell's probability comes to them in a join with it.
Null is a value like any other. A cell without tokens has no weight, and its
documents are sampled at the overall rate. A cell that would need more than it has is
taken whole; with ``within`` this limit holds in every scaling, so that the cells with
tokens to spare take up what full cells cannot, and only targets beyond all cells of a
value stay out of reach. The sample depends on the id alone: rows that share one stay or go
together where their cells agree. An empty table gives an empty table. The columns
read are doc_id, text and the dimensions; others pass through under their names.
"""

import logging
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelspark.session import land

WORD = r"[^\x20\x09-\x0D]+"
#: How far each dimension's target keeps to the corpus: 1 is its own share of tokens, 0 an equal share.
TARGETS = {"source": 0.5, "lang": 0.7, "topic": 0.8}
RATE = 0.5
SWEEPS = 12
CELLS_A_TASK = 500_000
SEED = "mix"
LOGGED = 20  # targets out of reach

log = logging.getLogger(__name__)


def tokens(text: Column) -> Column:
    """The number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def topic(text: Column) -> Column:
    """A topic by form: tables, marked-up text, texts with addresses, notes, long reads and prose."""
    return (
        F.when(text.contains(" | "), "table")
        .when(text.contains("%%%"), "marked")
        .when(text.contains("@") | text.contains("http"), "contact")
        .when(F.coalesce(F.length(text), F.lit(0)) < 400, "note")
        .when(F.length(text) >= 4000, "long")
        .otherwise("prose")
    )


def smoothed_shares(cells: DataFrame, targets: dict[str, float]) -> DataFrame:
    """The cells with a column <dimension>_share each: its value's token sum to a power, as a share of all such."""

    def raised(total, power):
        return F.when(total > 0, F.pow(total.cast("double"), F.lit(power))).otherwise(F.lit(0.0))

    wholes = [
        cells.groupBy(k).agg(F.sum("tokens").alias("sum")).select(F.lit(k).alias("k"), raised(F.col("sum"), power).alias("v"))
        for k, power in targets.items()
    ]
    whole = reduce(DataFrame.union, wholes).groupBy("k").agg(F.sum("v").alias("v"))
    whole = {r["k"]: r["v"] for r in whole.collect()}  # one number for each dimension
    own = {k: raised(F.sum("tokens").over(Window.partitionBy(k)), power) for k, power in targets.items()}
    return cells.select("*", *[(own[k] / F.nullif(F.lit(whole.get(k, 0.0)), F.lit(0.0))).alias(f"{k}_share") for k in targets])


def rake(cells: DataFrame, dimensions: list[str], sweeps: int = SWEEPS, wanted: float | None = None) -> DataFrame:
    """The cells' ``tokens`` scaled to a ``weight`` whose sums by each dimension approach its <dimension>_share.

    With ``wanted``, the tokens of the whole sample, no weight passes the share of them that its cell has.
    """
    kept = cells.columns
    cells = cells.select("*", F.col("tokens").cast("double").alias("weight"))
    for _ in range(sweeps):
        for k in dimensions:
            total = F.sum("weight").over(Window.partitionBy(k))
            scaled = F.col("weight") * F.col(f"{k}_share") / F.nullif(total, F.lit(0.0))
            if wanted is not None:
                limit = F.col("tokens") / F.nullif(F.lit(float(wanted)), F.lit(0.0))
                scaled = F.least(limit, F.coalesce(scaled, F.lit(0.0)))
            cells = cells.select(*kept, F.coalesce(scaled, F.lit(0.0)).alias("weight"))
    return cells


def out_of_reach(fitted: DataFrame, dimensions: list[str], least: float = 0.01) -> DataFrame:
    """(dimension, value, target, reached): the shares that raked cells miss by more than ``least`` of the target."""
    sums = [
        fitted.groupBy(F.lit(k).alias("dimension"), F.col(k).cast("string").alias("value"))
        .agg(F.first(f"{k}_share").alias("target"), F.sum("weight").alias("reached"))
        for k in dimensions
    ]
    return reduce(DataFrame.union, sums).where(F.abs(F.col("reached") - F.col("target")) > F.lit(least) * F.col("target"))


def uniform(doc_id: Column, seed: str = SEED) -> Column:
    """A number from 0 to below 1 that depends on the id alone."""
    digest = F.md5(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def sampled(
    spark: SparkSession,
    documents: DataFrame,
    targets: dict[str, float] = TARGETS,
    rate: float = RATE,
    sweeps: int = SWEEPS,
    within: bool = False,
) -> DataFrame:
    """documents with a last column ``mixing``: topic, tokens, probability, and whether the row is in the sample.

    With ``within`` the targets that are still missed by a hundredth are logged, the furthest first.
    """
    own = {"source": F.col("source"), "lang": F.col("lang"), "topic": topic(F.col("text"))}
    keys = list(targets)
    counted = documents.select(*[own[k].alias(k) for k in keys], tokens(F.col("text")).alias("tokens"))
    cells = land(counted.groupBy(*keys).agg(F.sum("tokens").alias("tokens")), spark, "mixing-cells")
    total, n_cells = cells.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.count("*")).first()
    # cells in one task need no exchange between the scalings
    few = cells.coalesce(max(1, -(-n_cells // CELLS_A_TASK)))
    fitted = rake(smoothed_shares(few, targets), keys, sweeps, rate * total if within else None)
    if within:
        fitted = land(fitted, spark, "mixing-fitted")
        for r in out_of_reach(fitted, keys).orderBy(F.desc(F.abs(F.col("reached") - F.col("target")))).limit(LOGGED).collect():
            log.warning("%s %s: %.4f of the tokens wanted, %.4f reached", r["dimension"], r["value"], r["target"], r["reached"])
    needed = F.lit(rate * total) * F.col("weight") / F.nullif("tokens", F.lit(0))
    chances = land(
        fitted.select(*[F.col(k).alias(f"cell_{k}") for k in keys], F.coalesce(F.least(F.lit(1.0), needed), F.lit(rate)).alias("probability")),
        spark,
        "mixing-chances",
    )
    row = F.struct("*").alias("row")
    keyed = documents.select(row, *[own[k].alias(f"key_{k}") for k in keys])
    same = [keyed[f"key_{k}"].eqNullSafe(chances[f"cell_{k}"]) for k in keys]
    met = keyed.join(chances, same, "left")
    fields = [F.col("row").getField(c).alias(c) for c in documents.columns]
    mixing = F.struct(
        F.col("key_topic").alias("topic") if "topic" in targets else F.lit(None).cast("string").alias("topic"),
        tokens(F.col("row").getField("text")).alias("tokens"),
        F.col("probability"),
        (uniform(F.col("row").getField("doc_id")) < F.col("probability")).alias("kept"),
    )
    return met.select(*fields, mixing.alias("mixing"))


def oracle(targets: dict[str, float] = TARGETS, rate: float = RATE, sweeps: int = SWEEPS, seed: str = SEED) -> str:
    """The same in SQL: one step for each scaling."""
    keys = list(targets)
    on = " AND ".join(f"d.{k} IS NOT DISTINCT FROM c.{k}" for k in keys)
    steps = [
        f"""d AS (SELECT doc_id, source, lang, CASE WHEN contains(text, ' | ') THEN 'table' WHEN contains(text, '%%%') THEN 'marked'
 WHEN contains(text, '@') OR contains(text, 'http') THEN 'contact' WHEN coalesce(length(text), 0) < 400 THEN 'note'
 WHEN length(text) >= 4000 THEN 'long' ELSE 'prose' END AS topic,
 coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS tokens FROM documents)""",
        f"cells AS (SELECT {', '.join(keys)}, CAST(sum(tokens) AS DOUBLE) AS tokens FROM d GROUP BY ALL)",
    ]
    for k, power in targets.items():
        steps.append(f"s_{k} AS (SELECT {k}, CASE WHEN sum(tokens) > 0 THEN pow(sum(tokens), {power}) ELSE 0 END AS raised FROM cells GROUP BY {k})")
    joins = " ".join(f"LEFT JOIN s_{k} ON c.{k} IS NOT DISTINCT FROM s_{k}.{k}" for k in keys)
    shares = ", ".join(f"s_{k}.raised / (SELECT sum(raised) FROM s_{k}) AS {k}_share" for k in keys)
    steps.append(f"w0 AS MATERIALIZED (SELECT c.*, {shares}, tokens AS weight FROM cells c {joins})")
    for i in range(sweeps * len(keys)):
        k = keys[i % len(keys)]
        new = f"coalesce(weight * {k}_share / nullif(sum(weight) OVER (PARTITION BY {k}), 0), 0) AS weight"
        steps.append(f"w{i + 1} AS (SELECT * REPLACE ({new}) FROM w{i})")
    steps.append(f"""c AS MATERIALIZED (SELECT *, coalesce(least(1.0, {rate} * (SELECT sum(tokens) FROM cells) * weight / nullif(tokens, 0)), {rate}) AS probability
 FROM w{sweeps * len(keys)})""")
    return f"""WITH {', '.join(steps)}
SELECT d.doc_id, d.source, d.lang, d.topic, CAST(d.tokens AS BIGINT) AS n_tokens, round(c.probability, 9) AS probability,
 CAST('0x' || substr(md5('{seed}' || coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) / 4294967296.0 < c.probability AS kept
FROM d JOIN c ON {on}"""
