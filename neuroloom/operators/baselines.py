"""Stored baselines of motif intensity and coherence, and Z against them.

motif_baselines(model, session, stimulus, smt, rep, n, intensity, coherence, replicas): a folder for each null model; only types that a replica
has are stored, ``replicas`` tells of how many.  A filter on model reads that folder alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import motifs, nullmodels

MODELS = ("random", "degree", "pair", "signed_pair")
STORED = "session string, stimulus string, smt string, rep int, n long, intensity double, coherence double, replicas int, model string"
GRAPH = ["session", "stimulus"]


def store(edges: DataFrame, nodes: DataFrame, path: str, models: tuple[str, ...] = MODELS, replicas: int = 200) -> None:
    """Draw ``replicas`` of every graph by each model and write their censuses.  A model stored again replaces its folder only."""
    for model in models:
        drawn = nullmodels.dealt_weights(replicas)(edges=edges) if model == "dealt" else nullmodels.random_graphs(edges, nodes, model, replicas)
        found = motifs.replica_census(drawn).where("n > 0").select(*GRAPH, "smt", "rep", "n", "intensity", "coherence", F.lit(replicas).alias("replicas"))
        found.write.mode("overwrite").parquet(f"{path}/model={model}")


def stored(spark: SparkSession, path: str, *models: str) -> DataFrame:
    """The baselines of the models named, or of all."""
    found = spark.read.schema(STORED).option("basePath", path).parquet(path)
    return found.where(F.col("model").isin(*models)) if models else found


def _moments(name: str) -> list[Column]:
    """Mean and population deviation over all replicas, those without the type counting 0."""
    k, size = F.count(name), F.max("replicas")
    mean = F.avg(name) * k / size
    spread = k * (F.var_pop(name) + F.pow(F.avg(name) - mean, F.lit(2))) + (size - k) * F.pow(mean, F.lit(2))
    return [mean.alias(f"{name}_mean"), F.sqrt(spread / size).alias(f"{name}_std")]


def zscores(census: DataFrame, baselines: DataFrame) -> DataFrame:
    """By model, session, stimulus and type: intensity and coherence with mean, population deviation and Z of the baseline.

    ``census`` has all types of every graph.  Rows are the types that some graph or some replica of the model has.  Where a graph's replicas never have
    the type, its intensity is taken to be one 5 among zeros, its coherence 0 throughout.  Z is null where the deviation is 0 (below 1e-6).
    A graph without baselines counts as one whose replicas have no type; no baselines give no rows.
    """
    known = baselines.groupBy("model", *GRAPH, "smt").agg(*_moments("intensity"), *_moments("coherence"))
    sizes = F.broadcast(baselines.groupBy("model").agg(F.max("replicas").alias("size")))  # a row a model
    every = census.crossJoin(sizes)
    seen = known.select("model", "smt").union(every.where("n > 0").select("model", "smt")).dropDuplicates()
    rows = every.join(seen, ["model", "smt"], "left_semi").join(known, ["model", *GRAPH, "smt"], "left")
    size = F.col("size")
    filled = {"intensity_mean": 5 / size, "intensity_std": F.sqrt(25 / size - 25 / (size * size)), "coherence_mean": F.lit(0.0), "coherence_std": F.lit(0.0)}
    rows = rows.withColumns({c: F.coalesce(c, v) for c, v in filled.items()})
    z = lambda c: F.when(F.col(f"{c}_std") > 1e-6, (F.col(c) - F.col(f"{c}_mean")) / F.col(f"{c}_std")).alias(f"{c}_z")
    both = [c for name in ("intensity", "coherence") for c in (name, f"{name}_mean", f"{name}_std", z(name))]
    return rows.select("model", *GRAPH, "smt", *both)


def over_sessions(scores: DataFrame) -> DataFrame:
    """By model, stimulus and type: means over sessions of all columns of ``zscores`` (null Z passed over), and the sample deviation of the intensity's Z."""
    means = [F.avg(f"{name}{part}").alias(f"{name}{part}") for name in ("intensity", "coherence") for part in ("", "_mean", "_std", "_z")]
    return scores.groupBy("model", "stimulus", "smt").agg(*means, F.stddev_samp("intensity_z").alias("intensity_z_std"))


def rounded(scores: DataFrame) -> DataFrame:
    """Means and deviations to six digits, Z to five."""
    digits = lambda c: 5 if "_z" in c else 6
    return scores.select([(F.round(c, digits(c)) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in scores.dtypes])
