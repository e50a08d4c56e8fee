"""Walk-forward stacked classifier on Spark ML: two boosted groups and an L1 logistic on top.

Boosted trees here and in the reference are different implementations: same layout and settings,
no numeric parity claimed. Scaling is fitted per fold (there it saw all rows).
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import RobustScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.functions.scan import row_index
from sigloom.params import ALL_FACTORS, GROUP_A, GROUP_B
from sigloom.session import materialise

META = ("p_a", "p_b", "m_vix", "m_cred", "m_term", "m_pcr")
LABEL_RETURN = 0.015


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Add ``weight`` = n / (2 n_class); two counted rows are joined back."""
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_nc"))
    total = df.agg(F.count(F.lit(1)).alias("_n"))
    w = sizes.crossJoin(F.broadcast(total)).select(label, (F.col("_n") / (2.0 * F.col("_nc"))).alias("weight"))
    return df.join(F.broadcast(w), label)  # one row per class


def expanding_folds(df: DataFrame, order: list, splits: int = 3) -> DataFrame:
    """Add ``idx`` and ``fold`` (0 = never predicted, k = test block k); block size n // (splits+1)."""
    ix = row_index(df, order)
    total = ix.agg(F.count(F.lit(1)).alias("_n"))  # one row
    size = F.floor(F.col("_n") / (splits + 1))
    first = F.col("_n") - size * splits
    k = F.when(F.col("idx") < first, 0).otherwise(F.floor((F.col("idx") - first) / size) + 1)
    return ix.crossJoin(F.broadcast(total)).withColumn("fold", k.cast("int")).drop("_n")


def purged_split(df: DataFrame, order: list, train: float = 0.75, embargo: int = 60) -> DataFrame:
    """Add ``idx`` and ``part``: train / embargo / valid, or 80/20 when too little is left."""
    ix = row_index(df, order)
    total = ix.agg(F.count(F.lit(1)).alias("_n"))  # one row
    i, n = F.col("idx"), F.col("_n")
    end = F.floor(n * train)
    short = end + embargo >= n - 10
    end = F.when(short, F.floor(n * 0.8)).otherwise(end)
    start = F.when(short, end).otherwise(end + embargo)
    part = F.when(i < end, "train").when(i >= start, "valid").otherwise("embargo")
    return ix.crossJoin(F.broadcast(total)).withColumn("part", part).drop("_n")


@dataclass
class Stack:
    oof: DataFrame
    importances: DataFrame
    group_weights: dict[str, float]
    models: dict[str, PipelineModel] = field(default_factory=dict)


def _base(columns: list[str], rounds: int) -> Pipeline:
    return Pipeline(stages=[
        VectorAssembler(inputCols=columns, outputCol="raw"),
        RobustScaler(inputCol="raw", outputCol="x", withCentering=True, withScaling=True),
        GBTClassifier(featuresCol="x", labelCol="label", weightCol="weight", maxIter=rounds, maxDepth=3,
                      stepSize=0.05, seed=42),
    ])


def fit_stack(trades: DataFrame, active: list[str], rounds: int = 60, splits: int = 3) -> Stack:
    """``trades``: sig_id, dt, ret, vix, cred, term, market_pcr and one column per active factor.

    The driver holds fold limits, two coefficients and at most 64 importances; rows stay put.
    """
    cols = {"p_a": [f for f in active if f in GROUP_A], "p_b": [f for f in active if f in GROUP_B]}
    base = trades.select(
        "sig_id", "dt", "ret", (F.col("ret") > LABEL_RETURN).cast("double").alias("label"),
        (F.col("vix") / 20.0).alias("m_vix"), F.col("cred").alias("m_cred"),
        (F.col("term") - 1.0).alias("m_term"), (F.col("market_pcr") - 1.0).alias("m_pcr"), *active)
    rows = materialise(expanding_folds(base, [F.col("dt"), F.col("sig_id")], splits))

    def fit(train: DataFrame, group: str) -> PipelineModel:
        return _base(cols[group], rounds).fit(class_weights(train))

    # a fit is some hundred short jobs, one after the other; the fits do not depend on each other
    asked = [(k, g) for k in range(1, splits + 2) for g in cols if cols[g]]
    with ThreadPool(max(len(asked), 1)) as pool:
        fitted = dict(zip(asked, pool.starmap(lambda k, g: fit(rows.where(F.col("fold") < k) if k <= splits else rows, g), asked)))

    parts = []
    for k in range(1, splits + 1):
        test = rows.where(F.col("fold") == k)
        for g in ("p_a", "p_b"):
            if cols[g]:
                out = fitted[k, g].transform(test).withColumn(g, vector_to_array("probability")[1])
                test = out.drop("raw", "x", "rawPrediction", "probability", "prediction")
            else:
                test = test.withColumn(g, F.lit(0.5))
        parts.append(test)
    oof = parts[0]
    for part in parts[1:]:
        oof = oof.unionByName(part)
    oof = materialise(oof)

    usable = oof.where("p_a > 0")
    n = usable.count()
    asm = VectorAssembler(inputCols=list(META), outputCol="meta")
    if n > 10:
        lr = LogisticRegression(featuresCol="meta", labelCol="label", weightCol="weight",
                                elasticNetParam=1.0, regParam=1.0 / n, standardization=False)
        meta = Pipeline(stages=[asm, lr]).fit(class_weights(usable))
        a, b = (float(v) for v in meta.stages[-1].coefficients.toArray()[:2])
        ea, eb = math.exp(a), math.exp(b)
        weights = {"p_a": ea / (ea + eb), "p_b": eb / (ea + eb)}
    else:
        lr = LogisticRegression(featuresCol="meta", labelCol="label", weightCol="weight", regParam=1.0 / max(
            oof.count(), 1), standardization=False)
        meta = Pipeline(stages=[asm, lr]).fit(class_weights(oof))
        weights = {"p_a": 0.5, "p_b": 0.5}

    models, share = {"meta": meta}, {}
    for g in ("p_a", "p_b"):
        if not cols[g]:
            continue
        models[g] = fitted[splits + 1, g]
        imp = models[g].stages[-1].featureImportances.toArray()
        for f, v in zip(cols[g], imp / (imp.sum() + 1e-10)):
            share[f] = share.get(f, 0.0) + float(v) * weights[g]
    listed = sorted(((f, share[f]) for f in ALL_FACTORS if share.get(f, 0.0) > 0), key=lambda x: (-x[1], x[0]))
    imps = trades.sparkSession.createDataFrame(listed, "factor string, importance double")
    return Stack(oof, imps, weights, models)


def save_models(stack: Stack, path: str) -> None:
    """The pipelines of a stack. Each base pipeline holds its list of features in its assembler."""
    for name, m in stack.models.items():
        m.write().overwrite().save(f"{path}/{name}")


def load_models(path: str, names: tuple[str, ...] = ("p_a", "p_b", "meta")) -> dict[str, PipelineModel]:
    return {n: PipelineModel.load(f"{path}/{n}") for n in names}


def features_of(model: PipelineModel) -> list[str]:
    """The input columns that a saved pipeline was fitted on, in vector order."""
    return list(model.stages[0].getInputCols())


def probability(models: dict[str, PipelineModel], rows: DataFrame) -> DataFrame:
    """``rows`` (the factors of both groups, m_vix, m_cred, m_term, m_pcr) with ``ai_prob`` of the loaded stack."""
    for g in ("p_a", "p_b"):
        if g in models:
            out = models[g].transform(rows).withColumn(g, vector_to_array("probability")[1])
            rows = out.drop("raw", "x", "rawPrediction", "probability", "prediction")
        else:
            rows = rows.withColumn(g, F.lit(0.5))
    out = models["meta"].transform(rows).withColumn("ai_prob", vector_to_array("probability")[1])
    return out.drop("meta", "rawPrediction", "probability", "prediction")


def enough_trades(trades: DataFrame, n: int = 30) -> bool:
    """Whether there are the trades that a stack needs."""
    return trades.limit(n).count() >= n
