"""A trained model of pauses: source-disjoint split, fit, scores of gaps, held-out figures."""

from __future__ import annotations

from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.shared import written

# Classes of gaps in order, those that may be removed, and the least number of labelled rows.
CLASSES = ["breath_pause", "waiting_pause", "sentence_pause", "normal_word_gap", "nonspeech_unknown", "speaker_transition"]
REMOVABLE = ["breath_pause", "waiting_pause"]
LEAST_ROWS = 200
FEATURES = ["duration_s", "speaker_change", "ends_sentence", "ends_clause", "starts_filler", "ends_filler", "pre_rate", "post_rate", "rel_pos"]


def _share(*parts: Column) -> Column:
    """A number from 0 to 1 from the hash of the parts."""
    name = F.concat_ws(":", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("long") / 4294967296.0


def source_split(labelled: DataFrame, test_share: float = 0.20, trials: int = 50) -> DataFrame:
    """The rows (source_id, gap_idx, label and more) with held_out: no source is on both sides.

    Of ``trials`` hashed splits the best has the most classes among its training rows, then the share of held-out rows nearest
    ``test_share``, then the least number. The trials are scored from counts by source and label, never from rows. Where every trial leaves a
    side empty (one source, say), rows are split by the hash of source and gap.
    """
    counts = labelled.groupBy("source_id", "label").agg(F.count("*").alias("n"))
    dealt = counts.withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(trials - 1)))).withColumn("held", _share(F.col("source_id"), F.col("trial")) < test_share)
    kept = F.sum(F.when(~F.col("held"), F.col("n")).otherwise(0))
    by_class = dealt.groupBy("trial", "label").agg(kept.alias("kept"), F.sum("n").alias("n"))
    coverage = F.sum((F.col("kept") > 0).cast("int")) / F.count("*")
    share = F.sum(F.col("n") - F.col("kept")) / F.sum("n")
    scored = by_class.groupBy("trial").agg((coverage * 10.0 - F.abs(share - test_share)).alias("score"), share.alias("share")).filter("share > 0 and share < 1")
    # one row
    best = scored.agg(F.max_by("trial", F.struct("score", -F.col("trial"))).alias("_trial"))
    held = F.when(F.col("_trial").isNull(), _share(F.col("source_id"), F.col("gap_idx")) < test_share).otherwise(_share(F.col("source_id"), F.col("_trial")) < test_share)
    return labelled.crossJoin(F.broadcast(best)).withColumn("held_out", held).drop("_trial")


def _ready(rows: DataFrame, features: list[str]) -> DataFrame:
    return rows.fillna(0.0, features)


def train_pause_model(labelled: DataFrame, features: list[str] | None = None, binary: bool = False, trees: int = 40, depth: int = 8, seed: int = 42) -> PipelineModel:
    """A model of the classes (a forest) or, if ``binary``, of removable or not (boosted trees), fit by Spark on all rows with a known label.

    Unmeasured features count as 0. Fewer than LEAST_ROWS such rows are refused with a ValueError.
    """
    features = features or FEATURES
    known = _ready(labelled.filter(F.col("label").isin(CLASSES)), features)
    index = F.array_position(F.array(*map(F.lit, CLASSES)), F.col("label")) - 1
    target = F.col("label").isin(REMOVABLE) if binary else index
    rows = known.select(*features, target.cast("double").alias("target"))
    n = rows.count()
    if n < LEAST_ROWS:
        raise ValueError(f"{n} labelled gaps, at least {LEAST_ROWS} are needed")
    assembler = VectorAssembler(inputCols=features, outputCol="_features")
    common = {"featuresCol": "_features", "labelCol": "target", "seed": seed}
    model = GBTClassifier(maxIter=trees, maxDepth=min(depth, 5), **common) if binary else RandomForestClassifier(numTrees=trees, maxDepth=depth, **common)
    return Pipeline(stages=[assembler, model]).fit(rows)


def score_gaps(gaps: DataFrame, model: PipelineModel, threshold: float = 0.65, features: list[str] | None = None) -> DataFrame:
    """Gaps with p_removable (of the removable classes together, 0 to 1), removable (p_removable >= threshold) and, of a model of the classes, predicted."""
    out = model.transform(_ready(gaps, features or FEATURES)).withColumn("_p", vector_to_array("probability"))
    if isinstance(model.stages[-1], GBTClassificationModel):
        p, named = F.col("_p")[1], []
    else:
        p = sum((F.coalesce(F.get("_p", CLASSES.index(c)), F.lit(0.0)) for c in REMOVABLE), F.lit(0.0))
        named = [F.get(F.array(*map(F.lit, CLASSES)), F.col("prediction").cast("int")).alias("predicted")]
    p = F.least(F.lit(1.0), F.greatest(F.lit(0.0), p))
    return out.select(*(F.col(f"`{c}`") for c in gaps.columns), p.alias("p_removable"), (p >= threshold).alias("removable"), *named)


def pause_metrics(scored: DataFrame) -> DataFrame:
    """One row over scored rows with a label: n, multi_error, removable_precision and removable_recall (0 without a positive), four decimals."""
    true, found = F.col("label").isin(REMOVABLE), F.col("removable")
    n = lambda c: F.sum(c.cast("long"))
    ratio = lambda a, b: F.round(F.coalesce(n(a) / F.nullif(n(b), F.lit(0)), F.lit(0.0)), 4)
    return scored.agg(
        F.count("*").alias("n"), F.round(1 - F.avg((F.col("predicted") == F.col("label")).cast("double")), 4).alias("multi_error"), ratio(true & found, found).alias("removable_precision"), ratio(true & found, true).alias("removable_recall")
    )


@dataclass(frozen=True)
class BoostedClasses:
    """A boosted model a class (None: the class has no training row), the features they take and how many trees each kept."""

    features: tuple[str, ...]
    models: tuple[GBTClassificationModel | None, ...]

    @property
    def rounds(self) -> dict[str, int]:
        return {c: m.getNumTrees if m else 0 for c, m in zip(CLASSES, self.models)}


def train_boosted_classes(
    labelled: DataFrame, features: list[str] | None = None, rounds: int = 20, depth: int = 4, rate: float = 0.3, tolerance: float = 0.01, seed: int = 42, parallel: int = 3
) -> BoostedClasses:
    """Boosted trees for each class against the rest, stopped by the rows with ``held_out``; their margins go into one softmax when rows are scored.

    A class stops at the round from which the held-out loss no longer falls by ``tolerance`` of itself (0.01 at least), or after ``rounds``; with no held-out row
    all rounds are made. Trees are grown by Spark over all rows, ``parallel`` classes at a time. Null features count as 0, rows with an unknown label
    are left out, and fewer than LEAST_ROWS training rows are refused with a ValueError.
    """
    features = features or FEATURES
    known = _ready(labelled.filter(F.col("label").isin(CLASSES)), features)
    rows = written(known.select(*(F.col(c).cast("double") for c in features), "label", F.coalesce("held_out", F.lit(False)).alias("held_out")), "pause-rows")
    sizes = {(r.label, r.held_out): r["count"] for r in rows.groupBy("label", "held_out").count().collect()}
    n = sum(size for (_, held), size in sizes.items() if not held)
    if n < LEAST_ROWS:
        raise ValueError(f"{n} labelled gaps, at least {LEAST_ROWS} are needed")
    ready = VectorAssembler(inputCols=features, outputCol="_features").transform(rows)
    stop = {"validationIndicatorCol": "held_out", "validationTol": tolerance} if any(held for _, held in sizes) else {}

    def fit(c: str) -> GBTClassificationModel | None:
        if not sizes.get((c, False)):
            return None
        trees = GBTClassifier(featuresCol="_features", labelCol="_target", maxIter=rounds, maxDepth=depth, stepSize=rate, seed=seed, **stop)
        return trees.fit(ready.select("_features", "held_out", (F.col("label") == c).cast("double").alias("_target")))

    with ThreadPool(parallel) as pool:
        models = pool.map(inheritable_thread_target(rows.sparkSession)(fit), CLASSES)
    return BoostedClasses(tuple(features), tuple(models))


def score_classes(gaps: DataFrame, model: BoostedClasses, threshold: float = 0.65) -> DataFrame:
    """Gaps with ``probabilities`` (in order of CLASSES, sum 1), predicted (the likeliest; the earlier of equals), p_removable and removable.

    A margin m stands for odds of exp(2m), so the softmax is taken over 2m; a class without a model has the probability 0.
    """
    out = VectorAssembler(inputCols=list(model.features), outputCol="_features").transform(_ready(gaps.select("*", *(F.col(f"`{c}`").alias(f"_kept_{i}") for i, c in enumerate(gaps.columns))), list(model.features)))
    odds = []
    for i, m in enumerate(model.models):
        if m is None:
            odds.append(F.lit(0.0))
            continue
        m.setRawPredictionCol(f"_raw_{i}").setProbabilityCol(f"_prob_{i}").setPredictionCol(f"_pred_{i}")
        out = m.transform(out)
        odds.append(F.exp(2 * vector_to_array(f"_raw_{i}")[1]))
    out = out.withColumn("_odds", F.array(*odds))
    total = F.aggregate("_odds", F.lit(0.0), lambda s, x: s + x)
    out = out.withColumn("probabilities", F.transform("_odds", lambda x: x / total))
    p = F.least(F.lit(1.0), sum((F.get("probabilities", CLASSES.index(c)) for c in REMOVABLE), F.lit(0.0)))
    likeliest = F.get(F.array(*map(F.lit, CLASSES)), (F.array_position("probabilities", F.array_max("probabilities")) - 1).cast("int"))
    kept = [F.col(f"_kept_{i}").alias(c) for i, c in enumerate(gaps.columns)]
    return out.select(*kept, "probabilities", likeliest.alias("predicted"), p.alias("p_removable"), (p >= threshold).alias("removable"))


def class_log_loss(scored: DataFrame) -> DataFrame:
    """One row: n and logloss (mean of -ln p of the row's label, p at least 1e-15) of the scored rows with a known label; null with none."""
    at = F.array_position(F.array(*map(F.lit, CLASSES)), F.col("label"))
    p = F.get("probabilities", (at - 1).cast("int"))
    return scored.filter(F.col("label").isin(CLASSES)).agg(F.count("*").alias("n"), F.avg(-F.log(F.greatest(p, F.lit(1e-15)))).alias("logloss"))
