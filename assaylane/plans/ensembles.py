"""Tree ensembles on MLlib, grown until validation AUC stops rising."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.ml.classification import (
    GBTClassificationModel,
    GBTClassifier,
    RandomForestClassificationModel,
    RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assaylane.fixed import SEED
from assaylane.operators.columns import col, quoted
from assaylane.operators.impute import filled
from assaylane.operators.labels import with_class_weight
from assaylane.operators.metrics import evaluate, roc_auc
from assaylane.session import materialize

MAX_DEPTH = 30  # the deepest tree MLlib grows; stands for "no limit" too
GAIN = 1e-6
VECTOR, ROW = "_features", "_row"
NODES_PER_SHARD = 5_000_000  # tree nodes that go to the tasks at once, about half a GB


@dataclass(frozen=True)
class ForestConfig:
    n_estimators: int = 2000
    max_depth: int | None = None
    min_samples_leaf: int = 1
    max_features: str | None = "sqrt"
    class_weight: str | None = "balanced"
    step: int = 100
    patience: int = 20
    seed: int = SEED
    max_bins: int = 32
    algo: str = "rf"


@dataclass(frozen=True)
class BoostedConfig:
    n_estimators: int = 2000
    max_depth: int = 6
    learning_rate: float = 0.1
    subsample: float = 1.0
    colsample_bytree: float = 1.0  # drawn per node here, as MLlib has no draw per tree
    early_stopping_rounds: int = 50
    seed: int = SEED
    max_bins: int = 32
    algo: str = "gbt"


Config = ForestConfig | BoostedConfig


def config_from(algo: str, values: dict) -> Config:
    """Given values over the defaults. A setting that this engine does not have is an error."""
    kind = ForestConfig if algo == "rf" else BoostedConfig
    unknown = sorted(set(values) - set(kind.__dataclass_fields__))
    if unknown:
        raise ValueError(f"no such settings for {algo!r}: {', '.join(unknown)}")
    return kind(**{k: v for k, v in values.items() if k != "algo"})


def tree_depth(max_depth: int | None) -> int:
    """Depth for MLlib; no limit means its deepest tree. More levels than that are refused, not cut."""
    if max_depth is not None and max_depth > MAX_DEPTH:
        raise ValueError(f"trees have {MAX_DEPTH} levels at most; leave max_depth out for no limit")
    return MAX_DEPTH if max_depth is None else max_depth


@dataclass
class Ensemble:
    """A fitted model: feature names and medians, and MLlib models whose votes are added up."""

    features: list[str]
    medians: dict[str, float]
    models: list
    config: Config
    history: list[dict] = field(default_factory=list)

    @property
    def n_trees(self) -> int:
        return sum(len(m.treeWeights) for m in self.models)

    def vectors(self, df: DataFrame, keep: Sequence[str] | None = None) -> DataFrame:
        """Aligned, imputed and assembled features next to the kept columns."""
        return assemble(df, self.features, self.medians, keep)

    def predict(self, df: DataFrame, out: str = "prob_activo", keep: Sequence[str] | None = None) -> DataFrame:
        """Add the probability of class 1. Missing feature columns are imputed."""
        scored = self.score_vectors(self.vectors(df, keep), out)
        return scored.drop(VECTOR)

    def score_vectors(self, vectors: DataFrame, out: str = "prob_activo", nodes_per_shard: int | None = None) -> DataFrame:
        """The vectors and the probability of class 1.

        A model of at most ``nodes_per_shard`` tree nodes goes to the tasks as a whole. A larger one is cut into shards
        of trees; each adds its votes to a table of row numbers and votes, and the sums are joined to the rows.
        """
        shards = tree_shards(self.models, nodes_per_shard or NODES_PER_SHARD)
        if len(shards) == 1:
            votes, scored = _with_votes(vectors, shards[0])
            return scored.withColumn(out, self._probability(votes)).drop(*_raw_names(shards[0]))
        rows = numbered(vectors)
        ledger = None
        for shard in shards:
            votes, scored = _with_votes(rows.select(ROW, VECTOR), shard)
            part = materialize(scored.select(ROW, votes.alias("_votes")))
            ledger = part if ledger is None else ledger.union(part)
        sums = ledger.groupBy(ROW).agg(F.sum("_votes").alias("_votes"))
        return rows.join(sums, ROW).withColumn(out, self._probability(F.col("_votes"))).drop(ROW, "_votes")

    def _probability(self, votes: Column) -> Column:
        """From the votes of all trees: class shares of a forest, the margin of boosted trees."""
        return votes / F.lit(float(self.n_trees)) if self.config.algo == "rf" else _logistic(votes)

    def importances(self) -> list[tuple[str, float]]:
        """Feature importances summing to 1, each model weighted by its number of trees."""
        total = [0.0] * len(self.medians)
        for model in self.models:
            for i, v in enumerate(model.featureImportances.toArray()):
                total[i] += float(v) * len(model.treeWeights) / self.n_trees
        return list(zip(self.medians, total))


def assemble(
    df: DataFrame, features: Sequence[str], medians: dict[str, float], keep: Sequence[str] | None = None
) -> DataFrame:
    """Kept columns (default: all) and one vector of the imputed features that have a median."""
    kept = [quoted(c) for c in (df.columns if keep is None else keep)]
    present = set(df.columns)
    inputs = {f"_f{i}": c for i, c in enumerate(c for c in features if c in medians)}
    numbers = [
        f"{filled(quoted(c) if c in present else 'NULL', medians[c])} AS {name}" for name, c in inputs.items()
    ]
    assembler = VectorAssembler(inputCols=list(inputs), outputCol=VECTOR)
    return assembler.transform(df.selectExpr(*kept, *numbers)).drop(*inputs)


def _positive(vector: str) -> Column:
    return vector_to_array(col(vector))[1]


def _logistic(margin: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-2.0 * margin))


def numbered(df: DataFrame) -> DataFrame:
    """``df`` written once, with a number that tells its rows apart."""
    return materialize(df.withColumn(ROW, F.monotonically_increasing_id()))


def _forest(cfg: ForestConfig, trees: int, seed: int, y: str, weighted: bool) -> RandomForestClassifier:
    depth = tree_depth(cfg.max_depth)
    forest = RandomForestClassifier(
        featuresCol=VECTOR,
        labelCol=y,
        numTrees=trees,
        maxDepth=depth,
        minInstancesPerNode=cfg.min_samples_leaf,
        featureSubsetStrategy=cfg.max_features or "all",
        maxBins=cfg.max_bins,
        seed=seed,
        cacheNodeIds=depth > 10,
    )
    return forest.setWeightCol("weight") if weighted else forest


def _quiet(model, raw: str):
    """Only the raw votes are needed; a model without the other output columns is cheaper to apply."""
    return model.setRawPredictionCol(raw).setProbabilityCol("").setPredictionCol("")


def _raw_names(models: Sequence) -> list[str]:
    return [f"_raw{i}" for i in range(len(models))]


def _with_votes(vectors: DataFrame, models: Sequence) -> tuple[Column, DataFrame]:
    """The votes for class 1 of all models added up, and the table with the raw columns that they are made of."""
    for model, raw in zip(models, _raw_names(models)):
        vectors = _quiet(model, raw).transform(vectors)
    return reduce(lambda a, b: a + b, [_positive(r) for r in _raw_names(models)]), vectors


def tree_shards(models: Sequence, most: int) -> list[list]:
    """The models in groups of at most ``most`` tree nodes; a model above that is cut between its trees."""
    shards: list[list] = []
    held = most
    for model in models:
        for part, nodes in _parts(model, most):
            if held + nodes > most:
                shards.append([])
                held = 0
            shards[-1].append(part)
            held += nodes
    return shards


def _parts(model, most: int) -> list[tuple]:
    """(model, tree nodes) for a model, or for the pieces of one with more than ``most`` nodes."""
    if model.totalNumNodes <= most:
        return [(model, model.totalNumNodes)]
    trees, weights = model._call_java("trees"), list(model.treeWeights)
    sizes = [trees[i].numNodes() for i in range(len(weights))]
    out, begin = [], 0
    for end in range(1, len(sizes) + 1):
        if end == len(sizes) or sum(sizes[begin : end + 1]) > most:
            part = [trees[i] for i in range(begin, end)]
            if isinstance(model, GBTClassificationModel):
                piece = boosted_model(part, weights[begin:end])
            else:
                piece = _forest_model(part, model.numFeatures)
            out.append((piece, sum(sizes[begin:end])))
            begin = end
    return out


def _java_trees(trees: Sequence, kind: str):
    context = SparkSession.getActiveSession().sparkContext
    package = getattr(context._jvm.org.apache.spark.ml, kind)
    single = package.DecisionTreeClassificationModel if kind == "classification" else package.DecisionTreeRegressionModel
    array = context._gateway.new_array(single, len(trees))
    for i, tree in enumerate(trees):
        array[i] = tree
    return array


def _forest_model(trees: Sequence, features: int) -> RandomForestClassificationModel:
    """A forest of given (Java) trees."""
    jvm = SparkSession.getActiveSession().sparkContext._jvm
    made = jvm.org.apache.spark.ml.classification.RandomForestClassificationModel(_java_trees(trees, "classification"), features, 2)
    return RandomForestClassificationModel(made).setFeaturesCol(VECTOR)


def boosted_model(trees: Sequence, weights: Sequence[float]) -> GBTClassificationModel:
    """Boosted trees of given (Java) trees and their weights."""
    context = SparkSession.getActiveSession().sparkContext
    numbers = context._gateway.new_array(context._jvm.double, len(weights))
    for i, w in enumerate(weights):
        numbers[i] = float(w)
    name = f"gbtc_{uuid.uuid4().hex[:12]}"
    made = context._jvm.org.apache.spark.ml.classification.GBTClassificationModel(name, _java_trees(trees, "regression"), numbers)
    return GBTClassificationModel(made).setFeaturesCol(VECTOR)


def training_table(train: DataFrame, cfg: Config, y: str) -> DataFrame:
    """Label, vector and class weight of the training rows, written once for the many passes of a fit."""
    if cfg.algo == "rf" and cfg.class_weight == "balanced":
        return materialize(with_class_weight(train, y).select(col(y).cast("double").alias(y), VECTOR, "weight"))
    return materialize(train.select(col(y).cast("double").alias(y), VECTOR))


def fit_forest(
    train: DataFrame, val: DataFrame, cfg: ForestConfig, y: str = "activo", parallelism: int = 2
) -> tuple[list, list[dict]]:
    """Grow a forest ``step`` trees at a time and keep the size with the best validation AUC.

    ``train`` and ``val`` hold the label and the feature vector. Stops after ``patience`` rounds without a gain.
    Returns the models of the kept rounds and one history row per round. The validation vectors are written once;
    each look at them appends row numbers and votes to a ledger and scores all new sizes in one pass. As the stop
    cannot come before ``patience`` rounds without a gain are over, that many are grown between two looks, and no
    round is grown in vain.
    """
    ready = training_table(train, cfg, y)
    rows = numbered(val.select(col(y).cast("double").alias(y), VECTOR))
    ledger = rows.select(ROW, y)
    sizes = [min(cfg.step, cfg.n_estimators - n) for n in range(0, cfg.n_estimators, cfg.step)]
    weighted = "weight" in ready.columns
    models: list = []
    history: list[dict] = []
    best, best_auc, stale = 0, float("-inf"), -1
    upto = F.lit(0.0)

    def grow(i: int):
        return _forest(cfg, sizes[i], cfg.seed + i, y, weighted).fit(ready)

    while len(models) < len(sizes) and stale < cfg.patience:
        window = range(len(models), min(len(models) + cfg.patience - stale, len(sizes)))
        with ThreadPoolExecutor(parallelism) as pool:
            models += pool.map(inheritable_thread_target(ready.sparkSession)(grow), window)
        ledger, upto = _append_votes(ledger, rows, models, window, upto)
        for i, scores in _scores_of_sizes(ledger, sizes, window, y).items():
            auc = scores["roc_auc"]
            history.append({"trees": sum(sizes[: i + 1]), "val_auc": auc, "val_f1": scores["f1"]})
            if auc is not None and auc > best_auc + GAIN:
                best, best_auc, stale = i + 1, auc, 0
            else:
                stale = max(stale, 0) + 1
    return models[: best or len(models)], history


def _append_votes(ledger: DataFrame, rows: DataFrame, models: Sequence, window: range, upto: Column) -> tuple[DataFrame, Column]:
    """The ledger with the votes up to each of the new rounds: ``_votes_<round>``. Vectors are read, not written."""
    raws = [f"_raw{i}" for i in window]
    scored = rows.select(ROW, VECTOR)
    for i, raw in zip(window, raws):
        scored = _quiet(models[i], raw).transform(scored)
    new = scored.select(ROW, *[_positive(r).alias(r) for r in raws])
    joined = ledger.join(new, ROW)
    sums = {}
    for i, raw in zip(window, raws):
        upto = upto + F.col(raw)
        sums[f"_votes_{i}"] = upto
    return materialize(joined.select(*ledger.columns, *[v.alias(n) for n, v in sums.items()])), F.col(f"_votes_{window[-1]}")


def _scores_of_sizes(ledger: DataFrame, sizes: Sequence[int], window: range, y: str) -> dict[int, dict]:
    """Validation scores of every new forest size, in one pass over the ledger."""
    shares = [F.struct(F.lit(i).alias("round"), (F.col(f"_votes_{i}") / float(sum(sizes[: i + 1]))).alias("p")) for i in window]
    long = ledger.select(y, F.explode(F.array(*shares)).alias("s")).select(y, "s.round", "s.p")
    found = {r["round"]: r.asDict() for r in evaluate(long, y, "p", keys=["round"]).collect()}
    return {i: found[i] if i in found else {"roc_auc": None, "f1": None} for i in window}


def fit_boosted(train: DataFrame, val: DataFrame, cfg: BoostedConfig, y: str = "activo") -> tuple[list, list[dict]]:
    """Boost until validation AUC has not risen for ``early_stopping_rounds``; keep the best length.

    One tree a round: a regression tree on the pseudo-residuals of the logistic loss at the margins so far. Margins are
    kept with the rows and advance by some trees at a time, so a round costs the same whatever its number, and the best
    length is a prefix of the trees at hand: nothing is fitted twice. Trees between two looks at the validation rows
    are as many as must come before the next possible stop.
    """
    stop = cfg.early_stopping_rounds
    ready = _margins(train, y)
    rows = _margins(val, y)
    trees, history = [], []
    best, best_auc = 0, float("-inf")
    pending = 0  # trees that the margins of the training rows do not hold yet
    while len(trees) < cfg.n_estimators and (not history or len(trees) - best < stop):
        done = len(trees)
        looks = stop - (done - best) if history else stop + 1
        for _ in range(min(looks, cfg.n_estimators - done)):
            if pending == ADVANCE:
                ready = _advanced(ready, trees[-pending:], len(trees) - pending, cfg)
                pending = 0
            trees.append(_next_tree(ready, trees[len(trees) - pending :], len(trees), cfg))
            pending += 1
        for start in range(done, len(trees), ADVANCE):
            rows, aucs = _look(rows, trees[start : start + ADVANCE], start, cfg, y)
            for t in sorted(aucs):
                history.append({"trees": t + 1, "val_auc": aucs[t]})
                if aucs[t] is not None and aucs[t] > best_auc:
                    best, best_auc = t + 1, aucs[t]
    best = best or len(trees)
    return [boosted_model([t._java_obj for t in trees[:best]], [_weight(t, cfg) for t in range(best)])], history


ADVANCE = 8  # trees that are applied to the rows in one pass


def _weight(t: int, cfg: BoostedConfig) -> float:
    """The first tree fits the labels and counts in full."""
    return 1.0 if t == 0 else cfg.learning_rate


def _margins(df: DataFrame, y: str) -> DataFrame:
    """Label, label as -1 or 1, vector and margin, written."""
    label = col(y).cast("double")
    return materialize(df.select(label.alias(y), (2 * label - 1).alias("_sign"), VECTOR, F.lit(0.0).alias("_margin")))


def _steps(df: DataFrame, trees: Sequence, start: int, cfg: BoostedConfig) -> tuple[DataFrame, list[Column]]:
    """The rows with the outputs of some trees, and the margin after each of them."""
    margin, steps = F.col("_margin"), []
    for t, tree in enumerate(trees, start):
        df = tree.setPredictionCol(f"_tree{t}").transform(df)
        margin = margin + F.lit(_weight(t, cfg)) * F.col(f"_tree{t}")
        steps.append(margin)
    return df, steps


def _advanced(df: DataFrame, trees: Sequence, start: int, cfg: BoostedConfig) -> DataFrame:
    applied, steps = _steps(df, trees, start, cfg)
    kept = [c for c in df.columns if c != "_margin"]
    return materialize(applied.select(*[col(c) for c in kept], steps[-1].alias("_margin")))


def _next_tree(df: DataFrame, trees: Sequence, t: int, cfg: BoostedConfig):
    """A regression tree on the pseudo-residuals after ``trees``, which come after the margins."""
    applied, steps = _steps(df, trees, t - len(trees), cfg)
    sign, margin = F.col("_sign"), steps[-1] if steps else F.col("_margin")
    target = sign if t == 0 else 4.0 * sign / (1.0 + F.exp(2.0 * sign * margin))
    learner = RandomForestRegressor(
        featuresCol=VECTOR,
        labelCol="_target",
        numTrees=1,
        bootstrap=False,
        maxDepth=tree_depth(cfg.max_depth),
        subsamplingRate=cfg.subsample,
        featureSubsetStrategy=_columns_per_node(cfg),
        maxBins=cfg.max_bins,
        seed=cfg.seed + t,
    )
    return learner.fit(applied.select(VECTOR, target.alias("_target"))).trees[0].setFeaturesCol(VECTOR)


def _columns_per_node(cfg: BoostedConfig) -> str:
    return "all" if cfg.colsample_bytree >= 1 else str(cfg.colsample_bytree)


def _look(rows: DataFrame, trees: Sequence, start: int, cfg: BoostedConfig, y: str) -> tuple[DataFrame, dict[int, float]]:
    """Advance the validation rows by some trees; AUC after each of them."""
    applied, steps = _steps(rows, trees, start, cfg)
    stored = materialize(applied.select(*[col(c) for c in rows.columns if c != "_margin"], F.array(*steps).alias("_steps")))
    long = stored.select(y, F.posexplode("_steps").alias("_pos", "_p"))
    aucs = {start + r["_pos"]: r["roc_auc"] for r in roc_auc(long, y, "_p", ["_pos"]).collect()}
    return stored.withColumn("_margin", F.element_at("_steps", -1)).drop("_steps"), {start + i: aucs.get(start + i) for i in range(len(trees))}


def _boosting(cfg: BoostedConfig, rounds: int, y: str) -> GBTClassifier:
    return GBTClassifier(
        featuresCol=VECTOR,
        labelCol=y,
        maxIter=rounds,
        maxDepth=tree_depth(cfg.max_depth),
        stepSize=cfg.learning_rate,
        subsamplingRate=cfg.subsample,
        featureSubsetStrategy=_columns_per_node(cfg),
        maxBins=cfg.max_bins,
        seed=cfg.seed,
    )


def fit_once(train: DataFrame, cfg: Config, y: str = "activo") -> list:
    """All trees in one go, without early stopping. ``train`` is a table of ``training_table``, which fits may share."""
    if cfg.algo == "rf":
        return [_forest(cfg, cfg.n_estimators, cfg.seed, y, "weight" in train.columns).fit(train)]
    return [_boosting(cfg, cfg.n_estimators, y).fit(train)]


def fit(train: DataFrame, val: DataFrame, cfg: Config, y: str = "activo") -> tuple[list, list[dict]]:
    return fit_forest(train, val, cfg, y) if cfg.algo == "rf" else fit_boosted(train, val, cfg, y)
