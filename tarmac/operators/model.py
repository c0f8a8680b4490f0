"""Training, scoring, persistence and per-row contributions.

* Categoricals (carrier, airports, route, daypart) become target-encoded
  numbers fitted on the train split only (route cardinality rules out tree
  bins); numerics are coerced and missing values get a sentinel the trees
  can split off (Spark trees have no missing-value routing).
* Gradient-boosted trees with log-loss and balanced class weights, fitted
  once to ``max_iter`` rounds.  Spark's own stop rule has no patience, so it
  is not used: one Arrow-batched pass over the validation rows adds the trees'
  outputs up, tree by tree, one grouped query gives the exact AUC of every
  round, and the forest is cut to the trees up to the best round before
  ``patience`` rounds brought no better one.  Spark has no L2 leaf term (D14).
* Categoricals' encoding: ordered target statistics (:mod:`.encoding`) on the
  train rows by default, so that no row's own label is in its encoding; rows
  that are scored get the statistic of all train rows, with the same prior.
* Contributions (H1): the fitted forest has a size fixed by its parameters
  (trees x 2^(depth+1) nodes), so its node table is read from the saved model,
  broadcast once, and an Arrow-batched function of the feature array alone
  works on all trees with NumPy.  ``shapley`` (the default) gives exact Shapley
  values of the game in which an unknown feature's split is averaged by the
  children's training weight; ``path`` gives the change in node value at every split on a
  row's path to the split feature.  In both, base + sum(contributions) equals the margin.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field, fields

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import SQLTransformer, StringIndexer, TargetEncoder, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas as S
from ..functions.coerce import to_double
from ..session import materialize, shared_dir
from . import encoding as EN
from . import metrics as M

MISSING_NUMERIC = -999.0


@dataclass
class ModelConfig:
    feature_cols: list[str] = field(default_factory=S.model_feature_columns)
    cat_cols: list[str] = field(default_factory=lambda: list(S.CATEGORICAL_FEATURES))
    label: str = S.LABEL
    max_iter: int = 1500
    patience: int = 200
    max_depth: int = 6
    step_size: float = 0.05
    seed: int = 42
    max_bins: int = 254
    subsampling_rate: float = 1.0
    encoding: str = "ordered"     # or "plain": one mean per category on train rows too
    prior_weight: float = 1.0     # rows that the global rate counts for in a category's statistic
    cache_node_ids: bool = True   # node ids cached + checkpointed to the shared folder every 10 rounds

    @property
    def numeric_cols(self) -> list[str]:
        return [c for c in self.feature_cols if c not in self.cat_cols]

    @property
    def vector_cols(self) -> list[str]:
        """Vector slot order: numerics first, then encoded categoricals."""
        return self.numeric_cols + [f"{c}__num" for c in self.cat_cols]

    @property
    def vector_features(self) -> list[str]:
        """Original feature name of every vector slot."""
        return self.numeric_cols + list(self.cat_cols)


def model_inputs(df: DataFrame, cfg: ModelConfig, keep=()) -> DataFrame:
    """Project to the model's columns (missing -> null) and sanitise.

    Categoricals: text, null -> ``__MISSING__``.  Numerics: guarded double
    cast, null -> sentinel.  Raw values are kept under ``{c}__raw`` for the
    explanation text.
    """
    cols = []
    for c in cfg.feature_cols:
        src = F.col(c) if c in df.columns else F.lit(None)
        if c in cfg.cat_cols:
            cols.append(F.coalesce(src.cast("string"), F.lit(S.MISSING_KEY)).alias(c))
        else:
            v = to_double(src) if c in df.columns and isinstance(df.schema[c].dataType, T.StringType) \
                else src.cast("double")
            cols.append(F.coalesce(v, F.lit(MISSING_NUMERIC)).alias(c))
            cols.append(v.alias(f"{c}__raw"))
    extra = [F.col(k) for k in keep if k in df.columns]
    if cfg.label in df.columns and cfg.label not in keep:
        extra.append(F.col(cfg.label).cast("double").alias(cfg.label))
    return df.select(*extra, *cols)


def class_weight_column(train: DataFrame, label: str) -> Column:
    """Balanced weight ``max_count / count_c`` (A15) as a column expression.

    The two class counts come from one aggregate over the train rows (two
    numbers); the expression compares the row's label with them, no join.
    """
    y = F.col(label).cast("double")
    pos, neg = train.agg(F.count_if(y == 1), F.count_if(y != 1)).first()
    top = float(max(pos, neg))
    return F.when(y == 1, F.lit(top / max(pos, 1))).otherwise(F.lit(top / max(neg, 1)))


def fit(train: DataFrame, val: DataFrame | None, cfg: ModelConfig) -> PipelineModel:
    """Fit encoder (train only) + boosted trees (train, validation on val).

    The (sampled) train rows are written once: the indexer, the encoder, the class counts and the ordered statistics all read them.
    """
    inputs = lambda df: model_inputs(df, cfg).select(cfg.label, *cfg.feature_cols)
    tr = materialize(inputs(train), "fit_rows")
    idx = StringIndexer(inputCols=list(cfg.cat_cols), outputCols=[f"{c}__idx" for c in cfg.cat_cols],
                        handleInvalid="keep").fit(tr)
    enc = TargetEncoder(inputCols=[f"{c}__idx" for c in cfg.cat_cols], outputCols=[f"{c}__te" for c in cfg.cat_cols],
                        labelCol=cfg.label, targetType="binary", handleInvalid="keep", smoothing=cfg.prior_weight).fit(idx.transform(tr))
    # Re-cast the encodings: a plain double carries no nominal ML metadata, so the
    # trees split on it as a number instead of treating it as a category.
    plain = SQLTransformer(statement="SELECT *, " + ", ".join(
        f"CAST({c}__te AS DOUBLE) AS {c}__num" for c in cfg.cat_cols) + " FROM __THIS__")
    asm = VectorAssembler(inputCols=cfg.vector_cols, outputCol="features", handleInvalid="keep")
    weight = class_weight_column(tr, cfg.label)
    encoded = lambda df: enc.transform(idx.transform(df))
    prepare = lambda df: materialize(asm.transform(plain.transform(df))
                                     .withColumn("_w", weight).select("features", cfg.label, "_w"), "fit")
    train_rows = encoded(tr)
    if cfg.encoding == "ordered":
        # The order is a hash of the features; rows equal in all of them see the same rows before them.
        order = F.shiftrightunsigned(F.xxhash64(F.lit(cfg.seed), *map(F.col, cfg.feature_cols)), 64 - EN.ORDER_BITS)
        train_rows = EN.ordered_target_statistics(train_rows.drop(*[f"{c}__te" for c in cfg.cat_cols]), cfg.cat_cols, cfg.label, order, cfg.prior_weight, suffix="__te")
    elif cfg.encoding != "plain":
        raise ValueError(f"unknown encoding {cfg.encoding!r}")
    data = prepare(train_rows)
    gbt = GBTClassifier(featuresCol="features", labelCol=cfg.label, weightCol="_w", lossType="logistic",
                        maxDepth=cfg.max_depth, stepSize=cfg.step_size, seed=cfg.seed, maxBins=cfg.max_bins,
                        subsamplingRate=cfg.subsampling_rate, cacheNodeIds=cfg.cache_node_ids)
    if val is None:
        return PipelineModel(stages=[idx, enc, plain, asm, gbt.setMaxIter(cfg.max_iter).fit(data)])
    fitted = gbt.setMaxIter(cfg.max_iter).fit(data)
    aucs = round_aucs(round_margins(prepare(encoded(inputs(val))), fitted, cfg.label))
    best, _ = best_round([-r["roc_auc"] if r["roc_auc"] is not None else 0.0 for r in aucs.orderBy("round").collect()], cfg.patience)
    return PipelineModel(stages=[idx, enc, plain, asm, first_trees(fitted, best)])


def _matrix(x: pa.ListArray, width: int) -> np.ndarray:
    """Rows of ``width`` numbers as a matrix whose columns are contiguous."""
    return np.asfortranarray(x.flatten().to_numpy(zero_copy_only=False).reshape(-1, width))


def _lists(x: np.ndarray) -> pa.ListArray:
    """A matrix as one list a row."""
    n, width = x.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(np.ascontiguousarray(x).ravel()))


def round_margins(rows: DataFrame, gbt: GBTClassificationModel, label: str) -> DataFrame:
    """``label, margins`` of every row: the margin after each round, by one pass over the forest."""
    bc, width = rows.sparkSession.sparkContext.broadcast(forest_arrays(gbt)), gbt.numFeatures

    @F.arrow_udf("array<double>")
    def margins(x: pa.Array) -> pa.Array:
        return _lists(staged_margins(_matrix(x, width), bc.value))

    return rows.select(F.col(label).alias("label"), margins(vector_to_array("features")).alias("margins"))


def round_aucs(rows: DataFrame, label: str = "label", margins: str = "margins") -> DataFrame:
    """Exact AUC after every round (from 1), ``margins`` an array of a row's margin by round: one grouped ranking of
    the distinct (round, margin) pairs.  A round has no AUC where one class is missing."""
    long = rows.select(F.col(label).alias("label"), F.posexplode(margins).alias("_at", "score"))
    return M.ranking_metrics(long.withColumn("round", (F.col("_at") + 1).cast("long")), group_cols=["round"])


def first_trees(gbt: GBTClassificationModel, k: int) -> GBTClassificationModel:
    """The fitted model cut to its first ``k`` trees: what fitting ``k`` rounds gives, boosting being deterministic for a seed."""
    if k >= gbt.getNumTrees:
        return gbt
    sc, old = SparkSession.active().sparkContext, gbt._java_obj
    trees = sc._gateway.new_array(sc._jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, k)
    weights = sc._gateway.new_array(sc._jvm.double, k)
    every = old.trees()
    for i, w in enumerate(gbt.treeWeights[:k]):
        trees[i], weights[i] = every[i], float(w)
    cut = GBTClassificationModel(sc._jvm.org.apache.spark.ml.classification.GBTClassificationModel(
        old.uid(), trees, weights, old.numFeatures(), old.numClasses()))
    cut._resetUid(gbt.uid)
    return gbt._copyValues(cut)


def best_round(losses: list[float], patience: int) -> tuple[int, bool]:
    """The round (from 1) of the least loss before ``patience`` rounds brought no better one, and whether that came."""
    best = 0
    for i, x in enumerate(losses):
        if x < losses[best]:
            best = i
        elif i - best >= patience:
            return best + 1, True
    return best + 1, False


def score(model: PipelineModel, df: DataFrame, cfg: ModelConfig, keep=()) -> DataFrame:
    """Batch scoring -> ``probability`` and ``margin`` (E3); keeps ``keep`` columns."""
    x = model_inputs(df, cfg, keep=keep)
    out = model.transform(x)
    return (out.withColumn("probability", vector_to_array("probability")[1])
               .withColumn("margin", vector_to_array("rawPrediction")[1]))


def save(model: PipelineModel, cfg: ModelConfig, path: str, metrics: DataFrame | None = None,
         report: DataFrame | None = None) -> None:
    """Persist model, settings, metrics and training report."""
    spark = SparkSession.active()
    model.write().overwrite().save(f"{path}/model")
    meta = asdict(cfg) | {"vector_features": cfg.vector_features, "rounds_kept": model.stages[-1].getNumTrees}
    spark.createDataFrame([(json.dumps(meta),)], "meta string").write.mode("overwrite").text(f"{path}/feature_cols")
    for name, table in (("metrics", metrics), ("report", report)):
        if table is not None:
            table.coalesce(1).write.mode("overwrite").json(f"{path}/{name}")


def load(path: str) -> tuple[PipelineModel, ModelConfig]:
    """A saved model with the settings it was fitted with."""
    meta = json.loads(SparkSession.active().read.text(f"{path}/feature_cols").first()[0])
    return PipelineModel.load(f"{path}/model"), ModelConfig(**{f.name: meta[f.name] for f in fields(ModelConfig)})


# ---------------------------------------------------------------------------
# H1: contributions by exact Shapley values or by decision paths
# ---------------------------------------------------------------------------

def forest_arrays(model: PipelineModel | GBTClassificationModel) -> dict:
    """Node arrays of the fitted forest, read from its saved form.

    Bounded by the model parameters (trees x nodes), not by the data.
    """
    gbt = model.stages[-1] if isinstance(model, PipelineModel) else model
    spark = SparkSession.active()
    path = f"{shared_dir(spark)}/models/forest-{uuid.uuid4().hex[:12]}"
    gbt.write().overwrite().save(path)
    rows = spark.read.parquet(f"{path}/data").select(
        "treeID", "nodeData.id", "nodeData.prediction", "nodeData.leftChild", "nodeData.rightChild",
        "nodeData.split.featureIndex", "nodeData.split.leftCategoriesOrThreshold",
        "nodeData.split.numCategories", F.col("nodeData.impurityStats")[0].alias("cover")).collect()
    n_trees = len(gbt.treeWeights)
    size = max(r["id"] for r in rows) + 1
    pred = np.zeros((n_trees, size))
    left = -np.ones((n_trees, size), dtype=np.int64)
    right = -np.ones((n_trees, size), dtype=np.int64)
    feat = -np.ones((n_trees, size), dtype=np.int64)
    thr, cover = np.zeros((n_trees, size)), np.zeros((n_trees, size))
    for r in rows:
        t, i = r["treeID"], r["id"]
        pred[t, i], cover[t, i] = r["prediction"], r["cover"]
        left[t, i], right[t, i], feat[t, i] = r["leftChild"], r["rightChild"], r["featureIndex"]
        if r["numCategories"] is not None and r["numCategories"] >= 0:
            raise ValueError("categorical splits are not expected: categoricals are target-encoded")
        if r["leftCategoriesOrThreshold"]:
            thr[t, i] = r["leftCategoriesOrThreshold"][0]
    return {"pred": pred, "left": left, "right": right, "feat": feat, "thr": thr, "cover": cover,
            "w": np.asarray(gbt.treeWeights, dtype=float)}


def leaf_nodes(x: np.ndarray, forest: dict, t: int) -> np.ndarray:
    """The leaf of tree ``t`` that each row of ``x`` ends in."""
    left, right, feat, thr = (forest[k][t] for k in ("left", "right", "feat", "thr"))
    cur = np.zeros(len(x), dtype=np.int64)
    live = np.flatnonzero(left[cur] >= 0)
    while len(live):
        node = cur[live]
        cur[live] = np.where(x[live, feat[node]] <= thr[node], left[node], right[node])
        live = live[left[cur[live]] >= 0]
    return cur


def staged_margins(x: np.ndarray, forest: dict) -> np.ndarray:
    """n x trees: the margin of every row after each tree."""
    out = np.empty((len(x), len(forest["w"])))
    for t, w in enumerate(forest["w"]):
        out[:, t] = w * forest["pred"][t][leaf_nodes(x, forest, t)]
    return np.cumsum(out, axis=1)


def path_contributions(x: np.ndarray, forest: dict) -> tuple[np.ndarray, np.ndarray]:
    """(n x f contributions, n base values) in margin units for a batch."""
    n, f = x.shape
    contrib = np.zeros((n, f))
    base = np.zeros(n)
    rows = np.arange(n)
    for t in range(len(forest["w"])):
        w = forest["w"][t]
        pred, left, right = forest["pred"][t], forest["left"][t], forest["right"][t]
        feat, thr = forest["feat"][t], forest["thr"][t]
        cur = np.zeros(n, dtype=np.int64)
        base += w * pred[0]
        while True:
            active = left[cur] >= 0
            if not active.any():
                break
            idx = rows[active]
            node = cur[active]
            fi = feat[node]
            go_left = x[idx, fi] <= thr[node]
            child = np.where(go_left, left[node], right[node])
            np.add.at(contrib, (idx, fi), w * (pred[child] - pred[node]))
            cur[active] = child
    return contrib, base


def leaf_paths(forest: dict, t: int) -> dict[int, tuple[float, list[tuple[int, float, np.ndarray, np.ndarray]]]]:
    """Of every leaf of tree ``t``: its value and, per feature on its path, ``(feature, share, nodes, lefts)``: the share of training
    weight that the feature's splits let through, the nodes of these splits and whether the path goes left there."""
    pred, left, right, feat, cover = (forest[k][t] for k in ("pred", "left", "right", "feat", "cover"))
    out, todo = {}, [(0, ())]
    while todo:
        node, path = todo.pop()
        if left[node] >= 0:
            todo += [(right[node], path + ((node, False),)), (left[node], path + ((node, True),))]
            continue
        own = []
        for f in sorted({feat[n] for n, _ in path}):
            nodes, lefts = map(np.array, zip(*[(n, go) for n, go in path if feat[n] == f]))
            share = np.prod(cover[np.where(lefts, left[nodes], right[nodes])] / cover[nodes])
            own.append((int(f), float(share), nodes, lefts))
        out[int(node)] = float(pred[node]), own
    return out


def shapley_weights(passed: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Patterns x features: a path's Shapley values for a leaf value of one.

    A set of known features lets through the product over its members of ``passed`` (0 or 1) and over the others of ``share``.
    The products over all sets of one size are a coefficient of the polynomial prod(share + passed * y) over the features but one.
    """
    u, d = passed.shape
    size_weight = np.array([math.factorial(s) * math.factorial(d - s - 1) / math.factorial(d) for s in range(d)])
    out = np.empty((u, d))
    for i in range(d):
        poly = np.zeros((u, d))
        poly[:, 0] = 1.0
        for j in range(d):
            if j != i:
                up = poly[:, :-1] * passed[:, j:j + 1]
                poly *= share[j]
                poly[:, 1:] += up
        out[:, i] = (passed[:, i] - share[i]) * (poly @ size_weight)
    return out


#: Bits of a table of :func:`shapley_paths`; a single leaf may have more, one a feature of its path.
BLOCK_BITS = 10


def _blocks(forest: dict, t: int) -> list[tuple[dict[int, list[tuple[int, bool]]], list[int], list[int]]]:
    """Tree ``t`` in subtrees: ``(above, splits, leaves)``, where ``above`` has the splits on the way to the subtree by feature.

    A subtree is as large as its splits and the features above them have ``BLOCK_BITS`` bits.
    """
    left, right, feat = (forest[k][t] for k in ("left", "right", "feat"))
    out, todo = [], [(0, {})]
    while todo:
        node, above = todo.pop()
        splits, leaves, below = [], [], [node]
        while below:
            n = below.pop()
            (splits if left[n] >= 0 else leaves).append(int(n))
            below += [left[n], right[n]] if left[n] >= 0 else []
        if not splits or len(above) + len(splits) <= BLOCK_BITS:
            out.append((above, splits, leaves))
            continue
        f = int(feat[node])
        todo += [(child, above | {f: [*above.get(f, ()), (int(node), go)]}) for child, go in ((left[node], True), (right[node], False))]
    return out


def shapley_paths(forest: dict) -> tuple[list[tuple[int, list[list[tuple[int, bool]]], list[int], dict[int, np.ndarray]]], float]:
    """Of every block of a tree ``(tree, splits of each feature above, splits, tables)``, and the base value.

    A row's code has a bit for each feature above the block (are all its splits there passed?) and one for each of the block's splits
    (does it go left?).  ``tables`` has by feature the sum of the Shapley values of the block's leaves for every code, so a row takes one number
    a feature from a whole block.  All of this is bounded by the forest.
    """
    out, base, weights = [], 0.0, {}
    for t, w in enumerate(forest["w"]):
        paths = leaf_paths(forest, t)
        for above, splits, leaves in _blocks(forest, t):
            codes = np.arange(1 << (len(above) + len(splits)))
            bit = {n: codes >> (len(above) + i) & 1 for i, n in enumerate(splits)}
            tables: dict[int, np.ndarray] = {}
            for leaf in leaves:
                value, path = paths[leaf]
                share = np.array([p[1] for p in path])
                base += w * value * share.prod()
                if len(path) not in weights:
                    weights[len(path)] = (np.arange(1 << len(path))[:, None] >> np.arange(len(path)) & 1).astype(float)
                pattern = np.zeros(len(codes), dtype=np.int64)
                for i, (f, _, nodes, lefts) in enumerate(path):
                    passed = codes >> list(above).index(f) & 1 if f in above else np.ones_like(codes)
                    for n, go in zip(nodes, lefts):
                        if n in bit:
                            passed = passed & (bit[n] if go else 1 - bit[n])
                    pattern += passed << i
                values = w * value * shapley_weights(weights[len(path)], share)
                for i, (f, *_) in enumerate(path):
                    tables[f] = tables.get(f, 0.0) + values[pattern, i]
            if tables:
                out.append((t, list(above.values()), splits, tables))
    return out, base


def shapley_values(x: np.ndarray, forest: dict, paths=None) -> tuple[np.ndarray, np.ndarray]:
    """(n x f exact Shapley values, n base values) in margin units for a batch; ``paths`` of :func:`shapley_paths` may be given."""
    blocks, base = paths or shapley_paths(forest)
    contrib, tree = np.zeros(x.shape[::-1]), -1
    for t, above, splits, tables in blocks if len(x) else ():
        if t != tree:
            feat = forest["feat"][t]
            tree, goes = t, {n: x[:, feat[n]] <= forest["thr"][t][n] for n in np.flatnonzero(forest["left"][t] >= 0)}
        code = np.zeros(len(x), dtype=np.uint16 if len(above) + len(splits) <= 16 else np.int64)
        for i, nodes in enumerate(above):
            passed = np.ones(len(x), dtype=bool)
            for n, left in nodes:
                passed &= goes[n] if left else ~goes[n]
            code |= passed * code.dtype.type(1 << i)
        for i, n in enumerate(splits, len(above)):
            code |= goes[n] * code.dtype.type(1 << i)
        at = code.astype(np.intp)
        for f, table in tables.items():
            contrib[f] += table.take(at)
    return np.ascontiguousarray(contrib.T), np.full(len(x), base)


ATTRIBUTIONS = {"shapley": shapley_values, "path": path_contributions}


def add_contributions(scored: DataFrame, model: PipelineModel, cfg: ModelConfig, method: str = "shapley") -> DataFrame:
    """Scored rows -> + ``contrib`` (array<double>, log-odds per feature) and ``base_value`` (H1), by one of ``ATTRIBUTIONS``.

    Only the feature array goes to Python, in Arrow batches; a query that uses neither column has no
    Python in its plan.
    """
    bc, attribute = scored.sparkSession.sparkContext.broadcast(forest_arrays(model)), ATTRIBUTIONS[method]

    width = len(cfg.vector_cols)

    @F.arrow_udf("contrib array<double>, base_value double")
    def explain(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        # The paths depend on the forest alone: made once a task.
        known = {"paths": shapley_paths(bc.value)} if attribute is shapley_values else {}
        for x in batches:
            c, b = attribute(_matrix(x, width), bc.value, **known)
            # log-odds = 2 x margin for Spark's logistic boosting
            yield pa.StructArray.from_arrays([_lists(2.0 * c), pa.array(2.0 * b)], names=["contrib", "base_value"])

    vectors = [f.name for f in scored.schema.fields if f.dataType.typeName() == "vector"]
    out = scored.withColumn("_explained", explain(vector_to_array("features"))).drop(*vectors)
    return out.withColumns({"contrib": F.col("_explained.contrib"), "base_value": F.col("_explained.base_value")}).drop("_explained")


def contribution_structs(cfg: ModelConfig, contrib: str = "contrib", values: bool = True) -> Column:
    """``array<struct<feature, value, contribution, pos>>`` in model feature order; without ``values`` no ``value``."""
    slots = {name: i for i, name in enumerate(cfg.vector_features)}
    items = []
    for pos, name in enumerate(cfg.feature_cols):
        raw = F.col(f"{name}__raw") if name not in cfg.cat_cols else F.col(name)
        value = F.round(raw, 6).cast("string") if name not in cfg.cat_cols else raw.cast("string")
        items.append(F.struct(F.lit(name).alias("feature"), *([value.alias("value")] if values else []),
                              F.element_at(F.col(contrib), slots[name] + 1).alias("contribution"),
                              F.lit(pos).alias("pos")))
    return F.array(*items)


def raw_values(cfg: ModelConfig) -> tuple[Column, Column]:
    """The numbers and the texts of the features, each an array in model feature order with null for the other kind."""
    numbers = F.array(*[F.lit(None).cast("double") if c in cfg.cat_cols else F.col(f"{c}__raw") for c in cfg.feature_cols])
    return numbers, F.array(*[F.col(c).cast("string") if c in cfg.cat_cols else F.lit(None).cast("string") for c in cfg.feature_cols])


def with_values(chosen: Column, numbers: Column, texts: Column) -> Column:
    """Ranked structs without ``value`` (``contribution_structs``) -> with it: only the chosen ones are rounded and made text."""
    text = lambda at: F.coalesce(F.element_at(texts, at), F.round(F.element_at(numbers, at), 6).cast("string"))
    return F.transform(chosen, lambda d: F.struct(d["feature"].alias("feature"), text(d["pos"] + 1).alias("value"),
                                                  d["contribution"].alias("contribution"), d["pos"].alias("pos")))
