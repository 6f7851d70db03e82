"""Predicting the day type from weather and calendar with a decision tree.

The tree is grown level by level for all buildings at once. The best split of
every node comes from class counts per distinct feature value, aggregated
map-side, and cumulative sums over those values (at most one value per day, so
at most 366 a year). Each level is one job that leaves a small table of nodes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loadsig.operators.profiles import DAY
from loadsig.session import materialise

# Features of a day in order, and the limits of the tree and split.
FEATURES = ["Temperature", "Solar_Irradiation", "Holiday", "DATE_day_year", "DATE_day_week", "DATE_weekday"]
MAX_DEPTH, MIN_LEAF, MIN_SPLIT = 5, 5, 5
TEST_SHARE, SPLIT_SEED = 0.2, 42

TREE_SCHEMA = (
    "building_id string, node int, depth int, feature string, threshold double, n_days bigint, "
    "impurity double, counts array<bigint>, prediction int, is_leaf boolean"
)


def daily_features(df: DataFrame) -> DataFrame:
    """Weather and calendar of each building and day.

    The calendar follows from the day itself; the holiday mark is the first
    known one. Irradiation of a day without values sums to 0.
    """
    day = F.col(DAY)
    return (
        df.groupBy("building_id", F.to_date("DATE").alias(DAY))
        .agg(
            F.avg("Temperature").alias("Temperature"),
            F.coalesce(F.sum("Solar_Irradiation"), F.lit(0.0)).alias("Solar_Irradiation"),
            F.min_by("Holiday", F.when(F.col("Holiday").isNotNull(), F.col("DATE"))).alias("Holiday"),
        )
        .withColumns(
            {
                "DATE_day_year": F.dayofyear(day),
                "DATE_day_week": F.weekday(day),
                "DATE_weekday": F.weekday(day) < 5,
            }
        )
    )


def labelled_days(features: DataFrame, assignments: DataFrame) -> DataFrame:
    """Days with all features and a day type."""
    known = assignments.filter(F.col("cluster").isNotNull())
    return features.na.drop("any", subset=FEATURES).join(known, ["building_id", DAY])


def one_hot(df: DataFrame) -> DataFrame:
    """0/1 columns for both levels of the holiday and weekday marks."""
    levels = {}
    for name in ("Holiday", "DATE_weekday"):
        levels[f"{name}_False"] = (~F.col(name)).cast("int")
        levels[f"{name}_True"] = F.col(name).cast("int")
    return df.withColumns(levels).drop("Holiday", "DATE_weekday")


def class_counts(df: DataFrame, cluster: str = "cluster") -> DataFrame:
    return df.groupBy("building_id", cluster).agg(F.count(F.lit(1)).alias("n_days"))


def stratified_split(days: DataFrame, test_share: float = TEST_SHARE, seed: int = SPLIT_SEED) -> DataFrame:
    """Add ``is_test``: a repeatable hold-out with the same mix of day types.

    ceil(share * n) days of each building are held out; the training days are
    shared over the types by largest remainder. Within a type the order is a
    hash of seed, building and day. Windows see the days of one type of one
    building, at most 366 a year.
    """
    per_class = class_counts(days).withColumnRenamed("n_days", "_n_class")
    building = Window.partitionBy("building_id")
    n, n_class = F.col("_n"), F.col("_n_class")
    n_train = n - F.ceil(F.lit(test_share) * n)
    remainder = Window.partitionBy("building_id").orderBy(F.desc("_rest"), "cluster")
    quotas = (
        per_class.withColumn("_n", F.sum("_n_class").over(building))
        .withColumn("_train", n_train.cast("long"))
        .withColumn("_whole", F.expr("(_n_class * _train) div _n"))
        .withColumn("_rest", (n_class * F.col("_train")) % n)
        .withColumn("_left", F.col("_train") - F.sum("_whole").over(building))
        .withColumn("_quota", n_class - F.col("_whole")
                    - (F.row_number().over(remainder) <= F.col("_left")).cast("long"))
        .select("building_id", "cluster", "_quota")
    )
    draw = F.md5(F.concat_ws("|", F.lit(seed), F.col("building_id"), F.col(DAY)))
    order = Window.partitionBy("building_id", "cluster").orderBy(draw, DAY)
    return (
        days.join(quotas, ["building_id", "cluster"])
        .withColumn("is_test", F.row_number().over(order) <= F.col("_quota"))
        .drop("_quota")
    )


# --- growing the tree ---------------------------------------------------------

def _gini(counts: list[Column], n: Column) -> Column:
    return _impurity(sum((c * c for c in counts[1:]), counts[0] * counts[0]), n)


def _impurity(square: Column, n: Column) -> Column:
    """Gini impurity from the sum of the squared class counts."""
    return F.lit(1.0) - F.try_divide(square.cast("double"), (n * n).cast("double"))


def best_split(days: DataFrame, n_classes: int, min_leaf: int = MIN_LEAF) -> DataFrame:
    """Best threshold of every (building, node) by Gini gain.

    Candidates lie midway between neighbouring distinct values. Equal gains go
    to the earlier feature, then the lower threshold.

    The impurities need the sums of the squared class counts on both sides only.
    Passing a value changes them by what its days change in the counts of their
    classes, so running sums of these changes do for any number of classes.
    """
    values = F.array(
        *[F.struct(F.lit(j).alias("feature_index"), F.col(f).cast("double").alias("value"))
          for j, f in enumerate(FEATURES)]
    )
    keys = ["building_id", "node", "feature_index"]
    own = Window.partitionBy(*keys, "cluster")
    after = F.sum("c").over(own.orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    counts = (
        days.filter(F.col("cluster").between(0, n_classes - 1))
        .select("building_id", "node", "cluster", F.inline(values))
        .groupBy(*keys, "value", "cluster").agg(F.count(F.lit(1)).alias("c"))
        .select(*keys, "value", "c", after.alias("l"), (F.sum("c").over(own) - after).alias("r"))
        .groupBy(*keys, "value").agg(
            F.sum("c").alias("c"), F.sum(F.col("c") * (2 * F.col("l") - F.col("c"))).alias("more"),
            F.sum(F.col("c") * (2 * F.col("r") + F.col("c"))).alias("less"))
    )
    feature = Window.partitionBy(*keys)
    upto = feature.orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    cum = counts.select(
        *keys, "value", F.lead("value").over(feature.orderBy("value")).alias("next_value"),
        F.sum("c").over(upto).alias("n_left"), F.sum("c").over(feature).alias("n"),
        F.sum("more").over(upto).alias("square_left"), F.sum("more").over(feature).alias("square"),
        F.sum("less").over(upto).alias("less"),
    ).filter(F.col("next_value").isNotNull())
    n, n_left, n_right = F.col("n"), F.col("n_left"), F.col("n") - F.col("n_left")
    left, right = _impurity(F.col("square_left"), n_left), _impurity(F.col("square") - F.col("less"), n_right)
    gain = _impurity(F.col("square"), n) - (n_left * left + n_right * right) / n
    name = F.element_at(F.array(*[F.lit(f) for f in FEATURES]), F.col("feature_index") + 1)
    scored = cum.filter((n_left >= min_leaf) & (n_right >= min_leaf)).select(
        "building_id", "node", "feature_index", name.alias("feature"),
        ((F.col("value") + F.col("next_value")) / 2.0).alias("threshold"),
        gain.alias("gain"), n_left.alias("n_left"), n_right.alias("n_right"),
    )
    rank = F.struct(-F.round("gain", 9), F.col("feature_index"), F.col("threshold"))
    return (
        scored.groupBy("building_id", "node")
        .agg(F.min_by(F.struct("feature", "threshold", "gain", "n_left", "n_right"), rank).alias("s"))
        .select("building_id", "node", "s.*")
    )


def node_table(days: DataFrame, n_classes: int) -> DataFrame:
    """Class counts, impurity and majority class of each node."""
    counts = [F.sum((F.col("cluster") == c).cast("long")) for c in range(n_classes)]
    listed = F.array(*[F.col(f"c{c}") for c in range(n_classes)])
    return (
        days.groupBy("building_id", "node")
        .agg(F.count(F.lit(1)).alias("n_days"), *[x.alias(f"c{c}") for c, x in enumerate(counts)])
        .select(
            "building_id", "node", "n_days",
            _gini([F.col(f"c{c}") for c in range(n_classes)], F.col("n_days")).alias("impurity"),
            listed.alias("counts"),
            (F.array_position(listed, F.array_max(listed)) - 1).cast("int").alias("prediction"),
        )
    )


def _feature_value(feature: Column) -> Column:
    pairs = [x for f in FEATURES for x in (F.lit(f), F.col(f).cast("double"))]
    return F.create_map(*pairs)[feature]


def fit_tree(days: DataFrame, max_depth: int = MAX_DEPTH, min_leaf: int = MIN_LEAF, n_classes: int | None = None) -> DataFrame:
    """Tree table of every building, grown on the given (training) days.

    Nodes are numbered like a heap: 1 is the root, 2i and 2i+1 the days at or
    below and above the threshold of node i.
    """
    days = materialise(days.select("building_id", *FEATURES, "cluster"), "training-days")
    if n_classes is None:
        n_classes = int(days.agg(F.max("cluster")).first()[0]) + 1
    rows = days.withColumn("node", F.lit(1))
    levels = []
    for depth in range(max_depth + 1):
        nodes = node_table(rows, n_classes)
        if depth < max_depth:
            splits = best_split(rows, n_classes, min_leaf).select("building_id", "node", "feature", "threshold")
            worth = (F.col("impurity") > 0) & (F.col("n_days") >= MIN_SPLIT)
            nodes = nodes.join(splits, ["building_id", "node"], "left").withColumns(
                {c: F.when(worth, F.col(c)) for c in ("feature", "threshold")}
            )
        else:
            nodes = nodes.withColumns({"feature": F.lit(None).cast("string"), "threshold": F.lit(None).cast("double")})
        level = materialise(
            nodes.select(
                "building_id", "node", F.lit(depth).alias("depth"), "feature", "threshold", "n_days",
                "impurity", "counts", "prediction", F.col("feature").isNull().alias("is_leaf"),
            ),
            "tree-level",
        )
        levels.append(level)
        inner = level.filter("NOT is_leaf").select("building_id", "node", "feature", "threshold")
        if inner.isEmpty():
            break
        above = (_feature_value(F.col("feature")) > F.col("threshold")).cast("int")
        rows = (
            rows.join(inner, ["building_id", "node"])
            .withColumn("node", F.col("node") * 2 + above)
            .drop("feature", "threshold")
        )
    tree = levels[0]
    for level in levels[1:]:
        tree = tree.unionByName(level)
    return tree


def predict_day_type(days: DataFrame, tree: DataFrame, name: str = "cluster_PRED") -> DataFrame:
    """Add the predicted day type.

    The nodes of a building travel as one map, so days are joined once and walk
    down the tree inside the row, as deep as the building's tree is.
    """
    node = F.struct("feature", "threshold", "prediction", "is_leaf")
    trees = tree.groupBy("building_id").agg(
        F.map_from_entries(F.collect_list(F.struct("node", node))).alias("_tree"),
        F.greatest(F.max("depth"), F.lit(1)).alias("_depth"),
    )

    def step(node: Column, _) -> Column:
        here = F.element_at("_tree", node)
        above = (_feature_value(here["feature"]) > here["threshold"]).cast("int")
        return F.when(here["is_leaf"], node).otherwise(node * 2 + above)

    leaf = F.aggregate(F.sequence(F.lit(1), F.col("_depth")), F.lit(1), step)
    return (
        days.join(trees, "building_id")
        .withColumn(name, F.element_at("_tree", leaf)["prediction"])
        .drop("_tree", "_depth")
    )


def tree_table(tree: DataFrame) -> DataFrame:
    """The content of a tree picture, one line of text per node."""
    rule = F.concat_ws(" ", F.col("feature"), F.lit("<="), F.round("threshold", 6).cast("string"))
    return tree.select(
        "building_id", "node", "depth",
        F.when(F.col("is_leaf"), F.lit("leaf")).otherwise(rule).alias("rule"),
        "n_days", "impurity", "counts", "prediction",
    )


# --- evaluation ---------------------------------------------------------------

def confusion_cells(days: DataFrame, actual: str = "cluster", predicted: str = "cluster_PRED") -> DataFrame:
    return days.groupBy("building_id", F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(
        F.count(F.lit(1)).alias("n")
    )


def confusion_long(cells: DataFrame) -> DataFrame:
    """One row per building and pair of its own classes, filled with 0."""
    classes = cells.select("building_id", F.explode(F.array("actual", "predicted")).alias("c")).distinct()
    frame = classes.withColumnRenamed("c", "actual").join(classes.withColumnRenamed("c", "predicted"), "building_id")
    return frame.join(cells, ["building_id", "actual", "predicted"], "left").select(
        "building_id", "actual", "predicted", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def confusion_matrix(cells: DataFrame, classes: list[int] | None = None) -> DataFrame:
    """Actual rows by predicted columns, filled with 0 for every class: the
    classes that occur in any building, unless they are given."""
    if classes is None:
        labels = cells.select(F.explode(F.array("actual", "predicted")).alias("c")).filter("c IS NOT NULL")
        classes = sorted(r["c"] for r in labels.distinct().collect())
    counted = cells.groupBy("building_id", "actual").agg(
        *[F.sum(F.when(F.col("predicted") == c, F.col("n")).otherwise(0)).alias(f"Predicted_{c}") for c in classes]
    )
    frame = cells.select("building_id").distinct().withColumn(
        "actual", F.explode(F.array(*[F.lit(c) for c in classes]))
    )
    columns = [F.coalesce(F.col(f"Predicted_{c}"), F.lit(0)).alias(f"Predicted_{c}") for c in classes]
    return frame.join(counted, ["building_id", "actual"], "left").select("building_id", "actual", *columns)


def classification_report(cells: DataFrame, digits: int | None = 2) -> DataFrame:
    """Precision, recall, F1 and support of each class and their averages.

    Scores are rounded half to even. The accuracy line repeats its value in
    every column.
    """
    n, hit = F.col("n"), F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)
    zero = F.lit(0).cast("long")
    shares = F.array(
        F.struct(F.col("actual").alias("label"), n.alias("support"), zero.alias("claimed"), hit.alias("hits")),
        F.struct(F.col("predicted").alias("label"), zero.alias("support"), n.alias("claimed"), zero.alias("hits")),
    )
    per_class = (
        cells.select("building_id", F.inline(shares))
        .groupBy("building_id", "label")
        .agg(F.sum("support").alias("support"), F.sum("claimed").alias("claimed"), F.sum("hits").alias("hits"))
    )

    def ratio(a, b) -> Column:
        return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))

    hits, support, claimed = F.col("hits"), F.col("support"), F.col("claimed")
    scores = {"precision": ratio(hits, claimed), "recall": ratio(hits, support),
              "f1_score": ratio(hits * 2, claimed + support)}
    scored = per_class.withColumns(scores)

    weighted = {s: ratio(F.sum(F.col(s) * support), F.sum(support)) for s in scores}
    accuracy = ratio(F.sum(hits), F.sum(support))
    summary = scored.groupBy("building_id").agg(
        accuracy.alias("acc"),
        *[F.avg(s).alias(f"macro_{s}") for s in scores],
        *[w.alias(f"weighted_{s}") for s, w in weighted.items()],
        F.sum("support").cast("double").alias("n"),
    )

    def line(label: str, prefix: str | None) -> Column:
        cols = [F.lit(label).alias("label")]
        cols += [F.col("acc" if prefix is None else f"{prefix}_{s}").alias(s) for s in scores]
        return F.struct(*cols, F.col("acc" if prefix is None else "n").alias("support"))

    lines = F.array(line("accuracy", None), line("macro avg", "macro"), line("weighted avg", "weighted"))
    report = scored.select(
        "building_id", F.col("label").cast("string").alias("label"), *scores, support.cast("double").alias("support")
    ).unionByName(summary.select("building_id", F.inline(lines)))
    if digits is None:
        return report
    return report.withColumns({s: F.bround(s, digits) for s in scores})


def accuracy(days: DataFrame, actual: str = "cluster", predicted: str = "cluster_PRED") -> DataFrame:
    return days.groupBy("building_id").agg(
        F.count(F.lit(1)).alias("n_days"),
        F.avg((F.col(actual) == F.col(predicted)).cast("double")).alias("accuracy"),
    )


def accuracy_by_day(days: DataFrame, actual: str = "cluster", predicted: str = "cluster_PRED") -> DataFrame:
    return days.select(
        "building_id", DAY, F.col(actual).alias("actual"), F.col(predicted).alias("predicted"),
        (F.col(actual) == F.col(predicted)).cast("int").alias("correct"),
    )
