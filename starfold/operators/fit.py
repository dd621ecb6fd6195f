"""Linear rankers and classifiers over event folds (X1-X13); single models by ``pyspark.ml``, sets of models in common passes."""

from __future__ import annotations

import math

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import PCA, Interaction, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starfold.core import add_position, as_list, checkpoint, dot, hash_int, hash_position
from starfold.functions.scalars import hash_half, hash_order, tilt_probabilities
from starfold.operators import metrics as M
from starfold.operators.batchfit import coefficient_table, fit_models, loeo_ridge_coefficients, softmax

SHRINK = 0.02  # fixed value: strength of the pull of segment offsets to their event mean, per item


# --- folds -------------------------------------------------------------------------------------------------------


def fold_by_event(items: DataFrame, event: str, k: int, seed: str) -> DataFrame:
    """Events in SHA-256 order of ``seed:event``, dealt to k folds with stride k."""
    e = items.select(event).distinct().withColumn("__o", hash_order(seed, F.col(event)))
    first = F.conv(F.substring("__o", 1, 3), 16, 10).cast("long")
    return add_position(e, [], ["__o"], first, "__p").select(event, ((F.col("__p") - 1) % k).cast("int").alias("fold"))


def fold_balanced(items: DataFrame, unit, k: int, seed: str) -> DataFrame:
    """Whole units, largest first, each into the fold with the fewest items so far; equal sizes in hash order.

    The greedy rule only depends on the sizes.  The driver handles the histogram of distinct sizes (bounded by the
    square root of twice the table); for equal sizes it yields a short lead-in and then a fixed cycle of folds.
    """
    unit = as_list(unit)
    sizes = items.groupBy(*unit).agg(F.count(F.lit(1)).alias("__size"))
    sizes = checkpoint(sizes.withColumn("__key", F.concat_ws("|", *[F.col(c).cast("string") for c in unit])))
    load, plan = [0] * k, []
    for size, count in sizes.groupBy("__size").count().orderBy(F.col("__size").desc()).toLocalIterator():
        lead: list[int] = []
        while len(lead) < count and max(load) - min(load) >= size:
            f = load.index(min(load))
            lead.append(f)
            load[f] += size
        cycle = sorted(range(k), key=lambda f: (load[f], f))
        rest = count - len(lead)
        for i, f in enumerate(cycle):
            load[f] += size * (rest // k + (1 if i < rest % k else 0))
        plan.append((size, lead, cycle))
    table = items.sparkSession.createDataFrame(plan, "__size long, __lead array<int>, __cycle array<int>")
    r = hash_position(sizes, "__size", seed, "__key", "__r").join(table, "__size")
    n = F.size("__lead")
    fold = F.when(F.col("__r") <= n, F.try_element_at("__lead", F.col("__r").cast("int"))).otherwise(
        F.element_at("__cycle", ((F.col("__r") - n - 1) % k + 1).cast("int")))
    return r.select(*unit, F.col("__size").alias("items"), fold.alias("fold"))


# --- four classes ------------------------------------------------------------------------------------------------


def converged(model):
    """The fitted model, or an error with its trace when the solver stopped at its iteration limit."""
    history = model.summary.objectiveHistory
    if model.summary.totalIterations >= model.getMaxIter():
        raise RuntimeError(f"the fit did not converge in {model.getMaxIter()} iterations; objectives {history[:2]} ... {history[-2:]}")
    return model


def class_weights(items: DataFrame, event: str, label: str, mode: str = "event") -> DataFrame:
    """``weight`` with equal mass per event, or per event and class, summing to 1 over the fitted rows."""
    if mode not in ("event", "event_class"):
        raise ValueError("unknown weighting")
    cells = items.groupBy(event, label).agg(F.count(F.lit(1)).alias("__nc"))
    events = cells.groupBy(event).agg(F.sum("__nc").alias("__ne"), F.count(F.lit(1)).alias("__cls"))
    total = events.agg(F.count(F.lit(1)).alias("__events"))
    j = items.join(cells, [event, label]).join(events, event).crossJoin(F.broadcast(total))  # one row
    w = 1 / F.col("__ne") if mode == "event" else 1 / (F.col("__nc") * F.col("__cls"))
    return j.withColumn("weight", w / F.col("__events")).drop("__nc", "__ne", "__cls", "__events")


def fit_four_class(items: DataFrame, event: str, features: str, label: str, penalty: float, mode: str = "event", max_iter: int = 1_000) -> LogisticRegressionModel:
    """Multinomial softmax with L2 on the coefficients only."""
    d = class_weights(items, event, label, mode).select(array_to_vector(features).alias("features"), F.col(label).cast("double").alias("label"), "weight")
    d = checkpoint(d)  # the solver reads its input more than once
    return converged(LogisticRegression(
        family="multinomial", weightCol="weight", regParam=penalty, elasticNetParam=0.0, standardization=False, maxIter=max_iter, tol=1e-8).fit(d))


def predict_classes(model: LogisticRegressionModel, items: DataFrame, features: str, out: str = "p") -> DataFrame:
    """Class probabilities as an array column."""
    model.setFeaturesCol("features__")
    d = model.transform(items.withColumn("features__", array_to_vector(features)))
    return d.withColumn(out, vector_to_array("probability")).drop("features__", "rawPrediction", "probability", "prediction")


def oof_predict(items: DataFrame, folds: DataFrame, event: str, key: str, features: str, label: str, penalties: list[float], mode: str = "event") -> DataFrame:
    """Out-of-fold class probabilities for every penalty: ``(penalty, key, event, label, p)``.

    All folds and penalties are fitted in common passes over the items; a fold is scored by the models fitted without it.
    """
    d = checkpoint(class_weights(items.select(key, event, F.col(features).cast("array<double>").alias("x"), label).join(folds, event), event, label, mode))
    ks = [r[0] for r in d.select("fold").distinct().orderBy("fold").collect()]
    if not ks:
        return d.select(F.lit(0.0).alias("penalty"), key, event, label, F.lit(None).cast("array<double>").alias("p"))
    width, classes = d.agg(F.first(F.size("x")), F.max(label) + 1).first()
    sets = F.array_compact(F.array(*[F.when(F.col("fold") != k, F.lit(i)) for i, k in enumerate(ks)]))
    models = [(i, float(p)) for p in penalties for i in range(len(ks))]
    theta = fit_models(d.select("x", F.col(label).cast("int").alias("y"), F.col("weight").alias("w"), sets.alias("sets")), models, width, int(classes), intercept=True)
    table = coefficient_table(d, list(range(len(models))), theta, "model", "coef")
    out = d.withColumn("__i", F.array_position(F.array(*[F.lit(k) for k in ks]), F.col("fold")).cast("int") - 1)
    out = out.withColumn("__p", F.explode(F.array(*[F.struct(F.lit(float(p)).alias("penalty"), (F.lit(j * len(ks)) + F.col("__i")).cast("long").alias("model")) for j, p in enumerate(penalties)])))
    return out.select(key, event, label, "x", "__p.*").join(table, "model").select("penalty", key, event, label, softmax(F.col("x"), F.col("coef")).alias("p"))


def penalty_report(oof: DataFrame, event: str, label: str, top: int = 3) -> DataFrame:
    """Per penalty macro AP of the top class and macro balanced accuracy, and for each boundary ``k`` below the top the macro
    AP (``ap_macro_k``) of label >= k, ranked by the summed probability of the classes from k on."""
    bounds = range(1, top + 1)
    long = F.explode(F.array(*[F.struct(F.lit(k).alias("boundary"), F.aggregate(F.slice("p", k + 1, top + 1 - k), F.lit(0.0), lambda a, v: a + v).alias("__s")) for k in bounds]))
    d = oof.select("penalty", event, label, long.alias("__b")).select("penalty", event, label, "__b.*")
    ap = M.average_precision(d, ["penalty", "boundary", event], F.col(label) >= F.col("boundary"), "__s")
    ap = ap.groupBy("penalty").agg(*[F.avg(F.when(F.col("boundary") == k, F.col("ap"))).alias("ap_macro" if k == top else f"ap_macro_{k}") for k in reversed(bounds)])
    conf = M.confusion(oof, ["penalty", event], F.col(label), "p", top + 1)
    bal = M.classification_metrics(conf, ["penalty", event], top + 1).groupBy("penalty").agg(F.avg("balanced_accuracy").alias("balanced_macro"))
    return ap.join(bal, "penalty")


def select_by(report: DataFrame, order: list[str]) -> DataFrame:
    """The row that is largest in the listed columns, in that order."""
    return report.orderBy(*[F.col(c).desc_nulls_last() for c in order]).limit(1)


# --- pairs -------------------------------------------------------------------------------------------------------


def difference_rows(pairs: DataFrame, items: DataFrame, key: str, features: str, weight: str | None = None) -> DataFrame:
    """``(features, label, weight)`` with winner - loser; half of the rows, by hash, are turned round (same loss)."""
    side = lambda end: items.select(F.col(key).alias(end), F.col(features).alias(f"__{end}"))
    j = pairs.join(side("winner"), "winner").join(side("loser"), "loser")
    sign = F.when(hash_int("turn", "winner", "loser") % 2 == 1, -1.0).otherwise(1.0)
    diff = F.zip_with("__winner", "__loser", lambda a, b: a.cast("double") - b.cast("double"))
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    j = j.withColumn("__sign", sign)
    return j.withColumn("features", array_to_vector(F.transform(diff, lambda x: x * F.col("__sign")))).withColumn(
        "label", (F.col("__sign") > 0).cast("double")).withColumn("__w", w).drop("__winner", "__loser", "__sign")


def fit_pairwise(pairs: DataFrame, items: DataFrame, key: str, features: str, penalty: float, weight: str | None = None, max_iter: int = 1_000) -> DenseVector:
    """Coefficients of a no-intercept logistic on feature differences."""
    d = difference_rows(pairs, items, key, features, weight).select("features", "label", F.col("__w").alias("weight"))
    d = checkpoint(d)  # the solver reads its input more than once
    model = LogisticRegression(
        fitIntercept=False, weightCol="weight", regParam=penalty, elasticNetParam=0.0, standardization=False, maxIter=max_iter, tol=1e-8).fit(d)
    return converged(model).coefficients


def linear_score(items: DataFrame, features: str, coefficients, out: str = "score") -> DataFrame:
    """Score of a linear model."""
    return items.withColumn(out, dot(F.col(features), F.array(*[F.lit(float(c)) for c in coefficients])))


# --- offsets -----------------------------------------------------------------------------------------------------


def softplus(x: Column) -> Column:
    """``log(1 + exp(x))`` without overflow."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def sigmoid(x: Column) -> Column:
    """``1 / (1 + exp(-x))`` without overflow."""
    small = F.exp(-F.abs(x))
    return F.when(x >= 0, 1 / (1 + small)).otherwise(small / (1 + small))


def inside_gradient(inside: list, u: list[float]) -> list[float]:
    """Gradient by the increments ``u`` of constraints (r_winner, r_loser, w) inside segments."""
    curve, out = {k: sum(u[:k]) for k in range(len(u) + 1)}, [0.0] * len(u)
    for won, lost, w in inside:
        lead = curve[won] - curve[lost]
        small = math.exp(-abs(lead))
        g = -w * (small if lead >= 0 else 1.0) / (1 + small)
        out = [x + g * ((won >= k) - (lost >= k)) for k, x in enumerate(out, 1)]
    return out


def fit_offsets(constraints: DataFrame, items: DataFrame, key: str, rating: str, seg: str, event: str, shrink: float = SHRINK,
                tol: float = 5e-3, levels: int = 5, max_rounds: int = 500) -> tuple[DataFrame, list[float], float]:
    """s = g(rating) + b[segment] from weighted constraints winner > loser.

    The loss is ``softplus(s_loser - s_winner)`` by weight, plus ``shrink`` times the squared distance of each item's offset from
    its event's mean.  g grows by ``u_k >= 0`` per star, so it is monotone and the loss is convex; b is centred over the items.

    Projected gradient steps are scaled by a fixed diagonal (curvature bound) and by the Barzilai-Borwein length of the last step.
    Offsets, their last steps and gradients stay in a Spark table; a round is two joins and one aggregation per segment, and only
    the increments and a few sums reach the driver.  A constraint inside one segment does not depend on its offset nor pull at it,
    so these are summed by their two ratings once and take no part in the joins.  Ends when the gradient norm is at most ``tol`` per unit of constraint weight;
    an error with the trace of norms if ``max_rounds`` do not reach it.  Returns (offsets, g, gradient norm per weight).
    """
    side = lambda end: items.select(F.col(key).alias(end), F.col(rating).alias(f"r_{end}"), F.col(seg).alias(f"s_{end}"))
    c = constraints.join(side("winner"), "winner").join(side("loser"), "loser")
    c = checkpoint(c.groupBy("r_winner", "r_loser", "s_winner", "s_loser").agg(F.sum("weight").alias("w")))
    b = items.groupBy(F.col(seg).alias("seg")).agg(F.first(event).alias("event"), F.count(F.lit(1)).cast("double").alias("n"))
    ends = c.select(F.explode(F.array(F.struct(F.col("s_winner").alias("seg"), "w"), F.struct(F.col("s_loser").alias("seg"), "w"))).alias("x")).select("x.*")
    # curvature of a constraint is at most a quarter of its weight
    b = b.join(ends.groupBy("seg").agg((F.sum("w") / 4).alias("h")), "seg", "left")
    b = checkpoint(b.select("seg", "event", "n", (F.coalesce("h", F.lit(0.0)) + 2 * shrink * F.col("n") + 1e-9).alias("scale"), *[F.lit(0.0).alias(x) for x in ("b", "g", "step")]))
    steps = [(F.col("r_winner") >= k).cast("int") - (F.col("r_loser") >= k).cast("int") for k in range(1, levels + 1)]
    *weights, whole = c.agg(*[F.coalesce(F.sum(F.when(x, F.col("w"))), F.lit(0.0)) for x in (*[x != 0 for x in steps], F.lit(True))]).first()
    inside = c.where("s_winner = s_loser").groupBy("r_winner", "r_loser").agg(F.sum("w").alias("w")).where("w is not null and r_winner is not null and r_loser is not null").collect()  # a row per pair of ratings
    c = checkpoint(c.where("s_winner != s_loser"))
    u, last_u, last_g, scale = [1.0] * levels, [0.0] * levels, [0.0] * levels, [w + 1e-9 for w in weights]
    length, trace = 0.5, []
    for _ in range(max_rounds):
        curve = F.array(*[F.lit(float(sum(u[:k]))) for k in range(levels + 1)])
        off = b.select("seg", "b")
        d = c.join(off.withColumnsRenamed({"seg": "s_winner", "b": "__bw"}), "s_winner").join(off.withColumnsRenamed({"seg": "s_loser", "b": "__bl"}), "s_loser")
        lead = F.element_at(curve, F.col("r_winner") + 1) + F.col("__bw") - F.element_at(curve, F.col("r_loser") + 1) - F.col("__bl")
        d = d.withColumn("__g", -F.col("w") * sigmoid(-lead))
        pull = d.select(F.explode(F.array(
            F.struct(F.col("s_winner").alias("seg"), F.col("__g").alias("p"), *[(F.col("__g") * x).alias(f"u{k}") for k, x in enumerate(steps)]),
            F.struct(F.col("s_loser").alias("seg"), (-F.col("__g")).alias("p"), *[F.lit(0.0).alias(f"u{k}") for k in range(levels)]))).alias("x")).select("x.*")
        pull = pull.groupBy("seg").agg(*[F.sum(x).alias(x) for x in ("p", *[f"u{k}" for k in range(levels)])])
        means = b.groupBy("event").agg((F.sum(F.col("n") * F.col("b")) / F.sum("n")).alias("m"))
        now = b.withColumnRenamed("g", "__old").join(means, "event").join(pull, "seg", "left").fillna(0.0)
        now = checkpoint(now.withColumn("g", F.col("p") + 2 * shrink * F.col("n") * (F.col("b") - F.col("m"))))
        sums = now.agg(*[F.coalesce(F.sum(x), F.lit(0.0)) for x in (F.col("g") * F.col("g"), F.col("step") * F.col("step") * F.col("scale"), F.col("step") * (F.col("g") - F.col("__old")), *[F.col(f"u{k}") for k in range(levels)])]).first()
        grad = [x + y for x, y in zip(sums[3:], inside_gradient(inside, u), strict=True)]
        held = [x <= 0 < g for x, g in zip(u, grad, strict=True)]  # at the bound and pushed against it
        trace.append(math.sqrt(sums[0] + sum(g * g for g, h in zip(grad, held, strict=True) if not h)) / max(whole, 1e-12))
        if trace[-1] <= tol:
            mean = b.agg(F.sum(F.col("n") * F.col("b")) / F.sum("n")).first()[0]
            return b.select("seg", "event", "n", (F.col("b") - float(mean)).alias("b")), [float(sum(u[:k])) for k in range(levels + 1)], trace[-1]
        moved = [x - y for x, y in zip(u, last_u, strict=True)]
        far = sums[1] + sum(m * m * s for m, s in zip(moved, scale, strict=True))
        bend = sums[2] + sum(m * (x - y) for m, x, y in zip(moved, grad, last_g, strict=True))
        if len(trace) > 1:
            length = min(50.0, max(1e-3, far / bend)) if bend > 0 else 1.0
        last_u, last_g = u, grad
        u = [max(0.0, x - length * g / s) for x, g, s in zip(u, grad, scale, strict=True)]
        b = now.select("seg", "event", "n", "scale", (F.col("b") - length * F.col("g") / F.col("scale")).alias("b"), "g", (-length * F.col("g") / F.col("scale")).alias("step"))
    raise RuntimeError(f"offsets did not settle; gradient norms {trace[:3]} ... {trace[-3:]}")


def offset_scores(items: DataFrame, offsets: DataFrame, g: list[float], rating: str, seg: str) -> DataFrame:
    """Latent score of every item."""
    curve = F.array(*[F.lit(float(x)) for x in g])
    j = items.join(offsets.select(F.col("seg").alias(seg), F.col("b").alias("b_seg")), seg)
    return j.withColumn("g", F.element_at(curve, F.col(rating) + 1)).withColumn("score", F.col("g") + F.col("b_seg"))


def offset_gates(constraints: DataFrame, items: DataFrame, key: str, rating: str, seg: str, event: str, hold: float = 0.2, seed: str = "hold", **kw) -> DataFrame:
    """Fit on a hash sample of the constraints and report agreement per kind on the held-out and fitted rest."""
    h = hash_int(seed, "winner", "loser") < int(hold * (1 << 32))
    tagged = checkpoint(constraints.withColumn("held", h))  # for the fit and for the report
    b, g, _ = fit_offsets(tagged.where(~F.col("held")), items, key, rating, seg, event, **kw)
    s = offset_scores(items, b, g, rating, seg)
    o = M.pair_outcomes(tagged, s, key, "score", eps=0.0)
    return M.pair_metrics(o, ["kind", "held"])


# --- leave one event out -----------------------------------------------------------------------------------------


def model_rows(differences: DataFrame, sets: Column, *carried) -> DataFrame:
    """Rows of ``fit_models`` from ``difference_rows``, each in the row sets given by an array of numbers."""
    return differences.select(vector_to_array("features").alias("x"), F.col("label").cast("int").alias("y"), F.col("__w").alias("w"), sets.alias("sets"), *carried)


def numbered(values: list, like: DataFrame, name: str, kind: str) -> DataFrame:
    """Table of values and their place in the list."""
    return like.sparkSession.createDataFrame([(v, i) for i, v in enumerate(values)], f"`{name}` {kind}, code int")


def winner_right(coef: Column) -> Column:
    """1 if the turned difference ``x`` is scored with its label's sign, 0.5 at zero, else 0; NULL without a model."""
    m = dot(F.col("x"), coef[0]) * F.when(F.col("y") == 1, 1.0).otherwise(-1.0)
    return F.when(m == 0, 0.5).when(m > 0, 1.0).when(m < 0, 0.0)


def loeo_pairs(pairs: DataFrame, items: DataFrame, key: str, event: str, features: str, penalty: float, min_pairs: int = 30) -> DataFrame:
    """Per held-out event: fit on pairs that do not touch it, accuracy on pairs inside it and on pairs touching it once.

    All events are fitted in common passes over the pairs.  The event names and one coefficient vector each reach the driver.
    """
    kind = items.schema[event].dataType.simpleString()
    names = [r[0] for r in items.where(F.col(event).isNotNull()).select(event).distinct().orderBy(event).collect()]
    place = numbered(names, items, event, kind)
    code = items.select(key, event).join(place, event)
    end = lambda name: code.select(F.col(key).alias(name), F.col("code").alias(f"__c_{name}"))
    d = difference_rows(pairs.select("winner", "loser").join(end("winner"), "winner").join(end("loser"), "loser"), items, key, features)
    others = F.filter(F.sequence(F.lit(0), F.lit(max(0, len(names) - 1))), lambda i: (i != F.col("__c_winner")) & (i != F.col("__c_loser")))
    both = F.array_distinct(F.array("__c_winner", "__c_loser"))
    rows = checkpoint(model_rows(d, others, both.alias("touched")))
    first = rows.select(F.size("x")).first()
    theta = fit_models(rows, [(i, penalty) for i in range(len(names))], first[0], tol=1e-9) if first else []
    table = coefficient_table(items, names[: len(theta)], theta, event, "coef")
    test = rows.select("x", "y", F.size("touched").alias("__ends"), F.explode("touched").alias("code")).join(place, "code").join(table, event, "left")
    inside = F.col("__ends") == 1
    test = test.withColumn("__ok", winner_right(F.col("coef"))).groupBy(event).agg(
        F.count_if(inside).alias("within_pairs"), F.avg(F.when(inside, F.col("__ok"))).alias("within"),
        F.count_if(~inside).alias("touch_pairs"), F.avg(F.when(~inside, F.col("__ok"))).alias("touch"))
    test = place.select(event).join(test, event, "left").fillna(0, ["within_pairs", "touch_pairs"])
    return test.select(event, "within_pairs", F.when(F.col("within_pairs") >= min_pairs, F.col("within")).alias("within"),
                       "touch_pairs", F.when(F.col("touch_pairs") >= min_pairs, F.col("touch")).alias("touch"))


def loeo_ridge(items: DataFrame, key: str, event: str, features: str, rating: str, alpha: float = 1.0) -> DataFrame:
    """Ridge from features to rating, each event predicted by the others; Spearman per event (diagnostic only)."""
    from starfold.operators.summary import spearman

    coef = loeo_ridge_coefficients(items, event, features, rating, alpha)
    j = items.select(event, F.col(features).alias("__x"), F.col(rating).cast("double").alias("label")).join(coef, event)
    return spearman(j.select(event, "label", dot(F.array_prepend("__x", F.lit(1.0)), F.col("coef")).alias("prediction")), event, "label", "prediction")


# --- probes ------------------------------------------------------------------------------------------------------


def probe_outcomes(pairs: DataFrame, items: DataFrame, key: str, views: dict[str, str], layer: str, folds: DataFrame, event: str, penalty: float,
                   leaky: bool = True, carried: list[str] | None = None) -> DataFrame:
    """Out-of-fold outcome of every pair per feature view: ``(view, layer, split, fold, outcome, carried...)``.

    A fold is tested on pairs with both ends in it and fitted on pairs with neither end in it.  ``leaky`` adds a split of the
    pairs by hash, the upper bound that shares events between fitting and testing.  The models of all layers and folds of a view
    are fitted in common passes; ``carried`` columns of the pairs, such as their star boundary or event, stay for grouping.
    """
    carried = carried or []
    ev = items.select(key, event).join(folds, event)
    end = lambda name: ev.select(F.col(key).alias(name), F.col("fold").alias(f"fold_{name}"))
    base = pairs.select("winner", "loser", layer, *[c for c in carried if c != layer]).join(end("winner"), "winner").join(end("loser"), "loser")
    base = checkpoint(base.withColumn("row_fold", (hash_int("leak", "winner", "loser") % 3).cast("int")))
    layers = [r[0] for r in base.where(F.col(layer).isNotNull()).select(layer).distinct().orderBy(layer).collect()]
    ks = [r[0] for r in folds.select("fold").distinct().orderBy("fold").collect()]
    n = len(ks) + leaky
    base = base.join(numbered(layers, base, layer, base.schema[layer].dataType.simpleString()), layer)
    number = lambda i: F.col("code") * n + i
    fits = [F.when((F.col("fold_winner") != k) & (F.col("fold_loser") != k), number(i)) for i, k in enumerate(ks)]
    tests = [F.when((F.col("fold_winner") == k) & (F.col("fold_loser") == k), F.struct(number(i).alias("model"), F.lit("event").alias("split"), F.lit(k).alias("fold"))) for i, k in enumerate(ks)]
    if leaky:
        fits.append(F.when(F.col("row_fold") != 0, number(n - 1)))
        tests.append(F.when(F.col("row_fold") == 0, F.struct(number(n - 1).alias("model"), F.lit("leaky_rows").alias("split"), F.lit(0).alias("fold"))))
    out = None
    for view, column in views.items():
        d = difference_rows(base, items, key, column)
        rows = checkpoint(model_rows(d, F.array_compact(F.array(*fits)), F.array_compact(F.array(*tests)).alias("tests"), layer, *[c for c in carried if c != layer]))
        first = rows.select(F.size("x")).first()
        theta = fit_models(rows, [(m, penalty) for m in range(len(layers) * n)], first[0]) if first else []
        table = coefficient_table(rows, list(range(len(theta))), theta, "model", "coef")
        t = rows.withColumn("__t", F.explode("tests")).select("x", "y", "__t.*", F.col(layer).alias("layer"), *[c for c in carried if c != "layer"]).join(table, "model")
        part = t.select(F.lit(view).alias("view"), "layer", "split", "fold", winner_right(F.col("coef")).alias("outcome"), *[c for c in carried if c != "layer"])
        out = part if out is None else out.unionByName(part)
    return out


def probe_matrix(pairs: DataFrame, items: DataFrame, key: str, views: dict[str, str], layer: str, folds: DataFrame, event: str, penalty: float,
                 min_test: int = 30, leaky: bool = True, by: list[str] | None = None) -> DataFrame:
    """Accuracy of a pairwise probe per feature view and pair layer: mean and deviation over event folds.

    Folds with fewer than ``min_test`` test pairs are skipped and counted.  ``by`` columns of the pairs (star boundary, event) give
    an arm each: the same out-of-fold outcomes, grouped by that column as ``stratum``; ``arm`` is ``all`` or the column's name.
    """
    by = by or []
    o = probe_outcomes(pairs, items, key, views, layer, folds, event, penalty, leaky, by)
    arms = F.explode(F.array(F.struct(F.lit("all").alias("arm"), F.lit("").alias("stratum")), *[F.struct(F.lit(c).alias("arm"), F.col("layer" if c == layer else c).cast("string").alias("stratum")) for c in by]))
    g = ["view", "layer", "split", "arm", "stratum"]
    rows = o.select("view", "layer", "split", "fold", "outcome", arms.alias("__a")).select("view", "layer", "split", "fold", "outcome", "__a.*")
    rows = rows.groupBy(*g, "fold").agg(F.count("outcome").alias("pairs"), F.avg("outcome").alias("accuracy"))
    ok = F.col("pairs") >= min_test
    return rows.groupBy(*g).agg(
        F.avg(F.when(ok, F.col("accuracy"))).alias("mean"), F.stddev_pop(F.when(ok, F.col("accuracy"))).alias("std"),
        F.count_if(ok).alias("folds"), F.count_if(~ok).alias("skipped"), F.sum("pairs").alias("pairs"))


def conditioned_features(items: DataFrame, event: str, features: str, out: str = "conditioned") -> DataFrame:
    """Event-conditioned features: one-hot event times features."""
    ix = StringIndexer(inputCol=event, outputCol="__ix", stringOrderType="alphabetAsc").fit(items)
    width = items.select(F.size(features)).first()[0]
    names = [f"__x{i}" for i in range(width)]
    d = ix.transform(items).withColumns({n: F.col(features)[i] for i, n in enumerate(names)})
    d = VectorAssembler(inputCols=names, outputCol="__v").transform(d)
    d = OneHotEncoder(inputCols=["__ix"], outputCols=["__oh"], dropLast=False).fit(d).transform(d)
    d = Interaction(inputCols=["__oh", "__v"], outputCol="__i").transform(d)
    return d.withColumn(out, vector_to_array("__i")).drop("__ix", "__oh", "__v", "__i", *names)


def standardise_fit(items: DataFrame, train: Column, features: str, out: str, components: int | None = None) -> DataFrame:
    """Standardise with the training rows' mean and deviation, optionally PCA fitted on the same rows."""
    d = items.withColumn("__v", array_to_vector(features))
    scaler = StandardScaler(inputCol="__v", outputCol="__z", withMean=True, withStd=True).fit(d.where(train))
    d = scaler.transform(d)
    if components is None:
        return d.withColumn(out, vector_to_array("__z")).drop("__v", "__z")
    pca = PCA(k=components, inputCol="__z", outputCol="__p").fit(scaler.transform(items.where(train).withColumn("__v", array_to_vector(features))))
    return pca.transform(d).withColumn(out, vector_to_array("__p")).drop("__v", "__z", "__p")


# --- choices on fitting events -----------------------------------------------------------------------------------


def choose_fusion(pairs: DataFrame, items: DataFrame, key: str, event: str, single: str, extra: str, grid: list[float]) -> DataFrame:
    """Event-macro accuracy of ``single / scale + alpha * extra / scale`` for each alpha; best first, smaller alpha on ties.

    All grid values are scored in one pass over the pairs; scales are the deviations of the pair differences.
    """
    side = lambda end: items.select(F.col(key).alias(end), F.col(event).alias(f"e_{end}"), F.col(single).alias(f"a_{end}"), F.col(extra).alias(f"b_{end}"))
    d = pairs.select("winner", "loser").join(side("winner"), "winner").join(side("loser"), "loser")
    d = checkpoint(d.select(F.col("e_winner").alias(event), (F.col("a_winner") - F.col("a_loser")).alias("a"), (F.col("b_winner") - F.col("b_loser")).alias("b")))
    scale = d.agg(F.stddev_pop("a").alias("sa"), F.stddev_pop("b").alias("sb"))
    g = d.crossJoin(F.broadcast(scale)).withColumn("alpha", F.explode(F.array(*[F.lit(float(x)) for x in grid])))  # one row
    m = F.try_divide("a", "sa") + F.col("alpha") * F.try_divide("b", "sb")
    o = g.withColumn("o", F.when(m == 0, 0.5).when(m > 0, 1.0).otherwise(0.0)).groupBy("alpha", event).agg(F.avg("o").alias("m"))
    return o.groupBy("alpha").agg(F.avg("m").alias("accuracy")).orderBy(F.round("accuracy", 12).desc(), "alpha")


def choose_gamma(items: DataFrame, event: str, label: str, probs: str, signal: str, grid: list[float], top: int = 3) -> DataFrame:
    """Macro AP of the tilted top-class probability for each gamma; best first, then balanced recall, then the smaller gamma.

    All gammas are scored in one pass over the items in long form.
    """
    base = checkpoint(items.select(event, label, probs, signal))
    tilted = F.explode(F.array(*[F.struct(F.lit(float(g)).alias("gamma"), tilt_probabilities(F.col(probs), F.col(signal), g).alias("__p")) for g in grid]))
    t = base.select(event, label, tilted.alias("x")).select(event, label, "x.*").withColumn("__s", F.element_at("__p", top + 1))
    ap = M.average_precision(t, ["gamma", event], F.col(label) >= top, "__s").groupBy("gamma").agg(F.avg("ap").alias("ap_macro"))
    recall = M.classification_metrics(M.confusion(t, ["gamma", event], F.col(label), "__p", top + 1), ["gamma", event], top + 1)
    recall = recall.groupBy("gamma").agg(F.avg("balanced_accuracy").alias("balanced_recall"))
    return ap.join(recall, "gamma").orderBy(F.round("ap_macro", 12).desc(), F.round("balanced_recall", 12).desc(), "gamma")


def learning_curve(items: DataFrame, subsets: DataFrame, event: str, features: str, label: str, penalty: float, top: int = 3) -> DataFrame:
    """X11: per (held-out event, size, draw) of the fold table: top-class AP of a model fitted on those events only.

    All runs are fitted in common passes; rows learn the numbers of their runs from their event.
    """
    name = items.schema[event].dataType.simpleString()
    keys = [tuple(r) for r in subsets.select("held_out", "size", "draw").distinct().orderBy("held_out", "size", "draw").collect()]
    runs = items.sparkSession.createDataFrame([(*k, i) for i, k in enumerate(keys)], f"held_out {name}, size int, draw int, model int")
    d = class_weights(items.select(event, label, F.col(features).cast("array<double>").alias("x")), event, label)
    member = subsets.join(runs, ["held_out", "size", "draw"]).groupBy(event).agg(F.collect_list("model").alias("sets"))
    d = checkpoint(d.join(member, event, "left"))
    first = d.agg(F.first(F.size("x")), F.max(label) + 1).first()
    rows = d.select("x", F.col(label).cast("int").alias("y"), F.col("weight").alias("w"), F.coalesce("sets", F.array().cast("array<int>")).alias("sets"))
    theta = fit_models(rows, [(i, penalty) for i in range(len(keys))], first[0], int(first[1]), intercept=True) if keys and first[0] else []
    table = coefficient_table(items, list(range(len(theta))), theta, "model", "coef")
    p = d.drop("sets").join(runs.withColumnRenamed("held_out", event), event).join(table, "model").withColumnRenamed(event, "held_out")
    p = p.withColumn("__s", F.element_at(softmax(F.col("x"), F.col("coef")), top + 1))
    return M.average_precision(p, ["held_out", "size", "draw"], F.col(label) >= top, "__s").select("held_out", "size", "draw", "ap", "random_ap")


def half_transfer(pairs: DataFrame, items: DataFrame, key: str, event: str, seg: Column, features: str, penalty: float, min_train: int = 20, min_test: int = 5) -> DataFrame:
    """Segments of an event split in two halves by hash; fit on one half, score the other, both ways, against a model
    of the other events.  One row per event with both accuracies.  All models are fitted in common passes."""
    half = items.withColumn("half", hash_half("half", seg)).select(F.col(key).alias("winner"), F.col(event).alias("event"), "half")
    other = items.withColumn("h2", hash_half("half", seg)).select(F.col(key).alias("loser"), F.col(event).alias("e2"), "h2")
    d = checkpoint(pairs.select("winner", "loser").join(half, "winner").join(other, "loser").where("event = e2 and half = h2").drop("e2", "h2"))
    counts = {(r["event"], r["half"]): r["n"] for r in d.groupBy("event", "half").agg(F.count(F.lit(1)).alias("n")).collect()}
    names = sorted({e for e, _ in counts})
    kind = items.schema[event].dataType.simpleString()
    able = [(c, h) for c, e in enumerate(names) for h in (0, 1) if counts.get((e, h), 0) >= min_train and counts.get((e, 1 - h), 0) >= min_test]
    if not able:
        return d.sparkSession.createDataFrame([], f"event {kind}, pairs long, within double, cross double")
    n = len(names)
    d = difference_rows(d.join(numbered(names, d, "event", kind), "event"), items, key, features)
    crossed = F.filter(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: i != F.col("code"))
    rows = checkpoint(model_rows(d, F.array_append(crossed, F.col("code") * 2 + F.col("half").cast("int") + n), "event", "half", "code"))
    models = [*range(n), *[n + 2 * c + h for c, h in able]]
    theta = fit_models(rows, [(m, penalty) for m in models], rows.select(F.size("x")).first()[0])
    own = coefficient_table(d, models[n:], theta[n:], "own_model", "own")
    cross = coefficient_table(d, models[:n], theta[:n], "code", "cross")
    o = rows.withColumn("own_model", (F.col("code") * 2 + 1 - F.col("half") + n).cast("long")).join(own, "own_model").join(cross, "code", "left")
    return o.groupBy("event").agg(F.count(F.lit(1)).alias("pairs"), F.avg(winner_right(F.col("own"))).alias("within"), F.avg(winner_right(F.col("cross"))).alias("cross"))


# --- gates -------------------------------------------------------------------------------------------------------


def stage_gate(report: DataFrame, value: str, floor: float, kill_below: float, low: str, high: str) -> DataFrame:
    """Pass when the value reaches the floor and the interval is above zero; kill when it is below ``kill_below`` or the
    interval covers zero; weak otherwise."""
    ok = (F.col(value) >= floor) & (F.col(low) > 0)
    kill = (F.col(value) < kill_below) | ((F.col(low) <= 0) & (F.col(high) >= 0))
    return report.withColumn("verdict", F.when(ok, "pass").when(kill, "kill").otherwise("weak"))


def control_columns(items: DataFrame, key: str, tier: str, seed: str = "control") -> DataFrame:
    """A noise column that must fail a gate and a noisy-truth column that must pass it."""
    u = [(hash_int(f"{seed}{i}", key) + 1) / float((1 << 32) + 2) for i in range(2)]
    normal = F.sqrt(-2 * F.log(u[0])) * F.cos(2 * math.pi * u[1])
    return items.withColumn("control_noise", normal).withColumn("control_truth", F.col(tier) + 0.5 * normal)
