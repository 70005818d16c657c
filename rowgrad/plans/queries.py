"""The registered queries: every operator over the whole given tables.

Weights come from integer formulas instead of random draws, so that SQL can build the same ones.
Results are flat rows with values rounded to six places.
"""

from __future__ import annotations

from datetime import datetime

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import losses, parsing
from ..functions.optim import Adam, Momentum, RMSProp
from ..functions.parsing import CLASS_FIRST, MULTI_TARGET, TARGET_LAST, Layout
from ..operators import batching, evaluate, gradients, messages, network, params, ranking
from ..operators.batching import BatchPlan
from ..operators.network import MSE, ModelSpec, conv_model, dense_model
from ..operators.params import Parameters
from ..operators.scoring import score
from ..session import materialize, scratch_path
from ..sources import sinks, tables, text
from ..streaming import messages as message_stream
from ..streaming import rows as row_stream
from ..streaming import snapshots
from . import replay, train

CLASSIFIER = dense_model([64, 16, 10], keep_prob=1.0)
REGRESSOR = dense_model([49, 8, 15], loss=MSE, keep_prob=1.0)
FLAG_MODEL = dense_model([4, 8, 1], loss=MSE, keep_prob=1.0)
SOFTMAX = dense_model([64, 10], optimizer=Adam(lr=0.05), keep_prob=1.0)
IMAGE_MODEL = conv_model(8, (2, 3), 8, 10, keep_prob=1.0)
LOG_MODEL = dense_model([3, 1], optimizer=Adam(lr=0.001), keep_prob=1.0)
FLAG_SCALE = 1000.0  # prices are large and not scaled; the weights are

MAX_AGE_S = 100
SEED = 7


def formula_weights(model: ModelSpec, scale: float = 1.0) -> list[np.ndarray]:
    """``((i*(31+2l) + j*(17+6l)) % 101 - 50) / 250`` and biases ``((13j + l) % 7 - 3) / 20``."""
    out = []
    for layer, stage in enumerate(model.stages):
        i, j = np.indices(stage.shape)
        divisor = 250.0 * (scale if layer == 0 else 1.0)
        out.append(((i * (31 + 2 * layer) + j * (17 + 6 * layer)) % 101 - 50) / divisor)
        out.append(((np.arange(stage.shape[1]) * 13 + layer) % 7 - 3) / 20.0)
    return out


def rounded(column: Column | str, places: int = 6) -> Column:
    return F.round(column, places) + F.lit(0.0)


def _embeddings(spark: SparkSession, d: str) -> DataFrame:
    return tables.class_rows(tables.read_table(spark, d, "embeddings"))


def _events(spark: SparkSession, d: str) -> DataFrame:
    return tables.read_table(spark, d, "events")


def _flag_rows(spark: SparkSession, d: str) -> DataFrame:
    return tables.single_target_rows(tables.read_table(spark, d, "lineitem"))


def _spread(column: str, names: list[str]) -> list[Column]:
    return [F.get(column, F.lit(i)).alias(n) for i, n in enumerate(names)]


# ---- parsing ------------------------------------------------------------------------------------


def _scan_of(spark: SparkSession, line: DataFrame, name: str) -> DataFrame:
    """Write lines as text files and scan them back."""
    path = scratch_path(spark, name)
    line.write.text(path)
    return text.read_lines(spark, path)


def _class_line() -> Column:
    return F.concat_ws(",", F.col("label").cast("string"), F.col("features").cast("array<string>"))


def parse_class_first(spark, d):
    lines = _scan_of(spark, _embeddings(spark, d).select(_class_line().alias("value")), "class-first")
    rows = parsing.parse_lines(lines, Layout(CLASS_FIRST, 64, 10, min_len=2))
    return rows.select("label", *_spread("features", [f"x{i}" for i in range(64)]))


def parse_target_last(spark, d):
    item = _flag_rows(spark, d)
    line = F.concat_ws(",", F.col("features").cast("array<string>"), F.col("target").cast("array<string>"))
    lines = _scan_of(spark, item.select(line.alias("value")), "target-last")
    rows = parsing.parse_lines(lines, Layout(TARGET_LAST, 4, 1))
    return rows.select(*_spread("features", ["quantity", "price", "discount", "tax"]), *_spread("target", ["target"]))


def parse_multi_target(spark, d):
    values = F.col("features").cast("array<string>")
    line = F.concat_ws(",", values, F.lit("ignored"))
    lines = _scan_of(spark, _embeddings(spark, d).select(line.alias("value")), "multi-target")
    rows = parsing.parse_lines(lines, Layout(MULTI_TARGET, 49, 15))
    return rows.select(*_spread("features", [f"x{i}" for i in range(49)]), *_spread("target", [f"y{i}" for i in range(15)]))


def scan_line_numbers(spark, d):
    """Line numbers of a scan do not depend on the splits: every file is numbered 0 … n-1."""
    lines = _scan_of(spark, _events(spark, d).select(F.col("event_id").cast("string").alias("value")), "numbered")
    files = lines.groupBy("file_path").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("line_no").alias("first"),
        F.max("line_no").alias("last"),
        F.sum("line_no").alias("total"),
        F.sum(F.col("value").cast("long")).alias("ids"),
    )
    right = (F.col("first") == 0) & (F.col("last") == F.col("n") - 1) & (F.col("total") * 2 == F.col("n") * F.col("last"))
    return files.agg(F.sum("n").alias("n_lines"), F.bool_and(right).alias("all_numbered"), F.sum("ids").alias("id_sum"))


def one_hot_label(spark, d):
    hot = _embeddings(spark, d).select("vec_id", parsing.one_hot(F.col("label"), CLASSIFIER.n_out).alias("hot"))
    return hot.select("vec_id", *_spread("hot", [f"c{i}" for i in range(10)]))


def features_to_float(spark, d):
    padded = F.transform(F.col("features").cast("array<string>"), lambda x: F.concat(F.lit(" "), x, F.lit(" ")))
    fields = _embeddings(spark, d).select("vec_id", parsing.fields_of(F.concat_ws(",", padded)).alias("fields"))
    return fields.select("vec_id", F.posexplode(parsing.features_to_float(F.col("fields"))).alias("pos", "x"))


def drop_bad_lines(spark, d):
    def every(n):
        return F.col("vec_id") % n == 0

    good = _class_line()
    line = (
        F.when(every(10), "")
        .when(every(17), F.concat_ws(",", (F.col("label") + 10).cast("string"), F.col("features").cast("array<string>")))
        .when(every(23), "7")
        .when(every(29), F.concat(good, F.lit(",x")))
        .otherwise(good)
    )
    lines = _scan_of(spark, _embeddings(spark, d).select(line.alias("value")), "bad-lines")
    return parsing.reject_counts(lines, Layout(CLASS_FIRST, 64, 10, min_len=2))


# ---- samples and batches ------------------------------------------------------------------------


def limited_take(spark, d):
    return ranking.first_rows(_events(spark, d).select("event_id", "user_id", "value"), ["event_id"], 2500)


def warmup_holdout(spark, d):
    return ranking.without_first_rows(_events(spark, d).select("event_id", "user_id", "value"), ["event_id"], 2000)


def _batched(df: DataFrame, plan: BatchPlan) -> DataFrame:
    """Batches with as many hash ranges as the table needs; at least four, so that small tables take the same path as large ones."""
    return batching.assign_batches(df, plan, cells=max(4, batching.cells_for(df.count())))


EVENT_PLAN = BatchPlan(("event_id",), n_parts=8, batch_size=50, seed=SEED, hashing="md5")
EVENT_PLAN_ALL = BatchPlan(("event_id",), n_parts=8, batch_size=0, seed=SEED, hashing="md5")


def assign_minibatch(spark, d):
    batched = _batched(_events(spark, d).select("event_id"), EVENT_PLAN)
    return batched.select("event_id", "part_id", "batch_id", "batch_rows", "group_id", "group_batches")


def assign_minibatch_all(spark, d):
    batched = batching.assign_batches(_events(spark, d).select("event_id"), EVENT_PLAN_ALL)
    return batched.select("event_id", "part_id", "batch_id", "batch_rows")


FAST_PLAN = BatchPlan(("event_id",), n_parts=8, batch_size=50, seed=SEED)


def assign_minibatch_fast_hash(spark, d):
    """Batches by Spark's own hash, which SQL can't repeat: how many rows, batches and groups there are, and whether their sizes are right."""
    batched = _batched(_events(spark, d).select("event_id"), FAST_PLAN)
    batches = batched.groupBy("part_id", "batch_id", "group_id", "batch_rows", "group_batches").agg(F.count(F.lit(1)).alias("n"))
    full = F.sum(F.when(F.col("n") < FAST_PLAN.batch_size, 1).otherwise(0))
    parts = batches.groupBy("part_id").agg(
        F.sum("n").alias("n"),
        full.alias("short"),
        F.bool_and(F.col("n") == F.col("batch_rows")).alias("sized"),
        (F.max("batch_id") + 1 == F.count(F.lit(1))).alias("dense"),
        F.bool_and(F.floor(F.col("batch_id") / FAST_PLAN.push_every) == F.col("group_id")).alias("grouped"),
    )
    right = F.col("sized") & F.col("dense") & F.col("grouped") & (F.col("short") <= 1)
    return parts.agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_parts"), F.bool_and(right).alias("all_right"))


def push_groups(spark, d):
    batched = _batched(_events(spark, d).select("event_id"), EVENT_PLAN)
    return batching.push_groups(batched, EVENT_PLAN.push_every)


def warmup_slices(spark, d):
    usable = F.col("event_type") != "error"
    return batching.warmup_slices(_events(spark, d), ["event_id"], 2000, 50, usable).select("event_id", "slice_id")


def warmup_slices_count_skipped(spark, d):
    usable = F.col("event_type") != "error"
    sliced = batching.warmup_slices(_events(spark, d), ["event_id"], 2000, 50, usable, count_skipped=True)
    return sliced.select("event_id", "slice_id")


REPARTITION_PLAN = BatchPlan(("event_id",), n_parts=32, batch_size=50, seed=SEED, hashing="md5")
MOVED_ROWS = 1_000_000  # a task gets about so many rows of an epoch at most


def epoch_repartition(spark, d):
    """Two epochs: every row once in each, in a logical partition and a task drawn anew; two tasks for each partition, more for many rows."""
    events = _events(spark, d).select("event_id")
    slices = max(2, -(-events.count() // (REPARTITION_PLAN.n_parts * MOVED_ROWS)))

    def one(epoch):
        moved = batching.redistribute(events, REPARTITION_PLAN, epoch, slices)
        return moved.select(F.lit(epoch).alias("epoch"), "event_id", "part_id", "task_id")

    return one(0).unionByName(one(1))


# ---- scoring and errors -------------------------------------------------------------------------


def _scored(spark, d, keep=("vec_id", "label")):
    return score(_embeddings(spark, d), CLASSIFIER, formula_weights(CLASSIFIER), list(keep))


def _flag_scored(spark, d):
    return score(_flag_rows(spark, d), FLAG_MODEL, formula_weights(FLAG_MODEL, FLAG_SCALE), ["target"])


def dense_forward(spark, d):
    scored = _scored(spark, d, ["vec_id"])
    return scored.select("vec_id", F.posexplode("scores").alias("c", "s")).select("vec_id", "c", rounded("s").alias("score"))


def conv_forward(spark, d):
    scored = score(_embeddings(spark, d), IMAGE_MODEL, formula_weights(IMAGE_MODEL), ["vec_id"])
    return scored.select("vec_id", F.posexplode("scores").alias("c", "s")).select("vec_id", "c", rounded("s").alias("score"))


def predict_argmax(spark, d):
    return evaluate.with_prediction(_scored(spark, d, ["vec_id"])).select("vec_id", "predicted")


def error_rate(spark, d):
    one = evaluate.evaluate(_embeddings(spark, d), CLASSIFIER, formula_weights(CLASSIFIER))
    return one.select("n", rounded("error").alias("error"))


def accuracy(spark, d):
    scored = evaluate.with_prediction(_scored(spark, d, ["label"]))
    return scored.agg(rounded(losses.accuracy(F.col("predicted"), F.col("label"))).alias("accuracy"))


def softmax_xent(spark, d):
    loss = losses.softmax_xent(F.col("scores"), F.col("label"))
    return _scored(spark, d).select("vec_id", rounded(loss).alias("xent"))


def mse_loss(spark, d):
    one = evaluate.evaluate(_flag_rows(spark, d), FLAG_MODEL, formula_weights(FLAG_MODEL, FLAG_SCALE))
    return one.select("n", rounded("error").alias("mse"))


VECTOR_PLAN = BatchPlan(("vec_id",), n_parts=4, batch_size=50, seed=SEED, hashing="md5")


def _written_batches(spark, d):
    batched = _batched(_embeddings(spark, d), VECTOR_PLAN)
    return materialize(batched.select("part_id", "batch_id", "label", "features"), "batches")


def partition_eval(spark, d):
    batched = _written_batches(spark, d)
    weights = formula_weights(CLASSIFIER)
    per_part = materialize(evaluate.partition_errors(batched, CLASSIFIER, weights), "part-errors")
    first = evaluate.partition_errors(batched, CLASSIFIER, weights, first_batch_only=True)
    means = {
        "weighted": evaluate.mean_partition_error(per_part),
        "unweighted": evaluate.mean_partition_error(per_part, weighted=False),
        "first_batch_unweighted": evaluate.mean_partition_error(first, weighted=False),
    }
    out = per_part.select(F.lit("part").alias("scope"), "part_id", "error")
    for scope, mean in means.items():
        out = out.unionByName(mean.select(F.lit(scope).alias("scope"), F.lit(-1).alias("part_id"), "error"))
    return out.select("scope", "part_id", rounded("error").alias("error"))


# ---- gradients and updates ----------------------------------------------------------------------


def _flat_gradient(gradient: DataFrame, by: list[str] | tuple[str, ...] = (), places: int = 6) -> DataFrame:
    rows = gradient.select(*by, "layer", "name", "chunk", F.posexplode("values").alias("_i", "_g"))
    index = (F.col("chunk") * params.CHUNK + F.col("_i")).cast("int").alias("idx")
    return rows.select(*by, "layer", "name", index, rounded("_g", places).alias("g"))


def batch_gradient_xent(spark, d):
    batched = _batched(_embeddings(spark, d), VECTOR_PLAN)
    got = gradients.batch_gradients(batched, CLASSIFIER, formula_weights(CLASSIFIER))
    return _flat_gradient(got, ["part_id", "batch_id"])


def batch_gradient_mse(spark, d):
    rows = tables.multi_target_rows(tables.read_table(spark, d, "embeddings"))
    batched = _batched(rows, VECTOR_PLAN)
    got = gradients.batch_gradients(batched, REGRESSOR, formula_weights(REGRESSOR))
    return _flat_gradient(got, ["part_id", "batch_id"])


DROPPER = dense_model([64, 16, 10], optimizer=Adam(lr=0.01), keep_prob=0.5)


def batch_gradient_dropout(spark, d):
    """Batch gradients with half of the hidden units dropped, drawn by row and unit."""
    batched = _batched(_embeddings(spark, d), VECTOR_PLAN)
    return _flat_gradient(gradients.batch_gradients(batched, DROPPER, formula_weights(DROPPER), dropout_salt=3), ["part_id", "batch_id"])


def _lines_in_thousands(spark, d):
    """Order lines in three parts; features in thousands keep the sums comparable to a few places."""
    rows = tables.read_table(spark, d, "lineitem").withColumn("part_id", F.col("l_linenumber") % 3)
    target = F.array((F.col("l_returnflag") == "R").cast("double")).alias("target")
    scaled = [F.col(c) / 1000.0 for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")]
    return rows.select("part_id", target, F.array(*scaled).alias("features"))


def gradient_sum(spark, d):
    """Sum of the squared-error gradients of all order lines."""
    got = gradients.gradient_sum(_lines_in_thousands(spark, d), FLAG_MODEL, formula_weights(FLAG_MODEL))
    return _flat_gradient(got, places=2)


def conv_gradient(spark, d):
    """Summed gradient of the image network over all embeddings."""
    return _flat_gradient(gradients.gradient_sum(_embeddings(spark, d), IMAGE_MODEL, formula_weights(IMAGE_MODEL)))


GROUP_PLAN = BatchPlan(("vec_id",), n_parts=3, batch_size=25, push_every=3, seed=SEED, hashing="md5")


def gradient_mean(spark, d):
    batched = _batched(_embeddings(spark, d), GROUP_PLAN)
    got = gradients.group_gradients(batched, CLASSIFIER, formula_weights(CLASSIFIER))
    return _flat_gradient(got, ["part_id", "group_id"])


MESSAGE_PLAN = BatchPlan(("vec_id",), n_parts=3, batch_size=0, seed=SEED, hashing="md5")


def _three_updates(spark, model: ModelSpec, start: list[np.ndarray], pushed: DataFrame) -> DataFrame:
    """Apply the gradients of parts 0, 1 and 2 in turn, as table joins."""
    table = params.to_table(spark, model, Parameters.fresh(start, model.optimizer))
    for part in range(3):
        table = params.apply_gradient(table, pushed.filter(F.col("part_id") == part), model.optimizer)
    return table


def _flat_table(table: DataFrame, model: ModelSpec, keep: tuple[str, ...] = ("step",)) -> DataFrame:
    names = ["values", *model.optimizer.slots]
    lanes = table.select("layer", "name", "chunk", *keep, F.posexplode(F.arrays_zip(*names)).alias("_i", "_x"))
    index = (F.col("chunk") * params.CHUNK + F.col("_i")).cast("int").alias("idx")
    values = [rounded(F.col("_x")[n]).alias("value" if n == "values" else n) for n in names]
    return lanes.select("layer", "name", index, *values, *keep)


def adam_update(spark, d):
    model = dense_model([64, 16, 10], optimizer=Adam(lr=0.01), keep_prob=1.0)
    batched = batching.assign_batches(_embeddings(spark, d), MESSAGE_PLAN)
    pushed = materialize(gradients.group_gradients(batched, model, formula_weights(model)), "pushed")
    return _flat_table(_three_updates(spark, model, formula_weights(model), pushed), model)


def rmsprop_update(spark, d):
    model = dense_model([49, 8, 15], loss=MSE, optimizer=RMSProp(lr=0.01), keep_prob=1.0)
    rows = tables.multi_target_rows(tables.read_table(spark, d, "embeddings"))
    batched = batching.assign_batches(rows, MESSAGE_PLAN)
    pushed = materialize(gradients.group_gradients(batched, model, formula_weights(model)), "pushed")
    return _flat_table(_three_updates(spark, model, formula_weights(model), pushed), model)


MOMENTUM_MODEL = dense_model([4, 8, 1], loss=MSE, optimizer=Momentum(lr=1e-4, momentum=0.9995), keep_prob=1.0)


def _line_messages(spark, d, model: ModelSpec, start: list[np.ndarray]) -> DataFrame:
    """Three messages: mean gradients of the order lines by line number modulo three."""
    sums = gradients.gradient_sum(_lines_in_thousands(spark, d), model, start, ["part_id"])
    return sums.withColumn("values", F.transform("values", lambda g: g / F.col("n_rows")))


def momentum_update(spark, d):
    start = formula_weights(MOMENTUM_MODEL)
    pushed = materialize(_line_messages(spark, d, MOMENTUM_MODEL, start), "pushed")
    return _flat_table(_three_updates(spark, MOMENTUM_MODEL, start, pushed), MOMENTUM_MODEL)


def params_roundtrip(spark, d):
    """Save after one update, load, take over on the driver and hand out again."""
    start = formula_weights(MOMENTUM_MODEL)
    pushed = _line_messages(spark, d, MOMENTUM_MODEL, start).filter(F.col("part_id") == 0)
    table = params.to_table(spark, MOMENTUM_MODEL, Parameters.fresh(start, MOMENTUM_MODEL.optimizer))
    path = scratch_path(spark, "model")
    params.save_params(params.apply_gradient(table, pushed, MOMENTUM_MODEL.optimizer), path)
    taken = params.collect_params(params.load_params(spark, path), MOMENTUM_MODEL)
    return _flat_table(params.to_table(spark, MOMENTUM_MODEL, taken), MOMENTUM_MODEL)


# ---- training -----------------------------------------------------------------------------------

WARMUP_ROWS, WARMUP_BATCH = 150, 50
TRAIN_ROUNDS = 3


def _softmax_start() -> Parameters:
    return Parameters.fresh(formula_weights(SOFTMAX), SOFTMAX.optimizer)


def _params_and_errors(spark: SparkSession, model: ModelSpec, fit: train.Fit) -> DataFrame:
    flat = params.flat_values(params.to_table(spark, model, fit.params))
    flat = flat.select(F.col("name").alias("item"), "idx", rounded("values").alias("value"))
    curve = fit.curve_frame(spark).select(F.lit("error").alias("item"), F.col("step").cast("int").alias("idx"), rounded("error").alias("value"))
    return flat.unionByName(curve)


def warmup_curve(spark, d):
    fit = train.fit_warmup(_embeddings(spark, d), SOFTMAX, ["vec_id"], WARMUP_ROWS, WARMUP_BATCH, _softmax_start())
    return _params_and_errors(spark, SOFTMAX, fit)


def _round_plan(rows: DataFrame) -> BatchPlan:
    """Batches just large enough for the whole table to pass in three rounds."""
    plan = BatchPlan(("vec_id",), n_parts=4, batch_size=1, push_every=2, seed=SEED, hashing="md5")
    parts = batching.with_parts(rows.select("vec_id"), plan).groupBy("part_id").count()
    largest = parts.agg(F.max("count")).first()[0]
    size = -(-largest // (plan.push_every * TRAIN_ROUNDS))
    return BatchPlan(plan.key, plan.n_parts, size, plan.push_every, plan.seed, plan.hashing)


def _train(spark, d, mode):
    rows = _embeddings(spark, d)
    fit = train.fit_rounds(rows, SOFTMAX, _round_plan(rows), _softmax_start(), mode=mode, eval_df=rows, eval_every=1)
    return _params_and_errors(spark, SOFTMAX, fit)


def train_rounds(spark, d):
    return _train(spark, d, train.MEAN)


def train_rounds_sequential(spark, d):
    return _train(spark, d, train.SEQUENTIAL)


def train_rounds_deep(spark, d):
    """Three rounds of a network with a hidden stage and dropout."""
    rows = _embeddings(spark, d)
    start = Parameters.fresh(formula_weights(DROPPER), DROPPER.optimizer)
    fit = train.fit_rounds(rows, DROPPER, _round_plan(rows), start, eval_df=rows, eval_every=1, dropout_seed=5)
    flat = params.flat_values(params.to_table(spark, DROPPER, fit.params))
    flat = flat.select(F.concat("name", F.col("layer").cast("string")).alias("item"), "idx", rounded("values").alias("value"))
    curve = fit.curve_frame(spark).select(F.lit("error").alias("item"), F.col("step").cast("int").alias("idx"), rounded("error").alias("value"))
    return flat.unionByName(curve)


def _first_weights(drawn: DataFrame) -> DataFrame:
    rows = drawn.select("chunk", F.posexplode("values").alias("_i", "_v"))
    return rows.select((F.col("chunk").cast("long") * params.CHUNK + F.col("_i")).alias("idx"), rounded("_v").alias("value"))


def init_truncated_normal(spark, d):
    """First weights of a stage with an input for each embedding and sixteen units."""
    return _first_weights(params.truncated_normal(spark, 16 * _embeddings(spark, d).count(), 0.1, SEED))


def init_constant(spark, d):
    return _first_weights(params.constant(spark, 16 * _embeddings(spark, d).count(), 0.1))


def init_xavier_uniform(spark, d):
    return _first_weights(params.xavier_uniform(spark, _embeddings(spark, d).count(), 16, SEED))


REPLAY_WORKERS, REPLAY_ROWS = 8, 20


def _worker_log(rows: DataFrame) -> DataFrame:
    """One message for twenty rows; each of eight workers pulls every 100 s, works for a minute or so, and its message takes up to two minutes."""
    m = F.col("message")
    at = F.lit(datetime(2024, 1, 1)).cast("timestamp")

    def later(moment, seconds):
        return moment + F.make_dt_interval(secs=seconds)

    log = rows.select("message").distinct().withColumn("pulled", later(at, F.floor(m / REPLAY_WORKERS) * 100 + m % REPLAY_WORKERS * 7))
    log = log.withColumn("time_sent", later(F.col("pulled"), 60 + m * 37 % 23))
    return log.withColumn("arrived", later(F.col("time_sent"), m * 7 % 13 * 10))


def train_stale(spark, d):
    """Training with stale gradients: each message is the mean over two batches of ten rows at the version its worker had pulled."""
    rows = _embeddings(spark, d)
    messages_of = rows.select(F.floor(F.col("vec_id") / REPLAY_ROWS).alias("message"), F.lit(0.5).alias("weight"), "label", "features")
    done = replay.replay(messages_of, _worker_log(messages_of), SOFTMAX, _softmax_start(), MAX_AGE_S, eval_df=rows)
    counts = spark.createDataFrame([("received", 0, float(done.received)), ("rejected", 0, float(done.rejected))], "item string, idx int, value double")
    return _params_and_errors(spark, SOFTMAX, done.fit).unionByName(counts)


def held_versions(spark, d):
    """Every event as a message that was pulled for twenty minutes before it was sent: which version its worker held; -1 if rejected."""
    log = _messages(spark, d).select(F.col("id").alias("message"), (F.col("time_sent") - F.make_dt_interval(mins=F.lit(20))).alias("pulled"), "time_sent", "arrived")
    found = replay.held_versions(log, MAX_AGE_S)
    return found.select("message", "received", "accepted", *[F.coalesce(c, F.lit(-1)).alias(c) for c in ("seq", "version")])


def training_log_roundtrip(spark, d):
    path = scratch_path(spark, "curves")
    batched = _written_batches(spark, d)
    for run_id, first_only in (("all_rows", False), ("first_batch", True)):
        errors = evaluate.partition_errors(batched, CLASSIFIER, formula_weights(CLASSIFIER), first_only)
        at = F.lit(datetime(2024, 1, 1)).cast("timestamp").alias("ts")
        step = F.col("part_id").cast("long").alias("step")
        sinks.append_curve(errors.select(F.lit("eval").alias("phase"), at, step, "error"), path, run_id)
    return sinks.read_curve(spark, path).select("run_id", "phase", "step", rounded("error").alias("error"))


# ---- messages and streams -----------------------------------------------------------------------


def _messages(spark, d):
    return tables.gradient_events(_events(spark, d))


def stale_reject(spark, d):
    return messages.with_acceptance(_messages(spark, d), MAX_AGE_S).select("id", "age_us", "accepted")


def gradient_counts(spark, d):
    return messages.message_counts(messages.with_acceptance(_messages(spark, d), MAX_AGE_S))


def eval_cadence(spark, d):
    judged = messages.with_acceptance(_messages(spark, d).select("id", "time_sent", "arrived"), MAX_AGE_S)
    return messages.evaluation_points(judged.select("id", "arrived", "accepted")).select("received", "id")


def _message_stream(spark, d):
    schema = _events(spark, d).schema
    return tables.gradient_events(message_stream.stream_table(spark, f"{d}/events.parquet*", schema))


def stream_stale_reject(spark, d):
    path, mark = scratch_path(spark, "stale"), scratch_path(spark, "stale-checkpoint")
    message_stream.run_counts(message_stream.count_by_acceptance(_message_stream(spark, d), MAX_AGE_S), path, mark)
    return snapshots.latest(spark, path)


def stream_worker_cadence(spark, d):
    path, mark = scratch_path(spark, "cadence"), scratch_path(spark, "cadence-checkpoint")
    message_stream.run_cadence(_message_stream(spark, d), path, mark)
    return message_stream.latest_cadence(spark, path)


def _log_gradients(log: DataFrame) -> DataFrame:
    """A message's gradient: 1, 2 and 3 hundredths of its value for the weights, 4 for the bias."""

    def chunk(name, *factors):
        values = F.array(*[F.col("value") * f for f in factors])
        return F.struct(F.lit(0).alias("layer"), F.lit(name).alias("name"), F.lit(0).alias("chunk"), values.alias("values"))

    both = F.explode(F.array(chunk("W", 0.01, 0.02, 0.03), chunk("b", 0.04)))
    return log.select("id", "time_sent", "arrived", both.alias("_c")).select("id", "time_sent", "arrived", "_c.*")


def stream_apply_log(spark, d):
    path, mark = scratch_path(spark, "updates"), scratch_path(spark, "updates-checkpoint")
    start = params.to_table(spark, LOG_MODEL, Parameters.fresh(formula_weights(LOG_MODEL), LOG_MODEL.optimizer))
    log = _log_gradients(_message_stream(spark, d))
    message_stream.run_updates(log, start, LOG_MODEL.optimizer, ["arrived", "id"], MAX_AGE_S, path, mark)
    return _flat_table(snapshots.latest(spark, path), LOG_MODEL, keep=("step", "received", "rejected"))


MESSAGE_ROWS = 5


def _gradient_messages(spark, d) -> DataFrame:
    """Messages with gradients of five rows each, worked out at the start; the events of their numbers tell when they were sent and came."""
    rows = _embeddings(spark, d).withColumn("message", F.floor(F.col("vec_id") / MESSAGE_ROWS).cast("int"))
    pushed = gradients.gradient_sum(rows, SOFTMAX, _softmax_start().values, ["message"])
    sent = _messages(spark, d).select("id", "time_sent", "arrived")
    return pushed.withColumnRenamed("message", "id").withColumn("id", F.col("id").cast("long")).drop("n_rows").join(sent, "id")


def stream_apply(spark, d):
    """Gradients applied as they arrive, in three lots; the error after every tenth message, where that was accepted.

    The stream is stopped and restarted between the lots, and most evaluations fall inside a micro-batch.
    """
    source, path, mark = (scratch_path(spark, n) for n in ("gradients", "applied", "applied-checkpoint"))
    pushed = materialize(_gradient_messages(spark, d), "gradient-messages")
    numbered = ranking.row_positions(pushed.select("arrived", "id").distinct(), ["arrived", "id"], name="place")
    lots = numbered.withColumn("lot", F.floor((F.col("place") - 1) * 3 / F.lit(numbered.count())).cast("int")).select("id", "lot")
    pushed = materialize(pushed.join(lots, "id"), "gradient-lots", ("lot",))
    start = params.to_table(spark, SOFTMAX, _softmax_start())
    rows = _embeddings(spark, d)
    for lot in range(3):
        pushed.where(F.col("lot") == lot).drop("lot").write.mode("append").parquet(source)
        stream = message_stream.stream_table(spark, source, pushed.drop("lot").schema)
        message_stream.run_updates(
            stream, start, SOFTMAX.optimizer, ["arrived", "id"], MAX_AGE_S, path, mark, measure=lambda states: evaluate.version_errors(rows, SOFTMAX, states)
        )
    flat = params.flat_values(snapshots.latest(spark, path)).select(F.col("name").alias("item"), F.col("idx").cast("long").alias("idx"), rounded("values").alias("value"))
    errors = message_stream.evaluations(spark, path).select(F.lit("error").alias("item"), F.col("mark").alias("idx"), rounded("error").alias("value"))
    return flat.unionByName(errors)


def stream_train(spark, d):
    """The rows arrive in three lots; the stream is stopped and restarted in between."""
    source, path, mark = (scratch_path(spark, n) for n in ("arriving", "trained", "trained-checkpoint"))
    rows = _embeddings(spark, d)
    for lot in range(3):
        rows.filter(F.col("vec_id") % 3 == lot).select(_class_line().alias("value")).write.mode("append").text(source)
        row_stream.train_on_files(spark, source, Layout(CLASS_FIRST, 64, 10, min_len=2), SOFTMAX, _softmax_start(), path, mark)
    return _flat_table(snapshots.latest(spark, path), SOFTMAX)


QUERIES = {
    f.__name__: f
    for f in (
        parse_class_first,
        parse_target_last,
        parse_multi_target,
        scan_line_numbers,
        one_hot_label,
        features_to_float,
        drop_bad_lines,
        limited_take,
        warmup_holdout,
        assign_minibatch,
        assign_minibatch_all,
        assign_minibatch_fast_hash,
        push_groups,
        warmup_slices,
        warmup_slices_count_skipped,
        epoch_repartition,
        dense_forward,
        conv_forward,
        predict_argmax,
        error_rate,
        accuracy,
        softmax_xent,
        mse_loss,
        partition_eval,
        batch_gradient_xent,
        batch_gradient_mse,
        batch_gradient_dropout,
        conv_gradient,
        gradient_sum,
        gradient_mean,
        adam_update,
        momentum_update,
        rmsprop_update,
        params_roundtrip,
        warmup_curve,
        train_rounds,
        train_rounds_sequential,
        train_rounds_deep,
        init_truncated_normal,
        init_constant,
        init_xavier_uniform,
        train_stale,
        held_versions,
        training_log_roundtrip,
        stale_reject,
        gradient_counts,
        eval_cadence,
        stream_stale_reject,
        stream_worker_cadence,
        stream_apply,
        stream_apply_log,
        stream_train,
    )
}
