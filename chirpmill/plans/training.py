"""From labelled posts to evaluated members: clean, balance, split, fit, combine, report."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import CLASSES, RESAMPLE_RATIOS, SEED, TEST_SHARE, VAL_SHARE
from ..operators import cleaning, ensemble, labels, members, metrics, sampling, tokens
from ..session import checked_small, stage

ROW_KEYS = ["post_id", "draw_no"]


def prepare(df: DataFrame, cleaner: str = "enhanced", text: str = "text") -> DataFrame:
    """Replace the text by its cleaned form and drop rows that have nothing left."""
    return cleaning.drop_empty(cleaning.with_cleaned(df, cleaner, text)).drop(text)


def training_keys(prepared: DataFrame, balance_after_split: bool = False, ratios: dict[int, float] | None = None,
                  test_share: float = TEST_SHARE, val_share: float = VAL_SHARE, seed: int = SEED) -> DataFrame:
    """``(post_id, draw_no, label_id, split)`` of the balanced and split set; no text takes part.

    The default balances before it splits, so copies of one post can meet on both sides;
    ``balance_after_split`` splits first and balances the train rows only.
    """
    ratios = ratios or RESAMPLE_RATIOS
    if not balance_after_split:
        balanced = stage(sampling.balance(prepared, ratios, seed=seed), "balanced")
        return sampling.stratified_split(balanced, ROW_KEYS, test_share=test_share, val_share=val_share, seed=seed)
    keys = prepared.select("post_id", "label_id")
    split = stage(sampling.stratified_split(keys, ["post_id"], test_share=test_share, val_share=val_share, seed=seed), "split")
    train = sampling.balance(split.where("split = 'train'"), ratios, seed=seed).withColumn("split", F.lit("train"))
    rest = split.where("split <> 'train'").withColumn("draw_no", F.lit(0).cast("long"))
    return train.unionByName(rest)


def train_texts(prepared: DataFrame, keys: DataFrame) -> DataFrame:
    """Each train post once, with ``times``, how often it was drawn: texts are not multiplied."""
    times = keys.where("split = 'train'").groupBy("post_id").agg(F.count("*").alias("times"))
    return prepared.select("post_id", "cleaned_text").join(times, "post_id")


def training_table(prepared: DataFrame, keys: DataFrame) -> DataFrame:
    """Texts, labels and class weights for every row of the set; weights come from the train rows."""
    weights = labels.class_weights(keys.where("split = 'train'"))
    rows = keys.join(prepared.select("post_id", "cleaned_text"), "post_id")
    return members.with_tokens(labels.attach_class_weight(rows, weights))


@dataclass
class Trained:
    """What a run leaves behind."""

    models: dict[int, PipelineModel]
    cleaner: str
    scores: DataFrame
    predictions: DataFrame
    members: DataFrame
    compared: DataFrame
    best: DataFrame
    weights: dict[int, float]
    classes: tuple[str, ...] = CLASSES
    #: Epochs of member 4, where it was trained by epochs.
    history: DataFrame | None = None


def class_names(prepared: DataFrame, classes: tuple[str, ...] | None = None) -> tuple[str, ...]:
    """Names of the classes by their ids: ``classes``, or the sentiments that stand beside the ids, or else by number."""
    sizes = checked_small(prepared.groupBy("label_id").agg(
        F.min("sentiment") if "sentiment" in prepared.columns else F.lit(None).cast("string")), labels.MAX_CLASSES, "classes")
    said = dict(sizes.where("label_id is not null").collect())
    n = max(said, default=0) + 1
    if classes is None:
        classes = CLASSES if set(said.values()) <= {*CLASSES} else tuple(said.get(k) or f"class {k}" for k in range(n))
    if n > len(classes):
        raise ValueError(f"labels name {n} classes, {len(classes)} are given")
    return classes


def fit(labelled: DataFrame, cleaner: str = "enhanced", balance_after_split: bool = False, select_on: str = "test",
        grids: dict[int, list[tuple[str, Pipeline]]] | None = None, classes: tuple[str, ...] | None = None,
        ratios: dict[int, float] | None = None, epochs_in: str | None = None, kept_in: str | None = None) -> Trained:
    """Train the four members and judge them and their four combinations.

    ``select_on`` names the split that picks the combination: 'test' or, free of leaks, 'val'. A member
    named in ``grids`` is the candidate that does best on the validation rows. With a folder in ``epochs_in`` member 4 is
    trained by epochs and stops early, with one in ``kept_in`` a run that was stopped loads its finished members.
    ``classes`` names the classes by their ids; without it their number follows from the labels.
    """
    prepared = stage(prepare(labelled, cleaner), "prepared")
    classes = class_names(prepared, classes)
    n_classes = len(classes)
    keys = stage(training_keys(prepared, balance_after_split, ratios), "keys")
    rows = stage(training_table(prepared, keys), "training", ("split",))
    train, val = rows.where("split = 'train'"), rows.where("split = 'val'")
    words = members.fitted_words(train)
    with ThreadPoolExecutor(2) as pool:  # two runs of jobs that do not wait for each other
        both = [pool.submit(inheritable_thread_target(train.sparkSession)(f), train, words)
                for f in (members.fit_word_vectors, members.fitted_grams)]
        vectors, grams = (task.result() for task in both)
    apart = {*(grids or {}), *([4] if epochs_in else [])}
    pipelines = {m: p for m, p in members.member_pipelines(words, vectors, grams, n_classes).items() if m not in apart}
    models = members.fit_members(train, pipelines, kept_in) if pipelines else {}
    for m, candidates in (grids or {}).items():
        models[m], _ = members.select_on_validation(train, val, candidates, m)
    history = None
    if epochs_in:
        models[4], history = members.perceptron_by_epochs(train, val, vectors, epochs_in, n_classes=n_classes)
    models = dict(sorted(models.items()))
    held_out = rows.where("split <> 'train'")
    wide = stage(members.predict_together(held_out, models, [*ROW_KEYS, "label_id", "split"]), "scores")
    scores = ensemble.long_scores(wide, [*ROW_KEYS, "label_id", "split"], n_classes=n_classes)
    accuracies = ensemble.member_accuracy(scores, ["model_id", "split"], n_classes=n_classes)
    # a row for each member
    weights = {r["model_id"]: r["weight"] for r in ensemble.ensemble_weights(scores.where("split = 'val'"), n_classes=n_classes).collect()}
    predicted = ensemble.with_methods(wide, weights, n_classes=n_classes)
    compared = ensemble.compare_methods(predicted.where(F.col("split") == select_on))
    return Trained(models, cleaner, scores, predicted.where("split = 'test'"), accuracies, compared, ensemble.best_method(compared), weights,
                   classes, history)


def final_report(trained: Trained) -> DataFrame:
    """The classification report of the chosen combination on the test rows."""
    method = trained.best.first()["method"]
    return metrics.classification_report(trained.predictions, pred=f"pred_{method}", classes=trained.classes).withColumn("method", F.lit(method))


def vocabulary(prepared: DataFrame, keys: DataFrame, max_words: int) -> DataFrame:
    """The vocabulary of the train rows, each counted as often as it was drawn."""
    return tokens.fit_vocabulary(train_texts(prepared, keys), weight="times", max_words=max_words)
