"""The four classifiers of the ensemble as ``pyspark.ml`` pipelines over a ``tokens`` column.

Each member gives a probability per class for every row. Features of every member have a fixed width
(capped vocabulary, capped n-grams, fixed vectors), so models and broadcasts do not grow with the data.
"""

from __future__ import annotations

import re
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import (
    LogisticRegression,
    MultilayerPerceptronClassifier,
    NaiveBayes,
    RandomForestClassifier,
)
from pyspark.ml.feature import IDF, CountVectorizerModel, NGram, SQLTransformer, VectorAssembler, Word2VecModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.patterns import MAX_WORDS, OOV_ID, SEED, VECTOR_SIZE
from ..functions.text import tokens
from ..session import stage
from . import ngrams, word_vectors
from .dictionary import Dictionary
from .ensemble import N_CLASSES, _p
from .epochs import Epochs, fit_epochs
from .features import Features, with_features
from .manifest import once, pipeline_key, rows_key, text_key
from .ranking import hashed_order
from .tokens import fit_vocabulary

NAMES = {1: "weighted terms, logistic", 2: "word n-grams, bayes", 3: "word vectors, forest", 4: "word vectors, perceptron"}
UNKNOWN = "<unknown>"
#: What members learn from.
TRAIN_COLUMNS = ("post_id", "draw_no", "tokens", "label_id", "weight")


def with_tokens(df: DataFrame, text: str = "cleaned_text", cleaner: str | None = None) -> DataFrame:
    return df.withColumn("tokens", tokens(F.col(text), cleaner))


def _outputs(model_id: int) -> dict[str, str]:
    return {"probabilityCol": f"probability_{model_id}", "predictionCol": f"prediction_{model_id}",
            "rawPredictionCol": f"raw_{model_id}"}


def fitted_words(train: DataFrame, text: str = "cleaned_text", key: str = "post_id", max_words: int = MAX_WORDS) -> list[str]:
    """The capped vocabulary of the train rows in order of its ids: at most ``max_words - 2`` words on the driver."""
    return [r["word"] for r in fit_vocabulary(train, text, key, max_words=max_words).orderBy("idx").select("word").collect()]


def known_words(words: list[str]) -> SQLTransformer:
    """Tokens as ``known``: words outside the vocabulary become the one unknown word. Saved with the pipeline."""
    known = Dictionary({w: i for i, w in enumerate(words)}).known_sql("tokens", UNKNOWN)
    return SQLTransformer(statement=f"SELECT *, {known} AS known FROM __THIS__")


def with_counts(df: DataFrame, stages: list) -> tuple[DataFrame, list]:
    """``df`` with what the opening stages of a member count, and the stages that are left.

    Where these look known words up and count all of them (``logistic_member``), both are one step over ``tokens``. It gives the
    counts that the stages give; any other opening is left to its stages.
    """
    if len(stages) < 2 or not isinstance(stages[0], SQLTransformer) or not isinstance(stages[1], CountVectorizerModel):
        return df, stages
    counter = stages[1]
    *words, last = counter.vocabulary
    plain = counter.getInputCol() == "known" and counter.getMinTF() == 1.0 and not counter.getBinary()
    if not plain or last != UNKNOWN or UNKNOWN in words or stages[0].getStatement() != known_words(words).getStatement():
        return df, stages
    ids = Dictionary({w: i for i, w in enumerate(words)})
    return df.withColumn(counter.getOutputCol(), ids.counts_of(F.col("tokens"), len(words))), stages[2:]


def words_known(look: Transformer) -> list[str] | None:
    """The words that a stage of ``known_words`` looks up; None for any other stage."""
    said = look.getStatement() if isinstance(look, SQLTransformer) else ""
    text = re.search(r"get\(split\('(.*)', '\\n'\), cast\(crc32\(", said, re.DOTALL)
    listed = re.findall(r"(\S+)\t(\d+) ", re.sub(r"\\(.)", r"\1", text[1])) if text else []
    words = [w for w, _ in sorted(listed, key=lambda entry: int(entry[1]))]
    return words if text and len(words) <= MAX_WORDS and known_words(words).getStatement() == said else None


def _counts_known(counter: Transformer, of: str) -> bool:
    """Whether a stage counts all words of the column ``of`` that it lists."""
    return (isinstance(counter, CountVectorizerModel) and counter.getInputCol() == of and counter.getMinTF() == 1.0
            and not counter.getBinary() and len({*counter.vocabulary}) == len(counter.vocabulary))


def _reads(stage: Transformer) -> set[str]:
    """Columns that a stage may read."""
    named = [stage.getOrDefault(p) for p in stage.params if p.name.endswith(("Col", "Cols")) and stage.isDefined(p)]
    return {c for n in named for c in ([n] if isinstance(n, str) else n)}


def _opening(words: list[str], stages: list, asked: Features) -> list | None:
    """Adds to ``asked`` what the stages behind the look-up of ``words`` read from it, and gives the stages that are left.

    None where they are others than those of the four members.
    """
    number = {w: i for i, w in enumerate([*words, UNKNOWN])}
    made, left = {"known"}, [*stages]
    add = []
    while len(left) > 1 and isinstance(left[0], NGram) and left[0].getInputCol() == "known" and left[0].getN() > 1:
        n, counter = left[0].getN(), left[1]
        if not _counts_known(counter, left[0].getOutputCol()):
            return None
        runs = [tuple(number.get(w, -1) for w in run.split(" ")) for run in counter.vocabulary]
        if any(len(run) != n or min(run) < 0 for run in runs):
            return None
        made.add(left[0].getOutputCol())
        add.append(lambda n=n, name=counter.getOutputCol(), runs=runs: asked.runs.update({name: (n, runs)}))
        left = left[2:]
    if not add and left and _counts_known(left[0], "known") and left[0].vocabulary == [*number]:
        add.append(lambda name=left[0].getOutputCol(): asked.counts.append(name))
        left = left[1:]
    elif not add and left and isinstance(left[0], Word2VecModel) and left[0].getInputCol() == "known":
        add.append(lambda model=left[0]: asked.add_mean(_vectors_of(model, [*number]), model.getOutputCol()))
        left = left[1:]
    if not add or any(made & _reads(s) for s in left):
        return None
    for each in add:
        each()
    return left


def _vectors_of(model: Word2VecModel, words: list[str]) -> np.ndarray:
    """The vectors of some words, in their order; zeros for a word without one."""
    found = model.getVectors().select("word", "vector").toArrow()
    rows = np.concatenate([part.field("values").flatten().to_numpy() for part in found["vector"].chunks]).reshape(-1, model.getVectorSize())
    at = {w: i for i, w in enumerate(found["word"].to_pylist())}
    place = np.array([at.get(w, -1) for w in words])
    return np.where(place[:, None] >= 0, rows[place], 0.0).astype(np.float32)


def opened(df: DataFrame, stages: dict[int, list]) -> tuple[DataFrame, dict[int, list]]:
    """``df`` with what the opening stages of members make from ``tokens``, and the stages that are left of each.

    Members that know the same words share one step (``with_features``) for the look-up, the counts of words and of runs and
    the means of vectors, which gives what the stages give. A member that opens otherwise keeps its stages.
    """
    looks, asked, left = {}, {}, dict(stages)
    for m, (look, *rest) in ((m, s) for m, s in stages.items() if s and isinstance(s[0], SQLTransformer)):
        said = look.getStatement()
        if said not in looks:
            looks[said] = words_known(look)
        words = looks[said]
        if words is None or UNKNOWN in words:
            continue
        own = _opening(words, rest, asked.setdefault(said, Features(words)))
        left[m] = left[m] if own is None else own
    for wanted in asked.values():
        if wanted.counts or wanted.runs or wanted.means:
            df = with_features(df, wanted)
    return df, left


def fitted(pipeline: Pipeline, rows: DataFrame, drawn: bool = False) -> PipelineModel:
    """``pipeline.fit(rows)``, where the opening stages are one step (``opened``) in each pass.

    With ``drawn`` it learns from rows drawn by weight (``drawn_by_weight``).
    """
    stages = pipeline.getStages()
    ready, left = opened(rows, {0: stages})
    left = left[0]
    ready = drawn_by_weight(ready) if drawn else ready
    return PipelineModel([*stages[:len(stages) - len(left)], *Pipeline(stages=left).fit(ready).stages])


def predicted(model: PipelineModel, df: DataFrame) -> DataFrame:
    """``model.transform(df)`` without the words that are known, looked up and counted in one step (``with_counts``)."""
    ready, left = with_counts(df, model.stages)
    return PipelineModel(left).transform(ready)


def fit_word_vectors(train: DataFrame, words: list[str], size: int = VECTOR_SIZE, seed: int = SEED) -> PipelineModel:
    """Vectors of the vocabulary and of the unknown word from what stands near what in the train texts (``word_vectors``).

    They follow from the rows and the seed alone. A row counts as often as it is in ``train``.
    """
    known = Dictionary({w: i + 1 for i, w in enumerate(words)})
    ids = train.select(known.numbers_of(F.col("tokens"), unknown=0).alias("sequence"))
    rows = word_vectors.information(word_vectors.cooccurrence(ids))
    named = [UNKNOWN, *words]
    vectors = word_vectors.fitted(rows, len(named), size, seed)
    return PipelineModel([known_words(words), word_vectors.vector_model(train.sparkSession, named, vectors)])


def drawn_by_weight(train: DataFrame, weight: str = "weight", keys: tuple[str, ...] = ("post_id", "draw_no"), seed: int = SEED) -> DataFrame:
    """Rows repeated by their weight, for a learner without weights: the whole part, and once more by chance for the rest."""
    chance = F.conv(F.substring(hashed_order(seed, *keys), 1, 13), 16, 10).cast("double") / float(16 ** 13)
    times = F.floor(weight) + F.when(chance < F.col(weight) - F.floor(weight), 1).otherwise(0)
    return train.withColumn("again", F.explode(F.array_repeat(F.lit(0), times.cast("int")))).drop("again")


def logistic_member(words: list[str], reg: float = 0.01, max_iter: int = 50) -> Pipeline:
    return Pipeline(stages=[
        known_words(words),
        CountVectorizerModel.from_vocabulary([*words, UNKNOWN], inputCol="known", outputCol="tf_1"),
        IDF(inputCol="tf_1", outputCol="tfidf_1"),
        LogisticRegression(featuresCol="tfidf_1", labelCol="label_id", weightCol="weight", regParam=reg,
                           maxIter=max_iter, **_outputs(1)),
    ])


def fitted_grams(train: DataFrame, words: list[str], keys: tuple[str, ...] = ("post_id", "draw_no"), least: int = ngrams.LEAST,
                 most: int = ngrams.MOST) -> dict[int, list[str]]:
    """The frequent runs of known words in the train rows by their size: at most ``most`` of each on the driver."""
    known = Dictionary({w: i + OOV_ID + 1 for i, w in enumerate(words)})
    ids = train.select(*keys, known.numbers_of(F.col("tokens")).alias("sequence"))
    return ngrams.most_frequent(ngrams.frequent(ids, keys=keys, least=least), words, OOV_ID + 1, most)


def ngram_bayes_member(words: list[str], grams: dict[int, list[str]], smoothing: float = 1.0) -> Pipeline:
    """Counts of the frequent runs of two to five words, each run in a place of its own."""
    steps, counted = [], []
    for n in ngrams.SIZES:
        # a size without a frequent run keeps one place that no text fills
        kept = grams.get(n) or [" ".join([UNKNOWN] * n)]
        steps += [NGram(n=n, inputCol="known", outputCol=f"grams_{n}"),
                  CountVectorizerModel.from_vocabulary(kept, inputCol=f"grams_{n}", outputCol=f"counts_{n}")]
        counted.append(f"counts_{n}")
    return Pipeline(stages=[
        known_words(words),
        *steps,
        VectorAssembler(inputCols=counted, outputCol="grams_2_to_5"),
        NaiveBayes(featuresCol="grams_2_to_5", labelCol="label_id", weightCol="weight", smoothing=smoothing, **_outputs(2)),
    ])


def _vector_stages(vectors: PipelineModel, name: str) -> list[Transformer]:
    known, model = vectors.stages
    return [known, model.copy().setOutputCol(name)]


def forest_member(vectors: PipelineModel, trees: int = 20, depth: int = 5, seed: int = SEED) -> Pipeline:
    return Pipeline(stages=[
        *_vector_stages(vectors, "vector_3"),
        RandomForestClassifier(featuresCol="vector_3", labelCol="label_id", weightCol="weight", numTrees=trees,
                               maxDepth=depth, seed=seed, **_outputs(3)),
    ])


def perceptron_member(vectors: PipelineModel, size: int = VECTOR_SIZE, hidden: int = 64, max_iter: int = 60, seed: int = SEED,
                      n_classes: int = N_CLASSES) -> Pipeline:
    return Pipeline(stages=[
        *_vector_stages(vectors, "vector_4"),
        MultilayerPerceptronClassifier(featuresCol="vector_4", labelCol="label_id", layers=[size, hidden, n_classes],
                                       maxIter=max_iter, seed=seed, **_outputs(4)),
    ])


def perceptron_by_epochs(train: DataFrame, val: DataFrame, vectors: PipelineModel, path: str, plan: Epochs | None = None,
                         hidden: int = 64, n_classes: int = N_CLASSES) -> tuple[PipelineModel, DataFrame]:
    """Member 4 trained epoch by epoch with an early stop, and its history; ``path`` keeps the epochs.

    Vectors of the rows are made once and written; an epoch reads those.
    """
    stages = _vector_stages(vectors, "vector_4")
    front = PipelineModel(stages)
    ready = [stage(front.transform(rows).select("vector_4", "label_id"), "vectors") for rows in (drawn_by_weight(train), val)]
    plan = plan or Epochs((vectors.stages[-1].getVectorSize(), hidden, n_classes))
    run = fit_epochs(*ready, plan, path, features="vector_4", outputs=_outputs(4))
    return PipelineModel([*stages, run.model]), run.history


def member_pipelines(words: list[str], vectors: PipelineModel, grams: dict[int, list[str]], n_classes: int = N_CLASSES) -> dict[int, Pipeline]:
    return {1: logistic_member(words), 2: ngram_bayes_member(words, grams), 3: forest_member(vectors),
            4: perceptron_member(vectors, vectors.stages[-1].getVectorSize(), n_classes=n_classes)}


def fit_members(train: DataFrame, pipelines: dict[int, Pipeline], kept_in: str | None = None) -> dict[int, PipelineModel]:
    """Fit all members; their jobs share the cluster. Member 4 takes no weights and learns from rows drawn by weight.

    With a folder in ``kept_in`` each member is saved when it is done, and loaded instead when a run over the same rows with
    the same settings is started again (``manifest``).
    """
    spark = train.sparkSession
    rows = rows_key(train, *TRAIN_COLUMNS) if kept_in else None

    def fit(m: int, pipeline: Pipeline) -> PipelineModel:
        make = lambda: fitted(pipeline, train, drawn=m == 4)
        return once(spark, kept_in, f"member_{m}", text_key([rows, pipeline_key(pipeline)]), make) if kept_in else make()

    with ThreadPoolExecutor(len(pipelines)) as pool:
        running = {m: pool.submit(inheritable_thread_target(spark)(fit), m, pipeline) for m, pipeline in pipelines.items()}
        return {m: task.result() for m, task in running.items()}


def predict_proba(df: DataFrame, models: dict[int, PipelineModel], keep: list[str]) -> DataFrame:
    """Probabilities of all members beside each other: one pass over the rows, no shuffle.

    Each member gives as many as it has learnt classes. Where all open with the same look-up of words, it is done once.
    """
    opening = [model.stages[0] for model in models.values()]
    shared = all(isinstance(s, SQLTransformer) for s in opening) and len({s.getStatement() for s in opening}) == 1
    if shared:
        df = opening[0].transform(df)
    for m, model in models.items():
        before = df.columns
        scored = (PipelineModel(model.stages[1:]) if shared else model).transform(df)
        probs = vector_to_array(f"probability_{m}")
        df = scored.withColumn(f"probs_{m}", probs).select(*before, f"probs_{m}")
    return df.select(*keep, *[F.get(f"probs_{m}", F.lit(k)).alias(_p(m, k)) for m, model in models.items() for k in range(model.stages[-1].numClasses)])


def predict_together(df: DataFrame, models: dict[int, PipelineModel], keep: list[str]) -> DataFrame:
    """What ``predict_proba`` gives, with the openings of all members in one step (``opened``)."""
    ready, left = opened(df, {m: model.stages for m, model in models.items()})
    return predict_proba(ready, {m: PipelineModel(stages) for m, stages in left.items()}, keep)


def select_on_validation(train: DataFrame, val: DataFrame, candidates: list[tuple[str, Pipeline]], model_id: int) -> tuple[PipelineModel, DataFrame]:
    """Fit every candidate on train and keep the one that is best on the fixed validation rows.

    Returns the winner and ``(candidate, val_accuracy, chosen)``; the earlier candidate wins a tie. Candidates are fitted
    side by side; a row without a prediction or label is a miss.
    """
    spark = train.sparkSession

    def attempt(name: str, pipeline: Pipeline) -> tuple[str, PipelineModel, float]:
        model = pipeline.fit(train)
        hit = F.coalesce(F.col(f"prediction_{model_id}") == F.col("label_id"), F.lit(False)).cast("double")
        return name, model, model.transform(val).agg(F.avg(hit)).first()[0] or 0.0

    with ThreadPoolExecutor(len(candidates)) as pool:
        running = [pool.submit(inheritable_thread_target(spark)(attempt), *candidate) for candidate in candidates]
        tried = [task.result() for task in running]
    best = max(tried, key=lambda t: t[2])
    rows = [(name, float(score), name == best[0]) for name, _, score in tried]
    return best[1], spark.createDataFrame(rows, "candidate string, val_accuracy double, chosen boolean")


def save_model(model: PipelineModel, cleaner: str, path: str) -> None:
    """Save a fitted pipeline and the name of the cleaner its texts went through."""
    model.write().overwrite().save(f"{path}/model")
    spark = SparkSession.active()
    spark.range(1).select(F.lit(cleaner).alias("cleaner")).write.mode("overwrite").parquet(f"{path}/settings")


def load_model(spark: SparkSession, path: str) -> tuple[PipelineModel, str]:
    return PipelineModel.load(f"{path}/model"), spark.read.parquet(f"{path}/settings").first()["cleaner"]
