"""A two-stage classifier as an ML estimator: whether a row needs help, then which kind, composed to one distribution."""

from __future__ import annotations

import json

from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class _Columns(Params):
    labelCol = Param(Params._dummy(), "labelCol", "0 for no need, 1 and on for the kinds of need", TypeConverters.toString)  # noqa: N815
    probabilityCol = Param(Params._dummy(), "probabilityCol", "an array with the probability of every label", TypeConverters.toString)  # noqa: N815
    needCol = Param(Params._dummy(), "needCol", "the first stage's probability of a need", TypeConverters.toString)  # noqa: N815
    predictionCol = Param(Params._dummy(), "predictionCol", "the likeliest label, the first of equals", TypeConverters.toString)  # noqa: N815
    kinds = Param(Params._dummy(), "kinds", "number of kinds of need", TypeConverters.toInt)

    def __init__(self, **given: object):
        super().__init__()
        self._setDefault(labelCol="y", probabilityCol="p", needCol="p_need", predictionCol="y_pred", kinds=3)
        self._set(**given)


class TwoStage(Estimator, _Columns):
    """Fits ``first`` on need or none, and ``second`` on the kind of the rows with a need, whose labels it counts from 0.

    Both are estimators with a label and a probability column, or pipelines that end in one. Where the rows have one side
    alone, the first stage is a constant; where those with a need are of one kind, so is the second; without any, the
    kinds share a need's probability evenly. Rows without a label are left out of the fit.
    """

    def __init__(self, first: Estimator, second: Estimator, stageLabelCol: str = "label", stageProbabilityCol: str = "probability", **given: object):  # noqa: N803
        super().__init__(**given)
        self.first, self.second, self.stage = first, second, (stageLabelCol, stageProbabilityCol)

    def _fit(self, rows: DataFrame) -> TwoStageModel:
        y, label = self.getOrDefault("labelCol"), self.stage[0]
        rows = rows.filter(F.col(y).isNotNull())
        n = {int(r[y]): r["count"] for r in rows.groupBy(y).count().collect()}  # a row a label
        kinds = sorted(k - 1 for k in n if k > 0)
        first: Model | int = self.first.fit(rows.withColumn(label, (F.col(y) > 0).cast("double"))) if kinds and n.get(0) else int(bool(kinds))
        needing = sum(c for k, c in n.items() if k > 0)
        second: Model | int | None = None
        if len(kinds) > 1 and needing > 1:
            second = self.second.fit(rows.filter(F.col(y) > 0).withColumn(label, (F.col(y) - 1).cast("double")))
        elif kinds and needing > 1:
            second = kinds[0]
        return TwoStageModel(first, second, self.stage[1], **{p.name: self.getOrDefault(p) for p in self.params})


class TwoStageModel(Model, _Columns, MLWritable, MLReadable):
    """A stage is a fitted model, the class that it always gives, or, for the second, none."""

    def __init__(self, first: Model | int, second: Model | int | None, probability: str = "probability", **given: object):
        super().__init__(**given)
        self.first, self.second, self.probability = first, second, probability

    def _stage(self, rows: DataFrame, stage: Model | int | None, classes: int, name: str) -> DataFrame:
        if isinstance(stage, Model):
            extra = set(rows.columns)
            out = stage.transform(rows)
            p = vector_to_array(F.col(self.probability))
            known = F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda k: F.coalesce(F.get(p, k), F.lit(0.0)))
            return out.withColumn(name, known).drop(*[c for c in out.columns if c not in extra])
        share = [1.0 / classes if stage is None else float(k == stage) for k in range(classes)]
        return rows.withColumn(name, F.array(*[F.lit(v) for v in share]))

    def _transform(self, rows: DataFrame) -> DataFrame:
        kinds = self.getOrDefault("kinds")
        out = self._stage(self._stage(rows, self.first, 2, "_first"), self.second, kinds, "_second")
        parts: list[Column] = [F.col("_first")[0], *[F.col("_first")[1] * F.col("_second")[k] for k in range(kinds)]]
        total = sum(parts[1:], parts[0])
        p = F.when(total > 0, F.array(*[x / total for x in parts])).otherwise(F.array(*[F.lit(0.0)] * (kinds + 1)))
        out = out.withColumn(self.getOrDefault("probabilityCol"), p).withColumn(self.getOrDefault("needCol"), F.col("_first")[1]).drop("_first", "_second")
        q = self.getOrDefault("probabilityCol")
        return out.withColumn(self.getOrDefault("predictionCol"), (F.array_position(q, F.array_max(q)) - 1).cast("int"))

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()


class _Writer(MLWriter):
    def __init__(self, model: TwoStageModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:  # noqa: N802
        m = self.model
        stages = {name: {"class": f"{type(s).__module__}.{type(s).__qualname__}"} if isinstance(s, Model) else {"constant": s} for name, s in (("first", m.first), ("second", m.second))}
        DefaultParamsWriter.saveMetadata(m, path, self.sparkSession, {"stages": json.dumps(stages), "probability": m.probability})
        for name in ("first", "second"):
            if isinstance(stage := getattr(m, name), Model):
                stage.write().overwrite().save(f"{path}/{name}") if self.shouldOverwrite else stage.write().save(f"{path}/{name}")


class _Reader(MLReader):
    def load(self, path: str) -> TwoStageModel:
        about = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        stages = {}
        for name, how in json.loads(about["stages"]).items():
            stages[name] = how.get("constant")
            if "class" in how:
                module, _, kind = how["class"].rpartition(".")
                stages[name] = getattr(__import__(module, fromlist=[kind]), kind).load(f"{path}/{name}")
        out = TwoStageModel(stages["first"], stages["second"], about["probability"])
        DefaultParamsReader.getAndSetParams(out, about)
        return out
