"""Scoring bundles: a model with its fitted encoder, scaler, feature list and classes in one versioned folder.

``<root>/v-<version>/`` holds Spark's own model files beside fitted state as tables (dictionary, scaler, features,
contract, classes, facts); a row in ``<root>/versions`` is appended last and makes the version visible, so a reader
never meets a half-written one. Everything goes through Spark's readers and writers, so the folder may be in any store.
Scoring raw rows is one lazy plan: contract, encode, scale, select, align, audit, predict, decode.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from datetime import datetime, timezone
from typing import Any, Mapping, Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsframe.operators import encoding, learning
from opsframe.operators.boosting import BoostedClasses
from opsframe.operators.tables import require_columns

FORMAT = 1


@dataclass(frozen=True)
class Bundle:
    """Everything that turns raw rows into decoded predictions."""

    model: learning.Classifier
    categorical: Sequence[str]
    numeric: Sequence[str]
    encoder: encoding.OneHot | encoding.Ordinal | None
    scaler: encoding.Scaler | None
    facts: Mapping[str, Any]
    version: str | None = None

    @property
    def required(self) -> list[str]:
        """Input columns: categorical, scaled and those the model takes as they are, each once."""
        coded = set(self.categorical) if self.encoder else set()
        if isinstance(self.encoder, encoding.OneHot):
            coded |= {f"{c}_{v}" for c, vs in self.encoder.values.items() for v in vs}
        own = [f for f in self.model.features if f not in coded]
        return list(dict.fromkeys([*(self.categorical if self.encoder else []), *(self.scaler.params if self.scaler else []), *own]))

    def contract(self, df: DataFrame) -> DataFrame:
        """``column, state`` with states required, missing and ignored."""
        need = self.required
        rows = [(c, "required" if c in df.columns else "missing") for c in need] + [(c, "ignored") for c in df.columns if c not in need]
        return df.sparkSession.createDataFrame(rows, "column string, state string")

    def matrix(self, df: DataFrame) -> DataFrame:
        """Raw rows as ``_raw`` with the model's features in their order; what is no number is null."""
        need, _ = require_columns(df, self.required)
        work = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_raw"), *[F.col(f"`{c}`") for c in need.columns])
        if self.encoder:
            work = self.encoder.transform(work)
        if self.scaler:
            work = work.withColumns({c: F.col(f"`{c}`").try_cast("double") for c in self.scaler.params})
            work = self.scaler.transform(work)
        absent = [f for f in self.model.features if f not in work.columns]
        if absent:
            raise ValueError(f"the transformed rows lack {len(absent)} features: {', '.join(absent[:10])}")
        number = lambda f: F.nanvl(F.col(f"`{f}`").try_cast("double"), F.lit(None).cast("double")).alias(f)
        return work.select("_raw", *[number(f) for f in self.model.features])

    def audit(self, df: DataFrame) -> DataFrame:
        """``feature, missing``: values that are null or no number after the transforms, from one scan."""
        counts = self.matrix(df).agg(*[F.count_if(F.col(f"`{f}`").isNull()).alias(f"c{i}") for i, f in enumerate(self.model.features)])
        cells = [F.struct(F.lit(f).alias("feature"), F.col(f"c{i}").alias("missing")) for i, f in enumerate(self.model.features)]
        return counts.select(F.explode(F.array(*cells)).alias("p")).select("p.*")

    def score(self, df: DataFrame, incomplete: str = "raise") -> DataFrame:
        """All raw columns with ``y_pred``, ``score`` and ``class_probabilities`` (class to probability).

        Rows with missing values stop the job (``raise``) or stay with ``complete`` false and no prediction (``flag``).
        """
        if incomplete not in ("raise", "flag"):
            raise ValueError(f"unknown handling of incomplete rows: {incomplete}")
        if incomplete == "raise":
            bad = {r["feature"]: r["missing"] for r in self.audit(df).where("missing > 0").limit(10).collect()}
            if bad:
                raise ValueError(f"missing values after the transforms: {bad}")
        work = self.matrix(df)
        whole = F.lit(True)
        for f in self.model.features:
            whole = whole & F.col(f"`{f}`").isNotNull()
        filled = work.withColumn("complete", whole).withColumns({f: F.coalesce(F.col(f"`{f}`"), F.lit(0.0)) for f in self.model.features})
        out = self.model.predict(filled)
        only = lambda c: F.when(F.col("complete"), c)
        found = [only(F.col("y_pred")).alias("y_pred")]
        if "probabilities" in out.columns:
            names = F.array(*[F.lit(c) for c in self.model.classes])
            found += [only(F.col("score")).alias("score"), only(F.map_from_arrays(names, F.col("probabilities"))).alias("class_probabilities")]
        kept = [F.col(f"_raw.`{c}`") for c in df.columns if c not in ("y_pred", "score", "class_probabilities", "complete")]
        return out.select(*kept, "complete", *found)


def fit_bundle(train: DataFrame, label: str, numeric: Sequence[str], categorical: Sequence[str] = (), encoder: str = "onehot", scaler: str | None = "standard",
               kind: str = "forest", features: Sequence[str] | None = None, valid: DataFrame | None = None, facts: Mapping[str, Any] = {}, **params: Any) -> Bundle:
    """Fit encoder, scaler and model on raw training rows; ``features`` selects from the transformed columns."""
    enc = None
    if categorical:
        enc = encoding.fit_onehot(train, categorical) if encoder == "onehot" else encoding.fit_ordinal(train, categorical)
    sc = encoding.fit_scaler(train, numeric, scaler) if scaler and numeric else None

    def shaped(df: DataFrame) -> DataFrame:
        out = df.select(label, *categorical, *numeric)
        out = enc.transform(out) if enc else out
        return sc.transform(out) if sc else out

    data = shaped(train)
    chosen = tuple(features or [c for c in data.columns if c != label])
    model = learning.train(data, label, chosen, kind, valid=shaped(valid) if valid is not None else None, **params)
    return Bundle(model, tuple(categorical), tuple(numeric), enc, sc, {"kind": kind, **facts})


def save_bundle(bundle: Bundle, root: str) -> str:
    """Write a new version and return its name; earlier versions stay."""
    spark = SparkSession.active()
    now = datetime.now(timezone.utc)
    version = f"{now:%Y%m%dT%H%M%S%f}-{uuid.uuid4().hex[:8]}"
    path = f"{root.rstrip('/')}/v-{version}"
    put = lambda name, rows, schema: spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/{name}")
    m = bundle.model
    facts: dict[str, Any] = {"format": FORMAT, "facts": dict(bundle.facts), "model": m.kind, "encoder": None, "scaler": None}
    if isinstance(m.model, learning.Boosted):
        m.model.assembler.save(f"{path}/model/assembler")
        for k, ensemble in enumerate(m.model.boosted.ensembles):
            ensemble.save(f"{path}/model/class-{k}")
        facts["boosted"] = {"start": list(m.model.boosted.start), "rounds": m.model.boosted.rounds}
    else:
        m.model.save(f"{path}/model/pipeline")
    if bundle.encoder:
        facts["encoder"] = "onehot" if isinstance(bundle.encoder, encoding.OneHot) else "ordinal"
        facts["sizes"] = {c: list(v) for c, v in bundle.encoder.dictionary.sizes.items()}
        bundle.encoder.dictionary.table.write.parquet(f"{path}/dictionary")
    if bundle.scaler:
        facts["scaler"] = bundle.scaler.kind
        put("scaler", [(c, float(a), float(b)) for c, (a, b) in bundle.scaler.params.items()], "column string, center double, scale double")
    put("features", list(enumerate(m.features)), "position int, feature string")
    put("classes", list(enumerate(m.classes)), "position int, name string")
    put("contract", [(i, c, c in bundle.categorical) for i, c in enumerate([*bundle.categorical, *bundle.numeric])], "position int, column string, categorical boolean")
    put("facts", [(json.dumps(facts, sort_keys=True),)], "facts string")
    row = [(version, m.kind, now.isoformat())]
    spark.createDataFrame(row, "version string, kind string, created_at string").coalesce(1).write.mode("append").parquet(f"{root.rstrip('/')}/versions")
    return version


def bundle_versions(spark: SparkSession, root: str) -> DataFrame:
    """``version, kind, created_at`` of all complete versions."""
    return spark.read.schema("version string, kind string, created_at string").parquet(f"{root.rstrip('/')}/versions")


def load_bundle(spark: SparkSession, root: str, version: str | None = None) -> Bundle:
    """The named version, or the newest."""
    known = bundle_versions(spark, root)
    found = known.where(F.col("version") == version).first() if version else known.orderBy(F.desc("version")).first()
    if found is None:
        raise ValueError(f"no complete version {version or ''} under {root}")
    path = f"{root.rstrip('/')}/v-{found['version']}"
    rows = lambda name: spark.read.parquet(f"{path}/{name}")
    facts = json.loads(rows("facts").first()["facts"])
    if facts["format"] != FORMAT:
        raise ValueError(f"format {facts['format']} of {path} is not known")
    listed = lambda name, col: tuple(r[col] for r in rows(name).orderBy("position").collect())
    features, classes = listed("features", "feature"), listed("classes", "name")
    contract = rows("contract").orderBy("position").collect()
    categorical = tuple(r["column"] for r in contract if r["categorical"])
    enc = scaler = None
    if facts["encoder"]:
        known_values = encoding.Dictionary(rows("dictionary"), {c: tuple(v) for c, v in facts["sizes"].items()})
        enc = (encoding.OneHot if facts["encoder"] == "onehot" else encoding.Ordinal)(known_values, categorical)
    if facts["scaler"]:
        scaler = encoding.Scaler(facts["scaler"], {r["column"]: (r["center"], r["scale"]) for r in rows("scaler").collect()})
    if "boosted" in facts:
        ensembles = [GBTRegressionModel.load(f"{path}/model/class-{k}") for k in range(len(classes))]
        model: Any = learning.Boosted(learning.VectorAssembler.load(f"{path}/model/assembler"), BoostedClasses(ensembles, facts["boosted"]["start"], facts["boosted"]["rounds"]))
    else:
        model = PipelineModel.load(f"{path}/model/pipeline")
    fitted = learning.Classifier(facts["model"], model, features, classes)
    return Bundle(fitted, categorical, tuple(r["column"] for r in contract if not r["categorical"]), enc, scaler, facts["facts"], found["version"])
