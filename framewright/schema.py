"""The clip manifest: one wide nullable schema, strict validation, JSON Lines and Parquet."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The manifest's fields in their order.
REQUIRED_DDL = (
    "path STRING, label STRING, label_idx INT, split STRING, is_synthetic BOOLEAN, duration_sec DOUBLE, "
    "fps DOUBLE, width INT, height INT, blur_score DOUBLE, motion_score DOUBLE, quality_score DOUBLE"
)
OPTIONAL_DDL = "caption STRING, source_path STRING, phash STRING"
MULTITASK_DDL = (
    "caption_model STRING, flow_path STRING, flow_method STRING, flow_mean_magnitude DOUBLE, "
    "flow_direction_entropy DOUBLE, depth_path STRING, depth_model STRING, depth_variance DOUBLE, depth_mean DOUBLE"
)
GENERATIVE_DDL = "synthesis_method STRING, model_path STRING, lora_path STRING"
GENERATION_CONFIG_DDL = "num_frames INT, height INT, width INT, guidance_scale DOUBLE, num_inference_steps INT, seed INT"
#: What the planned extensions of the manifest carry.
PLANNED_DDL = "camera_pose STRING, seg_mask_path STRING, physics_tags ARRAY<STRING>"


_TYPES = {"STRING": T.StringType(), "INT": T.IntegerType(), "BIGINT": T.LongType(), "DOUBLE": T.DoubleType(), "FLOAT": T.FloatType(), "BOOLEAN": T.BooleanType()}


def schema_of(*ddl: str) -> T.StructType:
    """Fields "name TYPE" divided by commas, TYPE as in _TYPES or ARRAY<TYPE>; works without a session."""

    def kind(text: str) -> T.DataType:
        return T.ArrayType(kind(text[6:-1])) if text.startswith("ARRAY<") else _TYPES[text]

    return T.StructType([T.StructField(*(f(x) for f, x in zip((str, kind), field.split(), strict=True))) for part in ddl for field in part.split(", ")])


MANIFEST_SCHEMA = schema_of(REQUIRED_DDL, OPTIONAL_DDL)
WIDE_SCHEMA = schema_of(REQUIRED_DDL, OPTIONAL_DDL, MULTITASK_DDL, GENERATIVE_DDL, PLANNED_DDL).add("generation_config", schema_of(GENERATION_CONFIG_DDL))
REQUIRED = schema_of(REQUIRED_DDL).names
SWEEP_SCHEMA = schema_of(
    "threshold DOUBLE, class STRING, retention_rate DOUBLE, drift DOUBLE, n_clips_before BIGINT, n_clips_after BIGINT, overall_retention DOUBLE, tvd DOUBLE"
)
VECTOR_SCHEMA = schema_of("path STRING, vector ARRAY<FLOAT>")
SPLITS = ["train", "val", "test"]


class ManifestError(ValueError):
    """A manifest lacks a required field."""


def read_manifest(spark: SparkSession, path: str, schema: T.StructType = WIDE_SCHEMA) -> DataFrame:
    """A JSON Lines manifest; blank lines are skipped, absent fields are null, malformed lines fail."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_manifest_or_empty(spark: SparkSession, path: str | None, schema: T.StructType = WIDE_SCHEMA) -> DataFrame:
    """As read_manifest; a manifest that does not exist has no rows."""
    from pyspark.errors import AnalysisException

    if path is not None:
        try:
            return read_manifest(spark, path, schema)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
    return spark.createDataFrame([], schema)


def missing_fields(df: DataFrame) -> DataFrame:
    """(path, missing): rows with a required field that is absent or null, and the names of those fields."""
    absent = F.filter(F.array(*(F.when(F.col(c).isNull(), F.lit(c)) if c in df.columns else F.lit(c) for c in REQUIRED)), lambda x: x.isNotNull())
    return df.select("path" if "path" in df.columns else F.lit(None).cast("string").alias("path"), absent.alias("missing")).where(F.size("missing") > 0)


def load_strict(spark: SparkSession, path: str, schema: T.StructType = WIDE_SCHEMA) -> DataFrame:
    """A manifest whose every row has all required fields; ManifestError names the first rows that lack some. The
    rows are read once for the check."""
    df = read_manifest(spark, path, schema)
    lacking = missing_fields(df).limit(5).collect()
    if lacking:
        raise ManifestError("; ".join(f"{r['path']}: {', '.join(r['missing'])}" for r in lacking))
    return df


def validate_manifest(df: DataFrame) -> DataFrame:
    """df itself, if each required column is there with its type; otherwise ManifestError. Reads no rows."""
    have = {f.name: f.dataType for f in df.schema}
    wrong = [f.name for f in schema_of(REQUIRED_DDL) if have.get(f.name) != f.dataType]
    if wrong:
        raise ManifestError(f"required columns are missing or of another type: {', '.join(wrong)}")
    return df


def write_manifest(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON Lines with every field in every line, null ones included."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def union_manifests(*parts: DataFrame) -> DataFrame:
    """All rows; columns that a part lacks are null in its rows."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def with_positions(df: DataFrame, *order: str) -> DataFrame:
    """df with `pos`, the 0-based place of each row by the given columns. The rank is computed by range partitions."""
    from framewright.operators.distribute import global_rank

    return global_rank(df, [F.col(c) for c in order], "pos")
