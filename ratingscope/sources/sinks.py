"""Files of runs: result rows, attack summaries and the tables of team dynamics, published together or not at all.

Tables are written by Spark's writers, each task to files of its own, into a staging folder beside the target. When all of them
are there, they are moved to their places, and last a manifest names them. A failing task leaves neither tables nor
staging folder; a folder without its manifest isn't complete.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratingscope.schema import KEYS

MANIFEST = "manifest.json"
#: The columns of result rows and of attack summaries.
RESULT_COLUMNS = ("session", "team", "question", "student_name", "student_email", "model", "iwf", "converged", "iterations", "final_l1_norm")
ATTACK_COLUMNS = ("source", "attack", "model", "mean_delta", "n", "mc_std")


def publish(spark: SparkSession, tables: dict[str, DataFrame], folder: str, kinds: dict[str, str] | None = None) -> list[str]:
    """Write tables as ``folder/name`` (CSV with header, or the kind named), all or none, and the manifest. Returns their names.
    Tables of the same names that are there already are an error."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    top = path(folder)
    fs = top.getFileSystem(conf)
    if taken := [name for name in (*tables, MANIFEST) if fs.exists(path(top, name))]:
        raise FileExistsError(f"{folder} has {', '.join(taken)}")
    stage, moved = path(top, f"_staging-{uuid.uuid4().hex}"), []
    try:
        for name, df in tables.items():
            kind = (kinds or {}).get(name, "csv")
            df.write.format(kind).options(**({"header": True} if kind == "csv" else {})).save(str(path(stage, name)))
        listed = {name: sorted(s.getPath().getName() for s in fs.listStatus(path(stage, name)) if s.getPath().getName().startswith("part-")) for name in tables}
        text = json.dumps({"tables": {name: {"kind": (kinds or {}).get(name, "csv"), "columns": df.columns, "files": listed[name]} for name, df in tables.items()}}, indent=2)
        out = fs.create(path(stage, MANIFEST))
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        for name in (*tables, MANIFEST):
            if not fs.rename(path(stage, name), path(top, name)):
                raise OSError(f"{name} can't be moved to {folder}")
            moved.append(name)
    except BaseException:
        for name in moved:
            fs.delete(path(top, name), True)
        raise
    finally:
        fs.delete(stage, True)
    return list(tables)


def read_published(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables that a complete folder's manifest names."""
    text = "\n".join(r.value for r in spark.read.text(f"{folder}/{MANIFEST}").collect())  # a few lines
    out = {}
    for name, about in json.loads(text)["tables"].items():
        reader = spark.read.format(about["kind"]).options(**({"header": True, "inferSchema": True} if about["kind"] == "csv" else {}))
        out[name] = reader.load(f"{folder}/{name}").select(*about["columns"])
    return out


def result_rows(iwf: DataFrame, ratings: DataFrame, names: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """The ten columns of result files, of runs that didn't fail; ``names`` (csv_path, team, question, email, name)."""
    session = ratings.groupBy(*keys).agg(F.first(F.concat_ws("-", "semester", "year")).alias("session"))
    rows = iwf.where("error is null").join(session, keys).join(names.select(*keys, "email", "name"), [*keys, "email"], "left")
    return rows.select("session", "team", "question", F.col("name").alias("student_name"), F.col("email").alias("student_email"), "model", F.bround("iwf", 4).alias("iwf"), "converged", "iterations", F.col("final_l1").alias("final_l1_norm"))


def attack_rows(summary: DataFrame, source: str = "real") -> DataFrame:
    """The six columns of attack summaries from ``perturb.attack_summary``; ``source`` says what kind of teams they are of."""
    rounded = (F.bround(c, 4).alias(c) for c in ("mean_delta", "mc_std"))
    mean, std = rounded
    return summary.select(F.lit(source).alias("source"), F.col("variant").alias("attack"), "model", mean, "n", std)


def dynamics_tables(parts: dict[str, DataFrame], fits: DataFrame, keys: list[str] = KEYS) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """The six tables of team dynamics and their kinds, from ``atypical.team_dynamics`` and ``archetypes.sweep``."""
    label, delta = parts["classifications"].select(*keys, "label"), parts["deltas"]
    scored = parts["atypicality"].select(*keys, F.col("distance").alias("atypicality"), F.col("flag").alias("atypicality_flag"), (F.col("cause") != "none").alias("degenerate"), F.col("cause").alias("degenerate_cause"))
    far = [c for c in parts["classifications"].columns if c.startswith(("dist_", "weight_"))]
    named = parts["classifications"].select(*keys, F.col("label").alias("dynamic_label"), *far)
    corr = parts["correlation"].select("subset", "n", F.col("r").alias("pearson_r"), F.col("p").alias("p_value"), (F.col("subset") == "clean").alias("degenerate_excluded"))
    tables = {
        "atypicality_summary": corr,
        "classifications": delta.join(scored, keys).join(named, keys),
        "delta_by_label": parts["delta_by_label"],
        "feature_matrix": parts["feature_matrix"].drop("cause").join(delta, keys).join(label.withColumnRenamed("label", "dynamic_label"), keys),
        "archetypes": fits.select("k", "rss", F.col("stability").alias("bootstrap_stability"), "archetypes"),
        "archetype_stability": fits.select("k", "rss", F.col("stability").alias("bootstrap_stability")),
    }
    return tables, {"archetypes": "json"}
