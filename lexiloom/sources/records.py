"""Record sources: JSON lines, CSV, zip members, question-and-answer rows, directory listings and fixtures."""

from __future__ import annotations

import hashlib
import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lexiloom.checks import require, require_empty, require_unique
from lexiloom.functions.text import text_hash

# Header of the labelled CSV, and the Q&A row.
CSV_SCHEMA = "id string, prompt_id string, text string, generated string"
QA_SCHEMA = "question string, human_answers array<string>, chatgpt_answers array<string>"
BOM = "﻿"


def read_json_lines(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """Rows of JSON lines; a byte order mark and blank lines are passed over, a malformed line is an error."""
    lines = spark.read.text(path).select(F.regexp_replace("value", f"^{BOM}", "").alias("value"))
    lines = lines.where(F.trim("value") != "")
    return lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def select_records(records: DataFrame, ids: DataFrame | None = None, limit: int | None = None, key: str = "id") -> DataFrame:
    """The records of an allow-list, all of whose ids must be there, the first ``limit`` by id."""
    if ids is not None:
        require_empty(ids.select(key).join(records.select(key), key, "left_anti").distinct(), "ids not found")
        records = records.join(ids.select(key).distinct(), key, "left_semi")
    return records.orderBy(key).limit(limit) if limit is not None else records


def read_labelled_csv(spark: SparkSession, path: str, dataset: str) -> DataFrame:
    """id, text, label, prompt_id, source_group and hashes from a CSV with exactly the expected header."""
    raw = spark.read.csv(path, header=True, schema=CSV_SCHEMA, multiLine=True, quote='"', escape='"', enforceSchema=False, mode="FAILFAST")
    require(raw, {
        "label": ~F.col("generated").isin("0", "1"), "text": F.trim(F.coalesce("text", F.lit(""))) == "",
        "id": F.coalesce("id", F.lit("")) == "", "prompt": F.coalesce("prompt_id", F.lit("")) == "",
    })
    require_unique(raw, "id")
    name = F.lit(dataset + ":")
    return raw.select(
        F.concat(name, "id").alias("id"), "text", F.when(F.col("generated") == "0", "human").otherwise("ai").alias("label"),
        F.concat(name, "prompt_id").alias("prompt_id"), F.concat(name, F.lit("essay:"), "id").alias("source_group"),
        F.lit(None).cast("string").alias("author_id"), F.lit(None).cast("string").alias("generator"), F.lit(dataset).alias("source_dataset"),
        F.sha2("text", 256).alias("content_sha256"), text_hash(F.col("text")).alias("normalized_text_sha256"),
        F.create_map(F.lit("id"), "id", F.lit("prompt_id"), "prompt_id", F.lit("generated"), "generated").alias("source_record"),
    )


def missing_parents(children: DataFrame, key: str, parents: DataFrame, parent_key: str | None = None) -> DataFrame:
    """The distinct keys of ``children`` that no row of ``parents`` has, null among them."""
    held = parents.select(F.col(parent_key or key).alias(key)).distinct()
    return children.select(key).distinct().join(held, key, "left_anti")


def read_essays(spark: SparkSession, essays: str, prompts: str, dataset: str) -> DataFrame:
    """``read_labelled_csv`` whose prompts all stand in a second CSV with the column prompt_id."""
    rows = read_labelled_csv(spark, essays, dataset)
    known = spark.read.csv(prompts, header=True, multiLine=True, quote='"', escape='"').select(F.concat(F.lit(dataset + ":"), "prompt_id").alias("prompt_id"))
    require_empty(missing_parents(rows, "prompt_id", known), "prompts not found")
    return rows


MAX_PREDICTION_ID, MAX_PREDICTION_TEXT = 256, 200_000


def prediction_input_problems(records: DataFrame) -> DataFrame:
    """id, problems array<string> of records (id, text) that a model may not be asked about.

    A repeated id is a problem of each of its rows.
    """
    repeated = records.groupBy("id").count().where("count > 1").select("id", F.lit(True).alias("_repeated"))
    rules = {
        "id": ~F.coalesce(F.length("id").between(1, MAX_PREDICTION_ID), F.lit(False)), "repeated id": F.coalesce("_repeated", F.lit(False)),
        "text": F.coalesce(F.trim("text"), F.lit("")) == "", "too long": F.length("text") > MAX_PREDICTION_TEXT, "invalid characters": ~F.is_valid_utf8("text"),
    }
    problems = F.array_compact(F.array(*(F.when(F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items())))
    return records.join(repeated, "id", "left").select("id", problems.alias("problems"))


# What a release must say of its licence.
RELEASE_LICENSE, RELEASE_STATEMENT = "Attribution 4.0 International (CC BY 4.0)", "licensed under CC BY 4.0"


def release_problems(releases: DataFrame, ref: str, dataset: str) -> DataFrame:
    """id, problems array<string> of releases (id, metadata as JSON, catalog): the two documents must agree on dataset and licence."""
    told = lambda key: F.coalesce(F.get_json_object("metadata", f"$.{key}"), F.lit(""))
    catalog = F.coalesce("catalog", F.lit(""))
    rules = {
        "identity": (told("ref") != ref) | (told("isPrivate") != "false"), "license": told("licenseName") != RELEASE_LICENSE,
        "statement": ~told("description").contains(dataset) | ~told("description").contains(RELEASE_STATEMENT),
        "catalog": ~catalog.contains(ref) | ~catalog.contains(f"{dataset} dataset is {RELEASE_STATEMENT}"),
    }
    return releases.select("id", F.array_compact(F.array(*(F.when(rule, F.lit(name)) for name, rule in rules.items()))).alias("problems"))


def flatten_answers(rows: DataFrame, dataset: str, generator: str = "unnamed model") -> DataFrame:
    """One row an answer from question, human_answers, chatgpt_answers; position and group are kept."""
    numbered = rows.withColumn("row", F.monotonically_increasing_id()) if "row" not in rows.columns else rows
    group = F.concat(F.lit(f"{dataset}:question:"), text_hash(F.col("question")))
    parts = []
    for column, label, made_by in (("human_answers", "human", None), ("chatgpt_answers", "ai", generator)):
        part = numbered.select("row", group.alias("source_group"), F.posexplode(column).alias("position", "text"))
        parts.append(part.select(
            F.concat_ws(":", "source_group", F.lit(label), F.col("row").cast("string"), F.col("position").cast("string")).alias("id"), "row", "text", F.lit(label).alias("label"),
            "source_group", "position", F.lit(made_by).cast("string").alias("generator"), F.sha2("text", 256).alias("content_sha256"), text_hash(F.col("text")).alias("normalized_text_sha256"),
        ))
    return parts[0].unionByName(parts[1])


def zip_members(spark: SparkSession, path: str, most_members: int = 1_000, most_bytes: int = 1 << 28) -> DataFrame:
    """path, member, bytes, sha256, content of the members of archives within a budget of members and bytes each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    members = [m for m in archive.infolist() if not m.is_dir()]
                    if len(members) > most_members or sum(m.file_size for m in members) > most_bytes:
                        raise ValueError(f"{name} exceeds its budget")
                    for member in members:
                        data = archive.read(member)
                        yield pd.DataFrame([{"path": name, "member": member.filename, "bytes": len(data), "sha256": hashlib.sha256(data).hexdigest(), "content": data}])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, member string, bytes long, sha256 string, content binary")


def file_listing(spark: SparkSession, path: str, ignored: list[str] | None = None) -> DataFrame:
    """path, bytes, sha256 of all files under a folder, without those in ignored folders."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    for name in ignored or []:
        files = files.where(~F.col("path").contains(f"/{name}/"))
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def inventory_differences(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """path, problem: files missing, unexpected, or of another size or hash than a manifest (path, bytes, sha256) says."""
    m = manifest.select("path", F.col("bytes").alias("m_bytes"), F.col("sha256").alias("m_sha"))
    both = found.join(m, "path", "full_outer")
    problem = F.when(F.col("sha256").isNull(), "missing").when(F.col("m_sha").isNull(), "unexpected").when(F.col("bytes") != F.col("m_bytes"), "size").when(F.col("sha256") != F.col("m_sha"), "hash")
    return both.select("path", problem.alias("problem")).where("problem is not null")


def verified_cases(spark: SparkSession, path: str, kinds: list[str]) -> DataFrame:
    """Fixture rows (id, title, text, text_sha256, provenance with a kind); the whole file fails if any row does."""
    rows = spark.read.json(path, multiLine=True)
    require(rows, {"hash": F.sha2("text", 256) != F.col("text_sha256"), "kind": ~F.col("provenance.kind").isin(kinds), "id": F.col("id").isNull()})
    return require_unique(rows, "id")


def demo_fixture(records: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """source_group, human_id, ai_id, text: the first group with both labels, with its paragraphs joined.

    ``paragraphs`` has id, text of eligible paragraphs.
    """
    both = records.groupBy("source_group").agg(F.min(F.when(F.col("label") == "human", F.col("id"))).alias("human_id"), F.min(F.when(F.col("label") == "ai", F.col("id"))).alias("ai_id"))
    first = both.where("human_id is not null and ai_id is not null").orderBy("source_group").limit(1)
    h, a = (paragraphs.select(F.col("id").alias(c), F.col("text").alias(c + "_text")) for c in ("human_id", "ai_id"))
    return first.join(h, "human_id").join(a, "ai_id").select("source_group", "human_id", "ai_id", F.concat_ws("\n\n", "human_id_text", "ai_id_text").alias("text"))
