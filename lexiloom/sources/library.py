"""The reference library: a log of deltas, each with its documents, their tokens and their inverted index, merged on reading.

A batch writes a delta of its own: tables of the documents and of their tokens, bucketed by id, the index, bucketed and sorted by gram,
and the ids that it defines or removes. Then a pointer of the next number appears, which names all deltas in order, so a reader sees
one version whole, and a batch costs what it holds, not what is there. Of an id the newest delta counts. ``compact`` makes one delta of the newest ones, or of all.

A search joins the grams of passages with each delta's index, whose buckets are read as they lie: the library is not shuffled. Few grams are
looked up as literals, which prunes buckets and row groups. Then only the tokens of documents that were found are read, again by buckets.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.checks import CheckFailed, require_empty
from lexiloom.functions.text import valid_url, with_words, words
from lexiloom.operators.corpus import leaks
from lexiloom.operators.overlap import SEED, STRIDE
from lexiloom.sources import artifacts
from lexiloom.storage import Scratch, shuffles_cleaned, sorted_once

#: The version of the tables.
VERSION = 2
# The licences admitted, and the limits of a document.
ALLOWED_LICENSES = ["CC0-1.0", "CC-BY-2.0", "CC-BY-2.5", "CC-BY-3.0", "CC-BY-4.0"]
MAX_ID, MAX_TITLE, MAX_TEXT, MAX_PROVIDER, MAX_METADATA, LEAST_WORDS = 256, 2_000, 1_000_000, 100, 100_000, 5
MAX_REQUEST, MAX_REQUEST_WORDS = 50_000, 12_000

SCHEMA = "document_id string, title string, text string, url string, license_id string, license_url string, source_provider string, metadata string, word_count int, content_sha256 string, indexed_at timestamp"


SCHEMA_IN = ["document_id", "title", "text", "url", "license_id", "license_url", "source_provider", "metadata"]

#: Words and documents of a bucket, about; the most buckets of a table (larger deltas have larger ones); the most distinct grams that a search looks up as literals.
BUCKET_TOKENS, BUCKET_DOCUMENTS, MOST_BUCKETS, LITERAL_GRAMS = 4_000_000, 25_000, 50_000, 2_000
_KINDS = {
    "documents": (SCHEMA, "document_id"), "tokens": ("document_id string, words string", "document_id"),
    "index": ("gram string, document_id string, s_pos int", "gram"), "ids": ("document_id string", "document_id"),
}


def admission_problems(word_count: Column | None = None) -> Column:
    """array<string> of what keeps a row of document columns out of the library."""
    c = F.col
    blank = lambda x: F.coalesce(F.trim(x), F.lit("")) == ""
    rules = {
        "document_id": blank(c("document_id")) | (F.length("document_id") > MAX_ID), "title": blank(c("title")) | (F.length("title") > MAX_TITLE),
        "text": blank(c("text")) | (F.length("text") > MAX_TEXT), "license": ~F.coalesce(c("license_id").isin(ALLOWED_LICENSES), F.lit(False)),
        "url": ~valid_url(c("url")), "license_url": ~valid_url(c("license_url"), optional=True),
        "provider": c("source_provider").isNull() | (F.length("source_provider") > MAX_PROVIDER),
        "metadata": F.length("metadata") > MAX_METADATA, "words": (F.size(words(F.coalesce("text", F.lit("")))) if word_count is None else word_count) < LEAST_WORDS,
    }
    return F.array_compact(F.array(*(F.when(F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items())))


def request_problem(text: Column) -> Column:
    """Why a submitted text is not taken, or null."""
    return (
        F.when(text.isNull() | (F.trim(text) == ""), "blank").when(F.length(text) > MAX_REQUEST, "too long").when(text.contains("\x00") | ~F.is_valid_utf8(text), "invalid characters")
        .when(F.size(words(text)) > MAX_REQUEST_WORDS, "too many words")
    )


class Unavailable(Exception):
    """There is no library at a path."""


def _versions(spark: SparkSession, path: str) -> tuple[int, bool]:
    """The number of the newest pointer (0 if there is none), and whether any tables are there."""
    at, system = artifacts._path(spark, path)
    names = [str(f.getPath().getName()) for f in system.listStatus(at)] if system.exists(at) else []
    numbers = [int(m[1]) for n in names if (m := re.fullmatch(r"current-(\d+)\.json", n))]
    return max(numbers, default=0), any(n.startswith("d-") for n in names)


def _latest(rows: DataFrame, later: DataFrame | None) -> DataFrame:
    """Rows of (document_id, delta) whose delta is the newest that names the document."""
    if later is None:
        return rows.drop("delta")
    newest = later.groupBy("document_id").agg(F.max("delta").alias("newest"))
    return rows.join(newest, "document_id", "left").where("newest is null or newest = delta").drop("delta", "newest")


def _tokens(rows: DataFrame) -> DataFrame:
    """document_id, tokens; they are stored as one string, as words have no spaces, which takes half the room of an array on its way."""
    return rows.select("document_id", F.split("words", " ").alias("tokens"))


def _index(rows: DataFrame) -> DataFrame:
    """What ``index_of`` gives for the stored words: a seed starts where the one before it ends, so a text is cut into them from left to right."""
    assert SEED == STRIDE
    seeds = F.regexp_extract_all(F.translate("words", " ", "\x1f"), F.lit(f"(?:[^\x1f]++\x1f){{{SEED - 1}}}[^\x1f]++"), F.lit(0))
    return rows.select("document_id", F.posexplode(seeds).alias("n", "gram")).select("document_id", (F.col("n") * STRIDE).alias("s_pos"), "gram")


class StoredLibrary:
    """One version of a library: its deltas, oldest first, each {name, document_buckets, gram_buckets}."""

    def __init__(self, spark: SparkSession, path: str, deltas: list[dict]):
        self.spark, self.path, self.deltas = spark, path, deltas

    def _table(self, delta: dict, kind: str) -> DataFrame:
        """A delta's table with its buckets, which a session's catalogue has to be told of; the name is not kept."""
        schema, column = _KINDS[kind]
        name, buckets = f"lexiloom_{uuid.uuid4().hex}", delta["gram_buckets" if column == "gram" else "document_buckets"]
        at = f"{self.path}/{delta['name']}/{kind}".replace("'", "\\'")
        self.spark.sql(f"CREATE TABLE {name} ({schema}) USING parquet CLUSTERED BY ({column}) SORTED BY ({column}) INTO {buckets} BUCKETS LOCATION '{at}'")
        told = self.spark.table(name)
        self.spark.sql(f"DROP TABLE {name}")
        return told

    def _every(self, kind: str, of=lambda df: df) -> DataFrame:
        """Rows of all deltas with the delta's number, each through ``of`` before they meet."""
        out = None
        for n, delta in enumerate(self.deltas):
            part = of(self._table(delta, kind)).withColumn("delta", F.lit(n))
            out = part if out is None else out.unionByName(part)
        return out if out is not None else of(self.spark.createDataFrame([], _KINDS[kind][0])).withColumn("delta", F.lit(0))

    def _later(self) -> DataFrame | None:
        """document_id, delta of what deltas after the first define or remove."""
        return StoredLibrary(self.spark, self.path, self.deltas)._every("ids").where("delta > 0") if len(self.deltas) > 1 else None

    def documents(self) -> DataFrame:
        return _latest(self._every("documents"), self._later())

    def index(self) -> DataFrame:
        """document_id, s_pos, gram."""
        return _latest(self._every("index"), self._later()).select("document_id", "s_pos", "gram")

    def hits(self, asked: DataFrame) -> DataFrame:
        """passage_id, document_id, q_pos, s_pos, gram for the places of grams asked for; only the hits meet the newer deltas' ids."""
        few = [r.gram for r in asked.select("gram").distinct().limit(LITERAL_GRAMS + 1).collect()]
        literal = (lambda df: df.where(F.col("gram").isin(few))) if len(few) <= LITERAL_GRAMS else (lambda df: df)
        found = self._every("index", lambda df: literal(df).join(asked, "gram"))
        return _latest(found, self._later()).select("passage_id", "document_id", "q_pos", "s_pos", "gram")

    def tokens(self, wanted: DataFrame) -> DataFrame:
        """document_id, tokens of the documents with the ids wanted (distinct)."""
        return _tokens(_latest(self._every("tokens", lambda df: df.join(wanted, "document_id", "left_semi")), self._later()))

    def is_empty(self) -> bool:
        return self.documents().isEmpty()


def opened(spark: SparkSession, path: str) -> StoredLibrary:
    """The newest version.

    No library raises Unavailable; tables without a pointer, or of another table version, are an error.
    """
    number, tables = _versions(spark, path)
    if not number:
        if tables:
            raise CheckFailed({"library without a pointer": 1})
        raise Unavailable(path)
    return StoredLibrary(spark, path, _pointer(spark, path, number)["deltas"])


def _pointer(spark: SparkSession, path: str, number: int) -> dict:
    told = json.loads(artifacts.read_text(spark, f"{path}/current-{number}.json"))
    if told["version"] != VERSION:
        raise CheckFailed({"library version": told["version"]})
    return told


def open_library(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(documents, index) of the newest version, merged."""
    library = opened(spark, path)
    return library.documents(), library.index()


def status(spark: SparkSession, path: str) -> str:
    """unavailable, empty or ready."""
    try:
        return "empty" if opened(spark, path).is_empty() else "ready"
    except Unavailable:
        return "unavailable"


def _write(spark: SparkSession, path: str, parts: dict[str, DataFrame], rows: int, words: int, put: Scratch | None = None) -> dict:
    """A delta's tables: one file a bucket, as each task has the rows of one.

    An index that is not among the parts is made of the tokens written, when the tables of ``put`` are no longer needed and are deleted.
    """
    buckets_of = lambda n, size: min(MOST_BUCKETS, max(1, -(-n // size)))
    delta = {"name": f"d-{uuid.uuid4().hex}", "document_buckets": buckets_of(rows, BUCKET_DOCUMENTS), "gram_buckets": buckets_of(words, BUCKET_TOKENS)}
    for kind in ("documents", "tokens", "ids", "index"):
        if kind == "index" and put is not None:
            put.drop(*(df for df, _ in list(put.tables.values())))
        df = parts[kind] if kind in parts else _index(StoredLibrary(spark, path, [delta])._table(delta, "tokens"))
        schema, column = _KINDS[kind]
        buckets = delta["gram_buckets" if column == "gram" else "document_buckets"]
        order = [column, "document_id", "s_pos"] if kind == "index" else [column]
        name = f"lexiloom_{uuid.uuid4().hex}"
        out = df.select(*(F.col(c.split()[0]) for c in schema.split(", "))).repartition(buckets, column).sortWithinPartitions(*order)
        # each task has one bucket in order, so the writer is not told to sort; readers are, by ``_table``
        with shuffles_cleaned(spark), sorted_once(spark):
            out.write.format("parquet").option("compression", "zstd").option("path", f"{path}/{delta['name']}/{kind}").bucketBy(buckets, column).saveAsTable(name)
        spark.sql(f"DROP TABLE {name}")
    return delta


def _point(spark: SparkSession, path: str, number: int, deltas: list[dict]) -> None:
    artifacts.write_text(spark, f"{path}/current-{number}.json", json.dumps({"version": VERSION, "deltas": deltas}))


def upsert(spark: SparkSession, path: str, incoming: DataFrame) -> DataFrame:
    """Add or replace documents with their index entries; returns document_id, problems of rejected rows.

    A delta is written beside the others, then a pointer of the next number appears: readers see one version or the
    other whole, at any moment. Of two writers at once the second fails, as the number is taken. An admitted id that a batch
    has more than once is rejected as repeated, with all of its rows.
    """
    number, _ = _versions(spark, path)
    deltas = _pointer(spark, path, number)["deltas"] if number else []
    with Scratch(spark) as put:
        read = with_words(incoming.select(*SCHEMA_IN), F.coalesce("text", F.lit("")))
        batch = put(read.select(*SCHEMA_IN, F.size("tokens").alias("word_count"), F.array_join("tokens", " ").alias("words")), "library-batch")
        repeated = put(batch.groupBy("document_id").count().where("count > 1").select("document_id", F.lit(True).alias("_again")), "library-repeated")
        # as a rule none is, and then no text moves
        marked = batch.withColumn("_again", F.lit(None).cast("boolean")) if repeated.isEmpty() else batch.join(repeated, "document_id", "left")
        found = admission_problems(F.col("word_count"))
        problems = F.when(F.col("_again"), F.array_append(found, "repeated")).otherwise(found)
        checked = marked.withColumn("problems", problems)
        rejected = put.keep(put(checked.where(F.size("problems") > 0).select("document_id", "problems"), "library-rejected"))
        good = checked.where(F.size("problems") == 0)
        told = good.agg(F.count("*").alias("rows"), F.coalesce(F.sum("word_count"), F.lit(0)).alias("words")).first()
        documents = good.withColumns({"content_sha256": F.sha2("text", 256), "indexed_at": F.current_timestamp()})
        delta = _write(spark, path, {"documents": documents, "tokens": good, "ids": good}, told["rows"], told["words"], put)
    _point(spark, path, number + 1, [*deltas, delta])
    return rejected


def remove(spark: SparkSession, path: str, ids: DataFrame) -> None:
    """A version without the documents of these ids: a delta of ids alone."""
    number, _ = _versions(spark, path)
    deltas = opened(spark, path).deltas
    none = {kind: spark.createDataFrame([], _KINDS[kind][0]) for kind in ("documents", "tokens", "index")}
    gone = ids.select("document_id").where("document_id is not null").distinct()
    _point(spark, path, number + 1, [*deltas, _write(spark, path, none | {"ids": gone}, gone.count(), 0)])


def compact(spark: SparkSession, path: str, newest: int | None = None) -> None:
    """A version with the same rows whose newest deltas, or all, are one. What earlier pointers name stays until ``vacuum``."""
    number, _ = _versions(spark, path)
    deltas = opened(spark, path).deltas
    kept = deltas[: len(deltas) - newest] if newest is not None else []
    merged = StoredLibrary(spark, path, deltas[len(kept) :])
    later = merged._later()
    with Scratch(spark) as put:
        documents = put(merged.documents(), "library-compact")
        told = documents.agg(F.count("*").alias("rows"), F.coalesce(F.sum("word_count"), F.lit(0)).alias("words")).first()
        # over all deltas nothing is left to be removed
        ids = merged._every("ids").select("document_id").distinct() if kept else documents.select("document_id")
        parts = {"documents": documents, "tokens": _latest(merged._every("tokens"), later), "ids": ids, "index": _latest(merged._every("index"), later)}
        delta = _write(spark, path, parts, told["rows"], told["words"])
    _point(spark, path, number + 1, [*kept, delta])


def vacuum(spark: SparkSession, path: str, versions: int = 1) -> list[str]:
    """Delete the deltas that none of the last versions names, and the pointers before those; returns the deltas' names."""
    number, _ = _versions(spark, path)
    named = {d["name"] for n in range(max(1, number - versions + 1), number + 1) for d in _pointer(spark, path, n)["deltas"]}
    at, system = artifacts._path(spark, path)
    gone = []
    for file in system.listStatus(at):
        name = str(file.getPath().getName())
        pointer = re.fullmatch(r"current-(\d+)\.json", name)
        if (name.startswith("d-") and name not in named) or (pointer and int(pointer[1]) <= number - versions):
            system.delete(file.getPath(), True)
            gone += [name] * name.startswith("d-")
    return gone


def accepted(entries: DataFrame) -> DataFrame:
    """One row: requested, accepted of acquisition entries with a status."""
    return entries.agg(F.count("*").alias("requested"), F.count_if(F.col("status") == "accepted").alias("accepted"))


def summary(documents: DataFrame) -> DataFrame:
    return documents.agg(F.count("*").alias("documents"), F.coalesce(F.sum("word_count"), F.lit(0)).alias("words"), F.max("indexed_at").alias("updated_at"))


def license_counts(documents: DataFrame, license_col: str = "license_id") -> DataFrame:
    return documents.groupBy(license_col).agg(F.count("*").alias("n")).orderBy(license_col)


def first_document(documents: DataFrame, key: str = "document_id") -> DataFrame:
    return documents.orderBy(key).limit(1)


def provenance_problems(documents: DataFrame) -> DataFrame:
    """One row of counts: documents with a wrong hash, licence, link or attribution, or with an authorship label."""
    meta = lambda key: F.coalesce(F.get_json_object("metadata", f"$.{key}"), F.lit(""))
    return documents.agg(
        F.count_if(F.sha2("text", 256) != F.col("content_sha256")).alias("hash"), F.count_if(~F.col("license_id").isin(ALLOWED_LICENSES)).alias("license"),
        F.count_if(meta("license_evidence") == "").alias("evidence"), F.count_if(meta("attribution") == "").alias("attribution"), F.count_if(meta("authorship_label") != "").alias("label"),
    )


def freeze(rows: DataFrame, path: str, keys: list[str], **told) -> dict:
    """Write split rows once, partitioned by split, with a manifest of hashes and counts; a populated path or a leak between splits is an error."""
    spark = rows.sparkSession
    require_empty(leaks(rows, keys), "values in several splits")
    rows.write.mode("errorifexists").partitionBy("split").parquet(path)
    counts = {r["split"]: r["count"] for r in spark.read.parquet(path).groupBy("split").count().collect()}
    return artifacts.write_manifest(spark, path, keys=keys, counts=counts, **told)


def load_frozen(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Frozen rows after the checks of the files against their manifest, of the texts' hashes, and of leaks."""
    artifacts.verified(spark, path)
    rows = spark.read.parquet(path)
    require_empty(rows.where(F.sha2("text", 256) != F.col("text_sha256")), "changed texts")
    require_empty(leaks(rows, keys), "values in several splits")
    return rows


def json_report(rows: DataFrame) -> str:
    """A one-row report as JSON; NaN is an error."""
    return json.dumps(rows.first().asDict(recursive=True), allow_nan=False, indent=2, default=str)


def write_report(rows: DataFrame, path: str) -> None:
    """The JSON of a one-row report, as a file that appears whole."""
    artifacts.write_text(rows.sparkSession, path, json_report(rows))
