"""Reading submissions, files and labelled sets; writing exports; audit rows from access logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import params as P
from tessera.functions import scores
from tessera.functions import text as T

# Fixed value: the form of an identifier in a path.
UUID = r"(?i)^(?:urn:uuid:)?\{?[0-9a-f]{8}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{12}\}?$"


ROW_GROUP = 128 << 20  #: bytes of a usual row group, the least that a scan can split


def spread(rows: DataFrame) -> DataFrame:
    """The rows dealt out evenly where the input, by the planner's size of it, may have fewer row groups than there are cores; else as they are.

    One task reads a row group, however many cores are idle. So a core receives at most a row group's bytes, and a large input is not shuffled.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    size = int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return rows.repartition(cores) if size < cores * ROW_GROUP else rows


def scan_submissions(submissions: DataFrame, batch: str | None = None) -> DataFrame:
    """Rows with text, of one batch if given; the filter reaches the scan and prunes partitions by batch."""
    rows = submissions.where(F.col("text").isNotNull())
    return rows.where(F.col("batch") == batch) if batch is not None else rows


def scan_files(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) of the files under a folder. Spark's readers list no empty files, so these are in neither."""
    return validate_files(spark.read.format("binaryFile").load(path).select("path", "length", "content"))


def file_problem(length: Column, magic: Column, mime: Column | None = None) -> Column:
    """Why a file is rejected; null if it is not."""
    out = F.when(length > P.MAX_FILE_BYTES, "too_large").when(magic != F.lit(b"%PDF"), "not_pdf")
    return out.when(mime != "application/pdf", "not_pdf") if mime is not None else out


def validate_files(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    rows = files.withColumn("problem", file_problem(F.col("length"), F.substring("content", 1, 4)))
    return rows.where("problem is null").drop("problem"), rows.where("problem is not null").drop("content")


def batch_size_ok(files: DataFrame) -> DataFrame:
    """(batch, n, ok): 1 to 60 files."""
    return files.groupBy("batch").agg(F.count("*").alias("n")).withColumn("ok", F.col("n").between(1, P.MAX_FILES))


def content_groups(rows: DataFrame, content: str) -> DataFrame:
    """Adds content_hash, stored_path and n_same: equal contents of a batch share a path and stay separate rows."""
    hashed = rows.withColumn("content_hash", F.sha2(F.col(content).cast("binary"), 256))
    n = hashed.groupBy("batch", "content_hash").agg(F.count("*").alias("n_same"))
    return hashed.join(n, ["batch", "content_hash"]).withColumn("stored_path", F.concat_ws("/", "batch", F.concat("content_hash", F.lit(".pdf"))))


def scan_labelled_folder(spark: SparkSession, labels_csv: str, folder: str) -> DataFrame:
    """(filename, label, y, text) of a CSV of file names and labels and the files it names; names of missing or empty files give no row."""
    labels = spark.read.csv(labels_csv, header=True, schema="filename string, label string")
    texts = spark.read.text(folder, wholetext=True).select(F.col("_metadata.file_name").alias("filename"), F.col("value").alias("text"))
    return labels.join(texts, "filename").withColumn("y", (F.col("label") == "ai-generated").cast("int"))


def scan_labelled_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema="text string, label int", multiLine=True, quote='"', escape='"').dropna(subset=["text", "label"])


def write_features(rows: DataFrame, path: str, features) -> None:
    """Features of (text, label) rows as CSV; rows whose text gives no style are left out. ``features``: from a text column to a struct."""
    found = rows.where(T.stylometric(F.col("text")).isNotNull()).select(features(F.col("text")).alias("f"), "label").select("f.*", "label")
    found.write.mode("overwrite").option("header", "true").csv(path)


def export_documents(batches: DataFrame, docs: DataFrame, risks: DataFrame, ai: DataFrame, pairs: DataFrame) -> DataFrame:
    """One nested row a batch, for batches that a row can hold (``document_lines`` has no such limit): header, submissions with risk and ai_detection (null if missing), similarity_pairs; empty lists where there are none."""
    r = risks.select("doc", F.struct("weighted_score", "risk_level", "text_sim_max", "code_sim_max", "weight_profile").alias("risk"))
    a = ai.select("doc", F.struct("ai_prob", "source").alias("ai_detection"))
    subs = docs.join(r, "doc", "left").join(a, "doc", "left").groupBy("batch").agg(F.sort_array(F.collect_list(F.struct("doc", "student_id", "risk", "ai_detection"))).alias("submissions"))
    found = pairs.groupBy("batch").agg(F.sort_array(F.collect_list(F.struct("a", "b", "fused", "copy_direction"))).alias("similarity_pairs"))
    out = batches.join(subs, "batch", "left").join(found, "batch", "left")
    lists = {c: F.coalesce(F.col(c), F.array().cast(df.schema[c].dataType)) for df, c in ((subs, "submissions"), (found, "similarity_pairs"))}
    return out.withColumns(lists)


def document_lines(batches: DataFrame, docs: DataFrame, risks: DataFrame, ai: DataFrame, pairs: DataFrame) -> DataFrame:
    """(batch, part, x, y, line): the lines of the documents of ``export_documents`` in order of part, x and y, a line for each submission and pair.

    So no row holds a batch. Fields without a value are null.
    """
    json = lambda c: F.to_json(c, {"ignoreNullFields": "false"})
    none = F.lit(None).cast("long")
    head = json(F.struct(*(F.col(c) for c in batches.columns)))
    mark = lambda part, text: batches.select("batch", F.lit(part).alias("part"), none.alias("x"), none.alias("y"), text.alias("line"))
    r = risks.select("doc", F.struct("weighted_score", "risk_level", "text_sim_max", "code_sim_max", "weight_profile").alias("risk"))
    a = ai.select("doc", F.struct("ai_prob", "source").alias("ai_detection"))
    known = F.broadcast(batches.select("batch"))  # a row a batch, so no line is shuffled to be joined
    subs = docs.join(known, "batch", "left_semi").join(r, "doc", "left").join(a, "doc", "left")
    subs = subs.select("batch", F.col("doc").alias("x"), none.alias("y"), json(F.struct("doc", "student_id", "risk", "ai_detection")).alias("line"))
    found = pairs.join(known, "batch", "left_semi").select("batch", F.col("a").alias("x"), F.col("b").alias("y"), json(F.struct("a", "b", "fused", "copy_direction")).alias("line"))

    def listed(rows: DataFrame, part: int) -> DataFrame:
        first = rows.groupBy("batch").agg(F.min(F.struct("x", "y")).alias("first"))
        comma = F.when(F.struct("x", "y") == F.col("first"), F.col("line")).otherwise(F.concat(F.lit(","), F.col("line")))
        return rows.join(F.broadcast(first), "batch").select("batch", F.lit(part).alias("part"), "x", "y", comma.alias("line"))

    out = mark(0, F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.lit(',"submissions":['))).unionByName(listed(subs, 1))
    return out.unionByName(mark(2, F.lit('],"similarity_pairs":['))).unionByName(listed(found, 3)).unionByName(mark(4, F.lit("]}")))


def write_documents(lines: DataFrame, folder: str, files: int = 200) -> None:
    """Text below ``folder``/batch=...: a batch's files, in order of their names, are its JSON document. Lines are dealt out by range, so a large batch is many files."""
    order = ["batch", "part", "x", "y"]
    lines.repartitionByRange(files, *order).sortWithinPartitions(*order).select("batch", "line").write.partitionBy("batch").text(folder)


def percent_text(c: Column) -> Column:
    """A share from 0 on as percent with one digit, N/A for null; the double's own value is rounded, not its shortest text."""
    x = c * 100
    tens = 8 * x + 2 * x
    rest = 2 * x - (tens - 8 * x)  # tens and rest together are ten times x exactly
    low = F.floor(tens)
    half = tens - low
    up = (half > 0.5) | ((half == 0.5) & ((rest > 0) | ((rest == 0) & (low % 2 == 1))))
    whole = low + up.cast("long")
    return F.when(c.isNull(), "N/A").otherwise(F.concat(F.floor(whole / 10).cast("string"), F.lit("."), (whole % 10).cast("string")))


def export_csv_rows(docs: DataFrame, risks: DataFrame, ai: DataFrame) -> DataFrame:
    """The nine columns of the CSV export as text; the probability is that of the detection, not of the risk row."""
    rows = docs.join(risks.drop("batch", "ai_prob", "has_code"), "doc", "left").join(ai.select("doc", "ai_prob"), "doc", "left")
    return rows.select(
        F.coalesce("student_id", F.lit("N/A")).alias("student_id"), F.coalesce("student_name", F.lit("Unknown")).alias("student_name"), F.coalesce(F.upper("risk_level"), F.lit("N/A")).alias("risk_level"),
        percent_text(F.col("weighted_score")).alias("weighted_score"), percent_text(F.col("ai_prob")).alias("ai_probability"), percent_text(F.col("text_sim_max")).alias("text_sim_max"),
        percent_text(F.col("code_sim_max")).alias("code_sim_max"), F.coalesce("weight_profile", F.lit("N/A")).alias("weight_profile"), F.col("doc").cast("string").alias("submission_id"),
    )


def analysis_sheet(docs: DataFrame, risks: DataFrame, ai: DataFrame, marked: DataFrame) -> DataFrame:
    """The per-student table of the workbook: scores times 100 to one decimal, defaults for what is missing."""
    rows = docs.join(risks.drop("batch", "has_code"), "doc", "left").join(ai.select("doc", F.col("ai_prob").alias("ai_result")), "doc", "left")
    rows = rows.join(marked.select("doc", "marks_obtained", "total_marks"), "doc", "left")
    zero = F.lit(0.0)
    pct = lambda *cs: scores.rounded(F.coalesce(*cs, zero) * 100, 1)
    lost = F.greatest(zero, F.coalesce("total_marks", F.lit(10.0)) - F.col("marks_obtained"))
    return rows.select(
        "doc", F.coalesce("student_id", F.lit("N/A")).alias("student_id"), F.coalesce("student_name", F.lit("Unknown")).alias("student_name"),
        F.upper(F.coalesce("risk_level", F.lit("low"))).alias("risk_level"), pct(F.col("weighted_score")).alias("weighted_score"), pct(F.col("ai_result"), F.col("ai_prob")).alias("ai_probability"),
        pct(F.col("text_sim_max")).alias("text_sim_max"), F.coalesce(scores.rounded(F.col("code_sim_max") * 100, 1).cast("string"), F.lit("N/A")).alias("code_sim_max"),
        F.coalesce(F.col("weight_profile"), F.when(F.col("has_code"), "code_present").otherwise("theory_only")).alias("weight_profile"),
        F.when(F.col("marks_obtained").isNull(), "N/A").when(lost > 0.05, F.format_string("-%.1f", lost)).otherwise("0.0").alias("total_deductions"),
        F.when(F.col("marks_obtained").isNull(), "N/A").otherwise(F.format_string("%.1f", "marks_obtained")).alias("final_marks"),
    )


def export_annotations(annotations: DataFrame, docs: DataFrame, batches: DataFrame, user: str, is_admin: bool) -> DataFrame:
    """Annotations with their document's preview and batch, by creation; an instructor's own batches only."""
    own = batches if is_admin else batches.where(F.col("instructor_id") == user)
    rows = annotations.join(docs.select("doc", "batch", F.substring("text", 1, 200).alias("preview")), "doc").join(own.select("batch", "name"), "batch")
    return rows.orderBy("created_at", "doc")


def write_export(df: DataFrame, path: str, fmt: str, manifest: str, batch: str, user: str) -> None:
    """Writes json, csv or parquet by batch, and appends a row to the manifest."""
    writer = df.write.mode("overwrite")
    (writer.option("header", "true") if fmt == "csv" else writer).format(fmt).save(path)
    row = df.sparkSession.range(1).select(F.lit(batch).alias("batch"), F.lit(fmt).alias("format"), F.lit(path).alias("file_path"), F.lit(user).alias("generated_by"), F.current_timestamp().alias("generated_at"))
    row.write.mode("append").parquet(manifest)


def overwrite_batches(df: DataFrame, path: str) -> None:
    """Replaces the partitions of the batches in ``df`` and leaves the others, so a rerun changes nothing."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)


def without_batches(table: DataFrame, deleted: DataFrame, key: str = "batch") -> DataFrame:
    """What a cascading delete leaves of a table."""
    return table.join(deleted.select(key), key, "left_anti")


def delete_batches(tables: dict[str, DataFrame], deleted: DataFrame) -> dict[str, DataFrame]:
    """What is left of every table that carries a batch once batches are deleted."""
    return {name: without_batches(t, deleted) for name, t in tables.items()}


# Actions by method and path pattern; * is any one segment.
ACTIONS = [
    ("POST", "auth/login", "auth.login"), ("POST", "auth/logout", "auth.logout"), ("POST", "auth/register", "auth.register"),
    ("POST", "batches", "batch.create"), ("DELETE", "batches/*", "batch.delete"), ("POST", "batches/*/process", "batch.process"),
    ("POST", "batches/*/marking-config", "batch.update_marking_config"), ("POST", "submissions/*/annotations", "annotation.create"),
    ("DELETE", "annotations/*", "annotation.delete"), ("PUT", "submissions/*/marks", "submission.update_marks"),
    ("POST", "admin/users", "admin.user_create"), ("DELETE", "admin/users/*", "admin.user_delete"), ("PATCH", "admin/users/*/role", "admin.user_update_role"),
]
# Paths that leave no audit rows.
SKIPPED = ["/api/health", "/api/docs", "/api/redoc", "/api/openapi.json"]


def derive_action(method: Column, path: Column, prefix: str = "/api/") -> Column:
    """The known action of a request, else its method with the last two path segments that are no UUIDs."""
    clean = F.regexp_replace(F.replace(path, F.lit(prefix), F.lit("")), "^/+|/+$", "")
    segments = F.filter(F.split(clean, "/"), lambda s: s != "")
    joined = F.array_join(segments, "/")
    out = None
    for m, p, action in ACTIONS:
        test = (method == m) & joined.rlike("^" + p.replace("*", "[^/]+") + "$")
        out = F.when(test, action) if out is None else out.when(test, action)
    plain = F.filter(segments, lambda s: ~s.rlike(UUID))
    return out.otherwise(F.concat_ws(".", F.lower(method), F.nullif(F.array_join(F.slice(plain, F.greatest(F.size(plain) - 1, F.lit(1)), F.lit(2)), "."), F.lit(""))))


def access_to_audit(log: DataFrame, trusted: list[str], prefix: str = "/api/") -> DataFrame:
    """Audit rows of the writing requests of an access log; column expressions only, so it runs on streams, too."""
    segments = F.filter(F.split("path", "/"), lambda s: s != "")
    ids = F.filter(F.transform(segments, lambda s, i: F.struct(i.alias("i"), s.alias("s"))), lambda x: x["s"].rlike(UUID))
    first = F.get(ids, F.lit(0))
    hop = F.trim(F.element_at(F.split("x_forwarded_for", ","), 1))
    ip = F.when(F.col("x_forwarded_for").isNotNull() & (F.col("x_forwarded_for") != "") & F.col("client_host").isin(trusted), hop).otherwise(F.coalesce("client_host", F.lit("unknown")))
    rows = log.where(F.col("method").isin("POST", "PUT", "PATCH", "DELETE") & ~F.col("path").isin(SKIPPED))
    return rows.select(
        "user_id", derive_action(F.col("method"), F.col("path"), prefix).alias("action"), F.when(first["i"] > 0, F.get(segments, first["i"] - 1)).alias("entity_type"),
        F.lower(first["s"]).alias("entity_id"), ip.alias("ip_address"), "ts",
    )
