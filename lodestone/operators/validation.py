"""Data-quality layers. Every check takes a DataFrame and returns issues; statistics come in one pass."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text
from lodestone.operators import manifest as M
from lodestone.schema import HIERARCHY, ISSUES, REQUIRED

ERROR, WARNING = "error", "warning"


def _issues(df: DataFrame, severity: str, kind: str, field_name=None, path=None, cnt=None) -> DataFrame:
    as_column = lambda c, t: (F.lit(c) if not hasattr(c, "cast") else c).cast(t)
    return df.select(F.lit(severity).alias("severity"), as_column(kind, "string").alias("type"), as_column(field_name, "string").alias("field"), as_column(path, "string").alias("path"), as_column(cnt, "long").alias("cnt"))


def schema_issues(df: DataFrame, required: list[str] = REQUIRED, hierarchy: list[str] = HIERARCHY) -> DataFrame:
    """Missing columns, nulls per required column, rows without a whole hierarchy."""
    missing = [(ERROR, "missing_column", c, None, None) for c in required if c not in df.columns]
    out = df.sparkSession.createDataFrame(missing, ISSUES)
    there, keys = [c for c in required if c in df.columns], [c for c in hierarchy if c in df.columns]
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(f"null_values {c}") for c in there], F.count_if(reduce(lambda a, c: a | F.col(c).isNull(), keys, F.lit(False))).alias("incomplete_hierarchy "))
    each = counts.unpivot([], counts.columns, "what", "cnt").where("cnt > 0")
    what = F.split("what", " ")
    return out.unionByName(_issues(each, ERROR, what[0], F.nullif(what[1], F.lit("")), None, F.col("cnt")))


def file_issues(df: DataFrame, files: DataFrame) -> DataFrame:
    """Referenced files that are missing or begin with the wrong bytes; files: path, head (the first 4 bytes).

    A null or empty list has no files; text that isn't a JSON list is one issue.
    """
    listed = F.when(F.coalesce("image_files", F.lit("")).isin("", "[]"), F.array().cast("array<string>")).otherwise(F.from_json("image_files", "array<string>"))
    broken = _issues(df.where(listed.isNull()), ERROR, "invalid_json_image_files", None, F.col("camera_id"))
    images = df.select(F.explode(listed).alias("path"), F.lit("image").alias("kind"))
    pdfs = df.where(F.coalesce("datasheet_file", F.lit("")) != "").select(F.col("datasheet_file").alias("path"), F.lit("pdf").alias("kind"))
    held = images.unionByName(pdfs).join(files.select(F.col("path").alias("_path"), "head"), F.col("path") == F.col("_path"), "left")
    wrong = F.when(F.col("kind") == "pdf", F.col("head") != F.lit(b"%PDF")).otherwise(F.lower("path").endswith(".webp") & (F.col("head") != F.lit(b"RIFF")))
    kind = F.when(F.col("_path").isNull(), F.concat(F.lit("missing_"), "kind")).when(F.coalesce(wrong, F.lit(True)), F.concat(F.lit("invalid_"), "kind", F.lit("_format")))
    found = held.withColumn("what", kind).where("what is not null")
    return broken.unionByName(_issues(found, ERROR, F.col("what"), None, F.col("path")))


def quality_issues(df: DataFrame, key: str = "camera_id") -> DataFrame:
    """Rows in groups of equal keys (an error), rows without images and datasheet (a warning)."""
    dup = duplicate_rows(df, key)
    bare = df.agg(F.count_if(no_media()).alias("cnt"))
    return _issues(dup.where("cnt > 0"), ERROR, "duplicate_ids", key, None, F.col("cnt")).unionByName(_issues(bare.where("cnt > 0"), WARNING, "no_media_records", None, None, F.col("cnt")))


def no_media():
    return (F.col("image_urls").isNull() | (F.col("image_urls") == "[]")) & (F.col("datasheet_url").isNull() | (F.col("datasheet_url") == ""))


def duplicate_rows(df: DataFrame, *keys: str) -> DataFrame:
    """cnt: all rows in groups of two and more; null keys equal each other."""
    groups = df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
    return groups.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("cnt"))


def statistics(df: DataFrame) -> DataFrame:
    """Totals and coverage in one row, from one pass."""
    filled = lambda c, empty: F.count_if(F.col(c).isNotNull() & (F.col(c) != empty))
    counts = df.agg(F.count("*").alias("total_records"), filled("image_urls", "[]").alias("records_with_images"), filled("datasheet_url", "").alias("records_with_pdfs"), filled("specifications", "{}").alias("records_with_specs"))
    share = {f"{name}_coverage": text.percent(F.col(c), F.col("total_records")) for name, c in (("image", "records_with_images"), ("pdf", "records_with_pdfs"), ("specs", "records_with_specs"))}
    return counts.withColumns(share)


def distribution(df: DataFrame, column: str = "product_category") -> DataFrame:
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))


def manifest_of(df: DataFrame) -> DataFrame:
    """A flat manifest from product rows that have their whole hierarchy."""
    whole = df.where(reduce(lambda a, c: a & F.col(c).isNotNull(), HIERARCHY, F.lit(True)))
    return whole.select(
        F.col("product_category").alias("category"), F.col("product_series").alias("series"), "camera_id", "model_name", text.json_strings(F.col("image_urls")).alias("image_urls"),
        "datasheet_url", F.from_json("specifications", "map<string, map<string, string>>").alias("specifications_html"),
    )


def manifest_issues(df: DataFrame, flat: DataFrame) -> DataFrame:
    """A warning if the manifest lists another number of products than the table has, and one per category that
    the manifest has and the table lacks."""
    counts = flat.agg(F.count("*").alias("expected")).crossJoin(df.agg(F.count("*").alias("actual")))  # one row each
    off = _issues(counts.where("expected <> actual"), WARNING, "product_count_mismatch", None, None, F.col("actual") - F.col("expected"))
    per = M.compare(flat.select("category"), df.select(F.col("product_category").alias("category")), "category")
    return off.unionByName(_issues(per.where("status = 'missing'"), WARNING, "empty_category", F.col("category"), None, F.col("expected")))


@dataclass
class Report:
    dataset: str
    manifest: str
    stats: dict = field(default_factory=dict)
    errors: list = field(default_factory=list)
    warnings: list = field(default_factory=list)
    n_errors: int = 0
    n_warnings: int = 0
    version: dict | None = None


def validate(df: DataFrame, files: DataFrame | None = None, flat: DataFrame | None = None, names: tuple[str, str] = ("products", "manifest"), version: dict | None = None, shown: int = 10) -> Report:
    """All layers. The report holds counts and the first few issues of each severity, whatever their number."""
    layers = [schema_issues(df), quality_issues(df), manifest_issues(df, flat if flat is not None else manifest_of(df))]
    layers += [file_issues(df, files)] if files is not None else []
    issues = reduce(DataFrame.unionByName, layers).persist()
    try:
        by_type = {(r["severity"], r["type"]): (r["n"], r["rows"]) for r in issues.groupBy("severity", "type").agg(F.count("*").alias("n"), F.sum("cnt").alias("rows")).collect()}
        first = {s: issues.where(F.col("severity") == s).orderBy("type", "field", "path").limit(shown).collect() for s in (ERROR, WARNING)}
    finally:
        issues.unpersist()
    n = lambda kind: by_type.get((ERROR, kind), (0, 0))[0]
    stats = statistics(df).first().asDict()
    stats |= {"missing_images": n("missing_image"), "invalid_format_images": n("invalid_image_format"), "missing_pdfs": n("missing_pdf"), "invalid_format_pdfs": n("invalid_pdf_format")}
    stats |= {"duplicate_ids": by_type.get((ERROR, "duplicate_ids"), (0, 0))[1] or 0, "no_media_records": by_type.get((WARNING, "no_media_records"), (0, 0))[1] or 0, "manifest_products": (flat if flat is not None else manifest_of(df)).count()}
    total = lambda s: sum(v[0] for k, v in by_type.items() if k[0] == s)
    return Report(*names, stats, [r.asDict() for r in first[ERROR]], [r.asDict() for r in first[WARNING]], total(ERROR), total(WARNING), version)


def format_report(r: Report, verbose: bool = False) -> str:
    """The report as text, section by section. Its titles and labels are fixed values."""
    s, out = r.stats, []

    def section(title: str, *lines: str) -> None:
        out.extend([f"--- {title} ---", *lines, ""])

    out += ["=" * 80, "DATASET VALIDATION REPORT", "=" * 80, f"Dataset: {r.dataset}", f"Manifest: {r.manifest}", ""]
    if r.version:
        v = r.version
        lines = [f"Version: {v.get('version')}", f"Timestamp: {v.get('timestamp', 'N/A')}", f"Record Count: {v.get('record_count', 'N/A')}", f"Manifest Hash: {(v.get('manifest_hash') or 'N/A')[:32]}", f"Append Mode: {v.get('append_mode', 'N/A')}"]
        section("VERSION INFORMATION", *lines, *([f"Records Added: {v.get('records_added')}", f"Records Updated: {v.get('records_updated')}", f"Parent Version: {v.get('parent_version')}"] if v.get("append_mode") else []))
    section("VALIDATION SUMMARY", f"Errors: {r.n_errors}", f"Warnings: {r.n_warnings}")
    cover = [f"Records with {label}: {s[c]} ({s[p] or 'N/A'})" for label, c, p in (("Images", "records_with_images", "image_coverage"), ("PDFs", "records_with_pdfs", "pdf_coverage"), ("Specs", "records_with_specs", "specs_coverage"))]
    section("COVERAGE METRICS", f"Total Records: {s['total_records']}", *cover)
    section("FILE INTEGRITY", f"Missing Images: {s['missing_images']}", f"Invalid Image Format: {s['invalid_format_images']}", f"Missing PDFs: {s['missing_pdfs']}", f"Invalid PDF Format: {s['invalid_format_pdfs']}")
    section("DATA QUALITY", f"Duplicate IDs: {s['duplicate_ids']}", f"Records without Media: {s['no_media_records']}")
    section("MANIFEST COMPARISON", f"Expected Products: {s['manifest_products']}", f"Actual Products: {s['total_records']}")
    out.append(f"Dataset has {r.n_errors} error(s)" if r.n_errors else f"Dataset has {r.n_warnings} warning(s) but no errors" if r.n_warnings else "Dataset validation passed")
    for title, found, n in (("ERRORS", r.errors, r.n_errors), ("WARNINGS", r.warnings, r.n_warnings)):
        if verbose and n:
            out += ["", f"--- {title} (first {len(found)}) ---", *(f"  {x}" for x in found), *([f"  ... and {n - len(found)} more"] if n > len(found) else [])]
    return "\n".join([*out, "=" * 80, ""])
