"""Upload admission, option resolution, legacy shapes and stage switches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import BOX
from ..functions.text import strip
from .masks import OCCLUSION

MAX_BYTES = 50 * 1024 * 1024
MAX_PAGES = 100
#: Option keys with their values (booleans where there are none) and defaults.
OPTIONS = (
    ("text_card_mode", ("basic_cloze", "text_occlusion"), "basic_cloze"),
    ("diagram_occlusion_enabled", None, "true"),
    ("diagram_mask_grouping", ("individual", "grouped"), "individual"),
    ("text_mask_grouping", ("individual", "grouped"), "individual"),
)
LEGACY_KEY = "mask_grouping"


def admission(uploads: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Uploads (``deck_name, content_type, filename, size, head``) with ``reason``: why one is refused, or NULL. ``head`` is the first bytes."""
    name = F.length(strip(F.col("deck_name")))
    pdf = F.coalesce(F.col("content_type").isin("application/pdf", "application/x-pdf"), F.lit(False)) | F.lower(F.coalesce("filename", F.lit(""))).endswith(".pdf")
    reason = F.when(~F.coalesce(name.between(1, 100), F.lit(False)), "deck_name must be 1-100 characters.")
    reason = reason.when(~pdf, "Uploaded file must be a PDF.")
    reason = reason.when(F.col("size") > max_bytes, f"PDF exceeds the {max_bytes // (1024 * 1024)} MB size limit.")
    reason = reason.when(~F.coalesce(F.col("head").startswith("%PDF-"), F.lit(False)), "File is not a valid PDF.")
    return uploads.withColumn("reason", reason)


def read_uploads(spark, path: str) -> DataFrame:
    """Files below ``path`` as uploads; only the head of each file's content is kept."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(name.alias("deck_name"), F.lit(None).cast("string").alias("content_type"), name.alias("filename"), F.col("length").alias("size"), F.decode(F.substring("content", 1, 5), "ISO-8859-1").alias("head"))


def page_limit(pages: DataFrame, limit: int = MAX_PAGES) -> DataFrame:
    """``job_id, page_count, error_message``: NULL, or that the deck has too many pages."""
    counts = pages.groupBy("job_id").agg(F.max("page_number").alias("page_count"))
    message = F.concat(F.lit("PDF has "), F.col("page_count"), F.lit(f" pages, which exceeds the {limit}-page limit."))
    return counts.withColumn("error_message", F.when(F.col("page_count") > limit, message))


def merge_schema(stored: DataFrame, current: DataFrame) -> DataFrame:
    """Stored rows under the current columns, missing ones NULL; nothing is dropped or renamed."""
    return stored.unionByName(current, allowMissingColumns=True)


def resolve_options(requests: DataFrame, column: str = "options", default_mode: str = "basic_cloze") -> DataFrame:
    """``requests`` with a column for each option and ``reason`` (NULL where the payload is accepted).

    Nothing, blanks and ``{}`` mean all defaults; the legacy key fills only what was not sent; an unknown default
    mode counts as ``basic_cloze``. Broken JSON, anything but an object, unknown keys and bad values are refused.
    """
    raw = F.col(column)
    missing = F.coalesce(strip(raw) == "", F.lit(True))
    parsed = F.try_parse_json(F.when(missing, F.lit("{}")).otherwise(raw))
    rows = requests.withColumn("json", parsed)
    keys = F.json_object_keys(F.when(missing, F.lit("{}")).otherwise(raw))
    known = F.array(*[F.lit(k) for k, _, _ in OPTIONS], F.lit(LEGACY_KEY))
    rows = rows.withColumn("keys", F.when(F.schema_of_variant("json").startswith("OBJECT"), keys))

    def sent(key: str) -> Column:
        return F.array_contains("keys", key)

    def value(key: str) -> Column:
        return F.try_variant_get("json", f"$.{key}", "string")

    columns: dict[str, Column] = {}
    bad: Column = F.lit(False)
    for key, values, default in OPTIONS:
        legacy = values == ("individual", "grouped")
        if key == "text_card_mode" and default_mode in values:
            default = default_mode
        own = F.when(sent(key), value(key))
        if legacy:
            own = own.when(sent(LEGACY_KEY), value(LEGACY_KEY))
        given = sent(key) | sent(LEGACY_KEY) if legacy else sent(key)
        if values:
            fine = F.coalesce(own.isin(*values), F.lit(False)) & F.coalesce(F.schema_of_variant(F.variant_get("json", f"$.{key}", "variant")) == "STRING", F.lit(True))
        else:
            fine = F.coalesce(F.schema_of_variant(F.variant_get("json", f"$.{key}", "variant")) == "BOOLEAN", F.lit(False))
        bad = bad | (given & ~fine)
        columns[key] = F.when(given, own).otherwise(F.lit(default))
    reason = F.when(F.col("json").isNull(), "options must be valid JSON.").when(F.col("keys").isNull(), "options must be a JSON object.")
    reason = reason.when(F.size(F.array_except("keys", known)) > 0, "unknown option").when(bad, "invalid option value")
    rows = rows.withColumn("reason", reason)
    for key, values, _ in OPTIONS:
        rows = rows.withColumn(key, F.when(F.col("reason").isNull(), columns[key] if values else columns[key].cast("boolean")))
    return rows.drop("json", "keys")


#: Current and older keys together.
_STORED = f"struct<kind:string,direction:string,labels:array<string>,crop_box:{BOX},target_boxes:array<{BOX}>,mask_boxes:array<{BOX}>,label:string,label_box:{BOX}>"


def upgrade_occlusion(stored: Column) -> Column:
    """A stored occlusion (JSON) in today's shape: without a kind, an old label and box become those of a diagram."""
    o = F.from_json(stored, _STORED)
    old = o["kind"].isNull() & (o["label"].isNotNull() | o["label_box"].isNotNull())
    labels = F.when(old & o["label"].isNotNull(), F.coalesce(o["labels"], F.array(o["label"]))).otherwise(o["labels"])
    targets = F.when(old & o["label_box"].isNotNull(), F.coalesce(o["target_boxes"], F.array(o["label_box"]))).otherwise(o["target_boxes"])
    now = F.struct(F.when(old, "diagram").otherwise(o["kind"]).alias("kind"), o["direction"].alias("direction"), labels.alias("labels"), o["crop_box"].alias("crop_box"), targets.alias("target_boxes"), o["mask_boxes"].alias("mask_boxes"))
    return now.cast(OCCLUSION)


def stage_plan(jobs: DataFrame, flagged: DataFrame) -> DataFrame:
    """Which branches run for each deck (``job_id, text_card_mode, diagram_occlusion_enabled``), given its flagged pages."""
    counts = flagged.groupBy("job_id").agg(F.count("*").alias("diagram_pages"))
    both = jobs.join(counts, "job_id", "left").withColumn("diagram_pages", F.coalesce("diagram_pages", F.lit(0)).cast("long"))
    text = F.col("text_card_mode") == "text_occlusion"
    return both.select("job_id", (~text).alias("runs_cards"), text.alias("runs_text_masks"), (F.col("diagram_occlusion_enabled") & (F.col("diagram_pages") > 0)).alias("runs_diagrams"), "diagram_pages")
