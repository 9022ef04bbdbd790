"""Attachment rows: which to fetch, their text, their scan status."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from threadlens.functions.text import TEXT_CAP
from threadlens.schemas import KEY

# Fixed values -----------------------------------------------------------
READABLE = (".pdf", ".docx")
EXTRACT_LIMIT = 50_000
WORD_NS = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
# ------------------------------------------------------------------------


def is_readable(name: Column) -> Column:
    low = F.lower(F.coalesce(name, F.lit("")))
    return F.endswith(low, F.lit(READABLE[0])) | F.endswith(low, F.lit(READABLE[1]))


def attachment_pairs(child_messages: DataFrame, meta: DataFrame) -> DataFrame:
    """(user_id, message_id, attachment_id) worth fetching: flagged message, readable name."""
    message = ["user_id", "message_id"]
    flagged = child_messages.filter("has_attachments").select(*message).distinct()
    return (
        meta.filter(is_readable(F.col("name")))
        .join(flagged, message, "left_semi")
        .select(*message, "attachment_id").distinct()
    )


def _docx_text(raw: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(raw)) as z, z.open("word/document.xml") as f:
        body = ElementTree.parse(f).getroot().find(f"{WORD_NS}body")
    lines = (
        "".join(t.text or "" for t in p.iter(f"{WORD_NS}t")) for p in body.findall(f"{WORD_NS}p")
    )
    return "\n".join(line for line in lines if line.strip())


def _pdf_text(raw: bytes) -> str:
    from pypdf import PdfReader  # optional; absent means "failed"

    return "".join(page.extract_text() or "" for page in PdfReader(io.BytesIO(raw)).pages)


def _text_of(name: str | None, content_type: str | None, raw: bytes | None) -> str | None:
    low, kind = (name or "").lower(), (content_type or "").lower()
    if not raw:
        return None
    if "pdf" in kind or low.endswith(".pdf"):
        reader = _pdf_text
    elif "wordprocessingml" in kind or low.endswith(".docx"):
        reader = _docx_text
    else:
        return None
    try:
        return reader(raw)[:EXTRACT_LIMIT].strip() or None
    except Exception:  # an unreadable file is a status, not a failed job
        return None


def extract_text(files: DataFrame) -> DataFrame:
    """Add ``text`` to rows with ``name``, ``content_type`` and ``content`` bytes.

    Bytes go to Python in Arrow batches and only text comes back.
    """
    rest = [f for f in files.schema.fields if f.name != "content"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest) + ", text string"

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            text = [
                _text_of(n, c, bytes(r) if r is not None else None)
                for n, c, r in zip(batch["name"], batch["content_type"], batch["content"])
            ]
            yield batch.drop(columns="content").assign(text=pd.Series(text, dtype="object"))

    return files.mapInPandas(read, schema)


def scan_status(name: Column, text: Column, limit: int = TEXT_CAP) -> Column:
    """unsupported by name, failed without text, truncated beyond the cap, else ok."""
    return (
        F.when(~is_readable(name), "unsupported")
        .when(F.coalesce(text, F.lit("")) == "", "failed")
        .when(F.length(text) > limit, "truncated")
        .otherwise("ok")
    )


def attach(
    child_messages: DataFrame, meta: DataFrame, texts: DataFrame, limit: int = TEXT_CAP
) -> DataFrame:
    """Attachments of flagged messages with text (capped), length and status.

    ``meta`` and ``texts(user_id, message_id, attachment_id, text)`` are joined
    within a tenant. What could not be fetched or read is ``failed``.
    """
    message = ["user_id", "message_id"]
    flagged = child_messages.filter("has_attachments").select(*KEY, "message_id")
    name = F.coalesce("name", F.lit(""))
    rows = (
        flagged.join(meta, message)
        .join(texts.select(*message, "attachment_id", "text"), [*message, "attachment_id"], "left")
        .withColumn("scan_status", scan_status(name, F.col("text"), limit))
    )
    readable = F.col("scan_status").isin("ok", "truncated")
    return rows.select(
        *KEY, "message_id", "attachment_id", name.alias("name"),
        F.lower(F.coalesce("content_type", F.lit(""))).alias("content_type"),
        F.coalesce("size", F.lit(0).cast("bigint")).alias("size"),
        F.when(readable, F.length("text")).otherwise(0).cast("bigint").alias("actual_char_count"),
        "scan_status",
        F.when(readable, F.substring("text", 1, limit)).otherwise("").alias("text"),
    )


def storage_columns(attachments: DataFrame) -> DataFrame:
    """What is stored of an attachment: everything but its text."""
    return attachments.drop("text")


def per_thread(attachments: DataFrame) -> DataFrame:
    """The attachment columns a thread row carries."""
    return attachments.groupBy(*KEY).agg(
        F.max("size").alias("max_attachment_size"),
        F.bool_or(F.col("scan_status").isin("failed", "truncated")).alias("attachments_incomplete"),
    )
