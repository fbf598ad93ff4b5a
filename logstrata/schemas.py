"""Schemas and vocabularies of a case store."""

from __future__ import annotations

from pyspark.sql import types as T

_FACT = {
    "id": "long",
    "tracev3_file_id": "long",
    "format_src_file_id": "long",
    "timesync_file_id": "long",
    "tracev3_chunkset_file_offset": "long",
    "tracev3_firehose_inner_offset": "long",
    "tracev3_entry_inner_offset": "long",
    "format_string_file_offset": "long",
    "timestamp_unix_ns": "long",
    "timestamp_mach": "long",
    "timesync_anchor_id": "long",
    "process": "string",
    "pid": "long",
    "tid": "long",
    "euid": "long",
    "log_level": "string",
    "event_type": "string",
    "subsystem": "string",
    "category": "string",
    "message": "string",
    "message_format_string": "string",
    "library": "string",
    "library_uuid": "string",
    "process_uuid": "string",
    "activity_id": "long",
    "parent_activity_id": "long",
    "boot_uuid": "string",
    "raw_data": "string",
}
#: One row for each log entry, in the column order of the fact table.
FACT = T.StructType([T.StructField(name, T.LongType() if kind == "long" else T.StringType()) for name, kind in _FACT.items()])
#: Columns in which an empty string means none. The message keeps an empty string.
EMPTY_IS_NULL = ("process", "log_level", "event_type", "subsystem", "category", "message_format_string", "library", "library_uuid", "process_uuid", "boot_uuid")
#: The stable read surface.
VIEW = ("id", "timestamp_unix_ns", "timestamp_mach", "process", "pid", "tid", "euid", "log_level", "event_type", "subsystem", "category", "message", "message_format_string", "boot_uuid")

ANCHORS = "anchor_id long, boot_uuid string, file_id long, file_offset long, kernel_time long, wall_ns long, record long, numerator long, denominator long, boot_rank long, is_boot boolean"
SOURCE_FILES = "file_id long, rel_path string, kind string, size long, sha256 string, entries long, damage array<string>"
KB_SIGNATURES = "kb_id long, signature_id string, action string, description string, confidence string, tags array<string>, kb_version string, match_count long, applied_at string, match string, extract string, references string"
ANNOTATIONS = "log_id long, kb_id long"
VALUES = "log_id long, kb_id long, label string, value string"

# Vocabularies in id order, and the rank of boots that no clock file names.
LOG_LEVELS = ("Default", "Info", "Debug", "Error", "Fault")
EVENT_TYPES = ("Log", "Activity", "Trace", "Signpost", "Loss", "Statedump", "Simpledump")
LEVEL_OF_TYPE = {0: "Default", 1: "Info", 2: "Debug", 0x10: "Error", 0x11: "Fault"}
EVENT_OF_ACTIVITY = {2: "Activity", 3: "Trace", 4: "Log", 6: "Signpost", 7: "Loss"}
UNKNOWN_BOOT_RANK = 1 << 30
STATUSES = ("running", "complete", "cancelled")
