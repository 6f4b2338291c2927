"""Table layouts and fixed values shared by the package."""

from pyspark.sql import types as T

LEDGER = T.StructType(
    [
        T.StructField(name, T.StringType())
        for name in (
            "original_file_id",
            "file_name",
            "archive_batch_id",
            "date_moved",
            "user_folder_id",
            "status",
            "error",
        )
    ]
)

PROBE = "struct<streams:array<struct<index:int,codec_type:string>>>"

INVENTORY = (
    "id string, name string, mime_type string, trashed boolean, parent_id string, "
    "owners array<struct<emailAddress:string>>, "
    "permissions array<struct<role:string,emailAddress:string>>"
)

# The document type that is exported as text.
DOCUMENT_MIME = "application/vnd.google-apps.document"

# Field names of an action item, in contract order.
ITEM_FIELDS = (
    "description",
    "owner",
    "due_date",
    "urgency_score",
    "priority_score",
    "citation",
    "high_level_topic",
)

# Sections that hold action items; the assistant section is added by name.
ITEM_SECTIONS = ("next_steps", "strategic_initiatives", "executive_followup")

# How a missing value is written in the replies.
NULL_MARKERS = ("", "n/a", "not provided")

# Texts of the ledger's error column and of the run report.
DOWNLOAD_FAILED = "Transcript download failed"
SUMMARY_FAILED = "Summary generation failed (see logs for detail)"
UPLOAD_FAILED = "Summary upload failed"
ARCHIVE_FAILED = "Could not archive"
NO_LOG = "Job complete—no log file found!"
REPORT_HEAD = "The transcript notes were completed with: %s error(s).\n\n"
REPORT_RULE = "---- Log Tail (last %s characters) ----\n"
RUN_START = "==== Gathering"

# Names of archive folders, media files and split modes.
ARCHIVE_ROOT = "transcript_archive"
BATCH_PREFIX = "processed-transcripts_"
AUDIO_NAME = "_output_audio_track_%s.mp3"
VIDEO_NAME = "_output_video_track_%s.mp4"
VIDEO_ONLY_NAME = "output_video_only_track_%s.mp4"
SPLIT_MODES = ("audio", "both")
BAD_MODE = "Invalid choice. Please enter 'audio' or 'both'."
