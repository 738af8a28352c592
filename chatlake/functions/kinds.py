"""Codes of message and attachment kinds, and the rules that derive them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TEXT, SYSTEM, APP = 0, 1, 2
IMAGE, VIDEO, AUDIO, STICKER, FILE = 0, 1, 2, 3, 4

# File extensions per attachment kind, used when the MIME type says nothing.
EXTENSIONS = {
    IMAGE: ["heic", "jpg", "jpeg", "png", "gif", "webp", "tiff"],
    VIDEO: ["mov", "mp4", "m4v"],
    AUDIO: ["caf", "m4a", "mp3", "amr", "wav", "aac"],
}

# Reaction codes of the source and the emoji they stand for.
REACTIONS = {2000: "❤️", 2001: "👍", 2002: "👎", 2003: "😂", 2004: "‼️", 2005: "❓"}
CUSTOM_REACTION = 2006
STICKER_REACTION = 2007
REMOVAL_OFFSET = 1000


def attachment_kind(mime: Column, filename: Column, is_sticker: Column) -> Column:
    """Sticker flag first, then the MIME family, then the file extension, else file."""
    mime = F.coalesce(mime, F.lit(""))
    extension = F.when(filename.contains("."), F.lower(F.substring_index(filename, ".", -1)))
    rule = F.when(F.coalesce(is_sticker, F.lit(False)), STICKER)
    for kind, family in ((IMAGE, "image/"), (VIDEO, "video/"), (AUDIO, "audio/")):
        rule = rule.when(mime.startswith(family), kind)
    for kind, endings in EXTENSIONS.items():
        rule = rule.when(extension.isin(endings), kind)
    return rule.otherwise(FILE).cast("tinyint")
