"""Schemas of the raw source tables and of the canonical tables. Nothing is inferred."""

RAW = {
    "handle": "rowid long, id string, service string",
    "chat": "rowid long, guid string, chat_identifier string, service_name string, display_name string",
    "chat_handle_join": "chat_id long, handle_id long",
    "message": (
        "rowid long, guid string, text string, handle_id long, service string, date long, is_from_me int, "
        "item_type int, group_title string, associated_message_guid string, associated_message_type int, "
        "associated_message_emoji string, balloon_bundle_id string, thread_originator_guid string, "
        "date_edited long, date_retracted long"
    ),
    "chat_message_join": "chat_id long, message_id long",
    "attachment": (
        "rowid long, filename string, mime_type string, transfer_name string, total_bytes long, is_sticker int, "
        "hide_attachment int"
    ),
    "message_attachment_join": "message_id long, attachment_id long",
}

HANDLES = "handle_id long, address string, name string, digits string, contact_key string"
CHATS = "chat_id long, identifier string, display_name string, service string"
MEMBERS = "chat_id long, handle_id long"
MESSAGES = (
    "message_id long, source_id long, guid string, chat_id long, handle_id long, from_me boolean, ts timestamp, "
    "text string, kind int, service string, reply_to string, edited boolean, unsent boolean, has_link boolean, "
    "attach_count long"
)
ATTACHMENTS = (
    "attachment_id long, message_id long, filename string, mime string, path string, bytes long, kind int"
)
REACTIONS = (
    "reaction_id long, target_guid string, part long, handle_id long, from_me boolean, emoji string, "
    "removed boolean, ts timestamp"
)
REACTION_STATE = (
    "target_guid string, part long, from_me boolean, handle_id long, emoji string, ts timestamp, reaction_id long, removed boolean"
)
WINDOWS = (
    "window_id long, chat_id long, start_ts timestamp, end_ts timestamp, first_id long, last_id long, "
    "n_messages long, text string, text_hash long"
)
VECTORS = "window_id long, chat_id long, start_ts timestamp, model_id string, status string, v array<float>, q array<tinyint>"
DIRTY = "chat_id long, from_ts timestamp"
STATE = "key string, value string, seq long"


def empty(spark, schema: str):
    return spark.createDataFrame([], schema)
