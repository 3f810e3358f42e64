"""Table schemas of the engine. ``part_index``, ``record_pos`` and ``seq`` carry the order
that a row store keeps implicitly and a distributed table does not."""

EMAILS = (
    "email_id string not null, message_id string, subject string not null, sender string not null, "
    "date_received timestamp not null, status string not null, created_at timestamp"
)
ATTACHMENTS = (
    "attachment_id string not null, email_id string not null, part_index int, filename string not null, "
    "raw_text string, status string not null, error_message string, created_at timestamp"
)
RECORDS = (
    "record_id string not null, attachment_id string not null, record_pos int, "
    "dynamic_data map<string,string> not null, region string, is_validated boolean, created_at timestamp"
)
REPLIES = "attachment_id string, attempt int, content string, error string"
STATUS_EVENTS = (
    "job_id string, seq long, ts timestamp, type string, email_id string, attachment_id string, "
    "filename string, error string, record_count int"
)
EDITS = (
    "record_id string, seq long, op string, field string, value string, "
    "dynamic_data map<string,string>, region string"
)

TABLES = {
    "emails": EMAILS,
    "attachments": ATTACHMENTS,
    "records": RECORDS,
    "replies": REPLIES,
    "status_events": STATUS_EVENTS,
    "edits": EDITS,
}
