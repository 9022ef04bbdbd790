"""Table shapes.

Lists that belong to a thread (messages, participants, attachments) are child
tables keyed by ``(user_id, thread_id)``. A thread row carries what searches
need from them as plain columns, so a thread that holds a large share of all
messages never becomes one oversized row or one oversized task.
"""

KEY = ["user_id", "thread_id"]

MESSAGES = """
    user_id string, message_id string, thread_id string, subject string, from_addr string,
    to_addrs array<string>, date string, has_attachments boolean, body string,
    web_link string, container_id string, arrival_seq bigint
"""

THREADS = """
    user_id string, thread_id string, subject string, date_first string, date_last string,
    n_messages bigint, day_min string, day_max string, has_attachments boolean,
    web_link string, max_attachment_size bigint, attachments_incomplete boolean,
    ai_tags array<string>, user_tags array<string>, manually_reviewed boolean,
    last_synced string, body_char_count bigint, body_scan_status string, tags_truncated boolean
"""

THREAD_MESSAGES = """
    user_id string, thread_id string, message_id string, day string, date string,
    arrival_seq bigint, has_attachments boolean, web_link string
"""

PARTICIPANTS = "user_id string, thread_id string, address string"

ATTACHMENTS = """
    user_id string, thread_id string, message_id string, attachment_id string, name string,
    content_type string, size bigint, actual_char_count bigint, scan_status string
"""

QUERIES = """
    user_id string, session_id bigint, round bigint, query_id bigint, q string,
    search_mode string, has_attachments boolean, has_multiple boolean, date_from string,
    date_to string, min_attachment_kb bigint, sort_by string
"""

CHANGES = """
    user_id string, source_id string, thread_id string, removed_message_id string, seq bigint
"""

STATE_EVENTS = "user_id string, key string, value string, seq bigint"

USAGE_EVENTS = """
    user_id string, ts timestamp, day string, batched boolean, input_tokens bigint,
    output_tokens bigint, cache_read_tokens bigint
"""
