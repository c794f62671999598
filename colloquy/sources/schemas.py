"""Declared schemas (DDL text) of the stored tables and domain values of their enums."""


USERS = (
    "id bigint, username string, email string, full_name string, is_active boolean, role string, "
    "created_at timestamp_ntz, updated_at timestamp_ntz"
)
MEETINGS = (
    "id bigint, title string, description string, start_time timestamp_ntz, end_time timestamp_ntz, "
    "duration double, participants int, location string, status string, owner_id bigint, audio_path string, "
    "transcript_raw string, transcript_formatted string, summary string, summary_type string, "
    "key_topics string, created_at timestamp_ntz, updated_at timestamp_ntz"
)
SEGMENTS = (
    "id bigint, meeting_id bigint, speaker string, speaker_index int, text string, start_time double, "
    "end_time double, confidence double, language string"
)
TASKS = (
    "id bigint, meeting_id bigint, title string, description string, due_date timestamp_ntz, priority string, "
    "assignee_id bigint, assignee_name string, status string, extracted_from_text string, confidence double, "
    "created_at timestamp_ntz, updated_at timestamp_ntz, completed_at timestamp_ntz"
)
COMMENTS = (
    "id bigint, author_id bigint, meeting_id bigint, task_id bigint, content string, "
    "created_at timestamp_ntz, updated_at timestamp_ntz"
)
METRICS = (
    "timestamp double, cpu_percent double, memory_mb double, gpu_memory_mb double, disk_io_read_mb double, "
    "disk_io_write_mb double, network_sent_mb double, network_recv_mb double"
)

TABLES = {
    "users": USERS, "meetings": MEETINGS, "transcript_segments": SEGMENTS, "tasks": TASKS,
    "comments": COMMENTS, "resource_metrics": METRICS,
}

# The domains of the enum columns.
ROLES = ("admin", "manager", "user", "guest")
MEETING_STATUS = ("scheduled", "in_progress", "completed", "archived")
TASK_STATUS = ("pending", "in_progress", "completed", "blocked")
PRIORITY = ("low", "medium", "high", "urgent")
ITEM_PRIORITY = ("low", "medium", "high")
