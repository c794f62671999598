"""Queries over work items and meetings."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy.catalog.registry import query
from colloquy.catalog.views import AS_OF, COMMENTS, DAYS, DUE_SOON, MEETINGS, OVERDUE, RANK, TASKS, USERS, stamp, with_
from colloquy.operators import tasks as ops
from colloquy.sources import tables as t

OWNER = 7
WHEN = t.AS_OF
FMT = "yyyy-MM-dd HH:mm:ss"


def text_time(*names):
    return [F.date_format(n, FMT).alias(n) for n in names]


@query("S01_load_tables", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")
def load_tables(spark, d):
    return t.load(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


@query("P01_list_tasks", with_(TASKS, MEETINGS) + f"""
SELECT id, meeting_id, title, status, priority FROM tasks
WHERE meeting_id IN (SELECT id FROM meetings WHERE owner_id = {OWNER}) AND status = 'pending' AND priority = 'high'
ORDER BY id LIMIT 50 OFFSET 0""")
def list_tasks(spark, d):
    return ops.list_tasks(
        t.tasks(spark, d), t.meetings(spark, d), OWNER, status="pending", priority="high"
    ).select("id", "meeting_id", "title", "status", "priority")


@query("P02_list_meetings", with_(MEETINGS) + f"""
SELECT id, title, status, (SELECT count(*) FROM meetings WHERE owner_id = {OWNER} AND status = 'completed') AS total
FROM meetings WHERE owner_id = {OWNER} AND status = 'completed' ORDER BY id LIMIT 10 OFFSET 5""")
def list_meetings(spark, d):
    return ops.list_meetings(t.meetings(spark, d), OWNER, "completed", 5, 10).select("id", "title", "status", "total")


@query("P03_search_meetings", with_(MEETINGS) + """
SELECT id, title FROM meetings WHERE contains(lower(title), 'er#00000012') OR contains(lower(description), 'er#00000012')
  OR contains(lower(title), 'mobil') OR contains(lower(description), 'mobil')""")
def search_meetings(spark, d):
    m = t.meetings(spark, d)
    both = ops.search_meetings(m, "ER#00000012").unionByName(ops.search_meetings(m, "Mobil"))
    return both.select("id", "title").distinct()


@query("P05_reminder_flags", with_(TASKS) + f"""
SELECT id, {OVERDUE} AS is_overdue, {DUE_SOON} AS is_due_soon, round({DAYS}, 2) AS days_left FROM tasks""")
def reminder_flags(spark, d):
    return ops.reminder_flags(t.tasks(spark, d), WHEN).select("id", "is_overdue", "is_due_soon", "days_left")


@query("P06_priority_rank", with_(TASKS) + f"""
SELECT coalesce(priority, 'none') AS priority, CAST({RANK} AS BIGINT) AS rank,
  CAST(CASE priority WHEN 'urgent' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END AS BIGINT) AS weight,
  count(*) AS n FROM tasks GROUP BY ALL""")
def priority_rank(spark, d):
    return t.tasks(spark, d).groupBy(
        F.coalesce("priority", F.lit("none")).alias("priority"), ops.priority_rank().cast("bigint").alias("rank"),
        ops.priority_weight().cast("bigint").alias("weight"),
    ).agg(F.count(F.lit(1)).alias("n"))


_LEGACY = "CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'P' THEN 'processing' ELSE 'analyzed' END"


@query("P07_normalize_status", f"""
SELECT old_status, CASE old_status WHEN 'pending' THEN 'scheduled' WHEN 'processing' THEN 'in_progress'
  WHEN 'analyzed' THEN 'completed' ELSE old_status END AS new_status, count(*) AS n
FROM (SELECT {_LEGACY} AS old_status FROM orders UNION ALL SELECT event_type FROM events) GROUP BY ALL""")
def normalize_status(spark, d):
    status = F.col("o_orderstatus")
    old = F.when(status == "O", "pending").when(status == "P", "processing").otherwise("analyzed").alias("old_status")
    rows = t.load(spark, d, "orders").select(old).unionAll(
        t.load(spark, d, "events").select(F.col("event_type").alias("old_status"))
    )
    return rows.groupBy("old_status", ops.normalize_status("old_status").alias("new_status")).agg(F.count(F.lit(1)).alias("n"))


@query("P12_page", with_(TASKS) + "SELECT id, title FROM tasks ORDER BY created_at DESC, id LIMIT 30 OFFSET 60")
def page(spark, d):
    return ops.page(t.tasks(spark, d), [F.col("created_at").desc(), "id"], 60, 30).select("id", "title")


@query("P12_page_after", with_(TASKS) + "SELECT id, title FROM tasks ORDER BY created_at DESC, id LIMIT 30 OFFSET 60")
def page_after(spark, d):
    rows, order = t.tasks(spark, d), [("created_at", True), ("id", False)]
    # the two pages before, 30 rows each; the last row of one is where the next begins
    last = None
    for _ in range(2):
        end = ops.page_after(rows.select("created_at", "id"), order, last, 30).tail(1)
        if not end:
            return rows.select("id", "title").limit(0)
        last = end[0].asDict()
    return ops.page_after(rows, order, last, 30).select("id", "title")


@query("J01_owned_tasks", with_(TASKS, MEETINGS) + f"""
SELECT id, meeting_id FROM tasks WHERE meeting_id IN (SELECT id FROM meetings WHERE owner_id = {OWNER})""")
def owned_tasks(spark, d):
    return ops.owned_tasks(t.tasks(spark, d), t.meetings(spark, d), OWNER).select("id", "meeting_id")


@query("J02_with_meeting_title", with_(TASKS, MEETINGS) + """
SELECT tasks.id, meeting_id, meetings.title AS meeting_title FROM tasks LEFT JOIN meetings ON meeting_id = meetings.id""")
def with_meeting_title(spark, d):
    return ops.with_meeting_title(t.tasks(spark, d), t.meetings(spark, d)).select("id", "meeting_id", "meeting_title")


@query("O01_urgent_tasks", with_(TASKS, MEETINGS) + f"""
SELECT tasks.id, meeting_id, priority, {stamp('due_date')} AS due_date, {OVERDUE} AS is_overdue, {DUE_SOON} AS is_due_soon,
  round({DAYS}, 2) AS days_left, title AS meeting_title
FROM (SELECT * EXCLUDE (title) FROM tasks WHERE status <> 'completed'
  AND meeting_id IN (SELECT id FROM meetings WHERE owner_id = {OWNER})
  ORDER BY {RANK}, due_date ASC NULLS LAST, created_at DESC, id LIMIT 25) AS tasks
JOIN (SELECT id AS mid, title FROM meetings) ON mid = meeting_id""")
def urgent_tasks(spark, d):
    return ops.urgent_tasks(t.tasks(spark, d), t.meetings(spark, d), OWNER, WHEN, 25).select(
        "id", "meeting_id", "priority", *text_time("due_date"), "is_overdue", "is_due_soon", "days_left", "meeting_title"
    )


@query("O02_reminders", with_(TASKS, MEETINGS) + f"""
SELECT id, {stamp('due_date')} AS due_date, bucket, count(*) OVER (PARTITION BY bucket) AS bucket_count FROM (
  SELECT id, due_date, CASE WHEN {OVERDUE} THEN 'overdue' WHEN {DUE_SOON} THEN 'due_soon' END AS bucket FROM (
    SELECT * FROM tasks WHERE due_date IS NOT NULL AND status <> 'completed'
      AND meeting_id IN (SELECT id FROM meetings WHERE owner_id = {OWNER}) ORDER BY due_date, id LIMIT 400))
WHERE bucket IS NOT NULL""")
def reminders(spark, d):
    return ops.reminders(t.tasks(spark, d), t.meetings(spark, d), OWNER, WHEN, 400).select(
        "id", *text_time("due_date"), "bucket", "bucket_count"
    )


@query("O04_sort_tasks", with_(TASKS) + """
SELECT 'newest' AS view, id, row_number() OVER (ORDER BY created_at DESC, id) AS position FROM tasks
UNION ALL SELECT 'oldest', id, row_number() OVER (ORDER BY created_at, id) FROM tasks WHERE status = 'completed'
UNION ALL SELECT 'priority', id, row_number() OVER (
  ORDER BY CASE priority WHEN 'urgent' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END DESC, id) FROM tasks WHERE status <> 'completed'
UNION ALL SELECT 'due', id, row_number() OVER (ORDER BY due_date ASC NULLS LAST, id) FROM tasks""")
def sort_tasks(spark, d):
    all_tasks = t.tasks(spark, d)
    views = [("newest", "all"), ("oldest", "completed"), ("priority", "pending"), ("due", "all")]
    return ops.task_positions(all_tasks, views).select("view", "id", "position")


@query("O05_task_timeline", with_(TASKS) + f"""
SELECT id, CASE WHEN length(d) > 30 THEN substr(d, 1, 30) || '...' ELSE d END AS label, {stamp('due_date')} AS due_date,
  CASE WHEN assignee_id = 0 THEN '待分配' ELSE 'u' || assignee_id END AS assignee, upper(coalesce(priority, 'medium')) AS priority
FROM (SELECT *, description || ' of ' || status || ' ' || title AS d FROM tasks) WHERE due_date IS NOT NULL""")
def task_timeline(spark, d):
    items = t.tasks(spark, d).withColumn(
        "description", F.concat_ws(" ", F.concat(F.col("description"), F.lit(" of")), "status", "title")
    ).withColumn("assignee", F.when(F.col("assignee_id") != 0, F.concat(F.lit("u"), F.col("assignee_id").cast("string"))))
    return ops.task_timeline(items).select("id", "label", *text_time("due_date"), "assignee", "priority")


@query("O06_recent_actions", with_(TASKS) + """
SELECT id, meeting_id, action, rank FROM (SELECT id, meeting_id, description AS action,
  row_number() OVER (PARTITION BY meeting_id ORDER BY created_at DESC, id) AS rank FROM tasks) WHERE rank <= 20""")
def recent_actions(spark, d):
    return ops.recent_actions(t.tasks(spark, d)).select("id", "meeting_id", "action", F.col("rank").cast("bigint").alias("rank"))


_COUNTS = ", ".join(f"count(*) FILTER (WHERE status = '{s}') AS {s}" for s in ("pending", "in_progress", "completed", "blocked"))
_TASK_COUNTS = ", ".join(f"count(*) FILTER (WHERE status = '{s}') AS {s}_tasks" for s in ("pending", "in_progress", "completed", "blocked"))


@query("A01_task_summary", with_(TASKS) + f"""
SELECT count(*) AS total_tasks, {_TASK_COUNTS},
  coalesce(round(avg((epoch_us(completed_at) - epoch_us(created_at)) / 86400000000.0 * 24), 2), 0.0) AS average_completion_hours
FROM tasks""")
def task_summary(spark, d):
    return ops.task_summary(t.tasks(spark, d))


@query("A02_assignee_stats", with_(TASKS) + f"SELECT assignee_id, count(*) AS total_assigned, {_COUNTS} FROM tasks GROUP BY 1")
def assignee_stats(spark, d):
    return ops.assignee_stats(t.tasks(spark, d))


@query("A03_meeting_task_stats", with_(TASKS) + """
SELECT meeting_id, count(*) AS total_tasks, count(*) FILTER (WHERE status = 'completed') AS completed_tasks,
  count(*) FILTER (WHERE status = 'pending') AS pending_tasks,
  round(count(*) FILTER (WHERE status = 'completed') * 100 / count(*), 2) AS completion_rate FROM tasks GROUP BY 1""")
def meeting_task_stats(spark, d):
    return ops.meeting_task_stats(t.tasks(spark, d))


@query("A04_task_cube", with_(TASKS) + """
SELECT status, priority, count(*) AS n, CAST(grouping(status) * 2 + grouping(priority) AS BIGINT) AS level
FROM (SELECT status, coalesce(priority, 'none') AS priority FROM tasks) GROUP BY CUBE (status, priority)""")
def task_cube(spark, d):
    return ops.task_cube(t.tasks(spark, d))


@query("A05_meeting_statistics", with_(TASKS, MEETINGS) + """
SELECT status, count(*) AS meetings, round(sum(duration) / 60, 2) AS minutes, CAST(coalesce(sum(n), 0) AS BIGINT) AS tasks,
  round(CAST(coalesce(sum(n), 0) AS DOUBLE) / count(*), 2) AS tasks_per_meeting
FROM meetings LEFT JOIN (SELECT meeting_id, count(*) AS n FROM tasks GROUP BY 1) ON id = meeting_id GROUP BY 1""")
def meeting_statistics(spark, d):
    return ops.meeting_statistics(t.meetings(spark, d), t.tasks(spark, d))


@query("A05_user_statistics", with_(TASKS, MEETINGS, USERS) + """
SELECT id, username, coalesce(m, 0) AS meetings, coalesce(a, 0) AS assigned, coalesce(c, 0) AS completed FROM users
LEFT JOIN (SELECT owner_id, count(*) AS m FROM meetings GROUP BY 1) ON owner_id = id
LEFT JOIN (SELECT assignee_id, count(*) AS a, count(*) FILTER (WHERE status = 'completed') AS c FROM tasks GROUP BY 1)
  ON assignee_id = id""")
def user_statistics(spark, d):
    return ops.user_statistics(t.users(spark, d), t.meetings(spark, d), t.tasks(spark, d))


@query("A15_priority_histogram", with_(TASKS) + """
SELECT p AS priority, count(id) AS n FROM (VALUES ('HIGH'), ('MEDIUM'), ('LOW')) v(p) LEFT JOIN (
  SELECT id, CASE WHEN upper(priority) IN ('HIGH', 'MEDIUM', 'LOW') THEN upper(priority) ELSE 'MEDIUM' END AS q FROM tasks) ON q = p GROUP BY 1""")
def priority_histogram(spark, d):
    return ops.priority_histogram(t.tasks(spark, d))
