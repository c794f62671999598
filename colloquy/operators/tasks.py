"""Work items: filters, order, reminders, statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from colloquy.functions.dates import as_time, days_between
from colloquy.functions.text import strip
from colloquy.plans.hot import number_rows

# Rank of a priority, most pressing first; unknown counts as medium.
PRIORITY_RANK = (("urgent", 0), ("high", 1), ("medium", 2), ("low", 3))
MEDIUM_RANK = 2
# Old meeting states and what they are called now.
LEGACY_STATUS = (
    ("draft", "scheduled"), ("pending", "scheduled"), ("processing", "in_progress"),
    ("transcribed", "in_progress"), ("analyzed", "completed"),
)


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def priority_rank(col="priority") -> Column:
    out = F.lit(MEDIUM_RANK)
    for name, rank in PRIORITY_RANK:
        out = F.when(_col(col) == name, rank).otherwise(out)
    return out


def priority_weight(col="priority") -> Column:
    """The client's reversed scale: urgent 4 to low 1, anything else 0."""
    out = F.lit(0)
    for name, rank in PRIORITY_RANK:
        out = F.when(_col(col) == name, 4 - rank).otherwise(out)
    return out


def normalize_status(col="status", mapping=LEGACY_STATUS) -> Column:
    out = _col(col)
    for old, new in mapping:
        out = F.when(_col(col) == old, new).otherwise(out)
    return out


def page_after(df: DataFrame, order: Sequence[tuple[str, bool]], last: dict | None = None, limit: int = 50) -> DataFrame:
    """The page behind a row, by its sort values: columns of ``order`` with whether they fall.

    ``last`` holds the values of those columns in the last row of the page before, None
    for the first page. Rows before are filtered in the scan, never sorted and skipped,
    however far the page lies. Rising columns have nulls first, falling ones last. The
    columns together tell rows apart, else rows equal to the last are passed over.
    """
    sort = [F.col(c).desc() if falls else F.col(c).asc() for c, falls in order]
    if last is not None:
        behind, equal = F.lit(False), F.lit(True)
        for c, falls in order:
            value = F.lit(last[c]).cast(df.schema[c].dataType)
            if last[c] is None:
                after = F.lit(False) if falls else F.col(c).isNotNull()
            else:
                after = (F.col(c) < value) | F.col(c).isNull() if falls else F.col(c) > value
            behind, equal = behind | (equal & after), equal & F.col(c).eqNullSafe(value)
        df = df.filter(behind)
    return df.orderBy(*sort).limit(limit)


def page(df: DataFrame, order: list, skip: int = 0, limit: int = 50) -> DataFrame:
    """Rows ``skip .. skip+limit`` of a total order (the order must be unique to be stable)."""
    return df.orderBy(*order).offset(skip).limit(limit)


def owned_tasks(tasks: DataFrame, meetings: DataFrame, owner_id) -> DataFrame:
    mine = meetings.filter(F.col("owner_id") == owner_id).select(F.col("id").alias("meeting_id"))
    return tasks.join(mine, "meeting_id", "left_semi")


def filter_tasks(tasks: DataFrame, status=None, priority=None, meeting_id=None, assignee_id=None) -> DataFrame:
    """Conjunction of the filters given; a falsy argument filters nothing."""
    wanted = {"status": status, "priority": priority, "meeting_id": meeting_id, "assignee_id": assignee_id}
    for name, value in wanted.items():
        if value:
            tasks = tasks.filter(F.col(name) == value)
    return tasks


def list_tasks(tasks, meetings, owner_id, skip: int = 0, limit: int = 50, **filters) -> DataFrame:
    return page(filter_tasks(owned_tasks(tasks, meetings, owner_id), **filters), ["id"], skip, limit)


def list_meetings(meetings: DataFrame, owner_id, status=None, skip: int = 0, limit: int = 50) -> DataFrame:
    """A page of a user's meetings with the total before paging."""
    found = meetings.filter(F.col("owner_id") == owner_id)
    if status:
        found = found.filter(F.col("status") == status)
    total = found.agg(F.count(F.lit(1)).alias("total")).scalar()
    return page(found, ["id"], skip, limit).withColumn("total", total)


def search_meetings(meetings: DataFrame, text: str) -> DataFrame:
    needle = text.lower()
    hit = lambda c: F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(needle))
    return meetings.filter(hit("title") | hit("description"))


def with_meeting_title(tasks: DataFrame, meetings: DataFrame) -> DataFrame:
    titles = meetings.select(F.col("id").alias("meeting_id"), F.col("title").alias("meeting_title"))
    return tasks.join(titles, "meeting_id", "left")


def reminder_flags(tasks: DataFrame, as_of: str) -> DataFrame:
    days = days_between("due_date", as_time(as_of))
    open_ = F.col("status") != "completed"
    flag = lambda c: F.coalesce(open_ & c, F.lit(False))
    return (
        tasks.withColumn("is_overdue", flag(days < 0))
        .withColumn("is_due_soon", flag(days.between(0, 2)))
        .withColumn("days_left", F.round(days, 2))
    )


def urgent_tasks(
    tasks, meetings, owner_id, as_of: str, limit: int = 10, include_completed: bool = False, **filters
) -> DataFrame:
    """Most pressing first; the title and flags are added after the cut."""
    found = filter_tasks(owned_tasks(tasks, meetings, owner_id), **filters)
    if not include_completed:
        found = found.filter(F.col("status") != "completed")
    top = found.orderBy(
        priority_rank(), F.col("due_date").asc_nulls_last(), F.col("created_at").desc_nulls_last(), "id"
    ).limit(max(1, min(limit, 100)))
    return reminder_flags(with_meeting_title(top, meetings), as_of)


def reminders(tasks, meetings, owner_id, as_of: str, limit: int = 100, **filters) -> DataFrame:
    """The earliest open tasks, split into overdue and due soon with their counts."""
    found = filter_tasks(owned_tasks(tasks, meetings, owner_id), **filters).filter(
        F.col("due_date").isNotNull() & (F.col("status") != "completed")
    )
    first = found.orderBy("due_date", "id").limit(max(1, min(limit, 500)))
    bucket = F.when(F.col("is_overdue"), "overdue").when(F.col("is_due_soon"), "due_soon")
    marked = reminder_flags(first, as_of).withColumn("bucket", bucket).filter(F.col("bucket").isNotNull())
    # at most 500 rows reach this window
    return marked.withColumn("bucket_count", F.count(F.lit(1)).over(Window.partitionBy("bucket")))


def sort_tasks(tasks: DataFrame, by: str = "newest", show: str = "all") -> DataFrame:
    if show == "completed":
        tasks = tasks.filter(F.col("status") == "completed")
    elif show == "pending":
        tasks = tasks.filter(F.col("status") != "completed")
    order = {
        "newest": [F.col("created_at").desc_nulls_last()],
        "oldest": [F.col("created_at").asc_nulls_first()],
        "priority": [priority_weight().desc()],
        "due": [F.col("due_date").asc_nulls_last()],
    }[by]
    return tasks.orderBy(*order, "id")


def task_positions(tasks: DataFrame, views) -> DataFrame:
    """``(view, id, position)``: the place of each task in the orders of ``sort_tasks``, from 1, for views (by, show).

    An order is cut into slices, so no task sorts a whole view.
    """
    time = lambda c: F.unix_micros(F.col(c).cast("timestamp")).cast("double")
    never = F.lit(1e16)
    at = {
        "newest": F.coalesce(-time("created_at"), never), "oldest": F.coalesce(time("created_at"), -never),
        "priority": -priority_weight().cast("double"), "due": F.coalesce(time("due_date"), never),
    }
    rows = None
    for by, show in views:
        shown = {"completed": F.col("status") == "completed", "pending": F.col("status") != "completed"}.get(show, F.lit(True))
        part = tasks.filter(shown).select(F.lit(by).alias("view"), "id", at[by].alias("_at"))
        rows = part if rows is None else rows.unionAll(part)
    return number_rows(rows, ["view"], ["_at", "id"], "position").select("view", "id", (F.col("position") + 1).alias("position"))


def task_timeline(items: DataFrame, unassigned: str = "待分配") -> DataFrame:
    label = F.when(F.length("description") > 30, F.concat(F.substring("description", 1, 30), F.lit("...")))
    return items.filter(F.col("due_date").isNotNull()).select(
        "id", label.otherwise(F.col("description")).alias("label"), "due_date",
        F.coalesce(F.nullif(F.col("assignee"), F.lit("")), F.lit(unassigned)).alias("assignee"),
        F.upper(F.coalesce("priority", F.lit("medium"))).alias("priority"),
    ).orderBy("due_date", "id")


def recent_actions(tasks: DataFrame, n: int = 20) -> DataFrame:
    """The newest ``n`` nonblank tasks of each meeting."""
    text = strip(F.coalesce(F.nullif(F.col("description"), F.lit("")), F.col("title"), F.lit("")))
    newest = Window.partitionBy("meeting_id").orderBy(F.col("created_at").desc(), "id")
    return (
        tasks.withColumn("action", text).filter(F.col("action") != "")
        .withColumn("rank", F.row_number().over(newest)).filter(F.col("rank") <= n)
    )


# --- statistics -------------------------------------------------------------------------------

def _status_count(status: str) -> Column:
    return F.count_if(F.col("status") == status)


def task_summary(tasks: DataFrame) -> DataFrame:
    hours = days_between("completed_at", "created_at") * 24
    return tasks.agg(
        F.count(F.lit(1)).alias("total_tasks"),
        *[_status_count(s).alias(f"{s}_tasks") for s in ("pending", "in_progress", "completed", "blocked")],
        F.coalesce(F.round(F.avg(hours), 2), F.lit(0.0)).alias("average_completion_hours"),
    )


def assignee_stats(tasks: DataFrame) -> DataFrame:
    return tasks.groupBy("assignee_id").agg(
        F.count(F.lit(1)).alias("total_assigned"),
        *[_status_count(s).alias(s) for s in ("completed", "in_progress", "pending", "blocked")],
    )


def meeting_task_stats(tasks: DataFrame) -> DataFrame:
    done = _status_count("completed")
    return tasks.groupBy("meeting_id").agg(
        F.count(F.lit(1)).alias("total_tasks"), done.alias("completed_tasks"),
        _status_count("pending").alias("pending_tasks"),
        F.round(done * 100 / F.count(F.lit(1)), 2).alias("completion_rate"),
    )


def task_cube(tasks: DataFrame) -> DataFrame:
    """Counts for every combination of status and priority, totals included, in one pass."""
    return tasks.select("status", F.coalesce("priority", F.lit("none")).alias("priority")).cube("status", "priority").agg(
        F.count(F.lit(1)).alias("n"),
        (F.grouping("status") * 2 + F.grouping("priority")).cast("bigint").alias("level"),
    )


def meeting_statistics(meetings: DataFrame, tasks: DataFrame) -> DataFrame:
    """Totals, minutes and tasks per meeting, per meeting status."""
    per_meeting = tasks.groupBy(F.col("meeting_id").alias("id")).agg(F.count(F.lit(1)).alias("_tasks"))
    joined = meetings.join(per_meeting, "id", "left")
    return joined.groupBy("status").agg(
        F.count(F.lit(1)).alias("meetings"),
        F.round(F.sum("duration") / 60, 2).alias("minutes"),
        F.coalesce(F.sum("_tasks"), F.lit(0)).alias("tasks"),
        F.round(F.coalesce(F.sum("_tasks"), F.lit(0)) / F.count(F.lit(1)), 2).alias("tasks_per_meeting"),
    )


def user_statistics(users: DataFrame, meetings: DataFrame, tasks: DataFrame) -> DataFrame:
    """Per user: meetings held, tasks assigned and tasks completed."""
    held = meetings.groupBy(F.col("owner_id").alias("id")).agg(F.count(F.lit(1)).alias("meetings"))
    given = tasks.groupBy(F.col("assignee_id").alias("id")).agg(
        F.count(F.lit(1)).alias("assigned"), _status_count("completed").alias("completed")
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return users.join(held, "id", "left").join(given, "id", "left").select(
        "id", "username", zero("meetings"), zero("assigned"), zero("completed")
    )


def priority_histogram(items: DataFrame) -> DataFrame:
    """HIGH, MEDIUM and LOW with zero rows for absent ones; unknown counts as MEDIUM."""
    name = F.upper(F.coalesce("priority", F.lit("medium")))
    known = F.when(name.isin("HIGH", "MEDIUM", "LOW"), name).otherwise("MEDIUM")
    counts = items.groupBy(known.alias("priority")).agg(F.count(F.lit(1)).alias("n"))
    domain = items.sparkSession.createDataFrame([("HIGH",), ("MEDIUM",), ("LOW",)], "priority string")
    return domain.join(counts, "priority", "left").select("priority", F.coalesce("n", F.lit(0)).alias("n"))
