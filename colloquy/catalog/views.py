"""The sample-table views once more as SQL text, for the checking queries."""

MEETINGS = """meetings AS (SELECT c_custkey AS id, c_name AS title, c_mktsegment AS description,
  CAST(c_nationkey AS BIGINT) AS owner_id, c_acctbal AS duration,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'scheduled' WHEN 'MACHINERY' THEN 'archived' ELSE 'completed' END AS status
  FROM customer)"""

TASKS = """tasks AS (SELECT o_orderkey AS id, o_custkey AS meeting_id,
  'Order "' || o_orderkey || '"' AS title, 'Order item ' || (o_orderkey % 100) AS description,
  CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'P' THEN 'in_progress' ELSE 'completed' END AS status,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'urgent' WHEN '2-HIGH' THEN 'high' WHEN '3-MEDIUM' THEN 'medium'
    WHEN '5-LOW' THEN 'low' END AS priority,
  o_orderdate AS created_at,
  CASE WHEN o_orderkey % 7 <> 0 THEN o_orderdate + to_days(CAST(o_orderkey % 60 AS INTEGER)) END AS due_date,
  CASE WHEN o_orderstatus = 'F' THEN o_orderdate + to_days(CAST(o_orderkey % 30 + 1 AS INTEGER)) END AS completed_at,
  o_custkey % 25 AS assignee_id,
  CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END AS extracted_from_text,
  (o_orderkey % 100) / 100 AS confidence, o_totalprice AS amount FROM orders)"""

USERS = "users AS (SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS username FROM nation)"

COMMENTS = """comments AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS task_id,
  l_suppkey AS author_id, l_returnflag || l_linestatus AS content FROM lineitem)"""

SEGMENTS = """segments AS (SELECT conv_id AS meeting_id, turn AS seg_no, role AS speaker, text,
  (sum(length(text)) OVER w - length(text)) / 10 AS start_time, sum(length(text)) OVER w / 10 AS end_time
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))"""

EVENTS = """timed AS (SELECT user_id AS meeting_id, event_id AS seg_no, event_type AS speaker,
  epoch_us(ts) / 1e6 AS start_time, epoch_us(ts) / 1e6 + value * 60 AS end_time,
  (event_id % 10) / 10 AS confidence, props AS text, ts FROM events)"""

AS_OF = "TIMESTAMP '1998-08-01 00:00:00'"
RANK = "CASE priority WHEN 'urgent' THEN 0 WHEN 'high' THEN 1 WHEN 'low' THEN 3 ELSE 2 END"
DAYS = f"(epoch_us(due_date) - epoch_us({AS_OF})) / 86400000000.0"
OVERDUE = f"coalesce(status <> 'completed' AND {DAYS} < 0, false)"
DUE_SOON = f"coalesce(status <> 'completed' AND {DAYS} BETWEEN 0 AND 2, false)"


def stamp(col: str) -> str:
    return f"strftime({col}, '%Y-%m-%d %H:%M:%S')"


def with_(*views: str) -> str:
    return "WITH " + ",\n".join(views) + "\n"
