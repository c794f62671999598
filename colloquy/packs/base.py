"""The shape of a rule pack.

A pack is plain data. Operators compile it into ``Column`` expressions on the
driver, so no word list is shipped to executors other than inside the plan.
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class TaskPattern:
    """One task sentence shape; group numbers refer to ``regex``, 0 = absent."""

    regex: str
    task: int
    owner: int = 0
    due: int = 0
    names_assignee: bool = False


@dataclass(frozen=True)
class DuePhrase:
    """What a date phrase means: ``rule`` is one of weekday, weekday_after, month_end."""

    phrase: str
    rule: str
    weekday: str = ""


@dataclass(frozen=True)
class RulePack:
    name: str
    # sentences and tokens
    sentence_break: str
    clause_break: str
    trim_chars: str
    stop_mark: str
    final_marks: tuple[str, ...]
    script_char: str
    token: str
    topic_token: str
    keyword_token: str
    # utterances
    fillers: tuple[str, ...]
    important: tuple[str, ...]
    important_regex: str
    block_joiner: str
    # topics
    topic_stop: tuple[str, ...]
    topic_stop_lower: tuple[str, ...]
    keyword_stop: tuple[str, ...]
    stopwords: tuple[str, ...]
    topic_rules: tuple[tuple[str, tuple[str, ...]], ...]
    topic_skip: tuple[str, ...]
    # sentiment
    positive: tuple[str, ...]
    negative: tuple[str, ...]
    # cleaning
    redundant: tuple[str, ...]
    punctuation: tuple[tuple[str, str], ...]
    ordinals: tuple[str, ...]
    question_words: tuple[str, ...]
    doubled: tuple[str, ...]
    # decisions, issues, actions
    decision_marks: tuple[str, ...]
    issue_marks: tuple[str, ...]
    issue_context: tuple[str, ...]
    issue_noise: tuple[str, ...]
    action_regex: str
    action_due_regex: str
    action_owner_block: tuple[str, ...]
    action_link: str
    # tasks
    lead_fillers: tuple[str, ...]
    task_patterns: tuple[TaskPattern, ...]
    task_verbs: str
    task_noise: tuple[str, ...]
    owner_link: str
    due_open: str
    due_close: str
    assignee_regex: str
    assignee_block: tuple[str, ...]
    assignee_noise: tuple[str, ...]
    due_phrases: tuple[DuePhrase, ...]
    high: tuple[str, ...]
    medium: tuple[str, ...]
    score_verbs: tuple[str, ...]
    # second task filter
    refine_block: tuple[str, ...]
    refine_noise: tuple[str, ...]
    refine_function_words: tuple[str, ...]
    refine_verbs: tuple[str, ...]
    refine_intents: tuple[str, ...]
    refine_chatter: tuple[str, ...]
    refine_vague: tuple[str, ...]
    refine_owner_regex: str
    refine_strict_regex: str
    refine_word: str
    due_hint: str
    due_context: tuple[str, ...]
    # entities
    name_regex: str
    name_stop: tuple[str, ...]
    surnames: str
    titled_surnames: str
    titles_kept: tuple[str, ...]
    titles_dropped: tuple[str, ...]
    org_regexes: tuple[str, ...]
    date_regexes: tuple[str, ...]
    time_regexes: tuple[str, ...]
    entity_task_regexes: tuple[str, ...]
    # refusal patterns of generated summaries
    refusals: tuple[str, ...] = field(default=())
    summary_parts: tuple[str, str, str] = ("", "", "")
