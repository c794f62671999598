"""A pack for the invented Latin-script prose of the sample tables.

Same shape as the Chinese pack, with words that do occur in that prose, so each
rule has hits to be checked on.
"""

from colloquy.packs.base import DuePhrase, RulePack, TaskPattern

_REST = "[A-Za-z ]"

PROSE = RulePack(
    name="prose",
    sentence_break="[.!?;。！？；\\n\\r]+",
    clause_break="[,，|]+",
    trim_chars=" ,|\t",
    stop_mark=". ",
    final_marks=(".", "!", "?"),
    script_char="[^\\x00-\\x7F]",
    token="[A-Za-z]{3,}",
    topic_token="[A-Za-z]{4,20}",
    keyword_token="[A-Za-z]{4,12}",
    fillers=("okay", "areof", "dela"),
    important=("that", "der", "que", "pour", "con"),
    important_regex="(this|with|und|\\d{4})",
    block_joiner=", ",
    topic_stop=("Que", "Les", "Der", "Die", "Und", "The", "And"),
    topic_stop_lower=(
        "the", "and", "that", "for", "was", "with", "this", "are", "from", "der", "die", "und", "den", "von",
        "que", "les", "des", "une", "pour", "dans", "par", "los", "del", "las", "con",
    ),
    keyword_stop=("that", "with", "this", "from", "pour", "dans", "nicht", "sich"),
    stopwords=(
        "the", "and", "that", "for", "was", "with", "this", "are", "from", "der", "die", "und", "den", "von",
        "que", "les", "des", "une", "pour", "dans", "par", "los", "del", "las", "con",
    ),
    topic_rules=(
        ("licensing", ("License", "licensed")),
        ("origin", ("from", "von", "del")),
        ("purpose", ("for the", "pour", "para")),
        ("company", ("with", "mit", "avec")),
        ("negation", ("not", "nicht", "pas")),
        ("relation", ("that", "que", "dass")),
    ),
    topic_skip=("erth", "thin"),
    positive=("tion", "ment", "lich", "with", "for"),
    negative=("was", "not", "sich", "und", "eau"),
    redundant=("er", "ou", "the", "then"),
    punctuation=((",", "，"), (".", "。"), ("?", "？"), ("!", "！"), (":", "："), (";", "；"), ("(", "（"), (")", "）")),
    ordinals=("and", "und"),
    question_words=("wh", "que"),
    doubled=("thth", "nana"),
    decision_marks=("that", "que", "dass"),
    issue_marks=("not", "nicht", "pas", "was"),
    issue_context=("the", "der", "les"),
    issue_noise=("ou", "sch"),
    action_regex="([A-Za-z]{2,10}) for ([A-Za-z ]{2,40})",
    action_due_regex="(this[a-z ]*)",
    action_owner_block=("the", "and", "that"),
    action_link=" for ",
    lead_fillers=("And", "The", "Und"),
    task_patterns=(
        TaskPattern(f"^([A-Za-z]{{2,10}}) (?:the|der|les) ({_REST}{{2,50}})$", owner=1, task=2, names_assignee=True),
        TaskPattern(f"^(?:[A-Za-z]{{0,8}} )?(?:for|to) ({_REST}{{2,50}}?) (this|that|with|was) (?:the|of|and).*$", task=1, due=2),
        TaskPattern(f"^([A-Za-z]{{2,8}}) (?:is|are) ({_REST}{{2,50}})$", owner=1, task=2, names_assignee=True),
        TaskPattern(f"^(?:of|in) ({_REST}{{2,50}})$", task=1),
        TaskPattern(f"^(this|that|with|was) (?:is|are|in) ({_REST}{{2,50}})$", due=1, task=2),
        TaskPattern(f"^([A-Za-z]{{2,8}}) (this|that|with|was) ({_REST}{{2,50}})$", owner=1, due=2, task=3),
    ),
    task_verbs="(the|tion|ment|der)",
    task_noise=("sch", "ouou"),
    owner_link=" owns ",
    due_open=" (by ",
    due_close=")",
    assignee_regex="^[A-Za-z]{2,8}$",
    assignee_block=("The", "And", "Of"),
    assignee_noise=("wh", "ou"),
    due_phrases=(
        DuePhrase("this", "weekday", "FRI"),
        DuePhrase("that", "weekday_after", "MON"),
        DuePhrase("was", "month_end"),
    ),
    high=("urgent", "ing"),
    medium=("important", "tion"),
    score_verbs=("the", "ment"),
    refine_block=("the", "and"),
    refine_noise=("wh", "ss"),
    refine_function_words=("that", "and"),
    refine_verbs=("the", "of"),
    refine_intents=("for", "with", "this"),
    refine_chatter=("ouou", "schsch"),
    refine_vague=("ouan", "nana"),
    refine_owner_regex="^([A-Za-z]{2,10}) owns ",
    refine_strict_regex="^([A-Za-z]{2,8}) owns ([A-Za-z0-9, \\-]{2,40})$",
    refine_word="[A-Za-z]{2,}",
    due_hint="this|that|was",
    due_context=("of the", "for the"),
    name_regex="[A-Z][a-z]{2,9}",
    name_stop=("The", "And", "Und", "Der", "Die"),
    surnames="[ABCDEFGHIR]",
    titled_surnames="[TOE]",
    titles_kept=("h", "r"),
    titles_dropped=("nd", "er"),
    org_regexes=("([A-Za-z]{2,}(?:tion|ment|heit|keit))", "([A-Z][a-z]+ (?:License|Public))"),
    date_regexes=("\\d{4}-\\d{1,2}-\\d{1,2}", "\\d{1,3}\\.\\d{1,3}", "this", "Q[1-4]"),
    time_regexes=("this|that", "Q[1-4]"),
    entity_task_regexes=(
        "([TOE][a-z]{1,2})(?: the| of)? (?:for|is|and)([^.]+?)(?:[,.;!?]|$)",
        "(to|for)([^.]+?)(the|and)(?:[,.;!?]|$)",
        "([^,.]{2,20}) of ([TOE][a-z]{1,2}) ",
    ),
    refusals=("cannot (access|process)", "as a language model"),
    summary_parts=("Main topics: %s", "%d action clues", "%d decisions"),
)
