"""Table schemas and constants.

Fixed values: weights, limits and word lists that results depend on.
"""

from __future__ import annotations

EVENTS = (
    "event_id string, session_id string, segment_id string, ts timestamp, msg_index int, sub_index int, type string, role string, "
    "content string, tool_name string, tool_input string, token_estimate bigint"
)
SESSIONS = "session_id string, parent_id string, interface string, label string, created_at timestamp, last_active timestamp, status string"
LINEAGE = "old_session_id string, new_session_id string, created_at timestamp"
EDGES = "from_event_id string, to_event_id string, edge_type string, session_id string, created_at timestamp"
HISTORY = "id bigint, session_id string, ts timestamp, goal string, current_step string, intent_label string, decisions array<struct<decision:string,rationale:string>>"
VECTORS = "event_id string, session_id string, segment_id string, embedding array<float>, token_count int, type string, embedding_model_id string"
MESSAGES = (
    "session_id string, msg_index int, role string, content string, name string, "
    "tool_calls array<struct<id:string,function:struct<name:string,arguments:string>>>"
)
STATE = (
    "schema_version int, session_id string, segment_id string, goal string, current_step string, open_loops array<string>, last_tool string, "
    "last_tool_output_summary string, decision_stack array<struct<decision:string,rationale:string>>, active_entities array<string>, turn_count int, "
    "enrichment struct<decision_summary:string,intent_label:string,topic_tags:array<string>>"
)
TRACE = (
    "turn_id string, session_id string, segment_id string, timestamp timestamp, intent string, mode string, query string, candidates int, "
    "selected int, budget int, top_chunks array<struct<event_id:string,score:double>>, fallback_triggered boolean"
)

EDGE_TYPES = ("tool_input", "tool_output", "decision", "follows")

# similarity, recency, dependency, type
MODE_WEIGHTS = {
    "general": (0.6, 0.2, 0.1, 0.1),
    "reasoning": (0.7, 0.15, 0.05, 0.1),
    "factual": (0.55, 0.3, 0.05, 0.1),
    "debugging": (0.35, 0.35, 0.2, 0.1),
    "clarification": (0.4, 0.35, 0.15, 0.1),
}
TYPE_WEIGHTS = {"decision": 1.0, "user_message": 0.8, "tool_output": 0.6, "assistant_message": 0.5}
TYPE_WEIGHT_DEFAULT = 0.5

RECENCY_LAMBDA = 0.01
DECAY, MAX_DEPTH = 0.6, 4
MIN_CANDIDATES = 12
STATE_RATIO, RETRIEVED_RATIO, TAIL_RATIO = 0.05, 0.30, 0.55
TAIL_FLOOR = 64
BUDGET_PERCENT, CONTEXT_LENGTH = 0.70, 128_000
STATE_CAP_TOKENS, MIN_PARTIAL_TOKENS, SAFETY_TOKENS, MESSAGE_TOKENS = 1000, 200, 256, 4
THIN_DEDUP, THIN_CLEAN = 0.2, 0.5
DRIFT_THRESHOLD = 0.35
DRIFT_WEIGHTS = (0.4, 0.3, 0.3)
COLD_START, CENTROID_WINDOW = 3, 200
SUMMARY_THRESHOLD, SUMMARY_TOKENS, CHARS_PER_TOKEN = 500, 100, 4
KEEPALIVE_SECONDS, GC_SECONDS = 120, 86_400
OVERHEAD_START = 16_000
GOAL_TRAIL, CHECKPOINT_CALLS = 3, 5
ENRICH_EVERY, ENRICH_TURNS = 5, 10

MEMORY_TOOLS = ("context_search", "fetch_event", "expand_context", "list_segments", "get_goal_history")

SWITCH_PHRASES = ("let's switch to", "forget that", "new topic", "instead of that", "давай переключимся", "забудь это", "новая тема")
SEGMENT_PHRASES = ("let's switch to", "forget that", "new topic", "instead of that", "давай переключимся", "забудь это")
QUESTION_WORDS = (
    "what", "why", "how", "when", "where", "who", "which", "whose", "whom", "is", "are", "was", "were", "do", "does", "did", "can", "could",
    "should", "would", "will",
    "что", "почему", "как", "когда", "где", "кто", "откуда", "зачем", "какой", "какая", "какое", "какие", "сколько", "куда", "чей", "чья",
)
STOPWORDS = (
    "the", "a", "an", "and", "or", "but", "if", "then", "this", "that", "these", "those", "it", "its", "we", "you", "your", "i", "my",
    "и", "или", "но", "это", "эта", "этот", "эти", "тот", "та", "те", "мы", "вы", "ваш", "я", "мой", "он", "она", "они",
)
NEGATIONS = ("not", "no", "never", "don't", "не", "нет")
DEBUG_WORDS = (
    "error", "fail", "failed", "traceback", "exception", "stacktrace", "debug", "broken", "crash", "bug",
    "ошибк", "не работает", "падает", "сломал", "не запускается", "краш",
)
DEBUG_TOOLS, DEBUG_DOUBTS = ("read", "bash", "grep", "glob"), ("?", "wrong", "не так")
REASONING_WORDS = (
    "почему", "зачем", "как лучше", "что если", "стоит ли", "какой подход", "why", "how should", "what if", "should i", "best way", "tradeoff",
)
FACTUAL_WORDS = (
    "what is", "when ", "where ", "who ", "list ", "show me", "что такое", "когда", "где находится", "перечисли", "покажи",
)
