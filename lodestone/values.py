"""Constants whose content decides results.

They are stated as plain text, in their natural order.
"""

# --- fixed values: allowed filter vocabulary ---------------------------------
PRIORITIES = ["Blocker", "Critical", "Major", "Minor", "Trivial"]
ISSUE_TYPES = [
    "Bug", "Improvement", "Sub-task", "New Feature", "Task", "Test",
    "Documentation", "Umbrella", "Question", "Wish", "Dependency upgrade",
    "Story", "Epic", "Brainstorming", "IT Help", "Request", "Planned Work",
    "Github Integration", "Technical task", "RTC", "New JIRA Project",
    "Blog - New Blog Request",
]
RESOLUTIONS = [
    "Fixed", "Incomplete", "Duplicate", "Won't Fix", "Not A Problem",
    "Invalid", "Cannot Reproduce", "Done", "Resolved", "Later",
    "Won't Do", "Not A Bug", "Auto Closed", "Implemented", "Abandoned",
    "Workaround", "Information Provided", "Works for Me", "Feedback Received",
]

# --- fixed values: content and context limits (characters) --------------------
MAX_CONTENT_CHARS = 8000
RERANK_DESC_CHARS = 500
OFFLINE_RERANK_DESC_CHARS = 1000
CONTEXT_DESC_CHARS = 1500
EXCERPT_BEFORE, EXCERPT_AFTER = 100, 150

# --- fixed values: ranking ----------------------------------------------------
RRF_K = 60
KEYWORD_WEIGHT = 0.25
WEIGHT_SWEEP = [1.0, 0.5, 0.25, 0.1, 0.0]
RERANK_DEPTH = 20
FUSION_DEPTH = 100
OFFLINE_DEPTHS = [20, 30, 50]
RESCUE_SLOTS = 1
RARE_SHARE = 0.02
SUMMARY_WEIGHT, DESCRIPTION_WEIGHT = 1.0, 0.4
TOP_K = 10
MRR_EPSILON = 1e-9
SCORE_EPSILON = 1e-6
EXTRA_KEYS_KEPT = 20

# --- fixed values: vectors ----------------------------------------------------
NATIVE_DIM = 2560
STORED_DIM = 1024
MAX_BATCH_TOKENS = 16384
QUERY_PREFIX = (
    "Instruct: Given a web search query, retrieve relevant passages that answer the query\n"
    "Query: "
)

# --- fixed values: request limits ---------------------------------------------
QUESTION_MIN_CHARS, QUESTION_MAX_CHARS = 3, 500
SEARCH_MAX_K, ASK_MAX_K, DEFAULT_K = 50, 20, 10

# --- fixed values: prompt text ------------------------------------------------
CONTEXT_FIELDS = ["issue_key", "summary", "status", "resolution",
                  "priority", "issue_type", "created"]
PROMPT_QUESTION = "Question: "
PROMPT_HEADING = "Jira issues:"
PROMPT_CLOSING = "Answer with citations."

STRATEGIES = ["summary_only", "summary_desc"]

# --- fixed values: English stop words (Snowball list, 127 words) ---------------
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves "
    "he him his himself she her hers herself it its itself they them their "
    "theirs themselves what which who whom this that these those am is are was "
    "were be been being have has had having do does did doing a an the and but "
    "if or because as until while of at by for with about against between into "
    "through during before after above below to from up down in out on off over "
    "under again further then once here there when where why how all any both "
    "each few more most other some such no nor not only own same so than too "
    "very s t can will just don should now"
).split()
