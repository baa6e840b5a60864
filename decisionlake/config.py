"""Values fixed by the data contract. Operators take them as parameters with these defaults."""

# --- fixed values: decision records ---------------------------------------------------------
NUMBER_WIDTH = 4
STATUSES = ["Proposed", "Accepted", "Superseded", "Deprecated", "Rejected"]
REQUIRED_FIELDS = ["Status", "Date", "Decider"]
RECORD_TYPES = {"adr": "ADR", "pdr": "PDR", "bdr": "BDR"}
LABELS = ["ADR", "BDR", "PDR"]
ALIAS_STOPLIST = ["api", "app", "web", "auth", "prod", "test", "db", "data", "core", "service"]

# frontmatter key -> column of the records table
FIELD_COLUMNS = {
    "Status": "status",
    "Date": "date",
    "Decided originally": "decided_originally",
    "Reviewed": "reviewed",
    "Decider": "decider",
    "Sources": "sources",
    "Related": "related",
    "Supersedes": "supersedes",
    "Aliases": "aliases",
    "Human gated paths": "gated_paths",
    "Human approval for": "approval_for",
    "Evidence for": "evidence_for",
    "Evidence artifacts": "evidence_artifacts",
}

# --- fixed values: run records --------------------------------------------------------------
RUN_FIELDS = [
    "Status", "Date", "Runner", "Trigger", "Scope", "Budget", "Outcome", "Stop reason",
    "Artifacts", "Checker result", "Harness improvement", "Sources",
]
RUN_STATUSES = ["Open", "Closed"]
RUN_TRIGGERS = ["manual", "ci", "goal", "loop", "other"]
RUN_OUTCOMES = ["pending", "success", "failure", "stopped"]
RUN_CHECKER_RESULTS = ["pass", "fail", "skip", "unknown"]

# --- fixed values: product signals ----------------------------------------------------------
SIGNAL_REQUIRED = [
    "id", "source", "product_area", "platform", "app_version", "device_os",
    "content_summary", "raw_refs", "customer_impact", "actionability", "privacy_class",
    "suggested_owner", "created_at",
]
SIGNAL_DISCRIMINATORS = [
    "id", "source", "content_summary", "raw_refs", "created_at", "customer_impact",
    "actionability", "privacy_class",
]
SIGNAL_ENUMS = {
    "source": ["crash", "anr", "analytics", "session_replay", "support", "app_review", "ci",
               "device_farm", "experiment", "security", "privacy"],
    "product_area": ["onboarding", "monetization", "gameplay", "notifications", "social",
                     "account", "unknown"],
    "platform": ["ios", "android", "both", "backend"],
    "customer_impact": ["none", "low", "medium", "high", "critical"],
    "actionability": ["unknown", "needs_more_data", "needs_human_product_judgment",
                      "immediately_actionable"],
    "privacy_class": ["public", "internal", "pii", "sensitive"],
}

# --- fixed values: store sweep --------------------------------------------------------------
KNOWN_STORE_DIRS = [
    ".claude", ".codex", ".factory", ".droid", ".hermes", ".cursor",
    ".gemini", ".qwen", ".continue", ".aider", ".aider-desk", ".codeium",
    ".cline", ".roo", ".kilocode", ".augment", "goose", "crush", "opencode",
]
NON_AGENT_DIRS = [
    ".amplify", ".cursor-tutor", ".claude-squad", ".claude----", ".warp",
    "com.apple.AMPLibraryAgent", "Claude.new_backup", "Claude-3p",
    "dev.warp.Warp-Stable", "dev.warp.Warp-Stable.new_backup",
]
STORE_HINTS = [
    "aider", "gemini", "cline", "claude", "codex", "factory", "hermes", "cursor",
    "opencode", "continue", "windsurf", "goose", "crush", "amp-", "amp_",
    "roo", "kilo", "augment", "qoder", "qwen", "codeium",
]

# --- fixed values: gates and evaluation -----------------------------------------------------
UI_SUFFIXES = [
    ".html", ".css", ".scss", ".sass", ".less", ".js", ".jsx", ".ts", ".tsx",
    ".vue", ".svelte", ".swift", ".kt", ".java", ".xml", ".storyboard", ".xib",
]
OUTPUT_WEIGHT = 5          # weight of an output token in the cost index
EFFICACY_GATE = 80.0       # pass rate below which cost per pass is withheld
TIER_RANK = {"opus": 3, "sonnet": 2, "haiku": 1}
BM25_K1 = 1.5
BM25_B = 0.75
