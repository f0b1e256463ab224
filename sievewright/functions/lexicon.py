"""Word lists and parameters of the text functions.

Fixed values: results agree with the specification only with these.  All are
defaults of parameters; pass others for other data.
"""

STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "how", "in", "into", "is", "it", "of", "on", "or", "the", "this", "to", "with")

#: Domains in order, with the words that assign them.
DOMAIN_WORDS: dict[str, tuple[str, ...]] = {
    "code": ("api", "bug", "class", "code", "function", "lint", "package", "python", "refactor", "repository", "test"),
    "automotive": ("car", "coolant", "engine", "fan", "overheat", "overheating", "radiator", "thermostat", "vehicle"),
    "cybersecurity": ("auth", "breach", "firewall", "logs", "malware", "permissions", "port", "scan", "secrets", "security", "threat"),
    "media": ("audio", "clip", "codec", "color", "export", "frames", "media", "motioncam", "render", "video"),
    "documents": ("archive", "citation", "document", "documents", "index", "indexing", "manual", "notes", "rag", "retrieval", "search", "summary"),
    "general": ("analyze", "compare", "constraints", "explain", "plan", "reasoning", "task", "triage"),
}
#: Labels that one domain stands for; a domain without an entry stands for itself.
DOMAIN_LABELS: dict[str, tuple[str, ...]] = {"documents": ("documents", "document", "search", "retrieval")}
FALLBACK_DOMAIN = "general"

#: Sample types in order of precedence, with the substrings that show them.
SAMPLE_CUES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("code", ("python", "code", "function", "api", "test")),
    ("summarization", ("summarize", "summary")),
    ("classification", ("classify", "label", "category")),
    ("reasoning", ("why", "reason", "explain", "analyze")),
)
SAMPLE_TYPES = ("instruction", "conversation", "factual_qa", "reasoning", "writing", "classification", "summarization", "code", "unknown")
ANSWER_TYPES = ("instruction", "conversation", "factual_qa", "reasoning", "classification", "summarization", "code")

ROLE_ALIASES = {"human": "user", "user": "user", "gpt": "assistant", "assistant": "assistant", "bot": "assistant", "system": "system"}

SUSPICIOUS_MARKERS = (
    "ignore previous instructions", "system prompt", "developer message", "jailbreak", "prompt injection", "do not obey", "reveal secrets", "api key", "password",
)
BLOCK_PREFIXES = ("Instruction:", "Input:", "Output:", "assistant:", "user:")
REFUSAL_MARKERS = ("as an ai language model", "i cannot assist", "i'm sorry, but i can't")
GENERIC_CONTENT = ("good idea", "important note", "needs review", "check later", "unknown", "todo")

NEGATION_MARKERS = ("does not", "do not", "did not", "cannot", "can not", "should not", "must not", "not", "never", "no ")
#: Positive phrase and its opposite.
OPPOSITES = (
    ("supports", "does not support"), ("enabled", "disabled"), ("allowed", "blocked"), ("true", "false"), ("available", "unavailable"), ("safe", "unsafe"), ("works", "does not work"),
)

BLOCKED_LICENSES = ("unknown", "unknown-demo-license", "research-only", "research-only-demo", "non-commercial", "proprietary")
MANIFEST_USES = ("routing_eval", "knowledge_seed_candidate", "training_export_candidate", "benchmark_candidate")

#: Expert modules: name, domain words, capabilities, keywords, cost.
MODULES: tuple[tuple[str, str, tuple[str, ...], tuple[str, ...], int], ...] = (
    ("code-assistant", "code software programming", ("debugging", "refactoring", "static analysis"), ("python", "function", "bug", "repository", "test", "class", "api", "code"), 2),
    ("automotive-diagnostics", "automotive car engine vehicle", ("diagnostics", "maintenance", "inspection"), ("overheat", "overheating", "idle", "idling", "coolant", "radiator", "engine", "traffic", "car"), 2),
    ("cybersecurity-scanner", "cybersecurity security network", ("threat analysis", "vulnerability review", "incident triage"), ("malware", "phishing", "firewall", "port", "breach", "scan", "logs"), 3),
    ("media-video-tool", "media video photo audio", ("transcoding", "metadata extraction", "workflow automation"), ("clip", "video", "thumbnail", "frames", "audio", "render", "photo"), 2),
    ("document-search", "document search knowledge retrieval", ("search", "summarization", "evidence lookup"), ("pdf", "document", "manual", "notes", "find", "archive", "report"), 1),
    ("general-reasoning", "general reasoning planning", ("triage", "decomposition", "explanation"), ("analyze", "explain", "plan", "compare", "decide", "ambiguous", "help"), 1),
)
#: Domain label of each module in benchmark scoring.
MODULE_LABELS = {
    "code-assistant": "code", "automotive-diagnostics": "automotive", "cybersecurity-scanner": "cybersecurity",
    "media-video-tool": "media", "document-search": "document", "general-reasoning": "general",
}

#: Benchmark cases: id, task, expected domains, modules and keywords, workspace.
#: Instructions of training examples by what they are made from.
EXAMPLE_INSTRUCTIONS = {
    "knowledge_seed": "Explain the validated knowledge item for future expert behavior.",
    "feedback_record": "Use this feedback trace to improve future routing behavior.",
    "benchmark_result": "Route the benchmark task and preserve the expected trace rationale.",
}
