# Work markers, their comment styles, keyword lists and weights.

MARKERS = ["TODO", "FIXME", "HACK", "NOTE", "BUG", "DEPRECATED"]

# Comment styles; %s is the marker. One group each: the text after the marker.
COMMENT_STYLES = [
    r"//\s*%s\s*:?\s*(.+)",
    r"#\s*%s\s*:?\s*(.+)",
    r"/\*\s*%s\s*:?\s*(.+?)\s*\*/",
    r"<!--\s*%s\s*:?\s*(.+?)\s*-->",
]

CRITICAL_WORDS = ["critical", "urgent", "security", "vulnerability"]
HIGH_WORDS = ["important", "blocker", "broken", "crash"]
PRIORITY_BY_MARKER = {"BUG": "High", "FIXME": "High", "HACK": "Medium", "DEPRECATED": "Medium", "TODO": "Medium", "NOTE": "Low"}
# hundredths
URGENCY = {"Critical": 100, "High": 80, "Medium": 50, "Low": 20}

TOPICS = [
    ("Authentication", ["auth", "login", "security"]),
    ("API", ["api", "endpoint", "rest"]),
    ("Database", ["database", "db", "query"]),
    ("Testing", ["test", "spec"]),
    ("Frontend", ["ui", "frontend", "component"]),
    ("Performance", ["performance", "optimize", "cache"]),
]
DEFAULT_TOPIC = "General"

BIG_WORK = ["refactor", "rewrite", "implement"]
SMALL_WORK = ["fix", "update", "change", "add", "remove"]

PLACEHOLDERS = [
    "NotImplementedError",
    "todo!()",
    "unimplemented!()",
    'panic!("not implemented")',
    'throw new Error("not implemented")',
]
