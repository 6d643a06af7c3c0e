"""Word lists, patterns, labels and formats.

Results depend on these exact values, so they are kept together here as plain
text and in their natural order. Nothing in this module computes anything.
"""

# ---------------------------------------------------------------- fixed values: text classes

# Whitespace as Unicode text handling sees it (control separators included).
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
# The same set as a regex class body that Java and RE2 both accept.
WHITESPACE_CLASS = (
    r"\t\n\x0b\f\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
# Line breaks beyond \r and \n that a text splitter honours.
EXTRA_LINE_BREAKS = r"[\x0b\f\x1c-\x1e\x{85}\x{2028}\x{2029}]"
# Letters, digits and underscore of any script.
WORD_CLASS = r"\p{L}\p{N}_"
ASCII_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
# Cell texts that a CSV reader takes for missing values.
MISSING_CELLS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# ---------------------------------------------------------------- fixed values: files and limits

ALLOWED_EXTENSIONS = ["log", "txt", "csv"]
MAX_FILE_BYTES = 100 * 1024 * 1024
PREVIEW_LINES = 5
PREVIEW_CHARS = 100
SCORE_THRESHOLD = 0.6
HIGH_SCORE = 0.8
TOP_RESULTS = 20
HISTOGRAM_BINS = 50
FORMAT_SAMPLE_LINES = 10
APP_NAME = "security_monitoring"

# ---------------------------------------------------------------- fixed values: normalising

TIMESTAMP_REMOVALS = [
    r"\d{4}-\d{2}-\d{2}[T\s]\d{2}:\d{2}:\d{2}Z?",
    r"\d{2}/\d{2}/\d{4}\s\d{2}:\d{2}:\d{2}",
    r"\d{1,2}/\d{1,2}/\d{2,4}",
    r"\d{2}:\d{2}:\d{2}",
]
ADDRESS_REMOVALS = [
    r"\b\d{1,3}(?:\.\d{1,3}){3}\b",
    r":\d{1,5}\b",
    r"\b\d+\b",
]
BRACKETS_AND_QUOTES = r'[{}\[\]":,]'
CAPITAL_AFTER_LETTER = r"(?<=[a-zA-Z])(?=[A-Z])"

# ---------------------------------------------------------------- fixed values: prototype scoring options

SCORING_OPTIONS = {
    "class_names": ["Non-login event", "Failed login", "Successful login"],
    "thresholds": {
        "login_detection": 0.15,
        "classification": 0.3,
        "high_confidence": 0.6,
        "medium_confidence": 0.4,
        "model_confidence": 0.8,
    },
    "prototype_categories": ["successful_login", "failed_login", "non_login"],
    "prototype_templates": {
        "successful_login": ["authenticated", "accepted", "successful", "verified", "granted", "established"],
        "failed_login": ["failed", "denied", "invalid", "incorrect", "error", "failure"],
        "non_login": ["started", "running", "established", "completed", "normal", "transfer"],
    },
    "login_terms": ["user", "login", "authentication", "password", "access", "session"],
    "system_terms": ["service", "process", "connection", "operation", "system", "file"],
    "phrases_per_category": 7,
    "normalization_patterns": [
        (r"\d+", ""),
        (BRACKETS_AND_QUOTES, " "),
        (CAPITAL_AFTER_LETTER, " "),
    ],
    "term_normalizations": {
        r"\bssh\w*": "ssh",
        r"\blogin\w*": "login",
        r"\bauth\w*": "authentication",
        r"\bfail\w*": "failed",
        r"\bsuccess\w*": "successful",
    },
    "category_labels": {
        "successful_login": "Successful login",
        "failed_login": "Failed login",
        "non_login": "Non-login event",
    },
}

# ---------------------------------------------------------------- fixed values: field patterns

LINE_FIELDS = {
    "timestamp": r"\d{4}-\d{2}-\d{2}[T\s]\d{2}:\d{2}:\d{2}",
    "ip": r"\b\d{1,3}(?:\.\d{1,3}){3}\b",
    "user": r"user\s*[=:]\s*[\w\-]+",
    "status": r"status\s*[=:]\s*\d{3}",
    "method": r"(GET|POST|PUT|DELETE|HEAD)",
}
SEARCH_FIELDS = {
    "user": r"user[\s]*[:=][\s]*(\w+)",
    "src_ip": r"(\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b)",
    "action": r"(failed|success|login|logout|authentication)",
}
TRANSFORM_FIELDS = {
    "severity": r"(ERROR|WARN|INFO|DEBUG)",
    "session_id": r"session[_\-]?id[=:]\s*([A-Za-z0-9\-_]+)",
    "normalized_user": r"user[_\-]?(?:name|id)?[=:]\s*([A-Za-z0-9\-_@.]+)",
}
LOG_LEVELS = [("ERROR", "ERROR"), ("WARN", "WARNING"), ("INFO", "INFO")]
DEFAULT_LOG_LEVEL = "DEBUG"
EVENT_CATEGORIES = [
    (r"(?i)failed.*login", "authentication_failure"),
    (r"(?i)success.*login", "authentication_success"),
]
DEFAULT_EVENT_CATEGORY = "unknown"
CLOCK_HOUR = r"(\d{2}):\d{2}:\d{2}"

# (kind, pattern, capture group)
ENTITY_PATTERNS = [
    ("IP", r"\b(?:\d{1,3}\.){3}\d{1,3}\b", 0),
    ("User", r"(?i)\b(?:user|username|login|account)[:\s=]+([a-zA-Z0-9_\-\.]+)\b", 1),
    ("Host", r"\b[a-zA-Z0-9]([a-zA-Z0-9\-]{0,61}[a-zA-Z0-9])?(\.[a-zA-Z0-9]([a-zA-Z0-9\-]{0,61}[a-zA-Z0-9])?)*\b", 0),
    ("Email", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", 0),
    ("File", r"[/\\](?:[^/\\:\*\?\"<>\|]+[/\\])*[^/\\:\*\?\"<>\|]*", 0),
    ("Timestamp", r"\d{4}-\d{2}-\d{2}[\sT]\d{2}:\d{2}:\d{2}", 0),
]

# ---------------------------------------------------------------- fixed values: labels by rule

SSH_RULES = [(r"(?i)Failed password for", "Failed_login"), (r"(?i)Accepted password for", "Success_login")]
LINUX_RULES = [
    (r"(?i)authentication failure;", "Failed_login"),
    (r"(?i)accepted password for | session opened for", "Success_login"),
]
RULE_DEFAULT = "Other"

ASSET_TYPES = [
    ("SSH", ["sshd[", "ssh2", "openssh"]),
    ("Linux", ["systemd", "pam_unix", "su[", "sudo:"]),
    ("Windows", ["logon type:", "security id:", "windows"]),
    ("Database", ["postgres[", "mysql[", "oracle", "mongodb"]),
    ("WebServer", ["apache2[", "nginx[", "iis"]),
    ("FTP", ["ftpd[", "vsftpd[", "proftpd["]),
    ("VPN", ["openvpn[", "vpn-server["]),
    ("Container", ["docker[", "containerd[", "kube-apiserver["]),
    ("Cron", ["cron[", "crond["]),
    ("System", ["kernel:"]),
    ("Email", ["postfix", "dovecot", "sendmail"]),
    ("LDAP", ["ldap[", "winbind["]),
    ("Application", ["auth:", "authentication", "login", "logon"]),
]
DEFAULT_ASSET_TYPE = "Other"

LOG_FORMATS = [
    ("apache", ["apache", "httpd"]),
    ("nginx", ["nginx"]),
    ("ssh", ["ssh", "sshd"]),
    ("authentication", ["login", "auth"]),
    ("system", ["kernel"]),
]
DEFAULT_LOG_FORMAT = "generic"
EMPTY_LOG_FORMAT = "unknown"
FORMAT_TIMESTAMPS = [r"\d{4}-\d{2}-\d{2}", r"\d{2}/\d{2}/\d{4}", r"\d{2}:\d{2}:\d{2}", r"\w{3}\s+\d{1,2}"]
FORMAT_ADDRESS = r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b"

# (name, pattern, confidence, fields)
SECURITY_PATTERNS = [
    ("Failed Login", r"(failed|invalid|unsuccessful).*(login|authentication|sign)", 0.8, ["user", "src_ip", "timestamp"]),
    ("Successful Login", r"(success|successful|accepted).*(login|authentication|sign)", 0.7, ["user", "src_ip", "timestamp"]),
    ("User Activity", r"user\s*[:=]\s*\w+", 0.6, ["user", "action"]),
]

ATTACK_PATTERNS = {
    "Failed Logins": [r"failed\s+login", r"authentication\s+failed", r"invalid\s+user", r"login\s+failed"],
    "Brute Force": [r"multiple\s+failed\s+attempts", r"repeated\s+login\s+failures", r"brute\s+force"],
    "SQL Injection": [r"union\s+select", r"or\s+1\s*=\s*1", r"drop\s+table", r"insert\s+into"],
    "XSS": [r"<script>", r"javascript:", r"onerror\s*=", r"onload\s*="],
    "Port Scanning": [r"port\s+scan", r"connection\s+attempt", r"probe\s+detected"],
}
ATTACK_THRESHOLD = 0.7
ATTACK_BINS = 5

EVENT_PATTERNS = {
    "authentication_success": [
        "Accepted password for",
        "User login succeeded for",
        "VPN Login: User=",
        "result=success",
        '"ConsoleLogin": "Success"',
        '"Status": {"value": "0"',
        "outcome=SUCCESS",
        '"outcome": {"result": "SUCCESS"',
        '"Successful"',
        '"ResultStatus": "Succeeded"',
        "LOG:  connection authorized:",
        "Connect ",
        'POST /login HTTP/1.1" 302',
        "USER_LOGON.*SUCCESS",
        "establish.*0",
        "status=success",
        "Successful login",
    ],
    "authentication_failure": [
        "Failed password for",
        "User login FAILED for",
        "AAA user authentication Rejected",
        "result=failure",
        '"ConsoleLogin": "Failure"',
        '"errorMessage": "Failed authentication"',
        '"Status": {"value": "50074"',
        "outcome=FAILURE",
        '"outcome": {"result": "FAILURE"',
        '"Failed"',
        '"ResultStatus": "Failed"',
        "FATAL:  password authentication failed",
        "Access denied for user",
        'POST /login HTTP/1.1" 401',
        "USER_LOGON.*FAILURE",
        "establish.*rejected",
        "status=failure",
        "Unsuccessful login",
        "EventID>4625</EventID>",
        "Failed authentication",
        "password was incorrect",
    ],
}

# ---------------------------------------------------------------- fixed values: token tags

# (tag, pattern); a capture group marks the tagged part, longest words first.
TAG_PATTERNS = [
    ("TIMESTAMP", r"\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}"),
    ("IP_ADDRESS", r"\b(?:\d{1,3}\.){3}\d{1,3}\b"),
    ("USERNAME", r"(?:user\s+|for\s+)([a-zA-Z0-9._-]+)(?:\s+from|\s+on|\s*$)"),
    ("PORT", r"port\s+(\d+)"),
    ("DURATION", r"\(duration:\s+([0-9.]+s)\)"),
    ("STATUS", r"(successfully|successful|succeeded|failed|failure|denied|granted)"),
]
PADDING_WORD = "<PAD>"
UNKNOWN_WORD = "<UNK>"

# ---------------------------------------------------------------- fixed values: corrections and training

CORRECTION_CLASS_IDS = {"successful_login": 1, "failed_login": 2, "other_login": 0, "not_login": 0}
CORRECTION_SOURCE = "user_correction"
#: Our own name for rows that fill a set up.
FILLER_SOURCE = "labelled_line"
CORRECTION_BOOST = 3
CLASS_NAMES_BY_ID = {1: "successful_logins", 2: "failed_logins", 0: "non_login_events"}

# Times in log lines: (regex, Spark time format). The syslog form has no year.
LOG_TIMES = [
    (r"\b[A-Z][a-z]{2} +\d{1,2} \d{2}:\d{2}:\d{2}", "MMM d HH:mm:ss"),
    (r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{1,6}Z", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"),
    (r"\d{4}/\d{2}/\d{2} \d{2}:\d{2}:\d{2}", "yyyy/MM/dd HH:mm:ss"),
    (r"\d{2}/[A-Z][a-z]{2}/\d{4}:\d{2}:\d{2}:\d{2}", "dd/MMM/yyyy:HH:mm:ss"),
    (r"\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}", "yyyy-MM-dd HH:mm:ss"),
    (r"\d{2}/\d{2}/\d{4} \d{2}:\d{2}:\d{2}", "MM/dd/yyyy HH:mm:ss"),
]
