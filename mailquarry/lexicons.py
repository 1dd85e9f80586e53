"""Word lists and constants that results depend on (fixed values).

Lists that share a subject but differ are kept apart on purpose: the operators
that use them give different results.  Every operator takes its lists as
parameters; these are the defaults.
"""

# fmt: off
TRUSTED_SUFFIXES = ("python.org", "pypi.org", "github.com", "gitlab.com", "microsoft.com", "microsoftonline.com", "google.com", "accounts.google.com", "youtube.com", "wikipedia.org", "mozilla.org", "developer.mozilla.org", "linkedin.com", "amazon.com", "amazon.in", "yahoo.com", "paypal.com", "account.live.com", "apple.com", "icloud.com")
CONFUSABLES = {"а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ӏ": "l", "ο": "o", "ρ": "p", "ν": "v", "χ": "x"}

BENIGN_REGISTRABLES = ("google.com", "accounts.google.com", "meet.google.com", "maps.google.com", "github.com", "amazon.in", "hdfcbank.com", "notion.so", "dropbox.com")
TRUSTED_SUBDOMAINS = ("accounts.google.com", "meet.google.com", "maps.google.com", "docs.google.com", "mail.google.com", "support.github.com", "www.hdfcbank.com", "www.amazon.in", "www.dropbox.com", "www.notion.so")
SENDER_BRANDS = {"google": "google.com", "github": "github.com", "amazon": "amazon.in", "hdfc": "hdfcbank.com", "notion": "notion.so", "dropbox": "dropbox.com", "paypal": "paypal.com", "microsoft": "microsoft.com", "outlook": "outlook.com", "docusign": "docusign.com", "bank": "hdfcbank.com"}

JOINT_SHORTENERS = ("bit.ly", "tinyurl.com", "t.co", "goo.gl", "ow.ly", "is.gd", "cutt.ly", "buff.ly", "rb.gy")
BASIC_SHORTENERS = ("bit.ly", "t.co", "tinyurl.com", "goo.gl", "is.gd", "cutt.ly")
CORPUS_SHORTENERS = ("bit.ly", "tinyurl", "goo.gl", "t.co", "ow.ly")

JOINT_TLDS = ("zip", "xyz", "top", "click", "work", "shop", "live", "gq", "tk", "ml", "cf")
MODEL_TLDS = ("cam", "cfd", "click", "cyou", "icu", "info", "live", "mov", "pro", "quest", "rest", "sbs", "top", "work", "xyz", "zip")
CORPUS_TLDS = (".top", ".xyz", ".click", ".gq", ".work", ".support", ".info", ".country", ".stream", ".download", ".review", ".racing", ".party")

BASIC_KEYWORDS = ("login", "verify", "secure", "update", "account", "password", "signin", "confirm", "bank", "wallet", "otp", "reset")
MODEL_KEYWORDS = ("login", "verify", "secure", "update", "account", "signin", "sign-in", "password", "pay", "billing", "confirm", "wallet", "bank", "invoice", "support", "alert", "webscr", "icloud", "office", "microsoft")
JOINT_KEYWORDS = ("login", "verify", "update", "auth", "reset", "secure", "account", "password", "otp")
LURE_KEYWORDS = ("login", "verify", "secure", "update", "account", "password", "signin", "confirm", "bank", "wallet", "otp", "reset", "gift", "card", "free", "now", "urgent", "support")
PATH_RISKS = ("login", "signin", "verify", "verification", "auth", "reset", "password", "account", "session", "security", "confirm")
DOCS_PATHS = ("/docs", "/documentation", "/reference", "/library", "/api", "/en-us/", "/manual", "/guide", "/tutorial", "/learn", "/3/")
SENSITIVE_PATHS = ("/login", "/signin", "/auth", "/verify", "/account", "/security", "/reset", "/password", "/otp", "/admin")

URGENCY = ("urgent", "immediately", "within 24 hours", "today", "expire", "final warning", "action required")
CREDENTIAL = ("verify your account", "verify identity", "sign in", "login", "password", "otp", "authentication")
FINANCE = ("payment", "invoice", "bank", "salary", "payroll", "wire transfer", "gift card")
RESTRICTION = ("restricted access", "suspended", "termination", "locked", "disable")
BENIGN = ("no action required", "for awareness only", "monthly statement", "order has been shipped", "track your shipment", "available in portal")
INTERNAL = ("thanks", "regards", "please review", "for your reference")
HIGH_INTENT = ("permanent suspension", "permanently disabled", "within 24 hours", "final warning", "validate now", "avoid suspension", "account termination")

STATEMENT_HINTS = ("monthly statement", "account statement", "statement is ready", "official banking portal")
TRANSACTION_HINTS = ("order has been shipped", "track your shipment", "delivery update", "your monthly statement", "account statement is now available", "view your order", "order details", "invoice is ready")
URGENCY_HINTS = ("urgent", "immediately", "within 24 hours", "suspended", "suspension", "verify now", "action required", "click now")
CREDENTIAL_HINTS = ("verify your account", "verify identity", "account verification", "sign in", "login", "password", "reset password", "otp", "authentication")
STEALTH_HINTS = ("gift card", "wire transfer", "bank account change", "change payment details", "update payment details", "employee login", "review the attached", "open attachment", "docusign", "shared document", "confirm acknowledgement", "payroll", "crypto wallet", "seed phrase")

BENIGN_REASONS = "match|aligned|benign|safe|trusted"
SUSPICIOUS_REASONS = "mismatch|phish|suspicious|fake|redirect|ip|lure|hard cue|typosquat"

MODEL_FEATURES = ("url_len", "host_len", "path_len", "query_len", "host_ratio", "path_ratio", "query_ratio", "num_dots", "num_subdomains", "num_hyphens", "num_underscores", "num_digits", "num_at", "num_pct", "num_eq", "num_amp", "num_qmark", "num_slash", "num_colon", "qparams", "has_https", "has_http_in_path", "has_double_slash_in_path", "has_ip_host", "tld_suspicious", "entropy_host", "entropy_path", "entropy_url", "keyword_count")
MODE_THRESHOLDS = {"soc": 0.4, "balanced": 0.5, "high_confidence": 0.6}
REPEAT_SEEDS = (17, 23, 31, 47, 59, 73, 89, 97)
# fmt: on
