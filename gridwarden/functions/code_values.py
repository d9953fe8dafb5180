"""Fixed values about source code: patterns of definitions, guards, sinks and rules. Order is part of their meaning."""

from __future__ import annotations

from .values import DELTA_AUTH, DELTA_ROUTES

__all__ = ["DELTA_AUTH", "DELTA_ROUTES"]

# -- lines -------------------------------------------------------------------------------------------------------------

FILE_MARKERS = [r"^(?://|#|--)?\s*(?:file|path|filename)\s*:\s*(.+)\z", r"^[-=]{3,}\s*(.+?\.(?:js|jsx|ts|tsx|py|php|java|go|rb|cs))\s*[-=]{3,}\z"]
#: pattern of a definition, and how many groups it has: name and parameters
DEFINITIONS = [
    (r"(?:export\s+)?(?:async\s+)?function\s+(\w+)\s*\(([^)]*)\)", 2),
    (r"(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?\(?([^)=]*)\)?\s*=>", 2),
    (r"def\s+(\w+)\s*\(([^)]*)\)\s*:", 2),
    (r"^\s*class\s+(\w+)", 1),
]
FUNCTION_JS = r"(?:function\s+(\w+)\s*\(([^)]*)\)|(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?\(?([^)=]*)\)?\s*=>)"
FUNCTION_PY = r"def\s+(\w+)\s*\(([^)]*)\)\s*:"
CALL = r"(\w+)\s*\(([^)]*)\)"
BRANCH = r"\bif\b|\belse\b|\bfor\b|\bwhile\b|\btry\b|\bexcept\b|\bcatch\b"
SINK_LINE = (
    r"(?:db|pool|client)\.(?:query|execute|run)\s*\(|cursor\.execute\s*\(|\.innerHTML|dangerouslySetInnerHTML|document\.write|insertAdjacentHTML|(?:exec|execSync|spawn|spawnSync|os\.system|os\.popen|subprocess\.\w+)\s*\("
    r"|(?:readFile|createReadStream|open\s*\(|send_file|FileResponse|Path\.open)|redirect\s*\(|res\.redirect|fetch\s*\(|axios|pickle\.loads?|yaml\.load|eval\s*\(|exec\s*\(|Template\s*\("
)
ASSIGN = r"(?:const|let|var)\s+(\w+)\s*=\s*(.+?);?\s*\z|^\s*(\w+)\s*=\s*(.+?);?\s*\z"
DESTRUCTURE = r"(?:const|let|var)\s*\{([^}]+)\}\s*=\s*(.+?);?\s*\z"
FOR_IN = r"for\s+(\w+)\s+in\s+(.+):"
CONSTANT = r"(?:const|let|var)\s+(\w+)\s*=\s*([^;]+)|^\s*(\w+)\s*=\s*([^#\n]+)"
LITERAL = r"^(?:['\"`][\s\S]*['\"`]|\d+(?:\.\d+)?|true|false|null|undefined|None|\[\s*\]|\{\s*\})\z"
IF_PAREN, IF_COLON = r"if\s*\(([^)]+)\)", r"if\s+(.+):"
COMPARE = r"^(\w+)\s*([!=]==?)\s*(['\"`]?[^'\"`]+['\"`]?)\z"
STOP = r"\b(return|throw)\b|^\s*raise\s+"
GUARD = r"if\s*\(([^)]*(?:validate|isValid|allow|schema|typeof|instanceof|includes)[^)]*)\)\s*(?:return|throw|next|res\.status)|if\s+(.+?(?: in |isinstance|validate|allowed|cleaned_data).+):"
IMPORT_PY = r"^\s*(?:from\s+([\w.]+)\s+import\s+(.+)|import\s+([\w.]+))"
IMPORT_JS = r"^\s*import\s+(?:\{([^}]+)\}|(\w+)|\*\s+as\s+(\w+)).*from\s+['\"]([^'\"]+)['\"]"
REQUIRE = r"(?:const|let|var)\s+(?:\{([^}]+)\}|(\w+))\s*=\s*require\s*\(['\"]([^'\"]+)['\"]\)"
EXPORT = r"^\s*export\s+(?:async\s+)?(?:function|class|const|let|var)\s+(\w+)"
CLASS, MODEL = r"^\s*class\s+(\w+)", r"models\.Model|db\.Model|BaseModel"
AUTH_SYMBOL = r"@(?:login_required|permission_required|jwt_required)|Depends\s*\([^)]*(?:auth|current_user)|require_auth|adminOnly|requireRole"
ROUTE_PY = r"@(?:app|router|bp)\.(route|get|post|put|patch|delete)\s*\(\s*['\"]([^'\"]+)['\"]"
ROUTE_GUARD = r"@(?:login_required|permission_required|jwt_required|require_auth)|Depends\s*\([^)]*(?:auth|token|current_user|require_user)|current_user\.is_authenticated|request\.user\.is_authenticated|require_auth|has_permission|is_authenticated|requireRole|adminOnly"
SENSITIVE_PATH = r"(?:admin|delete|update|upload|config|debug|export|users?|billing|token|secret|settings|internal)"
SANITIZER_KINDS = [
    ("html", [r"encodeHTML|escapeHtml|DOMPurify\.sanitize|validator\.escape|he\.encode|xss\(|sanitizeHtml", r"markupsafe\.escape|html\.escape|bleach\.clean|escape\s*\("]),
    ("url", [r"encodeURIComponent|new URL\s*\(|URL\.parse", r"urllib\.parse\.quote|url_has_allowed_host_and_scheme|is_safe_url"]),
    ("sql", [(r"(?:escape|sanitize)Sql|mysql\.escape|psycopg2\.sql\.Identifier|bindparam|text\s*\([^)]*\)\.bindparams", "i"), (r"(?:db|pool|client)\.(?:query|execute|run)\s*\([^)]*,\s*(?:\[|\{)|cursor\.execute\s*\([^,\n]+,\s*(?:\(|\[|\{)|\.filter\s*\(|\.where\s*\([^)]*(?:=|==)\s*\w+\s*\)|Prisma\.sql", "i")]),
    ("cmd", [r"spawn\s*\([^)]*,\s*\[[^\]]*\]\s*,?\s*(?:\{[^}]*shell\s*:\s*false[^}]*\})?\s*\)", r"subprocess\.\w+\s*\(\s*\[[^\]]+\][^)]*shell\s*=\s*False", r"subprocess\.\w+\s*\(\s*\[[^\]]+\][^)s]*\)"]),
    ("path", [(r"path\.resolve\s*\([^)]*\)\s*[\s\S]{0,100}startsWith\s*\(|allowlist|ALLOWED_FILES", "i"), r"secure_filename|(?:Path|pathlib\.Path)\([^)]*\)\.resolve\s*\(|os\.path\.normpath|safe_join|send_from_directory"]),
    ("header", [(r"\.replace\s*\([\s\S]*?\\r\\n|sanitize.*header", "i")]),
    ("schema", [(r"\b(?:z|zod|Joi|yup|schema|validator)\b[\s\S]{0,80}\b(?:parse|safeParse|validate|is[A-Z]\w*)\s*\(|pydantic|BaseModel|Serializer\s*\(|forms\.Form|cleaned_data|full_clean\s*\(", "i")]),
    ("type", [r"parseInt|Number\s*\(|int\s*\(|float\s*\(|bool\s*\("]),
    ("allowlist", [(r"allowlist|whitelist|ALLOWED_|\.includes\s*\(|in\s+ALLOWED", "i")]),
]
AUTH_BOUNDARIES = [
    (r"\b(?:requireAuth|isAuthenticated|authMiddleware|authenticate|verifyToken|ensureLoggedIn)\s*[,(]", "login"),
    (r"\b(?:isAdmin|requireAdmin|adminOnly|requireRole\s*\(\s*['\"`]admin)", "admin"),
    (r"\bjwt\.verify\s*\(", "login"),
    (r"\bpassport\.authenticate\s*\(", "login"),
    (r"\bif\s*\(\s*!?\s*req\.(user|session\.user|isAuthenticated\(\))", "login"),
]
REACH_DEAD = [(r"if\s*\(\s*false\s*\)", "i"), r"if\s*\(0\s*\)", (r"//\s*TODO.*(?:remove|dead|unused)", "i"), (r"/\*\s*DEAD\s*\*/", "i")]
REACH_DEV = [r"process\.env\.NODE_ENV\s*===?\s*['\"`]development['\"`]", r"process\.env\.NODE_ENV\s*!==?\s*['\"`]production['\"`]", r"isDev\s*(?:&&|\?|===?\s*true)", r"debug\s*(?:&&|\?|===?\s*true)", r"localhost|127\.0\.0\.1"]
REACH_INTERNAL = [r"/internal/", r"/admin/", r"/private/", r"x-internal-token", r"SERVICE_SECRET|INTERNAL_API_KEY"]
#: ends of a line in which one of the REACH patterns may begin that goes on in the next lines: what stands before each of their \s*
REACH_HEADS = [(r"if\s*(?:\(\s*(?:(?:false|0)\s*)?)?\z", "i"), r"//\s*\z", (r"/\*\s*(?:DEAD\s*)?\z", "i"), (r"process\.env\.NODE_ENV\s*(?:[=!]==?\s*)?\z", "i"), (r"(?:isDev|debug)\s*(?:===?\s*)?\z", "i")]
#: pattern, flags, weight, label
CRITICAL = [
    (r"eval\s*\(|new Function\s*\(|vm\.run", "", 10, "eval/code-exec"),
    (r"db\.\w+\s*\(|pool\.\w+\s*\(|\.query\s*\(", "", 8, "db-sink"),
    (r"exec\s*\(|spawn\s*\(|execSync|child_process", "", 10, "cmd-injection-sink"),
    (r"innerHTML\s*=|dangerouslySetInnerHTML|document\.write", "", 8, "xss-sink"),
    (r"readFile\s*\(|createReadStream\s*\(|writeFile\s*\(", "", 7, "fs-sink"),
    (r"fetch\s*\(|axios\.|got\s*\(|http\.(?:get|post)", "", 6, "http-client"),
    (r"res\.redirect\s*\(|location\s*=|window\.location", "", 6, "redirect-sink"),
    (r"req\.(body|query|params|headers)|request\.(body|query)", "", 8, "taint-source"),
    (r"process\.env\.|getenv\s*\(|os\.environ", "", 5, "env-access"),
    (r"jwt\.|verify\w*[Tt]oken|isAuthenticated|checkAuth", "", 7, "auth-guard"),
    (r"bcrypt|argon2|hashPassword|compareSync", "", 6, "crypto-auth"),
    (r"session\.|cookie\.|passport\.", "", 6, "session"),
    (r"crypto\.\w+|createCipher|createHash", "", 5, "crypto"),
    (r"Math\.random\s*\(\)|Date\.now\s*\(\).*(?:token|key|secret)", "i", 7, "weak-random"),
    (r"JSON\.parse\s*\(|deserializ|pickle\.loads", "", 5, "deserialize"),
    (r"unserialize\s*\(|YAML\.load\s*\(|Marshal\.load", "", 9, "unsafe-deserialize"),
    (r"Object\.assign\s*\(\s*\{|merge\s*\(|deepMerge\s*\(", "", 5, "merge-sink"),
    (r"__proto__|prototype\s*\[", "", 8, "proto-pollution"),
]
BOILERPLATE = [r"^(?:export\s+)?(?:type|interface)\s+\w+(?:\s+extends\s+\w+)?\s*\{[^{}]*\}\s*\z", r"^\s*//", r"^\s*\*[\s*]", r"^\s*/\*", r"^\s*\*/", r"^\s*console\.(log|debug|info)\s*\(", r"^\s*(?:import\s+type\s+|export\s+type\s+)"]
SURFACE_SINKS = [
    ("sql", r"db\.(query|execute|run)\s*\("), ("eval", r"\beval\s*\(|new Function\s*\("), ("xss", r"\.innerHTML\s*=|dangerouslySetInnerHTML"), ("ssrf", r"fetch\s*\(\s*\w|axios\.(get|post)\s*\(\s*\w"),
    ("cmd", r"exec\s*\(|spawn\s*\(|execSync\s*\("), ("path", r"readFile\s*\(|readFileSync\s*\(|createReadStream"), ("redirect", r"res\.redirect\s*\(|location\.href\s*="), ("proto", r"\[req\.|Object\.assign\s*\(\s*\w+\s*,\s*req"),
]
SURFACE_SOURCES = [
    ("req.body", r"(?:const|let|var)\s+(?:\{([^}]+)\}|(\w+))\s*=\s*req\.body"), ("req.query", r"(?:const|let|var)\s+(?:\{([^}]+)\}|(\w+))\s*=\s*req\.query"), ("req.params", r"(?:const|let|var)\s+(?:\{([^}]+)\}|(\w+))\s*=\s*req\.params"),
    ("searchParams", r"(?:const|let|var)\s+(\w+)\s*=\s*(?:req\.|request\.).*searchParams\.get"), ("formData", r"(?:const|let|var)\s+(\w+)\s*=\s*formData\.get\s*\("),
]

# -- systems -----------------------------------------------------------------------------------------------------------

MIDDLEWARE = r"(?:app|router)\.(use|get|post|put|delete|patch)\s*\(\s*(?:'[^']*',\s*)?(\w+)"
MIDDLEWARE_AUTH = r"auth|jwt|verify|token|session|require[Aa]uth|isLoggedIn|protect|authenticate"
MIDDLEWARE_VALID = r"valid|sanitize|schema|joi|zod|yup|check"
AUTH_CHECK = r"if\s*\(\s*!?\s*(?:req\.)?(user|session|token|isAuth|isAdmin|role)|(?:authenticate|authorize|verify[Tt]oken|checkAuth|requireLogin)\s*\("
AUTH_BYPASS = r"skip[Aa]uth|bypass|noAuth|isPublic|skipMiddleware|whitelist"
QUERY_RAW = r"\.query\s*\(`[^`]*\$\{|\.raw\s*\(|sequelize\.query\s*\([^,)]*\$\{|knex\.raw"
QUERY_SAFE = r"\.query\s*\([^)]*,\s*\[|\$\d+|\?[^?]|\.findOne\s*\(|\.findAll\s*\(|prisma\."
EMIT = r"(?:emit|publish|send|enqueue|dispatch)\s*\(\s*['\"](\w+)['\"]"
LISTEN = r"(?:on|subscribe|consume|listen)\s*\(\s*['\"](\w+)['\"]"
WRAPPED = r"exec\s*\(|execSync\s*\(|eval\s*\(|readFile|createReadStream|db\.query"
SERVICE = r"fetch\s*\(['\"`]https?://|axios\.(get|post|put|delete)\s*\(|http\.request\s*\("
SERVICE_AUTH = r"Authorization|Bearer|apiKey|x-api-key|credentials"
GRAPH = {
    "source": [(r"req\.(body|query|params)\b", "HTTP input"), (r"process\.env\b", "env var"), (r"fs\.readFile|readFileSync", "file read"), (r"JSON\.parse\s*\(", "deserialized input"), (r"message\.body|event\.data", "queue message"), (r"socket\.on\s*\(", "websocket input")],
    "sink": [(r"db\.(query|execute|run)\s*\(`", "raw SQL"), (r"exec\s*\(|spawn\s*\(", "shell exec"), (r"eval\s*\(", "eval"), (r"innerHTML\s*=", "innerHTML"), (r"fetch\s*\(\s*\w", "SSRF"), (r"res\.redirect\s*\(", "open redirect"), (r"\.rawQuery\s*\(", "raw query"), (r"child_process", "child process")],
    "sanitizer": [(r"DOMPurify\.sanitize", "DOMPurify"), (r"mysql\.escape|pg\.escapeLiteral", "DB escape"), (r"validator\.", "validator"), (r"Joi\.|Zod\.|yup\.", "schema validation"), (r"encodeURIComponent|htmlspecialchars", "URI encode")],
    "auth-gate": [(r"requireAuth|isAuthenticated|verifyToken", "auth middleware"), (r"jwt\.verify\s*\(", "JWT verify"), (r"bcrypt\.compare\s*\(", "bcrypt compare"), (r"requireAdmin|isAdmin|roles\.includes", "role gate")],
    "service-dep": [(r"axios\.(get|post|put|delete)", "HTTP call"), (r"amqp|rabbitmq|kafka|bull\.add", "queue send"), (r"redis\.set|memcache\.set", "cache write"), (r"stripe\.|sendgrid\.|twilio\.", "SaaS API"), (r"prisma\.\w+\.(create|update|delete)", "DB write")],
    "async-bridge": [(r"new Promise\s*\(", "Promise"), (r"setTimeout|setInterval", "timer"), (r"EventEmitter|\.emit\s*\(", "event emit"), (r"\.then\s*\(\s*async", "promise chain"), (r"process\.nextTick", "nextTick")],
}
#: family, what it provides, label
PRIMITIVES = [
    ("xss", ["session-token", "cookie-access", "dom-control", "credential-theft"], "XSS → Session Hijack"),
    ("sql-injection", ["db-read", "db-write", "credential-dump", "auth-bypass", "data-exfil"], "SQLi → Database Access"),
    ("ssrf", ["internal-network-access", "cloud-metadata-access", "credential-theft", "internal-service-rce"], "SSRF → Internal Network"),
    ("command-injection", ["rce", "file-system-access", "network-pivot", "persistence"], "Command Injection → RCE"),
    ("path-traversal", ["file-read", "source-code-disclosure", "credential-file-access"], "Path Traversal → File Read"),
    ("jwt-bypass", ["auth-bypass", "privilege-escalation", "admin-access"], "JWT Bypass → Admin Access"),
    ("prototype-pollution", ["property-injection", "auth-bypass", "rce"], "Prototype Pollution → Auth Bypass"),
    ("open-redirect", ["phishing-vector", "token-theft", "oauth-hijack"], "Open Redirect → Token Theft"),
    ("header-injection", ["cache-poisoning", "response-splitting", "session-fixation"], "Header Injection → Cache Poisoning"),
    ("hardcoded-secret", ["credential-theft", "api-access", "cloud-access", "third-party-access"], "Hardcoded Secret → API Compromise"),
    ("auth-bypass", ["admin-access", "data-access", "privilege-escalation"], "Auth Bypass → Unauthorized Access"),
]
#: what it takes, what it enables
ESCALATIONS = [
    (["internal-network-access", "cloud-metadata-access"], "IAM credential theft via AWS metadata service"),
    (["IAM credential theft via AWS metadata service"], "Full AWS account takeover via stolen IAM credentials"),
    (["credential-dump", "auth-bypass"], "Full authentication bypass with leaked credentials"),
    (["session-token", "admin-access"], "Admin account takeover via stolen session + privilege escalation"),
    (["file-read", "credential-file-access"], "Secret exfiltration via arbitrary file reads (.env, private keys)"),
    (["rce", "network-pivot"], "Full infrastructure compromise via RCE + lateral movement"),
    (["credential-theft", "api-access"], "Third-party service compromise via stolen API keys"),
    (["property-injection", "auth-bypass"], "Privilege escalation via prototype pollution + auth logic bypass"),
]

#: our own: what an attack of a family needs from one before it
CHAIN_NEEDS = {
    "sql-injection": ["internal-network-access"], "command-injection": ["admin-access", "internal-service-rce"], "path-traversal": ["admin-access"],
    "jwt-bypass": ["credential-file-access", "credential-dump"], "hardcoded-secret": ["source-code-disclosure"], "auth-bypass": ["session-token", "token-theft", "session-fixation"],
}
