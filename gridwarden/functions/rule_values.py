"""The rule catalogue and the taint engine's patterns, in order of evaluation.

Patterns that looked around or back are written without it, for engines that lack it; where that says a little less or more, the note says so.
"""

from __future__ import annotations

H, M, L = "high", "medium", "low"
SEC, LOGIC, MAINT = "security", "logic", "maintainability"
ESCAPED = r"(?:encodeHTML|escapeHtml|DOMPurify\.sanitize|textContent\s*=|createTextNode)\s*\("
PARAMS = r"db\.(?:query|execute|run)\s*\(\s*(?:['\"`][^'\"]+\?[^'\"]+['\"`]|\w+)\s*,\s*\["
ALLOWED = (r"(?:ALLOWED_HOSTS|allowedDomains|whitelist|allowlist)", "i")

#: id, pattern, flags, severity, category, family of duplicates (None: its own), patterns on the line that mitigate it
RULES = [
    ("rce-eval", r"\beval\s*\([^'\"` ]", "", H, SEC, "rce", []),
    ("rce-function-constructor", r"(?:return\s+)?(?:new\s+)?Function\s*\(\s*[a-zA-Z_$\[]", "", H, SEC, "rce", []),
    ("rce-vm-run", r"vm\.run(?:InNewContext|InThisContext|InContext)\s*\(", "", H, SEC, "rce", []),
    ("sqli-concat", r'"[^"]*(?:WHERE|SELECT|INSERT|UPDATE|DELETE|FROM)[^"]*"\s*\+', "i", H, SEC, "sqli", [PARAMS]),
    ("sqli-template", r"`[^`]*(?:WHERE|SELECT|INSERT|UPDATE|DELETE|FROM)\s[^`]*\$\{", "i", H, SEC, "sqli", [PARAMS]),
    ("sqli-regex-sanitize", r"\.replace\s*\(\s*/[^/]*['\"`;][^/]*/[gi]*\s*,\s*['\"]{2}\s*\)", "", H, SEC, "sqli", []),
    ("xss-innerhtml", r"\.innerHTML\s*=(?:\s+|[^'\"`\s]|['\"`](?:\$|\z)|\z)", "", H, SEC, "xss", [ESCAPED]),
    # safe interpolations are looked for on the whole line
    ("xss-template-html", r"`[^`]*<(?:div|span|pre|p|a|h[1-6])[^`]*\$\{", "i", H, SEC, "xss", [ESCAPED, (r"\$\{[^}]*(?:encodeHTML|escapeHtml|textContent)", "i")]),
    ("proto-incomplete-check", r"!==\s*['\"]__proto__['\"]", "", H, SEC, None, [r"(?:constructor|prototype).*(?:prototype|constructor)"]),
    # that the key is the loop's own name is not checked
    ("proto-for-in-no-check", r"for\s*\(\s*(?:let|var|const)?\s*\w+\s+in\s+\w+\s*\)\s*\{[^}]*target\s*\[\s*\w+\s*\]", "s", H, SEC, None, [r"Object\.keys\s*\(", r"\.hasOwnProperty\s*\(", r"includes\s*\(\s*key"]),
    ("ssrf-unvalidated-url", r"(?:fetch|axios(?:\.get|\.post)?|got|request)\s*\(\s*(?:req\.|request\.|params\.|query\.|body\.)|\bconst\s+(?:url|href|endpoint)\s*=\s*req\.[^;]+;\s*[^\n]*(?:fetch|axios)\s*\(\s*(?:url|href|endpoint)", "s", H, SEC, None, [ALLOWED]),
    ("header-injection", r"setHeader\s*\([^)]*(?:req\.(?:query|params|body|headers)\.|\$\{)", "", H, SEC, None, [r"\$\{\w*(?:safe|clean|sanitized|encoded)"]),
    ("trust-false-security-claim", r"['\"`].*(?:fully\s+secure|100%\s+safe|verified\s+safe|✓\s*(?:fully|100|safe|secure))", "i", H, SEC, None, []),
    ("prompt-injection", r"ignore\s+(?:all\s+)?(?:previous|above|prior)\s+instructions?", "i", H, SEC, "rce", []),
    ("env-exposure", r"res\.(?:send|json)\s*\(\s*\{[^}]*process\.env", "", H, SEC, None, []),
    ("falsy-zero-check", r"return\s+\w+\s*&&\s*typeof\s+\w+\s*===?\s*['\"](?:number|string)['\"]", "", M, LOGIC, None, []),
    ("reduce-no-initial", r"\.reduce\s*\(\s*\([^)]+\)\s*=>[^,)]*\)", "", M, LOGIC, None, [r"\.reduce\s*\([^)]*=>[^)]*,[^)]+\)"]),
    ("silent-truncation", r"\breturn\b[^\n;]*\.slice\s*\(\s*0\s*,\s*\d{3,}", "", M, LOGIC, None, []),
    ("loose-equality", r"\breturn\s+\w+\s*==\s*\w+\s*;", "", L, LOGIC, None, []),
    ("race-condition-stock", r"if\s*\(\s*\w+\s*>=?\s*\w+\s*\)[^{}]*\{[^{}]*await[^{}]*\w+\s*-=\s*\w+", "s", H, LOGIC, None, []),
    ("math-random-security", r"(?:token|secret|nonce|salt|sessionId|csrf|key|password)\s*[=:]\s*(?:String\()?Math\.random", "", M, SEC, None, []),
    ("unawaited-promise", r"(?:^|\s)(?:fetch|axios|got|http)\s*\([^)]+\)\s*;", "m", L, LOGIC, "rce", []),
    ("path-traversal-readfile", r"(?:readFile|readFileSync|createReadStream|writeFile|writeFileSync)\s*\(\s*(?:req\.|path\.join\s*\([^)]*req\.)", "", H, SEC, "path", [(r"path\.normalize|allowlist|whitelist|ALLOWED_FILES", "i")]),
    ("path-traversal-join", r"path\.join\s*\(\s*__dirname[^)]*req\.|path\.join\s*\([^)]*req\.[^)]*__dirname", "", H, SEC, "path", [(r"startsWith\s*\(.*BASE|\.startsWith\s*\(.*__dirname|allowlist", "i")]),
    ("cmd-injection-exec", r"(?:exec|execSync|execFile)\s*\(\s*(?:`[^`]*\$\{|[\"'][^\"']*\"\s*\+|req\.|[\w]+\s*\+\s*[\"'])", "", H, SEC, "cmd", [r"spawn\s*\([^)]*,\s*\["]),
    ("cmd-injection-spawn-shell", r"spawn\s*\([^)]*shell\s*:\s*true", "", H, SEC, "cmd", []),
    ("mass-assignment", r"Object\.assign\s*\(\s*\w+\s*,\s*req\.body|const\s+\w+\s*=\s*\{\s*\.\.\.\s*req\.body", "", H, SEC, None, []),
    ("open-redirect", r"res\.redirect\s*\(\s*(?:req\.|[`'\"][^)]*\$\{|url\s*\)|redirect\s*\)|returnUrl\s*\))", "", H, SEC, None, [(r"ALLOWED_HOSTS|allowedDomains|whitelist|allowlist|startsWith\s*\(['\"]/['\"]|startsWith\s*\(APP_URL", "i")]),
    ("redos", r"new\s+RegExp\s*\(\s*\w+|\.match\s*\(\s*/(?:[^/]*[+*]){2,}|\.test\s*\(\s*(?:req\.|input|userInput)", "", M, SEC, None, [r"safe-regex|vuln-regex-detector"]),
    ("insecure-deserialize", r"serialize\.unserialize\s*\(|unserialize\s*\(\s*req\.|deserialize\s*\(\s*req\.", "", H, SEC, "rce", []),
    ("react-dangerous-innerhtml", r"dangerouslySetInnerHTML\s*=\s*\{\s*\{[\s\S]{0,80}__html\s*:", "", H, SEC, "xss", [r"DOMPurify\.sanitize|he\.encode|xss\("]),
    ("nextjs-headers-user-input", r"headers\s*\(\s*\)\s*\{[^}]*return\s*\[[^\]]*['\"][^'\"]+['\"]\s*,\s*req\.", "s", M, SEC, None, []),
    ("jwt-none-algorithm", r"jwt\.verify\s*\([^)]+\)|jwt\.decode\s*\([^,)]+\)", "", H, SEC, None, [r"algorithms\s*:\s*\["]),
    ("timing-attack-comparison", r"(?:token|secret|signature|hmac|hash|apiKey|password)\s*===\s*\w+|\w+\s*===\s*(?:token|secret|signature|hmac|hash|apiKey)", "", M, SEC, None, [r"timingSafeEqual|safe-compare|slowEquals"]),
    ("idor-user-id-from-request", r"(?:userId|user_id|accountId|account_id|customerId)\s*[=:]\s*req\.(?:params|query|body)\.\w+", "", H, SEC, "rce", [r"req\.user\.id\s*!==?\s*|ownership|authorize|canAccess|isOwner"]),
    ("ssti-template-concat", r"(?:ejs|nunjucks|pug|handlebars|mustache|swig|twig)\.(?:render|compile)\s*\([^)]*\+[^)]*req\.|template\s*=\s*[`'\"][^`'\"]*\$\{[^}]*req\.", "", H, SEC, None, []),
    ("xxe-xml-parse", r"(?:xml2js|xmldom|fast-xml-parser|DOMParser|libxmljs)\.(?:parse|parseFromString|parseXml)\s*\(", "", H, SEC, "rce", [r"resolveEntities\s*:\s*false|processEntities\s*:\s*false|noent"]),
    ("mass-assignment-spread", r"(?:update|create|updateOne|updateMany|findOneAndUpdate|save)\s*\(\s*\{?\s*\.{3}req\.body", "", H, SEC, None, [r"pick\s*\(|omit\s*\(|allowedFields|whitelist"]),
    ("internal-package-no-scope", r"require\s*\(\s*['\"][a-z][a-z0-9-]{2,30}['\"]\s*\).*(?:internal|private|corp|company|org)", "i", M, SEC, None, []),
    ("cors-wildcard-credentials", r"Access-Control-Allow-Origin['\"]\s*:\s*['\"][*]['\"]|origin\s*:\s*['\"][*]['\"]", "", H, SEC, None, [r"credentials\s*:\s*false"]),
    ("python-pickle-deserialize", r"pickle\.loads?\s*\(|cPickle\.loads?\s*\(", "", H, SEC, "rce", []),
    ("python-os-system-injection", r"os\.system\s*\(|subprocess\.\w+\s*\([^)]*shell\s*=\s*True", "", H, SEC, "rce", [r"shlex\.quote|shlex\.split|shell\s*=\s*False"]),
    ("python-sqli-format", r"cursor\.execute\s*\(\s*f['\"][\s\S]*\{|\bcursor\.execute\s*\([^,\n)]*\+|(?:query|sql|stmt)\s*=\s*f['\"]|(?:query|sql|stmt)\s*=\s*['\"][^'\"]*['\"]\s*%|(?:query|sql|stmt)\s*=\s*['\"][^'\"]*['\"]\.format\s*\(", "", H, SEC, "sqli", [r"cursor\.execute\s*\(\s*[^,\n)]+,\s*(?:\(|\[|\{)", r"cursor\.execute\s*\(\s*['\"][^'\"]*(?:%s|\?)[^'\"]*['\"]\s*,"]),
    ("php-rfi-include", r"(?:include|require|include_once|require_once)\s*\(\s*\$_(?:GET|POST|REQUEST|COOKIE)", "", H, SEC, "path", []),
    ("graphql-introspection-enabled", r"introspection\s*:\s*true|allowIntrospection\s*:\s*true", "", M, SEC, None, []),
    ("http-param-pollution", r"req\.query\.\w+\s*\.(?:toLowerCase|toUpperCase|trim|split|replace|includes|indexOf)\s*\(", "", M, SEC, None, []),
    ("log-injection", r"(?:console\.log|logger\.\w+|log\.(?:info|warn|error|debug))\s*\([^)]*req\.(?:body|query|params|headers)", "", L, SEC, None, []),
    ("sensitive-data-in-url", r"(?:token|password|secret|api_?key|apikey|auth)\s*[:=]\s*req\.query\.\w+", "i", M, SEC, None, []),
    ("missing-rate-limit-auth", r"(?:router|app)\.(post|put)\s*\(\s*['\"][^'\"]*(?:login|signin|auth|password|token)['\"]", "i", M, SEC, "rce", [r"rateLimit|rate_limit|throttle|slowDown|limiter"]),
    ("cleartext-password-storage", r"(?:password|passwd)\s*(?:===|==|!==)\s*(?:req\.|user\.|input\.|data\.)|user\.password\s*=\s*req\.body\.password", "", H, SEC, None, [r"bcrypt\.|argon2\.|scrypt\.|pbkdf2"]),
    ("function-constructor-eval", r"\bFunction\s*\(\s*(?:code|input|userInput|req\.|body\.|query\.|data)", "", H, SEC, "rce", []),
    ("math-random-crypto", r"Math\.random\s*\(\s*\)[^\n;]{0,40}(?:token|secret|session|csrf|nonce|salt|password|apiKey)", "i", H, SEC, None, [r"crypto\.randomBytes|crypto\.getRandomValues|randomUUID"]),
    ("prototype-pollution-for-in", r"for\s*\(\s*(?:let|const|var)\s+\w+\s+in\s+\w+\s*\)\s*\{[^}]{0,200}target\s*\[\s*key\s*\]\s*=", "", H, SEC, "rce", [r"hasOwnProperty|Object\.keys|Object\.entries"]),
    ("env-leak-response", r"res\.\s*(?:send|json|end)\s*\([^)]{0,100}process\.env", "", H, SEC, None, []),
    ("loose-equality-auth", r"(?:isAdmin|isAuthenticated|authorized|role|permission|userId|user\.id)\s*==", "", M, SEC, "rce", [r"==="]),
    ("missing-await-auth", r"if\s*\(\s*(?:verify|check|validate|auth|isValid|authenticate)\w*\s*\([^)]*\)\s*\)\s*\{", "", H, SEC, "rce", [r"await\s+(?:verify|check|validate|auth|isValid|authenticate)"]),
    ("python-reflected-xss-response", r"(?:HttpResponse|HTMLResponse|Response|make_response|render_template_string)\s*\([^\n)]*(?:request\.(?:args|form|GET|POST)|Markup\s*\()", "", H, SEC, "xss", [(r"html\.escape|markupsafe\.escape|bleach\.clean|render_template\s*\(|autoescape", "i")]),
    (
        "python-config-exposure-response",
        r"(?:return\s+\{[\s\S]{0,320}(?:['\"](?:secret|db_password|password|api_key|token|private_key)['\"]\s*:|(?:SECRET_KEY|JWT_SECRET|SESSION_SECRET|DB_PASSWORD|DATABASE_URL)\b)[\s\S]{0,220}\}"
        r"|(?:jsonify|Response|JsonResponse|res\.json)\s*\([^)]{0,260}(?:os\.environ|os\.getenv|process\.env|app\.config|settings\.__dict__|django\.conf\.settings|['\"](?:secret|db_password|password|api_key|token|private_key)['\"]\s*:|(?:SECRET_KEY|JWT_SECRET|SESSION_SECRET|DB_PASSWORD|DATABASE_URL)\b)[^)]*\))",
        "", H, SEC, None, [r"redact|maskSecret|pick_public|PUBLIC_|SAFE_CONFIG"],
    ),
    ("flask-debug-mode-enabled", r"(?:app\.run\s*\([^)]*debug\s*=\s*True|app\.config\[['\"]DEBUG['\"]\]\s*=\s*True|DEBUG\s*=\s*True)", "", H, SEC, None, [r"if\s+os\.environ\.get\(['\"]FLASK_ENV['\"]\)\s*==\s*['\"]development['\"]|debug\s*=\s*False|DEBUG\s*=\s*False"]),
    ("python-request-param-admin-bypass", r"if\s+request\.(?:args|GET|query_params|form|POST)\.get\s*\(\s*['\"](?:admin|is_admin|role|user|uid)['\"][^)]*\)\s*(?:==|in)\s*['\"]?(?:1|true|admin|root)['\"]?[\s\S]{0,160}return\s+['\"][^'\"]*(?:admin|welcome|authorized|success)", "i", H, SEC, None, [(r"@login_required|@permission_required|current_user|request\.user|Depends\s*\([^)]*(?:auth|current_user|require_user)|jwt_required|has_permission|is_authenticated", "i")]),
    ("python-unsafe-upload-filename", r"(?:request\.files\[[^\]]+\]|UploadFile|File\s*\()[\s\S]{0,240}(?:\.save\s*\([^)]*\.filename|open\s*\([^)]*\.filename|shutil\.copyfileobj|FileSystemStorage\s*\([^)]*\)\.save\s*\([^)]*\.name)", "", H, SEC, "path", [r"secure_filename|Path\s*\([^)]*\)\.name|validate_extension|allowed_extensions|content_type|MAX_CONTENT_LENGTH|file\.size|SpooledTemporaryFile"]),
    # the two checks that clear a name are looked for on the first line alone
    ("python-path-traversal-open-join", r"def\s+\w+\s*\([^)]*\)\s*:\s*\n(?:.*\n){0,12}?\s*\w+\s*=\s*request\.(?:args|GET|query_params|form|POST)\.get\s*\([^)]*\)(?:.*\n){0,12}?\s*\w+\s*=\s*(?:os\.path\.join|path\.join)\s*\([^)]*\w+[^)]*\)(?:.*\n){0,12}?\s*return\s+open\s*\(", "m", H, SEC, "path", [r"secure_filename|safe_join|send_from_directory|Path\s*\([^)]*\)\.resolve|os\.path\.normpath"]),
    ("flask-django-fastapi-missing-auth-sensitive-route", r"@(?:app|router)\.(?:get|post|put|patch|delete)\s*\(\s*['\"][^'\"]*(?:admin|delete|update|upload|config|debug|export|users?|billing|token|secret)[^'\"]*['\"][\s\S]{0,220}def\s+\w+\s*\([^)]*\)\s*:", "", H, SEC, None, [(r"@login_required|@permission_required|Depends\s*\([^)]*(?:auth|token|current_user|require_user)|current_user\.is_authenticated|request\.user\.is_authenticated|require_auth|jwt_required", "i")]),
    ("python-hardcoded-secret-key", r"(?:SECRET_KEY|JWT_SECRET|SESSION_SECRET|SECURITY_PASSWORD_SALT)\s*=\s*['\"][^'\"\n]{8,}['\"]|app\.config\[['\"]SECRET_KEY['\"]\]\s*=\s*['\"][^'\"\n]{8,}['\"]", "", H, SEC, "rce", [r"os\.environ|os\.getenv|settings\.SECRET_KEY|process\.env"]),
    ("hardcoded-credential-plaintext", r"(?:PASSWORD|PASSWD|SECRET|API_KEY|AUTH_TOKEN|PRIVATE_KEY|correct_password)\s*=\s*['\"][^'\"]{4,}['\"]", "", H, SEC, "rce", [r"os\.environ|process\.env|getenv|config\[|settings\."]),
    ("python-plaintext-password-compare", r"(?:input_password|user_pass|password|pwd)\s*==\s*(?:correct_password|PASSWORD|PASSWD|self\.\w*password)", "i", H, SEC, None, [r"bcrypt|argon2|hashlib\.pbkdf2|hmac\.compare_digest|check_password_hash"]),
    ("python-division-no-guard", r"(?:total|sum|count|value|result)\s*/\s*(?:len\s*\(|count\s*\(|\w+(?:\s*\))?)\s*", "", M, LOGIC, "rce", [r"if.*!=\s*0", r"if.*(?:len|count).*==\s*0|if not \w+|len\(\w+\)\s*>\s*0|try:|except ZeroDivisionError"]),
    ("python-db-connection-leak", r"conn\s*=\s*(?:sqlite3|psycopg2|pymysql|pymongo|cx_Oracle)\.connect\s*\(", "", M, LOGIC, "sqli", [r"conn\.close\s*\(\)|with\s+(?:sqlite3|psycopg2|pymysql)\.connect|contextlib|finally:"]),
    ("python-unguarded-division", r"^(?:print\s*\()?(?:\w+\s*\()*\w+\s*/\s*\d*[,)]?\s*$", "m", H, LOGIC, None, [r"try:|if\s+\w+\s*!=\s*0|if\s+\w+:"]),
    ("python-subprocess-multiline-shell", r"subprocess\.\w+\s*\([\s\S]*?shell\s*=\s*True", "", H, SEC, "cmd", [r"shell\s*=\s*False"]),
    ("python-bare-except-pass", r"except\s*(Exception)?:\s*\n\s*pass", "", H, MAINT, None, []),
    ("python-global-mutable-state", r"global\s+\w+[\s\S]{0,200}?(?:append|extend|\+=|=\s*\w+\s*\+)", "", M, LOGIC, None, []),
    ("python-unbounded-dict-cache", r"(?:cache|_cache|memo)\s*\[\s*[\w.]+\s*\]\s*=", "", M, LOGIC, None, [r"lru_cache|functools\.lru_cache|maxsize|OrderedDict|TTLCache"]),
    ("python-unsafe-mkstemp", r"(?:fd|file_desc)\s*,\s*(?:path|tmp_path)\s*=\s*tempfile\.mkstemp\s*\(", "", M, SEC, None, [r"os\.close\s*\(|NamedTemporaryFile|TemporaryDirectory"]),
    ("python-infinite-worker-no-shutdown", r"while\s+True:\s*\n\s*(?:try:|[\w.]+\s*=\s*[\w.]+\.get\s*\()", "", L, MAINT, None, []),
    ("plaintext-password-storage-class", r"self\.(?:password|passwd|pwd)\s*=\s*(?:password|pwd|pass_str)", "", H, SEC, None, [r"bcrypt|argon2|hashlib|werkzeug\.security\.generate_password_hash"]),
    ("hardcoded-admin-bypass", r"(?:username|user)\s*==\s*[\"']admin[\"']", "", H, SEC, None, []),
    ("express-xss-template-html-multiline", r"(?:const|let|var)\s+\w+\s*=\s*`[\s\S]*?<(?:h[1-6]|p|div|span|a|script|iframe)[\s\S]*?\$\{[\s\S]*?req\.(?:query|params|body|headers)", "i", H, SEC, "xss", []),
    ("express-env-disclosure-multiline", r"res\.(?:send|json|status\s*\(\s*\d+\s*\)\s*\.\s*(?:send|json))\s*\(\s*\{[\s\S]*?(?:process\.env|SECRET|API_KEY|DATABASE_URL|JWT_SECRET)[\s\S]*?\}", "i", H, SEC, None, []),
    ("sql-plaintext-password-insert", r"(?:INSERT|UPDATE)[\s\S]*?(?:password|passwd|pwd)[\s\S]*?(?:VALUES|SET)[\s\S]*?(?:\$\{|\+\s*|'\s*,\s*')", "i", H, SEC, "sqli", [r"bcrypt\.hash|argon2|hashPassword|encrypt"]),
    ("hardcoded-admin-seed", r"INSERT[\s\S]*?(?:admin|root|superuser)[\s\S]*?(?:admin123|password|123456|qwerty)", "i", H, SEC, None, []),
    ("jwt-decode-auth-bypass-multiline", r"jwt\.decode\s*\([\s\S]*?(?:req\.|token|auth)", "i", H, SEC, None, [r"jwt\.verify"]),
]
#: Rules that report one finding a file at most.
ONCE = {"prompt-injection"}
#: Content rules, for prose: (id, pattern, flags, severity)
CONTENT_RULES = [
    ("token-literal", r"(?:token|secret|password|passwd|api_?key)[\"']?\s*[:=]\s*[\"']?[A-Za-z0-9+/_.=-]{6,}", "i", H),
    ("hex-secret", r"\b[0-9a-f]{32,}\b", "", M),
    ("email-address", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+", "", L),
    ("phone-number", r"\+[0-9][ ().0-9-]{7,}[0-9]", "", L),
    ("card-number", r"\b[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{3,4}\b", "", H),
    ("license-line", r"licen[cs]e", "i", L),
    ("symbol-run", r"[#*$%&|<>]{3,}", "", L),
    ("inline-script", r"<script|javascript:|on\w+\s*=\s*[\"']", "i", M),
    ("plain-http-link", r"http://", "i", L),
    ("prompt-injection", r"ignore\s+(?:all\s+)?(?:previous|above|prior)\s+instructions?", "i", H),
]

# -- taint -------------------------------------------------------------------------------------------------------------

#: pattern of a source, whether it names several variables
SOURCES = [
    (r"(?:const|let|var)\s+(\w+)\s*=\s*req\.(?:query|params|body|headers)\.(\w+)", False),
    (r"(?:const|let|var)\s*\{([^}]+)\}\s*=\s*req\.(?:query|params|body|headers)", True),
    (r"req\.(?:query|params|body|headers)\.(\w+)", False),
    (r"(?:const|let|var)\s+(\w+)\s*=\s*(?:request|req)\.nextUrl\.searchParams\.get\(", False),
    (r"(?:const|let|var)\s*\{([^}]+)\}\s*=\s*(?:await\s+)?params", True),
    (r"searchParams\.get\s*\(\s*['\"](\w+)['\"]", False),
    (r"(?:ctx|context|c)\.(?:query|params|body|request\.body)\.(\w+)", False),
    (r"event\.(?:queryStringParameters|body|pathParameters)\.(\w+)", False),
    (r"formData\.get\s*\(\s*['\"](\w+)['\"]", False),
    (r"new\s+URLSearchParams\s*\([^)]*\)\s*\.get\s*\(\s*['\"](\w+)['\"]", False),
    (r"(?:const|let|var)\s+(\w+)\s*=\s*new\s+URL\s*\([^)]+\)\.searchParams", False),
    (r"(?:const|let|var)\s+(\w+)\s*=\s*args\.(\w+)", False),
    (r"(?:const|let|var)\s*\{([^}]+)\}\s*=\s*args", True),
    (r"(?:const|let|var)\s+(\w+)\s*=\s*input\.(\w+)", False),
    (r"(?:const|let|var)\s*\{([^}]+)\}\s*=\s*input", True),
    (r"request\.form\.get\s*\(\s*['\"](\w+)['\"]", False),
    (r"request\.args\.get\s*\(\s*['\"](\w+)['\"]", False),
    (r"request\.json\.get\s*\(\s*['\"](\w+)['\"]", False),
    (r"os\.environ\.get\s*\(\s*['\"](\w+)['\"]", False),
    (r"def\s+\w+\s*\((?:[^)]*,\s*)?(user_id|user_input|input_\w+|query|request|data|payload|message|content)(\s*,|\s*\))", False),
    (r"def\s+\w+\s*\(([a-z_]\w*)(?:\s*,|\s*\))", False),
]
NOT_NAMES = ["const", "let", "var", "async", "await", "true", "false"]
#: what is assigned, and what from
ALIASES = [
    r"(?:const|let|var)\s+(\w+)\s*=\s*(\w+)\s*[;,\n]",
    r"(?:const|let|var)\s+(\w+)\s*=\s*`[^`]*\$\{(\w+)\}",
    r"(?:const|let|var)\s+(\w+)\s*=\s*(\w+)\s*\+",
    r"(?:const|let|var)\s+(\w+)\s*=\s*\S+\s*\+\s*(\w+)",
]
CALL_ALIAS = r"(?:const|let|var)\s+(\w+)\s*=\s*(?:await\s+)?(\w+)\s*\(([^)]*)\)"
#: a guard that returns or throws, and the group of the variable that it checks; 0 if it names none
GUARDS = [
    (r"if\s*\(\s*!(\w+)\s*\)\s*(?:return|throw|res\.(?:send|status|end))", 1),
    (r"if\s*\(\s*typeof\s+(\w+)\s*!==?\s*['\"]string['\"]\s*\)\s*(?:return|throw)", 1),
    (r"if\s*\(\s*!(\w+)\s*\|\|[^)]*\)\s*(?:return|throw)", 1),
    (r"if\s*\(\s*(\w+)\s*===?\s*(?:null|undefined)\s*\)\s*(?:return|throw)", 1),
    (r"(\w+)\s*=\s*parseInt\s*\(.*\);\s*if\s*\(\s*isNaN", 1),
    (r"const\s+(?:result|parsed|validated)\s*=\s*(?:schema|z\.\w+|Joi\.\w+)\s*\.(?:parse|validate|safeParse)\s*\(", 0),
]
HTML_SAFE = r"encodeHTML|escapeHtml|DOMPurify\.sanitize|validator\.escape|he\.encode|xss\("
URL_SAFE = r"encodeURIComponent|URL\.parse|new URL\("
SQL_SAFE = r"(?:escape|sanitize)Sql|mysql\.escape"
CRLF_SAFE = r"\.replace\s*\(\s*/\[\\r\\n|\.replace\s*\(\s*/\\r\\n"
PATH_SAFE = r"path\.normalize|\.replace\s*\(.*\.\."
SQL_SAFE_CALL = r"db\.(?:query|execute|run)\s*\([^)]*,\s*\["
