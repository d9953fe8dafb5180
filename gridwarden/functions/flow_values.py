"""Fixed values of the data-flow findings: sinks, contexts, weakness classes and scores by sink."""

from __future__ import annotations

HTML_SAFE = r"encodeHTML|escapeHtml|DOMPurify\.sanitize|validator\.escape|he\.encode|xss\(|sanitizeHtml"
URL_SAFE = r"encodeURIComponent|new URL\s*\(|URL\.parse"
REDIRECT_SAFE = r"ALLOWED_HOSTS|allowedDomains|allowlist|startsWith\s*\(['\"]/|startsWith\s*\(APP_URL"
PARAMETERIZED = r"(?:db|pool|client)\.(?:query|execute|run)\s*\([^)]*,\s*(?:\[|\{)|cursor\.execute\s*\([^,\n]+,\s*(?:\(|\[|\{)|\.filter\s*\(|\.where\s*\([^)]*(?:=|==)\s*\w+\s*\)|Prisma\.sql"
#: sink, pattern; the first of a line counts
SINKS = [
    ("sql", r"(?:db|pool|client)\.(?:query|execute|run)\s*\(|cursor\.execute\s*\(|\.raw\s*\(|text\s*\("),
    ("xss", r"(?:res\.send|res\.write|Response|HttpResponse|HTMLResponse|render_template_string|Markup|make_response|return\s+f?['\"`][\s\S]*<[^>]+>)"),
    ("cmd", r"(?:exec|execSync|spawn|spawnSync|os\.system|os\.popen|subprocess\.\w+)\s*\("),
    ("path", r"(?:readFile|readFileSync|createReadStream|writeFile|open|send_file|FileResponse|Path|os\.path\.join|path\.join)\s*\("),
    ("redirect", r"(?:res\.redirect|redirect|HttpResponseRedirect|RedirectResponse)\s*\("),
    ("ssrf", r"(?:fetch|axios(?:\.get|\.post)?|got|request|requests\.(?:get|post)|httpx\.(?:get|post)|urllib\.request\.urlopen)\s*\("),
    ("deserialization", r"(?:pickle|marshal)\.loads?\s*\(|yaml\.load\s*\(|ObjectInputStream|unserialize\s*\("),
    ("ssti", r"(?:jinja2\.)?Template\s*\(|render_template_string\s*\(|mako\.template\.Template\s*\("),
    ("eval", r"\beval\s*\(|\bexec\s*\(|new Function\s*\(|vm\.run"),
    ("header", r"(?:setHeader|headers\s*\[|response\[[^\]]+\]\s*=)"),
]
#: kinds of sanitizer that cover a sink, besides schema and allowlist, which cover all
COVERS = {"sql": "sql", "xss": "html", "ssti": "html", "cmd": "cmd", "eval": "cmd", "deserialization": "cmd", "path": "path", "redirect": "url", "ssrf": "url", "header": "header"}
#: class, name, base of exploitability
SINK_FACTS = {
    "sql": ("CWE-89", 88), "xss": ("CWE-79", 82), "cmd": ("CWE-78", 95), "path": ("CWE-22", 72), "redirect": ("CWE-601", 68), "ssrf": ("CWE-918", 86), "deserialization": ("CWE-502", 96), "ssti": ("CWE-94", 94), "eval": ("CWE-94", 96), "header": ("CWE-113", 70),
}
SEVERE = ["sql", "cmd", "xss", "path", "deserialization", "eval", "ssti", "ssrf"]
CRITICAL = ["cmd", "deserialization", "ssti", "eval", "ssrf"]
#: what stands before an interpolation, or on its line, and the context that it makes
XSS_BEFORE = [(r"on\w+\s*=\s*[\"'][^\"']*\z", "attribute"), (r"style\s*=\s*[\"'][^\"']*\z", "css"), (r"href\s*=\s*[\"'][^\"']*\z", "url"), (r"src\s*=\s*[\"'][^\"']*\z", "url")]
XSS_LINE = [(r"\.innerHTML|\.outerHTML|document\.write|insertAdjacentHTML", "dom-sink"), (r"dangerouslySetInnerHTML|__html", "jsx"), (r"<script[\s>]", "inline-js")]
#: the argument of a sink, and what is reported of it: a trial payload and the damage
SINK_ARGUMENTS = {
    "sql": r"(?:query|execute|run|raw|text)\s*\((.*)\)", "xss": r"(?:innerHTML|outerHTML|write|insertAdjacentHTML)[^=]*(?:=|\()(.*)",
    "cmd": r"(?:exec|execSync|spawn|spawnSync|os\.system|os\.popen|subprocess\.\w+)\s*\((.*)\)", "path": r"(?:readFile|readFileSync|createReadStream|writeFile|open|send_file|FileResponse|Path|join)\s*\((.*)\)",
    "redirect": r"(?:redirect|HttpResponseRedirect|RedirectResponse)\s*\((.*)\)", "ssrf": r"(?:fetch|axios(?:\.get|\.post)?|got|request|requests\.\w+|httpx\.\w+|urlopen)\s*\((.*)\)",
    "deserialization": r"(?:loads?|load)\s*\((.*)\)", "ssti": r"(?:Template|render_template_string)\s*\((.*)\)", "eval": r"(?:eval|exec|Function|run\w*)\s*\((.*)\)", "header": r"(?:setHeader|headers\s*\[|response\[[^\]]+\]\s*=)\s*\(?(.*)",
}
SINK_PAYLOADS = {
    "sql": "' OR '1'='1'--", "xss": "<img src=x onerror=alert(1)>", "cmd": '"; id; #', "path": "../../etc/passwd", "redirect": "https://evil.example/phish", "ssrf": "http://169.254.169.254/latest/meta-data/",
    "deserialization": "a serialized object that runs code", "ssti": "{{ 7 * 7 }}", "eval": "process.exit()", "header": "value%0d%0aSet-Cookie:%20admin=true",
}
SINK_IMPACTS = {
    "sql": "data read or changed", "cmd": "remote code", "eval": "remote code", "ssti": "remote code", "deserialization": "remote code", "ssrf": "internal services", "path": "files read or written", "redirect": "phishing", "header": "split responses",
}
SINK_FIXES = {
    "sql": "bind values to placeholders", "cmd": "run a fixed program with a checked list of arguments", "path": "resolve the path and keep it below a base folder", "redirect": "allow listed hosts only", "ssrf": "allow listed hosts only, at the network",
    "deserialization": "read a plain data format", "ssti": "pass values to a fixed template", "eval": "look actions up in a table", "header": "refuse line breaks",
}
#: a list of arguments for a child process, and a shell for it
ARGUMENT_LIST, WITH_SHELL = r"subprocess\.\w+\s*\(\s*\[", r"shell\s*=\s*True"
#: of what is assigned on a line: from what, and to what; groups (target, expression)
FLOW_ASSIGN = r"(?:const|let|var)\s+(\w+)\s*=\s*(?:await\s+)?([\w.]+)\s*[;,\n]"
FLOW_READ = r"(?:const|let|var)\s+(\w+)\s*=\s*([\w.]+)"
FLOW_TARGET = r"^\s*([\w.]+)\s*=\s*(.+)\z"
FLOW_UNPACK = r"(?:const|let|var)\s*\{([^}]+)\}\s*=\s*(\w+)"
FLOW_CALLBACK = r"([\w.]+)\.(?:map|forEach|filter|then|catch|finally)\s*\(\s*(?:async\s*)?\(?(\w+)\)?\s*=>"
FLOW_MADE = r"^\s*(\w+)\s*=\s*(\w+)\s*\(([^)]*)\)"
#: written to pages
DOM_VALUE = r"(?:\.innerHTML|\.outerHTML|document\.write|insertAdjacentHTML\s*\([^,]+,)\s*=?\s*([^;]+)"
MARKUP_VALUE = r"`[^`]*<[a-zA-Z/?][^`]*\$\{([^}]+)\}[^`]*`"
JSX_VALUE, ANY_VALUE = r"__html\s*:\s*([^,}]+)", r"\$\{([^}]+)\}"
#: requests that go out
REQUEST_TO, REQUEST_BUILT = r"(?:fetch|axios(?:\.get|\.post)?|got|request)\s*\(\s*(\w+)", r"(?:fetch|axios)\s*\(`[^`]*\$\{(\w+)\}`\)"
#: payloads by context of a page
XSS_PAYLOADS = {
    "html-body": "<script>alert(1)</script>", "attribute": '" onmouseover="alert(1)', "inline-js": "</script><script>alert(1)</script>", "css": "expression(alert(1))", "url": "javascript:alert(1)",
    "dom-sink": "<img src=x onerror=alert(1)>", "jsx": "<img src=x onerror={alert(1)}>",
}
#: addresses in other number systems, which stand for private or metadata hosts
ODD_ADDRESSES = [(r"\b(0x[\da-f]+|\d{8,10})\b", "i"), (r"\b0\d+\.\d+\.\d+\.\d+", "")]
