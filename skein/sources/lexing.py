"""Facts of one source file: functions, types, calls, imports, routes, models, style uses, comments.

Python is read with its own parser, other languages by a lexer that blanks
strings and comments and follows brackets. A fact is a dict of kind, line, end,
name and string attributes.
"""

from __future__ import annotations

import ast
import bisect
import functools
import hashlib
import re

#: Languages by file extension.
LANGUAGES = {".py": "python", ".go": "go", ".js": "js", ".jsx": "js", ".mjs": "js", ".ts": "js", ".tsx": "js", ".java": "java", ".kt": "kotlin", ".cs": "csharp", ".rs": "rust", ".swift": "swift"}
TEMPLATES = (".html", ".htm", ".vue", ".svelte", ".ejs", ".hbs")
STYLES = (".css", ".scss", ".less")
#: Names whose calls are no calls of the program's own functions.
KEYWORDS = set("if for while switch catch return function await new typeof super this func go defer select match loop fn impl let use where in as is not and or elif with assert del lambda yield print len make append panic require import export sizeof nameof when guard init".split())
VERBS = ("get", "post", "put", "patch", "delete", "head", "options", "all", "use")
FUNCTION = {
    "go": r"^func\s+(?:\((?P<recv>[^)]*)\)\s*)?(?P<name>\w+)",
    "js": r"^[ \t]*(?:export\s+)?(?:default\s+)?(?:async\s+)?(?:function\s*\*?\s*(?P<name>\w+)\s*\(|(?:const|let|var)\s+(?P<name2>\w+)\s*(?::[^=]+)?=\s*(?:async\s*)?(?:function\b|\([^)]*\)\s*(?::[^=]+)?=>|\w+\s*=>)|(?:public\s+|private\s+|protected\s+|static\s+|async\s+)*(?P<name3>\w+)\s*\([^)]*\)\s*(?::[^{]+)?\{)",
    "java": r"^[ \t]*(?:(?:public|private|protected|static|final|abstract|synchronized|default)\s+)*[\w<>\[\],.? ]+\s+(?P<name>\w+)\s*\([^;{]*\)\s*(?:throws [\w, .]+)?\{",
    "kotlin": r"^[ \t]*(?:\w+\s+)*fun\s+(?:<[^>]*>\s*)?(?:[\w.]+\.)?(?P<name>\w+)\s*\(",
    "csharp": r"^[ \t]*(?:(?:public|private|protected|internal|static|virtual|override|async|sealed)\s+)+[\w<>\[\],.? ]+\s+(?P<name>\w+)\s*\([^;{]*\)\s*(?:\{|=>)",
    "rust": r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+|const\s+|unsafe\s+)*fn\s+(?P<name>\w+)",
    "swift": r"^[ \t]*(?:\w+\s+)*func\s+(?P<name>\w+)",
}
DEFINITION = {
    "go": r"^type\s+(?P<name>\w+)\s+(?:struct|interface|func|\w)",
    "js": r"^(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(?P<name>\w+)(?:\s+extends\s+(?P<base>[\w.]+))?",
    "java": r"^[ \t]*(?:(?:public|private|protected|static|final|abstract)\s+)*(?:class|interface|enum|record)\s+(?P<name>\w+)(?:[^{]*?extends\s+(?P<base>\w+))?",
    "kotlin": r"^[ \t]*(?:\w+\s+)*(?:class|interface|object)\s+(?P<name>\w+)",
    "csharp": r"^[ \t]*(?:(?:public|private|protected|internal|static|sealed|abstract|partial)\s+)*(?:class|interface|struct|enum|record)\s+(?P<name>\w+)(?:\s*:\s*(?P<base>[\w<>]+))?",
    "rust": r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?struct\s+(?P<name>\w+)",
    "swift": r"^[ \t]*(?:\w+\s+)*(?:class|struct|enum|protocol|actor)\s+(?P<name>\w+)(?:\s*:\s*(?P<base>\w+))?",
}
IMPORT = {
    "go": r"^(?:import\s+|\s+)(?:[\w.]+\s+)?\"(?P<spec>[^\"]+)\"\s*$",
    "js": r"(?:from\s+|require\(\s*|^import\s+)[\"'](?P<spec>[^\"']+)[\"']",
    "java": r"^import\s+(?:static\s+)?(?P<spec>[\w.]+)",
    "kotlin": r"^import\s+(?P<spec>[\w.]+)",
    "csharp": r"^\s*using\s+(?P<spec>[\w.]+)\s*;",
    "rust": r"^\s*(?:pub\s+)?use\s+(?P<spec>[\w:]+)",
    "swift": r"^import\s+(?P<spec>\w+)",
}
MODEL_BASES = ("Model", "Base", "DeclarativeBase", "SQLModel", "Document", "models.Model", "db.Model", "BaseEntity")
CALL = re.compile(r"(?P<dot>\.)?\b(?P<name>[A-Za-z_]\w*)\s*\(")
STRING_OR_COMMENT = re.compile(r"//[^\n]*|/\*.*?\*/|\"\"\".*?\"\"\"|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`", re.DOTALL)
EXPRESS = re.compile(r"\b(?P<obj>\w+)\.(?P<verb>get|post|put|patch|delete|head|options|all|use)\(\s*(?P<q>[\"'`])(?P<path>/[^\"'`]*)(?P=q)\s*(?P<rest>,[^\n]*)?")
GO_ROUTE = re.compile(r"\.(?P<verb>GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS|Get|Post|Put|Patch|Delete|Head|Options|Handle|HandleFunc)\(\s*\"(?:(?P<m>[A-Z]+) )?(?P<path>/[^\"]*)\"\s*,\s*(?P<rest>[^\n]*)")
ANNOTATED = re.compile(r"(?:@|\[)(?:(?P<verb>Get|Post|Put|Patch|Delete)Mapping|Http(?P<verb2>Get|Post|Put|Patch|Delete))\s*(?:\(\s*(?:value\s*=\s*|path\s*=\s*)?\"(?P<path>[^\"]*)\")?")
RETROFIT = re.compile(r"@(?P<verb>GET|POST|PUT|PATCH|DELETE)\(\s*\"(?P<path>[^\"]+)\"")
CLIENT = re.compile(r"\b(?:fetch|axios|http|client|api|request|\$http|ky|got|requests|httpx)(?:\.(?P<verb>get|post|put|patch|delete|head))?\(\s*(?P<arg>f?[\"'`][^\"'`\n]*[\"'`])(?P<rest>[^\n]{0,200})")
IDENT = re.compile(r"[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)*")


def content_hash(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()[:16]


def blanked(text: str) -> str:
    """The text with strings and comments replaced by spaces, line ends kept."""
    return STRING_OR_COMMENT.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


@functools.lru_cache(maxsize=4)
def line_ends(text: str) -> list[int]:
    return [m.start() for m in re.finditer("\n", text)]


def line_at(text: str, at: int) -> int:
    return bisect.bisect_left(line_ends(text), at) + 1


def block_end(text: str, at: int) -> int:
    """Where the bracket block that opens first after a place ends; a line end before it means none."""
    open_ = text.find("{", at)
    if open_ < 0 or ";" in text[at:open_]:
        return text.find("\n", at) if "\n" in text[at:] else len(text)
    depth = 0
    for i in range(open_, len(text)):
        depth += (text[i] == "{") - (text[i] == "}")
        if depth == 0:
            return i
    return len(text)


def exported(language: str, name: str, head: str) -> str | None:
    rules = {"go": name[:1].isupper(), "python": not name.startswith("_"), "java": "public" in head, "csharp": "public" in head, "kotlin": not re.search(r"\b(private|internal)\b", head), "rust": re.match(r"\s*pub\s", head) is not None}
    return None if language not in rules else str(bool(rules[language])).lower()


def comment_before(lines: list[str], line: int) -> str:
    """The comment block that ends on the line before a declaration, its marks stripped, up to 300 characters."""
    out = []
    for i in range(line - 2, -1, -1):
        text = lines[i].strip()
        if not text.startswith(("//", "/*", "*", "#", "///")) or text.startswith(("#[", "#!")):
            break
        out.append(re.sub(r"^(///?!?|/\*\*?|\*/?|#)\s?|\*/$", "", text).strip())
    return " ".join(x for x in reversed(out) if x)[:300]


def fact(kind: str, line: int, name: str = "", end: int | None = None, **attrs: str | None) -> dict:
    return {"kind": kind, "line": line, "end": end or line, "name": name, "attrs": {k: v for k, v in attrs.items() if v is not None}}


def parse_python(text: str) -> list[dict]:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return []
    found: list[dict] = []
    lines = text.split("\n")
    for node in ast.walk(tree):
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
            doc = (ast.get_docstring(node) or "").strip().split("\n\n")[0].replace("\n", " ")[:300]
            signature = lines[node.lineno - 1].strip().rstrip(":")
            body = "\n".join(lines[node.lineno - 1 : node.end_lineno])
            short = body if node.end_lineno - node.lineno < 15 and len(body) <= 600 else None
            found.append(fact("function", node.lineno, node.name, node.end_lineno, signature=signature, doc=doc or None, exported=exported("python", node.name, ""), body=short))
            found += python_routes(node)
        elif isinstance(node, ast.ClassDef):
            bases = [ast.unparse(b) for b in node.bases]
            doc = (ast.get_docstring(node) or "").split("\n\n")[0][:300]
            found.append(fact("definition", node.lineno, node.name, node.end_lineno, doc=doc or None, exported=exported("python", node.name, "")))
            found += python_model(node, bases)
        elif isinstance(node, ast.Call):
            f = node.func
            if isinstance(f, ast.Name):
                found.append(fact("call", node.lineno, f.id))
            elif isinstance(f, ast.Attribute):
                found.append(fact("call", node.lineno, f.attr, selector="true"))
        elif isinstance(node, ast.Import):
            found += [fact("import", node.lineno, a.name) for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            base = "." * node.level + (node.module or "")
            found.append(fact("import", node.lineno, base))
            found += [fact("import", node.lineno, base + ("" if base.endswith(".") else ".") + a.name, member="true") for a in node.names]
    return found + clients(text)


def python_routes(node: ast.FunctionDef | ast.AsyncFunctionDef) -> list[dict]:
    """Routes of decorators such as @app.get("/x") and @bp.route("/x", methods=[...])."""
    found = []
    for d in node.decorator_list:
        if not (isinstance(d, ast.Call) and isinstance(d.func, ast.Attribute) and d.args and isinstance(d.args[0], ast.Constant) and str(d.args[0].value).startswith("/")):
            continue
        verb, path = d.func.attr.lower(), str(d.args[0].value)
        if verb in VERBS and verb not in ("all", "use"):
            verbs = [verb.upper()]
        elif verb in ("route", "api_route"):
            listed = next((k.value for k in d.keywords if k.arg == "methods"), None)
            verbs = [str(e.value) for e in getattr(listed, "elts", [])] or ["GET"]
        else:
            continue
        found += [fact("route", d.lineno, f"{v} {path}", method=v, path=path, handlers=node.name) for v in verbs]
    return found


def python_model(node: ast.ClassDef, bases: list[str]) -> list[dict]:
    fields, table = [], None
    for s in node.body:
        target = s.targets[0] if isinstance(s, ast.Assign) else s.target if isinstance(s, ast.AnnAssign) else None
        if not isinstance(target, ast.Name):
            continue
        if target.id in ("__tablename__", "db_table") and isinstance(s.value, ast.Constant):
            table = str(s.value.value)
        elif isinstance(s.value, ast.Call) and re.search(r"(Column|Field|mapped_column|Key|relationship)$", ast.unparse(s.value.func)):
            renamed = s.value.args[0].value if s.value.args and isinstance(s.value.args[0], ast.Constant) and isinstance(s.value.args[0].value, str) else None
            fields.append(f"{target.id}→{renamed}" if renamed and renamed != target.id and "Column" in ast.unparse(s.value.func) else target.id)
    if table or fields and any(b.split("[")[0] in MODEL_BASES or b.rsplit(".", 1)[-1] in MODEL_BASES for b in bases):
        return [fact("model", node.lineno, node.name, node.end_lineno, table=table, fields=", ".join(fields[:50]), field_count=str(len(fields)))]
    return []


def clients(text: str) -> list[dict]:
    """HTTP requests that code makes: a verb, or fetch with a method option, and a quoted path."""
    found = []
    for m in CLIENT.finditer(text):
        option = re.search(r"method\s*[:=]\s*[\"'](\w+)", m["rest"] or "")
        verb = (m["verb"] or (option[1] if option else "")).upper()
        found.append(fact("client", line_at(text, m.start()), m["arg"].lstrip("f"), method=verb))
    return found


def parse_braces(language: str, text: str) -> list[dict]:
    found: list[dict] = []
    bare, lines = blanked(text), text.split("\n")
    for m in re.finditer(FUNCTION[language], bare, re.MULTILINE):
        name = next((v for k, v in m.groupdict().items() if k.startswith("name") and v), "")
        if not name or name in KEYWORDS:
            continue
        line, end = line_at(bare, m.start() + len(m[0]) - len(m[0].lstrip())), line_at(bare, block_end(bare, m.end() - 1 if m[0].endswith("{") else m.end()))
        head = lines[line - 1]
        body = "\n".join(lines[line - 1 : end])
        receiver = re.sub(r"^\w+\s+|[*\s]|\[.*", "", m["recv"]) if "recv" in m.groupdict() and m["recv"] else None
        found.append(fact("function", line, name, end, signature=head.strip().rstrip("{").strip(), doc=comment_before(lines, line) or None, exported=exported(language, name, head), receiver=receiver, body=body if end - line < 15 and len(body) <= 600 else None))
    for m in re.finditer(DEFINITION[language], bare, re.MULTILINE):
        line, end = line_at(bare, m.start() + len(m[0]) - len(m[0].lstrip())), line_at(bare, block_end(bare, m.end()))
        found.append(fact("definition", line, m["name"], end, doc=comment_before(lines, line) or None, exported=exported(language, m["name"], lines[line - 1])))
        found += brace_model(language, m, "\n".join(lines[max(0, line - 4) : end]), line, end)
    declared = {(f["line"], f["name"]) for f in found if f["kind"] == "function"}
    for m in CALL.finditer(bare):
        line = line_at(bare, m.start("name"))
        if m["name"] not in KEYWORDS and (line, m["name"]) not in declared:
            found.append(fact("call", line, m["name"], selector="true" if m["dot"] else None))
    found += [fact("import", line_at(text, m.start()), m["spec"]) for m in re.finditer(IMPORT[language], text, re.MULTILINE)]
    if language == "js":
        for m in EXPRESS.finditer(text):
            names = IDENT.findall(blanked(m["rest"] or ""))
            if m["rest"] and m["obj"] not in ("axios", "http", "client", "api", "request"):
                verb = "" if m["verb"] in ("all", "use") else m["verb"].upper()
                found.append(fact("route", line_at(text, m.start()), f"{verb or 'ANY'} {m['path']}", method=verb, path=m["path"], handlers=" ".join(names)))
    elif language == "go":
        for m in GO_ROUTE.finditer(text):
            chained = re.search(r"\.Methods\(\s*\"(\w+)\"", m["rest"])
            verb = m["m"] or (chained[1] if chained else "" if m["verb"].startswith("Handle") else m["verb"].upper())
            names = IDENT.findall(blanked(re.sub(r"\)\s*\.Methods.*", "", m["rest"])))
            found.append(fact("route", line_at(text, m.start()), f"{verb or 'ANY'} {m['path']}", method=verb, path=m["path"], handlers=" ".join(n.rsplit(".", 1)[-1] for n in names)))
    elif language in ("java", "kotlin", "csharp"):
        found += annotated_routes(text, found)
    return found + (clients(text) if language in ("js", "python") else [])


def annotated_routes(text: str, found: list[dict]) -> list[dict]:
    """Routes of annotated methods, with the path of the innermost class around them in front."""
    out, functions, classes = [], sorted((f for f in found if f["kind"] == "function"), key=lambda f: f["line"]), [f for f in found if f["kind"] == "definition"]
    lines = text.split("\n")
    for m in ANNOTATED.finditer(text):
        line = line_at(text, m.start())
        around = min((c for c in classes if c["line"] <= line <= c["end"]), key=lambda c: c["end"] - c["line"], default=None)
        prefix = ""
        if around:
            head = "\n".join(lines[max(0, around["line"] - 5) : around["line"]])
            p = re.search(r"(?:RequestMapping|Route)\(\s*(?:value\s*=\s*|path\s*=\s*)?\"([^\"]*)\"", head)
            prefix = (p[1] if p else "").replace("[controller]", around["name"].removesuffix("Controller").lower())
        verb = (m["verb"] or m["verb2"]).upper()
        path = "/" + "/".join(x.strip("/") for x in (prefix, m["path"] or "") if x.strip("/"))
        handler = next((f["name"] for f in functions if f["line"] >= line), "")
        out.append(fact("route", line, f"{verb} {path}", method=verb, path=path, handlers=handler))
    return out + [fact("client", line_at(text, m.start()), f'"/{m["path"].lstrip("/")}"', method=m["verb"]) for m in RETROFIT.finditer(text)]


def brace_model(language: str, m: re.Match, body: str, line: int, end: int) -> list[dict]:
    fields, table = [], None
    if language == "go":
        tags = re.findall(r"^\s*(\w+)\s+[^`\n]+`[^`]*\b(?:gorm|db|bun|xorm):\"([^\"]*)\"", body, re.MULTILINE)
        for name, tag in tags:
            column = re.search(r"column:(\w+)", tag)
            column = column[1] if column else tag if re.fullmatch(r"\w+", tag) else None
            fields.append(f"{name}→{column}" if column and column != name else name)
    elif language in ("java", "kotlin"):
        if re.search(r"@Entity\b", body):
            found = re.search(r"@Table\(\s*(?:name\s*=\s*)?\"([^\"]+)\"", body)
            table = found[1] if found else m["name"]
            fields = re.findall(r"(?:private|protected|va[lr])\s+(?:[\w<>]+\s+)?(\w+)\s*[;:=]", body)
    elif language == "js" and (m["base"] or "").rsplit(".", 1)[-1] in MODEL_BASES or language == "js" and "@Entity(" in body:
        found = re.search(r"tableName\s*[:=]\s*[\"'](\w+)|@Entity\([\"'](\w+)", body)
        table = next((g for g in (found.groups() if found else ()) if g), None)
        fields = re.findall(r"^\s+(?:@\w+\([^)]*\)\s*)?(?:declare\s+)?(\w+)[!?]?\s*:\s*\w", body, re.MULTILINE)
    elif language == "csharp":
        found = re.search(r"\[Table\(\"([^\"]+)\"", body)
        table = found[1] if found else None
        fields = re.findall(r"public\s+[\w<>?]+\s+(\w+)\s*\{\s*get;", body) if table or "[Key]" in body else []
    elif language == "swift" and re.search(r":\s*[^{]*\bModel\b", body.split("{")[0]):
        found = re.search(r"schema\s*=\s*\"([^\"]+)\"", body)
        table = found[1] if found else None
        fields = re.findall(r"var\s+(\w+)\s*:", body)
    if not fields and not table:
        return []
    return [fact("model", line, m["name"], end, table=table, fields=", ".join(fields[:50]), field_count=str(len(fields)))]


def parse_markdown(text: str) -> list[dict]:
    """Title, body without the first heading, and symbol tokens outside fences."""
    title, body, tokens, fenced = "", [], [], False
    for line in text.split("\n"):
        if line.lstrip().startswith("```"):
            fenced = not fenced
            continue
        if not title and line.startswith("#"):
            title = line.lstrip("#").strip()
            continue
        if line.strip():
            body.append(line.strip())
        if not fenced and len(tokens) < 100:
            tokens += [re.sub(r"\(\)$", "", t) for t in re.findall(r"`([^`\n]{1,80})`", line)]
    likely = [t for t in tokens if re.fullmatch(r"[A-Za-z_][\w./-]*", t) and not t.endswith("/") and t.upper() != t]
    return [fact("doc", 1, title, doc_body=" ".join(body)[:500])] + [fact("token", 1, t) for t in dict.fromkeys(likely)]


def only_scripts(text: str) -> str:
    """A template with all but the bodies of its inline scripts blanked, line ends kept."""
    out, at, low = [], 0, text.lower()
    blank = lambda x: re.sub(r"[^\n]", " ", x)
    while (begin := low.find("<script", at)) >= 0 and (open_ := low.find(">", begin)) >= 0 and (end := low.find("</script", open_)) >= 0:
        head = low[begin + 7 : open_]
        kind = re.search(r"type\s*=\s*[\"']([^\"']*)", head)
        mine = not re.search(r"\bsrc\s*=", head) and (kind is None or kind[1] in ("", "module") or "javascript" in kind[1])
        out += [blank(text[at : open_ + 1]), text[open_ + 1 : end] if mine else blank(text[open_ + 1 : end])]
        at = end
    return "".join([*out, blank(text[at:])])


def form_requests(text: str) -> list[dict]:
    """Requests that the forms of a template send: their action, by their method."""
    found = []
    for m in re.finditer(r"<form\b([^>]*)>", text, re.IGNORECASE):
        own = {k.lower(): v for k, v in re.findall(r"([\w-]+)\s*=\s*[\"']([^\"']*)[\"']", m[1])}
        if own.get("action", "").startswith("/"):
            found.append(fact("client", line_at(text, m.start()), f'"{own["action"]}"', method=own.get("method", "get").upper()))
    return found


def parse_file(path: str, data: bytes) -> list[dict]:
    """All facts of a file, the file itself first."""
    suffix = "." + path.rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else ""
    text = data.decode("utf-8", "replace")
    head = fact("file", 1, path, text.count("\n") + 1, hash=content_hash(data) if len(data) <= 2 << 20 else None, generated="true" if re.search(r"DO NOT EDIT|@generated", text[:2048]) else None)
    if b"\0" in data[:512] or len(data) > 2 << 20:
        return [head]
    if suffix == ".py":
        return [head, *parse_python(text)]
    if suffix in LANGUAGES:
        return [head, *parse_braces(LANGUAGES[suffix], text)]
    if suffix in (".md", ".mdx"):
        return [head, *parse_markdown(text)]
    if suffix in TEMPLATES and len(data) <= 1 << 20:
        return [head, *parse_braces("js", only_scripts(text)), *form_requests(text)]
    return [head]
