"""Source parsers: symbols and raw references of one file. Plain Python, run inside Arrow batches.

A language's parser gives (name, kind, start_line, end_line) rows. The registry is the
extension point: ``register`` adds or replaces a language. Kotlin and Swift are parsed by
patterns and braces, without a grammar."""

from __future__ import annotations

import ast
import posixpath
import re
from collections.abc import Callable, Iterator

Symbol = tuple[str, str, int, int]

IDENT = r"[A-Za-z_][A-Za-z0-9_]*"
JS_IDENT = r"[A-Za-z_$][A-Za-z0-9_$]*"
#: Declaration patterns by language, tried in order on each line: (kind, pattern); a kind of "" is taken from the pattern.
JAVA_TYPE = rf"^\s*(?:public\s+|private\s+|protected\s+)?(?:abstract\s+|final\s+)?(?P<kind>class|interface|enum|record)\s+(?P<name>{IDENT})"
JAVA_CONSTRUCTOR = rf"^\s*(?:public|private|protected)\s+(?P<name>{IDENT})\s*\([^;]*\)\s*(?:throws\s+[^{{]+)?(?:\{{.*)?$"
JAVA_METHOD = rf"^\s*(?:public|private|protected)?\s*(?:static\s+)?(?:[A-Za-z_][A-Za-z0-9_<>\[\]?]*\s+)+(?P<name>{IDENT})\s*\([^;]*\)\s*(?:throws\s+[^{{]+)?(?:\{{.*)?$"
DECLARATIONS = {
    "java": (("", JAVA_TYPE), ("constructor", JAVA_CONSTRUCTOR), ("method", JAVA_METHOD)),
    "javascript": (
        ("function", rf"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s+(?P<name>{JS_IDENT})"),
        ("function", r"^\s*export\s+default\s+(?:async\s+)?function\s*\("),
        ("class", rf"^\s*(?:export\s+)?(?:default\s+)?class\s+(?P<name>(?!extends\b){JS_IDENT})"),
        ("interface", rf"^\s*(?:export\s+)?interface\s+(?P<name>{JS_IDENT})"),
        ("class", r"^\s*export\s+default\s+class\s*(?:extends\s+[A-Za-z_$][A-Za-z0-9_$.]*)?\s*\{?"),
        ("function", rf"^\s*(?:export\s+)?(?:const|let|var)\s+(?P<name>{JS_IDENT})\s*(?::[^=]+)?=\s*(?:async\s+)?(?:\([^)]*\)|{JS_IDENT})\s*(?::[^=]+)?=>"),
        ("function", rf"^\s*export\s+default\s+(?:async\s+)?(?:\([^)]*\)|{JS_IDENT})\s*=>"),
        ("function", rf"^\s*(?:export\s+)?(?:const|let|var)\s+(?P<name>{JS_IDENT})\s*=\s*styled(?:\.{JS_IDENT}|\s*\()"),
        ("function", rf"^\s*export\s+default\s+(?:memo|withRouter)\(\s*(?P<name>{JS_IDENT})\s*\)"),
        ("method", rf"^\s*(?:public\s+|private\s+|protected\s+)?(?:readonly\s+)?(?:static\s+)?(?:async\s+)?(?:get\s+|set\s+)?(?P<name>{JS_IDENT})\s*\([^;]*\)\s*(?::\s*[^\{{]+)?\s*(?:\{{.*)?$"),
    ),
    "fallback": (("", rf"^\s*(?P<kind>def|class)\s+(?P<name>{IDENT})"), ("function", rf"^\s*function\s+(?P<name>{IDENT})")),
}
#: Words that look like calls or declarations but are control flow.
CONTROL_WORDS = {"java": ("if", "for", "while", "switch", "catch", "return", "new", "throw", "synchronized"), "javascript": ("if", "for", "while", "switch", "catch", "function")}
FALLBACK_WINDOW = 30
BRACE_WINDOW = 12
UNBALANCED_LINES = 100

#: Comments and quoted strings (skipped), braces and line ends.
_LEXEME = re.compile(r"""//[^\n]*|/\*.*?(?:\*/|\Z)|"(?:\\.|[^"\\\n])*"?|'(?:\\.|[^'\\\n])*'?|[{}\n]""", re.S)


def lines_of(content: str) -> list[str]:
    return content.splitlines()


class Braces:
    """Where the code braces of a source stand."""

    def __init__(self, content: str):
        self.events: list[tuple[int, str]] = []
        line = 1
        for found in _LEXEME.finditer(content):
            text = found.group()
            if text in "{}":
                self.events.append((line, text))
            line += text.count("\n")
        self.lines = max(1, len(content.splitlines()))

    def end(self, start: int, window: int = BRACE_WINDOW) -> int:
        """The line on which the block that opens at most window lines after start closes."""
        at = next((i for i, (line, b) in enumerate(self.events) if line >= start and b == "{"), None)
        if at is None or self.events[at][0] > start + window:
            return start
        opened = self.events[at][0]
        at = next(i for i, (line, _) in enumerate(self.events) if line >= opened)
        depth = 0
        for line, b in self.events[at:]:
            depth += 1 if b == "{" else -1
            if depth == 0 and b == "}":
                return line
        return min(self.lines, opened + UNBALANCED_LINES)


    def depths(self) -> list[int]:
        """How many braces are open where each line begins; the first entry stands for no line."""
        change = [0] * (self.lines + 3)
        for line, b in self.events:
            change[min(line + 1, self.lines + 2)] += 1 if b == "{" else -1
        out, depth = [], 0
        for c in change:
            depth += c
            out.append(max(0, depth))
        return out


def python_symbols(content: str, path: str = "") -> list[Symbol]:
    """Classes and functions by syntax tree; a function anywhere inside a class is a method. None if the source does not parse."""
    try:
        tree = ast.parse(content)
    except (SyntaxError, ValueError, RecursionError):
        return []
    out: list[Symbol] = []
    todo: list[tuple[ast.AST, bool]] = [(tree, False)]
    while todo:
        node, inside = todo.pop()
        for child in ast.iter_child_nodes(node):
            below = inside
            if isinstance(child, ast.ClassDef):
                out.append((child.name, "class", child.lineno, child.end_lineno or child.lineno))
                below = True
            elif isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                out.append((child.name, "method" if inside else "function", child.lineno, child.end_lineno or child.lineno))
            todo.append((child, below))
    return sorted(out, key=lambda s: (s[2], s[0]))


def _default_name(path: str) -> str:
    """The name of a file's unnamed default export: its stem, or its folder for index files."""
    stem = posixpath.splitext(posixpath.basename(path or ""))[0]
    if stem == "index":
        stem = posixpath.basename(posixpath.dirname(path)) or stem
    return re.sub(r"[^A-Za-z0-9_$]", "_", stem) or "default"


def _by_patterns(language: str) -> Callable[[str, str], list[Symbol]]:
    patterns = [(kind, re.compile(p)) for kind, p in DECLARATIONS[language]]
    barred = set(CONTROL_WORDS[language])

    def parse(content: str, path: str = "") -> list[Symbol]:
        braces, out = Braces(content), []
        for n, line in enumerate(lines_of(content), 1):
            for kind, pattern in patterns:
                found = pattern.match(line)
                if not found:
                    continue
                groups = found.groupdict()
                name = groups.get("name") or _default_name(path)
                if kind != "method" or name.lower() not in barred:
                    out.append((name, kind or groups["kind"], n, braces.end(n)))
                break
        return out

    return parse


def fallback_symbols(content: str, path: str = "") -> list[Symbol]:
    """def, class and function lines of any text, each with a fixed window of lines."""
    total, out = len(lines_of(content)), []
    for n, line in enumerate(lines_of(content), 1):
        for kind, pattern in DECLARATIONS["fallback"]:
            found = re.match(pattern, line)
            if found:
                out.append((found["name"], kind or ("class" if found["kind"] == "class" else "function"), n, max(n, min(total, n + FALLBACK_WINDOW))))
                break
    return out


#: Attributes and annotations that may stand before a declaration on its line.
_MARKS = r"(?:@[A-Za-z_][A-Za-z0-9_.]*(?:\([^)]*\))?\s+)*"
KOTLIN_TYPE = re.compile(rf"^\s*{_MARKS}(?:(?:public|private|internal|protected|abstract|open|sealed|data|inner|annotation|value|enum)\s+)*(class|interface|object)\s+({IDENT})")
KOTLIN_FUN = re.compile(rf"^\s*{_MARKS}(?:(?:public|private|internal|protected|abstract|open|override|suspend|inline|operator|infix|tailrec)\s+)*fun\s+(?:<[^>]*>\s*)?(?:[A-Za-z_][A-Za-z0-9_<>?.]*\.)?({IDENT})\s*\(")
SWIFT_TYPE = re.compile(rf"^\s*{_MARKS}(?:(?:public|private|internal|fileprivate|open|final|indirect)\s+)*(class|struct|enum|protocol|actor|extension)\s+(?!func\b|var\b|let\b)({IDENT})")
SWIFT_FUN = re.compile(rf"^\s*{_MARKS}(?:(?:public|private|internal|fileprivate|open|final|static|class|override|mutating)\s+)*func\s+({IDENT})")


def _nested(content: str, type_pattern: re.Pattern, fun_pattern: re.Pattern, maker: str) -> list[Symbol]:
    """Types and functions at the top of a file, and the methods and constructors right inside such types, as a syntax
    tree's first two levels give them; maker: the pattern of constructors inside types."""
    braces, out, types = Braces(content), [], []
    depth, lines = braces.depths(), lines_of(content)

    def end(n: int) -> int:
        """Where a function ends: on its own line if the next block belongs to another declaration, or one closes first."""
        line, b = next(((x, b) for x, b in braces.events if x >= n), (n, "}"))
        other = b == "}" or any(type_pattern.match(x) or fun_pattern.match(x) for x in lines[n:line])
        return n if other else braces.end(n)

    for n, line in enumerate(lines, 1):
        types = [t for t in types if t[1] >= n]
        level = depth[n]
        if level == 0 and (found := type_pattern.match(line)) is not None:
            kind = {"object": "class", "actor": "class", "extension": "class"}.get(found[1], found[1])
            if re.search(r"\benum\s+class\b", line):
                kind = "enum"
            last = braces.end(n)
            out.append((found[2], kind, n, last))
            types.append((found[2], last))
        elif level == 0 or (level == 1 and types):
            if (found := fun_pattern.match(line)) is not None:
                out.append((found[1], "method" if level else "function", n, end(n)))
            elif level and re.match(maker, line):
                out.append((types[-1][0], "constructor", n, braces.end(n)))
    return sorted(out, key=lambda s: (s[2], s[0]))


def kotlin_symbols(content: str, path: str = "") -> list[Symbol]:
    return _nested(content, KOTLIN_TYPE, KOTLIN_FUN, r"^\s*(?:(?:public|private|internal|protected)\s+)?constructor\s*\(")


def swift_symbols(content: str, path: str = "") -> list[Symbol]:
    return _nested(content, SWIFT_TYPE, SWIFT_FUN, r"^\s*(?:(?:public|private|internal|convenience|required|override)\s+)*init[?!]?\s*\(")


REGISTRY: dict[str, Callable[[str, str], list[Symbol]]] = {
    "python": python_symbols,
    "java": _by_patterns("java"),
    "javascript": _by_patterns("javascript"),
    "kotlin": kotlin_symbols,
    "swift": swift_symbols,
}
REGISTRY |= {alias: REGISTRY["javascript"] for alias in ("typescript", "js", "ts")}


def register(language: str, parser: Callable[[str, str], list[Symbol]]) -> None:
    """Adds or replaces the parser of a language."""
    REGISTRY[language.strip().lower()] = parser


def parser_of(language: str | None) -> Callable[[str, str], list[Symbol]]:
    return REGISTRY.get((language or "").strip().lower(), fallback_symbols)


def json_keys(content: str, limit: int = 40) -> list[Symbol]:
    """The first top-level keys of a JSON object with the lines of their values."""
    import json

    try:
        payload = json.loads(content)
    except (ValueError, RecursionError):
        return []
    lines, out = lines_of(content), []
    for key in list(payload)[:limit] if isinstance(payload, dict) else []:
        quoted = re.compile(f'"{re.escape(key)}"\\s*:')
        start = next((n for n, line in enumerate(lines, 1) if quoted.search(line)), 1)
        out.append((key, "config_key", start, _value_end(lines, start)))
    return out


def _value_end(lines: list[str], start: int) -> int:
    """The line on which the bracketed value that a key line opens is closed; the key line itself for plain values."""
    depth, opened = 0, False
    for n in range(start, len(lines) + 1):
        bare = re.sub(r'"(?:\\.|[^"\\])*"', "", lines[n - 1])
        opened = opened or bool(re.search(r"[\[{]", bare))
        depth += len(re.findall(r"[\[{]", bare)) - len(re.findall(r"[\]}]", bare))
        if not opened or depth <= 0:
            return n
    return min(len(lines), start + 5)


def python_docstring(content: str) -> str | None:
    try:
        return ast.get_docstring(ast.parse(content))
    except (SyntaxError, ValueError, RecursionError):
        return None


def first_python_definition(content: str) -> tuple[str, str] | None:
    """(kind, name) of the first top-level class or function."""
    try:
        body = ast.parse(content).body
    except (SyntaxError, ValueError, RecursionError):
        return None
    for node in body:
        if isinstance(node, ast.ClassDef):
            return "class", node.name
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            return "function", node.name
    return None


def named_spans(content: str, name: str, path: str) -> list[tuple[int, int]]:
    """The spans at which a source defines a name: by syntax tree for Python, by declaration patterns and braces else."""
    parser = python_symbols if path.endswith(".py") else REGISTRY["java"] if path.endswith((".java", ".cs")) else REGISTRY["javascript"]
    return [(start, end) for n, _, start, end in parser(content, path) if n == name]


# Raw references -------------------------------------------------------------------------------------------------


def relative_module(path: str, level: int, module: str | None, name: str) -> str | None:
    """The dotted name that a relative Python import means."""
    own = python_module(path)
    if not own:
        return None
    parts = own.split(".")
    if not path.endswith("/__init__.py"):
        parts = parts[:-1]
    up = max(level - 1, 0)
    if up > len(parts):
        return None
    found = [p for p in [*parts[: len(parts) - up], *(module or "").split("."), name] if p]
    return ".".join(found) or None


def python_module(path: str) -> str:
    """The dotted module name of a Python path; empty for others."""
    plain = posixpath.normpath(path.replace("\\", "/")).lstrip("./")
    if not plain.endswith(".py"):
        return ""
    return re.sub(r"/__init__$", "", plain[:-3]).replace("/", ".")


def _dotted(node: ast.AST) -> str | None:
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute):
        before = _dotted(node.value)
        return f"{before}.{node.attr}" if before else node.attr
    if isinstance(node, ast.Call):
        return _dotted(node.func)
    return _dotted(node.value) if isinstance(node, ast.Subscript) else None


def _imported(node: ast.AST, path: str) -> Iterator[tuple[str, str]]:
    """(local name, full name) that an import statement binds."""
    for alias in node.names:
        if isinstance(node, ast.Import):
            yield alias.asname or alias.name.split(".")[0], alias.name
        elif alias.name != "*":
            full = relative_module(path, node.level, node.module, alias.name) if node.level else f"{node.module}.{alias.name}" if node.module else alias.name
            if full:
                yield alias.asname or alias.name, full


#: (owner name, owner line, relation, reference, bound reference, line, confidence); owner line 0 for file imports
Reference = tuple[str, int, str, str, str | None, int, float]


def python_references(content: str, path: str) -> list[Reference]:
    """Calls, imports and base classes inside symbols with what import bindings make of them, and the file's own imports."""
    try:
        tree = ast.parse(content)
    except (SyntaxError, ValueError, RecursionError):
        return []
    out: list[Reference] = []

    def bound(ref: str, scope: dict[str, str]) -> str | None:
        root, _, rest = ref.partition(".")
        return None if root not in scope else f"{scope[root]}.{rest}" if rest else scope[root]

    def visit(node: ast.AST, owner: tuple[str, int] | None, scope: dict[str, str]) -> None:
        for child in ast.iter_child_nodes(node):
            own, names = owner, scope
            if isinstance(child, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)):
                own, names = (child.name, child.lineno), dict(scope)
                for base in getattr(child, "bases", []):
                    ref = _dotted(base)
                    if ref:
                        out.append((*own, "EXTENDS", ref, bound(ref, names), base.lineno, 0.95))
            elif isinstance(child, (ast.Import, ast.ImportFrom)):
                for local, full in _imported(child, path):
                    scope[local] = full
                    if owner:
                        out.append((*owner, "IMPORTS", full, bound(full, scope), child.lineno, 0.8))
            elif isinstance(child, ast.Call) and owner:
                ref = _dotted(child.func)
                if ref:
                    out.append((*owner, "CALLS", ref, bound(ref, names), child.lineno, 0.9))
            visit(child, own, names)

    top: dict[str, str] = {}
    for node in tree.body:
        if isinstance(node, (ast.Import, ast.ImportFrom)):
            for local, full in _imported(node, path):
                top[local] = full
                out.append(("", 0, "FILE_IMPORT", full, None, node.lineno, 1.0))
    try:
        visit(tree, None, top)
    except RecursionError:
        return []
    return out


#: Reference patterns of Java, JavaScript, TypeScript, Kotlin and Swift.
JAVA_IMPORT = re.compile(r"^\s*import\s+(static\s+)?([A-Za-z_][A-Za-z0-9_\.\*]*)\s*;")
JAVA_PACKAGE = re.compile(r"^\s*package\s+([A-Za-z_][A-Za-z0-9_\.]*)\s*;")
JAVA_HEAD = re.compile(
    rf"^\s*(?:public\s+|private\s+|protected\s+)?(?:abstract\s+|final\s+|sealed\s+|non-sealed\s+|static\s+)*(class|interface|enum|record)\s+({IDENT})(?:\s+extends\s+([^\{{]+?))?(?:\s+implements\s+([^\{{]+?))?\s*(?:\{{|$)"
)
JAVA_CALL = re.compile(rf"(?:{IDENT}\s*\.\s*)?({IDENT})\s*\(")
JAVA_NO_CALLS = set("if for while switch catch return new throw synchronized super this".split())
JS_IMPORT = re.compile(r"^\s*import\s+(?:type\s+)?(?:.+?\s+from\s+)?['\"]([^'\"]+)['\"]")
JS_HEAD = re.compile(rf"^\s*(?:export\s+)?(?:default\s+)?class\s+({JS_IDENT})(?:\s+extends\s+({JS_IDENT}))?(?:\s+implements\s+([^\{{]+))?")
TS_INTERFACE = re.compile(rf"^\s*(?:export\s+)?interface\s+({JS_IDENT})(?:\s+extends\s+([^\{{]+))?")
JS_CALL = re.compile(rf"({JS_IDENT}(?:\s*\.\s*{JS_IDENT})?)\s*\(")
TS_FUNCTION = re.compile(rf"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s+({JS_IDENT})\s*\(")
TS_JSX = re.compile(r"<([A-Z][A-Za-z0-9_$]*)(?:\.[A-Z][A-Za-z0-9_$]*)?\b")
JS_NO_CALLS = set("if for while switch catch return new throw function".split())
KOTLIN_IMPORT = re.compile(r"^\s*import\s+([A-Za-z_][\w.]*(?:\.\*)?)(?:\s+as\s+(\w+))?")
KOTLIN_PACKAGE = re.compile(r"^\s*package\s+([A-Za-z_][\w.]*)")
KOTLIN_HEAD = re.compile(rf"^\s*(?:\w+\s+)*?(class|interface|object)\s+{IDENT}[^:{{]*(?:\([^)]*\))?\s*:\s*([^{{]+)")
SWIFT_IMPORT = re.compile(r"^\s*(?:@\w+\s+)?import\s+(?:class\s+|struct\s+|enum\s+|protocol\s+|func\s+)?([A-Za-z_][\w.]*)")
SWIFT_HEAD = re.compile(rf"^\s*(?:\w+\s+)*?(class|struct|enum|protocol|actor|extension)\s+{IDENT}(?:<[^>]*>)?\s*:\s*([^{{]+)")


def _types(listed: str | None) -> list[str]:
    """Simple names of a comma-separated list of types."""
    bare = re.sub(r"<[^<>]*>", "", re.sub(r"<[^<>]*>", "", listed or ""))
    names = (re.sub(r"[?\s]|\(.*", "", part).split(".")[-1] for part in bare.split(","))
    return [n for n in names if n]


def line_references(content: str, path: str, language: str) -> list[Reference]:
    """References of languages that are read line by line; the owner is found by line afterwards."""
    out: list[Reference] = []
    add = lambda kind, ref, n, sure: out.append(("", n, kind, ref, None, n, sure))
    declared = [re.compile(p) for p in (JAVA_CONSTRUCTOR, JAVA_METHOD)]
    for n, line in enumerate(lines_of(content), 1):
        if language == "java":
            if (m := JAVA_IMPORT.match(line)) is not None:
                add("IMPORTS", m[2], n, 0.8)
                add("FILE_IMPORT", m[2], n, 1.0)
            if (m := JAVA_HEAD.match(line)) is not None:
                for name in _types(m[3]):
                    add("EXTENDS", name, n, 0.95)
                for name in _types(m[4]) if m[1] == "class" else []:
                    add("IMPLEMENTS", name, n, 0.95)
            if not m and not any(p.match(line) for p in declared):
                for call in JAVA_CALL.finditer(line):
                    if call[1].lower() not in JAVA_NO_CALLS:
                        add("CALLS", call[1], n, 0.75)
        elif language in ("javascript", "js", "typescript", "ts"):
            typed = language in ("typescript", "ts")
            if (m := JS_IMPORT.match(line)) is not None:
                add("IMPORTS", m[1].strip(), n, 0.8)
                add("FILE_IMPORT", m[1].strip(), n, 1.0)
            if (m := JS_HEAD.match(line)) is not None:
                if m[2]:
                    add("EXTENDS", m[2], n, 0.95)
                for name in _types(m[3]) if typed else []:
                    add("IMPLEMENTS", name, n, 0.95)
            if typed and (m := TS_INTERFACE.match(line)) is not None:
                for name in _types(m[2]):
                    add("EXTENDS", name, n, 0.95)
            own = TS_FUNCTION.match(line) if typed else None
            for call in JS_CALL.finditer(line):
                ref = re.sub(r"\s+", "", call[1])
                if ref.lower() not in JS_NO_CALLS and not (own and ref == own[1]):
                    add("CALLS", ref, n, 0.75)
            for tag in TS_JSX.finditer(line) if typed and path.endswith("x") else ():
                add("CALLS", tag[1], n, 0.72)
        elif language in ("kotlin", "swift"):
            imports, head = (KOTLIN_IMPORT, KOTLIN_HEAD) if language == "kotlin" else (SWIFT_IMPORT, SWIFT_HEAD)
            if (m := imports.match(line)) is not None:
                add("IMPORTS", m[1], n, 0.95)
                add("FILE_IMPORT", m[1], n, 1.0)
                continue
            if (m := head.match(line)) is not None:
                for part in re.split(r",(?![^<(]*[>)])", m[2]):
                    for name in _types(part):
                        extends = m[1] in ("interface", "protocol") or (language == "kotlin" and "(" in part) or (language == "swift" and m[1] == "class")
                        add("EXTENDS" if extends else "IMPLEMENTS", name, n, 0.95)
                continue
            if not (KOTLIN_FUN if language == "kotlin" else SWIFT_FUN).match(line):
                for call in JAVA_CALL.finditer(line):
                    if call[1].lower() not in JAVA_NO_CALLS:
                        add("CALLS", call[1], n, 0.8)
    return out


def references(content: str, path: str, language: str) -> list[Reference]:
    return python_references(content, path) if language == "python" else line_references(content, path, language)


#: (kind, local name, full name): what a file's import lines bind
Binding = tuple[str, str, str]


def package_of(content: str, language: str) -> str | None:
    pattern, most = (JAVA_PACKAGE, 80) if language == "java" else (KOTLIN_PACKAGE, 40)
    return next((m[1] for m in map(pattern.match, lines_of(content)[:most]) if m), None)


def import_bindings(content: str, language: str) -> list[Binding]:
    """Java and Kotlin imports by kind: single, wildcard, static member and static wildcard."""
    out: list[Binding] = []
    for line in lines_of(content):
        if language == "java" and (m := JAVA_IMPORT.match(line)) is not None:
            static, full = bool(m[1]), m[2].strip()
            if full.endswith(".*"):
                out.append(("static_wildcard" if static else "wildcard", "", full[:-2]))
            elif static and "." in full:
                out.append(("static", full.rsplit(".", 1)[1], full.rsplit(".", 1)[0]))
            elif not static:
                out.append(("single", full.split(".")[-1], full))
        elif language == "kotlin" and (m := KOTLIN_IMPORT.match(line)) is not None:
            out.append(("wildcard", "", m[1][:-2]) if m[1].endswith(".*") else ("single", m[2] or m[1].split(".")[-1], m[1]))
    return out


def js_bindings(content: str) -> list[tuple[str, str, str]]:
    """(local name, exported name, module) that import lines bind; an exported name of * is a namespace."""
    out = []
    for line in lines_of(content):
        m = JS_IMPORT.match(line)
        if not m:
            continue
        clause = re.sub(r"^\s*import(?:\s+type)?", "", line.split("from", 1)[0]).strip()
        namespace = re.match(rf"^\*\s+as\s+({JS_IDENT})$", clause)
        if namespace:
            out.append((namespace[1], "*", m[1].strip()))
            continue
        for part in (re.search(r"\{([^}]*)\}", clause) or ["", ""])[1].split(","):
            names = [x.strip() for x in part.split(" as ", 1)]
            if names[0]:
                out.append((names[-1], names[0], m[1].strip()))
        default = clause.split(",", 1)[0].strip()
        if default and default[0] not in "{'\"":
            out.append((default, "default", m[1].strip()))
    return out


def js_exports(content: str) -> list[tuple[str, str, str, int]]:
    """(kind, exported name, source name or module, line): own names, lists, re-exports, star re-exports and defaults."""
    out = []
    named = re.compile(rf"^\s*export\s+(default\s+)?(?:async\s+)?(?:function|class|interface|const|let|var)\s+({JS_IDENT})")
    for n, line in enumerate(lines_of(content), 1):
        if (m := re.match(r"^\s*export\s*(?:\{([^}]*)\}|(\*))\s*from\s*['\"]([^'\"]+)['\"]", line)) is not None:
            if m[2]:
                out.append(("star", "*", m[3], n))
            for part in (m[1] or "").split(","):
                names = [x.strip() for x in part.split(" as ", 1)]
                if names[0]:
                    out.append(("reexport", names[-1], f"{names[0]}|{m[3]}", n))
        elif (m := re.match(r"^\s*export\s*\{([^}]*)\}", line)) is not None:
            for part in m[1].split(","):
                names = [x.strip() for x in part.split(" as ", 1)]
                if names[0]:
                    out.append(("own", names[-1], names[0], n))
        elif (m := named.match(line)) is not None:
            out.append(("own", m[2], m[2], n))
            if m[1]:
                out.append(("own", "default", m[2], n))
        elif re.match(r"^\s*export\s+default\b", line):
            out.append(("default_line", "default", "", n))
    return out
