"""Functions, imports and runtime hazards of source texts, by tolerant lexers.

No grammar library is needed: comments and strings are blanked out, then Python and
Ruby are read by indentation and the brace languages by their braces. Broken code
gives what can be read of it. ``strict_compat`` adds rows that a syntax tree's node
kinds would (an anonymous row for each decorated Python definition and each Rust
impl block, C names unknown).
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from .. import lookups as L

ANONYMOUS = "<anonymous>"
_JS = ("JavaScript", "JSX", "TypeScript", "TSX")
_SCHEMA = (
    "repo_id string, path string, functions array<struct<name:string,start_line:int,line_count:int,complexity:int,nesting:int>>, "
    "imports array<struct<module_path:string,line:int>>, hazards array<struct<kind:string,line:int>>"
)
Function = tuple[str, int, int, int, int]

_BLANK = {
    "Python": re.compile(r"\"\"\".*?(?:\"\"\"|\Z)|'''.*?(?:'''|\Z)|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|#[^\n]*", re.S),
    "Ruby": re.compile(r"^=begin.*?^=end|\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'|#[^\n]*", re.S | re.M),
    "Rust": re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\\n])'", re.S),
    "Go": re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\\n])*\"|`[^`]*`|'(?:\\.|[^'\\\n])+'", re.S),
    "PHP": re.compile(r"//[^\n]*|#(?!\[)[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'", re.S),
    "": re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`", re.S),
}


_JS_TOKEN = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|[`{}/]|[\w$]+|\s+|.", re.S)
_JS_REGEX = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*")
_JS_TEMPLATE = re.compile(r"(?:\\.|[^`\\$]|\$(?!\{))*(?:`|\$\{|\Z)", re.S)
#: After these a slash starts a regular expression.
_BEFORE_REGEX = frozenset("return typeof case in of delete void throw new instanceof do else yield await".split())


def _spaces(text: str) -> str:
    return re.sub(r"[^\n]", " ", text)


def _blank_js(text: str) -> str:
    """As ``blank``; regular expressions are told from divisions by what precedes them, and code inside template strings stays."""
    out, at, last, braces = [], 0, "", []
    while m := _JS_TOKEN.match(text, at):
        x = m.group()
        at = m.end()
        if x == "`" or (x == "}" and braces and braces[-1] == "`"):
            if x == "}":
                braces.pop()
            rest = _JS_TEMPLATE.match(text, at)
            out.append(_spaces(text[m.start() : rest.end()]))
            at, last = rest.end(), ")"
            if rest.group().endswith("${"):
                braces.append("`")
                last = "("
            continue
        if x == "/" and (last in _BEFORE_REGEX or not last or last[-1] in "(,=:[!&|?{};+-*%~^<>") and (r := _JS_REGEX.match(text, m.start())):
            out.append(_spaces(r.group()))
            at, last = r.end(), ")"
            continue
        if x == "{":
            braces.append("{")
        elif x == "}" and braces:
            braces.pop()
        if x[:2] in ("//", "/*") or x[0] in "\"'" and len(x) > 1:
            out.append(_spaces(x))
            last = last if x[0] == "/" else ")"
        else:
            out.append(x)
            last = last if x.isspace() else x
    return "".join(out)


def blank(language: str, text: str) -> str:
    """The text with comments, and what stands between quotes, as spaces; lines and places stay."""
    return _blank_js(text) if language in _JS else _BLANK.get(language, _BLANK[""]).sub(lambda m: _spaces(m.group()), text)


class _Lines:
    def __init__(self, text: str):
        self.starts = [0, *(m.end() for m in re.finditer("\n", text))]

    def at(self, place: int) -> int:
        return bisect_right(self.starts, place)


#: Statements by their line, and every ``else`` that no colon follows, as each conditional expression has one.
_PY_BRANCH = re.compile(r"^[ \t]*(?:async[ \t]+)?(?:if|elif|for|while|with|except(?![ \t]*\*))\b|\b(?:and|or)\b|\belse\b(?![ \t]*:)", re.M)
_PY_NEST = re.compile(r"^([ \t]*)(?:async[ \t]+)?(?:if|for|while|with|try)\b", re.M)


def _indent(line: str) -> int:
    return len(line.expandtabs(8)) - len(line.expandtabs(8).lstrip())


def _block_end(lines: list[str], first: int) -> int:
    """Index of the last line of the block that the definition at ``first`` opens."""
    own, last, depth = _indent(lines[first]), first, 0
    for i in range(first, len(lines)):
        line = lines[i]
        if i > first and line.strip() and depth <= 0 and _indent(line) <= own and not line.lstrip().startswith((")", "]", "}")):
            break
        depth += sum(line.count(c) for c in "([{") - sum(line.count(c) for c in ")]}")
        if line.strip():
            last = i
    return last


def _python_functions(text: str, clean: str, strict: bool) -> Iterator[Function]:
    lines = clean.split("\n")
    for i, line in enumerate(lines):
        if not (m := re.match(r"[ \t]*(?:async[ \t]+)?def[ \t]+(\w+)", line)):
            if strict and re.match(r"[ \t]*@\w", line) and not (i and re.match(r"[ \t]*@\w", lines[i - 1])):
                d = next((j for j in range(i, len(lines)) if re.match(r"[ \t]*(?:async[ \t]+)?(?:def|class)\b", lines[j])), None)
                if d is not None:
                    end = _block_end(lines, d)
                    yield (ANONYMOUS, i + 1, end - i + 1, *_python_measures("\n".join(lines[i : end + 1])))
            continue
        end = _block_end(lines, i)
        yield (m.group(1), i + 1, end - i + 1, *_python_measures("\n".join(lines[i : end + 1])))


def _logical(body: str) -> str:
    """``body`` with the line ends inside brackets, and escaped ones, as spaces."""
    depth, out = 0, []
    for x in re.split(r"([(\[{)\]}\n])", body.replace("\\\n", "  ")):
        if x in ("(", "[", "{"):
            depth += 1
        elif x in (")", "]", "}"):
            depth = max(0, depth - 1)
        out.append(" " if x == "\n" and depth else x)
    return "".join(out)


def _python_measures(body: str) -> tuple[int, int]:
    most, open_, body = 0, [], _logical(body)
    for line in body.split("\n"):
        if line.strip():
            at = _indent(line)
            word = re.match(r"\s*(\w+)", line)
            if not (word and word.group(1) in ("elif", "else", "except", "finally")):
                while open_ and open_[-1] >= at:
                    open_.pop()
            if _PY_NEST.match(line):
                open_.append(at)
                most = max(most, len(open_))
    return 1 + len(_PY_BRANCH.findall(body)), most


_RB_BRANCH = re.compile(r"\b(?:if|elsif|unless|while|for|case|when|rescue)\b")


def _ruby_functions(clean: str, strict: bool) -> Iterator[Function]:
    twice = 1 + strict  # a tree's keyword tokens have the names of the statements they start
    lines = clean.split("\n")
    for i, line in enumerate(lines):
        if m := re.match(r"([ \t]*)def\s+(?:self\.)?([\w?!=]+)", line):
            own = _indent(line)
            end = next((j for j in range(i + 1, len(lines)) if re.match(r"\s*end\b", lines[j]) and _indent(lines[j]) <= own), len(lines) - 1)
            body, open_, most = lines[i : end + 1], [], 0
            for x in body[1:]:
                if x.strip():
                    while open_ and open_[-1] >= _indent(x) and not re.match(r"\s*(?:elsif|else|when|rescue|ensure)\b", x):
                        open_.pop()
                    if re.match(r"\s*(?:if|unless|while|for|case|begin)\b", x):
                        open_.append(_indent(x))
                        most = max(most, len(open_))
            yield (m.group(2), i + 1, end - i + 1, 1 + twice * len(_RB_BRANCH.findall("\n".join(body))), most + (strict and most > 0))


_NOT_NAMES = frozenset("if for while switch catch return else do try function with synchronized new throw sizeof match await typeof case elseif foreach".split())
_HEAD = {
    "JS": re.compile(r"\bfunction\s*\*?\s*(?P<a>\w*)\s*(?:<[^>]*>)?\([^{};]*\)[^{};=()]*\{|(?<![\w.])(?P<b>[#\w$]+)\s*(?:<[^<>]*>)?\((?P<p>[^(){};]*)\)\s*(?::[^{};=()]*)?\{|(?:(?<![\w$.])(?P<c>[A-Za-z_$][\w$]*)|\([^()]*\)(?:\s*:[^=;{}()]*)?)\s*=>\s*(?P<body>\{)?"),
    "Rust": re.compile(r"\bfn\s+(?P<a>\w+)[^;{}]*\{"),
    "RustImpl": re.compile(r"\bimpl\b[^;{}]*\{"),
    "Go": re.compile(r"\bfunc\s+(?:\([^)]*\)\s*)?(?P<a>\w+)\s*(?:\[[^\]]*\])?\([^{}]*?\)[^{};\n]*\{"),
    "Java": re.compile(r"(?<![\w.])(?P<a>\w+)\s*\([^(){};]*(?:\([^()]*\)[^(){};]*)*\)\s*(?:throws\s+[\w., ]+)?\{"),
    "C": re.compile(r"(?<![\w.])(?P<a>~?\w+)\s*\([^(){};]*(?:\([^()]*\)[^(){};]*)*\)\s*(?:const\s*|noexcept\s*|override\s*)*(?:->[^{};]*)?\{"),
    "PHP": re.compile(r"\bfunction\s*&?\s*(?P<a>\w*)\s*\([^{};]*?\)[^{};]*\{"),
}
_OPERATORS = re.compile(r"===|!==|==|!=|<=|>=|&&|\|\||\?\?|<<|>>|\*\*|(?<![=<>!+\-*/%&|^])[+\-*/%<>&|^](?![=>+\-&|/*<])|\b(?:instanceof|in)\b")
_BRANCH = {
    "JS": re.compile(r"\b(?:if|for|while|do|case|catch)\b|(?<![?.])\?(?![?.:])"),
    "Rust": re.compile(r"\b(?:if|for|while|loop)\b|=>"),
    "Go": re.compile(r"\b(?:if|for|switch|select)\b"),
    "Java": re.compile(r"\b(?:if|for|while|do|catch|switch)\b|(?<!\?)\?(?![?>,])"),
    "C": re.compile(r"\b(?:if|for|while|do|case|default)\b|\?"),
    "PHP": re.compile(r"\b(?:if|elseif|for|foreach|while|do|switch|catch|match)\b|(?<!\?)\?(?![?>:]|->)"),
}
_NEST = {
    "JS": re.compile(r"\b(if|for|while|do|try|switch)\b"),
    "Rust": re.compile(r"\b(if|for|while|loop|match)\b"),
    "Go": re.compile(r"\b(if|for|switch|select)\b"),
    "Java": re.compile(r"\b(if|for|while|do|try|switch)\b"),
    "C": re.compile(r"\b(if|for|while|do|switch)\b"),
    "PHP": re.compile(r"\b(if|for|foreach|while|do|switch|try)\b"),
}


def _family(language: str) -> str:
    return "JS" if language in _JS else "C" if language in ("C", "C++") else language


class _Braces:
    """One pass over a blanked text: matching braces, ends of expressions, branches and nesting, each asked for by range."""

    def __init__(self, kind: str, text: str):
        self.text, self.lines = text, _Lines(text)
        branches = [m.start() for m in _BRANCH[kind].finditer(text)]
        if kind == "JS":
            branches += [m.start() for m in _OPERATORS.finditer(text)]
        self.branches = sorted(branches)
        self._pair()
        self._nest(_NEST[kind])

    def _pair(self) -> None:
        """Closing brace of each opening one, and for each depth of brackets the places where an expression may end."""
        self.closing: dict[int, int] = {}
        self.ends: dict[int, list[int]] = {}
        self.places, self.depths = [-1], [0]
        braces, depth = [], 0
        for m in re.finditer(r"[()\[\]{},;\n]", self.text):
            x, at = m.group(), m.start()
            if x in "([{":
                depth += 1
                if x == "{":
                    braces.append(at)
            else:
                self.ends.setdefault(depth, []).append(at)
                if x in ")]}":
                    depth -= 1
                    if x == "}" and braces:
                        self.closing[braces.pop()] = at
            self.places.append(at)
            self.depths.append(depth)

    def close(self, brace: int) -> int:
        return self.closing.get(brace, len(self.text) - 1)

    def expression_end(self, start: int) -> int:
        """The last place of the expression at ``start``: it ends with its statement, line or argument."""
        ends = self.ends.get(self.depths[bisect_left(self.places, start) - 1], [])
        i = bisect_left(ends, start)
        return (ends[i] if i < len(ends) else len(self.text)) - 1

    def _nest(self, kinds: re.Pattern) -> None:
        """Depths of blocks that nesting keywords open, by place; an ``else if`` nests in its ``if``, as its tree does."""
        self.at, level = [], []
        depth = pending = parens = closed = 0
        stack: list[tuple[int, int, int]] = []
        inner: list[int] = []  # parentheses in which each pending keyword stands
        for m in re.finditer(r"[{}();]|\b\w+\b", self.text):
            x = m.group()
            if x == "(":
                parens += 1
            elif x == ")":
                parens = max(0, parens - 1)
                closed = 0
            elif x == "{":
                own = pending if pending and inner and inner[-1] == parens else 0
                stack.append((own, 0 if own else pending, parens))
                depth += own
                pending, parens, closed = 0, 0, 0
                inner.append(-1)
            elif x == "}":
                if stack:
                    inner.pop()
                    own, pending, parens = stack.pop()
                    depth -= own
                    closed = own
                    if own and inner:
                        inner.pop()
                    continue
            elif x == ";":
                if pending and inner and inner[-1] == parens:
                    pending = 0
                    inner.pop()
                closed = 0
            elif x in ("else", "elif", "elseif", "catch", "finally", "except"):
                if closed and not pending:
                    pending = closed
                    inner.append(parens)
                closed = 0
            elif kinds.fullmatch(x):
                if pending and inner and inner[-1] == parens:
                    pending += 1
                else:
                    pending = 1
                    inner.append(parens)
                self.at.append(m.start())
                level.append(depth + pending)
                closed = 0
            else:
                closed = 0
            if x in "{":
                self.at.append(m.start())
                level.append(depth)
        self.level = [np.array(level, np.int64)]
        while len(self.level[-1]) > 2 ** (len(self.level) - 1):
            half, last = 2 ** (len(self.level) - 1), self.level[-1]
            self.level.append(np.maximum(last[:-half], last[half:]))

    def nesting(self, first: int, end: int) -> int:
        """Deepest chain of blocks between two places, above what the first stands in."""
        a, b = bisect_left(self.at, first), bisect_right(self.at, end)
        if a >= b:
            return 0
        base = self.level[0][a - 1] if a and self.text[self.at[a - 1]] == "{" and self.at[a - 1] == first - 1 else self._before(a)
        k = (b - a).bit_length() - 1
        return max(0, int(max(self.level[k][a], self.level[k][b - 2**k])) - int(base))

    def _before(self, a: int) -> int:
        """Depth in which the token with index ``a`` stands."""
        return int(self.level[0][a]) - (self.text[self.at[a]] != "{")

    def count(self, first: int, end: int) -> int:
        return bisect_right(self.branches, end) - bisect_left(self.branches, first)


def _brace_functions(language: str, clean: str, strict: bool) -> Iterator[Function]:
    kind = _family(language)
    heads = [(m, False) for m in _HEAD[kind].finditer(clean)]
    if kind == "Rust" and strict:
        heads += [(m, True) for m in _HEAD["RustImpl"].finditer(clean)]
    if not heads:
        return
    code = _Braces(kind, clean)
    for m, impl in sorted(heads, key=lambda x: x[0].start()):
        groups = m.groupdict()
        name = ANONYMOUS if impl else groups.get("a") or groups.get("b") or groups.get("c") or ANONYMOUS
        if name in _NOT_NAMES:
            continue
        if kind in ("Java", "C") and re.search(r"(?:\bnew|\.|=)\s*$", clean[max(0, m.start() - 8) : m.start()]):
            continue
        braced = clean[m.end() - 1] == "{"
        end = code.close(m.end() - 1) if braced else max(m.start(), code.expression_end(m.end()))
        first, last = code.lines.at(m.start()), code.lines.at(end)
        yield (ANONYMOUS if strict and kind == "C" else name, first, last - first + 1, 1 + code.count(m.end(), end), code.nesting(m.end(), end))
        if strict and kind == "JS" and clean.startswith("function", m.start()):
            yield (ANONYMOUS, first, 1, 1, 0)  # a tree's keyword token has a function's name


_PLACE = {
    "Rust": re.compile(r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?use\s+([^;]+);", re.M),
    "Java": re.compile(r"^[ \t]*import\s+(?:static\s+)?([\w.]+)(?:\.\*)?\s*;", re.M),
    "C": re.compile(r"^[ \t]*#[ \t]*include[ \t]*[<\"]([^>\"\n]+)[>\"]", re.M),
    "PHP": re.compile(r"^[ \t]*use\s+(?:function\s+|const\s+)?([\w\\, ]+?)(?:\s+as\s+\w+)?\s*;", re.M),
    "Ruby": re.compile(r"^[ \t]*((?:require|require_relative|load|include|extend)\b[^\n#]*)", re.M),
}


_GO_COMMENT = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\\n])*\"|`[^`]*`", re.S)
_JS_SOURCE = re.compile(r"(?:[^;'\"=]*?\bfrom)?\s*['\"]([^'\"\n]+)['\"]")


def imports_of(language: str, text: str) -> list[tuple[str, int]]:
    """(module path, line) of the import statements of a text; empty paths are left out."""
    kind, lines, found = _family(language), _Lines(text), []
    if kind == "Python":
        # Of several modules the first without another name is taken; __future__ is no module.
        for m in re.finditer(r"(?:^|[;:])[ \t]*(?:from[ \t]+([.\w]+)[ \t]+import\b|import[ \t]+([^\n;]+))", blank(language, text).replace("\\\n", "  "), re.M):
            names = [m.group(1)] if m.group(1) else [x.strip() for x in m.group(2).split(",")]
            path = next((x for x in names if re.fullmatch(r"[.\w]+", x) and x != "__future__"), "")
            found.append((path, lines.at(m.start(1) if m.group(1) else m.start(2))))
    elif kind == "JS":
        for m in re.finditer(r"(?:^|;)[ \t]*import\b(?!\s*[(.=])", blank(language, text), re.M):
            if x := _JS_SOURCE.match(text, m.end()):
                found.append((x.group(1), lines.at(m.end())))
    elif kind == "Go":
        clean = _GO_COMMENT.sub(lambda m: m.group() if m.group()[0] in "\"`" else _spaces(m.group()), text)
        for m in re.finditer(r"^[ \t]*import\s*(?:\(([^)]*)\)|(?:[\w.]+\s+)?\"([^\"\n]+)\")", clean, re.M):
            if m.group(2):
                found.append((m.group(2), lines.at(m.start())))
            else:
                found += [(x.group(1), lines.at(m.start(1) + x.start(1))) for x in re.finditer(r"\"([^\"\n]+)\"", m.group(1))]
    elif kind in _PLACE:
        clean = text if kind in ("C", "Ruby") else blank(language, text)
        for m in _PLACE[kind].finditer(clean):
            found.append((" ".join(m.group(1).split()), lines.at(m.start())))
    return [(x.strip(), n) for x, n in found if x.strip()]


def functions_of(language: str, text: str, strict: bool = False) -> list[Function]:
    """(name, first line, lines, complexity, nesting) of every function of a text, outer before inner."""
    clean = blank(language, text)
    if language == "Python":
        return list(_python_functions(text, clean, strict))
    if language == "Ruby":
        return list(_ruby_functions(clean, strict))
    return list(_brace_functions(language, clean, strict)) if language in L.PARSED else []


_ACCESSOR = re.compile(r"\bdef\s+(?:get_instance|getInstance|instance)\b")
_LISTENERS = ("addEventListener(", ".on(", ".subscribe(", ".listen(")
_SETUPS = tuple(f"{o}.{v}(" for o, vs in (("app", ("delete", "get", "post", "put", "use")), ("router", ("use",))) for v in vs)


def _python_hazards(text: str, clean: str) -> Iterator[tuple[str, int]]:
    lines, raw = clean.split("\n"), text.split("\n")
    i = 0
    while i < len(lines):
        line = lines[i]
        if re.match(r"[A-Za-z_][\w.]*\s*\(", line) and not re.match(r"(?:if|while|for|with|return|print_function|def|class|assert|del|not|raise|lambda|yield|await|elif|except)\b", line):
            end = _block_end(lines, i)
            whole = "\n".join(lines[i : end + 1]).rstrip()
            closed = whole.endswith(")") and not re.search(r"\)\s*(?:=[^=]|[-+*/%]?=|\.\w+\s*=)", whole)
            if closed and not raw[i].startswith(L.SAFE_CALLS):
                yield "ModuleLevelCall", i + 1
            i = end + 1
            continue
        if re.match(r"class\s+\w+", line):
            end = _block_end(lines, i)
            inner = min((_indent(x) for x in lines[i + 1 : end + 1] if x.strip()), default=0)
            field = accessor = False
            for j in range(i + 1, end + 1):
                x = lines[j]
                if x.strip() and _indent(x) == inner:
                    if re.match(r"\s*[\w.]+\s*(?::[^=]+)?=[^=]", x):
                        if "_instance" in x:
                            field = True
                        elif ":" not in raw[j]:
                            yield "MutableClassVariable", j + 1
                    accessor |= bool(_ACCESSOR.search(x))
            if field and accessor:
                yield "SingletonPattern", i + 1
            i = end + 1
            continue
        i += 1


def _js_hazards(text: str, clean: str) -> Iterator[tuple[str, int]]:
    lines = _Lines(text)
    depth = start = 0
    for m in re.finditer(r"[{}()\[\];]|\n", clean):
        x = m.group()
        depth += x in "{([" and x != "\n"
        depth -= x in "})]"
        ends = depth == 0 and (x == ";" or x == "}" or (x == "\n" and re.match(r"\s*(?:[A-Za-z_$]|\Z)", clean[m.end() :][:200])))
        if depth <= 0 and ends:
            depth = 0
            statement, where = text[start : m.end()], start + len(text[start : m.end()]) - len(text[start : m.end()].lstrip())
            head = statement.strip()
            if k := re.match(r"(?:export\s+(?:default\s+)?)?(?:abstract\s+)?class\b", head):
                body = head[k.end() :]
                if "_instance" in body:
                    yield "SingletonPattern", lines.at(where)
            elif head and not re.match(r"(?:import|export|const|let|var|function|async function|if|for|while|switch|return|try|type|interface|enum|//|/\*)\b", head):
                if any(w in head for w in _LISTENERS):
                    yield "GlobalEventListener", lines.at(where)
                elif any(w in head for w in _SETUPS):
                    yield "ModuleLevelCall", lines.at(where)
            start = m.end()
    rest = text[start:].strip()
    if rest:
        if any(w in rest for w in _LISTENERS):
            yield "GlobalEventListener", lines.at(start + text[start:].index(rest[0]))
        elif any(w in rest for w in _SETUPS):
            yield "ModuleLevelCall", lines.at(start + text[start:].index(rest[0]))


def hazards_of(language: str, text: str) -> list[tuple[str, int]]:
    """(kind, line) of what runs or is shared when a module is loaded; Python and the JavaScript family only."""
    if language == "Python":
        return list(_python_hazards(text, blank(language, text)))
    return list(_js_hazards(text, blank(language, text))) if language in _JS else []


def parse(files: DataFrame, strict_compat: bool = False) -> DataFrame:
    """(repo_id, path, functions, imports, hazards): one pass over the parsed languages' texts, in Arrow batches."""

    kind = _parse_datatype_string(_SCHEMA)
    schema = to_arrow_schema(kind)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 200):
                rows = []
                for r in b.slice(i, 200).to_pylist():
                    language, text = r["language"], r["content"].replace("\r\n", "\n")
                    rows.append(
                        {
                            "repo_id": r["repo_id"],
                            "path": r["path"],
                            "functions": [dict(zip(("name", "start_line", "line_count", "complexity", "nesting"), f, strict=True)) for f in functions_of(language, text, strict_compat)],
                            "imports": [{"module_path": m, "line": n} for m, n in imports_of(language, text)],
                            "hazards": [{"kind": k, "line": n} for k, n in hazards_of(language, text)],
                        }
                    )
                yield pa.RecordBatch.from_pylist(rows, schema)

    return files.where(F.col("language").isin(*L.PARSED)).select(F.col("repo_id").cast("string"), "path", "language", "content").mapInArrow(run, kind)


def functions(parsed: DataFrame) -> DataFrame:
    return parsed.select("repo_id", "path", F.explode("functions").alias("f")).select("repo_id", "path", "f.*")


def imports(parsed: DataFrame) -> DataFrame:
    return parsed.select("repo_id", "path", F.explode("imports").alias("i")).select("repo_id", "path", "i.*")


def hazards(parsed: DataFrame) -> DataFrame:
    return parsed.select("repo_id", "path", F.explode("hazards").alias("h")).select("repo_id", "path", "h.*")


def function_stats(found: DataFrame) -> DataFrame:
    """(repo_id, functions, avg_function_lines, max_function_lines, max_nesting, avg_complexity)."""
    n = F.count(F.lit(1))
    return found.groupBy("repo_id").agg(
        n.alias("functions"), F.floor(F.sum("line_count") / n).cast("bigint").alias("avg_function_lines"), F.max("line_count").alias("max_function_lines"), F.max("nesting").alias("max_nesting"), F.avg("complexity").alias("avg_complexity")
    )


def complex_large_files(files: DataFrame, found: DataFrame) -> DataFrame:
    """(repo_id, path, line_count, functions, language) of files over 500 lines with a function in 500 lines or more."""
    per = found.groupBy("repo_id", "path").agg(F.count(F.lit(1)).alias("functions"))
    return files.where("line_count > 500").select("repo_id", "path", "line_count", "language").join(per, ["repo_id", "path"]).where(F.col("functions") / F.col("line_count") > 0.002)
