"""A scanner for languages whose blocks stand in braces: C++, C#, Java, Go, Rust, TypeScript and JavaScript.

One pass over a file's tokens. Words up to a brace, a semicolon or (where lines end
statements) a line's end are a head; what it says, and in which scope it stands,
decides whether it opens a namespace, a type, a function or a plain block, or declares
a member, a variable, an alias or an import. Unbalanced braces close what is open.
"""

from __future__ import annotations

import re
from typing import NamedTuple

_TOKEN = re.compile(
    r"(?P<skip>[ \t\r\f\v]+|//[^\n]*|/\*.*?(?:\*/|\Z)|\\\n)|(?P<line>\n)|(?P<directive>(?m:^)[ \t]*\#[^\n]*(?:(?<=\\)\n[^\n]*)*)"
    r"|(?P<text>\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?|`(?:\\.|[^`\\])*`?)|(?P<word>[A-Za-z_$][\w$]*)|(?P<number>\d[\w.]*)|(?P<mark>=>|->|::|:=|[^\w\s])",
    re.S,
)
TYPES = {"class": "class", "struct": "struct", "interface": "interface", "enum": "enum", "union": "struct", "trait": "interface", "record": "class"}
SPACES = {"namespace", "module", "mod"}
BY_LINE = {"go", "typescript", "javascript"}
NO_NAMES = frozenset("if else for while do switch catch return sizeof new delete throw case default try finally foreach using lock synchronized await yield typeof instanceof in of assert static_assert decltype alignof noexcept super this".split())
OWN_WORDS = {"go": frozenset(["go", "defer", "select", "range"]), "rust": frozenset(["match", "loop"])}
OWN_TYPES = {"record": ("java", "csharp"), "trait": ("rust",)}
MODIFIERS = frozenset("export default public private protected internal static virtual inline constexpr const explicit friend extern abstract sealed partial override async final readonly unsafe declare pub mutable let var function func fn synchronized native default transient volatile".split())
_OPEN_END = frozenset("= , ( [ + - * / && || | & ? : => . < :: :=".split())
_GOES_ON = frozenset("{ . ? : && || | = => & + - * /".split())


class Token(NamedTuple):
    kind: str
    text: str
    line: int


class Scope(NamedTuple):
    kind: str  # space, type, function or block
    name: str


def tokens(text: str) -> list[Token]:
    out, line = [], 1
    for m in _TOKEN.finditer(text):
        kind = m.lastgroup
        if kind != "skip":
            out.append(Token(kind, m.group().strip(" \t") if kind == "directive" else m.group(), line))
        line += m.group().count("\n")
    return out


def _plain(head: list[Token]) -> list[Token]:
    """A head without angle brackets that hold types, so that commas and colons in them do not count."""
    out, depth = [], 0
    for k, t in enumerate(head):
        if t.text == "<" and (depth or k and head[k - 1].kind == "word"):
            depth += 1
        elif t.text == ">" and depth:
            depth -= 1
        elif not depth:
            out.append(t)
    return out if not depth else list(head)


def _bases(rest: list[Token]) -> list[str]:
    """Names after a colon, extends or implements."""
    out, on, name = [], False, ""
    for t in [*rest, Token("mark", ",", 0)]:
        if t.text in (":", "extends", "implements", ","):
            if on and name:
                out.append(name)
            on, name = on or t.text != ",", ""
        elif t.kind == "word" and t.text not in ("public", "private", "protected", "virtual"):
            name = name + t.text if name.endswith(("::", ".")) else t.text
        elif t.text in ("::", ".") and name:
            name += t.text
    return out


def _call_at(head: list[Token], none: frozenset = NO_NAMES) -> int | None:
    """Where a name stands right before the first parenthesis outside of others."""
    for k, t in enumerate(head):
        if t.text == "(":
            return k - 1 if k and head[k - 1].kind == "word" and head[k - 1].text not in none else None
        if t.text == "=":
            return None
    return None


class Scan:
    def __init__(self, path: str, language: str):
        self.path, self.language = path, language
        self.none = NO_NAMES | OWN_WORDS.get(language, frozenset())
        self.types = {k: v for k, v in TYPES.items() if language in OWN_TYPES.get(k, (language,))}
        self.rows: list[tuple] = []
        self.scopes: list[Scope] = []

    def row(self, kind: str, t: Token, name: str | None = None, parent: str | None = None, target: str | None = None) -> None:
        self.rows.append((self.path, kind, name or t.text, t.line, parent if parent is not None else self.owner(), target))

    def owner(self) -> str | None:
        return next((s.name for s in reversed(self.scopes) if s.kind in ("space", "type")), None)

    def inside(self) -> str | None:
        """The function that code stands in, with its type."""
        at = next((k for k in range(len(self.scopes) - 1, -1, -1) if self.scopes[k].kind == "function"), None)
        return None if at is None else self.scopes[at].name

    def in_type(self) -> str | None:
        return self.scopes[-1].name if self.scopes and self.scopes[-1].kind == "type" else None

    def calls(self, head: list[Token], skip: int | None = None) -> None:
        where = self.inside()
        if where is None:
            return
        for k, t in enumerate(head):
            if t.kind == "word" and k != skip and k + 1 < len(head) and head[k + 1].text == "(" and t.text not in self.none and t.text not in MODIFIERS:
                self.row("call", t, parent=where, target=t.text)

    def function(self, head: list[Token]) -> str | None:
        """Record the function that a head declares, and give its name with its type."""
        bare = _plain(head)
        words = [t.text for t in bare]
        if self.language == "go" and "func" in words[:1] and len(words) > 1 and words[1] == "(":  # a method stands after its receiver
            close = words.index(")") if ")" in words else len(words)
            receiver = next((t.text for t in reversed(bare[2:close]) if t.kind == "word"), None)
            at = _call_at(bare[close + 1 :], self.none)
            if at is None:
                return None
            t = bare[close + 1 + at]
            self.row("method", t, parent=receiver)
            return f"{receiver}.{t.text}"
        if "=>" in words[-2:] or ("function" in words and "=" in words[: words.index("function")]):  # a function that a name is set to
            t = next((bare[k - 1] for k, w in enumerate(words) if w in ("=", ":") and k and bare[k - 1].kind == "word"), None)
            if t is None or "(" in words[: bare.index(t)]:
                return None
            own = self.in_type()
            self.row("method" if own else "function", t)
            return f"{own}.{t.text}" if own else t.text
        at = _call_at(bare, self.none)
        if at is None:
            return None
        t, own = bare[at], self.in_type()
        before = bare[at - 1].text if at else ""
        if before in (".", "->") or t.text in MODIFIERS:
            return None
        if before == "::" and at > 1 or before == "~" and at > 2 and bare[at - 2].text == "::":  # outside of its type
            own = bare[at - 2].text if before == "::" else bare[at - 3].text
        kind = "destructor" if before == "~" else "constructor" if own and t.text in (own, "constructor") else "method" if own else "function"
        if not own and at == 0 and self.language in ("cpp", "java", "csharp"):
            return None  # a bare call, as of a macro
        self.row(kind, t, "~" + t.text if kind == "destructor" else t.text, parent=own if own else None)
        return f"{own}.{t.text}" if own else t.text

    def opened(self, head: list[Token]) -> Scope:
        bare = _plain(head)
        words = [t.text for t in bare]
        if self.inside() is None or any(w in self.types for w in words[:2]):
            for k, t in enumerate(bare):
                if t.text in SPACES and self.inside() is None:
                    name = "".join(x.text for x in bare[k + 1 :] if x.kind == "word" or x.text in ("::", "."))
                    if name:
                        self.row("namespace", t, name)
                    return Scope("space", name)
                if t.text == "impl" and self.language == "rust":
                    names = [x.text for x in bare[k + 1 :] if x.kind == "word"]
                    return Scope("type", names[-1] if names else "")
                if self.language == "go" and t.text == "type" and len(bare) > k + 2 and bare[k + 2].text in self.types:
                    self.row(self.types[bare[k + 2].text], bare[k + 1])
                    return Scope("type", bare[k + 1].text)
                if t.text in self.types and (k + 1 < len(bare)) and "(" not in words[:k] and "=" not in words[:k]:
                    at = next((j for j in range(k + 1, len(bare)) if bare[j].kind == "word" and bare[j].text not in self.types), None)
                    if at is None:
                        return Scope("type", "")
                    if "(" in words[at:] and self.types[t.text] == "struct" and self.language == "cpp":
                        break  # a function that returns one
                    self.row(self.types[t.text], bare[at])
                    for base in _bases(bare[at + 1 :]):
                        self.row("inherits", bare[at], target=base)
                    if any(x.text == "template" for x in head[:k]):
                        self.row("template", bare[at])
                    return Scope("type", bare[at].text)
            if bare and words[0] == "extern" and bare[-1].kind == "text":
                return Scope("space", "")
        if self.inside() is None or "=>" in words[-2:] or "function" in words:
            name = self.function(head)
            if name:
                return Scope("function", name)
            own = self.in_type()
            if words[-1:] == ["="] or own and self.language == "csharp" and "(" not in words and len(bare) > 1:  # a value in braces, a property
                self.ended(head)
        self.calls(head)
        return Scope("block", "")

    def ended(self, head: list[Token]) -> None:
        if not head:
            return
        bare = _plain(head)
        words = [t.text for t in bare]
        first = words[0]
        if first == "import" or first in ("using", "use") and "=" not in words and "(" not in words or first == "export" and "from" in words:
            texts = [t for t in bare if t.kind == "text"]
            for t in texts:
                self.row("import", t, t.text.strip("\"'`"), target=t.text.strip("\"'`"))
            if not texts:
                name = "".join(w for w in words[1:] if w not in ("static", "namespace", ";"))
                self.row("import", bare[0], name, target=name)
            return
        if first == "package":
            self.row("namespace", bare[0], "".join(words[1:]))
            return
        if first in ("typedef", "using", "type") and len(bare) > 2:
            t = next((x for x in reversed(bare) if x.kind == "word"), bare[0]) if first == "typedef" else bare[1]
            self.row("typedef", t)
            return
        if self.inside() is not None or self.scopes and self.scopes[-1].kind == "block":
            self.calls(head)
            return
        if self.scopes and self.scopes[-1].kind == "type" and not any(w in ("(", "=", ";") for w in words) and self.language in ("java", "csharp", "cpp", "rust") and "," in words:
            return  # members of an enumeration
        if "(" in words and _call_at(bare, self.none) is not None and "=" not in words[: words.index("(")]:
            self.function(head)
            return
        upto = next((k for k, w in enumerate(words) if w in ("=", ":", "[", ":=")), len(words))
        named = [t for t in bare[:upto] if t.kind == "word" and t.text not in MODIFIERS]
        if self.language == "go" and self.in_type():
            named = named[:1]
        typed = len(named) > 1 or upto < len(words) or self.language in BY_LINE and (first in ("var", "const", "let") or self.in_type())
        if named and typed and named[-1].text not in self.none and named[0].text not in self.none and first not in ("return", "friend", *self.types):
            self.row("field" if self.in_type() else "variable", named[-1])


def parse_braces(path: str, language: str, text: str) -> list[tuple]:
    """Rows (path, kind, name, line, parent, target) of a file's namespaces, types, bases, functions, members, aliases, imports and calls."""
    scan, head, deep, stack, listed = Scan(path, language), [], 0, [], 0
    every = tokens(text)
    for k, t in enumerate(every):
        if t.kind == "directive":
            m = re.match(r"#\s*(include|define)\s*[<\"]?([^>\"\s(]+)", t.text)
            if m:
                scan.row("import" if m[1] == "include" else "macro", t, m[2], target=m[2] if m[1] == "include" else None)
        elif t.kind == "line":
            following = next((x for x in every[k + 1 : k + 50] if x.kind != "line"), None)
            if language in BY_LINE and head and not deep and head[-1].text not in _OPEN_END and (following is None or following.text not in _GOES_ON or language == "go" and following.text in ("*", "&", "-")):
                scan.ended(head)
                head = []
        elif t.kind == "mark" and (t.text == "{" and head and not deep and head[0].text in ("import", "export", "use") and (len(head) == 1 or head[-1].text in (",", "type", "::")) or t.text == "}" and listed):  # names that are listed
            listed += 1 if t.text == "{" else -1
            deep += 1 if t.text == "{" else -1
            head.append(t)
        elif t.text == "{" and t.kind == "mark":
            stack.append((deep, head if deep else None))
            scan.scopes.append(scan.opened(head))
            head, deep = [], 0
        elif t.text == "}" and t.kind == "mark":
            scan.ended(head)
            head = []
            if stack:
                deep, outer = stack.pop()
                scan.scopes.pop()
                head = [x for x in outer if x.text == "("][:deep] if outer else []
        elif t.text == ";" and not deep:
            scan.ended(head)
            head = []
        elif t.text == ":" and len(head) == 1 and head[0].text in ("public", "private", "protected", "default") and language == "cpp":
            head = []
        else:
            if t.text in "([" and t.kind == "mark" and not (t.text == "(" and len(head) == 1 and head[0].text in ("const", "var", "type") and language == "go"):
                deep += 1
            elif t.text in ")]" and t.kind == "mark":
                deep = max(0, deep - 1)
            head.append(t)
    scan.ended(head)
    return scan.rows
