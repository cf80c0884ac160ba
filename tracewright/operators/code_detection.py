"""Rules that tell source code from prose.

A text is code of the first language whose form it has as a whole: every top-level statement must
read like a real construct, so short words and notes do not count. Without grammar libraries this
meets its contract on ordinary snippets, not on every program.
"""

from __future__ import annotations

import ast
import re
from functools import lru_cache


class CodeDetector:
    """``detect`` gives the language of a text or None; ``prepare`` may load what it needs."""

    def prepare(self) -> None:
        return None

    def detect(self, text: str) -> str | None:
        raise NotImplementedError


def _python(text: str) -> bool:
    try:
        body = ast.parse(text).body
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return False
    lines = text.splitlines()

    # Bare names, texts and comparisons are valid Python, but so is much prose.
    def real(node: ast.stmt) -> bool:
        if isinstance(node, ast.Expr):
            return isinstance(node.value, ast.Call | ast.Await | ast.Yield) and not re.search(r"\w \(", lines[node.lineno - 1])
        if isinstance(node, ast.AnnAssign):
            return node.value is not None
        if isinstance(node, ast.Assign):
            return not re.fullmatch(r"\S+=\S+.*", text.strip()) or "(" in text or "[" in text
        return not isinstance(node, ast.Pass | ast.Break | ast.Continue)

    return bool(body) and all(map(real, body))


_SQL = re.compile(
    r"\s*(?:SELECT\s.+?\sFROM\s+[\w.\"]+\b.*|INSERT\s+INTO\s+[\w.\"]+.*(?:VALUES|SELECT)\b.*|UPDATE\s+[\w.\"]+\s+SET\s+[\w.\"]+\s*=.*|DELETE\s+FROM\s+[\w.\"]+.*"
    r"|CREATE\s+(?:TABLE|VIEW|INDEX|UNIQUE)\b.+|ALTER\s+TABLE\s.+|DROP\s+(?:TABLE|VIEW|INDEX)\s.+|WITH\s+\w+\s+AS\s*\(.+)\s*",
    re.IGNORECASE | re.DOTALL,
)
#: Top-level constructs of brace languages.
_HEADS = {
    "javascript": r"(?:export\s+|async\s+)*(?:function\b.*\(|class\s+\w+|(?:const|let|var)\s+[\w{\[].*=|import\s.+from\s|\(?[\w, ]*\)?\s*=>|if\s*\(|for\s*\(|while\s*\(|return\b.*;|[\w.]+\(.*\);)",
    "typescript": r"(?:export\s+)?(?:interface\s+\w+|type\s+\w+\s*=|enum\s+\w+)",
    "go": r"(?:package\s+\w+\s*$|func\s.*\(|import\s+[(\"]|type\s+\w+\s+(?:struct|interface)|var\s+\w+\s+[\w*\[\]]+)",
    "rust": r"(?:pub\s+)?(?:fn\s+\w+|struct\s+\w+|enum\s+\w+|impl\b|use\s+[\w:]+;|let\s+(?:mut\s+)?\w+|mod\s+\w+|trait\s+\w+|#\[\w+)",
    "java": r"(?:public|private|protected|static|final|abstract)\s+.*[{;(]|import\s+[\w.*]+;|package\s+[\w.]+;|@\w+\s*$",
    "c": r"#\s*(?:include\s*[<\"]|define\s+\w+|ifdef\s|ifndef\s|pragma\s)|(?:static\s+|const\s+|unsigned\s+)*(?:int|char|void|float|double|long|struct\s+\w+)\s+\**\w+\s*[(=;\[{]",
    "bash": r"#!\s*/.*sh\b|(?:if\s+\[.*\]\s*;?\s*then|for\s+\w+\s+in\s.*;?\s*do|export\s+\w+=)",
}
_HEADS = {k: re.compile(v) for k, v in _HEADS.items()}


def _balanced(text: str) -> bool:
    stack, quote, skip = [], "", False
    for c in text:
        if skip:
            skip = False
        elif quote:
            if c == "\\":
                skip = True
            elif c == quote:
                quote = ""
        elif c in "\"'`":
            quote = c
        elif c in "([{":
            stack.append({"(": ")", "[": "]", "{": "}"}[c])
        elif c in ")]}" and (not stack or stack.pop() != c):
            return False
    return not stack and (not quote or quote == "'")


def _statements(text: str) -> list[str]:
    """Top-level lines of a brace language: those where no bracket is open."""
    out, depth = [], 0
    for line in text.splitlines():
        if line.strip() and depth <= 0 and line.strip() not in ("}", "};", "})", "});"):
            out.append(line.strip())
        depth += sum(line.count(c) for c in "([{") - sum(line.count(c) for c in ")]}")
    return out


class RuleCodeDetector(CodeDetector):
    """Languages in a fixed order; results of short texts are cached in each worker."""

    LANGUAGES = ("python", "sql", "go", "rust", "java", "typescript", "javascript", "c", "bash")

    def __init__(self, languages: tuple[str, ...] = LANGUAGES):
        self.languages = tuple(languages)

    def detect(self, text: str) -> str | None:
        return _detect(text, self.languages) if len(text) <= 1024 else _detect.__wrapped__(text, self.languages)


@lru_cache(4096)
def _detect(text: str, languages: tuple[str, ...]) -> str | None:
    if not text.strip():
        return None
    for language in languages:
        if language == "python":
            found = _python(text)
        elif language == "sql":
            # Without its semicolon a statement must at least shout its keywords.
            body = text.rstrip()
            loud = re.match(r"\s*(?:SELECT\b.*\bFROM|INSERT\s+INTO|UPDATE\b.*\bSET|DELETE\s+FROM)\b", body, re.DOTALL)
            found = (body.endswith(";") or loud is not None) and _balanced(body) and _SQL.fullmatch(body.removesuffix(";")) is not None
        else:
            heads = _statements(text)
            found = bool(heads) and _balanced(text) and all(_HEADS[language].match(h) for h in heads)
        if found:
            return language
    return None
