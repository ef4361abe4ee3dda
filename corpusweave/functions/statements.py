"""Whole statements of source texts, found by one lexical pass per text.

A grammar row gives a language's comments and strings, the words at which a statement may
begin, and the statements themselves. All of them are alternatives of one pattern that cuts a text into
consecutive tokens, so what looks like a statement inside a comment or a string is never read as one, and a
statement may run over many lines. Tokens cover the text without gaps: places and lines follow from running sums.

Repetitions are possessive: they do not backtrack and do not nest, however long the text.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .languages import SCRIPT
from .text import bind, running_sum


@dataclass(frozen=True)
class Statement:
    """`regex` of a whole statement of `kind`; its groups `names` and `module` hold what is bound and where from (0: nothing)."""

    kind: str
    regex: str
    names: int
    module: int


@dataclass(frozen=True)
class Grammar:
    """`skipped`: comments and strings, which begin with one of the characters `marks`; `opening`: first words of statements."""

    languages: tuple[str, ...]
    skipped: str
    marks: str
    opening: str
    statements: tuple[Statement, ...]
    comment: str
    filler: str | None = None

    def tokens(self) -> str:
        plain = self.filler or rf"(?:(?!(?:{self.opening})\b)[\w$]++|[^\w${self.marks}])++"
        return "(?s)(?:" + "|".join([self.skipped, *[s.regex for s in self.statements], plain, "."]) + ")"


_LINE_STRINGS = r""""(?:[^"\\\n]|\\.)*+"|'(?:[^'\\\n]|\\.)*+'"""
_SLASH_COMMENT = r"//[^\n]*+|/\*.*?\*/"
_QUOTED = r"""(?:'[^'\n]*'|"[^"\n]*")"""
_GAP = rf"(?:\s|{_SLASH_COMMENT})"
#: Names, stars, commas and braces up to the word `from` (which may itself be a name, before a comma, a brace or `as`).
_CLAUSE = rf"(?:(?!from\b(?!{_GAP}*+(?:[,}}]|as\b)))[\w$]++|[*{{}},]|{_GAP})++"
_END = r"[ \t]*+;?"

_SCRIPT = Grammar(
    SCRIPT, rf"{_SLASH_COMMENT}|{_LINE_STRINGS}|`(?:[^`\\]|\\.)*+`", "\"'`/", "import|export|require", (
        Statement("type_only", rf"import{_GAP}++type{_GAP}++(?!from\b)({_CLAUSE})from{_GAP}*+({_QUOTED}){_END}", 1, 2),
        Statement("es_module", rf"import\b({_CLAUSE})from{_GAP}*+({_QUOTED}){_END}", 1, 2),
        Statement("side_effect", rf"import{_GAP}*+({_QUOTED}){_END}", 0, 1),
        Statement("re_export", rf"export{_GAP}*+((?:type{_GAP}++)?(?:\*(?:{_GAP}*+as{_GAP}++[\w$]++)?|\{{[^{{}}]*+\}})){_GAP}*+from{_GAP}*+({_QUOTED}){_END}", 1, 2),
        Statement("common_js", rf"require\s*+\(\s*+({_QUOTED})\s*+\)", 0, 1),
        Statement("dynamic", rf"import{_GAP}*+\({_GAP}*+({_QUOTED}){_GAP}*+\)", 0, 1),
    ), _SLASH_COMMENT)

_WS = r"(?:[ \t\f]|\\\r?\n)"
_AS = rf"(?:{_WS}++as{_WS}++\w++)?"
_PYTHON = Grammar(
    ("python",), rf"""#[^\n]*+|\"\"\"(?:[^"\\]|\\.|"(?!""))*+\"\"\"|'''(?:[^'\\]|\\.|'(?!''))*+'''|{_LINE_STRINGS}""", "\"'#", "import|from", (
        Statement("python_import", rf"import{_WS}++([\w.]++{_AS}(?:{_WS}*+,{_WS}*+[\w.]++{_AS})*+)", 1, 0),
        Statement("python_from_import", rf"from{_WS}++([\w.]++){_WS}++import{_WS}*+(\((?:[^()#]|#[^\n]*+)*+\)|\*|\w++{_AS}(?:{_WS}*+,{_WS}*+\w++{_AS})*+)", 2, 1),
    ), r"#[^\n]*+|\\\r?\n")

_RUST = Grammar(
    ("rust",), rf"""{_SLASH_COMMENT}|r"[^"]*+"|r#".*?"#|r##".*?"##|"(?:[^"\\]|\\.)*+"|'(?:[^'\\\n]|\\.)'""", "\"'/", "use|pub", (
        Statement("rust_use", r"(?:pub(?:\s*+\([^)]*+\))?\s++)?use\s++([^;]*+);", 1, 1),
    ), _SLASH_COMMENT, r"""(?:(?!(?:use|pub)\b|r#*+")[\w$]++|[^\w$"'/])++""")

_LUA = Grammar(
    ("lua",), rf"--\[\[.*?\]\]|--[^\n]*+|{_LINE_STRINGS}", "\"'\\-", "require", (
        Statement("lua_require", rf"require\s*+\(\s*+({_QUOTED})\s*+\)", 0, 1),
        Statement("lua_require", rf"require\s*+({_QUOTED})", 0, 1),
    ), r"--[^\n]*+")

_SHELL = Grammar(
    ("shell",), r"[ \t]*+#[^\n]*+", "", "", (
        Statement("shell_source", r"""[ \t]*+(?:source|\.)[ \t]++["']?+([^\s"']++)["']?+[^\n]*+""", 0, 1),
    ), r"(?!)", r"[^\n]++\n?+|\n")

GRAMMARS = (_SCRIPT, _PYTHON, _RUST, _LUA, _SHELL)
FOUND = "array<struct<start_off:bigint,end_off:bigint,line:bigint,statement:string,newline:string>>"


def _newlines(text: Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))).cast("bigint")


def placed(tokens: Column, opens: Callable[[Column], Column]) -> Column:
    """Tokens that `opens` accepts, with their places; `tokens` cover a text without gaps."""
    def of(all_tokens: Column) -> Column:
        def row(ends: Column, lines: Column) -> Column:
            def one(i: Column) -> Column:
                token = F.get(all_tokens, i)
                begins = (i == 0) | F.get(all_tokens, i - 1).endswith("\n")
                newline = F.when(begins, F.regexp_extract(F.get(all_tokens, i + 1), r"^\r?\n", 0))
                return F.struct(
                    (F.get(ends, i) - F.length(token)).alias("start_off"), F.get(ends, i).alias("end_off"),
                    (F.get(lines, i) - _newlines(token)).alias("line"), token.alias("statement"), F.coalesce(newline, F.lit("")).alias("newline"))

            wanted = F.filter(F.sequence(F.lit(0), F.size(all_tokens) - 1), lambda i: opens(F.get(all_tokens, i)))
            return F.transform(wanted, one)

        places = running_sum(F.transform(all_tokens, lambda t: F.length(t).cast("bigint")))
        return bind(places, lambda ends: bind(running_sum(F.transform(all_tokens, _newlines)), lambda lines: row(ends, lines)))

    return bind(tokens, of)


def statements_of(text: Column, language: Column, grammars: tuple[Grammar, ...] = GRAMMARS) -> Column:
    """start_off, end_off, line (from 0), statement, and the line end behind it if it has its lines to itself, for each statement of a text."""
    tokens, fits = F.lit(None).cast("array<string>"), []
    for g in grammars:
        own = language.isin(*g.languages)
        begins = F.lit(True) if not g.opening else text.rlike(rf"\b(?:{g.opening})\b")
        tokens = F.when(own & (text != "") & begins, F.regexp_extract_all(text, F.lit(g.tokens()), F.lit(0))).otherwise(tokens)
        fits.append((own, rf"(?s)^(?:{'|'.join(s.regex for s in g.statements)})$"))
    opens = lambda token: F.coalesce(*[F.when(own, token.rlike(whole)) for own, whole in fits])
    return placed(tokens, opens)


def plain(text: Column, comment: str) -> Column:
    """Without comments, with single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, f"(?s){comment}", " "), r"\s+", " "))


def parts_of(statement: Column, language: Column, grammars: tuple[Grammar, ...] = GRAMMARS) -> Column:
    """struct<kind,module,clause> of a statement, by the first row it fits."""
    out = F.lit(None).cast("struct<kind:string,module:string,clause:string>")
    for g in reversed(grammars):
        for s in reversed(g.statements):
            whole = f"(?s)^{s.regex}$"
            group = lambda n: F.regexp_extract(statement, whole, n) if n else F.lit("")  # noqa: E731, B023
            module = F.regexp_replace(plain(group(s.module), g.comment), r"""^['"]|['"]$""", "") if s.module else F.lit("")
            out = F.when(language.isin(*g.languages) & statement.rlike(whole), F.struct(
                F.lit(s.kind).alias("kind"), module.alias("module"), plain(group(s.names), g.comment).alias("clause"))).otherwise(out)
    return out
