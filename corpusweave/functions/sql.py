"""Table functions for SQL users: `matches(text, pattern)` and `imports(text, language)`.

Both are SQL functions over built-in expressions, with the patterns and grammar rows of the DataFrame operators.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from .statements import GRAMMARS

MATCHES = r"""create or replace temporary function matches(text string, pattern string)
  returns table (match_no int, start_off int, end_off int, matched_text string)
  return select pos, m.begins, m.begins + length(m.hit), m.hit from (
    select posexplode(transform(regexp_extract_all(text, pattern, 0), (hit, i) -> named_struct('hit', hit, 'begins',
      aggregate(slice(split(text, pattern, -1), 1, i + 1), 0, (n, piece) -> n + length(piece))
      + aggregate(slice(regexp_extract_all(text, pattern, 0), 1, i), 0, (n, before) -> n + length(before))))) as (pos, m))"""


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _imports() -> str:
    tokens, kinds, modules = [], [], []
    for g in GRAMMARS:
        own = "language in (" + ", ".join(map(_literal, g.languages)) + ")"
        tokens.append(f"when {own} then regexp_extract_all(text, {_literal(g.tokens())}, 0)")
        for s in g.statements:
            whole = _literal(f"(?s)^{s.regex}$")
            kinds.append(f"when {own} and token rlike {whole} then '{s.kind}'")
            module = f"trim(regexp_replace(regexp_extract(token, {whole}, {s.module or s.names}), '\\\\s+', ' '))"
            modules.append(f"when {own} and token rlike {whole} then regexp_replace({module}, '^[\"\\']|[\"\\']$', '')")
    every = f"case {' '.join(tokens)} end"
    # A token's line is the number of line ends in all tokens before it.
    return f"""create or replace temporary function imports(text string, language string)
      returns table (module_path string, import_type string, line int)
      return select case {' '.join(modules)} end, case {' '.join(kinds)} end,
        aggregate(slice(tokens, 1, at), 0, (n, t) -> n + length(t) - length(replace(t, chr(10), '')))
      from (select x.token, at, x.tokens, language from (select posexplode(transform({every}, t -> named_struct('token', t, 'tokens', {every}))) as (at, x)))
      where case {' '.join(kinds)} end is not null"""


def register(spark: SparkSession) -> None:
    """Make the table functions known to a session.

    `matches` gives match_no, start_off, end_off (characters from 0) and matched_text of a Java pattern that does not match the empty text;
    `imports` gives module_path, import_type and line of whole statements (`import a, b` in one row).
    """
    spark.sql(MATCHES)
    spark.sql(_imports())
