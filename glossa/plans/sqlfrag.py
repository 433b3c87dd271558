"""Reusable SQL fragments for oracle queries (DuckDB dialect, ANSI where possible)."""

from __future__ import annotations

TOK = r"regexp_extract_all(lower({col}), '[\p{{L}}\p{{N}}]+')"


def tokens(col: str = "text") -> str:
    return TOK.format(col=col)


def ngram_list(tok: str, n: int) -> str:
    if n == 1:
        return tok
    return (f"list_transform(range(1, len({tok}) - {n - 2}), "
            f"lambda i: array_to_string({tok}[i:i + {n - 1}], ' '))")


def feat_ctes(src: str, group: str, n: int = 1, name: str = "f", text: str = "text") -> str:
    """CTEs ``{name}_tok`` and ``{name}`` = (group_id, feat, value, group_norm)."""
    return f"""{name}_t AS (SELECT {group} AS group_id, {tokens(text)} AS t FROM {src}),
{name}_g AS (SELECT group_id, unnest({ngram_list('t', n)}) AS feat FROM {name}_t),
{name}_c AS (SELECT group_id, feat, CAST(count(*) AS DOUBLE) AS value FROM {name}_g GROUP BY group_id, feat),
{name} AS (SELECT group_id, feat, value, value / sum(value) OVER (PARTITION BY group_id) AS group_norm FROM {name}_c)"""


def label_outcomes_cte(name: str = "y") -> str:
    return f"""{name} AS (
  SELECT doc_id AS group_id, 'quality' AS outcome, CAST(quality AS DOUBLE) AS y FROM labels WHERE quality IS NOT NULL
  UNION ALL
  SELECT doc_id, 'toxic', CAST(toxic AS DOUBLE) FROM labels WHERE toxic IS NOT NULL)"""


def corr_expr(n="n", sx="sx", sy="sy", sxx="sxx", syy="syy", sxy="sxy") -> str:
    return (f"({n}*{sxy} - {sx}*{sy}) / nullif(sqrt(({n}*{sxx} - {sx}*{sx}) * ({n}*{syy} - {sy}*{sy})), 0)")
