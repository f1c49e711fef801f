"""Partial masks and column strategies as Column functions and SQL functions.

Everything is built from Catalyst expressions, so it stays inside whole-stage
code generation. Lengths are characters.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def _stars(n: Column) -> Column:
    return F.repeat(F.lit("*"), F.greatest(n, F.lit(0)))


def _len(v: Column) -> Column:
    return F.char_length(v)


# --- partial masks used for names of files -----------------------------------


def mask_name(v: Column) -> Column:
    return F.when(_len(v) <= 1, "*").otherwise(F.concat(F.left(v, F.lit(1)), _stars(_len(v) - 1)))


def mask_phone(v: Column) -> Column:
    return F.when(_len(v) < 7, "****").otherwise(F.concat(F.left(v, F.lit(3)), F.lit("****"), F.right(v, F.lit(4))))


def mask_id_card(v: Column) -> Column:
    return F.when(_len(v) <= 10, "******").otherwise(
        F.concat(F.left(v, F.lit(6)), _stars(_len(v) - 10), F.right(v, F.lit(4)))
    )


def mask_bank_card(v: Column) -> Column:
    return F.when(_len(v) <= 8, "****").otherwise(
        F.concat(F.left(v, F.lit(4)), _stars(_len(v) - 8), F.right(v, F.lit(4)))
    )


def mask_passport(v: Column) -> Column:
    return F.when(_len(v) <= 3, _stars(F.greatest(_len(v), F.lit(1)))).otherwise(
        F.concat(F.left(v, F.lit(1)), _stars(_len(v) - 3), F.right(v, F.lit(2)))
    )


def mask_email(v: Column) -> Column:
    at = F.instr(v, "@")
    head = F.when(at == 1, "*").otherwise(F.left(v, F.lit(1)))
    return F.when(at == 0, "***EMAIL***").otherwise(F.concat(head, F.lit("***"), F.substring(v, at, _len(v))))


def mask_ipv4(v: Column) -> Column:
    parts = F.split(v, r"\.", -1)
    return F.when(F.size(parts) == 4, F.concat(F.get(parts, F.lit(0)), F.lit("."), F.get(parts, F.lit(1)), F.lit(".*.*"))).otherwise(
        F.lit("***IP***")
    )


# Rule id (also with the suffix used for findings) -> partial mask.
PARTIAL_BY_RULE: dict[str, Callable[[Column], Column]] = {
    "phone": mask_phone,
    "id_card": mask_id_card,
    "bank_card": mask_bank_card,
    "passport": mask_passport,
    "email": mask_email,
    "ipv4": mask_ipv4,
    "chinese_name": mask_name,
}


def partial_mask(rule_id: Column, value: Column, template: Column) -> Column:
    """Dispatch by rule id; terms and unknown rules give their template."""
    base = F.when(rule_id == "name_ner", "chinese_name").otherwise(F.regexp_replace(rule_id, "_ner$", ""))
    out = None
    for rule, fn in PARTIAL_BY_RULE.items():
        out = F.when(base == rule, fn(value)) if out is None else out.when(base == rule, fn(value))
    return out.otherwise(template)


# --- column strategies ---------------------------------------------------------


def keep_mask(v: Column, prefix: Column | int, suffix: Column | int, char: Column | str = "*") -> Column:
    """Keep ``prefix`` and ``suffix`` characters, mask the rest (never empty)."""
    p = F.lit(prefix) if isinstance(prefix, int) else prefix
    s = F.lit(suffix) if isinstance(suffix, int) else suffix
    c = F.lit(char) if isinstance(char, str) else char
    n = _len(v)
    tail = F.when(s > 0, F.right(v, s)).otherwise("")
    return F.when(p + s >= n, F.repeat(c, F.greatest(n, F.lit(1)))).otherwise(
        F.concat(F.left(v, p), F.repeat(c, n - p - s), tail)
    )


def mask_middle(v: Column, prefix: Column | int, suffix: Column | int) -> Column:
    """As :func:`keep_mask` with stars; an empty value stays empty."""
    return F.when(_len(v) == 0, "").otherwise(keep_mask(v, prefix, suffix))


def mask_email_user(v: Column) -> Column:
    at = F.instr(v, "@")
    user = F.substring(v, F.lit(1), at - 1)
    domain = F.substring(v, at, _len(v))
    short = _stars(F.greatest(_len(user), F.lit(1)))
    return F.when(at == 0, mask_middle(v, 1, 1)).otherwise(
        F.concat(F.when(_len(user) <= 2, short).otherwise(mask_middle(user, 1, 1)), domain)
    )


def configurable_mask(
    v: Column, *, replacement: str | None = None, pattern: str | None = None, keep_prefix: int = 0,
    keep_suffix: int = 0, mask_char: str = "*", enabled: bool = True,
) -> Column:
    """A fixed replacement when no pattern is given, else keep and mask."""
    if not enabled:
        return v
    if replacement is not None and pattern is None:
        return F.lit(replacement)
    return keep_mask(v, keep_prefix, keep_suffix, mask_char)


# Strategy id -> f(value, replacement column). Users may add their own.
Strategy = Callable[[Column, Column], Column]
STRATEGIES: dict[str, Strategy] = {
    "PHONE_MID4": lambda v, r: mask_middle(v, 3, 4),
    "IDCARD_MID10": lambda v, r: mask_middle(v, 4, 4),
    "BANKCARD_LAST4": lambda v, r: mask_middle(v, 0, 4),
    "EMAIL_USER_MASK": lambda v, r: mask_email_user(v),
    "DEFAULT_VALUE": lambda v, r: F.coalesce(r, F.lit("[MASKED]")),
    "CLEAR_COL": lambda v, r: F.lit(""),
}


def full_mask(v: Column, r: Column) -> Column:
    """FULL_MASK, BANK_CARD, EMAIL, ADDRESS, COMPLIANCE_ID and unknown strategies."""
    return F.coalesce(r, mask_middle(v, 0, 0))


def register_strategy(strategy_id: str, fn: Strategy) -> None:
    STRATEGIES[strategy_id] = fn


def apply_strategy(v: Column, strategy: Column, replacement: Column) -> Column:
    """Masked value by strategy id; NULL strategy or empty value passes."""
    out = F.when(strategy.isNull() | v.isNull() | (v == ""), v)
    for sid, fn in STRATEGIES.items():
        out = out.when(strategy == sid, fn(v, replacement))
    return out.otherwise(full_mask(v, replacement))


# --- SQL functions --------------------------------------------------------------
# name -> (parameters, body). Spark inlines these bodies into the query.

SQL_FUNCTIONS = {
    "mask_middle": (
        "v STRING, p INT, s INT",
        "CASE WHEN char_length(v) = 0 THEN '' WHEN p + s >= char_length(v) THEN repeat('*', char_length(v)) "
        "ELSE concat(left(v, p), repeat('*', char_length(v) - p - s), CASE WHEN s > 0 THEN right(v, s) ELSE '' END) END",
    ),
    "mask_keep": (
        "v STRING, p INT, s INT, c STRING",
        "CASE WHEN p + s >= char_length(v) THEN repeat(c, greatest(char_length(v), 1)) "
        "ELSE concat(left(v, p), repeat(c, char_length(v) - p - s), CASE WHEN s > 0 THEN right(v, s) ELSE '' END) END",
    ),
    "mask_name": ("v STRING", "CASE WHEN char_length(v) <= 1 THEN '*' ELSE concat(left(v, 1), repeat('*', char_length(v) - 1)) END"),
    "mask_phone": ("v STRING", "CASE WHEN char_length(v) < 7 THEN '****' ELSE concat(left(v, 3), '****', right(v, 4)) END"),
    "mask_id_card": (
        "v STRING",
        "CASE WHEN char_length(v) <= 10 THEN '******' ELSE concat(left(v, 6), repeat('*', char_length(v) - 10), right(v, 4)) END",
    ),
    "mask_bank_card": (
        "v STRING",
        "CASE WHEN char_length(v) <= 8 THEN '****' ELSE concat(left(v, 4), repeat('*', char_length(v) - 8), right(v, 4)) END",
    ),
    "mask_passport": (
        "v STRING",
        "CASE WHEN char_length(v) <= 3 THEN repeat('*', greatest(char_length(v), 1)) "
        "ELSE concat(left(v, 1), repeat('*', char_length(v) - 3), right(v, 2)) END",
    ),
    "mask_email": (
        "v STRING",
        "CASE WHEN instr(v, '@') = 0 THEN '***EMAIL***' "
        "ELSE concat(CASE WHEN instr(v, '@') = 1 THEN '*' ELSE left(v, 1) END, '***', substring(v, instr(v, '@'))) END",
    ),
    "mask_ipv4": (
        "v STRING",
        "CASE WHEN size(split(v, '[.]', -1)) = 4 THEN concat(split(v, '[.]', -1)[0], '.', split(v, '[.]', -1)[1], '.*.*') "
        "ELSE '***IP***' END",
    ),
    "mask_email_user": (
        "v STRING",
        "CASE WHEN instr(v, '@') = 0 THEN mask_middle(v, 1, 1) "
        "WHEN instr(v, '@') <= 3 THEN concat(repeat('*', greatest(instr(v, '@') - 1, 1)), substring(v, instr(v, '@'))) "
        "ELSE concat(mask_middle(left(v, instr(v, '@') - 1), 1, 1), substring(v, instr(v, '@'))) END",
    ),
}


def register_functions(spark: SparkSession) -> list[str]:
    """Register the masks as temporary SQL functions of the session."""
    for name, (params, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS STRING RETURN {body}")
    return list(SQL_FUNCTIONS)
