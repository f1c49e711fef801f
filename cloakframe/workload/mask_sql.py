"""DuckDB SQL that masks a text column the same way, for checking results.

It follows the definition directly: rules one after another over the text,
then numbering by first appearance with window functions.
"""

from __future__ import annotations

from cloakframe.plans import lexicon as lx

MARK = 57345  # private-use code points, one per rule


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def mask_ctes(
    source: str, key: str = "doc_id", rules: list[tuple] | None = None, *, prefix: str = "", const: dict[str, str] | None = None,
    seed: str | None = None,
) -> str:
    """CTE list giving ``mapping(key, original, masked, rule_id, first_seen, n)`` and ``masked(key, masked, n)``.

    ``source`` is a query with columns ``key`` and ``text``. ``const`` maps rule
    ids to constants (rules without a counter). ``seed`` is a query with
    ``key, original, masked, counter``.
    """
    rules = rules or [r for r in lx.BUILTIN_RULES if r[0] not in lx.DEFAULT_OFF_RULES]
    const = const or {}
    n = len(rules)
    marks = "".join(chr(MARK + i) for i in range(n))
    steps = [f"{prefix}t0 AS MATERIALIZED (SELECT {key} AS k, text AS t FROM ({source}))"]
    for i, r in enumerate(rules):
        keep = "".join(f", m{j}" for j in range(i))
        steps.append(
            f"{prefix}t{i + 1} AS MATERIALIZED (SELECT k, regexp_replace(t, {_lit(r[2])}, chr({MARK + i}), 'g') AS t{keep}, "
            f"regexp_extract_all(t, {_lit(r[2])}) AS m{i} FROM {prefix}t{i})"
        )
    occ = " UNION ALL ".join(
        f"SELECT k, {i} AS r, unnest(m{i}) AS original, unnest(range(1, len(m{i}) + 1)) AS idx FROM {prefix}t{n}" for i in range(n)
    )
    ids = " ".join(f"WHEN {i} THEN {_lit(r[0])}" for i, r in enumerate(rules))
    temps = " ".join(f"WHEN {i} THEN {_lit(const.get(r[0], r[3]))}" for i, r in enumerate(rules))
    counted = " ".join(f"WHEN {i} THEN {0 if r[0] in const else 1}" for i, r in enumerate(rules))
    seed_cte = seed or "SELECT NULL::BIGINT AS k, NULL::VARCHAR AS original, NULL::VARCHAR AS masked, 0 AS counter WHERE false"
    steps += [
        f"{prefix}occ AS ({occ})",
        # marks in text order with their line
        f"{prefix}tok AS (SELECT k, unnest(regexp_extract_all(t, '[{marks}]|\\n')) AS c, "
        f"unnest(range(1, len(regexp_extract_all(t, '[{marks}]|\\n')) + 1)) AS ord FROM {prefix}t{n} WHERE regexp_matches(t, '[{marks}]'))",
        f"{prefix}pos AS (SELECT k, c, ord, ascii(c) - {MARK} AS r, "
        f"sum((c = chr(10))::INT) OVER (PARTITION BY k ORDER BY ord ROWS UNBOUNDED PRECEDING) AS line FROM {prefix}tok)",
        f"{prefix}mark AS (SELECT k, r, line, ord, row_number() OVER (PARTITION BY k, r ORDER BY ord) AS idx, "
        f"row_number() OVER (PARTITION BY k ORDER BY ord) AS part FROM {prefix}pos WHERE c <> chr(10))",
        f"{prefix}seen AS (SELECT m.k, m.r, m.line, m.part, o.original, "
        f"row_number() OVER (PARTITION BY m.k ORDER BY m.line, m.r, m.ord) - 1 AS seq FROM {prefix}mark m "
        f"JOIN {prefix}occ o ON o.k = m.k AND o.r = m.r AND o.idx = m.idx)",
        f"{prefix}val AS (SELECT k, original, min(seq) AS first_seen, arg_min(r, seq) AS r, count(*) AS n FROM {prefix}seen GROUP BY k, original)",
        f"{prefix}seed AS ({seed_cte})",
        f"{prefix}cnt AS (SELECT k, max(counter) AS counter FROM {prefix}seed GROUP BY k)",
        f"{prefix}num AS (SELECT v.*, CASE v.r {ids} END AS rule_id, CASE v.r {temps} END AS tpl, CASE v.r {counted} END AS counted, "
        f"coalesce(c.counter, 0) + sum(CASE v.r {counted} END) OVER (PARTITION BY v.k ORDER BY v.first_seen) AS no "
        f"FROM {prefix}val v LEFT JOIN {prefix}cnt c ON c.k = v.k "
        f"WHERE NOT EXISTS (SELECT 1 FROM {prefix}seed s WHERE s.k = v.k AND s.original = v.original))",
        f"{prefix}fresh AS (SELECT k, original, CASE WHEN counted = 1 THEN tpl || no ELSE tpl END AS masked, rule_id, first_seen, n FROM {prefix}num)",
        f"{prefix}lookup AS (SELECT k, original, masked FROM {prefix}fresh UNION ALL SELECT k, original, masked FROM {prefix}seed)",
        f"{prefix}part AS (SELECT k, unnest(string_split_regex(t, '[{marks}]')) AS p, "
        f"unnest(range(1, len(string_split_regex(t, '[{marks}]')) + 1)) AS part FROM {prefix}t{n})",
        f"{prefix}masked AS (SELECT p.k, string_agg(p.p || coalesce(l.masked, ''), '' ORDER BY p.part) AS masked, count(s.original) AS n "
        f"FROM {prefix}part p LEFT JOIN {prefix}seen s ON s.k = p.k AND s.part = p.part "
        f"LEFT JOIN {prefix}lookup l ON l.k = s.k AND l.original = s.original GROUP BY p.k)",
    ]
    return ",\n".join(steps)
