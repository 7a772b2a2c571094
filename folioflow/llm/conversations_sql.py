"""The DuckDB SQL of conversation repair: a recursive query over turns with the least cost, script and text for each grammar state.

A state's entry is one string: the cost in ten digits, the script, a mark, and the repaired text. Entries of
equal cost never have scripts of which one begins the other, so the least string is the least script.
"""

from __future__ import annotations

_MARK = "chr(1)"


def _crc32(text: str) -> str:
    """crc32 of an ASCII text, bit by bit."""
    shifted = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: xor(a >> 1, (a & 1) * 3988292384))"
    codes = f"list_transform(string_split({text}, ''), lambda x: CAST(ascii(x) AS BIGINT))"
    return f"xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], {codes}), lambda c, b: {shifted}), 4294967295)"


def _edited(entry: str, cost: str, letter: str, line: str) -> str:
    """The entry with an edit: null stays null."""
    return (
        f"(lpad(CAST(CAST(left({entry}, 10) AS BIGINT) + {cost} AS VARCHAR), 10, '0') || substr({entry}, 11, instr({entry}, {_MARK}) - 11) || '{letter}' || substr({entry}, instr({entry}, {_MARK})) || {line})"
    )


def _least(*entries: str) -> str:
    return f"least({', '.join(entries)})"


def _steps() -> str:
    """The columns of the entries after a turn, from those with insertions before it (g0 to g3)."""
    keep, renamed = "3 * truncated", "3 + 3 * truncated"
    kept = lambda g, letter: f"CASE WHEN NOT gone AND letter = '{letter}' THEN {_edited(g, keep, 'K', 'line')} END"
    named = lambda g, role: f"CASE WHEN NOT gone THEN {_edited(g, renamed, 'R', f"chr(10) || '{role}:' || text")} END"
    deleted = lambda g: _edited(g, "4", "D", "''")
    return ", ".join(
        [
            f"{deleted('g0')} AS f0",
            f"{_least(deleted('g1'), kept('g0', 's'))} AS f1",
            f"{_least(deleted('g2'), *(kept(g, 'u') for g in ('g0', 'g1', 'g3')), *(named(g, 'user') for g in ('g0', 'g1', 'g3')))} AS f2",
            f"{_least(deleted('g3'), kept('g2', 'a'), named('g2', 'assistant'))} AS f3",
        ]
    )


def _inserted(source: str) -> str:
    user = [_edited(f, "3", "I", "chr(10) || 'user:'") for f in ("f0", "f1", "f3")]
    first = f"SELECT *, {_least('f2', *user)} AS g2 FROM {source}"
    return f"(SELECT *, f0 AS g0, f1 AS g1, {_least('f3', _edited('g2', '3', 'I', "chr(10) || 'assistant:'"))} AS g3 FROM ({first}))"


def sql() -> str:
    key = "coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')"
    space = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""
        WITH RECURSIVE fates AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc32(key)} % 20 AS fate FROM conversations
        ), damaged AS (
            SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role, CASE fate WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
            FROM fates, range(CASE fate WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)
        ), placed AS (
            SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS nth, rtrim(text, {space}) AS bare FROM damaged
        ), faults AS (
            SELECT *, left(role, 1) AS letter, chr(10) || role || ':' || text AS line, bare = '' AS is_blank,
                bare <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY nth) > 1 AS is_duplicate FROM placed
        ), turns AS (
            SELECT *, is_blank OR is_duplicate AS gone, CAST(NOT (is_blank OR is_duplicate) AND right(bare, 1) NOT IN ('.', '!', '?') AS INTEGER) AS truncated,
                CAST(lag(letter) OVER own || letter NOT IN ('su', 'ua', 'au') AS INTEGER) AS is_illegal
            FROM faults WINDOW own AS (PARTITION BY conv_id ORDER BY nth)
        ), ids AS (
            SELECT conv_id FROM conversations GROUP BY conv_id
        ), told AS (
            SELECT ids.conv_id, count(nth) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, coalesce(sum(CAST(is_blank AS INTEGER)), 0) AS blank,
                coalesce(sum(CAST(is_duplicate AS INTEGER)), 0) AS duplicate, coalesce(sum(truncated), 0) AS truncated, coalesce(sum(is_illegal), 0) AS illegal
            FROM ids LEFT JOIN turns ON ids.conv_id IS NOT DISTINCT FROM turns.conv_id GROUP BY ids.conv_id
        ), entries AS (
            SELECT conv_id, CAST(0 AS BIGINT) AS i, '0000000000' || {_MARK} AS f0, CAST(NULL AS VARCHAR) AS f1, CAST(NULL AS VARCHAR) AS f2, CAST(NULL AS VARCHAR) AS f3 FROM ids
            UNION ALL
            SELECT e.conv_id, e.i + 1, {_steps()}
            FROM {_inserted("entries")} AS e JOIN turns AS t ON e.conv_id IS NOT DISTINCT FROM t.conv_id AND t.nth = e.i + 1
        ), done AS (
            SELECT t.*, least(e.g0, e.g3) AS best FROM told AS t JOIN {_inserted("entries")} AS e ON t.conv_id IS NOT DISTINCT FROM e.conv_id AND t.n = e.i
        )
        SELECT conv_id, CAST(gaps AS BIGINT) AS gaps, CAST(blank AS BIGINT) AS blank, CAST(duplicate AS BIGINT) AS duplicate, CAST(truncated AS BIGINT) AS truncated,
            CAST(illegal AS BIGINT) AS illegal, CAST(left(best, 10) AS BIGINT) AS cost, substr(best, 11, instr(best, {_MARK}) - 11) AS audit, sha256(substr(best, instr(best, {_MARK}) + 2)) AS repaired_sha256
        FROM done
    """
