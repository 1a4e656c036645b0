"""Five-field cron expressions as array expressions.

Each field becomes an ``array<int>`` of its allowed values. Nothing here iterates over minutes:
days are tested against three small arrays, and only matching days meet the times of day. Rules that depend on the month are values
beyond the field's own: the last day, the n-th and the last weekday of a month.
The pieces are SQL texts for ``selectExpr``: they nest lambdas too deeply to build call by call.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Field bounds and names of the cron grammar.
FIELDS = {"minute": (0, 59), "hour": (0, 23), "dom": (1, 31), "month": (1, 12), "dow": (0, 7)}
MONTH_NAMES = "jan feb mar apr may jun jul aug sep oct nov dec"
DAY_NAMES = "sun mon tue wed thu fri sat"
NAMES = {"month": (MONTH_NAMES, 1), "dow": (DAY_NAMES, 0)}
# what the days relative to a month are counted from: day 32 is the last one, WEEK + 7 * (n - 1) + d the n-th weekday d, LAST + d the last one
LAST_DAY, WEEK, LAST = 32, 10, 50
DAY = "[0-7]|[a-z]{3}"
PART = r"^(?:\*|([0-9]{1,2}|[a-z]{3})(?:-([0-9]{1,2}|[a-z]{3}))?)(?:/([0-9]{1,4}))?$"


def tokens(cron: str) -> str:
    return f"filter(split(trim({cron}), r'\\s+'), t -> t <> '')"


def has_five_fields(cron: Column | str) -> Column:
    if isinstance(cron, str):
        return F.expr(f"size({tokens(cron)}) = 5")
    return F.size(F.filter(F.split(F.trim(cron), r"\s+"), lambda t: t != "")) == 5


def parse_field(fields: str, name: str) -> str:
    """The comma-separated parts of one field as ``array<struct<low, high, step, ok>>``.

    ``fields`` is the array of tokens. A broken part has ``ok`` false and maybe null bounds.
    """
    lo, hi = FIELDS[name]
    # a plain "*" covers a week once: Sunday is 0 there
    top = 6 if name == "dow" else hi

    def number(text: str) -> str:
        if name not in NAMES:
            return f"try_cast({text} AS INT)"
        words, first = NAMES[name]
        word = f"nullif(array_position(split('{words}', ' '), {text}), 0)"
        return f"coalesce(try_cast({text} AS INT), CAST({word} AS INT) + {first - 1})"

    def group(index: int) -> str:
        return f"regexp_extract(p, r'{PART}', {index})"

    # rules relative to the month, as values of their own
    code = "CAST(NULL AS INT)"
    if name == "dom":
        code = f"CASE WHEN p = 'l' THEN {LAST_DAY} END"
    if name == "dow":
        def weekday(pattern: str) -> str:
            return f"pmod({number(f'regexp_extract(p, r{chr(39)}{pattern}{chr(39)}, 1)')}, 7)"

        nth, last, named = f"^({DAY})#([1-5])$", f"^({DAY})l$", f"^l({DAY})$"
        code = f"""CASE WHEN p rlike r'{nth}' THEN {WEEK} + 7 * (CAST(regexp_extract(p, r'{nth}', 2) AS INT) - 1) + {weekday(nth)}
            WHEN p rlike r'{last}' THEN {LAST} + {weekday(last)} WHEN p rlike r'{named}' THEN {LAST} + {weekday(named)} END"""
    texts = f"""transform(split(lower(coalesce(get({fields}, {list(FIELDS).index(name)}), '')), ','), p -> struct(
        {group(1)} AS lo, {group(2)} AS hi, {group(3)} AS step, p rlike r'{PART}' AS shaped, {code} AS code))"""
    bounds = f"""transform({texts}, p -> struct(
        CASE WHEN p.code IS NOT NULL THEN p.code WHEN p.lo = '' THEN {lo} ELSE {number('p.lo')} END AS low,
        CASE WHEN p.code IS NOT NULL THEN p.code WHEN p.hi <> '' THEN {number('p.hi')} WHEN p.lo = '' OR p.step <> '' THEN {top} ELSE {number('p.lo')} END AS high,
        CASE WHEN p.step = '' OR p.code IS NOT NULL THEN 1 ELSE try_cast(p.step AS INT) END AS step,
        p.shaped AS shaped, p.code IS NOT NULL AS special, p.hi <> '' AS ranged))"""
    # a range may run over the end of its field
    inside = f"b.low BETWEEN {lo} AND {hi} AND b.high BETWEEN {lo} AND {hi} AND (b.low <= b.high OR b.ranged) AND b.step >= 1"
    return f"transform({bounds}, b -> named_struct('low', b.low, 'high', b.high, 'step', b.step, 'ok', coalesce(b.special OR (b.shaped AND {inside}), false)))"


def parsed_ok(parsed: str) -> str:
    return f"forall({parsed}, b -> b.ok)"


def parsed_values(parsed: str, name: str) -> str:
    """Sorted allowed values of a parsed field; Sunday is 0. Null where a part is broken."""
    lo, hi = FIELDS[name]
    span = 7 if name == "dow" else hi - lo + 1
    around = f"transform(sequence(b.low, b.high + {span}, b.step), v -> {lo} + (v - {lo}) % {span})"
    values = f"flatten(transform({parsed}, b -> CASE WHEN b.ok THEN CASE WHEN b.low <= b.high THEN sequence(b.low, b.high, b.step) ELSE {around} END END))"
    if name == "dow":
        values = f"transform({values}, v -> CASE WHEN v < {WEEK} THEN v % 7 ELSE v END)"
    return f"array_sort(array_distinct({values}))"


def is_valid_cron(cron: str) -> Column:
    """True for a well-formed five-field expression whose values are all in range; false for null."""
    checks = " AND ".join(parsed_ok(parse_field("t", name)) for name in FIELDS)
    return F.expr(f"coalesce(transform(array({tokens(cron)}), t -> size(t) = 5 AND {checks})[0], false)")


def field_values(cron: str, name: str) -> Column:
    """Sorted allowed values of one field of a valid expression."""
    return F.expr(parsed_values(parse_field(tokens(cron), name), name))


def day_matches(day: str, spec: str) -> str:
    """Whether a schedule fires on a day: restricted day-of-month and day-of-week are OR-ed.

    ``spec`` is a struct of the allowed ``dom, month, dow``.
    """
    weekday, number, last = f"(dayofweek({day}) - 1)", f"dayofmonth({day})", f"dayofmonth(last_day({day}))"
    dom = f"(array_contains({spec}.dom, {number}) OR ({number} = {last} AND array_contains({spec}.dom, {LAST_DAY})))"
    nth = f"array_contains({spec}.dow, {WEEK} + 7 * CAST(floor(({number} - 1) / 7) AS INT) + {weekday})"
    dow = f"(array_contains({spec}.dow, {weekday}) OR {nth} OR ({number} > {last} - 7 AND array_contains({spec}.dow, {LAST} + {weekday})))"
    either = f"size(filter({spec}.dom, v -> v < {LAST_DAY})) < 31 AND size(filter({spec}.dow, v -> v < {WEEK})) < 7"
    return f"(array_contains({spec}.month, month({day})) AND CASE WHEN {either} THEN {dom} OR {dow} ELSE {dom} AND {dow} END)"


def minutes_of_day(hours: str, minutes: str) -> str:
    """Sorted minutes after midnight at which a matching day fires, from the two fields' values."""
    return f"flatten(transform({hours}, h -> transform({minutes}, m -> h * 60 + m)))"
