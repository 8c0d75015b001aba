"""JSON values as VARIANT: strict parsing, exact types, truthiness.

The functions take and return SQL expressions as text. The rules of this package combine
dozens of small tests; written as text a rule reaches the session in one call, which
keeps the start of a query, and of every micro-batch of a stream, short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The parser reads the first value of a text and ignores the rest. The text is therefore
# put into an array ahead of this number: where the number comes out as second element,
# nothing followed the value. A number has no escaped spelling, so a text without these
# digits cannot imitate it. The newline ends a string that was left open.
_END = "271828182845.90452353"


# NaN and Infinity are not JSON. The parser's own limits are lower: strings of 20 million characters
# and 1,000 levels.
_LIMITS = "map('allowNonNumericNumbers', 'false', 'allowSingleQuotes', 'false', 'maxStringLen', '1000000000', 'maxNestingDepth', '10000')"


def _parsed(text: str) -> str:
    return f"from_json({text}, 'variant', {_LIMITS})"


def _parse_pair(text: str) -> str:
    # Only a text that holds the digits itself needs the two-sided test: after the first
    # value the array form admits "," "]" or the end, the object form "," "}" or the end,
    # and a "," satisfies the object form only with a key that breaks the array form.
    paired = f"""CASE WHEN NOT contains({text}, '{_END}')
        OR ({_parsed(f"'[' || {text} || ']'")} IS NOT NULL
          AND {_parsed(f"""'{{"w":' || {text} || '}}'""")} IS NOT NULL)
      THEN '[' || {text} || '\\n,{_END}]' END"""
    return _parsed(paired)


def _only_value(pair: str) -> str:
    return f"""CASE WHEN to_json(try_variant_get({pair}, '$[1]', 'variant')) = '{_END}'
      THEN try_variant_get({pair}, '$[0]', 'variant') END"""


def strict_variant(text: str) -> str:
    """The value of a text that is exactly one JSON value, else null."""
    return _only_value(_parse_pair(text))


def with_strict_variant(df: DataFrame, text: str, into: str) -> DataFrame:
    """The same in two projections, so that the text is parsed once."""
    return (
        df.withColumn("_pair", F.expr(_parse_pair(text)))
        .withColumn(into, F.expr(_only_value("_pair")))
        .drop("_pair")
    )


def pick(value: str, *names: str) -> str:
    """Several keys of an object at once, as a struct of VARIANTs; null for a non-object."""
    fields = ",".join(f"{name} variant" for name in names)
    return f"try_variant_get({value}, '$', 'struct<{fields}>')"


def kind_of(value: str) -> str:
    """Type name such as STRING, BIGINT, BOOLEAN, VOID or OBJECT<..>; null where absent.

    Reads only type tags, so it stays cheap for objects that hold long texts, and unlike
    a cast it keeps the string "true" apart from the boolean.
    """
    return f"schema_of_variant({value})"


def text_of(value: str) -> str:
    """A scalar as text, an object or array as JSON text."""
    return f"try_variant_get({value}, '$', 'string')"


def described(value: str) -> str:
    """``struct<kind, text>`` of a value, from which the tests below are simple compares.

    Objects are not written out; their text is null.
    """
    kind = kind_of(value)
    text = f"CASE WHEN NOT startswith({kind}, 'OBJECT') THEN {text_of(value)} END"
    return f"named_struct('kind', {kind}, 'text', {text})"


def described_text(value: str) -> str:
    """``struct<kind, text, value>`` of a value meant to be a text: an object comes as JSON."""
    return f"named_struct('kind', {kind_of(value)}, 'text', {text_of(value)}, 'value', {value})"


def without_bom(seen: str) -> str:
    """A described value with U+FEFF dropped from its text."""
    return f"named_struct('kind', {seen}.kind, 'text', replace({seen}.text, '\\ufeff', ''))"


def is_object(seen: str) -> str:
    """Whether a described value is an object; the tests below take described values too."""
    return f"coalesce(startswith({seen}.kind, 'OBJECT'), false)"


def is_boolean(seen: str) -> str:
    return f"coalesce({seen}.kind = 'BOOLEAN', false)"


def is_falsy(seen: str, empty_containers: bool = True) -> str:
    """Absent, null, false, zero, empty text and, by default, empty objects and arrays."""
    kinds, texts = "'VOID'", "'false', '0', '0.0', '-0.0'"
    if empty_containers:
        kinds, texts = kinds + ", 'OBJECT<>'", texts + ", '[]'"
    return f"""coalesce({seen}.kind IN ({kinds}) OR {seen}.text = ''
      OR ({seen}.kind <> 'STRING' AND {seen}.text IN ({texts})), {seen}.kind IS NULL)"""


def is_unbindable(seen: str) -> str:
    """True for what a scalar column cannot hold: containers, integers beyond 64 bits."""
    return f"""coalesce(startswith({seen}.kind, 'OBJECT') OR startswith({seen}.kind, 'ARRAY')
      OR ({seen}.kind LIKE 'DECIMAL(%,0)' AND try_cast({seen}.text AS BIGINT) IS NULL), false)"""


def float_text(number: str) -> str:
    """A double as Python writes it: the same digits, with an exponent of two digits or more where it has less than
    -4 or more than 15 places."""
    # The fewest digits that stand for the number; the platform's own text may have one too many.
    tried = ", ".join(f"format_string('%.{digits}e', {number})" for digits in (0, 14, 15, 16))
    shortest = f"""coalesce(get(filter(array({tried}), s -> CAST(s AS DOUBLE) = {number}), 0), CAST({number} AS STRING))"""
    # From 12.5, 1.25E7 or 1.25e-05: the digits, and how many of them stand before the point.
    return f"""element_at(transform(transform(transform(array(replace({shortest}, 'e', 'E')),
      t -> named_struct('sign', if(startswith(t, '-'), '-', ''), 'm', split_part(ltrim('-', t), 'E', 1),
        'e', coalesce(try_cast(nullif(split_part(t, 'E', 2), '') AS INT), 0), 'whole', t)),
      p -> named_struct('sign', p.sign, 'whole', p.whole,
        'digits', rtrim('0', ltrim('0', replace(p.m, '.', ''))),
        'point', length(split_part(p.m, '.', 1)) + p.e - (length(replace(p.m, '.', '')) - length(ltrim('0', replace(p.m, '.', '')))))),
      n -> CASE WHEN n.whole IN ('NaN', 'Infinity', '-Infinity') THEN n.whole
        WHEN n.digits = '' THEN n.sign || '0.0'
        WHEN n.point > 16 OR n.point < -3 THEN n.sign || left(n.digits, 1)
          || if(length(n.digits) > 1, '.' || substr(n.digits, 2), '')
          || if(n.point > 16, 'e+', 'e-') || lpad(CAST(abs(n.point - 1) AS STRING), greatest(2, length(CAST(abs(n.point - 1) AS STRING))), '0')
        WHEN n.point <= 0 THEN n.sign || '0.' || repeat('0', -n.point) || n.digits
        WHEN n.point >= length(n.digits) THEN n.sign || rpad(n.digits, n.point, '0') || '.0'
        ELSE n.sign || left(n.digits, n.point) || '.' || substr(n.digits, n.point + 1) END), 1)"""


def stored_text(seen: str) -> str:
    """A scalar as a text column keeps it: booleans as 1 and 0, numbers with a fraction or an exponent as Python's floats."""
    floating = f"({seen}.kind IN ('DOUBLE', 'FLOAT') OR ({seen}.kind LIKE 'DECIMAL(%' AND {seen}.kind NOT LIKE 'DECIMAL(%,0)'))"
    return f"""CASE WHEN {floating} THEN {float_text(f"CAST({seen}.text AS DOUBLE)")}
      WHEN {seen}.kind <> 'BOOLEAN' THEN {seen}.text
      WHEN {seen}.text = 'true' THEN '1' WHEN {seen}.text = 'false' THEN '0' END"""
