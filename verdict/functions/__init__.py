"""Functions on columns: text cleaning, number parsing, JSON values held as VARIANT."""


def settled(expression: str) -> str:
    """The same SQL expression, computed where it is defined and nowhere else.

    The optimizer moves a filter, also the one it infers for an exploded array, below the
    projections its columns come from and writes their expressions out inside it. For
    columns derived in several stages the copies multiply, and costly parsing or scoring
    runs twice. The condition here always holds, but it is one the optimizer must leave in
    place, so a filter stays above it.
    """
    return f"CASE WHEN spark_partition_id() >= 0 THEN {expression} END"


def literal(text: str) -> str:
    """A text as SQL string literal."""
    escaped = text.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"
