"""Column functions for amounts, dates and masks found in free text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Date shapes in the order they are tried (shape guard, Spark pattern).
DATE_SHAPES = (
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"),
    (r"^\d{1,2}-\d{1,2}-\d{4}$", "d-M-yyyy"),
    (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"),
)


def stripped(text: Column) -> Column:
    """Without white space of any kind at either end; ``trim`` knows blanks only."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def plain_number(value: Column) -> Column:
    """A double as decimal text, also where its own text form would have an exponent."""
    long_form = F.regexp_replace(value.cast("decimal(38,6)").cast("string"), r"(\.\d+?)0+$", "$1")
    return F.when(F.abs(value).between(1e7, 1e30), long_form).otherwise(value.cast("string"))


def amount_value(raw: Column) -> Column:
    """Number in a money text; whichever of ``,`` and ``.`` comes last is the decimal mark.

    NULL when nothing parsable is left: ``24.395,00 EUR`` gives 24395.0 and ``1,234`` gives 1.234.
    A column of numbers is taken as it is.
    """
    return F.when(F.typeof(raw) != "string", raw.try_cast("double")).otherwise(_amount_in_text(raw.cast("string")))


def _amount_in_text(text: Column) -> Column:
    kept = F.regexp_replace(text, r"[^0-9,.\-]", "")
    comma_is_decimal = F.regexp_extract(text, r"([.,])[^.,]*$", 1) == ","
    # translate() drops characters that have no counterpart.
    plain = F.when(comma_is_decimal, F.translate(kept, ",.", ".")).otherwise(
        F.translate(kept, ",", "")
    )
    return plain.try_cast("double")


def date_value(raw: Column) -> Column:
    """First date shape that fits, NULL when none does."""
    text = stripped(raw)
    tries = [
        F.when(text.rlike(guard), F.try_to_timestamp(text, F.lit(pattern)).cast("date"))
        for guard, pattern in DATE_SHAPES
    ]
    return F.coalesce(*tries)


def mask_email(email: Column, is_admin: Column | bool = False) -> Column:
    """Keep the two characters before the mask; administrators see the address."""
    masked = F.regexp_replace(email, r"(.{2}).*@", "$1****@")
    admin = is_admin if isinstance(is_admin, Column) else F.lit(bool(is_admin))
    return F.when(admin, email).otherwise(masked)


def one_line(message: Column, width: int = 250) -> Column:
    """Line breaks and tabs collapsed to a space, then the first ``width`` characters."""
    return F.left(F.regexp_replace(message, r"[\n\r\t]+", " "), F.lit(width))


#: Fixed value: the Crockford base-32 alphabet in digit order.
CROCKFORD = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"


def ulid_millis(ulid: Column) -> Column:
    """Epoch milliseconds in the first ten base-32 characters of a (prefixed) ULID; NULL if one is not of the alphabet."""
    body = F.regexp_replace(ulid, r"^[^_]*_", "")
    head = F.split(F.upper(F.left(body, F.lit(10))), "")
    alphabet = F.lit(CROCKFORD)
    return F.aggregate(
        head,
        F.lit(0).cast("bigint"),
        lambda acc, ch: acc * F.lit(32) + (F.nullif(F.position(ch, alphabet), F.lit(0)) - 1),
    )


def ulid_head(millis: Column) -> Column:
    """The ten characters that stand for a time in a ULID; the way back of ``ulid_millis``."""
    digits = [F.substr(F.lit(CROCKFORD), ((millis / F.lit(32**i)).cast("bigint") % 32 + 1).cast("int"), F.lit(1)) for i in reversed(range(10))]
    return F.concat(*digits)


def after_millis(last_event_id: Column) -> Column:
    """Time in the identifier of the last event seen; 0 where it is none (26 characters after the prefix)."""
    body = F.regexp_replace(last_event_id, r"^[^_]*_", "")
    return F.coalesce(F.when(F.length(body) == 26, ulid_millis(last_event_id)), F.lit(0).cast("bigint"))
