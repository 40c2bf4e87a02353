"""Keys that make different spellings of one value equal. All are built-in expressions, so they stay in codegen.

Ids become BINARY: 16 bytes for a UUID, a zero byte plus the trimmed text for anything else, so that no text can be taken
for a UUID. Null stays null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t\r\n\f\v"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trimmed(c: Column | str) -> Column:
    return F.btrim(col(c), F.lit(BLANKS))


def folded(c: Column | str) -> Column:
    """Text without regard to letter case and surrounding blanks."""
    return F.lower(trimmed(c))


def uuid_key(c: Column | str) -> Column:
    """The UUID that a text denotes (dashes, braces, ``urn:uuid:`` and letter case do not matter), as 16 bytes."""
    bare = F.replace(F.translate(F.lower(trimmed(c)), "{}-", ""), F.lit("urn:uuid:"), F.lit(""))
    raw = F.unhex(F.when(F.length(bare) == 32, bare))
    return F.coalesce(raw, F.concat(F.lit(bytearray(b"\0")), F.encode(trimmed(c), "utf-8")))


def uuid_text(c: Column | str) -> Column:
    """A key of uuid_key as text: lower case 8-4-4-4-12, or the text itself."""
    h = F.lower(F.hex(col(c)))
    dashed = F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    return F.when(F.length(col(c)) == 16, dashed).when(col(c).isNotNull(), F.decode(F.substring(col(c), 2, 1 << 30), "utf-8"))


def digest_key(c: Column | str) -> Column:
    """The SHA-256 digest that a text denotes, as 32 bytes; a zero byte plus the text where it is no full digest."""
    bare = F.btrim(F.regexp_replace(folded(c), r"^(sha-?256[:=-]|0x)", ""), F.lit(BLANKS))
    raw = F.unhex(F.when(F.length(bare) == 64, bare))
    return F.coalesce(raw, F.concat(F.lit(bytearray(b"\0")), F.encode(col(c), "utf-8")))


def instant_ms(c: Column | str) -> Column:
    """Milliseconds of the instant that an ISO text denotes, null if it denotes none."""
    return F.unix_millis(trimmed(c).try_cast("timestamp"))
