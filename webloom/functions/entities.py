"""HTML character references decoded with built-in expressions.

The named references are the HTML 4 set shipped with Python's standard
library (``html.entities.name2codepoint``); the lookup is one constant map
literal, folded by the optimizer, so decoding stays JVM-side.
"""

from __future__ import annotations

from html.entities import name2codepoint
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

ENTITY_PIECES = r"&[A-Za-z][A-Za-z0-9]*;|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};|[^&]+|&"


def _named_map() -> Column:
    return F.create_map(*chain.from_iterable((F.lit(k), F.lit(chr(v))) for k, v in sorted(name2codepoint.items())))


def _codepoint(n: Column) -> Column:
    """String of one code point (invalid or control values give U+FFFD)."""
    ok = (n > 0) & (n <= 0x10FFFF) & ~((n >= 0xD800) & (n <= 0xDFFF))
    return F.when(ok, F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")).otherwise(F.lit("�"))


def decode_entities(text: Column) -> Column:
    names = _named_map()

    def piece(p):
        hexnum = F.regexp_extract(p, r"^&#[xX]([0-9A-Fa-f]+);$", 1)
        decnum = F.regexp_extract(p, r"^&#([0-9]+);$", 1)
        name = F.regexp_extract(p, r"^&([A-Za-z][A-Za-z0-9]*);$", 1)
        return (F.when(hexnum != "", _codepoint(F.conv(hexnum, 16, 10).cast("long")))
                .when(decnum != "", _codepoint(decnum.cast("long")))
                .when(name != "", F.coalesce(F.element_at(names, name), p))
                .otherwise(p))

    decoded = F.array_join(F.transform(F.regexp_extract_all(text, F.lit(ENTITY_PIECES), 0), piece), "")
    return F.when(text.contains("&"), decoded).otherwise(text)
