"""SQL text for column maps: identifiers and literals.

Building a wide projection through the Column API costs one py4j call per
operator (~0.5 ms each); the same projection as SQL text is parsed in the JVM
in one ``selectExpr`` call.  Literals are written so that they parse back to
exactly the same value (doubles via their shortest repr with a ``D`` suffix).
"""

from __future__ import annotations

import math


def ident(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def lit(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, int):
        return f"({v})" if v >= 0 else f"(-{abs(v)})"
    if isinstance(v, float):
        if math.isnan(v):
            return "CAST('NaN' AS DOUBLE)"
        if math.isinf(v):
            return "CAST('Infinity' AS DOUBLE)" if v > 0 else "CAST('-Infinity' AS DOUBLE)"
        return f"({repr(v)}D)" if v >= 0 or repr(v) == "-0.0" else f"(-{repr(-v)}D)"
    if isinstance(v, str):
        return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
    raise TypeError(f"no SQL literal for {type(v).__name__}")
