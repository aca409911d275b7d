"""Spelling of ECMAScript regular expressions for the JVM.

The rule values are written for ECMAScript.  Three atoms mean something else to
``java.util.regex`` and are replaced once, on the driver, when a plan is built:

* ``\\b``  is ASCII in ECMAScript, Unicode-aware on JDK 17;
* ``\\s``  includes the no-break space, the byte order mark and the Unicode
  separators in ECMAScript, only ASCII on the JVM;
* ``$``   is the very end in ECMAScript, also "before a final line break" on the JVM.
"""

from __future__ import annotations

_BOUNDARY = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"
_SPACE = r"\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


def java_pattern(pattern: str, ignore_case: bool = False) -> str:
    """Return ``pattern`` with the same meaning for Spark's ``rlike`` family."""
    out = ["(?i)"] if ignore_case else []
    in_class = False
    i = 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\":
            pair = pattern[i : i + 2]
            if pair == r"\s":
                out.append(_SPACE if in_class else f"[{_SPACE}]")
            elif pair == r"\b" and not in_class:
                out.append(_BOUNDARY)
            else:
                out.append(pair)
            i += 2
            continue
        if ch == "[":
            # A bracket inside a class is literal in ECMAScript, nested on the JVM.
            out.append(r"\[" if in_class else ch)
            in_class = True
        elif ch == "]":
            in_class = False
            out.append(ch)
        elif ch == "$" and not in_class:
            out.append(r"\z")
        else:
            out.append(ch)
        i += 1
    return "".join(out)
