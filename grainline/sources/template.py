"""Bind a chart's date-templated query for one window (SRC-2).

``{NAME}`` stands for a window value (fixed names: START_DATE, END_DATE,
CUR_DATE_HIPHEN and CUR_DATE_UNDERSCORE, the last two the window's end) or for
a chart variable. A list variable becomes a list of quoted, escaped literals;
other values are put in as they are. Braces around anything but upper-case
names are left alone.

Queries may also use Spark's named parameter markers ``:start_date``,
``:end_date`` and ``:cur_date``; :func:`window_args` gives them typed DATE
values, so no text is put in for dates.
"""

from __future__ import annotations

import datetime as _dt
import re

_TOKEN = re.compile(r"\{([A-Z][A-Z0-9_]*)\}")
_MARKER = re.compile(r"(?<![:\w]):(start_date|end_date|cur_date)\b")


class UnresolvedVariableError(KeyError):
    pass


def quoted(value) -> str:
    """A value as a Spark SQL string literal."""
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def bind_template(query: str, variables: dict | None, start: _dt.date, end: _dt.date) -> str:
    texts = {
        name: ", ".join(map(quoted, v)) if isinstance(v, (list, tuple)) else str(v) for name, v in (variables or {}).items()
    }
    texts |= {
        "START_DATE": f"{start:%Y-%m-%d}",
        "END_DATE": f"{end:%Y-%m-%d}",
        "CUR_DATE_HIPHEN": f"{end:%Y-%m-%d}",
        "CUR_DATE_UNDERSCORE": f"{end:%Y_%m_%d}",
    }
    pieces = _TOKEN.split(query)  # text, name, text, name, ..., text
    missing = sorted(set(pieces[1::2]) - texts.keys())
    if missing:
        raise UnresolvedVariableError(", ".join(missing))
    pieces[1::2] = [texts[name] for name in pieces[1::2]]
    return "".join(pieces)


def window_args(query: str, start: _dt.date, end: _dt.date) -> dict[str, _dt.date]:
    """Values for the named date markers the query actually uses."""
    values = {"start_date": start, "end_date": end, "cur_date": end}
    return {name: values[name] for name in set(_MARKER.findall(query))}
