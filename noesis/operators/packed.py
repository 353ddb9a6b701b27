"""Several values packed in one text field: one row per value, position kept.

A field that starts with ``[`` is a JSON list. Otherwise values are separated by comma, semicolon, bar, tab or line
break; a field with none of these outside quotes is separated by blanks. A double quote at the start of a value opens a
quoted value, in which separators are text and a doubled quote is one quote. Values are trimmed, empty ones dropped
without counting, repeats and case kept.

Blocks of rows are scanned as the byte buffer of one Arrow string array: a running count of quotes gives the quote
parity of every byte, masks give the separators outside quotes, and the offsets of all values of the block come from
those masks at once. Fields whose quotes are not in regular places (a quote inside a value, text after a closing quote,
an odd number of quotes) are parsed one by one under the same rules.

Defined cases: null, empty and blank fields give no row; a JSON list that cannot be read is parsed as plain text; JSON
null is dropped, other JSON values become their JSON text; an unclosed quote reaches to the end of the field; text after
a closing quote is added to the value as it stands.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

SEPARATORS = b",;|\t\n\r"
QUOTE, BLANK, BRACKET = 34, 32, 91
_IS_SEP = np.zeros(256, bool)
_IS_SEP[list(SEPARATORS)] = True
_SEPS = set(SEPARATORS.decode())


def _scan(field: str, seps: set[str]) -> list[str]:
    """Values of one field under the given separators, untrimmed quotes resolved."""
    out, i, n = [], 0, len(field)
    while i <= n:
        while i < n and field[i].isspace() and field[i] not in seps:
            i += 1
        value = ""
        if i < n and field[i] == '"':
            i += 1
            while i < n:
                if field[i] == '"':
                    if i + 1 < n and field[i + 1] == '"':
                        i += 1
                    else:
                        break
                value += field[i]
                i += 1
            i += 1
        j = i
        while j < n and field[j] not in seps:
            j += 1
        value = (value + field[i:j]).strip()
        if value:
            out.append(value)
        i = j + 1
    return out


def _separated(field: str) -> bool:
    """Whether a separator other than a blank stands outside quotes; quotes open after a blank, too."""
    i, n, start = 0, len(field), True
    while i < n:
        c = field[i]
        if c == '"' and start:
            i += 1
            while i < n and (field[i] != '"' or field[i + 1 : i + 2] == '"'):
                i += 2 if field[i] == '"' else 1
            i, start = i + 1, False
            continue
        if c in _SEPS:
            return True
        start = c.isspace()
        i += 1
    return False


def split_field(field: str | None) -> list[str]:
    """The values of one field: the rules of this module, one character after the other."""
    if not field:
        return []
    if field[0] == "[":
        try:
            values = json.loads(field)
        except ValueError:
            values = None
        if isinstance(values, list):
            texts = (x if isinstance(x, str) else json.dumps(x, ensure_ascii=False) for x in values if x is not None)
            return [y for x in texts if (y := x.strip())]
    return _scan(field, _SEPS if _separated(field) else {" ", " "})


def split_block(fields: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Row ordinal, position and value of every value in a block of fields."""
    arr = fields.cast(pa.large_string()) if fields.type != pa.large_string() else fields
    n = len(arr)
    offsets = np.frombuffer(arr.buffers()[1], np.int64, n + 1, arr.offset * 8) if n else np.zeros(1, np.int64)
    raw = arr.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    begin, end = (offsets[:-1] - offsets[0]), (offsets[1:] - offsets[0])
    sizes = np.where(np.asarray(arr.is_valid()), end - begin, 0) if n else np.zeros(0, np.int64)
    filled = sizes > 0
    first = np.zeros(n, np.uint8)
    first[filled] = data[begin[filled]]
    row = np.repeat(np.arange(n), end - begin)

    is_quote = data == QUOTE
    run = np.cumsum(is_quote)
    before = np.concatenate([[0], run])[begin] if n else np.zeros(0, np.int64)
    nth = run - before[row]  # quotes of this row up to and with this byte
    outside = (nth - is_quote) % 2 == 0
    sep = _IS_SEP[data] & outside
    per_row = np.bincount(row, sep, n).astype(np.int64)
    blank = (data == BLANK) & outside
    sep = np.where(per_row[row] > 0, sep, blank)

    # A quote is regular when it opens behind a separator and blanks, doubles the one before it, or closes before one.
    at = np.flatnonzero(is_quote)
    odd = np.zeros(n, bool)
    if len(at):
        solid = np.flatnonzero((data != BLANK) | sep)
        before_at = solid[np.maximum(np.searchsorted(solid, at) - 1, 0)]
        has_before = (np.searchsorted(solid, at) > 0) & (before_at >= begin[row[at]])
        after_i = np.searchsorted(solid, at, "right")
        has_after = after_i < len(solid)
        after_at = solid[np.minimum(after_i, len(solid) - 1)]
        has_after &= after_at < end[row[at]]
        opening = nth[at] % 2 == 1
        doubled_back = (at > begin[row[at]]) & is_quote[np.maximum(at - 1, 0)]
        doubled_on = (at + 1 < end[row[at]]) & is_quote[np.minimum(at + 1, len(data) - 1)]
        good_open = ~has_before | sep[before_at] | (doubled_back & (nth[at] > 1))
        good_close = ~has_after | sep[after_at] | doubled_on
        bad = np.where(opening, ~good_open, ~good_close)
        odd[row[at[bad]]] = True
        odd |= np.bincount(row, is_quote, n).astype(np.int64) % 2 == 1
    nbsp = data == 0xC2  # a two-byte blank may separate only where no other separator is: leave those to the scanner
    if nbsp.any():
        odd |= np.bincount(row, nbsp, n).astype(np.int64) * (per_row == 0) > 0
    single = filled & (odd | (first == BRACKET))
    block = filled & ~single

    # Values of all regular fields: bytes without separators, offsets at separators and field ends.
    use = block[row]
    cuts = np.flatnonzero(sep & use)
    keep = use & ~sep
    kept = np.concatenate([[0], np.cumsum(keep)])
    ends = np.concatenate([cuts, end[block]])
    parents = np.concatenate([row[cuts], np.flatnonzero(block)])
    order = np.lexsort((ends, parents))
    parents, bounds = parents[order], kept[ends[order]]
    child_offsets = np.concatenate([[0], bounds]).astype(np.int64)
    child = pa.LargeStringArray.from_buffers(len(bounds), pa.py_buffer(child_offsets), pa.py_buffer(np.ascontiguousarray(data[keep])))
    child = pc.utf8_trim_whitespace(child)
    if is_quote.any():
        quoted = pc.and_(pc.starts_with(child, '"'), pc.greater_equal(pc.utf8_length(child), 2))
        inner = pc.replace_substring(pc.utf8_slice_codeunits(child, 1, -1), '""', '"')
        child = pc.if_else(quoted, pc.utf8_trim_whitespace(inner), child)
    solid_value = np.asarray(pc.greater(pc.binary_length(child), 0)).astype(bool)
    parents, child = parents[solid_value], child.filter(pa.array(solid_value))

    ones = np.flatnonzero(single)
    if len(ones):
        lists = [split_field(x) for x in arr.take(pa.array(ones)).to_pylist()]
        parents = np.concatenate([parents, np.repeat(ones, [len(x) for x in lists])])
        child = pa.concat_arrays([child, pa.array([y for x in lists for y in x], pa.large_string())])
        order = np.argsort(parents, kind="stable")
        parents, child = parents[order], child.take(pa.array(order))
    starts = np.searchsorted(parents, np.arange(n))
    return parents, np.arange(len(parents)) - starts[parents], child


def explode_packed(df: DataFrame, key: str, field: str, *, value: str = "tag", pos: str = "pos") -> DataFrame:
    """``key, pos, value``: one row per value packed in ``field``. Narrow: no shuffle, one pass over two columns."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parents, at, values = split_block(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(parents)), pa.array(at, pa.int32()), values.cast(pa.string())], names=[key, pos, value])

    return df.select(key, field).mapInArrow(run, f"`{key}` {kind}, `{pos}` int, `{value}` string")
