"""Loading raw lines and records: valid rows as tags, the others with the reason.

Both inputs go through the finite-state tokenizer of :mod:`tagloom.operators.tokenizer`
batch by batch, where they are read; nothing is shuffled. Output rows are

``(src, row_no, pos, seq, id, ns, key, value, reason, at, overlong)``

A valid line gives one row per tag, numbered by ``pos`` (one row without key if it has an
id only); a valid record gives one row. An invalid one gives a single row with ``reason``
and ``at``, the offset in characters where the fault lies. No row is walked in Python: parts
are stretches of one text, found and cut out for a whole batch at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.operators import tokenizer as fsm

SCHEMA = "src string, row_no bigint, pos bigint, seq bigint, id string, ns string, key string, value string, reason string, at int, overlong string"
_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
_TYPES = [pa.string(), *[pa.int64()] * 3, *[pa.string()] * 5, pa.int32(), pa.string()]
#: Reasons, first wins.
REASONS = ("quoting", "columns", "value")
_NONE = len(REASONS)

_BARE_NEXT = fsm.char_set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_+-.", 128)
_MAX_BIGINT = 2**63 - 1


def _rows(size: int, **columns: pa.Array) -> pa.RecordBatch:
    """Rows of :data:`SCHEMA`; columns not named are NULL."""
    made = [columns[n].cast(t) if n in columns else pa.nulls(size, t) for n, t in zip(_NAMES, _TYPES, strict=True)]
    return pa.RecordBatch.from_arrays(made, _NAMES)


def _joined(*batches: pa.RecordBatch) -> pa.RecordBatch:
    return pa.Table.from_batches(batches).combine_chunks().to_batches()[0] if any(b.num_rows for b in batches) else batches[0]


def _same(text: str, size: int) -> pa.Array:
    return pa.array([text]).take(pa.array(np.zeros(size, np.int64)))


def _bad(src: str, numbers: pa.Array, which: np.ndarray, reason: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    names = pa.array(REASONS).take(pa.array(reason[which].astype(np.int64)))
    return _rows(len(which), src=_same(src, len(which)), row_no=numbers.take(pa.array(which)), reason=names, at=pa.array(at[which]))


def _within(mask: np.ndarray) -> np.ndarray:
    """Prefix counts: those in [a, b) are c[b] - c[a]."""
    return np.concatenate([[0], np.cumsum(mask)])


def _next_at(positions: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The first of the sorted positions in [start, end), else end."""
    at = np.searchsorted(positions, start)
    found = np.append(positions, np.iinfo(np.int64).max)[at]
    return np.minimum(found, end)


def parse_lines(numbers: pa.Array, texts: pa.Array) -> pa.RecordBatch:
    """Lines ``<id> <tag>…``. Blank and NULL lines are skipped; the id isn't checked. A
    tag's parts are what its unquoted ``=``, and ``:`` before the first ``=``, separate."""
    laid = fsm.Texts(texts)
    chars, lengths, first = laid.chars, laid.lengths, laid.first
    classes = fsm.classify(chars, fsm.WHITE)
    before, ends = fsm.LINE.run(classes, lengths)
    quote = chars == ord('"')
    in_field = (before == fsm.QUOTED) | (classes != 2)
    open_text = (before != fsm.QUOTED) & ~quote & in_field  # neither quoted nor a quote

    # Fields: stretches of in_field that don't run over the border of two texts.
    border = np.zeros(len(chars) + 1, bool)
    border[first] = True
    border = border[:-1]
    starts = np.flatnonzero(in_field & (border | ~np.concatenate([[False], in_field[:-1]])))
    stops = np.flatnonzero(in_field & (np.concatenate([border[1:], [True]]) | ~np.concatenate([in_field[1:], [False]]))) + 1
    line = np.searchsorted(first + lengths, starts, "right")
    n_fields = np.bincount(line, minlength=len(lengths))
    rank = np.arange(len(starts)) - np.repeat(np.cumsum(n_fields) - n_fields, n_fields)
    tag = rank > 0
    t_start, t_stop, t_line = starts[tag], stops[tag], line[tag]

    equals = np.flatnonzero(open_text & (chars == ord("=")))
    colons = np.flatnonzero(open_text & (chars == ord(":")))
    first_eq = _next_at(equals, t_start, t_stop)
    n_eq = np.searchsorted(equals, t_stop) - np.searchsorted(equals, t_start)
    n_colon = np.searchsorted(colons, first_eq) - np.searchsorted(colons, t_start)

    # Parts: between the separators of a tag.
    def inside(positions: np.ndarray, until: np.ndarray) -> np.ndarray:
        of = np.searchsorted(t_start, positions, "right") - 1
        return (of >= 0) & (positions < until[np.maximum(of, 0)]) if len(t_start) else np.zeros(len(positions), bool)

    cuts = np.sort(np.concatenate([equals[inside(equals, t_stop)], colons[inside(colons, first_eq)]]))
    p_start = np.sort(np.concatenate([t_start, cuts + 1]))
    p_tag = np.searchsorted(t_start, p_start, "right") - 1
    # A cut at the end of a tag begins an empty part, which may lie at the next tag's border.
    p_stop = _next_at(cuts, p_start, t_stop[p_tag]) if len(p_start) else p_start
    n_quote = _within(quote)
    n_open = _within(open_text)
    bare_ok = np.zeros(len(chars), bool)
    small = chars < 128
    bare_ok[small] = _BARE_NEXT[chars[small]]
    n_bad = _within(~bare_ok)
    size = p_stop - p_start
    quotes, plain = n_quote[p_stop] - n_quote[p_start], n_open[p_stop] - n_open[p_start]
    head = np.append(chars, 0)[np.minimum(p_start, len(chars))]
    mixed = (quotes > 0) & (plain > 0)
    wrong = (size == 0) | (quotes == 0) & ((n_bad[p_stop] - n_bad[p_start] > 0) | (head == ord(".")) | (size == 1) & (head == ord("+")))

    reason = np.full(len(lengths), _NONE)
    at = np.full(len(lengths), np.iinfo(np.int64).max)

    def fault(kind: int, lines: np.ndarray, positions: np.ndarray) -> None:
        new = reason[lines] == _NONE
        lines, positions = lines[new], positions[new]
        np.minimum.at(at, lines, positions)
        reason[lines] = kind

    unclosed = np.flatnonzero(ends == fsm.QUOTED)
    last_quote = np.flatnonzero(quote)
    opened = last_quote[np.searchsorted(last_quote, (first + lengths)[unclosed]) - 1] if len(unclosed) else unclosed
    fault(0, np.concatenate([unclosed, t_line[p_tag[mixed]]]), np.concatenate([opened, p_start[mixed]]))
    many = (n_eq > 1) | (n_colon > 1)
    fault(1, t_line[many], t_start[many])
    fault(2, t_line[p_tag[wrong]], p_start[wrong])

    bad = np.flatnonzero((n_fields > 0) & (reason != _NONE))
    field = np.cumsum(n_fields) - n_fields  # where a line's fields begin
    alone = np.flatnonzero((n_fields == 1) & (reason == _NONE))
    good = np.flatnonzero(reason[t_line] == _NONE)
    of = t_line[good]
    k = np.searchsorted(p_tag, good)
    with_ns, with_value = n_colon[good] > 0, n_eq[good] > 0

    def part(at: np.ndarray, present: np.ndarray | None = None) -> pa.Array:
        at = np.minimum(at, max(len(p_start) - 1, 0))
        return laid.tokens(p_start[at], p_stop[at], present)

    def ids(lines: np.ndarray) -> pa.Array:
        return laid.take(starts[field[lines]], stops[field[lines]])

    number = numbers.take(pa.array(of))
    tags = _rows(
        len(good), src=_same("lines", len(good)), row_no=number, seq=number, pos=pa.array(rank[tag][good] - 1), id=ids(of),
        ns=part(k, with_ns), key=part(k + with_ns), value=part(k + with_ns + 1, with_value),
    )
    number = numbers.take(pa.array(alone))
    return _joined(tags, _rows(len(alone), src=_same("lines", len(alone)), row_no=number, seq=number, id=ids(alone)), _bad("lines", numbers, bad, reason, at - first))


def _numbers(texts: pa.Array, name: str) -> tuple[pa.Array, pa.Array]:
    """Digits as 64-bit numbers, and the text of those that are none."""
    bare = pc.utf8_ltrim(texts, "0")
    size = pc.utf8_length(bare).to_numpy(zero_copy_only=False)
    out = pc.if_else(pa.array(size == 0), "0", pc.if_else(pa.array(size <= 18), bare, pa.scalar(None, pa.large_string()))).cast(pa.int64())
    rest = [(i, bare[i].as_py()) for i in np.flatnonzero(size > 18).tolist()]  # few: 19 digits or more
    if not rest:
        return out, pa.nulls(len(texts), pa.string())
    values = out.to_pylist()
    over: list[str | None] = [None] * len(values)
    for i, text in rest:
        if len(text) == 19 and int(text) <= _MAX_BIGINT:
            values[i] = int(text)
        else:
            over[i] = f"{name}={text}"
    return pa.array(values, pa.int64()), pa.array(over, pa.string())


def parse_records(numbers: pa.Array, texts: pa.Array) -> pa.RecordBatch:
    """Records ``seq,pos,id,ns,key,value``. An unquoted empty field is absent, ``""`` is
    empty. A NULL record has one absent field, so its columns are wrong. A ``seq`` or ``pos``
    that doesn't fit 64 bits is valid; it is NULL, and stands in ``overlong`` as text."""
    laid = fsm.Texts(texts)
    chars, lengths, first = laid.chars, laid.lengths, laid.first
    classes = fsm.classify(chars, fsm.COMMA)
    before, ends = fsm.RECORD.run(classes, lengths)
    stop = first + lengths
    commas = np.flatnonzero((classes == 2) & (before != fsm.INSIDE) & (before != fsm.BROKEN))
    lo, n_commas = np.searchsorted(commas, first), np.searchsorted(commas, stop) - np.searchsorted(commas, first)

    reason = np.full(len(lengths), _NONE)
    broken = _next_at(np.flatnonzero(before == fsm.BROKEN), first, stop)
    quoting, columns = (ends == fsm.INSIDE) | (ends == fsm.BROKEN), n_commas != 5
    reason[columns], reason[quoting] = 1, 0
    sixth = np.append(commas, 0)[np.minimum(lo + 5, len(commas))]
    at = np.where(quoting, np.where(broken < stop, broken - 1, stop), np.where(n_commas > 5, sixth, stop))

    # The six fields of the others, with and without quotes around.
    left = np.flatnonzero(reason == _NONE)
    inner = np.append(commas, 0)[np.minimum(lo[left, None] + np.arange(5), len(commas))]
    a = np.column_stack([first[left, None], inner + 1])
    b = np.column_stack([inner, stop[left, None]])
    quoted = (b > a) & (np.append(chars, 0)[a] == ord('"'))
    x, y = a + quoted, np.maximum(b - quoted, a + quoted)
    digit = (chars >= ord("0")) & (chars <= ord("9"))
    small = chars < len(fsm.WHITE)
    white = np.zeros(len(chars), bool)
    white[small] = fsm.WHITE[chars[small]]

    def some(mask: np.ndarray, k: int) -> np.ndarray:
        count = _within(mask)
        return count[y[:, k]] > count[x[:, k]]

    empty = y == x
    replaced = _within(chars == 0xFFFD)
    fault = replaced[b] > replaced[a]
    fault[:, 0] |= empty[:, 0] | some(~digit, 0) | ~some(digit & (chars != ord("0")), 0)
    fault[:, 1] |= empty[:, 1] | some(~digit, 1)
    fault[:, 2] |= empty[:, 2]
    fault[:, 3] |= ~empty[:, 3] & ~some(~white, 3)
    fault[:, 4] |= empty[:, 4] | ~some(~white, 4)
    wrong = fault.any(1)
    reason[left[wrong]] = 2
    at[left[wrong]] = a[wrong, fault[wrong].argmax(1)]
    good = left[~wrong]
    a, b, present = a[~wrong], b[~wrong], (b > a)[~wrong]
    seq, long_seq = _numbers(laid.tokens(a[:, 0], b[:, 0]), "seq")
    pos, long_pos = _numbers(laid.tokens(a[:, 1], b[:, 1]), "pos")
    field = lambda k: laid.tokens(a[:, k], b[:, k], present[:, k])
    rows = _rows(
        len(good), src=_same("export", len(good)), row_no=numbers.take(pa.array(good)), pos=pos, seq=seq, id=field(2), ns=field(3), key=field(4), value=field(5),
        overlong=pc.coalesce(pc.binary_join_element_wise(long_seq, long_pos, " "), long_seq, long_pos),
    )
    return _joined(rows, _bad("export", numbers, np.flatnonzero(reason != _NONE), reason, at - first))


def _mapped(parse):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield parse(batch.column(0).cast(pa.int64()), batch.column(1))

    return run


def load_lines(lines: DataFrame) -> DataFrame:
    """``(seq, value)`` rows of raw lines to :data:`SCHEMA`."""
    return lines.select("seq", "value").mapInArrow(_mapped(parse_lines), SCHEMA)


def load_export(export: DataFrame) -> DataFrame:
    """``(row_no, raw)`` rows of raw records to :data:`SCHEMA`."""
    return export.select("row_no", "raw").mapInArrow(_mapped(parse_records), SCHEMA)


def load(lines: DataFrame, export: DataFrame) -> DataFrame:
    return load_lines(lines).unionByName(load_export(export))


def rejected(lines: DataFrame, export: DataFrame) -> DataFrame:
    """``(src, row_no, reason)``: each bad row once, however often it was delivered."""
    return load(lines, export).filter(F.col("reason").isNotNull()).select("src", "row_no", "reason").distinct()


def loaded_tags(lines: DataFrame, export: DataFrame) -> DataFrame:
    """The valid rows as ``(src, row_no, pos, id, ns, key, value)``, each once."""
    good = load(lines, export).filter(F.col("reason").isNull() & F.col("key").isNotNull())
    return good.select("src", "row_no", "pos", "id", "ns", "key", "value").distinct()
