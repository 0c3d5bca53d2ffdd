"""A quote-aware finite-state tokenizer over many texts at once.

The states of all characters of a batch are found without walking any text from its
start: texts are cut into chunks of fixed length; a chunk's effect is a function from the
state before it to the state after it, found for all states side by side; these functions
compose, and a prefix composition over the chunks of a text, in a logarithmic number of
steps, gives each chunk's true start. So one very long text costs what many short ones do.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Characters of a chunk.
CHUNK = 128


@dataclass(frozen=True)
class Machine:
    """table[state, class] is the next state. Classes are small integers; the machine
    starts in state 0."""

    table: np.ndarray

    def run(self, classes: np.ndarray, lengths: np.ndarray, chunk: int = CHUNK) -> tuple[np.ndarray, np.ndarray]:
        """(state before each character, state after each text)."""
        states, stop = self.table.shape[0], self.table.shape[1]
        table = np.column_stack([self.table, np.arange(states)]).astype(np.uint8)  # padding changes nothing
        first = np.cumsum(lengths) - lengths
        per = np.maximum((lengths + chunk - 1) // chunk, 1)
        owner = np.repeat(np.arange(len(lengths)), per)
        rank = np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)
        begin = first[owner] + rank * chunk
        left = np.clip(lengths[owner] - rank * chunk, 0, chunk)
        padded = np.append(classes, stop).astype(np.uint8)
        offsets = np.arange(chunk)
        grid = padded[np.where(offsets < left[:, None], begin[:, None] + offsets, len(classes))]
        effect = np.tile(np.arange(states, dtype=np.uint8), (len(owner), 1))
        for i in range(chunk):
            effect = table[effect, grid[:, i, None]]
        # prefix[k] composes the effects of a text's chunks up to and with k.
        prefix, reach = effect, 1
        while len(rank) and reach <= rank.max():
            joins = np.flatnonzero(rank >= reach)
            merged = prefix.copy()
            merged[joins] = np.take_along_axis(prefix[joins], prefix[joins - reach], 1)
            prefix, reach = merged, reach * 2
        state = np.zeros(len(owner), np.uint8)
        later = np.flatnonzero(rank > 0)
        state[later] = prefix[later - 1, 0]
        before = np.empty(grid.shape, np.uint8)
        for i in range(chunk):
            before[:, i] = state
            state = table[state, grid[:, i]]
        ends = prefix[np.cumsum(per) - 1, 0] if len(per) else np.zeros(0, np.uint8)
        return before[offsets < left[:, None]], ends


# Lines: between fields, in a field outside quotes, inside quotes.
GAP, FIELD, QUOTED = 0, 1, 2
_OTHER, _QUOTE, _SEPARATOR = 0, 1, 2
LINE = Machine(np.array([[FIELD, QUOTED, GAP], [FIELD, QUOTED, GAP], [QUOTED, FIELD, QUOTED]]))

# Comma-separated records: at a field's start, in a plain field, inside quotes, after a
# quote inside quotes (its end, or half of a doubled one), broken.
START, PLAIN, INSIDE, CLOSED, BROKEN = range(5)
RECORD = Machine(
    np.array(
        [
            [PLAIN, INSIDE, START],
            [PLAIN, BROKEN, START],
            [INSIDE, CLOSED, INSIDE],
            [BROKEN, INSIDE, START],
            [BROKEN, BROKEN, BROKEN],
        ]
    )
)


class Texts:
    """Texts laid end to end: ``chars`` are their characters as numbers, text i being
    chars[first[i] : first[i] + lengths[i]]. NULL counts as empty."""

    def __init__(self, texts: pa.Array) -> None:
        whole = pc.fill_null(texts.cast(pa.large_string()), "")
        self.lengths = pc.utf8_length(whole).to_numpy(zero_copy_only=False).astype(np.int64)
        self.first = np.cumsum(self.lengths) - self.lengths
        _, offsets, data = whole.buffers()
        edges = np.frombuffer(offsets, np.int64)[whole.offset : whole.offset + len(whole) + 1]
        self.bytes = np.frombuffer(data, np.uint8)[edges[0] : edges[-1]] if data is not None and len(whole) else np.zeros(0, np.uint8)
        self.chars = np.frombuffer(self.bytes.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        width = 1 + (self.chars >= 0x80).astype(np.int64) + (self.chars >= 0x800) + (self.chars >= 0x10000)
        self.byte_at = np.concatenate([[0], np.cumsum(width)])

    def take(self, start: np.ndarray, stop: np.ndarray, present: np.ndarray | None = None) -> pa.Array:
        """The stretches [start, stop) of characters as strings, NULL where not present."""
        low, size = self.byte_at[start], self.byte_at[stop] - self.byte_at[start]
        if present is not None:
            size = np.where(present, size, 0)
        offsets = np.concatenate([[0], np.cumsum(size)])
        data = self.bytes[np.repeat(low - offsets[:-1], size) + np.arange(offsets[-1])]
        made = pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes()))
        return made if present is None else pc.if_else(pa.array(present), made, pa.scalar(None, pa.large_string()))

    def tokens(self, start: np.ndarray, stop: np.ndarray, present: np.ndarray | None = None) -> pa.Array:
        """As ``take``, quotes around a stretch stripped and those inside undoubled."""
        quoted = (stop > start) & (np.append(self.chars, 0)[start] == ord('"'))
        return pc.replace_substring(self.take(start + quoted, np.maximum(stop - quoted, start + quoted), present), '""', '"')


def classify(chars: np.ndarray, separators: np.ndarray) -> np.ndarray:
    """Class of each character: the quote, a separator, or other. separators: by number,
    true or false."""
    out = np.zeros(len(chars), np.uint8)
    out[chars == ord('"')] = _QUOTE
    small = chars < len(separators)
    out[small] = np.where(separators[chars[small]], _SEPARATOR, out[small])
    return out


def char_set(members: str | list[int], size: int = 0x3001) -> np.ndarray:
    out = np.zeros(size, bool)
    out[[ord(c) if isinstance(c, str) else c for c in members]] = True
    return out


#: Unicode White_Space (fixed values).
WHITE = char_set([*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
COMMA = char_set(",")
