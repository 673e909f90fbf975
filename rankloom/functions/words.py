"""Words of whole Arrow columns, cut in Python workers by the rules of ``text.WORD``.

The functions that run in tasks are made by factories and use nothing of this module, so they
reach the workers by value.
"""

import functools

import numpy as np
from pyspark.sql import Column, SparkSession, functions as F

from .text import BETWEEN_DIGITS, BETWEEN_LETTERS, ONE_WORD, WORD_INNER, WORD_START

START, INNER, LETTER, DIGIT, MARK, SINGLE, JOINS_LETTERS, JOINS_DIGITS = (1 << n for n in range(8))


def letter_classes(spark: SparkSession) -> np.ndarray:
    """The classes of every code point, as bits, asked of the regular expressions that ``text.tokens`` uses."""
    return _letter_classes(spark.sparkContext._jvm)


@functools.lru_cache(maxsize=1)
def _letter_classes(jvm) -> np.ndarray:
    every = np.concatenate([np.arange(0xD800), np.arange(0xE000, 0x110000)]).astype("<u4")
    text = every.tobytes().decode("utf-32-le")
    bits = np.zeros(0x110000, dtype=np.uint8)
    asked = {
        START: WORD_START, INNER: WORD_INNER, LETTER: r"\p{L}", DIGIT: r"\p{N}", MARK: r"\p{M}", SINGLE: ONE_WORD,
        JOINS_LETTERS: BETWEEN_LETTERS, JOINS_DIGITS: BETWEEN_DIGITS,
    }
    for bit, members in asked.items():
        # characters outside of the class become NUL, which is in none
        left = jvm.java.util.regex.Pattern.compile(f"(?s)(?![{members}]).").matcher(text).replaceAll("\0")
        bits[every[np.frombuffer(left.encode("utf-32-le"), dtype="<u4") != 0]] |= bit
    return bits


def ended(text: Column) -> Column:
    """Lower-cased text, empty for null, with a line break at its end, as ``word_cutter`` wants it."""
    return F.concat(F.coalesce(F.lower(text), F.lit("")), F.lit("\n"))


def word_cutter(slice_bytes: int = 2 << 20):
    """Function ``(column of ended texts, classes) -> iterator of (first row, words, words per row)``.

    Each piece holds the words of some rows in order, as one Arrow array; it ends once its texts exceed
    ``slice_bytes``, so the memory for it is bounded by that or by one text.
    """
    bit = dict(start=START, inner=INNER, letter=LETTER, digit=DIGIT, mark=MARK, single=SINGLE, letters=JOINS_LETTERS, digits=JOINS_DIGITS)

    def borders(points, classes):
        """First and next position of every word among code points."""
        import numpy as np

        kinds = classes[points]
        linked = (kinds & bit["inner"]) != 0
        joints = np.flatnonzero(kinds & (bit["letters"] | bit["digits"]))
        joints = joints[(joints > 0) & (joints < len(kinds) - 1)]
        here, before, after = kinds[joints], kinds[joints - 1], kinds[joints + 1]
        inside = (before & bit["inner"] != 0) & (after & bit["inner"] != 0)
        inside &= points[joints - 1] < 0x10000  # the expression looks back one UTF-16 unit
        letters = (here & bit["letters"] != 0) & (before & (bit["letter"] | bit["mark"]) != 0) & (after & bit["letter"] != 0)
        digits = (here & bit["digits"] != 0) & (before & bit["digit"] != 0) & (after & bit["digit"] != 0)
        linked[joints[inside & (letters | digits)]] = True
        change = np.flatnonzero(np.diff(linked.view(np.int8), prepend=0, append=0))
        first, end = change[::2], change[1::2]
        late = np.flatnonzero(kinds[first] & bit["start"] == 0)  # low lines and marks do not begin a word
        if len(late):
            starts = np.append(np.flatnonzero(kinds & bit["start"]), len(kinds))
            first[late] = starts[np.searchsorted(starts, first[late])]
            kept = first < end
            first, end = first[kept], end[kept]
        alone = np.flatnonzero(kinds & bit["single"])
        if len(alone):
            others = np.append(np.flatnonzero(kinds & bit["mark"] == 0), len(kinds))
            first = np.concatenate([first, alone])
            end = np.concatenate([end, others[np.searchsorted(others, alone + 1)]])
            order = np.argsort(first, kind="stable")
            first, end = first[order], end[order]
        return first, end

    def piece(data, offsets, classes):
        import numpy as np
        import pyarrow as pa

        if len(data) and data.max() >= 128:
            points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), dtype="<u4")
            at = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
        else:
            points, at = data, None
        first, end = borders(points, classes)
        if at is not None:
            first, end = at[first], at[end]
        edges = np.zeros(len(data) + 1, dtype=np.int8)
        edges[first] = 1
        edges[end] -= 1  # words may touch
        letters = data[np.cumsum(edges[:-1], dtype=np.int8).view(bool)]
        places = np.zeros(len(first) + 1, dtype=np.int32)
        np.cumsum(end - first, out=places[1:])
        words = pa.StringArray.from_buffers(len(first), pa.py_buffer(places), pa.py_buffer(letters))
        return words, np.diff(np.searchsorted(first, offsets))

    def cut(column, classes):
        import numpy as np
        import pyarrow as pa

        column = column.cast(pa.large_string())
        offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
        data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
        row = 0
        while row < len(column):
            upto = max(row + 1, int(np.searchsorted(offsets, offsets[row] + slice_bytes, side="right")) - 1)
            upto = min(upto, len(column))
            yield row, *piece(data[offsets[row]:offsets[upto]], offsets[row:upto + 1] - offsets[row], classes)
            row = upto

    return cut
