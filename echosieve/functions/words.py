"""Words and marks of whole Arrow arrays of texts, cut by array operations."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .text import WORD_PATTERN

#: What a byte of a text is.
BLANK, WORD, MARK, REST = range(4)  # REST: bytes of a mark after its first
CODE_POINTS, SURROGATES = 0x110000, (0xD800, 0xDFFF)


@lru_cache(maxsize=1)
def code_point_classes() -> bytes:
    """``BLANK``, ``WORD`` or ``MARK`` for every code point, by ``WORD_PATTERN``.

    Asked of Spark once, so that texts are cut as its regular expressions would cut them.
    """
    word, mark = (f"^(?:{p})$" for p in WORD_PATTERN.rsplit("|", 1))
    points = SparkSession.active().range(CODE_POINTS).filter(
        ~F.col("id").between(*SURROGATES)
    ).select("id", F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32").alias("c"))
    kind = F.when(F.col("c").rlike(word), WORD).when(F.col("c").rlike(mark), MARK).otherwise(BLANK)
    classes = bytearray([MARK]) * CODE_POINTS
    for row in points.select("id", kind.alias("kind")).filter(F.col("kind") != MARK).groupBy(
        "kind"
    ).agg(F.collect_list("id").alias("ids")).collect():
        for point in row.ids:
            classes[point] = row.kind
    return bytes(classes)


def word_cutter(classes: bytes, slab: int = 1 << 19):
    """Function: slabs ``(row, offsets, tokens)`` of an Arrow array of texts.

    ``tokens`` are the words and marks of about ``slab`` bytes, and ``offsets`` says where among
    them those of the row ``row``, and of each row after it, begin.  A text longer than a slab
    goes on in the next one; the cut is at a blank.
    """
    from zlib import compress

    packed = compress(classes)

    def cut(texts):
        from zlib import decompress

        import numpy as np
        import pyarrow as pa

        of_point = np.frombuffer(decompress(packed), np.uint8)
        of_ascii = of_point[:128].tobytes() + bytes(128)
        texts = texts.cast(pa.large_binary()).fill_null(b"")
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:][:len(texts) + 1]
        if not len(texts) or offsets[-1] == offsets[0]:
            return
        data = memoryview(texts.buffers()[2])[offsets[0]:offsets[-1]]
        offsets = offsets - offsets[0]
        blanks = tuple(bytes([b]) for b in range(128) if of_point[b] == BLANK)

        def stop_of(at):
            """Where the slab from ``at`` ends: at the end of a row or after a blank."""
            if at + slab >= len(data):
                return len(data)
            row = int(offsets[np.searchsorted(offsets, at + slab, side="right") - 1])
            if row > at:
                return row
            end = int(offsets[np.searchsorted(offsets, at, side="right")])
            part = bytes(data[at:at + slab])
            last = max(part.rfind(b) for b in blanks)
            while last < 0:  # a slab without a blank
                begin = at + len(part)
                more = bytes(data[begin:min(begin + slab, end)])
                if not more:
                    return end
                found = [f for f in map(more.find, blanks) if f >= 0]
                last = len(part) + min(found) if found else -1
                part += more
            return at + last + 1

        def classes_of(raw):
            kinds = np.frombuffer(raw.translate(of_ascii), np.uint8)
            raw = np.frombuffer(raw, np.uint8)
            lead = np.flatnonzero(raw >= 0xC0)
            if not len(lead):
                return kinds
            kinds = kinds.copy()
            first = raw[lead].astype(np.int32)
            for size, low, high, bits in ((2, 0xC0, 0xE0, 31), (3, 0xE0, 0xF0, 15), (4, 0xF0, 0xF8, 7)):
                mine = (first >= low) & (first < high)
                at, point = lead[mine], first[mine] & bits
                for k in range(1, size):
                    point = point << 6 | raw[at + k] & 63
                kind = of_point[point]
                kinds[at] = kind
                rest = np.where(kind == MARK, np.uint8(REST), kind)
                for k in range(1, size):
                    kinds[at + k] = rest
            return kinds

        at = 0
        while at < len(data):
            stop = stop_of(at)
            raw = bytes(data[at:stop])
            first = int(np.searchsorted(offsets, at, side="right")) - 1
            last = int(np.searchsorted(offsets, stop, side="left"))
            bounds = np.clip(offsets[first:last + 1], at, stop) - at
            kinds = classes_of(raw)
            words = kinds == WORD
            begins = words.copy()
            begins[1:] &= ~words[:-1]
            rows = bounds[:-1]
            rows = rows[rows < len(raw)]
            begins[rows] |= words[rows]
            begins |= kinds == MARK
            within = kinds != BLANK
            starts = np.flatnonzero(begins[within])
            text = np.frombuffer(raw, np.uint8)[within]
            ends = np.append(starts, len(text)).astype(np.int32)
            tokens = pa.StringArray.from_buffers(len(starts), pa.py_buffer(ends), pa.py_buffer(text))
            yield first, np.searchsorted(np.flatnonzero(begins), bounds), tokens
            at = stop

    def valid(texts):
        """``texts``, with U+FFFD for what is no UTF-8, as Spark's regular expressions see them."""
        import pyarrow as pa

        try:
            texts.validate(full=True)
            return texts
        except pa.ArrowInvalid:
            raw = texts.cast(pa.large_binary()).to_pylist()
            return pa.array(
                [None if t is None else t.decode("utf-8", "replace") for t in raw], pa.large_string()
            )

    return lambda texts: cut(valid(texts))
