"""MinHash signatures and bands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..params import BandShape
from .words import code_point_classes, word_cutter

# Hash family h -> (a*h + b) mod PRIME, with a and b drawn in
# turn from the generator x -> MULTIPLIER*x mod PRIME started at 1.
PRIME = 2**31 - 1
MULTIPLIER = 48271


def coefficients(count: int) -> list[tuple[int, int]]:
    """``count`` pairs ``(a, b)`` of the hash family."""
    values, x = [], 1
    for _ in range(2 * count):
        x = x * MULTIPLIER % PRIME
        values.append(x)
    return list(zip(values[::2], values[1::2]))


# Shifts by round, and tokens of at most so many bytes that fill one block of MD5.
TURNS = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
ONE_BLOCK = 55


def token_hasher():
    """Function: the first 32 bits of the MD5 of every string of an Arrow array, as uint32.

    It takes a few thousand tokens at a time: a step of MD5 is a few operations on arrays, where
    a call of a digest for each token costs several times as much.  Long tokens are digested one
    by one.
    """

    def token_hashes(tokens, block=8192):
        from hashlib import md5
        from math import sin

        import numpy as np
        import pyarrow.compute as pc

        sines = [np.uint32(int(abs(sin(i + 1)) * 2**32)) for i in range(64)]
        sizes = pc.binary_length(tokens).to_numpy(zero_copy_only=False)
        out = np.empty(len(tokens), np.uint32)
        for at in range(0, len(tokens), block):
            part, size = tokens.slice(at, block), sizes[at:at + block]
            n, long = len(part), np.flatnonzero(size > ONE_BLOCK)
            digests = [md5(part[int(i)].as_py().encode()).digest() for i in long]
            if len(long):
                part, size = pc.if_else(pc.greater(pc.binary_length(part), ONE_BLOCK), "", part), size.copy()
                size[long] = 0
            padded = pc.ascii_rpad(part, width=64, padding="\0")  # bytes, whatever they spell
            raw = np.frombuffer(padded.buffers()[2], np.uint8)[:64 * n].reshape(n, 64).copy()
            raw[np.arange(n), size] = 128
            words = np.ascontiguousarray(raw.view("<u4").T)
            words[14] = size * 8
            a, b, c, d = (
                np.full(n, v, np.uint32) for v in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
            )
            f, high = np.empty(n, np.uint32), np.empty(n, np.uint32)
            for i in range(61):  # the first word of the digest takes no part in the last three steps
                turn = i // 16
                if turn == 0:
                    np.bitwise_xor(c, d, out=f)
                    f &= b
                    f ^= d
                elif turn == 1:
                    np.bitwise_xor(b, c, out=f)
                    f &= d
                    f ^= c
                elif turn == 2:
                    np.bitwise_xor(b, c, out=f)
                    f ^= d
                else:
                    np.bitwise_not(d, out=f)
                    f |= b
                    f ^= c
                f += a
                f += words[(i, 5 * i + 1, 3 * i + 5, 7 * i)[turn] % 16]
                f += sines[i]
                shift = TURNS[turn][i % 4]
                np.right_shift(f, np.uint32(32 - shift), out=high)
                f <<= np.uint32(shift)
                f |= high
                f += b
                a, b, c, d, f = d, f, b, c, a
            out[at:at + n] = (b + np.uint32(0x67452301)).byteswap()
            for i, digest in zip(long, digests):
                out[at + i] = int.from_bytes(digest[:4], "big")
        return out

    return token_hashes


def _mixer(count: int):
    """Functions: ``reduce(x, high)``, x modulo PRIME as uint32, with x and high as its room, and
    ``mixed(words)``, a row of ``count`` hash values for each string of an Arrow array."""
    pairs = coefficients(count)
    prime = PRIME
    token_hashes = token_hasher()

    def reduce(x, high):
        import numpy as np

        # x mod (2^31 - 1): fold the high bits onto the low ones, which
        # leaves at most 2 * PRIME - 2, and subtract PRIME where possible
        # (where not, the unsigned difference wraps to a huge number).
        np.right_shift(x, np.uint64(31), out=high)
        x &= np.uint64(prime)
        x += high
        low = x.astype(np.uint32)
        return np.minimum(low, low - np.uint32(prime))

    def mixed(words):
        import numpy as np

        a = np.array([p[0] for p in pairs], dtype=np.uint64)
        b = np.array([p[1] for p in pairs], dtype=np.uint64)
        values = token_hashes(words).astype(np.uint64) % np.uint64(prime)
        table = np.empty((len(words), count), dtype=np.int32)
        for at in range(0, len(words), 256):
            x = values[at : at + 256, None] * a
            x += b
            table[at : at + 256] = reduce(x, np.empty_like(x))
        return table

    return reduce, mixed


def _of_tokens(mixed):
    """Function: lower the minima ``out[row]`` of each row by those of its tokens, which begin at
    ``offsets[row]``.  Every distinct token is hashed once and then looked up by the rows that
    hold it."""

    def lower(out, offsets, tokens):
        import numpy as np

        coded = tokens.dictionary_encode()
        table = mixed(coded.dictionary)
        # The distinct tokens of each row.
        rows = np.repeat(np.arange(len(offsets) - 1) * len(table), np.diff(offsets))
        held = np.sort(rows + coded.indices.to_numpy())
        held = held[np.append(True, held[1:] != held[:-1])] if len(held) else held
        bounds = np.searchsorted(held, np.arange(len(offsets)) * len(table))
        which = held - np.repeat(np.arange(len(offsets) - 1) * len(table), np.diff(bounds))
        for row, (lo, hi) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
            for part in range(lo, hi, 512):
                found = table[which[part : min(part + 512, hi)]].min(axis=0)
                np.minimum(out[row], found, out=out[row])

    return lower


def signature(tokens: Column, count: int, run: int = 1, slab: int = 1 << 17) -> Column:
    """``count`` minima over a set of tokens, or of runs of ``run`` tokens joined by a blank;
    PRIME each when it is empty.

    A token hash is the first 32 bits of the MD5 modulo PRIME.  Repeats do not matter.  An Arrow
    batch arrives as one flat string array with row offsets and is worked off in slabs of
    ``slab`` tokens, so memory stays bounded however long a document is.  Within a slab every
    distinct token is hashed once.  Runs hardly ever repeat, so each is hashed where it stands.
    """
    pairs = coefficients(count)
    prime = PRIME
    token_hashes = token_hasher()
    reduce, mixed = _mixer(count)
    lower = _of_tokens(mixed)

    @F.arrow_udf("array<int>")
    def minima(batch):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        offsets = batch.offsets.to_numpy().astype(np.int64)
        tokens = batch.values.slice(offsets[0], offsets[-1] - offsets[0])
        offsets = offsets - offsets[0]
        out = np.full((len(batch), count), prime, dtype=np.int32)

        def of_tokens():
            for at in range(0, len(tokens), slab):
                part = tokens.slice(at, slab)
                first = int(np.searchsorted(offsets, at, side="right")) - 1
                last = int(np.searchsorted(offsets, at + len(part), side="left"))
                lower(out[first:last], np.clip(offsets[first:last + 1] - at, 0, len(part)), part)

        def of_runs():
            for at in range(0, len(tokens) - run + 1, slab // 4):
                n = min(slab // 4, len(tokens) - run + 1 - at)
                starts = np.arange(at, at + n)
                row = np.searchsorted(offsets, starts, side="right") - 1
                within = starts + run <= offsets[row + 1]
                if not within.any():
                    continue
                joined = pc.binary_join_element_wise(
                    *[tokens.slice(at + k, n) for k in range(run)], " "
                )
                values = (token_hashes(joined).astype(np.uint64) % np.uint64(prime))[within]
                rows, first = np.unique(row[within], return_index=True)
                x, high = np.empty_like(values), np.empty_like(values)
                for k, (a, b) in enumerate(pairs):
                    np.multiply(values, np.uint64(a), out=x)
                    x += np.uint64(b)
                    least = np.minimum.reduceat(reduce(x, high), first)
                    out[rows, k] = np.minimum(out[rows, k], least)

        of_tokens() if run == 1 else of_runs()
        starts = pa.array(np.arange(len(batch) + 1, dtype=np.int32) * count)
        return pa.ListArray.from_arrays(starts, pa.array(out.ravel()))

    return minima(tokens)


def _text_minima(count: int, slab: int):
    """Function: the minima of an Arrow array of texts, a row each."""
    prime = PRIME
    cut = word_cutter(code_point_classes(), slab)
    lower = _of_tokens(_mixer(count)[1])

    def minima(texts):
        import numpy as np

        out = np.full((len(texts), count), prime, dtype=np.int32)
        for first, offsets, tokens in cut(texts):
            lower(out[first:], offsets, tokens)
        return out

    return minima


def text_signature(text: Column, count: int, slab: int = 1 << 19) -> Column:
    """``signature`` of the words and marks of a text, which are cut there as well: the JVM sends
    texts, not words.  A slab is so many bytes of text."""
    minima = _text_minima(count, slab)

    @F.arrow_udf("array<int>")
    def signed(texts):
        import numpy as np
        import pyarrow as pa

        starts = pa.array(np.arange(len(texts) + 1, dtype=np.int32) * count)
        return pa.ListArray.from_arrays(starts, pa.array(minima(texts).ravel()))

    return signed(text)


def text_buckets(text: Column, shape: BandShape, slab: int = 1 << 19) -> Column:
    """The ``bucket_keys`` of the signature of a text; hashes beyond the last band are not needed."""
    bands, rows = shape.bands, shape.rows
    minima = _text_minima(bands * rows, slab)

    @F.arrow_udf("array<binary>")
    def keys(texts):
        from hashlib import md5

        import pyarrow as pa

        names = [f"{band}:" for band in range(bands)]
        found = []
        for sig in minima(texts).tolist():
            values = list(map(str, sig))
            found.append([
                md5((name + ",".join(values[at:at + rows])).encode()).digest()
                for name, at in zip(names, range(0, bands * rows, rows))
            ])
        return pa.array(found, pa.list_(pa.binary()))

    return keys(text)


def signature_text(sig: Column) -> Column:
    return F.array_join(sig.cast("array<string>"), ",")


def band_texts(sig: Column, shape: BandShape) -> list[Column]:
    """Per band the text ``band:v1,v2,…`` whose MD5 names the bucket."""
    return [
        F.concat(
            F.lit(f"{band}:"), signature_text(F.slice(sig, band * shape.rows + 1, shape.rows))
        )
        for band in range(shape.bands)
    ]


def bucket_keys(sig: Column, shape: BandShape) -> Column:
    """The buckets of a signature as 16-byte keys, one per band."""
    return F.array(*[F.unhex(F.md5(text)) for text in band_texts(sig, shape)])
