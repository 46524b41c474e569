"""Small sequential models of the rules, written for the tests only."""

from __future__ import annotations

import hashlib
import re

import regex

from echosieve.functions.minhash import PRIME, coefficients
from echosieve.functions.text import WORD_PATTERN


def first_seen(keys):
    """Positions whose key is new, given ``[(pos, key)]``."""
    seen, kept = set(), []
    for pos, key in sorted(keys):
        if key not in seen:
            seen.add(key)
            kept.append(pos)
    return kept


def filtered(prints, m, k):
    """A sequential Bloom filter over ``[(pos, fp)]``: kept positions and bits set."""
    array, kept = set(), []
    for pos, fp in sorted(prints):
        bits = {
            int(hashlib.sha256(f"{fp}{i}".encode()).hexdigest(), 16) % m for i in range(k)
        }
        if not bits <= array:
            array |= bits
            kept.append(pos)
    return kept, len(array)


def chosen(rows):
    """First-come selection over ``{pos: buckets}``: kept list and ``{pos: owner}``."""
    held, kept, owner = {}, [], {}
    for pos in sorted(rows):
        hits = [held[b] for b in rows[pos] if b in held]
        if hits:
            owner[pos] = min(hits)
        else:
            kept.append(pos)
            held.update({b: pos for b in rows[pos]})
    return kept, owner


def words(text):
    return set(regex.findall(WORD_PATTERN, text))


def shingles(text, n):
    parts = text.split()
    return {" ".join(parts[i : i + n]) for i in range(len(parts) - n + 1)}


def signature(tokens, count):
    hashes = [int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % PRIME for t in tokens]
    return [min(((a * h + b) % PRIME for h in hashes), default=PRIME) for a, b in coefficients(count)]


def band_keys(sig, shape):
    return {
        (band, tuple(sig[band * shape.rows : (band + 1) * shape.rows]))
        for band in range(shape.bands)
    }


def signature_print(sig):
    return hashlib.sha256(",".join(map(str, sig)).encode()).hexdigest()


def text_lines(text):
    parts = re.split("\r\n|[\n\x0b\x0c\r\x85  ]", text)
    return parts[:-1] if parts[-1] == "" else parts
