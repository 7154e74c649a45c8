"""md5 of many short texts at once: every head joined to every tail, in numpy.

A call of hashlib for each text takes most of the time of a bootstrap. Here one step of md5 is done for a block of texts.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

BLOCK = 16_384  # texts hashed together; the arrays of a block stay in a core's cache
SHIFTS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
PLACES = ((1, 0), (5, 1), (3, 5), (7, 0))  # step and start of the words read in each of the four rounds
START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
SINES = [int(x) for x in np.floor(np.abs(np.sin(np.arange(1, 65, dtype=np.float64))) * 2.0**32).astype(np.uint64)]


def _compress(state: list[np.ndarray], words: list[np.ndarray]) -> list[np.ndarray]:
    """One 64-byte block; a word is an array of heads by tails, or of tails alone."""
    a, b, c, d = (x.copy() for x in state)
    f, t = np.empty_like(a), np.empty_like(a)
    for i in range(64):
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
            np.invert(d, out=f)
            f |= b
            f ^= c
        step, start = PLACES[turn]
        f += a
        f += words[(start + step * i) % 16] + np.uint32(SINES[i])
        shift = SHIFTS[turn][i % 4]
        np.left_shift(f, np.uint32(shift), out=t)
        f >>= np.uint32(32 - shift)
        f |= t
        f += b
        a, b, c, d, f = d, f, b, c, a
    return [x + y for x, y in zip(state, (a, b, c, d))]


def md5_words(heads: Sequence[bytes], tails: Sequence[bytes]) -> np.ndarray:
    """The four words of md5(head + tail), heads by tails by 4, each the number that its eight hex digits write."""
    out = np.empty((len(heads), len(tails), 4), np.uint32)
    head_sizes, tail_sizes = np.array([len(h) for h in heads], np.int64), np.array([len(t) for t in tails], np.int64)
    for size in np.unique(head_sizes).tolist():
        own_heads = np.nonzero(head_sizes == size)[0]
        head_words = -(-size // 4)
        first = np.frombuffer(b"".join(heads[i].ljust(4 * head_words, b"\0") for i in own_heads.tolist()), "<u4").reshape(len(own_heads), head_words)
        blocks = (size + tail_sizes + 8) // 64 + 1
        for n_blocks in np.unique(blocks).tolist():
            own_tails = np.nonzero(blocks == n_blocks)[0]
            texts = [bytes(size) + tails[i] + b"\x80" for i in own_tails.tolist()]
            ends = [(8 * (len(text) - 1)).to_bytes(8, "little") for text in texts]
            padded = b"".join(text.ljust(64 * n_blocks - 8, b"\0") + end for text, end in zip(texts, ends))
            rest = np.ascontiguousarray(np.frombuffer(padded, "<u4").reshape(len(texts), -1).T)
            step_tails = min(len(texts), BLOCK)
            step_heads = max(1, BLOCK // step_tails)
            for from_head in range(0, len(own_heads), step_heads):
                at = slice(from_head, from_head + step_heads)
                for from_tail in range(0, len(texts), step_tails):
                    some = rest[:, from_tail:from_tail + step_tails]
                    shape = (len(own_heads[at]), some.shape[1])
                    words = [first[at, w, None] | some[w] if w < head_words else some[w] for w in range(len(some))]
                    state = [np.full(shape, x, np.uint32) for x in START]
                    for block in range(n_blocks):
                        state = _compress(state, words[16 * block:16 * block + 16])
                    place = np.ix_(own_heads[at], own_tails[from_tail:from_tail + step_tails])
                    for k, word in enumerate(state):
                        out[..., k][place] = word.byteswap()
    return out
