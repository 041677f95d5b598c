"""Numpy helpers for work inside binary values; Spark cuts the files into chunks and combines the rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd


def run_summary(breaks: np.ndarray, n: int) -> tuple[int, int, int, int]:
    """(n, prefix, suffix, best) of the runs between sorted break positions in ``range(n)``."""
    if len(breaks) == 0:
        return n, n, n, n
    prefix, suffix = int(breaks[0]), int(n - 1 - breaks[-1])
    inner = int(np.diff(breaks).max()) - 1 if len(breaks) > 1 else 0
    return n, prefix, suffix, max(prefix, suffix, inner)


def _bytes(value: bytes | None) -> np.ndarray:
    return np.frombuffer(value or b"", dtype=np.uint8)


def compare_overlap(frames: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """U4: bytes both chunks have: count, unequal bytes and bits, first unequal, equal-run summary."""
    for pdf in frames:
        rows = []
        for a, b in zip(pdf["a"], pdf["b"]):
            x, y = _bytes(a), _bytes(b)
            n = min(len(x), len(y))
            delta = x[:n] ^ y[:n]
            at = np.flatnonzero(delta)
            bits = int(np.bitwise_count(delta[at]).sum()) if len(at) else 0
            rows.append((len(at), bits, int(at[0]) if len(at) else None, *run_summary(at, n)))
        out = pd.DataFrame(rows, columns=["diff", "bits", "first", "n", "pre", "suf", "best"], dtype="object")
        yield pd.concat([pdf[keys].reset_index(drop=True), out], axis=1)


LOCKSTEP_COLUMNS = [
    "diff", "first", "n", "pre", "suf", "best",
    "bits", "first_bit", "bn", "bpre", "bsuf", "bbest",
    "equal_blocks", "first_block", "kn", "kpre", "ksuf", "kbest", "same_blocks", "same_bytes",
]


def compare_lockstep(frames: Iterator[pd.DataFrame], keys: list[str], block: int) -> Iterator[pd.DataFrame]:
    """U4: both chunks from the same offset, the shorter one missing bytes at its end.

    Missing bytes count as unequal bytes, as 0x00 in the bit view and in padded blocks;
    ``same_blocks`` counts unpadded blocks equal in content and length.
    """
    for pdf in frames:
        rows = []
        for a, b in zip(pdf["a"], pdf["b"]):
            x, y = _bytes(a), _bytes(b)
            n, m = min(len(x), len(y)), max(len(x), len(y))
            px, py = np.zeros(m, np.uint8), np.zeros(m, np.uint8)
            px[: len(x)], py[: len(y)] = x, y
            delta = px ^ py
            unequal = delta != 0
            missing = unequal.copy()
            missing[n:] = True
            byte_at = np.flatnonzero(missing)
            at = np.flatnonzero(unequal)
            grid = np.unpackbits(delta[at]).reshape(-1, 8)
            bit_at = (at[:, None] * 8 + np.arange(8))[grid == 1]
            starts = np.arange(0, m, block)
            bad = np.add.reduceat(unequal, starts) > 0 if m else np.zeros(0, bool)
            bad_at = np.flatnonzero(bad)
            whole = (starts < n) & (np.minimum(starts + block, len(x)) == np.minimum(starts + block, len(y)))
            rows.append((
                len(byte_at), int(byte_at[0]) if len(byte_at) else None, *run_summary(byte_at, m),
                len(bit_at), int(bit_at[0]) if len(bit_at) else None, *run_summary(bit_at, m * 8),
                int((~bad).sum()), int(bad_at[0]) if len(bad_at) else None, *run_summary(bad_at, len(starts)),
                int((whole & ~bad).sum()), int(n - unequal[:n].sum()),
            ))
        out = pd.DataFrame(rows, columns=LOCKSTEP_COLUMNS, dtype="object")
        yield pd.concat([pdf[keys].reset_index(drop=True), out], axis=1)


def correlate(frames: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Votes per index difference for two bounded lists of sorted block indices of equal content.

    Output rows are differences, at most the sum of the two spans, never pairs. One frame goes out per so many of them.
    """
    for pdf in frames:
        parts: list[tuple[np.ndarray, ...]] = []
        size = 0
        for at, (o, c) in enumerate(zip(pdf["o_idx"], pdf["c_idx"])):
            o, c = np.asarray(o), np.asarray(c)
            low = int(o[0] - c[-1])
            votes = np.zeros(int(o[-1] - c[0]) - low + 1, np.int64)
            first = np.zeros(len(votes), np.int64)
            for i in c[::-1]:  # descending, so the smallest carved index is written last
                spot = o - i - low
                votes[spot] += 1
                first[spot] = i
            hit = np.flatnonzero(votes)
            parts.append((np.full(len(hit), at), hit + low, votes[hit], first[hit]))
            size += len(hit)
            if size > 200_000:
                yield _voted(pdf, keys, parts)
                parts, size = [], 0
        if parts:
            yield _voted(pdf, keys, parts)


def _voted(pdf: pd.DataFrame, keys: list[str], parts: list[tuple[np.ndarray, ...]]) -> pd.DataFrame:
    row, d, votes, first = (np.concatenate(x) for x in zip(*parts))
    named = {k: pdf[k].to_numpy()[row] for k in keys}
    return pd.DataFrame({**named, "d": d, "votes": votes, "ci": first, "oi": d + first})
