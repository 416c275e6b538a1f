"""Edit distances of word sequences by Myers' bit vectors, one bit for each word of the pattern."""

from __future__ import annotations

from collections.abc import Hashable, Sequence


def distances(pattern: Sequence[Hashable], text: Sequence[Hashable], anywhere: bool = True) -> list[int]:
    """For each end in text, the fewest edits between pattern and a stretch of text that ends there.

    With anywhere False, the stretch starts where text starts. Python's integers hold patterns of any length.
    """
    m = len(pattern)
    if not m:
        return [0 if anywhere else j + 1 for j in range(len(text))]
    masks: dict[Hashable, int] = {}
    for i, x in enumerate(pattern):
        masks[x] = masks.get(x, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score, out = full, 0, m, []  # vertical differences of +1 and -1
    for x in text:
        eq = masks.get(x, 0)
        vertical = eq | down
        across = (((eq & up) + up) ^ up) | eq
        plus = down | ~(across | up) & full
        minus = up & across
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        plus = (plus << 1 | (0 if anywhere else 1)) & full
        minus = minus << 1 & full
        up = minus | ~(vertical | plus) & full
        down = plus & vertical
        out.append(score)
    return out


def distance(a: Sequence[Hashable], b: Sequence[Hashable]) -> int:
    """Edits that turn a into b."""
    return distances(a, b, anywhere=False)[-1] if len(b) else len(a)
