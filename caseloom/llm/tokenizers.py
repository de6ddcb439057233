"""Public tokenizers read from a folder of vocabulary files; nothing is trained."""

from __future__ import annotations

import base64
import heapq
import os
from functools import lru_cache

#: Where the vocabulary files are; a parameter of every operator that tokenizes.
TOKENIZER_DIR = os.environ.get("CASELOOM_TOKENIZERS", "/opt/tokenizers")

# Fixed value: the published pattern that splits text before byte-level merges.
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)


@lru_cache(maxsize=4)
def ranks(name: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> dict[bytes, int]:
    """Token bytes -> id of a rank file."""
    with open(f"{folder}/{name}.tiktoken", "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge(word: bytes, table: dict[bytes, int]) -> list[int]:
    """Ids of one word by exact byte-pair merges, lowest rank first, leftmost on ties.

    A heap over a linked list: n log n even where a word is a whole text.
    """
    if (whole := table.get(word)) is not None:
        return [whole]
    n = len(word)
    end = list(range(1, n + 1))  # end[i]: where the piece that starts at i ends
    before = list(range(-1, n - 1))
    alive = [True] * n
    heap: list[tuple[int, int, int, int]] = []

    def offer(i: int) -> None:
        j = end[i]
        if j < n and (rank := table.get(word[i : end[j]])) is not None:
            heapq.heappush(heap, (rank, i, j, end[j]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, j, k = heapq.heappop(heap)
        if not (alive[i] and end[i] == j and j < n and alive[j] and end[j] == k):
            continue
        alive[j] = False
        end[i] = k
        if k < n:
            before[k] = i
        if before[i] >= 0:
            offer(before[i])
        offer(i)
    ids, i = [], 0
    while i < n:
        ids.append(table[word[i : end[i]]])
        i = end[i]
    return ids


@lru_cache(maxsize=4)
def counter(name: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR):
    """The installed encoder over a rank file, for counts."""
    import tiktoken

    spec = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return tiktoken.Encoding(name, pat_str=spec, mergeable_ranks=ranks(name, folder), special_tokens={})
